"""Opening scenes, recognised names and boxes in frames."""
from __future__ import annotations

from pyspark.sql import functions as F

from tideline import views
from tideline.catalog import query
from tideline.catalog.caption_queries import WIN, _clips
from tideline.catalog.prefix import sql
from tideline.plans import hooks as h
from tideline.plans import identity as i
from tideline.plans import panels as pn
from tideline.session import settle


def _hook_lines(spark, d):
    return settle(h.hook_lines(views.transcript(spark, d)))


def _hook_clips(spark, d):
    return _clips(spark, d).withColumns({"given_peak": F.col("w_start") + 12.5, "given_hook": F.lit("Wait until you see what happens next?"), "title": F.concat(F.lit("The big moment of day "), F.col("wid").cast("string"))})


@query("teaser_peaks")
def teaser_peaks(spark, d):
    """Opening moment of every clip."""
    return h.teaser_peaks(h.hook_lines(views.transcript(spark, d)), _clips(spark, d)).select("video_id", "wid", "teaser_at", F.round("teaser_score", 4).alias("teaser_score"))


@query("hook_phrases", sql("""SELECT video_id, wid, pseq::INT AS seq, array_to_string(ws[1:14], ' ') AS text FROM (SELECT video_id, wid, f AS pseq, string_split(string_agg(clean, ' ' ORDER BY seq), ' ') AS ws FROM walk GROUP BY 1, 2, 3) WHERE len(ws) >= 3""", "line", more=WIN + """,
cl AS (SELECT l.video_id, wid, seq, l."start", l."end", trim(regexp_replace(regexp_replace(text, '(?i)\\b(um|uh|like|you know|sort of|kind of|i mean|basically|actually|literally)\\b', '', 'g'), '\\s+', ' ', 'g')) AS clean
  FROM line l JOIN win w ON l.video_id = w.video_id AND l."start" BETWEEN w_start AND w_end),
cg AS (SELECT *, "start" - lag("end") OVER (PARTITION BY video_id, wid ORDER BY "start", seq) AS g FROM cl),
cn AS (SELECT *, len(string_split(clean, ' ')) AS n, row_number() OVER (PARTITION BY video_id, wid ORDER BY "start", seq) AS rn FROM cg WHERE clean <> ''),
walk AS (SELECT video_id, wid, rn, seq, clean, seq AS f, least(14, n) AS c FROM cn WHERE rn = 1 UNION ALL
  SELECT x.video_id, x.wid, x.rn, x.seq, x.clean, CASE WHEN w.c >= 14 OR greatest(0, x.g) > 0.85 THEN x.seq ELSE w.f END, least(14, CASE WHEN w.c >= 14 OR greatest(0, x.g) > 0.85 THEN x.n ELSE w.c + x.n END) FROM walk w JOIN cn x ON x.video_id = w.video_id AND x.wid = w.wid AND x.rn = w.rn + 1)""", recursive=True))
def hook_phrases(spark, d):
    return h.phrases(_hook_lines(spark, d), _clips(spark, d)).select("video_id", "wid", "seq", "text")


@query("hook_analysis")
def hook_analysis(spark, d):
    """Teaser, tease and length for every clip."""
    return h.analyse(_hook_lines(spark, d), _clips(spark, d)).select("video_id", "wid", "teaser_at", "tease", "teaser_sec")


@query("hook_resolution")
def hook_resolution(spark, d):
    """Given hooks merged with the local analysis."""
    return h.resolve(_hook_lines(spark, d), _hook_clips(spark, d)).select("video_id", "wid", "peak", "hook", "teaser_sec")


@query("hook_word_peaks", sql("""SELECT w.video_id, w.wid, min(l."start") AS word_peak FROM win w LEFT JOIN line l ON l.video_id = w.video_id AND l."start" BETWEEN w_start AND w_end
AND contains(lower(text), 'there')::INT + contains(lower(text), 'tion')::INT + contains(lower(text), 'zzzzz')::INT >= 2 GROUP BY 1, 2""", "line", more=WIN))
def hook_word_peaks(spark, d):
    lines = views.transcript(spark, d).withColumns({"clean": F.col("text"), "base": F.lit(0.0), "gap": F.lit(0.0)})
    return h.hook_word_peaks(lines, _clips(spark, d).withColumn("given_hook", F.lit("There, tion zzzzz!"))).select("video_id", "wid", "word_peak")


PLAYERS = ("simple", "device", "zywoo", "niko", "electronic", "twistzz", "ropz")
FOES = ("falcon", "raven_x", "ghost-7", "tiger", "wolfpack", "ember", "quartz", "onyx", "saffron", "cobalt", "maple")


def _ocr(spark, d):
    e = views.kill_events(spark, d)
    pick = lambda names, c: F.element_at(F.array(*[F.lit(n) for n in names]), (c % len(names) + 1).cast("int"))
    killer = F.when(F.col("seq") % 3 != 0, pick(PLAYERS, F.col("video_id"))).otherwise(pick(PLAYERS, F.col("seq")))
    noisy = F.when(F.col("seq") % 5 == 0, F.translate(killer, "i", "1")).otherwise(killer)
    foe = pick(FOES, F.col("seq"))
    raw = F.when(F.col("seq") % 7 == 0, noisy).when(F.col("seq") % 11 == 0, F.concat_ws(" ", foe, killer)).when(F.col("seq") % 4 == 0, F.concat_ws(" + ", noisy, pick(PLAYERS, F.col("seq") + 2), foe)).otherwise(F.concat_ws(" [x] ", noisy, foe))
    return e.select("video_id", "seq", (F.floor(F.col("time") * 2) / 2).alias("time"), raw.alias("raw_ocr"), (F.col("highlight_score") / 5).alias("border_score"))


def _anchored(spark, d):
    reads = settle(i.read_feed(_ocr(spark, d)).filter(F.col("time") >= i.SPAWN_CUTOFF))
    return reads, settle(i.backward_anchors(reads, reads))


def _entries(spark, d):
    reads, anchored = _anchored(spark, d)
    return reads, settle(i.registry(anchored))


@query("feed_readings", sql("""SELECT video_id, seq, CASE WHEN seq % 7 = 0 THEN 'partial|' || noisy WHEN seq % 11 = 0 THEN foe || '||' || killer WHEN seq % 4 = 0 THEN noisy || '|' || helper || '|' || foe ELSE noisy || '||' || foe END AS read_key FROM (
  SELECT video_id, seq, killer, CASE WHEN seq % 5 = 0 THEN replace(killer, 'i', '1') ELSE killer END AS noisy, helper, foe FROM (SELECT video_id, seq, CASE WHEN seq %% 3 <> 0 THEN ([%s])[video_id %% 7 + 1] ELSE ([%s])[seq %% 7 + 1] END AS killer,
  ([%s])[(seq + 2) %% 7 + 1] AS helper, ([%s])[seq %% 11 + 1] AS foe FROM kill_event))""".replace("% 7 = 0", "%% 7 = 0").replace("% 11 = 0", "%% 11 = 0").replace("% 4 = 0", "%% 4 = 0").replace("% 5 = 0", "%% 5 = 0")
                            % tuple(", ".join(f"'{n}'" for n in names) for names in (PLAYERS, PLAYERS, PLAYERS, FOES)), "kill_event"))
def feed_readings(spark, d):
    return i.read_feed(_ocr(spark, d)).select("video_id", "seq", "read_key")


@query("backward_anchors")
def backward_anchors(spark, d):
    """Where each seed reading first became visible."""
    return _anchored(spark, d)[1].select("video_id", "seq", "time", "anchor", "best_conf")


@query("feed_registry")
def feed_registry(spark, d):
    """Distinct feed lines of every recording."""
    return _entries(spark, d)[1]


@query("name_clusters")
def name_clusters(spark, d):
    """Clusters of similar names."""
    reads = i.read_feed(_ocr(spark, d))
    return i.name_clusters(reads.select("video_id", F.col("seq").cast("double").alias("pos"), F.col("killer").alias("name")))


@query("pov_cluster")
def pov_cluster(spark, d):
    """The dominant player of every recording."""
    return i.pov_cluster(_entries(spark, d)[1])


def _classified(spark, d):
    _, entries = _entries(spark, d)
    clusters = settle(i.name_clusters(entries.filter("killer <> ''").select("video_id", F.col("entry").cast("double").alias("pos"), F.col("killer").alias("name"))))
    return entries, i.classify_entries(entries, settle(i.pov_cluster(entries, clusters)), clusters)


@query("classify_entries")
def classify_entries(spark, d):
    """Kill, death or skip for every feed line."""
    return _classified(spark, d)[1].select("video_id", "entry", "killer", "victim", "pov", "kind", "reason")


@query("entry_events")
def entry_events(spark, d):
    """Classified kills in the event schema."""
    return i.to_events(_classified(spark, d)[1])


@query("skip_reasons")
def skip_reasons(spark, d):
    """Why feed lines were skipped."""
    return i.skip_reasons(_classified(spark, d)[1])


@query("identity_funnel")
def identity_funnel(spark, d):
    """Counters of every stage per recording."""
    ocr = _ocr(spark, d)
    reads = i.read_feed(ocr)
    entries, classified = _classified(spark, d)
    return i.funnel(ocr, reads, entries, classified)


@query("plausible_tags", sql("""SELECT c_custkey, length(c_name) BETWEEN 3 AND 22 AND regexp_matches(c_mktsegment, '^[A-Za-z0-9_\\-]+$') AND NOT contains(lower(c_mktsegment), 'pov') AS plausible FROM customer"""))
def plausible_tags(spark, d):
    return views.table(spark, d, "customer").select("c_custkey", i.plausible_tag(F.col("c_mktsegment")).alias("plausible"))


@query("streamer_tokens", sql("""SELECT p_partkey, list_sort(list_distinct(list_filter(string_split(p_name, ' ') || [lower(p_type)], lambda t: length(t) >= 4))) AS tokens FROM part"""))
def streamer_tokens(spark, d):
    return views.table(spark, d, "part").select("p_partkey", F.array_sort(i.streamer_tokens(F.col("p_name"), F.col("p_type"))).alias("tokens"))


@query("feed_names_streamer", sql("""SELECT p_partkey, contains(replace(p_name, ' ', ''), 'ring') OR contains(replace(p_name, ' ', ''), 'boltred') AS named FROM part"""))
def feed_names_streamer(spark, d):
    return views.table(spark, d, "part").select("p_partkey", i.names_streamer(F.col("p_name"), F.array(F.lit("ring"), F.lit("boltred"))).alias("named"))


@query("name_normalise", sql("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9_\\-]', '', 'g') AS norm FROM part"))
def name_normalise(spark, d):
    return views.table(spark, d, "part").select("p_partkey", i.normalise_name(F.col("p_name")).alias("norm"))


FRAMES = """hit AS (SELECT l_suppkey AS video_id, l_orderkey * 10 + l_linenumber AS seq, l_partkey AS pk, l_quantity AS q1, l_discount AS q2, l_tax AS q3, epoch_ms(l_shipdate) / 86400000.0 * 2 - 18000 AS t, l_quantity * 2 AS x, l_discount * 300 AS y, 900 + l_tax * 500 AS w, 500 + l_linenumber * 5.0 AS h FROM lineitem),
one AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY video_id, seq ORDER BY pk, q1, q2, q3, t) = 1),
lagged AS (SELECT *, lag(t) OVER o AS pt, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(w) OVER o AS pw, lag(h) OVER o AS ph FROM one WINDOW o AS (PARTITION BY video_id ORDER BY t, seq)),
inter AS (SELECT *, greatest(0, least(x + w, px + pw) - greatest(x, px)) * greatest(0, least(y + h, py + ph) - greatest(y, py)) AS shared FROM lagged),
chained AS (SELECT *, sum(CASE WHEN t - pt <= 4.5 AND shared / greatest(w * h + pw * ph - shared, 1) > 0.35 THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY t, seq) AS chain FROM inter)"""


def _hits(spark, d):
    li = views.table(spark, d, "lineitem")
    rows = li.select(F.col("l_suppkey").alias("video_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "l_partkey", "l_quantity", "l_discount", "l_tax", (F.unix_millis(F.col("l_shipdate").cast("timestamp")) / 86400000.0 * 2 - 18000).alias("t"),
                     (F.col("l_quantity") * 2).alias("x"), (F.col("l_discount") * 300).alias("y"), (900 + F.col("l_tax") * 500).alias("w"), (500 + F.col("l_linenumber") * 5.0).alias("h"))
    return rows.groupBy("video_id", "seq").agg(F.min_by(F.struct("t", "x", "y", "w", "h"), F.struct("l_partkey", "l_quantity", "l_discount", "l_tax", "t")).alias("r")).select("video_id", "seq", "r.*")


@query("panel_chains", sql("SELECT video_id, chain::BIGINT AS chain, count(*) AS hits, round(sum(x), 4) AS sum_x FROM chained GROUP BY 1, 2", more=FRAMES))
def panel_chains(spark, d):
    hits = _hits(spark, d).withColumn("score", F.lit(1.0))
    return pn.chains(hits).groupBy("video_id", "chain").agg(F.count(F.lit(1)).alias("hits"), F.round(F.sum("x"), 4).alias("sum_x"))


PANELS = FRAMES.replace("one AS (", "raw1 AS (", 1).replace("lagged AS (SELECT *, lag(t)", """moved AS (SELECT *, w * h AS area, w / greatest(h, 1.0) AS aspect, sqrt((x + 450 + w / 2 - 960) ** 2 + (y + 200 + h / 2 - 540) ** 2) AS dist FROM raw1),
one AS (SELECT *, area * (1 - dist / 540.0) * least(w / 607.0, 2.2) AS score FROM moved WHERE area BETWEEN 207360 AND 1824768 AND aspect BETWEEN 0.85 AND 4.2 AND w >= 607.0 * 1.06 AND dist <= 410.4
  AND area * (1 - dist / 540.0) * least(w / 607.0, 2.2) > 0),
lagged AS (SELECT *, lag(t)""", 1) + """,
seg AS (SELECT video_id, chain, count(*) AS n, sum(score) AS total, avg(x) AS x, avg(y) AS y, avg(w) AS w, avg(h) AS h, min(t) AS t0, max(t) AS t1 FROM chained GROUP BY 1, 2),
top AS (SELECT *, total / n AS mean FROM seg QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY total * n DESC, chain) = 1),
box AS (SELECT *, greatest(0, floor(x) - 38) AS x1, greatest(0, floor(y) - 21) AS y1, greatest(0, t0 - 0.4) AS s0, least(10000, t1 + 1.2) AS e0 FROM top WHERE n >= 2 AND mean >= 607.0 * 1080 * 0.015),
timed AS (SELECT *, CASE WHEN e0 - s0 < 1.5 THEN least(10000, s0 + 2.5) ELSE e0 END AS s1 FROM box)"""


@query("best_panels", sql("""SELECT video_id, n, x1::INT AS box_x, y1::INT AS box_y, (least(1920, floor(x) + floor(w) + 38) - x1)::INT AS box_w, (least(1080, floor(y) + floor(h) + 21) - y1)::INT AS box_h,
  round_even(greatest(0, s0), 2) AS start_time, round_even(least(10000, s1), 2) AS end_time, round_even(least(1.0, mean / (607.0 * 1080 * 0.08)), 3) AS confidence FROM timed""", more=PANELS))
def best_panels(spark, d):
    """The strongest panel of every recording."""
    hits = _hits(spark, d).withColumn("score", pn.panel_score(F.col("x") + 450, F.col("y") + 200, F.col("w"), F.col("h"), 1920.0, 1080.0)).filter("score > 0")
    return pn.best_panel(hits, F.lit(0.0), F.lit(10000.0), 1920.0, 1080.0)


@query("webcam_corner", sql("""WITH f AS (SELECT l_suppkey AS video_id, l_orderkey + l_linenumber / 10.0 AS t, (['top-left', 'top-right', 'bottom-left', 'bottom-right'])[l_linenumber % 4 + 1] AS corner, l_quantity::BIGINT AS area, l_partkey AS sharp FROM lineitem),
c AS (SELECT video_id, corner, sum(area) AS a FROM f GROUP BY 1, 2), top AS (SELECT video_id, arg_max(corner, (a, corner)) AS corner FROM c GROUP BY 1)
SELECT video_id, corner, max(area * (1 + sharp / 500)) AS best_score FROM top JOIN f USING (video_id, corner) GROUP BY 1, 2""".replace("FROM top JOIN f USING (video_id, corner)", "FROM (SELECT top.video_id, top.corner, f.area, f.sharp FROM top JOIN f ON top.video_id = f.video_id)")))
def webcam_corner(spark, d):
    corners = F.array(*[F.lit(c) for c in ("top-left", "top-right", "bottom-left", "bottom-right")])
    faces = views.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("video_id"), (F.col("l_orderkey") + F.col("l_linenumber") / 10.0).alias("t"), F.element_at(corners, F.col("l_linenumber") % 4 + 1).alias("corner"),
                                                     F.col("l_quantity").cast("bigint").alias("area"), F.col("l_partkey").alias("sharp"))
    best = faces.groupBy("video_id").agg(F.max(F.col("area") * (1 + F.col("sharp") / 500)).alias("best_score"))
    return pn.webcam_corner(faces).join(best, "video_id").select("video_id", "corner", "best_score")
