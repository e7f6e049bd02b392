"""Joins between events, windows and candidates, and the selection rules."""
from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline import views
from tideline.catalog import query
from tideline.catalog.kill_queries import FEED, PACKS, QUALITY
from tideline.catalog.prefix import sql, tenth
from tideline.functions import events as ev
from tideline.functions.profiles import PROFILES
from tideline.operators.ranges import band_join, nearest_join
from tideline.plans import kills as k
from tideline.plans import review
from tideline.plans import select as s
from tideline.plans import windows as w

KEY = ["video_id"]

CAND = f"""cand AS (SELECT video_id, seq, {tenth('"time"')} AS start_time, {tenth('"time"')} + 12 + seq % 30 AS end_time, floor(highlight_score * 1000) AS local_score, 40 + (seq * 7) % 60 AS confidence,
  floor(highlight_score * 20) AS viral_score, (seq % 5)::INT AS kills, seq % 5 >= 3 AS montage, row_number() OVER (PARTITION BY video_id ORDER BY highlight_score DESC, seq)::INT AS arrival FROM kill_event)"""


def _cand(spark, d):
    e = views.kill_events(spark, d)
    start = F.floor(F.col("time") * 10 + 0.5) / 10
    rank = F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("highlight_score"), "seq"))
    return e.select("video_id", "seq", start.alias("start_time"), (start + 12 + F.col("seq") % 30).alias("end_time"), F.floor(F.col("highlight_score") * 1000).cast("double").alias("local_score"),
                    (40 + (F.col("seq") * 7) % 60).alias("confidence"), F.floor(F.col("highlight_score") * 20).cast("double").alias("viral_score"), (F.col("seq") % 5).cast("int").alias("kills"),
                    (F.col("seq") % 5 >= 3).alias("montage"), rank.alias("arrival"))


def _conflict(share, gap):
    return (f"(abs(k.s - p[1].s) < {gap} OR (least(k.e, p[1].e) > greatest(k.s, p[1].s) AND (least(k.e, p[1].e) - greatest(k.s, p[1].s)) / least(k.e - k.s, p[1].e - p[1].s) > {share}))")


def greedy(src, order, conflict, most):
    return f"""g0 AS (SELECT video_id, list({{'s': start_time, 'e': end_time, 'q': seq}} ORDER BY {order}) AS ps FROM {src} GROUP BY video_id),
g1 AS (SELECT video_id, list_reduce(list_transform(ps, lambda x: [x]), lambda acc, p: CASE WHEN len(acc) > {most} OR len(list_filter(acc, lambda k: {conflict})) > 0 THEN acc ELSE list_append(acc, p[1]) END,
  [{{'s': -1e9::DOUBLE, 'e': -1e9::DOUBLE + 1, 'q': -1::BIGINT}}]) AS kept FROM g0),
picked AS (SELECT video_id, i::INT - 1 AS place, kept[i].q AS seq FROM g1, unnest(range(2, len(kept) + 1)) AS t(i))"""


# ---------------------------------------------------------------- joins


@query("nearest_event", sql("""SELECT a.video_id, a.seq, n.seq AS near_seq, round(n.d, 9) AS distance FROM kill_event a LEFT JOIN LATERAL (
  SELECT b.seq, abs(b."time" - a."time") AS d FROM kill_event b WHERE b.video_id = a.video_id AND starts_with(b.roi, 'top_right') AND abs(b."time" - a."time") <= 2.5 ORDER BY abs(b."time" - a."time"), b.seq LIMIT 1) n ON true""", "kill_event"))
def nearest_event(spark, d):
    e = views.kill_events(spark, d)
    out = nearest_join(e.select("video_id", "seq", "time"), e.filter("roi like 'top_right%'"), KEY, ["seq"], F.col("time"), F.col("time"), ["seq"], 2.5, {"near_seq": "seq"})
    return out.select("video_id", "seq", "near_seq", F.round("distance", 9).alias("distance"))


@query("confirmed_peaks", sql("""SELECT video_id, count(*) AS confirmed FROM kill_event a WHERE NOT starts_with(roi, 'top_right') AND EXISTS (SELECT 1 FROM kill_event b WHERE b.video_id = a.video_id AND starts_with(b.roi, 'top_right')
  AND abs(b."time" - a."time") <= 3.5) GROUP BY 1""", "kill_event"))
def confirmed_peaks(spark, d):
    e = views.kill_events(spark, d)
    peaks, feed = e.filter("roi not like 'top_right%'").select("video_id", "seq", "time"), e.filter("roi like 'top_right%'").select("video_id", F.col("time").alias("_t"))
    near = band_join(peaks, feed, KEY, F.col("time"), F.col("_t"), 3.5, 3.5).filter(F.abs(F.col("_t") - F.col("time")) <= 3.5).select("video_id", "seq").distinct()
    return near.groupBy("video_id").agg(F.count(F.lit(1)).alias("confirmed"))


EWIN = """ewin AS (SELECT DISTINCT video_id, i::INT AS wid, i * 30.0::DOUBLE AS w_start, i * 30.0::DOUBLE + 45 AS w_end FROM kill_event, range(0, 87) AS r(i))"""


def _ewin(spark, d):
    ids = views.kill_events(spark, d).select("video_id").distinct()
    return ids.select("video_id", F.explode(F.sequence(F.lit(0), F.lit(86))).alias("wid")).select("video_id", "wid", (F.col("wid") * F.lit(30.0)).alias("w_start"), (F.col("wid") * F.lit(30.0) + 45).alias("w_end"))


@query("hud_window_boost", sql("""SELECT video_id, wid, coalesce(kills, 0) AS kills, CASE WHEN coalesce(kills, 0) > 0 THEN least(120.0, kills * 28 + high * 12) ELSE 0 END::DOUBLE AS boost FROM ewin LEFT JOIN (
  SELECT w.video_id, w.wid, count(*) AS kills, count(*) FILTER (WHERE confidence >= 0.65) AS high FROM ewin w JOIN kill_event e ON e.video_id = w.video_id AND e."time" >= w_start - 0.5 AND e."time" <= w_end + 0.5 AND confidence >= 0.5 GROUP BY 1, 2) USING (video_id, wid)""", "kill_event", more=EWIN))
def hud_window_boost(spark, d):
    return w.event_boost(views.kill_events(spark, d).select("video_id", "time", "confidence"), _ewin(spark, d)).select("video_id", "wid", "kills", "boost")


HIGH = CAND + """,
pool AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY local_score DESC, seq)::INT AS list_index FROM cand),
hl AS (SELECT video_id, seq AS hid, start_time + 1.5 AS start_time, end_time + 4 AS end_time, CASE WHEN seq % 4 = 0 THEN (seq % 9)::INT END AS candidate_id FROM cand),
hit AS (SELECT h.video_id, h.hid, min(p.list_index) AS match_index FROM hl h JOIN pool p ON p.video_id = h.video_id AND (p.list_index = h.candidate_id OR abs(p.start_time - h.start_time) < 4
  OR (least(p.end_time, h.end_time) > greatest(p.start_time, h.start_time) AND (least(p.end_time, h.end_time) - greatest(p.start_time, h.start_time)) / least(p.end_time - p.start_time, h.end_time - h.start_time) > 0.5)) GROUP BY 1, 2)"""


def _pool(spark, d):
    return _cand(spark, d).withColumn("list_index", F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("local_score"), "seq")))


def _high(spark, d):
    return _cand(spark, d).select("video_id", F.col("seq").alias("hid"), (F.col("start_time") + 1.5).alias("start_time"), (F.col("end_time") + 4).alias("end_time"), F.when(F.col("seq") % 4 == 0, (F.col("seq") % 9).cast("int")).alias("candidate_id"))


@query("disjunctive_match", sql("SELECT h.video_id, h.hid, match_index FROM hl h LEFT JOIN hit USING (video_id, hid)", "kill_event", more=HIGH))
def disjunctive_match(spark, d):
    return s.attach_candidates(_high(spark, d), _pool(spark, d)).select("video_id", "hid", "match_index")


@query("pick_validation", sql("""SELECT p.video_id, p.seq AS pick, c.seq, c.start_time FROM (SELECT video_id, seq, (seq % 15)::INT AS n FROM cand) p JOIN pool c ON c.video_id = p.video_id AND c.list_index = p.n""", "kill_event", more=HIGH))
def pick_validation(spark, d):
    picks = _cand(spark, d).select("video_id", F.col("seq").alias("pick"), F.concat(F.when(F.col("seq") % 2 == 0, "#").otherwise(""), (F.col("seq") % 15).cast("string")).alias("candidate_id"))
    return s.resolve_picks(picks, _pool(spark, d)).select("video_id", "pick", "seq", "start_time")


MONT = PACKS + """,
mont AS (SELECT video_id, pack_seq AS seq, list("time" ORDER BY "time") AS kill_times, min("time") AS start_time, max("time") + 7 AS end_time, count(*)::INT AS kills, max("time") - min("time") + 8 AS output_duration,
  pack_seq % 2 = 0 AS backed, pack_seq % 3 <> 0 AS chain, (50 + 22 * count(*))::DOUBLE AS local_score FROM packs GROUP BY video_id, pack_seq)"""


def _montages(spark, d):
    packed = k.burst_packs(views.kill_events(spark, d))
    return packed.groupBy("video_id", F.col("pack_seq").alias("seq")).agg(
        F.sort_array(F.collect_list("at")).alias("kill_times"), F.min("at").alias("start_time"), (F.max("at") + 7).alias("end_time"), F.count(F.lit(1)).cast("int").alias("kills"),
        (F.max("at") - F.min("at") + 8).alias("output_duration")).withColumns({"backed": F.col("seq") % 2 == 0, "chain": F.col("seq") % 3 != 0, "local_score": (50 + 22 * F.col("kills")).cast("double")})


@query("share_kill_pairs", sql("""SELECT DISTINCT a.video_id, a.seq, b.seq AS other FROM (SELECT video_id, seq, unnest(kill_times) AS t FROM mont) a JOIN (SELECT video_id, seq, unnest(kill_times) AS t FROM mont) b
ON a.video_id = b.video_id AND a.seq < b.seq AND abs(a.t - b.t) < 25""", "kill_event", more=MONT, recursive=True))
def share_kill_pairs(spark, d):
    return s.sharing_pairs(_montages(spark, d), 25.0)


@query("antijoin_overlap", sql("""SELECT video_id, seq FROM mont a WHERE kills < 3 AND (SELECT count(*) FROM mont e WHERE e.video_id = a.video_id AND e.kills >= 3) < 5
AND NOT EXISTS (SELECT 1 FROM mont e WHERE e.video_id = a.video_id AND e.kills >= 3 AND (abs(e.start_time - a.start_time) < 20 OR (least(e.end_time, a.end_time) > greatest(e.start_time, a.start_time)
  AND (least(e.end_time, a.end_time) - greatest(e.start_time, a.start_time)) / least(e.end_time - e.start_time, a.end_time - a.start_time) > 0.35)))""", "kill_event", more=MONT, recursive=True))
def antijoin_overlap(spark, d):
    m = _montages(spark, d).select("video_id", "seq", "start_time", "end_time", "kills")
    return s.drop_overlapping_audio(m.filter("kills < 3"), m.filter("kills >= 3")).select("video_id", "seq")


@query("profile_lookup", sql("SELECT o_orderkey, " + "CASE cat " + " ".join(f"WHEN '{n}' THEN {p['min_clip']}" for n, p in PROFILES.items()) + " ELSE 12 END::DOUBLE AS min_clip, CASE cat " + " ".join(f"WHEN '{n}' THEN {p['max_clip']}" for n, p in PROFILES.items()) + """ ELSE 45 END::DOUBLE AS max_clip
FROM (SELECT o_orderkey, (['shooter', 'talk', 'racing', 'nothing'])[o_orderkey % 4 + 1] AS cat FROM orders)"""))
def profile_lookup(spark, d):
    from tideline.functions.text import profile_value

    cat = F.element_at(F.array(*[F.lit(c) for c in ("shooter", "talk", "racing", "nothing")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = views.table(spark, d, "orders").select("o_orderkey", cat.alias("cat"))
    return rows.select("o_orderkey", profile_value(F.col("cat"), "min_clip").alias("min_clip"), profile_value(F.col("cat"), "max_clip").alias("max_clip"))


@query("line_near_event", sql("""SELECT e.video_id, e.seq, coalesce(n.peak_line, '') AS peak_line FROM (SELECT video_id, seq, "time" % 200 AS t FROM kill_event) e LEFT JOIN LATERAL (
  SELECT left(l.text, 72) AS peak_line FROM line l WHERE l.video_id = e.video_id AND l.text <> '' AND abs(l."start" - e.t) < 8 ORDER BY abs(l."start" - e.t), l.seq LIMIT 1) n ON true""", "kill_event", "line"))
def line_near_event(spark, d):
    points = views.kill_events(spark, d).select("video_id", "seq", (F.col("time") % 200).alias("t"))
    lines = views.transcript(spark, d).filter("text <> ''").select("video_id", F.col("seq").alias("lseq"), "start", F.left("text", F.lit(72)).alias("peak_line"))
    out = nearest_join(points, lines, KEY, ["seq"], F.col("t"), F.col("start"), ["lseq"], 8.0 - 1e-9, {"peak_line": "peak_line"})
    return out.select("video_id", "seq", F.coalesce("peak_line", F.lit("")).alias("peak_line"))


# ---------------------------------------------------------------- review of detections

REVIEW = QUALITY + ",\n" + FEED + """,
vkey AS (SELECT DISTINCT video_id, floor("time" * 10 + 0.5) || '_' || roi AS pk FROM validated UNION SELECT DISTINCT video_id, floor("time" * 10 + 0.5) || '_' || roi FROM quality WHERE video_id NOT IN (SELECT video_id FROM validated)),
final_t AS (SELECT video_id, floor("time" * 10 + 0.5) / 10 AS ft FROM validated WHERE highlight_score >= 0.2),
review AS (SELECT e.video_id, e.seq, e.roi, c.seq IS NOT NULL AS confirmed, q.seq IS NOT NULL AS passes_quality, v.pk IS NOT NULL AS in_pool,
  EXISTS (SELECT 1 FROM final_t f WHERE f.video_id = e.video_id AND abs(f.ft - e."time") <= 1.8) AS in_final FROM kill_event e LEFT JOIN confirmed c USING (video_id, seq) LEFT JOIN quality q USING (video_id, seq)
  LEFT JOIN vkey v ON v.video_id = e.video_id AND v.pk = floor(e."time" * 10 + 0.5) || '_' || e.roi)"""


def _review(spark, d):
    e = views.kill_events(spark, d)
    pool = k.quality_pool(e)
    final = k.fingerprint_kills(e).filter("highlight_score >= 0.2").select("video_id", (F.floor(F.col("time") * 10 + 0.5) / 10).alias("cut_time"))
    return review.annotate(e, pool, final)


@query("event_annotation", sql("""SELECT video_id, seq, confirmed, passes_quality, in_pool, in_final, list_filter([CASE WHEN NOT confirmed THEN 'not_confirmed' END, CASE WHEN confirmed AND NOT passes_quality THEN 'quality_filter' END,
  CASE WHEN passes_quality AND NOT in_pool THEN 'excluded_from_montage_pool' END], lambda x: x IS NOT NULL) AS reasons FROM review""", "kill_event", more=REVIEW))
def event_annotation(spark, d):
    return _review(spark, d).select("video_id", "seq", "confirmed", "passes_quality", "in_pool", "in_final", "reasons")


@query("review_summary", sql("""SELECT video_id, count(*) AS total_detected, count(*) FILTER (WHERE confirmed) AS confirmed, count(*) FILTER (WHERE passes_quality) AS passes_quality, count(*) FILTER (WHERE in_pool) AS in_pool,
  count(*) FILTER (WHERE in_final) AS in_final FROM review GROUP BY 1""", "kill_event", more=REVIEW))
def review_summary(spark, d):
    return review.summary(_review(spark, d))


@query("reject_histogram", sql("""SELECT reason, count(*) AS events FROM (SELECT unnest(list_filter([CASE WHEN NOT confirmed THEN 'not_confirmed' END, CASE WHEN confirmed AND NOT passes_quality THEN 'quality_filter' END,
  CASE WHEN passes_quality AND NOT in_pool THEN 'excluded_from_montage_pool' END], lambda x: x IS NOT NULL)) AS reason FROM review) GROUP BY 1""", "kill_event", more=REVIEW))
def reject_histogram(spark, d):
    return review.reject_histogram(_review(spark, d))


@query("scan_health", sql("""SELECT video_id, samples, kills, kills = 0 AND samples > 0 AND samples < 50 AS suspect FROM (SELECT video_id, count(*) AS samples, count(*) FILTER (WHERE player_kill AND red_highlight AND starts_with(roi, 'top_right') AND confidence > 0.95) AS kills FROM kill_event GROUP BY 1)""", "kill_event"))
def scan_health(spark, d):
    e = views.kill_events(spark, d)
    stats = e.groupBy("video_id").agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("player_kill") & F.col("red_highlight") & ev.top_right() & (F.col("confidence") > 0.95)).alias("kills"))
    return review.scan_health(stats)


# ---------------------------------------------------------------- selection


@query("third_quota", sql("""SELECT video_id, seq, third, in_third FROM (SELECT *, row_number() OVER (PARTITION BY video_id, third ORDER BY arrival)::INT AS in_third FROM (SELECT *, least(2, floor(start_time / 864.0))::INT AS third FROM cand)) WHERE in_third <= 6""", "kill_event", more=CAND))
def third_quota(spark, d):
    return s.third_quota(_cand(spark, d), F.lit(2592.0)).select("video_id", "seq", "third", "in_third")


NON = CAND + """,
raw AS (SELECT *, least(2, floor(start_time / 864.0)) AS third FROM cand WHERE arrival <= 28),
quota AS (SELECT *, row_number() OVER (PARTITION BY video_id, third ORDER BY arrival) <= 6 AS q FROM raw),
""" + greedy("quota", "q DESC, CASE WHEN q THEN third ELSE 9 END, CASE WHEN q THEN -local_score ELSE 0 END, arrival", _conflict(0.35, 20), 28)


@query("greedy_nonoverlap", sql("SELECT video_id, seq, place FROM picked", "kill_event", more=NON))
def greedy_nonoverlap(spark, d):
    return s.merge_pool(_cand(spark, d), F.lit(2592.0)).select("video_id", "seq", "place")


RANKED = NON + """,
joined AS (SELECT c.*, p.place FROM picked p JOIN cand c USING (video_id, seq)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY kills DESC, montage DESC, local_score DESC, place)::INT AS list_index FROM joined)"""


@query("final_candidates", sql("""SELECT video_id, seq, list_index, least(99, floor(local_score / first_value(local_score) OVER (PARTITION BY video_id ORDER BY list_index) * 100 + 0.5))::INT AS confidence FROM ranked WHERE list_index <= 12""", "kill_event", more=RANKED))
def final_candidates(spark, d):
    return s.ranked_pool(s.merge_pool(_cand(spark, d), F.lit(2592.0))).select("video_id", "seq", "list_index", "confidence")


@query("shooter_pool", sql("""SELECT video_id, seq, row_number() OVER (PARTITION BY video_id ORDER BY kills DESC, montage DESC, local_score DESC, place)::INT AS list_index FROM joined j
WHERE CASE WHEN (SELECT bool_or(montage) FROM joined x WHERE x.video_id = j.video_id) THEN montage ELSE seq % 2 = 0 END QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY kills DESC, montage DESC, local_score DESC, place) <= greatest(12, (SELECT count(*) FROM joined x WHERE x.video_id = j.video_id AND montage))""", "kill_event", more=RANKED))
def shooter_pool(spark, d):
    pool = s.merge_pool(_cand(spark, d), F.lit(2592.0)).withColumn("flags", F.array(F.when(F.col("seq") % 2 == 0, "hud-kills").otherwise("none")))
    return s.shooter_pool(pool).select("video_id", "seq", "list_index")


@query("dedupe_highlights", sql("SELECT video_id, seq, place FROM picked", "kill_event", more=CAND + ",\n" + greedy("cand", "viral_score DESC, confidence DESC, seq", _conflict(0.4, 22), 7)))
def dedupe_highlights(spark, d):
    return s.dedupe_highlights(_cand(spark, d)).select("video_id", "seq", "place")


@query("peak_dedupe", sql("SELECT video_id, seq, place FROM picked", "kill_event", more="""pk AS (SELECT video_id, seq, "time" AS start_time, "time" + 1 AS end_time, CASE WHEN starts_with(roi, 'top_right') THEN 45 ELSE 0 END + confidence * 12 + confidence * 8 AS score FROM kill_event),
""" + greedy("pk", "score DESC, seq", "abs(k.s - p[1].s) < 3.5", 4)))
def peak_dedupe(spark, d):
    return review.dedupe_peaks(views.kill_events(spark, d)).select("video_id", "seq", "place")


@query("shooter_selection", sql("""SELECT video_id, seq, place FROM (SELECT video_id, i::INT - 1 AS place, kept[i].q AS seq FROM (SELECT video_id, list_reduce(list_transform(ps, lambda x: [x]), lambda acc, p: CASE WHEN len(acc) > 99 OR len(list_filter(acc, lambda k:
  CASE WHEN k.c AND p[1].c THEN len(list_filter(k.t, lambda a: len(list_filter(p[1].t, lambda b: abs(a - b) < 3)) > 0)) > 0 ELSE abs(k.s - p[1].s) < 90 OR (least(k.e, p[1].e) > greatest(k.s, p[1].s) AND (least(k.e, p[1].e) - greatest(k.s, p[1].s)) / least(k.e - k.s, p[1].e - p[1].s) > 0.35) END)) > 0
  THEN acc ELSE list_append(acc, p[1]) END, [{'s': -1e9::DOUBLE, 'e': -1e9::DOUBLE + 1, 'q': -1::BIGINT, 'c': false, 't': []::DOUBLE[]}]) AS kept FROM (
  SELECT video_id, list({'s': start_time, 'e': end_time, 'q': seq, 'c': chain, 't': kill_times} ORDER BY kills DESC, output_duration DESC, backed DESC, local_score DESC, seq) AS ps FROM (SELECT *, count(*) FILTER (WHERE chain) OVER (PARTITION BY video_id) AS nc FROM mont) WHERE nc < 2 OR chain GROUP BY video_id)), unnest(range(2, len(kept) + 1)) AS t(i))""",
                              "kill_event", more=MONT, recursive=True))
def shooter_selection(spark, d):
    return s.shooter_selection(_montages(spark, d)).select("video_id", "seq", "place")


@query("quality_selection")
def quality_selection(spark, d):
    """Three to five highlights per recording from picks and candidates."""
    pool = s.ranked_pool(s.merge_pool(_cand(spark, d), F.lit(2592.0)))
    c = pool.select("video_id", "list_index", "start_time", "end_time", "local_score", (F.col("local_score") / 20).alias("text_score"), "confidence", "montage")
    picks = c.select("video_id", F.col("list_index").alias("candidate_id"), "start_time", "end_time", F.col("text_score").alias("quality"), "confidence",
                                                 (F.col("text_score") >= 8).alias("strong"), F.col("list_index").alias("rank"))
    return s.quality_selection(picks, c, F.lit(2592.0))


@query("valid_highlights", sql("""SELECT video_id, seq, CASE WHEN montage THEN start_time ELSE greatest(0, least(start_time, 2580)) END AS start_time, CASE WHEN montage THEN end_time ELSE greatest(0, least(end_time, 2580)) END AS end_time FROM cand
WHERE CASE WHEN montage THEN seq % 7 >= 3 ELSE least(start_time, 2580) < 2580 AND least(end_time, 2580) > least(start_time, 2580) AND least(end_time, 2580) - least(start_time, 2580) >= 5 END""", "kill_event", more=CAND))
def valid_highlights(spark, d):
    rows = _cand(spark, d).withColumn("output_duration", (F.col("seq") % 7).cast("double"))
    return s.valid_highlights(rows, F.lit(2580.0)).select("video_id", "seq", "start_time", "end_time")


@query("boosted_candidates", sql("""SELECT video_id, seq, row_number() OVER (PARTITION BY video_id ORDER BY boosted DESC, list_index)::INT AS list_index, boosted AS local_score, least(99, floor(boosted / max(boosted) OVER (PARTITION BY video_id) * 100 + 0.5))::INT AS confidence,
  CASE WHEN list_index <= 6 THEN list_filter([CASE WHEN seq % 18 >= 8 THEN 'audio-spike' END, CASE WHEN seq % 10 >= 5 THEN 'audio-burst' END, CASE WHEN seq % 13 >= 6 THEN 'visual-event' END], lambda x: x IS NOT NULL) ELSE [] END AS flags
FROM (SELECT *, floor(local_score + CASE WHEN list_index <= 6 THEN seq % 45 + seq % 13 ELSE 0 END + 0.5) AS boosted FROM ranked WHERE list_index <= 12)""", "kill_event", more=RANKED))
def boosted_candidates(spark, d):
    pool = s.ranked_pool(s.merge_pool(_cand(spark, d), F.lit(2592.0))).withColumn("flags", F.expr("cast(array() as array<string>)"))
    signals = pool.select("video_id", "list_index", (F.col("seq") % 45).cast("double").alias("audio_points"), (F.col("seq") % 13).cast("double").alias("visual_points"), (F.col("seq") % 18).alias("spike"), (F.col("seq") % 10).alias("burst"))
    return s.boost_signals(pool, signals, 6).select("video_id", "seq", "list_index", "local_score", "confidence", "flags")


@query("viral_scores", sql("""SELECT video_id, seq, greatest(4, least(8, floor(CASE WHEN montage THEN 4.5 + confidence / 100 * 2.5 ELSE 4 + confidence / 100 * 2 END + kills * 0.2 + 0.5)))::BIGINT AS viral FROM cand""", "kill_event", more=CAND))
def viral_scores(spark, d):
    return _cand(spark, d).select("video_id", "seq", s.viral_score(F.col("kills"), F.col("confidence") / 100, F.col("montage")).alias("viral"))


@query("trim_clamp", sql("""SELECT video_id, seq, CASE WHEN e1 - s1 > 60 THEN s1 ELSE s1 END AS "start", CASE WHEN e1 - s1 > 60 THEN s1 + 60 WHEN e1 - s1 < 8 THEN s1 + 8 ELSE e1 END AS "end" FROM (SELECT *, least(s0, greatest(0, least(2592.0, e0) - 8)) AS s1, least(2592.0, e0) AS e1 FROM (
  SELECT video_id, seq, greatest(0, start_time - 20) AS s0, greatest(greatest(0, start_time - 20) + 8, start_time + local_score / 8) AS e0 FROM cand))""", "kill_event", more=CAND))
def trim_clamp(spark, d):
    start, end = review.clamp_trim(F.col("start_time") - 20, F.col("start_time") + F.col("local_score") / 8, F.lit(2592.0))
    return _cand(spark, d).select("video_id", "seq", start.alias("start"), end.alias("end"))


@query("recut_list", sql("""SELECT video_id, seq, abs(start_time + d - start_time) > 0.35 OR abs(end_time + d2 - end_time) > 0.35 AS trim_changed, abs(2.2 + d3 - 2.2) > 0.15 AS hook_changed FROM (SELECT *, (seq % 5) * 0.1 AS d, (seq % 7) * 0.08 AS d2, (seq % 4) * 0.07 AS d3 FROM cand)""", "kill_event", more=CAND))
def recut_list(spark, d):
    rows = _cand(spark, d).withColumns({"new_start": F.col("start_time") + (F.col("seq") % 5) * 0.1, "new_end": F.col("end_time") + (F.col("seq") % 7) * 0.08, "teaser": F.lit(2.2), "new_teaser": F.lit(2.2) + (F.col("seq") % 4) * 0.07})
    return rows.select("video_id", "seq", review.trim_changed(F.col("start_time"), F.col("end_time"), F.col("new_start"), F.col("new_end")).alias("trim_changed"), (F.abs(F.col("new_teaser") - F.col("teaser")) > 0.15).alias("hook_changed"))


