"""Shooter highlights from sound, kill feed and speech together."""
from __future__ import annotations

import re

from pyspark.sql import functions as F

from tideline import views
from tideline.catalog import query
from tideline.catalog.kill_queries import CONFIRMED
from tideline.catalog.loudness_queries import CLUSTERS, SCAN
from tideline.catalog import shooter_sql as q
from tideline.catalog.prefix import sql
from tideline.catalog.text_queries import METRICS
from tideline.functions import patterns as p
from tideline.plans import loudness as l
from tideline.plans import shooter as sh
from tideline.plans import windows as w
from tideline.session import settle

END = 256.0


def _signals(spark, d):
    """Scan, kill peaks, events and flagged lines of the long recordings."""
    scan = settle(l.loudness_scan(views.long_loudness(spark, d)))
    peaks = settle(l.loudness_peaks(scan, "kill").withColumn("strength", F.col("strength").cast("double")))
    return scan, peaks, settle(views.long_events(spark, d)), settle(sh.keyword_flags(views.long_lines(spark, d)))


CHAIN = CLUSTERS + """,
chain AS (SELECT video_id, c0, min("time") AS cs, max("time") AS ce, count(*) AS peaks, max(strength)::DOUBLE AS strongest, count(*) * 22 + max(strength)::DOUBLE * 4 + sum(strength::DOUBLE) AS score FROM walk GROUP BY 1, 2 HAVING count(*) >= 2),
cp AS (SELECT w.video_id, w.c0, w."time" AS t, w.strength::DOUBLE AS s FROM walk w JOIN chain USING (video_id, c0))"""


def _re(pattern):
    return "regexp_matches(text, '(?i)" + pattern.replace("'", "''") + "')"


FLAGGED = f"""flag AS (SELECT video_id, seq, text, "start" AS t, {_re(p.KILL_WORDS)} AS kill, {_re(p.PAYOFF_WORDS)} AS pay, {_re(p.BORING_WORDS)} AS boring,
  {_re(sh.STILL_KILL_BORING)} AS still_b, {_re(sh.STILL_KILL_PAYOFF)} AS still_p FROM ln),
said AS (SELECT *, kill AND NOT (boring AND NOT still_b) AND NOT (pay AND NOT still_p) AS moment FROM flag)"""


@query("keyword_peaks", sql("""SELECT video_id, c0 AS cluster_at, (SELECT count(*) FROM said f WHERE f.video_id = c.video_id AND f.kill AND f.t BETWEEN cs - 2 AND ce + 4) AS keyword_lines,
  coalesce((SELECT list(f.t ORDER BY f.t) FROM said f WHERE f.video_id = c.video_id AND f.moment AND f.t BETWEEN cs - 2 AND ce + 8), []) AS moments FROM chain c""",
                             "long_loud", "line", "long_line", more=CHAIN + ",\n" + FLAGGED, recursive=True))
def keyword_peaks(spark, d):
    """Kill lines and kill moments of the transcript around each loud chain."""
    _, peaks, _, flagged = _signals(spark, d)
    spans = sh.chain_peaks(peaks)[1].select("video_id", F.col("cluster_at").alias("wid"), F.col("c_start").alias("w_start"), F.col("c_end").alias("w_end"))
    return sh.keyword_windows(spans, flagged).select("video_id", F.col("wid").alias("cluster_at"), "keyword_lines", "moments")


def _around(name, reach):
    """Confirmed kills around each chain, of recordings that have two."""
    return f"""{name} AS (SELECT c.c0, e.* FROM chain c JOIN confirmed e USING (video_id) JOIN rich USING (video_id) WHERE e."time" BETWEEN cs - {reach[0]} AND ce + {reach[1]})"""


def _dedupe(src, name):
    """The timeline rule inside each chain."""
    return f"""{name}f AS (SELECT *, sum(starts_with(roi, 'top_right')::INT) OVER (PARTITION BY video_id, c0) AS feeds,
    CASE WHEN player_kill OR red_highlight THEN 50 ELSE 0 END + highlight_score * 30 + confidence * 12 + CASE WHEN starts_with(roi, 'top_right') THEN 4 ELSE 0 END AS points FROM {src}),
{name}p AS (SELECT *, lag("time") OVER (PARTITION BY video_id, c0 ORDER BY "time", seq) AS pv FROM {name}f WHERE feeds < 2 OR starts_with(roi, 'top_right')),
{name}g AS (SELECT *, sum((pv IS NULL OR "time" - pv > 1.6)::INT) OVER (PARTITION BY video_id, c0 ORDER BY "time", seq) AS g FROM {name}p),
{name}t AS (SELECT *, max(points) OVER (PARTITION BY video_id, c0, g) AS top FROM {name}g),
{name}k AS (SELECT * FROM {name}t WHERE points >= top - 0.05 QUALIFY row_number() OVER (PARTITION BY video_id, c0, g ORDER BY "time", seq) = 1),
{name} AS (SELECT * FROM {name}k QUALIFY row_number() OVER (PARTITION BY video_id, c0 ORDER BY "time", seq) <= 4)"""


def _apart(src, name):
    """Event peaks 3.5 s apart, best first, four at most."""
    return f"""{name}l AS (SELECT video_id, c0, list({{'t': "time", 's': confidence * 12, 'r': roi}} ORDER BY CASE WHEN starts_with(roi, 'top_right') THEN 45.0 ELSE 0 END + confidence * 12 DESC, "time", roi) AS ps FROM {src} GROUP BY 1, 2),
{name} AS (SELECT video_id, c0, x.t AS t, x.s AS s, x.r AS roi FROM (SELECT video_id, c0, unnest(list_reduce(list_transform(ps, lambda x: [x]), lambda acc, p: CASE WHEN len(acc) >= 4 OR len(list_filter(acc, lambda q: abs(q.t - p[1].t) < 3.5)) > 0
  THEN acc ELSE list_append(acc, p[1]) END)) AS x FROM {name}l))"""


def _tight(src, name):
    """Peaks up to the first gap above 22 s."""
    return f"""{name} AS (SELECT video_id, c0, t, s, roi FROM (SELECT *, sum(late) OVER (PARTITION BY video_id, c0 ORDER BY t ROWS UNBOUNDED PRECEDING) AS cut
  FROM (SELECT *, coalesce((t - lag(t) OVER (PARTITION BY video_id, c0 ORDER BY t) > 22)::INT, 0) AS late FROM {src})) WHERE cut = 0)"""


def _ladder(chain="chain", peaks="cp", x=""):
    parts = _LADDER.replace("FROM chain ", f"FROM {chain} ").replace("FROM cp ", f"FROM {peaks} ")
    return q.renamed(parts, x, *re.findall(r"(?m)^(\w+) AS \(", parts)) if x else parts


BASE = [CHAIN, FLAGGED, CONFIRMED]
_LADDER = ",\n".join([
    "rich AS (SELECT video_id FROM confirmed GROUP BY 1 HAVING count(*) >= 2)",
    _around("near1", sh.FEED), _dedupe("near1", "one"), _apart("one", "one_a"), _tight("one_a", "set0"),
    _around("near2", sh.FEED_WIDE), _dedupe("near2", "two"), _apart("two", "two_a"), _tight("two_a", "set1"),
    """set3 AS (SELECT c.video_id, c.c0, f.t, 11.0::DOUBLE AS s, NULL::VARCHAR AS roi FROM chain c JOIN said f USING (video_id) WHERE f.moment AND f.t BETWEEN cs - 6 AND ce + 18 QUALIFY row_number() OVER (PARTITION BY video_id, c0 ORDER BY f.t) <= 4)""", _tight("set3", "set2"),
    """marks AS (SELECT video_id, seq, "time", confidence FROM confirmed UNION ALL SELECT video_id, seq, "time", confidence FROM kill_event ANTI JOIN confirmed USING (video_id)),
mk AS (SELECT p.video_id, p.c0, p.t, p.s, arg_min(m.confidence, (abs(m."time" - p.t), m."time", m.seq)) AS mark FROM cp p LEFT JOIN marks m ON m.video_id = p.video_id AND abs(m."time" - p.t) <= 2.5 GROUP BY ALL),
mr AS (SELECT *, NULL::VARCHAR AS roi, row_number() OVER (PARTITION BY video_id, c0 ORDER BY mark IS NULL, s + coalesce(mark, 0) * 40 DESC, t) AS rk FROM mk),
mark5 AS (SELECT * FROM mr WHERE mark IS NOT NULL AND rk <= 5),
set5 AS (SELECT video_id, c0, t, s, roi FROM mr WHERE mark IS NOT NULL AND rk <= 4),
top4 AS (SELECT * FROM mr WHERE rk <= 4)""", _tight("mark5", "set4"),
    _around("near6", sh.NEAR_FEED), _apart("near6", "set6"), _tight("top4", "set7"),
    "sets AS (" + " UNION ALL ".join(f"SELECT {i} AS place, '{name}' AS rung, {least} AS least, * FROM set{i}" for i, (name, least) in enumerate(
        [("feed", 2), ("feed_wide", 2), ("lines", 2), ("lines", 2), ("marked", 2), ("marked", 2), ("near_feed", 2), ("loud", 1)])) + ")",
    "counted AS (SELECT *, count(*) OVER (PARTITION BY video_id, c0, place) >= least AS ok FROM sets)",
    "ladder AS (SELECT * FROM counted QUALIFY place = min(place) FILTER (WHERE ok) OVER (PARTITION BY video_id, c0))"])
LADDER = ",\n".join([*BASE, _ladder()])


@query("peak_ladder", sql("SELECT video_id, c0 AS cluster_at, rung, t AS \"time\", round(s, 4) AS strength FROM ladder", "long_loud", "line", "long_line", "long_event", more=LADDER, recursive=True))
def peak_ladder(spark, d):
    """The moments each loud chain stands for and the rung that gave them."""
    _, peaks, events, flagged = _signals(spark, d)
    return sh.peak_ladder(*sh.chain_peaks(peaks), events, flagged).select("video_id", "cluster_at", "rung", "time", F.round("strength", 4).alias("strength"))


_TABLES = ("long_loud", "line", "long_line", "long_event")
MONTAGES = ",\n".join([LADDER, q.PAYOFF_PEAKS, q.montages("ladder", "chain", "cm")])
WINDOWS = ",\n".join([MONTAGES, q.FEED_MONTAGES, q.SPARSE, _ladder("sp_chain", "sp", "sx_"), q.montages("sx_ladder", "sp_chain", "sm"), q.UNION_ALL])


def _cuts(made):
    """Cut lists as three arrays."""
    return made.withColumns({name: F.transform("segments", lambda x: x[field]) for name, field in (("starts", "start"), ("lengths", "duration"), ("peak_times", "peak_time"))}).drop("segments")


@query("chain_montages", sql("""SELECT video_id, c0 AS cluster_at, rung, st AS starts, du AS lengths, pt AS peak_times, start_time, end_time, output_duration, kill_count::INT AS kill_count, sure, hud_kills, keyword_lines, has_payoff, hook,
  coalesce((SELECT left(arg_min(l.text, (abs(l."start" - hook), l."start", l.seq)), 72) FROM ln l WHERE l.video_id = cm.video_id AND l.text <> '' AND abs(l."start" - hook) < 8), '') AS peak_line, round(composite, 4) AS composite FROM cm""",
                              *_TABLES, more=MONTAGES, recursive=True))
def chain_montages(spark, d):
    """Montages of loud chains with payoff and composite."""
    scan, peaks, events, flagged = _signals(spark, d)
    made = sh.chain_montages(*sh.chain_peaks(peaks), events, flagged, scan, END)
    made = _cuts(sh.near_line(made, flagged, ["cluster_at"], "hook", "peak_line"))
    return made.select("video_id", "cluster_at", "rung", "starts", "lengths", "peak_times", "start_time", "end_time", "output_duration", "kill_count", "sure", "hud_kills", "keyword_lines", "has_payoff", "hook",
                       F.coalesce("peak_line", F.lit("")).alias("peak_line"), F.round("composite", 4).alias("composite"))


PLAIN = CHAIN + ",\n" + FLAGGED + """,
edge AS (SELECT *, greatest(0, cs - 2) AS w0, CASE WHEN least(256, ce + 4) - greatest(0, cs - 2) < 12 THEN least(256, greatest(0, cs - 2) + 12) ELSE least(256, ce + 4) END AS w_end FROM chain),
span AS (SELECT *, CASE WHEN w_end - w0 > 45 THEN greatest(0, w_end - 45) ELSE w0 END AS w_start FROM edge),
heard AS (SELECT p.video_id, p.c0, floor(least(150, (greatest(0, max(delta)::DOUBLE) * 9 + greatest(0, avg(delta::DOUBLE)) * 5) * 1.35) + 0.5) + 35 AS audio FROM span p JOIN scan s USING (video_id)
  WHERE idx BETWEEN floor(w_start / 0.5) AND floor(w_end / 0.5) GROUP BY 1, 2),
seen AS (SELECT p.video_id, p.c0, count(*) AS kills, least(120.0, count(*) * 28 + count(*) FILTER (WHERE confidence >= 0.65) * 12) AS boost FROM span p JOIN kill_event e USING (video_id)
  WHERE confidence >= 0.5 AND e."time" BETWEEN w_start - 0.5 AND w_end + 0.5 GROUP BY 1, 2),
hk AS (SELECT video_id, c0, arg_min(t, (-s, t)) AS hook FROM cp GROUP BY 1, 2)"""


@query("chain_windows", sql("""SELECT video_id, c0 AS cluster_at, w_start::DOUBLE AS w_start, w_end::DOUBLE AS w_end, hook, coalesce(kills, 0) AS hud_kills, keyword_lines,
  round(80 + peaks * 28 + keyword_lines * 12 + audio + coalesce(boost, 0) + strongest * 3, 4)::DOUBLE AS composite
FROM (SELECT *, (SELECT count(*) FROM said f WHERE f.video_id = p.video_id AND f.kill AND f.t BETWEEN w_start - 2 AND w_end + 4) AS keyword_lines FROM span p) JOIN heard USING (video_id, c0) JOIN hk USING (video_id, c0) LEFT JOIN seen USING (video_id, c0)""",
                             "long_loud", "line", "long_line", "long_event", more=PLAIN, recursive=True))
def chain_windows(spark, d):
    """Plain windows of loud chains with composite."""
    scan, peaks, events, flagged = _signals(spark, d)
    made = sh.chain_windows(*sh.chain_peaks(peaks), events, flagged, scan, END)
    return made.select("video_id", "cluster_at", "w_start", "w_end", "hook", "hud_kills", "keyword_lines", F.round("composite", 4).alias("composite"))


def _windows(spark, d):
    scan, peaks, events, flagged = _signals(spark, d)
    return settle(sh.shooter_windows(peaks, events, flagged, scan, END)), sh.feed_clips(events, scan, END)


@query("shooter_windows", sql("SELECT video_id, source, st AS starts, du AS lengths, pt AS peak_times, start_time, end_time, output_duration, kill_count::INT AS kill_count, has_payoff, round(composite, 4) AS composite FROM win", *_TABLES, more=WINDOWS, recursive=True))
def shooter_windows(spark, d):
    """All montages of a recording by source, with the early stop."""
    made = _cuts(_windows(spark, d)[0])
    return made.select("video_id", "source", "starts", "lengths", "peak_times", "start_time", "end_time", "output_duration", F.col("kill_count").cast("int"), "has_payoff", F.round("composite", 4).alias("composite"))


@query("signal_pool", sql("""SELECT video_id, list_index::INT AS list_index, from_pool, start_time, end_time, kill_count, local_score::DOUBLE AS local_score,
  least(99, floor(local_score / first_value(local_score) OVER (PARTITION BY video_id ORDER BY list_index) * 100 + 0.5))::INT AS confidence FROM pool""", *_TABLES, more=WINDOWS + ",\n" + q.POOL, recursive=True))
def signal_pool(spark, d):
    """Candidates of recordings without a transcript: feed clips and the montages beside them."""
    made = sh.signal_pool(*_windows(spark, d))
    return made.select("video_id", "list_index", "from_pool", "start_time", "end_time", F.col("kill_count").cast("bigint"), "local_score", "confidence")


ENGAGED = SCAN + """,
el AS (SELECT *, lag("time") OVER (PARTITION BY video_id ORDER BY "time", seq) AS pv FROM kill_event SEMI JOIN scan USING (video_id)),
es AS (SELECT *, sum((pv IS NULL OR "time" - pv > 4.5)::INT) OVER (PARTITION BY video_id ORDER BY "time", seq) AS g FROM el),
sp AS (SELECT video_id, g, min("time") AS t0, max("time") AS t1, max(starts_with(roi, 'top_right')::INT) AS feed, count(*) AS flashes FROM es GROUP BY 1, 2),
gun AS (SELECT p.*, coalesce((SELECT arg_min(s.idx, (-s.delta, s.idx)) FROM scan s WHERE s.video_id = p.video_id AND s.delta > 0 AND s.idx BETWEEN greatest(0, floor(((t0 + t1) / 2 - (t1 - t0 + 5)) / 0.5)) AND ceil(((t0 + t1) / 2 + 2) / 0.5)) * 0.5::DOUBLE, (t0 + t1) / 2) AS loud_at FROM sp p),
pool AS (SELECT e.*, t0, loud_at, flashes, abs(e."time" - loud_at) AS dist, row_number() OVER (PARTITION BY e.video_id, e.g ORDER BY e."time", e.seq) AS rn FROM es e JOIN gun USING (video_id, g) WHERE feed = 0 OR starts_with(roi, 'top_right')),
wk AS (SELECT video_id, g, rn, seq, dist, confidence FROM pool WHERE rn = 1 UNION ALL SELECT w.video_id, w.g, p.rn,
  CASE WHEN p.dist < w.dist - 0.05 OR (abs(p.dist - w.dist) < 0.05 AND p.confidence > w.confidence) THEN p.seq ELSE w.seq END,
  CASE WHEN p.dist < w.dist - 0.05 OR (abs(p.dist - w.dist) < 0.05 AND p.confidence > w.confidence) THEN p.dist ELSE w.dist END,
  CASE WHEN p.dist < w.dist - 0.05 OR (abs(p.dist - w.dist) < 0.05 AND p.confidence > w.confidence) THEN p.confidence ELSE w.confidence END FROM wk w JOIN pool p ON p.video_id = w.video_id AND p.g = w.g AND p.rn = w.rn + 1),
won AS (SELECT video_id, g, arg_max(seq, rn) AS seq FROM wk GROUP BY 1, 2)"""


@query("loud_engagements", sql("SELECT p.video_id, p.t0 AS session_start, p.seq, p.flashes, p.loud_at FROM pool p JOIN won USING (video_id, g, seq)", "long_loud", "long_event", more=ENGAGED.replace("FROM kill_event SEMI", 'FROM (SELECT * REPLACE ("time" % 256 AS "time") FROM kill_event) SEMI'), recursive=True))
def loud_engagements(spark, d):
    """One detection per engagement, anchored by the loudest moment around it."""
    scan = settle(l.loudness_scan(views.long_loudness(spark, d)))
    events = views.long_events(spark, d)
    dense = events.withColumn("time", F.col("time") % END)
    return l.loud_engagements(dense, scan).select("video_id", "session_start", "seq", "flashes", "loud_at")


ALL_TERMS = METRICS.replace("FROM line", "FROM ln") + ",\n" + SCAN + """,
lastb AS (SELECT video_id, max(idx) AS li FROM scan GROUP BY 1),
st AS (SELECT m.video_id, m.wid, max(delta)::DOUBLE AS mx, avg(delta::DOUBLE) AS av, arg_min(idx, (-delta, idx)) * 0.5::DOUBLE AS pt FROM m5 m JOIN lastb USING (video_id) JOIN scan s ON s.video_id = m.video_id
  AND s.idx BETWEEN greatest(0, least(li, floor(w_start / 0.5))) AND greatest(0, least(li, floor(w_end / 0.5))) GROUP BY 1, 2),
hy AS (SELECT *, mx >= 5 AND EXISTS (SELECT 1 FROM flagged f WHERE f.video_id = st.video_id AND f."end" >= pt - 6 AND f."start" <= pt + 6 AND (f.score >= 8 OR regexp_matches(f.text, '[?!]'))) AS hype FROM st),
au AS (SELECT *, floor(least(150, greatest(0, mx) * 9 + greatest(0, av) * 5) + 0.5) + CASE WHEN hype THEN 50 ELSE 0 END - CASE WHEN mx < 2 AND av < 0.5 THEN 25 ELSE 0 END AS sound FROM hy),
ev AS (SELECT m.video_id, m.wid, count(*) AS hk, least(120.0, count(*) * 28 + count(*) FILTER (WHERE confidence >= 0.65) * 12) AS boost FROM m5 m JOIN kill_event e ON e.video_id = m.video_id AND confidence >= 0.5 AND e."time" BETWEEN w_start - 0.5 AND w_end + 0.5 GROUP BY 1, 2),
tm AS (SELECT m.*, coalesce(sound, 0) AS snd, coalesce(mx, 0) AS mx0, coalesce(hk, 0) AS hud_kills, coalesce(boost, 0) AS hud, coalesce(hype, false) AS hyped, m.video_id IN (SELECT video_id FROM kill_event) AS known
  FROM m5 m LEFT JOIN au USING (video_id, wid) LEFT JOIN ev USING (video_id, wid)),
tn AS (SELECT *, snd - CASE WHEN known AND hud_kills = 0 AND snd > 40 THEN 35 ELSE 0 END AS audio, CASE WHEN borings >= 1 AND kills = 0 THEN 120 WHEN hud_kills = 0 AND kills = 0 AND mx0 < 7 THEN 80 ELSE 0 END AS boring FROM tm)"""


@query("window_all_terms", sql("SELECT video_id, wid, audio::DOUBLE AS audio, hud_kills, hud::DOUBLE AS hud, boring::DOUBLE AS boring, hyped OR hud_kills >= 2 AS hype, round(comp + audio + hud - boring, 3) AS composite FROM tn", "long_loud", "line", "long_line", "long_event", more=ALL_TERMS))
def window_all_terms(spark, d):
    """Windows scored by speech, loudness, kill feed and boredom together."""
    scan, _, events, _ = _signals(spark, d)
    lines = settle(w.scored_lines(views.long_lines(spark, d)))
    ends = lines.groupBy("video_id").agg(F.max("end").alias("e"))
    spans = ends.withColumn("wid", F.explode(F.sequence(F.lit(0), F.floor(F.col("e") / 20).cast("int")))).select("video_id", "wid", (F.col("wid") * 20).cast("double").alias("w_start"), (F.col("wid") * 20 + 28).cast("double").alias("w_end"))
    made = w.full_scores(settle(w.window_metrics(lines, spans)), lines, events, scan, shooter=True)
    return made.select("video_id", "wid", "audio", "hud_kills", "hud", "boring", "hype", F.round("composite", 3).alias("composite"))
