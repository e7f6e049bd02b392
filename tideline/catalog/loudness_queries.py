"""Loudness series and window statistics."""
from __future__ import annotations

from pyspark.sql import functions as F

from tideline import views
from tideline.catalog import query
from tideline.catalog.prefix import sql
from tideline.plans import kills as k
from tideline.plans import loudness as l

SCAN = """smoothed AS (SELECT *, ((coalesce(lag(db) OVER w, db) + db + coalesce(lead(db) OVER w, db)) / 3)::FLOAT AS sm FROM loud WINDOW w AS (PARTITION BY video_id ORDER BY idx)),
scan AS (SELECT video_id, idx, idx * 0.5::DOUBLE AS "time", db, sm, (sm::DOUBLE - avg(sm::DOUBLE) OVER (PARTITION BY video_id ORDER BY idx ROWS BETWEEN 60 PRECEDING AND 60 FOLLOWING))::FLOAT AS delta FROM smoothed),
sides AS (SELECT *, lag(delta) OVER w AS a1, lead(delta) OVER w AS b1, lag(delta, 2) OVER w AS a2, lead(delta, 2) OVER w AS b2 FROM scan WINDOW w AS (PARTITION BY video_id ORDER BY idx)),
maxima AS (SELECT video_id, idx, "time", delta AS strength FROM sides WHERE delta >= a1 AND delta >= b1 AND delta >= a2 AND delta >= b2)"""


def greedy(least, spacing, most):
    """Recursive form of the spacing rule: accept the strongest open peak of every recording, drop its neighbours, repeat."""
    return SCAN + f""",
open0 AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY strength DESC, idx) AS rk FROM maxima WHERE strength >= {least}),
ranked AS (SELECT video_id, list({{'i': idx, 't': "time", 's': strength}} ORDER BY rk) AS ps FROM open0 GROUP BY video_id),
picked AS (SELECT video_id, unnest(list_reduce(ps, lambda acc, p: CASE WHEN len(list_filter(acc, lambda q: abs(q.t - p[1].t) < {spacing})) > 0 THEN acc ELSE list_append(acc, p[1]) END,
    [{{'i': -1, 't': -1e9::DOUBLE, 's': 0::FLOAT}}])) AS p FROM (SELECT video_id, list_transform(ps, lambda x: [x]) AS ps FROM ranked)),
peaks AS (SELECT video_id, p.i AS idx, p.t AS "time", p.s AS strength FROM picked WHERE p.i >= 0 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY p.s DESC, p.i) <= {most})"""


def _scan(spark, d):
    return l.loudness_scan(views.loudness(spark, d).select("video_id", "idx", "db"))


@query("rms_buckets", sql("""SELECT video_id, (idx // 8)::INT AS bucket, CASE WHEN sqrt(sum(sample * sample) / count(*)) > 1e-5
  THEN round(20 * log10(sqrt(sum(sample * sample) / count(*))), 6) ELSE -100 END AS db FROM loud GROUP BY 1, 2""", "loud"))
def rms_buckets(spark, d):
    samples = views.loudness(spark, d).select("video_id", F.col("idx").alias("i"), F.col("sample").alias("s"))
    return l.rms_buckets(samples, 8).select("video_id", F.col("idx").alias("bucket"), F.round("db", 6).alias("db"))


@query("smoothed_db", sql("""SELECT video_id, idx, round(sm::DOUBLE, 4) AS smooth FROM smoothed""", "loud", more=SCAN))
def smoothed_db(spark, d):
    return _scan(spark, d).select("video_id", "idx", F.round(F.col("smooth").cast("double"), 4).alias("smooth"))


@query("baseline_delta", sql("""SELECT video_id, idx, round(delta::DOUBLE, 4) AS delta FROM scan""", "loud", more=SCAN))
def baseline_delta(spark, d):
    return _scan(spark, d).select("video_id", "idx", F.round(F.col("delta").cast("double"), 4).alias("delta"))


@query("local_maxima", sql("""SELECT video_id, idx, round(strength::DOUBLE, 4) AS strength FROM maxima WHERE strength >= 3.5""", "loud", more=SCAN))
def local_maxima(spark, d):
    return l.local_maxima(_scan(spark, d), 3.5).select("video_id", "idx", F.round(F.col("strength").cast("double"), 4).alias("strength"))


def _peaks(preset):
    body = "SELECT video_id, idx, round(strength::DOUBLE, 4) AS strength FROM peaks"

    @query(f"audio_peaks_{preset}", sql(body, "loud", more=greedy(*l.PRESETS[preset])))
    def run(spark, d):
        return l.loudness_peaks(_scan(spark, d), preset).select("video_id", "idx", F.round(F.col("strength").cast("double"), 4).alias("strength"))


for _preset in l.PRESETS:
    _peaks(_preset)

CLUSTERS = greedy(*l.PRESETS["kill"]) + """,
plag AS (SELECT *, lag("time") OVER (PARTITION BY video_id ORDER BY "time") AS prev, row_number() OVER (PARTITION BY video_id ORDER BY "time") AS rn FROM peaks),
walk AS (SELECT video_id, rn, "time", strength, "time" AS c0 FROM plag WHERE rn = 1 UNION ALL
  SELECT p.video_id, p.rn, p."time", p.strength, CASE WHEN p."time" - w."time" <= 18 AND p."time" - w.c0 <= 105 THEN w.c0 ELSE p."time" END
  FROM walk w JOIN plag p ON p.video_id = w.video_id AND p.rn = w.rn + 1)"""


@query("kill_peak_clusters", sql("""SELECT video_id, c0 AS "start", max("time") AS "end", count(*) AS peaks, round(max(strength)::DOUBLE, 4) AS max_strength,
  round(count(*) * 22 + max(strength)::DOUBLE * 4 + sum(strength::DOUBLE), 3) AS score FROM walk GROUP BY video_id, c0 HAVING count(*) >= 2""", "loud", more=CLUSTERS, recursive=True))
def kill_peak_clusters(spark, d):
    peaks = l.loudness_peaks(_scan(spark, d), "kill").withColumn("strength", F.col("strength").cast("double"))
    return k.peak_clusters(peaks).select("video_id", "start", "end", "peaks", F.round("max_strength", 4).alias("max_strength"), F.round("score", 3).alias("score"))


WINDOWS = """win AS (SELECT DISTINCT video_id, s AS wid, (s * 4)::DOUBLE AS w_start, (s * 4 + 8)::DOUBLE AS w_end FROM loud, range(0, 8) AS r(s))"""


def _windows(spark, d):
    ids = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("video_id"))
    grid = ids.withColumn("wid", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return grid.select("video_id", "wid", (F.col("wid") * 4).cast("double").alias("w_start"), (F.col("wid") * 4 + 8).cast("double").alias("w_end"))


@query("window_audio_stats", sql("""SELECT video_id, wid::INT AS wid, round(max_delta, 4) AS max_delta, round(avg_delta, 4) AS avg_delta, peak_time,
  floor(least(150, greatest(0, max_delta) * 9 + greatest(0, avg_delta) * 5) + 0.5) AS audio_score FROM (
  SELECT video_id, wid, max(delta)::DOUBLE AS max_delta, avg(delta::DOUBLE) AS avg_delta, arg_max(idx, (delta, -idx)) * 0.5::DOUBLE AS peak_time
  FROM win JOIN scan USING (video_id) WHERE idx BETWEEN greatest(0, floor(w_start / 0.5)) AND least(63, floor(w_end / 0.5)) GROUP BY 1, 2)""", "loud", more=SCAN + ",\n" + WINDOWS))
def window_audio_stats(spark, d):
    stats = l.window_stats(_scan(spark, d), _windows(spark, d))
    return stats.select("video_id", "wid", F.round("max_delta", 4).alias("max_delta"), F.round("avg_delta", 4).alias("avg_delta"), "peak_time",
                        l.window_score(F.col("max_delta"), F.col("avg_delta")).alias("audio_score"))


POINTS = """pt AS (SELECT video_id, seq, "time" % 32 AS t FROM kill_event)"""


def _points(spark, d):
    return views.kill_events(spark, d).select("video_id", "seq", (F.col("time") % 32).alias("t"))


@query("combat_audio_exists", sql("""SELECT video_id, seq, t FROM pt WHERE EXISTS (SELECT 1 FROM scan s WHERE s.video_id = pt.video_id AND s.delta >= 4.2
  AND s.idx BETWEEN greatest(0, floor((t - 2.2) / 0.5)) AND ceil((t + 0.6) / 0.5))""", "kill_event", "loud", more=SCAN + ",\n" + POINTS))
def combat_audio_exists(spark, d):
    return l.combat_audio(_points(spark, d), _scan(spark, d), "t")


@query("combat_peak", sql("""SELECT pt.video_id, pt.seq, coalesce(arg_max(idx, (delta, -idx)) * 0.5::DOUBLE, any_value(t)) AS peak_time, round(coalesce(max(delta)::DOUBLE, 0), 4) AS peak_delta
FROM pt LEFT JOIN scan s ON s.video_id = pt.video_id AND s.delta > 0 AND s.idx BETWEEN greatest(0, floor((t - 5) / 0.5)) AND ceil((t + 2) / 0.5) GROUP BY 1, 2""",
                        "kill_event", "loud", more=SCAN + ",\n" + POINTS))
def combat_peak(spark, d):
    return l.combat_peak(_points(spark, d), _scan(spark, d), "t").select("video_id", "seq", "peak_time", F.round("peak_delta", 4).alias("peak_delta"))


@query("snap_to_gunshot", sql("""SELECT pt.video_id, pt.seq, coalesce(arg_max(s.idx, (s.delta::DOUBLE + (t - s.idx * 0.5) * 0.4, -s.idx)) * 0.5::DOUBLE, greatest(0, any_value(t) - 0.68)) AS snapped
FROM pt LEFT JOIN (SELECT * FROM sides WHERE delta >= 4.2 AND delta >= a1 AND delta >= b1) s ON s.video_id = pt.video_id AND t - s.idx * 0.5 BETWEEN 0.08 AND 2.4
  AND s.delta::DOUBLE + (t - s.idx * 0.5) * 0.4 > 4.2 GROUP BY 1, 2""", "kill_event", "loud", more=SCAN + ",\n" + POINTS))
def snap_to_gunshot(spark, d):
    return l.snap_to_gunshot(_points(spark, d), l.with_shot_flag(_scan(spark, d)), "t").select("video_id", "seq", "snapped")


@query("window_audio_emotion", sql("""SELECT video_id, count(*) AS chunks, round(greatest(0, least(18, var_pop(db) * 0.35 + greatest(0, max(db) + 22) * 0.6)), 4) AS spike_score
FROM (SELECT video_id, idx // 8 AS c, max(db) - 30 AS db FROM loud GROUP BY 1, 2) GROUP BY 1""", "loud"))
def window_audio_emotion(spark, d):
    chunks = views.loudness(spark, d).groupBy("video_id", F.floor(F.col("idx") / 8).alias("c")).agg((F.max("db") - 30).alias("max_volume")).withColumn("wid", F.lit(0))
    counted = l.volume_spikes(chunks).join(chunks.groupBy("video_id").agg(F.count(F.lit(1)).alias("chunks")), "video_id")
    return counted.select("video_id", "chunks", F.round("spike_score", 4).alias("spike_score"))
