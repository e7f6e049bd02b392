"""Loudness series: buckets, baseline, peaks and window statistics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.numeric import half_up, nz
from tideline.functions import events as ev
from tideline.operators.ordered import TILE, gap_sessions, top_per_key, with_halo
from tideline.operators.ranges import band_join, overlap_join
from tideline.operators.scans import scan_sessions, spaced_peaks

KEY = ["video_id"]

# Bucket length, baseline reach and silence floor.
BUCKET_SEC = 0.5
SAMPLES_PER_BUCKET = 4000
BASELINE_BUCKETS = 60
FLOOR_RMS, FLOOR_DB = 1e-5, -100.0
# Peak presets as (least rise in dB, spacing in seconds, most peaks).
PRESETS = {"anchor": (5.0, 20.0, 40), "kill": (3.5, 3.0, 100), "gunshot": (4.8, 1.4, 200), "payoff": (3.5, 2.0, 40)}


def rms_buckets(samples: DataFrame, per_bucket: int = SAMPLES_PER_BUCKET) -> DataFrame:
    """Loudness per bucket from samples ``(video_id, i, s)``; a last bucket less than a quarter full is dropped."""
    sums = samples.groupBy(*KEY, F.floor(F.col("i") / per_bucket).cast("int").alias("idx")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("s") * F.col("s")).alias("sq"))
    rms = F.sqrt(F.col("sq") / F.col("n"))
    return sums.filter(F.col("n") >= per_bucket / 4).select(*KEY, "idx", F.when(rms > FLOOR_RMS, 20 * F.log10(rms)).otherwise(FLOOR_DB).alias("db"))


def loudness_scan(buckets: DataFrame) -> DataFrame:
    """Smoothed loudness, its rise over the local baseline and whether the bucket is a local maximum.

    Smoothing, the centred baseline and the comparison with two neighbours all run on one shuffle: tiles carry a halo
    wide enough for all three.
    """
    reach = (BASELINE_BUCKETS + 4) * BUCKET_SEC
    timed = with_halo(buckets.withColumn("time", F.col("idx") * BUCKET_SEC), "time", reach)
    w = W.partitionBy(*KEY, TILE).orderBy("idx")
    smooth = ((nz(F.lag("db").over(w), F.col("db")) + F.col("db") + nz(F.lead("db").over(w), F.col("db"))) / 3).cast("float")
    timed = timed.withColumn("smooth", smooth)
    base = F.avg(F.col("smooth").cast("double")).over(w.rowsBetween(-BASELINE_BUCKETS, BASELINE_BUCKETS))
    timed = timed.withColumn("delta", (F.col("smooth").cast("double") - base).cast("float"))
    sides = [F.lag("delta", 1).over(w), F.lead("delta", 1).over(w), F.lag("delta", 2).over(w), F.lead("delta", 2).over(w)]
    peak = F.lit(True)
    for s in sides:
        peak = peak & nz(F.col("delta") >= s, False)
    return timed.withColumn("is_peak", peak).filter("_home").select(*KEY, "idx", "time", "db", "smooth", "delta", "is_peak")


def local_maxima(scan: DataFrame, least: float) -> DataFrame:
    return scan.filter("is_peak").filter(F.col("delta") >= least).select(*KEY, "idx", "time", F.col("delta").alias("strength"))


def loudness_peaks(scan: DataFrame, preset: str = "anchor") -> DataFrame:
    """Strongest peaks first, kept apart by the preset's spacing, at most the preset's count per recording.

    The cap may be applied after the spacing rule: greedy acceptance runs in order of strength, so its first k
    acceptances are the k strongest of all acceptances.
    """
    least, spacing, most = PRESETS[preset]
    kept = spaced_peaks(local_maxima(scan, least), KEY, "time", "strength", ["idx"], spacing)
    return top_per_key(kept, KEY, [F.desc("strength"), F.col("idx")], most)


def window_stats(scan: DataFrame, windows: DataFrame, wid: str = "wid") -> DataFrame:
    """Highest and mean rise per window ``(video_id, wid, w_start, w_end)`` and the time of the first highest."""
    last = scan.groupBy(*KEY).agg(F.max("idx").alias("_last"))
    bucket = lambda c: F.greatest(F.lit(0), F.least(F.col("_last"), F.floor(F.col(c) / BUCKET_SEC)))
    spans = windows.join(last, KEY).withColumns({"_lo": bucket("w_start"), "_hi": bucket("w_end")}).drop("_last")
    pairs = overlap_join(scan.select(*KEY, "idx", "delta"), spans, KEY, (F.col("idx"), F.col("idx")), (F.col("_lo"), F.col("_hi")), bin_sec=120)
    stats = pairs.groupBy(*KEY, wid).agg(
        F.max("delta").cast("double").alias("max_delta"), F.avg(F.col("delta").cast("double")).alias("avg_delta"),
        (F.max_by("idx", F.struct("delta", -F.col("idx"))) * BUCKET_SEC).alias("peak_time"))
    return windows.join(stats, [*KEY, wid], "left").withColumns({
        "max_delta": nz(F.col("max_delta"), 0.0), "avg_delta": nz(F.col("avg_delta"), 0.0), "peak_time": nz(F.col("peak_time"), F.col("w_start"))})


def window_score(max_delta: Column, avg_delta: Column, weight: Column | float = 1.0) -> Column:
    raw = F.greatest(F.lit(0.0), max_delta) * 9 + F.greatest(F.lit(0.0), avg_delta) * 5
    return half_up(F.least(F.lit(150.0), raw * weight)).cast("double")


def _near(points: DataFrame, scan: DataFrame, at: str, before: float, after: float) -> DataFrame:
    """Buckets from floor((t - before)/0.5) to ceil((t + after)/0.5) around each point."""
    lo = F.floor((F.col(at) - before) / BUCKET_SEC)
    hi = F.ceil((F.col(at) + after) / BUCKET_SEC)
    pairs = band_join(points, scan.select(*KEY, "idx", "delta"), KEY, F.col(at), F.col("idx") * BUCKET_SEC, before + BUCKET_SEC, after + BUCKET_SEC)
    return pairs.filter(F.col("idx").between(lo, hi))


def combat_audio(points: DataFrame, scan: DataFrame, at: str = "time", before: float = 2.2, after: float = 0.6, least: float = 4.2) -> DataFrame:
    """Points with a loud bucket close by; the filter runs before the join and the answer is a semi-join."""
    loud = scan.filter(F.col("delta") >= least)
    hits = _near(points.select(*KEY, "seq", at), loud, at, before, after).select(*KEY, "seq").distinct()
    return points.join(hits, [*KEY, "seq"], "left_semi")


def combat_peak(points: DataFrame, scan: DataFrame, at: str = "time", before: float = 5.0, after: float = 2.0) -> DataFrame:
    """Loudest positive bucket around each point, else the point itself with rise 0."""
    pairs = _near(points.select(*KEY, "seq", at), scan.filter("delta > 0"), at, before, after)
    best = pairs.groupBy(*KEY, "seq").agg(F.max_by(F.struct("idx", "delta"), F.struct("delta", -F.col("idx"))).alias("_b"))
    return points.join(best, [*KEY, "seq"], "left").select(
        *points.columns, nz(F.col("_b.idx") * BUCKET_SEC, F.col(at)).alias("peak_time"), nz(F.col("_b.delta").cast("double"), 0.0).alias("peak_delta"))


def loud_engagements(events: DataFrame, scan: DataFrame, gap: float = 4.5) -> DataFrame:
    """One detection per engagement of a recording with loudness: the one nearest to the loudest moment around it.

    The moment is the loudest bucket above its surroundings from the engagement's length and 5 s before its middle to 2 s after, else
    the middle. Detections are taken in order of time, feed regions only if there are any: one that is nearer by more than 0.05 s
    wins, one that is as near to 0.05 s wins by confidence. The walk keeps one detection, so long engagements are scanned in pieces."""
    rows = gap_sessions(ev.complete(events).withColumn("at", ev.event_time()).join(scan.select(*KEY).distinct(), KEY, "left_semi"), KEY, "at", gap, ["seq"])
    spans = rows.groupBy(*KEY, "session_start").agg(F.max("at").alias("_t1"), F.max(ev.top_right().cast("int")).alias("_feed"), F.count(F.lit(1)).alias("flashes"))
    middle = (F.col("session_start") + F.col("_t1")) / 2
    low = F.greatest(F.lit(0), F.floor((middle - (F.col("_t1") - F.col("session_start") + 5)) / BUCKET_SEC))
    spans = spans.withColumns({"_middle": middle, "_lo": low, "_hi": F.ceil((middle + 2) / BUCKET_SEC)})
    loud = overlap_join(scan.filter("delta > 0").select(*KEY, "idx", "delta"), spans.select(*KEY, "session_start", "_lo", "_hi"), KEY, (F.col("idx"), F.col("idx")), (F.col("_lo"), F.col("_hi")), bin_sec=120)
    best = loud.groupBy(*KEY, "session_start").agg(F.max_by("idx", F.struct("delta", -F.col("idx"))).alias("_idx"))
    spans = spans.join(best, [*KEY, "session_start"], "left").select(*KEY, "session_start", "flashes", "_feed", nz(F.col("_idx") * BUCKET_SEC, F.col("_middle")).alias("loud_at"))
    pool = rows.join(spans, [*KEY, "session_start"]).filter((F.col("_feed") == 0) | ev.top_right())
    slim = pool.select(*KEY, "session_start", "at", "seq", F.abs(F.col("at") - F.col("loud_at")).alias("dist"), nz(F.col("confidence"), 0.0).alias("conf"))

    def step(prev: Column, row: Column) -> Column:
        better = prev.isNull() | (row["dist"] < prev["dist"] - 0.05) | ((F.abs(row["dist"] - prev["dist"]) < 0.05) & (row["conf"] > prev["conf"]))
        return F.struct(*[F.when(better, row[n]).otherwise(prev[n]).alias(n) for n in ("dist", "conf", "seq")])

    walked = scan_sessions(slim, KEY, "session_start", "at", ["seq"], "struct<dist:double,conf:double,seq:bigint>", step)
    won = walked.groupBy(*KEY, "session_start").agg(F.max_by("state.seq", F.struct("at", "seq")).alias("seq"))
    return pool.join(won, [*KEY, "session_start", "seq"], "left_semi").drop("_feed")


def snap_to_gunshot(points: DataFrame, scan: DataFrame, at: str = "time") -> DataFrame:
    """Move each point to the best gunshot-like bucket just before it, else 0.68 s earlier."""
    spikes = scan.filter(F.col("delta") >= 4.2).select(*KEY, "idx", "delta", "shot")
    ahead = F.col(at) - F.col("idx") * BUCKET_SEC
    pairs = band_join(points.select(*KEY, "seq", at), spikes.filter("shot"), KEY, F.col(at), F.col("idx") * BUCKET_SEC, 2.5, 0.5)
    pairs = pairs.withColumn("_score", F.col("delta").cast("double") + ahead * 0.4).filter((ahead >= 0.08) & (ahead <= 2.4) & (F.col("_score") > 4.2))
    best = pairs.groupBy(*KEY, "seq").agg(F.max_by("idx", F.struct("_score", -F.col("idx"))).alias("_i"))
    return points.join(best, [*KEY, "seq"], "left").select(
        *points.columns, nz(F.col("_i") * BUCKET_SEC, F.greatest(F.lit(0.0), F.col(at) - 0.68)).alias("snapped"))


def with_shot_flag(scan: DataFrame) -> DataFrame:
    """Mark buckets not below either direct neighbour, edges excluded."""
    timed = with_halo(scan, "time", 2 * BUCKET_SEC)
    w = W.partitionBy(*KEY, TILE).orderBy("idx")
    shot = nz((F.col("delta") >= F.lag("delta").over(w)) & (F.col("delta") >= F.lead("delta").over(w)), False)
    return timed.withColumn("shot", shot).filter("_home").drop("_home", TILE)


def volume_spikes(chunks: DataFrame) -> DataFrame:
    """Spread and height of chunk maxima ``(video_id, wid, max_volume)`` as a spike score of at most 18."""
    stats = chunks.groupBy(*KEY, "wid").agg(F.var_pop("max_volume").alias("variance"), F.max("max_volume").alias("peak"))
    return stats.withColumn("spike_score", F.greatest(F.lit(0.0), F.least(F.lit(18.0), F.col("variance") * 0.35 + F.greatest(F.lit(0.0), F.col("peak") + 22) * 0.6)))
