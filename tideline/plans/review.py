"""Review of detections, trim rules, clip timing and change detection."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import events as ev
from tideline.functions.numeric import clamp, half_up, nz, tenth
from tideline.operators.greedy import greedy_rank
from tideline.operators.ranges import band_join
from tideline.plans import kills as k

KEY = ["video_id"]

# Tolerance of cut membership, clip and teaser limits in seconds.
CUT_TOLERANCE = 1.8
MIN_MAIN, MAX_MAIN = 8.0, 60.0
MIN_TEASER, MAX_TEASER, TEASER = 0.5, 4.0, 2.2
LATE_SEC, LATE_SHARE = 10.0, 0.38
QUALITY_FLOOR = 64


def event_key() -> Column:
    return F.concat(half_up(ev.event_time() * 10).cast("string"), F.lit("_"), nz(F.col("roi"), "unknown"))


def annotate(events: DataFrame, pool: DataFrame, cuts: DataFrame, audible: DataFrame | None = None) -> DataFrame:
    """Every detection with the outcome of each filter stage and the reasons it was dropped.

    ``cuts`` lists ``(video_id, cut_time)`` of the final clips, ``audible`` the detections with combat sound nearby.
    """
    rows = ev.complete(events).withColumns({"confirmed": ev.confirmed(), "_key": event_key(), "at": ev.event_time()})
    good = k.quality_kills(events).select(*KEY, "seq", F.lit(True).alias("_q"))
    keys = pool.select(*KEY, event_key().alias("_key"), F.lit(True).alias("_p")).distinct()
    near = band_join(rows.select(*KEY, "seq", "at"), cuts.select(*KEY, F.col("cut_time").alias("_c")), KEY, F.col("at"), F.col("_c"), CUT_TOLERANCE, CUT_TOLERANCE)
    final = near.filter(F.abs(F.col("_c") - F.col("at")) <= CUT_TOLERANCE).select(*KEY, "seq", F.lit(True).alias("_f")).distinct()
    rows = rows.join(good, [*KEY, "seq"], "left").join(keys, [*KEY, "_key"], "left").join(final, [*KEY, "seq"], "left")
    if audible is not None:
        rows = rows.join(audible.select(*KEY, "seq", F.lit(True).alias("_a")).distinct(), [*KEY, "seq"], "left")
    else:
        rows = rows.withColumn("_a", F.lit(True))
    q, p = nz(F.col("_q"), False), nz(F.col("_p"), False)
    heard = ~q | nz(F.col("_a"), False)
    score = F.when(nz(F.col("player_kill"), False), nz(F.col("kill_quality_score"), 60.0))
    reasons = F.array_compact(F.array(F.when(~F.col("confirmed"), "not_confirmed"), F.when(F.col("confirmed") & ~q, "quality_filter"), F.when(q & ~heard, "no_combat_audio"),
                                      F.when(q & heard & ~p, "excluded_from_montage_pool")))
    return rows.withColumns({
        "passes_quality": q, "passes_audio": heard, "in_pool": p, "in_final": nz(F.col("_f"), False), "reasons": reasons, "anchor_time": tenth(ev.anchor(None, k.RED.offset)), "quality_score": score,
        "over_floor": score.isNull() | (score >= QUALITY_FLOOR), "hud_time": tenth(F.col("at"))}).drop("_q", "_p", "_f", "_a", "_key", "at")


def summary(annotated: DataFrame) -> DataFrame:
    return annotated.groupBy(*KEY).agg(F.count(F.lit(1)).alias("total_detected"), F.count_if("confirmed").alias("confirmed"), F.count_if("passes_quality").alias("passes_quality"),
                                       F.count_if("in_pool").alias("in_pool"), F.count_if("in_final").alias("in_final"))


def reject_histogram(annotated: DataFrame) -> DataFrame:
    return annotated.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("events"))


def scan_health(stats: DataFrame) -> DataFrame:
    """Scans that found nothing in few samples, which points at a decoding failure."""
    return stats.withColumn("suspect", (F.col("kills") == 0) & (F.col("samples") > 0) & (F.col("samples") < 50))


def is_decode_error(message: Column) -> Column:
    return F.lower(nz(message, "")).rlike("av1|failed to get pixel")


def dedupe_peaks(peaks: DataFrame, gap: float = 3.5, most: int = 4) -> DataFrame:
    """The strongest peaks at least ``gap`` apart; feed regions count 45, confidence counts as strength and again."""
    score = F.when(ev.top_right(), 45).otherwise(0) + (F.col("strength") if "strength" in peaks.columns else nz(F.col("confidence"), 0.5) * 12) + nz(F.col("confidence"), 0.0) * 8
    rows = peaks.select(*KEY, "seq", "time", "roi", "confidence", score.alias("_s"))
    out = greedy_rank(rows, KEY, [-F.col("_s"), F.col("seq")], lambda a, b: F.abs(a["time"] - b["time"]) < gap, most)
    return out.drop("_s")


def clamp_trim(start: Column, end: Column, source: Column) -> tuple[Column, Column]:
    """Trim limits: 8 to 60 seconds, inside the source."""
    s = F.greatest(F.lit(0.0), nz(start, 0.0))
    e = F.greatest(s + MIN_MAIN, F.when(nz(end, 0.0) == 0, s + 28).otherwise(end))
    known = source > 0
    e = F.when(known, F.least(source, e)).otherwise(e)
    s = F.when(known, F.least(s, F.greatest(F.lit(0.0), e - MIN_MAIN))).otherwise(s)
    return s, F.when(e - s > MAX_MAIN, s + MAX_MAIN).when(e - s < MIN_MAIN, s + MIN_MAIN).otherwise(e)


def trim_changed(old_start: Column, old_end: Column, new_start: Column, new_end: Column, tolerance: float = 0.35) -> Column:
    return (F.abs(new_start - old_start) > tolerance) | (F.abs(new_end - old_end) > tolerance)


def hook_changed(teaser: Column, new_teaser: Column, cold: Column, new_cold: Column, peak: Column, new_peak: Column, offset: Column, new_offset: Column) -> Column:
    far = lambda a, b: F.abs(nz(a, 0.0) - nz(b, 0.0)) > 0.35
    return (F.abs(nz(new_teaser, 0.0) - nz(teaser, TEASER)) > 0.15) | (nz(cold, False) != nz(new_cold, False)) | far(peak, new_peak) | far(offset, new_offset)


def segments_changed(old: Column, new: Column, tolerance: float = 0.12) -> Column:
    """Whether two lists of cuts differ in length, start or duration."""
    moved = F.exists(F.arrays_zip(old.alias("a"), new.alias("b")), lambda z: (F.abs(nz(z["a"]["start"], 0.0) - nz(z["b"]["start"], 0.0)) > tolerance) | (F.abs(nz(z["a"]["duration"], 0.0) - nz(z["b"]["duration"], 0.0)) > tolerance))
    return F.when((nz(F.size(old), 0) < 1) | (nz(F.size(new), 0) < 1), False).when(F.size(old) != F.size(new), True).otherwise(moved)


def within_window(old_start: Column, old_end: Column, new_start: Column, new_end: Column) -> Column:
    return (new_start >= old_start - 0.35) & (new_end <= old_end + 0.35)


def least_peak_offset(duration: Column) -> Column:
    return F.greatest(F.lit(LATE_SEC), F.greatest(F.lit(8.0), duration) * LATE_SHARE)


def clamp_peak(start: Column, end: Column, peak: Column) -> Column:
    """Peak of the opening teaser, late enough in the clip."""
    return F.when(peak.isNull(), start + (end - start) * 0.72).otherwise(F.greatest(start + least_peak_offset(end - start), F.least(end - 0.5, peak)))


def late_enough(start: Column, end: Column, peak: Column) -> Column:
    return nz((peak >= start) & (peak <= end) & (peak - start >= least_peak_offset(end - start)), False)


def wants_cold_open(user_flag: Column, start: Column, end: Column, peak: Column, teaser: Column) -> Column:
    length = F.when(nz(teaser, 0.0) == 0, TEASER).otherwise(teaser)
    return nz(user_flag, False) & (end - start >= MIN_MAIN) & (length >= MIN_TEASER) & late_enough(start, end, peak)


def teaser_window(start: Column, end: Column, peak: Column, teaser: Column) -> dict[str, Column]:
    """Where the teaser lies inside the clip."""
    main = F.greatest(F.lit(1.0), end - start)
    raw = nz(peak - start, main * 0.72)
    at = F.greatest(least_peak_offset(main), F.least(main - 0.35, raw))
    stop = F.least(main, at + 0.15)
    begin = F.greatest(F.lit(0.0), stop - teaser)
    tail = F.greatest(F.lit(0.0), main - teaser)
    begin = F.when(at >= main - teaser - 0.2, tail).when(stop - begin < teaser - 0.05, tail).otherwise(begin)
    return {"teaser_start": begin, "peak_in_clip": at, "main_duration": main}


def export_peak(start: Column, end: Column, offset: Column, set_peak: Column, old_peak: Column, cold: Column) -> Column:
    """Peak used for an export: the slider offset, the set peak, the stored peak or 72 percent of the clip."""
    peak = F.coalesce(start + offset, set_peak, old_peak, start + (end - start) * 0.72)
    peak = clamp(peak, start + 0.3, end - 0.3)
    return F.when(cold, clamp_peak(start, end, peak)).otherwise(peak)


def trim_around_peak(start: Column, end: Column, peak: Column, source: Column) -> dict[str, Column]:
    """A trim window with the peak at about 72 percent; moved twice if clamping pushes the peak outside."""
    length = clamp(F.greatest(end - start, F.lit(24.0)), MIN_MAIN, MAX_MAIN)
    offset = F.greatest(least_peak_offset(length), F.least(length - 0.35, length * 0.72))

    def fits(w):
        return (peak >= w[0] - 0.2) & (peak <= w[1] + 0.2)

    first = clamp_trim(peak - offset, peak - offset + length, source)
    limit = F.when(source > 0, F.least(source, peak + 4)).otherwise(peak + 4)
    second = clamp_trim(peak - (length - 4), limit, source)
    late = F.greatest(F.lit(0.0), peak - MIN_MAIN)
    third = clamp_trim(late, late + length, source)
    pick = lambda i: F.when(fits(first), first[i]).when(fits(second), second[i]).otherwise(third[i])
    return {"start": pick(0), "end": pick(1)}
