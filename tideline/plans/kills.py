"""From noisy detections to kills, engagements, packs and cut lists."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import events as ev
from tideline.functions.numeric import half_up, nz, tenth
from tideline.functions.patterns import KILL_WORDS, has
from tideline.operators.ordered import gap_sessions, ordered, top_per_key, windowed, within
from tideline.operators.scans import scan_sessions

KEY = ["video_id"]

# Gaps, caps and spans in seconds.
ENGAGEMENT_GAP = 4.5
DEDUPE_GAP = 1.6
MAX_KILLS = 4
BURST_GAP, BURST_SPAN = 22.0, 55.0
DENSE_GAP, DENSE_SPAN = 22.0, 32.0
CLUSTER_GAP, CLUSTER_SPAN = 95.0, 600.0
WIDE_GAP, CHAIN_SPAN = 30.0, 75.0
COHERENT_GAP = 35.0
SAME_KILL_SEC = 7.0
MIN_MONTAGE = 12.0
TRIM_GAP, TRIM_MIN = 0.15, 1.15


@dataclass(frozen=True)
class Timing:
    """Pre-roll, post-roll and limits of one cut, in seconds."""

    before: float
    after: float
    longest: float
    shortest: float
    total: float
    offset: float = 0.0


# Timing profiles.
KILL_ONLY = Timing(2.0, 4.0, 6.0, 4.0, 26.0)
HUD = Timing(1.2, 7.0, 8.5, 4.5, 44.0)
RED = Timing(1.0, 7.0, 8.5, 4.5, 40.0, -0.85)
SINGLE = Timing(2.0, 8.0, 10.0, 8.0, 11.0)
PAYOFF = Timing(0.5, 6.0, 6.5, 5.0, 0.0)


def confirmed_kills(events: DataFrame) -> DataFrame:
    return ev.complete(events).filter(ev.confirmed())


def quality_kills(events: DataFrame) -> DataFrame:
    """Confirmed kills that pass the stricter gate; neighbours within six seconds come from one bounded window."""
    pool = confirmed_kills(events).withColumn(
        "_k", ((F.col("roi") == "bottom_kills") | has(nz(F.col("text"), ""), KILL_WORDS)).cast("int"))
    reach = ev.SPAWN_PAIR_SEC
    near = windowed(pool, KEY, "time", reach, [], {
        "_n": lambda w: F.count(F.lit(1)).over(within(w, reach, reach)),
        "_nk": lambda w: F.sum("_k").over(within(w, reach, reach)),
    })
    return near.filter(ev.quality(F.col("_n") - 1, F.col("_nk") - F.col("_k"))).drop("_k", "_n", "_nk")


def player_feed_kills(events: DataFrame) -> DataFrame:
    return ev.complete(events).filter(ev.player_feed())


def trusted_kills(events: DataFrame) -> DataFrame:
    return ev.complete(events).filter(ev.trusted())


def fingerprint_kills(events: DataFrame, duration: Column | float | None = None) -> DataFrame:
    """One row per kill: readings within seven seconds of a key's first reading merge into it, the strongest reading
    wins and the earliest anchor stays; later readings of the key are kills of their own, one per anchor."""
    feed = player_feed_kills(events).withColumn("anchor", tenth(ev.event_time()))
    if duration is not None:
        limit = duration if isinstance(duration, Column) else F.lit(float(duration))
        feed = feed.filter((limit <= 0) | (F.col("anchor") <= limit - 1))
    named = nz(F.col("fingerprint"), "") != ""
    feed = feed.withColumn("kill_key", F.when(named, F.concat(F.lit("fp:"), "fingerprint"))
                           .when(nz(F.col("victim"), "") != "", F.concat(F.lit("kv:"), nz(F.col("killer"), ""), F.lit(">"), F.col("victim")))
                           .otherwise(F.concat(F.lit("t:"), half_up(F.col("anchor") / 2))))
    first = feed.groupBy(*KEY, "kill_key").agg(F.min("anchor").alias("_first"))
    feed = feed.join(first, [*KEY, "kill_key"])
    merged = (F.col("anchor") - F.col("_first")) <= SAME_KILL_SEC
    feed = feed.withColumn("_group", F.when(merged, F.col("_first")).otherwise(F.col("anchor")))
    sign = F.when(merged, -1).otherwise(1)
    rank = F.struct(F.when(merged, ev.strength_of_reading()).otherwise(0.0).alias("a"), (ev.event_time() * sign).alias("b"), (F.col("seq") * sign).alias("c"))
    kept = [c for c in feed.columns if c not in (*KEY, "kill_key", "_first", "_group", "anchor")]
    best = feed.groupBy(*KEY, "kill_key", "_group").agg(
        F.max_by(F.struct(*kept), rank).alias("_w"), F.min("anchor").alias("_anchor"), F.count(F.lit(1)).alias("readings"))
    out = best.select(*KEY, "kill_key", "readings", "_w.*", "_anchor")
    return out.withColumns({
        "kill_anchor_time": F.col("_anchor"), "validated_by": F.lit("red-highlight"), "player_kill": F.lit(True),
        "red_highlight": F.lit(True), "kill_quality_score": ev.kill_quality()}).drop("_anchor")


def quality_pool(events: DataFrame, has_loudness: Column | bool = False, duration: Column | float | None = None) -> DataFrame:
    """Validated kills where a recording has any; otherwise nothing if its loudness is known, else the quality kills."""
    validated = fingerprint_kills(events, duration)
    with_any = validated.select(*KEY).distinct()
    fallback = quality_kills(events).filter(~(has_loudness if isinstance(has_loudness, Column) else F.lit(has_loudness)))
    return validated.unionByName(fallback.join(with_any, KEY, "left_anti"), allowMissingColumns=True)


def collapse_engagements(events: DataFrame, gap: float = ENGAGEMENT_GAP) -> DataFrame:
    """One detection per engagement, kill feed regions first, then by confidence and activity."""
    rows = ev.complete(events).withColumn("at", ev.event_time())
    rows = gap_sessions(rows, KEY, "at", gap, ["seq"])
    score = F.coalesce(F.col("confidence"), F.lit(0.0)) * 12 + F.coalesce(F.col("activity"), F.lit(0.0)) * 20
    kept = [c for c in rows.columns if c not in (*KEY, "session_start")]
    best = rows.groupBy(*KEY, "session_start").agg(
        F.max_by(F.struct(*kept), F.struct(ev.top_right().cast("int"), score, -F.col("at"), -F.col("seq"))).alias("_b"),
        F.count(F.lit(1)).alias("flashes"))
    return best.select(*KEY, "session_start", "flashes", "_b.*")


def timeline_dedupe(events: DataFrame, gap: float = DEDUPE_GAP, limit: int | None = MAX_KILLS) -> DataFrame:
    """Kill moments of a recording: feed regions only where at least two exist, one event per group of close
    detections (best score, earlier within 0.05), the first ``limit`` in time order."""
    rows = ev.complete(events).withColumns({"at": ev.event_time(), "_tr": ev.top_right().cast("int")})
    rich = rows.groupBy(*KEY).agg(F.sum("_tr").alias("_n")).filter("_n >= 2").select(*KEY, F.lit(True).alias("_rich"))
    rows = rows.join(rich, KEY, "left").filter(F.col("_rich").isNull() | (F.col("_tr") == 1)).drop("_rich", "_tr")
    rows = gap_sessions(rows, KEY, "at", gap, ["seq"]).withColumn("_score", ev.timeline_score())
    top = rows.groupBy(*KEY, "session_start").agg(F.max("_score").alias("_top"))
    rows = rows.join(top, [*KEY, "session_start"]).filter(F.col("_score") >= F.col("_top") - 0.05)
    kept = [c for c in rows.columns if c not in (*KEY, "session_start", "_score", "_top")]
    best = rows.groupBy(*KEY, "session_start").agg(F.min_by(F.struct(*kept), F.struct("at", "seq")).alias("_b")).select(*KEY, "session_start", "_b.*")
    if limit is None:
        return best
    return top_per_key(best, KEY, [F.col("at"), F.col("seq")], limit)


def burst_packs(events: DataFrame, gap: float = BURST_GAP, span: float = BURST_SPAN, most: int = MAX_KILLS) -> DataFrame:
    """Every event in exactly one pack: gap, span and count limits, first come first served."""
    rows = ev.complete(events).withColumn("at", ev.event_time())
    rows = gap_sessions(rows, KEY, "at", gap, ["seq"])
    slim = rows.select(*KEY, "session_start", "at", "seq")

    def step(prev: Column, row: Column) -> Column:
        fresh = prev.isNull() | (prev["n"] >= most) | (row["at"] - prev["first_at"] > span)
        return F.struct(
            F.when(fresh, row["at"]).otherwise(prev["first_at"]).alias("first_at"),
            F.when(fresh, row["seq"]).otherwise(prev["first_seq"]).alias("first_seq"),
            F.when(fresh, 1).otherwise(prev["n"] + 1).cast("int").alias("n"))

    packed = scan_sessions(slim, KEY, "session_start", "at", ["seq"], "struct<first_at:double,first_seq:bigint,n:int>", step)
    packed = packed.select(*KEY, "at", "seq", F.col("state.first_at").alias("pack_at"), F.col("state.first_seq").alias("pack_seq"), F.col("state.n").alias("pos"))
    return rows.drop("session_start").join(packed, [*KEY, "at", "seq"])


def gap_span_clusters(points: DataFrame, t: str, tie: list[str], gap: float, span: float) -> DataFrame:
    """Clusters limited by gap and total span; adds ``cluster_at`` (first time of the cluster)."""
    rows = gap_sessions(points, KEY, t, gap, tie)

    def step(prev: Column, row: Column) -> Column:
        fresh = prev.isNull() | (row[t] - prev["first"] > span)
        return F.struct(F.when(fresh, row[t]).otherwise(prev["first"]).alias("first"))

    out = scan_sessions(rows.select(*KEY, "session_start", t, *tie, *[c for c in points.columns if c not in (*KEY, t, *tie)]),
                        KEY, "session_start", t, tie, "struct<first:double>", step)
    return out.select(*points.columns, F.col("state.first").alias("cluster_at"))


def peak_clusters(peaks: DataFrame, gap: float = 18.0, span: float = 105.0, least: int = 2) -> DataFrame:
    """Loudness peak chains with their score."""
    rows = gap_span_clusters(peaks, "time", ["idx"], gap, span)
    return rows.groupBy(*KEY, "cluster_at").agg(
        F.count(F.lit(1)).alias("peaks"), F.max("time").alias("end"), F.max("strength").alias("max_strength"), F.sum("strength").alias("total")
    ).filter(F.col("peaks") >= least).select(
        *KEY, F.col("cluster_at").alias("start"), "end", "peaks", "max_strength",
        (F.col("peaks") * 22 + F.col("max_strength") * 4 + F.col("total")).alias("score"))


PACK = [*KEY, "pack_at", "pack_seq"]


def dedupe_groups(rows: DataFrame, keys: list[str], gap: float = DEDUPE_GAP, most: int | None = None) -> DataFrame:
    """The timeline rule inside small groups: feed regions only where there are two, one event per group of close
    detections, the first ``most`` in time order. All windows share the group key, so rows are shuffled once."""
    group = W.partitionBy(*keys)
    timed = group.orderBy("at", "seq")
    rows = rows.withColumns({"_tr": ev.top_right().cast("int"), "_score": ev.timeline_score()})
    rows = rows.withColumn("_feeds", F.sum("_tr").over(group)).filter((F.col("_feeds") < 2) | (F.col("_tr") == 1))
    rows = rows.withColumn("_new", (F.coalesce(F.col("at") - F.lag("at").over(timed), F.lit(gap + 1)) > gap).cast("int"))
    rows = rows.withColumn("_grp", F.sum("_new").over(timed.rowsBetween(W.unboundedPreceding, 0)))
    close = W.partitionBy(*keys, "_grp")
    rows = rows.withColumn("_top", F.max("_score").over(close)).filter(F.col("_score") >= F.col("_top") - 0.05)
    rows = rows.withColumn("_rk", F.row_number().over(close.orderBy("at", "seq"))).filter("_rk = 1")
    if most:
        rows = rows.withColumn("_pos", F.row_number().over(timed)).filter(F.col("_pos") <= most).drop("_pos")
    return rows.drop("_tr", "_score", "_feeds", "_new", "_grp", "_top", "_rk")


def dedupe_packs(packed: DataFrame) -> DataFrame:
    """The timeline rule inside each pack; a pack has at most four rows."""
    return dedupe_groups(packed, PACK)


def segment_columns(rows: DataFrame, red: Column, video_end: Column, per: list[str]) -> DataFrame:
    """Add ``start``/``duration``/``peak_time`` of the cut around each kill: shortened before the next kill, shifted
    back at the end of the recording, null where it is too short. ``red`` chooses the timing profile."""
    pick = lambda field: F.when(red, getattr(RED, field)).otherwise(getattr(HUD, field))
    timed = W.partitionBy(*per).orderBy("at", "seq")
    rows = rows.withColumn("_at", F.when(red, ev.anchor(None, RED.offset)).otherwise(ev.anchor(None, HUD.offset)))
    room = F.lead("_at").over(timed) - F.col("_at") - 0.25
    after = F.when(room.isNull(), pick("after")).otherwise(F.least(pick("after"), F.greatest(F.lit(0.9), room)))
    rows = rows.withColumn("_len", F.least(pick("longest"), pick("before") + after))
    begin = F.greatest(F.lit(0.0), F.col("_at") - pick("before"))
    rows = rows.withColumn("_begin", F.when(begin + F.col("_len") > video_end, F.greatest(F.lit(0.0), video_end - F.col("_len"))).otherwise(begin))
    rows = rows.withColumn("_len", F.least(F.col("_len"), video_end - F.col("_begin")))
    ok = F.col("_len") >= pick("shortest")
    return rows.withColumns({"start": F.when(ok, tenth(F.col("_begin"))), "duration": F.when(ok, tenth(F.col("_len"))), "peak_time": tenth(F.col("_at"))}).drop("_at", "_begin", "_len")


def trim_overlaps(segments: Column, least: float = TRIM_MIN, gap: float = TRIM_GAP) -> Column:
    """Shorten each cut so that it ends before the next one starts; drop cuts that become too short."""
    def fit(s: Column, i: Column) -> Column:
        room = F.get(segments, i + 1)["start"] - gap - s["start"]
        return s.withField("duration", F.when(nz(room < s["duration"], False), F.greatest(F.lit(least), tenth(room))).otherwise(s["duration"]))

    return F.filter(F.transform(segments, fit), lambda s: s["duration"] >= least)


def total_duration(segments: Column) -> Column:
    return tenth(F.aggregate(segments, F.lit(0.0), lambda a, s: a + nz(s["duration"], 0.0)))


def coherent(segments: Column, wide_gap: bool | None = None) -> Column:
    """Whether a cut list stays within one fight. ``wide_gap=None`` lets a gap above 35 s switch the gap test off,
    as specified; ``False`` rejects such lists."""
    gaps = F.transform(segments, lambda s, i: nz(s["peak_time"], s["start"]) - nz(F.get(segments, i - 1)["peak_time"], F.get(segments, i - 1)["start"]))
    jump = F.exists(F.slice(gaps, 2, F.greatest(F.size(gaps), F.lit(1))), lambda g: g > COHERENT_GAP)
    wide = jump if wide_gap is None else F.lit(wide_gap)
    first, last = F.get(segments, F.lit(0)), F.element_at(segments, -1)
    span = nz(last["peak_time"], last["start"]) - nz(first["peak_time"], first["start"])
    return F.when(F.size(segments) < 1, False).when(F.size(segments) == 1, True).otherwise(
        (wide | (~jump & (span <= BURST_SPAN))) & (span <= CLUSTER_SPAN))


def pack_clips(packed: DataFrame, video_end: Column | float, wide_gap: bool | None = None) -> DataFrame:
    """One clip per pack: a continuous fight, a single kill or a jump-cut montage, with its score and its segments."""
    limit = video_end if isinstance(video_end, Column) else F.lit(float(video_end))
    pack = W.partitionBy(*PACK)
    timed = pack.orderBy("at", "seq")
    red = nz(F.col("red_highlight"), False) | (nz(F.col("validated_by"), "") == "red-highlight")
    rows = dedupe_packs(packed).withColumns({
        "_n": F.count(F.lit(1)).over(pack),
        "_gap": F.col("at") - F.lag("at").over(timed),
        "_marked": F.max(red | nz(F.col("player_kill"), False)).over(pack),
        "_reds": F.sum((red | nz(F.col("method"), "").contains("red-highlight")).cast("int")).over(pack),
    })
    rows = rows.withColumn("_red", F.when(F.col("_n") == 1, F.col("_marked")).otherwise(F.col("_reds") >= F.col("_n") / 2))
    rows = rows.withColumns({"_am": F.when(F.col("_marked"), ev.anchor(None, RED.offset)).otherwise(ev.anchor(None, HUD.offset)),
                             "_ar": F.when(F.col("_red"), ev.anchor(None, RED.offset)).otherwise(ev.anchor(None, HUD.offset))})
    rows = segment_columns(rows, F.col("_red"), limit, PACK)
    cut = F.struct("at", "seq", "start", "duration", "peak_time", tenth(F.coalesce("audio_peak_time", "at")).alias("raw_time"),
                   tenth(F.col("at")).alias("hud_flash_time"), F.col("roi").alias("hud_roi"), "confidence")
    first, last = (lambda c: F.min_by(c, F.struct("at", "seq"))), (lambda c: F.max_by(c, F.struct("at", "seq")))
    packs = rows.groupBy(*PACK).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max("_gap"), F.lit(0.0)).alias("max_gap"), (F.max("at") - F.min("at")).alias("span"),
        F.avg(nz(F.col("confidence"), 0.5)).alias("mean"), F.max(nz(F.col("confidence"), 0.5)).alias("peak"), first("at").alias("t0"), first("roi").alias("roi0"),
        first("_am").alias("am0"), last("_am").alias("am1"), first("_ar").alias("ar0"), last("_ar").alias("ar1"),
        F.sort_array(F.collect_list(F.when(F.col("start").isNotNull(), cut))).alias("_raw"),
        F.sort_array(F.collect_list(tenth(F.col("at")))).alias("times"))

    def window(a0: str, a1: str) -> tuple[Column, Column]:
        begin = F.greatest(F.lit(0.0), F.col(a0) - max(1.2, RED.before, HUD.before))
        end = F.least(limit, F.col(a1) + max(8.0, RED.after, HUD.after))
        return begin, F.when(end - begin < MIN_MONTAGE, F.least(limit, begin + MIN_MONTAGE)).otherwise(end)

    (bm, em), (br, er) = window("am0", "am1"), window("ar0", "ar1")
    packs = packs.withColumns({"bm": bm, "em": em, "br": br, "er": er, "_cuts": trim_overlaps(F.col("_raw"))})
    dense = (F.col("n") >= 2) & (F.col("span") <= DENSE_SPAN) & (F.col("max_gap") <= DENSE_GAP)
    packs = packs.withColumns({"_late": F.col("em") - F.col("bm") < 4, "_out": total_duration(F.col("_cuts")), "_k": F.size("_cuts")})
    need = F.when(F.col("_k") >= 4, MIN_MONTAGE).when(F.col("_k") >= 3, 7.0).otherwise(4.0)
    packs = packs.withColumn("kind", F.when(dense & ~(F.col("_late") & (F.col("er") - F.col("br") < 4)), "continuous")
                             .when((F.col("n") == 1) & (F.get("_raw", F.lit(0))["duration"] >= 3), "single")
                             .when((F.col("n") >= 2) & (F.col("_k") >= 2) & (F.col("_out") >= need), "montage")).filter("kind is not null")
    begin, end = F.when(F.col("_late"), F.col("br")).otherwise(F.col("bm")), F.when(F.col("_late"), F.col("er")).otherwise(F.col("em"))
    whole = F.struct(tenth(begin).alias("start"), tenth(end - begin).alias("duration"), tenth(F.when(F.col("_late"), F.col("ar0")).otherwise(F.col("am0"))).alias("peak_time"),
                     tenth(F.col("t0")).alias("raw_time"), tenth(F.col("t0")).alias("hud_flash_time"), F.col("roi0").alias("hud_roi"), F.col("peak").alias("confidence"),
                     F.col("n").cast("int").alias("kill_count"), F.col("times").alias("kill_times"))
    lone = lambda s: F.struct(s["start"], s["duration"], s["peak_time"], s["raw_time"], s["hud_flash_time"], s["hud_roi"], s["confidence"],
                              F.lit(1).alias("kill_count"), F.array(s["hud_flash_time"]).alias("kill_times"))
    packs = packs.withColumn("segments", F.when(F.col("kind") == "continuous", F.array(whole)).when(F.col("kind") == "single", F.transform("_raw", lone))
                             .otherwise(F.transform("_cuts", lone)))
    packs = packs.filter(coherent(F.col("segments"), wide_gap)).withColumn("kill_count", F.aggregate("segments", F.lit(0), lambda a, s: a + s["kill_count"]))
    score = (F.when(F.col("kind") == "single", 72).when((F.col("kind") == "continuous") & ~F.col("_late"), 58 + F.col("kill_count") * 24)
             .otherwise(50 + F.col("kill_count") * 22))
    last_cut = F.element_at("segments", -1)
    return packs.select(
        *PACK, "kind", "kill_count", F.get("segments", F.lit(0))["start"].alias("start_time"), tenth(last_cut["start"] + last_cut["duration"]).alias("end_time"),
        total_duration(F.col("segments")).alias("output_duration"), score.cast("double").alias("local_score"),
        F.least(F.lit(95), half_up(F.col("mean") * 100)).cast("double").alias("confidence"), tenth(F.col("span")).alias("chain_span"), "segments")


def dense_fights(packed: DataFrame) -> DataFrame:
    """Packs whose kills all lie close together."""
    stepped = ordered(packed.withColumn("_p", F.struct("pack_at", "pack_seq")), KEY, "at", ["seq"], lag={"_pa": "at", "_pp": "_p"})
    gap = F.when(F.col("_pp") == F.col("_p"), F.col("at") - F.col("_pa"))
    stats = stepped.withColumn("_g", gap).groupBy(*KEY, "pack_at", "pack_seq").agg(
        F.count(F.lit(1)).alias("kills"), (F.max("at") - F.min("at")).alias("span"), F.coalesce(F.max("_g"), F.lit(0.0)).alias("max_gap"))
    return stats.filter((F.col("kills") >= 2) & (F.col("span") <= DENSE_SPAN) & (F.col("max_gap") <= DENSE_GAP))


def merged_clips(anchors: DataFrame, duration: Column | float, gap: float = 5.0, before: float = 4.0, after: float = 2.0) -> DataFrame:
    """Clips around close anchors, merged where they touch, with the number of distinct anchors."""
    limit = duration if isinstance(duration, Column) else F.lit(float(duration))
    marks = anchors.select(*KEY, "anchor").distinct()
    groups = gap_sessions(marks, KEY, "anchor", gap).groupBy(*KEY, "session_start").agg(F.max("anchor").alias("_last"), F.count(F.lit(1)).alias("kills"))
    spans = groups.select(*KEY, F.greatest(F.lit(0.0), F.col("session_start") - before).alias("start"), F.least(limit, F.col("_last") + after).alias("end"), "kills")
    spans = ordered(spans, KEY, "start", ["end"], run_max={"_reach": "end"})
    spans = ordered(spans, KEY, "start", ["end"], lag={"_before": "_reach"})
    spans = spans.withColumn("_open", F.when(F.col("_before").isNull() | (F.col("start") > F.col("_before")), F.col("start")))
    spans = ordered(spans, KEY, "start", ["end"], fill={"_clip": "_open"})
    return spans.groupBy(*KEY, F.col("_clip").alias("clip_start")).agg(F.max("end").alias("clip_end"), F.sum("kills").alias("kills"))
