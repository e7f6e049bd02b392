"""Ranking candidates and choosing the final highlights."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.numeric import clamp, half_up, nz, tenth
from tideline.operators.greedy import greedy_rank
from tideline.operators.ordered import top_per_key
from tideline.operators.ranges import band_join, overlap_join

KEY = ["video_id"]

# Overlap shares, least distances in seconds, pool and clip limits.
POOL_OVERLAP, POOL_GAP, MOST_RAW, POOL, PER_THIRD = 0.35, 20.0, 28, 12, 6
DEDUPE_OVERLAP, DEDUPE_GAP, DEDUPE_MOST, DEDUPE_FALLBACK = 0.4, 22.0, 7, 5
LEAST_CLIPS, MOST_CLIPS, SHOOTER_CLIPS = 3, 5, 99
LONG_VIDEO, SPREAD_LONG, SPREAD_SHORT = 600.0, 90.0, 22.0
QUALITY, STRONG_CONF, LEAST_CONF, STRONG_SHARE = 8.0, 62, 42, 0.72
FOCUS_RADIUS = 420.0
WEAK_CONF = 75


def overlap_share(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap as a share of the shorter interval; an empty shorter interval counts as length one."""
    shared = F.least(a1, b1) - F.greatest(a0, b0)
    shorter = F.least(a1 - a0, b1 - b0)
    return F.when(shared <= 0, 0.0).otherwise(shared / F.when(shorter == 0, 1.0).otherwise(shorter))


def clash(share: float, gap: Column | float):
    """Conflict test on rows with ``start_time`` and ``end_time``."""
    limit = gap if isinstance(gap, Column) else F.lit(float(gap))
    return lambda a, b: (overlap_share(a["start_time"], a["end_time"], b["start_time"], b["end_time"]) > share) | (F.abs(a["start_time"] - b["start_time"]) < limit)


def third_quota(candidates: DataFrame, duration: Column) -> DataFrame:
    """Arrival rank inside each third of the recording; at most six per third count as quota rows."""
    third = F.least(F.lit(2), F.floor(F.col("start_time") / (duration / 3))).cast("int")
    rows = candidates.withColumn("third", third)
    return top_per_key(rows, [*KEY, "third"], [F.col("arrival")], PER_THIRD, rank="in_third")


def merge_pool(candidates: DataFrame, duration: Column, most: int = MOST_RAW) -> DataFrame:
    """Quota rows of each third by score first, then the other raw rows by arrival, keeping rows that do not overlap."""
    raw = top_per_key(candidates, KEY, [F.col("arrival")], most)
    quota = third_quota(raw, duration).select(*KEY, "arrival", "third").withColumn("_q", F.lit(0))
    rows = raw.join(quota, [*KEY, "arrival"], "left")
    rows = rows.withColumns({"_q": nz(F.col("_q"), 1), "third": nz(F.col("third"), 9)})
    rank = F.when(F.col("_q") == 0, -F.col("local_score")).otherwise(0.0)
    out = greedy_rank(rows, KEY, [F.col("_q"), F.col("third"), rank, F.col("arrival")], clash(POOL_OVERLAP, POOL_GAP), most)
    return out.drop("_q", "third")


def final_order() -> list[Column]:
    return [F.desc(nz(F.col("kills"), 0)), F.desc(nz(F.col("montage"), False).cast("int")), F.desc("local_score")]


def ranked_pool(merged: DataFrame, most: int = POOL) -> DataFrame:
    """Final order of a pool with list index and confidence relative to the first row."""
    top = top_per_key(merged, KEY, [*final_order(), F.col("place")], most, rank="list_index")
    first = F.first("local_score").over(W.partitionBy(*KEY).orderBy("list_index"))
    return top.withColumn("confidence", relative_confidence(F.col("local_score"), first))


def relative_confidence(score: Column, top: Column) -> Column:
    return F.least(F.lit(99), half_up(score / F.when(nz(top, 0.0) == 0, 1.0).otherwise(top) * 100)).cast("int")


def shooter_pool(pool: DataFrame, most: int = POOL) -> DataFrame:
    """Montages where a recording has any, else rows flagged with kills; all montages stay when they exceed the pool."""
    flags = pool.groupBy(*KEY).agg(F.max(F.col("montage").cast("int")).alias("_any"), F.count_if("montage").alias("_m"))
    rows = pool.join(flags, KEY).filter(F.when(F.col("_any") == 1, F.col("montage")).otherwise(F.array_contains("flags", "hud-kills")))
    limit = F.greatest(F.lit(most).cast("bigint"), F.col("_m"))
    rows = rows.withColumn("list_index", F.row_number().over(W.partitionBy(*KEY).orderBy(*final_order(), "place"))).filter(F.col("list_index") <= limit)
    return rows.drop("_any", "_m")


def fill_grid(duration: Column, low: Column | float = 12.0, least: int = 8) -> Column:
    """Evenly spaced times that fill a small pool: every max(30, duration/9) seconds up to the last clip start."""
    step = F.greatest(F.lit(30.0), duration / (least + 1))
    n = F.greatest(F.lit(0), F.ceil((duration - low) / step - 1).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i * step)).otherwise(F.expr("cast(array() as array<double>)"))


def attach_candidates(highlights: DataFrame, candidates: DataFrame, share: float = 0.5, gap: float = 4.0) -> DataFrame:
    """Each highlight's first candidate with the same list index, enough overlap or a close start.

    The three alternatives are three equi-joins (index, time bin, time bin) whose union is reduced to the first match.
    """
    c = candidates.select(*KEY, F.col("list_index").alias("c_index"), F.col("start_time").alias("_cs"), F.col("end_time").alias("_ce"))
    h = highlights.select(*KEY, "hid", "candidate_id", F.col("start_time").alias("_hs"), F.col("end_time").alias("_he"))
    same = h.join(c, [h.video_id == c.video_id, h.candidate_id == c.c_index]).select(h.video_id, "hid", "c_index")
    over = overlap_join(h, c, KEY, (F.col("_hs"), F.col("_he")), (F.col("_cs"), F.col("_ce")))
    over = over.filter(overlap_share(F.col("_cs"), F.col("_ce"), F.col("_hs"), F.col("_he")) > share).select(*KEY, "hid", "c_index")
    near = band_join(h, c, KEY, F.col("_hs"), F.col("_cs"), gap, gap).filter(F.abs(F.col("_cs") - F.col("_hs")) < gap).select(*KEY, "hid", "c_index")
    first = same.unionByName(over).unionByName(near).groupBy(*KEY, "hid").agg(F.min("c_index").alias("match_index"))
    return highlights.join(first, [*KEY, "hid"], "left")


def resolve_picks(picks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Picks bound to candidates by list index; picks that name no candidate drop out, the order of picks stays."""
    index = F.regexp_extract(F.regexp_replace(F.trim("candidate_id"), "^#", ""), r"^(\d{1,9})", 1).try_cast("int")
    named = picks.withColumn("list_index", index).filter(F.col("list_index").isNotNull()).drop("candidate_id")
    return named.join(candidates, [*KEY, "list_index"])


def normalise_highlight(start: Column, end: Column, low: float = 12.0, high: float = 45.0) -> tuple[Column, Column]:
    s = nz(start, 0.0)
    e = F.when(nz(end, 0.0) == 0, s + 25).otherwise(end)
    return s, F.when(e - s < low, s + low).when(e - s > high, s + high).otherwise(e)


def valid_highlights(rows: DataFrame, duration: Column) -> DataFrame:
    """Clamp to the recording; plain clips need five seconds, montages three seconds of output."""
    s, e = clamp(F.col("start_time"), 0.0, duration), clamp(F.col("end_time"), 0.0, duration)
    ok = F.when(F.col("montage"), F.col("output_duration") >= 3).otherwise((s < duration) & (e > s) & (e - s >= 5))
    return rows.filter(ok).withColumns({"start_time": F.when(F.col("montage"), F.col("start_time")).otherwise(s), "end_time": F.when(F.col("montage"), F.col("end_time")).otherwise(e)})


def dedupe_highlights(highlights: DataFrame, gap: float = DEDUPE_GAP) -> DataFrame:
    """The best non-overlapping highlights, at most seven. The first row is always kept, so the five-row fallback of
    an empty selection cannot occur."""
    order = [-nz(F.col("viral_score"), 0.0), -nz(F.col("confidence"), 0.0), F.col("seq")]
    return greedy_rank(highlights, KEY, order, clash(DEDUPE_OVERLAP, gap), DEDUPE_MOST)


def window_text_score(peak: Column, mean: Column) -> Column:
    return peak * 2 + mean


def pick_score(text_score: Column, start: Column, focus: Column | None = None) -> Column:
    """Value of a pick from its text score and its candidate's score, sound and flags (null columns without a match)."""
    has = lambda f: nz(F.array_contains("c_flags", f), False)
    score = (text_score + nz(F.col("c_score"), 0.0) * 0.15 + nz(F.col("c_audio"), 0.0) * 0.5 + F.when(has("hype-moment"), 30).otherwise(0) + F.when(has("multikill-montage"), 45).otherwise(0)
             + F.when(has("kill-chain"), 25).otherwise(0) + F.when(has("hud-kills"), 40).otherwise(0) + F.when(has("kill-feed"), 30).otherwise(0))
    return score if focus is None else score + F.when(F.abs(start - focus) < FOCUS_RADIUS, 25).otherwise(0)


def strong_pick(quality: Column, confidence: Column, score: Column, top: Column) -> Column:
    """Good text or strong sound, and enough confidence, relative score or strong sound."""
    montage = nz(F.col("c_montage"), False) | nz(F.arrays_overlap("c_flags", F.array(*[F.lit(f) for f in ("multikill-montage", "kill-chain", "hud-kills", "kill-feed")])), False)
    loud = montage | (nz(F.col("c_audio"), 0.0) >= 60) | nz(F.array_contains("c_flags", "hype-moment"), False)
    share = nz(score, 0.0) / F.when(nz(top, 0.0) == 0, 1.0).otherwise(top)
    return ((quality >= QUALITY) | loud) & ((nz(confidence, 0) >= STRONG_CONF) | (share >= STRONG_SHARE) | loud)


def quality_selection(picks: DataFrame, candidates: DataFrame, duration: Column, shooter: bool = False) -> DataFrame:
    """Three to five highlights per recording from ranked picks and the candidate pool.

    ``picks``: (video_id, candidate_id, start_time, end_time, quality, confidence, strong, rank); ``candidates``:
    (video_id, list_index, start_time, end_time, local_score, text_score, confidence, montage). Both are pools of
    bounded size per recording (at most 12 or so rows), so the five passes run as one fold over one array of offers:
    each pass offers rows in its own order and the fold keeps what its pass allows.
    """
    offer = lambda df, phase, order, idx: df.select(
        *KEY, F.struct(F.lit(phase).alias("phase"), order.alias("rank"), F.col(idx).cast("int").alias("idx"), F.col("start_time").alias("start"), F.col("end_time").alias("stop"),
                       nz(F.col("quality"), 0.0).alias("quality"), nz(F.col("confidence"), 0).cast("double").alias("conf"), nz(F.col("strong"), False).alias("strong")).alias("o"))
    ranked = picks.withColumn("rank", F.col("rank").cast("double"))
    pool = candidates.withColumns({"quality": F.col("text_score"), "strong": F.lit(True)})
    parts = [offer(ranked, 1, F.col("rank"), "candidate_id")]
    if shooter:
        parts.append(offer(pool.filter("montage"), 0, -F.col("local_score"), "list_index"))
        parts.append(offer(pool.filter("montage"), 3, -F.col("local_score"), "list_index"))
    else:
        parts += [offer(ranked, 2, F.col("rank"), "candidate_id"), offer(pool, 3, -F.col("local_score"), "list_index"), offer(pool, 4, -F.col("local_score"), "list_index")]
    offers = parts[0]
    for p in parts[1:]:
        offers = offers.unionByName(p)
    packed = offers.groupBy(*KEY).agg(F.sort_array(F.collect_list("o")).alias("_o")).join(duration if isinstance(duration, DataFrame) else offers.select(*KEY).distinct().withColumn("duration", duration), KEY)
    packed = packed.withColumn("_gap", F.when(F.col("duration") > LONG_VIDEO, SPREAD_LONG).otherwise(SPREAD_SHORT))
    kind = "array<struct<phase:int,rank:double,idx:int,start:double,stop:double,quality:double,conf:double,strong:boolean>>"

    def walk(kept: Column, o: Column) -> Column:
        n = F.size(kept)
        near = F.exists(kept, lambda k: (overlap_share(k["start"], k["stop"], o["start"], o["stop"]) > 0.35) | (F.abs(k["start"] - o["start"]) < F.col("_gap")))
        seen = F.exists(kept, lambda k: k["idx"] == o["idx"])
        bucket = F.floor(o["start"] / 30)
        crowded = (F.col("duration") > LONG_VIDEO) & (n >= LEAST_CLIPS) & F.exists(kept, lambda k: F.abs(F.floor(k["start"] / 30) - bucket) < 3)
        text_ok = F.lit(True) if shooter else o["quality"] >= QUALITY
        take = (
            F.when(o["phase"] == 0, n < MOST_CLIPS).when(o["phase"] == 1, (n < MOST_CLIPS) & o["strong"] & ~seen)
            .when(o["phase"] == 2, (n < LEAST_CLIPS) & (o["quality"] >= QUALITY) & (o["conf"] >= LEAST_CONF) & ~seen)
            .when(o["phase"] == 3, (n < MOST_CLIPS) & ~crowded & text_ok & ((o["conf"] >= LEAST_CONF) | (n < LEAST_CLIPS)))
            .otherwise(n < LEAST_CLIPS))
        return F.when(take & ~near, F.concat(kept, F.array(o))).otherwise(kept)

    chosen = packed.select(*KEY, F.posexplode(F.aggregate("_o", F.expr(f"cast(array() as {kind})"), walk)).alias("place", "k"))
    return chosen.select(*KEY, (F.col("place") + 1).alias("place"), F.col("k.phase").alias("phase"), F.col("k.idx").alias("list_index"), F.col("k.start").alias("start_time"), F.col("k.stop").alias("end_time"), F.col("k.conf").alias("confidence"))


def montages_share(a: Column, b: Column, gap: float = 3.0) -> Column:
    """Whether two lists of kill times have a pair closer than ``gap``; montage lists hold a handful of times."""
    return F.exists(a, lambda x: F.exists(b, lambda y: F.abs(x - y) < gap))


def shooter_selection(montages: DataFrame, long_video: Column | bool = True, focus: Column | None = None, most: int = SHOOTER_CLIPS) -> DataFrame:
    """Montages by kills, length, event backing and score; chains sharing a kill or montages too close drop out.

    Rows carry (start_time, end_time, kills, output_duration, backed, chain, local_score, kill_times, seq).
    """
    score = nz(F.col("local_score"), 0.0)
    if focus is not None:
        score = score + F.when(F.abs(F.col("start_time") - focus) < FOCUS_RADIUS, 40).otherwise(0)
    chains = montages.groupBy(*KEY).agg(F.count_if("chain").alias("_c"))
    pool = montages.join(chains, KEY).filter((F.col("_c") < 2) | F.col("chain")).drop("_c")
    gap = F.when(long_video if isinstance(long_video, Column) else F.lit(long_video), SPREAD_LONG).otherwise(SPREAD_SHORT)
    pool = pool.withColumn("_gap", gap)

    def close(a: Column, b: Column) -> Column:
        plain = (overlap_share(a["start_time"], a["end_time"], b["start_time"], b["end_time"]) > 0.35) | (F.abs(a["start_time"] - b["start_time"]) < b["_gap"])
        return F.when(a["chain"] & b["chain"], montages_share(a["kill_times"], b["kill_times"])).otherwise(plain)

    order = [-F.col("kills"), -nz(F.col("output_duration"), 0.0), -F.col("backed").cast("int"), -score, F.col("seq")]
    reach = (F.col("start_time") - 10, F.greatest(F.col("end_time"), F.col("start_time") + F.col("_gap")) + 10)
    return greedy_rank(pool, KEY, order, close, most, span=reach).drop("_gap")


def viral_score(kills: Column, mean_conf: Column, backed: Column) -> Column:
    base = F.when(backed, F.lit(4.5) + mean_conf * 2.5).otherwise(F.lit(4.0) + mean_conf * 2)
    return clamp(half_up(base + kills * 0.2), 4, 8)


def drop_overlapping_audio(audio: DataFrame, events: DataFrame, least: int = 5) -> DataFrame:
    """Audio montages kept beside event montages: none where a recording has five event montages, else those that
    neither overlap nor start close to one. The anti-join runs on time bins."""
    counts = events.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    open_ = audio.join(counts.filter(F.col("_n") >= least), KEY, "left_anti")
    a = open_.select(*KEY, "seq", F.col("start_time").alias("_as"), F.col("end_time").alias("_ae"))
    e = events.select(*KEY, F.col("start_time").alias("_es"), F.col("end_time").alias("_ee"))
    over = overlap_join(a, e, KEY, (F.col("_as"), F.col("_ae")), (F.col("_es"), F.col("_ee"))).filter(overlap_share(F.col("_as"), F.col("_ae"), F.col("_es"), F.col("_ee")) > POOL_OVERLAP)
    near = band_join(a, e, KEY, F.col("_as"), F.col("_es"), POOL_GAP, POOL_GAP).filter(F.abs(F.col("_as") - F.col("_es")) < POOL_GAP)
    hit = over.select(*KEY, "seq").unionByName(near.select(*KEY, "seq")).distinct()
    return open_.join(hit, [*KEY, "seq"], "left_anti")


def sharing_pairs(montages: DataFrame, gap: float = 3.0) -> DataFrame:
    """Pairs of montages that use the same kill, from a band self-join of their kill times."""
    times = montages.select(*KEY, "seq", F.explode("kill_times").alias("_t"))
    other = times.select(*KEY, F.col("seq").alias("other"), F.col("_t").alias("_u"))
    pairs = band_join(times, other, KEY, F.col("_t"), F.col("_u"), gap, gap)
    return pairs.filter((F.col("seq") < F.col("other")) & (F.abs(F.col("_t") - F.col("_u")) < gap)).select(*KEY, "seq", "other").distinct()


def boost_signals(candidates: DataFrame, signals: DataFrame, most: int = 15) -> DataFrame:
    """Add measured sound and picture points to the first candidates, derive flags and rank everything again."""
    rows = candidates.join(signals, [*KEY, "list_index"], "left")
    hit = F.col("list_index") <= most
    add = F.when(hit, nz(F.col("audio_points"), 0.0) + nz(F.col("visual_points"), 0.0)).otherwise(0.0)
    new = F.array_compact(F.array(F.when(hit & (F.col("spike") >= 8), "audio-spike"), F.when(hit & (F.col("burst") >= 5), "audio-burst"), F.when(hit & (F.col("visual_points") >= 6), "visual-event")))
    rows = rows.withColumns({"local_score": half_up(F.col("local_score") + add).cast("double"), "flags": F.array_union("flags", new), "_old": F.col("list_index")})
    order = W.partitionBy(*KEY).orderBy(F.desc("local_score"), "_old")
    rows = rows.withColumns({"list_index": F.row_number().over(order), "_top": F.first("local_score").over(order)})
    return rows.withColumn("confidence", relative_confidence(F.col("local_score"), F.col("_top"))).drop("_top", "_old", "audio_points", "visual_points", "spike", "burst")


def candidate_flags(category: Column | None = None) -> Column:
    """Flags of a scored window."""
    c = lambda cond, name: F.when(nz(cond, False), name)
    label = F.col("arc")
    base = [
        c((category != "generic"), F.concat(F.lit("cat:"), category)) if category is not None else F.lit(None).cast("string"),
        F.when(~label.isin("none", "flat"), label), c(F.col("peak") >= 12, "high-peak"), c(nz(F.col("dead_penalty"), 0.0) < 3, "tight-mid"),
        c(F.col("structure_label") == "peak+context+reaction", "multi-signal"), c(F.col("mono_penalty") >= 12, "lore-risk"), c(F.col("delta") >= 12, "reaction-arc"),
        F.when(nz(F.col("hype"), False), "hype-moment").when(nz(F.col("max_delta"), 0.0) >= 6, "audio-peak"), c(F.col("hud_kills") >= 2, "hud-kills"),
        c((F.col("hud_kills") >= 1) & (F.col("hud_boost") >= 25), "kill-feed")]
    return F.array_distinct(F.array_compact(F.array(*base)))


def refine_weak(highlights: DataFrame, refined: DataFrame) -> DataFrame:
    """Weak clips (confidence below 75) get the better window and a confidence gain; others stay.

    ``refined``: (video_id, seq, r_start, r_end, r_peak, before, after, first_speech).
    """
    rows = highlights.join(refined, [*KEY, "seq"], "left")
    weak = nz(F.col("confidence") < WEAK_CONF, False) & ~nz(F.col("montage"), False)
    better = nz(F.col("after") > F.col("before") + 2, False)
    apply = weak & F.col("after").isNotNull() & (better | (F.col("confidence") < STRONG_CONF) | (F.col("after") >= F.col("before") - 1))
    start = F.when(apply, F.col("r_start")).otherwise(F.col("start_time"))
    lead = F.greatest(start, F.col("first_speech") - 0.6)
    cut = weak & nz(lead > start + 1.2, False)
    gain = half_up(F.greatest(F.lit(0.0), nz(F.col("after") - F.col("before"), 0.0)) * 1.5) + F.when(apply & better, 4).otherwise(0)
    return rows.select(
        *KEY, "seq", F.when(cut, lead).otherwise(start).alias("start_time"), F.when(apply, F.col("r_end")).otherwise(F.col("end_time")).alias("end_time"),
        F.when(apply, F.col("r_peak")).otherwise(F.col("hook_peak")).alias("hook_peak"),
        F.when(weak, F.least(F.lit(84.0), F.greatest(F.col("confidence"), F.col("confidence") + gain))).otherwise(F.col("confidence")).alias("confidence"), weak.alias("boosted"), cut.alias("dead_air"))


def zoom_moments(zooms: Column, start: Column, end: Column, peak: Column) -> Column:
    """Zoom times inside the clip, with the peak and an early pulse, sorted."""
    extra = F.array_compact(F.array(peak, start + F.least(F.lit(2.5), (end - start) * 0.12)))
    return F.array_sort(F.filter(F.array_distinct(F.concat(nz(zooms, F.expr("cast(array() as array<double>)")), extra)), lambda z: (z >= start) & (z <= end)))


def highlight_reason(reason: Column, lines: list[Column], title: Column, start: Column) -> Column:
    """A reason for every highlight: its own, a line of the clip, the title, or the time stamp."""
    own = F.trim(nz(reason, ""))
    found = F.get(F.filter(F.transform(F.array(*lines), lambda s: F.trim(nz(s, ""))), lambda s: F.length(s) >= 6), F.lit(0))
    name = F.trim(nz(title, ""))
    s = nz(start, 0.0)
    stamp = F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad(F.floor(s % 60).cast("string"), 2, "0"))
    return (F.when(F.length(own) >= 10, F.left(own, F.lit(280))).when(found.isNotNull(), F.when(F.length(found) > 260, F.concat(F.left(found, F.lit(257)), F.lit("…"))).otherwise(found))
            .when((name != "") & (name != "Top moment"), F.concat(F.lit("Strong moment: “"), name, F.lit("” — works well as a short.")))
            .otherwise(F.concat(F.lit("Engaging segment from "), stamp, F.lit(" with clear payoff."))))


def display_duration(measured: Column, output: Column, start: Column, end: Column) -> Column:
    return F.when(nz(measured > 0.5, False), measured).when(nz(output > 0.5, False), output).otherwise(F.greatest(F.lit(1.0), nz(end, 0.0) - nz(start, 0.0)))


def clip_duration(montage: Column, measured: Column, output: Column, start: Column, end: Column, cold_open: Column, teaser: Column) -> Column:
    """Length of a rendered clip: measured where plausible, else output, span and teaser."""
    main = F.greatest(F.lit(1.0), end - start)
    ok = nz(measured > 0.5, False)
    cut = F.when(ok, measured).otherwise(nz(output, 0.0))
    plain = F.when(ok & (F.abs(measured - main) <= 0.35), measured).otherwise(main)
    return F.when(montage, cut).when(~cold_open, plain).when(ok, measured).otherwise(main + teaser)


def round_span(start: Column, end: Column) -> tuple[Column, Column]:
    return tenth(start), tenth(end)
