"""Transcript lines, candidate windows and their scores."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import text as tx
from tideline.functions.numeric import half_up, nz, tenth
from tideline.functions.profiles import PROFILES
from tideline.operators.ordered import ordered, top_per_key
from tideline.operators.ranges import DEFAULT_BIN_SEC, band_join, overlap_join, reach_join
from tideline.session import settle

KEY = ["video_id"]
WIN = ["video_id", "wid"]

# Clip limits, pool sizes and window search, in seconds and rows.
MIN_CLIP, MAX_CLIP, TARGET_CLIP = 12.0, 45.0, 28.0
MOST_RAW, POOL, LEAST_POOL, PER_THIRD = 28, 12, 8, 6
SHIFT_STEP, SHIFT_MOST = 2, 8
# A window without lines only has the penalty for missing interaction.
EMPTY_WINDOW = -12.0
PRE_PEAK, POST_PEAK, TAIL_SCORE, TAIL_BREAK = 18.0, 3.0, 4.0, 2.5
# No window around a peak is longer: the longest clip of a profile, and what rounding may add. The column names the tile of a window.
REACH, REACH_TILE = max(float(p["max_clip"]) for p in PROFILES.values()) + 1.0, "_reach_tile"


def scored_lines(lines: DataFrame, category: Column | None = None, tile: float = 3600.0) -> DataFrame:
    """Lines ``(video_id, seq, text, start, end)`` with pause, score and the flags the window scores need.

    All text work happens here, once per line and before lines are put in order, so that text moves only where a caller reads it.
    """
    rows = lines.withColumns({"text": F.trim("text"), "duration": F.greatest(F.lit(0.3), F.col("end") - F.col("start"))})
    rows = tx.measure_lines(rows)
    flags = tx.line_flags()
    rows = rows.withColumns({"_said": F.col("text") != "", "_worth": tx.line_words(category), "_pace": tx.line_pace(F.col("duration")), **flags}).drop(*tx.HELPERS)
    rows = ordered(rows, KEY, "seq", tile=4096, lag={"_prev": "end"}).filter("_said")
    rows = rows.withColumn("gap", F.greatest(F.lit(0.0), F.col("start") - nz(F.col("_prev"), F.col("start"))))
    rows = rows.withColumn("score", tx.score_with_pause(F.col("_worth"), F.col("_pace"), F.col("gap")))
    return rows.select(*dict.fromkeys([*lines.columns, "gap", "duration", "words", "clean", "score", *flags]))


LINE = ("seq", "start", "end", "score", "words", "mark", "reaction", "monologue", "setup", "negative", "kill_talk", "boring_talk")


def window_lines(lines: DataFrame, windows: DataFrame) -> DataFrame:
    """Lines that meet each window ``(video_id, wid, w_start, w_end)``; flags only, no text."""
    slim = lines.select(*KEY, *LINE)
    return overlap_join(slim, windows, KEY, (F.col("start"), F.col("end")), (F.col("w_start"), F.col("w_end")))


def window_metrics(lines: DataFrame, windows: DataFrame) -> DataFrame:
    """Totals, density, arc, structure and dead time per window. One shuffle of the pairs on (video_id, wid).

    Windows of at most ``reach`` seconds may carry the tile their start lies in (:func:`in_tiles`). Lines then come to the tiles, pairs
    are not shuffled, and a window without lines has a row of nulls."""
    tiled = REACH_TILE in windows.columns
    pairs = reach_join(windows, lines.select(*KEY, *LINE), KEY, (F.col("w_start"), F.col("w_end")), (F.col("start"), F.col("end")), REACH_TILE, REACH) if tiled else window_lines(lines, windows)
    at = [*KEY, REACH_TILE, "wid"] if tiled else WIN
    whole = W.partitionBy(*at)
    order = whole.orderBy("start", "seq")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    span = F.col("w_end") - F.col("w_start")
    inner = (F.col("end") >= F.col("w_start") + span * 0.25) & (F.col("start") <= F.col("w_start") + span * 0.75)
    pairs = pairs.withColumn("_inner", inner).withColumns({
        "_gap": F.col("start") - F.lag("end").over(order),
        "_dead": F.when(F.col("_inner"), F.col("start") - F.last(F.when(F.col("_inner"), F.col("end")), True).over(before)),
        "_peak": F.max(F.struct("score", -F.col("start"), -F.col("seq"))).over(whole)})
    pairs = pairs.withColumn("_break", F.col("_gap").isNull() | (F.col("_gap") > 1.2))
    pairs = pairs.withColumns({"_run0": F.last(F.when(F.col("_break"), F.col("start")), True).over(upto), "_next": F.lead("_break").over(order),
                               "_at": -F.col("_peak.col2")})
    first = F.col("start") < F.col("w_start") + span * 0.5
    ahead = (F.col("start") < F.col("_at") - 0.2) & (F.col("start") >= F.col("w_start"))
    later = (F.col("start") > F.col("_at") + 0.2) & (F.col("start") <= F.col("w_end"))
    turn = (F.col("_gap") >= 0.4) & (F.col("_gap") <= 6)
    zero = F.lit(0.0)
    total = lambda cond, value="score": nz(F.sum(F.when(cond, F.col(value))), 0.0)
    out = pairs.groupBy(*at, "w_start", "w_end").agg(
        F.count("start" if tiled else F.lit(1)).alias("n_lines"), F.sum("score").alias("total"), F.greatest(zero, F.max("score")).alias("peak"), F.max("score").alias("peak_score"),
        F.max("_at").alias("peak_at"),
        F.sum("words").alias("_words"), F.sum(F.greatest(F.lit(0.3), F.col("end") - F.col("start"))).alias("_speech"),
        F.sum(F.when((F.col("words") <= 10) & F.col("reaction"), 1.0).otherwise(0.0) + F.when((F.col("score") >= 6) & (F.col("words") <= 14), 0.5).otherwise(0.0)).alias("_reactions"),
        F.count_if("monologue").alias("monologue_lines"), F.count_if(turn).alias("interaction_turns"), F.avg(F.when(turn, F.col("_gap"))).alias("_avg_gap"),
        F.greatest(zero, F.max(F.when(nz(F.col("_next"), True), F.col("end") - F.col("_run0")))).alias("longest_run"),
        nz(F.sum(F.when(F.col("_dead") > 4, F.least(F.lit(15.0), (F.col("_dead") - 4) * 3))), 0.0).alias("dead_penalty"),
        F.count_if(ahead).alias("_before"), total(ahead).alias("context_before"),
        total(later & ((F.col("score") >= 4) | F.col("reaction"))).alias("reaction_after"), F.max(later & (F.col("score") >= 8)).alias("_strong_after"),
        F.count_if(first).alias("_n1"), total(first).alias("_t1"), total(~first).alias("_t2"), F.greatest(zero, nz(F.max(F.when(~first, F.col("score"))), 0.0)).alias("_p2"),
        F.max(first & F.col("setup")).alias("_setup"), F.sum("negative").alias("negative_hits"), F.count_if("kill_talk").alias("kill_lines"),
        F.count_if("boring_talk").alias("boring_lines"))
    avg1 = F.when(F.col("_n1") > 0, F.col("_t1") / F.greatest(F.col("_n1"), F.lit(1))).otherwise(0.0)
    width = F.col("w_end") - F.col("w_start")
    out = out.withColumns({
        "_a1": avg1, "density": F.col("total") / F.greatest(width / 10, F.lit(1.0)),
        "speech_rate": half_up(F.col("_words") / F.greatest(F.col("_speech"), F.lit(1.0)) * 60), "reaction_lines": half_up(F.col("_reactions")),
        "avg_gap": nz(F.col("_avg_gap"), 0.0), "speech_coverage": F.col("_speech") / F.greatest(F.lit(1.0), width)})
    out = out.withColumns(_arc()).withColumns(_structure()).select(
        *WIN, "w_start", "w_end", "n_lines", "total", "peak", "peak_score", "peak_at", "density", "speech_rate", "reaction_lines", "monologue_lines",
        "interaction_turns", "avg_gap", "longest_run", "speech_coverage", "arc_score", "arc", "context_before", "reaction_after", "structure_bonus",
        "structure_label", "_mono_hits", "low_interaction", "dead_penalty", "negative_hits", "kill_lines", "boring_lines")
    if not tiled:
        return out
    found, names = F.col("n_lines") > 0, [*WIN, "w_start", "w_end"]
    return out.select(*names, *[F.when(found, F.col(c)).alias(c) for c in out.columns if c not in names])


def in_tiles(windows: DataFrame) -> DataFrame:
    """``windows`` of at most ``REACH`` seconds, dealt by recording and the tile in which they begin."""
    return windows.withColumn(REACH_TILE, F.floor(F.col("w_start") / F.lit(DEFAULT_BIN_SEC))).repartition(*KEY, REACH_TILE)


def _arc() -> dict[str, Column]:
    strong = (F.col("_p2") >= 8) & (F.col("_p2") >= F.col("_a1") * 0.7)
    setup = F.col("_setup") & (F.col("_p2") >= 6)
    weak = (F.col("_a1") > 4) & (F.col("_t2") < F.col("_t1") * 0.4)
    return {
        "arc_score": F.when(strong, 12).otherwise(0) + F.when(setup, 6).otherwise(0) - F.when(weak, 10).otherwise(0),
        "arc": F.when(weak, "weak-tail").when(setup | (strong & F.col("_setup")), "setup→payoff").when(strong, "payoff").otherwise("flat")}


def _structure() -> dict[str, Column]:
    peak = F.col("peak_score") >= 8
    context = (F.col("_before") >= 1) & (F.col("context_before") >= 3)
    reaction = (F.col("reaction_after") >= 6) | F.col("_strong_after")
    strong = (F.col("_p2") >= 8) & (F.col("_p2") >= F.col("_a1") * 0.7)
    weak = (F.col("_a1") > 4) & (F.col("_p2") < F.col("_a1") * 0.5)
    bonus = (F.when(peak & context & reaction, 18).when(peak & (context | reaction), 10).when(peak, 4).otherwise(0)
             + F.when(strong, 8).otherwise(0) + F.when(F.col("_setup") & (F.col("_p2") >= 6), 4).otherwise(0) - F.when(weak, 8).otherwise(0)
             + F.when((F.col("speech_rate") >= 170) & (F.col("reaction_lines") >= 1), 5).otherwise(0) + F.when(F.col("reaction_lines") >= 3, 6).otherwise(0))
    label = (F.when(weak, "weak-tail").when(strong & F.col("_setup"), "setup→payoff").when(peak & context & reaction, "peak+context+reaction")
             .when(peak & context, "peak+context").when(peak & reaction, "peak+reaction").when(peak, "peak-only").otherwise("flat"))
    mono = F.array(
        F.when(F.col("monologue_lines") >= 2, 12.0 + F.col("monologue_lines") * 4).otherwise(0.0),
        F.when((F.col("longest_run") >= 18) & (F.col("reaction_lines") < 2), 14.0).otherwise(0.0),
        F.when((F.col("speech_coverage") > 0.82) & (F.col("interaction_turns") < 2), 10.0).otherwise(0.0))
    low = (F.when((F.col("interaction_turns") < 1) & (F.col("reaction_lines") < 1), 12)
           .when((F.col("interaction_turns") < 2) & (F.col("monologue_lines") >= 1), 6).otherwise(0))
    return {"structure_bonus": bonus, "structure_label": label, "_mono_hits": mono, "low_interaction": low}


def monologue_penalty(category: Column | None = None) -> Column:
    weight = tx.profile_value(category, "monologue_penalty")
    return half_up(F.get("_mono_hits", F.lit(0)) * weight) + half_up(F.get("_mono_hits", F.lit(1)) * weight) + half_up(F.get("_mono_hits", F.lit(2)) * weight)


def transcript_delta(category: Column | None = None) -> Column:
    return half_up(F.col("structure_bonus") * tx.profile_value(category, "structure_weight") - monologue_penalty(category) - F.col("low_interaction"))


def composite(category: Column | None = None, audio: Column | None = None, hud: Column | None = None, boring: Column | None = None) -> Column:
    """Window score from the metrics; audio, event and boredom terms are added where known."""
    none = F.lit(0.0)
    return (F.col("total") + F.col("peak") * 3 + F.col("density") * 4 + F.col("arc_score") * 0.6 + transcript_delta(category)
            + (none if audio is None else audio) + (none if hud is None else hud) - F.col("dead_penalty") - (none if boring is None else boring)
            - F.col("negative_hits") * 20)


def boring_penalty(hud_kills: Column, max_delta: Column) -> Column:
    """For shooter recordings: holding talk without kills, or no sign of action at all."""
    talk_only = (F.col("boring_lines") >= 1) & (F.col("kill_lines") == 0)
    quiet = (hud_kills == 0) & (F.col("kill_lines") == 0) & (max_delta < 7)
    return F.when(talk_only, 120.0).when(quiet, 80.0).otherwise(0.0)


def audio_delta(lines: DataFrame, stats: DataFrame, weight: Column | float = 1.0) -> DataFrame:
    """Loudness term per window: +50 when a loud peak has a reaction line close by, -25 for flat sound."""
    from tideline.plans.loudness import window_score

    loud = stats.filter("max_delta >= 5").select(*WIN, "w_start", "w_end", "peak_time")
    talk = lines.filter((F.col("score") >= 8) | F.col("mark")).select(*KEY, "seq", "start", "end")
    near = overlap_join(talk, loud, KEY, (F.col("start"), F.col("end")), (F.col("peak_time") - 6, F.col("peak_time") + 6))
    hype = near.select(*WIN).distinct().withColumn("hype", F.lit(True))
    out = stats.join(hype, WIN, "left").withColumn("hype", nz(F.col("hype"), False))
    flat = (F.col("max_delta") < 2) & (F.col("avg_delta") < 0.5)
    return out.withColumn("audio_delta", window_score(F.col("max_delta"), F.col("avg_delta"), weight) + F.when(F.col("hype"), 50).otherwise(0) - F.when(flat, 25).otherwise(0))


def event_boost(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Kills with confidence >= 0.5 within half a second of each window and the boost of at most 120."""
    sure = events.filter(F.col("confidence") >= 0.5).select(*KEY, F.col("time").alias("_t"), "confidence")
    pairs = overlap_join(sure, windows, KEY, (F.col("_t"), F.col("_t")), (F.col("w_start") - 0.5, F.col("w_end") + 0.5))
    counts = pairs.groupBy(*WIN).agg(F.count(F.lit(1)).alias("kills"), F.count_if(F.col("confidence") >= 0.65).alias("high"))
    out = windows.join(counts, WIN, "left").withColumn("kills", nz(F.col("kills"), F.lit(0).cast("bigint")))
    return out.withColumn("boost", F.when(F.col("kills") > 0, F.least(F.lit(120.0), F.col("kills") * 28.0 + F.col("high") * 12.0)).otherwise(0.0)).drop("high")


def window_texts(lines: DataFrame, windows: DataFrame) -> DataFrame:
    """Texts of each window ``(video_id, wid, w_start, w_end, at)``: ``setup_line`` (the two lines before the peak line, else the first one),
    ``peak_line`` (the first line within 1.5 s of ``at``, else the best one), ``tail_line`` (the two after it), 72 characters each, and
    ``excerpt`` (the first six lines worth more than 2, 220 characters).

    Lines are ranked by time and score alone; only the dozen that a window shows are joined with their text."""
    slim = lines.select(*KEY, "seq", F.col("start").alias("_s"), F.col("end").alias("_e"), "score")
    pairs = overlap_join(slim, windows.select(*WIN, "w_start", "w_end", "at"), KEY, (F.col("_s"), F.col("_e")), (F.col("w_start"), F.col("w_end")))
    whole = W.partitionBy(*WIN)
    place, near = F.struct("_s", "seq"), F.abs(F.col("_s") - F.col("at")) < 1.5
    best = F.max_by(place, F.struct("score", -F.col("_s"), -F.col("seq"))).over(whole)
    pairs = pairs.withColumn("_pk", F.coalesce(F.min(F.when(near, place)).over(whole), best))
    part = F.when(F.col("_s") < F.col("_pk._s") - 0.3, "before").when(F.col("_s") > F.col("_pk._s") + 0.3, "after").otherwise("beside")
    pairs = pairs.withColumn("_part", part).withColumn("_good", F.col("score") > 2)
    rank = lambda keys, order: F.row_number().over(W.partitionBy(*WIN, *keys).orderBy(*order))
    pairs = pairs.withColumns({
        "_first": rank([], ["_s", "seq"]), "_back": rank(["_part"], [F.desc("_s"), F.desc("seq")]), "_on": rank(["_part"], ["_s", "seq"]), "_nth": rank(["_good"], ["seq"])})
    role = F.array_compact(F.array(
        F.when((F.col("_part") == "before") & (F.col("_back") <= 2), "setup"), F.when(F.col("_first") == 1, "first"), F.when(place == F.col("_pk"), "peak"),
        F.when((F.col("_part") == "after") & (F.col("_on") <= 2), "tail"), F.when(F.col("_good") & (F.col("_nth") <= 6), "excerpt")))
    shown = pairs.select(*WIN, "seq", "_s", F.explode(role).alias("_role")).join(lines.select(*KEY, "seq", "text"), [*KEY, "seq"])
    said = lambda name, *order: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_role") == name, F.struct(*order, "text")))), lambda x: x["text"]), " ")
    out = shown.groupBy(*WIN).agg(*[said(name, "_s", "seq").alias(f"_{name}") for name in ("setup", "first", "peak", "tail")], said("excerpt", "seq").alias("_excerpt"))
    cut = lambda text, n: F.left(F.coalesce(text, F.lit("")), F.lit(n))
    texts = out.select(*WIN, cut(F.when(F.col("_setup") == "", F.col("_first")).otherwise(F.col("_setup")), 72).alias("setup_line"), cut(F.col("_peak"), 72).alias("peak_line"), cut(F.col("_tail"), 72).alias("tail_line"), cut(F.col("_excerpt"), 220).alias("excerpt"))
    return windows.join(texts, WIN, "left").withColumns({n: nz(F.col(n), "") for n in ("setup_line", "peak_line", "tail_line", "excerpt")})


def full_scores(metrics: DataFrame, lines: DataFrame, events: DataFrame, scan: DataFrame, category: Column | None = None, shooter: bool = False) -> DataFrame:
    """``metrics`` with ``audio``, ``hud_kills``, ``hud``, ``boring``, ``hype`` and ``composite``: all terms of a window's score.

    A recording without loudness or without events has nothing for them. In shooter recordings loud windows without a kill lose 35 where
    events are known, and talk about holding and windows without any sign of a fight are penalised."""
    from tideline.plans.loudness import window_stats

    spans = metrics.select(*WIN, "w_start", "w_end")
    heard = audio_delta(lines, window_stats(scan, spans), tx.profile_value(category, "audio_weight")).select(*WIN, "audio_delta", "max_delta", F.col("hype").alias("_hype"))
    seen = event_boost(events, spans).select(*WIN, F.col("kills").alias("hud_kills"), F.col("boost").alias("hud"))
    known = events.select(*KEY).distinct().withColumn("_known", F.lit(True))
    rows = metrics.join(heard, WIN, "left").join(seen, WIN).join(known, KEY, "left")
    sound, loudest = nz(F.col("audio_delta"), 0.0), nz(F.col("max_delta"), 0.0)
    alone = nz(F.col("_known"), False) & (F.col("hud_kills") == 0) & (sound > 40) & F.lit(shooter)
    rows = rows.withColumns({
        "audio": sound - F.when(alone, 35).otherwise(0), "boring": boring_penalty(F.col("hud_kills"), loudest) if shooter else F.lit(0.0), "hype": nz(F.col("_hype"), False) | (F.col("hud_kills") >= 2)})
    return rows.withColumn("composite", composite(category, F.col("audio"), F.col("hud"), F.col("boring"))).drop("audio_delta", "max_delta", "_hype", "_known")


def anchors(lines: DataFrame, chapters: DataFrame | None = None, peaks: DataFrame | None = None) -> DataFrame:
    """Four-second anchors scored by lines, chapter marks (+18) and loudness peaks (30 + 6 per dB)."""
    bucket = lambda c: (F.floor(F.col(c) / 4) * 4).cast("double")
    null_text, null_num = F.lit(None).cast("string"), F.lit(None).cast("double")
    parts = lines.select(*KEY, bucket("start").alias("bucket"), "score", null_text.alias("label"), F.lit(False).alias("loud"), F.lit(0).alias("kind"), null_num.alias("raw"))
    if chapters is not None:
        parts = parts.unionByName(chapters.select(*KEY, bucket("time").alias("bucket"), F.lit(18.0).alias("score"), "label", F.lit(False).alias("loud"), F.lit(1).alias("kind"),
                                                  F.col("time").cast("double").alias("raw")))
    if peaks is not None:
        parts = parts.unionByName(peaks.select(*KEY, bucket("time").alias("bucket"), (F.lit(30.0) + F.col("strength") * 6).alias("score"), null_text.alias("label"),
                                               F.lit(True).alias("loud"), F.lit(2).alias("kind"), F.col("time").alias("raw")))
    out = parts.groupBy(*KEY, "bucket").agg(
        F.round(F.sum("score"), 6).alias("score"), F.max_by("label", F.when(F.col("label").isNotNull(), F.col("raw"))).alias("chapter"), F.max("loud").alias("loud"),
        F.min("kind").alias("kind"), F.min(F.when(F.col("kind") == 1, F.col("raw"))).alias("_c"), F.min(F.when(F.col("kind") == 2, F.col("raw"))).alias("_p"))
    at = F.when(F.col("kind") == 0, F.col("bucket")).when(F.col("kind") == 1, F.col("_c")).otherwise(F.col("_p"))
    return out.withColumn("time", at).drop("_c", "_p")


def peak_line_near(points: DataFrame, lines: DataFrame, at: str, radius: float, out: str) -> DataFrame:
    """Start of the best-scored line starting within ``radius`` of each point ``(video_id, aid)``; the first wins ties."""
    pairs = band_join(points.select(*KEY, "aid", F.col(at).alias("_at")), lines.select(*KEY, "seq", "start", "score"), KEY, F.col("_at"), F.col("start"), radius, radius)
    best = pairs.groupBy(*KEY, "aid").agg(F.max_by("start", F.struct("score", -F.col("seq"))).alias(out))
    return points.join(best, [*KEY, "aid"], "left")


def dynamic_tail(points: DataFrame, lines: DataFrame, most: float = MAX_CLIP) -> DataFrame:
    """Per point with ``peak`` and ``video_end``: ``tail`` (end stretched over well-scored lines after the peak) and
    ``reach`` (end of the last line after it). Lines beyond the longest clip cannot matter: the end is capped there,
    so the fold sees at most a minute of lines."""
    far = most + TAIL_BREAK
    slim = points.select(*KEY, "aid", "peak", "video_end")
    src = lines.select(*KEY, F.col("seq").alias("_seq"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("score").alias("_sc"))
    pairs = overlap_join(src, slim, KEY, (F.col("_s"), F.col("_e")), (F.col("peak") - 0.3, F.col("peak") + far))
    pairs = pairs.filter((F.col("_e") > F.col("peak") - 0.3) & (F.col("_s") < F.col("video_end")) & (F.col("_s") <= F.col("peak") + far))
    got = pairs.groupBy(*KEY, "aid").agg(
        F.sort_array(F.collect_list(F.struct("_s", "_seq", "_e", "_sc"))).alias("_ls"),
        F.max(F.when(F.col("_s") >= F.col("peak") - 0.25, F.col("_e"))).alias("_reach"))
    last = lines.groupBy(*KEY).agg(F.max("start").alias("_last"))
    out = points.join(got, [*KEY, "aid"], "left").join(last, KEY, "left")
    begin = F.struct(F.least(F.col("video_end"), F.col("peak") + POST_PEAK).alias("end"), F.lit(True).alias("open"))

    def stretch(acc: Column, x: Column) -> Column:
        stop = ~acc["open"] | (x["_s"] > acc["end"] + TAIL_BREAK)
        longer = F.least(F.col("video_end"), F.greatest(acc["end"], x["_e"] + 0.4))
        return F.struct(F.when(~stop & (x["_sc"] >= TAIL_SCORE), longer).otherwise(acc["end"]).alias("end"), (~stop).alias("open"))

    tail = F.aggregate(nz(F.col("_ls"), F.expr("cast(array() as array<struct<_s:double,_seq:int,_e:double,_sc:double>>)")), begin, stretch)["end"]
    beyond = (F.col("_last") > F.col("peak") + far) & (F.col("_last") < F.col("video_end"))
    return out.withColumns({"tail": tail, "reach": F.when(beyond, F.col("video_end")).otherwise(F.col("_reach"))}).drop("_ls", "_reach", "_last")


def dynamic_end(start: Column, low: Column | float, high: Column | float) -> Column:
    """Clip end for a start, from ``tail`` and ``reach``."""
    end = F.least(F.col("video_end"), F.greatest(F.col("tail"), nz(F.col("reach") + 0.35, F.col("tail"))))
    limit = F.greatest(start + low, F.col("video_end"))
    end = F.least(limit, F.greatest(end, start + low))
    return F.when(end - start > high, start + high).otherwise(end)


def shifted_windows(points: DataFrame, low: Column | float = MIN_CLIP, high: Column | float = MAX_CLIP) -> DataFrame:
    """The base window around each peak and its eight shifted variants; ``pos`` orders them, the base first."""
    lo, hi = (c if isinstance(c, Column) else F.lit(c) for c in (low, high))
    start0 = F.greatest(F.lit(0.0), F.col("peak") - PRE_PEAK)
    base = points.withColumns({"_b0": tenth(start0), "_b1": tenth(dynamic_end(start0, lo, hi))})
    shifts = [0] + [s for s in range(-SHIFT_MOST, SHIFT_MOST + 1, SHIFT_STEP) if s]
    rows = base.withColumn("pos", F.explode(F.array(*[F.lit(i) for i in range(len(shifts))])))
    rows = rows.withColumn("_s", F.greatest(F.lit(0.0), F.col("_b0") + F.element_at(F.array(*[F.lit(float(s)) for s in shifts]), F.col("pos") + 1)))
    rows = rows.withColumn("_e", dynamic_end(F.col("_s"), lo, hi))
    over = F.col("_e") > F.col("video_end")
    rows = rows.withColumns({"_s": F.when(over, F.greatest(F.lit(0.0), F.col("video_end") - lo)).otherwise(F.col("_s")), "_e": F.least(F.col("_e"), F.col("video_end"))})
    rows = rows.withColumn("_s", F.when(F.col("_e") - F.col("_s") > hi, F.col("_e") - hi).otherwise(F.col("_s")))
    is_base = F.col("pos") == 0
    rows = rows.withColumns({"w_start": F.when(is_base, F.col("_b0")).otherwise(F.col("_s")), "w_end": F.when(is_base, F.col("_b1")).otherwise(F.col("_e"))})
    return rows.filter(is_base | (F.col("_e") - F.col("_s") >= lo)).drop("_b0", "_b1", "_s", "_e")


def worth_scoring(lines: DataFrame, points: DataFrame, category: Column | None = None, most: int = MOST_RAW) -> DataFrame:
    """Of anchors ranked by ``aid`` those that may be among the first ``most`` with a window of at least the profile's
    least length. Only an unshifted window can be shorter, so an anchor whose own one is long enough surely counts."""
    lo, hi = tx.profile_value(category, "min_clip"), tx.profile_value(category, "max_clip")
    own = shifted_windows(dynamic_tail(points.select(*KEY, "aid", "peak", "video_end"), lines, 45.0), lo, hi).filter("pos = 0")
    sure = own.select(*KEY, "aid", (F.col("w_end") - F.col("w_start") >= lo).cast("int").alias("_sure"))
    counted = ordered(sure, KEY, "aid", tile=4096, run_sum={"_count": "_sure"}).filter(F.col("_count") - F.col("_sure") < most)
    return points.join(counted.select(*KEY, "aid"), [*KEY, "aid"], "left_semi")


def best_windows(lines: DataFrame, points: DataFrame, category: Column | None = None) -> DataFrame:
    """``lines`` should be settled, they are read several times.

    For each point ``(video_id, aid, peak, video_end)`` the variant with the highest composite; earlier wins ties."""
    lo, hi = tx.profile_value(category, "min_clip"), tx.profile_value(category, "max_clip")
    # Anchors share peaks: what follows from the peak alone is worked out once per peak.
    spots = points.select(*KEY, F.struct("peak", "video_end").alias("aid"), "peak", "video_end").distinct()
    variants = settle(shifted_windows(dynamic_tail(spots, lines, 45.0), lo, hi).select(*KEY, "aid", "pos", "w_start", "w_end"))
    # Variants share ends, so a window is measured once, however many peaks have it; it names them, so nothing is joined with its measures.
    spans = in_tiles(variants).groupBy(*KEY, REACH_TILE, "w_start", "w_end").agg(F.collect_list(F.struct("aid", "pos")).alias("_of"))
    measured = window_metrics(lines, spans.withColumn("wid", F.struct("w_start", "w_end", "_of")).drop("_of")).withColumn("composite", nz(composite(category), EMPTY_WINDOW))
    scored = measured.withColumn("_of", F.explode("wid._of")).withColumns({"aid": F.col("_of.aid"), "pos": F.col("_of.pos")}).drop("wid", "_of")
    kept = [c for c in scored.columns if c not in (*KEY, "aid", "pos")]
    # One aggregate per column: those that nobody reads are neither shuffled nor compared.
    order = F.struct(F.round("composite", 9), -F.col("pos"))
    best = scored.groupBy(*KEY, "aid").agg(*[F.max_by(c, order).alias(c) for c in kept]).withColumnRenamed("aid", "_spot")
    best = best.select(*[F.col(k).alias(f"_k_{k}") for k in KEY], F.col("_spot").alias("_of"), *kept)
    same = F.col("_spot") == F.col("_of")
    for k in KEY:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return points.select(*KEY, "aid", F.struct("peak", "video_end").alias("_spot")).join(best, same).select(*KEY, "aid", *kept)


def top_anchors(lines: DataFrame, video_end: DataFrame, chapters: DataFrame | None = None, peaks: DataFrame | None = None, most: int | None = MOST_RAW) -> DataFrame:
    """The strongest anchors of each recording, or all of them in that order, with the peak their window is built around."""
    order = [F.desc("score"), F.col("kind"), F.col("time")]
    found = anchors(lines, chapters, peaks)
    ranked = top_per_key(found, KEY, order, most, rank="aid") if most is not None else found.withColumn("aid", F.row_number().over(W.partitionBy(*KEY).orderBy(*order)))
    near = settle(peak_line_near(ranked.join(video_end, KEY), lines, "time", 18.0, "_p18"))
    # Only points without a line close by look for one further away.
    far = peak_line_near(near.filter(F.col("_p18").isNull() & ~F.col("loud")), lines, "time", 45.0, "_p45")
    near = near.filter(F.col("_p18").isNotNull() | F.col("loud")).withColumn("_p45", F.lit(None).cast("double")).unionByName(far)
    peak = F.when(F.col("loud"), F.col("time")).otherwise(F.coalesce("_p18", "_p45", "time"))
    return near.withColumn("peak", peak).drop("_p18", "_p45")
