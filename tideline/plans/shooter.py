"""Highlights of shooter recordings from all signals: which moments a loud chain stands for, montages and windows around them,
the union of sources with its early stop, and the candidate pool without a transcript."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import events as ev
from tideline.functions.numeric import half_up, nz, tenth
from tideline.functions.patterns import BORING_WORDS, KILL_WORDS, PAYOFF_WORDS, has_lower, may_hit, tokens
from tideline.operators.cascade import first_qualifying, until_enough
from tideline.operators.greedy import greedy_rank
from tideline.operators.ordered import top_per_key
from tideline.operators.ranges import band_join, nearest_join, overlap_join
from tideline.plans import chains as c
from tideline.plans import kills as k
from tideline.plans import loudness as l
from tideline.plans import select as s
from tideline.plans import windows as w
from tideline.session import settle

KEY = ["video_id"]
CLUSTER = [*KEY, "cluster_at"]

# Seconds around a chain in which a source is asked, distances and limits.
FEED, FEED_WIDE, LINES, NEAR_FEED = (3.0, 8.0), (5.0, 18.0), (6.0, 18.0), (6.0, 14.0)
KEYWORDS_BEFORE, KEYWORDS_AFTER = 2.0, 4.0
PEAK_GAP, MARK_DIST, CONFIRM_DIST, LINE_DIST = 3.5, 2.5, 3.5, 8.0
LINE_STRENGTH, EVENT_STRENGTH = 11.0, 12.0
AUDIO_WEIGHT = 1.35
FEED_BONUS, MONTAGE_BONUS, MOST_FEED = 120, 280, 5
# Words that keep a line a kill moment although it also has a plant or payoff word.
STILL_KILL_BORING = r"\b(kill|frag|headshot|ace|clutch)\b"
STILL_KILL_PAYOFF = r"\b(kill|frag|headshot|ace)\b"

LONE = k.Timing(2.0, 8.0, 10.0, 8.0, 26.0)


def keyword_flags(lines: DataFrame) -> DataFrame:
    """Lines with ``kill``, ``payoff``, ``boring`` and ``moment``: whether a line by itself marks a kill.

    A line is split into words once; only lines that share a word with one of the patterns are looked at by patterns."""
    patterns = (KILL_WORDS, PAYOFF_WORDS, BORING_WORDS)
    low = F.lower(nz(F.col("text"), ""))
    rows = lines.withColumn("_low", low).withColumn("_may", may_hit(tokens(F.col("_low")), patterns))
    hit = lambda p: F.when(F.col("_may"), has_lower(F.col("_low"), p)).otherwise(False)
    rows = rows.withColumns({"kill": hit(KILL_WORDS), "payoff": hit(PAYOFF_WORDS), "boring": hit(BORING_WORDS)})
    still = lambda p: has_lower(F.col("_low"), p)
    moment = F.when(F.col("kill"), ~(F.col("boring") & ~still(STILL_KILL_BORING)) & ~(F.col("payoff") & ~still(STILL_KILL_PAYOFF))).otherwise(False)
    return rows.withColumn("moment", moment).drop("_low", "_may")


def keyword_windows(windows: DataFrame, flagged: DataFrame) -> DataFrame:
    """``windows`` (video_id, wid, w_start, w_end) with ``keyword_lines`` (kill lines from 2 s before to 4 s after) and ``moments``
    (sorted times of kill moments from 2 s before to 8 s after); one join serves both reaches."""
    marked = flagged.filter("kill").select(*KEY, F.col("start").alias("_at"), "moment")
    spans = windows.select(*KEY, "wid", F.col("w_start").alias("_ws"), F.col("w_end").alias("_we"))
    pairs = overlap_join(marked, spans, KEY, (F.col("_at"), F.col("_at")), (F.col("_ws") - KEYWORDS_BEFORE, F.col("_we") + 8.0))
    found = pairs.groupBy(*KEY, "wid").agg(
        F.count_if(F.col("_at") <= F.col("_we") + KEYWORDS_AFTER).alias("keyword_lines"), F.sort_array(F.collect_list(F.when(F.col("moment"), F.col("_at")))).alias("moments"))
    return windows.join(found, [*KEY, "wid"], "left").withColumns({
        "keyword_lines": nz(F.col("keyword_lines"), F.lit(0).cast("bigint")), "moments": nz(F.col("moments"), F.expr("cast(array() as array<double>)"))})


def kill_line_score(score: Column, kill: Column) -> Column:
    """Value of a line as a kill line: its score and 12 more where it has a kill word, else nothing."""
    return F.when(kill, score + 12).otherwise(0.0)


def until_gap(rows: DataFrame, keys: list[str], gap: float = k.BURST_GAP) -> DataFrame:
    """The rows of each key in time order up to the first gap above ``gap``."""
    timed = W.partitionBy(*keys).orderBy("time")
    late = nz((F.col("time") - F.lag("time").over(timed) > gap).cast("int"), 0)
    return rows.withColumn("_late", late).withColumn("_cut", F.max("_late").over(timed.rowsBetween(W.unboundedPreceding, 0))).filter("_cut = 0").drop("_late", "_cut")


def event_peaks(rows: DataFrame) -> DataFrame:
    """Events as peaks: twelve times their confidence strong."""
    return rows.select(*CLUSTER, "time", (nz(F.col("confidence"), 0.0) * EVENT_STRENGTH).alias("strength"), "roi", F.lit("event").alias("kind"))


def _rank(roi: Column, strength: Column) -> Column:
    return F.when(nz(roi, "").startswith("top_right"), 45.0).otherwise(0.0) + strength


def _apart_order() -> list[Column]:
    return [-_rank(F.col("roi"), F.col("strength")), F.col("time"), F.col("roi"), F.col("strength")]


def apart(rows: DataFrame, keys: list[str], gap: float = PEAK_GAP, most: int = k.MAX_KILLS) -> DataFrame:
    """The best peaks of each key that lie ``gap`` or more apart, feed regions and strength first, earlier ones on ties.

    For a handful of rows per key, which are folded as one array."""
    rest = [x for x in rows.columns if x not in keys]
    row = F.struct(*[x.alias(f"o{i}") for i, x in enumerate(_apart_order())], F.struct(*rest).alias("r"))
    kind = rows.select(F.array(F.struct(*rest)).alias("a")).schema["a"].dataType.simpleString()

    def walk(kept: Column, x: Column) -> Column:
        close = F.exists(kept, lambda y: F.abs(y["time"] - x["r"]["time"]) < gap)
        return F.when(close | (F.size(kept) >= most), kept).otherwise(F.concat(kept, F.array(x["r"])))

    packed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_a"))
    return packed.select(*keys, F.explode(F.aggregate("_a", F.expr(f"cast(array() as {kind})"), walk)).alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def apart_of_many(rows: DataFrame, keys: list[str], gap: float = PEAK_GAP, most: int = k.MAX_KILLS) -> DataFrame:
    """The same for keys with any number of rows."""
    span = (F.col("time") - gap / 2, F.col("time") + gap / 2)
    return greedy_rank(settle(rows), keys, _apart_order(), lambda a, b: F.abs(a["time"] - b["time"]) < gap, most, span=span).drop("place")


def chain_peaks(peaks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Loudness peaks with their chain (gap 18 s, span 105 s, two peaks or more), and the chains ``(c_start, c_end, peaks,
    strongest, score)``."""
    rows = k.gap_span_clusters(peaks.select(*KEY, "time", "idx", "strength"), "time", ["idx"], 18.0, 105.0)
    rows, chains = with_chains(settle(rows))
    return settle(rows), settle(chains)


def with_chains(rows: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    total = F.count(F.lit(1)) * 22 + F.max("strength") * 4 + F.sum("strength")
    chains = rows.groupBy(*CLUSTER).agg(F.min("time").alias("c_start"), F.max("time").alias("c_end"), F.count(F.lit(1)).alias("peaks"), F.max("strength").alias("strongest"), total.alias("score"))
    chains = chains.filter(F.col("peaks") >= least)
    return rows.join(chains.select(*CLUSTER), CLUSTER, "left_semi"), chains


def _around(chains: DataFrame, rows: DataFrame, reach: tuple[float, float]) -> DataFrame:
    """``rows`` (video_id, time, ...) that lie around each chain, under its key."""
    spans = chains.select(*CLUSTER, (F.col("c_start") - reach[0]).alias("_lo"), (F.col("c_end") + reach[1]).alias("_hi"))
    return overlap_join(rows.withColumn("_at", F.col("time")), spans, KEY, (F.col("_at"), F.col("_at")), (F.col("_lo"), F.col("_hi"))).drop("_at", "_lo", "_hi")


def peak_ladder(chain_rows: DataFrame, chains: DataFrame, events: DataFrame, flagged: DataFrame) -> DataFrame:
    """What a loud chain stands for: the first of six candidate sets that qualifies as a whole.

    ``feed``: confirmed kills close to the chain, ``feed_wide``: further around it, ``lines``: kill moments of the transcript,
    ``marked``: its loud peaks that have an event beside them, ``near_feed``: confirmed kills near it without the gap test, and
    ``loud``: its strongest peaks. A set is tight where no gap exceeds 22 s and counts with two peaks; the last one counts always."""
    events = ev.complete(events)
    sure = k.confirmed_kills(events)
    rich = sure.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_sure"))
    rich_kills = settle(sure.join(rich.filter("_sure >= 2").select(*KEY), KEY, "left_semi").withColumn("at", ev.event_time()))

    def feed(reach: tuple[float, float]) -> DataFrame:
        near = k.dedupe_groups(_around(chains, rich_kills, reach), CLUSTER, most=k.MAX_KILLS)
        return settle(until_gap(apart(event_peaks(near), CLUSTER), CLUSTER))

    said = flagged.filter("moment").select(*KEY, F.col("start").alias("time"), F.lit(LINE_STRENGTH).alias("strength"), F.lit(None).cast("string").alias("roi"), F.lit("line").alias("kind"))
    said = settle(top_per_key(_around(chains, said, LINES), CLUSTER, [F.col("time")], k.MAX_KILLS))
    # marks: the confirmed kills of a recording, or all its events if it has none
    marks = sure.unionByName(events.join(rich.select(*KEY), KEY, "left_anti"))
    loud = chain_rows.withColumns({"roi": F.lit(None).cast("string"), "kind": F.lit("loud")})
    marked = nearest_join(loud, marks.select(*KEY, F.col("time").alias("_et"), F.col("seq").alias("_es"), nz(F.col("confidence"), 0.0).alias("_ec")), KEY, ["cluster_at", "idx"],
                          F.col("time"), F.col("_et"), ["_et", "_es"], MARK_DIST, {"mark": "_ec"})
    marked = settle(marked)
    with_mark = marked.filter("mark is not null")
    best = [(-(F.col("strength") + nz(F.col("mark"), 0.0) * 40)), F.col("time")]
    peak = lambda rows: rows.select(*CLUSTER, "time", "strength", "roi", "kind")
    near = apart_of_many(event_peaks(_around(chains, rich_kills, NEAR_FEED)), CLUSTER)
    strongest = top_per_key(marked, CLUSTER, [F.col("mark").isNull(), *best], 4)
    return settle(first_qualifying([
        ("feed", feed(FEED), 2), ("feed_wide", feed(FEED_WIDE), 2), ("lines", until_gap(peak(said), CLUSTER), 2), ("lines", peak(said), 2),
        ("marked", until_gap(peak(top_per_key(with_mark, CLUSTER, best, 5)), CLUSTER), 2), ("marked", peak(top_per_key(with_mark, CLUSTER, best, 4)), 2),
        ("near_feed", near, 2), ("loud", until_gap(peak(strongest), CLUSTER), 1),
    ], CLUSTER))


def _feed_cuts(selected: DataFrame, video_end: Column) -> DataFrame:
    """Cuts of montages whose peaks are events; the anchor is moved once more, as specified."""
    rows = ev.complete(selected.select(
        *CLUSTER, "time", "roi", F.lit(0.6).alias("confidence"), F.lit(None).cast("boolean").alias("player_kill"), F.lit(None).cast("boolean").alias("red_highlight"),
        F.lit(None).cast("double").alias("highlight_score"), F.col("time").alias("at"), F.monotonically_increasing_id().alias("seq")))
    rows = k.segment_columns(k.dedupe_groups(rows, CLUSTER, most=k.MAX_KILLS), F.lit(False), video_end, CLUSTER)
    cut = F.struct("start", "duration", "peak_time")
    made = rows.groupBy(*CLUSTER).agg(F.sort_array(F.collect_list(F.when(F.col("start").isNotNull(), F.struct(F.col("at").alias("_o"), cut.alias("cut"))))).alias("_s"))
    made = made.withColumn("segments", k.trim_overlaps(F.transform("_s", lambda x: x["cut"]))).withColumns({"output_duration": k.total_duration(F.col("segments")), "kill_count": F.size("segments")})
    need = F.when(F.col("kill_count") >= 4, k.MIN_MONTAGE).when(F.col("kill_count") >= 3, 7.0).otherwise(4.0)
    return made.filter((F.col("kill_count") >= 2) & (F.col("output_duration") >= need)).select(*CLUSTER, "segments", "output_duration", "kill_count", F.lit(k.HUD.total).alias("limit"))


def shooter_cuts(ladder: DataFrame, video_end: Column | float) -> DataFrame:
    """Cut lists of the chosen peaks: four at most, 3.5 s apart; events are anchored before they are cut."""
    end = video_end if isinstance(video_end, Column) else F.lit(float(video_end))
    lead = F.when(F.col("roi") == "bottom_kills", 0.65).when(F.col("roi") == "top_right", 0.85).otherwise(0.75)
    event = F.col("kind") == "event"
    rows = apart(ladder, CLUSTER).withColumn("time", F.when(event, F.greatest(F.lit(0.0), F.col("time") - lead)).otherwise(F.col("time")))
    rows = settle(rows.withColumns({"_events": F.count_if(event).over(W.partitionBy(*CLUSTER)), "_n": F.count(F.lit(1)).over(W.partitionBy(*CLUSTER))}))
    offset = F.when(event, -0.75).when(F.col("kind") == "line", -0.15).otherwise(-0.2)
    others = rows.filter("_events < 2").withColumn("time", F.greatest(F.lit(0.0), F.col("time") + offset))
    cuts = lambda part, timing: c.peak_segments(part, CLUSTER, end, timing, 0.0).select(*CLUSTER, "segments", "output_duration", F.col("kill_count"), F.lit(timing.total).alias("limit"))
    made = _feed_cuts(rows.filter("_events >= 2"), end).unionByName(cuts(others.filter("_n >= 2"), k.KILL_ONLY)).unionByName(cuts(others.filter("_n = 1"), LONE))
    picked = rows.groupBy(*CLUSTER).agg(F.max("time").alias("hook"), F.min("time").alias("first_peak"), F.first("rung").alias("rung"), F.sort_array(F.collect_list("time")).alias("peak_times"))
    return settle(made.join(picked, CLUSTER))


def finalise(segments: Column, measured: Column | None = None, start: Column | None = None, end: Column | None = None) -> dict[str, Column]:
    """Length and span of a finished montage: the measured length where there is one, else the sum of its cuts."""
    first, last = F.get(segments, F.lit(0)), F.element_at(segments, -1)
    known = F.lit(None).cast("double") if measured is None else measured
    given = lambda x: F.lit(None).cast("double") if x is None else F.when(x != 0, x)
    return {"output_duration": F.when(nz(known > 0.5, False), tenth(known)).otherwise(k.total_duration(segments)),
            "start_time": F.coalesce(given(start), first["start"]), "end_time": F.coalesce(given(end), tenth(last["start"] + last["duration"]))}


def payoff_moments(montages: DataFrame, flagged: DataFrame, scan: DataFrame, video_end: Column | float) -> DataFrame:
    """``payoff_at`` of montages (keys ``montage``, ``last_kill``): the first payoff line from 1.5 s after the last kill on, within 20 s;
    without one the strongest loud peak between 2 s after it and then."""
    end = video_end if isinstance(video_end, Column) else F.lit(float(video_end))
    ahead = F.least(end, F.col("last_kill") + 20.0)
    slim = montages.select(*KEY, "montage", "last_kill").distinct()
    said = overlap_join(flagged.filter("payoff").select(*KEY, F.col("start").alias("_p")), slim, KEY, (F.col("_p"), F.col("_p")), (F.col("last_kill") + 1.5, ahead))
    said = said.groupBy(*KEY, "montage").agg(F.min("_p").alias("_said"))
    loud = overlap_join(l.loudness_peaks(scan, "payoff").select(*KEY, F.col("time").alias("_p"), F.col("strength").cast("double").alias("_x")), slim, KEY, (F.col("_p"), F.col("_p")), (F.col("last_kill") + 2.0, ahead))
    loud = loud.filter((F.col("_p") > F.col("last_kill") + 2.0) & (F.col("_p") < F.least(end, F.col("last_kill") + 20.0)))
    loud = loud.groupBy(*KEY, "montage").agg(F.min_by("_p", F.struct(-F.col("_x"), "_p")).alias("_loud"))
    return montages.join(said, [*KEY, "montage"], "left").join(loud, [*KEY, "montage"], "left").withColumn("payoff_at", F.coalesce("_said", "_loud")).drop("_said", "_loud")


def with_payoff(montages: DataFrame, flagged: DataFrame, scan: DataFrame, video_end: Column | float) -> DataFrame:
    """Montages (``montage``, ``segments``, ``limit``, ``sure``) of three kills or more and two confirmed ones, extended by a payoff."""
    end = video_end if isinstance(video_end, Column) else F.lit(float(video_end))
    kind = "array<struct<start:double,duration:double,peak_time:double,payoff:boolean>>"
    rows = montages.withColumn("segments", F.transform("segments", lambda x: F.struct(x["start"], x["duration"], x["peak_time"], F.lit(False).alias("payoff"))).cast(kind))
    last = F.element_at("segments", -1)["peak_time"]
    may = (F.size("segments") >= 3) & (F.col("sure") >= 2)
    rows = settle(payoff_moments(rows.withColumn("last_kill", F.when(may, last)), flagged, scan, end))
    t = k.PAYOFF
    begin = F.greatest(F.lit(0.0), F.col("payoff_at") - t.before)
    length = min(t.longest, t.before + t.after)
    start = F.when(begin + length > end, F.greatest(F.lit(0.0), end - length)).otherwise(begin)
    dur = F.when(begin + length > end, end - start).otherwise(length)
    total, most = k.total_duration(F.col("segments")), F.col("limit") + t.longest + 0.5
    ok = nz((F.col("payoff_at") > last + 2.0) & (total < most) & (dur >= t.shortest) & (total + dur <= most), False)
    extra = F.array(F.struct(tenth(start).alias("start"), tenth(dur).alias("duration"), tenth(F.col("payoff_at")).alias("peak_time"), F.lit(True).alias("payoff"))).cast(kind)
    rows = rows.withColumns({"has_payoff": ok, "segments": F.when(ok, F.concat("segments", extra)).otherwise(F.col("segments"))})
    return rows.withColumns(finalise(F.col("segments"))).drop("last_kill", "payoff_at", "limit")


def _confirmed_peaks(cuts: DataFrame, events: DataFrame) -> DataFrame:
    """How many of a montage's peaks have an event within 3.5 s."""
    points = cuts.select(*CLUSTER, F.explode("peak_times").alias("_t"))
    near = band_join(points, events.select(*KEY, F.col("time").alias("_e")), KEY, F.col("_t"), F.col("_e"), CONFIRM_DIST, CONFIRM_DIST)
    hits = near.filter(F.abs(F.col("_t") - F.col("_e")) <= CONFIRM_DIST).select(*CLUSTER, "_t").distinct().groupBy(*CLUSTER).agg(F.count(F.lit(1)).alias("sure"))
    return cuts.join(hits, CLUSTER, "left").withColumn("sure", nz(F.col("sure"), F.lit(0).cast("bigint")))


def measured(windows: DataFrame, events: DataFrame, flagged: DataFrame, scan: DataFrame, base: float) -> DataFrame:
    """``windows`` (video_id, wid, w_start, w_end) with kill lines, the sound score plus ``base``, kills and their boost."""
    spans = windows.select(*KEY, "wid", "w_start", "w_end")
    heard = l.window_stats(scan, spans).select(*KEY, "wid", (l.window_score(F.col("max_delta"), F.col("avg_delta"), AUDIO_WEIGHT) + base).alias("audio_delta"), "max_delta")
    seen = w.event_boost(events, spans).select(*KEY, "wid", F.col("kills").alias("hud_kills"), "boost")
    read = keyword_windows(spans, flagged).select(*KEY, "wid", "keyword_lines")
    return windows.join(heard, [*KEY, "wid"]).join(seen, [*KEY, "wid"]).join(read, [*KEY, "wid"])


def near_line(rows: DataFrame, lines: DataFrame, rid: list[str], at: str, out: str) -> DataFrame:
    """``out``: the first 72 characters of the line that starts nearest to ``at``, less than 8 s away."""
    said = lines.filter("text <> ''").select(*KEY, F.col("seq").alias("_ls"), F.col("start").alias("_st"), F.left("text", F.lit(72)).alias("_text"))
    return nearest_join(rows, said, KEY, rid, F.col(at), F.col("_st"), ["_st", "_ls"], LINE_DIST - 1e-9, {out: "_text"}).drop("distance")


def chain_montages(chain_rows: DataFrame, chains: DataFrame, events: DataFrame, flagged: DataFrame, scan: DataFrame, video_end: Column | float) -> DataFrame:
    """One montage per loud chain that makes a coherent one, with its composite.

    Where a recording has three confirmed kills or more, a montage needs two peaks with an event beside them."""
    cuts = shooter_cuts(peak_ladder(chain_rows, chains, events, flagged), video_end)
    sure = k.confirmed_kills(events).groupBy(*KEY).agg(F.count(F.lit(1)).alias("_sure"))
    cuts = _confirmed_peaks(cuts, events).join(sure, KEY, "left").filter(~((nz(F.col("_sure"), 0) >= 3) & (F.col("sure") < 2))).drop("_sure")
    cuts = settle(cuts.filter(k.coherent(F.col("segments")))).withColumn("montage", F.col("cluster_at")).drop("output_duration")
    rows = settle(with_payoff(cuts, flagged, scan, video_end).join(chains, CLUSTER).withColumns({"wid": F.col("cluster_at"), "w_start": F.col("start_time"), "w_end": F.col("end_time")}))
    rows = measured(rows, events, flagged, scan, 60.0)
    composite = c.montage_composite(F.col("peaks"), F.col("keyword_lines"), F.col("audio_delta"), F.col("boost"), F.col("sure"), F.size("segments"), F.col("strongest"))
    return settle(rows.withColumn("composite", composite).drop("montage", "wid", "w_start", "w_end", "peak_times"))


def chain_windows(chain_rows: DataFrame, chains: DataFrame, events: DataFrame, flagged: DataFrame, scan: DataFrame, video_end: Column | float) -> DataFrame:
    """One plain window per loud chain with its composite, the simpler clip of the same moments."""
    hook = chain_rows.groupBy(*CLUSTER).agg(F.min_by("time", F.struct(-F.col("strength"), "time")).alias("hook"))
    spans = c.cluster_window(chains.withColumnsRenamed({"c_start": "start", "c_end": "end"}), video_end).withColumn("wid", F.col("cluster_at"))
    rows = measured(settle(spans.join(hook, CLUSTER)), events, flagged, scan, 35.0)
    return rows.withColumn("composite", 80 + F.col("peaks") * 28 + F.col("keyword_lines") * 12 + F.col("audio_delta") + F.col("boost") + F.col("strongest") * 3).drop("wid")


def feed_clips(events: DataFrame, scan: DataFrame, video_end: Column | float) -> DataFrame:
    """Clips of the feed's own kills in recordings whose loudness is known."""
    heard = scan.select(*KEY).distinct()
    kills = settle(k.quality_pool(events.join(heard, KEY, "left_semi"), True, video_end))
    return k.pack_clips(settle(k.burst_packs(kills)), video_end)


def feed_montages(events: DataFrame, flagged: DataFrame, scan: DataFrame, video_end: Column | float) -> DataFrame:
    """The feed's clips where a recording has two kills or more, with payoff and composite."""
    heard = scan.select(*KEY).distinct()
    kills = settle(k.quality_pool(events.join(heard, KEY, "left_semi"), True, video_end))
    enough = kills.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").select(*KEY)
    clips = settle(k.pack_clips(settle(k.burst_packs(kills.join(enough, KEY, "left_semi"))), video_end))
    rows = clips.select(*KEY, "pack_at", "pack_seq", F.col("pack_seq").alias("montage"), "segments", "kill_count", F.col("kill_count").alias("sure"), F.lit(k.RED.total).alias("limit"), F.col("confidence"))
    rows = with_payoff(rows, flagged, scan, video_end)
    return rows.withColumn("composite", (320 + F.col("kill_count") * 55 + F.when(F.col("confidence") == 0, 70).otherwise(nz(F.col("confidence"), 70.0)) * 2).cast("double")).drop("montage", "sure")


def _order(first: Column, second: Column, third: Column | None = None) -> Column:
    return F.struct(first.cast("double").alias("a"), second.cast("double").alias("b"), (F.lit(0.0) if third is None else third).alias("c"))


_OUT = ["start_time", "end_time", "output_duration", "kill_count", "composite", "segments", "has_payoff"]


def shooter_windows(peaks: DataFrame, events: DataFrame, flagged: DataFrame, scan: DataFrame, video_end: Column | float) -> DataFrame:
    """All montages of a recording, by source: ``feed``, ``chain`` and ``sparse``; one per source and second of its start.

    A recording with four confirmed kills and three feed montages needs nothing else. Elsewhere chains count, with two kills in
    them where three or more are confirmed; and a recording that still has fewer than four montages and fewer than three events
    gets one from its strongest peaks. Only recordings with loudness have any."""
    sure = k.confirmed_kills(events).groupBy(*KEY).agg(F.count(F.lit(1)).alias("confirmed"))
    seen = events.groupBy(*KEY).agg(F.count(F.lit(1)).alias("events"))
    loud = peaks.groupBy(*KEY).agg(F.count(F.lit(1)).alias("loud_peaks"))
    feed = settle(feed_montages(events, flagged, scan, video_end))
    made = feed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("feed"))
    facts = seen.join(sure, KEY, "left").join(loud, KEY, "full").join(made, KEY, "full")
    facts = settle(facts.select(*KEY, *[nz(F.col(n), F.lit(0).cast("bigint")).alias(n) for n in ("confirmed", "events", "loud_peaks", "feed")]))
    full = (F.col("confirmed") >= 4) & (F.col("feed") >= 3)

    # recordings that are already served, or too poor, are left out before anything is built for them
    open_ = facts.filter(~full).select(*KEY)
    mine = lambda df: df.join(open_, KEY, "left_semi")
    rows, chains = chain_peaks(mine(peaks))
    chained = chain_montages(rows, chains, mine(events), mine(flagged), mine(scan), video_end)
    chained = chained.join(facts.select(*KEY, "confirmed"), KEY, "left").filter(~((nz(F.col("confirmed"), 0) >= 3) & (F.col("hud_kills") < 2)))
    slim = lambda df, order: df.select(*KEY, *_OUT, order.alias("_order"))
    poor = facts.filter(~full & (F.col("events") < 3) & (F.col("loud_peaks") >= 2)).select(*KEY)
    sources = [
        ("feed", slim(feed, _order(-F.col("composite"), F.col("pack_at"), F.col("pack_seq").cast("double"))), None),
        ("chain", slim(chained, _order(-F.col("score"), F.col("cluster_at"))), ~nz(full, False)),
    ]
    if not poor.isEmpty():
        few = lambda df: df.join(poor, KEY, "left_semi")
        lone = c.sparse_peaks(few(peaks)).withColumn("idx", half_up(F.col("time") * 2).cast("int"))
        lone = lone.withColumn("cluster_at", F.min("time").over(W.partitionBy(*KEY)))
        sparse = chain_montages(*with_chains(settle(lone.select(*CLUSTER, "time", "idx", "strength"))), few(events), few(flagged), few(scan), video_end)
        sources.append(("sparse", slim(sparse, _order(F.lit(0.0), F.col("cluster_at"))), nz(~full, True) & (F.col("have") < 4)))
    return until_enough(sources, KEY, [F.floor("start_time")], [F.col("_order")], facts).drop("_order")


def feed_candidates(candidates: DataFrame, clips: DataFrame) -> DataFrame:
    """The feed's clips, worth 120 more, and, where a recording has fewer than five, the montages among ``candidates``
    (seq, start_time, end_time, kill_count, local_score, segments) that don't overlap them; numbered by kills, then score.

    Recordings without a clip keep all their candidates."""
    kept = ["start_time", "end_time", "kill_count", "local_score"]
    own = clips.select(*KEY, F.lit(0).alias("from_pool"), F.col("pack_seq").cast("string").alias("seq"), *[F.col(x) if x != "local_score" else (F.col(x) + FEED_BONUS).alias(x) for x in kept])
    served = clips.select(*KEY).distinct()
    whole = candidates.filter(k.coherent(F.filter("segments", lambda x: ~x["payoff"]))).join(served, KEY, "left_semi")
    beside = s.drop_overlapping_audio(whole, clips, MOST_FEED).unionByName(candidates.join(served, KEY, "left_anti"))
    rows = own.unionByName(beside.select(*KEY, F.lit(1).alias("from_pool"), F.col("seq").cast("string").alias("seq"), *kept))
    return rows.withColumn("list_index", F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("kill_count"), F.desc("local_score"), "from_pool", "start_time", "seq")))


def signal_pool(windows: DataFrame, clips: DataFrame) -> DataFrame:
    """The candidates of recordings without a transcript: their montages, worth 280 more, beside the feed's clips, with a
    confidence relative to the first one. All are montages, so none is cut off."""
    place = F.concat_ws(":", "source", F.floor("start_time"))
    pool = windows.withColumns({"seq": place, "local_score": (half_up(F.col("composite")) + MONTAGE_BONUS).cast("double")})
    ranked = feed_candidates(pool, clips)
    top = F.first("local_score").over(W.partitionBy(*KEY).orderBy("list_index"))
    return ranked.withColumn("confidence", s.relative_confidence(F.col("local_score"), top)).drop("seq")


def worthy(candidates: DataFrame, lines: DataFrame) -> DataFrame:
    """Plain candidates ``(video_id, wid, w_start, w_end, flags)`` that show a fight: flagged for kills, or with a kill line."""
    flagged = F.exists("flags", lambda x: x.isin("multikill-montage", "hud-kills", "kill-feed", "hud-confirmed"))
    kills = w.window_lines(lines, candidates.select(*KEY, "wid", "w_start", "w_end")).groupBy(*KEY, "wid").agg(F.max(F.col("kill_talk").cast("int")).alias("_kill"))
    return candidates.join(kills, [*KEY, "wid"], "left").filter(nz(flagged, False) | (nz(F.col("_kill"), 0) == 1)).drop("_kill")
