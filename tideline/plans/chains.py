"""Longer chains of kills and montages cut from loudness peaks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions import events as ev
from tideline.functions.numeric import nz, tenth
from tideline.operators.greedy import greedy_rank
from tideline.operators.ordered import gap_sessions, ordered, top_per_key
from tideline.operators.ranges import overlap_join
from tideline.plans import kills as k
from tideline.plans.select import montages_share

KEY = ["video_id"]


def event_clusters(events: DataFrame) -> DataFrame:
    """Kills of wide clusters (gap 95 s, span 600 s), one per close group, at most four, clusters with at least two."""
    rows = ev.complete(events).withColumn("at", ev.event_time())
    placed = k.gap_span_clusters(rows.select(*KEY, "at", "seq"), "at", ["seq"], k.CLUSTER_GAP, k.CLUSTER_SPAN)
    rows = rows.join(placed, [*KEY, "at", "seq"])
    kept = k.dedupe_groups(rows, [*KEY, "cluster_at"], most=k.MAX_KILLS)
    return kept.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*KEY, "cluster_at"))).filter("_n >= 2").drop("_n")


def cluster_montages(events: DataFrame, video_end: Column | float, wide_gap: bool | None = None) -> DataFrame:
    """One montage per wide cluster, most kills first."""
    rows = event_clusters(events)
    first = F.min("seq").over(W.partitionBy(*KEY, "cluster_at"))
    packed = rows.withColumns({"pack_at": F.col("cluster_at"), "pack_seq": first, "pos": F.lit(1)}).drop("cluster_at")
    clips = k.pack_clips(packed, video_end, wide_gap)
    return clips.withColumn("place", F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("kill_count"), "pack_at")))


def cluster_score(kills: Column, span: Column, mean_conf: Column, feed: Column, first_at: Column) -> Column:
    """Value of a chain: count, confidence, feed kills and span, less penalties for early and tight ones."""
    count = F.when(kills >= 4, 90).when(kills == 3, 55).when(kills == 2, 12).otherwise(0)
    tight = F.when(span < k.CHAIN_SPAN, 100).when(span < 120, 50).otherwise(0)
    return F.when(kills < 2, 0.0).otherwise(count + kills * 35 + mean_conf * 28 + feed * 18 + F.least(F.lit(120.0), span * 0.35) - F.when(first_at < 90, 15).otherwise(0) - tight)


def burst_adjust(kills: Column, span: Column) -> Column:
    return (F.when(span <= k.BURST_GAP, 70 + kills * 22).when(span <= k.BURST_SPAN, 35 + kills * 12).when(span > 90, -120 - kills * 8).when(span > 60, -70 - kills * 5).otherwise(0))


def _rank_chains(members: DataFrame, order) -> DataFrame:
    """Chains from their member rows ``(video_id, chain, at, seq, ...)``: totals, then a greedy pass that keeps chains
    sharing no kill. Chains whose spans lie apart cannot share one, so the pass runs per group of touching spans."""
    feed = (nz(F.col("player_kill"), False) | nz(F.col("red_highlight"), False) | ev.top_right()).cast("int")
    c = members.groupBy(*KEY, "chain").agg(F.sort_array(F.collect_list("at")).alias("kill_times"), F.count(F.lit(1)).cast("int").alias("kills"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
                                           F.avg(nz(F.col("confidence"), 0.5)).alias("_c"), F.sum(feed).alias("_f"))
    c = c.withColumn("span", F.col("last_at") - F.col("first_at")).filter("kills >= 2")
    c = c.withColumn("score", cluster_score(F.col("kills"), F.col("span"), F.col("_c"), F.col("_f"), F.col("first_at"))).drop("_c", "_f")
    c = ordered(c, KEY, "first_at", ["chain"], run_max={"_reach": "last_at"})
    c = gap_sessions(c, KEY, "first_at", 3.0, ["chain"], out="_group", end="_reach").drop("_reach")
    out = greedy_rank(c, [*KEY, "_group"], order(), lambda a, b: montages_share(a["kill_times"], b["kill_times"]), None, span=(F.col("first_at") - 3, F.col("last_at") + 3))
    return out.drop("_group", "place")


def sliding_chains(events: DataFrame) -> DataFrame:
    """The chain of up to four kills starting at every kill (gap 95 s, span 600 s, repeats within 4.5 s collapsed),
    more kills, shorter span and higher score first, no kill used twice."""
    rows = ev.complete(events).withColumn("at", ev.event_time())
    slim = rows.select(*KEY, "at", "seq").withColumn("_e", F.struct("at", "seq"))
    for i in (1, 2, 3):
        slim = ordered(slim, KEY, "at", ["seq"], lead={f"_n{i}": "_e" if i == 1 else f"_n{i - 1}"})
    ok1 = nz(F.col("_n1.at") - F.col("at") <= k.CLUSTER_GAP, False)
    ok2 = ok1 & nz((F.col("_n2.at") - F.col("_n1.at") <= k.CLUSTER_GAP) & (F.col("_n2.at") - F.col("at") <= k.CLUSTER_SPAN), False)
    ok3 = ok2 & nz((F.col("_n3.at") - F.col("_n2.at") <= k.CLUSTER_GAP) & (F.col("_n3.at") - F.col("at") <= k.CLUSTER_SPAN), False)
    links = F.array_compact(F.array("_e", F.when(ok1, F.col("_n1")), F.when(ok2, F.col("_n2")), F.when(ok3, F.col("_n3"))))
    members = slim.select(*KEY, F.col("seq").alias("chain"), F.explode(links).alias("m")).select(*KEY, "chain", "m.*").join(rows, [*KEY, "at", "seq"])
    kept = k.dedupe_groups(members, [*KEY, "chain"], gap=k.ENGAGEMENT_GAP, most=k.MAX_KILLS)
    return _rank_chains(kept, lambda: [-F.col("kills"), F.col("span"), -F.col("score"), F.col("first_at"), F.col("chain")])


def next_at_least(rows: DataFrame, gap: float) -> DataFrame:
    """Per row the first later row at least ``gap`` seconds away: probes at t + gap and rows are scanned together in
    falling time, so the answer is a forward fill and needs no range join."""
    src = rows.select(*KEY, (-F.col("at")).alias("_t"), F.lit(0).alias("_kind"), F.col("seq").alias("_s"), F.struct("at", "seq").alias("_e"), F.lit(None).cast("bigint").alias("_for"))
    probe = rows.select(*KEY, (-(F.col("at") + gap)).alias("_t"), F.lit(1).alias("_kind"), F.col("seq").alias("_s"), F.lit(None).cast("struct<at:double,seq:bigint>").alias("_e"), F.col("seq").alias("_for"))
    scanned = ordered(src.unionByName(probe).withColumn("_ns", -F.col("_s")), KEY, "_t", ["_kind", "_ns"], fill={"_hit": "_e"})
    return scanned.filter("_kind = 1 and _hit is not null").select(*KEY, F.col("_for").alias("seq"), F.col("_hit.at").alias("next_at"), F.col("_hit.seq").alias("next_seq"))


def wide_chains(events: DataFrame) -> DataFrame:
    """Chains of up to four kills at least thirty seconds apart and spanning 75 s, longest span first."""
    rows = ev.complete(events).withColumn("at", ev.event_time())
    nxt = next_at_least(rows.select(*KEY, "at", "seq"), k.WIDE_GAP)
    chain = rows.select(*KEY, F.col("seq").alias("s0"), "at")
    for i in (1, 2, 3):
        hop = nxt.select(*KEY, F.col("seq").alias(f"s{i - 1}"), F.col("next_seq").alias(f"s{i}"))
        chain = chain.join(hop, [*KEY, f"s{i - 1}"], "left")
    members = chain.select(*KEY, F.col("s0").alias("chain"), F.explode(F.array_compact(F.array("s0", "s1", "s2", "s3"))).alias("seq")).join(rows, [*KEY, "seq"])
    span = W.partitionBy(*KEY, "chain")
    members = members.withColumn("_span", F.max("at").over(span) - F.min("at").over(span)).filter(F.col("_span") >= k.CHAIN_SPAN).drop("_span")
    return _rank_chains(members, lambda: [-F.col("span"), -F.col("kills"), -F.col("score"), F.col("first_at"), F.col("chain")])


def strongest_tight(peaks: DataFrame, keys: list[str], most: int = 4, gap: float = k.BURST_GAP) -> DataFrame:
    """The strongest peaks of each cluster in time order, up to the first gap above ``gap``."""
    top = top_per_key(peaks, keys, [F.desc("strength"), F.col("time")], most)
    timed = W.partitionBy(*keys).orderBy("time")
    late = (F.col("time") - F.lag("time").over(timed) > gap).cast("int")
    return top.withColumn("_late", nz(late, 0)).withColumn("_cut", F.max("_late").over(timed.rowsBetween(W.unboundedPreceding, 0))).filter("_cut = 0").drop("_late", "_cut")


def sparse_peaks(peaks: DataFrame, most: int = 5, span: float = 75.0, gap: float = k.BURST_GAP) -> DataFrame:
    """Per recording the strongest peak and, in order of strength, peaks within 75 s of it and 22 s of the last one
    taken. The peak table is capped at a hundred rows per recording, so one small array is folded."""
    packed = peaks.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct((-F.col("strength")).alias("s"), F.col("time").alias("t")))).alias("_p"))

    def walk(acc: Column, p: Column) -> Column:
        first, last = F.get(acc, F.lit(0)), F.get(acc, F.size(acc) - 1)
        take = (F.size(acc) == 0) | ((F.size(acc) < most) & (F.abs(p["t"] - first["t"]) <= span) & (F.abs(p["t"] - last["t"]) <= gap))
        return F.when(take, F.concat(acc, F.array(p))).otherwise(acc)

    kept = F.aggregate("_p", F.expr("cast(array() as array<struct<s:double,t:double>>)"), walk)
    return packed.select(*KEY, kept.alias("_k")).filter(F.size("_k") >= 2).select(*KEY, F.explode("_k").alias("_x")).select(*KEY, F.col("_x.t").alias("time"), (-F.col("_x.s")).alias("strength"))


def peak_segments(selected: DataFrame, keys: list[str], video_end: Column | float, timing: k.Timing = k.KILL_ONLY, offset: float = -0.2) -> DataFrame:
    """Cuts around a handful of peaks per cluster: none overlaps the last, and the total stays near the profile's limit
    once twelve seconds are reached."""
    end = video_end if isinstance(video_end, Column) else F.lit(float(video_end))
    length = min(timing.longest, timing.before + timing.after)
    packed = selected.groupBy(*keys).agg(F.sort_array(F.collect_list("time")).alias("_t"), F.count(F.lit(1)).alias("_n"))
    limit = F.greatest(F.lit(max(timing.total, length)), F.when(F.col("_n") >= 2, k.MIN_MONTAGE).otherwise(length))
    zero = F.expr("struct(cast(array() as array<struct<start:double,duration:double,peak_time:double>>) as segs, 0D as total, -1e9D as last, true as open)")
    kind = "struct<segs:array<struct<start:double,duration:double,peak_time:double>>,total:double,last:double,open:boolean>"

    def walk(acc: Column, t: Column) -> Column:
        at = F.greatest(F.lit(0.0), t + offset)
        raw = F.greatest(F.lit(0.0), at - min(timing.before, 3.0))
        start = F.when(raw + length > end, F.greatest(F.lit(0.0), end - length)).otherwise(raw)
        dur = F.when(raw + length > end, end - start).otherwise(length)
        skip = (dur < timing.shortest) | (start < acc["last"] - 0.2)
        full = ((acc["total"] + dur > limit) & (acc["total"] >= k.MIN_MONTAGE)) | (acc["total"] + dur > limit + length)
        go = acc["open"] & ~(~skip & full)
        take = go & ~skip
        seg = F.struct(tenth(start).alias("start"), tenth(dur).alias("duration"), tenth(at).alias("peak_time"))
        return F.struct(F.when(take, F.concat(acc["segs"], F.array(seg))).otherwise(acc["segs"]), F.when(take, acc["total"] + dur).otherwise(acc["total"]), F.when(take, start + dur).otherwise(acc["last"]), go).cast(kind)

    built = packed.withColumn("_b", F.aggregate("_t", zero, walk))
    n = F.size("_b.segs")
    ok = (n >= 1) & ((F.col("_n") < 2) | ((n >= 2) & (F.col("_b.total") >= k.MIN_MONTAGE)))
    last = F.element_at("_b.segs", -1)
    return built.filter(ok).select(*keys, F.col("_b.segs").alias("segments"), k.total_duration(F.col("_b.segs")).alias("output_duration"), F.get("_b.segs", F.lit(0))["start"].alias("start_time"),
                                   tenth(last["start"] + last["duration"]).alias("end_time"), n.alias("kill_count"))


def append_payoff(montages: DataFrame, payoffs: DataFrame, video_end: Column | float, ahead: float = 20.0) -> DataFrame:
    """Montages of three or more cuts extended by the first payoff moment ``(video_id, time)`` after the last kill."""
    end = video_end if isinstance(video_end, Column) else F.lit(float(video_end))
    rows = montages.withColumn("_last", F.element_at("segments", -1)["peak_time"])
    rid = [*KEY, "start_time", "end_time"]
    slim = rows.filter(F.size("segments") >= 3).select(*rid, "_last")
    pairs = overlap_join(payoffs.select(*KEY, F.col("time").alias("_p")), slim, KEY, (F.col("_p"), F.col("_p")), (F.col("_last") + 1.5, F.least(end, F.col("_last") + ahead)))
    first = pairs.groupBy(*rid).agg(F.min("_p").alias("_pay"))
    rows = rows.join(first, rid, "left")
    t = k.PAYOFF
    begin = F.greatest(F.lit(0.0), F.col("_pay") - t.before)
    length = min(t.longest, t.before + t.after)
    start = F.when(begin + length > end, F.greatest(F.lit(0.0), end - length)).otherwise(begin)
    dur = F.when(begin + length > end, end - start).otherwise(length)
    most = k.RED.total + t.longest + 0.5
    ok = nz((F.col("_pay") > F.col("_last") + 2.0) & (F.col("output_duration") < most) & (dur >= t.shortest) & (F.col("output_duration") + dur <= most), False)
    return rows.withColumns({
        "has_payoff": ok, "payoff": F.when(ok, F.struct(tenth(start).alias("start"), tenth(dur).alias("duration"), tenth(F.col("_pay")).alias("peak_time"))),
        "output_duration": F.when(ok, tenth(F.col("output_duration") + tenth(dur))).otherwise(F.col("output_duration")),
        "end_time": F.when(ok, tenth(tenth(start) + tenth(dur))).otherwise(F.col("end_time"))}).drop("_last", "_pay")


def cluster_window(clusters: DataFrame, video_end: Column | float, low: float = k.MIN_MONTAGE, high: float = 45.0) -> DataFrame:
    """One plain window over a whole peak chain ``(start, end, peaks)``."""
    end = video_end if isinstance(video_end, Column) else F.lit(float(video_end))
    single = F.col("peaks") == 1
    s = F.greatest(F.lit(0.0), F.col("start") - 2)
    e = F.least(end, F.col("end") + F.when(single, 8).otherwise(k.KILL_ONLY.after))
    e = F.when((e - s < low) & ~single, F.least(end, s + low)).otherwise(e)
    return clusters.withColumns({"w_start": F.when(e - s > high, F.greatest(F.lit(0.0), e - high)).otherwise(s), "w_end": e})


def montage_composite(peaks: Column, keyword_lines: Column, audio: Column, boost: Column, confirmed: Column, cuts: Column, strongest: Column) -> Column:
    return 280 + peaks * 45 + keyword_lines * 15 + audio + boost + confirmed * 30 + cuts * 25 + F.when(strongest >= 8, 50).otherwise(25)


def first_per_second(windows: DataFrame) -> DataFrame:
    """One window per whole second of its start; earlier sources win, then the higher composite."""
    sec = F.floor("start_time")
    kept = [c for c in windows.columns if c not in KEY]
    return windows.groupBy(*KEY, sec.alias("_sec"), "source").agg(F.max_by(F.struct(*kept), F.struct("composite", -F.col("end_time"))).alias("_w")).select(*KEY, "_w.*")
