"""The ways that handle large keys give the same answer as plain code on small data."""
import json
import random

import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.operators.chunks import carry_chunks
from tideline.operators.greedy import greedy_rank
from tideline.operators.ordered import gap_sessions, ordered, windowed, within
from tideline.operators.ranges import band_join, nearest_join, overlap_join
from tideline.operators.scans import scan_sessions, spaced_peaks

K = ["video_id"]


def points(spark, n=200, span=120, seed=1, videos=3):
    rnd = random.Random(seed)
    rows = [(rnd.choice(range(videos)), i, round(rnd.uniform(0, span), 1), float(rnd.randint(1, 40))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "video_id long, seq long, t double, v double")


def test_ordered_matches_plain_window(spark):
    _, df = points(spark)
    w = W.partitionBy("video_id").orderBy("t", "seq")
    up = w.rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("sparse", F.when(F.col("seq") % 5 == 0, F.col("v")))
    want = df.select("video_id", "seq", F.lag("v").over(w).alias("a"), F.lead("v").over(w).alias("b"), F.sum("v").over(up).alias("c"), F.max("v").over(up).alias("d"), F.last("sparse", True).over(up).alias("e"))
    got = ordered(df, K, "t", ["seq"], tile=7, lag={"a": "v"}, lead={"b": "v"}, run_sum={"c": "v"}, run_max={"d": "v"}, fill={"e": "sparse"}).select("video_id", "seq", "a", "b", "c", "d", "e")
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, got.collect()))


def test_windowed_counts_neighbours_across_tiles(spark):
    rows, df = points(spark)
    got = {r.seq: r.n for r in windowed(df, K, "t", 6, [], {"n": lambda s: F.count(F.lit(1)).over(within(s, 6, 6))}, tile=15).collect()}
    for v, i, t, _ in rows:
        assert got[i] == sum(1 for a, _, b, _ in rows if a == v and abs(round(b * 1e6) - round(t * 1e6)) <= 6e6)


def brute_packs(times, gap, span, most):
    packs = []
    for t in times:
        if packs and t - packs[-1][-1] <= gap and t - packs[-1][0] <= span and len(packs[-1]) < most:
            packs[-1].append(t)
        else:
            packs.append([t])
    return packs


@pytest.mark.parametrize("piece_sec,piece_rows", [(3600, 2048), (11, 3), (5, 2)])
def test_scan_is_exact_for_any_piece_size(spark, piece_sec, piece_rows):
    rows, df = points(spark, n=150, span=300)
    s = gap_sessions(df.select("video_id", "t", "seq"), K, "t", 8.0, ["seq"], tile=20)

    def step(prev, row):
        new = prev.isNull() | (prev["n"] >= 4) | (row["t"] - prev["first"] > 12)
        return F.struct(F.when(new, row["t"]).otherwise(prev["first"]).alias("first"), F.when(new, 1).otherwise(prev["n"] + 1).cast("int").alias("n"))

    got = scan_sessions(s, K, "session_start", "t", ["seq"], "struct<first:double,n:int>", step, piece_sec=piece_sec, piece_rows=piece_rows)
    have = sorted((r.video_id, r.t, r.seq, r.state.n) for r in got.collect())
    want = []
    for v in range(3):
        mine = sorted((t, i) for a, i, t, _ in rows if a == v)
        pos = [n + 1 for p in brute_packs([t for t, _ in mine], 8.0, 12, 4) for n in range(len(p))]
        want += [(v, t, i, p) for (t, i), p in zip(mine, pos)]
    assert have == sorted(want)


@pytest.mark.parametrize("piece_sec,piece_rows", [(3600, 2048), (9, 3)])
def test_spacing_rule_matches_greedy(spark, piece_sec, piece_rows):
    rows, df = points(spark, n=160, span=200, seed=4)
    got = spaced_peaks(df, K, "t", "v", ["seq"], 3.0, piece_sec=piece_sec, piece_rows=piece_rows)
    have = sorted((r.video_id, r.seq) for r in got.collect())
    want = []
    for v in range(3):
        kept = []
        for t, i, s in sorted(((t, i, s) for a, i, t, s in rows if a == v), key=lambda x: (-x[2], x[0], x[1])):
            if all(abs(round(t - q, 6)) >= 3.0 for q, _ in kept):
                kept.append((t, i))
        want += [(v, i) for _, i in kept]
    assert have == sorted(want)


@pytest.mark.parametrize("piece_rows", [2048, 3])
def test_spacing_rule_is_the_same_on_any_path(spark, piece_rows):
    """Times on a tenth of a second, where 5.1 - 2.1 falls short of 3 in floating point, on a rising ramp."""
    rows = [(1, f"k{i:03d}", round(2.1 + i * 0.5, 1), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "video_id long, name string, t double, v double")
    got = sorted(r.t for r in spaced_peaks(df, K, "t", "v", ["name"], 3.0, piece_sec=9, piece_rows=piece_rows).collect())
    assert got == sorted(t for _, _, t, _ in rows[::-1][::6])


@pytest.mark.parametrize("fold_rows", [2048, 5])
def test_greedy_rank_fold_and_rounds_agree(spark, fold_rows):
    rows, df = points(spark, n=90, span=100, seed=7)
    got = greedy_rank(df, K, [-F.col("v"), F.col("seq")], lambda a, b: F.abs(a["t"] - b["t"]) < 6, 5, fold_rows=fold_rows)
    have = sorted((r.video_id, r.place, r.seq) for r in got.collect())
    want = []
    for v in range(3):
        kept = []
        for t, i, s in sorted(((t, i, s) for a, i, t, s in rows if a == v), key=lambda x: (-x[2], x[1])):
            if len(kept) < 5 and all(abs(t - q) >= 6 for q, _ in kept):
                kept.append((t, i))
        want += [(v, n + 1, i) for n, (_, i) in enumerate(kept)]
    assert have == sorted(want)


@pytest.mark.parametrize("most", [7, None])
@pytest.mark.parametrize("shape", ["random", "ramp", "fall", "even"])
def test_greedy_in_tiles_equals_plain_greedy(spark, shape, most):
    rows, _ = points(spark, n=150, span=300, seed=9)
    value = {"random": lambda i, t, s: s, "ramp": lambda i, t, s: t, "fall": lambda i, t, s: -t, "even": lambda i, t, s: 1.0}[shape]
    rows = [(v, i, t, float(value(i, t, s))) for v, i, t, s in rows]
    df = spark.createDataFrame(rows, "video_id long, seq long, t double, v double")
    got = greedy_rank(df, K, [-F.col("v"), F.col("t"), F.col("seq")], lambda a, b: F.abs(a["t"] - b["t"]) < 6, most, span=(F.col("t"), F.col("t") + 6), fold_rows=5, tile_sec=20)
    want = []
    for v in range(3):
        kept = []
        for t, i, s in sorted(((t, i, s) for a, i, t, s in rows if a == v), key=lambda x: (-x[2], x[0], x[1])):
            if (most is None or len(kept) < most) and all(abs(t - q) >= 6 for q, _ in kept):
                kept.append((t, i))
        want += [(v, n + 1, i) for n, (_, i) in enumerate(kept)]
    assert sorted((r.video_id, r.place, r.seq) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("n", [4_000, 8_000])
def test_rounds_do_not_follow_the_rows(spark, n, monkeypatch):
    """One dense recording in which every row waits for the one before: the number of written tables stays the same."""
    from tideline.operators import greedy

    written = []
    monkeypatch.setattr(greedy, "settle", lambda df: written.append(1) or df.checkpoint())
    df = spark.range(n).select(F.lit(1).alias("video_id"), F.col("id").alias("seq"), (F.col("id") * 3600.0 / n).alias("t"))
    gap = 3600.0 / n * 2.5
    got = greedy.greedy_rank(df, K, [F.col("t")], lambda a, b: F.abs(a["t"] - b["t"]) < gap, None, span=(F.col("t"), F.col("t") + gap), tile_sec=300)
    assert got.count() == -(-n // 3)
    assert len(written) <= 3 + 3 * 6


@pytest.mark.parametrize("chunk_rows", [5000, 7])
def test_carried_state_is_independent_of_chunks(spark, chunk_rows):
    rows, df = points(spark, n=60, seed=3)

    def process(state, group: pd.DataFrame) -> str:
        return json.dumps((json.loads(state) if state else []) + [int(x) for x in group["seq"]])

    got = {r.video_id: json.loads(r.state) for r in carry_chunks(df, K, "t", ["seq"], process, chunk_rows=chunk_rows).collect()}
    for v in range(3):
        assert got[v] == [i for t, i in sorted((t, i) for a, i, t, _ in rows if a == v)]


def test_range_joins_match_nested_loops(spark):
    rows, a = points(spark, n=60, seed=11)
    other, b = points(spark, n=60, seed=12)
    spans = a.select("video_id", F.col("seq").alias("x"), F.col("t").alias("s"), (F.col("t") + F.col("v")).alias("e"))
    marks = b.select("video_id", F.col("seq").alias("y"), F.col("t").alias("m"), (F.col("t") + 5).alias("n"))
    got = sorted((r.x, r.y) for r in overlap_join(spans, marks, K, (F.col("s"), F.col("e")), (F.col("m"), F.col("n")), bin_sec=9).collect())
    assert got == sorted((i, j) for v, i, t, w in rows for u, j, p, _ in other if u == v and t + w >= p and t <= p + 5)
    near = band_join(spans, marks, K, F.col("s"), F.col("m"), 4, 2, bin_sec=3)
    assert sorted((r.x, r.y) for r in near.collect()) == sorted((i, j) for v, i, t, _ in rows for u, j, p, _ in other if u == v and t - 4 <= p <= t + 2)
    best = {r.x: r.hit for r in nearest_join(spans, marks, K, ["x"], F.col("s"), F.col("m"), ["y"], 2.5, {"hit": "y"}).collect()}
    for v, i, t, _ in rows:
        options = sorted((abs(p - t), j) for u, j, p, _ in other if u == v and abs(p - t) <= 2.5)
        assert best[i] == (options[0][1] if options else None)
