"""Hard negatives against all pairs in plain Python."""
import math

import numpy as np
import pytest
from conftest_llm import key
from pyspark.sql import functions as F

from tideline.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int, id bigint, row string, anchor int"


def brute(rows, is_anchor, positives=5, negatives=5, low=80, scale=256):
    good = [
        (i, lab, [math.floor(float(np.float32(x)) * scale) for x in v]) for i, v, lab, *_ in rows
        if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for at, (i, lab, v) in enumerate(good):
        if not is_anchor(i):
            continue
        others = sorted((-sum(a * b for a, b in zip(v, w)), j, k, other) for k, (j, other, w) in enumerate(good) if k != at and len(w) == len(v))
        for minus, j, _, _ in [o for o in others if o[3] == lab][:positives]:
            window = [o for o in others if o[3] != lab and low * -minus <= 100 * -o[0] <= 100 * -minus][:negatives]
            out += [(i, j, rank, o[1], -minus, -o[0]) for rank, o in enumerate(window, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "r", None) for i, v, lab in rows], SCHEMA)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((4, 8))
    rows = [(k, [float(x) for x in np.float32(0.1 * (centres[k % 4] + 0.4 * rng.standard_normal(8)))], int(rng.integers(0, 3))) for k in range(400)]
    rows += [(400 + k, rows[10][1], k % 3) for k in range(12)]  # ties of every label
    rows += [(500, [1.0, 2.0], 0), (501, [1.0, 1.5], 0), (502, [1.0, 1.4], 1), (503, [], 0), (504, [], 1), (505, [], 0), (510, [0.0] * 8, 1), (511, [0.0] * 8, 2), (520, [0.0] * 8, 1)]
    rows += [(None, [0.1] * 8, 1), (600, None, 1), (601, [0.1] * 7 + [None], 1), (602, [0.1] * 7 + [float("nan")], 1), (603, [float("inf")] + [0.1] * 7, 1), (604, [0.1] * 8, None), (-20, [0.2] * 8, 2)]
    return rows


@pytest.mark.parametrize("rows_of_block, anchors_of_block", [(4096, 4096), (37, 5)])
def test_equals_all_pairs(spark, vectors, rows_of_block, anchors_of_block):
    df = hn.hard_negatives(table(spark, vectors), F.col("vec_id") % 10 == 0, rows_of_block=rows_of_block, anchors_of_block=anchors_of_block)
    want = brute(vectors, lambda i: i % 10 == 0)
    assert got(df) == want and len(want) > 300


def test_other_parameters(spark, vectors):
    df = hn.hard_negatives(table(spark, vectors), F.col("vec_id") % 30 == 0, positives=2, negatives=9, low=95, scale=1000, rows_of_block=50)
    assert got(df) == brute(vectors, lambda i: i % 30 == 0, 2, 9, 95, 1000)
    with pytest.raises(ValueError):
        hn.hard_negatives(table(spark, vectors), F.lit(True), low=120)


def test_equal_ids_and_copies_are_rows_of_their_own(spark):
    rows = [(10, [0.5, 0.5], 1), (10, [0.5, 0.5], 1), (3, [0.5, 0.5], 2), (3, [0.5, 0.45], 2), (4, [0.4, 0.4], 1)]
    assert got(hn.hard_negatives(table(spark, rows), F.col("vec_id") == 10)) == brute(rows, lambda i: i == 10)


def test_empty_tables_and_no_anchors(spark, vectors):
    assert got(hn.hard_negatives(table(spark, []), F.col("vec_id") % 10 == 0)) == []
    assert got(hn.hard_negatives(table(spark, vectors), F.lit(None).cast("boolean"))) == []
    assert got(hn.hard_negatives(table(spark, [(10, None, None)]), F.lit(True))) == []


def test_hot_label_and_many_equal_vectors(spark):
    rows = [(k, [0.5, 0.25, 0.125], 0 if k % 3 else 1) for k in range(1500)]
    df = hn.hard_negatives(table(spark, rows), F.col("vec_id") % 100 == 0, rows_of_block=100)
    assert got(df) == brute(rows, lambda i: i % 100 == 0)


def test_numbers_beyond_a_long_stop_there(spark):
    big = [3.0e8] * 3
    rows = [(0, big, 1), (1, big, 1), (2, big, 2), (3, [-x for x in big], 2)]
    out = got(hn.hard_negatives(table(spark, rows), F.col("vec_id") == 0, scale=1 << 20))
    assert out == [(0, 1, 1, 2, 2**63 - 1, 2**63 - 1)]
    rows = [(i, [x / 300 for x in v], lab) for i, v, lab in rows]  # beyond a double, within a long
    assert got(hn.hard_negatives(table(spark, rows), F.col("vec_id") == 0)) == brute(rows, lambda i: i == 0)


def test_windows_read_across_batches():
    import pyarrow as pa

    # anchor, falling, id, positive: scores 10 10 10 9 8 7 | 5 5
    pairs = [(1, ~10, 2, False), (1, ~10, 3, True), (1, ~10, 4, False), (1, ~9, 1, False), (1, ~8, 7, True), (1, ~8, 9, False), (1, ~7, 8, False), (2, ~5, 1, False), (2, ~5, 2, True)]
    batches = [pa.RecordBatch.from_pylist([{"anchor": a, "anchor_id": a * 10, "falling": f, "id": i, "positive": p}]) for a, f, i, p in pairs]
    out = [tuple(r.values()) for b in hn.read_windows(5, 5, 80)(iter(batches)) for r in b.to_pylist()]
    assert sorted(out, key=lambda r: key(*r)) == sorted([
        (10, 3, 1, 2, 10, 10), (10, 3, 2, 4, 10, 10), (10, 3, 3, 1, 10, 9), (10, 3, 4, 9, 10, 8), (10, 7, 1, 9, 8, 8), (10, 7, 2, 8, 8, 7), (20, 2, 1, 1, 5, 5)])
