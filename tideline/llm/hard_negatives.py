"""Hard negatives: rows of another label that score almost as high for an anchor as rows of its own label.

A secondary sort finds them. Pairs of anchor and row travel under the key (anchor, descending score, id); partitions hold whole
anchors, sorted, and one pass over a partition opens a window at each positive and emits the negatives that follow while they
fall into open windows. Of an anchor it holds its open windows and the few negatives tied with the present score, no more.

Most pairs can be left out before the shuffle. Blocks of anchors meet blocks of rows; a first pass keeps a block's best rows of
the anchor's label, which settles the positives, a second one keeps the first rows that each positive's window finds in the
block. Both prunings are exact, and what is sorted grows with anchors times blocks instead of anchors times rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import stash

#: Positives of an anchor, negatives of a positive, and the least negative score in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW = 5, 5, 80
#: What components are multiplied by before they are rounded down.
SCALE = 256
#: Rows and anchors of a block, and scores that a task holds at once.
ROWS, ANCHORS, HELD = 4096, 4096, 1 << 19
_LONG = np.iinfo(np.int64)
_OUT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows; beyond a long they stop at its limits."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    most = [max(int(x.max()), -int(x.min())) for x in (a, b)]
    if most[0] * most[1] * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), _LONG.min, _LONG.max).astype(np.int64)


def least_score(positive: int, low: int = LOW) -> int:
    """The least whole score that is ``low`` hundredths of the positive's score."""
    return -(-low * positive // 100)


def first_of(scores: np.ndarray, may: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Line and column of the first ``most`` allowed columns of each line, by falling score and then by column."""
    falling = np.where(may, ~scores, _LONG.max)
    if scores.shape[1] > most:
        may = may & (falling <= np.partition(falling, most - 1, axis=1)[:, most - 1:most])
    line, column = np.nonzero(may)
    order = np.lexsort((column, falling[line, column], line))
    line, column = line[order], column[order]
    nth = np.arange(len(line)) - np.searchsorted(line, line)
    return line[nth < most], column[nth < most]


def _matrix(t: pa.Table, name: str = "q") -> np.ndarray:
    return t[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1) if len(t) else np.zeros((0, 0), np.int64)


def _pairs(anchors: pa.Table, rows: pa.Table, chosen: list[tuple[np.ndarray, np.ndarray]], scores: list[np.ndarray], positive: bool) -> pa.Table:
    line, column = (np.concatenate([c[k] for c in chosen] or [np.zeros(0, np.int64)]) for k in (0, 1))
    got = np.concatenate(scores or [np.zeros(0, np.int64)])
    take = lambda t, name, at: t[name].combine_chunks().take(pa.array(at))
    return pa.table({
        "anchor": take(anchors, "row", line), "anchor_id": take(anchors, "id", line), "falling": pa.array(~got), "id": take(rows, "id", column),
        "row": take(rows, "row", column), "positive": pa.array(np.full(len(got), positive)),
    })


_PAIR = "anchor bigint, anchor_id bigint, falling bigint, id bigint, row bigint, positive boolean"


def _chunks(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[slice, np.ndarray]]:
    """Scores of some anchors of a block at a time."""
    a, b = _matrix(anchors), _matrix(rows)
    step = max(1, HELD // max(1, len(rows)))
    for at in range(0, len(anchors), step):
        yield slice(at, at + step), inner_products(a[at:at + step], b)


def best_positives(most: int):
    """For a block of anchors and a block of rows: each anchor's first ``most`` other rows of its label."""

    def of(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])
        label, row = rows["label"].to_numpy(), rows["row"].to_numpy()
        chosen, got = [], []
        for part, scores in _chunks(anchors, rows):
            may = (anchors["label"].to_numpy()[part, None] == label) & (anchors["row"].to_numpy()[part, None] != row)
            line, column = first_of(scores, may, most)
            chosen.append((line + part.start, column))
            got.append(scores[line, column])
        return _pairs(anchors, rows, chosen, got, True)

    return of


def windowed_negatives(most: int, low: int):
    """For a block of anchors with the scores of their positives and a block of rows: the first ``most`` rows of another label in
    each positive's window, named once per anchor."""

    def of(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])
        label = rows["label"].to_numpy()
        lists = anchors["positive_scores"].to_pylist()
        deep = max(map(len, lists), default=0)
        chosen, got = [], []
        for part, scores in _chunks(anchors, rows):
            other = anchors["label"].to_numpy()[part, None] != label
            hit = np.zeros(scores.shape, dtype=bool)
            for k in range(deep):
                high = np.array([v[k] if k < len(v) else _LONG.min for v in lists[part]], dtype=np.int64)
                least = np.array([least_score(v[k], low) if k < len(v) else _LONG.max for v in lists[part]], dtype=np.int64)
                line, column = first_of(scores, other & (scores <= high[:, None]) & (scores >= least[:, None]), most)
                hit[line, column] = True
            line, column = np.nonzero(hit)
            chosen.append((line + part.start, column))
            got.append(scores[line, column])
        return _pairs(anchors, rows, chosen, got, False)

    return of


def read_windows(positives: int, negatives: int, low: int):
    """One pass over pairs sorted by (anchor, falling score, id): the negatives of each positive, in order."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, score, opened = None, None, 0
        tied: list[int] = []  # the first negatives of the present score
        windows: list[list] = []  # positive id, its score, least score, negatives so far
        for batch in batches:
            out = []
            for a, anchor_id, falling, i, positive in zip(*(batch[name].to_pylist() for name in ("anchor", "anchor_id", "falling", "id", "positive"))):
                if a != anchor:
                    anchor, score, opened, tied, windows = a, None, 0, [], []
                if ~falling != score:
                    score, tied = ~falling, []
                    windows = [w for w in windows if w[2] <= score and w[3] < negatives]
                if positive:
                    opened += 1
                    least = least_score(score, low)
                    if opened > positives or least > score:
                        continue
                    windows.append([i, score, least, len(tied)])
                    out += [(anchor_id, i, k, n, score, score) for k, n in enumerate(tied, 1)]
                    continue
                if len(tied) < negatives:
                    tied.append(i)
                for w in windows:
                    if w[3] < negatives:
                        w[3] += 1
                        out.append((anchor_id, w[0], w[3], i, w[1], score))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = [part.split()[0] for part in _OUT.split(", ")]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), kinds)], names=names)

    return of


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, scale: int = SCALE, rows_of_block: int = ROWS, anchors_of_block: int = ANCHORS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    An anchor is a row for which ``is_anchor`` holds. Its positives are its first other rows of the same label, the negatives of
    a positive the first rows of another label whose score is at most the positive's and at least ``low`` hundredths of it; rows
    come by falling score, then by id. A score is the inner product of components floor(``scale`` * x). Positives below zero have
    no negatives.

    Rows with a null id, label or vector, or any null or non-finite component take no part. Rows that share an id are rows of
    their own, so a copy of an anchor may be its positive. Vectors of different sizes don't meet; those of size zero score zero
    with each other. Numbers beyond a long stop at its limits. Other columns are not looked at. An empty table, or one without
    anchors, gives an empty table.
    """
    if not 0 <= low <= 100:
        raise ValueError("low: hundredths of the positive's score, 0 to 100")
    x = F.col("x")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    given = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("bigint").alias("label"),
        F.transform(vector_col, lambda v: v.cast("double")).alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.coalesce(F.forall(x, finite), F.lit(False))
    rows = stash(given.filter(sound).select(
        "id", "label", "anchor", F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).alias("q"), F.size(x).alias("dims"), F.monotonically_increasing_id().alias("row")))
    size = rows.agg(F.count("*").alias("all"), F.count(F.when(F.col("anchor"), 1)).alias("anchors")).first()
    row_blocks, anchor_blocks = max(1, -(-size["all"] // rows_of_block)), max(1, -(-size["anchors"] // anchors_of_block))

    block = lambda name, n: F.pmod(F.xxhash64(F.col("row")), F.lit(n)).cast("int").alias(name)
    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    key = ["dims", "anchor_block", "row_block"]
    dealt = rows.select("dims", "id", "row", "label", "q", block("row_block", row_blocks), every("anchor_block", anchor_blocks))
    anchors = rows.filter("anchor").select("dims", "id", "row", "label", "q", block("anchor_block", anchor_blocks))

    def meet(asking: DataFrame, task) -> DataFrame:
        there = asking.toDF(*asking.columns).select("*", every("row_block", row_blocks))  # renamed, so that both sides differ in name
        return there.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(task, _PAIR)

    order = ["falling", "id", "row"]
    first = F.row_number().over(Window.partitionBy("anchor").orderBy(*order))
    best = stash(meet(anchors, best_positives(positives)).withColumn("nth", first).filter(F.col("nth") <= positives).drop("nth"))
    asked = best.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.bitwise_not("falling")).alias("positive_scores"))
    found = meet(anchors.join(asked, "row"), windowed_negatives(negatives, low))
    return best.union(found).repartition("anchor").sortWithinPartitions("anchor", *order).mapInArrow(read_windows(positives, negatives, low), _OUT)
