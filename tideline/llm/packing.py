"""Packing of tokenised documents into sequences of at most 1024 tokens by patterns of lengths.

Only the histogram of piece lengths (at most 1024 numbers) reaches the driver. There, patterns of two and three lengths that
fill a sequence exactly are enumerated, their repeat counts fitted to the histogram by non-negative least squares and rounded
down, and what is left packed by best fit, again on the histogram. Pieces are ranked within their length by Spark; length and
rank name the pattern, the repetition and the place.
"""
from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tideline.llm.bpe_words import WordTable, encode_texts, encode_words
from tideline.llm.common import pieces, stash

CAPACITY, END_ID = 1024, 2
#: Gradient steps of the least squares fit.
STEPS = 400
#: Pieces of one length are ranked in groups of about so many rows; at least LEAST_SALTS groups.
RANK_ROWS, LEAST_SALTS = 100_000, 64
#: Pre-tokens whose ids a task remembers, and characters of text that it has in hand at once.
CACHE, PIECE = 120_000, 1 << 20


@functools.lru_cache(2)
def _ids(path: str) -> WordTable:
    return WordTable(functools.partial(encode_words, path), np.uint32, CACHE)


def token_pieces(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Rows of pieces: id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit integers).

    A document is its ids and ``end_id``. One longer than ``capacity`` is cut so that all pieces but the first are full."""
    id_field = docs.schema[id_col]
    schema = T.StructType([T.StructField(id_col, id_field.dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())] + [T.StructField("ids", T.BinaryType())] * keep_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, done = batch.column(0), 0
            for texts in pieces((t.as_py() for t in batch.column(1)), PIECE):
                ids, counts = encode_texts(texts, path, _ids(path))
                owner, rows, blobs = [], [], []
                for k, own in enumerate(np.split(ids, np.cumsum(counts)[:-1])):
                    raw = memoryview(np.append(own, np.uint32(end_id)).astype("<u4").tobytes())
                    n = len(own) + 1
                    first = n % capacity or capacity
                    bounds = [0, *range(first, n + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                        owner.append(done + k)
                        rows.append((piece, a, b - a, zlib.crc32(raw[4 * a:4 * b])))
                        if keep_ids:
                            blobs.append(bytes(raw[4 * a:4 * b]))
                done += len(texts)
                columns = np.array(rows, dtype=np.int64).reshape(-1, 4)
                arrays = [keys.take(pa.array(owner, type=pa.int64())), pa.array(columns[:, 0].astype(np.int32)), *(pa.array(columns[:, i]) for i in (1, 2, 3))]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(blobs, type=pa.binary())] * keep_ids, names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(cut, schema)


def exact_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three ascending lengths (0: none) that occur and sum to the capacity."""
    have = np.zeros(capacity + 1, dtype=bool)
    have[lengths] = True
    have[0] = True
    a, b = (x.ravel() for x in np.meshgrid(np.flatnonzero(have), np.flatnonzero(have), indexing="ij"))
    c = capacity - a - b
    good = (a <= b) & (b <= c) & (c < capacity)
    good[good] &= have[c[good]]
    return np.stack([a, b, c], axis=1)[good]


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that minimise the squared distance of their lengths to the histogram,
    by accelerated projected gradient steps."""
    size = len(histogram)
    weights = (patterns > 0).astype(np.float64)
    apply = lambda x: np.bincount(patterns.ravel(), weights=(x[:, None] * weights).ravel(), minlength=size)
    back = lambda r: (r[patterns] * weights).sum(axis=1)
    probe = np.ones(len(patterns))
    for _ in range(20):  # largest eigenvalue
        probe = back(apply(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    rate, x, y, t = 1 / (1.05 * norm), np.zeros(len(patterns)), np.zeros(len(patterns)), 1.0
    for _ in range(steps):
        new = np.maximum(0, y - rate * back(apply(y) - histogram))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (before - 1) / t * (new - x)
        x = new
    return x


def best_fill(left: np.ndarray, capacity: int) -> list[int]:
    """The longest length left, and ones that fill the rest best, two at a time."""
    have = np.flatnonzero(left)
    row = [int(have[-1])]
    spare = left.copy()
    spare[row[0]] -= 1
    gap = capacity - row[0]
    while gap and (fits := np.flatnonzero(spare[:gap + 1])).size:
        # The largest length that is left up to each size, and so the best partner of each.
        upto = np.maximum.accumulate(np.where(spare[:gap + 1] > 0, np.arange(gap + 1), 0))
        partner = upto[gap - fits]
        lone = (partner == fits) & (spare[fits] < 2)
        partner[lone] = np.where(fits[lone] > 0, upto[np.maximum(np.minimum(fits[lone] - 1, gap - fits[lone]), 0)], 0)
        best = int(np.argmax((fits + partner) * (capacity + 1) + fits))
        for n in (int(fits[best]), int(partner[best])):
            if n:
                row.append(n)
                spare[n] -= 1
                gap -= n
    return row


def plan_patterns(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns of lengths and their repeat counts that use up the histogram (counts by length, from 0 to the capacity)."""
    left, plan = histogram.astype(np.int64).copy(), []
    left[0] = 0

    def use(row: list[int], most: int) -> None:
        need = np.bincount(row, minlength=capacity + 1)
        times = int(min(most, (left[need > 0] // need[need > 0]).min()))
        if times > 0:
            plan.append((row, times))
            left[:] -= times * need

    use([capacity], int(left[capacity])) if left[capacity] else None
    lengths = np.flatnonzero(left)
    if len(lengths) and len(patterns := exact_patterns(lengths, capacity)):
        repeats = np.floor(fit_repeats(patterns, left.astype(np.float64)) + 1e-6)
        for k in np.argsort(-repeats, kind="stable")[:np.count_nonzero(repeats)]:
            use([int(n) for n in patterns[k][::-1] if n], int(repeats[k]))
    while left.any():
        use(best_fill(left, capacity), int(left.max()))
    return plan


@dataclass(frozen=True)
class Slots:
    """Runs of slots: length and first rank in one number, ascending; the sequence of the first, and the offset within sequences."""
    firsts: np.ndarray
    sequences: np.ndarray
    offsets: np.ndarray

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.firsts, (lengths << 44) + ranks, side="right") - 1
        return self.sequences[at] + ranks - (self.firsts[at] - (lengths << 44)), self.offsets[at]


def slots(plan: list[tuple[list[int], int]]) -> Slots:
    used: dict[int, int] = {}
    runs, sequence = [], 0
    for row, times in plan:
        offset = 0
        for n in row:
            first = used.get(n, 0)
            runs.append(((n << 44) + first, sequence, offset))
            used[n] = first + times
            offset += n
        sequence += times
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 3)
    return Slots(table[:, 0], table[:, 1], table[:, 2])


def pack(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``: columns of ``token_pieces`` and these two.

    Null and empty texts are documents of one token, the end. Rows with equal ids are packed one by one; which of equal pieces
    gets which place is arbitrary. Other columns are not looked at; an empty table gives an empty table.
    """
    cut = stash(token_pieces(docs, path, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id, keep_ids=keep_ids))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in cut.groupBy("length").count().collect():  # at most ``capacity`` rows
        histogram[row["length"]] = row["count"]
    places = slots(plan_patterns(histogram, capacity))
    salts = max(LEAST_SALTS, int(histogram.max()) // RANK_ROWS + 1)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.select(F.col("length").alias("of"), F.col("salt").alias("by"), (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("place", F.row_number().over(Window.partitionBy("length", "salt").orderBy(id_col, "piece", "ids_crc32")))

    @arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def slot(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        found = places.find(lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(x, type=pa.int64()) for x in found], names=["sequence_id", "offset"])

    joined = ranked.join(before, (F.col("length") == F.col("of")) & (F.col("salt") == F.col("by")))
    return joined.withColumn("slot", slot(F.col("length"), F.col("before") + F.col("place") - 1)).select(*cut.columns, "slot.sequence_id", "slot.offset")
