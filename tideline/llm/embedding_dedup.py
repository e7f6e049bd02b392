"""Embedding near-duplicates: sign hashing by random hyperplanes in several tables, exact cosines, connected components.

Equal vectors count once, with their number. In each table a vector falls into the bucket of its signs. A bucket's vectors
are compared in one task, a crowded bucket's as pairs of tiles in several; a pair that an earlier table brings together too
is left to that table, so links are counted without being listed. Tasks return per vector the number of its links and one
link towards the smallest vector that it reached there. Buckets have no limit, so a link is missed only if its vectors share
no bucket; the number of tables follows from ``RECALL`` at the least cosine.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import stash
from tideline.llm.components import components, roots

COSINE, RECALL = 0.9, 0.995
#: Vectors that a bucket has on average if signs were even, and vectors of a tile.
BUCKET, TILE = 256, 2048
SEED = 20


def plan_tables(rows: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a table, and tables so that two vectors of that cosine share a bucket with probability ``recall``."""
    bits = min(24, max(4, round(math.log2(max(rows, 1) / BUCKET)) if rows else 4))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def unit_rows(vectors: list[list[float] | None]) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sign_codes(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """A bucket number per vector and table."""
    planes = np.random.default_rng([SEED, unit.shape[1]]).standard_normal((bits * tables, unit.shape[1]))
    signs = (unit @ planes.T > 0).reshape(len(unit), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def compare(unit: np.ndarray, codes: np.ndarray, table: int, split: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked vectors, the first before the second, that no earlier table brings together.

    All vectors are compared with each other if ``split`` is 0, else the first ``split`` with the others."""
    firsts, seconds = [], []
    for at in range(0, split or len(unit), 512):
        upto = min(at + 512, split or len(unit))
        begin = split or at
        a, b = np.nonzero(unit[at:upto] @ unit[begin:].T >= cosine)
        a, b = a + at, b + begin
        a, b = a[a < b], b[a < b]
        fresh = np.ones(len(a), dtype=bool)
        for earlier in range(table):
            fresh &= codes[a, earlier] != codes[b, earlier]
        firsts.append(a[fresh])
        seconds.append(b[fresh])
    return np.concatenate(firsts), np.concatenate(seconds)


def embedding_groups(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """The id, ``n_links`` and ``component_id`` of every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, vectors of different sizes
    not with each other; such a row is its own component. Rows that share an id are one node of the graph, but each is a
    vector of its own for ``n_links``; null ids are kept, link with nothing and have no component. Other columns are not looked
    at; an empty table gives an empty table.
    """
    x = F.col("x")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    sound = F.col("id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, finite) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.transform(vector_col, lambda v: v.cast("double")).alias("x")).select("id", F.when(F.coalesce(sound, F.lit(False)), x).alias("x"))
    distinct = stash(rows.filter(x.isNotNull()).groupBy("x").agg(F.min("id").alias("node"), F.count("*").alias("copies")))
    bits, tables = plan_tables(distinct.count(), cosine, recall)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = batch.column(0).to_pylist()
            sizes = np.array([len(v) for v in plain], dtype=np.int64)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                codes = sign_codes(unit_rows([plain[k] for k in own]), bits, tables)
                taken = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(codes.tolist(), type=pa.list_(pa.int32()))], names=["x", "node", "copies", "codes"])

    coded = distinct.select("x", "node", "copies").mapInArrow(hashed, "x array<double>, node bigint, copies bigint, codes array<int>")
    in_tables = coded.select("x", "node", "copies", "codes", F.posexplode("codes").alias("tab", "code")).withColumn("dims", F.size("x"))
    key = ["dims", "tab", "code"]
    crowded = stash(coded.select(F.size("x").alias("dims"), F.posexplode("codes").alias("tab", "code")).groupBy(*key).count().filter(F.col("count") > tile).select(*key, F.ceil(F.col("count") / tile).cast("int").alias("tiles")))
    placed = in_tables.withColumn("first", F.lit(0)).withColumn("second", F.lit(0)).withColumn("own", F.lit(0))
    if crowded.limit(1).count():
        own = F.when(F.col("tiles").isNull(), 0).otherwise(F.pmod(F.xxhash64("node", "x"), F.col("tiles")).cast("int"))
        others = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("tiles") - 1, F.lit(0))))
        placed = (
            in_tables.join(crowded, key, "left").withColumn("own", own).withColumn("other", others)
            .withColumn("first", F.least("own", "other")).withColumn("second", F.greatest("own", "other"))
        )

    def links(group: pa.Table) -> pa.Table:
        order = np.argsort(group["own"].to_numpy() != group["first"].to_numpy(), kind="stable")
        group = group.take(pa.array(order))
        split = int((group["own"].to_numpy() == group["first"].to_numpy()).sum()) if group["first"][0] != group["second"][0] else 0
        size = group["dims"][0].as_py()
        flat = lambda name: group[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(group), -1)
        unit = flat("x").astype(np.float64)
        assert unit.shape[1] == size
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        a, b = compare(unit, flat("codes"), group["tab"][0].as_py(), split, cosine) if split < len(group) else (np.zeros(0, int), np.zeros(0, int))
        node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
        n_links = np.bincount(a, weights=copies[b], minlength=len(node)) + np.bincount(b, weights=copies[a], minlength=len(node))
        by = np.argsort(node, kind="stable")  # so that the first of a component is its smallest node
        back = np.empty(len(by), dtype=np.int64)
        back[by] = np.arange(len(by))
        root = node[by][roots(back[a], back[b], len(node))[back]]
        hit = n_links > 0
        return pa.table({"node": node[hit], "x": group["x"].filter(pa.array(hit)), "n_links": n_links[hit].astype(np.int64), "root": root[hit]})

    found = stash(placed.groupBy(*key, "first", "second").applyInArrow(links, "node bigint, x array<double>, n_links bigint, root bigint"))
    counts = found.groupBy("x").agg(F.sum("n_links").alias("linked"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = distinct.join(counts, "x", "left").join(joined, "node", "left").select(F.col("x").alias("of"), F.coalesce("linked", F.lit(0)).alias("linked"), "copies", F.coalesce("root", "node").alias("component"))
    return rows.join(classes, x == F.col("of"), "left").select(
        F.col("id").alias(id_col), F.coalesce(F.col("linked") + F.col("copies") - 1, F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
