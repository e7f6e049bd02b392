"""Connected components of links between numbers, in rounds that at least halve what is left."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import stash


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each of the nodes 0 to n - 1's component under links a - b."""
    label = np.arange(n)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = low < high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]
    return label


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest of its component, which join the same nodes as the links given."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    to = roots(at[:len(a)], at[len(a):], len(nodes))
    loose = to != np.arange(len(nodes))
    return nodes[loose], nodes[to[loose]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links, replaced by a forest of the same components; never more rows than it had nodes."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a, b = forest(np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()]))
    yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, of every node that ``links`` (columns a, b, longs) mention.

    Each round points every node at its smallest neighbour, follows the pointers to their ends and keeps links between
    different ends only. Nulls and links of a node with itself are left out. Every table is written before it is read twice.
    """
    left = stash(links.select("a", "b").filter("a <> b").mapInArrow(_local, "a bigint, b bigint").distinct())
    known = None
    while left.limit(1).count():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")))
        while True:
            step = stash(to.alias("x").join(to.select(F.col("node").alias("via"), F.col("root").alias("next")), F.col("root") == F.col("via")).select("node", F.col("next").alias("root"), (F.col("root") != F.col("next")).alias("moved")))
            to = step.select("node", "root")
            if not step.filter("moved").limit(1).count():
                break
        ends = lambda side: to.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
        left = stash(
            left.join(ends("a"), "a").join(ends("b"), "b").filter("a_root <> b_root")
            .select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).mapInArrow(_local, "a bigint, b bigint").distinct()
        )
        if known is None:
            known = to
        else:
            known = stash(known.join(to.select(F.col("node").alias("via"), F.col("root").alias("next")), F.col("root") == F.col("via"), "left").select("node", F.coalesce("next", "root").alias("root")))
    return known if known is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
