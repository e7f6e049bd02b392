"""Choices between whole sets of rows: the first set that qualifies per key, and sources that count only while more is wanted."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_qualifying(sets: Sequence[tuple[str, DataFrame, int]], keys: Sequence[str], name: str = "rung") -> DataFrame:
    """Of several candidate sets per key the first one that has at least its number of rows there, as a whole.

    ``sets``: name, rows with equal columns, least number. All sets travel in one shuffle on ``keys``; counting and choosing are
    windows on that partitioning."""
    every = None
    for place, (label, rows, least) in enumerate(sets):
        one = rows.withColumns({name: F.lit(label), "_place": F.lit(place), "_least": F.lit(least)})
        every = one if every is None else every.unionByName(one)
    counted = every.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys, "_place")))
    chosen = F.min(F.when(F.col("_n") >= F.col("_least"), F.col("_place"))).over(W.partitionBy(*keys))
    return counted.withColumn("_chosen", chosen).filter(F.col("_place") == F.col("_chosen")).drop("_place", "_least", "_n", "_chosen")


def until_enough(sources: Sequence[tuple[str, DataFrame, Column | None]], keys: Sequence[str], same: Sequence[Column], order: Sequence[Column], facts: DataFrame, name: str = "source") -> DataFrame:
    """Rows of several sources in turn; what a key has from the sources before decides whether the next one counts there.

    ``sources``: name, rows with equal columns, and the condition under which the source counts, over the columns of ``facts`` (a
    row per key; nulls where there is none) and ``have``, the rows kept so far. Of rows of one source that agree in ``same`` the first
    in ``order`` is kept. ``facts`` and the counts are a row per key, so a source is shuffled once, for ``same``."""
    out = None
    for label, rows, counts in sources:
        one = rows
        if counts is not None:
            have = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("have")) if out is not None else None
            state = facts if have is None else facts.join(have, list(keys), "full")
            known = [c for c in state.columns if c not in keys]
            zero = F.coalesce(F.col("have"), F.lit(0)) if "have" in known else F.lit(0)
            state = state.withColumn("have", zero)
            one = rows.join(state, list(keys), "left").withColumn("have", F.coalesce("have", F.lit(0))).filter(counts).select(*rows.columns)
        marks = [c.alias(f"_same{i}") for i, c in enumerate(same)]
        one = one.select("*", *marks)
        first = F.row_number().over(W.partitionBy(*keys, *[f"_same{i}" for i in range(len(same))]).orderBy(*order))
        one = one.withColumn("_nth", first).filter("_nth = 1").drop("_nth", *[f"_same{i}" for i in range(len(same))]).withColumn(name, F.lit(label))
        out = one if out is None else out.unionByName(one)
    return out
