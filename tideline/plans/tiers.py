"""Which stage a changed setting forces to run again."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_hash(*cols: Column) -> Column:
    """First sixteen hex digits of the SHA-256 of the JSON form."""
    return F.substring(F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256), 1, 16)


def with_hashes(settings: DataFrame, stages: list[tuple[str, list[str]]], key: str) -> DataFrame:
    """One hash per stage; each includes the hash of the stage before, so a change cascades."""
    out = settings
    before: str | None = None
    for name, columns in stages:
        cols = [F.col(c) for c in columns] + ([F.col(f"{before}_hash")] if before else [])
        out = out.withColumn(f"{name}_hash", stable_hash(*cols))
        before = name
    return out.select(key, *[f"{n}_hash" for n, _ in stages])


def tier_of(current: DataFrame, previous: DataFrame, key: str, stages: list[str]) -> DataFrame:
    """The first stage whose hash differs from the stored one; ``full`` for the first stage or a new row, else ``noop``."""
    old = previous.select(key, *[F.col(f"{s}_hash").alias(f"_{s}") for s in stages])
    rows = current.join(old, key, "left")
    tier = F.lit("noop")
    for s in reversed(stages):
        name = "full" if s == stages[0] else s
        tier = F.when(~F.col(f"{s}_hash").eqNullSafe(F.col(f"_{s}")), name).otherwise(tier)
    return rows.select(key, *[f"{s}_hash" for s in stages], tier.alias("tier"))
