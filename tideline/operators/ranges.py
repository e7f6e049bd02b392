"""Interval and nearest-time joins, always as equi-joins on (keys, time bin)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_BIN_SEC = 60.0


def _bins(low: Column, high: Column, width: float) -> tuple[Column, Column]:
    return F.floor(low / F.lit(float(width))), F.floor(high / F.lit(float(width)))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[Column, Column],
    right_span: tuple[Column, Column],
    *,
    how: str = "inner",
    bin_sec: float = DEFAULT_BIN_SEC,
) -> DataFrame:
    """Pairs whose closed intervals meet. Column names other than ``keys`` must differ between the sides.

    Each interval is listed under the bins it touches; a pair is emitted only in the first bin both share, so no
    de-duplication shuffle is needed. ``left_semi`` and ``left_anti`` are answered on distinct left rows.
    """
    l0, l1 = _bins(*left_span, bin_sec)
    r0, r1 = _bins(*right_span, bin_sec)
    lhs = left.withColumns({"_ls": left_span[0], "_le": left_span[1], "_l0": l0}).withColumn("_bin", F.explode(F.sequence(l0, F.greatest(l0, l1))))
    rhs = right.withColumns({"_rs": right_span[0], "_re": right_span[1], "_r0": r0}).withColumn("_bin", F.explode(F.sequence(r0, F.greatest(r0, r1))))
    rhs = rhs.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in rhs.columns if c != "_bin"], F.col("_bin").alias("_rbin"))
    on = (F.col("_bin") == F.col("_rbin")) & (F.col("_le") >= F.col("_rs")) & (F.col("_ls") <= F.col("_re"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    if how == "inner":
        on = on & (F.col("_bin") == F.greatest("_l0", "_r0"))
        out = lhs.join(rhs, on, "inner")
        return out.drop("_ls", "_le", "_l0", "_bin", "_rs", "_re", "_r0", "_rbin", *[f"_k_{k}" for k in keys])
    if how == "left_semi":
        return lhs.join(rhs, on, "left_semi").select(*left.columns).distinct()
    raise ValueError(how)


def reach_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[Column, Column],
    right_span: tuple[Column, Column],
    tile: str,
    most: float,
    *,
    tile_sec: float = DEFAULT_BIN_SEC,
) -> DataFrame:
    """Left rows with the right rows whose closed intervals meet theirs; a left row without any comes once, with nulls.

    ``tile`` names the column with the number of the tile of ``tile_sec`` in which a left interval begins; left intervals last ``most``
    seconds at most. Only right rows are copied, so all pairs of a left row are where (keys, tile) was dealt: what is
    then grouped by these columns and more is not shuffled again. Column names other than ``keys`` must differ between the sides."""
    first, last = _bins(right_span[0] - F.lit(float(most)), right_span[1], tile_sec)
    rhs = right.withColumns({"_rs": right_span[0], "_re": right_span[1], "_rtile": F.explode(F.sequence(first, F.greatest(first, last)))})
    rhs = rhs.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in rhs.columns])
    on = (F.col(tile) == F.col("_rtile")) & (left_span[1] >= F.col("_rs")) & (left_span[0] <= F.col("_re"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    return left.join(rhs, on, "left").drop("_rs", "_re", "_rtile", *[f"_k_{k}" for k in keys])


def band_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    at: Column,
    right_at: Column,
    before: float,
    after: float,
    *,
    bin_sec: float = DEFAULT_BIN_SEC,
) -> DataFrame:
    """Pairs with ``right_at`` in [at - before, at + after]; only the left side is copied, to at most a few bins."""
    width = max(float(bin_sec), before + after)
    low, high = at - F.lit(float(before)), at + F.lit(float(after))
    l0, l1 = _bins(low, high, width)
    lhs = left.withColumns({"_lo": low, "_hi": high}).withColumn("_bin", F.explode(F.sequence(l0, l1)))
    rhs = right.withColumns({"_rt": right_at, "_rbin": F.floor(right_at / F.lit(width))})
    rhs = rhs.select(*[F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in rhs.columns])
    on = (F.col("_bin") == F.col("_rbin")) & (F.col("_rt") >= F.col("_lo")) & (F.col("_rt") <= F.col("_hi"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    return lhs.join(rhs, on, "inner").drop("_lo", "_hi", "_bin", "_rbin", "_rt", *[f"_k_{k}" for k in keys])


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_id: Sequence[str],
    at: Column,
    right_at: Column,
    tie: Sequence[str],
    max_dist: float,
    pick: dict[str, str],
    *,
    bin_sec: float = DEFAULT_BIN_SEC,
) -> DataFrame:
    """Left rows with the nearest right row within ``max_dist`` (earliest ``tie`` on equal distance), else nulls.

    ``pick`` maps output names to right columns; ``distance`` is added. The band join feeds a partial ``min_by``, so
    pairs collapse before the shuffle.
    """
    slim = left.select(*keys, *left_id, at.alias("_a"))
    other = right.select(*keys, right_at.alias("_b"), *[F.col(c).alias(f"_t_{c}") for c in tie], *[F.col(c).alias(f"_p_{n}") for n, c in pick.items()])
    pairs = band_join(slim, other, keys, F.col("_a"), F.col("_b"), max_dist, max_dist, bin_sec=bin_sec)
    gap = F.abs(F.col("_b") - F.col("_a"))
    best = pairs.filter(gap <= max_dist).groupBy(*keys, *left_id).agg(
        F.min_by(F.struct(gap.alias("distance"), *[F.col(f"_p_{n}").alias(n) for n in pick]), F.struct(gap, *[f"_t_{c}" for c in tie])).alias("_best"))
    return left.join(best, [*keys, *left_id], "left").select(*left.columns, "_best.*")
