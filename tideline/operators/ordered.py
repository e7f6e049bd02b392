"""Ordered computations along a timeline that never put one recording into one task.

A plain ``Window.partitionBy(video_id)`` sends a whole recording to one task. Here each recording is cut into time
tiles: the window runs inside (recording, tile), one summary row per tile carries the running state across tiles, and
the two are joined. The large table is shuffled once, on (keys, tile); only summaries are shuffled on the bare keys.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.session import settle

TILE = "_tile"
DEFAULT_TILE_SEC = 3600.0


def with_tile(df: DataFrame, t: str, tile: float = DEFAULT_TILE_SEC) -> DataFrame:
    return df.withColumn(TILE, F.floor(F.col(t) / F.lit(float(tile))))


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    tie: Sequence[str] = (),
    *,
    tile: float = DEFAULT_TILE_SEC,
    lag: Mapping[str, str] | None = None,
    lead: Mapping[str, str] | None = None,
    run_sum: Mapping[str, str] | None = None,
    run_max: Mapping[str, str] | None = None,
    fill: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add ordered columns, each mapping new name -> source column.

    ``lag``/``lead`` read the neighbouring row, ``run_sum``/``run_max`` include the current row and ``fill`` carries the
    last non-null value forward. Rows are ordered by ``t`` and then ``tie`` inside ``keys``.
    """
    lag, lead = dict(lag or {}), dict(lead or {})
    run_sum, run_max, fill = dict(run_sum or {}), dict(run_max or {}), dict(fill or {})
    keys = list(keys)
    base = with_tile(df, t, tile)
    inside = W.partitionBy(*keys, TILE).orderBy(t, *tie)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    position = F.struct(t, *tie)

    local, summary, carry, final = {}, [], [], {}
    across = W.partitionBy(*keys).orderBy(TILE)
    before = across.rowsBetween(W.unboundedPreceding, -1)

    if lag:
        source = F.struct(*[F.col(c).alias(n) for n, c in lag.items()])
        local["_l"] = F.lag(source).over(inside)
        summary.append(F.max_by(source, position).alias("_tail"))
        carry.append(F.lag("_tail").over(across).alias("_c_tail"))
        for n in lag:
            final[n] = F.when(F.col("_l").isNull(), F.col(f"_c_tail.{n}")).otherwise(F.col(f"_l.{n}"))
    if lead:
        source = F.struct(*[F.col(c).alias(n) for n, c in lead.items()])
        local["_n"] = F.lead(source).over(inside)
        summary.append(F.min_by(source, position).alias("_head"))
        carry.append(F.lead("_head").over(across).alias("_c_head"))
        for n in lead:
            final[n] = F.when(F.col("_n").isNull(), F.col(f"_c_head.{n}")).otherwise(F.col(f"_n.{n}"))
    for n, c in run_sum.items():
        local[f"_s_{n}"] = F.sum(c).over(upto)
        summary.append(F.sum(c).alias(f"_t_{n}"))
        carry.append(F.sum(f"_t_{n}").over(before).alias(f"_cs_{n}"))
        final[n] = F.col(f"_s_{n}") + F.coalesce(F.col(f"_cs_{n}"), F.lit(0))
    for n, c in run_max.items():
        local[f"_m_{n}"] = F.max(c).over(upto)
        summary.append(F.max(c).alias(f"_t_{n}"))
        carry.append(F.max(f"_t_{n}").over(before).alias(f"_cm_{n}"))
        final[n] = F.greatest(F.col(f"_m_{n}"), F.col(f"_cm_{n}"))
    for n, c in fill.items():
        local[f"_f_{n}"] = F.last(c, ignorenulls=True).over(upto)
        summary.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), position)).alias(f"_t_{n}"))
        carry.append(F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_cf_{n}"))
        final[n] = F.coalesce(F.col(f"_f_{n}"), F.col(f"_cf_{n}"))

    carried = base.groupBy(*keys, TILE).agg(*summary).select(*keys, TILE, *carry)
    joined = base.withColumns(local).join(carried, [*keys, TILE], "left")
    return joined.select(*[c for c in df.columns if c not in final], *[e.alias(n) for n, e in final.items()])


def gap_sessions(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    gap: float,
    tie: Sequence[str] = (),
    *,
    out: str = "session_start",
    end: str | None = None,
    strict: bool = False,
    tile: float = DEFAULT_TILE_SEC,
) -> DataFrame:
    """Label each row with the first time of its session; a session ends where the gap exceeds ``gap``.

    ``end`` names the column the gap is measured from (default: ``t`` of the previous row). With ``strict`` a gap equal
    to ``gap`` already splits. The label is unique per key because a later session always starts later.
    """
    step = ordered(df, keys, t, tie, tile=tile, lag={"_prev": end or t})
    distance = F.col(t) - F.col("_prev")
    split = (distance >= F.lit(gap)) if strict else (distance > F.lit(gap))
    step = step.withColumn("_open", F.when(F.col("_prev").isNull() | split, F.col(t)))
    return ordered(step, keys, t, tie, tile=tile, fill={out: "_open"}).drop("_prev", "_open")


def with_halo(df: DataFrame, t: str, reach: float, tile: float = DEFAULT_TILE_SEC) -> DataFrame:
    """Copy rows that lie within ``reach`` of a tile edge into the neighbouring tile, marked ``_home = false``.

    A frame of at most ``reach`` to either side, partitioned by (keys, tile), then sees all its rows: one shuffle, no
    join. Filter on ``_home`` after the window.
    """
    tile = max(float(tile), 2.0 * float(reach))
    home = F.floor(F.col(t) / F.lit(tile))
    spread = F.sequence(F.floor((F.col(t) - F.lit(float(reach))) / F.lit(tile)), F.floor((F.col(t) + F.lit(float(reach))) / F.lit(tile)))
    return df.withColumn("_at", home).withColumn(TILE, F.explode(spread)).withColumn("_home", F.col("_at") == F.col(TILE)).drop("_at")


def windowed(df: DataFrame, keys: Sequence[str], t: str, reach: float, tie: Sequence[str], exprs: Mapping[str, object], tile: float = DEFAULT_TILE_SEC) -> DataFrame:
    """Evaluate window expressions of bounded reach; each value is a function of the (keys, tile) window spec.

    Without ``tie`` the spec is ordered by whole microseconds, so that ``within`` can state a range frame.
    """
    order = [t, *tie] if tie else [F.round(F.col(t) * MICRO).cast("bigint")]
    spec = W.partitionBy(*keys, TILE).orderBy(*order)
    halo = with_halo(df, t, reach, tile)
    return halo.withColumns({n: make(spec) for n, make in exprs.items()}).filter("_home").drop("_home", TILE)


MICRO = 1_000_000


def within(spec, before: float, after: float, strict: bool = False):
    """The rows between ``before`` seconds earlier and ``after`` seconds later, ends included unless ``strict``."""
    less = 1 if strict else 0
    return spec.rangeBetween(less - round(before * MICRO), round(after * MICRO) - less)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows per key. Spark limits each map partition before the shuffle, so hot keys stay small."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def places(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """Number all rows from 1 in ``order`` (unique): range partitions are numbered each on its own, and the sizes of
    those before are added. Range bounds are sampled, so the partitions are written once."""
    cut = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part")) - F.col("_n")  # a row per partition
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return cut.withColumn(name, inside).join(sizes.select("_part", before.alias("_before")), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")
