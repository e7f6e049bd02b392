"""Order-dependent scans: each row's state follows from the previous row's state.

Rows are first split into sessions that cannot influence each other. Sessions are cut into pieces of bounded length and
bounded row count, each piece is folded JVM-side, and only if some session needed several pieces is the state carried
from piece to piece until nothing changes. That is exact for any session size and no task ever holds a whole one.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.operators.greedy import TILE_SEC, decide_in_tiles
from tideline.operators.ordered import MICRO, gap_sessions
from tideline.session import settle

PIECE_SEC = 3600.0
PIECE_ROWS = 2048


def _pieces(df: DataFrame, keys: Sequence[str], session: str, t: str, tie: Sequence[str], piece_sec: float, piece_rows: int) -> DataFrame:
    cut = [*keys, session, "_part"]
    numbered = df.withColumn("_part", F.floor((F.col(t) - F.col(session)) / F.lit(float(piece_sec))))
    numbered = numbered.withColumn("_sub", F.floor((F.row_number().over(W.partitionBy(*cut).orderBy(t, *tie)) - 1) / F.lit(piece_rows)))
    rest = [c for c in df.columns if c not in (*keys, session, t, *tie)]
    return numbered.groupBy(*cut, "_sub").agg(F.sort_array(F.collect_list(F.struct(t, *tie, *rest))).alias("_rows"))


def _fold(step: Callable[[Column, Column], Column], ddl: str) -> Column:
    start = F.when(F.col("_entry").isNull(), F.expr(f"cast(array() as array<{ddl}>)")).otherwise(F.array("_entry"))

    def advance(done: Column, row: Column) -> Column:
        return F.concat(done, F.array(step(F.get(done, F.size(done) - 1), row).cast(ddl)))

    states = F.aggregate("_rows", start, advance)
    return F.when(F.col("_entry").isNull(), states).otherwise(F.slice(states, 2, F.size("_rows")))


def scan_sessions(
    df: DataFrame,
    keys: Sequence[str],
    session: str,
    t: str,
    tie: Sequence[str],
    state: str,
    step: Callable[[Column, Column], Column],
    *,
    piece_sec: float = PIECE_SEC,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Run ``step(previous_state, row) -> state`` over each session in order; adds the struct column ``state``.

    ``state`` is the DDL of the state struct. The previous state is null on the first row of a session.
    """
    ids = [*keys, session, "_part", "_sub"]
    pieces = settle(_pieces(df, keys, session, t, tie, piece_sec, piece_rows))
    blank = F.lit(None).cast(state)
    done = pieces.withColumn("_entry", blank).withColumn("_states", _fold(step, state))
    more = settle(pieces.filter("_part > 0 or _sub > 0").select(*keys, session).distinct())
    if not more.isEmpty():
        # Only sessions of several pieces take part in the rounds.
        current = done.join(more, [*keys, session], "left_semi")
        done = done.join(more, [*keys, session], "left_anti")
        along = W.partitionBy(*keys, session).orderBy("_part", "_sub")
        while True:
            current = settle(current)
            exits = current.select(*ids, F.col("_entry").alias("_had"), F.element_at("_states", -1).alias("_exit"))
            entries = exits.withColumn("_want", F.lag("_exit").over(along)).filter(~F.col("_want").eqNullSafe(F.col("_had"))).select(*ids, "_want")
            entries = settle(entries)
            if entries.isEmpty():
                break
            stale = F.col("_want").isNotNull()
            current = current.join(entries, ids, "left").withColumn("_entry", F.coalesce("_want", "_entry"))
            current = current.withColumn("_states", F.when(stale, _fold(step, state)).otherwise(F.col("_states"))).drop("_want")
        done = done.unionByName(current)
    rows = done.select(*keys, session, F.explode(F.arrays_zip("_rows", "_states")).alias("_z"))
    return rows.select(*keys, session, "_z._rows.*", F.col("_z._states").alias("state")).select(*df.columns, "state")


def _micros(t: Column) -> Column:
    return F.round(t * MICRO).cast("bigint")


def spaced_peaks(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    strength: str,
    tie: Sequence[str],
    spacing: float,
    *,
    piece_sec: float = PIECE_SEC,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Greedy selection, strongest first, dropping rows closer than ``spacing`` (in whole microseconds) to a stronger
    accepted row.

    Rows further apart than ``spacing`` never interact, so each gap component is decided on its own. Components that fit
    in one piece are folded; longer ones are decided tile by tile, which gives the same answer without ever gathering
    the component.
    """
    grouped = gap_sessions(df, keys, t, spacing, tie, out="_comp", strict=True)
    pieces = settle(_pieces(grouped, keys, "_comp", t, tie, piece_sec, piece_rows))
    rest = [c for c in df.columns if c not in keys]
    long_comps = pieces.filter("_part > 0 or _sub > 0").select(*keys, "_comp").distinct()
    split = not long_comps.isEmpty()
    short = pieces.join(long_comps, [*keys, "_comp"], "left_anti") if split else pieces

    ranked = F.array_sort(F.col("_rows"), lambda a, b: F.when(a[strength] > b[strength], -1).when(a[strength] < b[strength], 1)
                          .when(F.struct(a[t], *[a[c] for c in tie]) < F.struct(b[t], *[b[c] for c in tie]), -1).otherwise(1))
    kind = pieces.schema["_rows"].dataType.simpleString()
    kept = F.aggregate(ranked, F.expr(f"cast(array() as {kind})"),
                       lambda acc, p: F.when(F.exists(acc, lambda q: F.abs(_micros(q[t]) - _micros(p[t])) < round(spacing * MICRO)), acc).otherwise(F.concat(acc, F.array(p))))
    chosen = short.select(*keys, F.explode(kept).alias("_p")).select(*keys, *[F.col(f"_p.{c}").alias(c) for c in rest]).select(*df.columns)
    if not split:
        return chosen

    order = F.struct((-F.col(strength)).alias("o0"), F.col(t).alias("o1"), *[F.col(c).alias(f"o{i + 2}") for i, c in enumerate(tie)])
    open_ = grouped.join(long_comps, [*keys, "_comp"], "left_semi").select(*keys, order.alias("_o"), F.struct(*rest).alias("_r"), F.col(t).alias("_s"), (F.col(t) + F.lit(float(spacing))).alias("_e"))
    near = lambda a, b: F.abs(_micros(a[t]) - _micros(b[t])) < round(spacing * MICRO)
    kept = decide_in_tiles(open_, keys, near, min(float(piece_sec), TILE_SEC))
    return chosen.unionByName(kept.select(*keys, "_r.*").select(*df.columns))
