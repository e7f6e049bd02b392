"""Greedy selection in rank order with pairwise conflicts and a cap per key."""
from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.operators.ranges import overlap_join
from tideline.session import settle

FOLD_ROWS = 2048
# Seconds of a tile in which conflicts are resolved at once, and the most tiles that later rounds join to one.
TILE_SEC, TILES = 1800.0, 32


def greedy_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    conflict: Callable[[Column, Column], Column],
    most: int | None,
    *,
    span: tuple[Column, Column] | None = None,
    fold_rows: int = FOLD_ROWS,
    tile_sec: float = TILE_SEC,
) -> DataFrame:
    """Walk the rows of each key in ``order`` (ascending, unique) and keep those that conflict with no kept row, up to
    ``most``; adds ``place``, counted from 1.

    Keys with at most ``fold_rows`` rows are folded as one sorted array. ``span`` states an interval of seconds per row
    such that rows conflict only if theirs meet; larger keys are then decided tile by tile. Without it they take ``most``
    rounds, each of which keeps the first remaining row and drops its conflicts. All ways give the same answer and no
    task holds a large key.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    ends = [span[0].alias("_s"), span[1].alias("_e")] if span else []
    rows = df.select(*keys, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("_o"), F.struct(*rest).alias("_r"), *ends)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = settle(sizes.filter(F.col("_n") > fold_rows).select(*keys))
    split = not large.isEmpty()
    small = rows.join(large, keys, "left_anti") if split else rows

    packed = small.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_o", "_r"))).alias("_a"))
    kind = df.select(F.array(F.struct(*rest)).alias("a")).schema["a"].dataType.simpleString()

    def walk(kept: Column, row: Column) -> Column:
        full = F.size(kept) >= most if most is not None else F.lit(False)
        clash = F.exists(kept, lambda k: F.coalesce(conflict(k, row["_r"]), F.lit(False)))
        return F.when(full | clash, kept).otherwise(F.concat(kept, F.array(row["_r"])))

    folded = packed.select(*keys, F.posexplode(F.aggregate("_a", F.expr(f"cast(array() as {kind})"), walk)).alias("place", "_r"))
    out = folded.select(*keys, "_r.*", (F.col("place") + 1).alias("place"))
    if split and span:
        kept = decide_in_tiles(rows.join(large, keys, "left_semi"), keys, conflict, tile_sec)
        ranked = kept.select(*keys, "_r.*", F.row_number().over(W.partitionBy(*keys).orderBy("_o")).alias("place"))
        out = out.unionByName(ranked.filter(F.col("place") <= most) if most is not None else ranked)
    elif split:
        if most is None:
            raise ValueError("greedy_rank needs a cap or spans for large keys")
        open_rows = settle(rows.join(large, keys, "left_semi"))
        for place in range(1, most + 1):
            best = settle(open_rows.groupBy(*keys).agg(F.min(F.struct("_o", "_r")).alias("_b")))
            if best.isEmpty():
                break
            out = out.unionByName(best.select(*keys, "_b._r.*", F.lit(place).alias("place")))
            clash = F.coalesce(conflict(F.col("_b._r"), F.col("_r")), F.lit(False)) | (F.col("_o") == F.col("_b._o"))
            open_rows = settle(open_rows.join(best, keys).filter(~clash).select(*keys, "_o", "_r"))
    return out.select(*df.columns, "place")


def decide_in_tiles(rows: DataFrame, keys: list[str], conflict: Callable[[Column, Column], Column], tile_sec: float) -> DataFrame:
    """The kept rows of ``(keys, _o, _r, _s, _e)``.

    Each conflict points from the better row to the worse. A row is kept once all better ones are dropped and dropped once
    one is kept, so a tile resolves whatever does not wait for another tile. What waits goes to the next round with tiles
    twice as long, up to ``TILES`` of them: rounds follow the logarithm of a recording's length, not its rows.
    """
    tile = F.floor(F.col("_s") / F.lit(tile_sec)).cast("bigint")
    number = F.row_number().over(W.partitionBy(*keys, "_tile").orderBy("_o")).cast("bigint")
    base = settle(rows.withColumn("_tile", tile).withColumn("_id", F.col("_tile") * F.lit(1 << 32) + number))
    side = lambda x: base.select(*keys, *[F.col(c).alias(f"{c}{x}") for c in ("_id", "_o", "_r", "_s", "_e")])
    pairs = overlap_join(side("a"), side("b"), keys, (F.col("_sa"), F.col("_ea")), (F.col("_sb"), F.col("_eb")))
    pairs = pairs.filter((F.col("_oa") < F.col("_ob")) & F.coalesce(conflict(F.col("_ra"), F.col("_rb")), F.lit(False)))
    links = settle(pairs.select(*keys, F.col("_ida").alias("better"), F.col("_idb").alias("worse")))
    ids = lambda frame, column: frame.select(*keys, F.col(column).alias("_id")).distinct()
    kept = base.select(*keys, "_id").join(ids(links, "worse"), [*keys, "_id"], "left_anti")
    schema = base.select(*keys, "_id", F.lit(True).alias("kept")).schema
    joined = 1
    while not links.isEmpty():
        group = lambda c: F.floor(F.col(c) / F.lit((1 << 32) * joined)).cast("bigint")  # noqa: E731, B023
        grouped = links.withColumn("_g", group("worse")).withColumn("inside", group("better") == F.col("_g"))
        decided = settle(grouped.groupBy(*keys, "_g").applyInArrow(lambda t: _resolve(t, keys), schema))
        sources = ids(links, "better").join(ids(links, "worse"), [*keys, "_id"], "left_anti").withColumn("kept", F.lit(True))
        of = decided.select(*keys, "_id", "kept").unionByName(sources)
        waiting = links.join(decided.select(*keys, F.col("_id").alias("worse")), [*keys, "worse"], "left_anti")
        known = settle(waiting.join(of.select(*keys, F.col("_id").alias("better"), "kept"), [*keys, "better"], "left"))
        dropped = ids(known.filter("kept"), "worse")
        left = known.filter("kept is null").select(*keys, "better", "worse")
        for end in ("worse", "better"):
            left = left.join(dropped.withColumnRenamed("_id", end), [*keys, end], "left_anti")
        left = settle(left)
        freed = ids(known, "worse").join(dropped, [*keys, "_id"], "left_anti").join(ids(left, "worse"), [*keys, "_id"], "left_anti")
        kept = kept.unionByName(decided.filter("kept").select(*keys, "_id")).unionByName(freed)
        links, joined = left, min(2 * joined, TILES)
    return base.join(kept, [*keys, "_id"], "left_semi")


def _resolve(links: pa.Table, keys: list[str]) -> pa.Table:
    """Verdicts on the worse rows of one group of tiles that follow from the links inside it."""
    better, worse, inside = (links[c].to_pylist() for c in ("better", "worse", "inside"))
    waits: dict[int, int] = {}
    beats: dict[int, list[int]] = {}
    for b, w, here in zip(better, worse, inside, strict=True):
        waits[w] = waits.get(w, 0) + 1
        if here:
            beats.setdefault(b, []).append(w)
    verdict = {b: True for b in beats if b not in waits}
    todo = deque(verdict)
    while todo:
        b = todo.popleft()
        for w in beats.get(b, ()):
            if w in verdict:
                continue
            waits[w] -= 1
            if verdict[b] or waits[w] == 0:
                verdict[w] = not verdict[b]
                todo.append(w)
    found = [w for w in waits if w in verdict]
    first = [links[k].slice(0, 1).to_pylist()[0] for k in keys]
    columns = {k: pa.array([v] * len(found), type=links.schema.field(k).type) for k, v in zip(keys, first, strict=True)}
    return pa.table(columns | {"_id": pa.array(found, type=pa.int64()), "kept": pa.array([verdict[w] for w in found], type=pa.bool_())})
