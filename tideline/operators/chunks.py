"""Order-dependent state that has no closed form: processed chunk by chunk, state carried in a table."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.ordered import ordered
from tideline.session import settle

CHUNK_ROWS = 5000


def _whole_chunks(keys: Sequence[str], process: Callable[[str | None, pd.DataFrame], str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The states of keys whose rows follow each other in order: many small keys share a batch and cost no more than their rows."""

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current, kinds = [], None, None

        def close() -> tuple:
            return (*current, process(None, pa.Table.from_batches(held).to_pandas()))

        def packed(done: list[tuple]) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*done)]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=[*keys, "state"])

        for batch in batches:
            kinds = [*(batch.schema.field(k).type for k in keys), pa.string()]
            ids = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            done = []
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if held and ids[low] != current:
                    done.append(close())
                    held = []
                current = ids[low]
                held.append(batch.slice(low, high - low))
            if done:
                yield packed(done)
        if held:
            yield packed([close()])

    return states


def carry_chunks(df: DataFrame, keys: Sequence[str], t: str, tie: Sequence[str], process: Callable[[str | None, pd.DataFrame], str], *, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Final state per key of ``process(state, rows) -> state`` over the rows in order; the state is a JSON string.

    Keys are cut into chunks of ``chunk_rows`` rows. Round n feeds every key's n-th chunk together with the state left
    by the one before, so a group sees one chunk and one state. Ordinary keys finish in the first round, where a task walks through
    the sorted chunks of many keys; only a key with more rows takes further rounds, and those touch its rows alone.
    """
    keys = list(keys)
    numbered = ordered(df.withColumn("_one", F.lit(1)), keys, t, tie, run_sum={"_n": "_one"})
    numbered = settle(numbered.withColumn("_chunk", F.floor((F.col("_n") - 1) / chunk_rows)).drop("_one", "_n"))
    last = numbered.agg(F.max("_chunk")).first()[0]
    schema = T.StructType([numbered.schema[k] for k in keys] + [T.StructField("state", T.StringType())])
    order = [t, *tie]

    def following(group: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        if group.empty:
            return before
        rows = group.sort_values(order, kind="stable")
        return pd.DataFrame([{**{k: rows[k].iloc[0] for k in keys}, "state": process(before["state"].iloc[0], rows)}])

    # A fixed number of partitions: the rows are few bytes but much work, so they must not be coalesced by size.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    begun = numbered.filter("_chunk = 0").repartition(parts, *keys).sortWithinPartitions(*keys, *[F.col(c).asc_nulls_last() for c in order])
    state = begun.mapInArrow(_whole_chunks(keys, process), schema)
    done = None
    for chunk in range(1, (last or 0) + 1):
        state = settle(state)
        part = numbered.filter(F.col("_chunk") == chunk)
        going = part.select(*keys).distinct()
        finished = state.join(going, keys, "left_anti")
        done = finished if done is None else done.unionByName(finished)
        live = state.join(going, keys, "left_semi")
        state = part.groupBy(*keys).cogroup(live.groupBy(*keys)).applyInPandas(following, schema)
    return state if done is None else done.unionByName(state)
