"""SimHash near-duplicates by multi-index hashing.

A fingerprint's 64 bits are three segments. Two fingerprints that differ in four bits at most differ in one bit at most in
one of the segments, so each fingerprint looks up, in every segment's table, its own value and all values one bit away, and
whole distances decide. Equal fingerprints count once. Look-ups and table entries of a segment value meet in one task, which
compares them as arrays and returns a forest of the links found, not the pairs; a value with many entries is dealt to several
tasks by its look-ups.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tideline.llm.common import stash
from tideline.llm.components import components, forest

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: First bit and width of the segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Table entries of one segment value that one task compares with all look-ups of the value; pairs compared at once.
HOT, PAIRS = 1024, 2_000_000


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The SimHash of a text's shingles of ``size`` words, lower-cased from A to Z; 0 if it has no word or is null.

    A text of fewer words is one shingle. A bit is set if more than half of the shingles' XXH64 have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[:n].tolist(), ends[min(size, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65_536):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at:at + 65_536], last[at:at + 65_536], strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(text: Column, size: int = SHINGLE) -> Column:
    """Long column of fingerprints; bit 63 is the sign."""

    @arrow_udf("bigint")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t.as_py(), size) for t in texts], dtype=np.uint64).view(np.int64), type=pa.int64())

    return of(text)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between look-ups and table entries with one key, as a forest. Columns: key, fp, entry."""
    rows = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)) for b in batches]
    if rows:
        key, fp, entry = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((~entry, key))  # entries before look-ups
        key, fp, entry = key[order], fp[order], entry[order]
        firsts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        run = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
        entries = np.add.reduceat(entry.astype(np.int64), firsts)
        looks = np.flatnonzero(~entry & (entries[run] > 0))
        need = entries[run[looks]]
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        done = np.concatenate([[0], np.cumsum(need)])
        at = 0
        while at < len(looks):
            to = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS, side="right")) - 1)
            left = np.repeat(fp[looks[at:to]], need[at:to])
            begin = firsts[run[looks[at:to]]]
            right = fp[np.arange(done[to] - done[at]) + np.repeat(begin - (done[at:to] - done[at]), need[at:to])]
            near = (left < right) & (np.bitwise_count((left ^ right).view(np.uint64)) <= DISTANCE)
            if near.any():
                a, b = forest(np.concatenate([a, left[near]]), np.concatenate([b, right[near]]))
            at = to
        yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])


def near_links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """Links a, b that join the same fingerprints (column fp, each once) as all pairs within the distance would."""
    bits = F.col("fp")
    values = [(F.shiftrightunsigned(bits, first) if first else bits).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(k << 40)) for k, (first, width) in enumerate(SEGMENTS)]
    entries = distinct.select("fp", F.explode(F.array(*values)).alias("key"))
    looks = distinct.select("fp", F.explode(F.array(*values, *[v.bitwiseXOR(F.lit(1 << bit)) for v, (_, width) in zip(values, SEGMENTS, strict=True) for bit in range(width)])).alias("key"))
    crowded = stash(entries.groupBy("key").count().filter(F.col("count") > hot).select(F.col("key").alias("of"), F.ceil(F.col("count") / hot).cast("int").alias("tasks")))
    deal = F.lit(0)
    if crowded.limit(1).count():
        looks = looks.join(crowded, F.col("key") == F.col("of"), "left").withColumn("deal", F.when(F.col("tasks").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("tasks")).cast("int"))).drop("of", "tasks")
        entries = entries.join(crowded, F.col("key") == F.col("of"), "left").withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("tasks") - 1, F.lit(0))))).drop("of", "tasks")
        deal = F.col("deal")
    meet = entries.select(F.col("key"), "fp", F.lit(True).alias("entry"), deal.alias("deal")).union(looks.select(F.col("key"), "fp", F.lit(False).alias("entry"), deal.alias("deal")))
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = meet.repartition(parts, "key", "deal").select((F.col("key") + F.col("deal").cast("bigint") * F.lit(1 << 43)).alias("key"), "fp", "entry")
    return keyed.mapInArrow(_compare, "a bigint, b bigint")


def _rooted(made: DataFrame, id_col: str, hot: int) -> DataFrame:
    """Per fingerprint of ``made``: ``of``, ``group`` (the smallest fingerprint reachable) and the group's smallest id."""
    distinct = stash(made.groupBy("fp").agg(F.min(id_col).alias("least")))
    joined = components(near_links(distinct.select("fp"), hot))
    rooted = distinct.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("group"))
    least = rooted.groupBy("group").agg(F.min("least").alias("component_id"))
    return stash(rooted.select("fp", "group").join(least, "group").select(F.col("fp").alias("of"), "group", "component_id"))


def simhash_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """The id, ``fp`` (long) and ``component_id`` of every row: the smallest id reachable over links of fingerprints.

    Null, empty and wordless texts share fingerprint 0, which links like any other. Rows with equal ids are rows of their own;
    a null id never is the smallest one unless its component has no other. Other columns are not looked at; an empty table
    gives an empty table.
    """
    made = stash(docs.select(F.col(id_col).alias(id_col), fingerprints(F.col(text_col), size).alias("fp")))
    return made.join(_rooted(made, id_col, hot), F.col("fp") == F.col("of")).select(id_col, "fp", "component_id")


def one_of_each_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """``docs`` with all its columns, and of each group one row: that of the smallest id (null last), of equal ids any one."""
    names = set(docs.columns)
    fp, row = (next(n for n in (f"{name}{'_' * k}" for k in range(len(names) + 1)) if n not in names) for name in ("simhash_fp", "simhash_row"))
    marked = stash(docs.select("*", fingerprints(F.col(text_col), size).alias(fp)).withColumn(row, F.monotonically_increasing_id()))
    rows = marked.select(F.col(id_col).alias("id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    groups = rows.join(_rooted(rows, "id", hot), F.col("fp") == F.col("of"))
    stay = groups.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")).select(F.col("first.row").alias(row))
    return marked.join(stay, row, "left_semi").select(*docs.columns)
