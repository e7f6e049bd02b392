"""Near copies: texts whose sets of word shingles have a Jaccard similarity of ``LEAST`` or more.

Equal sets count once. A set's minima under independent hashes are cut into bands; two sets of similarity s agree in one of
them with probability 1 - (1 - s**DEEP)**BANDS: 0.9993 at 0.8, more above. Sets that agree in a band are compared as whole
sets, so every link is exact. SimHash fingerprints of at most four differing bits (``simhash.near_links``) propose pairs too; their
sets are compared like a band's. A band's sets are first compared with the smallest of them, which joins large groups without
listing their pairs; what that leaves in different groups is compared pair by pair.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tideline.llm import simhash
from tideline.llm.common import stash
from tideline.llm.components import components

#: Words of a shingle, least similarity, bands and minima of a band.
SIZE, LEAST, BANDS, DEEP = 5, 0.8, 24, 6
SEED = 42
#: Shingles whose hashes under all functions are held at once.
STEP = 512


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``size`` words, lower-cased from A to Z.

    A text of fewer words is one shingle; without a word, or null, it has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, SEED) for w in words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - size + 1)
    sums = np.zeros(n, dtype=np.uint64)
    for k in range(min(size, len(words))):
        sums = _mixed(sums + hashes[k:k + n])
    return np.unique(sums)


def band_keys(hashes: np.ndarray, bands: int = BANDS, deep: int = DEEP) -> np.ndarray:
    """One number per band of a set of shingles; none of an empty set."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    turn = np.random.default_rng(SEED).integers(0, 1 << 64, (2, bands * deep), dtype=np.uint64)
    turn[1] |= np.uint64(1)
    least = np.full(bands * deep, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), STEP):
        np.minimum(least, ((hashes[at:at + STEP, None] ^ turn[0]) * turn[1]).min(axis=0), out=least)
    keys = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, deep).T:
        keys = _mixed(keys + column)
    return keys.view(np.int64)


def sketches(text: Column, size: int = SIZE, bands: int = BANDS, deep: int = DEEP) -> Column:
    """``whole``, equal for equal sets of shingles, and ``bands``."""
    kind = pa.struct([("whole", pa.int64()), ("bands", pa.list_(pa.int64()))])

    @arrow_udf("struct<whole:bigint,bands:array<bigint>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            wholes, keys = [], []
            for t in texts:
                own = shingles(t.as_py(), size)
                wholes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                keys.append(band_keys(own, bands, deep))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.StructArray.from_arrays([pa.array(np.array(wholes, dtype=np.uint64).view(np.int64)), lists.cast(kind[1].type)], fields=list(kind))

    return of(text)


def shingle_sets(text: Column, size: int = SIZE) -> Column:
    """Array column of a text's distinct shingles."""

    @arrow_udf("array<bigint>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([shingles(t.as_py(), size).view(np.int64) for t in texts], type=pa.list_(pa.int64()))

    return of(text)


def _links(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b, rows of ``texts``) that are similar enough as whole sets."""
    named = pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b").alias("row"))).distinct()
    sets = stash(texts.join(named, "row", "left_semi").select("row", shingle_sets(F.col("text"), size).alias("set")))
    of = lambda side: sets.select(F.col("row").alias(side), F.col("set").alias(f"{side}_set"))
    common, both = F.size(F.array_intersect("a_set", "b_set")), F.size("a_set") + F.size("b_set")
    return stash(pairs.join(of("a"), "a").join(of("b"), "b").filter(common / (both - common) >= least).select("a", "b"))


def _proposed(prints: DataFrame, hot: int) -> DataFrame:
    """Pairs a < b of nodes of ``prints`` (node, fp) that join what SimHash links join: nodes of one fingerprint with their smallest
    one, and smallest ones of near fingerprints."""
    heads = stash(prints.groupBy("fp").agg(F.min("node").alias("head")))
    same = prints.join(heads, "fp").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    of = lambda side: heads.select(F.col("fp").alias(side), F.col("head").alias(f"{side}_head"))
    near = simhash.near_links(heads.select("fp"), hot).join(of("a"), "a").join(of("b"), "b")
    return same.union(near.select(F.least("a_head", "b_head").alias("a"), F.greatest("a_head", "b_head").alias("b")))


def _groups(distinct: DataFrame, texts: DataFrame, size: int, least: float, proposed: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, of the nodes of ``distinct`` (node, bands) that have a link. ``proposed`` are
    pairs to compare beside those of the bands."""
    entries = distinct.select("node", F.explode("bands").alias("key"))
    heads = entries.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).filter("head <> last").select("key", "head")
    met = stash(entries.join(heads, "key"))
    star = stash(met.filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).union(proposed).distinct())
    links = _links(star, texts, size, least)
    known = components(links)
    now = stash(met.join(known, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))
    torn = now.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("key")
    open_ = stash(now.join(torn, "key"))
    left, right = open_.select("key", F.col("node").alias("a"), F.col("root").alias("a_root")), open_.select("key", F.col("node").alias("b"), F.col("root").alias("b_root"))
    rest = stash(left.join(right, "key").filter("a < b and a_root <> b_root").select("a", "b").distinct().join(star, ["a", "b"], "left_anti"))
    if not rest.limit(1).count():
        return known
    more = _links(rest, texts, size, least)
    return components(links.union(more)) if more.limit(1).count() else known


def one_of_each_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, least: float = LEAST, bands: int = BANDS, deep: int = DEEP, hot: int = simhash.HOT) -> DataFrame:
    """``docs`` with all its columns, and of each group one row: that of the smallest id (null last), of equal ids any one.

    Groups are what links of similarity ``least`` join. Null, empty and wordless texts are one group; rows with equal ids are
    rows of their own. An empty table gives an empty table."""
    names = set(docs.columns)
    sketch, row, fp = (next(n for n in (f"{name}{'_' * k}" for k in range(len(names) + 1)) if n not in names) for name in ("near_copies_sketch", "near_copies_row", "near_copies_fp"))
    marked = stash(docs.select("*", sketches(F.col(text_col), size, bands, deep).alias(sketch), simhash.fingerprints(F.col(text_col)).alias(fp)).withColumn(row, F.monotonically_increasing_id()))
    rows = marked.select(F.col(id_col).alias("id"), F.col(sketch)["whole"].alias("whole"), F.col(row).alias("row"))
    distinct = stash(marked.groupBy(F.col(sketch)["whole"].alias("whole")).agg(F.min(F.struct(F.col(row).alias("row"), F.col(sketch)["bands"].alias("bands"), F.col(fp).alias("fp"))).alias("first")).select("whole", F.col("first.row").alias("node"), "first.bands", "first.fp"))
    known = _groups(distinct.select("node", "bands"), marked.select(F.col(row).alias("row"), F.col(text_col).alias("text")), size, least, _proposed(distinct.select("node", "fp"), hot))
    grouped = distinct.select("whole", "node").join(known, "node", "left").select(F.col("whole").alias("of"), F.coalesce("root", "node").alias("group"))
    groups = rows.join(grouped, F.col("whole") == F.col("of"))
    stay = groups.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")).select(F.col("first.row").alias(row))
    return marked.join(stay, row, "left_semi").select(*docs.columns)
