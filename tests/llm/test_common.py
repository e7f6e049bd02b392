"""Shared helpers."""
import os
import zlib

from conftest_llm import key
from pyspark.sql import functions as F

from tideline.llm import common


def test_folds_follow_crc32(spark):
    frame = spark.createDataFrame([(i,) for i in [*range(50), 10**12, -3, None]], "doc_id bigint")
    for r in frame.select("doc_id", common.fold("doc_id", 7).alias("f")).collect():
        assert r["f"] == zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 7


def test_labels_need_one_undisputed_value(spark):
    rows = [(1, 1), (1, 1), (2, 0), (2, 1), (3, None), (4, 7), (None, 1), (5, 0), (5, None)]
    got = common.labels_by_id(spark.createDataFrame(rows, "doc_id bigint, toxic int"), "toxic").collect()
    assert sorted(key(*r) for r in got) == sorted([key(1, 1), key(5, 0)])


def test_pieces_keep_order_and_bounds():
    texts = ["a" * n for n in (0, 5, 30, 2, 2, 2, 9)] + [None]
    got = list(common.pieces(texts, 10, 3))
    assert [t for g in got for t in g] == [t or "" for t in texts]
    assert all(len(g) <= 3 and (sum(map(len, g)) <= 10 or len(g) == 1) for g in got)


def test_stashes_can_be_dropped(spark):
    kept = common.stash(spark.range(5).select((F.col("id") * 2).alias("x")))
    paths = list(common._STASHES)
    assert sorted(r["x"] for r in kept.collect()) == [0, 2, 4, 6, 8]
    common.drop_stashes(spark)
    assert not common._STASHES and not any(os.path.exists(p.removeprefix("file:")) for p in paths)
