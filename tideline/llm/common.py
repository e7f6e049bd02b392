"""Small helpers that several corpus operators share."""
from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import shared_folder

#: ASCII white space; everything else belongs to a word.
SPACES = b" \t\n\v\f\r"
#: UTF-8 bytes of text that Python code holds in its working arrays at once.
PIECE_BYTES = 2 << 20
_STASHES: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return (F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % folds).cast("int")


def labels_by_id(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """One row per id that has one undisputed label 0 or 1; null ids, other values and contradicting rows are left out."""
    value = F.col(label).cast("int")
    return (
        labels.select(F.col(id_col).alias("label_id"), value.alias("value"))
        .filter(F.col("label_id").isNotNull() & F.col("value").isin(0, 1))
        .groupBy("label_id").agg(F.min("value").alias("label"), F.max("value").alias("other"))
        .filter(F.col("label") == F.col("other")).drop("other")
    )


def stash(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: a compact cut of the lineage, which any executor can read again."""
    path = f"{shared_folder(df.sparkSession)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STASHES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stashes(spark: SparkSession) -> None:
    """Delete all tables that ``stash`` wrote in this process; results that still read them must have been saved."""
    while _STASHES:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STASHES.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pieces(texts: Iterable[str | None], limit: int = PIECE_BYTES, most: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in order, in lists of about ``limit`` characters and ``most`` texts at most; a longer text is a list of its own. Null is empty."""
    held, size = [], 0
    for text in texts:
        text = text or ""
        if held and (size + len(text) > limit or len(held) == most):
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held
