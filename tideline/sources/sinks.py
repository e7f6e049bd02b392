"""Writers. Every write goes to a new version or replaces whole partitions; nothing is updated in place."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tideline.plans.projects import newest


def _folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """The folders in ``path`` whose names begin with ``prefix``, by name."""
    files, target = _path(spark, path)
    if not files.exists(target):
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(target) if s.isDirectory() and s.getPath().getName().startswith(prefix))


def write_job_documents(results: DataFrame, path: str) -> str:
    """One result document, a line of JSON, per recording, as a new run beside those before; returns its folder.

    A run has as many files as tasks, not one per recording. :func:`read_job_documents` takes each recording from its newest run, so a
    rerun replaces only its recordings."""
    runs = _folders(results.sparkSession, path, "run=")
    target = f"{path}/run={int(runs[-1][4:]) + 1 if runs else 1:08d}"
    results.write.json(target)
    return target


def read_job_documents(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The newest documents of every recording; a run that was not written to its end doesn't count."""
    runs = [f"{path}/{n}" for n in _folders(spark, path, "run=") if is_committed(spark, f"{path}/{n}")]
    if not runs:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema.fields, StructField("run", LongType())])).option("basePath", path).json(runs)
    newest_run = F.max("run").over(W.partitionBy("video_id"))
    return rows.withColumn("_newest", newest_run).filter(F.col("run") == F.col("_newest")).select(*schema.names)


def write_report(report: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Report rows partitioned by month; a dry run only returns them."""
    if not dry_run:
        report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").json(path)
    return report


def write_text_report(lines: DataFrame, path: str) -> None:
    """Numbered report lines ``(month, part, pos, line)`` as text, one folder per month, lines in order."""
    ordered = lines.repartition("month").sortWithinPartitions("month", "part", "pos").select("month", "line")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").text(path)


def write_annotated(annotated: DataFrame, path: str) -> DataFrame:
    """The annotated detections and a one-row summary beside them; returns the summary."""
    annotated.write.mode("overwrite").json(f"{path}/kills")
    total = annotated.agg(F.count(F.lit(1)).alias("total_detected"), *[F.count_if(c).alias(c) for c in ("confirmed", "passes_quality", "in_pool", "in_final")])
    total.write.mode("overwrite").json(f"{path}/summary")
    return total


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def is_committed(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end: the committer leaves its marker last."""
    files, target = _path(spark, f"{path}/_SUCCESS")
    return files.exists(target)


def write_version(rows: DataFrame, path: str, version: str) -> str:
    """``rows`` as one version folder of JSON, written once: a committed version stays as it is, the leftovers of a broken run are
    replaced. Returns the folder."""
    target = f"{path}/version={version}"
    if not is_committed(rows.sparkSession, target):
        rows.write.mode("overwrite").json(target)
    return target


def latest_version(spark: SparkSession, path: str) -> str | None:
    """The folder of the newest committed version, by name."""
    done = [n for n in _folders(spark, path, "version=") if is_committed(spark, f"{path}/{n}")]
    return f"{path}/{done[-1]}" if done else None


def write_projects(projects: DataFrame, path: str, version: str) -> str:
    """The newest two hundred projects as a new version folder; returns its path."""
    return write_version(newest(projects), path, version)
