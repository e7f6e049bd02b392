"""Session defaults and the one place where lineage is cut."""
from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tideline", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; cluster sizing is left to the cluster's own settings."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and stream state that all executors see; a local one only on a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tideline-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return context.getCheckpointDir()


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder, so that loops neither grow the plan nor recompute it
    and a lost executor costs one task, not the whole history.

    What was shuffled on the way is deleted once the rows are written; else it stays on disk until the driver happens to
    collect its garbage. Only shuffles of this call go: the selection is a plan of its own."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)
