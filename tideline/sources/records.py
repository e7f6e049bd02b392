"""Job documents, reports, projects, detector output, logs and picks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline import schemas
from tideline.functions.numeric import nz

# Loudness assumed where a log does not state it, and report retention.
MAX_DB, MEAN_DB = -40.0, -35.0
KEEP_REPORTS = 12


def job_documents(spark: SparkSession, root: str) -> DataFrame:
    """``meta.json`` of every workspace folder not starting with an underscore; unreadable documents are skipped."""
    schema = schemas.JOB_META + ", _corrupt_record string"
    docs = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{root}/[!_]*/meta.json")
    docs = docs.withColumn("workspace", F.element_at(F.split("_metadata.file_path", "/"), -2))
    return docs.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def jobs_from_documents(docs: DataFrame) -> DataFrame:
    """Job rows as the monthly report reads them; game and category fall back to the content fields."""
    hl = nz(F.col("highlights"), F.expr("cast(array() as " + "array<struct<id:string,title:string,start_time:double,end_time:double,viral_score:double,montage_kill_count:int,"
                                        "montage_segments:array<struct<start:double,duration:double>>,montageKills:array<double>,kills:array<double>>>)"))
    kills = F.aggregate(hl, F.lit(0), lambda a, h: a + F.greatest(nz(F.size(h["montageKills"]), 0), nz(F.size(h["kills"]), 0), F.lit(0)))
    montage = F.exists(hl, lambda h: h["montage_segments"].isNotNull() | h["montageKills"].isNotNull())
    return docs.select(
        F.coalesce("jobId", "workspace").alias("job_id"), "status", F.coalesce("error.code", "errorCode").alias("error_code"), F.col("sourceType").alias("source_type"), "url",
        F.coalesce("detectedGame", "category", "contentGame", "contentCategory").alias("category"), F.to_timestamp("startedAt").alias("started_at"), F.to_timestamp("completedAt").alias("completed_at"),
        F.to_timestamp("createdAt").alias("created_at"), F.size(hl).alias("highlights"), kills.alias("kills"), montage.alias("has_montage"))


def report_history(spark: SparkSession, path: str, keep: int = KEEP_REPORTS) -> DataFrame:
    """The newest reports; other files in the folder do not count."""
    return spark.read.schema(schemas.REPORT).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).orderBy(F.desc("month")).limit(keep)


def project_table(spark: SparkSession, path: str) -> DataFrame:
    """Projects of a JSON array file; anything that is not an array reads as empty."""
    text = spark.read.format("text").option("wholetext", True).load(path)
    rows = text.select(F.inline(F.from_json("value", schemas.PROJECTS)))
    return rows.select("id", F.col("jobId").alias("job_id"), "title", "url", F.col("sourceType").alias("source_type"), F.col("clipCount").alias("clip_count"), F.col("createdAt").alias("created_at"),
                       F.col("updatedAt").alias("updated_at"), F.col("expiresAt").alias("expires_at"), nz(F.col("saved"), False).alias("saved")).filter(F.col("id").isNotNull())


def detector_events(raw: DataFrame) -> DataFrame:
    """Events of ``(video_id, content)`` detector results; failed results yield none."""
    doc = raw.select("video_id", F.from_json("content", schemas.DETECTOR).alias("d")).filter("d.ok")
    return doc.select("video_id", F.posexplode("d.events").alias("seq", "e")).select("video_id", F.col("seq").cast("bigint").alias("seq"), "e.*")


def ocr_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.OCR_LOG).json(path)


def video_metadata(raw: DataFrame) -> DataFrame:
    """Metadata documents ``(video_id, content)`` with defaults."""
    d = raw.select("video_id", F.from_json("content", schemas.METADATA).alias("d"))
    empty = F.expr("cast(array() as array<string>)")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    return d.select("video_id", F.trim(F.coalesce(filled("d.title"), F.lit("Unknown video"))).alias("title"), F.left(F.trim(nz(F.col("d.description"), "")), F.lit(3000)).alias("description"),
                    F.nullif(F.col("d.duration"), F.lit(0.0)).alias("duration"), nz(F.col("d.tags"), empty).alias("tags"), F.trim(F.coalesce(filled("d.channel"), filled("d.uploader"), F.lit(""))).alias("channel"),
                    nz(F.col("d.categories"), empty).alias("categories"))


def pick_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Picks from ``(video_id, content)`` answers that hold a JSON array somewhere, and the answers that do not."""
    body = F.nullif(F.regexp_extract("content", r"(?s)\[.*\]", 0), F.lit(""))
    parsed = raw.withColumn("_p", F.from_json(body, schemas.PICKS, {"mode": "PERMISSIVE"}))
    ok = F.col("_p").isNotNull() & (F.size("_p") > 0)
    picks = parsed.filter(ok).select("video_id", F.posexplode("_p").alias("seq", "p")).select("video_id", "seq", "p.*")
    return picks, parsed.filter(~ok | F.col("_p").isNull()).select(*raw.columns)


def volume_stats(log: Column) -> dict[str, Column]:
    """Loudness figures of a measurement log, with defaults."""
    find = lambda p, d: F.coalesce(F.nullif(F.regexp_extract(nz(log, ""), p, 1), F.lit("")).try_cast("double"), F.lit(d))
    return {"max_db": find(r"(?i)max_volume:\s*([-\d.]+)\s*dB", MAX_DB), "mean_db": find(r"(?i)mean_volume:\s*([-\d.]+)\s*dB", MEAN_DB)}


def log_times(log: Column, kind: str) -> Column:
    """All times of one kind in a measurement log: ``silence_start``, ``silence_end`` or ``pts_time``."""
    pattern = {"silence_start": r"silence_start:\s*([\d.]+)", "silence_end": r"silence_end:\s*([\d.]+)", "pts_time": r"pts_time[:=]([\d.]+)"}[kind]
    return F.transform(F.regexp_extract_all(nz(log, ""), F.lit("(?i)" + pattern), 1), lambda x: x.try_cast("double"))


def burst_score(starts: Column, ends: Column, duration: Column) -> Column:
    """Short loud bursts between silences: 2.5 points each, at most 10, none with fewer than two silences."""
    n = F.least(F.size(starts), F.size(ends))
    length = lambda i: F.when(nz(F.get(starts, i), 0.0) == 0, duration).otherwise(F.get(starts, i)) - nz(F.get(ends, i - 1), 0.0)
    short = F.size(F.filter(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), length), lambda x: (x > 0.2) & (x < 2.5)))
    return F.when(n < 2, 0.0).otherwise(F.least(F.lit(10.0), short * 2.5))


def cut_points(count: Column) -> Column:
    """Points for scene cuts in a window."""
    return F.when(count >= 8, 12).when(count >= 5, 9).when(count >= 3, 6).when(count >= 2, 3).otherwise(0)


def emotion_score(max_db: Column, mean_db: Column, spike: Column, burst: Column, lite: bool = False) -> Column:
    """Loudness emotion of a window: peak and energy, and unless ``lite`` spikes and bursts."""
    peak = F.greatest(F.lit(0.0), F.least(F.lit(16.0), (max_db + 28) * 0.9))
    energy = F.greatest(F.lit(0.0), F.least(F.lit(8.0), (mean_db + 32) * 0.45))
    if lite:
        return F.floor(F.least(F.lit(24.0), peak + energy) + 0.5)
    return F.floor(F.least(F.lit(45.0), peak + energy + F.floor(spike + 0.5) + burst) + 0.5)
