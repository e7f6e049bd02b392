"""What the writers leave behind, read back: written twice, as after a lost run."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tideline import catalog, views
from tideline.catalog import query
from tideline.catalog.prefix import sql
from tideline.catalog.select_queries import REVIEW, _review
from tideline.session import shared_folder
from tideline.sources import sinks


def _folder(spark):
    return f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"


@query("sink_job_documents", sql("SELECT user_id AS video_id, count(*) AS kills, min(event_id) AS first_seq, max(event_id) AS last_seq FROM events GROUP BY 1"))
def sink_job_documents(spark, d):
    """One result document per recording; a rerun of some recordings replaces only theirs."""
    rows = views.kill_events(spark, d).groupBy("video_id").agg(F.count(F.lit(1)).alias("kills"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    path = _folder(spark)
    sinks.write_job_documents(rows, path)
    sinks.write_job_documents(rows.filter("video_id % 2 = 1"), path)
    return sinks.read_job_documents(spark, path, rows.schema)


@query("sink_monthly_report", catalog.ORACLES["monthly_report"])
def sink_monthly_report(spark, d):
    """The monthly report as its files hold it, a folder per month, after a dry run and two real ones."""
    report, path = catalog.QUERIES["monthly_report"](spark, d), _folder(spark)
    sinks.write_report(report, path, dry_run=True)
    for _ in range(2):
        sinks.write_report(report, path)
    return spark.read.schema(report.schema).json(path).select(*report.columns)


@query("sink_annotated", sql("""SELECT count(*) AS total_detected, count(*) FILTER (WHERE confirmed) AS confirmed, count(*) FILTER (WHERE passes_quality) AS passes_quality, count(*) FILTER (WHERE in_pool) AS in_pool,
  count(*) FILTER (WHERE in_final) AS in_final, count(*) AS rows_written FROM review""", "kill_event", more=REVIEW))
def sink_annotated(spark, d):
    """The summary beside the annotated detections, and how many of them were written."""
    rows, path = _review(spark, d), _folder(spark)
    for _ in range(2):
        total = sinks.write_annotated(rows, path)
    written = spark.read.schema("video_id bigint, seq bigint").json(f"{path}/kills").agg(F.count("seq").alias("total_detected"), F.count("seq").alias("rows_written"))
    return spark.read.schema(total.schema).json(f"{path}/summary").join(written, "total_detected", "left")


@query("sink_projects", catalog.ORACLES["newest_projects"])
def sink_projects(spark, d):
    """The newest committed version of the project list."""
    rows, path = views.projects(spark, d), _folder(spark)
    sinks.write_version(rows.limit(0), path, "1")
    for _ in range(2):
        sinks.write_projects(rows, path, "2")
    return spark.read.schema(rows.schema).json(sinks.latest_version(spark, path)).select("id", "created_at")
