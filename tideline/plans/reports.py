"""Monthly job reports: counts, durations, breakdowns, trend and text form."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.numeric import nz

# Longest duration that counts, in milliseconds, and the report windows in months.
LONGEST_MS = 30 * 60 * 1000
TREND_MONTHS, HISTORY_MONTHS = 6, 12


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def previous_month(day: Column) -> Column:
    return F.date_format(F.add_months(F.trunc(day, "MM"), -1), "yyyy-MM")


def normalise_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs with month, outcome, error class, source, category, duration and montage flag. One narrow projection."""
    done = F.coalesce("completed_at", "created_at")
    failed = (F.col("status") == "error") | F.col("error_code").isNotNull()
    source = F.coalesce("source_type", F.when(F.contains("url", F.lit("youtube")), "youtube"), F.lit("unknown"))
    took = F.unix_millis("completed_at") - F.unix_millis("started_at")
    montage = nz(F.col("has_montage"), False) | F.col("category").isin("cs2", "counter-strike")
    return jobs.filter(done.isNotNull()).select(
        "job_id", month_key(done).alias("month"), failed.alias("failed"), (~failed & (F.col("status") == "completed")).alias("completed"),
        F.when(failed, F.coalesce("error_code", F.lit("UNKNOWN"))).alias("error"), F.when(source.isin("youtube", "local"), source).otherwise("unknown").alias("source"),
        F.coalesce("category", F.lit("unknown")).alias("category"), F.when((took > 0) & (took < LONGEST_MS), took).alias("took_ms"),
        nz(F.col("highlights"), 0).alias("highlights"), montage.alias("montage"), F.when(montage & (F.col("kills") > 0), F.col("kills")).alias("kills"))


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The element at position floor(n/2) of the sorted values, from value counts: the sorted side is bounded by the
    number of distinct values, not by the number of rows."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    order = W.partitionBy(*keys).orderBy(value)
    seen = counts.withColumns({"_upto": F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum("_n").over(W.partitionBy(*keys))})
    return seen.filter(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*keys).agg(F.min(value).alias("median"))


def duration_stats(jobs: DataFrame) -> DataFrame:
    rows = jobs.filter(F.col("took_ms").isNotNull())
    stats = rows.groupBy("month").agg(F.avg("took_ms").alias("avg_ms"), F.min("took_ms").alias("min_ms"), F.max("took_ms").alias("max_ms"), F.count(F.lit(1)).alias("timed"))
    return stats.join(upper_median(rows, ["month"], "took_ms").withColumnRenamed("median", "median_ms"), "month")


def monthly_report(jobs: DataFrame) -> DataFrame:
    """One row per month; every count in one aggregation, partial before the shuffle."""
    base = jobs.groupBy("month").agg(
        F.count(F.lit(1)).alias("total_jobs"), F.count_if("completed").alias("completed_jobs"), F.count_if("failed").alias("failed_jobs"),
        F.avg("highlights").alias("avg_highlights"), F.count_if("montage").alias("montage_jobs"), F.avg("kills").alias("avg_kills"))
    return base.join(duration_stats(jobs), "month", "left")


def breakdown(jobs: DataFrame, column: str) -> DataFrame:
    """Counts per month and value with their share of the month, most frequent first."""
    counts = jobs.filter(F.col(column).isNotNull()).groupBy("month", column).agg(F.count(F.lit(1)).alias("jobs"))
    totals = jobs.groupBy("month").agg(F.count(F.lit(1)).alias("_all"))
    ranked = W.partitionBy("month").orderBy(F.desc("jobs"), F.col(column))
    out = counts.join(totals, "month").withColumn("percent", F.floor(F.try_divide(F.col("jobs") * 1000, F.col("_all")) + 0.5) / 10)
    return out.select("month", F.col(column).alias("value"), "jobs", "percent", F.row_number().over(ranked).alias("rank"))


def breakdown_sets(jobs: DataFrame) -> DataFrame:
    """Counts by month and category, month and source, and month, in one pass with grouping sets."""
    jobs.createOrReplaceTempView("_tideline_jobs")
    return jobs.sparkSession.sql("""
        SELECT month, category, source, count(*) AS jobs, grouping_id(month, category, source) AS level
        FROM _tideline_jobs GROUP BY month, category, source GROUPING SETS ((month, category), (month, source), (month))""")


def trend(report: DataFrame, months: int = TREND_MONTHS) -> DataFrame:
    return report.orderBy(F.desc("month")).limit(months).select("month", "total_jobs", F.round("avg_highlights", 1).alias("avg_highlights"))


def _clock(ms: Column) -> Column:
    sec = F.floor(ms / 1000)
    return F.when(ms.isNull() | (ms == 0), "N/A").otherwise(F.format_string("%dm %ds", F.floor(sec / 60), sec % 60))


def text_report(report: DataFrame, categories: DataFrame, errors: DataFrame, history: DataFrame) -> DataFrame:
    """The report of each month as numbered text lines. Inputs are report tables, a few rows per month."""
    pct = lambda c: F.format_string("%.1f", F.try_divide(F.col(c) * 100.0, F.col("total_jobs")))
    head = F.array(
        F.concat(F.lit("Monthly report: "), "month"), F.concat(F.lit("Total jobs processed:     "), F.col("total_jobs").cast("string")),
        F.concat(F.lit("Successful completions:   "), F.col("completed_jobs").cast("string"), F.lit(" ("), pct("completed_jobs"), F.lit("%)")),
        F.concat(F.lit("Failed jobs:              "), F.col("failed_jobs").cast("string"), F.lit(" ("), pct("failed_jobs"), F.lit("%)")),
        F.concat(F.lit("Average:                  "), _clock(F.col("avg_ms"))), F.concat(F.lit("Median:                   "), _clock(F.col("median_ms"))),
        F.concat(F.lit("Fastest:                  "), _clock(F.col("min_ms"))), F.concat(F.lit("Slowest:                  "), _clock(F.col("max_ms"))),
        F.concat(F.lit("Avg highlights/video:     "), F.format_string("%.1f", F.col("avg_highlights"))), F.concat(F.lit("Montage jobs:             "), F.col("montage_jobs").cast("string")))
    lines = report.select("month", F.lit(0).alias("part"), F.posexplode(head).alias("pos", "line"))
    lines = lines.unionByName(categories.select("month", F.lit(1).alias("part"), F.col("rank").alias("pos"), F.concat(F.lit("  "), F.rpad("value", 20, " "), F.lit(" "), F.col("jobs").cast("string"),
                              F.lit(" ("), F.format_string("%.1f", F.col("percent")), F.lit("%)")).alias("line")))
    lines = lines.unionByName(errors.select("month", F.lit(2).alias("part"), F.col("rank").alias("pos"), F.concat(F.lit("  "), F.rpad("value", 20, " "), F.lit(" "), F.col("jobs").cast("string")).alias("line")))
    # One row per month: the unpartitioned window only ever sees the report table.
    before = F.collect_list(F.struct("month", "total_jobs", "avg_highlights")).over(W.orderBy("month").rowsBetween(-TREND_MONTHS, -1))
    recent = history.withColumn("_b", before).select("month", F.posexplode(F.reverse("_b")).alias("pos", "h")).join(report.select("month"), "month", "left_semi")
    return lines.unionByName(recent.select("month", F.lit(3).alias("part"), "pos", F.concat(F.lit("  "), "h.month", F.lit(": "), F.col("h.total_jobs").cast("string"), F.lit(" jobs, "),
                             F.format_string("%.1f", F.col("h.avg_highlights")), F.lit(" avg highlights")).alias("line")))


def work_plan(videos: DataFrame) -> DataFrame:
    """Per recording flags that later joins use as filters: long, very long, shooter, limits for extra measurements."""
    dur = F.col("duration")
    very, long_, scan = dur >= 4 * 3600, dur >= 2 * 3600, nz(F.col("has_loudness"), False)
    return videos.withColumns({"is_long": long_, "is_very_long": very,
                               "extra_limit": F.when(very, 6).when(long_, 8).when(scan, 12).otherwise(15),
                               "is_shooter": (F.col("category") == "shooter") | nz(F.col("inferred_shooter"), False)})
