"""Monthly job reports."""
from __future__ import annotations

from pyspark.sql import functions as F

from tideline import views
from tideline.catalog import query
from tideline.catalog.prefix import sql
from tideline.plans import reports as r


def _jobs(spark, d):
    return r.normalise_jobs(views.jobs(spark, d))


DUR = """med AS (SELECT month, took_ms AS median_ms FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY took_ms) AS rn, count(*) OVER (PARTITION BY month) AS n
  FROM jobx WHERE took_ms IS NOT NULL) WHERE rn = n // 2 + 1),
dur AS (SELECT month, avg(took_ms) AS avg_ms, min(took_ms) AS min_ms, max(took_ms) AS max_ms, count(*) AS timed, any_value(median_ms) AS median_ms
  FROM jobx JOIN med USING (month) WHERE took_ms IS NOT NULL GROUP BY month)"""
REPORT = DUR + """,
report AS (SELECT month, count(*) AS total_jobs, count(*) FILTER (WHERE completed AND NOT failed) AS completed_jobs, count(*) FILTER (WHERE failed) AS failed_jobs,
  avg(highlights) AS avg_highlights, count(*) FILTER (WHERE montage) AS montage_jobs, avg(kills) AS avg_kills FROM jobx GROUP BY month)"""


@query("duration_stats", sql("SELECT month, round(avg_ms, 4) AS avg_ms, min_ms, max_ms, timed, median_ms FROM dur", "job", more=DUR))
def duration_stats(spark, d):
    return r.duration_stats(_jobs(spark, d)).withColumn("avg_ms", F.round("avg_ms", 4))


@query("monthly_report", sql("""SELECT month, total_jobs, completed_jobs, failed_jobs, round(avg_highlights, 6) AS avg_highlights, montage_jobs, round(avg_kills, 6) AS avg_kills,
  round(avg_ms, 4) AS avg_ms, min_ms, max_ms, timed, median_ms FROM report LEFT JOIN dur USING (month)""", "job", more=REPORT))
def monthly_report(spark, d):
    return r.monthly_report(_jobs(spark, d)).withColumns({c: F.round(c, n) for c, n in {"avg_highlights": 6, "avg_kills": 6, "avg_ms": 4}.items()})


def _breakdown(name, column):
    @query(name, sql(f"""SELECT month, {column} AS value, count(*) AS jobs, floor(count(*) * 1000 / any_value(total) + 0.5) / 10 AS percent,
  row_number() OVER (PARTITION BY month ORDER BY count(*) DESC, {column})::INT AS rank
FROM (SELECT *, count(*) OVER (PARTITION BY month) AS total FROM jobx) WHERE {column} IS NOT NULL GROUP BY month, {column}""", "job"))
    def run(spark, d):
        return r.breakdown(_jobs(spark, d), column)


_breakdown("category_percent", "category")
_breakdown("source_breakdown", "source")
_breakdown("error_breakdown", "error")


@query("breakdown_grouping_sets", sql("""SELECT month, category, source, count(*) AS jobs, grouping_id(month, category, source)::BIGINT AS level FROM jobx
GROUP BY GROUPING SETS ((month, category), (month, source), (month))""", "job"))
def breakdown_grouping_sets(spark, d):
    return r.breakdown_sets(_jobs(spark, d))


@query("report_trend", sql("SELECT month, total_jobs, round(avg_highlights, 1) AS avg_highlights FROM report ORDER BY month DESC LIMIT 6", "job", more=REPORT))
def report_trend(spark, d):
    return r.trend(r.monthly_report(_jobs(spark, d)))


@query("report_history", sql("SELECT month, total_jobs FROM report ORDER BY month DESC LIMIT 12", "job", more=REPORT))
def report_history(spark, d):
    return r.monthly_report(_jobs(spark, d)).orderBy(F.desc("month")).limit(r.HISTORY_MONTHS).select("month", "total_jobs")


def _clock_sql(ms):
    return f"CASE WHEN coalesce({ms}, 0) = 0 THEN 'N/A' ELSE printf('%dm %ds', floor(floor({ms} / 1000) / 60)::BIGINT, floor({ms} / 1000)::BIGINT % 60) END"


def _counts_sql(column):
    return f"""SELECT month, {column} AS value, count(*) AS jobs, floor(count(*) * 1000 / any_value(total) + 0.5) / 10 AS percent, (row_number() OVER (PARTITION BY month ORDER BY count(*) DESC, {column}))::INT AS pos
  FROM (SELECT *, count(*) OVER (PARTITION BY month) AS total FROM jobx) WHERE {column} IS NOT NULL GROUP BY month, {column}"""


TEXT_REPORT = f"""SELECT month, 0 AS part, (i - 1)::INT AS pos, ls[i] AS line FROM (SELECT month, [
  'Monthly report: ' || month, 'Total jobs processed:     ' || total_jobs,
  'Successful completions:   ' || completed_jobs || ' (' || printf('%.1f', floor((completed_jobs * 100.0::DOUBLE / total_jobs) * 10 + 0.5) / 10) || '%)',
  'Failed jobs:              ' || failed_jobs || ' (' || printf('%.1f', floor((failed_jobs * 100.0::DOUBLE / total_jobs) * 10 + 0.5) / 10) || '%)',
  'Average:                  ' || {_clock_sql('avg_ms')}, 'Median:                   ' || {_clock_sql('median_ms')},
  'Fastest:                  ' || {_clock_sql('min_ms')}, 'Slowest:                  ' || {_clock_sql('max_ms')},
  'Avg highlights/video:     ' || printf('%.1f', floor((avg_highlights) * 10 + 0.5) / 10), 'Montage jobs:             ' || montage_jobs] AS ls FROM report LEFT JOIN dur USING (month)), unnest(range(1, 11)) AS t(i)
UNION ALL SELECT month, 1, pos, '  ' || rpad(value, 20, ' ') || ' ' || jobs || ' (' || printf('%.1f', percent) || '%)' FROM ({_counts_sql('category')})
UNION ALL SELECT month, 2, pos, '  ' || rpad(value, 20, ' ') || ' ' || jobs FROM ({_counts_sql('error')})
UNION ALL SELECT month, 3, (back - 1)::INT, '  ' || m || ': ' || n || ' jobs, ' || printf('%.1f', floor((a) * 10 + 0.5) / 10) || ' avg highlights' FROM (
  SELECT r.month, b.month AS m, b.total_jobs AS n, b.avg_highlights AS a, row_number() OVER (PARTITION BY r.month ORDER BY b.month DESC) AS back FROM report r JOIN report b ON b.month < r.month) WHERE back <= {r.TREND_MONTHS}"""


@query("text_report", sql(TEXT_REPORT, "job", more=REPORT))
def text_report(spark, d):
    """The monthly report as text lines."""
    jobs = _jobs(spark, d)
    report = r.monthly_report(jobs)
    return r.text_report(report, r.breakdown(jobs, "category"), r.breakdown(jobs, "error"), report)


@query("previous_month_key", sql("SELECT DISTINCT o_orderdate::DATE AS day, strftime(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH, '%Y-%m') AS previous, strftime(o_orderdate, '%Y-%m') AS month FROM orders"))
def previous_month_key(spark, d):
    day = F.to_date("o_orderdate")
    return views.table(spark, d, "orders").select(day.alias("day"), r.previous_month(day).alias("previous"), r.month_key(day).alias("month")).distinct()


@query("work_plan", sql("""SELECT video_id, duration >= 7200 AS is_long, duration >= 14400 AS is_very_long, CASE WHEN duration >= 14400 THEN 6 WHEN duration >= 7200 THEN 8 WHEN has_loudness THEN 12 ELSE 15 END AS extra_limit,
  category = 'shooter' AS is_shooter FROM (SELECT o_orderkey AS video_id, o_totalprice / 20 AS duration, o_orderkey % 2 = 0 AS has_loudness, CASE WHEN o_orderpriority = '2-HIGH' THEN 'shooter' ELSE 'talk' END AS category FROM orders)"""))
def work_plan(spark, d):
    videos = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("video_id"), (F.col("o_totalprice") / 20).alias("duration"), (F.col("o_orderkey") % 2 == 0).alias("has_loudness"),
                                                    F.when(F.col("o_orderpriority") == "2-HIGH", "shooter").otherwise("talk").alias("category"), F.lit(False).alias("inferred_shooter"))
    return r.work_plan(videos).select("video_id", "is_long", "is_very_long", "extra_limit", "is_shooter")
