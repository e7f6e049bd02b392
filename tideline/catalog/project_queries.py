"""Project library, retention and clean-up."""
from __future__ import annotations

from pyspark.sql import functions as F

from tideline import views
from tideline.catalog import query
from tideline.catalog.prefix import sql
from tideline.operators.ordered import places
from tideline.plans import projects as p

T = "902016000000"
COLS = "id, title, url, source_type, clip_count, created_at, updated_at, expires_at, saved"
NAMES = [c.strip() for c in COLS.split(",")]


def now():
    return F.lit(views.AS_OF_MS)


@query("active_projects", sql(f"SELECT {COLS}, job_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS workspace_available FROM project WHERE saved OR expires_at IS NULL OR expires_at > {T}", "project"))
def active_projects(spark, d):
    spaces = views.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("job_id"))
    return p.active(views.projects(spark, d), now(), spaces).select(*NAMES, "workspace_available")


@query("days_until_expiry", sql(f"""SELECT id, CASE WHEN expires_at IS NULL THEN NULL WHEN expires_at <= {T} THEN 0 ELSE ceil((expires_at - {T}) / 86400000) END::BIGINT AS days FROM project""", "project"))
def days_until_expiry(spark, d):
    return views.projects(spark, d).select("id", p.days_left(F.col("expires_at"), now()).cast("bigint").alias("days"))


@query("library_filter", sql("SELECT id, title FROM project WHERE contains(lower(title), 'build') AND saved", "project"))
def library_filter(spark, d):
    return p.library(views.projects(spark, d), now(), "saved", " BUILD ").select("id", "title")


@query("expiring_projects", sql(f"SELECT id, expires_at FROM project WHERE NOT saved AND expires_at IS NOT NULL AND (expires_at <= {T} OR ceil((expires_at - {T}) / 86400000) <= 3)", "project"))
def expiring_projects(spark, d):
    return p.library(views.projects(spark, d), now(), "expiring").select("id", "expires_at")


@query("expiry_buckets", sql(f"""SELECT label, count(*) AS projects FROM (SELECT CASE WHEN saved OR days IS NULL OR days > 3 THEN NULL WHEN days <= 0 THEN 'today' WHEN days = 1 THEN '1 day' ELSE days::INT || ' days' END AS label
FROM (SELECT *, CASE WHEN expires_at IS NULL THEN NULL WHEN expires_at <= {T} THEN 0 ELSE ceil((expires_at - {T}) / 86400000) END AS days FROM project)) GROUP BY 1""", "project"))
def expiry_buckets(spark, d):
    days = p.days_left(F.col("expires_at"), now())
    return views.projects(spark, d).groupBy(p.expiry_label(F.col("saved"), days).alias("label")).agg(F.count(F.lit(1)).alias("projects"))


@query("library_by_date", sql("SELECT id, updated_at, row_number() OVER (ORDER BY updated_at DESC, id)::BIGINT AS place FROM project", "project"))
def library_by_date(spark, d):
    """All projects in the library's order."""
    return places(views.projects(spark, d), p.library_order("date")).select("id", "updated_at", "place")


@query("library_by_title", sql("SELECT id, row_number() OVER (ORDER BY coalesce(title, ''), id)::BIGINT AS place FROM project", "project"))
def library_by_title(spark, d):
    return places(views.projects(spark, d), p.library_order("title")).select("id", "place")


@query("library_by_kills", sql("SELECT id, row_number() OVER (ORDER BY clip_count DESC, updated_at DESC, id)::BIGINT AS place FROM project", "project"))
def library_by_kills(spark, d):
    rows = views.projects(spark, d).withColumn("peak_kills", F.col("clip_count"))
    return places(rows, p.library_order("kills")).select("id", "place")


FRESH = f"""fresh AS (SELECT id + 700 AS id, 'again ' || title AS title, url, source_type, clip_count + 1 AS clip_count, {T} AS created_at, {T} AS updated_at, {T} + 604800000 AS expires_at, false AS saved FROM project)"""


def _fresh(spark, d):
    return views.projects(spark, d).select(
        (F.col("id") + 700).alias("id"), (F.col("job_id") + 700).alias("job_id"), F.concat(F.lit("again "), "title").alias("title"), "url", "source_type", (F.col("clip_count") + 1).alias("clip_count"),
        now().alias("created_at"), now().alias("updated_at"), (now() + 7 * p.DAY_MS).alias("expires_at"), F.lit(False).alias("saved"))


@query("upsert_projects", sql("""SELECT coalesce(f.id, o.id) AS id, CASE WHEN f.id IS NULL THEN o.title ELSE f.title END AS title, coalesce(o.created_at, f.created_at) AS created_at,
  coalesce(o.saved, f.saved) AS saved, CASE WHEN f.id IS NULL THEN o.expires_at WHEN o.saved THEN NULL ELSE f.expires_at END AS expires_at FROM project o FULL JOIN fresh f ON o.id = f.id""", "project", more=FRESH))
def upsert_projects(spark, d):
    return p.upsert(views.projects(spark, d), _fresh(spark, d)).select("id", "title", "created_at", "saved", "expires_at")


@query("update_projects", sql(f"""SELECT id, CASE WHEN source_type = 'local' THEN 'patched' ELSE title END AS title, CASE WHEN source_type = 'local' THEN id % 2 = 0 ELSE saved END AS saved,
  CASE WHEN source_type = 'local' THEN CASE WHEN id % 2 = 0 THEN NULL ELSE coalesce(expires_at, {T} + 604800000) END ELSE expires_at END AS expires_at, CASE WHEN source_type = 'local' THEN {T} ELSE updated_at END AS updated_at FROM project""", "project"))
def update_projects(spark, d):
    base = views.projects(spark, d)
    patches = base.filter("source_type = 'local'").select("id", (F.col("id") % 2 == 0).alias("saved"), F.lit("patched").alias("title"), F.lit(None).cast("bigint").alias("expires_at"))
    return p.update(base, patches, now()).select("id", "title", "saved", "expires_at", "updated_at")


@query("delete_projects", sql("SELECT id FROM project WHERE id NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')", "project"))
def delete_projects(spark, d):
    gone = views.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    return p.delete(views.projects(spark, d), gone).select("id")


@query("newest_projects", sql("SELECT id, created_at FROM project ORDER BY created_at DESC, id LIMIT 200", "project"))
def newest_projects(spark, d):
    return p.newest(views.projects(spark, d)).select("id", "created_at")


@query("merge_lists", sql("""SELECT coalesce(l.id, s.id) AS id, CASE WHEN l.id IS NULL THEN s.title ELSE l.title END AS title, coalesce(s.saved, l.saved) AS saved, s.id IS NOT NULL AS from_server,
  CASE WHEN l.id IS NULL THEN s.expires_at WHEN coalesce(l.saved, false) OR coalesce(s.saved, false) THEN NULL ELSE coalesce(l.expires_at, s.expires_at) END AS expires_at FROM fresh l FULL JOIN project s ON l.id = s.id""", "project", more=FRESH))
def merge_lists(spark, d):
    return p.merge_lists(_fresh(spark, d), views.projects(spark, d)).select("id", "title", "saved", "from_server", "expires_at")


@query("protected_jobs", sql(f"SELECT DISTINCT job_id FROM project WHERE saved OR expires_at > {T}", "project"))
def protected_jobs(spark, d):
    return p.protected_ids(views.projects(spark, d), now())


@query("prune_projects", sql(f"SELECT id FROM project WHERE NOT (NOT saved AND expires_at IS NOT NULL AND expires_at <= {T} AND created_at < {T} - 60 * 86400000::BIGINT)", "project"))
def prune_projects(spark, d):
    return p.prune(views.projects(spark, d), now(), 60).select("id")


@query("prune_without_age", sql("SELECT id FROM project", "project"))
def prune_without_age(spark, d):
    return p.prune(views.projects(spark, d), now()).select("id")


@query("stale_workspaces", sql(f"""SELECT o_orderkey AS dir, job_id FROM (SELECT o_orderkey, o_custkey AS job_id, epoch_ms(o_orderdate) AS mtime, o_orderstatus = 'F' AS has_meta FROM orders)
WHERE job_id NOT IN (SELECT job_id FROM project WHERE saved OR expires_at > {T}) AND {T} - mtime > CASE WHEN has_meta THEN 604800000 ELSE 1800000 END""", "project"))
def stale_workspaces(spark, d):
    dirs = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("dir"), F.col("o_custkey").alias("job_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("mtime"), (F.col("o_orderstatus") == "F").alias("has_meta"))
    return p.stale_workspaces(dirs, p.protected_ids(views.projects(spark, d), now()), now()).select("dir", "job_id")


CLASS = "(['workspace', 'preview', 'debug', 'log'])[l_orderkey % 4 + 1]"
FILES = f"""dirs AS (SELECT {CLASS} AS class, l_orderkey AS dir, l_orderkey % 20000 AS job_id, sum(l_quantity)::BIGINT AS bytes, max(epoch_ms(l_shipdate)) AS mtime, count(*) AS files FROM lineitem GROUP BY 1, 2, 3),
gone AS (SELECT * FROM dirs WHERE {T} - mtime > 86400000::BIGINT * CASE class WHEN 'workspace' THEN 3 WHEN 'preview' THEN 7 WHEN 'debug' THEN 14 ELSE 30 END
  AND job_id NOT IN (SELECT job_id FROM project WHERE saved OR expires_at > {T}))"""


def _gone(spark, d):
    kinds = F.array(*[F.lit(c) for c in ("workspace", "preview", "debug", "log")])
    files = views.table(spark, d, "lineitem").select(F.element_at(kinds, (F.col("l_orderkey") % 4 + 1).cast("int")).alias("class"), F.col("l_orderkey").alias("dir"), (F.col("l_orderkey") % 20000).alias("job_id"),
                                                     F.col("l_quantity").cast("bigint").alias("size"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("mtime"))
    return p.deep_cleanup(files, p.protected_ids(views.projects(spark, d), now()), now())


@query("cleanup_candidates", sql("SELECT class, dir, job_id, bytes, mtime, files FROM gone", "project", more=FILES))
def cleanup_candidates(spark, d):
    return _gone(spark, d).select("class", "dir", "job_id", "bytes", "mtime", "files")


@query("cleanup_stats", sql("SELECT class, count(*) AS dirs_removed, sum(bytes)::BIGINT AS bytes_freed FROM gone GROUP BY 1", "project", more=FILES))
def cleanup_stats(spark, d):
    return p.cleanup_stats(_gone(spark, d))


@query("results_to_projects", sql(f"""SELECT job_id AS id, coalesce(CASE WHEN job_id % 5 <> 0 THEN category END, CASE WHEN job_id % 10 <> 0 THEN 'src' END, 'Video') AS title, coalesce(source_type, 'youtube') AS source_type,
  highlights AS clip_count, {T} + 604800000 AS expires_at, false AS saved FROM job WHERE status = 'completed'""", "job"))
def results_to_projects(spark, d):
    done = views.jobs(spark, d).filter("status = 'completed'").select("job_id", F.when(F.col("job_id") % 5 != 0, F.col("category")).alias("title"), F.when(F.col("job_id") % 10 != 0, F.lit("src")).alias("source_name"),
                                                                      "url", "source_type", "highlights")
    return p.from_results(done, now()).select("id", "title", "source_type", "clip_count", "expires_at", "saved")


@query("history_to_projects", sql("""SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR ELSE 'legacy-' || at_ms END AS id, CASE WHEN o_orderstatus = 'P' THEN 'Video' ELSE o_orderpriority END AS title, at_ms AS created_at, at_ms + 604800000 AS expires_at
FROM (SELECT *, epoch_ms(o_orderdate) AS at_ms FROM orders)"""))
def history_to_projects(spark, d):
    rows = views.table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).alias("job_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("at"),
                                                  F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")).alias("title"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("source_type"))
    return p.from_history(rows, now()).select("id", "title", "created_at", "expires_at")


HL = """hl AS (SELECT l_orderkey AS id, l_partkey * 10 + l_linenumber AS seq, l_quantity::INT AS kills, l_extendedprice / 1000 AS duration, l_discount * 100 AS viral_score, l_returnflag AS platform FROM lineitem)"""


def _highlights(spark, d):
    return views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").cast("int").alias("kills"), (F.col("l_extendedprice") / 1000).alias("duration"),
                                                    (F.col("l_discount") * 100).alias("viral_score"), F.array("l_returnflag").alias("platform_fit"))


@query("project_peaks", sql("SELECT p.id, coalesce(max(kills), 0) AS peak_kills, max(duration) AS peak_duration FROM project p LEFT JOIN hl ON hl.id = p.id GROUP BY 1", "project", more=HL))
def project_peaks(spark, d):
    return p.peaks(views.projects(spark, d), _highlights(spark, d)).select("id", "peak_kills", "peak_duration")


@query("best_highlight", sql("SELECT id, seq, kills, duration, viral_score FROM hl QUALIFY row_number() OVER (PARTITION BY id ORDER BY viral_score DESC, seq) = 1", more=HL))
def best_highlight(spark, d):
    return p.best_highlight(_highlights(spark, d)).select("id", "seq", "kills", "duration", "viral_score")


def _feed(name, sort_by, order, platform="all", where="true"):
    @query(name, sql(f"SELECT id, seq, row_number() OVER (PARTITION BY id ORDER BY {order})::INT AS place FROM hl WHERE {where}", more=HL))
    def run(spark, d):
        return p.clip_feed(_highlights(spark, d), platform, sort_by).select("id", "seq", "place")


_feed("clip_feed_score", "score", "viral_score DESC, seq")
_feed("clip_feed_kills", "kills", "kills DESC, viral_score DESC, seq")
_feed("clip_feed_duration", "duration", "duration DESC, seq")
_feed("clip_feed_platform", "score", "viral_score DESC, seq", "R", "platform = 'R'")
