"""Project library, retention and clean-up work lists."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.numeric import nz

DAY_MS = 24 * 60 * 60 * 1000
# Days a project, a workspace, a preview, a debug export and a log are kept; most list entries.
RETENTION_DAYS, EXPIRING_DAYS = 7, 3
WORKSPACE_DAYS, PREVIEW_DAYS, DEBUG_DAYS, LOG_DAYS = 3, 7, 14, 30
BARE_WORKSPACE_MS = 30 * 60 * 1000
LIST_CAP, RECENT_CAP = 200, 50


def days_left(expires: Column, as_of: Column) -> Column:
    """Whole days until expiry, 0 once past, null without expiry."""
    left = expires - as_of
    return F.when(expires.isNull() | (expires == 0), None).when(left <= 0, 0).otherwise(F.ceil(left / DAY_MS))


def active(projects: DataFrame, as_of: Column, workspaces: DataFrame | None = None, saved_only: bool = False) -> DataFrame:
    keep = F.col("saved") if saved_only else (F.col("saved") | nz(F.col("expires_at"), 0).eqNullSafe(F.lit(0)) | (F.col("expires_at") > as_of))
    out = projects.filter(keep)
    if workspaces is None:
        return out
    known = workspaces.select("job_id").distinct().withColumn("workspace_available", F.lit(True))
    return out.join(known, "job_id", "left").withColumn("workspace_available", nz(F.col("workspace_available"), False))


def library(projects: DataFrame, as_of: Column, tab: str = "all", query: str = "") -> DataFrame:
    out = projects
    if tab == "saved":
        out = out.filter("saved")
    elif tab == "expiring":
        out = out.filter(~F.col("saved") & nz(days_left(F.col("expires_at"), as_of) <= EXPIRING_DAYS, False))
    needle = query.strip().lower()
    return out.filter(F.contains(F.lower("title"), F.lit(needle))) if needle else out


def library_order(sort_by: str = "date") -> list[Column]:
    newest = F.desc(F.coalesce("updated_at", "created_at"))
    if sort_by == "title":
        return [F.collate(F.coalesce("title", F.lit("")), "DE_CI"), F.col("id")]
    if sort_by == "kills":
        return [F.desc("peak_kills"), newest, F.col("id")]
    return [newest, F.col("id")]


def expiry_label(saved: Column, days: Column) -> Column:
    return F.when(saved | days.isNull() | (days > 3), None).when(days <= 0, "today").when(days == 1, "1 day").otherwise(F.format_string("%d days", days))


def upsert(projects: DataFrame, fresh: DataFrame) -> DataFrame:
    """New results replace old rows but keep creation time and the saved flag; saved rows never expire."""
    old = projects.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in projects.columns if c != "id"])
    both = old.join(fresh, F.col("_id") == F.col("id"), "full_outer")
    new, had = F.col("id").isNotNull(), F.col("_id").isNotNull()
    pick = {c: F.when(new, F.col(c)).otherwise(F.col(f"_{c}")) for c in projects.columns if c not in ("id", "created_at", "saved", "expires_at")}
    pick["id"] = F.coalesce("id", "_id")
    pick["created_at"] = F.when(had & (nz(F.col("_created_at"), 0) != 0), F.col("_created_at")).otherwise(F.col("created_at"))
    pick["saved"] = F.when(had, F.col("_saved")).otherwise(F.col("saved"))
    pick["expires_at"] = F.when(new & nz(F.col("_saved"), False), None).when(new, F.col("expires_at")).otherwise(F.col("_expires_at"))
    return both.select(*[pick[c].alias(c) for c in projects.columns])


def update(projects: DataFrame, patches: DataFrame, as_of: Column) -> DataFrame:
    """Apply ``(id, saved, title, expires_at)`` patches; null means unchanged, saving clears the expiry."""
    p = patches.select(F.col("id"), F.col("saved").alias("_s"), F.col("title").alias("_t"), F.col("expires_at").alias("_e"))
    joined = projects.join(p.withColumn("_hit", F.lit(True)), "id", "left")
    saved = F.coalesce("_s", "saved")
    expiry = F.when(saved, None).otherwise(F.coalesce("_e", "expires_at", as_of + RETENTION_DAYS * DAY_MS))
    hit = nz(F.col("_hit"), False)
    out = {"saved": F.when(hit, saved).otherwise(F.col("saved")), "title": F.coalesce("_t", "title"),
           "expires_at": F.when(hit, expiry).otherwise(F.col("expires_at")), "updated_at": F.when(hit, as_of).otherwise(F.col("updated_at"))}
    return joined.select(*[out.get(c, F.col(c)).alias(c) for c in projects.columns])


def delete(projects: DataFrame, ids: DataFrame) -> DataFrame:
    return projects.join(ids.select("id"), "id", "left_anti")


def newest(projects: DataFrame, most: int = LIST_CAP) -> DataFrame:
    return projects.orderBy(F.desc("created_at"), "id").limit(most)


def merge_lists(local: DataFrame, server: DataFrame) -> DataFrame:
    """Local rows win column by column, except the saved flag; a row saved on either side never expires."""
    s = server.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in server.columns if c != "id"])
    both = local.join(s, F.col("id") == F.col("_id"), "full_outer")
    have_l, have_s = F.col("id").isNotNull(), F.col("_id").isNotNull()
    saved_any = nz(F.col("saved"), False) | nz(F.col("_saved"), False)
    out = {c: F.when(have_l, F.col(c)).otherwise(F.col(f"_{c}")) for c in local.columns if c not in ("id", "saved", "expires_at")}
    out["id"] = F.coalesce("id", "_id")
    out["saved"] = F.coalesce("_saved", "saved")
    out["expires_at"] = F.when(~have_l, F.col("_expires_at")).when(saved_any, None).otherwise(F.coalesce("expires_at", "_expires_at"))
    return both.select(*[out[c].alias(c) for c in local.columns], have_s.alias("from_server"))


def protected_ids(projects: DataFrame, as_of: Column) -> DataFrame:
    return projects.filter(F.col("saved") | (F.col("expires_at") > as_of)).select("job_id").distinct()


def prune(projects: DataFrame, as_of: Column, max_age_days: int | None = None) -> DataFrame:
    """Rows that stay. Without an age nothing goes; with one, unsaved, expired and old rows go."""
    if not max_age_days:
        return projects
    cutoff = as_of - max_age_days * DAY_MS
    gone = ~F.col("saved") & nz(F.col("expires_at") != 0, False) & nz(F.col("expires_at") <= as_of, False) & nz((F.col("created_at") != 0) & (F.col("created_at") < cutoff), False)
    return projects.filter(~gone)


def stale_workspaces(dirs: DataFrame, protected: DataFrame, as_of: Column) -> DataFrame:
    """Unprotected workspaces older than seven days, or half an hour without a result document."""
    limit = F.when(F.col("has_meta"), F.lit(RETENTION_DAYS * DAY_MS)).otherwise(BARE_WORKSPACE_MS)
    return dirs.join(protected, "job_id", "left_anti").filter(as_of - F.col("mtime") > limit)


def deep_cleanup(files: DataFrame, protected: DataFrame, as_of: Column) -> DataFrame:
    """Directories and logs past their class's age, with size. ``files`` is one row per file
    ``(class, dir, job_id, size, mtime)``; sizes add up before the shuffle."""
    age = (F.when(F.col("class") == "workspace", WORKSPACE_DAYS).when(F.col("class") == "preview", PREVIEW_DAYS)
           .when(F.col("class") == "debug", DEBUG_DAYS).when(F.col("class") == "log", LOG_DAYS))
    dirs = files.groupBy("class", "dir", "job_id").agg(F.sum("size").alias("bytes"), F.max("mtime").alias("mtime"), F.count(F.lit(1)).alias("files"))
    return dirs.filter(as_of - F.col("mtime") > age.cast("bigint") * DAY_MS).join(protected, "job_id", "left_anti")


def cleanup_stats(removed: DataFrame) -> DataFrame:
    return removed.groupBy("class").agg(F.count(F.lit(1)).alias("dirs_removed"), F.sum("bytes").alias("bytes_freed"))


def from_results(results: DataFrame, as_of: Column) -> DataFrame:
    """Finished results ``(job_id, title, source_name, url, source_type, highlights)`` as project rows."""
    return results.filter(F.col("job_id").isNotNull()).select(
        F.col("job_id").alias("id"), "job_id", F.coalesce("title", "source_name", F.lit("Video")).alias("title"), nz(F.col("url"), "").alias("url"),
        nz(F.col("source_type"), "youtube").alias("source_type"), nz(F.col("highlights"), 0).cast("int").alias("clip_count"), as_of.alias("created_at"), as_of.alias("updated_at"),
        (as_of + RETENTION_DAYS * DAY_MS).alias("expires_at"), F.lit(False).alias("saved"))


def from_history(history: DataFrame, as_of: Column) -> DataFrame:
    """Legacy history rows ``(job_id, at, title, url, source_type)`` as project rows."""
    at = F.coalesce(F.nullif(F.col("at"), F.lit(0)), as_of)
    return history.select(
        F.coalesce("job_id", F.concat(F.lit("legacy-"), F.col("at").cast("string"))).alias("id"), "job_id", nz(F.nullif(F.col("title"), F.lit("")), "Video").alias("title"), nz(F.col("url"), "").alias("url"),
        nz(F.col("source_type"), "youtube").alias("source_type"), F.lit(0).alias("clip_count"), at.alias("created_at"), at.alias("updated_at"), (at + RETENTION_DAYS * DAY_MS).alias("expires_at"), F.lit(False).alias("saved"))


def peaks(projects: DataFrame, highlights: DataFrame) -> DataFrame:
    """Most kills and longest clip per project, from its highlights ``(id, kills, duration)``."""
    best = highlights.groupBy("id").agg(F.max(nz(F.col("kills"), 0)).alias("peak_kills"), F.max("duration").alias("peak_duration"))
    return projects.join(best, "id", "left").withColumn("peak_kills", nz(F.col("peak_kills"), 0))


def best_highlight(highlights: DataFrame, by: str = "viral_score") -> DataFrame:
    kept = [c for c in highlights.columns if c != "id"]
    return highlights.groupBy("id").agg(F.max_by(F.struct(*kept), F.struct(nz(F.col(by), 0.0), -F.col("seq"))).alias("_b")).select("id", "_b.*")


def clip_feed(highlights: DataFrame, platform: str = "all", sort_by: str = "score") -> DataFrame:
    """Highlights of a platform with their place in the feed of their job."""
    rows = highlights if platform in ("", "all") else highlights.filter(F.array_contains("platform_fit", platform))
    order = {"score": [F.desc(nz(F.col("viral_score"), 0.0))], "kills": [F.desc(nz(F.col("kills"), 0)), F.desc(nz(F.col("viral_score"), 0.0))],
             "duration": [F.desc("duration")], "order": []}[sort_by]
    return rows.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy(*order, "seq")))
