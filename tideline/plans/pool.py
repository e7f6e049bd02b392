"""From transcript, chapters and loudness to the ranked candidate pool of each recording."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.numeric import half_up, nz, tenth
from tideline.functions.text import profile_value
from tideline.operators.greedy import greedy_rank
from tideline.operators.ordered import top_per_key
from tideline.plans import select as s
from tideline.plans import windows as w
from tideline.session import settle

KEY = ["video_id"]
GRID_ID = 1_000_000_000


def candidate_pool(lines: DataFrame, ends: DataFrame, chapters: DataFrame | None = None, peaks: DataFrame | None = None, category: Column | None = None) -> DataFrame:
    """Up to twelve ranked candidates per recording.

    Scored lines are settled once, without their text, because anchors, peaks, tails and window scores all read them. Anchors are walked in
    order of score until 28 have a window of the profile's least length. Their windows and those of the evenly spaced fill
    points are scored in one pass; fill points enter only pools below eight.
    """
    lines = settle(lines.select(*KEY, *w.LINE))
    points = settle(w.top_anchors(lines, ends, chapters, peaks, None).select(*KEY, "aid", "time", "peak", "chapter", "video_end"))
    points = w.worth_scoring(lines, points, category)
    grid = ends.select(*KEY, "video_end", F.posexplode(s.fill_grid(F.col("video_end"))).alias("i", "time")).withColumn("aid", F.col("i") + GRID_ID)
    near = w.peak_line_near(w.peak_line_near(grid, lines, "time", 18.0, "_a"), lines, "time", 45.0, "_b")
    grid = near.select(*KEY, "aid", "time", F.coalesce("_a", "_b", "time").alias("peak"), F.lit(None).cast("string").alias("chapter"), "video_end")
    points = settle(points.unionByName(grid))
    best = w.best_windows(lines, points, category).join(points.select(*KEY, "aid", "chapter", "video_end"), [*KEY, "aid"])
    anchors = best.filter((F.col("aid") < GRID_ID) & (F.col("w_end") - F.col("w_start") >= profile_value(category, "min_clip")))
    best = top_per_key(anchors, KEY, [F.col("aid")], w.MOST_RAW).unionByName(best.filter(F.col("aid") >= GRID_ID))
    rows = best.select(*KEY, F.col("aid").alias("arrival"), tenth(F.col("w_start")).alias("start_time"), tenth(F.col("w_end")).alias("end_time"), half_up(F.col("composite")).cast("double").alias("local_score"),
                       F.lit(0).alias("kills"), F.lit(False).alias("montage"), "chapter", "arc", "video_end")
    rows = settle(rows)
    merged = s.merge_pool(rows.filter(F.col("arrival") < GRID_ID), F.col("video_end"))
    sizes = merged.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    short = rows.select(*KEY).distinct().join(sizes, KEY, "left").filter(nz(F.col("_n"), 0) < s.DEDUPE_MOST + 1).select(*KEY)
    again = merged.join(short, KEY, "left_semi").unionByName(rows.filter(F.col("arrival") >= GRID_ID).join(short, KEY, "left_semi").withColumn("place", F.col("arrival") + 0))
    filled = greedy_rank(again.withColumnRenamed("place", "_p"), KEY, [F.col("_p")], s.clash(s.POOL_OVERLAP, s.POOL_GAP), s.DEDUPE_MOST + 1).drop("_p")
    full = merged.join(short, KEY, "left_anti").unionByName(filled)
    return s.ranked_pool(full)
