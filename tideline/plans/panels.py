"""Boxes found in frames: chains of overlapping panels, webcam corners."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.numeric import nz
from tideline.functions.patterns import has
from tideline.operators.ordered import ordered

KEY = ["video_id"]
# Chain gap, overlap, and words that point at an on-screen panel.
CHAIN_GAP, CHAIN_IOU = 4.5, 0.35
PANEL_WORDS = r"\b(buch|bücher|handbuch|menu|menü|inventar|karte|map|screen|screenshot|liest|lesen|reading|journal|tagebuch|ui|interface)\b"


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes with x, y, w, h."""
    iw = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    ih = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    shared = F.when((iw > 0) & (ih > 0), iw * ih).otherwise(0.0)
    return shared / F.greatest(a["w"] * a["h"] + b["w"] * b["h"] - shared, F.lit(1.0))


def panel_score(x: Column, y: Column, bw: Column, bh: Column, w: float, h: float) -> Column:
    """Value of a wide central box: area weighted by centrality and by width beyond the portrait crop."""
    crop = float(int(h * 9 / 16))
    area, aspect = bw * bh, bw / F.greatest(bh, F.lit(1.0))
    dist = F.sqrt(F.pow(x + bw / 2 - w / 2, 2) + F.pow(y + bh / 2 - h / 2, 2))
    ok = area.between(w * h * 0.1, w * h * 0.88) & aspect.between(0.85, 4.2) & (bw >= crop * 1.06) & (dist <= min(w, h) * 0.38)
    return F.when(ok, area * (1 - dist / (min(w, h) * 0.5)) * F.least(bw / max(crop, 1.0), F.lit(2.2))).otherwise(0.0)


def chains(hits: DataFrame) -> DataFrame:
    """Consecutive hits ``(video_id, seq, t, x, y, w, h, score)`` that stay close in time and place."""
    boxed = hits.withColumn("_box", F.struct("x", "y", "w", "h"))
    rows = ordered(boxed, KEY, "t", ["seq"], lag={"_pt": "t", "_pb": "_box"})
    joins = nz((F.col("t") - F.col("_pt") <= CHAIN_GAP) & (iou(F.col("_pb"), F.col("_box")) > CHAIN_IOU), False)
    rows = rows.withColumn("_new", F.when(joins, 0).otherwise(1))
    return ordered(rows, KEY, "t", ["seq"], run_sum={"chain": "_new"}).drop("_pt", "_pb", "_box", "_new")


def best_panel(hits: DataFrame, start: Column, duration: Column, frame_w: float, frame_h: float, least: int = 2) -> DataFrame:
    """The strongest chain per recording as a padded box with its time span and confidence."""
    crop = float(int(frame_h * 9 / 16))
    segs = chains(hits).groupBy(*KEY, "chain").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("w").alias("w"), F.avg("h").alias("h"),
                                                   F.min("t").alias("t0"), F.max("t").alias("t1"))
    best = segs.groupBy(*KEY).agg(F.max_by(F.struct("n", "total", "x", "y", "w", "h", "t0", "t1"), F.struct(F.col("total") * F.col("n"), -F.col("chain"))).alias("_b")).select(*KEY, "_b.*")
    mean = F.col("total") / F.col("n")
    best = best.filter((F.col("n") >= least) & (mean >= crop * frame_h * 0.015))
    mx, my = float(int(frame_w * 0.02)), float(int(frame_h * 0.02))
    x, y, w, h = (F.floor(c) for c in ("x", "y", "w", "h"))
    x1, y1 = F.greatest(F.lit(0.0), x - mx), F.greatest(F.lit(0.0), y - my)
    s0 = F.greatest(start, F.col("t0") - 0.4)
    s1 = F.least(start + duration, F.col("t1") + 1.2)
    s1 = F.when(s1 - s0 < 1.5, F.least(start + duration, s0 + 2.5)).otherwise(s1)
    return best.select(
        *KEY, "n", x1.cast("int").alias("box_x"), y1.cast("int").alias("box_y"), (F.least(F.lit(frame_w), x + w + mx) - x1).cast("int").alias("box_w"), (F.least(F.lit(frame_h), y + h + my) - y1).cast("int").alias("box_h"),
        F.bround(F.greatest(F.lit(0.0), s0 - start), 2).alias("start_time"), F.bround(F.least(duration, s1 - start), 2).alias("end_time"), F.bround(F.least(F.lit(1.0), mean / (crop * frame_h * 0.08)), 3).alias("confidence"))


def boost_by_talk(panels: DataFrame, lines: DataFrame, duration: Column) -> DataFrame:
    """Panels named in the clip's own speech gain confidence and a longer tail."""
    named = lines.filter((F.col("start") >= 0) & (F.col("start") <= duration) & has(F.col("text"), PANEL_WORDS)).select(*KEY, F.lit(True).alias("_named")).distinct()
    rows = panels.join(named, KEY, "left")
    hit = nz(F.col("_named"), False)
    return rows.withColumns({"confidence": F.when(hit, F.least(F.lit(1.0), F.col("confidence") + 0.12)).otherwise(F.col("confidence")),
                             "end_time": F.when(hit, F.least(duration, F.col("end_time") + 0.8)).otherwise(F.col("end_time")), "named": hit}).drop("_named")


def webcam_corner(faces: DataFrame, default: str = "bottom-right") -> DataFrame:
    """The corner with most face area and the best frame. ``faces``: (video_id, t, corner, area, sharp)."""
    corners = faces.filter(F.col("corner").isNotNull()).groupBy(*KEY, "corner").agg(F.sum("area").alias("_a"))
    top = corners.groupBy(*KEY).agg(F.max_by("corner", F.struct("_a", "corner")).alias("corner"))
    frame = faces.groupBy(*KEY).agg(F.max_by("t", F.struct(F.col("area") * (1 + F.col("sharp") / 500), -F.col("t"))).alias("best_t"))
    return frame.join(top, KEY, "left").withColumn("corner", nz(F.col("corner"), default))


def in_region(fx: Column, fy: Column, fw: Column, fh: Column, rx: Column, ry: Column, rw: Column, rh: Column) -> Column:
    cx, cy = fx + fw / 2, fy + fh / 2
    return cx.between(rx, rx + rw) & cy.between(ry, ry + rh)


