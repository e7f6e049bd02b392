"""Opening scenes: which moment to show first and which line teases it."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import text as tx
from tideline.functions.numeric import nz
from tideline.operators.ordered import ordered
from tideline.operators.ranges import overlap_join
from tideline.operators.scans import scan_sessions
from tideline.plans.review import clamp_peak, least_peak_offset
from tideline.session import settle

KEY = ["video_id"]
CLIP = ["video_id", "wid"]

# Phrase limits, overlap limits and the lines used when nothing fits.
PHRASE_WORDS, PHRASE_LEAST, PHRASE_GAP = 14, 3, 0.85
PHRASE_OVERLAP, LINE_OVERLAP, FALLBACK_OVERLAP = 0.68, 0.72, 0.65
KEEP_PEAK, KEEP_HOOK = 0.82, 0.75
TEMPLATES = ("Wait until you see this…", "This is about to get wild…", "You need to see what happens next…", "Warte, bis du das siehst…", "Das musst du dir ansehen…")
NO_LINES = "Wait for this…"


def hook_lines(lines: DataFrame) -> DataFrame:
    """Lines with pause, a score that ignores the speaking rate, as the hook rules want, and what their words are worth as opening scene."""
    rows = ordered(lines, KEY, "seq", tile=4096, lag={"_pe": "end"})
    rows = rows.withColumn("gap", F.greatest(F.lit(0.0), F.col("start") - nz(F.col("_pe"), F.col("start")))).drop("_pe")
    rows = tx.measure_lines(rows)
    rows = rows.withColumn("base", tx.line_score(F.col("gap"), F.lit(0.0))).withColumn("opening", tx.measured_teaser_words(F.col("base")))
    return rows.select(*KEY, "seq", "start", "end", "gap", "text", "clean", "base", "opening")


def _in_clip(lines: DataFrame, clips: DataFrame, *more: str) -> DataFrame:
    """Lines with the clips they start in; ``more`` names further columns of the clips."""
    pairs = overlap_join(lines, clips.select(*CLIP, "w_start", "w_end", *more), KEY, (F.col("start"), F.col("start")), (F.col("w_start"), F.col("w_end")))
    dur = F.col("w_end") - F.col("w_start")
    return pairs.withColumn("ratio", F.when(dur > 0, (F.col("start") - F.col("w_start")) / dur).otherwise(0.5))


def teaser_peaks(lines: DataFrame, clips: DataFrame) -> DataFrame:
    """The best line late enough in each clip, else the 72 percent point with the line near it.

    ``lines`` come from :func:`hook_lines`: their words are judged before they meet the clips. One pass over the pairs finds both lines."""
    slim = lines.select(*KEY, "seq", "start", F.trim("text").alias("_line"), F.col("opening").alias("_words"))
    rows = _in_clip(slim, clips)
    dur = F.col("w_end") - F.col("w_start")
    late = F.col("start") - F.col("w_start") >= least_peak_offset(dur)
    at = F.col("w_start") + F.greatest(least_peak_offset(dur), dur * 0.72)
    share = F.when(dur > 0, (at - F.col("w_start")) / dur).otherwise(0.72)
    rows = rows.withColumn("_s", F.col("_words") + tx.teaser_place(F.col("ratio")))
    best = F.when(late, F.struct("_s", -F.col("seq"), -F.col("start")))  # of a line that comes twice the earlier one
    near = F.when(F.abs(F.col("start") - at) < 2.5, F.struct("seq", "start"))
    found = rows.groupBy(*CLIP, "w_start", "w_end").agg(
        F.lit(True).alias("has_lines"), F.max_by(F.struct("start", F.col("_s").alias("score")), best).alias("_b"), F.max_by("_line", best).alias("_b_line"),
        F.min_by(F.col("_words") + tx.teaser_place(share), near).alias("_n_score"), F.min_by("_line", near).alias("_n_line")).drop("w_start", "w_end")
    out = clips.join(found, CLIP, "left")
    silent, given = F.col("has_lines").isNull(), F.col("_b").isNotNull()
    return out.select(
        *clips.columns, nz(F.col("has_lines"), False).alias("has_lines"),
        F.when(silent, F.col("w_start") + dur * 0.72).when(given, F.col("_b.start")).otherwise(at).alias("teaser_at"),
        F.when(silent, "").when(given, F.col("_b_line")).otherwise(nz(F.col("_n_line"), "")).alias("teaser_line"),
        F.when(silent, 0.0).when(given, F.col("_b.score")).otherwise(nz(F.col("_n_score"), 0.0)).alias("teaser_score"))


def phrases(lines: DataFrame, clips: DataFrame) -> DataFrame:
    """Phrases of at most fourteen words per clip; a long pause ends one, words beyond the limit of a line are dropped.

    The scan carries a word count only. A phrase has at least one word per line, so at most fourteen lines.
    """
    counted = lines.select(*KEY, "seq", "start", "end", tx.count_squeezed(F.col("clean")).alias("n"), (F.col("clean") != "").alias("_said"))
    rows = _in_clip(counted, clips).select(*CLIP, "seq", "start", "end", "n", "_said")
    rows = ordered(rows, CLIP, "start", ["seq"], lag={"_pe": "end"})
    rows = rows.filter("_said").withColumn("_pause", F.greatest(F.lit(0.0), F.col("start") - F.col("_pe")))
    rows = rows.withColumn("_mark", F.when(F.col("_pe").isNull() | (F.col("_pause") > PHRASE_GAP), F.col("start")))
    rows = ordered(rows, CLIP, "start", ["seq"], fill={"_sess": "_mark"}).withColumn("_sess", nz(F.col("_sess"), F.col("start")))
    slim = rows.select(*CLIP, "_sess", "start", "seq", "n")

    def step(prev: Column, row: Column) -> Column:
        fresh = prev.isNull() | (prev["n"] >= PHRASE_WORDS)
        return F.struct(F.when(fresh, row["seq"]).otherwise(prev["first"]).cast("int").alias("first"),
                        F.least(F.lit(PHRASE_WORDS), F.when(fresh, row["n"]).otherwise(prev["n"] + row["n"])).cast("int").alias("n"))

    placed = scan_sessions(slim, CLIP, "_sess", "start", ["seq"], "struct<first:int,n:int>", step).select(*CLIP, "seq", F.col("state.first").alias("first"))
    placed = settle(placed.join(clips.select(*CLIP, "w_start", "w_end"), CLIP))
    # Only here is text needed: a line joins the places of its number whose clip it starts in.
    said = lines.filter("clean != ''").select(*KEY, "seq", "start", "clean")
    joined = placed.join(said, [*KEY, "seq"]).filter(F.col("start").between(F.col("w_start"), F.col("w_end")))
    joined = joined.repartition(*CLIP).groupBy(*CLIP, "first").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "clean"))), lambda r: r["clean"]), " ").alias("_t"), F.min("start").alias("start"),
        F.first("w_start").alias("w_start"), F.first("w_end").alias("w_end"))
    words = F.slice(F.split("_t", " "), 1, PHRASE_WORDS)
    return joined.withColumn("_w", words).filter(F.size("_w") >= PHRASE_LEAST).select(*CLIP, F.col("first").alias("seq"), "start", F.array_join("_w", " ").alias("text"), "w_start", "w_end")


def cliffhangers(lines: DataFrame, teasers: DataFrame) -> DataFrame:
    """The best tease per clip: phrases first, then lines, without those that repeat the teaser line.

    Each source settles its best offer per clip, so that what one has shuffled is gone when the next begins."""
    clips = teasers.select(*CLIP, "w_start", "w_end")
    known = teasers.select(*CLIP, "w_start", "w_end", "teaser_at", "teaser_line")
    spoken = tx.measure_lines(phrases(lines, clips)).withColumn("base", tx.line_score(F.lit(0.0), F.lit(0.0)))
    dur = F.col("w_end") - F.col("w_start")
    spoken = spoken.withColumn("ratio", F.when(dur > 0, (F.col("start") - F.col("w_start")) / dur).otherwise(0.5))
    spoken = spoken.select(*CLIP, F.lit(0).alias("src"), "seq", "start", "ratio", "text", "clean", "base").join(known.drop("w_start", "w_end"), CLIP)
    said = lines.select(*KEY, "seq", "start", F.trim("text").alias("text"), "clean", "base").filter("text != ''")
    said = _in_clip(said, known, "teaser_at", "teaser_line").select(*CLIP, F.lit(1).alias("src"), "seq", "start", "ratio", "text", "clean", "base", "teaser_at", "teaser_line")
    offers = settle(_best_offer(spoken, PHRASE_OVERLAP)).unionByName(settle(_best_offer(said, LINE_OVERLAP)))
    best = offers.groupBy(*CLIP).agg(F.max_by("_b", "_o").alias("_b"))
    return teasers.join(best, CLIP, "left").select(*teasers.columns, "_b.*")


def _best_offer(offers: DataFrame, limit: float) -> DataFrame:
    """The best offer of each clip among those that share at most ``limit`` with the teaser line, and its rank."""
    rows = offers.filter(tx.words_shared(tx.long_words(F.col("text")), tx.long_words(F.col("teaser_line"))) <= limit)
    rows = rows.withColumn("_s", tx.cliffhanger_score(F.col("clean"), F.col("base"), F.col("ratio"), F.col("teaser_at"), F.col("start")))
    order = F.struct("_s", (-F.col("src")).alias("_src"), (-F.col("seq")).alias("_seq"))
    return rows.groupBy(*CLIP).agg(F.max_by(F.struct(F.col("clean").alias("cliff_clean"), F.col("_s").alias("cliff_score")), order).alias("_b"), F.max(order).alias("_o"))


def earlier_line(lines: DataFrame, teasers: DataFrame) -> DataFrame:
    """The nearest line at least 1.5 s before the teaser."""
    said = lines.select(*KEY, "seq", "start", F.trim("text").alias("before_text"), F.col("clean").alias("before_clean"))
    rows = _in_clip(said, teasers, "teaser_at").filter((F.col("start") < F.col("teaser_at")) & (F.col("teaser_at") - F.col("start") >= 1.5))
    return rows.groupBy(*CLIP).agg(F.max_by(F.struct("before_text", "before_clean"), F.struct("start", -F.col("seq"))).alias("_e")).select(*CLIP, "_e.*")


def title_tease(title: Column) -> Column:
    """A title of eight to sixty characters as tease, else empty."""
    def judged(v: Column) -> Column:
        n = tx.count_squeezed(v["line"])
        bad = (v["c"] == "") | F.lower(v["c"]).eqNullSafe("top moment") | ~F.length(v["c"]).between(8, 60) | (n < 3) | v["line"].rlike("(?i)" + tx.DANGLING)
        return F.when(bad, "").otherwise(v["line"])

    def closed(c: Column) -> Column:
        return F.struct(c.alias("c"), F.when(c.rlike(r"[?!…]$"), c).otherwise(F.concat(c, F.lit("…"))).alias("line"))

    return tx.once(tx.once(tx.strip_fillers(nz(title, "")), closed), judged)


def _synthetic(title: Column) -> Column:
    template = F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), (F.floor(F.col("teaser_at")) % len(TEMPLATES) + 1).cast("int"))
    use_before = nz(F.col("before_text"), "") != ""
    use_before = use_before & (tx.word_overlap(nz(F.col("before_text"), ""), nz(F.col("teaser_line"), "")) < FALLBACK_OVERLAP)
    fallback = F.when(use_before, tx.format_cliffhanger(nz(F.col("before_clean"), ""))).otherwise(template)
    spoken = tx.once(tx.strip_fillers(nz(F.col("teaser_line"), "")), lambda teaser: F.when((F.length(teaser) >= 12) & tx.valid_cliffhanger(teaser), tx.format_cliffhanger(teaser)).otherwise(fallback))
    return tx.once(title_tease(title), lambda given: F.when(given != "", given).otherwise(spoken))


def analyse(lines: DataFrame, clips: DataFrame) -> DataFrame:
    """Teaser, tease and teaser length per clip. ``lines`` come from :func:`hook_lines` and should be settled."""
    teasers = settle(teaser_peaks(lines, clips))
    rows = cliffhangers(lines, teasers).join(settle(earlier_line(lines, teasers)), CLIP, "left")
    made = tx.format_cliffhanger(nz(F.col("cliff_clean"), ""))
    rows = rows.withColumn("_made", F.when(nz(F.col("cliff_score"), -999.0) > -1e9, made).otherwise("")).withColumn("_syn", _synthetic(F.lit("")))
    text = F.when(~F.col("has_lines"), NO_LINES).when(F.col("_made") != "", F.col("_made")).otherwise(F.col("_syn"))
    length = F.when(~F.col("has_lines"), 2.2).otherwise(tx.once(tx.strip_fillers(nz(F.col("teaser_line"), "")), tx.teaser_seconds))
    return rows.withColumns({"tease": text, "cliff_score": nz(F.col("cliff_score"), 0.0), "teaser_sec": length}).drop("_made", "_syn", "cliff_clean")


def score_at(lines: DataFrame, points: DataFrame, at: str) -> DataFrame:
    """Teaser score of the first line within two seconds of a time in the clip, else 0."""
    said = lines.select(*KEY, "seq", "start", "clean", "base")
    rows = _in_clip(said, points.withColumn("_at", F.col(at)), "_at").filter(F.abs(F.col("start") - F.col("_at")) < 2)
    dur = F.col("w_end") - F.col("w_start")
    share = F.when(dur > 0, (F.col("_at") - F.col("w_start")) / dur).otherwise(0.5)
    best = rows.groupBy(*CLIP).agg(F.min_by(tx.teaser_score(F.col("clean"), F.col("base"), share), "seq").alias("score_at"))
    return points.join(best, CLIP, "left").withColumn("score_at", nz(F.col("score_at"), 0.0))


def resolve(lines: DataFrame, clips: DataFrame) -> DataFrame:
    """Merge given peak and hook text ``(given_peak, given_hook, title)`` with the local analysis: a given peak stays
    if its moment is nearly as good, a given text if it reads as a tease and scores well enough."""
    found = settle(analyse(lines, clips))
    rows = score_at(lines, found, "given_peak")
    inside = F.col("given_peak").between(F.col("w_start"), F.col("w_end"))
    peak = F.when(nz(inside & (F.col("score_at") >= F.col("teaser_score") * KEEP_PEAK), False), F.col("given_peak")).otherwise(F.col("teaser_at"))
    rows = rows.withColumn("peak", clamp_peak(F.col("w_start"), F.col("w_end"), peak))
    given = tx.measure_lines(rows.withColumn("_g", F.trim(nz(F.col("given_hook"), ""))), "_g").withColumn("_gb", tx.line_score(F.lit(0.0), F.lit(0.0)))
    ratio = (F.col("peak") - F.col("w_start")) / F.greatest(F.col("w_end") - F.col("w_start"), F.lit(1.0))
    score = tx.cliffhanger_score(F.col("clean"), F.col("_gb"), ratio, F.col("peak"), F.col("peak") - 3)
    made = tx.format_cliffhanger(F.col("clean"))
    keep = (F.col("_g") != "") & (tx.word_overlap(F.col("_g"), F.col("teaser_line")) < 0.7) & tx.valid_cliffhanger(F.col("clean")) & (made != "") & (score >= F.col("cliff_score") * KEEP_HOOK)
    kept = given.withColumn("hook", F.when(keep, made).otherwise(F.col("tease")))
    final = F.when(tx.valid_cliffhanger(tx.strip_fillers(F.col("hook"))), F.col("hook")).otherwise(_synthetic(F.col("title")))
    return kept.select(*clips.columns, "peak", final.alias("hook"), "teaser_sec", F.left("teaser_line", F.lit(160)).alias("teaser_line"), "teaser_score", "cliff_score")


def hook_word_peaks(lines: DataFrame, clips: DataFrame) -> DataFrame:
    """First line of each clip that contains at least two (or all) longer words of the hook text ``given_hook``."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.col("given_hook")), r"[^A-Za-z0-9_äöüßÄÖÜ\s]", " "), r"\s+"), lambda w: F.length(w) > 3)
    rows = _in_clip(lines, clips).join(clips.select(*CLIP, words.alias("_w")), CLIP).filter(F.size("_w") > 0).withColumn("_low", F.lower("text"))
    hits = F.size(F.filter("_w", lambda w: F.contains(F.col("_low"), w)))
    first = rows.filter(hits >= F.least(F.lit(2), F.size("_w"))).groupBy(*CLIP).agg(F.min_by("start", "seq").alias("word_peak"))
    return clips.join(first, CLIP, "left")


