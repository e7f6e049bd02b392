"""Transcript lines and windows."""
from __future__ import annotations

from pyspark.sql import functions as F

from tideline import views
from tideline.catalog import query
from tideline.catalog.prefix import sql
from tideline.functions import patterns as p
from tideline.functions import text as tx
from tideline.plans import windows as w
from tideline.session import settle


def _q(pattern):
    return pattern.replace("'", "''")


def _hit(col, pattern):
    return f"(regexp_matches({col}, '(?i){_q(pattern)}'))::INT"


def _hits(col, patterns):
    return "(" + " + ".join(_hit(col, x) for x in patterns) + ")"


CLEAN = f"trim(regexp_replace(regexp_replace(text, '(?i){p.FILLERS}', '', 'g'), '\\s+', ' ', 'g'))"
LINES = f"""cleaned AS (SELECT *, {CLEAN} AS clean, "start" - lag("end") OVER (PARTITION BY video_id ORDER BY seq) AS g0 FROM line),
counted AS (SELECT *, CASE WHEN clean = '' THEN 0 ELSE len(string_split(clean, ' ')) END AS n, len(regexp_extract_all(clean, '{tx.CAPS}')) AS caps,
    greatest(0, coalesce(g0, 0)) AS gap, greatest(0.3, "end" - "start") AS dur FROM cleaned WHERE trim(text) <> ''),
base AS (SELECT *, regexp_matches(clean, '[!?]') OR caps > 0 AS emph, contains(clean, '?') AS ask, contains(clean, '!') AS cry,
    {_hits('clean', p.REACTION)} AS hr, {_hits('clean', p.LORE)} AS hl, {_hits('clean', p.NEGATIVE)} AS hn FROM counted),
scored AS (SELECT *, CASE WHEN clean = '' THEN -5.0::DOUBLE ELSE
    (CASE WHEN n <= 4 THEN CASE WHEN emph THEN 12 ELSE 5 END WHEN n <= 8 THEN CASE WHEN emph THEN 9 ELSE 4 END WHEN n <= 14 THEN 2 WHEN n >= 32 THEN -22 WHEN n >= 24 THEN -14 WHEN n >= 18 THEN -6 ELSE 0 END)::DOUBLE
    + ask::INT * 7 + cry::INT * 8 + (ask AND n <= 12)::INT * 5 + (cry AND n <= 10)::INT * 6 + (regexp_matches(clean, '\\.\\.\\.|—|–|…'))::INT * 2 + least(caps * 2, 8)
    + hr * 9 - hl * 18 - hn * 28 + CASE WHEN gap >= 0.8 THEN least(gap * 2.5, 8) ELSE 0 END
    + CASE WHEN n / dur >= 3.2 AND n <= 16 THEN 6 ELSE 0 END - CASE WHEN n / dur <= 1.4 AND n >= 20 THEN 8 ELSE 0 END END AS score FROM base)"""


def _lines(spark, d):
    return w.scored_lines(views.transcript(spark, d))


@query("silence_gaps", sql("SELECT video_id, seq, round(gap, 6) AS gap FROM counted", "line", more=LINES))
def silence_gaps(spark, d):
    return _lines(spark, d).select("video_id", "seq", F.round("gap", 6).alias("gap"))


@query("line_scores", sql("SELECT video_id, seq, round(score, 6) AS score FROM scored", "line", more=LINES))
def line_scores(spark, d):
    return _lines(spark, d).select("video_id", "seq", F.round("score", 6).alias("score"))


CATS = ["shooter", "moba", "survival", "horror", "racing", "react", "talk", "generic"]


def _profile_sql():
    from tideline.functions.profiles import PROFILES

    parts = []
    for name, prof in PROFILES.items():
        own = f"{_hits('clean', prof['keywords'])} * {prof['keyword_bonus'] + 2}" if prof["keywords"] else "0"
        lore = f"{_hits('clean', prof['lore'])} * {int(prof['lore_penalty'] * 0.85 + 0.5)}" if prof["lore"] else "0"
        parts.append(f"WHEN '{name}' THEN hr * ({prof['keyword_bonus']} - 9) - hl * ({prof['lore_penalty']} - 18) + {own} - {lore}")
    return "CASE cat " + " ".join(parts) + " END"


@query("line_scores_by_profile", sql(f"""SELECT video_id, seq, cat, round(CASE WHEN clean = '' THEN score ELSE score + {_profile_sql()} END, 6) AS score
FROM (SELECT *, (['{"', '".join(CATS)}'])[video_id % 8 + 1] AS cat FROM scored)""", "line", more=LINES))
def line_scores_by_profile(spark, d):
    lines = views.transcript(spark, d).withColumn("cat", F.element_at(F.array(*[F.lit(c) for c in CATS]), (F.col("video_id") % 8 + 1).cast("int")))
    return w.scored_lines(lines, F.col("cat")).select("video_id", "seq", "cat", F.round("score", 6).alias("score"))


@query("filler_strip", sql("SELECT video_id, seq, clean, length(clean) AS n_chars FROM cleaned", "line", more=LINES))
def filler_strip(spark, d):
    lines = views.transcript(spark, d).withColumn("clean", tx.strip_fillers(F.col("text")))
    return lines.select("video_id", "seq", "clean", F.length("clean").cast("bigint").alias("n_chars"))


_FLAGS = f""",
flagged AS (SELECT *, CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS words,
    regexp_matches(text, '[?!]') OR {_hits('text', p.REACTION)} > 0 AS react, {_hits('text', p.LORE)} > 0 AS lore, contains(text, '?') OR {_hit('text', p.SETUP_WORDS)} = 1 AS is_setup,
    {_hits('text', p.NEGATIVE)} AS neg, {_hit('text', p.KILL_WORDS)} = 1 AS killt, {_hit('text', p.BORING_WORDS)} = 1 AS boringt FROM scored),
bounds AS (SELECT video_id, max("end") AS e FROM line GROUP BY 1),
win AS (SELECT video_id, i::INT AS wid, (i * 20)::DOUBLE AS w_start, (i * 20 + 28)::DOUBLE AS w_end FROM bounds, unnest(range(0, (floor(e / 20) + 1)::BIGINT)) AS t(i)),
pairs AS (SELECT f.*, w.wid, w.w_start, w.w_end FROM flagged f JOIN win w ON f.video_id = w.video_id AND f."end" >= w.w_start AND f."start" <= w.w_end),
inwin AS (SELECT *, lag("end") OVER o AS pe, first_value("start") OVER pk AS pat, w_start + (w_end - w_start) * 0.5 AS mid,
    "end" >= w_start + (w_end - w_start) * 0.25 AND "start" <= w_start + (w_end - w_start) * 0.75 AS inn FROM pairs
  WINDOW o AS (PARTITION BY video_id, wid ORDER BY "start", seq), pk AS (PARTITION BY video_id, wid ORDER BY score DESC, "start", seq)),
dead AS (SELECT video_id, wid, sum(CASE WHEN g > 4 THEN least(15, (g - 4) * 3) ELSE 0 END) AS dead FROM (
  SELECT video_id, wid, "start" - lag("end") OVER (PARTITION BY video_id, wid ORDER BY "start", seq) AS g FROM inwin WHERE inn) GROUP BY 1, 2),
runs AS (SELECT video_id, wid, max(len) AS run FROM (SELECT video_id, wid, rid, arg_max("end", ("start", seq)) - min("start") AS len FROM (
  SELECT *, sum(CASE WHEN pe IS NULL OR "start" - pe > 1.2 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, wid ORDER BY "start", seq) AS rid FROM inwin) GROUP BY 1, 2, 3) GROUP BY 1, 2),
agg AS (SELECT video_id, wid, w_start, w_end, count(*) AS n_lines, sum(score) AS total, greatest(0, max(score)) AS peak, max(score) AS peak_score, max(pat) AS peak_at,
    sum(words) AS wsum, sum(greatest(0.3, "end" - "start")) AS speech, sum((words <= 10 AND react)::INT + CASE WHEN score >= 6 AND words <= 14 THEN 0.5 ELSE 0 END) AS reac,
    count(*) FILTER (WHERE words >= 22 OR lore) AS mono, count(*) FILTER (WHERE "start" - pe BETWEEN 0.4 AND 6) AS turns, avg(CASE WHEN "start" - pe BETWEEN 0.4 AND 6 THEN "start" - pe END) AS agap,
    count(*) FILTER (WHERE "start" < pat - 0.2 AND "start" >= w_start) AS nb, coalesce(sum(score) FILTER (WHERE "start" < pat - 0.2 AND "start" >= w_start), 0) AS ctx,
    coalesce(sum(score) FILTER (WHERE "start" > pat + 0.2 AND "start" <= w_end AND (score >= 4 OR react)), 0) AS rea, bool_or("start" > pat + 0.2 AND "start" <= w_end AND score >= 8) AS st8,
    count(*) FILTER (WHERE "start" < mid) AS n1, coalesce(sum(score) FILTER (WHERE "start" < mid), 0) AS t1, coalesce(sum(score) FILTER (WHERE "start" >= mid), 0) AS t2,
    greatest(0, coalesce(max(score) FILTER (WHERE "start" >= mid), 0)) AS p2, bool_or("start" < mid AND is_setup) AS su, sum(neg) AS neg, count(*) FILTER (WHERE killt) AS kills, count(*) FILTER (WHERE boringt) AS borings
  FROM inwin GROUP BY 1, 2, 3, 4),
m1 AS (SELECT *, coalesce(dead0, 0) AS dead, CASE WHEN n1 > 0 THEN t1 / n1 ELSE 0 END AS a1, floor(wsum / greatest(speech, 1) * 60 + 0.5) AS rate, floor(reac + 0.5) AS reactions, speech / greatest(1, w_end - w_start) AS cover
  FROM agg LEFT JOIN (SELECT video_id, wid, dead AS dead0 FROM dead) USING (video_id, wid) JOIN runs USING (video_id, wid)),
m2 AS (SELECT *, p2 >= 8 AND p2 >= a1 * 0.7 AS strong, peak_score >= 8 AS pk, nb >= 1 AND ctx >= 3 AS hc, rea >= 6 OR st8 AS hr2 FROM m1),
m3 AS (SELECT *, (strong::INT * 12 + (su AND p2 >= 6)::INT * 6 - (a1 > 4 AND t2 < t1 * 0.4)::INT * 10) AS arc_score,
    CASE WHEN a1 > 4 AND t2 < t1 * 0.4 THEN 'weak-tail' WHEN (su AND p2 >= 6) OR (strong AND su) THEN 'setup→payoff' WHEN strong THEN 'payoff' ELSE 'flat' END AS arc,
    CASE WHEN pk AND hc AND hr2 THEN 18 WHEN pk AND (hc OR hr2) THEN 10 WHEN pk THEN 4 ELSE 0 END + strong::INT * 8 + (su AND p2 >= 6)::INT * 4 - (a1 > 4 AND p2 < a1 * 0.5)::INT * 8
      + (rate >= 170 AND reactions >= 1)::INT * 5 + (reactions >= 3)::INT * 6 AS bonus,
    CASE WHEN a1 > 4 AND p2 < a1 * 0.5 THEN 'weak-tail' WHEN strong AND su THEN 'setup→payoff' WHEN pk AND hc AND hr2 THEN 'peak+context+reaction' WHEN pk AND hc THEN 'peak+context'
      WHEN pk AND hr2 THEN 'peak+reaction' WHEN pk THEN 'peak-only' ELSE 'flat' END AS label,
    CASE WHEN mono >= 2 THEN 12 + mono * 4 ELSE 0 END + CASE WHEN run >= 18 AND reactions < 2 THEN 14 ELSE 0 END + CASE WHEN cover > 0.82 AND turns < 2 THEN 10 ELSE 0 END AS monopen,
    CASE WHEN turns < 1 AND reactions < 1 THEN 12 WHEN turns < 2 AND mono >= 1 THEN 6 ELSE 0 END AS low FROM m2),
m4 AS (SELECT *, floor(bonus - monopen - low + 0.5) AS tdelta FROM m3),
m5 AS (SELECT *, total + peak * 3 + total / greatest((w_end - w_start) / 10, 1) * 4 + arc_score * 0.6 + tdelta - dead - neg * 20 AS comp FROM m4)"""
METRICS = LINES + _FLAGS


def _grid(spark, d):
    grid = views.transcript_ends(spark, d).withColumn("wid", F.explode(F.sequence(F.lit(0), F.floor(F.col("e") / 20).cast("int"))))
    return grid.select("video_id", "wid", (F.col("wid") * 20).cast("double").alias("w_start"), (F.col("wid") * 20 + 28).cast("double").alias("w_end"))


def _metrics(spark, d):
    return w.window_metrics(_lines(spark, d), _grid(spark, d))


@query("interval_overlap", sql("SELECT video_id, wid, seq FROM pairs", "line", more=METRICS))
def interval_overlap(spark, d):
    return w.window_lines(_lines(spark, d), _grid(spark, d)).select("video_id", "wid", "seq")


@query("window_scores", sql("""SELECT video_id, wid, n_lines, round(total, 4) AS total, round(peak, 4) AS peak, round(total / greatest((w_end - w_start) / 10, 1), 4) AS density FROM agg""", "line", more=METRICS))
def window_scores(spark, d):
    return _metrics(spark, d).select("video_id", "wid", "n_lines", F.round("total", 4).alias("total"), F.round("peak", 4).alias("peak"), F.round("density", 4).alias("density"))


@query("window_transcript_metrics", sql("""SELECT video_id, wid, rate AS speech_rate, reactions AS reaction_lines, mono AS monologue_lines, turns AS interaction_turns,
  round(coalesce(agap, 0), 6) AS avg_gap, round(greatest(0, run), 6) AS longest_run, round(cover, 6) AS speech_coverage FROM m1""", "line", more=METRICS))
def window_transcript_metrics(spark, d):
    return _metrics(spark, d).select("video_id", "wid", F.col("speech_rate").cast("double"), F.col("reaction_lines").cast("double"), "monologue_lines", "interaction_turns",
                                     F.round("avg_gap", 6).alias("avg_gap"), F.round("longest_run", 6).alias("longest_run"), F.round("speech_coverage", 6).alias("speech_coverage"))


@query("window_structure", sql("""SELECT video_id, wid, peak_at, round(ctx, 4) AS context_before, round(rea, 4) AS reaction_after, bonus::INT AS structure_bonus, label AS structure_label,
  monopen::INT AS monologue_penalty, low::INT AS low_interaction, tdelta AS transcript_delta FROM m4""", "line", more=METRICS))
def window_structure(spark, d):
    return _metrics(spark, d).select("video_id", "wid", "peak_at", F.round("context_before", 4).alias("context_before"), F.round("reaction_after", 4).alias("reaction_after"), "structure_bonus",
                                     "structure_label", w.monologue_penalty().cast("int").alias("monologue_penalty"), "low_interaction", w.transcript_delta().cast("double").alias("transcript_delta"))


@query("arc_quality", sql("SELECT video_id, wid, arc_score::INT AS arc_score, arc FROM m3", "line", more=METRICS))
def arc_quality(spark, d):
    return _metrics(spark, d).select("video_id", "wid", "arc_score", "arc")


@query("dead_zone", sql("SELECT video_id, wid, round(dead, 6) AS dead_penalty FROM m1", "line", more=METRICS))
def dead_zone(spark, d):
    return _metrics(spark, d).select("video_id", "wid", F.round("dead_penalty", 6).alias("dead_penalty"))


@query("composite_windows", sql("SELECT video_id, wid, round(comp, 3) AS composite FROM m5", "line", more=METRICS))
def composite_windows(spark, d):
    return _metrics(spark, d).select("video_id", "wid", F.round(w.composite(), 3).alias("composite"))


@query("boring_windows", sql("SELECT video_id, wid, kills AS kill_lines, borings AS boring_lines, borings >= 1 AND kills = 0 AS boring FROM agg", "line", more=METRICS))
def boring_windows(spark, d):
    return _metrics(spark, d).select("video_id", "wid", "kill_lines", "boring_lines", ((F.col("boring_lines") >= 1) & (F.col("kill_lines") == 0)).alias("boring"))


ANCHORS = LINES + """,
anc AS (SELECT video_id, floor("start" / 4) * 4 AS bucket, sum(score) AS score FROM scored GROUP BY 1, 2)"""


@query("anchor_scores", sql("SELECT video_id, bucket, round(score, 4) AS score FROM anc", "line", more=ANCHORS))
def anchor_scores(spark, d):
    return w.anchors(_lines(spark, d)).select("video_id", "bucket", F.round("score", 4).alias("score"))


def _ends(spark, d):
    return views.transcript_ends(spark, d).select("video_id", F.greatest(F.lit(12.0), F.col("e")).alias("video_end"))


@query("anchor_peaks", sql("""SELECT a.video_id, rk::INT AS aid, bucket, coalesce(max(CASE WHEN k18 = 1 THEN st END), max(CASE WHEN k45 = 1 THEN st END), bucket) AS peak FROM (
  SELECT a.video_id, a.rk, a.bucket, s."start" AS st,
    CASE WHEN abs(s."start" - a.bucket) <= 18 THEN row_number() OVER (PARTITION BY a.video_id, a.rk, abs(s."start" - a.bucket) <= 18 ORDER BY s.score DESC, s.seq) END AS k18,
    CASE WHEN abs(s."start" - a.bucket) <= 45 THEN row_number() OVER (PARTITION BY a.video_id, a.rk, abs(s."start" - a.bucket) <= 45 ORDER BY s.score DESC, s.seq) END AS k45
  FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(score, 6) DESC, bucket) AS rk FROM anc) a JOIN scored s ON s.video_id = a.video_id WHERE a.rk <= 28) a GROUP BY 1, 2, 3""", "line", more=ANCHORS))
def anchor_peaks(spark, d):
    return w.top_anchors(settle(_lines(spark, d)), _ends(spark, d)).select("video_id", "aid", "bucket", "peak")


@query("best_shift")
def best_shift(spark, d):
    """The best of nine shifted windows around every strong anchor."""
    lines = settle(_lines(spark, d).select("video_id", *w.LINE))
    return w.best_windows(lines, w.top_anchors(lines, _ends(spark, d))).select("video_id", "aid", "w_start", "w_end", F.round("composite", 3).alias("composite"))
