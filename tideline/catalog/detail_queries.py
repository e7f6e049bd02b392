"""Smaller rules on candidates, clips and lines: opening scenes, trims, lengths, scores of picks, flags, reasons."""
from __future__ import annotations

from pyspark.sql import functions as F

from tideline import views
from tideline.catalog import query
from tideline.catalog.prefix import sql
from tideline.catalog.select_queries import CAND, _cand
from tideline.catalog.shooter_queries import FLAGGED
from tideline.catalog.story_queries import PANELS, _hits
from tideline.catalog.text_queries import LINES, METRICS, _grid, _lines, _profile_sql
from tideline.functions import frames as fr
from tideline.functions import text as tx
from tideline.plans import classify as cl
from tideline.plans import panels as pn
from tideline.plans import review as r
from tideline.plans import select as s
from tideline.plans import shooter as sh
from tideline.plans import windows as w
from tideline.session import settle


@query("kill_line_scores", sql(f"""SELECT video_id, seq, round(CASE WHEN kill THEN score + {_profile_sql()} + 12 ELSE 0 END, 6) AS score FROM (SELECT *, 'shooter' AS cat FROM scored) JOIN (SELECT video_id, seq, kill FROM flag) USING (video_id, seq)""",
                                "line", "long_line", more=FLAGGED + ",\n" + LINES.replace("FROM line)", "FROM ln)", 1).replace("greatest(0, coalesce(g0, 0)) AS gap", "0.0 AS gap").replace('greatest(0.3, "end" - "start") AS dur', "1.0 AS dur")))
def kill_line_scores(spark, d):
    """Value of every line as a kill line."""
    lines = views.long_lines(spark, d).withColumn("text", F.trim("text")).filter("text <> ''")
    return tx.measure_lines(lines).select("video_id", "seq", F.round(tx.shooter_line_score(F.lit("shooter")), 6).alias("score"))


GRID = """win AS (SELECT DISTINCT video_id, i::INT AS wid, i * 20.0::DOUBLE AS w_start, i * 20.0::DOUBLE + 28 AS w_end FROM ln, range(0, 32) AS g(i)),
seen AS (SELECT w.video_id, w.wid, count(*) AS kills FROM win w JOIN kill_event e ON e.video_id = w.video_id AND e.confidence >= 0.5 AND e."time" BETWEEN w_start - 0.5 AND w_end + 0.5 GROUP BY 1, 2)"""


@query("worthy_candidates", sql("""SELECT video_id, wid FROM win w LEFT JOIN seen USING (video_id, wid) WHERE coalesce(kills, 0) >= 2
  OR EXISTS (SELECT 1 FROM flag f JOIN ln l USING (video_id, seq) WHERE f.video_id = w.video_id AND f.kill AND trim(l.text) <> '' AND greatest(l."end", l."start") >= w_start AND l."start" <= w_end)""", "line", "long_line", "long_event", more=FLAGGED + ",\n" + GRID))
def worthy_candidates(spark, d):
    """Windows that show a fight: two events, or a kill line."""
    lines = views.long_lines(spark, d)
    spans = lines.select("video_id").distinct().withColumn("wid", F.explode(F.sequence(F.lit(0), F.lit(31)))).select("video_id", "wid", (F.col("wid") * F.lit(20.0)).alias("w_start"), (F.col("wid") * F.lit(20.0) + 28).alias("w_end"))
    seen = w.event_boost(views.long_events(spark, d), spans).select("video_id", "wid", "w_start", "w_end", F.when(F.col("kills") >= 2, F.array(F.lit("hud-kills"))).otherwise(F.expr("cast(array() as array<string>)")).alias("flags"))
    return sh.worthy(seen, w.scored_lines(lines)).select("video_id", "wid")


@query("normalised_highlights", sql("""SELECT video_id, seq, s AS start_time, CASE WHEN e - s < 12 THEN s + 12 WHEN e - s > 45 THEN s + 45 ELSE e END AS end_time FROM (
  SELECT video_id, seq, coalesce(a, 0) AS s, CASE WHEN coalesce(b, 0) = 0 THEN coalesce(a, 0) + 25 ELSE b END AS e FROM (
  SELECT video_id, seq, CASE WHEN kills > 0 THEN start_time END AS a, CASE WHEN confidence >= 50 THEN start_time + local_score ELSE 0 END AS b FROM cand))""", "kill_event", more=CAND))
def normalised_highlights(spark, d):
    start, end = s.normalise_highlight(F.when(F.col("kills") > 0, F.col("start_time")), F.when(F.col("confidence") >= 50, F.col("start_time") + F.col("local_score")).otherwise(0.0))
    return _cand(spark, d).select("video_id", "seq", start.alias("start_time"), end.alias("end_time"))


_SHOWN = CAND + """,
shown AS (SELECT *, end_time - start_time AS len, CASE WHEN kills > 0 THEN start_time + local_score / 2 END AS peak, local_score / 40 AS teaser FROM cand)"""


def _shown(spark, d):
    return _cand(spark, d).withColumns({"len": F.col("end_time") - F.col("start_time"), "peak": F.when(F.col("kills") > 0, F.col("start_time") + F.col("local_score") / 2), "teaser": F.col("local_score") / 40})


@query("opening_teasers", sql("""SELECT video_id, seq, montage AND len >= 8 AND (CASE WHEN teaser = 0 THEN 2.2 ELSE teaser END) >= 0.5 AND coalesce(peak >= start_time AND peak <= end_time AND peak - start_time >= off, false) AS opens,
  round(CASE WHEN peak IS NULL THEN start_time + len * 0.72 ELSE greatest(start_time + off, least(end_time - 0.5, peak)) END, 6) AS teaser_peak, round(pin, 6) AS peak_in_clip, round(main, 6) AS main_duration,
  round(CASE WHEN pin >= main - teaser - 0.2 OR least(main, pin + 0.15) - greatest(0, least(main, pin + 0.15) - teaser) < teaser - 0.05 THEN greatest(0, main - teaser) ELSE greatest(0, least(main, pin + 0.15) - teaser) END, 6) AS teaser_start
FROM (SELECT *, greatest(moff, least(main - 0.35, coalesce(peak - start_time, main * 0.72))) AS pin FROM (SELECT *, greatest(10, greatest(8, len) * 0.38) AS off, greatest(1, len) AS main, greatest(10, greatest(8, greatest(1, len)) * 0.38) AS moff FROM shown))""", "kill_event", more=_SHOWN))
def opening_teasers(spark, d):
    """Which clips open with a teaser, the peak it shows and where it lies."""
    start, end, peak, teaser = (F.col(n) for n in ("start_time", "end_time", "peak", "teaser"))
    at = r.teaser_window(start, end, peak, teaser)
    return _shown(spark, d).select("video_id", "seq", r.wants_cold_open(F.col("montage"), start, end, peak, teaser).alias("opens"), F.round(r.clamp_peak(start, end, peak), 6).alias("teaser_peak"),
                                   *[F.round(at[n], 6).alias(n) for n in ("peak_in_clip", "main_duration", "teaser_start")])


@query("export_peaks", sql("""SELECT video_id, seq, round(CASE WHEN montage THEN greatest(start_time + greatest(10, greatest(8, len) * 0.38), least(end_time - 0.5, p)) ELSE p END, 6) AS peak FROM (
  SELECT *, least(greatest(coalesce(start_time + CASE WHEN seq % 3 = 0 THEN teaser END, CASE WHEN seq % 2 = 0 THEN start_time + 5 END, peak, start_time + len * 0.72), start_time + 0.3), end_time - 0.3) AS p FROM shown)""", "kill_event", more=_SHOWN))
def export_peaks(spark, d):
    start, end = F.col("start_time"), F.col("end_time")
    peak = r.export_peak(start, end, F.when(F.col("seq") % 3 == 0, F.col("teaser")), F.when(F.col("seq") % 2 == 0, start + 5), F.col("peak"), F.col("montage"))
    return _shown(spark, d).select("video_id", "seq", F.round(peak, 6).alias("peak"))


def _clamped(start, end):
    """Trim limits in SQL, as a pair of expressions."""
    s0 = f"greatest(0, {start})"
    e1 = f"least(2592.0, greatest({s0} + 8, CASE WHEN {end} = 0 THEN {s0} + 28 ELSE {end} END))"
    s1 = f"least({s0}, greatest(0, {e1} - 8))"
    return s1, f"CASE WHEN {e1} - {s1} > 60 THEN {s1} + 60 WHEN {e1} - {s1} < 8 THEN {s1} + 8 ELSE {e1} END"


(_S1, _E1), (_S2, _E2), (_S3, _E3) = _clamped("pk - off", "pk - off + len2"), _clamped("pk - (len2 - 4)", "least(2592.0, pk + 4)"), _clamped("greatest(0, pk - 8)", "greatest(0, pk - 8) + len2")


@query("trims_around_peak", sql(f"""SELECT video_id, seq, round(CASE WHEN pk BETWEEN s1 - 0.2 AND e1 + 0.2 THEN s1 WHEN pk BETWEEN s2 - 0.2 AND e2 + 0.2 THEN s2 ELSE s3 END, 6) AS start_time,
  round(CASE WHEN pk BETWEEN s1 - 0.2 AND e1 + 0.2 THEN e1 WHEN pk BETWEEN s2 - 0.2 AND e2 + 0.2 THEN e2 ELSE e3 END, 6) AS end_time FROM (SELECT *, {_S1} AS s1, {_E1} AS e1, {_S2} AS s2, {_E2} AS e2, {_S3} AS s3, {_E3} AS e3 FROM (
  SELECT *, greatest(greatest(10, greatest(8, len2) * 0.38), least(len2 - 0.35, len2 * 0.72)) AS off FROM (SELECT *, coalesce(peak, start_time + 3) AS pk, least(greatest(greatest(len, 24), 8), 60) AS len2 FROM shown)))""", "kill_event", more=_SHOWN))
def trims_around_peak(spark, d):
    """Trim windows that hold the peak at about 72 percent."""
    rows = _shown(spark, d).withColumn("pk", F.coalesce("peak", F.col("start_time") + 3))
    trim = r.trim_around_peak(F.col("start_time"), F.col("end_time"), F.col("pk"), F.lit(views.RECORDING_SEC))
    return rows.select("video_id", "seq", F.round(trim["start"], 6).alias("start_time"), F.round(trim["end"], 6).alias("end_time"))


@query("clip_lengths", sql("""SELECT video_id, seq, round(CASE WHEN coalesce(m > 0.5, false) THEN m WHEN coalesce(teaser > 0.5, false) THEN teaser ELSE greatest(1, len) END, 6) AS shown,
  round(CASE WHEN montage THEN CASE WHEN coalesce(m > 0.5, false) THEN m ELSE teaser END WHEN seq % 2 = 0 THEN CASE WHEN coalesce(m > 0.5, false) THEN m ELSE greatest(1, len) + 2.2 END
    WHEN coalesce(m > 0.5 AND abs(m - greatest(1, len)) <= 0.35, false) THEN m ELSE greatest(1, len) END, 6) AS length FROM (SELECT *, CASE WHEN seq % 4 > 0 THEN len + seq % 3 * 0.2 - 0.1 END AS m FROM shown)""", "kill_event", more=_SHOWN))
def clip_lengths(spark, d):
    """Displayed and rendered lengths of clips with and without a measurement."""
    m, start, end = F.when(F.col("seq") % 4 > 0, F.col("len") + F.col("seq") % 3 * 0.2 - 0.1), F.col("start_time"), F.col("end_time")
    shown = s.display_duration(m, F.col("teaser"), start, end)
    made = s.clip_duration(F.col("montage"), m, F.col("teaser"), start, end, F.col("seq") % 2 == 0, F.lit(2.2))
    return _shown(spark, d).select("video_id", "seq", F.round(shown, 6).alias("shown"), F.round(made, 6).alias("length"))


@query("zoom_times", sql("""SELECT video_id, seq, list_transform(list_sort(list_filter(list_distinct(list_filter([start_time + 1, start_time + 1, end_time + 1, peak, start_time + least(2.5, len * 0.12)], lambda z: z IS NOT NULL)), lambda z: z BETWEEN start_time AND end_time)), lambda z: round(z, 6)) AS zooms FROM shown""", "kill_event", more=_SHOWN))
def zoom_times(spark, d):
    start, end = F.col("start_time"), F.col("end_time")
    zooms = s.zoom_moments(F.array(start + 1, start + 1, end + 1), start, end, F.col("peak"))
    return _shown(spark, d).select("video_id", "seq", F.transform(zooms, lambda z: F.round(z, 6)).alias("zooms"))


_REASON = """rs AS (SELECT *, trim(coalesce(CASE WHEN seq % 4 = 0 THEN text END, '')) AS own, trim(coalesce(CASE WHEN seq % 3 = 0 THEN text END, '')) AS line, trim(CASE WHEN seq % 5 = 0 THEN 'Top moment' WHEN seq % 5 < 3 THEN killer || ' on ' || victim ELSE '' END) AS title FROM kill_event)"""


@query("highlight_reasons", sql("""SELECT video_id, seq, CASE WHEN length(own) >= 10 THEN left(own, 280) WHEN length(line) >= 6 THEN CASE WHEN length(line) > 260 THEN left(line, 257) || '…' ELSE line END
  WHEN coalesce(title, '') NOT IN ('', 'Top moment') THEN 'Strong moment: “' || title || '” — works well as a short.'
  ELSE 'Engaging segment from ' || floor("time" / 60)::BIGINT || ':' || lpad(floor("time" % 60)::BIGINT::VARCHAR, 2, '0') || ' with clear payoff.' END AS reason FROM rs""", "kill_event", more=_REASON))
def highlight_reasons(spark, d):
    """A reason for every event seen as a highlight."""
    title = F.when(F.col("seq") % 5 == 0, "Top moment").when(F.col("seq") % 5 < 3, F.concat("killer", F.lit(" on "), "victim")).otherwise("")
    reason = s.highlight_reason(F.when(F.col("seq") % 4 == 0, F.col("text")), [F.when(F.col("seq") % 3 == 0, F.col("text"))], title, F.col("time"))
    return views.kill_events(spark, d).select("video_id", "seq", reason.alias("reason"))


_PICKS = CAND + """,
pick AS (SELECT *, viral_score AS tsc, local_score AS c_score, confidence - 20 AS c_audio, list_filter([CASE WHEN seq % 7 = 0 THEN 'hype-moment' END, CASE WHEN montage THEN 'multikill-montage' END, CASE WHEN seq % 6 = 0 THEN 'kill-chain' END,
  CASE WHEN seq % 4 = 0 THEN 'hud-kills' END, CASE WHEN seq % 9 = 0 THEN 'kill-feed' END], lambda x: x IS NOT NULL) AS fl FROM cand),
pscore AS (SELECT *, tsc * 2 + kills + c_score * 0.15 + c_audio * 0.5 + CASE WHEN list_contains(fl, 'hype-moment') THEN 30 ELSE 0 END + CASE WHEN list_contains(fl, 'multikill-montage') THEN 45 ELSE 0 END + CASE WHEN list_contains(fl, 'kill-chain') THEN 25 ELSE 0 END
  + CASE WHEN list_contains(fl, 'hud-kills') THEN 40 ELSE 0 END + CASE WHEN list_contains(fl, 'kill-feed') THEN 30 ELSE 0 END + CASE WHEN abs(start_time - 1200) < 420 THEN 25 ELSE 0 END AS score FROM pick),
ploud AS (SELECT *, max(score) OVER (PARTITION BY video_id) AS top, (seq % 8 = 0) OR len(list_filter(fl, lambda x: x <> 'hype-moment')) > 0 OR c_audio >= 60 OR list_contains(fl, 'hype-moment') AS loud FROM pscore)"""


@query("pick_scores", sql("""SELECT video_id, seq, round(score, 6) AS score, ((tsc >= 8) OR loud) AND (confidence >= 62 OR score / (CASE WHEN top = 0 THEN 1 ELSE top END) >= 0.72 OR loud) AS strong FROM ploud""", "kill_event", more=_PICKS))
def pick_scores(spark, d):
    """Value of picks with focus and whether they are strong enough to be kept."""
    from pyspark.sql import Window as W

    flag = lambda cond, name: F.when(cond, name)
    q = F.col("seq")
    flags = F.array_compact(F.array(flag(q % 7 == 0, "hype-moment"), flag(F.col("montage"), "multikill-montage"), flag(q % 6 == 0, "kill-chain"), flag(q % 4 == 0, "hud-kills"), flag(q % 9 == 0, "kill-feed")))
    rows = _cand(spark, d).withColumns({"c_score": F.col("local_score"), "c_audio": (F.col("confidence") - 20).cast("double"), "c_flags": flags, "c_montage": q % 8 == 0})
    rows = rows.withColumn("score", s.pick_score(s.window_text_score(F.col("viral_score"), F.col("kills")), F.col("start_time"), F.lit(1200.0)))
    top = F.max("score").over(W.partitionBy("video_id"))
    return rows.withColumn("top", top).select("video_id", "seq", F.round("score", 6).alias("score"), s.strong_pick(F.col("viral_score"), F.col("confidence"), F.col("score"), F.col("top")).alias("strong"))


@query("refined_clips", sql("""SELECT video_id, seq, CASE WHEN cut THEN lead ELSE st END AS start_time, CASE WHEN apply THEN r_end ELSE end_time END AS end_time, CASE WHEN weak THEN least(84.0, greatest(confidence, confidence + gain)) ELSE confidence END::DOUBLE AS confidence, weak AS boosted, cut AS dead_air FROM (
  SELECT *, weak AND lead > st + 1.2 AS cut, floor(greatest(0, after - before) * 1.5 + 0.5) + CASE WHEN apply AND better THEN 4 ELSE 0 END AS gain FROM (SELECT *, greatest(st, speech - 0.6) AS lead FROM (SELECT *, CASE WHEN apply THEN r_start ELSE start_time END AS st FROM (
  SELECT *, weak AND (better OR confidence < 62 OR after >= before - 1) AS apply FROM (SELECT *, confidence < 75 AND NOT montage AS weak, after > before + 2 AS better FROM (
  SELECT *, start_time - 2 AS r_start, end_time + 3 AS r_end, viral_score AS before, viral_score + seq % 6 - 2 AS after, start_time + seq % 4 AS speech FROM cand))))))""", "kill_event", more=CAND))
def refined_clips(spark, d):
    """Weak clips with the better window, less dead air and more confidence."""
    rows = _cand(spark, d).withColumns({"hook_peak": F.col("start_time") + 4, "confidence": F.col("confidence").cast("double")})
    better = rows.select("video_id", "seq", (F.col("start_time") - 2).alias("r_start"), (F.col("end_time") + 3).alias("r_end"), (F.col("start_time") + 5).alias("r_peak"), F.col("viral_score").alias("before"),
                         (F.col("viral_score") + F.col("seq") % 6 - 2).alias("after"), (F.col("start_time") + F.col("seq") % 4).cast("double").alias("first_speech"))
    return s.refine_weak(rows, better).select("video_id", "seq", "start_time", "end_time", "confidence", "boosted", "dead_air")


@query("talked_panels", sql("""SELECT video_id, named, round(CASE WHEN named THEN least(1.0, conf + 0.12) ELSE conf END, 6) AS confidence, round(CASE WHEN named THEN least(10000, e0 + 0.8) ELSE e0 END, 6) AS end_time FROM (
  SELECT video_id, round_even(least(10000, s1), 2) AS e0, round_even(least(1.0, mean / (607.0 * 1080 * 0.08)), 3) AS conf, coalesce((SELECT bool_or(length(l.text) % 5 = 0) FROM line l WHERE l.video_id = t.video_id AND l."start" BETWEEN 0 AND 10000), false) AS named FROM timed t)""", "line", more=PANELS))
def talked_panels(spark, d):
    """Panels that the speech of their recording names; the prose has no such words, so a line's length decides which lines do."""
    hits = _hits(spark, d).withColumn("score", pn.panel_score(F.col("x") + 450, F.col("y") + 200, F.col("w"), F.col("h"), 1920.0, 1080.0)).filter("score > 0")
    panels = pn.best_panel(hits, F.lit(0.0), F.lit(10000.0), 1920.0, 1080.0)
    lines = views.transcript(spark, d).withColumn("text", F.when(F.length("text") % 5 == 0, F.concat(F.lit("look at the menu: "), "text")).otherwise(F.col("text")))
    made = pn.boost_by_talk(panels, lines, F.lit(10000.0))
    return made.select("video_id", "named", F.round("confidence", 6).alias("confidence"), F.round("end_time", 6).alias("end_time"))


REGIONS = ["top_right", "top_center", "bottom_bar", "hotbar"]


def _frames(spark, d):
    """Lines as the on-screen text of frames, with a density per region from the length of the text."""
    n = F.length("text")
    density = F.create_map(*[x for i, r in enumerate(REGIONS) for x in (F.lit(r), (n % (i + 3)) / 4987)])
    return views.long_lines(spark, d).select("video_id", F.col("seq").alias("frame"), "text", density.alias("density"))


def _frame_sql():
    """Points per frame and game in SQL."""
    parts = []
    for i, sig in enumerate(fr.SIGNATURES):
        text = " + ".join(f"CASE WHEN regexp_matches(text, '(?i){x}') THEN {sig['weight']} ELSE 0 END" for x in sig["patterns"])
        shape = "".join(f" + CASE WHEN {r} >= {limit} THEN 2.8 ELSE 0 END" for r, limit in fr.LAYOUT.get(sig["category"], {}).items())
        parts.append(f"SELECT video_id, '{sig['category']}' AS category, '{sig['game']}' AS game, {i} AS pos, ({text}{shape})::DOUBLE AS points FROM dens")
    sums = ", ".join(f"sum((length(text) % {i + 3})::DOUBLE / 4987) OVER o AS {r}" for i, r in enumerate(REGIONS))
    return f"""dens AS (SELECT video_id, seq, text, {sums} FROM ln WINDOW o AS (PARTITION BY video_id ORDER BY seq)),
pts AS ({" UNION ALL ".join(parts)}),
games AS (SELECT video_id, category, game, round(sum(points), 6) AS score, min(pos) AS pos FROM pts WHERE points > 0 GROUP BY 1, 2, 3)"""


@query("frame_scores", sql("""SELECT video_id, category, game, score, place, CASE WHEN place = 1 THEN CASE WHEN score >= 45 THEN 94 WHEN score >= 30 THEN 86 WHEN score >= 18 THEN 76 WHEN score >= 10 THEN 64 ELSE 50 END END AS confidence
FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, pos)::INT AS place FROM games) WHERE place <= 8""", "line", "long_line", more=_frame_sql()))
def frame_scores(spark, d):
    """The best games of every recording by on-screen text and layout."""
    scores = cl.frame_scores(_frames(spark, d), fr.SIGNATURES, fr.LAYOUT)
    return cl.shown_scores(scores, fr.SHOWN_SCORES).select("video_id", "category", "game", "score", "place", "confidence")


@query("frame_layout", sql("SELECT video_id, count(*) AS frames, " + ", ".join(f"floor(sum((length(text) % {i + 3})::DOUBLE / 4987) / count(*) * 10000 + 0.5) / 10000 AS {r}" for i, r in enumerate(REGIONS)) + " FROM ln GROUP BY 1", "line", "long_line"))
def frame_layout(spark, d):
    return cl.frame_layout(_frames(spark, d), REGIONS)


DOSSIER = METRICS + """,
pr AS (SELECT video_id, wid, seq, trim(text) AS tx, "start" AS s, score, w_start + 14 AS pa FROM pairs),
pz AS (SELECT video_id, wid, coalesce(min({'s': s, 'q': seq}) FILTER (WHERE abs(s - pa) < 1.5), arg_max({'s': s, 'q': seq}, (score, -s, -seq))) AS pk FROM pr GROUP BY 1, 2),
rl AS (SELECT pr.*, pk, CASE WHEN s < pk.s - 0.3 THEN 'b' WHEN s > pk.s + 0.3 THEN 'a' ELSE 'n' END AS part FROM pr JOIN pz USING (video_id, wid)),
rk AS (SELECT *, row_number() OVER (PARTITION BY video_id, wid ORDER BY s, seq) AS r1, row_number() OVER (PARTITION BY video_id, wid, part ORDER BY s DESC, seq DESC) AS rb, row_number() OVER (PARTITION BY video_id, wid, part ORDER BY s, seq) AS ra,
  row_number() OVER (PARTITION BY video_id, wid, score > 2 ORDER BY seq) AS rg FROM rl),
tx AS (SELECT video_id, wid, coalesce(string_agg(tx, ' ' ORDER BY s, seq) FILTER (WHERE part = 'b' AND rb <= 2), any_value(tx) FILTER (WHERE r1 = 1)) AS setup, any_value(tx) FILTER (WHERE s = pk.s AND seq = pk.q) AS peak,
  string_agg(tx, ' ' ORDER BY s, seq) FILTER (WHERE part = 'a' AND ra <= 2) AS tail, string_agg(tx, ' ' ORDER BY seq) FILTER (WHERE score > 2 AND rg <= 6) AS ex FROM rk GROUP BY 1, 2)"""


@query("window_texts", sql("SELECT video_id, wid, left(coalesce(setup, ''), 72) AS setup_line, left(coalesce(peak, ''), 72) AS peak_line, left(coalesce(tail, ''), 72) AS tail_line, left(coalesce(ex, ''), 220) AS excerpt FROM win LEFT JOIN tx USING (video_id, wid)", "line", more=DOSSIER))
def window_texts(spark, d):
    """Setup, peak and tail lines and the excerpt of windows."""
    spans = _grid(spark, d).withColumn("at", F.col("w_start") + 14)
    return w.window_texts(settle(_lines(spark, d)), spans).select("video_id", "wid", "setup_line", "peak_line", "tail_line", "excerpt")
