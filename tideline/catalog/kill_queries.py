"""Detection events: filters, de-duplication, engagements, packs and cut lists."""
from __future__ import annotations

from pyspark.sql import functions as F

from tideline import views
from tideline.catalog import query
from tideline.catalog.prefix import sql, tenth
from tideline.functions import events as ev
from tideline.functions.numeric import tenth as tenth_col
from tideline.operators.ordered import gap_sessions, top_per_key
from tideline.plans import kills as k

_KILL = r"(?i)\b(ace|clutch|1v\d|headshot|frag|double|triple|quad|pick|trade|nade|one tap|last|got him|nice|killed|eliminated)\b"
_BORING = r"(?i)\b(plant|planted|defus|holding|hold the|hold this|save|saving|eco|rotate|default|waiting|wait here|lädt|pflanzt|hält|post plant)\b"
_PAYOFF = r"(?i)\b(defus|defuse|defusing|plant|planted|bombe|bomb|clutch)\b"

CONFIRMED = f"""conf_ev AS (
  SELECT *, trim(coalesce(text, '')) AS tx, regexp_matches(trim(coalesce(text, '')), '{_KILL}') AS is_kill,
    regexp_matches(trim(coalesce(text, '')), '{_BORING}') OR regexp_matches(trim(coalesce(text, '')), '{_PAYOFF}') AS is_other
  FROM kill_event),
confirmed AS (
  SELECT * FROM conf_ev WHERE CASE WHEN confidence < 0.4 THEN false WHEN tx <> '' AND is_other AND NOT is_kill THEN false
    WHEN roi = 'bottom_kills' THEN confidence >= 0.65 AND (player_kill OR activity >= 0.15)
    WHEN starts_with(roi, 'top_right') THEN player_kill OR red_highlight OR contains(method, 'red-highlight') OR highlight_score >= 0.03
    WHEN tx <> '' THEN is_kill ELSE confidence >= 0.72 AND activity >= 0.1 END)"""

SESSIONS = """lagged AS (SELECT *, lag("time") OVER w AS prev FROM kill_event WINDOW w AS (PARTITION BY video_id ORDER BY "time", seq)),
sess AS (SELECT *, sum(CASE WHEN prev IS NULL OR "time" - prev > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY "time", seq) AS sid FROM lagged)"""

PACKS = SESSIONS.format(gap=22) + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY video_id, sid ORDER BY "time", seq) AS rn FROM sess),
packs AS (
  SELECT video_id, sid, rn, seq, "time", "time" AS pack_at, seq AS pack_seq, 1 AS pos FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.video_id, n.sid, n.rn, n.seq, n."time",
    CASE WHEN p.pos >= 4 OR n."time" - p.pack_at > 55 THEN n."time" ELSE p.pack_at END,
    CASE WHEN p.pos >= 4 OR n."time" - p.pack_at > 55 THEN n.seq ELSE p.pack_seq END,
    CASE WHEN p.pos >= 4 OR n."time" - p.pack_at > 55 THEN 1 ELSE p.pos + 1 END
  FROM packs p JOIN numbered n ON n.video_id = p.video_id AND n.sid = p.sid AND n.rn = p.rn + 1)"""

FEED = f"""feed AS (SELECT *, {tenth('"time"')} AS anchor, 'kv:' || killer || '>' || victim AS kill_key,
    highlight_score * 100 + confidence * 10 + activity * 5 AS strength FROM kill_event
  WHERE starts_with(roi, 'top_right') AND (player_kill OR red_highlight) AND highlight_score >= 0.055),
keyed AS (SELECT *, min(anchor) OVER (PARTITION BY video_id, kill_key) AS first_at FROM feed WHERE kill_key IS NOT NULL),
grouped AS (SELECT *, CASE WHEN anchor - first_at <= 7 THEN first_at ELSE anchor END AS grp, anchor - first_at <= 7 AS merged FROM keyed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id, kill_key, grp ORDER BY CASE WHEN merged THEN -strength ELSE 0 END,
    CASE WHEN merged THEN "time" ELSE -"time" END, CASE WHEN merged THEN seq ELSE -seq END) AS rk,
    min(anchor) OVER (PARTITION BY video_id, kill_key, grp) AS kill_at, count(*) OVER (PARTITION BY video_id, kill_key, grp) AS readings FROM grouped),
validated AS (SELECT * FROM ranked WHERE rk = 1)"""


@query("confirmed_kills", sql("SELECT video_id, seq, roi, confidence FROM confirmed", "kill_event", more=CONFIRMED))
def confirmed_kills(spark, d):
    return k.confirmed_kills(views.kill_events(spark, d)).select("video_id", "seq", "roi", "confidence")


QUALITY = CONFIRMED + """,
near AS (SELECT a.video_id, a.seq, count(b.seq) AS n, count(*) FILTER (WHERE b.roi = 'bottom_kills' OR b.is_kill) AS nk
  FROM confirmed a JOIN confirmed b ON a.video_id = b.video_id AND b."time" BETWEEN a."time" - 6 AND a."time" + 6 AND a.seq <> b.seq GROUP BY 1, 2),
quality AS (SELECT c.* FROM confirmed c LEFT JOIN near n USING (video_id, seq) WHERE CASE
    WHEN roi = 'bottom_kills' THEN (player_kill AND confidence >= 0.7) OR (confidence >= 0.8 AND activity >= 0.2)
    WHEN starts_with(roi, 'top_right') THEN player_kill OR red_highlight OR contains(method, 'red-highlight') OR highlight_score >= 0.035
    WHEN roi IN ('center_banner', 'top_left') AND tx = '' THEN false WHEN tx <> '' AND NOT is_kill THEN false
    WHEN "time" < 90 AND (tx = '' OR confidence < 0.72) THEN false
    WHEN "time" < 150 AND tx = '' AND coalesce(n, 0) >= 1 AND coalesce(nk, 0) = 0 THEN false ELSE confidence >= 0.55 END)"""


@query("quality_kills", sql("SELECT video_id, seq, roi, confidence FROM quality", "kill_event", more=QUALITY))
def quality_kills(spark, d):
    return k.quality_kills(views.kill_events(spark, d)).select("video_id", "seq", "roi", "confidence")


@query("player_feed_kills", sql("""SELECT video_id, seq, highlight_score FROM kill_event
WHERE starts_with(roi, 'top_right') AND (player_kill OR red_highlight) AND highlight_score >= 0.055""", "kill_event"))
def player_feed_kills(spark, d):
    return k.player_feed_kills(views.kill_events(spark, d)).select("video_id", "seq", "highlight_score")


REASON = "(['pov_killer_match', 'pov_partial_any', 'pov_victim_only', 'pov_name_in_line', 'unknown'])[seq % 5 + 1]"


@query("trusted_kills", sql(f"""SELECT video_id, seq, pov_reason FROM (SELECT *, {REASON} AS pov_reason FROM kill_event)
WHERE (player_kill OR red_highlight) AND pov_reason IN ('pov_killer_match', 'pov_partial_any', 'pov_name_in_line') AND confidence >= 0.55""", "kill_event"))
def trusted_kills(spark, d):
    reasons = F.array(*[F.lit(x) for x in ("pov_killer_match", "pov_partial_any", "pov_victim_only", "pov_name_in_line", "unknown")])
    events = views.kill_events(spark, d).withColumn("pov_reason", F.element_at(reasons, (F.col("seq") % 5 + 1).cast("int")))
    return k.trusted_kills(events).select("video_id", "seq", "pov_reason")


@query("fingerprint_dedupe", sql("""SELECT video_id, kill_key, kill_at AS kill_anchor_time, seq, readings,
  floor(60 + highlight_score * 80 + 0.5) AS kill_quality_score FROM validated""", "kill_event", more=FEED))
def fingerprint_dedupe(spark, d):
    return k.fingerprint_kills(views.kill_events(spark, d)).select("video_id", "kill_key", "kill_anchor_time", "seq", "readings", "kill_quality_score")


@query("quality_pool", sql("""SELECT video_id, seq, true AS validated FROM validated UNION ALL
SELECT video_id, seq, false FROM quality WHERE video_id NOT IN (SELECT video_id FROM validated)""", "kill_event", more=QUALITY + ",\n" + FEED))
def quality_pool(spark, d):
    return k.quality_pool(views.kill_events(spark, d)).select("video_id", "seq", (F.coalesce("validated_by", F.lit("")) != "").alias("validated"))


@query("kill_sessions_gap", sql("""SELECT video_id, min("time") AS session_start, max("time") AS session_end, count(*) AS events FROM sess GROUP BY video_id, sid""",
                                "kill_event", more=SESSIONS.format(gap=22)))
def kill_sessions_gap(spark, d):
    rows = gap_sessions(views.kill_events(spark, d).select("video_id", "time", "seq"), ["video_id"], "time", 22.0, ["seq"])
    return rows.groupBy("video_id", "session_start").agg(F.max("time").alias("session_end"), F.count(F.lit(1)).alias("events"))


@query("engagement_collapse", sql("""SELECT video_id, seq, "time", flashes FROM (SELECT *, count(*) OVER (PARTITION BY video_id, sid) AS flashes,
  row_number() OVER (PARTITION BY video_id, sid ORDER BY starts_with(roi, 'top_right') DESC, confidence * 12 + activity * 20 DESC, "time", seq) AS rk FROM sess)
WHERE rk = 1""", "kill_event", more=SESSIONS.format(gap=4.5)))
def engagement_collapse(spark, d):
    return k.collapse_engagements(views.kill_events(spark, d)).select("video_id", "seq", "time", "flashes")


TIMELINE = """counted AS (SELECT *, sum(CASE WHEN starts_with(roi, 'top_right') THEN 1 ELSE 0 END) OVER (PARTITION BY video_id) AS feeds FROM kill_event),
pool AS (SELECT *, CASE WHEN player_kill OR red_highlight THEN 50 ELSE 0 END + highlight_score * 30 + confidence * 12 +
    CASE WHEN starts_with(roi, 'top_right') THEN 4 ELSE 0 END AS score FROM counted WHERE feeds < 2 OR starts_with(roi, 'top_right')),
plag AS (SELECT *, lag("time") OVER (PARTITION BY video_id ORDER BY "time", seq) AS prev FROM pool),
psess AS (SELECT *, sum(CASE WHEN prev IS NULL OR "time" - prev > 1.6 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY "time", seq) AS sid FROM plag),
ptop AS (SELECT *, max(score) OVER (PARTITION BY video_id, sid) AS top FROM psess),
pbest AS (SELECT *, row_number() OVER (PARTITION BY video_id, sid ORDER BY "time", seq) AS rk FROM ptop WHERE score >= top - 0.05)"""


@query("timeline_dedupe", sql("""SELECT video_id, seq, "time" FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY "time", seq) AS pos FROM pbest WHERE rk = 1)
WHERE pos <= 4""", "kill_event", more=TIMELINE))
def timeline_dedupe(spark, d):
    return k.timeline_dedupe(views.kill_events(spark, d)).select("video_id", "seq", "time")


@query("burst_packs", sql("""SELECT video_id, seq, pack_at, pack_seq, pos FROM packs""", "kill_event", more=PACKS, recursive=True))
def burst_packs(spark, d):
    return k.burst_packs(views.kill_events(spark, d)).select("video_id", "seq", "pack_at", "pack_seq", "pos")


@query("dense_fights", sql("""SELECT video_id, pack_at, pack_seq, count(*) AS kills, max("time") - min("time") AS span, max(g) AS max_gap FROM (
  SELECT *, coalesce("time" - lag("time") OVER (PARTITION BY video_id, pack_at, pack_seq ORDER BY "time", seq), 0) AS g FROM packs)
GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND max("time") - min("time") <= 32 AND max(g) <= 22""", "kill_event", more=PACKS, recursive=True))
def dense_fights(spark, d):
    return k.dense_fights(k.burst_packs(views.kill_events(spark, d))).select("video_id", "pack_at", "pack_seq", "kills", "span", "max_gap")


SMALL = PACKS + """,
member AS (SELECT p.pack_at, p.pack_seq, e.* FROM packs p JOIN kill_event e USING (video_id, seq)),
mfeed AS (SELECT *, sum(CASE WHEN starts_with(roi, 'top_right') THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, pack_seq) AS feeds,
    CASE WHEN player_kill OR red_highlight THEN 50 ELSE 0 END + highlight_score * 30 + confidence * 12 + CASE WHEN starts_with(roi, 'top_right') THEN 4 ELSE 0 END AS score FROM member),
mpool AS (SELECT *, lag("time") OVER (PARTITION BY video_id, pack_seq ORDER BY "time", seq) AS prev FROM mfeed WHERE feeds < 2 OR starts_with(roi, 'top_right')),
mgrp AS (SELECT *, sum(CASE WHEN prev IS NULL OR "time" - prev > 1.6 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, pack_seq ORDER BY "time", seq) AS g FROM mpool),
mtop AS (SELECT *, max(score) OVER (PARTITION BY video_id, pack_seq, g) AS top FROM mgrp),
mkill AS (SELECT * FROM mtop WHERE score >= top - 0.05 QUALIFY row_number() OVER (PARTITION BY video_id, pack_seq, g ORDER BY "time", seq) = 1),
pstat AS (SELECT video_id, pack_seq, count(*) AS n, max("time") - min("time") AS span, min("time") AS t0, max("time") AS t1,
    bool_or(player_kill OR red_highlight) AS marked, sum(CASE WHEN red_highlight OR contains(method, 'red-highlight') THEN 1 ELSE 0 END) >= count(*) / 2 AS red,
    avg(confidence) AS mean_conf FROM mkill GROUP BY 1, 2),
pgap AS (SELECT video_id, pack_seq, max(step) AS max_gap FROM (SELECT video_id, pack_seq, "time" - lag("time") OVER (PARTITION BY video_id, pack_seq ORDER BY "time", seq) AS step FROM mkill) GROUP BY 1, 2),
pk AS (SELECT m.video_id, m.pack_at, m.pack_seq, m."time", m.seq, m.roi, s.*, p.max_gap,
    s.n >= 2 AND s.span <= 32 AND coalesce(p.max_gap, 0) <= 22 AS dense,
    CASE WHEN m.red_highlight OR m.player_kill THEN greatest(0, m."time" + CASE WHEN CASE WHEN s.n = 1 OR (s.n >= 2 AND s.span <= 32 AND coalesce(p.max_gap, 0) <= 22) THEN s.marked ELSE s.red END THEN -0.85 ELSE 0 END)
      ELSE greatest(0, m."time" - CASE m.roi WHEN 'bottom_kills' THEN 0.65 WHEN 'top_right' THEN 0.85 ELSE 0.75 END) END AS anchor,
    CASE WHEN s.n = 1 OR (s.n >= 2 AND s.span <= 32 AND coalesce(p.max_gap, 0) <= 22) THEN s.marked ELSE s.red END AS use_red
  FROM mkill m JOIN pstat s USING (video_id, pack_seq) JOIN pgap p USING (video_id, pack_seq)),
longc AS (SELECT video_id, any_value(pack_at) AS pack_at, pack_seq, 'continuous' AS kind, any_value(n) AS kill_count, any_value(mean_conf) AS mean_conf, any_value(span) AS span, arg_min(anchor, ("time", seq)) AS a0,
    greatest(0, arg_min(anchor, ("time", seq)) - CASE WHEN any_value(use_red) THEN 1.2 ELSE 1.2 END) AS b, least(2592.0, arg_max(anchor, ("time", seq)) + 8) AS e FROM pk WHERE dense GROUP BY video_id, pack_seq),
longf AS (SELECT *, CASE WHEN e - b < 12 THEN least(2592.0, b + 12) ELSE e END AS e2 FROM longc),
nexted AS (SELECT *, lead(anchor) OVER (PARTITION BY video_id, pack_seq ORDER BY "time", seq) AS nx, CASE WHEN use_red THEN 1.0 ELSE 1.2 END AS pre FROM pk WHERE NOT dense),
sized AS (SELECT *, least(8.5, pre + CASE WHEN nx IS NULL THEN 7 ELSE least(7, greatest(0.9, nx - anchor - 0.25)) END) AS nominal, greatest(0, anchor - pre) AS b0 FROM nexted),
placed AS (SELECT *, CASE WHEN b0 + nominal > 2592 THEN greatest(0, 2592.0 - nominal) ELSE b0 END AS b FROM sized),
cut AS (SELECT *, floor(b * 10 + 0.5) / 10 AS st, floor(least(nominal, 2592.0 - b) * 10 + 0.5) / 10 AS du, floor(anchor * 10 + 0.5) / 10 AS pt FROM placed WHERE least(nominal, 2592.0 - b) >= 4.5),
trimmed AS (SELECT *, CASE WHEN lead(st) OVER w - 0.15 - st < du THEN greatest(1.15, floor((lead(st) OVER w - 0.15 - st) * 10 + 0.5) / 10) ELSE du END AS d2
  FROM cut WINDOW w AS (PARTITION BY video_id, pack_seq ORDER BY "time", seq)),
final AS (SELECT *, pt - lag(pt) OVER (PARTITION BY video_id, pack_seq ORDER BY "time", seq) AS jump FROM trimmed WHERE d2 >= 1.15)"""

CLIPS = """SELECT video_id, pack_at, pack_seq, kind, kill_count::INT AS kill_count, start_time, end_time, output_duration, local_score::DOUBLE AS local_score,
  least(95, floor(mean_conf * 100 + 0.5)) AS confidence, floor(span * 10 + 0.5) / 10 AS chain_span FROM (
  SELECT video_id, pack_at, pack_seq, kind, kill_count, floor(b * 10 + 0.5) / 10 AS start_time,
    floor((floor(b * 10 + 0.5) / 10 + floor((e2 - b) * 10 + 0.5) / 10) * 10 + 0.5) / 10 AS end_time, floor((e2 - b) * 10 + 0.5) / 10 AS output_duration,
    58 + 24 * kill_count AS local_score, mean_conf, span FROM longf WHERE e2 - b >= 4
  UNION ALL
  SELECT video_id, pack_at, pack_seq, 'single', 1, st, floor((st + du) * 10 + 0.5) / 10, du, 72, mean_conf, span FROM cut WHERE n = 1 AND du >= 3
  UNION ALL
  SELECT video_id, any_value(pack_at), pack_seq, 'montage', count(*), min(st), floor((arg_max(st, ("time", seq)) + arg_max(d2, ("time", seq))) * 10 + 0.5) / 10,
    floor(sum(d2) * 10 + 0.5) / 10, 50 + 22 * count(*), any_value(mean_conf), any_value(span) FROM final WHERE n >= 2 GROUP BY video_id, pack_seq
  HAVING count(*) >= 2 AND floor(sum(d2) * 10 + 0.5) / 10 >= CASE WHEN count(*) >= 4 THEN 12 WHEN count(*) >= 3 THEN 7 ELSE 4 END
    AND max(pt) - min(pt) <= 55 AND coalesce(max(jump), 0) <= 35)"""


def _clips(spark, d):
    return k.pack_clips(k.burst_packs(views.kill_events(spark, d)), views.RECORDING_SEC, wide_gap=False)


@query("pack_clips", sql(CLIPS, "kill_event", more=SMALL, recursive=True))
def pack_clips(spark, d):
    return _clips(spark, d).drop("segments")


@query("pack_segments", sql("""SELECT video_id, pack_seq, 0 AS place, floor(b * 10 + 0.5) / 10 AS "start", floor((e2 - b) * 10 + 0.5) / 10 AS duration, floor(a0 * 10 + 0.5) / 10 AS peak_time, kill_count::INT AS kill_count FROM longf WHERE e2 - b >= 4
UNION ALL SELECT video_id, pack_seq, 0, st, du, pt, 1 FROM cut WHERE n = 1 AND du >= 3
UNION ALL SELECT video_id, pack_seq, (row_number() OVER (PARTITION BY video_id, pack_seq ORDER BY "time", seq) - 1)::INT, st, d2, pt, 1 FROM (SELECT *, count(*) OVER p AS cuts, sum(d2) OVER p AS total, max(pt) OVER p - min(pt) OVER p AS wide, coalesce(max(jump) OVER p, 0) AS leap
    FROM final WHERE n >= 2 WINDOW p AS (PARTITION BY video_id, pack_seq))
  WHERE cuts >= 2 AND floor(total * 10 + 0.5) / 10 >= CASE WHEN cuts >= 4 THEN 12 WHEN cuts >= 3 THEN 7 ELSE 4 END AND wide <= 55 AND leap <= 35""", "kill_event", more=SMALL, recursive=True))
def pack_segments(spark, d):
    """Every cut of every clip, in order."""
    cuts = _clips(spark, d).select("video_id", "pack_seq", F.posexplode("segments").alias("place", "s"))
    return cuts.select("video_id", "pack_seq", "place", "s.start", "s.duration", "s.peak_time", "s.kill_count")


@query("top_montages", sql(f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY kill_count DESC, local_score DESC, pack_at, pack_seq)::INT AS list_index
FROM ({CLIPS})) WHERE list_index <= 12""", "kill_event", more=SMALL, recursive=True))
def top_montages(spark, d):
    """The best cut lists of every recording: more kills first, then score."""
    clips = _clips(spark, d).drop("segments")
    return top_per_key(clips, ["video_id"], [F.desc("kill_count"), F.desc("local_score"), F.col("pack_at"), F.col("pack_seq")], 12, rank="list_index")


@query("merged_clips", sql(f"""SELECT video_id, min(s) AS clip_start, max(e) AS clip_end, sum(kills)::BIGINT AS kills FROM (
  SELECT *, sum(CASE WHEN prev_end IS NULL OR s > prev_end THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY s, e) AS cid FROM (
    SELECT *, max(e) OVER (PARTITION BY video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM (
      SELECT video_id, greatest(0, min(a) - 4) AS s, least(2592.0, max(a) + 2) AS e, count(*) AS kills FROM (
        SELECT *, sum(CASE WHEN p IS NULL OR a - p > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY a) AS gid FROM (
          SELECT *, lag(a) OVER (PARTITION BY video_id ORDER BY a) AS p FROM (SELECT DISTINCT video_id, {tenth('"time"')} AS a FROM kill_event)))
      GROUP BY video_id, gid))) GROUP BY video_id, cid""", "kill_event"))
def merged_clips(spark, d):
    marks = views.kill_events(spark, d).select("video_id", tenth_col(F.col("time")).alias("anchor"))
    return k.merged_clips(marks, views.RECORDING_SEC)


@query("kill_anchors", sql("""SELECT video_id, seq, CASE WHEN red_highlight OR player_kill THEN greatest(0, "time" - 0.85)
  ELSE greatest(0, "time" - CASE roi WHEN 'bottom_kills' THEN 0.65 WHEN 'top_right' THEN 0.85 ELSE 0.75 END) END AS anchor FROM kill_event""", "kill_event"))
def kill_anchors(spark, d):
    return ev.complete(views.kill_events(spark, d)).select("video_id", "seq", ev.anchor(None, k.RED.offset).alias("anchor"))
