"""Parsers, run on texts that Spark builds from the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from tideline import views
from tideline.catalog import query
from tideline.catalog.prefix import sql
from tideline.sources import captions as c
from tideline.sources import records as r


def _clock(sec, comma):
    ms = F.round(sec * 1000).cast("bigint")
    return F.format_string("%d:%02d:%02d" + (",%03d" if comma else ".%03d"), F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def _docs(spark, d):
    return views.table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.split("text", "\n").alias("ls"))


def _escaped(text):
    """A line as caption files hold it: markup characters as entities."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


# One caption per text line: line i starts at 7 i + 0.25 seconds and lasts (i mod 5) + 0.5 seconds.
CAP = """cap AS (SELECT doc_id AS video_id, (i - 1)::INT AS seq, trim(ls[i]) AS text, (i - 1) * 7 + 0.25::DOUBLE AS "start", (i - 1) % 5 + 0.5::DOUBLE AS dur FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS t(i))"""


@query("vtt_cues", sql("""SELECT video_id, text, "start", "start" + dur AS "end" FROM cap WHERE text <> ''""", more=CAP))
def vtt_cues(spark, d):
    cue = lambda s, i: F.concat(_clock(i * 7 + F.lit(0.25), False), F.lit(" --> "), _clock(i * 7 + F.lit(0.25) + i % 5 + 0.5, True), F.lit(" align:start\n<c>"), _escaped(s), F.lit("</c>\n\n"))
    raw = _docs(spark, d).select("video_id", F.concat(F.lit("WEBVTT\r\n\nNOTE made\n\n"), F.array_join(F.transform("ls", cue), "")).alias("content"))
    return c.vtt_cues(raw).select("video_id", "text", "start", "end")


@query("json3_cues", sql("""SELECT video_id, seq, text, "start", "start" + dur AS "end" FROM cap WHERE text <> ''""", more=CAP))
def json3_cues(spark, d):
    ev = lambda s, i: F.struct((i * 7000 + 250).cast("double").alias("tStartMs"), ((i % 5) * 1000 + 500).cast("double").alias("dDurationMs"), F.array(F.struct(_escaped(s).alias("utf8"))).alias("segs"))
    raw = _docs(spark, d).select("video_id", F.to_json(F.struct(F.transform("ls", ev).alias("events"))).alias("content"))
    return c.json3_cues(raw).select("video_id", "seq", "text", "start", "end")


@query("stt_words", sql("""SELECT video_id, seq, text, "start" + 600 AS "start", "start" + 600 + dur AS "end", CASE WHEN seq % 2 = 0 THEN 'A' END AS speaker FROM cap WHERE text <> ''""", more=CAP))
def stt_words(spark, d):
    word = lambda s, i: F.struct(s.alias("word"), (i * 7 + F.lit(0.25)).alias("start"), (i * 7 + F.lit(0.25) + i % 5 + 0.5).alias("end"), F.when(i % 2 == 0, "A").alias("speaker"))
    raw = _docs(spark, d).select("video_id", F.to_json(F.struct(F.lit("de").alias("language"), F.transform("ls", word).alias("words"))).alias("content"), F.lit(600.0).alias("offset"))
    return c.stt_words(raw).select("video_id", "seq", "text", "start", "end", "speaker")


@query("caption_rows", sql("""SELECT video_id, seq, CASE WHEN ("start" * 1000) > 5000 THEN "start" ELSE "start" * 1000 END AS "start", round(CASE WHEN ("start" * 1000) > 5000 THEN "start" ELSE "start" * 1000 END + greatest(0.05, dur), 6) AS "end" FROM cap WHERE text <> ''""", more=CAP))
def caption_rows(spark, d):
    rows = _docs(spark, d).select("video_id", F.posexplode("ls").alias("seq", "text"))
    rows = rows.withColumns({"offset": (F.col("seq") * 7 + 0.25) * 1000, "duration": (F.col("seq") % 5 + 0.5).cast("double")})
    return c.caption_rows(rows).select("video_id", "seq", "start", F.round("end", 6).alias("end"))


@query("source_fallback", sql("""SELECT video_id, CASE WHEN video_id % 3 = 0 THEN 'subs' WHEN video_id % 3 = 1 THEN 'api' ELSE 'stt' END AS source, count(*) AS lines FROM line GROUP BY 1, 2""", "line"))
def source_fallback(spark, d):
    lines = views.transcript(spark, d).select("video_id", "seq", "text", "start", "end")
    out = c.first_available([("subs", lines.filter("video_id % 3 = 0")), ("api", lines.filter("video_id % 3 < 2")), ("stt", lines)])
    return out.groupBy("video_id", "source").agg(F.count(F.lit(1)).alias("lines"))


SUFFIX = ("de.vtt", "en.json3", "en.auto.vtt", "fr.vtt", "en-US.vtt", "de.auto.json3")


@query("best_subtitle", sql("""SELECT o_custkey AS video_id, arg_max(name, (score, -o_orderkey)) AS name FROM (SELECT o_custkey, o_orderkey, 'v' || o_orderkey || '.' || (%s)[o_orderkey %% 6 + 1] AS name, ([105, 102, 102, 5, 102, 101])[o_orderkey %% 6 + 1] AS score FROM orders) GROUP BY 1""" % ("[" + ", ".join(f"'{s}'" for s in SUFFIX) + "]")))
def best_subtitle(spark, d):
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIX]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    files = views.table(spark, d, "orders").select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("v"), "o_orderkey", F.lit("."), suffix).alias("name"))
    return c.best_subtitle(files)


@query("chapter_marks", sql("""SELECT doc_id AS video_id, m.t::DOUBLE AS "time", m.l AS label FROM documents, unnest([{'t': (doc_id % 3) * 3600 + 123, 'l': 'Boss ' || lang}, {'t': 750 + doc_id % 60, 'l': 'Intro'}]) AS u(m) WHERE m.t < 4000"""))
def chapter_marks(spark, d):
    desc = F.concat(F.format_string("%d:02:03 - Boss ", F.col("doc_id") % 3), "lang", F.lit("\nno mark\n"), F.format_string("12:%02d – Intro\n", 30 + F.col("doc_id") % 60 - F.when(F.col("doc_id") % 60 >= 30, 60).otherwise(0)))
    late = F.when(F.col("doc_id") % 60 >= 30, F.replace(desc, F.lit("\n12:"), F.lit("\n13:"))).otherwise(desc)
    rows = views.table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), late.alias("description"), F.lit(4000.0).alias("duration"))
    return c.chapter_marks(rows).select("video_id", "time", "label")


@query("tag_strip", sql("""SELECT page_id, trim(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), ' ' || chr(10) || chr(13) || chr(9)) AS text FROM pages"""))
def tag_strip(spark, d):
    return views.table(spark, d, "pages").select("page_id", c.strip_tags(F.col("html")).alias("text"))


@query("missing_work", sql("SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0)"))
def missing_work(spark, d):
    req = views.table(spark, d, "orders").select("o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("clip_hash"), F.lit("m").alias("model"), F.lit("").alias("cold_open_key"))
    done = req.filter("o_orderkey % 3 = 0").select("clip_hash", "model", "cold_open_key", F.when(F.col("o_orderkey") % 4 == 0, 10).otherwise(11).alias("version"), F.lit(5).alias("segments"))
    return c.missing_work(req, done, 11).select("o_orderkey")


@query("detector_events", sql("""SELECT video_id, seq, roi, confidence FROM kill_event WHERE seq % 10 <> 0""", "kill_event"))
def detector_events(spark, d):
    e = views.kill_events(spark, d)
    fields = [f.split(":")[0] for f in __import__("tideline.schemas", fromlist=["x"]).KILL_EVENT.split(",")]
    ev = F.struct(*[F.col(n) for n in fields if n in e.columns])
    raw = e.select("video_id", F.col("seq").alias("real_seq"), F.to_json(F.struct((F.col("seq") % 10 != 0).alias("ok"), F.array(ev).alias("events"))).alias("content"))
    out = r.detector_events(raw.select(F.struct("video_id", "real_seq").alias("video_id"), "content"))
    return out.select("video_id.video_id", F.col("video_id.real_seq").alias("seq"), "roi", "confidence")


@query("video_metadata", sql("""SELECT doc_id AS video_id, CASE WHEN doc_id % 5 = 0 THEN 'Unknown video' ELSE source END AS title, trim(left(trim(text), 3000)) AS description, CASE WHEN doc_id % 4 <> 0 THEN n_chars::DOUBLE END AS duration, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'up' END AS channel FROM documents"""))
def video_metadata(spark, d):
    docs = views.table(spark, d, "documents")
    raw = docs.select(F.col("doc_id").alias("video_id"), F.to_json(F.struct(F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("title"), F.col("text").alias("description"), F.when(F.col("doc_id") % 4 != 0, F.col("n_chars").cast("double")).alias("duration"),
                                                                     F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("").alias("channel"), F.lit("up").alias("uploader"))).alias("content"))
    return r.video_metadata(raw).select("video_id", "title", F.trim("description").alias("description"), "duration", "channel")


@query("pick_rows", sql("""SELECT conv_id AS video_id, turn AS t, (turn % 9)::VARCHAR AS candidate_id, role AS title, (turn % 10)::DOUBLE AS viral_score FROM conversations WHERE turn % 3 <> 0"""))
def pick_rows(spark, d):
    conv = views.table(spark, d, "conversations")
    arr = F.to_json(F.array(F.struct((F.col("turn") % 9).cast("string").alias("candidate_id"), F.col("role").alias("title"), (F.col("turn") % 10).cast("double").alias("viral_score"))))
    raw = conv.select(F.struct(F.col("conv_id"), F.col("turn")).alias("video_id"), F.when(F.col("turn") % 3 == 0, "sorry, nothing").otherwise(F.concat(F.lit("Sure:\n```json\n"), arr, F.lit("\n``` done"))).alias("content"))
    picks, _ = r.pick_rows(raw)
    return picks.select(F.col("video_id.conv_id").alias("video_id"), F.col("video_id.turn").alias("t"), "candidate_id", "title", "viral_score")


@query("measurement_logs", sql("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -40 ELSE -(o_orderkey % 30) - 0.5 END::DOUBLE AS max_db, CASE WHEN o_orderkey % 2 = 0 THEN -35 ELSE -20.25 END::DOUBLE AS mean_db, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 5 ELSE 7.5 END::DOUBLE AS burst, ([0, 0, 3, 6, 6, 9, 9, 9, 12, 12])[o_orderkey % 10 + 1]::INT AS cuts FROM orders"""))
def measurement_logs(spark, d):
    k = F.col("o_orderkey")
    vol = F.concat(F.when(k % 3 != 0, F.concat(F.lit("max_volume: "), (-(k % 30) - 0.5).cast("string"), F.lit(" dB\n"))).otherwise(""), F.when(k % 2 != 0, "mean_volume: -20.25 dB\n").otherwise(""))
    sil = F.array_join(F.transform(F.when(k % 4 == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), (k % 4).cast("int"))), lambda i: F.when(i == 0, F.lit("")).otherwise(F.format_string("silence_start: %d.0\nsilence_end: %d.5\n", i * 2 - 1, i * 2 - 1))), "")
    cuts = F.repeat(F.lit("frame pts_time:1.5\n"), (k % 10).cast("int"))
    logs = views.table(spark, d, "orders").select(k, F.concat(vol, sil).alias("log"), cuts.alias("cut_log"))
    burst = r.burst_score(r.log_times(F.col("log"), "silence_start"), r.log_times(F.col("log"), "silence_end"), F.lit(20.0))
    stats = r.volume_stats(F.col("log"))
    return logs.select("o_orderkey", stats["max_db"].alias("max_db"), stats["mean_db"].alias("mean_db"), burst.alias("burst"), r.cut_points(F.size(r.log_times(F.col("cut_log"), "pts_time"))).alias("cuts"))


@query("window_emotion", sql("""SELECT o_orderkey, floor(least(45.0, greatest(0, least(16, (-(o_orderkey % 30) + 28) * 0.9)) + greatest(0, least(8, (-(o_orderkey % 37) + 32) * 0.45)) + o_orderkey % 18 + (o_orderkey % 5) * 2) + 0.5)::BIGINT AS emotion FROM orders"""))
def window_emotion(spark, d):
    k = F.col("o_orderkey")
    score = r.emotion_score(-(k % 30).cast("double"), -(k % 37).cast("double"), (k % 18).cast("double"), ((k % 5) * 2).cast("double"))
    return views.table(spark, d, "orders").select(k, score.alias("emotion"))


HASHES = """h0 AS (SELECT *, 'x' AS other FROM orders),
h1 AS (SELECT *, left(sha256('{"o_custkey":' || o_custkey || '}'), 16) AS raw_hash FROM h0),
h2 AS (SELECT *, left(sha256('{"o_orderstatus":"' || o_orderstatus || '","raw_hash":"' || raw_hash || '"}'), 16) AS grade_hash FROM h1),
h3 AS (SELECT *, left(sha256('{"o_orderpriority":"' || o_orderpriority || '","grade_hash":"' || grade_hash || '"}'), 16) AS captions_hash FROM h2),
h4 AS (SELECT *, left(sha256('{"o_totalprice":' || o_totalprice || ',"captions_hash":"' || captions_hash || '"}'), 16) AS music_hash FROM h3)"""


@query("settings_hash", sql("""SELECT o_orderkey, raw_hash, grade_hash, captions_hash, music_hash, CASE WHEN o_orderkey % 2 = 0 AND o_orderpriority <> 'x' THEN 'captions' ELSE 'noop' END AS tier FROM h4""", more=HASHES))
def settings_hash(spark, d):
    """Stable settings hashes and the tier of work each change needs."""
    from tideline.plans.tiers import tier_of, with_hashes

    rows = with_hashes(views.table(spark, d, "orders"), [("raw", ["o_custkey"]), ("grade", ["o_orderstatus"]), ("captions", ["o_orderpriority"]), ("music", ["o_totalprice"])], "o_orderkey")
    old = with_hashes(views.table(spark, d, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, "x").otherwise(F.col("o_orderpriority"))), [("raw", ["o_custkey"]), ("grade", ["o_orderstatus"]), ("captions", ["o_orderpriority"]), ("music", ["o_totalprice"])], "o_orderkey")
    return tier_of(rows, old, "o_orderkey", ["raw", "grade", "captions", "music"])
