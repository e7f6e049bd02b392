"""Captions, speakers and cut timelines."""
from __future__ import annotations

from pyspark.sql import functions as F

from tideline import views
from tideline.catalog import query
from tideline.catalog.kill_queries import PACKS
from tideline.catalog.text_queries import LINES
from tideline.catalog.prefix import sql, tenth
from tideline.functions.patterns import FILLERS
from tideline.plans import captions as c
from tideline.plans import kills as k

TURNS = """turn AS (SELECT conv_id AS video_id, turn::INT AS seq, CASE WHEN turn % 4 = 0 THEN role END AS speaker, text, turn * 3.0::DOUBLE + (length(text) % 4) * 0.5 AS "start",
  turn * 3.0::DOUBLE + (length(text) % 4) * 0.5 + 1.5 AS "end" FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS turn, role, text FROM conversations))"""


def _turns(spark, d):
    from pyspark.sql import Window as W

    rows = views.table(spark, d, "conversations").withColumn("seq", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "text")) - 1)
    start = F.col("seq") * F.lit(3.0) + (F.length("text") % 4) * 0.5
    return rows.select(F.col("conv_id").alias("video_id"), F.col("seq").cast("int").alias("seq"), F.when(F.col("seq") % 4 == 0, F.col("role")).alias("speaker"), "text", start.alias("start"), (start + 1.5).alias("end"))


@query("caption_merge", sql("""SELECT video_id, g::INT AS seq, string_agg(text, ' ' ORDER BY seq) AS text, min("start") AS "start", floor((arg_max("end", seq) - min("start")) * 100 + 0.5) / 100 AS duration FROM walk GROUP BY 1, 2""", "line", more="""
src AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seq) AS rn FROM line WHERE text <> ''),
walk AS (SELECT video_id, rn, seq, text, "start", "end", seq AS g, "start" AS g0, "end" AS until, length(text) AS chars FROM src WHERE rn = 1 UNION ALL
  SELECT s.video_id, s.rn, s.seq, s.text, s."start", s."end", CASE WHEN s."start" - w.until < 0.4 AND w.chars + length(s.text) < 220 THEN w.g ELSE s.seq END,
    CASE WHEN s."start" - w.until < 0.4 AND w.chars + length(s.text) < 220 THEN w.g0 ELSE s."start" END,
    CASE WHEN s."start" - w.until < 0.4 AND w.chars + length(s.text) < 220 THEN w.g0 + floor((s."end" - w.g0) * 100 + 0.5) / 100 ELSE s."end" END,
    CASE WHEN s."start" - w.until < 0.4 AND w.chars + length(s.text) < 220 THEN w.chars + 1 + length(s.text) ELSE length(s.text) END
  FROM walk w JOIN src s ON s.video_id = w.video_id AND s.rn = w.rn + 1)""", recursive=True))
def caption_merge(spark, d):
    return c.merge_captions(views.transcript(spark, d).filter("text != ''").drop("duration"))


@query("speaker_turns", sql("""SELECT video_id, seq, speaker_id, ((dense_rank() OVER (PARTITION BY video_id ORDER BY first_seq) - 1) % 6)::INT AS colour FROM (
  SELECT *, min(seq) OVER (PARTITION BY video_id, speaker_id) AS first_seq FROM (
    SELECT video_id, seq, last_value(sid IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS speaker_id FROM (
      SELECT *, CASE WHEN speaker IS NOT NULL THEN 'groq-' || speaker WHEN pe IS NULL THEN 'speaker-0' WHEN p = 1 THEN 'gap-' || sum(p) OVER (PARTITION BY video_id ORDER BY seq) END AS sid FROM (
        SELECT *, (speaker IS NULL AND pe IS NOT NULL AND "start" - pe > 1.5)::INT AS p FROM (SELECT *, lag("end") OVER (PARTITION BY video_id ORDER BY seq) AS pe FROM turn)))))""", more=TURNS))
def speaker_turns(spark, d):
    return c.speaker_turns(_turns(spark, d)).select("video_id", "seq", "speaker_id", "colour")


TIMED = TURNS + """,
nx AS (SELECT *, lead("start") OVER (PARTITION BY video_id ORDER BY "start", "end", seq) AS n FROM (SELECT video_id, seq, text, "start", "start" + (seq % 5) * 0.9 AS "end" FROM turn)),
e1 AS (SELECT *, CASE WHEN n IS NULL THEN greatest("end", "start" + 0.1) ELSE least(greatest("end", "start" + 0.1), n - 0.05) END AS a FROM nx),
e2 AS (SELECT *, CASE WHEN a - "start" > 1.6 THEN "start" + 1.6 ELSE a END AS b FROM e1), e3 AS (SELECT *, CASE WHEN b <= "start" THEN "start" + 0.1 ELSE b END AS c FROM e2),
e4 AS (SELECT *, CASE WHEN n < c - 0.001 THEN greatest("start" + 0.05, n - 0.05) ELSE c END AS e FROM e3)"""


@query("caption_timings", sql("""SELECT video_id, seq, "start", round(e, 6) AS "end" FROM e4""", more=TIMED))
def caption_timings(spark, d):
    words = _turns(spark, d).withColumn("end", F.col("start") + (F.col("seq") % 5) * 0.9)
    return c.caption_timings(words).select("video_id", "seq", "start", F.round("end", 6).alias("end"))


@query("caption_sync", sql("""SELECT video_id, count(*) AS words, min("start") AS first_at, count(*) FILTER (WHERE "start" < 2) AS first_two_sec, count(*) FILTER (WHERE "start" < pe - 0.01) AS overlaps
FROM (SELECT *, lag("end") OVER (PARTITION BY video_id ORDER BY "start", seq) AS pe FROM nx) GROUP BY 1""", more=TIMED))
def caption_sync(spark, d):
    words = _turns(spark, d).withColumn("end", F.col("start") + (F.col("seq") % 5) * 0.9)
    return c.sync_diagnostics(words)


TOKENS = """tokd AS (SELECT doc_id AS video_id, (i - 1)::INT AS seq, ws[i] AS text FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents), unnest(range(1, len(ws) + 1)) AS t(i)),
imp AS (SELECT *, lower(trim(regexp_replace(trim(regexp_replace(regexp_replace(text, '(?i)%s', '', 'g'), '\\s+', ' ', 'g')), '[^A-Za-z0-9_äöüßÄÖÜ]', ' ', 'g'))) AS cl FROM tokd),
imp2 AS (SELECT *, regexp_split_to_array(cl, '\\s+')[1] AS tk FROM imp),
hit AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seq) AS rn FROM imp2 WHERE length(cl) >= 3 AND ((length(tk) >= 4 AND tk IN (%s)) OR regexp_matches(cl, '(?i)%s') OR regexp_matches(cl, '(?i)%s')
  OR (contains(text, '!') AND length(tk) >= 3)))""" % (FILLERS, ", ".join(f"'{w}'" for w in c.IMPACT_WORDS), c.IMPACT_PHRASES[0], c.IMPACT_PHRASES[1])


@query("keyword_highlights", sql("SELECT video_id, seq FROM walk WHERE take", more=TOKENS + """,
walk AS (SELECT video_id, rn, seq, seq AS last, true AS take FROM hit WHERE rn = 1 UNION ALL
  SELECT h.video_id, h.rn, h.seq, CASE WHEN h.seq - w.last >= 3 THEN h.seq ELSE w.last END, h.seq - w.last >= 3 FROM walk w JOIN hit h ON h.video_id = w.video_id AND h.rn = w.rn + 1)""", recursive=True))
def keyword_highlights(spark, d):
    words = views.table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", " ")).alias("seq", "text"))
    return c.highlight_words(words)


WIN = """bounds AS (SELECT video_id, max("end") AS e FROM line GROUP BY 1),
win AS (SELECT video_id, i::INT AS wid, (i * 40)::DOUBLE AS w_start, (i * 40 + 28)::DOUBLE AS w_end FROM bounds, unnest(range(0, (floor(e / 40) + 1)::BIGINT)) AS t(i))"""


def _clips(spark, d):
    grid = views.transcript_ends(spark, d).withColumn("wid", F.explode(F.sequence(F.lit(0), F.floor(F.col("e") / 40).cast("int"))))
    return grid.select("video_id", "wid", (F.col("wid") * 40).cast("double").alias("w_start"), (F.col("wid") * 40 + 28).cast("double").alias("w_end"))


CW = WIN + """,
cw AS (SELECT l.video_id, wid, seq, text, greatest(0, l."start" - w_start) AS s, greatest(0.1, l."end" - w_start) AS e FROM line l JOIN win w ON l.video_id = w.video_id AND l."start" BETWEEN w_start AND w_end WHERE trim(text) <> '')"""


def _words(spark, d):
    return c.prepare_clip_words(views.transcript(spark, d), _clips(spark, d)).select("video_id", "wid", "seq", "text", "start", "end")


@query("clip_transcript", sql("""SELECT l.video_id, wid, seq FROM line l JOIN win w ON l.video_id = w.video_id AND l."end" >= w_start AND l."start" <= w_end""", "line", more=WIN))
def clip_transcript(spark, d):
    return c.clip_words(views.transcript(spark, d), _clips(spark, d)).select("video_id", "wid", "seq")


@query("clip_words", sql('SELECT video_id, wid, seq, round(s, 6) AS "start", round(e, 6) AS "end" FROM cw WHERE e > s', "line", more=CW))
def clip_words(spark, d):
    return _words(spark, d).select("video_id", "wid", "seq", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("clamp_words", sql('SELECT video_id, wid, seq, round(s, 6) AS "start", round(least(20.2, greatest(s + 0.05, e)), 6) AS "end" FROM cw WHERE e > s AND s < 20.2 AND least(20.2, greatest(s + 0.05, e)) > s', "line", more=CW))
def clamp_words(spark, d):
    return c.clamp_words(_words(spark, d), F.lit(20.0)).select("video_id", "wid", "seq", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("display_lag", sql('SELECT video_id, seq, round("start" + 0.055, 6) AS "start", round(greatest("start" + 0.055 + 0.05, "end" + 0.055), 6) AS "end" FROM line', "line"))
def display_lag(spark, d):
    return c.lag_words(views.transcript(spark, d)).select("video_id", "seq", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("viable_transcripts", sql("SELECT video_id, count(*) AS words FROM line GROUP BY 1 HAVING count(*) >= 5", "line"))
def viable_transcripts(spark, d):
    return c.viable(views.transcript(spark, d))


QUAL = CW + """,
q0 AS (SELECT video_id, wid, count(*) AS words, arg_max(e, (s, seq)) / 28.0::DOUBLE AS coverage, count(*) / 28.0::DOUBLE AS rate FROM cw WHERE e > s GROUP BY 1, 2),
q AS (SELECT *, 6 AS least_words, words >= 6 AND coverage >= 0.2 AND rate >= 0.15 AS pass FROM q0)"""


@query("caption_quality", sql("SELECT video_id, wid, words, round(coverage, 6) AS coverage, round(rate, 6) AS rate, least_words, pass FROM q", "line", more=QUAL))
def caption_quality(spark, d):
    out = c.caption_quality(_words(spark, d), F.lit(28.0))
    return out.select("video_id", "wid", "words", F.round("coverage", 6).alias("coverage"), F.round("rate", 6).alias("rate"), "least_words", "pass")


@query("chosen_attempt", sql("SELECT video_id, wid AS attempt, words, pass FROM q QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY pass DESC, CASE WHEN pass THEN wid ELSE -wid END) = 1", "line", more=QUAL))
def chosen_attempt(spark, d):
    tries = c.caption_quality(_words(spark, d), F.lit(28.0)).select("video_id", F.col("wid").alias("attempt"), "words", "pass")
    return c.choose_attempt(tries, ["video_id"])


@query("main_timeline_only", sql("SELECT video_id, wid, max(e) <= 28.75 AS main_only FROM cw WHERE e > s GROUP BY 1, 2", "line", more=CW))
def main_timeline_only(spark, d):
    return c.main_timeline_only(_words(spark, d), F.lit(28.0))


@query("cold_open_timeline", sql("""SELECT video_id, wid, seq, 'teaser' AS part, round(greatest(s, 18) - 18, 6) AS "start", round(greatest(0.05, least(e, 20.2) - greatest(s, 18)), 6) AS duration FROM cw WHERE e > s AND s < 18.0 + 2.2 AND e > 18
UNION ALL SELECT video_id, wid, seq, 'main', round(2.2 + s, 6), round(greatest(0.05, e - s), 6) FROM cw WHERE e > s AND s < 28""", "line", more=CW))
def cold_open_timeline(spark, d):
    out = c.cold_open_words(_words(spark, d), F.lit(2.2), F.lit(18.0), F.lit(28.0))
    return out.select("video_id", "wid", "seq", "part", F.round("start", 6).alias("start"), F.round("duration", 6).alias("duration"))


@query("teaser_merge", sql("""SELECT video_id, wid, seq, 'teaser' AS part, round(s, 6) AS "start", round(greatest(0.05, least(2.2, e) - s), 6) AS duration FROM cw WHERE e > s AND least(2.2, e) > s
UNION ALL SELECT video_id, wid, seq, 'main', round(2.2 + s, 6), round(greatest(0.05, e - s), 6) FROM cw WHERE e > s""", "line", more=CW))
def teaser_merge(spark, d):
    words = _words(spark, d)
    out = c.merge_teaser(words, words, F.lit(2.2))
    return out.select("video_id", "wid", "seq", "part", F.round("start", 6).alias("start"), F.round("duration", 6).alias("duration"))


@query("remap_words", sql("""SELECT video_id, wid, seq, round(a, 6) AS "start", round(greatest(a + 0.05, b), 6) AS "end" FROM (SELECT *, greatest(0, wid * 40 + s - (wid * 40 + 4)) AS a, least(20.0::DOUBLE, wid * 40 + e - (wid * 40 + 4)) AS b
FROM cw WHERE e > s AND wid * 40 + e >= wid * 40 + 4 - 0.1 AND wid * 40 + s <= wid * 40 + 24 + 0.1) WHERE b > a""", "line", more=CW))
def remap_words(spark, d):
    base = (F.col("wid") * 40).cast("double")
    out = c.remap_words(_words(spark, d), base, base + 4, base + 24)
    return out.select("video_id", "wid", "seq", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


SEG = PACKS + f""",
seg AS (SELECT video_id, pack_seq, seq, {tenth('"time"')} AS "start", 8.0::DOUBLE AS duration FROM packs),
trimmed AS (SELECT *, CASE WHEN n - 0.15 - "start" < duration THEN greatest(1.15, {tenth('n - 0.15 - "start"')}) ELSE duration END AS d FROM (SELECT *, lead("start") OVER (PARTITION BY video_id, pack_seq ORDER BY "start", seq) AS n FROM seg)),
lay AS (SELECT *, sum(greatest(0.5, d)) OVER (PARTITION BY video_id, pack_seq ORDER BY "start", seq) AS oe, lead("start") OVER (PARTITION BY video_id, pack_seq ORDER BY "start", seq) IS NULL AS is_last FROM trimmed WHERE d >= 1.15)"""
PACK = ["video_id", "pack_seq"]


def _segments(spark, d):
    packed = k.burst_packs(views.kill_events(spark, d))
    return packed.select("video_id", "pack_seq", "seq", (F.floor(F.col("at") * 10 + 0.5) / 10).alias("start"), F.lit(8.0).alias("duration"))


@query("trim_overlaps", sql('SELECT video_id, pack_seq, seq, "start", d AS duration FROM lay', "kill_event", more=SEG, recursive=True))
def trim_overlaps(spark, d):
    return c.trim_segments(_segments(spark, d), PACK).select("video_id", "pack_seq", "seq", "start", "duration")


def _layout(spark, d):
    return c.output_layout(c.trim_segments(_segments(spark, d), PACK), PACK)


@query("output_layout", sql('SELECT video_id, pack_seq, seq, round(oe - d, 6) AS out_start, round(oe, 6) AS out_end, is_last FROM lay', "kill_event", more=SEG, recursive=True))
def output_layout(spark, d):
    return _layout(spark, d).select("video_id", "pack_seq", "seq", F.round("out_start", 6).alias("out_start"), F.round("out_end", 6).alias("out_end"), "is_last")


@query("source_from_output", sql("""SELECT p.video_id, p.pack_seq, p.out_t, round(coalesce(min(CASE WHEN hit THEN "start" + least(d, p.out_t - os) END), arg_min("start" + greatest(0, least(d, p.out_t)), os)), 6) AS source_t FROM (
  SELECT p.*, l."start", l.d, l.oe - l.d AS os, p.out_t >= l.oe - l.d AND (p.out_t < l.oe OR (l.is_last AND p.out_t <= l.oe)) AS hit FROM (SELECT DISTINCT video_id, pack_seq, round(t * 3.3 + 0.73, 6) AS out_t FROM lay, range(0, 5) AS r(t)) p JOIN lay l USING (video_id, pack_seq)) p GROUP BY 1, 2, 3""",
                              "kill_event", more=SEG, recursive=True))
def source_from_output(spark, d):
    layout = _layout(spark, d)
    points = layout.select(*PACK).distinct().withColumn("out_t", F.explode(F.array(*[F.lit(round(t * 3.3 + 0.73, 6)) for t in range(5)])))
    return c.source_from_output(layout, points, PACK).withColumn("source_t", F.round("source_t", 6))


@query("output_from_source", sql("""SELECT p.video_id, p.pack_seq, p.src_t, round(coalesce(arg_max(oe - d + p.src_t - "start", oe) FILTER (WHERE p.src_t >= "start" - 0.02 AND p.src_t < "start" + d - 0.01),
  CASE WHEN p.src_t >= arg_max("start" + d, oe) - 0.05 THEN max(oe) ELSE 0 END), 6) AS out_t FROM (SELECT video_id, pack_seq, round(min("start") + t * 4.4 + 0.03, 6) AS src_t FROM lay, range(0, 5) AS r(t) GROUP BY video_id, pack_seq, t) p JOIN lay l USING (video_id, pack_seq) GROUP BY 1, 2, 3""",
                              "kill_event", more=SEG, recursive=True))
def output_from_source(spark, d):
    layout = _layout(spark, d)
    first = layout.groupBy(*PACK).agg(F.min("start").alias("_s"))
    points = first.select(*PACK, F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.round(F.col("_s") + i * 4.4 + 0.03, 6))).alias("src_t"))
    return c.output_from_source(layout, points, PACK).withColumn("out_t", F.round("out_t", 6))


BUCKETS = LINES + """,
cl AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY "start", seq) AS rn FROM cleaned WHERE clean <> ''),
bk AS (SELECT video_id, rn, seq, "start" AS s, clean, "start" AS closed, seq AS bucket, true AS shut, 0.0::DOUBLE AS opened FROM cl WHERE rn = 1
  UNION ALL SELECT c.video_id, c.rn, c.seq, c."start", c.clean, CASE WHEN c."start" - b.closed >= 5 THEN c."start" ELSE b.closed END, CASE WHEN b.shut THEN c.seq ELSE b.bucket END, c."start" - b.closed >= 5, b.closed
  FROM bk b JOIN cl c ON c.video_id = b.video_id AND c.rn = b.rn + 1)"""


@query("prompt_buckets", sql("""SELECT video_id, bucket, min(s) AS "start", floor(CASE WHEN arg_min(opened, (s, seq)) = 0 THEN min(s) ELSE arg_min(opened, (s, seq)) END)::BIGINT AS stamp, string_agg(clean, ' ' ORDER BY seq) AS text FROM bk GROUP BY 1, 2""", "line", more=BUCKETS, recursive=True))
def prompt_buckets(spark, d):
    """Transcript text in buckets of about five seconds."""
    return c.prompt_buckets(views.transcript(spark, d))


@query("text_sampling", sql("""SELECT doc_id, CASE WHEN length(text) <= 6000 THEN text ELSE left(text, 2000) || chr(10) || '...[sampled]...' || chr(10) ||
  list_aggregate(list_transform(range(0, least(2980, ((length(text) - 3000) + greatest(1, (length(text) - 3000) // 2980) - 1) // greatest(1, (length(text) - 3000) // 2980))), lambda i: substr(text, (2001 + i * greatest(1, (length(text) - 3000) // 2980))::BIGINT, 1)), 'string_agg', '')
  || chr(10) || '...[sampled]...' || chr(10) || right(text, 1000) END AS sampled, [substr(text, 1, s), substr(text, s + 1, s), substr(text, 2 * s + 1, s)] AS thirds FROM (SELECT *, ceil(length(text) / 3)::BIGINT AS s FROM documents)"""))
def text_sampling(spark, d):
    return c.sample_text(views.table(spark, d, "documents"), "text", "sampled").select("doc_id", "sampled", c.thirds(F.col("text")).alias("thirds"))
