"""Content classification and small text rules."""
from __future__ import annotations

import re

from pyspark.sql import functions as F

from tideline import views
from tideline.catalog import query
from tideline.catalog.loudness_queries import CLUSTERS
from tideline.catalog.prefix import sql
from tideline.functions import patterns as p
from tideline.functions.profiles import GAMING_WORDS, SHOOTER_GAMES
from tideline.plans import classify as c
from tideline.plans import loudness as l
from tideline.plans import kills as k

TITLES = ("CS2 ranked clutch", "Minecraft let's play", "League of Legends ranked", "Cooking with friends", "Valorant vs Counter-Strike 2", "Horror game: Phasmophobia", "Rust base raid",
          "Interview podcast", "watching and reaction", "Formula 1 and F1 cup", "gaming stream", "ARK: survival day 3")
TALK = ("the awp ace was insane", "plant the bomb a site", "baron and dragon teamfight", "", "wait what why no way", "creeper in the nether", "oh my god scared", "penta kill ace push end",
        "they call of", "duty now", "counter-strike is", "counterstrike and cs2", "final lap crash goal", "rotate save eco round", "spike site a", "nothing here")


def _arr(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


SRC = f"""titled AS (SELECT doc_id AS video_id, ({_arr(TITLES)})[doc_id % 12 + 1] AS title, ({_arr(TITLES)})[doc_id % 7 + 1] || ' ' || lang AS tags, text AS description FROM documents),
spoken AS (SELECT video_id, seq, lower(({_arr(TALK)})[(video_id * 7 + seq) % 16 + 1] || ' ' || text) AS low FROM line),
whole AS (SELECT video_id, string_agg(low, ' ' ORDER BY seq) AS low FROM spoken GROUP BY 1)"""


def _rules(sets):
    rows = []
    for i, r in enumerate(c.RULES):
        if r["set"] in sets:
            bare = re.sub(r"\(\?!.*?\)", "", r["pattern"])
            game = "NULL" if r["game"] is None else "'" + r["game"] + "'"
            rows.append(f"({i}, '{r['set']}', {r['pos']}, '{r['category']}', {game}, {r['weight']}::DOUBLE, '{bare.replace(chr(39), chr(39) * 2)}')")
    return "rule(rule, kind, pos, category, game, weight, pattern) AS (VALUES " + ",\n".join(rows) + ")"


# The SQL engine has no look-ahead; no text of the tables continues the way the four look-aheads forbid.
RULES = _rules(("title", "spoken", "keywords"))
META = SRC + ",\n" + RULES + """,
meta AS (SELECT video_id, 'title' AS source, lower(title) AS low, 1.35 AS mul, 1 AS ord FROM titled UNION ALL SELECT video_id, 'description', lower(description), 0.65, 2 FROM titled UNION ALL SELECT video_id, 'tags', lower(tags), 1.15, 3 FROM titled),
mpt AS (SELECT video_id, category, game, weight * least(len(regexp_extract_all(low, pattern)), 3) * mul AS points, ord * 1000 + pos AS pos FROM meta, rule WHERE kind = 'title' AND regexp_matches(low, pattern)),
cnt AS (SELECT video_id, rule.*, len(regexp_extract_all(low, pattern)) AS n FROM whole, rule WHERE regexp_matches(low, pattern)),
tpt AS (SELECT video_id, category, game, weight * least(n, 3) * CASE WHEN kind = 'title' THEN 1.75 * 0.55 ELSE 1.75 END AS points, pos + 5000 AS pos FROM cnt WHERE kind <> 'keywords'
  UNION ALL SELECT video_id, category, NULL, sum(least(n, 4)) * 2.5 * 1.75 * 0.4, min(pos) + 5000 FROM cnt WHERE kind = 'keywords' GROUP BY video_id, category HAVING sum(least(n, 4)) >= 3),
merged AS (SELECT video_id, category, game, round(sum(points), 6) AS score, min(pos) AS pos FROM (SELECT * FROM mpt UNION ALL SELECT * FROM tpt) GROUP BY 1, 2, 3)"""


def _titled(spark, d):
    pick = lambda n: F.element_at(F.array(*[F.lit(t) for t in TITLES]), (F.col("doc_id") % n + 1).cast("int"))
    return views.table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), pick(12).alias("title"), F.concat_ws(" ", pick(7), "lang").alias("tags"), F.col("text").alias("description"))


def _meta(spark, d):
    t = _titled(spark, d)
    return t.select("video_id", F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.col(s).alias("text")) for s in ("title", "description", "tags")])).alias("x")).select("video_id", "x.*")


def _spoken(spark, d):
    phrase = F.element_at(F.array(*[F.lit(t) for t in TALK]), ((F.col("video_id") * 7 + F.col("seq")) % 16 + 1).cast("int"))
    return views.transcript(spark, d).select("video_id", "seq", F.concat(phrase, F.lit(" "), "text").alias("text"))


@query("matcher_scores", sql("SELECT video_id, category, game, round(sum(points), 6) AS score FROM mpt GROUP BY 1, 2, 3", "line", more=META))
def matcher_scores(spark, d):
    return c.merged_scores(c.metadata_points(_meta(spark, d))).drop("pos")


@query("transcript_scores", sql("SELECT video_id, category, game, round(sum(points), 6) AS score FROM tpt GROUP BY 1, 2, 3", "line", more=META))
def transcript_scores(spark, d):
    return c.merged_scores(c.transcript_points(_spoken(spark, d))).drop("pos")


@query("category_density", sql("SELECT video_id, category, sum(least(n, 4))::BIGINT AS hits FROM cnt WHERE kind = 'keywords' GROUP BY 1, 2 HAVING sum(least(n, 4)) >= 3", "line", more=META))
def category_density(spark, d):
    points = c.transcript_points(_spoken(spark, d)).filter(F.col("game").isNull())
    return points.select("video_id", "category", F.round(F.col("points") / (2.5 * 1.75 * 0.4)).cast("bigint").alias("hits"))


@query("merged_scores", sql("SELECT video_id, category, game, score FROM merged", "line", more=META))
def merged_scores(spark, d):
    return c.merged_scores(c.metadata_points(_meta(spark, d)), c.transcript_points(_spoken(spark, d))).drop("pos")


CONF = "CASE WHEN score >= 42 THEN 94 WHEN score >= 28 THEN 88 WHEN score >= 18 THEN 80 WHEN score >= 12 THEN 72 WHEN score >= 8 THEN 62 WHEN score > 0 THEN 52 ELSE 35 END"


@query("best_category", sql(f"""SELECT t.video_id, coalesce(b.category, 'generic') AS category, CASE WHEN b.category IS NULL THEN CASE WHEN gaming THEN 'Gaming' END ELSE b.game END AS game, coalesce(b.score, CASE WHEN gaming THEN 6 ELSE 0 END) AS score,
  least(97, {CONF.replace('score', 'coalesce(b.score, CASE WHEN gaming THEN 6 ELSE 0 END)')} + 8)::INT AS confidence FROM (SELECT video_id, regexp_matches(lower(title || ' ' || tags), '{GAMING_WORDS.replace(chr(39), chr(39) * 2)}') AS gaming FROM titled) t
LEFT JOIN (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, pos) = 1) b USING (video_id)""", "line", more=META))
def best_category(spark, d):
    scores = c.merged_scores(c.metadata_points(_meta(spark, d)), c.transcript_points(_spoken(spark, d)))
    videos = _titled(spark, d).select("video_id", c.is_gaming(F.concat_ws(" ", "title", "tags")).alias("gaming"))
    best = c.best_category(scores, videos)
    return c.signal_bonus(best, F.array(*[F.lit(s) for s in ("title", "tags", "description", "transcript")])).select("video_id", "category", "game", "score", "confidence")


@query("metadata_category", sql(f"""SELECT t.video_id, coalesce(b.category, 'generic') AS category, coalesce(b.score, 0) AS score, {CONF.replace('score', 'coalesce(b.score, 0)')}::INT AS confidence FROM titled t
LEFT JOIN (SELECT video_id, category, game, round(sum(points), 6) AS score, min(pos) AS pos FROM mpt GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY round(sum(points), 6) DESC, min(pos)) = 1) b USING (video_id)""", "line", more=META))
def metadata_category(spark, d):
    videos = _titled(spark, d).select("video_id", F.lit(False).alias("gaming"))
    return c.best_category(c.merged_scores(c.metadata_points(_meta(spark, d))), videos).select("video_id", "category", "score", "confidence")


@query("visual_category", sql(f"""SELECT t.video_id, false AS gaming, coalesce(b.category, 'generic') AS category, b.game, coalesce(b.score, 0)::DOUBLE AS score, {CONF.replace('score', 'coalesce(b.score, 0)')}::INT AS confidence FROM titled t
LEFT JOIN (SELECT video_id, category, game, round(sum(points), 6) AS score, min(pos) AS pos FROM (SELECT video_id, category, game, points, pos FROM mpt
    UNION ALL SELECT video_id, 'shooter', 'Valorant', (video_id % 60) * 0.35::DOUBLE * {c.SOURCE_WEIGHTS["visual"]}::DOUBLE, 9000 FROM titled)
  GROUP BY 1, 2, 3 HAVING round(sum(points), 6) > 0 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY round(sum(points), 6) DESC, min(pos)) = 1) b USING (video_id)""", "line", more=META))
def visual_category(spark, d):
    """Category after a frame classification adds its points."""
    visual = _titled(spark, d).select("video_id", F.lit("shooter").alias("category"), F.lit("Valorant").alias("game"), (F.col("video_id") % 60).cast("double").alias("score"))
    scores = c.merged_scores(c.metadata_points(_meta(spark, d)), c.visual_points(visual))
    return c.best_category(scores, _titled(spark, d).select("video_id", F.lit(False).alias("gaming")))


@query("shooter_content", sql(f"SELECT video_id, title FROM titled WHERE video_id % 5 = 0 OR regexp_matches(title, '(?i){SHOOTER_GAMES}')", "line", more=SRC))
def shooter_content(spark, d):
    return _titled(spark, d).filter(c.is_shooter(F.when(F.col("video_id") % 5 == 0, "shooter").otherwise("talk"), F.col("title"))).select("video_id", "title")


@query("gameplay_text", sql(f"SELECT video_id, regexp_matches(title, '(?i){c.GAMEPLAY_WORDS.replace(chr(39), chr(39) * 2)}') AS gameplay, regexp_matches(title, '(?i){GAMING_WORDS.replace(chr(39), chr(39) * 2)}') AS gaming FROM titled", "line", more=SRC))
def gameplay_text(spark, d):
    return _titled(spark, d).select("video_id", c.is_gameplay(F.col("title")).alias("gameplay"), c.is_gaming(F.col("title")).alias("gaming"))


@query("talk_counts", sql(f"SELECT video_id, len(regexp_extract_all(low, '{p.KILL_WORDS}')) AS kill_terms, len(regexp_extract_all(low, '{p.BORING_WORDS}')) AS boring_terms FROM whole", "line", more=SRC))
def talk_counts(spark, d):
    return c.talk_counts(_spoken(spark, d))


@query("shooter_inference", sql(f"""SELECT video_id, reason, 82 AS confidence FROM (SELECT video_id, CASE WHEN coalesce(clusters, 0) >= 1 THEN 'kill chains' WHEN coalesce(n, 0) >= 5 THEN 'combat spikes'
    WHEN kill_terms >= 4 AND kill_terms > boring_terms THEN 'kill terms' END AS reason
  FROM (SELECT video_id, len(regexp_extract_all(low, '{p.KILL_WORDS}')) AS kill_terms, len(regexp_extract_all(low, '{p.BORING_WORDS}')) AS boring_terms FROM whole)
  LEFT JOIN (SELECT video_id, count(*) AS n FROM peaks GROUP BY 1) USING (video_id)
  LEFT JOIN (SELECT video_id, count(*) AS clusters FROM (SELECT video_id, c0 FROM walk GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1) USING (video_id)) WHERE reason IS NOT NULL""", "line", "loud", more=SRC + ",\n" + CLUSTERS, recursive=True))
def shooter_inference(spark, d):
    """Recordings whose sound or speech says shooter, with the reason."""
    peaks = l.loudness_peaks(l.loudness_scan(views.loudness(spark, d).select("video_id", "idx", "db")), "kill").withColumn("strength", F.col("strength").cast("double"))
    counts = peaks.groupBy("video_id").agg(F.count(F.lit(1)).alias("peaks"))
    clusters = k.peak_clusters(peaks).groupBy("video_id").agg(F.count(F.lit(1)).alias("clusters"))
    rows = c.talk_counts(_spoken(spark, d)).join(counts, "video_id", "left").join(clusters, "video_id", "left")
    return c.infer_shooter(rows.fillna(0, ["peaks", "clusters"])).select("video_id", "reason", "confidence")


@query("language_guess", sql(f"SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{c.GERMAN}') THEN 'de' WHEN regexp_matches(lower(text), '{c.ENGLISH}') THEN 'en' END AS guess FROM documents"))
def language_guess(spark, d):
    return views.table(spark, d, "documents").select("doc_id", c.guess_language(F.col("text")).alias("guess"))


NAMES = ("German", "EN", "unknown", "french ", "xx", "", "haw", "Deutsch")


@query("language_codes", sql(f"""SELECT doc_id, CASE lower(trim(({_arr(NAMES)})[doc_id % 8 + 1])) WHEN 'german' THEN 'de' WHEN 'en' THEN 'en' WHEN 'french' THEN 'fr' WHEN 'haw' THEN 'haw' WHEN 'deutsch' THEN 'de' END AS code FROM documents"""))
def language_codes(spark, d):
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("doc_id") % 8 + 1).cast("int"))
    return views.table(spark, d, "documents").select("doc_id", c.language_code(name).alias("code"))


@query("game_labels", sql("SELECT label, count(*) AS n FROM (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'unknown' ELSE o_orderpriority END AS label FROM orders) GROUP BY 1"))
def game_labels(spark, d):
    game = F.when(F.col("o_orderkey") % 4 == 0, "Gaming").when(F.col("o_orderkey") % 4 == 1, " ").otherwise(F.col("o_orderpriority"))
    return views.table(spark, d, "orders").groupBy(c.game_label(game).alias("label")).agg(F.count(F.lit(1)).alias("n"))


MESSAGES = ("authentication_error: bad", "not_found_error", "Invalid JSON at position 3", "ffmpeg binary not found", "cookies expired today", "Video download failed: 403", "No transcript here", "Private video", "Invalid YouTube URL", "boom")
CLASSES = ("auth", "model", "json", "tool", "cookies", "download", "captions", "unavailable", "url", "other")


@query("error_classes", sql(f"""SELECT month, class, count(*) AS n, max(length(message))::INT AS longest FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, ({_arr(CLASSES)})[o_orderkey % 10 + 1] AS class, ({_arr(MESSAGES)})[o_orderkey % 10 + 1] AS message FROM orders WHERE o_orderstatus = 'P') GROUP BY 1, 2"""))
def error_classes(spark, d):
    message = F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), (F.col("o_orderkey") % 10 + 1).cast("int"))
    failed = views.table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), message.alias("message"))
    return failed.groupBy("month", c.error_class(F.col("message")).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.max(F.length(c.shorten(F.col("message")))).alias("longest"))


URL = "CASE page_id % 4 WHEN 0 THEN 'https://www.youtube.com/watch?v=abcDEF_-' || lpad((page_id % 1000)::VARCHAR, 3, '0') || '&t=' || page_id || 's' WHEN 1 THEN ' https://youtu.be/XYZabc12' || lpad((page_id % 1000)::VARCHAR, 3, '0') || '?start=' || page_id WHEN 2 THEN 'https://youtube.com/shorts/shortid' || lpad((page_id % 10000)::VARCHAR, 4, '0') ELSE url END"


@query("url_parts", sql(f"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'abcDEF_-' || lpad((page_id % 1000)::VARCHAR, 3, '0') WHEN page_id % 4 = 1 THEN 'XYZabc12' || lpad((page_id % 1000)::VARCHAR, 3, '0') WHEN page_id % 4 = 2 THEN 'shortid' || lpad((page_id % 10000)::VARCHAR, 4, '0') END AS video,
  CASE WHEN page_id % 4 < 2 THEN page_id ELSE try_cast(nullif(regexp_extract(url, '[?&]t=(\\d+)', 1), '') AS BIGINT) END AS start_second FROM pages"""))
def url_parts(spark, d):
    three = F.lpad((F.col("page_id") % 1000).cast("string"), 3, "0")
    url = (F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://www.youtube.com/watch?v=abcDEF_-"), three, F.lit("&t="), F.col("page_id").cast("string"), F.lit("s")))
           .when(F.col("page_id") % 4 == 1, F.concat(F.lit(" https://youtu.be/XYZabc12"), three, F.lit("?start="), F.col("page_id").cast("string")))
           .when(F.col("page_id") % 4 == 2, F.concat(F.lit("https://youtube.com/shorts/shortid"), F.lpad((F.col("page_id") % 10000).cast("string"), 4, "0"))).otherwise(F.col("url")))
    pages = views.table(spark, d, "pages").withColumn("_u", url)
    return pages.select("page_id", c.video_id_of(F.col("_u")).alias("video"), c.start_second_of(F.col("_u")).alias("start_second"))


@query("sample_grid", sql("""SELECT o_orderkey, len(ts) AS n, round(list_sum(ts), 0) AS total FROM (SELECT o_orderkey, list_transform(range(0, 10), lambda i: round_even(s + i * ((e - s) / 9), 2)) AS ts FROM (
  SELECT o_orderkey, least(45.0, o_totalprice / 50 * 0.03) AS s0, o_totalprice / 50 AS d0, greatest(30, o_totalprice / 50) AS dd, least(45.0, greatest(30, o_totalprice / 50) * 0.03) AS s, greatest(least(45.0, greatest(30, o_totalprice / 50) * 0.03) + 30, greatest(30, o_totalprice / 50) * 0.92) AS e FROM orders))"""))
def sample_grid(spark, d):
    times = c.sample_times(F.col("o_totalprice") / 50)
    return views.table(spark, d, "orders").select("o_orderkey", times.alias("ts")).select("o_orderkey", F.size("ts").cast("bigint").alias("n"), F.round(F.aggregate("ts", F.lit(0.0), lambda a, x: a + x), 0).alias("total"))


@query("chunk_grid", sql("""SELECT o_orderkey, CASE WHEN ceil(dd / 600) > 24 THEN 24 ELSE ceil(dd / 600) END::INT AS chunks, CASE WHEN ceil(dd / 600) > 24 THEN floor(23 * (dd / 24)) ELSE (ceil(dd / 600) - 1) * 600 END AS last_start
FROM (SELECT o_orderkey, o_totalprice / 10 AS dd FROM orders)"""))
def chunk_grid(spark, d):
    return views.table(spark, d, "orders").select("o_orderkey", c.chunk_starts(F.col("o_totalprice") / 10).alias("t")).select("o_orderkey", F.size("t").alias("chunks"), F.element_at("t", -1).alias("last_start"))
