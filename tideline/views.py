"""Driver tables seen as timeline entities. The same definitions exist as SQL in ``catalog/prefix.py``."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.ordered import ordered

EPOCH_2024 = 1704067200
REGION_OF_TYPE = {"purchase": "top_right", "signup": "bottom_kills", "view": "top_right_2", "click": "top_left", "error": "center_banner"}
BANNER_TEXTS = ("headshot kill", "bomb planted", "round info", "")
RECORDING_SEC = 2592.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kill_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as detections: one recording per user, one second per 1000 s of wall time."""
    k = F.expr("try_cast(get_json_object(props, '$.k') as int)")
    roi = F.col("event_type")
    mapped = F.lit(None).cast("string")
    for name, region in REGION_OF_TYPE.items():
        mapped = F.when(roi == name, region).otherwise(mapped)
    score = F.col("value") / 1000
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_id"),
        F.col("event_id").alias("seq"),
        ((F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) - EPOCH_2024) / 1000).alias("time"),
        mapped.alias("roi"),
        F.least(F.lit(0.99), F.lit(0.4) + F.col("value") / 250).alias("confidence"),
        F.coalesce(k % 2 == 0, F.lit(False)).alias("player_kill"),
        F.coalesce(k % 3 == 0, F.lit(False)).alias("red_highlight"),
        score.alias("highlight_score"),
        F.concat(F.lit("p"), k % 7).alias("killer"),
        F.concat(F.lit("v"), k % 11).alias("victim"),
        (F.col("value") / 490).alias("activity"),
        F.when(roi.isin("error", "click"), F.element_at(F.array(*[F.lit(x) for x in BANNER_TEXTS]), F.coalesce(k % 4, F.lit(3)) + 1)).alias("text"),
        F.when(k % 10 == 0, "red-highlight").otherwise("ocr").alias("method"),
    )


def loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as a raw loudness series: one recording per vector, one bucket per element."""
    src = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("video_id"), F.posexplode("embedding").alias("idx", "x"))
    return src.select("video_id", "idx", (F.col("x").cast("double") * 40).alias("db"), F.col("x").cast("double").alias("sample"))


LINE_TILE = 4096


def _document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    words = F.size(F.array_remove(F.split("text", " "), ""))
    lines = lines.withColumns({"_dur": F.greatest(F.lit(5), words * 4).cast("bigint"), "_gap": ((F.length("text") % 4) * 5).cast("bigint")})
    return lines.withColumn("_len", F.col("_dur") + F.col("_gap"))


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as timed lines: one recording per document, one line per text line.

    Times are running sums of whole tenths of a second, so they are exact in any order of summation.
    """
    timed = ordered(_document_lines(spark, sf_dir), ["video_id"], "seq", tile=LINE_TILE, run_sum={"_end": "_len"})
    return timed.select("video_id", "seq", "text", ((F.col("_end") - F.col("_dur")) / 10).alias("start"), (F.col("_end") / 10).alias("end"),
                        (F.col("_dur") / 10).alias("duration"))


def transcript_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ``end`` of each recording's :func:`transcript` as ``e``. Lines last longer than nothing, so it is the sum of their
    lengths, and no line has to be put in order; running sums of rows without a recording begin anew in each tile."""
    tiles = _document_lines(spark, sf_dir).groupBy("video_id", F.floor(F.col("seq") / F.lit(float(LINE_TILE))).alias("_tile")).agg(F.sum("_len").alias("_sum"))
    total = F.when(F.col("video_id").isNull(), F.max("_sum")).otherwise(F.sum("_sum"))
    return tiles.groupBy("video_id").agg((total / 10).alias("e"))


# Longer recordings for analyses that need sound, kills and speech together.
LONG_VECTORS, LONG_EVENTS, LONG_TEXTS, LONG_SEC = 8, 25, 16, 640.0


CALLS = ("", "Got him! ", "", "", "bomb planted, ", "", "nice HEADSHOT ", "", "waiting to plant, ", "", "ace, defused: ", "", "one tap ", "", "clutch the bomb ", "", "eco, nice ")


def long_loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight vectors in a row as one loudness series of 256 s."""
    rows = loudness(spark, sf_dir)
    part = F.col("video_id") % LONG_VECTORS
    return rows.select(F.floor(F.col("video_id") / LONG_VECTORS).alias("video_id"), (part * 64 + F.col("idx")).cast("int").alias("idx"), "db")


def long_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections on a faster clock (one second per 10 s of wall time, wrapped at 640 s), 25 of them a recording."""
    return kill_events(spark, sf_dir).withColumns({"video_id": F.floor(F.col("seq") / LONG_EVENTS), "time": (F.col("time") * 100) % LONG_SEC})


def long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of 16 documents, each 40 s after the one before, as one transcript. The prose has no calls of its own, so a line's
    length decides which call, if any, it begins with."""
    rows = transcript(spark, sf_dir)
    call = F.element_at(F.array(*[F.lit(x) for x in CALLS]), (F.length("text") % len(CALLS) + 1).cast("int"))
    later = (F.col("video_id") % LONG_TEXTS) * 40
    return rows.select(F.floor(F.col("video_id") / LONG_TEXTS).alias("video_id"), (F.col("video_id") % LONG_TEXTS * 1_000_000 + F.col("seq")).alias("seq"),
                       F.concat(call, F.col("text")).alias("text"), (F.col("start") + later).alias("start"), (F.col("end") + later).alias("end"))


AS_OF_MS = 902016000000  # 1998-08-02


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` with their ``lineitem`` totals as processed jobs. Lines are summed per order before the join."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).cast("int").alias("highlights"), F.sum("l_quantity").cast("int").alias("kills"), F.max(F.col("l_returnflag") == "R").alias("has_montage"))
    o = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    k, done = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    return o.select(
        k.alias("job_id"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "error").otherwise("running").alias("status"),
        F.when((F.col("o_orderstatus") == "P") & (k % 7 != 0), F.concat(F.lit("E"), (k % 5).cast("string"))).alias("error_code"),
        F.when(k % 3 == 0, "youtube").when(k % 3 == 1, "local").alias("source_type"),
        F.when(k % 2 == 0, "https://youtube.example/v").otherwise("https://example.org/v").alias("url"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "cs2").otherwise(F.col("o_orderpriority")).alias("category"),
        F.timestamp_millis(F.unix_millis(done) - (k % 2400) * 1000).alias("started_at"), done.alias("completed_at"), done.alias("created_at"),
        F.coalesce("highlights", F.lit(0)).alias("highlights"), F.coalesce("kills", F.lit(0)).alias("kills"), F.coalesce("has_montage", F.lit(False)).alias("has_montage"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` with the latest order as library projects; expiry is seven days after the order."""
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.unix_millis(F.max("o_orderdate").cast("timestamp")).alias("last"), F.count(F.lit(1)).cast("int").alias("n"))
    c = table(spark, sf_dir, "customer").join(last, "c_custkey", "left")
    saved = F.col("c_acctbal") > 5000
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_custkey").alias("job_id"), F.concat_ws(" ", "c_mktsegment", "c_name").alias("title"), F.concat(F.lit("https://example.org/"), "c_custkey").alias("url"),
        F.when(F.col("c_nationkey") % 2 == 0, "youtube").otherwise("local").alias("source_type"), F.coalesce("n", F.lit(0)).alias("clip_count"),
        F.coalesce("last", F.lit(AS_OF_MS)).alias("created_at"), F.coalesce("last", F.lit(AS_OF_MS)).alias("updated_at"),
        F.when(~saved & F.col("last").isNotNull(), F.col("last") + 7 * 86400000).alias("expires_at"), saved.alias("saved"))
