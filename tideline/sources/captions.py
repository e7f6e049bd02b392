"""Caption files, transcription output and caption rows as transcript lines."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline import schemas
from tideline.functions.numeric import hundredth, nz
from tideline.plans.captions import merge_captions

KEY = ["video_id"]
# Preferred caption languages, best first, and least durations in seconds.
LANGUAGES = ("de", "en", "de-de", "en-us", "en-gb")
LEAST = 0.05
_CUE = r"(?m)^([^\n]*-->[^\n]*)\n?((?:(?![^\n]*-->)[^\n]*\S[^\n]*(?:\n|\z))*)"


def strip_tags(text: Column) -> Column:
    """Remove markup and decode the five basic entities."""
    out = F.regexp_replace(nz(text, ""), "<[^>]+>", "")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def timestamp_seconds(ts: Column) -> Column:
    """``H:MM:SS.mmm`` or ``MM:SS.mmm`` with point or comma as seconds."""
    parts = F.split(F.trim(ts), ":")
    num = lambda i: nz(F.replace(F.get(parts, i), F.lit(","), F.lit(".")).try_cast("double"), 0.0)
    return F.when(F.size(parts) == 3, num(F.lit(0)) * 3600 + num(F.lit(1)) * 60 + num(F.lit(2))).when(F.size(parts) == 2, num(F.lit(0)) * 60 + num(F.lit(1))).otherwise(num(F.lit(0)))


def vtt_cues(raw: DataFrame) -> DataFrame:
    """Cues of ``(video_id, content)`` texts; a cue's text ends at a blank line or the next cue."""
    body = raw.select(*KEY, F.replace("content", F.lit("\r"), F.lit("")).alias("c"))
    cues = body.select(*KEY, F.posexplode(F.arrays_zip(F.regexp_extract_all("c", F.lit(_CUE), 1).alias("head"), F.regexp_extract_all("c", F.lit(_CUE), 2).alias("body"))).alias("seq", "z"))
    side = lambda i: timestamp_seconds(F.get(F.split(F.trim(F.get(F.split("z.head", "-->"), F.lit(i))), " "), F.lit(0)))
    text = F.array_join(F.filter(F.transform(F.split("z.body", "\n"), strip_tags), lambda s: s != ""), " ")
    rows = cues.select(*KEY, "seq", F.trim(text).alias("text"), side(0).alias("_s"), side(1).alias("_e")).filter((F.col("text") != "") & (F.col("_e") > F.col("_s")))
    return _placed(rows, hundredth(F.col("_s")), F.greatest(F.lit(LEAST), hundredth(F.col("_e") - F.col("_s"))))


def _placed(rows: DataFrame, start: Column, duration: Column) -> DataFrame:
    return rows.select(*KEY, "seq", "text", start.alias("start"), (start + duration).alias("end"))


def json3_cues(raw: DataFrame) -> DataFrame:
    """Timed text of ``(video_id, content)`` JSON documents; unreadable documents yield no rows."""
    ev = raw.select(*KEY, F.posexplode(F.from_json("content", schemas.JSON3)["events"]).alias("seq", "e")).filter(F.size("e.segs") > 0)
    text = F.trim(F.array_join(F.transform("e.segs", lambda s: strip_tags(s["utf8"])), ""))
    rows = ev.select(*KEY, "seq", text.alias("text"), "e.tStartMs", "e.dDurationMs").filter("text <> ''")
    length = F.greatest(F.lit(50.0), F.when(nz(F.col("dDurationMs"), 0.0) == 0, 1500.0).otherwise(F.col("dDurationMs"))) / 1000
    return _placed(rows, hundredth(nz(F.col("tStartMs"), 0.0) / 1000), hundredth(length))


def read_captions(spark: SparkSession, path: str, video_id: Column | None = None) -> DataFrame:
    """Caption files under ``path`` by suffix, one scan per format, neighbouring captions merged."""
    key = video_id if video_id is not None else F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)
    files = spark.read.format("text").option("wholetext", True)
    vtt = files.option("pathGlobFilter", "*.vtt").load(path).select(key.alias("video_id"), F.col("value").alias("content"))
    js = files.option("pathGlobFilter", "*.json*").load(path).select(key.alias("video_id"), F.col("value").alias("content"))
    return merge_captions(vtt_cues(vtt).unionByName(json3_cues(js)))


def subtitle_score(name: Column) -> Column:
    """Preference of a caption file name: language, no automatic captions, format."""
    low = F.lower(name)
    lang = F.lit(0)
    for i, code in reversed(list(enumerate(LANGUAGES))):
        lang = F.when(F.contains(low, F.lit(f".{code}.")), 100 - i).otherwise(lang)
    return lang - F.when(F.contains(low, F.lit(".auto")), 2).otherwise(0) + F.when(low.endswith(".vtt"), 5).when(low.endswith(".json3"), 3).otherwise(0)


def best_subtitle(files: DataFrame) -> DataFrame:
    """One file per recording from ``(video_id, seq, name)``: highest score, first on ties."""
    return files.groupBy(*KEY).agg(F.max_by("name", F.struct(subtitle_score(F.col("name")), -F.col("seq"))).alias("name"))


def stt_words(raw: DataFrame) -> DataFrame:
    """Words of transcription documents ``(video_id, content, offset)``: document words, else segment words, else
    segment text; speaker from the word or its segment."""
    doc = raw.select(*KEY, nz(F.col("offset"), 0.0).alias("_o"), F.from_json("content", schemas.STT).alias("d"))
    off = F.greatest(F.lit(0.0), F.col("_o"))
    has = lambda c: nz(F.size(c) > 0, False)
    part = "struct<text:string,start:double,end:double,speaker:string>"
    own = F.transform("d.words", lambda w: F.struct(w["word"].alias("text"), w["start"].alias("start"), w["end"].alias("end"), F.coalesce(w["speaker_id"], w["speaker"]).alias("speaker")).cast(part))
    from_seg = F.flatten(F.transform("d.segments", lambda s: F.when(has(s["words"]), F.transform(s["words"], lambda w: F.struct(w["word"], w["start"], w["end"], F.coalesce(w["speaker_id"], w["speaker"], s["speaker"])).cast(part)))
                                     .otherwise(F.array(F.struct(s["text"], s["start"], s["end"], s["speaker"]).cast(part)))))
    rows = doc.select(*KEY, off.alias("_o"), F.posexplode(F.when(has(F.col("d.words")), own).otherwise(from_seg)).alias("seq", "w")).select(*KEY, "_o", "seq", "w.*")
    rows = rows.withColumn("text", F.trim("text")).filter("text <> ''")
    start = F.col("start") + F.col("_o")
    return rows.select(*KEY, "seq", "text", start.alias("start"), F.greatest(start + LEAST, F.col("end") + F.col("_o")).alias("end"), "speaker")


def caption_rows(rows: DataFrame) -> DataFrame:
    """Caption rows ``(video_id, seq, text, offset, duration)`` whose times may be milliseconds."""
    sec = lambda c: F.when(c > 5000, c / 1000).otherwise(c)
    length = F.greatest(F.lit(LEAST), sec(F.when(nz(F.col("duration"), 0.0) == 0, 1.0).otherwise(F.col("duration"))))
    return _placed(rows.withColumn("text", F.trim(nz(F.col("text"), ""))).filter("text <> ''"), sec(F.col("offset")), length)


def first_available(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """The lines of the first source that has any, per recording, tagged with its name."""
    tagged = [df.withColumns({"source": F.lit(name), "_p": F.lit(i)}) for i, (name, df) in enumerate(sources)]
    lines = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    best = lines.groupBy(*KEY).agg(F.min("_p").alias("_best"))
    return lines.join(best, KEY).filter(F.col("_p") == F.col("_best")).drop("_p", "_best")


def missing_work(requests: DataFrame, done: DataFrame, version: int) -> DataFrame:
    """Requests without a stored result of the same version, content hash, model and opening key."""
    keys = ["clip_hash", "model", "cold_open_key"]
    valid = done.filter((F.col("version") == version) & (F.col("segments") > 0)).select(*keys).distinct()
    return requests.join(valid, keys, "left_anti")


def chapter_marks(text: DataFrame) -> DataFrame:
    """Chapter times and labels from ``(video_id, description, duration)``."""
    pattern = F.lit(r"(\d{1,2}):(\d{2})(?::(\d{2}))?\s*[-–—:]\s*([^\n]+)")
    group = lambda i: F.regexp_extract_all("description", pattern, i)
    rows = text.select(*KEY, "duration", F.posexplode(F.arrays_zip(group(1).alias("a"), group(2).alias("b"), group(3).alias("c"), group(4).alias("label"))).alias("seq", "z"))
    a, b, c = (F.col(f"z.{x}").try_cast("int") for x in "abc")
    time = F.when(c.isNotNull(), a * 3600 + b * 60 + c).otherwise(a * 60 + b)
    return rows.select(*KEY, "seq", time.cast("double").alias("time"), F.left(F.trim("z.label"), F.lit(80)).alias("label"), "duration").filter((F.col("time") >= 0) & (F.col("time") < F.col("duration"))).drop("duration")
