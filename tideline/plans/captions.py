"""Caption words, speaker turns and the timelines of cut clips."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from pyspark.sql import functions as F

from tideline.functions.numeric import hundredth, nz, tenth
from tideline.functions.patterns import has
from tideline.functions.text import once, strip_fillers
from tideline.operators.ordered import gap_sessions, ordered
from tideline.operators.ranges import overlap_join
from tideline.operators.scans import scan_sessions
from tideline.session import settle

KEY = ["video_id"]
CLIP = ["video_id", "wid"]

# Gaps and limits in seconds, characters and words.
MERGE_GAP, MERGE_CHARS = 0.4, 220
SPEAKER_GAP, SPEAKER_COLOURS = 1.5, 6
WORD_GAP, WORD_LEAST, WORD_MOST = 0.05, 0.1, 1.6
DISPLAY_LAG = 0.055
HIGHLIGHT_GAP = 3
LEAST_WORDS = 5
PROMPT_STEP = 5.0
# Words and phrases that are highlighted.
IMPACT_WORDS = (
    "never", "always", "secret", "insane", "crazy", "unbelievable", "shocking", "wow", "wtf", "omg", "niemals", "geheim", "krass", "wahnsinn", "unglaublich",
    "schock", "alter", "bro", "wait", "warte", "best", "worst", "finally", "truth", "beste", "schlimmste", "endlich", "wahrheit", "why", "how", "what", "warum",
    "wieso", "look", "schau", "guck", "listen", "hör", "joke", "laugh", "funny", "hilarious", "lol", "haha", "witz", "lachen", "lustig", "react", "reaction",
    "scared", "no", "way", "yes", "ja", "nein", "heilige", "holy",
)
IMPACT_PHRASES = (r"\b(oh my god|no way|what the|holy shit|holy|wtf|omg)\b", r"\b(oh mein gott|auf keinen|alter|scheiße)\b")


def merge_captions(lines: DataFrame, gap: float = MERGE_GAP, most: int = MERGE_CHARS) -> DataFrame:
    """Join neighbouring captions ``(video_id, seq, text, start, end)`` while the pause stays short and the text below
    the limit. A merged text is bounded by that limit, so collecting its parts is too."""
    rows = gap_sessions(lines, KEY, "start", gap + 0.01, ["seq"], end="end")
    slim = rows.select(*KEY, "session_start", "start", "seq", "end", F.length("text").alias("chars"))

    def step(prev: Column, row: Column) -> Column:
        close = (row["start"] - prev["until"] < gap) & (prev["chars"] + row["chars"] < most)
        joins = nz(close, False)
        return F.struct(
            F.when(joins, prev["first_seq"]).otherwise(row["seq"]).alias("first_seq"), F.when(joins, prev["first_at"]).otherwise(row["start"]).alias("first_at"),
            F.when(joins, prev["first_at"] + hundredth(row["end"] - prev["first_at"])).otherwise(row["end"]).alias("until"),
            F.when(joins, prev["chars"] + 1 + row["chars"]).otherwise(row["chars"]).cast("int").alias("chars"))

    state = "struct<first_seq:int,first_at:double,until:double,chars:int>"
    placed = scan_sessions(slim, KEY, "session_start", "start", ["seq"], state, step).select(*KEY, "seq", F.col("state.first_seq").alias("_g"))
    joined = lines.join(placed, [*KEY, "seq"])
    return joined.groupBy(*KEY, F.col("_g").alias("seq")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("seq").alias("s"), "text"))), lambda r: r["text"]), " ").alias("text"),
        F.min("start").alias("start"), F.max_by("end", "seq").alias("_end")).withColumn("duration", hundredth(F.col("_end") - F.col("start"))).drop("_end")


def speaker_turns(words: DataFrame) -> DataFrame:
    """Speaker id per word: the given speaker, else a new id after a long pause, else the previous id; with the colour
    slot in order of first appearance."""
    rows = ordered(words, KEY, "start", ["seq"], lag={"_pe": "end"})
    own = F.col("speaker").isNotNull() & (F.col("speaker") != "")
    pause = ~own & F.col("_pe").isNotNull() & (F.col("start") - F.col("_pe") > SPEAKER_GAP)
    rows = ordered(rows.withColumn("_turn", F.when(pause, 1).otherwise(0)), KEY, "start", ["seq"], run_sum={"_n": "_turn"})
    own_id = (F.when(own, F.concat(F.lit("groq-"), F.col("speaker"))).when(F.col("_pe").isNull(), "speaker-0")
              .when(F.col("_turn") == 1, F.concat(F.lit("gap-"), F.col("_n").cast("string"))))
    rows = ordered(rows.withColumn("_id", own_id), KEY, "start", ["seq"], fill={"speaker_id": "_id"}).drop("_pe", "_turn", "_n", "_id")
    first = rows.groupBy(*KEY, "speaker_id").agg(F.min(F.struct("start", "seq")).alias("_f")).select(*KEY, "speaker_id", "_f.start", "_f.seq", F.lit(1).alias("_one"))
    slots = ordered(first, KEY, "start", ["seq"], run_sum={"_k": "_one"}).select(*KEY, "speaker_id", ((F.col("_k") - 1) % SPEAKER_COLOURS).cast("int").alias("colour"))
    return rows.join(slots, [*KEY, "speaker_id"])


def caption_timings(words: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Display end of each word: starts stay, the end is cut before the next word and kept between 0.1 and 1.6 s."""
    rows = ordered(words, keys, "start", ["end", "seq"], lead={"_next": "start"})
    s, nxt = F.col("start"), F.col("_next")
    end = F.greatest(F.col("end"), s + WORD_LEAST)
    end = F.when(nxt.isNotNull(), F.least(end, nxt - WORD_GAP)).otherwise(end)
    end = F.when(end - s > WORD_MOST, s + WORD_MOST).otherwise(end)
    end = F.when(end <= s, s + WORD_LEAST).otherwise(end)
    end = F.when(nz(nxt < end - 0.001, False), F.greatest(s + 0.05, nxt - WORD_GAP)).otherwise(end)
    return rows.withColumn("end", end).drop("_next")


def sync_diagnostics(words: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    rows = ordered(words, keys, "start", ["seq"], lag={"_pe": "end"})
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("words"), F.min("start").alias("first_at"), F.count_if(F.col("start") < 2).alias("first_two_sec"),
                                   F.count_if(F.col("start") < F.col("_pe") - 0.01).alias("overlaps"))


#: Occurs in every lower-case text that can hold an impact word or phrase: a listed word of four letters or more, or the first
#: run of letters of a phrase as a whole word. Stripping fillers never joins two ASCII letters, so neither comes from several words.
_MAY_IMPACT = "|".join(["!", *[w for w in IMPACT_WORDS if len(w) >= 4], r"(?<![a-z0-9_])(?:oh|no|what|holy|wtf|omg|auf|alter|schei)(?![a-z0-9_])"])


def impact_word(text: Column) -> Column:
    """Whether a caption word deserves emphasis."""
    def full(clean: Column) -> Column:
        token = F.element_at(F.split(clean, r"\s+"), 1)
        listed = (F.length(token) >= 4) & token.isin(*IMPACT_WORDS)
        phrase = has(clean, IMPACT_PHRASES[0]) | has(clean, IMPACT_PHRASES[1])
        return F.when(F.length(clean) < 3, False).otherwise(listed | phrase | (F.contains(text, F.lit("!")) & (F.length(token) >= 3)))

    clean = F.lower(F.trim(F.regexp_replace(strip_fillers(text), r"[^A-Za-z0-9_äöüßÄÖÜ]", " ")))
    return F.when(F.lower(text).rlike(_MAY_IMPACT), once(clean, full)).otherwise(False)


def highlight_words(words: DataFrame, min_gap: int = HIGHLIGHT_GAP) -> DataFrame:
    """Emphasised words, at most one in ``min_gap``. Only impact words enter the scan; they are written once, because the scan
    reads them several times."""
    hits = settle(words.withColumn("_pos", F.col("seq").cast("double")).filter(impact_word(F.col("text"))).select(*KEY, "seq", "_pos"))
    rows = gap_sessions(hits, KEY, "_pos", float(min_gap), strict=True)

    def step(prev: Column, row: Column) -> Column:
        take = prev.isNull() | (row["_pos"] - prev["last"] >= min_gap)
        return F.struct(F.when(take, row["_pos"]).otherwise(prev["last"]).alias("last"), take.alias("take"))

    done = scan_sessions(rows, KEY, "session_start", "_pos", ["seq"], "struct<last:double,take:boolean>", step)
    return done.filter("state.take").select(*KEY, "seq")


def clip_words(lines: DataFrame, clips: DataFrame) -> DataFrame:
    """Lines that reach into each clip ``(video_id, wid, w_start, w_end)``."""
    return overlap_join(lines, clips, KEY, (F.col("start"), F.col("end")), (F.col("w_start"), F.col("w_end")))


def prepare_clip_words(lines: DataFrame, clips: DataFrame) -> DataFrame:
    """Words starting inside each clip, on the clip's own time."""
    pairs = overlap_join(lines, clips, KEY, (F.col("start"), F.col("start")), (F.col("w_start"), F.col("w_end")))
    out = pairs.withColumns({"start": F.greatest(F.lit(0.0), F.col("start") - F.col("w_start")), "end": F.greatest(F.lit(0.1), F.col("end") - F.col("w_start"))})
    return out.filter((F.trim("text") != "") & (F.col("end") > F.col("start")))


def clamp_words(words: DataFrame, duration: Column, pad: float = 0.2) -> DataFrame:
    most = F.greatest(F.lit(0.5), duration) + pad
    start = F.greatest(F.lit(0.0), F.col("start"))
    out = words.filter((F.col("start") < most) & (F.trim("text") != "")).withColumns({"_s": start, "_e": F.least(most, F.greatest(start + 0.05, F.col("end")))})
    return out.withColumns({"start": F.col("_s"), "end": F.col("_e")}).drop("_s", "_e").filter("end > start")


def lag_words(words: DataFrame) -> DataFrame:
    """The uniform display lag, with a least duration."""
    start = F.col("start") + DISPLAY_LAG
    return words.withColumns({"end": F.greatest(start + 0.05, F.col("end") + DISPLAY_LAG), "start": start})


def viable(words: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    return words.groupBy(*keys).agg(F.count(F.lit(1)).alias("words")).filter(F.col("words") >= LEAST_WORDS)


def caption_quality(words: DataFrame, duration: Column, keys: Sequence[str] = CLIP) -> DataFrame:
    """Enough words, coverage and rate per clip; ``duration`` may use the clip columns of ``words``."""
    stats = words.groupBy(*keys).agg(F.count(F.lit(1)).alias("words"), F.max_by("end", F.struct("start", "seq")).alias("_last"), F.max(duration).alias("_dur"))
    dur = F.greatest(F.lit(1.0), F.col("_dur"))
    stats = stats.withColumns({"coverage": F.col("_last") / dur, "rate": F.col("words") / dur, "least_words": F.greatest(F.lit(3), F.floor(dur * 0.22)).cast("int")})
    ok = (F.col("words") >= F.col("least_words")) & (F.col("coverage") >= 0.2) & (F.col("rate") >= 0.15)
    return stats.withColumn("pass", ok).drop("_last", "_dur")


def choose_attempt(attempts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First attempt that passes the gate, else the last one. ``attempts`` has ``(attempt, pass)``."""
    order = F.struct(F.col("pass").cast("int"), F.when(F.col("pass"), -F.col("attempt")).otherwise(F.col("attempt")))
    kept = [c for c in attempts.columns if c not in keys]
    return attempts.groupBy(*keys).agg(F.max_by(F.struct(*kept), order).alias("_a")).select(*keys, "_a.*")


def main_timeline_only(words: DataFrame, main: Column, keys: Sequence[str] = CLIP) -> DataFrame:
    return words.groupBy(*keys).agg((F.max("end") <= F.greatest(F.lit(1.0), F.max(main)) + 0.75).alias("main_only"))


def cold_open_words(words: DataFrame, teaser: Column, teaser_at: Column, main: Column) -> DataFrame:
    """Main words on the timeline with an opening teaser: words inside the teaser twice, everything else shifted."""
    t_end = teaser_at + teaser
    inside = words.filter((F.col("start") < t_end) & (F.col("end") > teaser_at))
    inside = inside.withColumns({"_s": F.greatest(F.col("start"), teaser_at) - teaser_at, "_e": F.least(F.col("end"), t_end) - teaser_at}).withColumn("part", F.lit("teaser"))
    after = words.filter(F.col("start") < main).withColumns({"_s": teaser + F.col("start"), "_e": teaser + F.col("end")}).withColumn("part", F.lit("main"))
    both = inside.unionByName(after)
    return both.withColumns({"duration": F.greatest(F.lit(0.05), F.col("_e") - F.col("_s")), "start": F.col("_s")}).drop("_s", "_e", "end")


def merge_teaser(teaser_words: DataFrame, main_words: DataFrame, teaser: Column) -> DataFrame:
    """Separately transcribed teaser and main words on one timeline."""
    first = teaser_words.withColumns({"_s": F.greatest(F.lit(0.0), F.col("start")), "_e": F.least(teaser, F.col("end"))}).filter("_e > _s").withColumn("part", F.lit("teaser"))
    rest = main_words.withColumns({"_s": teaser + F.col("start"), "_e": teaser + F.col("end")}).withColumn("part", F.lit("main"))
    both = first.unionByName(rest).filter(F.trim("text") != "")
    return both.withColumns({"duration": F.greatest(F.lit(0.05), F.col("_e") - F.col("_s")), "start": F.col("_s")}).drop("_s", "_e", "end")


def remap_words(words: DataFrame, old_start: Column, new_start: Column, new_end: Column) -> DataFrame:
    """Words of a clip on the time of its new trim; words outside by more than 0.1 s drop out."""
    main = F.greatest(F.lit(1.0), new_end - new_start)
    src_s, src_e = old_start + F.col("start"), old_start + F.col("end")
    rows = words.filter((src_e >= new_start - 0.1) & (src_s <= new_end + 0.1) & (F.trim("text") != ""))
    rows = rows.withColumns({"_s": F.greatest(F.lit(0.0), src_s - new_start), "_e": F.least(main, src_e - new_start)}).filter("_e > _s")
    return rows.withColumns({"start": F.col("_s"), "end": F.greatest(F.col("_s") + 0.05, F.col("_e"))}).drop("_s", "_e")


def trim_segments(segments: DataFrame, keys: Sequence[str], least: float = 1.15, gap: float = 0.15) -> DataFrame:
    """Cuts shortened so that none reaches into the next one."""
    rows = ordered(segments, keys, "start", ["seq"], lead={"_next": "start"})
    room = F.col("_next") - gap - F.col("start")
    fit = F.when(nz(room < F.col("duration"), False), F.greatest(F.lit(least), tenth(room))).otherwise(F.col("duration"))
    return rows.withColumn("duration", fit).drop("_next").filter(F.col("duration") >= least)


def output_layout(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Place of each cut on the concatenated timeline."""
    rows = segments.withColumn("duration", F.greatest(F.lit(0.5), F.col("duration")))
    rows = ordered(rows, keys, "start", ["seq"], run_sum={"out_end": "duration"}, lead={"_next": "start"})
    return rows.withColumns({"out_start": F.col("out_end") - F.col("duration"), "is_last": F.col("_next").isNull()}).drop("_next")


def source_from_output(layout: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source time of output times ``(keys, out_t)``; the last cut includes its end, times outside fall into the first."""
    pairs = overlap_join(points, layout.select(*keys, "out_start", "out_end", F.col("start").alias("_src"), F.col("duration").alias("_d"), "is_last"), list(keys),
                         (F.col("out_t"), F.col("out_t")), (F.col("out_start"), F.col("out_end")))
    inside = pairs.filter((F.col("out_t") < F.col("out_end")) | F.col("is_last"))
    found = inside.groupBy(*keys, "out_t").agg(F.min_by(F.col("_src") + F.least(F.col("_d"), F.col("out_t") - F.col("out_start")), "out_start").alias("_v"))
    first = layout.groupBy(*keys).agg(F.min_by(F.struct("start", "duration"), "out_start").alias("_f"))
    out = points.join(found, [*keys, "out_t"], "left").join(first, list(keys))
    outside = F.col("_f.start") + F.greatest(F.lit(0.0), F.least(F.col("_f.duration"), F.col("out_t")))
    return out.select(*points.columns, nz(F.col("_v"), outside).alias("source_t"))


def output_from_source(layout: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Output time of source times ``(keys, src_t)``; the last matching cut wins, times after the end map to the end."""
    spans = layout.select(*keys, "out_start", "out_end", F.col("start").alias("_s"), (F.col("start") + F.col("duration")).alias("_e"), "is_last")
    pairs = overlap_join(points, spans, list(keys), (F.col("src_t"), F.col("src_t")), (F.col("_s") - 0.02, F.col("_e")))
    found = pairs.filter(F.col("src_t") < F.col("_e") - 0.01).groupBy(*keys, "src_t").agg(F.max_by(F.col("out_start") + F.col("src_t") - F.col("_s"), "out_start").alias("_v"))
    last = spans.filter("is_last").select(*keys, F.col("_e").alias("_le"), F.col("out_end").alias("_lo"))
    out = points.join(found, [*keys, "src_t"], "left").join(last, list(keys))
    return out.select(*points.columns, nz(F.col("_v"), F.when(F.col("src_t") >= F.col("_le") - 0.05, F.col("_lo")).otherwise(0.0)).alias("out_t"))


def prompt_buckets(lines: DataFrame, step: float = PROMPT_STEP) -> DataFrame:
    """Filler-free lines gathered into buckets: a bucket closes with the first line that starts ``step`` seconds or
    more after the line that closed the last one. Its ``stamp`` is the whole second of that last line, or of its own first
    line if there is none before or that was at 0.

    A line ``step`` or more after its neighbour always closes, so the scan starts anew there; only whether it joins an
    open bucket depends on the line before. Text is joined per bucket, only times enter the scan."""
    # The text is cleaned once; neither sessions nor scan carry it.
    rows = settle(lines.select(*KEY, "seq", "start", strip_fillers(F.col("text")).alias("clean"))).filter("clean != ''")
    slim = gap_sessions(rows.select(*KEY, "start", "seq"), KEY, "start", step, ["seq"], strict=True).select(*KEY, "session_start", "start", "seq")

    def advance(prev: Column, row: Column) -> Column:
        close = prev.isNull() | (row["start"] - prev["closed"] >= step)
        bucket = F.when(prev.isNull(), row["seq"]).otherwise(F.when(prev["shut"], row["seq"]).otherwise(prev["bucket"]))
        return F.struct(F.when(close, row["start"]).otherwise(prev["closed"]).alias("closed"), bucket.alias("bucket"), close.alias("shut"))

    marked = scan_sessions(slim, KEY, "session_start", "start", ["seq"], "struct<closed:double,bucket:int,shut:boolean>", advance)
    marked = ordered(marked.select(*KEY, "session_start", "start", "seq", "state"), KEY, "start", ["seq"], lag={"_before": "state", "_session": "session_start"})
    joins = nz(F.col("_session") != F.col("session_start"), False) & ~nz(F.col("_before.shut"), True)
    placed = marked.select(*KEY, "seq", F.when(joins, F.col("_before.bucket")).otherwise(F.col("state.bucket")).alias("bucket"), F.col("_before.closed").alias("_closed"))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "clean"))), lambda r: r["clean"]), " ")
    out = rows.join(placed, [*KEY, "seq"]).groupBy(*KEY, "bucket").agg(F.min("start").alias("start"), F.min_by("_closed", F.struct("start", "seq", "_closed")).alias("_closed"), said.alias("text"))
    opened = F.when(nz(F.col("_closed"), 0.0) == 0, F.col("start")).otherwise(F.col("_closed"))
    return out.select(*KEY, "bucket", "start", F.floor(opened).alias("stamp"), "text")


def sample_text(df: DataFrame, text: str, out: str, budget: int = 6000, head: int = 2000, tail: int = 1000) -> DataFrame:
    """Long texts cut to a budget: head, evenly sampled middle, tail. The stride is a column of its own and one regular
    expression keeps every n-th character, so the cost is linear in the text."""
    src, mark = F.col(text), F.lit("\n...[sampled]...\n")
    room = budget - head - tail - 20
    rows = df.withColumn("_rest", F.greatest(F.lit(0), F.length(src) - head - tail))
    rows = rows.withColumn("_stride", F.greatest(F.lit(1), F.floor(F.col("_rest") / room)).cast("int"))
    every = F.regexp_replace(F.substring(src, F.lit(head + 1), F.col("_rest")), F.concat(F.lit("(?s)(.).{0,"), (F.col("_stride") - 1).cast("string"), F.lit("}")), F.lit("$1"))
    cut = F.concat(F.substring(src, 1, head), mark, F.left(every, F.lit(room)), mark, F.right(src, F.lit(tail)))
    return rows.withColumn(out, F.when(F.length(src) <= budget, src).otherwise(cut)).drop("_rest", "_stride")


def thirds(text: Column) -> Column:
    size = F.ceil(F.length(text) / 3).cast("int")
    return F.array(F.substring(text, F.lit(1), size), F.substring(text, size + 1, size), F.substring(text, size * 2 + 1, size))


