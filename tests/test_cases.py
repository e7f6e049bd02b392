"""Small cases with expected results worked out by hand."""
import pytest
from pyspark.sql import functions as F

from tideline.functions import text as tx
from tideline.plans import captions as cap
from tideline.plans import classify as cl
from tideline.plans import hooks, identity, projects, reports
from tideline.plans import kills as k
from tideline.plans import loudness as l
from tideline.plans import review
from tideline.plans import select as sel
from tideline.plans import windows as w
from tideline.sources import captions as src
from tideline.sources import records as rec


def events(spark, times, **extra):
    rows = [(1, i, float(t)) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "video_id long, seq long, time double")
    base = {"roi": F.lit("top_right"), "confidence": F.lit(0.9), "player_kill": F.lit(True), "red_highlight": F.lit(True), "highlight_score": F.lit(0.1), "killer": F.lit("a"),
            "victim": F.concat(F.lit("v"), F.col("seq").cast("string")), "method": F.lit("two-pass-ocr"), "activity": F.lit(0.0), "text": F.lit(None).cast("string")}
    return df.withColumns({**base, **extra})


def test_rapid_kills_stay_separate_in_one_continuous_fight(spark):
    packed = k.burst_packs(events(spark, [98, 101, 119, 122]))
    clip = k.pack_clips(packed, 3000.0).collect()
    assert len(clip) == 1 and clip[0].kind == "continuous" and clip[0].kill_count == 4 and clip[0].local_score == 154
    assert list(clip[0].segments[0].kill_times) == [98.0, 101.0, 119.0, 122.0]


def test_raw_flashes_collapse_by_gap(spark):
    quiet = {"player_kill": F.lit(False), "red_highlight": F.lit(False)}
    assert sorted(r.session_start for r in k.collapse_engagements(events(spark, [258, 261, 267], **quiet)).collect()) == [258.0, 267.0]


def test_pack_caps(spark):
    rows = k.burst_packs(events(spark, [0, 10, 20, 30, 40, 90])).groupBy("pack_at").count().collect()
    assert sorted((r.pack_at, r["count"]) for r in rows) == [(0.0, 4), (40.0, 1), (90.0, 1)]


def test_fingerprint_window_counts_from_first_reading(spark):
    e = events(spark, [10, 16, 20]).withColumn("victim", F.lit("b"))
    assert sorted(r.kill_anchor_time for r in k.fingerprint_kills(e).collect()) == [10.0, 20.0]


def test_fingerprint_drops_anchors_at_the_end(spark):
    assert [r.kill_anchor_time for r in k.fingerprint_kills(events(spark, [10, 99.5]), 100.0).collect()] == [10.0]


def test_merged_clips(spark):
    def run(marks):
        df = spark.createDataFrame([(1, float(t)) for t in marks], "video_id long, anchor double")
        return sorted((r.clip_start, r.clip_end, r.kills) for r in k.merged_clips(df, 100.0).collect())

    assert run([10, 14, 30]) == [(6.0, 16.0, 2), (26.0, 32.0, 1)]
    assert run([10, 14, 20]) == [(6.0, 22.0, 3)]


def test_kill_predicates(spark):
    rows = [("bottom_kills", 0.65, True, False, 0.0, None), ("bottom_kills", 0.64, True, False, 0.0, None), ("top_right", 0.5, False, False, 0.03, None), ("top_right", 0.5, False, False, 0.029, None),
            ("top_left", 0.9, False, False, 0.0, "bomb planted"), ("top_left", 0.5, False, False, 0.0, "headshot"), ("top_right", 0.39, True, True, 0.9, None)]
    df = spark.createDataFrame([(1, i, 500.0, *r) for i, r in enumerate(rows)],
                               "video_id long, seq long, time double, roi string, confidence double, player_kill boolean, red_highlight boolean, highlight_score double, text string")
    assert sorted(r.seq for r in k.confirmed_kills(df).collect()) == [0, 2, 5]


def test_coherence_rule(spark):
    df = spark.createDataFrame([([10.0, 30.0],), ([10.0, 60.0],), ([10.0],), ([0.0, 30.0, 60.0],)], "t array<double>")
    segs = F.transform("t", lambda t: F.struct(t.alias("start"), F.lit(5.0).alias("duration"), t.alias("peak_time")))
    strict = [r[0] for r in df.select(k.coherent(segs, False)).collect()]
    derived = [r[0] for r in df.select(k.coherent(segs)).collect()]
    assert strict == [True, False, True, False] and derived == [True, True, True, False]


def score(spark, text, gap=0.0, dur=0.0, cat=None):
    df = tx.measure_lines(spark.createDataFrame([(text,)], "text string"))
    return df.select(tx.line_score(F.lit(gap), F.lit(dur), F.lit(cat) if cat else None)).first()[0]


def test_line_scores(spark):
    assert score(spark, "No way!") == 35
    assert score(spark, "um like you know") == -5
    assert score(spark, "subscribe") == -23
    assert score(spark, "hello there", gap=2.0) == 5 + 5
    assert score(spark, "a b c d e f g h i j k l m n o p", dur=5.0) == 6
    assert score(spark, "ACE now", cat="shooter") == 12 + 2 + 13
    assert score(spark, "so basically that") == 5


def test_word_edges_are_ascii(spark):
    df = spark.createDataFrame([("xécod",), ("ein überhol",), ("aüberhol",)], "t string")
    from tideline.functions.patterns import java, java_lower

    assert [r[0] for r in df.select(F.col("t").rlike(java(r"\bcod\b"))).collect()] == [True, False, False]
    assert [r[0] for r in df.select(F.col("t").rlike(java_lower(r"\b(überhol|crash)\b"))).collect()] == [False, False, True]


def test_upper_median(spark):
    df = spark.createDataFrame([("m", d) for d in (1, 2, 3, 4)], "month string, d long")
    assert reports.upper_median(df, ["month"], "d").first().median == 3


def test_chapter_marks(spark):
    df = spark.createDataFrame([(1, "1:02:03 - Boss\n12:30 – Intro", 9999.0)], "video_id long, description string, duration double")
    assert sorted((r.time, r.label) for r in src.chapter_marks(df).collect()) == [(750.0, "Intro"), (3723.0, "Boss")]


def test_caption_cue(spark):
    raw = "WEBVTT\n\nNOTE x\n\n00:00:01.000 --> 00:00:02.500 align:start\nHello <b>world</b>\n\n1\n00:05,000 --> 00:04.000\nback\n\n01:00.000 --> 01:01.000\na &amp; b\nsecond\n"
    df = spark.createDataFrame([(1, raw)], "video_id long, content string")
    assert sorted((r.text, r.start, r.end) for r in src.vtt_cues(df).collect()) == [("Hello world", 1.0, 2.5), ("a & b second", 60.0, 61.0)]


def test_caption_gate(spark):
    words = spark.createDataFrame([(1, 0, i, "w", float(i), 5.0) for i in range(3)], "video_id long, wid int, seq int, text string, start double, end double")
    out = cap.caption_quality(words, F.lit(10.0)).first()
    assert out["pass"] and out.least_words == 3 and out.coverage == 0.5


def test_name_agreement(spark):
    df = spark.createDataFrame([("simple", "s1mple"), ("simple", "falcon"), (None, "falcon")], "c string, h string")
    assert [r[0] for r in df.select(identity.resolve_pov(F.col("c"), F.col("h"))).collect()] == ["simple", "falcon", "falcon"]


def test_overlap_rule(spark):
    df = spark.createDataFrame([(0.0, 30.0, 25.0, 55.0), (0.0, 30.0, 15.0, 45.0), (0.0, 30.0, 29.0, 60.0)], "a double, b double, c double, d double")
    row = lambda s, e: F.struct(s.alias("start_time"), e.alias("end_time"))
    got = df.select(sel.clash(0.35, 20)(row(F.col("a"), F.col("b")), row(F.col("c"), F.col("d")))).collect()
    assert [r[0] for r in got] == [False, True, False]


def test_pruning_needs_an_age(spark):
    df = spark.createDataFrame([("a", False, 10, 5), ("b", True, 10, 5)], "id string, saved boolean, created_at long, expires_at long")
    now = F.lit(projects.DAY_MS * 100)
    assert projects.prune(df, now).count() == 2
    assert [r.id for r in projects.prune(df, now, 60).collect()] == ["b"]


def test_best_highlight_of_one(spark):
    df = spark.createDataFrame([("p", 0, "clip-1", 30.0, 75.0, 9.0)], "id string, seq int, clip string, start double, stop double, viral_score double")
    assert projects.best_highlight(df).first().clip == "clip-1"


def test_cliffhanger_texts(spark):
    texts = ["Wait until you see what happens next", "and then he will", "What happens in the end?", "short", "this is a long enough line that ends here."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(tx.valid_cliffhanger(F.col("t")).alias("ok"), tx.format_cliffhanger(F.col("t")).alias("f"), hooks.title_tease(F.col("t")).alias("title")).collect()
    assert [r.ok for r in rows] == [True, False, True, False, True]
    assert rows[0].f == "Wait until you see what happens next…" and rows[3].f == ""
    long = spark.createDataFrame([("why does this line simply go on and on until it has to be cut at some",)], "t string").select(tx.format_cliffhanger(F.col("t"), 40)).first()[0]
    assert long == "why does this line simply go on and on…"


def test_word_overlap(spark):
    df = spark.createDataFrame([("this moment changes everything", "everything about this"), ("", "word here")], "a string, b string")
    assert [round(r[0], 3) for r in df.select(tx.word_overlap(F.col("a"), F.col("b"))).collect()] == [round(2 / 3, 3), 0.0]


def test_caption_timing_rules(spark):
    words = spark.createDataFrame([(1, 0, "a", 0.0, 3.0), (1, 1, "b", 1.0, 1.02), (1, 2, "c", 1.05, 9.0)], "video_id long, seq int, text string, start double, end double")
    got = {r.seq: round(r.end, 3) for r in cap.caption_timings(words).collect()}
    assert got == {0: 0.95, 1: 1.05, 2: 2.65}


def test_burst_score_and_logs(spark):
    log = "silence_start: 1.0\nsilence_end: 1.5\nsilence_start: 3.0 max_volume: -3.5 dB\nsilence_end: 4.0"
    df = spark.createDataFrame([(log,)], "log string")
    stats = rec.volume_stats(F.col("log"))
    row = df.select(stats["max_db"].alias("a"), stats["mean_db"].alias("b"), rec.burst_score(rec.log_times(F.col("log"), "silence_start"), rec.log_times(F.col("log"), "silence_end"), F.lit(9.0)).alias("s")).first()
    assert (row.a, row.b, row.s) == (-3.5, -35.0, 5.0)


def test_teaser_window_and_peak(spark):
    df = spark.createDataFrame([(0.0, 30.0, 5.0), (0.0, 30.0, 29.9), (0.0, 30.0, None)], "s double, e double, p double")
    got = [round(r[0], 3) for r in df.select(review.clamp_peak(F.col("s"), F.col("e"), F.col("p"))).collect()]
    assert got == [11.4, 29.5, 21.6]


def test_speech_junctions_count_once(spark):
    rows = [(1, 0, "they call of"), (1, 1, "duty now"), (1, 2, "one"), (1, 3, "tap ace")]
    lines = spark.createDataFrame(rows, "video_id long, seq int, text string")
    assert cl.talk_counts(lines).first().kill_terms == 2


def test_loudness_presets_cap_after_spacing(spark):
    scan = spark.createDataFrame([(1, i, i * 0.5, float(10 if i % 9 == 0 else 0), True) for i in range(3, 400)], "video_id long, idx int, time double, delta double, is_peak boolean")
    got = sorted(r.idx for r in l.loudness_peaks(scan.withColumn("delta", F.col("delta").cast("float")), "payoff").collect())
    assert got == [i for i in range(3, 400) if i % 9 == 0][:40]


def test_dynamic_window_is_capped(spark):
    lines = spark.createDataFrame([(1, i, i * 4.0, i * 4.0 + 3, 10.0) for i in range(40)], "video_id long, seq int, start double, end double, score double")
    points = spark.createDataFrame([(1, 1, 60.0, 163.0)], "video_id long, aid int, peak double, video_end double")
    tails = w.dynamic_tail(points, lines)
    base = w.shifted_windows(tails).filter("pos = 0").first()
    assert (base.w_start, base.w_end) == (42.0, 87.0)
    assert w.shifted_windows(tails).count() == 9


@pytest.mark.parametrize("text,code", [("No transcript", "captions"), ("boom", "other"), ("Video download failed: x", "download")])
def test_error_classes(spark, text, code):
    assert spark.createDataFrame([(text,)], "m string").select(cl.error_class(F.col("m"))).first()[0] == code


def test_phrases_over_short_and_empty_lines(spark):
    """Counts equal those on the joined text, for one-word lines, empty lines and phrases over three lines."""
    import re

    from tideline.plans import classify

    words = "let me explain call of duty react to the cs 2 dota headshot minecraft   reacting to x".split(" ")
    said = {1: words, 2: [w for x in words for w in (x, "")], 3: [" ".join(words)], 4: ["call", "", "", "of duty call of", "duty", " ", "let me", "explain"], 5: ["", " "], 6: ["reacting", "to", "to", "react", "to"]}
    rows = [(v, i, t) for v, ts in said.items() for i, t in enumerate(ts)]
    lines = spark.createDataFrame(rows, "video_id long, seq int, text string")
    got = {}
    for r in classify.rule_counts(classify.joined_lines(lines), ("title", "spoken", "keywords"), ["video_id"]).collect():
        got[r.video_id, r.rule] = got.get((r.video_id, r.rule), 0) + r.n
    want = {(v, i): n for v, ts in said.items() for i, rule in enumerate(classify.RULES) if (n := len(re.findall(rule["pattern"], " ".join(ts))))}
    assert {k: n for k, n in got.items() if n} == want
