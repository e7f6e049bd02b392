"""Cheap tests before patterns: the same answers as the patterns alone, and work that is done once."""
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tideline.functions import patterns as p
from tideline.functions import text as tx
from tideline import views
from tideline.plans import captions, classify, hooks, windows
from tideline.functions.frames import SIGNATURES

ODD = ("", "no way", "No-way!", "um like you know", "so basically", "like and subscribe", "let's go lets go", "HÖR scheiße", "überhol könig", "baſically ſmoke flaſh", "spıke ı mean", "1v3 part 7 teil",
       "no um way oh my god", "the reason is", "_kill kill_ kill", "counter-strike counterterrorist", "round  3 tc", "call of duty cod of", "wait what why", "holy shit omg", "a site b site t side", "i can't let's go", "lol reaction lol")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def lines_of(spark, texts):
    return spark.createDataFrame([(i // 4, i % 4, t) for i, t in enumerate(texts)], "video_id bigint, seq int, text string")


@pytest.mark.parametrize("pattern", [*p.REACTION, *p.LORE, *p.NEGATIVE, p.KILL_WORDS, p.BORING_WORDS, p.SETUP_WORDS])
def test_tokens_decide_as_the_pattern_does(spark, pattern):
    rows = tx.measure_lines(lines_of(spark, ODD)).select("text", "clean", p.token_hit(F.col("tok"), F.col("low"), pattern).alias("got"), p.has_lower(F.col("low"), pattern).alias("want"))
    assert [r for r in rows.collect() if r["got"] != r["want"]] == []


def test_single_words_need_no_pattern(spark):
    rows = tx.measure_lines(lines_of(spark, ODD)).select(p.token_hit(F.col("tok"), F.col("low"), r"\b(gestorben|sieg|runde)\b"))
    assert "RLIKE" not in plan(rows).split("\n")[0]


def test_rules_count_as_their_patterns(spark):
    rows = lines_of(spark, ODD).select("video_id", "seq", F.lower("text").alias("low"), F.when(F.col("seq") % 2 == 0, " of duty ace kill baron").otherwise(F.lit("x site")).alias("more"))
    got = {(r["video_id"], r["seq"], r["rule"]): r["n"] for r in classify.rule_counts(rows, ("title", "spoken", "keywords"), ["video_id", "seq"]).collect()}
    want = {}
    for r in rows.collect():
        for i, rule in enumerate(classify.RULES):
            found = lambda text: len(re.findall(f"(?a:{rule['pattern']})", text))  # noqa: B023, E731
            several = re.search(r" |\\s|\\W|(?<!\\)\.", rule["pattern"])
            n = found(r["low"] + r["more"]) - found(r["more"]) if several else found(r["low"])
            if n:
                want[r["video_id"], r["seq"], i] = n
    assert got == want


def test_transcript_rules_run_once(spark):
    lines = lines_of(spark, ODD)
    assert plan(classify.transcript_points(lines)).count("Generate explode(filter(") == 1


def test_impact_words_as_without_the_cheap_test(spark):
    words = [w for t in ODD for w in t.split(" ")] + ["ne-ver", "never", "NEVER.", "x!", "wow!", "no\tway", "oh\nmy\ngod", "what,the", "alter", "halter", "scheiße", "um-wait", "wait", "ßwait"]
    rows = spark.createDataFrame([(w,) for w in words], "text string")
    clean = F.lower(F.trim(F.regexp_replace(tx.strip_fillers(F.col("text")), r"[^A-Za-z0-9_äöüßÄÖÜ]", " ")))
    token = F.element_at(F.split(clean, r"\s+"), 1)
    listed = (F.length(token) >= 4) & token.isin(*captions.IMPACT_WORDS)
    plainly = F.when(F.length(clean) < 3, False).otherwise(
        listed | p.has(clean, captions.IMPACT_PHRASES[0]) | p.has(clean, captions.IMPACT_PHRASES[1]) | (F.contains("text", F.lit("!")) & (F.length(token) >= 3)))
    assert [r for r in rows.select("text", captions.impact_word(F.col("text")).alias("got"), plainly.alias("want")).collect() if r["got"] != r["want"]] == []


def test_impact_words_are_looked_for_once(spark):
    words = lines_of(spark, ("wow never", "insane"))
    assert "never" not in plan(captions.highlight_words(words))


def test_frame_patterns_as_written(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "text string").withColumn("low", F.lower("text"))
    plain = F.translate("low", "ſı", "si")
    for pattern in {x for s in SIGNATURES for x in s["patterns"]}:
        got = rows.select("text", classify._shows(plain, pattern).alias("got"), F.col("low").rlike(p.java(pattern)).alias("want")).collect()
        assert [r for r in got if r["got"] != r["want"]] == [], pattern


def test_a_window_is_measured_once(spark, monkeypatch):
    seen = []
    whole = windows.window_metrics
    monkeypatch.setattr(windows, "window_metrics", lambda lines, spans: (seen.append(spans.count()), whole(lines, spans))[1])
    lines = windows.scored_lines(spark.createDataFrame([(1, i, "wow that was insane!", i * 3.0, i * 3.0 + 2) for i in range(12)], "video_id bigint, seq int, text string, start double, end double"))
    points = spark.createDataFrame([(1, aid, 20.0, 40.0) for aid in range(1, 6)], "video_id bigint, aid int, peak double, video_end double")
    best = windows.best_windows(lines, points).collect()
    assert len(best) == 5 and len({(r["w_start"], r["w_end"]) for r in best}) == 1
    assert seen[0] <= 9


def test_buckets_clean_the_text_once(spark):
    """The filler pattern ran in each of the steps that find sessions, scan them and join the text again."""
    lines = spark.createDataFrame([(1, i, f"um line {i} like", i * 2.0, i * 2.0 + 1) for i in range(6)], "video_id long, seq int, text string, start double, end double")
    assert "basically" not in plan(captions.prompt_buckets(lines))


def test_cleaned_text_is_evaluated_once_by_the_tease_rules(spark):
    """What a rule was given stood in its expression once per use, nested rules multiplied that."""
    lines = spark.createDataFrame([("why did that happen?",)], "t string").select(tx.format_cliffhanger(F.col("t")).alias("f"), tx.valid_cliffhanger(tx.strip_fillers(F.col("t"))).alias("v"))
    assert plan(lines.select("f")).count("basically") == 2 and plan(lines.select("v")).count("basically") == 2
    assert tuple(lines.first()) == ("why did that happen?", True)


def test_fillers_match_as_by_the_folding_pattern(spark):
    texts = ["um, so LIKE it", "summer like_this unlike", "ſort of like", "Kind of um", "lİke lıke UH", "äum umä um", "i  mean you know it", "like like likes", "", None, "éum umé 2um um2 _um um-um"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.strip_fillers(F.col("t")).alias("got"), tx.squeeze(F.regexp_replace("t", p.java(p.FILLERS), "")).alias("want")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def test_shared_words_count_repeats_and_stay_linear(spark):
    rnd, words = random.Random(5), ["alpha", "beta", "gamma", "größe", "of", "it", "delta_1", "x"]
    made = [(" ".join(rnd.choices(words, k=rnd.randint(0, 9))), ", ".join(rnd.choices(words, k=rnd.randint(0, 9)))) for _ in range(80)] + [("Alpha-BETA gamma", "alpha\tbeta!gammas"), ("", ""), ("ÄÖÜß alpha", "äöüß ALPHA alpha")]
    long_ = " ".join(f"word{i}" for i in range(30_000))
    keep = lambda s: [w for w in re.split(r"[^A-Za-z0-9_äöüßÄÖÜ]+", s.lower()) if len(w) > 3]
    want = [(sum(w in set(keep(a)) for w in keep(b)) / len(keep(b))) if keep(a) and keep(b) else 0.0 for a, b in made]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([*made, (long_, long_)])], "i int, a string, b string").coalesce(1).sortWithinPartitions("i")
    started = time.monotonic()
    got = [r[0] for r in rows.select(tx.word_overlap(F.col("a"), F.col("b"))).collect()]
    assert got == [*want, 1.0] and time.monotonic() - started < 30


def test_buckets_of_repeated_rows_have_one_stamp(spark):
    """Which of two equal rows gave the stamp followed from the order in which they arrived."""
    rows = [(1, i, f"line {i}", t, t + 1) for i, t in enumerate((3.0, 9.5, 11.0, 17.25))]
    got = {tuple(captions.prompt_buckets(spark.createDataFrame(r, "video_id long, seq int, text string, start double, end double").repartition(n)).orderBy("bucket").select("bucket", "stamp").collect())
           for r, n in ((rows * 2, 1), (rows[::-1] * 2, 3), (rows * 2, 2))}
    assert len(got) == 1


def test_points_with_one_peak_share_their_tails(spark, monkeypatch):
    """tails, variants and the choice were worked out for each of the points around a peak."""
    seen = []
    whole = windows.dynamic_tail
    monkeypatch.setattr(windows, "dynamic_tail", lambda points, *rest: (seen.append(points.count()), whole(points, *rest))[1])
    lines = windows.scored_lines(spark.createDataFrame([(1, i, "wow that was insane!", i * 3.0, i * 3.0 + 2) for i in range(12)], "video_id bigint, seq int, text string, start double, end double"))
    points = spark.createDataFrame([(1, 1, 20.0, 40.0), (1, 2, 20.0, 40.0), (1, 3, 9.0, 40.0), (None, 4, 9.0, 40.0)], "video_id bigint, aid int, peak double, video_end double")
    best = {r["aid"]: r for r in windows.best_windows(lines, points).collect()}
    assert seen == [3] and sorted(best) == [1, 2, 3, 4]
    assert best[1]["w_start"] == best[2]["w_start"] and best[1]["composite"] == best[2]["composite"] > best[4]["composite"] == windows.EMPTY_WINDOW


def test_only_lonely_points_look_far(spark, monkeypatch):
    """every point met all lines within 45 s, also those with a line within 18 s."""
    seen = []
    whole = windows.peak_line_near
    monkeypatch.setattr(windows, "peak_line_near", lambda points, lines, at, radius, out: (seen.append((radius, points.count())), whole(points, lines, at, radius, out))[1])
    lines = windows.scored_lines(spark.createDataFrame([(1, 0, "wow that was insane!", 1.0, 3.0), (1, 1, "and on", 60.0, 63.0)], "video_id bigint, seq int, text string, start double, end double"))
    chapters = spark.createDataFrame([(1, 100.0, "Boss"), (1, 200.0, "End")], "video_id bigint, time double, label string")
    ends = spark.createDataFrame([(1, 210.0)], "video_id bigint, video_end double")
    got = {r["time"]: r["peak"] for r in windows.top_anchors(lines, ends, chapters).collect()}
    assert seen == [(18.0, 4), (45.0, 2)]
    assert got == {0.0: 1.0, 60.0: 60.0, 100.0: 60.0, 200.0: 200.0}


def test_teasers_meet_their_lines_once(spark):
    """the lines were joined with the clips for the best line, for the one near the fixed point and for whether there is one."""
    texts = ("and then we walk on", "no way that was insane!", "um like", "oh my god holy!", "scheiße, wahnsinn", "lol", "the end is near")
    lines = hooks.hook_lines(spark.createDataFrame([(1, i, t, i * 4.0, i * 4.0 + 3) for i, t in enumerate(texts)], "video_id long, seq int, text string, start double, end double"))
    scores = lines.select("text", "opening", tx.teaser_score(F.col("clean"), F.col("base"), F.lit(0.3)).alias("whole")).collect()
    assert [r["opening"] - 18 for r in scores] == [r["whole"] for r in scores]
    clips = spark.createDataFrame([(1, 0, 0.0, 28.0), (1, 1, 500.0, 528.0), (2, 0, 0.0, 28.0), (1, 2, 24.0, 100.0), (None, 0, 0.0, 28.0)], "video_id long, wid int, w_start double, w_end double")
    found = hooks.teaser_peaks(lines, clips)
    got = {(r["video_id"], r["wid"]): (r["has_lines"], round(r["teaser_at"], 2), r["teaser_line"]) for r in found.collect()}
    assert got == {(1, 0): (True, 12.0, "oh my god holy!"), (1, 1): (False, 520.16, ""), (2, 0): (False, 20.16, ""), (None, 0): (False, 20.16, ""), (1, 2): (True, 78.72, "")}
    assert plan(found).count("Join Inner") == 1


def test_ends_of_transcripts_need_no_order(spark, tmp_path):
    """the end of a recording was found by putting all its lines in order; words were counted by a function per word."""
    docs = [(1, "one two\n\n  three   four five "), (1, "again"), (2, ""), (3, None), (None, "\n".join(f"line {i}" for i in range(5000))), (None, "more\nlines")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ends = views.transcript_ends(spark, str(tmp_path))
    want = views.transcript(spark, str(tmp_path)).groupBy("video_id").agg(F.max("end").alias("e"))
    assert sorted(ends.collect(), key=str) == sorted(want.collect(), key=str)
    assert "Window" not in plan(ends) and "lambda" not in plan(views.transcript(spark, str(tmp_path)))


def test_white_space_is_mapped_only_where_there_is_some(spark):
    """every character of every line went through the map of white space."""
    odd = ["", " ", "a b", "a  b", " a ", *(f"x{c}y{c}" for c in tx.SPACES), "na\u00efve caf\u00e9", "\U0001f600 ok", "\u2014 dash", "tab\there", None]
    rows = spark.createDataFrame([(t,) for t in odd], "text string")
    plain = F.trim(F.regexp_replace(F.translate("text", tx.SPACES, " " * len(tx.SPACES)), " {2,}", " "))
    got = rows.select(tx.squeeze(F.col("text")).alias("got"), plain.alias("want"))
    assert [r for r in got.collect() if r["got"] != r["want"]] == []
    assert "CASE WHEN" in plan(got.select("got"))


def test_of_a_line_that_comes_twice_the_earlier_one_teases(spark):
    """which of two rows with one number was the teaser followed from their order of arrival."""
    clips = spark.createDataFrame([(1, 0, 0.0, 28.0)], "video_id long, wid int, w_start double, w_end double")
    for rows in ([(1, 0, "no way", 13.0, 14.5), (1, 0, "no way", 15.0, 16.0)], [(1, 0, "no way", 15.0, 16.0), (1, 0, "no way", 13.0, 14.5)]):
        lines = hooks.hook_lines(spark.createDataFrame(rows, "video_id long, seq int, text string, start double, end double").coalesce(1))
        assert hooks.teaser_peaks(lines, clips).first()["teaser_at"] == 13.0
