"""Choices between whole sets, kill moments of lines, peaks kept apart, finished montages."""
import random
import re

import pytest
from pyspark.sql import functions as F

from tideline.functions import patterns as p
from tideline.operators.cascade import first_qualifying, until_enough
from tideline.plans import shooter as sh


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_first_set_that_qualifies_as_a_whole(spark):
    schema = "video_id int, v int"
    sets = [("a", frame(spark, [(1, 1), (2, 1), (2, 2), (4, 9)], schema), 2), ("b", frame(spark, [(1, 5), (1, 6), (2, 7), (3, 8)], schema), 2), ("c", frame(spark, [(1, 0), (3, 3), (5, 5)], schema), 1)]
    got = sorted(tuple(r) for r in first_qualifying(sets, ["video_id"]).collect())
    assert got == [(1, 5, "b"), (1, 6, "b"), (2, 1, "a"), (2, 2, "a"), (3, 3, "c"), (5, 5, "c")]


def test_sources_count_until_there_is_enough(spark):
    schema = "video_id int, at double, worth int"
    one = frame(spark, [(1, 1.2, 5), (1, 1.9, 9), (1, 7.0, 1), (2, 3.0, 1)], schema)
    two = frame(spark, [(1, 1.5, 1), (2, 4.0, 1), (2, 4.5, 2), (3, 0.0, 1)], schema)
    three = frame(spark, [(1, 9.0, 1), (2, 9.0, 1), (3, 9.0, 1), (4, 9.0, 1)], schema)
    facts = frame(spark, [(1, True), (2, False), (3, False)], "video_id int, full boolean")
    open_ = ~F.coalesce("full", F.lit(False))
    out = until_enough([("one", one, None), ("two", two, open_), ("three", three, open_ & (F.col("have") < 2))], ["video_id"], [F.floor("at")], [F.desc("worth")], facts)
    got = sorted(tuple(r) for r in out.select("video_id", "source", "at").collect())
    assert got == [(1, "one", 1.9), (1, "one", 7.0), (2, "one", 3.0), (2, "two", 4.5), (3, "three", 9.0), (3, "two", 0.0), (4, "three", 9.0)]


def test_kill_moments_of_lines(spark):
    texts = ["Got him!", "nice plant", "nice plant, headshot", "clutch defuse", "clutch the plant", "double kill, bomb", "waiting", "ace", None, "", "bomb planted", "LAST one", "placed", "frag while holding", "Ace's"]
    low = lambda pat, t: bool(re.search(pat, t or "", re.I | re.A))
    rows = sh.keyword_flags(frame(spark, [(1, i, t, float(i)) for i, t in enumerate(texts)], "video_id int, seq int, text string, start double")).collect()
    for r in rows:
        t = r["text"]
        kill, payoff, boring = low(p.KILL_WORDS, t), low(p.PAYOFF_WORDS, t), low(p.BORING_WORDS, t)
        assert (r["kill"], r["payoff"], r["boring"]) == (kill, payoff, boring)
        assert r["moment"] == (kill and not (boring and not low(sh.STILL_KILL_BORING, t)) and not (payoff and not low(sh.STILL_KILL_PAYOFF, t)))
    assert {r["text"] for r in rows if r["moment"]} == {"Got him!", "nice plant, headshot", "double kill, bomb", "ace", "LAST one", "frag while holding", "Ace's"}


def test_keyword_windows_use_two_reaches(spark):
    lines = frame(spark, [(1, t, True, t != 11.0, False) for t in (7.9, 8.0, 11.0, 24.0, 24.1, 28.0, 28.1)], "video_id int, start double, kill boolean, moment boolean, payoff boolean")
    spans = frame(spark, [(1, 0, 10.0, 20.0), (2, 0, 10.0, 20.0)], "video_id int, wid int, w_start double, w_end double")
    got = {r["video_id"]: (r["keyword_lines"], r["moments"]) for r in sh.keyword_windows(spans, lines).collect()}
    assert got == {1: (3, [8.0, 24.0, 24.1, 28.0]), 2: (0, [])}


def test_peaks_apart_in_both_forms(spark):
    rng = random.Random(6)
    rows = [(v, 1.0, round(rng.uniform(0, 30), 1), float(rng.randint(1, 9)), rng.choice(["top_right", "bottom_kills", None]), "event") for v in range(12) for _ in range(rng.randint(1, 25))]
    want = set()
    for v in range(12):
        kept = []
        for r in sorted((r for r in rows if r[0] == v), key=lambda r: (-(45.0 * (r[4] == "top_right") + r[3]), r[2])):
            if len(kept) < 4 and all(abs(r[2] - q[2]) >= 3.5 for q in kept):
                kept.append(r)
        want |= {(r[0], r[2]) for r in kept}
    df = frame(spark, rows, "video_id int, cluster_at double, time double, strength double, roi string, kind string")
    for form in (sh.apart, sh.apart_of_many):
        assert {(r["video_id"], r["time"]) for r in form(df, sh.CLUSTER).collect()} == want


@pytest.mark.parametrize("measured, start, want", [(None, None, (9.5, 3.0, 21.5)), (7.04, 2.0, (7.0, 2.0, 21.5)), (0.5, 0.0, (9.5, 3.0, 21.5))])
def test_finished_montage(spark, measured, start, want):
    df = frame(spark, [([(3.0, 4.0), (16.0, 5.5)], measured, start)], "segments array<struct<start:double,duration:double>>, m double, s double")
    row = df.withColumns(sh.finalise(F.col("segments"), F.col("m"), F.col("s"))).first()
    assert (row["output_duration"], row["start_time"], row["end_time"]) == want


def test_worthy_candidates_need_a_kill(spark):
    cands = frame(spark, [(1, 0, 0.0, 10.0, ["tight-mid"]), (1, 1, 20.0, 30.0, ["tight-mid"]), (1, 2, 40.0, 50.0, ["hud-kills"]), (1, 3, 60.0, 70.0, None)], "video_id int, wid int, w_start double, w_end double, flags array<string>")
    base = (1, 0.0, 1, None, False, False, False, False)
    lines = frame(spark, [(1, 1, 9.0, 11.0, *base[1:], True, True), (1, 2, 25.0, 26.0, *base[1:], False, True)],
                  "video_id int, seq int, start double, end double, score double, words int, mark string, reaction boolean, monologue boolean, setup boolean, negative boolean, kill_talk boolean, boring_talk boolean")
    assert {r["wid"] for r in sh.worthy(cands, lines).collect()} == {0, 2}


def test_prompt_buckets_close_across_gaps(spark):
    from tideline.plans import captions

    lines = frame(spark, [(1, i, t, f"w{i}") for i, t in enumerate([0.0, 1.0, 7.0, 8.0, 9.0, 12.5, 13.0, 30.0])] + [(2, 0, 4.0, "um"), (2, 1, 6.5, "x")], "video_id long, seq int, start double, text string")
    got = sorted((r["video_id"], r["start"], r["stamp"], r["text"]) for r in captions.prompt_buckets(lines).collect())
    assert got == [(1, 0.0, 0, "w0"), (1, 1.0, 1, "w1 w2"), (1, 8.0, 7, "w3 w4 w5"), (1, 13.0, 12, "w6 w7"), (2, 6.5, 6, "x")]
