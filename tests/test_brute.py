"""Queries without an SQL counterpart, checked against plain Python on small random data."""
import random

from pyspark.sql import functions as F

from tideline.plans import chains, hooks, identity
from tideline.plans import pool as pool_plan
from tideline.plans import select as sel
from tideline.plans import windows as w

COLS = "video_id long, seq long, time double, roi string, confidence double, player_kill boolean, red_highlight boolean, highlight_score double"


def kill_rows(seed, n=40, span=900):
    rnd = random.Random(seed)
    rows = []
    for v in (1, 2):
        for i in range(n):
            rows.append((v, v * 1000 + i, round(rnd.uniform(0, span), 2), rnd.choice(["top_right", "bottom_kills", "top_left"]), round(rnd.uniform(0.4, 0.99), 3), rnd.random() < 0.5, rnd.random() < 0.3, round(rnd.uniform(0, 0.4), 3)))
    return rows


def value(r):
    return (50 if r[5] or r[6] else 0) + r[7] * 30 + r[4] * 12 + (4 if r[3].startswith("top_right") else 0)


def dedupe(rows, gap, most):
    feed = [r for r in rows if r[3].startswith("top_right")]
    use = sorted(feed if len(feed) >= 2 else rows, key=lambda r: (r[2], r[1]))
    groups = []
    for r in use:
        if groups and r[2] - groups[-1][-1][2] <= gap:
            groups[-1].append(r)
        else:
            groups.append([r])
    best = [next(r for r in g if value(r) >= max(map(value, g)) - 0.05) for g in groups]
    return best[:most]


def chain_score(rows):
    span = rows[-1][2] - rows[0][2]
    feed = sum(r[5] or r[6] or r[3].startswith("top_right") for r in rows)
    n = len(rows)
    count = 90 if n >= 4 else 55 if n == 3 else 12
    tight = 100 if span < 75 else 50 if span < 120 else 0
    return count + n * 35 + sum(r[4] for r in rows) / n * 28 + feed * 18 + min(120, span * 0.35) - (15 if rows[0][2] < 90 else 0) - tight


def keep_disjoint(raw):
    kept = []
    for c in raw:
        if not any(abs(a[2] - b[2]) < 3 for k in kept for a in k for b in c):
            kept.append(c)
    return kept


def test_sliding_chains(spark):
    rows = kill_rows(5)
    got = sorted((r.video_id, tuple(r.kill_times)) for r in chains.sliding_chains(spark.createDataFrame(rows, COLS)).collect())
    want = []
    for v in (1, 2):
        mine = sorted((r for r in rows if r[0] == v), key=lambda r: (r[2], r[1]))
        raw = []
        for i, first in enumerate(mine):
            chain = [first]
            for nxt in mine[i + 1:]:
                if len(chain) == 4 or nxt[2] - chain[-1][2] > 95 or nxt[2] - first[2] > 600:
                    break
                chain.append(nxt)
            kills = dedupe(chain, 4.5, 4)
            if len(kills) >= 2:
                raw.append((first, kills))
        raw.sort(key=lambda c: (-len(c[1]), c[1][-1][2] - c[1][0][2], -chain_score(c[1]), c[1][0][2], c[0][1]))
        want += [(v, tuple(r[2] for r in c)) for c in keep_disjoint([c for _, c in raw])]
    assert got == sorted(want)


def test_wide_chains(spark):
    rows = kill_rows(6, n=25)
    got = sorted((r.video_id, tuple(r.kill_times)) for r in chains.wide_chains(spark.createDataFrame(rows, COLS)).collect())
    want = []
    for v in (1, 2):
        mine = sorted((r for r in rows if r[0] == v), key=lambda r: (r[2], r[1]))
        raw = []
        for i, first in enumerate(mine):
            chain = [first]
            for nxt in mine[i + 1:]:
                if len(chain) < 4 and nxt[2] - chain[-1][2] >= 30:
                    chain.append(nxt)
            if len(chain) >= 2 and chain[-1][2] - first[2] >= 75:
                raw.append(chain)
        raw.sort(key=lambda c: (-(c[-1][2] - c[0][2]), -len(c), -chain_score(c), c[0][2], c[0][1]))
        want += [(v, tuple(r[2] for r in c)) for c in keep_disjoint(raw)]
    assert got == sorted(want)


def share(a, b):
    lo, hi = max(a["s"], b["s"]), min(a["e"], b["e"])
    return 0 if hi <= lo else (hi - lo) / (min(a["e"] - a["s"], b["e"] - b["s"]) or 1)


def pick_five(picks, cands, duration):
    gap = 90 if duration > 600 else 22
    close = lambda a, b: share(a, b) > 0.35 or abs(a["s"] - b["s"]) < gap
    kept = []
    free = lambda h: not any(close(k, h) for k in kept)
    seen = lambda h: any(k["i"] == h["i"] for k in kept)
    for h in picks:
        if len(kept) < 5 and h["strong"] and free(h) and not seen(h):
            kept.append(h)
    for h in picks:
        if len(kept) < 3 and h["q"] >= 8 and h["c"] >= 42 and free(h) and not seen(h):
            kept.append(h)
    order = sorted(cands, key=lambda c: -c["l"])
    for c in order:
        bucket = c["s"] // 30
        if len(kept) >= 5 or (duration > 600 and len(kept) >= 3 and any(abs(k["s"] // 30 - bucket) < 3 for k in kept)):
            continue
        if free(c) and c["q"] >= 8 and not (c["c"] < 42 and len(kept) >= 3):
            kept.append(c)
    for c in order:
        if len(kept) < 3 and free(c):
            kept.append(c)
    return [k["i"] for k in kept[:5]]


def test_quality_selection(spark):
    rnd = random.Random(9)
    for duration in (500.0, 3000.0):
        cands, picks = [], []
        for v in range(6):
            for i in range(1, 12):
                s = float(rnd.randint(0, int(duration) - 60))
                cands.append((v, i, s, s + rnd.randint(12, 45), float(1000 - i * 7 - v), float(rnd.randint(2, 20)), rnd.randint(20, 99), False))
            for rank, i in enumerate(rnd.sample(range(1, 12), 6)):
                c = next(c for c in cands if c[0] == v and c[1] == i)
                picks.append((v, i, c[2], c[3], c[5], c[6], rnd.random() < 0.3, rank))
        cdf = spark.createDataFrame(cands, "video_id long, list_index int, start_time double, end_time double, local_score double, text_score double, confidence int, montage boolean")
        pdf = spark.createDataFrame(picks, "video_id long, candidate_id int, start_time double, end_time double, quality double, confidence int, strong boolean, rank int")
        rows = sel.quality_selection(pdf, cdf, F.lit(duration)).collect()
        for v in range(6):
            mine = [dict(i=c[1], s=c[2], e=c[3], l=c[4], q=c[5], c=c[6]) for c in cands if c[0] == v]
            mp = [dict(i=p[1], s=p[2], e=p[3], q=p[4], c=p[5], strong=p[6]) for p in picks if p[0] == v]
            assert [r.list_index for r in sorted(rows, key=lambda r: r.place) if r.video_id == v] == pick_five(mp, mine, duration)


def test_names_cluster_in_order(spark):
    names = ["simple", "s1mple", "falcon", "simple", "falcom", "ab"]
    df = spark.createDataFrame([(1, float(i), n) for i, n in enumerate(names)], "video_id long, pos double, name string")
    rows = sorted((r.representative, r["count"], tuple(r.members)) for r in identity.name_clusters(df).collect())
    assert rows == [("falcon", 2, ("falcom", "falcon")), ("simple", 3, ("s1mple", "simple"))]


def feed(spark, lines):
    return spark.createDataFrame([(1, i, float(t), raw, 0.05) for i, (t, raw) in enumerate(lines)], "video_id long, seq long, time double, raw_ocr string, border_score double")


def test_feed_pipeline(spark):
    reads = identity.read_feed(feed(spark, [(40.0, "simple [x] falcon"), (39.5, "simple [x] falcon"), (38.0, "s1mple [x] falcon"), (60.0, "simple"), (80.0, "raven + helper -> tiger"), (90.0, "falcon simple"), (95.0, "x")]))
    assert reads.count() == 6
    anchored = identity.backward_anchors(reads, reads)
    assert {r.seq: r.anchor for r in anchored.collect()}[0] == 38.0
    entries = identity.registry(anchored)
    first = entries.filter("entry = 0").first()
    assert (first.killer, first.victim, first.anchor) == ("s1mple", "falcon", 38.0)
    pov = identity.pov_cluster(entries)
    assert pov.first().pov in ("simple", "s1mple")
    clusters = identity.name_clusters(entries.select("video_id", F.col("entry").cast("double").alias("pos"), F.col("killer").alias("name")))
    kinds = {r.entry: (r.kind, r.reason) for r in identity.classify_entries(entries, pov, clusters).collect()}
    assert kinds[0] == ("kill", "pov_killer_match")
    assert ("death", "pov_death") in kinds.values()


def talk(spark):
    texts = ["hello there my friends", "wait what is this?", "no way this is insane!", "that was so crazy", "we go on with the game now", "Wait until you see what happens next", "wow holy clutch!!", "thanks and see you"]
    rows = [(1, i, t, i * 6.0, i * 6.0 + 4.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "video_id long, seq int, text string, start double, end double")


def test_hook_prefers_late_reaction(spark):
    lines = hooks.hook_lines(talk(spark))
    clips = spark.createDataFrame([(1, 0, 0.0, 47.0, 13.0, "", "")], "video_id long, wid int, w_start double, w_end double, given_peak double, given_hook string, title string")
    row = hooks.analyse(lines, clips).first()
    assert (row.teaser_at, row.teaser_line) == (36.0, "wow holy clutch!!")
    # By hand: 0.55 x 37 + 3 + 8 + 5 + 6 = 42.35 against 0.55 x 29 + 14 + 5 = 34.95 for the question.
    assert row.tease == "no way this is insane!" and round(row.cliff_score, 2) == 42.35
    assert hooks.resolve(lines, clips).first().peak == 36.0


def test_hook_without_lines(spark):
    lines = hooks.hook_lines(talk(spark))
    clips = spark.createDataFrame([(7, 0, 100.0, 150.0)], "video_id long, wid int, w_start double, w_end double")
    row = hooks.analyse(lines, clips).first()
    assert (row.teaser_at, row.tease, row.teaser_sec) == (136.0, hooks.NO_LINES, 2.2)


def test_candidate_pool_is_spread_and_ranked(spark):
    rows = [(v, i, ("no way that was insane! " if i % 9 == 0 else "and then we walk on ") + str(i), i * 5.0, i * 5.0 + 4) for v in (1, 2) for i in range(60)]
    lines = w.scored_lines(spark.createDataFrame(rows, "video_id long, seq int, text string, start double, end double"))
    ends = spark.createDataFrame([(1, 300.0), (2, 300.0)], "video_id long, video_end double")
    got = pool_plan.candidate_pool(lines, ends).collect()
    for v in (1, 2):
        mine = sorted((r for r in got if r.video_id == v), key=lambda r: r.list_index)
        assert 3 <= len(mine) <= 12 and mine[0].confidence == 99 or mine[0].confidence <= 99
        assert [r.local_score for r in mine] == sorted((r.local_score for r in mine), reverse=True)
        for i, a in enumerate(mine):
            assert 12 <= a.end_time - a.start_time <= 45.1
            for b in mine[i + 1:]:
                assert abs(a.start_time - b.start_time) >= 20


def test_short_windows_do_not_use_up_the_anchor_limit(spark):
    """Forty strong lines at the very end make windows that are too short; the next anchors take their places."""
    rows = [(1, i, "no way that was insane! " + str(i) if i % 3 == 0 else "and then we walk on", i * 5.0, i * 5.0 + 4) for i in range(150)]
    rows += [(1, 200 + i, "no way that was insane oh my god!! " + str(i), 750 + i * 4.0, 753 + i * 4.0) for i in range(10)]
    lines = w.scored_lines(spark.createDataFrame(rows, "video_id long, seq int, text string, start double, end double"))
    ends = spark.createDataFrame([(1, 760.0)], "video_id long, video_end double")
    points = w.top_anchors(lines, ends, most=None)
    long_enough = lambda best: sorted(r.aid for r in best.filter("w_end - w_start >= 12").collect())[:28]
    some = w.worth_scoring(lines, points)
    assert long_enough(w.best_windows(lines, some)) == long_enough(w.best_windows(lines, points))
    assert 28 <= some.count() <= points.count()


def test_close_names_are_those_of_the_plain_ratio():
    rnd = random.Random(5)
    names = ["".join(rnd.choice("abcx1-") for _ in range(rnd.randint(0, 9))) for _ in range(120)] + ["simple", "s1mple", "p1mples"]
    for limit in (0.55, 0.62, 0.85):
        for a in names:
            for b in names:
                assert identity._close(a, b, limit) == (identity._ratio(a, b) >= limit)


def test_feed_lines_are_parsed_once_and_names_clustered_without_a_group_per_recording(spark):
    ocr = spark.createDataFrame([(v, v * 10 + i, float(40 + i), f"Simple{i % 2} [x] raven_{v}", 0.1) for v in range(40) for i in range(5)], "video_id long, seq long, time double, raw_ocr string, border_score double")
    reads = identity.read_feed(ocr)
    plan = reads._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    clusters = identity.name_clusters(reads.select("video_id", F.col("seq").cast("double").alias("pos"), F.col("killer").alias("name")))
    assert "FlatMapGroupsInPandas" not in clusters._jdf.queryExecution().toString()
    rows = clusters.collect()
    assert len(rows) == 40 and all(r["count"] == 5 and r["representative"] == "simple0" for r in rows)
