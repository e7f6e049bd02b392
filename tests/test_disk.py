"""What queries hold on disk and in memory on the way: each test builds its own rows."""
import datetime
import math
import random
import re
import time

from pyspark.sql import functions as F

from tideline.operators.ranges import overlap_join, reach_join
from tideline.plans import hooks, windows
from tideline.session import settle
from tideline.streaming import live

LINES = "video_id bigint, seq int, text string, start double, end double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def by_window(df):
    """The shuffles by window."""
    return [x for x in re.findall(r"Exchange hashpartitioning\((.*)", plan(df)) if "wid#" in x]


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (found.apply(i).getName() for i in range(found.size())) if f.startswith("shuffle_")}


def test_settled_rows_leave_no_shuffle_files(spark):
    """F1 to F4: what each step had shuffled stayed on disk, so that a query held the shuffles of all its steps."""
    before = shuffle_files(spark)
    step = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    kept = settle(step)
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert shuffle_files(spark) - before == set()
    assert kept.agg(F.sum("n")).first()[0] == 1000 == step.agg(F.sum("n")).first()[0]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_pairs_stay_where_windows_were_dealt(spark):
    """pairs of windows and lines were shuffled once more to be measured, and the measures again to be joined with their windows."""
    rnd = random.Random(4)
    lines = [(v, i, rnd.choice(["wow that was insane!", "and on we go", "why?"]), t, t + rnd.choice([0.5, 3.0, 200.0])) for v in (1, 2) for i, t in enumerate(sorted(rnd.uniform(0, 400) for _ in range(60)))]
    spans = sorted({(v, round(s, 1), round(s + rnd.uniform(0.0, 45.0), 1)) for v in (1, 2, 3) for s in (rnd.uniform(-10, 900) for _ in range(80))})
    rows = windows.scored_lines(spark.createDataFrame(lines, LINES))
    spans = spark.createDataFrame([(*s, i) for i, s in enumerate(spans)], "video_id bigint, w_start double, w_end double, wid int")
    rows = settle(rows)
    plain, tiled = windows.window_metrics(rows, spans), windows.window_metrics(rows, windows.in_tiles(spans))
    want, got = ({r["wid"]: r for r in x.collect()} for x in (plain, tiled))
    assert set(got) == {s["wid"] for s in spans.collect()} > set(want)
    assert all(got[w] == want[w] if w in want else got[w]["n_lines"] is None for w in got)
    assert by_window(plain) and not by_window(tiled)
    slim = rows.select("video_id", "seq", "start", "end")
    met = overlap_join(slim, spans, ["video_id"], (F.col("start"), F.col("end")), (F.col("w_start"), F.col("w_end")))
    near = reach_join(windows.in_tiles(spans), slim, ["video_id"], (F.col("w_start"), F.col("w_end")), (F.col("start"), F.col("end")), windows.REACH_TILE, windows.REACH)
    pairs = lambda df: sorted(tuple(r) for r in df.filter("seq is not null").select("wid", "seq").collect())
    assert pairs(met) == pairs(near)


def test_scores_are_found_before_lines_are_put_in_order(spark):
    """texts were shuffled to put lines in order, also where only their scores are read."""
    lines = spark.createDataFrame([(1, i, t, i * 3.0, i * 3.0 + 2) for i, t in enumerate(["wow that was insane!", " ", "um", "and on"])], LINES)
    scored = windows.scored_lines(lines.repartition(2))
    assert [r["seq"] for r in scored.orderBy("seq").collect()] == [0, 2, 3] and scored.filter("seq = 2").first()["score"] == -5.0
    first = plan(scored.select("video_id", "score"))
    assert first.index("hashpartitioning") < first.index("lower(")


def test_baselines_keep_values_not_windows(spark, tmp_path):
    """state held a row for each window that a value lies in, ten times the values and more."""
    rnd = random.Random(9)
    at = lambda s: datetime.datetime.fromtimestamp(s, datetime.timezone.utc)
    rows = [(rnd.choice([1, 2, 3, None]), at(1000 + i / 4 + rnd.uniform(0, 20)), rnd.choice([None, float("nan"), *range(12)])) for i in range(600)]
    rows = [(v, t, None if x is None else float(x)) for v, t, x in rows] + [(4, None, 1.0), (5, at(1400.0), 1.0)]
    schema = "video_id long, ts timestamp, value double"
    plain = lambda x: None if x is None else "nan" if math.isnan(x) else round(x, 9)
    want = {}
    for v in (1, 2, 3, None, 5):
        for s in range(900, 1310, 5):  # windows of 60 s that end before the mark, 1400 - 30
            held = [x for w, t, x in rows if w == v and t is not None and s <= t.timestamp() < s + 60]
            known = [x for x in held if x is not None]
            if held:
                want[v, s + 30] = plain(sum(known) / len(known)) if known else None
    for cuts in (1, 3):
        folder = tmp_path / str(cuts)
        size = -(-len(rows) // cuts)
        for i in range(cuts):
            spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{folder}/src")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/src")
        query = live.baseline(stream, 30, "5 seconds").writeStream.format("memory").queryName(f"means_{cuts}").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        got = {(r["video_id"], r["centre"].timestamp()): plain(r["base"]) for r in spark.table(f"means_{cuts}").collect()}
        assert got == want
        assert max(o.numRowsTotal for p in query.recentProgress for o in p.stateOperators) <= 5


def test_texts_of_lines_move_only_where_they_are_read(spark, monkeypatch):
    """words were counted for phrases after the lines, with their texts, had been put in order, and lines met their teasers by a second join."""
    seen = []
    whole = hooks.scan_sessions
    monkeypatch.setattr(hooks, "scan_sessions", lambda df, *rest: (seen.append(plan(df)), whole(df, *rest))[1])
    texts = ("and then we walk on", "no way that was", "um", "insane my friends", "why did you do that to me?", "the end is near")
    lines = hooks.hook_lines(spark.createDataFrame([(1, i, t, i * 4.0, i * 4.0 + 3.5) for i, t in enumerate(texts)], LINES).repartition(2))
    clips = spark.createDataFrame([(1, 0, 0.0, 28.0), (1, 1, 500.0, 528.0)], "video_id long, wid int, w_start double, w_end double")
    got = hooks.phrases(settle(lines), clips).collect()
    assert sorted((r["wid"], r["seq"], r["text"]) for r in got) == [(0, 0, "and then we walk on no way that was insane my friends why did"), (0, 5, "the end is near")]
    assert seen[0].index("hashpartitioning") < seen[0].index("replace(")
    teasers = clips.withColumn("teaser_at", F.lit(13.0))
    before = hooks.earlier_line(lines, teasers)
    assert before.first()["before_text"] == "um" and before.count() == 1
    joined = before._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count("Join Inner") == 1
