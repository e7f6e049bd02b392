"""Files in, files out, and streams against batch."""
import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from tideline import views
from tideline.plans import kills as k
from tideline.sources import captions, records, sinks
from tideline.streaming import live

SF = "/root/testdata/sf0.001"


def test_caption_files_by_suffix(spark, tmp_path):
    (tmp_path / "a.de.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\none\n\n00:02.100 --> 00:03.000\ntwo\n")
    (tmp_path / "b.en.json3").write_text(json.dumps({"events": [{"tStartMs": 1000, "segs": [{"utf8": "hel"}, {"utf8": "lo"}]}, {"tStartMs": 9000, "dDurationMs": 10, "segs": [{"utf8": "x"}]}, {"tStartMs": 1}]}))
    (tmp_path / "c.en.json3").write_text("not json")
    rows = sorted((r.video_id, r.text, r.start, r.duration) for r in captions.read_captions(spark, str(tmp_path)).collect())
    assert rows == [("a", "one two", 1.0, 2.0), ("b", "hello", 1.0, 1.5), ("b", "x", 9.0, 0.05)]


def test_job_documents(spark, tmp_path):
    for name, text in {"j1": json.dumps({"jobId": "j1", "status": "completed", "contentGame": "cs2", "highlights": [{"id": "h", "montageKills": [1, 2]}]}), "_previews": json.dumps({"jobId": "no"}), "j2": "{broken"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "meta.json").write_text(text)
    rows = records.jobs_from_documents(records.job_documents(spark, str(tmp_path))).collect()
    assert [(r.job_id, r.category, r.highlights, r.kills, r.has_montage) for r in rows] == [("j1", "cs2", 1, 2, True)]


def test_project_table_reads_only_arrays(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps([{"id": "a", "saved": True}, {"id": "b", "expiresAt": 5}]))
    bad.write_text("\"text\"")
    assert sorted((r.id, r.saved) for r in records.project_table(spark, str(good)).collect()) == [("a", True), ("b", False)]
    assert records.project_table(spark, str(bad)).count() == 0


def test_picks_and_quarantine(spark):
    df = spark.createDataFrame([(1, 'ok ```json\n[{"candidate_id": "#2", "title": "t"}]\n```'), (2, "none"), (3, "[broken")], "video_id long, content string")
    picks, rest = records.pick_rows(df)
    assert [(r.video_id, r.candidate_id) for r in picks.collect()] == [(1, "#2")]
    assert sorted(r.video_id for r in rest.collect()) == [2, 3]


def test_ocr_log_and_report_history(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"idx": 1, "time_s": 2.5, "raw_ocr": "a b", "status": "accepted"}\n{"idx": 2, "status": "rejected"}\n')
    assert records.ocr_log(spark, str(tmp_path / "log.jsonl")).filter("status = 'accepted'").first().time_s == 2.5
    folder = tmp_path / "reports"
    folder.mkdir()
    for m in range(1, 15):
        (folder / f"2025-{m:02d}.json").write_text(json.dumps({"month": f"2025-{m:02d}", "totalJobs": m}))
    (folder / "latest.txt").write_text("x")
    got = [r.month for r in records.report_history(spark, str(folder)).collect()]
    assert len(got) == 12 and got[0] == "2025-14" and got[-1] == "2025-03"


def test_job_document_runs_replace_only_their_recordings(spark, tmp_path):
    path, ddl = str(tmp_path / "docs"), "video_id long, kills long"
    schema = spark.createDataFrame([], ddl).schema
    assert sinks.read_job_documents(spark, path, schema).count() == 0
    sinks.write_job_documents(spark.createDataFrame([(v, 1) for v in range(500)] + [(None, 1), (7, 2)], ddl).repartition(2), path)
    sinks.write_job_documents(spark.createDataFrame([(3, 5), (None, 6)], ddl), path)
    (tmp_path / "docs" / "run=00000009").mkdir()
    (tmp_path / "docs" / "run=00000009" / "part-0.json").write_text('{"video_id": 1, "kills": 99}\n')
    rows = [(r.video_id, r.kills) for r in sinks.read_job_documents(spark, path, schema).collect()]
    assert len(rows) == 502 and {r for r in rows if r[1] != 1} == {(3, 5), (None, 6), (7, 2)} and rows.count((3, 1)) == 0 and (1, 1) in rows
    assert len(list((tmp_path / "docs").rglob("*.json"))) < 20
    assert sinks.write_job_documents(spark.createDataFrame([(1, 8)], ddl), path).endswith("run=00000010")


def test_report_sink_replaces_only_its_month(spark, tmp_path):
    path = str(tmp_path / "report")
    make = lambda rows: spark.createDataFrame(rows, "month string, total long")
    sinks.write_report(make([("2025-01", 1), ("2025-02", 2)]), path)
    sinks.write_report(make([("2025-02", 9)]), path)
    sinks.write_report(make([("2025-03", 9)]), path, dry_run=True)
    assert sorted((r.month, r.total) for r in spark.read.json(path).select(F.col("month").cast("string"), "total").collect()) == [("2025-01", 1), ("2025-02", 9)]


def test_project_sink_and_text_report(spark, tmp_path):
    rows = spark.range(250).select(F.col("id").cast("string").alias("id"), F.col("id").alias("created_at"))
    target = sinks.write_projects(rows, str(tmp_path / "p"), "1")
    assert spark.read.json(target).count() == 200
    lines = spark.createDataFrame([("2025-01", 0, i, f"line {i:02d}") for i in range(12)], "month string, part int, pos int, line string")
    sinks.write_text_report(lines, str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == [f"line {i:02d}" for i in range(12)]


def test_versions_are_written_once_and_broken_ones_again(spark, tmp_path):
    rows, path = spark.range(5), str(tmp_path / "v")
    assert sinks.latest_version(spark, path) is None
    first = sinks.write_version(rows, path, "1")
    sinks.write_version(spark.range(9), path, "1")
    assert spark.read.json(first).count() == 5
    broken = sinks.write_version(spark.range(3), path, "2")
    (tmp_path / "v" / "version=2" / "_SUCCESS").unlink()
    assert sinks.latest_version(spark, path) == first
    assert sinks.write_version(rows, path, "2") == broken == sinks.latest_version(spark, path)
    assert spark.read.json(broken).count() == 5


def _stream(spark, tmp_path, df):
    src = str(tmp_path / "in")
    df.write.parquet(src)
    return spark.readStream.schema(df.schema).parquet(src)


def test_stream_packs_equal_batch(spark, tmp_path):
    batch = views.kill_events(spark, SF).select("video_id", "seq", F.col("time").alias("t"), F.timestamp_millis((F.col("time") * 1000).cast("bigint")).alias("ts"))
    late = batch.groupBy("video_id").agg(F.lit(10**6).cast("long").alias("seq")).select("video_id", "seq", F.lit(9000.0).alias("t"), F.timestamp_millis(F.lit(9_000_000)).alias("ts"))
    rows = live.run_to_table(live.burst_packs(_stream(spark, tmp_path, batch.unionByName(late).coalesce(1))), str(tmp_path / "out"))
    got = sorted((r.video_id, round(r.pack_at, 6), r.kills) for r in rows.collect() if r.pack_at < 9000)
    packs = k.burst_packs(views.kill_events(spark, SF)).groupBy("video_id", "pack_at").count()
    assert got == sorted((r.video_id, round(r.pack_at, 6), r["count"]) for r in packs.collect())


def test_stream_dedupe_keeps_first_within_delay(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0), (1, "a", 3), (1, "b", 4)], "video_id long, key string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert live.run_to_table(live.dedupe_detections(_stream(spark, tmp_path, df.coalesce(1))), str(tmp_path / "out")).count() == 2


def test_stream_words_meet_clips(spark, tmp_path):
    words = spark.createDataFrame([(1, 5, "in"), (1, 50, "out")], "video_id long, s int, text string").withColumn("word_ts", F.timestamp_seconds(F.col("s") + views.EPOCH_2024)).drop("s")
    clips = spark.createDataFrame([(1, "c", 0, 20)], "video_id long, clip_id string, a int, b int").select("video_id", "clip_id", F.timestamp_seconds(F.col("a") + views.EPOCH_2024).alias("clip_start"), F.timestamp_seconds(F.col("b") + views.EPOCH_2024).alias("clip_end"))
    (tmp_path / "w").mkdir(), (tmp_path / "c").mkdir()
    out = live.words_in_clips(_stream(spark, tmp_path / "w", words), _stream(spark, tmp_path / "c", clips))
    assert [r.text for r in live.run_to_table(out, str(tmp_path / "out")).collect()] == ["in"]


def test_stream_baseline_matches_window(spark, tmp_path):
    df = spark.range(200).select(F.lit(1).cast("long").alias("video_id"), F.timestamp_millis(F.col("id") * 500).alias("ts"), (F.col("id") % 7).cast("double").alias("value"))
    rows = live.run_to_table(live.baseline(_stream(spark, tmp_path, df.coalesce(1))), str(tmp_path / "out")).collect()
    at = {r.centre.timestamp(): r.base for r in rows}
    want = sum(i % 7 for i in range(200) if 0 <= i * 0.5 - 10.0 + 30 < 60) / sum(1 for i in range(200) if 0 <= i * 0.5 - 10.0 + 30 < 60)
    assert abs(at[10.0] - want) < 1e-9


def _in_batches(spark, folder, rows, schema, cuts):
    """A stream that reads ``rows`` in ``cuts`` micro-batches, in the order given."""
    size = -(-len(rows) // cuts)
    for i in range(cuts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(folder / "src"))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "src"))


@pytest.mark.parametrize("cuts", [1, 6])
def test_packs_do_not_depend_on_batches_or_order(spark, tmp_path, cuts):
    rnd = random.Random(5)
    times = sorted(round(rnd.uniform(0, 900), 1) for _ in range(80)) + [9000.0]
    arriving = sorted(((t + (rnd.uniform(0, 8) if t < 9000 else 0), i, t) for i, t in enumerate(times)))  # up to eight seconds late
    rows = [(1, i, t, datetime.datetime.fromtimestamp(t, datetime.timezone.utc)) for _, i, t in arriving]
    stream = _in_batches(spark, tmp_path, rows, "video_id long, seq long, t double, ts timestamp", cuts)
    got = sorted((r.pack_at, r.kills) for r in live.run_to_table(live.burst_packs(stream), str(tmp_path / "out")).collect())
    packs = []
    for t in times[:-1]:
        if packs and t - packs[-1][-1] <= 22 and t - packs[-1][0] <= 55 and len(packs[-1]) < 4:
            packs[-1].append(t)
        else:
            packs.append([t])
    assert got == [(p[0], len(p)) for p in packs]


@pytest.mark.parametrize("cuts", [1, 4])
def test_supersession_does_not_depend_on_batches(spark, tmp_path, cuts):
    rnd = random.Random(6)
    rows = [(k, g) for k in range(3) for g in range(7)]
    rnd.shuffle(rows)
    stream = _in_batches(spark, tmp_path, rows, "key long, generation long", cuts)
    out = live.run_to_table(live.with_supersession(stream), str(tmp_path / "out")).groupBy("key", "generation").agg(F.max("superseded").alias("s")).collect()
    assert {(r.key, r.generation): r.s for r in out} == {(k, g): g < 6 for k, g in rows}


def _files(spark, folder, rows, schema, cuts):
    """``rows`` as files that a stream reads one by one; the second half is to be added between two runs."""
    size = -(-len(rows) // cuts)
    return [lambda i=i: spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(folder / "src")) for i in range(cuts)]


def _twice(spark, folder, rows, schema, cuts, make):
    """All rows that ``make(stream)`` gives when it is stopped and started again half way."""
    files = _files(spark, folder, rows, schema, cuts)
    read = lambda: spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "src"))
    for part in (files[:cuts // 2 + 1], files[cuts // 2 + 1:]):
        for write in part:
            write()
        out = live.run_to_table(make(read()), str(folder / "out"))
    return out.collect()


def _utc(t):
    return datetime.datetime.fromtimestamp(t, datetime.timezone.utc)


@pytest.mark.parametrize("cuts", [1, 5])
def test_strongest_reading_wins_whatever_the_batches(spark, tmp_path, cuts):
    rnd = random.Random(8)
    made = [(1, rnd.choice("ab"), round(rnd.uniform(0, 60), 1), i, float(rnd.randint(1, 5))) for i in range(60)] + [(2, "z", 300.0, 99, 1.0)]
    rows = [(v, k_, _utc(1000 + t), q, x) for v, k_, t, q, x in sorted(made, key=lambda r: r[2] + (rnd.uniform(0, 8) if r[0] == 1 else 0))]
    got = _twice(spark, tmp_path, rows, "video_id long, key string, ts timestamp, seq long, strength double", cuts, live.strongest)
    want = set()
    for name in "ab":
        own = sorted((t, q, x) for v, k_, t, q, x in made if v == 1 and k_ == name)
        first = own[0][0]
        near = [r for r in own if round((r[0] - first) * 10) <= 70]
        best = min(near, key=lambda r: (-r[2], r[0], r[1]))
        want.add((1, name, round((1000 + first) * 1000), best[1], best[2], len(near)))
        for t in {r[0] for r in own[len(near):]}:
            last = max((r for r in own if r[0] == t), key=lambda r: r[1])
            want.add((1, name, round((1000 + t) * 1000), last[1], last[2], sum(r[0] == t for r in own)))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_strongest_keys_share_calls(spark, tmp_path):
    """Every key was a call of its own; keys dealt to one call stay apart, null ones and large ids included."""
    ids = [None, 0, 2**60 + 1, 2**60 + 2]
    rows = [(v, k_, _utc(1000 + t), q, x) for v in ids for k_ in ("a", None) for t, q, x in ((0.0, 1, 1.0), (3.0, 2, 5.0), (20.0, 3, 2.0))] + [(9, "z", _utc(9000), 99, 1.0)]
    schema = "video_id long, key string, ts timestamp, seq long, strength double"
    got = _twice(spark, tmp_path, rows, schema, 2, lambda s: live.strongest(s, groups=1))
    want = {(v, k_, *r) for v in ids for k_ in ("a", None) for r in ((1_000_000, 2, 5.0, 2), (1_020_000, 3, 2.0, 1))}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("cuts", [1, 5])
def test_expiry_sweeps_whatever_the_batches(spark, tmp_path, cuts):
    rnd = random.Random(9)
    made = [(i % 4, round(rnd.uniform(0, 20_000)), i, rnd.random() < 0.2, rnd.choice([None, 300, 900])) for i in range(50)] + [(9, 90_000, 99, True, None)]
    rows = [(p, _utc(t), q, saved, None if life is None else (t + life) * 1000) for p, t, q, saved, life in sorted(made, key=lambda r: r[1] + (rnd.uniform(0, 500) if r[0] < 9 else 0))]
    got = _twice(spark, tmp_path, rows, "id long, ts timestamp, seq long, saved boolean, expires_ms long", cuts, lambda s: live.expiries(s, 600.0, "10 minutes"))
    want = set()
    for p in range(4):
        own = sorted((t, q, saved, life) for i, t, q, saved, life in made if i == p)
        for (t, q, saved, life), nxt in zip(own, [*own[1:], (10**9,)]):
            due = None if saved or life is None else -(-(t + life) // 600) * 600
            if due is not None and due < nxt[0]:
                want.add((p, q, due * 1000))
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 5
