"""Live forms of the event and job analyses."""
from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Lateness we accept: seconds for detections, the look-ahead for baselines.
DETECTION_DELAY, BASELINE_DELAY = "10 seconds", "30 seconds"
# Calls into which the keys of a stream are dealt by hash where each key has little to do.
KEY_GROUPS = 4096
# Values of a call that are held before they are summed up.
STATE_ROWS = 1 << 20


def dedupe_detections(events: DataFrame, delay: str = DETECTION_DELAY) -> DataFrame:
    """First detection of each kill key; repeats within the watermark delay drop out and state expires with it."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["video_id", "key"])


def dedupe_requests(requests: DataFrame, delay: str = "10 minutes") -> DataFrame:
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["hash"])


def sessions(events: DataFrame, gap: str, delay: str = DETECTION_DELAY) -> DataFrame:
    """Gap sessions per recording with count and span."""
    win = F.session_window("ts", gap)
    return events.withWatermark("ts", delay).groupBy(win.alias("w"), "video_id").agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def tumbling(values: DataFrame, width: str, delay: str = DETECTION_DELAY, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """Bucketed count, sum and maximum of ``value``: loudness buckets, anchors and coarse samples differ in width only."""
    return values.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("highest")).select(
        *keys, F.col("w.start").alias("bucket"), "n", "total", "highest")


def baseline(values: DataFrame, reach_sec: int = 30, step: str = "500 milliseconds", delay: str = BASELINE_DELAY, groups: int = KEY_GROUPS) -> DataFrame:
    """Mean around each half second from a sliding window; a row leaves once the look-ahead has passed.

    State is a sum and a count per recording and ``step``, packed for all recordings of a group: a row of state for each window that a value
    lies in would be ``2 * reach_sec / step`` times as many. Recordings share ``groups`` calls by hash, each is judged on its own. Windows in
    a row with the same values are sent as one and listed outside. A value that comes after its delay counts in windows not yet sent."""
    micros = lambda text: pd.Timedelta(text) // pd.Timedelta(microseconds=1)
    width, slide = 2 * reach_sec * 1_000_000, micros(step)
    unit = math.gcd(width, slide)
    hop, reach = slide // unit, width // unit
    names, kinds = ("video_id", "unit", "total", "n"), (np.int64, np.int64, np.float64, np.int64)
    out = "video_id bigint, first bigint, last bigint, total double, n bigint"

    def fold(parts: list) -> list:
        columns = [np.concatenate(c) for c in zip(*parts)]
        order = np.lexsort((columns[1], columns[0]))
        ids, units, totals, ns = (c[order] for c in columns)
        at = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (units[1:] != units[:-1])][:len(ids)])
        return [ids[at], units[at], np.add.reduceat(totals, at), np.add.reduceat(ns, at)] if len(at) else [ids, units, totals, ns]

    def windows(units: np.ndarray, totals: np.ndarray, ns: np.ndarray, sent: int, upto: int) -> tuple:
        """Runs of windows after ``sent`` up to ``upto`` that hold the same values, of one recording: first and last number, sum, count."""
        edges = np.unique(np.r_[(units - reach) // hop + 1, units // hop + 1])
        low, high = np.searchsorted(units, edges[:-1] * hop), np.searchsorted(units, edges[:-1] * hop + reach)
        first, last = np.maximum(edges[:-1], sent + 1), np.minimum(edges[1:] - 1, upto)
        some = np.flatnonzero((high > low) & (last >= first))
        spans = np.c_[low[some], high[some]].ravel()
        both = [np.add.reduceat(np.r_[x, x[:1] * 0], spans)[::2] if len(spans) else x[:0] for x in (totals, ns)]
        return first[some], last[some], *both

    def judge(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        upto = (state.getCurrentWatermarkMs() * 1000 - width) // slide
        *held, sent = state.get if state.exists else (*[zlib.compress(b"")] * 4, upto)
        parts = [[np.frombuffer(zlib.decompress(c), k) for c, k in zip(held, kinds)]]
        if not state.hasTimedOut:
            for p in batches:
                parts.append([p[c].to_numpy(k) for c, k in zip(names, kinds)])
                if sum(len(x[0]) for x in parts[1:]) > STATE_ROWS:
                    parts = [fold(parts)]
        ids, units, totals, ns = fold(parts)
        found = []
        if upto > sent:
            ends = np.r_[np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids)]
            for a, b in zip(np.r_[0, ends[:-1]], ends) if len(ids) else ():
                rows = windows(units[a:b], totals[a:b], ns[a:b], sent, upto)
                found.append((np.full(len(rows[0]), ids[a]), *rows))
        left = units // hop > upto
        if left.any():
            state.update((*[zlib.compress(c[left].tobytes(), 1) for c in (ids, units, totals, ns)], int(max(sent, upto))))
            after = max(upto + 1, int(((units[left] - reach) // hop + 1).min()))
            _wait(state, [-(-(after * slide + width) // 1000)])
        elif state.exists:
            state.remove()
        if found:
            rows = pd.DataFrame(dict(zip(("video_id", "first", "last", "total", "n"), (np.concatenate(c) for c in zip(*found)))))
            yield rows if group[0] < groups else rows.assign(video_id=pd.Series([None] * len(rows), dtype="object"))

    # The mark is that of the end of the last window, so a row is late once all its windows are closed.
    due = values.filter("ts is not null").withColumn("_due", F.timestamp_micros(F.unix_micros("ts") + width)).withWatermark("_due", f"{micros(delay) + width} microseconds")
    at = F.unix_micros("ts")
    rows = due.select(
        F.when(F.col("video_id").isNull(), groups).otherwise(F.pmod(F.hash("video_id"), F.lit(groups))).alias("group"), F.coalesce("video_id", F.lit(0).cast("bigint")).alias("video_id"), "_due",
        F.round((at - F.pmod(at, F.lit(unit))) / F.lit(unit)).cast("bigint").alias("unit"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("total"), F.col("value").isNotNull().cast("bigint").alias("n"))
    held = "ids binary, units binary, totals binary, ns binary, sent bigint"
    runs = rows.groupBy("group").applyInPandasWithState(judge, out, held, "append", GroupStateTimeout.EventTimeTimeout)
    mean = F.when(F.col("n") > 0, F.coalesce("total", F.lit(float("nan"))) / F.col("n"))
    return runs.select("video_id", F.explode(F.sequence("first", "last")).alias("_at"), mean.alias("base")).select(
        "video_id", F.timestamp_micros(F.col("_at") * slide + reach_sec * 1_000_000).alias("centre"), "base")


def job_state(updates: DataFrame) -> DataFrame:
    """Latest state per job; run in update mode."""
    last = F.max_by(F.struct("status", "step", "progress", "message"), F.struct("ts", "seq"))
    status = F.when(F.col("s.step") == "error", "error").when(F.col("s.step") == "ready", "completed").otherwise("running")
    return updates.groupBy("job_id").agg(last.alias("s"), F.max("ts").alias("updated_at"), F.max(F.struct("ts", "seq")).alias("_v")).select(
        "job_id", status.alias("status"), "s.step", F.when(F.col("s.step") == "ready", 100).otherwise(F.col("s.progress")).alias("progress"), "s.message", "updated_at")


def with_supersession(requests: DataFrame) -> DataFrame:
    """Mark requests that a newer generation of the same key has replaced; state is the newest generation per key.

    A row that was sent as current is sent again as superseded when a newer one comes, so the latest word on a request,
    ``max(superseded)``, does not depend on how the input is cut into batches."""
    schema = "key bigint, generation bigint, superseded boolean"

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else None
        seen = [int(g) for p in batches for g in p["generation"]]
        newest = max([*seen, *([before] if before is not None else [])])
        state.update((newest,))
        again = [before] if before is not None and before < newest else []
        yield pd.DataFrame({"key": [key[0]] * (len(seen) + len(again)), "generation": seen + again, "superseded": [g < newest for g in seen + again]})

    return requests.groupBy("key").applyInPandasWithState(judge, schema, "newest bigint", "append", GroupStateTimeout.NoTimeout)


def burst_packs(events: DataFrame, gap: float = 22.0, span: float = 55.0, most: int = 4, delay: str = DETECTION_DELAY) -> DataFrame:
    """Packs limited by gap, span and count. Events carry ``t``, the seconds of ``ts``.

    State per recording is the open pack and the events that the watermark has not passed: those may still be preceded by
    late ones, so they are packed in order of time once it has. A pack is sent when the next event starts a new one or the
    watermark passes its gap."""
    out = "video_id bigint, pack_at double, kills int, last_at double"

    def pack(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n, waiting = state.get if state.exists else (0.0, 0.0, 0, [])
        waiting = sorted([*waiting, *(float(t) for p in batches for t in p["t"])] if not state.hasTimedOut else waiting)
        passed = state.getCurrentWatermarkMs() / 1000
        closed = []
        for t in [t for t in waiting if t <= passed]:
            if n and t - last <= gap and t - first <= span and n < most:
                last, n = t, n + 1
            else:
                if n:
                    closed.append((first, last, n))
                first, last, n = t, t, 1
        waiting = [t for t in waiting if t > passed]
        if n and passed > last + gap:
            closed.append((first, last, n))
            n = 0
        if n or waiting:
            state.update((first, last, n, waiting))
            due = min([*([last + gap] if n else []), *waiting[:1]])
            state.setTimeoutTimestamp(max(int(due * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"video_id": [key[0]] * len(closed), "pack_at": [c[0] for c in closed], "kills": [c[2] for c in closed], "last_at": [c[1] for c in closed]})

    return events.withWatermark("ts", delay).groupBy("video_id").applyInPandasWithState(pack, out, "first double, last double, n int, waiting array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def _wait(state: GroupState, times: list[int]) -> None:
    """Wake up once the watermark reaches the first of ``times``."""
    state.setTimeoutTimestamp(max(min(times) - 1, state.getCurrentWatermarkMs() + 1))


def strongest(readings: DataFrame, within: float = 7.0, keep: float = 86400.0, delay: str = DETECTION_DELAY, groups: int = KEY_GROUPS) -> DataFrame:
    """Kills from repeated readings ``(video_id, key, ts, seq, strength)``: of those within ``within`` seconds of a key's first
    reading the strongest, with the first one's time; each later moment of the key is a kill of its own.

    State per key is the first reading, the strongest so far and what the watermark has not passed; it goes ``keep`` seconds after
    the first one, and the key starts anew. Ties go to the earlier reading; of later readings of one moment the last one counts.
    A call from Spark costs far more than a reading, so keys share ``groups`` calls by hash; each is still judged on its own."""
    out = "video_id bigint, key string, anchor_ms bigint, seq bigint, strength double, readings int"
    held = ("ids array<bigint>, keys array<string>, firsts array<bigint>, bests array<double>, best_seqs array<bigint>, ns array<int>, opens array<boolean>, "
            "owners array<int>, times array<bigint>, strengths array<double>, seqs array<bigint>")
    reach, life = int(within * 1000), int(keep * 1000)

    def judge_key(mark: tuple, rows: list, passed: int) -> tuple[tuple, list, list]:
        first, best, best_seq, n, open_ = mark
        rows.sort(key=lambda r: (r[0], r[2]))
        kills, later = [], {}

        def close(upto: int) -> None:
            nonlocal first, open_
            if open_ and first + reach <= upto:
                kills.append((first, best_seq, best, n))
                open_ = False
            if first >= 0 and first + life <= upto:
                first = -1

        for t, x, q in [r for r in rows if r[0] <= passed]:
            close(t - 1)
            if first < 0:
                first, best, best_seq, n, open_ = t, x, q, 1, True
            elif t - first <= reach:
                n += 1
                if x > best:
                    best, best_seq = x, q
            else:
                later[t] = (t, q, x, later[t][3] + 1 if t in later else 1)
        close(passed)
        return (first, best, best_seq, n, open_), [r for r in rows if r[0] > passed], [*kills, *later.values()]

    def judge(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        marks, waiting = {}, {}
        if state.exists:
            ids, keys, *fields, owners, times, strengths, seqs = state.get
            names = list(zip(ids, keys))
            marks = dict(zip(names, zip(*fields)))
            for at, *row in zip(owners, times, strengths, seqs):
                waiting.setdefault(names[at], []).append(tuple(row))
        if not state.hasTimedOut:
            for p in batches:
                for no_id, i, k, t, x, q in zip(p["no_id"], p["video_id"], p["key"], p["ms"], p["strength"], p["seq"]):
                    waiting.setdefault((None if no_id else int(i), k), []).append((int(t), float(x), int(q)))
        passed, kills, left, due = state.getCurrentWatermarkMs(), [], [], []
        for name in marks.keys() | waiting.keys():
            mark, rows, found = judge_key(marks.get(name, (-1, 0.0, 0, 0, False)), waiting.get(name, []), passed)
            kills += [(*name, *k) for k in found]
            if mark[0] >= 0 or rows:
                left.append((name, mark, rows))
                due += [*([rows[0][0]] if rows else []), *([mark[0] + reach] if mark[4] else []), *([mark[0] + life] if mark[0] >= 0 else [])]
        if left:
            owned = [(at, *r) for at, (_, _, rows) in enumerate(left) for r in rows]
            state.update((*(list(c) for c in zip(*((*name, *mark) for name, mark, _ in left))), *((list(c) for c in zip(*owned)) if owned else ([], [], [], []))))
            _wait(state, due)
        elif state.exists:
            state.remove()
        if not kills:
            return
        columns = zip(("video_id", "key", "anchor_ms", "seq", "strength", "readings"), zip(*kills))
        yield pd.DataFrame({name: pd.Series(values, dtype="object") if name in ("video_id", "key") else list(values) for name, values in columns})

    rows = readings.withWatermark("ts", delay).select(
        F.pmod(F.hash("video_id", "key"), F.lit(groups)).alias("group"), F.col("video_id").isNull().alias("no_id"), F.coalesce("video_id", F.lit(0).cast("bigint")).alias("video_id"), "key", "ts",
        F.unix_millis("ts").alias("ms"), "seq", "strength")
    return rows.groupBy("group").applyInPandasWithState(judge, out, held, "append", GroupStateTimeout.EventTimeTimeout)


def expiries(updates: DataFrame, sweep: float = 600.0, delay: str = "10 minutes") -> DataFrame:
    """What a sweep every ``sweep`` seconds removes, from updates ``(id, ts, seq, saved, expires_ms)`` of projects.

    A project goes with the first sweep at or after its expiry, unless an update has come by then: the newest update alone decides,
    and saved ones don't expire. State per project is the next sweep that would remove it and the updates that the watermark has not
    passed; a timer fires where nothing else arrives."""
    out = "id bigint, seq bigint, swept_ms bigint"
    step = int(sweep * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        due, due_seq, *waiting = state.get if state.exists else (-1, 0, [], [], [])
        rows = list(zip(*waiting))
        if not state.hasTimedOut:
            rows += [(int(t), int(q), -1 if saved or pd.isna(e) else -(-int(e) // step) * step) for p in batches for t, q, saved, e in zip(p["ms"], p["seq"], p["saved"], p["expires_ms"])]
        rows.sort()
        passed, swept = state.getCurrentWatermarkMs(), []
        for t, q, then in [r for r in rows if r[0] <= passed]:
            if 0 <= due < t:
                swept.append((due_seq, due))
            due, due_seq = then, q
        if 0 <= due <= passed:
            swept.append((due_seq, due))
            due = -1
        rows = [r for r in rows if r[0] > passed]
        if due >= 0 or rows:
            state.update((due, due_seq, *([list(c) for c in zip(*rows)] if rows else ([], [], []))))
            _wait(state, [*[r[0] for r in rows[:1]], *([due] if due >= 0 else [])])
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], *x) for x in swept], columns=["id", "seq", "swept_ms"])

    rows = updates.withWatermark("ts", delay).select("id", "ts", F.unix_millis("ts").alias("ms"), "seq", "saved", F.col("expires_ms").cast("double").alias("expires_ms"))
    return rows.groupBy("id").applyInPandasWithState(run, out, "due bigint, due_seq bigint, times array<bigint>, seqs array<bigint>, dues array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def words_in_clips(words: DataFrame, clips: DataFrame, late: str = "1 hour") -> DataFrame:
    """Words joined to the clip windows they fall into, whichever arrives first; both sides expire."""
    w = words.withWatermark("word_ts", late).alias("w")
    c = clips.withWatermark("clip_start", late).alias("c")
    on = F.expr("w.video_id = c.video_id and word_ts >= clip_start and word_ts <= clip_end and word_ts <= clip_start + interval 1 hour")
    return w.join(c, on, "inner").select("w.video_id", "clip_id", "word_ts", "text")


def with_counters(events: DataFrame, name: str = "funnel") -> DataFrame:
    """The stream with live counters for a query listener."""
    return events.observe(name, F.count(F.lit(1)).alias("seen"), F.count_if(F.col("confidence") >= 0.5).alias("sure"))


def expired(projects: DataFrame, as_of: Column) -> DataFrame:
    """Rows an expiry sweep removes; call it from ``foreachBatch`` or a timed job."""
    return projects.filter(~F.col("saved") & F.col("expires_at").isNotNull() & (F.col("expires_at") <= as_of))


def run_to_table(stream: DataFrame, folder: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Process all available input into ``folder`` and return it as a batch table.

    In update mode every micro-batch appends its changed rows with the batch number; reading keeps the newest row per
    key. Nothing passes through the driver.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/data/part={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("_batch", IntegerType())])).parquet(f"{folder}/data/*")
    if mode != "update":
        return rows.drop("_batch")
    kept = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*kept), "_batch").alias("_r")).select(*keys, "_r.*")
