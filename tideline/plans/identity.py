"""Who did it: names read by character recognition, matched loosely, clustered and classified."""
from __future__ import annotations

import json
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tideline.functions.numeric import nz
from tideline.functions.text import once
from tideline.operators.chunks import carry_chunks
from tideline.operators.ranges import band_join
from tideline.session import settle

KEY = ["video_id"]

# Name thresholds, anchor walk and word lists.
CLUSTER_RATIO, POV_RATIO, SAME_RATIO, FOREIGN_RATIO, FEED_RATIO = 0.62, 0.62, 0.55, 0.82, 0.85
SPAWN_CUTOFF, BACK_STEP, BACK_MOST, BACK_MISSES = 32.0, 0.5, 12.0, 2
NAME = r"[A-Za-z0-9_\u0400-\u04FF][A-Za-z0-9_\-\u0400-\u04FF]{2,}"
CHANNEL_WORDS = ("pov", "highlights", "gameplay", "youtube", "twitch", "official", "channel", "gaming", "counter", "strike", "limcs")
TITLE_WORDS = ("vs", "pov", "cs2", "csgo", "faceit", "premier", "rank", "rated", "highlights", "highlight", "stream", "twitch", "live", "full", "match", "demo", "clip", "clips", "gameplay", "the", "and")
STREAM_WORDS = ("gaming", "live", "tv", "cs2", "csgo", "twitch", "youtube", "official", "channel", "stream", "highlights", "gameplay", "counter", "strike", "the", "und", "der", "die", "full", "voice", "comms",
                "soloq", "ranked", "match", "kills")


def normalise_name(name: Column) -> Column:
    """Lower case with only Latin letters, digits, underscore, hyphen and Cyrillic letters kept."""
    return F.regexp_replace(F.lower(nz(name, "")), "[^a-z0-9_\\-\\u0430-\\u044f\\u0451]", "")


@lru_cache(maxsize=200_000)
def _ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two names by longest matching blocks; edit distance is a different measure."""
    return pd.Series([_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def pair_ratio(some: pd.Series, others: pd.Series) -> pd.Series:
    """Highest similarity between two lists of names."""
    lists = ((xs if xs is not None else (), ys if ys is not None else ()) for xs, ys in zip(some, others))
    return pd.Series([max((_ratio(x or "", y or "") for x in xs for y in ys), default=0.0) for xs, ys in lists], dtype="float64")


@F.pandas_udf(DoubleType())
def best_ratio(a: pd.Series, others: pd.Series) -> pd.Series:
    """Highest similarity of a name to a list of names."""
    return pd.Series([max((_ratio(x or "", y or "") for y in (ys if ys is not None else ())), default=0.0) for x, ys in zip(a, others)], dtype="float64")


def plausible_tag(name: Column) -> Column:
    n = F.trim(nz(name, ""))
    low = F.regexp_replace(F.lower(n), "[^a-z0-9]", "")
    bad = F.lit(False)
    for w in CHANNEL_WORDS:
        bad = bad | F.contains(low, F.lit(w))
    return F.length(n).between(3, 22) & n.rlike(r"^[A-Za-z0-9_\-]+$") & ~bad


def parse_feed(raw: Column) -> Column:
    """Killer, assist and victim from one recognised line; a single name is a partial reading."""
    found = F.filter(F.transform(F.regexp_extract_all(nz(raw, ""), F.lit(f"({NAME})"), 1), normalise_name), lambda n: F.length(n) >= 3)
    none = F.lit("")

    def parts(names: Column) -> Column:
        n = F.size(names)
        return F.struct(F.when(n >= 1, F.get(names, F.lit(0))).otherwise(none).alias("killer"), F.when(n > 2, F.get(names, F.lit(1))).otherwise(none).alias("assist"),
                        F.when(n >= 2, F.get(names, n - 1)).otherwise(none).alias("victim"), (n == 1).alias("partial"), names.alias("names"))

    return once(found, parts)


def valid_reading() -> Column:
    k, v = normalise_name(F.col("killer")), normalise_name(F.col("victim"))
    return F.when(F.col("partial"), F.length(k) >= 3).otherwise((F.length(k) >= 3) & (F.length(v) >= 3) & (k != v))


def reading_key() -> Column:
    k, a, v = (normalise_name(F.col(c)) for c in ("killer", "assist", "victim"))
    return F.when(F.col("partial"), F.when(k == "", "").otherwise(F.concat(F.lit("partial|"), k))).when((k == "") & (v == ""), "").otherwise(F.concat_ws("|", k, a, v))


def read_feed(ocr: DataFrame) -> DataFrame:
    """Valid readings of ``(video_id, seq, time, raw_ocr, border_score)`` with names, key and confidence.

    A line is parsed once: ``inline`` keeps the optimizer from copying the rules into every column that uses them."""
    rows = ocr.select(*ocr.columns, F.inline(F.array(parse_feed(F.col("raw_ocr")))))
    rows = rows.select("*", F.inline(F.array(F.struct(reading_key().alias("read_key"), valid_reading().alias("_valid")))))
    rows = rows.filter(F.col("_valid") & (F.col("read_key") != "")).drop("_valid")
    return rows.withColumn("confidence", F.bround(F.least(F.lit(0.99), F.lit(0.55) + F.col("border_score") * 4), 3))


def same_reading(threshold: float = FEED_RATIO) -> Column:
    """Whether the readings in columns ``a_*`` and ``b_*`` describe the same feed line. Pairs that the length bound rules
    out are dropped by built-in functions; the rule itself runs once per remaining pair."""
    col = lambda side, f: nz(F.col(f"{side}_{f}"), "")
    may = lambda x, y: (F.length(x) > 0) & (F.length(y) > 0) & (2 * F.least(F.length(x), F.length(y)) >= threshold * (F.length(x) + F.length(y)))
    part_full = lambda p, f: may(col(p, "killer"), col(f, "killer")) | may(col(p, "killer"), col(f, "victim"))
    ap, bp = F.col("a_partial"), F.col("b_partial")
    possible = (F.when(ap & ~bp, part_full("a", "b")).when(bp & ~ap, part_full("b", "a")).when(ap & bp, may(col("a", "killer"), col("b", "killer")))
                .otherwise(may(col("a", "key"), col("b", "key")) | (may(col("a", "killer"), col("b", "killer")) & may(col("a", "victim"), col("b", "victim")))))
    fields = ("killer", "assist", "victim", "partial", "key")

    @F.pandas_udf("boolean")
    def same(sides: pd.DataFrame) -> pd.Series:
        sides = [[dict(zip(fields, row)) for row in zip(*(sides[f"{x}_{f}"] for f in fields))] for x in "ab"]
        return pd.Series([_same(a, b, threshold) for a, b in zip(*sides)], dtype="boolean")

    both = F.struct(*[(col(x, f) if f != "partial" else F.col(f"{x}_partial")).alias(f"{x}_{f}") for x in "ab" for f in fields])
    return possible & same(both)


def _side(prefix: str) -> list[Column]:
    return [normalise_name(F.col(c)).alias(f"{prefix}_{c}") for c in ("killer", "assist", "victim")] + [F.col("partial").alias(f"{prefix}_partial"), F.col("read_key").alias(f"{prefix}_key")]


def backward_anchors(seeds: DataFrame, reads: DataFrame) -> DataFrame:
    """Earliest time each seed reading stays visible, walking back in half-second steps and tolerating two misses.

    ``seeds``/``reads``: (video_id, seq, time, killer, assist, victim, partial, read_key, confidence). A seed meets at
    most twelve seconds of readings; the walk itself is a fold over at most 25 step numbers.
    """
    s = seeds.select(*KEY, "seq", F.col("time").alias("seed_t"), *_side("a"))
    r = reads.select(*KEY, F.col("time").alias("read_t"), F.col("confidence").alias("read_c"), *_side("b"))
    pairs = band_join(s, r, KEY, F.col("seed_t"), F.col("read_t"), BACK_MOST, 0.0)
    step = F.round((F.col("seed_t") - F.col("read_t")) / BACK_STEP)
    on_grid = F.abs(F.col("seed_t") - F.col("read_t") - step * BACK_STEP) < 1e-6
    pairs = pairs.filter(on_grid & (F.col("read_t") >= SPAWN_CUTOFF)).filter(same_reading())
    steps = pairs.groupBy(*KEY, "seq", "seed_t").agg(F.sort_array(F.collect_set(F.struct(step.cast("int").alias("i"), F.col("read_c").alias("c")))).alias("_s"))
    begin = F.struct(F.lit(-1).alias("at"), F.lit(0.5).alias("best"), F.lit(True).alias("go"))

    def walk(acc: Column, x: Column) -> Column:
        go = acc["go"] & (x["i"] - acc["at"] <= BACK_MISSES + 1)
        return F.struct(F.when(go, F.greatest(acc["at"], x["i"])).otherwise(acc["at"]).alias("at"), F.when(go, F.greatest(acc["best"], x["c"])).otherwise(acc["best"]).alias("best"), go.alias("go"))

    done = steps.withColumn("_w", F.aggregate("_s", begin, walk))
    found = done.select(*KEY, "seq", (F.col("seed_t") - F.greatest(F.col("_w.at"), F.lit(0)) * BACK_STEP).alias("anchor"), F.col("_w.best").alias("best_conf"))
    return seeds.join(found, [*KEY, "seq"], "left").withColumns({"anchor": nz(F.col("anchor"), F.col("time")), "best_conf": nz(F.col("best_conf"), 0.5)})


_BITS: dict[tuple[str, int], int] = {}


@lru_cache(maxsize=200_000)
def _letters(name: str) -> int:
    """The characters of a name as bits, repeats as bits of their own."""
    seen: dict[str, int] = {}
    mask = 0
    for c in name:
        seen[c] = seen.get(c, 0) + 1
        mask |= 1 << _BITS.setdefault((c, seen[c]), len(_BITS))
    return mask


def _close(a: str, b: str, threshold: float) -> bool:
    """Whether the similarity reaches the threshold; length and shared characters, which no matching blocks exceed, rule most pairs out."""
    if not a or not b:
        return False
    size = len(a) + len(b)
    if 2.0 * min(len(a), len(b)) / size < threshold or 2.0 * (_letters(a) & _letters(b)).bit_count() / size < threshold:
        return False
    return _ratio(a, b) >= threshold


_close_names = lru_cache(maxsize=200_000)(_close)


def _same(a: dict, b: dict, threshold: float) -> bool:
    """The reading rule on two plain records."""
    if a["partial"] != b["partial"]:
        part, full = (a, b) if a["partial"] else (b, a)
        name = part["killer"]
        return len(name) >= 3 and (_close_names(name, full["killer"], threshold) or _close_names(name, full["victim"], threshold))
    if a["partial"]:
        return len(a["killer"]) >= 3 and len(b["killer"]) >= 3 and _close_names(a["killer"], b["killer"], threshold)
    if _close(a["key"], b["key"], threshold):
        return True
    if not (_close_names(a["killer"], b["killer"], threshold) and _close_names(a["victim"], b["victim"], threshold)):
        return False
    if len(a["killer"]) < 3 or len(b["killer"]) < 3 or len(a["victim"]) < 3 or len(b["victim"]) < 3:
        return False
    return not a["assist"] or not b["assist"] or _close_names(a["assist"], b["assist"], threshold)


def registry(reads: DataFrame, threshold: float = FEED_RATIO) -> DataFrame:
    """Distinct feed lines per recording, in order of first reading: a full reading replaces a partial one, the
    earliest anchor and the highest confidence stay."""
    slim = reads.withColumns({c: normalise_name(F.col(c)) for c in ("killer", "assist", "victim")}).select(
        *KEY, "time", "seq", "read_key", "killer", "assist", "victim", "partial", F.array_join("names", " ").alias("names"), "anchor", F.col("best_conf").alias("conf"))

    fields = ("killer", "assist", "victim", "partial", "read_key", "names", "anchor", "conf")

    def process(state: str | None, rows: pd.DataFrame) -> str:
        entries = json.loads(state) if state else []
        for killer, assist, victim, partial, key, names, anchor, conf in zip(*(rows[c].tolist() for c in fields)):
            fp = {"killer": killer, "assist": assist, "victim": victim, "partial": bool(partial), "key": key, "names": names}
            known = next((e for e in entries if _same(fp, e, threshold)), None)
            if known is None:
                entries.append({**fp, "anchor": round(float(anchor), 2), "conf": round(float(conf), 3)})
                continue
            if known["partial"] and not fp["partial"]:
                known.update(fp)
            known["anchor"] = round(min(known["anchor"], float(anchor)), 2)
            known["conf"] = round(max(known["conf"], float(conf)), 3)
        return json.dumps(entries)

    state = carry_chunks(slim, KEY, "time", ["seq"], process)
    parsed = state.select(*KEY, F.posexplode(F.from_json("state", "array<struct<killer:string,assist:string,victim:string,partial:boolean,key:string,names:string,anchor:double,conf:double>>")).alias("entry", "_e"))
    return parsed.select(*KEY, "entry", "_e.*")


def name_clusters(names: DataFrame, threshold: float = CLUSTER_RATIO) -> DataFrame:
    """Greedy clusters of ``(video_id, pos, name)`` in order: a name joins the first cluster whose representative is
    similar enough; the representative is the most frequent, then longest member."""
    rows = names.withColumn("norm", normalise_name(F.col("name"))).filter(F.length("norm") >= 3).select(*KEY, "pos", "norm")

    def process(state: str | None, group: pd.DataFrame) -> str:
        clusters = json.loads(state) if state else []
        for norm in group["norm"]:
            home = next((c for c in clusters if _close(norm, c["rep"], threshold)), None)
            if home is None:
                clusters.append({"rep": norm, "members": {norm: 1}})
                continue
            home["members"][norm] = home["members"].get(norm, 0) + 1
            top = max((n, len(m)) for m, n in home["members"].items())
            if (home["members"][home["rep"]], len(home["rep"])) != top:
                home["rep"] = min(m for m, n in home["members"].items() if (n, len(m)) == top)
        return json.dumps(clusters)

    state = carry_chunks(rows, KEY, "pos", ["norm"], process)
    parsed = state.select(*KEY, F.posexplode(F.from_json("state", "array<struct<rep:string,members:map<string,int>>>")).alias("cluster", "_c"))
    members = F.map_keys("_c.members")
    return parsed.select(*KEY, "cluster", F.col("_c.rep").alias("representative"), F.array_sort(members).alias("members"), F.aggregate(F.map_values("_c.members"), F.lit(0), lambda a, x: a + x).alias("count"))


def pov_cluster(entries: DataFrame, killers: DataFrame | None = None) -> DataFrame:
    """The dominant player per recording from registry entries, with its coverage of all entries. ``killers`` are the settled clusters of
    the entries' killers, if they are known already."""
    order = F.col("entry") if "entry" in entries.columns else F.col("seq")
    if killers is None:
        killers = settle(name_clusters(entries.filter("killer <> ''").select(*KEY, order.cast("double").alias("pos"), F.col("killer").alias("name"))))
    victims = settle(name_clusters(entries.filter("victim <> ''").select(*KEY, order.cast("double").alias("pos"), F.col("victim").alias("name"))))
    v = victims.select(*KEY, F.col("representative").alias("_v"), F.col("count").alias("_vc"))
    near = killers.join(v, KEY).filter(name_ratio("representative", "_v") >= POV_RATIO).groupBy(*KEY, "cluster").agg((F.sum("_vc") * 5).alias("_bonus"))
    length = F.length("representative")
    base = F.col("count") * 10.0
    score = F.when(length < 4, -1.0).otherwise(F.when(length >= 6, base + 20).when(length <= 4, base * 0.45).otherwise(base) + nz(F.col("_bonus"), 0))
    scored = killers.join(near, [*KEY, "cluster"], "left").withColumn("score", score)
    best = scored.groupBy(*KEY).agg(F.max_by(F.struct("representative", "members", "count"), F.struct("score", F.struct(F.col("count"), length, -F.col("cluster")))).alias("_b"))
    fallback = victims.groupBy(*KEY).agg(F.max_by(F.struct("representative", "members", "count"), F.struct("count", F.length("representative"), -F.col("cluster"))).alias("_fb"))
    total = entries.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    out = total.join(best, KEY, "left").join(fallback, KEY, "left").withColumn("_b", F.coalesce("_b", "_fb")).filter("_b is not null")
    return out.select(*KEY, F.col("_b.representative").alias("pov"), F.col("_b.members").alias("members"), F.col("_b.count").alias("count"), (F.col("_b.count") / F.col("_n")).alias("coverage"))


def pov_hint(channel: Column, title: Column) -> Column:
    """A player name from the channel, a ``<name> POV`` title, or the first plausible title word."""
    chan = F.regexp_replace(F.trim(nz(channel, "")), "^@+", "")
    before = F.regexp_extract(nz(title, ""), r"(?i)([A-Za-z0-9_\-]{3,})\s+pov\b", 1)
    words = F.filter(F.regexp_extract_all(nz(title, ""), F.lit(f"({NAME})"), 1), lambda w: ~F.lower(w).isin(*TITLE_WORDS) & plausible_tag(w))
    return F.when(plausible_tag(chan), chan).when((before != "") & plausible_tag(before), before).otherwise(F.get(words, F.lit(0)))


def resolve_pov(cluster: Column, hint: Column) -> Column:
    """The cluster's spelling when hint and cluster agree, the hint when they clearly differ."""
    c = normalise_name(cluster)
    h = F.when(plausible_tag(hint), normalise_name(hint)).otherwise("")
    same = (name_ratio(h, c) >= SAME_RATIO) | F.contains(c, h) | F.contains(h, c)
    return F.when((h != "") & (c != ""), F.when(same, c).otherwise(h)).when(h != "", h).otherwise(c)


def _looks_like(k: Column, p: Column, members: Column) -> Column:
    """The rules that need no similarity: contained, same prefix, stem or ending, or contained in a member name."""
    prefix = F.greatest(F.lit(4), F.least(F.length(k), F.length(p)) - 2)
    contained = F.contains(p, k) | F.contains(k, p)
    alike = (F.length(k) >= 4) & (F.length(p) >= 4) & (contained | (F.substring(k, F.lit(1), prefix) == F.substring(p, F.lit(1), prefix)))
    for n in (7, 6, 5, 4):
        alike = alike | ((F.length(p) >= n) & (F.length(k) >= n - 1) & (F.contains(k, F.right(p, F.lit(n))) | F.contains(p, k)))
    alike = alike | ((F.length(p) >= 3) & ((F.right(k, F.lit(3)) == F.right(p, F.lit(3))) | (F.right(k, F.lit(4)) == F.right(p, F.lit(4)))))
    return alike | F.exists(members, lambda m: (F.length(m) >= 3) & (F.contains(m, k) | F.contains(k, m)))


def matches_any(names: Column, pov: Column, members: Column) -> Column:
    """Whether one of the recognised names is the recording's player. Direct and member similarity share the 0.55
    limit, so one similarity over both lists decides."""
    p = normalise_name(pov)
    kin = nz(members, F.expr("cast(array() as array<string>)"))
    long_ = F.filter(F.transform(names, normalise_name), lambda k: F.length(k) >= 3)
    like = pair_ratio(long_, F.concat(kin, F.array(p))) >= SAME_RATIO
    seen = F.struct(p.alias("p"), long_.alias("names"), kin.alias("kin"))
    return (p != "") & (like | once(seen, lambda s: F.exists(s["names"], lambda k: _looks_like(k, s["p"], s["kin"]))))


def matches_pov(name: Column, pov: Column, members: Column) -> Column:
    return matches_any(F.array(nz(name, "")), pov, members)


def classify_entries(entries: DataFrame, pov: DataFrame, clusters: DataFrame) -> DataFrame:
    """Kill, death or skip with the reason for each registry entry. Similarities become columns once; the ladder over
    them is plain expressions. Representatives of other players join as one list per recording."""
    p = pov.select(*KEY, "pov", "members")
    others = clusters.join(p.select(*KEY, "pov"), KEY).filter((F.col("count") >= 2) & (name_ratio("representative", "pov") < POV_RATIO)).groupBy(*KEY).agg(F.collect_set("representative").alias("_foreign"))
    rows = entries.join(p, KEY, "left").join(others, KEY, "left")
    empty = F.expr("cast(array() as array<string>)")
    rows = rows.withColumns({"_foreign": nz(F.col("_foreign"), empty), "_names": F.array_distinct(F.filter(F.concat(F.array("killer", "assist", "victim"), F.split("names", " ")), lambda n: F.length(n) >= 3))})
    for c in ("killer", "victim", "assist"):
        rows = rows.withColumn(f"_m_{c}", (nz(F.col(c), "") != "") & matches_pov(F.col(c), F.col("pov"), F.col("members")))
    rows = rows.withColumn("_f", (F.length("killer") >= 4) & ~F.col("_m_killer") & (best_ratio("killer", "_foreign") >= FOREIGN_RATIO))
    rows = rows.withColumn("_any", matches_any(F.col("_names"), F.col("pov"), F.col("members")))
    any_name = F.col("_any")
    enemy = (F.col("killer") != "") & ~F.col("_m_killer") & (F.length("killer") >= 4) & (F.col("victim") != F.col("killer"))
    pair = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    outcome = (
        F.when(nz(F.col("pov"), "") == "", pair("skip", "no_pov"))
        .when(F.col("_m_victim"), pair("death", "pov_death"))
        .when(F.col("_m_killer"), pair("kill", F.when(F.col("partial"), "pov_partial_killer").otherwise("pov_killer_match")))
        .when(F.col("_m_assist"), pair("kill", "pov_assist_swap"))
        .when(F.col("partial") & any_name, pair("kill", "pov_partial_any"))
        .when(F.col("partial"), pair("skip", F.when((F.size("_names") == 1) & F.col("_f"), "partial_foreign_skip").otherwise("partial_not_pov")))
        .when(F.col("_f"), pair("kill", "pov_foreign_killer_ocr"))
        .when(enemy, pair("kill", "pov_enemy_killer_field"))
        .when(any_name, pair("kill", "pov_name_in_line"))
        .otherwise(pair("skip", "not_pov")))
    return rows.withColumn("_o", outcome).select(*entries.columns, "pov", F.col("_o.kind").alias("kind"), F.col("_o.reason").alias("reason"))


def funnel(ocr: DataFrame, reads: DataFrame, entries: DataFrame, classified: DataFrame) -> DataFrame:
    """Counters of the identity pipeline per recording, each a partial aggregate."""
    a = ocr.groupBy(*KEY).agg(F.count(F.lit(1)).alias("ocr_calls"), F.count_if(F.length(F.trim(nz(F.col("raw_ocr"), ""))) > 2).alias("ocr_nonempty"))
    b = reads.groupBy(*KEY).agg(F.count(F.lit(1)).alias("parsed"), F.count_if("partial").alias("partial_reads"), F.count_distinct("read_key").alias("unique_before"))
    c = entries.groupBy(*KEY).agg(F.count(F.lit(1)).alias("unique_after"))
    d = classified.groupBy(*KEY).agg(F.count_if(F.col("kind") == "kill").alias("kills"), F.count_if(F.col("kind") == "death").alias("deaths"))
    return a.join(b, KEY, "left").join(c, KEY, "left").join(d, KEY, "left").fillna(0)


def skip_reasons(classified: DataFrame) -> DataFrame:
    return classified.filter("kind = 'skip'").groupBy("reason").agg(F.count(F.lit(1)).alias("entries"))


def to_events(classified: DataFrame) -> DataFrame:
    """Kills in the event schema the filters read."""
    red = F.col("reason").isin("pov_killer_match", "pov_partial_killer")
    return classified.filter("kind = 'kill'").select(
        *KEY, F.col("entry").cast("bigint").alias("seq"), F.col("anchor").alias("time"), F.col("anchor").alias("raw_time"), F.col("anchor").alias("kill_anchor_time"), F.col("conf").alias("confidence"),
        F.lit("top_right").alias("roi"), F.lit(True).alias("player_kill"), red.alias("red_highlight"), "killer", "assist", "victim", F.col("conf").alias("highlight_score"),
        F.when(red, "red").otherwise("white").alias("highlight_color"), F.lit("two-pass-ocr").alias("method"), F.col("pov").alias("pov_player"), F.col("reason").alias("pov_reason"))


def streamer_tokens(channel: Column, title: Column) -> Column:
    """Name tokens of a channel and title, with common suffixes also removed."""
    parts = F.filter(F.split(F.concat_ws(" ", nz(channel, ""), nz(title, "")), r"[\s_|–\-:()\[\]]+"), lambda p: p != "")
    plain = F.transform(parts, lambda p: F.lower(F.regexp_replace(p, "[^a-zA-Z0-9]", "")))
    cut = F.transform(F.filter(plain, lambda p: F.length(p) > 6), lambda p: F.regexp_replace(p, "(gaming|live|tv|cs2|csgo)$", ""))
    return F.array_distinct(F.filter(F.concat(plain, cut), lambda t: (F.length(t) >= 4) & ~t.isin(*STREAM_WORDS)))


def names_streamer(text: Column, names: Column) -> Column:
    norm = F.regexp_replace(F.lower(nz(text, "")), "[^a-z0-9]", "")
    return (F.length(norm) >= 3) & F.exists(names, lambda t: (F.length(t) >= 3) & F.contains(norm, t))
