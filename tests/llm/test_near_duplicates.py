"""Groups of near copies against brute force over all pairs."""
import random

import numpy as np
import pytest
import xxhash
from conftest_llm import key
from pyspark.sql import functions as F

from tideline.llm import embedding_dedup, simhash
from tideline.llm.components import components, forest, roots


def groups_of(n, pairs):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    n = 300
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([40, 200, 500]))]
    pairs += [(i, i + 1) for i in range(100, 180)] + [(200, k) for k in range(201, 260)]  # a chain and a hub
    want = groups_of(n, pairs)
    assert roots(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), n).tolist() == want
    links = spark.createDataFrame([*pairs, (None, 3), (4, None), (5, 5)], "a bigint, b bigint").repartition(7)
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert all(got.get(k, k) == want[k] for k in range(n))
    a, b = forest(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert groups_of(n, zip(a.tolist(), b.tolist())) == want


def test_components_of_no_links(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def check_simhash(got, rows):
    fps = [slow_fingerprint(r[1]) for r in rows]
    distinct = sorted(set(fps))
    label = groups_of(len(distinct), [(i, j) for i, a in enumerate(distinct) for j, b in enumerate(distinct[:i]) if (a ^ b).bit_count() <= 4])
    least = {}
    for r, f in zip(rows, fps):
        g = label[distinct.index(f)]
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = sorted(key(r[0], f, least.get(label[distinct.index(f)])) for r, f in zip(rows, fps))
    assert sorted(key(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want


def test_simhash_groups(docs, rows):
    check_simhash(simhash.simhash_groups(docs).collect(), rows)


@pytest.mark.parametrize("hot", [1024, 3])
def test_simhash_links_equal_all_pairs(spark, hot):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(120)} | {rng.getrandbits(64) for _ in range(100)} | {0, 1, (1 << 64) - 1}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp bigint"), hot).collect()
    bits = [f % (1 << 64) for f in fps]
    want = groups_of(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (bits[i] ^ bits[j]).bit_count() <= 4])
    assert groups_of(len(fps), [(fps.index(r["a"]), fps.index(r["b"])) for r in links]) == want


def test_one_of_each_group(docs, rows):
    left = simhash.one_of_each_group(docs)
    assert left.columns == docs.columns
    groups = {}
    for r in simhash.simhash_groups(docs).collect():
        groups.setdefault(r["component_id"], set()).add(r["doc_id"])
    got = [r["doc_id"] for r in left.collect()]
    fps = {simhash.fingerprint(r[1]) for r in rows}
    assert len(got) <= len(fps) and {g for g in groups if g is not None} <= set(got)


def test_simhash_of_no_documents(no_docs):
    assert simhash.simhash_groups(no_docs).count() == 0 and simhash.one_of_each_group(no_docs).count() == 0


def vectors(seed, n=260, size=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, size))
    for k in range(120, n):
        x[k] = x[k % 30] + rng.standard_normal(size) * rng.choice([0.0, 0.02, 0.1, 0.3])
    x[200] = 3 * x[7]
    rows = [(int(k), [float(v) for v in row]) for k, row in enumerate(x)]
    odd = [None, [], [0.0] * size, [float("nan")] + [1.0] * (size - 1), [None] + [1.0] * (size - 1), [float("inf")] + [1.0] * (size - 1), [1.0, 2.0], [1.0, 2.0]]
    return rows + [(1000 + k, v) for k, v in enumerate(odd)] + [rows[3], rows[3], (None, rows[3][1])]


@pytest.mark.parametrize("tile", [2048, 8])
def test_embedding_groups_equal_all_pairs(spark, tile):
    rows = vectors(5)
    frame = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "vec_id bigint, embedding array<double>, node double, x string")
    got = embedding_dedup.embedding_groups(frame, recall=0.999999, tile=tile).collect()
    sound = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    pairs, n_links = [], [0] * len(rows)
    for a in sound:
        for b in sound:
            if a != b and len(rows[a][1]) == len(rows[b][1]):
                p, q = np.array(rows[a][1]), np.array(rows[b][1])
                if p @ q / np.linalg.norm(p) / np.linalg.norm(q) >= 0.9 or rows[a][1] == rows[b][1]:
                    n_links[a] += 1
                    pairs.append((a, b))
    label = groups_of(len(rows), pairs + [(3, k) for k in range(len(rows)) if rows[k][0] == 3])
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[label[k]] = min(i, least.get(label[k], i))
    want = sorted(key(i, n, least[label[k]] if i is not None else None) for k, ((i, _), n) in enumerate(zip(rows, n_links)))
    assert sorted(key(r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want


def test_embedding_recall_at_the_least_cosine():
    rng = np.random.default_rng(0)
    bits, tables = embedding_dedup.plan_tables(50_000)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((4000, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    met = (embedding_dedup.sign_codes(a, bits, tables) == embedding_dedup.sign_codes(b, bits, tables)).any(axis=1)
    assert met.mean() > 0.985


def test_embeddings_of_an_empty_table(spark):
    assert embedding_dedup.embedding_groups(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_query_columns(spark):
    from tideline.llm.queries import QUERIES

    got = QUERIES["op6_embedding_dedup"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert got.filter(F.col("kept") != (F.col("vec_id") == F.col("component_id"))).count() == 0


def slow_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def survivors(rows, least=0.8):
    """Smallest ids of the groups that links of five-word Jaccard ``least`` join, over all pairs."""
    sets = [slow_shingles(t) for _, t in rows]
    alike = lambda a, b: a == b or len(a & b) / len(a | b) >= least
    label = groups_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])])
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(label[k], []).append(i)
    return sorted(map(min, groups.values()))


def edited(rng, changes):
    """A text and a copy of it with ``changes`` words replaced."""
    words = [f"w{rng.randrange(100_000)}" for _ in range(rng.randint(150, 600))]
    other = list(words)
    for at in rng.sample(range(len(words)), max(1, round(changes * len(words)))):
        other[at] = f"x{rng.randrange(100_000)}"
    return " ".join(words), " ".join(other)


def test_pipeline_leaves_what_all_pairs_leave(spark):
    """Pairs of similarity 0.65 to 0.98, a large group around one text, a chain, short and empty texts."""
    import corpus_pipeline

    rng = random.Random(8)
    texts = [t for k in range(150) for t in edited(rng, [0.005, 0.01, 0.018, 0.022, 0.03][k % 5])]
    base = edited(rng, 0)[0].split()
    for _ in range(80):
        copy = list(base)
        for at in rng.sample(range(len(copy)), 3):
            copy[at] = f"y{rng.randrange(1000)}"
        texts.append(" ".join(copy))
    chain = [f"c{k}" for k in range(240)]
    texts += [" ".join(chain[k:k + 200]) for k in range(0, 40, 8)] + ["one two", "One  Two", "one three", "", None, " \n", texts[0].upper()]
    rows = list(zip(rng.sample(range(10_000), len(texts)), texts))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = corpus_pipeline.drop_near_copies(spark, docs.repartition(5), "")
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == survivors(rows)


def test_bands_meet_at_the_least_similarity():
    """Sets of similarity 0.8 agree in a band as often as the formula says."""
    from tideline.llm import near_copies

    rng = np.random.default_rng(3)
    met = 0
    for _ in range(1500):
        own = rng.integers(0, 1 << 63, 360, dtype=np.uint64)
        a, b = own[:324], np.concatenate([own[:288], own[324:]])  # 288 of 360
        met += (near_copies.band_keys(a) == near_copies.band_keys(b)).any()
    assert met >= 1494
