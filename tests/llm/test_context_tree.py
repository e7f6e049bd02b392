"""Context-tree weighting against a plain recursive tree, base scores against a counter."""
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import key
from pyspark.sql import functions as F

from tideline.llm import context_tree as ct
from tideline.llm.common import fold


def model_text(text):
    return b" ".join((text or "").encode().lower().split()) + b"\n"


class SlowTree:
    """Counts per context and decision path in dictionaries, weights by recursion."""

    def __init__(self, texts):
        self.counts, self.children = defaultdict(lambda: [0, 0]), defaultdict(set)
        for text in texts:
            raw = b"\n" * ct.DEPTH + text
            for t in range(ct.DEPTH, len(raw)):
                for path, bit in self.decisions(raw[t]):
                    for depth in range(ct.DEPTH + 1):
                        context = raw[t - depth:t]
                        self.counts[context, path][bit] += 1
                        if depth < ct.DEPTH:
                            self.children[context, path].add(raw[t - depth - 1:t])
        self.memo = {}

    @staticmethod
    def decisions(byte):
        path = 1
        for k in range(7, -1, -1):
            bit = byte >> k & 1
            yield path, bit
            path = path << 1 | bit

    def own(self, context, path):
        a, b = self.counts.get((context, path), (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def below(self, context, path):
        return sum(self.weighted(child, path) for child in self.children.get((context, path), ()))

    def weighted(self, context, path):
        if (context, path) not in self.memo:
            own = self.own(context, path)
            self.memo[context, path] = own if len(context) == ct.DEPTH else np.logaddexp(own, self.below(context, path)) - math.log(2)
        return self.memo[context, path]

    def chance(self, context, path, bit):
        depth = len(context)
        n = self.counts.get((context[ct.DEPTH - depth:], path), (0, 0))
        mixed = None
        for d in range(ct.DEPTH, -1, -1):
            part = context[len(context) - d:] if d else b""
            n = self.counts.get((part, path), (0, 0))
            own = (n[bit] + 0.5) / (n[0] + n[1] + 1)
            if mixed is None:
                mixed = own
            else:
                weight = 1 / (1 + math.exp(min(700, self.below(part, path) - self.own(part, path))))
                mixed = weight * own + (1 - weight) * mixed
        return mixed

    def score(self, text):
        raw = b"\n" * ct.DEPTH + text
        return sum(math.log10(self.chance(raw[t - ct.DEPTH:t], path, bit)) for t in range(ct.DEPTH, len(raw)) for path, bit in self.decisions(raw[t]))


@pytest.fixture(scope="module")
def small():
    texts = ["the cat sat on the mat", "The dog  sat", None, "", "a the ébc", "cat cat\ncat", "unseen zebra", "mat the on"]
    return [(i, texts[i % len(texts)] if i < 16 else f"the cat {i} sat", "x", 1) for i in range(24)] + [(None, "the cat", None, None), (3, "Dog", "y", 2)]


def check(spark, rows, block_bytes):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kind string, block int").repartition(3)
    got = ct.score_texts(docs, learn=fold("doc_id", 7) != 2, block_bytes=block_bytes).collect()
    learn = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 != 2
    tree = SlowTree([model_text(t) for i, t, *_ in rows if learn(i)])
    counts = Counter(w for i, t, *_ in rows if learn(i) for w in [*(t or "").encode().lower().split(), b"\n"])
    n, v = sum(counts.values()), len(counts)
    want, scores, bases = [], {}, {}
    for i, t, *_ in rows:
        tokens = [*(t or "").encode().lower().split(), b"\n"]
        want.append(key(i, learn(i), len(tokens), sum(counts[w] > 0 for w in tokens), n))
        scores.setdefault(i, []).append(tree.score(model_text(t)))
        bases.setdefault(i, []).append(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens))
    assert sorted(key(r["doc_id"], r["learned"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == sorted(want)
    for i in scores:
        assert sorted(r["score"] for r in got if r["doc_id"] == i) == pytest.approx(sorted(scores[i]), rel=1e-5)
        assert sorted(r["base_score"] for r in got if r["doc_id"] == i) == pytest.approx(sorted(bases[i]))


@pytest.mark.parametrize("block_bytes", [8 << 20, 30])
def test_scores_equal_the_slow_tree(spark, small, block_bytes):
    check(spark, small, block_bytes)


def test_scores_do_not_depend_on_cells(spark, small, monkeypatch):
    """Borders through nearly every context, and none."""
    for cells in (300, 1):
        monkeypatch.setattr(ct, "_plan", lambda docs, text_col, buckets, cell, n=cells: (3, ct.borders(np.unique(ct.grams(*ct.stream([model_text(t).split() for _, t, *_ in small]))), n)))
        check(spark, small, 30)


def test_a_crowded_context_is_cut():
    """All grams end in the same two context bytes; no cell has more than a small share of them."""
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 32, 100_000, dtype=np.uint64)) | np.uint64(0x2061 << 32)
    parts = np.diff(np.concatenate([[0], np.searchsorted(keys, ct.borders(keys, 50)), [len(keys)]]))
    assert len(parts) == 50 and parts.max() < 1.1 * len(keys) / 50


def test_cells_follow_the_input(spark):
    rows = [(i, " ".join(f"w{i * k % 997}" for k in range(1, 60))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    few, many = (ct._plan(docs, "text", 4, cell) for cell in (10**9, 200))
    assert few[0] == 4 and len(few[1]) == 3 and many[0] > 4 and len(many[1]) > 30


def test_chances_sum_to_one(spark, small):
    tree = SlowTree([model_text(t) for _, t, *_ in small])
    raw = [model_text(t).strip() for _, t, *_ in small]
    total = sum(10 ** tree.score(bytes([b]))for b in range(256))
    assert total <= 1 + 1e-9 and raw


def test_edge_table(docs, rows, no_docs):
    got = ct.score_texts(docs, learn=fold("doc_id", 7) != 2).collect()
    assert len(got) == len(rows) and all(r["score"] < 0 and math.isfinite(r["score"]) and r["n_tokens"] >= 1 for r in got)
    assert ct.score_texts(no_docs, learn=F.lit(True)).count() == 0
    untaught = ct.score_texts(docs, learn=F.lit(False)).collect()
    assert all(r["score"] == pytest.approx(-8 * r["n_bytes"] * math.log10(2), rel=1e-5) and r["n_known"] == 0 for r in untaught)


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 10.0, 1e3, 1e9])
    assert ct.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-10)
