"""Quality rules, quality classifier and toxicity."""
import math
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import key
from pyspark.sql import functions as F

from tideline.llm import quality_classifier, quality_rules, stats, toxicity


def slow_base(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 3)}
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


@pytest.mark.parametrize("text", [None, "", "a", "a b c a b c a b", "x\nx\n\n \nx ", "a|b ### <é>", "a a a a", "one two three one two"])
def test_stats(text):
    assert stats.text_stats(text)[:5] == slow_base(text)


def test_quality_rules_on_edge_table(docs, rows, labels):
    got = quality_rules.quality_rules(docs, labels).collect()
    want = [key(r[0], *(b := slow_base(r[1])), b[0] < 50 or 100 * b[4] > 50 * b[0]) for r in rows]
    assert sorted(key(r["doc_id"], *r["stats"][:5], r["base_failed"]) for r in got) == sorted(want)
    assert all(r["kept"] == (not r["base_failed"] and not r["failed"]) for r in got)


def test_binomial_tail():
    for n, p in ((1, 0.5), (30, 0.1), (500, 0.003), (4000, 0.02)):
        for k in {0, 1, min(3, n), n // 50, n // 2, n - 1, n}:
            exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
            assert quality_rules.binomial_tail(k, n, p) == pytest.approx(min(exact, 1.0), abs=1e-9)


def test_cutoffs_keep_their_promise():
    """Of many draws, hardly any selects a cutoff whose true false rejection exceeds the risk."""
    rng = np.random.default_rng(2)
    share = np.array([0.0, 0.002, 0.004, 0.006, 0.01, 0.03, 0.948])
    junk = np.array([5, 20, 30, 20, 10, 5, 10])
    broken = sum((at := quality_rules.choose_cutoff(rng.multinomial(3000, share), junk, 0.02, 0.05, weight=0.0)) is not None and share[:at + 1].sum() > 0.02 for _ in range(400))
    assert broken <= 0.07 * 400
    assert quality_rules.choose_cutoff(np.array([0, 0, 10]), np.array([9, 1, 0]), 0.02, 0.05) is None  # too few to certify
    assert quality_rules.choose_cutoff(np.array([0, 0, 9000]), np.array([9, 0, 1]), 0.02, 0.05) == 0


def test_rules_are_certified_per_stratum(spark):
    clean, junk = "good plain words follow here again %d and differ %d", "*** ### %d $$$ %d"
    rows = [(i, " ".join((clean if i % 10 else junk) % (i * k, k) for k in range(12)), ["a", "b", "rare"][i % 2 if i < 5980 else 2]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(6000)], "doc_id bigint, quality int")
    got = quality_rules.quality_rules(docs, labels)
    failed = {r[0] for r in got.filter("not base_failed and not kept").select("doc_id").collect()}
    assert failed == set(range(10, 5980, 10))  # all words of document 0 repeat
    assert got.filter("stratum = 'rare' and size(failed) > 0").count() == 0


def test_quality_rules_without_rows(docs, no_docs, labels, no_labels):
    assert quality_rules.quality_rules(no_docs, labels).count() == 0
    assert quality_rules.quality_rules(docs, no_labels).filter("size(failed) > 0").count() == 0


def test_discriminant_equals_the_formula():
    rng = np.random.default_rng(3)
    d = len(quality_classifier.NAMES)
    x = [rng.normal(m, s, (400, d)) for m, s in ((0.0, 1.0), (0.4, 0.5))]
    model = quality_classifier.discriminant(np.array([400.0, 400.0]), np.array([a.sum(axis=0) for a in x]), np.array([a.T @ a for a in x]))
    probe = rng.normal(0, 1, (5, d))
    logs = []
    for m, f, det in zip(model.means, model.factors, model.logdets):
        cov = np.linalg.inv(f.T @ f)
        assert np.linalg.slogdet(cov)[1] == pytest.approx(det)
        logs.append([-0.5 * (p - m) @ np.linalg.solve(cov, p - m) - 0.5 * det for p in probe])
    want = 1 / (1 + np.exp(-(np.array(logs[1]) - logs[0])))
    assert model.scores(probe) == pytest.approx(want)


def held_out(spark, name, label, sf):
    from tideline.llm.queries import QUERIES

    got = QUERIES[name](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    return {(r["predicted"], r[label]): r["count"] for r in got.groupBy("predicted", label).count().collect()}


def test_quality_classifier_on_held_out_documents(spark):
    n = held_out(spark, "op7_quality_classifier", "quality", "/root/testdata/sf0.1")
    assert (n.get((1, 1), 0) + n.get((0, 0), 0)) / sum(n.values()) > 0.97


def test_toxicity_on_held_out_documents(spark):
    n = held_out(spark, "op5_toxicity", "toxic", "/root/testdata/sf0.1")
    assert n.get((1, 1), 0) / (n.get((1, 1), 0) + n.get((0, 1), 0)) > 0.3
    assert n.get((1, 0), 0) / (n.get((1, 0), 0) + n.get((0, 0), 0)) < 0.03


def test_toxicity_shares_ngrams():
    texts = [f"the {w} is here {i}" for i, w in enumerate(["idiot", "idiots", "idiotic", "stupidly", "stupid"] * 20)] + [f"the {w} is here {i}" for i, w in enumerate(["garden", "window", "morning", "paper", "river"] * 20)]
    rows, bias = toxicity.train(texts, np.array([1] * 100 + [0] * 100))
    model = toxicity.Toxicity(rows, bias)
    odd, plain = model.word_values([b"idiotts", b"gardens"])
    assert odd > plain


def test_subwords_do_not_cross_words():
    at, starts = toxicity.subwords([b"abc", b"abcd", b"a"])
    alone, _ = toxicity.subwords([b"abcd"])
    assert at[starts[1]:starts[2]].tolist() == alone.tolist()


@pytest.mark.parametrize("empty", [False, True])
def test_classifiers_on_edge_table(docs, no_docs, labels, no_labels, rows, empty):
    given = no_labels if empty else labels
    tox = toxicity.fit_toxicity(docs, given, sample_rows=20)
    scored = toxicity.score_toxicity(docs, tox).collect()
    good = quality_classifier.score_quality(docs, quality_classifier.fit_quality(docs, given)).collect()
    for got in (scored, good):
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert toxicity.score_toxicity(no_docs, tox).count() == 0
    assert toxicity.fit_toxicity(no_docs, given).bias == 0
    assert quality_classifier.fit_quality(no_docs, given) is None and quality_classifier.score_quality(no_docs, None).count() == 0


def test_same_text_same_score(docs, labels):
    model = toxicity.fit_toxicity(docs, labels, sample_rows=20)
    twice = toxicity.score_toxicity(docs.select((F.lit(1)).alias("doc_id"), "text"), model)
    both = docs.select("text", toxicity.toxicity_score(F.col("text"), model).alias("s")).groupBy("text").agg((F.max("s") - F.min("s")).alias("gap"))
    assert both.filter("gap > 1e-9").count() == 0 and twice.count() == docs.count()


def test_a_long_text_does_not_push_out_the_others(spark):
    """The first row by hash is longer than the byte bound; all others are still learned from."""
    first = spark.range(400).orderBy(F.xxhash64("id")).first()["id"]
    rows = [(i, " ".join(f"long{k}" for k in range(5000)) if i == first else f"the {['garden', 'idiot'][i % 2]} is here {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id bigint, toxic int")
    model = toxicity.fit_toxicity(docs, labels, sample_bytes=20_000)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert all((scores[i] >= 0.5) == (i % 2 == 1) for i in scores if i != first)
    assert toxicity.within([50, 3, 4, 9, 2], 10) == [False, True, True, False, True]


@pytest.mark.parametrize("toxic", [0, 1])
def test_one_class_drops_nothing(spark, toxic):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, toxic) for i in range(40)], "doc_id bigint, toxic int")
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    assert scored.filter("score = 0.5 and predicted = 0").count() == 40
