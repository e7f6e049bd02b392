"""URL filter: parts, rules and features against plain Python, trees against a slow version of the same steps."""
import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tideline.llm import url_filter as uf

RULES = [uf.Rule(v, at) for v, at in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))]
URLS = [
    None, "", "no scheme", "http://", "://", "http://A.Example.NET", "https://a.example.net/", "https://example.net/en/1?x=1&y=2#f", "https://example.net/en", "http://badexample.com/de/x",
    "HTTP://Sub.EXAMPLE.com/de/", "http://example.com/DE/1", "ftp://x.org/fr/?", "http://x.org#/fr/", "http://x.org?a=/fr/", "http://user@x.net:80/a//b/", "http://ÄÖ.net/ß", "http://net/", "http://a.net/b://c.org/fr/",
    "http://x\n.net/\ny", "http://h.example.net/" + "ab1/" * 9000 + "?" + "p=1&" * 500, "http://😀.org/fr/😀😀", "a" * 20_000,
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]


def rule(host, path):
    fit = [r.at for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=len) if fit else None


def bits(text):
    return sum(-c / len(text) * math.log2(c / len(text)) for c in collections.Counter(text).values()) if text else 0.0


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", "y", 1.0) for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string, score double")


def made_urls(n, seed=5):
    """Spam urls are long and full of digits, or lie under one suffix."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        bad = rng.random() < 0.4
        word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
        tail = "".join(rng.choice("0123456789") for _ in range(rng.randint(8, 14))) if bad and k % 2 else word()
        out.append((f"http://{word()}.{word()}.{'top' if bad and not k % 2 else rng.choice(['com', 'org'])}/{tail}", int(bad)))
    return out


def test_parts_rules_and_features(spark):
    df = pages(spark, URLS)
    got = uf.url_filter(df, RULES, uf.UrlModel(0.0, 0.0, [], {})).collect()
    assert len(got) == len(URLS)
    for r in got:
        url = URLS[r["page_id"]]
        assert (r["host"], r["path"]) == parts(url) and r["rule"] == rule(*parts(url))
        want = next((x.verdict for x in RULES if x.at == r["rule"]), "allow")
        assert r["verdict"] == want and r["score"] == 0
    host, path = uf.host_and_path(F.col("url"))
    features = uf.lexical_features(F.col("url"), host, path)
    for r in df.select("page_id", *[c.alias(n) for n, c in features.items()]).collect():
        url, (h, p) = URLS[r["page_id"]] or "", parts(URLS[r["page_id"]])
        asked = re.match(r"[^?#]*\?([^#]*)", url)
        assert r["length"] == len(url) and r["depth"] == len([x for x in p.split("/") if x]) and r["labels"] == len([x for x in h.split(".") if x])
        assert r["parameters"] == (len([x for x in asked[1].split("&") if x]) if asked else 0)
        assert r["digit_ratio"] == pytest.approx(len(re.findall("[0-9]", url)) / len(url) if url else 0)
        assert r["entropy"] == pytest.approx(bits(url), abs=1e-9) and r["host_entropy"] == pytest.approx(bits(h), abs=1e-9)
    assert set(features) | {"suffix_1", "suffix_2"} == set(uf.FEATURES)


def test_longest_rule_wins_whatever_the_order(spark):
    both = [uf.Rule("allow", "a.net/"), uf.Rule("block", "net/ab"), uf.Rule("allow", "x.org/"), uf.Rule("block", "x.org/")]
    df = pages(spark, ["http://a.net/ab", "http://x.org/"])
    for rules in (both, both[::-1]):
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in uf.url_filter(df, rules, uf.UrlModel(0.0, 0.0, [], {})).collect()}
        assert got == {0: ("a.net/", "allow"), 1: ("x.org/", "block")}


def slow_trees(rows, edges, base, trees, depth):
    """The same boosting in plain Python, one row and one candidate split at a time."""
    grown = []
    for _ in range(trees):
        grads = []
        for label, bins in rows:
            p = 1 / (1 + math.exp(-(base + sum(value(t, bins) for t in grown))))
            grads.append((round((label - p) * uf._UNIT), round(p * (1 - p) * uf._UNIT)))

        def grow(own, level, worth):
            best = None
            for f in range(len(edges)):
                for b in sorted({rows[k][1][f] for k in own})[:-1]:
                    sides = [[k for k in own if rows[k][1][f] <= b], [k for k in own if rows[k][1][f] > b]]
                    if min(map(len, sides)) < uf.LEAF_ROWS:
                        continue
                    gain = sum(worth(s) for s in sides) - worth(own)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, f, b, sides
            if level == depth or best is None:
                g, h = (sum(grads[k][x] for k in own) / uf._UNIT for x in (0, 1))
                return uf.Node(value=uf.RATE * g / (h + uf.RIDGE))
            return uf.Node(feature=best[1], bin=best[2], edge=edges[best[1]][best[2]], left=grow(best[3][0], level + 1, worth), right=grow(best[3][1], level + 1, worth))

        made = grow(range(len(rows)), 0, lambda own: (sum(grads[k][0] for k in own) / uf._UNIT) ** 2 / (sum(grads[k][1] for k in own) / uf._UNIT + uf.RIDGE))
        if made.left is None:
            break
        grown.append(made)
    return grown


def value(node, bins):
    while node.left is not None:
        node = node.left if bins[node.feature] <= node.bin else node.right
    return node.value


def same(a, b):
    if (a.left is None) != (b.left is None):
        return False
    if a.left is None:
        return a.value == pytest.approx(b.value, abs=1e-6)
    return (a.feature, a.bin, a.edge) == (b.feature, b.bin, b.edge) and same(a.left, b.left) and same(a.right, b.right)


def test_trees_equal_a_slow_version(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(300):
        bins = [rng.randint(0, 4), rng.randint(0, 3), rng.randint(0, 1)]
        rows.append((int(bins[0] + 2 * bins[2] + rng.random() * 2 > 3.5), bins))
    edges = [[0.5, 1.5, 2.5, 3.5], [0.5, 1.5, 2.5], [0.5]]
    got = uf.grow_trees(spark.createDataFrame(rows, "label int, bins array<int>"), edges, 0.2, trees=3, depth=3)
    want = slow_trees(rows, edges, 0.2, 3, 3)
    assert len(got) == len(want) == 3 and all(same(a, b) for a, b in zip(got, want))


def test_held_out_urls(spark):
    made = made_urls(1500)
    learn, held = made[:1000], made[1000:]
    labelled = spark.createDataFrame(learn, "url string, label int")
    model = uf.fit_urls(labelled, trees=6)
    df = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(held)], "page_id bigint, url string")
    got = {r["page_id"]: r["verdict"] == "block" for r in uf.url_filter(df, [], model).collect()}
    right = sum(got[k] == bool(y) for k, (_, y) in enumerate(held)) / len(held)
    assert right > 0.97
    again = uf.fit_urls(labelled.union(labelled).repartition(5).select("url", "label", F.lit("x").alias("host")), trees=6)
    assert again.trees == model.trees  # repeated rows and their order change nothing
    scored = uf.url_filter(pages(spark, URLS), RULES, model).collect()
    assert len(scored) == len(URLS) and all(0 <= r["score"] <= 1 for r in scored)


def test_nothing_to_learn_from(spark):
    for rows in ([], [("http://a.com/", 1)], [("http://a.com/", 1), ("http://a.com/", 0), (None, 1), ("x", None), ("y", 7)]):
        model = uf.fit_urls(spark.createDataFrame(rows, "url string, label int"))
        assert not model.trees
        assert {r["verdict"] for r in uf.url_filter(pages(spark, ["http://a.com/", None]), [], model).collect()} == {"allow"}
    assert uf.url_filter(pages(spark, []), RULES, uf.UrlModel(0.0, 0.0, [], {})).count() == 0


def test_main_path_is_native(spark):
    model = uf.fit_urls(spark.createDataFrame(made_urls(120), "url string, label int"), trees=1, depth=1)
    plan = uf.url_filter(pages(spark, URLS), RULES, model)._jdf.queryExecution().executedPlan().toString()
    assert model.trees and not re.search("Python|Pandas|Arrow", plan)
