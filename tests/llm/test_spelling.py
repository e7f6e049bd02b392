"""Spelling variants against all pairs of words in plain Python."""
import collections
import itertools
import random

import numpy as np
import pytest
from conftest_llm import key
from pyspark.sql import functions as F

from tideline.llm import spelling as sp


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(tokens, code_points=5, occurrences=3, times=2):
    n = collections.Counter(t for t in tokens if t is not None and len(t) >= code_points)
    n = {w: c for w, c in n.items() if c >= occurrences}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: v if v is not None and n[v] >= times * n[w] else None for w, v in form.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n), key=lambda r: key(*r))


def got(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: key(*r))


def tokens_of(spark, words):
    return spark.createDataFrame([(w, 1, "s", "f") for w in words], "word string, n int, sig string, form string")


def made(seed=1, roots=60):
    rng = random.Random(seed)
    letters = "abcdeé"
    words = []
    for _ in range(roots):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(4, 9)))
        for _ in range(6):
            words += [word] * rng.randint(1, 12)
            at, c = rng.randrange(len(word)), rng.choice(letters + "×ÿ")
            word = rng.choice([word[:at] + word[at + 1:], word[:at] + c + word[at:], word[:at] + c + word[at + 1:]])
    return words


@pytest.mark.parametrize("tile", [4096, 7])
def test_equals_all_pairs(spark, tile):
    words = made() + [None, "", "abcd", "ABCDE"] + ["x" * 30] * 3 + ["x" * 31] * 9 + ["x" * 32] * 20 + ["x" * 33] * 3 + ["y" + "x" * 32] * 4 + ["z" * 5000] * 3 + ["z" * 5001] * 6
    want = brute(words)
    assert got(sp.spelling_variants(tokens_of(spark, words), tile=tile)) == want
    assert sum(r[1] is not None for r in want) > 30 and any(r[1] != r[2] for r in want if r[1])


def test_crowded_signatures_meet_in_tiles(spark):
    rng = random.Random(3)
    anagrams = {"".join(rng.sample("abcdefg", 7)) for _ in range(700)} | {"".join(rng.sample("abcdefg", 7))[:6] for _ in range(200)}
    words = [w for k, w in enumerate(sorted(anagrams)) for _ in range(3 + k % 5)]
    assert got(sp.spelling_variants(tokens_of(spark, words), tile=16)) == brute(words)


def test_other_limits_chains_and_ties(spark):
    chain = ["aaaaa"] * 2 + ["aaaab"] * 4 + ["aaabb"] * 8 + ["aabbb"] * 16 + ["abbbb"] * 32 + ["bbbbb"] * 64 + ["qqqqa"] * 3 + ["qqqqb"] * 6 + ["qqqqc"] * 6
    for limits in ((5, 2, 2), (4, 3, 3), (6, 1, 2)):
        assert got(sp.spelling_variants(tokens_of(spark, chain), code_points=limits[0], occurrences=limits[1], times=limits[2])) == brute(chain, *limits)
    with pytest.raises(ValueError):
        sp.spelling_variants(tokens_of(spark, chain), times=1)


def test_empty(spark):
    assert got(sp.spelling_variants(tokens_of(spark, []))) == []
    assert got(sp.spelling_variants(tokens_of(spark, [None, "", "ab"]))) == []


def test_runs(spark, docs):
    import re
    for r in docs.select("text", sp.runs(F.col("text")).alias("runs")).collect():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")
        assert (r["runs"] or []) == re.findall("[A-Za-zÀ-ÿ]+", low)


def test_words_two_dimensions_apart_share_a_signature():
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(5, 8))) for _ in range(400)})
    word, letter, nth = sp.dimensions(words)
    seen = collections.Counter(zip(letter.tolist(), nth.tolist()))
    parts = sp.Parts([(c, k, n / len(words)) for (c, k), n in seen.items() if k <= sp.COUNTED])
    sets = collections.defaultdict(set)
    for w, c, k in zip(word.tolist(), letter.tolist(), nth.tolist()):
        sets[w].add((c, k))
    signed = sp.signatures(words, parts)
    for a, b in itertools.combinations(range(len(words)), 2):
        if len(sets[a] ^ sets[b]) <= 2:
            assert (signed[a] == signed[b]).any()
        if one_apart(words[a], words[b]):
            assert len(sets[a] ^ sets[b]) <= 2
            i, j = sorted((a, b), key=lambda k: len(words[k]))
            assert signed[a, sp.first_choice(words[i], words[j], sp.one_edit(words[i], words[j]), parts)] == signed[b, sp.first_choice(words[i], words[j], sp.one_edit(words[i], words[j]), parts)]
            known = sp.Words([words[i], words[j]])
            zero, one = np.array([0]), np.array([1])
            assert known.may_be_near(zero, one)[0] and known.edits(zero, one, parts)[0][0]
            assert known.edits(zero, one, parts)[1][0] == sp.first_choice(words[i], words[j], sp.one_edit(words[i], words[j]), parts)
