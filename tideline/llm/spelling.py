"""Spelling variants: words that one inserted, deleted or replaced code point turns into each other, by PartEnum signatures.

A word's letter multiset is a binary vector: dimension (letter, k) is set if the letter occurs k times or more. One edit changes
at most two dimensions. The dimensions are dealt to ``PARTS`` parts, balanced by how well they tell the vocabulary's words apart,
and every choice of ``PARTS`` - 2 parts is a signature: the vector on these parts. Two vectors that differ in two dimensions at
most agree in the parts that hold neither, so they share a signature; the signature join therefore misses no pair. Members of a
signature are verified letter by letter inside the task, and a pair is reported only under the first signature that avoids the
parts of the edited letters, so it is reported once. Crowded signatures are compared as pairs of tiles in several tasks.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import stash

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
#: Code points and occurrences that a word needs, and how many times as frequent its form has to be.
CODE_POINTS, OCCURRENCES, TIMES = 5, 3, 2
#: Parts, and differing dimensions that signatures have to survive.
PARTS, APART = 6, 2
#: Occurrences of a letter whose dimensions are dealt by measured balance; later ones by number.
COUNTED = 6
#: Words of a tile, and pairs that a task holds at once.
TILE, HELD = 4096, 1 << 17
#: Letters of words that are compared as rows of a matrix; longer ones are compared one by one.
WIDE = 32
#: Words that one step of making signatures holds.
STEP = 8192
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CHOICES = list(combinations(range(PARTS), PARTS - APART))
_MANY = 0x110000


def runs(text: Column) -> Column:
    """Maximal runs of letters, lower-cased from A to Z only; none of null."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(RUN), F.lit(0))


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and where each word starts, with the end of the last."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    return points, np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)]).astype(np.int64)


def dimensions(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, letter and occurrence number of every set dimension."""
    points, starts = _letters(words)
    word = np.repeat(np.arange(len(words)), np.diff(starts))
    order = np.lexsort((points, word))
    word, points = word[order], points[order]
    fresh = np.ones(len(word), dtype=bool)
    fresh[1:] = (word[1:] != word[:-1]) | (points[1:] != points[:-1])
    begin = np.flatnonzero(fresh)
    nth = np.arange(len(word)) - begin[np.cumsum(fresh) - 1] + 1 if len(word) else np.zeros(0, np.int64)
    return word, points, nth


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Parts:
    """Which part a dimension is dealt to."""

    def __init__(self, shares: list[tuple[int, int, float]]):
        """``shares``: letter, occurrence number and the share of words that have the dimension. Dimensions that tell words apart best
        are dealt first, forwards and backwards in turn; of equal ones the smaller goes first."""
        self.table = np.full((COUNTED + 1, 0x100), -1, dtype=np.int64)
        ranked = sorted(shares, key=lambda s: (abs(s[2] - 0.5), s[0], s[1]))
        for i, (letter, nth, _) in enumerate(ranked):
            turn, place = divmod(i, PARTS)
            self.table[nth, letter] = place if turn % 2 == 0 else PARTS - 1 - place

    def of(self, letters: np.ndarray, nth: np.ndarray) -> np.ndarray:
        known = np.where((nth <= COUNTED) & (letters < 0x100), self.table[np.minimum(nth, COUNTED), np.minimum(letters, 0xFF)], -1)
        return np.where(known >= 0, known, (letters + nth) % PARTS)


def part_sums(words: list[str], parts: Parts) -> np.ndarray:
    """A hash of each word's vector on each part."""
    word, letters, nth = dimensions(words)
    sums = np.zeros((len(words), PARTS), dtype=np.uint64)
    np.add.at(sums, (word, parts.of(letters, nth)), _mixed((nth * _MANY + letters).astype(np.uint64) + np.uint64(1)))
    return sums


def signatures(words: list[str], parts: Parts) -> np.ndarray:
    """A number per word and choice of parts."""
    sums = part_sums(words, parts)
    out = np.empty((len(words), len(_CHOICES)), dtype=np.int64)
    for k, choice in enumerate(_CHOICES):
        total = np.full(len(words), k + 1, dtype=np.uint64)
        for part in choice:
            total = _mixed(total + sums[:, part])
        out[:, k] = total.view(np.int64)
    return out


_FIRST = np.array([[next((k for k, c in enumerate(_CHOICES) if x not in c and y not in c), -1) for y in range(PARTS)] for x in range(PARTS)])


class Words:
    """The words of some rows, as a matrix of code points as far as they are short, and hashes of their first and last letters.

    Of two words one edit apart, the shorter of length n, the edit leaves either the first or the last (n - 1) // 2 letters alone.
    ``first`` and ``last`` are of that many letters, ``[0]`` for a word that is not the longer one, ``[1]`` for one that is."""

    def __init__(self, words: list[str]):
        self.words = words
        points, starts = _letters(words)
        self.size = np.diff(starts)
        self.long = self.size > WIDE
        row, at = np.repeat(np.arange(len(words)), self.size), np.arange(len(points)) - np.repeat(starts[:-1], self.size)
        short = ~self.long[row]
        row, at, points = row[short], at[short], points[short]
        self.matrix = np.zeros((len(words), WIDE + 1), dtype=np.int32)
        self.matrix[row, at] = points
        sums = np.zeros((2, len(words), WIDE + 2), dtype=np.uint64)
        for own, place in zip(sums, (at, self.size[row] - 1 - at)):
            own[row, place + 1] = _mixed((points * (WIDE + 1) + place).astype(np.uint64) + np.uint64(1))
            np.cumsum(own, axis=1, out=own)
        every = np.arange(len(words))
        self.first, self.last = ([own[every, np.where(self.long, 0, np.maximum(self.size - less, 0) // 2)] for less in (1, 2)] for own in sums)

    def may_be_near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether words, each ``i`` not longer than its ``j`` and by one letter at most, agree in their first or last letters."""
        longer = self.size[j] > self.size[i]
        same = lambda own: own[0][i] == np.where(longer, own[1][j], own[0][j])
        return same(self.first) | same(self.last) | self.long[i] | self.long[j]

    def edits(self, i: np.ndarray, j: np.ndarray, parts: Parts) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs are exactly one edit apart, and the first choice of parts without the edited dimensions."""
        a, b = self.matrix[i], self.matrix[j]
        longer = self.size[j] > self.size[i]
        apart = a != b
        at = apart.argmax(axis=1)
        shifted = np.concatenate([b[:, 1:], np.zeros((len(b), 1), b.dtype)], axis=1)
        behind = np.arange(WIDE + 1) >= at[:, None]
        near = np.where(longer, (~behind | (a == shifted)).all(axis=1), apart.sum(axis=1) == 1)
        pick = lambda m: m[np.arange(len(m)), at]
        x, y = pick(a), pick(b)
        part = lambda m, c: parts.of(c.astype(np.int64), (m == c[:, None]).sum(axis=1))
        of_y = part(b, y)
        first = _FIRST[np.where(longer, of_y, part(a, x)), of_y]
        for k in np.flatnonzero(self.long[i] | self.long[j]):
            edit = one_edit(self.words[i[k]], self.words[j[k]])
            near[k] = edit is not None
            if edit:
                first[k] = first_choice(self.words[i[k]], self.words[j[k]], edit, parts)
        return near, first


def one_edit(a: str, b: str) -> tuple[str, str] | None:
    """The letters of ``a`` and of ``b``, not shorter, at the one place where they differ, the first empty after an insertion; null
    unless exactly one edit apart."""
    if len(b) - len(a) > 1 or a == b:
        return None
    at = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if len(a) == len(b):
        return (a[at], b[at]) if a[at + 1:] == b[at + 1:] else None
    return ("", b[at]) if a[at:] == b[at + 1:] else None


def first_choice(a: str, b: str, edit: tuple[str, str], parts: Parts) -> int:
    """The first choice of parts that holds none of the dimensions in which two words one edit apart differ."""
    own = [parts.of(np.array([ord(c)]), np.array([w.count(c)]))[0] for w, c in ((a, edit[0]), (b, edit[1])) if c]
    return int(_FIRST[own[0], own[-1]])


def near_in_groups(group: np.ndarray, choice: np.ndarray, words: list[str], n: np.ndarray, parts: Parts, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions i, j of all pairs one edit apart that lie in one group and are reported there, both ways round.

    Rows of a group have one choice and signature and lie together. With ``side``, pairs of the same side in a group whose rows
    have two sides are left out."""
    known = Words(words)
    order = np.lexsort((known.size, group))
    wide = int(known.size.max(initial=0)) + 2
    ranked = group[order] * wide + known.size[order]
    ends = np.searchsorted(ranked, ranked + 1, side="right")
    two = np.zeros(len(group), dtype=bool)
    if side is not None:
        lows, highs = np.full(int(group.max(initial=-1)) + 1, np.iinfo(np.int64).max), np.full(int(group.max(initial=-1)) + 1, -1)
        np.minimum.at(lows, group, side)
        np.maximum.at(highs, group, side)
        two = (lows < highs)[group]
    out = []
    near, gap = np.arange(len(group)), 1
    while len(near := near[near + gap < ends[near]]):
        for at in range(0, len(near), HELD):
            i, j = order[near[at:at + HELD]], order[near[at:at + HELD] + gap]
            may = known.may_be_near(i, j)
            if side is not None:
                may &= ~two[i] | (side[i] != side[j])
            i, j = i[may], j[may]
            hit, first = known.edits(i, j, parts)
            hit &= first == choice[i]
            out.append((i[hit], j[hit]))
        gap += 1
    i, j = (np.concatenate([o[k] for o in out] or [np.zeros(0, np.int64)]) for k in (0, 1))
    return np.concatenate([i, j]), np.concatenate([j, i])


def _signed(parts: Parts, with_words: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                own = batch.slice(at, STEP)
                words = own["word"].to_pylist()
                found = signatures(words, parts)
                row = np.repeat(np.arange(len(words)), len(_CHOICES))
                cols = {"choice": pa.array(np.tile(np.arange(len(_CHOICES), dtype=np.int32), len(words))), "sig": pa.array(found.ravel())}
                if with_words:
                    cols |= {name: own[name].take(pa.array(row)) for name in ("word", "n")}
                yield pa.RecordBatch.from_pydict(cols)

    return of


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words of a batch have a dimension."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            _, letters, nth = dimensions(batch["word"].slice(at, STEP).to_pylist())
            own = (letters < 0x100) & (nth <= COUNTED)
            found, many = np.unique(letters[own] * (COUNTED + 1) + nth[own], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((found // (COUNTED + 1)).astype(np.int32)), pa.array((found % (COUNTED + 1)).astype(np.int32)), pa.array(many.astype(np.int64))], names=["letter", "nth", "words"])


_KEY = ["choice", "sig", "first", "second"]


def _compared(parts: Parts):
    """Near words within the signatures of a sorted partition: per word their number and the most frequent one, in parts."""

    def whole(t: pa.Table, changes: np.ndarray) -> pa.RecordBatch:
        words, n = t["word"].to_pylist(), t["n"].to_numpy()
        i, j = near_in_groups(np.cumsum(changes) - 1, t["choice"].to_numpy(), words, n, parts, t["own"].to_numpy())
        # by frequency, then by code points; rows of equal words are summed later
        rank = np.empty(len(words), dtype=np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort((rank[j], -n[j], i))
        i, j = i[order], j[order]
        begin = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, np.int64)
        counts = np.diff(np.append(begin, len(i)))
        take = lambda name, at: t[name].combine_chunks().take(pa.array(at))
        return pa.RecordBatch.from_arrays([take("word", i[begin]), pa.array(counts.astype(np.int64)), pa.array(-n[j[begin]]), take("word", j[begin])], names=["word", "n_near", "falling", "near"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            own = pa.Table.from_batches([batch])
            held = own if held is None else pa.concat_tables([held, own])
            changes = np.ones(len(held), dtype=bool)
            columns = [held[name].to_numpy() for name in _KEY]
            changes[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            cut = int(np.flatnonzero(changes)[-1]) if len(held) else 0
            if cut:
                yield whole(held.slice(0, cut).combine_chunks(), changes[:cut])
                held = held.slice(cut)
        if held is not None and len(held):
            changes = np.zeros(len(held), dtype=bool)
            changes[0] = True
            yield whole(held.combine_chunks(), changes)

    return of


def _near_words(vocabulary: DataFrame, tile: int) -> DataFrame:
    """``word``, ``n_near``, and ``best``: the negative count and the word of its most frequent near word; words without one are missing."""
    words = vocabulary.count()
    seen = vocabulary.select("word").mapInArrow(_counted, "letter int, nth int, words bigint").groupBy("letter", "nth").agg(F.sum("words").alias("words"))
    parts = Parts([(r["letter"], r["nth"], r["words"] / words) for r in seen.collect()])  # at most 256 letters, COUNTED times
    signed = vocabulary.mapInArrow(_signed(parts, True), "choice int, sig bigint, word string, n bigint")
    sizes = vocabulary.select("word").mapInArrow(_signed(parts, False), "choice int, sig bigint").groupBy("choice", "sig").count()
    crowded = stash(sizes.filter(F.col("count") > tile).select("choice", "sig", F.ceil(F.col("count") / tile).cast("int").alias("tiles")))
    placed = signed.select("*", F.lit(0).alias("own"), F.lit(0).alias("first"), F.lit(0).alias("second"))
    if crowded.limit(1).count():
        own = F.when(F.col("tiles").isNull(), 0).otherwise(F.pmod(F.xxhash64("word"), F.col("tiles"))).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("tiles") - 1, F.lit(0))))
        placed = signed.join(crowded, ["choice", "sig"], "left").withColumn("own", own).withColumn("other", others).select(
            "choice", "sig", "word", "n", "own", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"))
    met = placed.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(_compared(parts), "word string, n_near bigint, falling bigint, near string")
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("falling", "near")).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of all words that have a form; a round doubles the steps that every word looks ahead."""
    now = stash(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stash(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = after.select("word", "root")
        if not after.filter("moved").limit(1).count():
            return now


def spelling_variants(
    tokens: DataFrame, *, word_col: str = "word", code_points: int = CODE_POINTS, occurrences: int = OCCURRENCES, times: int = TIMES, tile: int = TILE,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word that has at least ``code_points`` and occurs at least ``occurrences`` times.

    ``n`` counts a word's rows in ``tokens``, ``n_near`` the words exactly one inserted, deleted or replaced code point away. A
    word's form is the most frequent of these, ties to the smallest in code-point order, if it is at least ``times`` as frequent;
    else null, and so is ``form_n``. ``times`` has to be above 1, so that forms lead to a root, a word without form. Null words
    are left out; other columns are not looked at; an empty table gives an empty table. Words may be of any length."""
    if times <= 1:
        raise ValueError("times: above 1, or forms may run in circles")
    own = tokens.select(F.col(word_col).alias("word")).filter(F.length("word") >= code_points)
    vocabulary = stash(own.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= occurrences))
    near = _near_words(vocabulary, tile)
    is_form = -F.col("best.falling") >= times * F.col("n")
    words = stash(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.falling")).alias("form_n")))
    roots = _roots(words.filter("form is not null"))
    return words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
