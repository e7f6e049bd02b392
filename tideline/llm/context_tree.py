"""Language model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each with a tree of contexts: the last 0 to ``DEPTH`` bytes. Every node estimates its
decision by Krichevsky-Trofimov from the counts of the training texts; a node's weighted probability is half its own estimate's
and half the product of its children's, so all depths are mixed by how well they coded the training texts. What a byte costs
depends on it and the ``DEPTH`` bytes before it only. So blocks of texts send their distinct byte strings of that length to
Spark, which sums them, weighs the trees and sends back one number per string; a text's score is the sum over its bytes.

Strings sorted from their last context byte backwards follow the tree, so they are cut into cells: ranges of about ``CELL``
strings of blocks each, more of them the longer the input is, at borders taken from a sample of texts. A frequent context is
cut like any other. Nodes that a border may cut, at most one per border, depth and decision path, are summed by Spark and
weighed on the driver; all others lie in one cell. Words and their counts go to as many buckets as their number asks for, for
the unigram base score.

The model's text is the lower-cased words, a space after each but the last, then a line end; contexts before the text are line
ends. Blocks are numbered by task and order, and written once.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.bpe import squeeze, unsqueeze
from tideline.llm.bpe_words import ragged
from tideline.llm.common import pieces, stash

DEPTH = 5
#: Bytes of text in a block, and texts: a text's number has 16 bits beside a gram's 48.
BLOCK, BLOCK_TEXTS = 4 << 20, 1 << 16
#: Strings, or words, of blocks that one task sums at once, as far as the sample tells.
CELL = 2_000_000
#: Texts of the sample that borders are taken from, and characters of each; no result depends on them.
SAMPLE, SAMPLE_CHARS = 2000, 20_000


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, eight steps up."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - shift


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that Krichevsky-Trofimov gives any sequence of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def stream(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of several texts, ``DEPTH`` line ends before each, and which of them are scored."""
    texts = [b" ".join(w) + b"\n" for w in words]
    pad = b"\n" * DEPTH
    raw = np.frombuffer(b"".join(pad + t for t in texts), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    scored = np.repeat(np.tile(np.array([False, True]), len(texts)), np.stack([np.full(len(texts), DEPTH), sizes], axis=1).ravel())
    return raw, scored


def grams(raw: np.ndarray, scored: np.ndarray) -> np.ndarray:
    """For every scored byte one number: the byte before it highest, the one before that next, ..., the byte itself lowest."""
    out = np.zeros((len(raw) - DEPTH, 8), dtype=np.uint8)
    for back in range(DEPTH + 1):
        out[:, DEPTH + 1 - back if back else 0] = raw[DEPTH - back:len(raw) - back]
    return out.view("<u8").ravel()[scored[DEPTH:]]


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    first = np.flatnonzero(np.append(len(ordered) > 0, ordered[1:] != ordered[:-1]))
    return ordered[first], np.diff(np.append(first, len(ordered)))


def borders(keys: np.ndarray, cells: int) -> np.ndarray:
    """Where sorted grams are cut into ``cells`` parts of about the same size. A whole context of DEPTH bytes stays in one part."""
    if not len(keys):
        return keys
    at = keys[np.arange(1, cells) * len(keys) // cells] >> np.uint64(8) << np.uint64(8)
    return np.unique(at[at > keys[0]])


def _cut(keys: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where each cell's part of sorted grams begins, and the end."""
    return np.concatenate([[0], np.searchsorted(keys, ends), [len(keys)]])


class Shared:
    """Nodes of the contexts that a border between cells may cut, at depths 0 to DEPTH - 1: arrays by context and decision path."""

    def __init__(self, ends: np.ndarray):
        self.contexts = [np.unique(ends >> np.uint64(8 * (DEPTH + 1 - depth))) for depth in range(DEPTH)]
        self.weight, self.chance = ([np.zeros((len(c), 256)) for c in self.contexts] for _ in range(2))

    def find(self, depth: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of a depth's nodes are shared ones, and their rows and paths."""
        if depth == DEPTH or not len(self.contexts[depth]):
            return (np.zeros(0, dtype=np.int64),) * 3
        context = number >> np.uint64(8)
        row = np.minimum(np.searchsorted(self.contexts[depth], context), len(self.contexts[depth]) - 1)
        here = np.flatnonzero(self.contexts[depth][row] == context)
        return here, row[here], (number[here] & np.uint64(255)).astype(np.int64)

    def fill(self, rows: list[tuple[int, int, int, float, float, float]]) -> None:
        """From all cells' sums (depth, context, path, zeros, ones, log weighted probability of children that are not shared)."""
        zeros, ones, below = ([np.zeros(w.shape) for w in self.weight] for _ in range(3))
        for depth, context, path, n0, n1, weighted in rows:
            row = np.searchsorted(self.contexts[depth], np.uint64(context))
            zeros[depth][row, path], ones[depth][row, path], below[depth][row, path] = n0, n1, weighted
        for depth in range(DEPTH - 1, -1, -1):
            own = estimate(zeros[depth], ones[depth])
            self.chance[depth] = (ones[depth] + 0.5) / (zeros[depth] + ones[depth] + 1)
            self.weight[depth] = own_weight(own, below[depth])
            if depth:
                up = np.searchsorted(self.contexts[depth - 1], self.contexts[depth] >> np.uint64(8))
                np.add.at(below[depth - 1], up, np.logaddexp(own, below[depth]) - np.log(2))


def own_weight(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Weight of a node's own chance against the deeper one: how well either coded the training texts."""
    return 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


def decision(keys: np.ndarray, counts: np.ndarray, k: int, shared: Shared):
    """Nodes of decision ``k`` for a cell's sorted distinct grams.

    The node of each gram at depth DEPTH; then per depth, DEPTH to 0: node numbers (context, path), zeros, ones, log own
    estimate, sum over children that are not shared of their log weighted probability, and each node's parent."""
    symbol = keys & np.uint64(255)
    number = (keys >> np.uint64(8) << np.uint64(8)) | (symbol >> np.uint64(8 - k)) | np.uint64(1 << k)
    new = np.append(True, number[1:] != number[:-1])
    first = np.flatnonzero(new)
    ones = np.add.reduceat(counts * ((symbol >> np.uint64(7 - k)) & np.uint64(1)), first)
    zeros, number = np.add.reduceat(counts, first) - ones, number[first]
    below, levels = np.zeros(len(first)), []
    for depth in range(DEPTH, -1, -1):
        own = estimate(zeros, ones)
        weighted = own if depth == DEPTH else np.logaddexp(own, below) - np.log(2)
        weighted[shared.find(depth, number)[0]] = 0
        up, parents = pd.factorize((number >> np.uint64(16) << np.uint64(8)) | (number & np.uint64(255)))
        levels.append((depth, number, zeros, ones, own, below, up))
        if depth:
            zeros, ones, below = (np.bincount(up, weights=x, minlength=len(parents)) for x in (zeros, ones, weighted))
            number = parents
    return np.cumsum(new) - 1, levels


def log10_costs(keys: np.ndarray, counts: np.ndarray, shared: Shared) -> np.ndarray:
    """Log10 probability of the byte of each of a cell's sorted distinct grams after its context; one decision is in hand at a time."""
    total = np.zeros(len(keys))
    for k in range(8):
        place, levels = decision(keys, counts, k, shared)
        node = mixed = None
        for depth, number, zeros, ones, own, below, up in levels:
            chance = (ones + 0.5) / (zeros + ones + 1)
            if mixed is None:
                mixed, node = chance, up
                continue
            weight = own_weight(own, below)
            here, row, path = shared.find(depth, number)
            weight[here], chance[here] = shared.weight[depth][row, path], shared.chance[depth][row, path]
            mixed = weight[node] * chance[node] + (1 - weight[node]) * mixed
            node = up[node]
        total += np.log10(np.where((keys >> np.uint64(7 - k)) & np.uint64(1) == 1, mixed[place], 1 - mixed[place]))
    return total


ROW = "kind string, bucket int, block bigint, keys binary, counts binary, texts binary, ids array<bigint>, folds binary"


def _vocabulary(words: list[list[bytes]]) -> list[bytes]:
    """Distinct words in the order in which they first occur: the same whenever a block is read."""
    return list(dict.fromkeys(chain.from_iterable(words)))


def _blocks(buckets: int, ends: np.ndarray, block_bytes: int):
    """Per block a row with its texts, and rows of its words per bucket and of its grams per cell, with their counts in training texts."""

    def row(kind: str, bucket: int, block: int, **rest):
        return {"kind": kind, "bucket": bucket, "block": block, "keys": None, "counts": None, "texts": None, "ids": None, "folds": None} | rest

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            done = 0
            for texts in pieces((t.as_py() for t in batch.column(2)), block_bytes, BLOCK_TEXTS):
                block += 1
                learn = batch.column(1).slice(done, len(texts)).to_numpy(zero_copy_only=False).astype(bool)
                words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
                seen = Counter(chain.from_iterable(compress(words, learn.tolist())))
                vocabulary = _vocabulary(words)
                to = np.fromiter(map(zlib.crc32, vocabulary), dtype=np.int64, count=len(vocabulary)) % buckets
                counts = np.fromiter(map(seen.__getitem__, vocabulary), dtype=np.int64, count=len(vocabulary))
                rows = []
                for bucket in np.unique(to).tolist():
                    own = np.flatnonzero(to == bucket)
                    rows.append(row("words", bucket, block, keys=zstandard.compress(b"\n".join([vocabulary[k] for k in own.tolist()]), 3), counts=squeeze(counts[own].astype(np.uint32))))
                raw, scored = stream(words)
                codes = grams(raw, scored)
                trained = np.repeat(learn, np.fromiter((sum(map(len, own)) + max(len(own), 1) for own in words), dtype=np.int64, count=len(words)))
                keys, _ = runs(np.sort(codes))
                taught, times = runs(np.sort(codes[trained]))
                counts = np.zeros(len(keys), dtype=np.uint32)
                counts[np.searchsorted(keys, taught)] = times
                parts = _cut(keys, ends)
                for cell in np.flatnonzero(np.diff(parts)).tolist():
                    part = slice(parts[cell], parts[cell + 1])
                    rows.append(row("grams", cell, block, keys=squeeze(np.diff(keys[part], prepend=np.uint64(0))), counts=squeeze(counts[part])))
                joined = zstandard.compress(b"\n".join(b" ".join(own) for own in words), 3)
                rows.append(row("texts", zlib.crc32(str(block).encode()) % buckets, block, texts=joined, ids=batch.column(0).slice(done, len(texts)).to_pylist(), folds=learn.tobytes()))
                done += len(texts)
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return cut


_SCHEMA = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("texts", pa.binary()), ("ids", pa.list_(pa.int64())), ("folds", pa.binary())])
_ANSWER = pa.schema([("block", pa.int64()), ("kind", pa.string()), ("bucket", pa.int32()), ("numbers", pa.binary())])


def _gather(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each row's grams, and all distinct ones, sorted, with their counts summed."""
    each = [np.cumsum(unsqueeze(k, np.uint64), dtype=np.uint64) for k in rows["keys"].to_pylist()]
    counts = np.concatenate([unsqueeze(c, np.uint32) for c in rows["counts"].to_pylist()]).astype(np.float64)
    codes, keys = pd.factorize(np.concatenate(each))
    sums, order = np.bincount(codes, weights=counts, minlength=len(keys)), np.argsort(keys)
    return each, keys[order], sums[order]


SHARED_ROW = "depth int, context bigint, path int, zeros double, ones double, weighted double"


def _sum_shared(shared: Shared):
    """A cell's part of the nodes that borders may cut."""

    def sums(rows: pa.Table) -> pa.Table:
        _, keys, counts = _gather(rows)
        out = [[np.zeros(0, t) for t in (np.int32, np.int64, np.int32, float, float, float)]]
        for k in range(8):
            for depth, number, zeros, ones, _, below, _ in decision(keys, counts, k, shared)[1]:
                here, row, path = shared.find(depth, number)
                if len(here):
                    out.append([np.full(len(here), depth, np.int32), shared.contexts[depth][row].astype(np.int64), path.astype(np.int32), zeros[here], ones[here], below[here]])
        return pa.table(dict(zip(("depth", "context", "path", "zeros", "ones", "weighted"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return sums


def _score_grams(shared):
    """Costs of each row's grams; ``shared`` is broadcast."""

    def score(rows: pa.Table) -> pa.Table:
        each, keys, counts = _gather(rows)
        costs = log10_costs(keys, counts, shared.value).astype(np.float32)
        out = [{"block": block, "kind": "grams", "bucket": cell, "numbers": squeeze(costs[np.searchsorted(keys, own)])} for block, cell, own in zip(rows["block"].to_pylist(), rows["bucket"].to_pylist(), each, strict=True)]
        return pa.Table.from_pylist(out, schema=_ANSWER)

    return score


def _count_words(rows: pa.Table) -> pa.Table:
    """Counts of each row's words over all blocks; and a row without a block: distinct words and words of training texts."""
    each = [zstandard.decompress(k).split(b"\n") for k in rows["keys"].to_pylist()]
    known: dict[bytes, int] = {}
    for own in each:
        known.update(zip([w for w in own if w not in known], range(len(known), len(known) + len(own)), strict=False))
    at = [np.fromiter(map(known.__getitem__, own), dtype=np.int64, count=len(own)) for own in each]
    seen = np.bincount(np.concatenate(at), weights=np.concatenate([unsqueeze(c, np.uint32) for c in rows["counts"].to_pylist()]), minlength=len(known)).astype(np.int64)
    out = [{"block": block, "kind": "words", "bucket": bucket, "numbers": squeeze(seen[own])} for block, bucket, own in zip(rows["block"].to_pylist(), rows["bucket"].to_pylist(), at, strict=True)]
    out.append({"block": None, "kind": "sums", "bucket": rows["bucket"][0].as_py(), "numbers": np.array([np.count_nonzero(seen), seen.sum()], dtype=np.int64).tobytes()})
    return pa.Table.from_pylist(out, schema=_ANSWER)


def _assemble(buckets: int, borders_: np.ndarray, ends: int, types: int, tokens: int):
    """Scores of a block's texts from the numbers of its words and grams."""

    def score(rows: pa.Table) -> pa.Table:
        found = {(r["kind"], r["bucket"]): r for r in rows.to_pylist()}
        block = next(r for (kind, _), r in found.items() if kind == "texts")
        words = [line.split(b" ") if line else [] for line in zstandard.decompress(block["texts"]).split(b"\n")]
        n_words = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        vocabulary = _vocabulary(words)
        to = np.fromiter(map(zlib.crc32, vocabulary), dtype=np.int64, count=len(vocabulary)) % buckets
        counts = np.zeros(len(vocabulary), dtype=np.int64)
        for bucket in np.unique(to).tolist():
            counts[to == bucket] = unsqueeze(found["words", bucket]["numbers"], np.int64)
        place = dict(zip(vocabulary, counts.tolist(), strict=True))
        each = np.fromiter(map(place.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=int(n_words.sum()))
        raw, scored = stream(words)
        sizes = np.fromiter((sum(map(len, own)) + max(len(own), 1) for own in words), dtype=np.int64, count=len(words))
        # Grams and the texts they are in, sorted as one number.
        both = np.sort(grams(raw, scored) << np.uint64(16) | np.repeat(np.arange(len(words), dtype=np.uint64), sizes))
        keys, times = runs(both >> np.uint64(16))
        parts = _cut(keys, borders_)
        costs = np.concatenate([unsqueeze(found["grams", b]["numbers"], np.float32) for b in np.flatnonzero(np.diff(parts)).tolist()])
        sums = np.bincount((both & np.uint64(0xFFFF)).astype(np.int64), weights=np.repeat(costs, times), minlength=len(words))
        owner = np.repeat(np.arange(len(words)), n_words)
        bottom = np.log10(tokens + types + 1)
        base = np.bincount(owner, weights=np.log10(each + 1), minlength=len(words)) + np.log10(ends + 1) - (n_words + 1) * bottom
        known = np.bincount(owner, weights=each > 0, minlength=len(words)).astype(np.int64) + (ends > 0)
        return pa.table({
            "id": pa.array(block["ids"], type=pa.int64()), "learned": pa.array(np.frombuffer(block["folds"], dtype=bool)), "n_tokens": n_words + 1, "n_known": known,
            "train_tokens": np.full(len(words), tokens), "base_score": base, "score": sums, "n_bytes": sizes})

    return score


def _plan(docs: DataFrame, text_col: str, buckets: int, cell: int) -> tuple[int, np.ndarray]:
    """Buckets of words and borders of cells, from the number of bytes and a sample of texts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text) + 1)).first()
    if not n:
        return buckets, np.zeros(0, dtype=np.uint64)
    sample = docs.select(F.substring(text, 1, SAMPLE_CHARS).alias("text")).filter(F.rand(7) < SAMPLE / n).limit(2 * SAMPLE).collect()
    words = [r["text"].encode("utf-8", "surrogatepass").lower().split() for r in sample]
    codes = np.sort(grams(*stream(words))) if words else np.zeros(0, dtype=np.uint64)
    keys, _ = runs(codes)
    need = lambda found: max(buckets, -(-int(size * found / max(len(codes), 1)) // cell))
    return need(len(_vocabulary(words))), borders(keys, need(len(keys)))


def score_texts(docs: DataFrame, *, learn: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK, cell: int = CELL) -> DataFrame:
    """Scores of all rows, by a model of those for which ``learn`` holds.

    Columns: the id, learned, n_tokens, n_known, train_tokens, base_score, score (log10 of the model's probability of the text)
    and n_bytes, of the model's text. Null and empty texts are one token, the end. Without training texts every decision has
    chance 1/2. Rows with equal ids are scored one by one (ids are integers, null stays null); other columns are not looked at,
    an empty table gives an empty table.
    """
    spark = docs.sparkSession
    buckets, ends = _plan(docs, text_col, int(spark.conf.get("spark.sql.shuffle.partitions")), cell)
    rows = stash(docs.select(F.col(id_col).cast("bigint"), F.coalesce(learn, F.lit(False)), F.col(text_col).cast("string")).mapInArrow(_blocks(buckets, ends, block_bytes), ROW))
    words, strings = rows.filter("kind = 'words'").select("bucket", "block", "keys", "counts"), rows.filter("kind = 'grams'").select("bucket", "block", "keys", "counts")
    shared = Shared(ends)
    if len(ends):
        parts = strings.groupBy("bucket").applyInArrow(_sum_shared(shared), SHARED_ROW)
        shared.fill(parts.groupBy("depth", "context", "path").agg(F.sum("zeros"), F.sum("ones"), F.sum("weighted")).collect())  # 5 x 255 rows per border at most
    shared = spark.sparkContext.broadcast(shared)
    answer = "block bigint, kind string, bucket int, numbers binary"
    counted = stash(words.groupBy("bucket").applyInArrow(_count_words, answer))
    sums = [np.frombuffer(r["numbers"], dtype=np.int64) for r in counted.filter("kind = 'sums'").select("numbers").collect()]  # one row per bucket
    texts = rows.filter("kind = 'texts'").select("block", "kind", "bucket", "texts", "ids", "folds")
    learned = docs.filter(learn).count()
    types, tokens = int(sum(s[0] for s in sums)) + (learned > 0), int(sum(s[1] for s in sums)) + learned
    scored = strings.groupBy("bucket").applyInArrow(_score_grams(shared), answer)
    met = counted.filter("kind = 'words'").unionByName(scored).unionByName(texts, allowMissingColumns=True)
    out = met.groupBy("block").applyInArrow(_assemble(buckets, ends, learned, types, tokens), "id bigint, learned boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint")
    return out.withColumnRenamed("id", id_col)


__all__ = ["DEPTH", "Shared", "borders", "estimate", "grams", "ragged", "score_texts", "stream"]
