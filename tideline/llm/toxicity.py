"""Toxicity of a text: embeddings of subwords, averaged per word and per text, into a linear softmax.

A text is the bag of its distinct words; a word's subwords are the word itself and its character n-grams with edge marks, hashed into a fixed number of rows; unseen
misspellings and forms share n-grams with known words. Embeddings and softmax are trained jointly (Adam, numpy) in one task
on a bounded sample of labelled rows. Scoring needs one number per word, kept per task for words met before.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tideline.llm.common import PIECE_BYTES, labels_by_id, pieces, stash

#: Labelled rows to learn from at most: those whose ids have the smallest hashes; and bytes of their distinct words at most.
SAMPLE_ROWS, SAMPLE_BYTES = 16_000, 64 << 20
#: Rows of the embedding table, their width, n-gram lengths in bytes; training steps, rows of a step (an eighth at most) and rate.
ROWS, WIDTH, GRAMS = 1 << 18, 2, (3, 4, 5)
STEPS, BATCH, RATE = 400, 512, 0.1
#: Shrinkage of the embeddings per step and unit of the rate.
DECAY = 1.0
#: Logits per unit of an averaged embedding and of the bias: one telling word among hundreds has to be able to decide.
SCALE, BIAS_SCALE = 50.0, 5.0
#: Weight of all toxic rows together: a single telling word in a long text should still reach the strict threshold.
TOXIC_SHARE = 0.85
THRESHOLD = 0.7
#: Words whose numbers a task remembers.
CACHE = 200_000
_PLAIN = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_MULTIPLIERS = np.cumprod(np.full(max(GRAMS), 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)


def words(text: str) -> list[bytes]:
    """Lower-case words of letters and digits; all other ASCII characters separate."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def subwords(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of all subwords of all words, and where each word's begin."""
    marked = np.frombuffer(b"".join(b"<" + w + b">" for w in vocabulary), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter((len(w) + 2 for w in vocabulary), dtype=np.int64, count=len(vocabulary))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(vocabulary)), sizes)
    left = ends[owner] - np.arange(len(marked))  # characters from here to the word's end
    owners, codes = [], []
    for n in GRAMS:
        if len(marked) < n:
            continue
        code = np.zeros(len(marked) - n + 1, dtype=np.uint64)
        for i in range(n):
            code += marked[i:len(code) + i] * _MULTIPLIERS[i]
        fits = left[:len(code)] >= n
        owners.append(owner[:len(code)][fits])
        codes.append(code[fits] * np.uint64(2 * n + 1))
    place = np.arange(len(marked), dtype=np.uint64) - np.repeat((ends - sizes).astype(np.uint64), sizes)
    mixed = (marked + np.uint64(7)) * ((place + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F) | np.uint64(1))
    mixed ^= mixed >> np.uint64(29)
    owners.append(np.arange(len(vocabulary)))
    codes.append(np.add.reduceat(mixed * np.uint64(0x165667B19E3779F9), ends - sizes))
    owners, codes = np.concatenate(owners), np.concatenate(codes)
    codes ^= codes >> np.uint64(32)
    codes *= np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(vocabulary))
    return (codes[order] >> np.uint64(40)).astype(np.int64) % ROWS, np.cumsum(counts) - counts


def all_subwords(vocabulary: list[bytes], step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """``subwords`` of many words, some at a time so that working arrays stay small."""
    parts = [subwords(vocabulary[at:at + step]) for at in range(0, len(vocabulary), step)]
    sizes = np.concatenate([np.diff(np.append(starts, len(rows))) for rows, starts in parts])
    return np.concatenate([rows.astype(np.int32) for rows, _ in parts]), np.cumsum(sizes) - sizes


@dataclass(frozen=True)
class Toxicity:
    """Log odds that each embedding row adds, and those of an empty text."""
    rows: np.ndarray
    bias: float

    def word_values(self, vocabulary: list[bytes]) -> np.ndarray:
        at, starts = all_subwords(vocabulary)
        return np.add.reduceat(self.rows[at], starts) / np.diff(np.append(starts, len(at)))


def _mean(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Row sums of non-empty runs divided by ``counts``."""
    return np.add.reduceat(values, starts, axis=0) / counts[:, None].astype(np.float32)


def _spread(grads: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(at, weights=grads[:, k], minlength=size) for k in range(grads.shape[1])], axis=1).astype(np.float32)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of several runs, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)


def train(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Log odds per embedding row and those of no word, from Adam steps on the cross entropy of batches; label 1 weighs TOXIC_SHARE of all.

    All are 0 unless texts with words have both labels."""
    known: dict[bytes, int] = {}
    bags = [np.fromiter((known.setdefault(w, len(known)) for w in dict.fromkeys(words(t))), dtype=np.int32) for t in texts]
    keep = np.array([len(b) > 0 for b in bags], dtype=bool)
    y, bags = np.asarray(labels)[keep].astype(np.float32), [b for b in bags if len(b)]
    if not len(y) or y.min() == y.max():
        return np.zeros(ROWS, dtype=np.float32), 0.0
    subs, starts = all_subwords(list(known))
    del known
    sizes = np.diff(np.append(starts, len(subs)))
    doc_words, doc_sizes = np.concatenate(bags), np.array([len(b) for b in bags])
    doc_starts = np.cumsum(doc_sizes) - doc_sizes
    weight = np.where(y == 1, TOXIC_SHARE / y.mean(), (1 - TOXIC_SHARE) / (1 - y.mean())).astype(np.float32)
    rng = np.random.default_rng(7)
    params = {"E": rng.normal(0, 0.1, (ROWS, WIDTH)).astype(np.float32), "W": rng.normal(0, 1, (WIDTH, 2)).astype(np.float32), "b": np.zeros(2, dtype=np.float32)}
    first, second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    parts = max(1, len(y) // max(1, min(BATCH, len(y) // 8)))
    steps = [part for _ in range(-(-STEPS // parts)) for part in np.array_split(rng.permutation(len(y)), parts)]
    for step, docs in enumerate(steps, 1):
        n = doc_sizes[docs]
        used, local = np.unique(doc_words[_runs(doc_starts[docs], n)], return_inverse=True)
        at, m = subs[_runs(starts[used], sizes[used])], sizes[used]
        bag = _mean(_mean(params["E"][at], np.cumsum(m) - m, m)[local], np.cumsum(n) - n, n)
        logits = SCALE * bag @ params["W"] + BIAS_SCALE * params["b"]
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        miss = (odds / odds.sum(axis=1, keepdims=True) - np.stack([1 - y[docs], y[docs]], axis=1)) * (weight[docs] / len(docs))[:, None]
        back = SCALE * miss @ params["W"].T / n[:, None]
        word_grads = _spread(np.repeat(back, n, axis=0), local, len(used)) / m[:, None]
        grads = {"W": SCALE * bag.T @ miss, "b": BIAS_SCALE * miss.sum(axis=0), "E": _spread(np.repeat(word_grads, m, axis=0), at, ROWS)}
        rate = RATE * (1 - (step - 1) / len(steps))
        for k, g in grads.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            if k == "E":
                params[k] *= np.float32(1 - rate * DECAY)
            params[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    turn = SCALE * (params["W"][:, 1] - params["W"][:, 0])
    return (params["E"] @ turn).astype(np.float32), float(BIAS_SCALE * (params["b"][1] - params["b"][0]))


def distinct_words(text: Column) -> Column:
    """String column of a text's distinct words in their order, all that training looks at."""

    @arrow_udf("string")
    def bags(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([b" ".join(dict.fromkeys(words(t.as_py() or ""))).decode("utf-8", "replace") for t in texts], type=pa.string())

    return bags(text)


def within(sizes: list[int], limit: int) -> list[bool]:
    """Which of the sizes are taken, in order, if one that no longer fits is left out and later ones are still tried."""
    out, held = [], 0
    for size in sizes:
        out.append(held + size <= limit)
        held += size * out[-1]
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Toxicity:
    """Train in one task on at most ``sample_rows`` labelled rows for which ``learn`` holds, the smallest id hashes first.

    Ids are chosen before any text is moved; their number is the bound of what is broadcast and of the sizes that the driver
    sees. Texts go as their distinct words, ``sample_bytes`` of these at most: a text that does not fit is left out, those
    after it are still tried. Without labelled rows of both classes every text scores 0.5, below the threshold. Null texts
    count as empty."""
    rows = (docs.filter(learn) if learn is not None else docs).select(F.col(id_col).alias("label_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    place = F.xxhash64("label_id").alias("place")
    ids = rows.select("label_id").distinct().join(labels_by_id(labels, label), "label_id").select(place, "label_id", "label").orderBy("place", "label_id").limit(sample_rows)
    chosen = stash(rows.join(F.broadcast(ids), "label_id").select("place", "label_id", "label", distinct_words(F.col("text")).alias("text")).withColumn("row", F.monotonically_increasing_id()))
    size = F.octet_length("text").alias("size")
    sizes = chosen.select("row", "place", "label_id", size, F.xxhash64("text").alias("hash")).orderBy("place", "label_id", "size", "hash", "row").limit(sample_rows).collect()
    held = [(r["row"],) for r, ok in zip(sizes, within([r["size"] for r in sizes], sample_bytes), strict=True) if ok]
    if not held:
        return Toxicity(np.zeros(ROWS, dtype=np.float32), 0.0)

    def fit(group: pa.Table) -> pa.Table:
        rows_ = sorted(zip(group["place"].to_pylist(), group["label_id"].to_pylist(), group["text"].to_pylist(), group["label"].to_pylist(), strict=True))
        values, bias = train([r[2] for r in rows_], np.array([r[3] for r in rows_]))
        return pa.table({"rows": pa.array([values.astype("<f4").tobytes()], type=pa.binary()), "bias": pa.array([bias], type=pa.float64())})

    taken = docs.sparkSession.createDataFrame(held, "row bigint")
    model = chosen.join(F.broadcast(taken), "row", "left_semi").select("place", "label_id", "text", "label", F.lit(0).alias("all")).groupBy("all").applyInArrow(fit, "rows binary, bias double").first()
    return Toxicity(np.frombuffer(model["rows"], dtype="<f4"), model["bias"])


def toxicity_score(text: Column, model: Toxicity) -> Column:
    """Score from 0 to 1 of a text column, whatever other columns there are; null counts as empty."""

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        values: dict[bytes, float] = {}
        for texts in batches:
            out = []
            for piece in pieces((t.as_py() for t in texts), PIECE_BYTES):
                bags = [set(words(t)) for t in piece]
                if new := sorted(set().union(*bags) - values.keys()):
                    if len(values) + len(new) > CACHE:
                        values = {}
                        new = sorted(set().union(*bags))
                    values.update(zip(new, model.word_values(new).tolist(), strict=True))
                out += [sum(map(values.__getitem__, bag)) / max(len(bag), 1) for bag in bags]
            odds = np.clip(np.array(out, dtype=np.float64) + model.bias, -500, 500)
            yield pa.array(1 / (1 + np.exp(-odds)), type=pa.float64())

    return score(text)


def score_toxicity(docs: DataFrame, model: Toxicity, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The id, ``score`` and ``predicted`` of every row; rows with equal ids are scored one by one, other columns are not looked at."""
    return docs.select(F.col(id_col).alias(id_col), toxicity_score(F.col(text_col), model).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
