"""Quality of a text by a regularised quadratic discriminant over transformed statistics of it.

Class means and covariances come from sums over all labelled rows, gathered per partition. Each covariance is shrunk towards
the pooled one and towards its own diagonal; its Cholesky factor is made once and kept with the model. The score is the
logistic function of the difference of the two log densities (Mahalanobis distance and log determinant).
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tideline.llm.common import labels_by_id
from tideline.llm.stats import FIELDS, text_stats

#: Features of the discriminant, see ``features``.
NAMES = ("length", "symbols", "repeats", "dup_lines", "shouting", "marks", "word_length", "variety", "stops", "alpha")
#: Weight of the pooled covariance, of the diagonal, and the least variance of a feature (all features lie in about 0 to 2).
POOLED, DIAGONAL, FLOOR = 0.5, 0.1, 0.01
THRESHOLD = 0.3


def features(text: str | None) -> np.ndarray:
    """Transformed statistics; an empty text has zero counts and so a defined vector."""
    s = dict(zip(FIELDS, map(float, text_stats(text)), strict=True))
    words, chars = max(s["n_words"], 1.0), max(s["word_chars"], 1.0)
    root = lambda part, whole: min(1.0, part / whole) ** 0.5
    return np.array([
        np.log1p(s["n_words"]) / 8, root(s["n_symbols"], chars), root(s["n_repeat_words"], words), root(s["n_dup_lines"], max(s["n_lines"], 1.0)),
        root(s["n_upper"], words), root(s["n_marks"], chars), np.log1p(chars / words) / 2, np.log1p(s["n_distinct"]) / np.log1p(words), root(s["n_stops"], chars), root(s["n_alpha_words"], words),
    ])


def matrix(texts: pa.Array) -> np.ndarray:
    return np.array([features(t.as_py()) for t in texts]).reshape(-1, len(NAMES))


def feature_column(text: Column) -> Column:
    """Array column of a text column's features."""

    @arrow_udf("array<double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = matrix(texts)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    return of(text)


@dataclass(frozen=True)
class Discriminant:
    """Log prior odds, and per class (0, 1) the mean, the inverse Cholesky factor and the log determinant."""
    prior: float
    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        logs = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.logdets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(self.prior + logs[1] - logs[0], -500, 500)))


def discriminant(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> Discriminant | None:
    """The model from per-class counts, sums and sums of outer products; None unless both classes have rows."""
    if (counts < 1).any():
        return None
    means = sums / counts[:, None]
    own = squares / counts[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (own * counts[:, None, None]).sum(axis=0) / counts.sum()
    factors, logdets = [], []
    for n, cov in zip(counts, own, strict=True):
        weight = max(POOLED * len(cov) / (n + len(cov)), 0.02)
        cov = (1 - weight) * cov + weight * pooled
        cov = (1 - DIAGONAL) * cov + DIAGONAL * np.diag(np.diag(cov)) + FLOOR * np.eye(len(cov))
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        logdets.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(float(np.log(counts[1] / counts[0])), means, np.array(factors), np.array(logdets))


def fit_quality(docs: DataFrame, labels: DataFrame, *, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> Discriminant | None:
    """Fit on all labelled rows of ``docs`` for which ``learn`` holds; None if a class has no row.

    Features are computed where the texts are; only they are joined with the labels. Rows without an id or with contradicting
    labels teach nothing; repeated rows count as often as they occur.
    """
    rows = docs.filter(learn) if learn is not None else docs
    rows = rows.select(F.col(id_col).alias("label_id"), feature_column(F.col(text_col)).alias("x")).join(labels_by_id(labels, label), "label_id").select("x", "label")
    wide, d = 1 + len(NAMES) + len(NAMES) ** 2, len(NAMES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, wide))
        for batch in batches:
            x, y = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d), batch.column(1).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], type=pa.int32()), pa.array(total.tolist(), type=pa.list_(pa.float64()))], names=["label", "sums"])

    parts = rows.mapInArrow(sums, "label int, sums array<double>").select("label", F.posexplode("sums").alias("at", "x"))
    found = parts.groupBy("label", "at").agg(F.sum("x").alias("x")).collect()  # 2 x 111 numbers
    total = np.zeros((2, wide))
    for row in found:
        total[row["label"], row["at"]] = row["x"]
    return discriminant(total[:, 0], total[:, 1:1 + d], total[:, 1 + d:].reshape(2, d, d))


def quality_score(text: Column, model: Discriminant | None) -> Column:
    """Score from 0 to 1 of a text column, whatever other columns there are; 0.5 for every text if there is no model."""
    if model is None:
        return F.lit(0.5)

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.scores(matrix(texts)) if len(texts) else [], type=pa.float64())

    return score(text)


def score_quality(docs: DataFrame, model: Discriminant | None, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The id, ``score`` and ``predicted`` of every row; null texts count as empty, which have a score as well."""
    return docs.select(F.col(id_col).alias(id_col), quality_score(F.col(text_col), model).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
