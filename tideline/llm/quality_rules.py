"""Quality rules whose cutoffs carry a guarantee on clean documents that they reject.

Each rule compares one number of a document with a cutoff: higher numbers fail. For every stratum and rule the labelled
documents are counted per cutoff by Spark. A cutoff is certified if the exact (Clopper-Pearson) upper bound of the share of
clean documents beyond it stays within the rule's part of ``risk``. Cutoffs are tested from lenient to strict and testing
stops at the first that fails (fixed sequence), so a rule spends its error probability once; over rules and strata it is
divided (Bonferroni). With probability 1 - ``error`` no stratum loses more than ``risk`` of its clean documents.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tideline.llm.common import labels_by_id, stash
from tideline.llm.stats import SQL_TYPE, stats_array

MIN_WORDS = 50
#: Highest share of clean documents of a stratum that all rules together may reject, and the chance that this is broken.
RISK, ERROR = 0.02, 0.05
#: A clean document that is rejected weighs as much as so many junk documents that are kept.
WEIGHT = 20.0
#: Strata table rows up to which it is sent to every task; beyond it Spark joins by shuffle.
SMALL_TABLE = 20_000
#: Cutoffs of a rule: the i-th of them, from lenient to strict, fails numbers above 1 - i / CUTOFFS.
CUTOFFS = 50


def document_stats(text: Column) -> Column:
    """Struct column of a text column's statistics."""

    @arrow_udf(SQL_TYPE)
    def stats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield stats_array(texts)

    return stats(text)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.least(part / whole, F.lit(1.0))).otherwise(F.lit(0.0))


def rules(stats: str = "stats") -> dict[str, Column]:
    """The rules' numbers, each from 0 (clean) to 1."""
    s = lambda name: F.col(f"{stats}.{name}").cast("double")
    return {
        "symbols": _share(s("n_symbols"), s("word_chars")),
        "repeats": _share(s("n_repeat_words"), s("n_words")),
        "dup_lines": _share(s("n_dup_lines"), s("n_lines")),
        "shouting": _share(s("n_upper"), s("n_words")),
        "marks": _share(s("n_marks"), s("n_words")),
    }


def first_failed(number: Column) -> Column:
    """Index of the most lenient cutoff that the number fails; CUTOFFS if it fails none."""
    return F.least(F.floor((1 - number) * CUTOFFS).cast("int") + 1, F.lit(CUTOFFS))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return total


def binomial_tail(k: int, n: int, p: float) -> float:
    """Probability of at most ``k`` successes in ``n`` trials of chance ``p``."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def certified(k: int, n: int, risk: float, error: float) -> bool:
    """Whether the exact upper bound at level ``error`` for the chance behind ``k`` of ``n`` is at most ``risk``."""
    return n > 0 and binomial_tail(k, n, risk) <= error


def choose_cutoff(clean: np.ndarray, junk: np.ndarray, risk: float, error: float, weight: float = WEIGHT) -> int | None:
    """Index of the grid cutoff to use, or None.

    ``clean`` and ``junk`` hold document counts by the first grid cutoff that a document exceeds; the last entry counts those
    that exceed none. Of the certified cutoffs the one that gains most wins; ties go to the more lenient one.
    """
    n, m = int(clean.sum()), int(junk.sum())
    best, gain, lost, caught = None, 0.0, 0, 0
    for i in range(len(clean) - 1):
        lost, caught = lost + int(clean[i]), caught + int(junk[i])
        if not certified(lost, n, risk, error):
            break
        value = caught / max(m, 1) - weight * lost / n
        if value > gain:
            best, gain = i, value
    return best


def fit_cutoffs(measured: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Certified cutoffs per stratum: columns stratum, rule, cutoff, n_clean, n_lost.

    ``measured`` has the id, ``stratum`` and ``stats``; ``labels`` label_id and label (1: clean). A stratum with too few clean
    documents to certify anything has no row, so none of its documents is rejected by a rule. Null is a stratum of its own.
    """
    names = list(rules())
    numbers = measured.select(F.col(id_col).alias("label_id"), "stratum", *[first_failed(c).alias(n) for n, c in rules().items()])
    labelled = numbers.join(labels, "label_id")
    counts = (
        labelled.select("stratum", "label", F.posexplode(F.array(*names)).alias("rule", "bin"))
        .groupBy("stratum", "rule", "label", "bin").agg(F.count("*").alias("n"))
    )
    strata = labelled.agg(F.count_distinct(F.coalesce(F.concat(F.lit("="), F.col("stratum")), F.lit("")))).first()[0]
    part, chance = risk / len(names), error / (len(names) * max(strata, 1))

    def choose(group: pa.Table) -> pa.Table:
        by = np.zeros((2, CUTOFFS + 1), dtype=np.int64)
        np.add.at(by, (group["label"].to_numpy(), group["bin"].to_numpy()), group["n"].to_numpy())
        at = choose_cutoff(by[1], by[0], part, chance)
        found = {"stratum": group["stratum"][0].as_py(), "rule": names[group["rule"][0].as_py()], "cutoff": at, "n_clean": by[1].sum(), "n_lost": by[1][: (at or 0) + 1].sum()}
        return pa.Table.from_pylist([found] if at is not None else [], schema=schema)

    schema = pa.schema([("stratum", pa.string()), ("rule", pa.string()), ("cutoff", pa.int32()), ("n_clean", pa.int64()), ("n_lost", pa.int64())])
    return counts.groupBy("stratum", "rule").applyInArrow(choose, "stratum string, rule string, cutoff int, n_clean bigint, n_lost bigint")


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", label: str = "quality", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Statistics, failed rules and verdict of every row of ``docs``.

    Columns: the id, ``stats`` (see ``stats.FIELDS``), ``base_failed`` (fewer than 50 words, or more than half of them in
    repeated windows), ``failed`` (names of certified rules that the document breaks, sorted) and ``kept``. A null or empty
    text has zero statistics and fails the base rule. Rows with equal ids are judged one by one; a null id is kept as it is
    and never meets a label. Without labels, or with too few, only the base rule rejects. Other columns of ``docs`` are not
    looked at; an empty table gives an empty table.
    """
    stratum = F.col(stratum_col).cast("string") if stratum_col else F.lit("all")
    measured = stash(docs.select(F.col(id_col).alias(id_col), stratum.alias("stratum"), document_stats(F.col(text_col)).alias("stats")))
    cutoffs = fit_cutoffs(measured, labels_by_id(labels, label), id_col=id_col, risk=risk, error=error)
    wide = stash(cutoffs.groupBy(F.col("stratum").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts")))
    if wide.limit(SMALL_TABLE + 1).count() <= SMALL_TABLE:
        wide = F.broadcast(wide)
    broken = F.array_compact(F.array(*[F.when(first_failed(c) <= F.col("cuts")[n], F.lit(n)) for n, c in sorted(rules().items())]))
    words, repeats = F.col("stats.n_words"), F.col("stats.n_repeat_words")
    judged = measured.join(wide, F.col("stratum").eqNullSafe(F.col("of")), "left").select(
        id_col, "stratum", "stats", ((words < MIN_WORDS) | (100 * repeats > 50 * words)).alias("base_failed"), F.when(F.col("cuts").isNull(), F.array().cast("array<string>")).otherwise(broken).alias("failed"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
