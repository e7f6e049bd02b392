"""The corpus operators applied to whole tables, one query each."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import bpe, context_tree, embedding_dedup, hard_negatives, packing, pii, prefix_counts, quality_classifier, quality_rules, simhash, spelling, toxicity, url_filter
from tideline.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), path)
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids"), path), 256).alias("decoded_sha256"))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    base = [F.col(f"stats.{n}").alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *base, "base_failed", "kept", F.array_join("failed", ",").alias("failed_rules"))


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda *kinds: lambda s: s["kind"].isin(*kinds)
    base = F.filter("spans", of(*pii.BASE))
    counts = [F.size(F.filter("spans", of(kind))).cast("bigint").alias(f"n_{kind}") for kind in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = context_tree.score_texts(table(spark, sf_dir, "documents"), learn=fold("doc_id", 7) != 2)
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", (-F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), learn=fold("doc_id", 3) != 1)
    return toxicity.score_toxicity(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_dedup.embedding_groups(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLES["op6_embedding_dedup"] = """
WITH RECURSIVE v AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(r.b, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(r.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN least r ON r.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
"""


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit_quality(docs, table(spark, sf_dir, "labels"), learn=fold("doc_id", 5) != 0)
    return quality_classifier.score_quality(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


ORACLES["op11_hard_negatives"] = """
WITH v AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
    SELECT a.id AS anchor, b.id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.id <> b.id AND len(a.q) = len(b.q) WHERE a.id % 100 = 0
),
positives AS (SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
found AS (
    SELECT p.anchor AS anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
        n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM positives p JOIN pairs n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
)
SELECT * FROM found WHERE rank <= 5
"""


@query
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.Rule(verdict, at) for verdict, at in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))]
    pages = table(spark, sf_dir, "pages")
    rule = url_filter.rule_of(*url_filter.host_and_path(F.col("url")), rules)
    ruled = pages.select("url", (url_filter.rule_verdict(rule, rules) == url_filter.BLOCK).cast("int").alias("label"))
    return url_filter.url_filter(pages, rules, url_filter.fit_urls(ruled))


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tokens = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(spelling.runs(F.col("text"))).alias("run"))
    tokens = tokens.withColumn("h", F.crc32(F.concat_ws(":", "doc", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", 1, at), F.substring(F.col("run"), at + 2, F.length("run")))
    return spelling.spelling_variants(tokens.select(F.when(F.col("h") % 97 == 0, cut).otherwise(F.col("run")).alias("word")))


ORACLES["op13_spelling"] = """
WITH RECURSIVE steps AS (
    SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
),
runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc,
        unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS run
    FROM documents
),
counted AS (SELECT doc, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (
    SELECT run, n, flatten(list_transform(range(1, length(doc || ':' || run) + 1),
        lambda i: CASE WHEN unicode((doc || ':' || run)[i]) < 128 THEN [unicode((doc || ':' || run)[i])::BIGINT]
            ELSE [192 + (unicode((doc || ':' || run)[i])::BIGINT >> 6), 128 + unicode((doc || ':' || run)[i])::BIGINT % 64] END)) AS b
    FROM counted
),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, crc[xor(c, x) % 256 + 1])), 4294967295) AS h FROM bytes, steps),
changed AS (SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n AS times FROM hashed),
words AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM changed GROUP BY word HAVING length(word) >= 5 AND sum(times) >= 3),
cut AS MATERIALIZED (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS MATERIALIZED (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM words a JOIN cut b ON a.word = b.rest
    UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS other, max(other_n) AS other_n FROM near GROUP BY word),
forms AS MATERIALIZED (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END::BIGINT AS form_n
    FROM words LEFT JOIN best USING (word)
),
walk AS (
    SELECT word, word AS reached, 0 AS step FROM forms
    UNION ALL SELECT w.word, f.form, w.step + 1 FROM walk w JOIN forms f ON f.word = w.reached WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN (SELECT word, arg_max(reached, step) AS root FROM walk GROUP BY word) r USING (word)
"""
