"""Encoding, counting and packing against the tokenizer libraries."""
import base64
import random
import zlib

import numpy as np
import public_tokenizers
import regex
import tiktoken
from conftest_llm import JSON, RANKS, key
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideline.llm import bpe, packing, prefix_counts, pretokens
from tideline.llm.bpe_words import encode_words

PIECES = ["a", "Z", "é", "5", "²", " ", " ", "  ", "\n", "\t", " ", "\u0085", "'", "'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "!", "_", "中", "😀", "​", "th", "ing", " the", "՘", "<|endoftext|>", "<|endof", "\0", "\x1c"]


def some_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 12))) for _ in range(n)]


def tiktoken_ids(text):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary_batch(text)


def test_pretokens_equal_the_pattern():
    pattern = regex.compile(public_tokenizers.PATTERN)
    for k in range(400):
        group = some_texts(k % 5, k)
        cut = pretokens.split(group)
        want = [pattern.findall(t) for t in group]
        assert [cut.words[c] for c in cut.codes] == [w for ws in want for w in ws]
        assert cut.per_text.tolist() == [len(ws) for ws in want]


def test_pretokens_survive_equal_hashes(monkeypatch):
    monkeypatch.setattr(pretokens.pd, "factorize", lambda key: (np.zeros(len(key), dtype=np.int64), None))
    cut = pretokens.split(["one two three", "two"])
    assert [cut.words[c] for c in cut.codes] == ["one", " two", " three", "two"]


def test_words_with_nul_are_encoded():
    ids, counts = encode_words(RANKS, ["a\0b", "the", "\0"])
    assert ids.tolist() == [i for t in tiktoken_ids(["a\0b", "the", "\0"]) for i in t] and counts.sum() == len(ids)


def test_encode_and_decode_equal_tiktoken(docs, rows):
    got = bpe.encode(docs, RANKS).withColumn("raw", bpe.decode(F.col("ids"), RANKS)).collect()
    want = sorted(key(r[0], np.array(ids, dtype="<u4").tobytes(), (r[1] or "").encode()) for r, ids in zip(rows, tiktoken_ids([r[1] or "" for r in rows])))
    assert sorted(key(r["doc_id"], bytes(r["ids"]), bytes(r["raw"])) for r in got) == want


def test_encode_in_small_blocks(docs, rows):
    got = bpe.encode(docs, RANKS, block_chars=50).collect()
    want = sorted(key(r[0], np.array(ids, dtype="<u4").tobytes()) for r, ids in zip(rows, tiktoken_ids([r[1] or "" for r in rows])))
    assert sorted(key(r["doc_id"], bytes(r["ids"])) for r in got) == want


def test_varints():
    numbers, size = bpe.to_varints(np.array([0, 127, 128, 16383, 16384, 1 << 21]))
    assert bpe.from_varints(numbers).tolist() == [0, 127, 128, 16383, 16384, 1 << 21] and size.tolist() == [1, 1, 2, 2, 3, 4]


def test_decode_nulls_and_unknown_ids(spark):
    frame = spark.createDataFrame([(None,), (b"",)], "ids binary")
    assert [r[0] for r in frame.select(bpe.decode(F.col("ids"), RANKS)).collect()] == [None, b""]
    bad = spark.createDataFrame([(b"\xff\xff\xff\x00",)], "ids binary")
    try:
        bad.select(bpe.decode(F.col("ids"), RANKS)).collect()
    except Exception as error:  # noqa: BLE001
        assert "not in the vocabulary" in str(error)
    else:
        raise AssertionError


def test_prefix_counts_equal_the_library_at_every_prefix():
    library = Tokenizer.from_file(JSON)
    for text in [*some_texts(250, 9), "don't 'tis we'll  \n x", "՘՘a"]:
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        counts = prefix_counts.prefix_counts([text], JSON)[0]
        assert counts.tolist() == want
        for limit in (0, 2, 5):
            assert prefix_counts.longest_within(counts, limit) == max(i for i, n in enumerate(want) if n <= limit)


def test_token_counts(docs, rows):
    library = Tokenizer.from_file(JSON)
    got = prefix_counts.token_counts(docs, JSON, limit=50).collect()
    want = []
    for r in rows:
        n = len(library.encode(r[1] or "", add_special_tokens=False).ids)
        want.append(key(r[0], len((r[1] or "").encode()), n, n > 50))
    assert sorted(key(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted(want)


def test_stored_counts(docs):
    got = docs.filter("doc_id < 20").select("text", prefix_counts.stored_counts(F.col("text"), JSON).alias("n")).collect()
    assert all(len(r["n"]) == len(r["text"] or "") + 1 for r in got)


def check_packing(got, rows, capacity=1024):
    library = Tokenizer.from_file(JSON)
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [2]
        bounds = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        want += [key(r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]
    assert sorted(key(*(r[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32"))) for r in got) == sorted(want)
    at = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= capacity
    return len(at), sum(at.values())


def test_packing(docs, rows):
    sequences, tokens = check_packing(packing.pack(docs, JSON).collect(), rows)
    assert sequences <= -(-tokens // 1024) + 2
    small, _ = check_packing(packing.pack(docs, JSON, capacity=16).collect(), rows, 16)
    assert small >= sequences


def test_packing_keeps_ids(docs):
    for r in packing.pack(docs.filter("doc_id < 16"), JSON, keep_ids=True).collect():
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]


def test_plans_use_up_the_histogram():
    rng = np.random.default_rng(1)
    for high, n in ((1025, 5000), (40, 3000), (1025, 30), (700, 1)):
        histogram = np.bincount(rng.integers(1, high, n), minlength=1025)
        plan = packing.plan_patterns(histogram)
        used = sum(times * np.bincount(row, minlength=1025) for row, times in plan)
        assert (used == histogram).all() and all(sum(row) <= 1024 for row, _ in plan)
        total = (histogram * np.arange(1025)).sum()
        assert sum(times for _, times in plan) <= -(-total // 1024) * 1.05 + 2


def test_empty_tables(no_docs):
    assert bpe.encode(no_docs, RANKS).count() == 0
    assert prefix_counts.token_counts(no_docs, JSON).count() == 0
    assert packing.pack(no_docs, JSON).count() == 0
