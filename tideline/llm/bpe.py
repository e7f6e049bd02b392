"""Byte-level BPE: every distinct pre-token is encoded once, and documents are put together again by position.

Texts are taken in blocks of bounded size. A block sends its distinct pre-tokens, dealt to buckets by hash, and per document
the sequence of their places in the block (frequent ones have small places, so a position costs little more than a byte).
All copies of a pre-token meet in one bucket and are encoded there once; ids go back to the blocks, where positions are
replaced by ids. Texts are cut twice, once for the pre-tokens and once for the sequences, so that sequences travel once.
Blocks are numbered by task and order: ``docs`` has to come in a repeatable order, as from files.
"""
from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tideline.llm.bpe_words import WordTable, encode_words, ragged, read_ranks
from tideline.llm.common import pieces
from tideline.llm.pretokens import split

#: Characters of text in a block.
BLOCK = 3 << 20
#: Bytes of ids decoded at once.
DECODE_BYTES = 2 << 20


def squeeze(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(array).tobytes())


def unsqueeze(raw: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=dtype)


def to_varints(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits per byte, low ones first, and how many bytes each number takes; numbers below 2**28."""
    size = 1 + (numbers >= 1 << 7) + (numbers >= 1 << 14) + (numbers >= 1 << 21)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for k in range(4):
        have = size > k
        part = (numbers[have] >> (7 * k)) & 127
        out[(ends - size)[have] + k] = part | np.where(size[have] > k + 1, 128, 0)
    return out, size


def from_varints(raw: np.ndarray) -> np.ndarray:
    last = raw < 128
    ends = np.flatnonzero(last) + 1
    size = np.diff(ends, prepend=0)
    out = np.zeros(len(ends), dtype=np.int64)
    for k in range(4):
        have = size > k
        out[have] |= (raw[(ends - size)[have] + k] & 127).astype(np.int64) << (7 * k)
    return out


def binaries(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary array of runs of one flat array."""
    offsets = np.concatenate([[0], np.cumsum(counts)]) * flat.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def _blocks(buckets: int, names: list[str], block_chars: int, words_only: bool):
    """Of each block either a row for every bucket that has pre-tokens of it, or a row for each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            done = 0
            for texts in pieces((t.as_py() for t in batch.column(1)), block_chars):
                found = split(texts)
                block += 1
                n = len(found.words)
                order = np.argsort(-np.bincount(found.codes, minlength=n), kind="stable")
                if words_only:
                    words = [found.words[k].encode("utf-8", "surrogatepass") for k in order.tolist()]
                    sizes = np.fromiter(map(len, words), dtype=np.uint32, count=n)
                    to = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=n) % buckets
                    by = np.argsort(to, kind="stable")
                    rows = []
                    for own in np.split(by, np.flatnonzero(np.diff(to[by])) + 1) if n else []:
                        text = np.frombuffer(b"".join([words[k] for k in own.tolist()]), dtype=np.uint8)
                        rows.append((int(to[own[0]]), block, squeeze(text), squeeze(sizes[own]), squeeze(to_varints(np.diff(own, prepend=0))[0])))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*rows, strict=True)], names=names)
                else:
                    place = np.empty(n, dtype=np.int64)
                    place[order] = np.arange(n)
                    raw, size = to_varints(place[found.codes])
                    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(found.per_text)])]
                    m = len(texts)
                    yield pa.RecordBatch.from_arrays([pa.array([block] * m, type=pa.int64()), batch.column(0).slice(done, m), binaries(raw, np.diff(ends))], names=names)
                    done += m

    return cut


def _encode(path: str):
    """The pre-tokens of each row replaced by their ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(functools.partial(encode_words, path), np.uint32)
        for batch in batches:
            payload, sizes = [], []
            for text, lengths in zip(batch.column("payload").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                raw, ends = unsqueeze(text, np.uint8).tobytes(), np.cumsum(unsqueeze(lengths, np.uint32)).tolist()
                at = table.places([raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends], ends, strict=False)])
                payload.append(squeeze(table.flat[ragged(table.starts[at], table.counts[at])].astype(np.uint32)))
                sizes.append(squeeze(table.counts[at].astype(np.uint16)) if table.counts[at].max() < 1 << 16 else squeeze(table.counts[at].astype(np.uint32)))
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"payload": pa.array(payload, type=pa.binary()), "sizes": pa.array(sizes, type=pa.binary())}
            yield pa.RecordBatch.from_arrays([columns[n] for n in ("block", "payload", "sizes", "places")], names=["block", "payload", "sizes", "places"])

    return encode


def _reassemble(id_col: str):
    def join(words: pa.Table, texts: pa.Table) -> pa.Table:
        flat, counts, places = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for ids, sizes, steps in zip(words["payload"].to_pylist(), words["sizes"].to_pylist(), words["places"].to_pylist(), strict=True):
            flat.append(unsqueeze(ids, np.uint32))
            places.append(np.cumsum(from_varints(unsqueeze(steps, np.uint8))))
            raw = unsqueeze(sizes, np.uint8)
            counts.append(raw.view(np.uint16 if len(raw) == 2 * len(places[-1]) else np.uint32).astype(np.int64))
        flat, counts, order = np.concatenate(flat), np.concatenate(counts), np.argsort(np.concatenate(places))
        starts = (np.cumsum(counts) - counts)[order]
        counts = counts[order]
        done, raw = [], texts["payload"].to_pylist()
        for at in range(0, len(raw), 512):
            part = raw[at:at + 512]
            codes = from_varints(np.frombuffer(b"".join(part), dtype=np.uint8))
            per_text = np.array([int(np.count_nonzero(np.frombuffer(r, dtype=np.uint8) < 128)) for r in part], dtype=np.int64)
            sizes = counts[codes]
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(per_text)]
            done.append(binaries(flat[ragged(starts[codes], sizes)].astype("<u4"), np.diff(ends, prepend=0)))
        return pa.table({id_col: texts[id_col], "ids": pa.chunked_array(done, type=pa.binary())})

    return join


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK) -> DataFrame:
    """The id and ``ids`` (little-endian unsigned 32-bit integers) of every row, by the rank file at ``path``.

    Null and empty texts have no ids (an empty binary). Rows with equal ids are encoded one by one, other columns are not
    looked at, an empty table gives an empty table. Special tokens are ordinary text.
    """
    field = docs.schema[id_col]
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    binary = lambda *names: [T.StructField(n, T.BinaryType()) for n in names]
    block = T.StructField("block", T.LongType())
    words = T.StructType([T.StructField("bucket", T.LongType()), block, *binary("payload", "sizes", "places")])
    texts = T.StructType([block, T.StructField(id_col, field.dataType), *binary("payload")])
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    sent = rows.mapInArrow(_blocks(buckets, words.names, block_chars, True), words).repartitionById(buckets, F.col("bucket").cast("int"))
    encoded = sent.mapInArrow(_encode(path), T.StructType([block, *binary("payload", "sizes", "places")]))
    sequences = rows.mapInArrow(_blocks(buckets, texts.names, block_chars, False), texts)
    met = encoded.groupBy("block").cogroup(sequences.groupBy("block"))
    return met.applyInArrow(_reassemble(id_col), T.StructType([T.StructField(id_col, field.dataType), T.StructField("ids", T.BinaryType())]))


@functools.lru_cache(2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes, and each id's start and size (-1: no such id)."""
    ranks = read_ranks(path)
    sizes = np.full(max(ranks.values()) + 1, -1, dtype=np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    filled = np.maximum(sizes, 0)
    return np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), dtype=np.uint8), np.cumsum(filled) - filled, sizes


def decode(ids: Column, path: str) -> Column:
    """Binary column: the bytes of the tokens of a binary column of ids, looked up in the vocabulary's token-byte table.

    Null stays null, no ids give no bytes; an id outside the vocabulary is an error."""

    @arrow_udf("binary")
    def join(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        flat, starts, sizes = _token_bytes(path)
        for column in batches:
            rows, done, at = column.to_pylist(), [], 0
            while at < len(rows):
                to, held = at, 0
                while to < len(rows) and (to == at or held + len(rows[to] or b"") <= DECODE_BYTES):
                    held += len(rows[to] or b"")
                    to += 1
                codes = np.frombuffer(b"".join([r or b"" for r in rows[at:to]]), dtype="<u4")
                if len(codes) and (codes.max() >= len(sizes) or sizes[codes].min() < 0):
                    raise ValueError("an id is not in the vocabulary")
                size = sizes[codes]
                ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum(np.array([len(r or b"") // 4 for r in rows[at:to]], dtype=np.int64))]
                done.append(binaries(flat[ragged(starts[codes], size)], np.diff(ends, prepend=0)))
                at = to
            out = pa.concat_arrays(done) if done else pa.array([], type=pa.binary())
            yield pa.compute.if_else(column.is_valid(), out, pa.scalar(None, type=pa.binary()))

    return join(ids)
