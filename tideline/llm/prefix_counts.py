"""Exact token counts of every prefix of a text, by dynamic programming over byte-level BPE.

Within a pre-token the last token of each prefix's encoding is the one token that ends there and stands in a valid pair with
the last token of the prefix before it; the count is that prefix's count plus one. Prefixes of a text add the counts of the
pre-tokens before. A prefix may be cut into pre-tokens differently at its very end; both such cases (a run of white space
that is followed by other text, and the first letter of a contraction of two) are corrected. With the counts stored, the
number of tokens, the place to truncate at and every question about a budget are look-ups.
"""
from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tideline.llm.bpe_words import WordTable, encode_words, library, ragged, read_ranks, segments
from tideline.llm.common import PIECE_BYTES, pieces
from tideline.llm.pretokens import SPACE, Pieces, split

LIMIT = 512


class PrefixProgram:
    """The dynamic programme of one vocabulary; it keeps which tokens and pairs of tokens the merges reproduce."""

    def __init__(self, path: str):
        self.path, self.ranks = path, read_ranks(path)
        self.tokens = {i: b for b, i in self.ranks.items()}
        self.lengths: dict[bytes, list[int]] = {}  # of tokens of four bytes or more, by their last four
        for token in sorted(self.ranks, key=len, reverse=True):
            if len(token) >= 4 and len(token) not in (known := self.lengths.setdefault(token[-4:], [])):
                known.append(len(token))
        self.singles: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}

    @functools.cached_property
    def _encode(self):
        import tiktoken

        return tiktoken.Encoding(f"bytes of {self.path}", pat_str=r"(?s:.+)", mergeable_ranks=self.ranks, special_tokens={})._encode_single_piece

    def _pair(self, a: int, b: int) -> bool:
        key = a << 32 | b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self._encode(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def _single(self, a: int) -> bool:
        if (known := self.singles.get(a)) is None:
            known = self.singles[a] = self._encode(self.tokens[a]) == [a]
        return known

    def extend(self, word: bytes, last: list[int], count: list[int]) -> None:
        """Go on from the prefixes whose last tokens and counts are given to the whole pre-token."""
        ranks, lengths, pairs = self.ranks, self.lengths, self.pairs
        for end in range(len(last), len(word) + 1):
            for size in (*lengths.get(word[end - 4:end], ()), 3, 2, 1) if end > 3 else (3, 2, 1):
                start = end - size
                if start < 0 or (token := ranks.get(word[start:end])) is None:
                    continue
                if start:
                    known = pairs.get(last[start] << 32 | token)
                    if known or known is None and self._pair(last[start], token):
                        break
                elif self._single(token):
                    break
            last.append(token)
            count.append(count[start] + 1)

    def counts(self, word: bytes) -> list[int]:
        """Tokens of each prefix of a pre-token, by bytes; the first is the empty prefix."""
        last, count = [-1], [0]
        self.extend(word, last, count)
        return count

    def profiles(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of each word's prefixes by code points, without the empty one, in one array; and the words' code points.

        Words are taken in byte order, so that what a word shares with the one before is not computed again."""
        raws = [w.encode("utf-8", "surrogatepass") for w in words]
        done: list[list[int]] = [[]] * len(words)
        last, count, before = [-1], [0], b""
        for i in sorted(range(len(words)), key=raws.__getitem__):
            raw, same = raws[i], 0
            for a, b in zip(raw, before):  # noqa: B905
                if a != b:
                    break
                same += 1
            del last[same + 1:], count[same + 1:]
            self.extend(raw, last, count)
            done[i], before = count[1:], raw
        flat = np.fromiter((n for counts in done for n in counts), dtype=np.int32)
        joined = np.frombuffer(b"".join(raws), dtype=np.uint8)
        final = np.ones(len(joined), dtype=bool)  # a code point's last byte: the next byte begins one
        final[:-1] = (joined[1:] & 0xC0) != 0x80
        return flat[final], np.fromiter(map(len, words), dtype=np.int64, count=len(words))


@functools.lru_cache(2)
def _program(path: str) -> tuple[PrefixProgram, WordTable]:
    program = PrefixProgram(path)
    return program, WordTable(program.profiles, np.int32)


def _profile(cut: Pieces, parts: list[str], path: str) -> np.ndarray:
    """Tokens of each part's prefixes that end behind each code point, for all parts in one array."""
    program, table = _program(path)
    _, kinds, _ = library(path)
    places = table.places(cut.words)
    at = places[cut.codes]
    sizes = table.counts[at]
    inner = table.flat[ragged(table.starts[at], sizes)]
    ends = np.cumsum(sizes)
    totals = inner[ends - 1]
    upto = np.concatenate([[0], np.cumsum(totals, dtype=np.int64)])
    first = np.cumsum(cut.per_text) - cut.per_text
    before = upto[:-1] - np.repeat(upto[first], cut.per_text)
    out = inner + np.repeat(before, sizes)
    # Runs of two white spaces or more before other text: as the end of a prefix, they are one pre-token.
    space = kinds(np.fromiter((ord(w[-1]) for w in cut.words), dtype=np.uint32, count=len(cut.words))) == SPACE
    lone = np.array([len(w) == 1 or w[0] == " " and not s for w, s in zip(cut.words, space, strict=True)], dtype=bool)
    own = np.repeat(np.arange(len(parts)), cut.per_text)
    follow = np.flatnonzero(space[cut.codes[:-1]] & lone[cut.codes[1:]] & (own[1:] == own[:-1])) if len(own) > 1 else np.zeros(0, dtype=int)
    for k in follow.tolist():
        nxt = cut.words[cut.codes[k + 1]]
        if nxt[0] == " " or space[cut.codes[k + 1]]:
            run = cut.words[cut.codes[k]] + nxt[0]
            out[ends[k]] = before[k] + program.counts(run.encode("utf-8", "surrogatepass"))[-1]
    # 're, 've, 'll: as the end of a prefix, the apostrophe and the first letter are two pre-tokens.
    short = np.array([w in ("'re", "'ve", "'ll") for w in cut.words], dtype=bool)
    for k in np.flatnonzero(short[cut.codes]).tolist():
        out[ends[k] - 2] = before[k] + 2
    return out


def prefix_counts(texts: list[str], path: str) -> list[np.ndarray]:
    """For each text, the number of tokens of its first 0, 1, 2 ... code points, special strings being one token once complete.

    Inside a special string the counts are those of the characters read so far."""
    _, kinds, special = library(path)
    if any(s in t for t in texts for s in special):
        return [_with_specials(t, path, special) if any(s in t for s in special) else prefix_counts([t], path)[0] for t in texts]
    cut = split(texts, kinds)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    flat = _profile(cut, texts, path) if len(cut.codes) else np.zeros(0, dtype=np.int64)
    return [np.concatenate([[0], part]) for part in np.split(flat, np.cumsum(sizes)[:-1])]


def _with_specials(text: str, path: str, special: dict[str, int]) -> np.ndarray:
    parts, before = segments([text], special)
    tokens = {i: s for s, i in special.items()}
    out, total, clean = [np.zeros(1, dtype=np.int64)], 0, ""
    for k, part in enumerate(parts):
        if k:
            mark = tokens[before[k]]
            run = prefix_counts_plain(clean + mark[:-1], path)[len(clean) + 1:]
            out += [run + total, np.array([total + (prefix_counts_plain(clean, path)[-1] if clean else 0) + 1])]
            total, clean = int(out[-1][0]), ""
        counts = prefix_counts_plain(part, path)
        out.append(counts[1:] + total)
        clean = part
    return np.concatenate(out)


def prefix_counts_plain(text: str, path: str) -> np.ndarray:
    """Counts of a text's prefixes that has no special string."""
    cut = split([text], library(path)[1])
    return np.concatenate([[0], _profile(cut, [text], path) if len(cut.codes) else np.zeros(0, dtype=np.int64)])


def longest_within(counts: np.ndarray, limit: int) -> int:
    """Code points of the longest prefix of at most ``limit`` tokens."""
    return int(np.flatnonzero(counts <= limit)[-1])


def stored_counts(text: Column, path: str) -> Column:
    """Array column: tokens of the first 0, 1, 2 ... code points; null counts as empty."""

    @arrow_udf("array<int>")
    def store(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [c for piece in pieces((t.as_py() for t in texts), PIECE_BYTES // 2) for c in prefix_counts(piece, path)]
            yield pa.array(rows, type=pa.list_(pa.int32()))

    return store(text)


def answers(text: Column, path: str, limit: int) -> Column:
    """Struct column from the counts of all prefixes: n_tokens, and keep_chars, the longest prefix of at most ``limit`` tokens."""

    @arrow_udf("struct<n_tokens:bigint,keep_chars:bigint>")
    def answer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [(int(c[-1]), longest_within(c, limit)) for piece in pieces((t.as_py() for t in texts), PIECE_BYTES // 2) for c in prefix_counts(piece, path)]
            both = np.array(rows, dtype=np.int64).reshape(-1, 2)
            yield pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["n_tokens", "keep_chars"])

    return answer(text)


def token_counts(docs: DataFrame, path: str, *, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_bytes, n_tokens, over_limit and keep_chars (code points of the longest prefix within the limit) of every row.

    Null and empty texts have no bytes and no tokens. Rows with equal ids are counted one by one, other columns are not looked
    at, an empty table gives an empty table. ``path`` names a .json file of the tokenizers library that every executor has.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(F.col(id_col).alias(id_col), F.octet_length(text).cast("bigint").alias("n_bytes"), answers(text, path, limit).alias("a"))
        .select(id_col, "n_bytes", "a.n_tokens", (F.col("a.n_tokens") > limit).alias("over_limit"), "a.keep_chars")
    )


__all__ = ["LIMIT", "PrefixProgram", "answers", "encode_words", "longest_within", "prefix_counts", "stored_counts", "token_counts"]
