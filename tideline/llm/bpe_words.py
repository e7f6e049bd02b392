"""Ids of distinct pre-tokens under a byte-level BPE vocabulary, for array code."""
from __future__ import annotations

import base64
import functools
import json
from collections.abc import Callable

import numpy as np
import tiktoken

from tideline.llm.pretokens import LibraryKinds, Pieces, regex_kinds, split

#: Pre-tokens that a process remembers at most.
CACHE = 400_000


def _alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files of byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes of every token and its id, from a .tiktoken rank file or a .json vocabulary (without its special tokens)."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        special, letters = {t["content"] for t in file["added_tokens"]}, _alphabet()
        return {bytes(letters[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.lru_cache(4)
def encoder(path: str) -> tiktoken.Encoding:
    """Merges whatever stands between two NUL characters as one piece."""
    return tiktoken.Encoding(f"pieces of {path}", pat_str=r"[^\x00]+|\x00", mergeable_ranks=read_ranks(path), special_tokens={})


@functools.lru_cache(4)
def whole_encoder(path: str) -> tiktoken.Encoding:
    """Merges any text as one piece."""
    return tiktoken.Encoding(f"whole {path}", pat_str=r"(?s:.+)", mergeable_ranks=read_ranks(path), special_tokens={})


def encode_words(path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after the other, and how many each has. No word is empty."""
    odd = {i for i, w in enumerate(words) if "\0" in w}
    if odd:
        each = [whole_encoder(path).encode_ordinary(w) for w in words]
        return np.array([i for ids in each for i in ids], dtype=np.uint32), np.array([len(x) for x in each], dtype=np.int64)
    if not words:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    ids = np.asarray(encoder(path).encode_to_numpy("\0".join(words), disallowed_special=()), dtype=np.uint32)
    ends = np.append(np.flatnonzero(ids == read_ranks(path)[b"\0"]), len(ids))
    return np.delete(ids, ends[:-1]), np.diff(ends, prepend=-1) - 1


@functools.lru_cache(2)
def library(path: str):
    """The tokenizers library's tokenizer of a .json file, its classes of characters and its special tokens."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    return tokenizer, LibraryKinds(tokenizer), special


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of several runs, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class WordTable:
    """Something computed once per pre-token, kept from text to text as runs of one flat array; begun anew when it is full."""

    def __init__(self, compute: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype, most: int = CACHE):
        self.compute, self.dtype, self.most = compute, dtype, most
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, dtype=self.dtype), 0
        self.starts, self.counts = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64)

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        return array if size <= len(array) else np.concatenate([array, np.zeros(max(size - len(array), len(array)), dtype=array.dtype)])

    def places(self, words: list[str]) -> np.ndarray:
        """Row of each of these distinct words in ``starts`` and ``counts``; holds until the next call."""
        new = [w for w in words if w not in self.known]
        if new and len(self.known) + len(new) > self.most:
            self._clear()
            new = words
        if new:
            flat, counts = self.compute(new)
            n, m = len(self.known), len(self.known) + len(new)
            self.flat, self.starts, self.counts = self._room(self.flat, self.used + len(flat)), self._room(self.starts, m), self._room(self.counts, m)
            self.flat[self.used:self.used + len(flat)] = flat
            self.counts[n:m] = counts
            self.starts[n:m] = self.used + np.cumsum(counts) - counts
            self.used += len(flat)
            self.known.update(zip(new, range(n, m), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))


def segments(texts: list[str], special: dict[str, int]) -> tuple[list[str], list[int | None]]:
    """Texts cut at strings of special tokens. Second list: the id before each segment, None if it begins a text."""
    parts, before = [], []
    for text in texts:
        todo = [(text, None)]
        for token, i in special.items():
            todo = [(part, i if k else first) for whole, first in todo for k, part in enumerate(whole.split(token))]
        parts += [p for p, _ in todo]
        before += [i for _, i in todo]
    return parts, before


def encode_texts(texts: list[str], path: str, words: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts as the tokenizers library gives them (special strings become special ids), and how many each has."""
    _, kinds, special = library(path)
    parts, before = segments(texts, special) if any(s in t for t in texts for s in special) else (texts, [None] * len(texts))
    cut = split(parts, kinds)
    at = words.places(cut.words)[cut.codes]
    counts = words.counts[at]
    ids = words.flat[ragged(words.starts[at], counts)]
    ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(cut.per_text)]
    if len(parts) == len(texts):
        return ids, np.diff(ends, prepend=0)
    begins = np.concatenate([[0], ends[:-1]])
    inserts = np.array([i is not None for i in before], dtype=bool)
    ids = np.insert(ids, begins[inserts], [i for i in before if i is not None])
    owner = np.cumsum(~inserts) - 1
    return ids, np.bincount(owner, weights=np.diff(ends, prepend=0) + inserts, minlength=len(texts)).astype(np.int64)


__all__ = ["Pieces", "WordTable", "encode_texts", "encode_words", "library", "ragged", "read_ranks", "regex_kinds", "segments"]
