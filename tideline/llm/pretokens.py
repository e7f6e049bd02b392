"""Pre-tokens of byte-level BPE (``public_tokenizers.PATTERN``) for many texts at once, as array operations.

The pattern cuts a text wherever the class of its characters changes: letters, numbers, white space, the rest. One space
joins the run behind it; the last character of a run of white space before other text stands alone unless it is that space;
an apostrophe that stands alone in its run and has no space before it takes s, t, re, ve, m, ll or d from the letters behind it.
"""
from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point, asked from the regular expression library once per process."""
    table = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[ord(m[0][0])] = kind
            codes = np.frombuffer(m[0].encode("utf-32-le"), dtype=np.uint32)
            table[codes] = kind
    return table


def regex_kinds(chars: np.ndarray) -> np.ndarray:
    """Classes of code points as the regular expression library and tiktoken have them."""
    return classes()[chars]


class LibraryKinds:
    """Classes of code points as a pre-tokenizer of the tokenizers library has them: its Unicode version is another one, so it
    is asked about each code point when that is first met."""

    def __init__(self, tokenizer):
        self.cuts, self.table = tokenizer.pre_tokenizer.pre_tokenize_str, np.full(0x110000, 255, dtype=np.uint8)

    def __call__(self, chars: np.ndarray) -> np.ndarray:
        found = self.table[chars]
        if (unknown := found == 255).any():
            for code in np.unique(chars[unknown]).tolist():
                near = {kind: len(self.cuts(beside + chr(code))) == 1 for kind, beside in ((LETTER, "a"), (NUMBER, "5"), (OTHER, "!"))}
                self.table[code] = next((kind for kind, joined in near.items() if joined), SPACE)
            found = self.table[chars]
        return found


@dataclass
class Pieces:
    """Pre-tokens of a list of texts, in order: ``ends`` in code points of the joined texts, ``words`` the distinct
    pre-tokens, ``codes`` each one's place in ``words``, ``per_text`` how many each text has."""
    ends: np.ndarray
    words: list[str]
    codes: np.ndarray
    per_text: np.ndarray


def cut(texts: list[str], kinds: Callable[[np.ndarray], np.ndarray] = regex_kinds) -> tuple[str, np.ndarray, np.ndarray]:
    """The joined texts, their code points, and where pre-tokens begin (True), one flag per code point."""
    joined = "".join(texts)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(chars):
        return joined, chars, np.zeros(0, dtype=bool)
    kind = kinds(chars)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    first = np.zeros(len(chars), dtype=bool)
    bounds = np.cumsum(sizes) - sizes
    first[bounds[sizes > 0]] = True
    change = first.copy()
    change[1:] |= kind[1:] != kind[:-1]
    begin = change.copy()
    # The last white space before other text of the same text.
    space_last = np.zeros(len(chars), dtype=bool)
    space_last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:]
    begin |= space_last
    joins = space_last & (chars == 32)
    begin[1:] &= ~joins[:-1]
    # Contractions.
    alone = np.flatnonzero(change & (chars == 39))
    alone = alone[alone + 1 < len(chars)]
    alone = alone[(kind[alone + 1] == LETTER) & ~first[alone + 1]]
    alone = alone[first[alone] | ~joins[alone - 1]]
    for at in alone.tolist():
        rest = joined[at + 1:at + 3]
        for suffix in SUFFIXES:
            after = at + 1 + len(suffix)
            if rest.startswith(suffix) and not first[at + 1:after].any():
                begin[at + 1] = False
                if after < len(chars):
                    begin[after] = True
                break
    return joined, chars, begin


@functools.cache
def _weights() -> np.ndarray:
    return np.random.default_rng(11).integers(1 << 63, size=1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def split(texts: list[str], kinds: Callable[[np.ndarray], np.ndarray] = regex_kinds) -> Pieces:
    """Distinct pre-tokens and their sequence. Substrings are grouped by a hash and compared with their group's first."""
    joined, chars, begin = cut(texts, kinds)
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(chars))[:len(starts)].astype(np.int64)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    stops = np.cumsum(sizes)
    per_text = np.diff(np.searchsorted(starts, np.concatenate([[0], stops])))
    if not len(starts):
        return Pieces(ends, [], np.zeros(0, dtype=np.int64), per_text)
    length = ends - starts
    at = np.arange(len(chars), dtype=np.int32 if len(chars) < 1 << 31 else np.int64)
    mixed = _weights()[(at - np.repeat(starts.astype(at.dtype), length)) & 4095]
    np.multiply(mixed, chars, out=mixed)
    key = np.add.reduceat(mixed, starts)
    del mixed
    key ^= length.astype(np.uint64) << np.uint64(56)
    codes, _ = pd.factorize(key)
    lead = np.full(int(codes.max()) + 1, -1, dtype=np.int64)
    lead[codes[::-1]] = np.arange(len(codes))[::-1]
    same = (length == length[lead[codes]]).all()
    if same:
        at += np.repeat((starts[lead[codes]] - starts).astype(at.dtype), length)
        same = (chars == chars[at]).all()
    del at
    if not same:  # two substrings with one hash: group by the strings themselves
        known: dict[str, int] = {}
        codes = np.fromiter((known.setdefault(joined[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), dtype=np.int64, count=len(starts))
        return Pieces(ends, list(known), codes, per_text)
    words = [joined[a:b] for a, b in zip(starts[lead].tolist(), ends[lead].tolist(), strict=True)]
    return Pieces(ends, words, codes, per_text)
