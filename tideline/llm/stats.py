"""Statistics of one text that quality rules and the quality classifier are built on."""
from __future__ import annotations

import numpy as np
import pyarrow as pa

from tideline.llm.common import SPACES

SYMBOLS = b"#*$%&|<>"
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks", "n_stops", "n_alpha_words")
SQL_TYPE = "struct<" + ",".join(f"{name}:bigint" for name in FIELDS) + ">"


def repeated_words(codes: np.ndarray) -> int:
    """Words that lie in a window of three words which the text holds twice or more."""
    if len(codes) < 4:
        return 0
    size = int(codes.max()) + 1
    _, pairs = np.unique(codes[:-1] * size + codes[1:], return_inverse=True)
    _, windows, counts = np.unique(pairs[:-1] * size + codes[2:], return_inverse=True, return_counts=True)
    hit = counts[windows] > 1
    covered = np.zeros(len(codes), dtype=bool)
    for shift in range(3):
        covered[shift:len(codes) - 2 + shift] |= hit
    return int(covered.sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The FIELDS of a text; null counts as empty, and an empty text has zeros.

    Lines without a word count neither as lines nor as repeats. Upper counts words with letters none of which is lower case.
    """
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    known = {w: k for k, w in enumerate(dict.fromkeys(words))}
    codes = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
    seen, lines, repeats = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            repeats += line in seen
            seen.add(line)
    shouted = np.array([w.decode("utf-8", "surrogatepass").isupper() for w in known], dtype=bool)
    letters = np.array([w.decode("utf-8", "surrogatepass")[:1].isalpha() for w in known], dtype=bool)
    times = np.bincount(codes, minlength=len(known))
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    return (
        len(words), len(text) - without(SPACES), without(SYMBOLS), repeats, repeated_words(codes), lines, len(known),
        int(times[shouted].sum()) if known else 0, without(b"0123456789"), without(b"!?"), without(b".,;:"), int(times[letters].sum()) if known else 0,
    )


def stats_array(texts: pa.Array) -> pa.Array:
    """``text_stats`` of an Arrow column of texts."""
    rows = np.array([text_stats(t.as_py()) for t in texts], dtype=np.int64).reshape(-1, len(FIELDS))
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(FIELDS))], names=list(FIELDS))
