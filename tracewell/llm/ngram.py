"""N-gram indicators of whole texts, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tracewell.llm.common import WHITE, byte_classes, hash_words, mix, text_bytes, word_rows

_U = np.uint64
#: Kinds of byte in a word's shape: 1 lower-case letter, 2 upper-case letter, 3 digit, 4 sentence mark, 5 other mark, 6 control.
_KIND = np.full(256, 6, np.uint8)
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
for _b in range(33, 127):
    if _KIND[_b] == 6:
        _KIND[_b] = 4 if chr(_b) in ".,;:?'\"()-" else 5


def _word_shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A small code for each word: the kinds of its first, second and last two bytes, and its length class."""
    last = len(data) - 1
    out = np.zeros(len(starts), _U)
    for at in (starts, np.minimum(starts + 1, ends - 1), np.maximum(ends - 2, starts), np.minimum(ends - 1, last)):
        out = out * _U(8) + _KIND[data[at]].astype(_U)
    size = np.minimum(np.log2(ends - starts).astype(np.int64), 7)
    return out * _U(8) + size.astype(_U)


def indicators(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram features of each text as (row, feature) pairs, sorted; features below 2^bits.

    The n-grams are: words; words with the word before; and runs of one to three word shapes, where a word that equals the word before it has
    a shape of its own. Each text has one feature more, that of the empty n-gram.
    """
    data, offsets = text_bytes(texts)
    starts, ends, words = hash_words(data, offsets, byte_classes(WHITE))
    rows = np.repeat(np.arange(len(texts)), np.diff(word_rows(starts, offsets)))
    shapes = mix(_word_shapes(data, starts, ends)) if len(starts) else words
    same_row = rows[1:] == rows[:-1]
    again = np.zeros(len(words), bool)
    again[1:] = same_row & (words[1:] == words[:-1])
    shapes = np.where(again, _U(0xA5A5), shapes)

    found = [(np.arange(len(texts)), np.zeros(len(texts), _U))]

    def add(kind: int, values: np.ndarray, n: int) -> None:
        """The n-grams of n values in one text each."""
        m = len(values) - n + 1
        if m <= 0:
            return
        h = np.full(m, kind, _U)
        for i in range(n):
            h = mix(h * _U(0x9E3779B97F4A7C15) + values[i : i + m])
        inside = rows[:m] == rows[n - 1 :]
        found.append((rows[:m][inside], h[inside]))

    add(1, words, 1)
    add(2, words, 2)
    for n in (1, 2, 3):
        add(10 + n, shapes, n)
    row = np.concatenate([r for r, _ in found])
    feature = np.concatenate([h for _, h in found]) >> _U(64 - bits)
    both = np.unique((row.astype(_U) << _U(bits)) | feature)
    return (both >> _U(bits)).astype(np.int64), (both & _U((1 << bits) - 1)).astype(np.int64)
