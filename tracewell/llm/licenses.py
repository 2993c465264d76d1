"""License scans: MinHash bands over overlapping windows of text retrieve license templates; exact containment of shingles verifies them.

Shingles are runs of SHINGLE words (ASCII letters and digits and other characters, in lower case; ASCII marks and blanks part words). A template of m shingles is sought with windows of m shingles, a new one every
max(1, m // 8) shingles; a template of over PIECE shingles is sought by its pieces of PIECE. A window's signature has BANDS x ROWS minima of its hashed shingles under multiplicative permutations; a
template is a candidate where a whole band is equal. A window over a text that has at least the share CONTAINMENT of a template's shingles, in their place, has a Jaccard similarity
s of 0.6 or more with it, so that it is missed with a probability of (1 - s^ROWS)^BANDS: 2e-5 for 0.6. A candidate is a match if the stretch of text around the window (a quarter of the
template's length more on both sides) has that share of the template's distinct shingles.

A window without any template's shingle has no minimum in common with one (the permutations are one-to-one), so its signature is not worked out.

Of matches of one template that overlap the best (then the first) is kept; each match is a row. Templates are a parameter; their number is small and they go to every task.

Cases: null text is empty and matches nothing; templates of under SHINGLE words are not sought; null doc_ids and equal rows each come out; templates with equal texts all match; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import NOT_ALNUM, byte_classes, hash_words, shingle_hashes, slices, text_bytes, word_rows

SHINGLE = 5
CONTAINMENT = 0.8
PIECE = 64
BANDS, ROWS = 24, 2
_U = np.uint64
_CLASSES = byte_classes(NOT_ALNUM)
_SLOTS = 1 << 16

#: Notices by which texts name their license. They must equal the notices' usual words.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "licensed under the GNU General Public License v3"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)


class Templates:
    """Shingles of templates, and their pieces' bands by window size."""

    def __init__(self, templates: tuple[tuple[str, str], ...], shingle: int = SHINGLE):
        self.shingle = shingle
        rng = np.random.default_rng(11)
        self.factors = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * _U(2) + _U(1)
        self.names, self.shingles = [], []
        bands: dict[int, dict[int, set[tuple[int, int]]]] = defaultdict(lambda: defaultdict(set))
        for name, text in templates:
            h = self._shingles(pa.array([text]))[0]
            if not len(h):
                continue
            n = len(self.names)
            self.names.append(name)
            self.shingles.append(np.unique(h))
            for at in range(0, max(1, len(h) - PIECE + 1), PIECE // 4):
                piece = h[at : at + PIECE]
                for key in self._keys(self._minima(piece[None, :]))[0].tolist():
                    bands[len(piece)][key].add((n, at))
        self.any = np.unique(np.concatenate([np.zeros(0, _U), *self.shingles]))
        self.may_be = np.zeros(_SLOTS, bool)
        self.may_be[(self.any >> _U(48)).astype(np.int64)] = True
        self.bands = {m: dict(x) for m, x in bands.items()}

    def _shingles(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Shingle hashes of all texts in one row (those that reach into the next text too), the first word of each text, starts and ends of words."""
        data, offsets = text_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
        starts, ends, words = hash_words(data, offsets, _CLASSES)
        return shingle_hashes(words, self.shingle), word_rows(starts, offsets), starts, ends

    def _minima(self, windows: np.ndarray) -> np.ndarray:
        """(permutation, window) minima of windows, one a row."""
        return np.stack([(windows * f).min(axis=1) for f in self.factors])

    @staticmethod
    def _keys(minima: np.ndarray) -> np.ndarray:
        """(window, band): each band's minima as one number; its top bits depend on all of them."""
        rows = minima.reshape(BANDS, ROWS, -1)
        key = np.repeat(np.arange(1, BANDS + 1, dtype=_U)[:, None] * _U(0x9E3779B97F4A7C15), rows.shape[2], axis=1)
        for i in range(ROWS):
            key = (key ^ rows[:, i]) * _U(0xBF58476D1CE4E5B9)
            key ^= key >> _U(29)
            key *= _U(0x94D049BB133111EB)
        return key.T

    def matches(self, texts: pa.Array) -> list[list[tuple[int, float, int, int]]]:
        """Of each text: template, containment, first and past-the-last word of the match."""
        h, first, _, _ = self._shingles(texts)
        candidates: set[tuple[int, int]] = set()
        at = np.flatnonzero(self.may_be[(h >> _U(48)).astype(np.int64)])
        upto = np.zeros(len(h) + 1, np.int64)
        upto[at[np.isin(h[at], self.any)] + 1] = 1
        upto = np.cumsum(upto)
        for m, bands in self.bands.items():
            starts = np.arange(0, max(0, len(h) - m + 1), max(1, m // 8))
            starts = starts[upto[starts + m] > upto[starts]]
            for i in range(0, len(starts), 4096):
                keys = self._keys(self._minima(h[starts[i : i + 4096, None] + np.arange(m)]))
                for start, row in zip(starts[i : i + 4096].tolist(), keys.tolist()):
                    candidates.update((n, start - piece) for key in row for n, piece in bands.get(key, ()))
        found: dict[tuple[int, int], set[tuple[float, int, int]]] = defaultdict(set)
        for n, at in candidates:
            own = self.shingles[n]
            size = len(own)
            text = int(np.searchsorted(first, min(max(0, at + size // 2), first[-1] - 1), side="right")) - 1
            lo, hi = int(first[text]), int(first[text + 1]) - self.shingle + 1
            a, b = max(lo, at - size // 4 - 1), min(hi, at + size + size // 4 + 1)
            where = np.flatnonzero(np.isin(h[a:b], own)) if b > a else np.zeros(0, np.int64)
            share = len(np.unique(h[a:b][where])) / size
            if share >= CONTAINMENT:
                found[text, n].add((-share, a + int(where[0]) - lo, a + int(where[-1]) + self.shingle - lo))
        out: list[list[tuple[int, float, int, int]]] = [[] for _ in range(len(texts))]
        for (text, n), spans in sorted(found.items()):
            kept: list[tuple[int, float, int, int]] = []
            for share, a, b in sorted(spans):  # the best of those that overlap
                if all(b <= x or a >= y for _, _, x, y in kept):
                    kept.append((n, -share, a, b))
            out[text] += sorted(kept, key=lambda k: k[2])
        return out


def scan(documents: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, license, template (its number), containment, first_word and end_word of each match; no shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(Templates(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in slices(batches, "text", 1 << 20):
            ids = batch.column("doc_id").to_pylist()
            rows = [(i, t.names[n], n, share, a, b) for i, found in zip(ids, t.matches(batch.column("text").cast(pa.string()))) for n, share, a, b in found]
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "license", "template", "containment", "first_word", "end_word"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, license string, template int, containment double, first_word int, end_word int")
