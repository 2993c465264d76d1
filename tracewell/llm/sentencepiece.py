"""SentencePiece encoding and decoding: a unigram Viterbi search over a double-array trie of pieces.

Pieces and their scores come as they are from a model file, and the search adds them up. Those of a unigram model are log probabilities; those of a merge model such as the public
piece_bpe_32k are the negative ranks of its merges, so that the best path has the pieces of the earliest merges, and few of them. A text gets one space in front; every space is written as the marker U+2581
in pieces. The encoding is the sequence of pieces with the largest sum of scores; at equal sums the earlier last piece boundary wins, so longer pieces do. A character without a
piece of its own costs the smallest score less 10, and is written as one byte piece for each UTF-8 byte (the unknown id if the model has none).
Decoding joins pieces, bytes as UTF-8 (malformed: U+FFFD), turns markers into spaces and drops the one in front. A marker in the text itself
is written as byte pieces, so decoding gives every text back that is valid Unicode.

No piece has a marker after another character (checked), so a best path has a boundary before every run of spaces, and words are coded
apart: a worker codes each distinct word once, in lockstep with other words of the batch.

Cases: null text encodes and decodes to null; an empty text has no ids; very long words are coded in linear time and memory; unknown ids below zero
or past the vocabulary decode as nothing, null ids too; control ids decode as nothing; very long texts are coded whole, a slice each; equal rows each come out; an empty table gives
no rows; all other columns stay, whatever their names, but those of the results' names are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import slices, spare

MARK = "▁"
#: Words a worker remembers; beyond that it starts again.
CACHE_WORDS = 200_000
#: Bytes of a word that is coded in lockstep; longer ones are coded one by one.
LOCKSTEP = 48
_WORD = re.compile(rb" +[^ ]*|[^ ]+")


class DoubleArray:
    """A trie over bytes: state s goes by byte c to t = base[s] + c if check[t] == s; piece[t] is the id that ends there, or -1."""

    def __init__(self, keys: dict[bytes, int]):
        size = 1 << 16
        base, check, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        children: dict[bytes, list[int]] = {}
        for key in keys:
            for i in range(len(key)):
                children.setdefault(key[:i], []).append(key[i])
        state = {b"": 0}
        used = bytearray(size)
        used[0] = 1
        free = wide = 1  # no hole lies before `free`; states with several children look for room from `wide` on
        for prefix in sorted(children, key=lambda p: (len(p), p)):
            s, codes = state[prefix], sorted(set(children[prefix]))
            at = max(free if len(codes) == 1 else wide, 1 + codes[0])
            tried = 0
            while True:
                if at + 256 >= len(used):
                    used += bytes(len(used))
                b = at - codes[0]
                if not used[at] and not any(used[b + c] for c in codes):
                    break
                at = used.find(0, at + 1)
                tried += 1
                if at < 0:
                    at = len(used)
            if tried > 32:
                wide = at
            while at >= len(check) - 512:
                base, check, piece = (np.concatenate([x, np.full(len(x), fill, np.int32)]) for x, fill in ((base, 0), (check, -1), (piece, -1)))
            base[s] = b
            for c in codes:
                used[b + c] = 1
                check[b + c] = s
                state[prefix + bytes([c])] = b + c
                piece[b + c] = keys.get(prefix + bytes([c]), -1)
            free = used.find(0, free)
        self.base, self.check, self.piece = base, check, piece


class Pieces:
    """A model's pieces: encode and decode."""

    _of: dict[str, Pieces] = {}

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.unknown = model.unk_id()
        self.score = np.array([model.get_score(i) for i in range(model.get_piece_size())])
        self.raw: list[bytes] = []
        self.byte = np.full(256, self.unknown)
        self.is_byte = np.zeros(len(self.score), bool)
        keys = {}
        for i in range(len(self.score)):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.is_byte[i] = True
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"piece {i} has a marker inside")
                self.raw.append(piece.replace(MARK, " ").encode())
                keys[self.raw[-1]] = i
        self.missing = min(self.score[i] for i in keys.values()) - 10
        self.trie = DoubleArray(keys)
        self.kind = np.dtype("<u2" if len(self.score) < 1 << 16 else "<u4")
        self.words: dict[bytes, bytes] = {}

    @classmethod
    def get(cls, path: str) -> Pieces:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def _write(self, word: bytes, ends: list[int], ids: list[int]) -> bytes:
        out, at = [], 0
        for end, i in zip(ends, ids):
            out += [i] if i >= 0 else self.byte[np.frombuffer(word[at:end], np.uint8)].tolist()
            at = end
        return np.array(out, self.kind).tobytes()

    def _one(self, word: bytes) -> bytes:
        """A word of any length, in time and memory in proportion to it."""
        n = len(word)
        best, via, back = [-np.inf] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        base, check, piece, score = self.trie.base, self.trie.check, self.trie.piece, self.score
        at = 0
        while at < n:
            first = word[at]
            size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            s, to, single, here = 0, at, False, best[at]
            while to < n:
                t = int(base[s]) + word[to]
                if check[t] != s or t == 0:
                    break
                s, to = t, to + 1
                if (i := int(piece[t])) >= 0:
                    single |= to == at + size
                    if here + score[i] > best[to]:
                        best[to], via[to], back[to] = here + score[i], i, at
            if not single and here + self.missing > best[min(n, at + size)]:
                to = min(n, at + size)
                best[to], via[to], back[to] = here + self.missing, -1, at
            at += size
        ends, ids, at = [], [], n
        while at:
            ends.append(at)
            ids.append(via[at])
            at = back[at]
        return self._write(word, ends[::-1], ids[::-1])

    def _together(self, words: list[bytes]) -> list[bytes]:
        """Words of at most LOCKSTEP bytes, all at once."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        most = int(size.max())
        data = np.zeros((n, most + 1), np.uint8)
        data[np.repeat(np.arange(n), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.frombuffer(b"".join(words), np.uint8)
        best, via, back = np.full((n, most + 1), -np.inf), np.full((n, most + 1), -1, np.int32), np.zeros((n, most + 1), np.int16)
        best[:, 0] = 0
        base, check, piece, score = self.trie.base, self.trie.check, self.trie.piece, self.score
        for at in range(most):
            rows = np.flatnonzero((size > at) & ((data[:, at] & 0xC0) != 0x80))
            if not len(rows):
                continue
            first = data[rows, at]
            wide = at + 1 + (first >= 0xC0) + (first >= 0xE0).astype(np.int64) + (first >= 0xF0)
            lone = np.ones(len(rows), bool)
            left, state, to = np.arange(len(rows)), np.zeros(len(rows), np.int32), at
            while len(left):
                inside = size[rows[left]] > to
                left, state = left[inside], state[inside]
                if not len(left):
                    break
                t = base[state] + data[rows[left], to]
                ok = (check[t] == state) & (t > 0)
                left, state = left[ok], t[ok]
                to += 1
                i = piece[state]
                hit = np.flatnonzero(i >= 0)
                lone[left[hit[wide[left[hit]] == to]]] = False
                r = rows[left[hit]]
                new = best[r, at] + score[i[hit]]
                up = new > best[r, to]
                r, i = r[up], i[hit][up]
                best[r, to], via[r, to], back[r, to] = new[up], i, at
            lone = np.flatnonzero(lone)
            r, to = rows[lone], np.minimum(wide[lone], size[rows[lone]])
            new = best[r, at] + self.missing
            up = new > best[r, to]
            r, to = r[up], to[up]
            best[r, to], via[r, to], back[r, to] = new[up], -1, at
        out = []
        via, back = via.tolist(), back.tolist()
        for k, word in enumerate(words):
            ends, ids, at = [], [], len(word)
            while at:
                ends.append(at)
                ids.append(via[k][at])
                at = back[k][at]
            out.append(self._write(word, ends[::-1], ids[::-1]) if min(ids) < 0 else np.array(ids[::-1], self.kind).tobytes())
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of self.kind."""
        split = [_WORD.findall(b" " + x.encode("utf-8", "replace")) if x else [] for x in texts]
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        known = self.words
        missing = sorted(set(chain.from_iterable(split)).difference(known), key=lambda w: (len(w), w))
        short = [w for w in missing if len(w) <= LOCKSTEP]
        for i in range(0, len(short), 4096):
            part = short[i : i + 4096]
            known.update(zip(part, self._together(part)))
        rare = {w: self._one(w) for w in missing[len(short) :]}  # long words seldom come again
        return [b"".join([known[w] if w in known else rare[w] for w in words]) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        known = ids[(ids >= 0) & (ids < len(raw))].tolist()
        text = b"".join([raw[i] for i in known]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encode(texts: DataFrame, path: str, text: str = "text", ids: str = "ids", same: str | None = None) -> DataFrame:
    """All columns but `text`, and the ids of the text as array<int>; if `same` is given, also whether the decoded ids are the text (in the place of columns of those names)."""
    rest = [c for c in texts.columns if c not in (text, ids, same)]
    held = spare(rest, "text")
    schema = T.StructType([*texts.select(*rest).schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(same, T.BooleanType())] if same else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.get(path)
        for batch in slices(batches, held):
            strings = batch.column(held).to_pylist()
            coded = pieces.encode([x or "" for x in strings])
            sizes = np.array([len(x) for x in coded]) // pieces.kind.itemsize
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32(), mask=np.append([x is None for x in strings], False))
            values = pa.array(np.frombuffer(b"".join(coded), pieces.kind), pa.int32())
            out = [*(batch.column(i) for i in range(len(rest))), pa.ListArray.from_arrays(offsets, values)]
            if same:
                out.append(pa.array([None if x is None else pieces.decode(np.frombuffer(c, pieces.kind)) == x for x, c in zip(strings, coded)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(out, schema.fieldNames())

    return texts.select(*rest, F.col(text).cast("string").alias(held)).mapInArrow(run, schema)


def decode(coded: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """All columns, and the text of the ids (in the place of a column of that name)."""
    coded = coded.select(*(c for c in coded.columns if c != text))
    names = coded.columns
    schema = T.StructType([*coded.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.get(path)
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            column = batch.column(ids)
            there = column.is_valid().to_pylist()
            lists = [None if not ok else pieces.decode(np.array([-1 if i is None else i for i in x.as_py()]) if x.values.null_count else x.values.to_numpy()) for ok, x in zip(there, column)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.string())], [*names, text])

    return coded.mapInArrow(run, schema)
