"""Token-id files: documents as one array of ids, with Elias-Fano coded boundaries.

A store is a folder of files. A file holds consecutive documents in ascending doc_id order; files sort by (part, block) of their headers.
Layout of a file:

    8 bytes   magic TWTOKEF1
    13 x 8    big-endian: total length, part, block, tokens of the part before this file, documents, tokens, bytes an id (2 or 4),
              null doc_ids, smallest doc_id, four spare
    ...       little-endian sections, each padded to 8 bytes: boundary coding, doc_id coding, ids

A coding of n ascending numbers below u keeps max(0, floor(log2(u/n))) low bits of each in a packed array, and the rest as a unary bit vector of
n ones and at most 2n zeros, so 2 + log2(u/n) bits a number. Every SAMPLE-th one's position is kept (32 bits), from which select continues by
counting bits of bytes; no 64-bit table of offsets is there. After the total length there may be one line feed, which the writer of lines adds.

Spark's own line writer carries the bytes, one file a block, so any file system that Spark writes to will do, commits are atomic, and a lost
executor's task is repeated. Cases: null text is an empty document (it has the end id only); null doc_ids come first; equal doc_ids are ordered by the XXH64 of their texts, then by
these; very long texts are encoded whole, a slice each; an empty table gives a store without files and no rows; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import Scratch, slices, text_bytes

MAGIC = b"TWTOKEF1"
HEADER = struct.Struct(">8s13q")
SAMPLE = 128
#: Ids after which a file ends.
BLOCK_TOKENS = 4 << 20
#: Distinct words after which a worker puts its memory aside; it holds twice as many at most, and those of a slice.
CACHE_WORDS = 150_000
#: Bytes of text whose words are worked on at once.
SLICE = 4 << 20
#: The digit between new words, and their number in a call of the library.
SIGN, JOINED = "7", 256
_ASCII = np.arange(256)
_LETTER = (_ASCII >= 97) & (_ASCII < 123)
#: Marks that may close a word, after a letter: no token spans their start. An apostrophe may begin a token with what follows.
_MARK = (_ASCII > 32) & (_ASCII < 127) & ~_LETTER & ~((_ASCII >= 48) & (_ASCII < 58)) & ~((_ASCII >= 65) & (_ASCII < 91)) & (_ASCII != 39)
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 8)


class EliasFano:
    """Ascending numbers, coded; access by select without decoding the rest."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        low = np.zeros(0, np.uint8)
        if low_bits:
            bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def dump(self) -> bytes:
        raw = b"".join(_pad(x.tobytes()) for x in (self.low, self.high, self.samples))
        return struct.pack("<4q", self.n, self.low_bits, len(self.high), len(self.samples)) + raw

    @classmethod
    def load(cls, raw: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, high, samples = struct.unpack_from("<4q", raw, at)
        parts, at = [], at + 32
        for kind, count in ((np.uint8, -(-n * low_bits // 8)), (np.uint8, high), (np.uint32, samples)):
            parts.append(np.frombuffer(raw, kind, count, at))
            at += parts[-1].nbytes + -parts[-1].nbytes % 8
        return cls(n, low_bits, *parts), at

    def _low(self, i: int) -> int:
        bit = i * self.low_bits
        part = self.low[bit // 8 : (bit + self.low_bits + 7) // 8].tobytes()
        return (int.from_bytes(part, "little") >> (bit % 8)) & ((1 << self.low_bits) - 1)

    def __getitem__(self, i: int) -> int:
        """The i-th number: select of the i-th one from the sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte, skip = divmod(at, 8)
        here = int(self.high[byte]) >> skip << skip
        while (ones := int(_BITS[here])) <= left:
            left -= ones
            byte += 1
            here = int(self.high[byte])
        for _ in range(left):
            here &= here - 1
        one = byte * 8 + (here & -here).bit_length() - 1
        return ((one - i) << self.low_bits) | self._low(i)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits and self.n:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.uint64)
            out |= (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out

    @property
    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.samples.nbytes


def pack(doc_ids: list, lengths: np.ndarray, ids: bytes, width: int, part: int = 0, block: int = 0, before: int = 0) -> bytes:
    """One file. doc_ids ascend, nulls first."""
    nulls = sum(x is None for x in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    base = int(known[0]) if len(known) else 0
    ends = np.concatenate([[0], np.cumsum(lengths)])
    body = EliasFano.of(ends).dump() + EliasFano.of(known.astype(np.uint64) - np.uint64(base & (1 << 64) - 1)).dump() + _pad(ids)
    return HEADER.pack(MAGIC, HEADER.size + len(body), part, block, before, len(doc_ids), int(ends[-1]), width, nulls, base, 0, 0, 0, 0) + body


class TokenFile:
    """A file's documents by number, from any buffer, such as a memory map."""

    def __init__(self, raw: bytes | memoryview):
        raw = memoryview(raw)
        magic, length, self.part, self.block, self.before, self.n_docs, self.n_tokens, self.width, self.nulls, self.base, *_ = HEADER.unpack_from(raw)
        if magic != MAGIC or len(raw) < length:
            raise ValueError("not a whole token file")
        self.ends, at = EliasFano.load(raw, HEADER.size)
        self._doc_ids, at = EliasFano.load(raw, at)
        self.ids = np.frombuffer(raw, "<u2" if self.width == 2 else "<u4", self.n_tokens, at)

    def doc_ids(self) -> list:
        known = self._doc_ids.all() + np.uint64(self.base & (1 << 64) - 1)
        return [None] * self.nulls + known.astype(np.int64).tolist()

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends[i] : self.ends[i + 1]]


#: The normaliser and the splitting rule under which WordCache may part a text. Under any other, whole texts go to the library.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


class WordCache:
    """Ids of whole texts by the tokenizers library, which sees each distinct word (between spaces or line feeds) once while a worker remembers it.

    Exact for a tokenizer of the form above (`parts`): it drops white space, lower-cases and splits runs of letters from runs of marks and single digits before its merges,
    so that no token and no rule spans a space, a line feed, a digit, or the start of a run of marks (but apostrophes) after a letter. The tokenizer's added tokens, which
    the library finds in the raw text, are such tokens: a text that holds one, as it is or in lower case, goes to the library whole and unchanged. So does every text if the
    tokenizer has another form.

    New words go to the library many at a time, joined by a digit that they don't have; its id ends each.
    """

    _of: dict = {}

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        self.parts = form["normalizer"] == _NORMALIZER and form["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]} and not form["model"].get("dropout")
        self.kind = np.dtype("<u2" if width == 2 else "<u4")
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.added = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()} - {""})
        self.sign = self._plain(SIGN)

    @classmethod
    def get(cls, path: str, width: int) -> WordCache:
        if (path, width) not in cls._of:
            cls._of[path, width] = cls(path, width)
        return cls._of[path, width]

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, words: list[str]) -> None:
        known, one = self.words, self.kind.itemsize
        joined = [w for w in words if SIGN not in w] if len(self.sign) == one else []
        for at in range(0, len(joined), JOINED):
            part = joined[at : at + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([SIGN.join(part)], add_special_tokens=False)[0].ids, self.kind)
            raw, begin = ids.tobytes(), 0
            ends = np.flatnonzero(ids == np.frombuffer(self.sign, self.kind)[0]) * one
            for w, end in zip(part, [*ends.tolist(), len(raw)], strict=True):
                known[w] = raw[begin:end]
                begin = end + one
        odd = [w for w in words if w not in known]
        for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
            known[w] = np.array(e.ids, self.kind).tobytes()

    def _ids(self, words: list[str]) -> list[bytes]:
        """Of distinct words. Words that weren't met since the last but one time that the memory was full are forgotten."""
        if len(self.words) > CACHE_WORDS:
            self.words, self.older = {}, self.words
        known, older = self.words, self.older
        missing = [w for w in words if w not in known]
        if missing:
            again = [w for w in missing if w in older]
            known.update(zip(again, map(older.__getitem__, again)))
            self._learn([w for w in missing if w not in known] if again else missing)
        return list(map(known.__getitem__, words))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian numbers; null is empty."""
        texts = pc.fill_null(texts, "")
        lower = pc.ascii_lower(texts).cast(pa.large_string())  # in this order: a cast slice doesn't start at its buffer's first byte
        whole = np.zeros(len(texts), bool) if self.parts else np.ones(len(texts), bool)
        for token in self.added if self.parts else ():
            whole |= pc.match_substring(lower, token).to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(whole)
        if len(rows):
            lower = pc.if_else(pa.array(whole), "", lower)
        split = pc.split_pattern(pc.replace_substring(lower, "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        ids = _take(self._distinct(words.dictionary), words.indices)
        ends = ids.buffers()[1]
        data, ends = memoryview(ids.buffers()[2] or b""), np.frombuffer(ends, np.int64)[ids.offset :]
        first = ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        out = [bytes(data[a:b]) for a, b in zip(first, first[1:])]
        for i in rows.tolist():
            out[i] = self._plain(texts[i].as_py())
        return out

    def _distinct(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words, as binary: those of a word up to its closing marks, if a letter stands before them, and those of the marks."""
        data, offsets = text_bytes(words)
        at = np.arange(len(data))
        body = np.maximum.accumulate(np.where(_MARK[data], -1, at)) if len(data) else at
        start, end = offsets[:-1], offsets[1:]
        last = body[np.maximum(end - 1, 0)] if len(data) else end
        letter = (end > start) & (last >= start)
        letter[letter] = _LETTER[data[last[letter]]]
        cut = np.where(letter, last + 1, end)
        pieces = pa.LargeStringArray.from_buffers(2 * len(words), pa.py_buffer(np.append(np.stack([start, cut], axis=1).ravel(), offsets[-1]).astype(np.int64)), pa.py_buffer(data.tobytes()))
        pieces = pieces.dictionary_encode()
        ids = _take(pa.array(self._ids(pieces.dictionary.to_pylist()), pa.large_binary()), pieces.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends[::2].copy()), ids.buffers()[2] or pa.py_buffer(b"")])


def _take(values: pa.Array, indices: pa.Array) -> pa.Array:
    """values[indices], bytes side by side from the start of a buffer."""
    return values.take(indices) if len(indices) else pa.LargeBinaryArray.from_buffers(pa.large_binary(), 0, [None, pa.py_buffer(np.zeros(1, np.int64)), pa.py_buffer(b"")])


def _encode(tokenizer: str, end_id: int, block_tokens: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end_id) < 1 << 16 else 4
        cache = WordCache.get(tokenizer, width)
        end = np.array([end_id], cache.kind).tobytes()
        part = TaskContext.get().partitionId()
        ids, lengths, docs, before, block, n = [], [], [], 0, 0, 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack(docs, np.array(lengths, np.int64), b"".join(ids), width, part, block, before)], pa.binary())], ["body"])

        for batch in slices(batches, "text", SLICE):
            for doc, raw in zip(batch.column("doc_id").to_pylist(), cache.encode(batch.column("text"))):
                if docs and n + len(raw) // width >= block_tokens:
                    yield file()
                    before, block, n = before + n, block + 1, 0
                    ids, lengths, docs = [], [], []
                ids += (raw, end)
                lengths.append(len(raw) // width + 1)
                docs.append(doc)
                n += lengths[-1]
        if docs:
            yield file()

    return encode


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int = 1, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write a store of all documents. The order is by range partitions, so each file is made by one task from the rows of one range."""
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    ordered = docs.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")
    files = ordered.mapInArrow(_encode(tokenizer, end_id, block_tokens), "body binary")
    files.select(F.col("body").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column("content"):
            f = TokenFile(raw.as_buffer())
            ends = [f.ends[i] for i in range(f.n_docs + 1)] if f.n_docs else [0]  # by select
            wide = memoryview(f.ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])]
            ends = np.array(ends, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(f.doc_ids(), pa.int64()), pa.array(np.full(f.n_docs, f.part)), pa.array(ends[:-1] + f.before), pa.array(np.diff(ends)), pa.array(crc, pa.int64())],
                ["doc_id", "part", "start", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of each document, from a store's files.

    Each file is read once; its rows go to a table in the shared folder, from which the driver gets one sum for each writing task.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 8").select("content")
    rows = Scratch(spark, "tokens").write(files.mapInArrow(_read, "doc_id long, part long, start long, n_tokens long, ids_crc32 long"), "rows")
    bases, at = [], 0
    for part, n in sorted(map(tuple, rows.groupBy("part").agg(F.max(F.col("start") + F.col("n_tokens"))).collect())):
        bases.append((part, at))
        at += n
    bases = spark.createDataFrame(bases, "part long, base long")
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
