"""What the operators share: input tables, scratch tables in the shared folder, and words of whole Arrow batches as hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once; a single longer text makes a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes of a batch that goes to Python, at most (or one row).
BATCH_BYTES = 4 << 20
_PRIME = 0x9E3779B97F4A7C15
_CHUNK = 1 << 18
_U = np.uint64


def small_batches(spark: SparkSession) -> None:
    """Batches of at most BATCH_BYTES between Spark and Python, which hold them on both sides; a setting of less stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not (now or "").isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where none is set and all is one machine (tests), a new local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tracewell-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Tables written into the shared folder, which cut a plan's lineage and outlive lost executors.

    A table goes with drop(), or else when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._at(self.path))

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def next_path(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.next_path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self._fs.delete(self._at(df._scratch_path), True)


#: Ids that are broadcast to an anti join, at most.
BROADCAST_IDS = 200_000


def without(rows: DataFrame, ids: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """rows whose key isn't among ids(key). Up to BROADCAST_IDS ids, counted first, go to the rows; more of them are joined by a shuffle."""
    ids = scratch.write(ids.select(key).distinct(), "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_anti").select(*rows.columns)


def spare(columns: list[str], name: str) -> str:
    """The name, with as many underscores in front as make it new among the columns (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` bytes of text, or a single longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and the n+1 offsets of its texts in them. Null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_classes(separators: bytes, lower: bool = True) -> np.ndarray:
    """For each byte: 0 if it separates words, else one more than the (lower-cased A-Z) byte."""
    out = np.arange(1, 257, dtype=np.uint16)
    if lower:
        out[65:91] += 32
    out[np.frombuffer(separators, np.uint8)] = 0
    return out


#: White space of ASCII.
WHITE = b"\t\n\x0b\x0c\r "
#: Every ASCII byte that is neither a letter nor a digit.
NOT_ALNUM = bytes(b for b in range(128) if not chr(b).isalnum())

_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        inverse = pow(_PRIME, -1, 1 << 64)
        _powers[:] = [np.concatenate([[_U(1)], np.multiply.accumulate(np.full(max(n, _CHUNK) - 1, x, _U))]) for x in (_PRIME, inverse)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection whose every output bit depends on every input bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def hash_words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and its 64-bit hash (equal words have equal hashes in any batch).

    A word is a longest run of bytes of class > 0 inside one text. Memory beside the results is bounded by _CHUNK and the longest word.
    """
    n = len(data)
    starts, ends, hashes = [], [], []
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    at = 0
    while at < n:
        to = min(n, at + _CHUNK)
        part = classes[data[at:to]]
        while to < n:  # whole words only
            whole = np.flatnonzero((part == 0) | cut[at + 1 : to + 1])
            if len(whole):
                to = at + int(whole[-1]) + 1
                part = part[: to - at]
                break
            more = min(n, to + _CHUNK)
            part = np.concatenate([part, classes[data[to:more]]])
            to = more
        word = part > 0
        if word.any():
            edge = cut[at:to]
            first = word.copy()
            first[1:] &= ~word[:-1] | edge[1:]
            last = word.copy()
            last[:-1] &= ~word[1:] | edge[1:]
            s, e = np.flatnonzero(first), np.flatnonzero(last)
            power, inverse = _power(to - at)
            total = np.cumsum(part.astype(_U) * power[: to - at], dtype=_U)
            h = total[e]
            h[s > 0] -= total[s[s > 0] - 1]
            hashes.append(mix(h * inverse[s]))
            starts.append(s + at)
            ends.append(e + (at + 1))
        at = to
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def word_rows(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text, the number of its first word; one more entry than texts."""
    return np.searchsorted(starts, offsets, side="left")


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of `size` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = words[:n].copy()
    for i in range(1, size):
        out = out * _U(_PRIME) + words[i : i + n]
    return mix(out)
