"""Language identification by fusing evidence: text, declared language, address suffix, and what else its host writes.

log P(language | row) = log prior(host) + TEMPER * log P(text | language) + log P(declared | language) + log P(suffix | language) + constant

Text: runs of three bytes of lower-cased letters (words padded with one blank), hashed to 2^BITS, with add-one smoothed frequencies for each language, learnt from about SAMPLE_ROWS
rows at most of each language that is given, however rare it is. A class UNKNOWN, with all runs alike, stands for anything that no learnt language explains. TEMPER makes up for runs not being independent.

Priors: the text's posteriors alone are summed by grouped aggregation for each host, its domain and all rows. A domain's shares are smoothed towards those of all rows by STRENGTH
pseudo-rows, and a host's towards its domain's; a row's own part is taken out first. P(declared | language) and P(suffix | language) are smoothed shares of the same sums.

Only evidence (a few numbers a row) is shuffled, never texts; sums by host are added up before the shuffle, and the join that brings them back has one row a host, so a hot host may be split.

Cases: null or empty text has no text evidence, so the other evidence decides; null or empty declarations and addresses are evidence of their own (a missing one); without any
training rows every row is UNKNOWN; equal posteriors go to the first language by name; null ids and equal rows each come out; very long texts are read whole, a slice each; an empty table gives no rows;
only the named columns are read, so that others may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import Scratch, mix, slices, text_bytes
from tracewell.llm.html_text import main_text

BITS = 16
#: Rows of each language that the text model learns from, about (those with the smallest hashes of their ids), where there are more.
SAMPLE_ROWS = 8_000
TEMPER = 0.2
STRENGTH = 20.0
UNKNOWN = "und"
_U = np.uint64
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
#: A comment, a script or style, or an html element's start that declares a language.
_DECLARED = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})\b""", re.I | re.S)


def runs(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed run) for each run of three bytes in each text; runs of blanks alone are left out."""
    data, offsets = text_bytes(texts)
    n = len(texts)
    letters = np.full(len(data) + 2 * n + 2, 32, np.uint8)
    row = np.repeat(np.arange(n), np.diff(offsets))
    letters[np.arange(len(data)) + 2 * row + 1] = _LETTER[data]
    row = np.repeat(np.arange(n), np.diff(offsets) + 2)
    code = (letters[:-2].astype(_U) << _U(16)) | (letters[1:-1].astype(_U) << _U(8)) | letters[2:]
    code, row = code[: len(row)], row[: len(code)]
    good = (letters[1 : 1 + len(code)] != 32) | ((letters[: len(code)] != 32) & (letters[2 : 2 + len(code)] != 32))
    return row[good], (mix(code[good]) >> _U(64 - bits)).astype(np.int64)


class TextModel:
    """Log frequencies of runs for each language, UNKNOWN last."""

    def __init__(self, languages: list[str], counts: np.ndarray, bits: int = BITS):
        self.languages, self.bits = [*languages, UNKNOWN], bits
        counts = counts.reshape(len(languages), 1 << bits) + 0.05
        known = np.log(counts / counts.sum(axis=1, keepdims=True))
        self.table = np.ascontiguousarray(np.vstack([known, np.full((1, 1 << bits), -bits * np.log(2))]).T.astype(np.float32))

    def log_likelihoods(self, texts: pa.Array) -> np.ndarray:
        row, run = runs(texts, self.bits)
        out = np.zeros((len(texts), len(self.languages)))
        if len(row):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            out[row[first]] = np.add.reduceat(self.table[run], first, axis=0, dtype=np.float64)
        return out


def fit(rows: DataFrame, key: str, text: str, language: str, sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """Learn from rows with a language: of each language all rows, or about sample_rows of them where there are more, those with the smallest hashes; at least one row.

    The driver gets a row a language, and at most 2^BITS counts of each.
    """
    known = rows.where(F.length(F.trim(language)) > 0).select(F.col(key).alias("key"), F.lower(F.trim(language)).alias("language"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    known = known.where(F.col("language") != UNKNOWN).withColumn("hash", F.xxhash64("key"))
    found = known.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("least")).collect()
    upto = {r["language"]: max(r["least"], min((sample_rows << 64) // r["n"], (1 << 64) - 1) - (1 << 63)) for r in found}
    names = sorted(upto)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        at = {x: i for i, x in enumerate(names)}
        for batch in slices(batches, "text"):
            of = np.array([at[x] for x in batch.column("language").to_pylist()])
            row, run = runs(batch.column("text"))
            for i in np.unique(of).tolist():
                counts[i] = counts.get(i, 0) + np.bincount(run[of[row] == i], minlength=1 << BITS)
        for i, n in counts.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i)), pa.array(some), pa.array(n[some])], ["language", "run", "n"])

    bounds = rows.sparkSession.createDataFrame(list(upto.items()), "language string, upto long")
    sample = known.join(F.broadcast(bounds), "language").where(F.col("hash") <= F.col("upto")).select("language", "text")
    found = sample.mapInArrow(count, "language long, run long, n long").groupBy("language", "run").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(names), 1 << BITS))
    counts[found["language"].to_numpy(), found["run"].to_numpy()] = found["n"].to_numpy()
    return TextModel(names, counts)


def address(url: str | None) -> tuple[str, str, str]:
    """Host, domain (its last two labels) and suffix (its last label) of an address; empty if there is none."""
    try:
        host = (urlsplit(url or "").hostname or "").strip(".")
    except ValueError:
        host = ""
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1]


def declared(source: str | None) -> str:
    """The language that the html element declares, wherever it stands but in a comment, script or style."""
    return next((m[2].lower() for m in _DECLARED.finditer(source or "") if m[2]), "")


def page_evidence(pages: DataFrame, model: TextModel, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """key, log likelihoods of the main text, declared language, host, domain and suffix of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "source"):
            sources = batch.column("source").to_pylist()
            likely = shared.value.log_likelihoods(pa.array([main_text(x) for x in sources], pa.string()))
            where = list(zip(*map(address, batch.column("url").to_pylist())))
            cols = [pa.array(list(likely), pa.list_(pa.float64())), pa.array([declared(x) for x in sources]), *(pa.array(list(x), pa.string()) for x in where)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *cols], ["key", "likely", "declared", "host", "domain", "suffix"])

    return pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.col(source).cast("string").alias("source")).mapInArrow(
        run, "key long, likely array<double>, declared string, host string, domain string, suffix string"
    )


def text_evidence(rows: DataFrame, model: TextModel, key: str, text: str, declared: str, host: str) -> DataFrame:
    """The same of plain texts, whose host has no domain above it but the table, and no suffix."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            likely = shared.value.log_likelihoods(batch.column("text"))
            blank = pa.array([""] * batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(list(likely), pa.list_(pa.float64())), batch.column("declared"), batch.column("host"), blank, blank], ["key", "likely", "declared", "host", "domain", "suffix"])

    blank = lambda c: F.coalesce(F.lower(F.trim(F.col(c).cast("string"))), F.lit(""))
    return rows.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), blank(declared).alias("declared"), blank(host).alias("host")).mapInArrow(
        run, "key long, likely array<double>, declared string, host string, domain string, suffix string"
    )


def fuse(evidence: DataFrame, languages: list[str], scratch: Scratch) -> DataFrame:
    """key, language, posterior, text_language, declared, host of each row of evidence."""
    n = len(languages)
    soft = lambda logs: F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    unit = lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda a, b: a + b))
    rows = evidence.withColumn("text", F.transform("likely", lambda x: x * TEMPER))
    rows = scratch.write(rows.withColumn("own", unit(soft(F.col("text")))).drop("likely"), "evidence")
    sums = [F.sum(F.col("own")[i]).alias(f"s{i}") for i in range(n)]
    array = lambda: F.array(*[f"s{i}" for i in range(n)])
    hosts = rows.groupBy("host", "domain").agg(*sums).withColumn("host_sums", array()).drop(*[f"s{i}" for i in range(n)])
    hosts = scratch.write(hosts, "hosts")
    again = [F.sum(F.col("host_sums")[i]).alias(f"s{i}") for i in range(n)]
    domains = hosts.groupBy("domain").agg(*again).withColumn("domain_sums", array()).drop(*[f"s{i}" for i in range(n)])
    every = rows.agg(*sums).first()
    every = np.array([x or 0.0 for x in every])
    share = F.array(*[F.lit(float(x)) for x in (every + 1) / (every + 1).sum()])

    def likelihood(column: str) -> DataFrame:
        """log P(value | language) for each value: its smoothed share of a language's rows."""
        by = rows.groupBy(column).agg(*sums)
        return by.select(column, F.array(*[F.log((F.col(f"s{i}") + 0.5) / (float(every[i]) + 1.0)) for i in range(n)]).alias(f"{column}_logs"))

    def smoothed(counts, above):
        total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(counts, above, lambda c, p: (F.greatest(c, F.lit(0.0)) + STRENGTH * p) / (total + STRENGTH))

    out = rows.join(hosts.join(domains, "domain"), ["host", "domain"]).join(likelihood("declared"), "declared").join(likelihood("suffix"), "suffix")
    less = lambda c: F.zip_with(c, F.col("own"), lambda a, b: F.greatest(a - b, F.lit(0.0)))
    out = out.withColumn("domain_prior", smoothed(less("domain_sums"), share)).withColumn("prior", smoothed(less("host_sums"), F.col("domain_prior")))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = add(add(F.col("text"), F.transform("prior", lambda x: F.log(x))), add(F.col("declared_logs"), F.col("suffix_logs")))
    out = out.withColumn("logs", logs).withColumn("posteriors", unit(soft(F.col("logs"))))
    names = F.array(*[F.lit(x) for x in languages])
    top = lambda v: F.element_at(names, F.array_position(v, F.array_max(v)).cast("int"))
    return out.select("key", top(F.col("posteriors")).alias("language"), F.array_max("posteriors").alias("posterior"), top(F.col("own")).alias("text_language"), "declared", "host")
