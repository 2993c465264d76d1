"""Source trees and corpora as DataFrames."""

from __future__ import annotations

import fnmatch
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that hold no implementation.
SKIPPED = "tests test __pycache__ build dist .tox .venv".split()
# Charsets and lengths of the hard workload, and its adversarial byte patterns.
CHARSETS = "windows-1252 iso-8859-1 iso-8859-2 iso-8859-5 iso-8859-7 iso-8859-9 koi8-r cp866 shift_jis euc-jp gb18030 big5 utf-8 utf-16".split()
LENGTHS = [6, 10, 16, 24, 40, 64]
ADVERSARIAL = [
    *(bytes(range(0x80, 0x80 + k)) for k in (8, 16, 24)),
    *(bytes(range(0xA0, 0xA0 + k)) for k in (8, 16)),
    b"\xe9\xe8\xea" * 4,
    b"\xc0\xc1\xc2\xc3" * 3,
    b"\x92\x93\x94\x95" * 3,
]


def _hidden(path: str) -> bool:
    """Whether Spark's own readers pass over a file: a part of its path begins with a dot or an underscore, as that of __init__.py does."""
    return any(p.startswith(".") or (p.startswith("_") and "=" not in p and not p.startswith(("_metadata", "_common_metadata"))) for p in path.split("/"))


def files(spark: SparkSession, root: str, impl: str, glob: str = "*.py") -> DataFrame:
    """(impl, path, content, text) below a root; path is relative, text decoded as UTF-8 with replacement. The name filter is applied while listing.

    Files that Spark's readers pass over (a package's __init__.py and other names that begin with an underscore or a dot) are read by the driver, through the file system of the
    root: they are a small part of a source tree.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    found = found.select(F.regexp_replace(F.col("path"), rf"^.*?\Q{base}\E/", "").alias("path"), "content")
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    top = fs.getFileStatus(folder).getPath().toString().rstrip("/") + "/"
    listing, rows = fs.listFiles(folder, True), []
    while listing.hasNext():
        at = listing.next().getPath()
        path = at.toString().removeprefix(top)
        if _hidden(path) and fnmatch.fnmatch(at.getName(), glob):
            stream = fs.open(at)
            rows.append((path, bytearray(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
            stream.close()
    found = found.unionByName(spark.createDataFrame(rows, "path string, content binary"))
    return found.select(F.lit(impl).alias("impl"), "path", "content", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def in_repo_scope(path: Column) -> Column:
    """Implementation files of a whole tree: none in SKIPPED folders, none named test*.py or *_test.py. Tested on the relative path."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    name = F.element_at(F.split(path, "/"), -1)
    return ~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED))) & ~name.rlike(r"^test.*\.py$|_test\.py$")


def in_package_scope(path: Column) -> Column:
    """Files of a package: no folder on the way has `test` in its name."""
    folder = F.regexp_replace(path, "[^/]*$", "")
    return ~F.lower(folder).contains("test")


def package_folder(listing: DataFrame, name: str | None = None) -> DataFrame:
    """(impl, folder): the shortest folder with an __init__.py (and of that name, if one is given), the first by name among equals."""
    folder = F.regexp_replace("path", "/?__init__\\.py$", "")
    rows = listing.where(F.col("path").rlike(r"(^|/)__init__\.py$")).select("impl", folder.alias("folder"))
    rows = rows.where(~F.lower("folder").contains("test") & ~F.col("folder").contains(".dist-info"))
    if name:
        rows = rows.where(F.element_at(F.split("folder", "/"), -1) == name)
    return rows.groupBy("impl").agg(F.min_by("folder", F.struct(F.length("folder"), "folder")).alias("folder"))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(bucket, item_id, payload, ok) of MANIFEST.tsv's items below folder/items/bucket/: ok is false where the file is missing or its digest differs."""
    manifest = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(f"{folder}/MANIFEST.tsv")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder}/items")
    parts = F.split("path", "/")
    found = found.select(F.element_at(parts, -2).alias("bucket"), F.element_at(parts, -1).alias("item_id"), F.col("content").alias("payload"))
    both = manifest.select("bucket", "item_id", "sha256").join(found, ["bucket", "item_id"], "left")
    return both.select("bucket", "item_id", "payload", F.coalesce(F.sha2("payload", 256) == F.col("sha256"), F.lit(False)).alias("ok"))


def checked(items: DataFrame) -> DataFrame:
    """The corpus, whose reading fails at the first item that isn't ok."""
    return items.where(F.assert_true(F.col("ok"), F.concat(F.lit("digest differs or file missing: "), F.col("bucket"), F.lit("/"), F.col("item_id"))).isNull()).drop("ok")


def unpack(packed: bytes) -> Iterator[bytes]:
    """Payloads behind four-byte big-endian lengths; a cut one raises."""
    at = 0
    while at < len(packed):
        size = int.from_bytes(packed[at : at + 4], "big")
        at += 4
        if at + size > len(packed):
            raise ValueError("the packed file is cut short")
        yield packed[at : at + size]
        at += size


def packed_items(blobs: DataFrame, column: str = "content") -> DataFrame:
    """(idx, payload) of packed files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for blob in df["blob"]:
                yield pd.DataFrame(list(enumerate(unpack(bytes(blob)))), columns=["idx", "payload"])

    return blobs.select(F.col(column).alias("blob")).mapInPandas(run, "idx int, payload binary")


def random_items(spark: SparkSession, seed: int = 20260522, n: int = 1000, most: int = 4096) -> DataFrame:
    """(item_id, payload): seeded random bytes; the generator is one stream, so it runs in one place."""
    rng = random.Random(seed)
    rows = [(f"rand_{i:04d}", bytes(rng.randrange(256) for _ in range(rng.randint(0, most)))) for i in range(n)]
    return spark.createDataFrame(rows, "item_id string, payload binary")


def encoded(texts: DataFrame, charsets: list[str] | None = None) -> DataFrame:
    """(text_id, charset, charset_no, payload) of texts(text_id, text) in each charset, what it lacks left out."""
    charsets = charsets or CHARSETS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [(t, c, i, (s or "").encode(c, "ignore")) for t, s in zip(df["text_id"], df["text"]) for i, c in enumerate(charsets)]
            yield pd.DataFrame(rows, columns=["text_id", "charset", "charset_no", "payload"])

    return texts.select("text_id", "text").mapInPandas(run, f"text_id {texts.schema['text_id'].dataType.simpleString()}, charset string, charset_no int, payload binary")


def hard_workload(texts: DataFrame, lengths: list[int] | None = None) -> DataFrame:
    """(digest, payload, text_id, charset, length): short ambiguous inputs. Each text in each charset, cut to each length, from four bytes; the first of equal payloads stays."""
    cut = encoded(texts).withColumn("length", F.explode(F.array(*map(F.lit, lengths or LENGTHS)))).withColumn("payload", F.expr("substring(payload, 1, length)"))
    cut = cut.where(F.octet_length("payload") >= 4).withColumn("digest", F.sha2("payload", 256))
    first = cut.groupBy("digest").agg(F.min(F.struct("text_id", "charset_no", "length", "charset")).alias("f"), F.first("payload").alias("payload"))
    return first.select("digest", "payload", "f.text_id", "f.charset", "f.length")


def adversarial(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"adv_{i:02d}", b) for i, b in enumerate(ADVERSARIAL)], "item_id string, payload binary")


def mime(text: Column, charset: str, transfer: str = "8bit") -> Column:
    """A text as a mail of one part."""
    head = f'MIME-Version: 1.0\r\nContent-Type: text/plain; charset="{charset}"\r\nContent-Transfer-Encoding: {transfer}\r\n\r\n'
    return F.concat(F.lit(head), text, F.lit("\r\n"))


def cut_utf8(payload: Column, most: int) -> Column:
    """At most `most` bytes of UTF-8, cut before a character and never in one."""
    whole = F.expr("1")
    for back in range(4):  # the last byte that stays must end a character
        next_byte = F.conv(F.hex(F.substring(payload, most - back + 1, 1)), 16, 10).cast("int")
        whole = F.when((F.octet_length(payload) <= most - back) | next_byte.isNull() | (next_byte.bitwiseAND(0xC0) != 0x80), F.substring(payload, 1, most - back)) if back == 0 else whole.when(next_byte.bitwiseAND(0xC0) != 0x80, F.substring(payload, 1, most - back))
    return whole
