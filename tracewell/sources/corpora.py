"""Builders of detector corpora: items (bucket, item_id, payload), their manifest and their files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.sources.trees import random_items

ITEM = "bucket string, item_id string, payload binary"
MANIFEST = ["bucket", "item_id", "source_type", "origin", "license", "accession_date", "size_bytes", "sha256"]
#: Bytes of a fetched page that stay.
PAGE_BYTES = 8192
# The languages that each encoding's bucket holds.
MULTILINGUAL = {
    "utf-8": "en fr de es zh ja ko ru ar".split(),
    "gb18030": "zh en ja ko ru".split(),
    "shift_jis": "ja en".split(),
    "windows-1252": "en fr de es".split(),
    "iso-8859-1": "en fr de es".split(),
}
# The mails (language, charset, transfer encoding).
MAILS = [
    ("fr", "utf-8", "8bit"),
    ("zh", "utf-8", "8bit"),
    ("de", "iso-8859-1", "8bit"),
    ("es", "windows-1252", "8bit"),
    ("zh", "gb18030", "8bit"),
    ("ja", "shift_jis", "8bit"),
    ("en", "ascii", "7bit"),
]
# Short fragments.
SNIPPETS = [
    ("hi_ascii", b"hi"),
    ("hello_world", b"hello, world!"),
    ("digits", b"1234567890"),
    ("html_tag", b"<p>hello</p>"),
    ("subject_ascii", b"Subject: tea\r\n"),
    ("utf8_bom_ascii", b"\xef\xbb\xbfBOM-prefixed UTF-8."),
    ("utf16le_bom", b"\xff\xfeh\x00i\x00"),
    ("utf16be_bom", b"\xfe\xff\x00h\x00i"),
    ("french_iso88591", "café et croissant".encode("iso-8859-1")),
    ("german_iso88591", "Straße und Würde".encode("iso-8859-1")),
    ("spanish_w1252", "mañana señora".encode("windows-1252")),
    ("japanese_sjis", "こんにちは".encode("shift_jis")),
    ("chinese_gb18030", "你好世界".encode("gb18030")),
    ("russian_utf8", "Привет".encode("utf-8")),
    ("arabic_utf8", "مرحبا".encode("utf-8")),
    ("korean_utf8", "안녕하세요".encode("utf-8")),
]


def strictly_encoded(texts: DataFrame, plan: list[tuple[str, str, str, str]], head: str = "") -> DataFrame:
    """Items of texts(lang, text): for each (lang, charset, bucket, item_id) of the plan the text in that charset, after an ASCII head in which {charset} is filled in.

    A text that the charset can't express gives no item, as does a null one. Several rows of a language give several items of one id.
    """
    wanted = texts.sparkSession.createDataFrame(plan, "lang string, charset string, bucket string, item_id string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for r in df.itertuples():
                try:
                    out.append((r.bucket, r.item_id, head.replace("{charset}", r.charset).encode("ascii") + r.text.encode(r.charset)))
                except UnicodeEncodeError:
                    continue
            yield pd.DataFrame(out, columns=["bucket", "item_id", "payload"])

    return texts.where("text is not null").select("lang", "text").join(F.broadcast(wanted), "lang").mapInPandas(run, ITEM)  # a plan is a few dozen rows


def multilingual(texts: DataFrame, name: str = "text", plan: dict[str, list[str]] | None = None) -> DataFrame:
    """A bucket for each encoding, an item for each of its languages."""
    short = lambda e: e.replace("-", "").replace("_", "")
    return strictly_encoded(texts, [(lang, e, f"multilingual_{short(e)}", f"{name}_{lang}_{short(e)}") for e, langs in (plan or MULTILINGUAL).items() for lang in langs])


def mail_head(sender: str, to: str, subject: str, date: str, transfer: str) -> str:
    lines = [f"From: {sender}", f"To: {to}", f"Subject: {subject}", f"Date: {date}", "MIME-Version: 1.0", "Content-Type: text/plain; charset={charset}", f"Content-Transfer-Encoding: {transfer}"]
    return "".join(f"{x}\r\n" for x in [*lines, ""])


def mails(texts: DataFrame, sender: str, to: str, subject: str, date: str, plan: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Mails of one part, one for each (language, charset, transfer encoding)."""
    out, plan = None, plan or MAILS
    for transfer in sorted({t for _, _, t in plan}):
        wanted = [(lang, c, "email_mime", f"email_{c.replace('-', '').replace('_', '')}_{lang}") for lang, c, t in plan if t == transfer]
        part = strictly_encoded(texts, wanted, mail_head(sender, to, subject, date, transfer))
        out = part if out is None else out.unionByName(part)
    return out


def page_start(page: Column, most: int = PAGE_BYTES) -> Column:
    """The first `most` bytes of a page (binary) read as UTF-8, less the continuation bytes at their end; its last lead byte may stay, as the published digests have it."""
    whole = F.encode(F.make_valid_utf8(page.cast("string")), "UTF-8")
    return F.unhex(F.regexp_replace(F.hex(F.substring(whole, 1, most)), "(?:[89AB][0-9A-F])+$", ""))


def pages(fetched: DataFrame, most: int = PAGE_BYTES) -> DataFrame:
    """Items of fetched(bucket, item_id, content)."""
    return fetched.select("bucket", "item_id", page_start(F.col("content"), most).alias("payload"))


def plain_starts(fetched: DataFrame) -> DataFrame:
    """Items of fetched(item_id, content, most): the first bytes of plain ASCII documents."""
    return fetched.select(F.lit("rfc_ascii").alias("bucket"), "item_id", F.expr("substring(content, 1, most)").alias("payload"))


def snippets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("short_snippets", n, b) for n, b in SNIPPETS], ITEM)


def twice_encoded(text: Column) -> Column:
    """UTF-8 taken for Latin-1 and encoded again."""
    return F.encode(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "UTF-8")


def malformed(spark: SparkSession, en: str, fr: str, zh: str, ja: str) -> DataFrame:
    """Mixed, cut and twice encoded bytes of four texts; the English one must be ASCII."""
    ascii_text = en.encode("ascii")
    rows = [
        ("utf8_double_encoded_fr", fr.encode().decode("latin-1").encode()),
        ("mixed_gb18030_then_shiftjis", zh.encode("gb18030") + ja.encode("shift_jis")),
        ("latin1_then_utf8_then_latin1", "café ".encode("latin-1") + "你好 ".encode() + "Straße".encode("latin-1")),
        ("utf8_truncated_midcodepoint", zh.encode()[:-2] + b"\xe4\xb8"),
        ("ascii_with_random_high_byte", ascii_text + b"\xc3" + ascii_text),
        ("w1252_smartquotes_plus_utf8", b"He said \x93hello\x94. " + "Smile \U0001f603!".encode()),
    ]
    return spark.createDataFrame([("malformed", n, b) for n, b in rows], ITEM)


def random_control(spark: SparkSession, seed: int = 20260522, n: int = 1000, most: int = 4096) -> DataFrame:
    """One item that packs all seeded random ones behind four-byte lengths: n * most bytes at most."""
    one = F.concat(F.unhex(F.lpad(F.hex(F.octet_length("payload")), 8, "0")), "payload")
    every = F.array_sort(F.collect_list(F.struct("item_id", one.alias("x"))))
    packed = random_items(spark, seed, n, most).agg(F.aggregate(every, F.unhex(F.lit("")), lambda s, x: F.concat(s, x["x"])).alias("payload"))
    return packed.select(F.lit("random_control").alias("bucket"), F.lit("random_fuzz").alias("item_id"), "payload")


def manifest(items: DataFrame, source_type: str, origin: str, terms: str, date: str) -> DataFrame:
    """A row an item: where it comes from, its size and digest. The date is given, so that a rebuilt corpus has the same digest."""
    fixed = {"source_type": source_type, "origin": origin, "license": terms, "accession_date": date}
    rows = items.select("bucket", "item_id", *(F.lit(v).alias(k) for k, v in fixed.items()), F.octet_length("payload").alias("size_bytes"), F.sha2("payload", 256).alias("sha256"))
    return rows.select(*MANIFEST)


def write_corpus(items: DataFrame, rows: DataFrame, folder: str) -> None:
    """items/bucket/item_id by the executors, then MANIFEST.tsv in order (in a folder of that name, as Spark writes): trees.corpus reads both. The folder must be one that all of them share."""
    from pyspark.sql.functions import col

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for df in batches:
            for r in df.itertuples():
                system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
                system.create_dir(f"{root}/items/{r.bucket}", recursive=True)
                with system.open_output_stream(f"{root}/items/{r.bucket}/{r.item_id}") as f:  # a task that runs again writes the same bytes
                    f.write(r.payload)
            yield pd.DataFrame({"n": [len(df)]})

    items.select("bucket", "item_id", "payload").mapInPandas(write, "n long").write.format("noop").mode("overwrite").save()
    rows.orderBy(col("bucket"), col("item_id")).coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(f"{folder}/MANIFEST.tsv")
