"""Detector corpora made of the tables, and detectors run over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import behaviour as B
from tracewell.plans.registry import query, table
from tracewell.sources import corpora

_HEAD = corpora.mail_head("corpus@example.invalid", "reader@example.invalid", "A document", "Thu, 28 May 2026 00:00:00 +0000", "8bit").replace("{charset}", "utf-8")
_HEAD_SQL = " || ".join(f"'{line}' || chr(13) || chr(10)" for line in _HEAD.split("\r\n")[:-1])


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as UTF-8, as a mail and encoded twice, and the start of each page; null texts make no items."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("item_id"), "text")
    payloads = {"multilingual_utf8": F.encode("text", "UTF-8"), "email_mime": F.encode(F.concat(F.lit(_HEAD), "text"), "UTF-8"), "malformed": corpora.twice_encoded(F.col("text"))}
    one = F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), p.alias("payload")) for b, p in payloads.items()]))
    fetched = table(spark, sf_dir, "pages").where("html is not null").select(F.lit("html").alias("bucket"), F.col("page_id").cast("string").alias("item_id"), F.encode("html", "UTF-8").alias("content"))
    return docs.select("item_id", one.alias("x")).select("x.bucket", "item_id", "x.payload").unionByName(corpora.pages(fetched))


@query(
    f"""WITH x AS (SELECT 'multilingual_utf8' AS bucket, doc_id::VARCHAR AS item_id, encode(text) AS payload FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT 'email_mime', doc_id::VARCHAR, encode({_HEAD_SQL} || text) FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT 'malformed', doc_id::VARCHAR, unhex(array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CASE WHEN x < '80' THEN x WHEN x < 'C0' THEN 'C2' || x ELSE 'C3' || translate(x[1], 'CDEF', '89AB') || x[2] END), '')) FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT 'html', page_id::VARCHAR, unhex(regexp_replace(left(hex(encode(html)), {2 * corpora.PAGE_BYTES}), '(?:[89AB][0-9A-F])+$', '')) FROM pages WHERE html IS NOT NULL)
    SELECT bucket, item_id, octet_length(payload) AS size_bytes, sha256(payload) AS sha256 FROM x"""
)
def s8_corpus_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and digests of the corpus."""
    return corpora.manifest(items(spark, sf_dir), "synthesized", "documents and pages", "as the tables", "2026-05-28").select("bucket", "item_id", "size_bytes", "sha256")


def _strict(payload: bytes) -> tuple[str, float]:
    if not payload:
        raise ValueError("nothing to read")
    payload.decode("utf-8")
    return ("ascii", 1.0) if payload.isascii() else ("utf-8", 0.99)


def _loose(payload: bytes) -> tuple[str, float]:
    return ("ISO_8859-1", 0.5) if any(x > 0x7F for x in payload) else ("US-ASCII", 0.75)


@query(
    """WITH x AS (SELECT doc_id::VARCHAR AS item, text, octet_length(encode(text)) AS bytes FROM documents WHERE text IS NOT NULL)
    SELECT item, 'strict' AS impl, CASE WHEN bytes = 0 THEN 'ERR:ValueError' WHEN bytes = length(text) THEN 'ascii' ELSE 'utf-8' END AS enc, CASE WHEN bytes = 0 THEN NULL WHEN bytes = length(text) THEN 1.0 ELSE 0.99 END::DOUBLE AS conf FROM x
    UNION ALL SELECT item, 'loose', CASE WHEN bytes = length(text) THEN 'US-ASCII' ELSE 'ISO_8859-1' END, CASE WHEN bytes = length(text) THEN 0.75 ELSE 0.5 END FROM x""",
    python=True,
)
def s13_detector_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two detectors over every document's UTF-8."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select(F.lit("documents").alias("workload"), F.lit("utf8").alias("bucket"), F.col("doc_id").cast("string").alias("item"), F.encode("text", "UTF-8").alias("payload"))
    found = B.detect(rows, "strict", _strict).unionByName(B.detect(rows, "loose", _loose))
    return found.select("item", "impl", "enc", "conf")
