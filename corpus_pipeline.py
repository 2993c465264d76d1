"""The corpus pipeline: five stages over the documents.

Each stage gets what its predecessor kept, as a table written in the shared folder, and returns the columns of documents (the last one its own). Rows with
equal doc_ids are documents of their own: each stage decides by a row's text, language, source and doc_id together, null or not; rows that are equal in these four are one document,
and the near-copy stage keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import decontaminate, language, quality, sentencepiece, simhash
from tracewell.llm.common import Scratch, spare, table, without
from tracewell.llm.queries import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is THRESHOLD or more, by a model of the labelled ones among them."""
    model = quality.fit(docs, quality.training_rows(table(spark, sf_dir, "labels")), "quality")
    score = spare(docs.columns, "score")
    return quality.score(docs, model, docs.columns, score).where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a hash of doc_id, text, lang and source, and that column's name."""
    row = spare(docs.columns, "row")
    return docs.withColumn(row, F.xxhash64("doc_id", "text", "lang", "source")), row


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the table declares: those go whose evidence says UNKNOWN, or that have no letters at all."""
    model = language.fit(docs, "doc_id", "text", "lang")
    rows, row = with_row(docs)
    evidence = language.text_evidence(rows, model, row, "text", "lang", "source")
    scratch = Scratch(spark, "language")
    unknown = language.fuse(evidence, model.languages, scratch).where(F.col("language") == language.UNKNOWN).select(F.col("key").alias(row))
    return without(rows, unknown, row, scratch).where(F.col("text").rlike(r"\p{L}")).select(*docs.columns)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id (a null one last; of equal doc_ids the smallest hash); documents without words are no copies."""
    scratch = Scratch(spark, "copies")
    rows, row = with_row(docs)
    found = scratch.write(simhash.similar_copies(rows, shingle=5, keep=[row]).select("root", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row).alias("by")), "groups")
    # a table of its own, so that the join may split a large group
    first = scratch.write(found.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("by").alias("first")).where("n > 1"), "first")
    later = found.join(first, "root").where(F.col(f"by.{row}") != F.col(f"first.{row}")).select(F.col(f"by.{row}").alias(row))
    kept = without(rows, later, row, scratch)
    # texts are shuffled only if whole rows come again, which their hashes alone tell
    again = rows.groupBy(row).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return (kept if again.isEmpty() else kept.dropDuplicates([row])).select(*docs.columns)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the pieces, their number, and whether decoding gives the text back."""
    coded = sentencepiece.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary("piece_bpe_32k.model"), same="same_text")
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").alias("n_pieces"), "same_text")


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_copies", keep_first_copies),
    ("decontaminate", keep_unleaked),
    ("sentencepiece", encode_pieces),
]

#: The stages learn models and hash shingles; SQL can't express them. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
