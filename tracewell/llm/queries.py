"""One query for each operator of this subpackage, over its whole table; SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import ann, chat, decontaminate, html_text, language, licenses, quality, sentencepiece, simhash, token_store
from tracewell.llm.common import Scratch, table

#: Folder of the public vocabulary files; None: that of the installed package.
TOKENIZER_FOLDER: str | None = None


def vocabulary(name: str) -> str:
    if TOKENIZER_FOLDER:
        return f"{TOKENIZER_FOLDER}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "tokens").next_path("store")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=1)
    return token_store.read_tokens(spark, path)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text model is learnt from documents; hosts, declarations and addresses are those of the pages."""
    model = language.fit(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    found = language.fuse(language.page_evidence(table(spark, sf_dir, "pages"), model), model.languages, Scratch(spark, "language"))
    return found.withColumnRenamed("key", "page_id").withColumn("posterior", F.round("posterior", 6))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text, decodes the ids and compares the texts: the ids' number, their crc32 (as text, joined by spaces), and whether the text came back."""
    path = vocabulary("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = sentencepiece.encode(docs.withColumn("text_sha256", F.sha2("text", 256)), path)
    back = sentencepiece.decode(coded, path)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.crc32(F.array_join("ids", " ").cast("binary")).alias("ids_crc32"), F.length("text").cast("long").alias("n_chars"), (F.sha2("text", 256) == F.col("text_sha256")).alias("same_text"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(table(spark, sf_dir, "documents"), bits=4, shingle=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: A conversation whose texts hold what other templates use as marks.
MARKS = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(MARKS, "conv_id long, turn long, role string, text string"))
    return chat.digests(chat.format_messages(turns.withColumn("parts", chat.text_part(F.col("text")))))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(documents, quality.training_rows(labels), "quality")
    scored = quality.score(documents, model).withColumn("held_out", quality.held_out())
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_licenses": op2_licenses,
    "op3_html_text": op3_html_text,
    "op4_language": op4_language,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_simhash": op6_simhash,
    "op7_chat": op7_chat,
    "op8_decontaminate": op8_decontaminate,
    "op9_ann": op9_ann,
    "op10_quality": op10_quality,
}

ORACLE_SQL: dict[str, str] = {}
