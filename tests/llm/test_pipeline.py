"""The pipeline's stages, each against its operator by brute force, on planted rows."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tracewell.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """The small tables with planted copies and leaks, and columns of clashing names."""
    folder = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = docs.join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").where("length(text) > 1500").orderBy("doc_id").limit(12).collect()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 150").first().text
    rng = random.Random(0)
    rows = []
    for k, r in enumerate(good[:6]):
        rows.append((900_000 + k, r.text, r.lang, r.source, len(r.text)))
        words = r.text.split(" ")
        words[rng.randrange(20, len(words) - 20)] = "edited"
        rows.append((910_000 + k, " ".join(words), r.lang, r.source, 0))
    for k, r in enumerate(good[6:]):
        rows.append((920_000 + k, f"{r.text[:600]} {item} {r.text[600:1200]}", r.lang, r.source, 0))
    rows += [(930_000, None, "en", "s", 0), (930_001, "", "en", "s", 0), (930_002, "--- 123 !!!", "en", "s", 0), (None, good[7].text[::-1], "en", "s", 0)]
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


def test_stages(spark, inputs):
    docs = spark.read.parquet(f"{inputs}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{inputs}/labels.parquet").collect()}
    at, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in at.select("doc_id").collect()}
        out = stage(spark, at, inputs)
        if name != "sentencepiece":
            assert out.columns == docs.columns
            out.write.parquet(f"{inputs}/{name}")
            out = spark.read.parquet(f"{inputs}/{name}")
        kept[name] = [r.doc_id for r in out.select("doc_id").collect()]
        assert set(kept[name]) <= before
        at = out
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in set(kept["quality"]) for d in good) / len(good) > 0.98
    assert sum(d in set(kept["quality"]) for d, q in labels.items() if q == 0) <= 0.05 * (len(labels) - len(good))
    assert len(set(kept["quality"]) - set(kept["language"])) <= 5
    assert not {930_000, 930_001, 930_002} & set(kept["language"])
    copies = set(kept["near_copies"])
    assert not any(x // 1000 in (900, 910) for x in copies if x) and len(copies) == len(kept["near_copies"])
    leaked = {d for d in copies if d and d // 1000 == 920}
    assert leaked and not leaked & set(kept["decontaminate"]) and None in kept["language"]
    rows = at.collect()
    assert len(rows) == len(kept["decontaminate"]) and all(r.same_text and r.n_pieces == len(r.ids) for r in rows)


def test_run_equals_the_stages(spark, inputs):
    from pyspark.sql import SparkSession

    assert isinstance(spark, SparkSession) and corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, inputs).count() > 500


def test_empty_documents(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).withColumn("score", F.lit(1.0)).withColumn("leaks", F.lit("x")).withColumn("_text", F.lit(2))
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    assert quality.THRESHOLD == 0.3


def test_copies_of_rows_without_or_with_equal_ids(spark):
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    one, two, three, long = text(), text(), text(), " ".join(f"x{i}" for i in range(60_000))
    rows = [(7, one), (7, two), (7, two), (None, one), (None, three), (None, three), (3, two), (9, long), (8, long + " end"), (1, ""), (2, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted([(7, one), (None, three), (3, two), (8, long + " end"), (1, ""), (2, None)], key=str)
    for parts in (1, 5):
        kept = corpus_pipeline.keep_first_copies(spark, docs.repartition(parts), SF)
        assert kept.columns == docs.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == want
