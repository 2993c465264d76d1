"""Agreement of detectors on items: rows are (impl, workload, bucket, item, enc, conf)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.columns import confidence_bucket, pilot_label, report_bucket, safe_div
from tracewell.operators.similarity import first_n


def detect(items: DataFrame, impl: str, detector: Callable[[bytes], tuple[str | None, float | None]]) -> DataFrame:
    """Runs a Python detector over items(workload, bucket, item, payload); an error becomes the label ERR:<its type>."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            found = []
            for payload in df["payload"]:
                try:
                    found.append(detector(bytes(payload)))
                except Exception as e:
                    found.append((f"ERR:{type(e).__name__}", None))
            yield df[["workload", "bucket", "item"]].assign(impl=impl, enc=[x[0] for x in found], conf=[x[1] for x in found])

    return items.mapInPandas(run, "workload string, bucket string, item string, impl string, enc string, conf double")


def paired(found: DataFrame, a: str, b: str) -> DataFrame:
    """One row an item that both detectors saw; keys that start with two underscores are no items."""
    rows = found.where(~F.col("item").cast("string").startswith("__"))
    sides = [rows.where(F.col("impl") == impl).select("workload", "bucket", "item", F.col("enc").alias(f"enc_{x}"), F.col("conf").alias(f"conf_{x}")) for impl, x in ((a, "a"), (b, "b"))]
    return sides[0].join(sides[1], ["workload", "bucket", "item"])


def _both(f: Callable[[Column, Column], Column]) -> Column:
    return f(F.col("enc_a"), F.col("conf_a")).eqNullSafe(f(F.col("enc_b"), F.col("conf_b")))


def exact() -> Column:
    return F.col("enc_a").eqNullSafe(F.col("enc_b")) & F.col("conf_a").eqNullSafe(F.col("conf_b"))


def same_bucket() -> Column:
    return F.col("enc_a").eqNullSafe(F.col("enc_b")) & _both(lambda e, c: confidence_bucket(c))


def same_normalised() -> Column:
    return _both(report_bucket) & _both(lambda e, c: confidence_bucket(c))


def report(pairs: DataFrame) -> DataFrame:
    """Counts and rates of each bucket and of all (bucket null)."""
    n = F.count(F.lit(1))
    counts = {"exact": F.count_if(exact()), "bucketed": F.count_if(same_bucket()), "normalised": F.count_if(same_normalised())}
    flagged = pairs.select("bucket", exact().alias("e"), same_bucket().alias("b"), same_normalised().alias("m"))
    out = flagged.groupingSets([["bucket"], []], "bucket").agg(F.count_if("e").alias("exact"), F.count_if("b").alias("bucketed"), F.count_if("m").alias("normalised"), n.alias("n"))
    return out.select("bucket", *counts, "n", *(safe_div(F.col(c), F.col("n")).alias(f"{c}_rate") for c in counts))


def samples(pairs: DataFrame, n: int = 5) -> DataFrame:
    """The first n disagreements of each bucket by item."""
    rows = pairs.where(~exact()).withColumn("normalised_agree", same_normalised())
    return first_n(rows, ["bucket"], ["item"], n).select("bucket", "item", "enc_a", "conf_a", "enc_b", "conf_b", "normalised_agree")


def discriminating(found: DataFrame, impls: int) -> DataFrame:
    """(workload, item) that all detectors saw and on whose label they don't agree."""
    rows = found.where(~F.col("item").cast("string").startswith("__")).withColumn("label", F.coalesce(pilot_label(F.col("enc")), F.lit("\0")))
    return rows.groupBy("workload", "item").agg(F.countDistinct("impl").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where((F.col("n") == impls) & (F.col("lo") != F.col("hi"))).select("workload", "item")


def agreement(pairs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(workload, n, agreement) of the pilot's labels, over the items of `only` where given; no rows for no items."""
    rows = pairs if only is None else pairs.join(only, ["workload", "item"], "left_semi")
    return rows.groupBy("workload").agg(F.count(F.lit(1)).alias("n"), F.avg(pilot_label(F.col("enc_a")).eqNullSafe(pilot_label(F.col("enc_b"))).cast("double")).alias("agreement"))


def confidence_agreement(pairs: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(n, agreement) of confidences within the tolerance, over rows of equal labels with both confidences; NaN over no rows."""
    rows = pairs.where(F.col("conf_a").isNotNull() & F.col("conf_b").isNotNull() & pilot_label(F.col("enc_a")).eqNullSafe(pilot_label(F.col("enc_b"))))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg((F.abs(F.col("conf_a") - F.col("conf_b")) <= tolerance).cast("double")), F.lit(float("nan"))).alias("agreement"))


def vocabulary(found: DataFrame) -> DataFrame:
    """(side, key, cnt) of the labels that a detector gives, as spelt, errors left out: a set for Jaccard."""
    rows = found.where((F.col("enc") != "") & ~F.col("enc").startswith("ERR"))
    return rows.select(F.col("impl").alias("side"), F.col("enc").alias("key")).distinct().withColumn("cnt", F.lit(1))


def realistic_rate(by_bucket: DataFrame, control: str = "random_control") -> DataFrame:
    """The normalised rate over all buckets but the control."""
    rows = by_bucket.where(F.col("bucket").isNotNull() & (F.col("bucket") != control))
    return rows.agg(F.sum("normalised").alias("normalised"), F.sum("n").alias("n")).select("normalised", "n", safe_div(F.col("normalised"), F.col("n")).alias("rate"))
