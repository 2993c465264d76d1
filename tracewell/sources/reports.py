"""Reports of measurements: reading and writing them, and the tables behind figures."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.columns import number_after

#: Columns of a signal row, as every report has them.
SIGNAL = ["signal", "contract", "expected", "actual", "verdict", "evidence"]


def witness(spark: SparkSession, path: str) -> DataFrame:
    """Signal rows of a tab-separated witness: comment lines, the header and rows of fewer than six fields are left out. Rows are told apart by (signal, contract), never by one of them."""
    rows = spark.read.option("sep", "\t").option("comment", "#").option("header", True).option("quote", "").option("mode", "PERMISSIVE").csv(path)
    return rows.toDF(*SIGNAL, *rows.columns[6:]).select(*SIGNAL).where(F.col("evidence").isNotNull())


def numbers(rows: DataFrame, keys: list[str]) -> DataFrame:
    """signal, contract and the number after each `key=` in `actual`; null where it isn't there."""
    return rows.select("signal", "contract", *(number_after(F.col("actual"), k).alias(k) for k in keys))


def json_report(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document, which may hold bare NaN."""
    return spark.read.option("multiLine", True).json(path)


def shown_numbers(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """(name, value) of the first match of each pattern's group in a text; empty if there is none."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.regexp_extract("value", p, 1).alias("value")) for n, p in patterns.items()])).alias("x")).select("x.*")


def plan(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """units(g, id, layer, tier, loc), depends(g, id, on), blocks(id, blocked) of a TOML plan."""
    units = tomllib.loads(text).get("units", {})
    rows = [(u, x.get("layer"), x.get("tier"), x.get("estimated_loc", 0), x.get("depends_on", []), x.get("blocks", [])) for u, x in units.items()]
    df = spark.createDataFrame(rows, "id string, layer int, tier int, loc long, depends array<string>, blocks array<string>").withColumn("g", F.lit("plan"))
    return df.select("g", "id", "layer", "tier", "loc"), df.select("g", "id", F.explode("depends").alias("on")), df.select("id", F.explode("blocks").alias("blocked"))


def links(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """entities(kind, id) and links(src, rel, dst) of a TOML document of arrays of tables whose list fields name other entities' ids."""
    entities, out = [], []
    tables = {k: v for k, v in tomllib.loads(text).items() if isinstance(v, list)}
    ids = {x["id"] for rows in tables.values() for x in rows if isinstance(x, dict) and "id" in x}
    prefixes = {i.rstrip("0123456789") for i in ids}
    for kind, rows in tables.items():
        for x in rows:
            entities.append((kind, x.get("id")))
            for rel, value in x.items():
                for dst in value if isinstance(value, list) else [value]:
                    if rel != "id" and isinstance(dst, str) and dst.rstrip("0123456789") in prefixes:
                        out.append((x.get("id"), rel, dst))
    return spark.createDataFrame(entities, "kind string, id string"), spark.createDataFrame(out, "src string, rel string, dst string")


def write_signals(rows: DataFrame, path: str) -> None:
    """Tab-separated signal rows with a header, in one file (a report is a few dozen rows)."""
    rows.select(*SIGNAL).coalesce(1).write.option("sep", "\t").option("header", True).option("quote", "").csv(path)


def write_imports(audit: DataFrame, path: str) -> None:
    """The import audit by lower-cased module, then implementation."""
    audit.orderBy(F.lower("name"), "impl").coalesce(1).write.option("sep", "\t").option("header", True).csv(path)


def merged(static: DataFrame, behaviour: DataFrame) -> DataFrame:
    """A report's rows: static ones but those delegated, then the behaviour's."""
    return static.where(F.col("verdict") != "DELEGATED").unionByName(behaviour)


def exit_code(rows: DataFrame) -> int:
    """1 if any verdict is FAIL."""
    return int(not rows.where("verdict = 'FAIL'").isEmpty())


def patch(additions: dict[str, DataFrame], comparison: DataFrame | None = None, version: str = "1") -> DataFrame:
    """One JSON document of additions to a report (`value`): an `add` operation for each path (/a/b) with the rows of its frame, a flat copy by dotted path, and the comparison's rows.

    A frame's value is its one row, or a list of its rows in order; they are reports, a few rows each.
    """
    spark = next(iter(additions.values())).sparkSession
    parts = []
    for path, rows in additions.items():
        every = F.array_sort(F.collect_list(F.to_json(F.struct(*rows.columns))))
        parts.append(rows.agg(every.alias("r")).select(F.lit(path).alias("path"), F.when(F.size("r") == 1, F.col("r")[0]).otherwise(F.concat(F.lit("["), F.array_join("r", ","), F.lit("]"))).alias("body")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    out = out.withColumn("dotted", F.replace(F.expr("substring(path, 2)"), F.lit("/"), F.lit("."))).withColumn("op", F.concat(F.lit('{"op":"add","path":'), quoted("path"), F.lit(',"value":'), "body", F.lit("}"))).withColumn("flat", F.concat(quoted("dotted"), F.lit(":"), "body"))
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", c))), lambda x: x[c]), ",")
    listed = out.agg(*(in_order(c).alias(c) for c in ("op", "flat")))
    compared = comparison.agg(F.array_sort(F.collect_list(F.to_json(F.struct(*comparison.columns)))).alias("c")) if comparison is not None else spark.range(1).select(F.array().cast("array<string>").alias("c"))
    both = listed.join(F.broadcast(compared))  # one row each
    return both.select(F.concat(F.lit(f'{{"schema_version":"{version}","rfc6902_ops":['), "op", F.lit('],"additions":{'), "flat", F.lit('},"comparison":['), F.array_join("c", ","), F.lit("]}")).alias("value"))


def console_table(comparison: DataFrame, most: int = 1000) -> str:
    """Lines of name, expected, recomputed and agreement (as provenance.reconcile gives them) in order of names, and whether all agree; a comparison of more rows than `most` raises."""
    rows = comparison.orderBy("name").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows to show")
    show = lambda *x: "{:<45} {:>16} {:>16}  {}".format(*x)
    lines = [show("name", "expected", "recomputed", "agrees"), *(show(r.name, str(r.expected), str(r.recomputed), "YES" if r.agrees else "NO") for r in rows)]
    return "\n".join([*lines, f"all agree: {all(r.agrees for r in rows)}"])


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def agreement_json(report: DataFrame, samples: DataFrame) -> DataFrame:
    """One JSON document of an agreement report: the aggregate, and by bucket its counts, rates and first disagreements."""
    by = samples.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("item", "enc_a", "conf_a", "enc_b", "conf_b", "normalised_agree"))).alias("samples"))
    rows = report.join(by, "bucket", "left")
    body = F.struct(*[F.col(c) for c in sorted(c for c in rows.columns if c != "bucket")])
    return rows.agg(F.max(F.when(F.col("bucket").isNull(), body)).alias("aggregate"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("bucket").isNotNull(), F.struct("bucket", body.alias("of")))))).alias("per_bucket")).select(F.to_json(F.struct("aggregate", "per_bucket")).alias("value"))


def comparison(rows: DataFrame, pairs: list[str]) -> DataFrame:
    """Signals by pairs: (signal, a column for each pair)."""
    return rows.groupBy("signal").pivot("pair", pairs).agg(F.first("value"))
