"""Writers: JSON lines, CSV, per-document folders, append logs, manifests, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import command_line, config_text, strip_controls


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with nulls spelled out; the committer makes the folder appear whole."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def as_csv_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns in a fixed order (others ignored), booleans as TRUE and FALSE."""
    kinds = {f.name: f.dataType for f in df.schema}
    pick = columns or df.columns
    return df.select(*[F.upper(F.col(c).cast("string")).alias(c) if isinstance(kinds[c], T.BooleanType) else F.col(c) for c in pick])


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "errorifexists") -> None:
    as_csv_values(df, columns).write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def with_total(detail: DataFrame, total: DataFrame, key: str, name: str = "ALL") -> DataFrame:
    """Detail rows and after them, by ``row_order``, the total row."""
    return detail.withColumn("row_order", F.lit(0)).unionByName(total.withColumn(key, F.lit(name)).withColumn("row_order", F.lit(1)), allowMissingColumns=True)


def sheet_text(df: DataFrame) -> DataFrame:
    """Rows whose strings hold no control characters, fit for a workbook."""
    return df.select(*[strip_controls(f.name).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema])


def write_per_document(df: DataFrame, path: str, key: str, kind: str = "csv", mode: str = "errorifexists") -> None:
    """A folder for each document. Rows are dealt out by it first, so a document is one file."""
    w = as_csv_values(df).repartition(key).write.mode(mode).partitionBy(key)
    w.option("header", True).csv(path) if kind == "csv" else w.format(kind).save(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def read_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the files of a folder and of those below it."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "content")


def build_manifest(files: DataFrame, root: str = "") -> DataFrame:
    """(name, path, size_bytes, md5) of files (path, content); paths below ``root`` are relative to it."""
    at = F.when(F.startswith("path", F.lit(root)), F.expr(f"substring(path, {len(root) + 1})")).otherwise(F.col("path")) if root else F.col("path")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), at.alias("path"), F.octet_length("content").cast("long").alias("size_bytes"), F.md5("content").alias("md5"))


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(name, error) of the entries that fail: the first failing check of each."""
    have = files.select(F.col("name"), F.col("size_bytes").alias("_size"), F.col("md5").alias("_md5"))
    x = manifest.join(have, "name", "left")
    error = (
        F.when(F.col("name").isNull() | (F.col("name") == ""), "missing name")
        .when(F.col("_size").isNull(), "missing file")
        .when(F.col("size_bytes").isNotNull() & (F.col("size_bytes") != F.col("_size")), "size mismatch")
        .when(F.col("md5").isNotNull() & (F.col("md5") != F.col("_md5")), "md5 mismatch")
    )
    return x.select("name", error.alias("error")).where("error is not null")


def unchanged(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose (name, md5) the manifest doesn't hold: what is left to do."""
    return files.join(manifest.select("name", "md5"), ["name", "md5"], "left_anti")


def repro_files(command, **settings) -> list:
    """The sidecars of a run as columns: ``command.txt`` of an array of words, ``config.json`` of its settings."""
    return [F.concat(command_line(command), F.lit("\n")).alias("command.txt"), F.concat(config_text(**settings), F.lit("\n")).alias("config.json")]


def markdown_rows(df: DataFrame) -> list:
    """The head of a report's table, and the column that is its row for each row of ``df``."""
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), "\n", " ")
    line = lambda xs: "| " + " | ".join(xs) + " |"
    return [[line(df.columns), line(["---"] * len(df.columns))], F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |"))]


def markdown_report(df: DataFrame, order: list[str]) -> DataFrame:
    """(part, line): the lines of a report's table, its head (part 0) and its rows (part 1), written in order by range."""
    head, row = markdown_rows(df)
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.lit(1).alias("part"), row.alias("line"))
    return df.sparkSession.createDataFrame([(0, x) for x in head], "part int, line string").coalesce(1).unionByName(rows)


def sanitize_schema(schema, drop: tuple[str, ...] = ("$schema", "additionalProperties", "title", "$id")):
    """A JSON schema without the given keys, at any depth."""
    if isinstance(schema, dict):
        return {k: sanitize_schema(v, drop) for k, v in schema.items() if k not in drop}
    return [sanitize_schema(v, drop) for v in schema] if isinstance(schema, list) else schema


def sanitized_schema(c, drop: tuple[str, ...] = ("$schema", "additionalProperties", "title", "$id")):
    """``sanitize_schema`` of JSON texts; null where a text is no JSON."""

    def one(text):
        try:
            return json.dumps(sanitize_schema(json.loads(text), drop), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    return F.pandas_udf(lambda texts: texts.map(one), "string")(c)


def output_key(model: str, family: str, mode: str) -> str:
    """The name of a run's outputs."""
    return "__".join(x.replace("/", "_").replace(":", "_") for x in (model, family, mode))
