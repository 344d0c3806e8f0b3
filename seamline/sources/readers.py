"""Readers: JSON lines, CSV, caches, parallel arrays, manifests, plain text, stand-off annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import collapse_space, strip

SENTENCE = "sentence_index int, sentence_text_full string, source_file string"
GOLD = "sentence_index int, sentence_text_full string, ground_truth_label string, source_file string, scene_id_raw string"
USAGE = "usage struct<prompt_tokens: int, output_tokens: int, thought_tokens: int>"
PREDICTION = (
    "key string, source_file string, sentence_index int, sentence_text_full string, parse_ok boolean, prediction_label string, "
    f"prediction_bool boolean, raw_model_response string, parse_error string, {USAGE}, error string"
)
CACHE = "map<string, struct<pred: string, reason: string, gold: string, sentence: string, parse_ok: boolean, parse_error: string, output_chars: int, latency_seconds: double>>"
RESULTS = (
    "original_indices array<int>, labels array<boolean>, predictions array<string>, ground_truth array<string>, reasons array<string>, sentences array<string>"
)
MANIFEST = "dataset string, index_base int, files array<struct<source_file: string, slug: string, jsonl: string, gold_csv: string, size_bytes: bigint, sentence_count: int, md5: string>>"
SPLITS = "splits map<string, array<string>>, expected_counts map<string, struct<sentences: int, scenes: int, non_scenes: int>>"


def read_jsonl(spark: SparkSession, path, schema: str) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped, malformed ones become rows of nulls."""
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path, schema: str | None = None) -> DataFrame:
    """CSV with a header; without a schema every column is a string."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (r.schema(schema) if schema else r).csv(path)


def read_documents_json(spark: SparkSession, path, schema: str) -> DataFrame:
    """Documents as JSON, one a line, so that a task holds one of them at a time."""
    return spark.read.schema(schema).json(path)


def infer_role(columns: list[str], preferred: list[str], parts: list[list[str]]) -> str | None:
    """The column of a role: the first preferred name that is there (in any case), else the first column whose
    name has all words of one of ``parts``, in order; else None."""
    low = {c.strip().lower(): c for c in reversed(columns)}
    for name in preferred:
        if name.lower() in low:
            return low[name.lower()]
    for words in parts:
        for c in columns:
            if all(w in c.lower() for w in words):
                return c
    return None


ROLES = {
    "scene": (["scene_id", "scene id", "scene", "szene"], [["scene"], ["szene"]]),
    "sentence_id": (["sentence_id", "sentence id", "sent_id", "id"], [["sentence", "id"], ["sent", "id"]]),
    "text": (["sentence", "sentence_text", "text", "satz"], [["sentence", "text"], ["text"], ["satz"]]),
}


def with_roles(df: DataFrame, required: tuple[str, ...] = ("scene", "text")) -> DataFrame:
    """The columns of the roles, named by them; a missing required role is an error, another is null."""
    out = []
    for role, (preferred, parts) in ROLES.items():
        c = infer_role(df.columns, preferred, parts)
        if c is None and role in required:
            raise ValueError(f"no column for {role} among {df.columns}")
        out.append((df[c] if c else F.lit(None).cast("string")).alias(role))
    return df.select(*out)


def explode_cache(df: DataFrame, column: str = "value") -> DataFrame:
    """Rows of a cache in JSON: digit keys alone, upper-cased labels (none: NOBORDER), confidence from the reason."""
    from ..functions.responses import confidence

    x = df.select(*[c for c in df.columns if c != column], F.explode(F.from_json(column, CACHE)).alias("key", "entry")).where("key rlike '^[0-9]+$'")
    label = lambda c: F.upper(F.coalesce(F.col(f"entry.{c}"), F.lit("NOBORDER")))
    return x.select(
        *[c for c in df.columns if c != column],
        F.col("key").cast("int").alias("idx"),
        label("pred").alias("pred"),
        label("gold").alias("gold"),
        confidence("entry.reason").alias("conf"),
        F.col("entry.sentence").alias("sentence"),
    )


def explode_results(df: DataFrame) -> DataFrame:
    """Rows of parallel arrays."""
    keep = [c for c in df.columns if not isinstance(df.schema[c].dataType, T.ArrayType)]
    arrays = [c for c in df.columns if c not in keep]
    return df.select(*keep, F.inline(F.arrays_zip(*arrays)))


def split_sentences(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, idx, text): a line each if there are several that aren't blank, else split after ``.!?``."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    flat = collapse_space(text)
    parts = F.filter(F.split(flat, r"(?<=[.!?]) +"), lambda x: x != "")
    return df.select(*keys, F.posexplode(F.when(F.size(lines) > 1, lines).otherwise(parts)).alias("idx", "text"))


def read_lines(spark: SparkSession, path) -> DataFrame:
    """(source_file, idx, text): one sentence a line, stripped, blank lines dropped."""
    x = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file"), "value")
    kept = F.filter(F.transform(F.split("value", "\r?\n"), strip), lambda v: v != "")
    return x.select("source_file", F.posexplode(kept).alias("idx", "text"))


def manifest_sentences(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """(slug, idx, key, text) of all files of a manifest, read as one; the slug defaults to the file's stem."""
    files = manifest.select(F.explode("files").alias("f")).select("f.*")
    paths = [f"{root}/{r[0]}" for r in files.select("jsonl").toLocalIterator()]
    rows = spark.read.schema(SENTENCE).json(paths).withColumn("_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    stem = F.regexp_replace(F.element_at(F.split("jsonl", "/"), -1), r"\.[^.]*$", "")
    names = files.select(F.element_at(F.split("jsonl", "/"), -1).alias("_file"), F.coalesce("slug", stem).alias("slug"))
    return rows.join(names, "_file").select(
        "slug", F.col("sentence_index").alias("idx"), F.concat_ws(":", "slug", "sentence_index").alias("key"), F.col("sentence_text_full").alias("text")
    )


def explode_manifest(manifest: DataFrame) -> DataFrame:
    return manifest.select("dataset", F.coalesce("index_base", F.lit(0)).alias("index_base"), F.explode("files").alias("f")).select("dataset", "index_base", "f.*")


def explode_splits(manifest: DataFrame) -> DataFrame:
    """(split, member)"""
    return manifest.select(F.explode("splits").alias("split", "members")).select("split", F.explode("members").alias("member"))


def batch_results(df: DataFrame, column: str = "value") -> DataFrame:
    """(key, response, error) of batch lines; a response wins over an error beside it."""
    j = lambda p: F.get_json_object(column, p)
    return df.select(j("$.key").alias("key"), j("$.response").alias("response"), F.when(j("$.response").isNull(), j("$.error")).alias("error"))


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """(key, label, reason) from CSV, or from JSON as a list at the root or under ``patches`` or ``overrides``."""
    if path.lower().endswith(".json"):
        item = "array<struct<key: string, label: string, reason: string>>"
        raw = spark.read.text(path, wholetext=True)
        found = F.coalesce(
            F.nullif(F.from_json(F.get_json_object("value", "$.patches"), item), F.from_json(F.lit("[]"), item)),
            F.nullif(F.from_json(F.get_json_object("value", "$.overrides"), item), F.from_json(F.lit("[]"), item)),
            F.from_json("value", item),
        )
        x = raw.select(F.inline(found))
    else:
        x = read_csv(spark, path, "key string, label string, reason string")
    return x.select(strip("key").alias("key"), F.upper(strip("label")).alias("label"), F.coalesce(F.nullif(strip("reason"), F.lit("")), F.lit("Manual override.")).alias("reason"))


def explode_keys(df: DataFrame, column: str = "keys") -> DataFrame:
    """(slug, idx, key) of a list of keys ``slug:idx``."""
    x = df.select(F.explode(column).alias("key"))
    return x.select(F.split_part("key", F.lit(":"), F.lit(1)).alias("slug"), F.split_part("key", F.lit(":"), F.lit(2)).try_cast("int").alias("idx"), "key")


def flatten_summaries(df: DataFrame) -> DataFrame:
    """(model, doc, f1_3, over_prediction) of run summaries with nested documents."""
    return df.select("model", F.explode("documents").alias("doc", "m")).select("model", "doc", "m.f1_3", "m.over_prediction")


def first_path_per_stem(files: DataFrame, path: str = "path") -> DataFrame:
    """One path for each file stem: the first in order."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\..*$", "")
    return files.groupBy(stem.alias("stem")).agg(F.min(path).alias("path"))


def completed_keys(log: DataFrame, fields: list[str], column: str = "value") -> DataFrame:
    """Distinct keys of an append-only log; lines that don't parse or lack a field are skipped."""
    x = log.select(*[F.get_json_object(column, f"$.{f}").alias(f) for f in fields])
    return x.where(" and ".join(f"{f} is not null" for f in fields)).distinct()


def kept_position(df: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """Rows with text, numbered anew by kept order."""
    x = df.where(strip(text) != "")
    return x.withColumn("position", F.row_number().over(Window.partitionBy(doc).orderBy(order)) - 1)


def prediction_positions(df: DataFrame) -> DataFrame:
    """(slug, pos, label): slug from the key, else the source file; position is the index less one; later rows win."""
    slug = F.when(F.col("key").contains(":"), F.split_part("key", F.lit(":"), F.lit(1))).otherwise(F.col("source_file"))
    x = df.where("sentence_index is not null").select(slug.alias("slug"), (F.col("sentence_index") - 1).alias("pos"), "label", "seq")
    return x.groupBy("slug", "pos").agg(F.max_by("label", "seq").alias("label"))


def members_with_files(members: DataFrame, files: DataFrame) -> DataFrame:
    """Members of splits with their file's path; a member without one is missing, not an error."""
    return members.join(files, members["member"] == files["stem"], "left").select("split", "member", "path", F.col("path").isNull().alias("missing"))


def resolve_source(df: DataFrame, files: DataFrame, keys: list[str], explicit: str = "explicit", manifest_first: str = "manifest_first", candidates: str = "candidates") -> DataFrame:
    """``df`` (one row for each value of ``keys``) with ``source``, the text file to read, and ``error``: the one
    named, which must be there; else the manifest's first, which must be there too; else the first of the
    candidates (an array) that is among ``files`` (path). All paths of all rows are looked up in one join."""
    named = F.coalesce(explicit, manifest_first)
    tried = df.select(*keys, F.posexplode(F.when(named.isNotNull(), F.array(named)).otherwise(F.col(candidates))).alias("_k", "path"))
    found = tried.join(files.select("path").distinct(), "path", "left_semi").groupBy(*keys).agg(F.min_by("path", "_k").alias("source"))
    missing = F.when(F.col("source").isNull(), F.when(named.isNotNull(), "missing file").otherwise("no source"))
    return df.join(found, keys, "left").withColumn("error", missing)
