"""Tables that the queries derive from the test tables, each with its SQL, so that both sides stay in step.

``sequence``: events of a user in order of time are an ordered document; an error is a gold border, a value
above 60 a predicted one, ``props.k`` hundredths its confidence (missing where 7 divides k).
``sentences``: documents, split. ``responses``: one synthesised model response per event.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import SPACES
from ..sources.readers import split_sentences


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, idx, event_id, event_type, value, k, gold, pred, conf)"""
    k = F.get_json_object("props", "$.k").cast("int")
    # named before it is numbered, so that windows by document find the rows where they are
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), "ts", "event_id", "event_type", "value", k.alias("k"))
    w = Window.partitionBy("doc").orderBy("ts", "event_id")
    return e.select(
        "doc",
        (F.row_number().over(w) - 1).alias("idx"),
        "event_id",
        "event_type",
        "value",
        "k",
        (F.col("event_type") == "error").alias("gold"),
        (F.col("value") > 60).alias("pred"),
        F.when(F.col("k") % 7 != 0, F.col("k") / 100.0).alias("conf"),
    )


SEQ = """seq AS (
    SELECT user_id AS doc, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS idx, event_id, event_type, value,
        CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type = 'error' AS gold, value > 60 AS pred,
        CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) / 100.0 END AS conf
    FROM events
)"""


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence with gaps in its index: after every third row two places are missing."""
    return sequence(spark, sf_dir).withColumn("idx", F.expr("idx + 2 * (idx div 3)").cast("int"))


SAMPLE = SEQ + """, sam AS (SELECT * REPLACE (CAST(idx + 2 * (idx // 3) AS INTEGER) AS idx) FROM seq)"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, idx, text)"""
    d = table(spark, sf_dir, "documents")
    return split_sentences(d, "text", ["doc_id", "lang"])


_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, '{SPACES}')), lambda x: x <> '')"
_PARTS = rf"list_filter(string_split(regexp_replace(trim(regexp_replace(text, '[{SPACES}]+', ' ', 'g')), '([.!?]) +', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"
SENT = f"""sent AS (
    SELECT doc_id, lang, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS idx, unnest(parts) AS text
    FROM (SELECT doc_id, lang, CASE WHEN len({_LINES}) > 1 THEN {_LINES} ELSE {_PARTS} END AS parts FROM documents WHERE text IS NOT NULL) x
)"""

#: the same expression in Spark and in DuckDB
_RAW = """CASE event_id % 14
    WHEN 0 THEN concat('{"label": "BORDER", "confidence": ', concat('0.', lpad(CAST(k AS STRING), 2, '0')), '}')
    WHEN 1 THEN '{"label": "no", "reason": "same place"}'
    WHEN 2 THEN concat('One thing is new.', chr(10), 'Another is not.', chr(10), '{"label": "BORDER", "confidence": "0.9", "reason": "time jump"}')
    WHEN 3 THEN '{"label": "NO'
    WHEN 4 THEN 'Some long thoughts. Final: BORDER'
    WHEN 5 THEN 'The answer is NOBORDER here.'
    WHEN 6 THEN 'BORDER'
    WHEN 7 THEN '{"label": "maybe"} and more'
    WHEN 8 THEN concat('[{"sentence_id": 1, "score": ', CAST(k AS STRING), '}, {"sentence_id": 2, "score": 80}]')
    WHEN 9 THEN 'NONE'
    WHEN 10 THEN concat('Sentence ', CAST(k AS STRING))
    WHEN 11 THEN ''
    WHEN 12 THEN concat('Answer: Yes', chr(10), 'It does not start a new scene')
    ELSE 'It marks a new scene in time; later that day' END"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence with ``raw``: valid JSON, JSON in prose, truncated JSON, plain words, nothing."""
    return sequence(spark, sf_dir).withColumn("raw", F.expr(_RAW))


RESP = SEQ + f", resp AS (SELECT *, {_RAW} AS raw FROM seq)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch rows: (slug, idx, key, parse_ok, label, raw, tokens...); every eleventh event failed to parse."""
    s = responses(spark, sf_dir)
    ok = F.col("event_id") % 11 != 0
    return s.select(
        F.concat(F.lit("u"), F.col("doc").cast("string")).alias("slug"),
        "idx",
        F.concat(F.lit("u"), F.col("doc").cast("string"), F.lit(":"), F.col("idx").cast("string")).alias("key"),
        ok.alias("parse_ok"),
        F.when(ok, F.when(F.col("pred"), "BORDER").otherwise("NOBORDER")).alias("label"),
        "conf",
        "gold",
        "event_id",
        "raw",
        F.concat(F.lit("text "), F.col("event_id").cast("string")).alias("text"),
        (F.col("k") * 10 + 100).alias("prompt_tokens"),
        (F.col("k") + 5).alias("output_tokens"),
        F.when(F.col("event_id") % 4 != 0, F.col("k") * 3).alias("thought_tokens"),
    )


PRED = RESP + """, pr AS (
    SELECT 'u' || CAST(doc AS VARCHAR) AS slug, idx, 'u' || CAST(doc AS VARCHAR) || ':' || CAST(idx AS VARCHAR) AS key, event_id % 11 <> 0 AS parse_ok,
        CASE WHEN event_id % 11 <> 0 THEN CASE WHEN pred THEN 'BORDER' ELSE 'NOBORDER' END END AS label, conf, gold, event_id, raw,
        'text ' || CAST(event_id AS VARCHAR) AS text, k * 10 + 100 AS prompt_tokens, k + 5 AS output_tokens, CASE WHEN event_id % 4 <> 0 THEN k * 3 END AS thought_tokens
    FROM resp
)"""


_FOLDERS: dict[str, str] = {}


def workspace(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; where none is set (local sessions), a temporary one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if sc.applicationId not in _FOLDERS:
            _FOLDERS[sc.applicationId] = tempfile.mkdtemp(prefix="seamline-")
            atexit.register(shutil.rmtree, _FOLDERS[sc.applicationId], ignore_errors=True)
        base = "file://" + _FOLDERS[sc.applicationId]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
