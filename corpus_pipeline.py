"""A corpus pipeline of five stages: identify languages, keep good texts, drop near-duplicates, redact secrets, pack.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns the
columns of ``documents``, others too if there are more; the last returns the pieces of packed sequences. Texts are
taken whole, however long; an empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seamline.llm import credential_automata, hilbert_pack, kneser_ney, language_mixture, simhash_bytes
from seamline.llm.scratch import modest_batches, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters, so null and empty ones too; texts in several languages stay, whatever the split.
    Of equally likely languages the first in the alphabet counts, which decides nothing here. Repeated rows stay."""
    return language_mixture.keep_identified(modest_batches(docs))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that fail the base rules (null and empty ones do) or leave their language's perplexity band, whose
    ends belong to it. A null language is one of its own. Repeated rows share their verdict."""
    return kneser_ney.keep_good(modest_batches(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group, one of repeated rows; of a group without any doc_id one
    row of each fingerprint. Null and empty texts are alike."""
    return simhash_bytes.keep_one(modest_batches(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the text; null and empty texts and rows without secrets stay as they are, repeated rows change
    alike, and overlapping spans become one."""
    return credential_automata.redact(modest_batches(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs documents along the curve into sequences of 4096 ids; null and empty texts are the end id alone, repeated rows
    each are packed, and rows at one place follow one another by a hash."""
    return hilbert_pack.pack(modest_batches(docs))


STAGES = [
    ("identify_language", identify_language),
    ("keep_quality", keep_quality),
    ("drop_near_duplicates", drop_near_duplicates),
    ("redact_secrets", redact_secrets),
    ("pack_sequences", pack_sequences),
]

#: models learned from the corpus decide what is kept, which SQL can't express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
