"""Queries ``opN_<name>`` of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import credential_automata, hilbert_pack, html_template, huffman_ids, kneser_ney, language_mixture, matroska, piece_trie, simhash_bytes, warc_zstd
from .scratch import modest_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return modest_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(_table(spark, sf_dir, "pages"))


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.judge(_table(spark, sf_dir, "documents"))


def op3_credential_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credential_automata.scan(_table(spark, sf_dir, "documents"))


def op4_simhash_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_bytes.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digest(_table(spark, sf_dir, "documents"))


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_mixture.identify(_table(spark, sf_dir, "documents"))


def op6_piece_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_trie.round_trip(_table(spark, sf_dir, "documents"))


def op7_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zstd.round_trip(_table(spark, sf_dir, "pages"))


def op8_hilbert_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_pack.pack(_table(spark, sf_dir, "documents"))


def op10_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman_ids.round_trip(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_template,
        op2_kneser_ney,
        op3_credential_automata,
        op4_simhash_bytes,
        op5_language_mixture,
        op6_piece_trie,
        op7_warc_zstd,
        op8_hilbert_pack,
        op9_matroska,
        op10_huffman_ids,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op7_warc_zstd": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages
        ), k AS (
            SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS last_id FROM p
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
            CASE WHEN last_id IS NOT NULL AND (page_id IS NULL OR page_id < last_id) THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id IS NULL OR page_id < last_id THEN last_id END AS refers_to
        FROM k
    """,
}
