"""Joins and alignment: fallbacks, containment, resume, upserts, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import collapse_space


def one_per(df: DataFrame, keys: list[str], order: list, last: bool = False) -> DataFrame:
    """One row per key: the first in order, or the last. Ties in ``order`` need a breaking column in it."""
    columns = [c for c in df.columns if c not in keys]
    rank = F.struct(*order)
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*columns), rank).alias("_r")).select(*keys, "_r.*")


def fallback_join(gold: DataFrame, preds: DataFrame, last_text_wins: bool = False) -> DataFrame:
    """Gold rows (doc, idx, text, gold) with the label of the prediction (doc, idx, text, label) at their
    position, else of one with the same text up to white space, else NOBORDER; ``matched_by`` tells which."""
    by_idx = one_per(preds.select("doc", "idx", "label", "seq"), ["doc", "idx"], ["seq"]).select("doc", "idx", F.col("label").alias("_i"))
    # texts meet by their hashes, so none of them is shuffled
    text = F.sha2(collapse_space("text"), 256)
    by_text = one_per(preds.select("doc", text.alias("_t"), "label", "seq"), ["doc", "_t"], ["seq"], last_text_wins).select("doc", "_t", F.col("label").alias("_x"))
    x = gold.withColumn("_t", text).join(by_idx, ["doc", "idx"], "left").join(by_text, ["doc", "_t"], "left")
    how = F.when(F.col("_i").isNotNull(), "index").when(F.col("_x").isNotNull(), "text").otherwise("none")
    return x.withColumn("label", F.coalesce("_i", "_x", F.lit("NOBORDER"))).withColumn("matched_by", how).drop("_i", "_x", "_t")


def position(df: DataFrame, mode: str, base: str = "index_base", doc: str = "doc", index: str = "file_index"):
    """``idx`` by the named notion: row_position, file_index, or file_index_minus_base."""
    if mode == "row_position":
        return df.withColumn("idx", F.row_number().over(Window.partitionBy(doc).orderBy(index)) - 1)
    if mode == "file_index":
        return df.withColumn("idx", F.col(index))
    if mode == "file_index_minus_base":
        return df.withColumn("idx", F.col(index) - F.col(base))
    raise ValueError(f"unknown mode: {mode}")


def within_tolerance(a: DataFrame, b: DataFrame, tol: int) -> DataFrame:
    """Rows of ``a`` (doc, idx) with a row of ``b`` at most ``tol`` away: an equi-join on shifted positions."""
    near = b.select("doc", F.explode(F.sequence(F.col("idx") - tol, F.col("idx") + tol)).alias("idx")).distinct()
    return a.join(near, ["doc", "idx"], "left_semi")


def contained_in(inner: DataFrame, outer: DataFrame, width: int = 1024) -> DataFrame:
    """(doc, scene, first_begin): the first inner span that lies whole inside each outer one.

    Positions are dealt out in stretches of ``width``: an inner span is in the one where it begins, an outer span in
    all that it reaches, so only spans near each other meet, however long the document.
    """
    at = inner.select("doc", F.floor(F.col("begin") / width).alias("_at"), F.col("begin").alias("_b"), F.col("end").alias("_e"))
    reached = F.sequence(F.floor(F.col("begin") / width), F.floor(F.greatest("begin", "end") / width))
    over = outer.select("doc", "scene", "begin", "end", F.explode(reached).alias("_at"))
    x = over.join(at, ["doc", "_at"]).where("_b >= begin and _e <= end")
    return x.groupBy("doc", "scene").agg(F.min("_b").alias("first_begin"))


def next_begin(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(doc, scene, first_begin): like the begin-only containment, by one sorted pass over both sides instead of
    a range join, so a long document costs its length, not the product."""
    both = inner.select("doc", F.lit(None).cast("long").alias("scene"), "begin", F.lit(1).alias("_k"), F.col("begin").alias("_b")).unionByName(
        outer.select("doc", F.col("scene").cast("long"), "begin", F.lit(0).alias("_k"), F.lit(None).cast("long").alias("_b"))
    )
    w = Window.partitionBy("doc").orderBy("begin", "_k").rowsBetween(0, Window.unboundedFollowing)
    return both.withColumn("first_begin", F.first("_b", ignorenulls=True).over(w)).where("_k = 0").select("doc", "scene", "first_begin")


def remaining(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def selected(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on).distinct(), on, "left_semi")


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc, shared, only_a, only_b) of the borders of two runs."""
    x = a.where("pred").select("doc", "idx", F.lit(True).alias("_a")).join(b.where("pred").select("doc", "idx", F.lit(True).alias("_b")), ["doc", "idx"], "full_outer")
    return x.groupBy("doc").agg(
        F.count_if(F.col("_a") & F.col("_b")).alias("shared"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b")
    )


def upsert(base: DataFrame, later: DataFrame, key: str, seq: str) -> DataFrame:
    """Rows of both; per key the later table's row wins, in a table the one with the largest ``seq``. No key: dropped."""
    x = base.withColumn("_p", F.lit(0)).unionByName(later.withColumn("_p", F.lit(1))).where(F.col(key).isNotNull())
    return one_per(x, [key], ["_p", seq], last=True).drop("_p")


def verify_counts(parsed: DataFrame, expected: DataFrame, keys: list[str], counts: list[str], tol: float = 0.02) -> DataFrame:
    """``ok`` of each expected row: every count within ``max(1, round(tol * expected))``; a null expectation passes."""
    x = expected.join(parsed, keys, "left")
    ok = F.lit(True)
    for c in counts:
        slack = F.greatest(F.lit(1.0), F.bround(F.col(f"expected_{c}") * tol))
        ok = ok & (F.col(f"expected_{c}").isNull() | F.coalesce(F.abs(F.coalesce(c, F.lit(0)) - F.col(f"expected_{c}")) <= slack, F.lit(False)))
    return x.withColumn("ok", ok)
