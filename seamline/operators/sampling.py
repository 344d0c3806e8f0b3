"""Sampling and splitting, deterministic under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import rank


def hash_rank(keys: list[str], seed: int) -> Column:
    """A pseudo-random order of rows by their keys, the same in any engine that has MD5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def evenly(df: DataFrame, n: Column, doc: str = "doc", idx: str = "idx") -> DataFrame:
    """``n`` rows of each document, evenly spaced: elements floor(i * size / n)."""
    w = Window.partitionBy(doc).orderBy(idx)
    x = df.withColumn("_n", n).withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy(doc))).withColumn("_r", F.row_number().over(w) - 1)
    step = F.col("_size") / F.when(F.col("_n") > 0, F.col("_n"))
    # row r is element i for the least i with floor(i * step) >= r, if that equals r and i < n
    i = F.ceil(F.col("_r") / step)
    hit = ((F.floor(i * step) == F.col("_r")) & (i < F.col("_n"))) | ((F.floor((i - 1) * step) == F.col("_r")) & (i - 1 >= 0) & (i - 1 < F.col("_n"))) | ((F.floor((i + 1) * step) == F.col("_r")) & (i + 1 < F.col("_n")))
    return x.where((F.col("_n") > 0) & (hit | (F.col("_size") <= F.col("_n")))).drop("_n", "_size", "_r")


def stratified(df: DataFrame, cap: int = 0, seed: int = 0) -> DataFrame:
    """All borders (a pseudo-random ``cap`` of them, if given) and as many evenly spaced other rows; of a
    document without borders nothing."""
    borders = df.where("gold")
    if cap:
        nth = F.row_number().over(Window.partitionBy("doc").orderBy(hash_rank(["doc", "idx"], seed), "idx"))
        borders = borders.withColumn("_k", nth).where(F.col("_k") <= cap).drop("_k")
    n = borders.groupBy("doc").agg(F.count(F.lit(1)).alias("_need"))
    rest = evenly(df.where("not gold").join(n, "doc"), F.col("_need")).drop("_need")
    return borders.unionByName(rest)


def capped(df: DataFrame, n: int, seed: int, doc: str = "doc", idx: str = "idx") -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(doc).orderBy(hash_rank([doc, idx], seed), idx))
    return df.withColumn("_k", nth).where(F.col("_k") <= n).drop("_k")


def negatives_wanted(mode: str, n_border: Column, n_other: Column, value: float = 0.0) -> Column:
    """How many negatives a policy keeps."""
    if mode in ("pct", "hard"):
        return F.greatest(F.lit(1), F.bround(n_other * value)).cast("long")
    if mode == "paper":
        return F.greatest(F.lit(1), F.bround(n_other * 0.1)).cast("long")
    if mode == "ratio":
        return n_other if value <= 0 else F.least(F.floor(n_border * value), n_other).cast("long")
    raise ValueError(f"unknown mode: {mode}")


def hard_negatives(df: DataFrame, window: int, share: float, seed: int) -> DataFrame:
    """All borders, all other rows within ``window`` of one, and a pseudo-random top-up to ``share`` of the others."""
    from .windows import distance_to

    x = df.withColumn("_d", distance_to("gold"))
    n = x.groupBy("doc").agg(F.count_if(~F.col("gold")).alias("_others"))
    near = F.col("gold") | F.coalesce(F.col("_d") <= window, F.lit(False))
    x = x.join(n, "doc").withColumn("_near", near)
    x = x.withColumn("_have", F.count_if(~F.col("gold") & F.col("_near")).over(Window.partitionBy("doc")))
    nth = F.row_number().over(Window.partitionBy("doc", "_near").orderBy(hash_rank(["doc", "idx"], seed), "idx"))
    want = negatives_wanted("hard", F.lit(0), F.col("_others"), share) - F.col("_have")
    return x.withColumn("_k", nth).where(F.col("_near") | (F.col("_k") <= want)).drop("_d", "_others", "_near", "_have", "_k")


def holdout(df: DataFrame, source: str, share: float | None = None, named: list[str] | None = None, seed: int = 0) -> DataFrame:
    """``held_out`` for whole sources: the named ones, or a share of them (one at least), by pseudo-random order."""
    s = df.select(source).distinct()
    if named is not None:
        return df.withColumn("held_out", F.col(source).isin(named))
    n = s.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * share)).alias("_n"))
    chosen = rank(s, [hash_rank([source], seed), source], "_k").crossJoin(n).select(source, (F.col("_k") <= F.col("_n")).alias("held_out"))
    return df.join(chosen, source, "left")


def folds(df: DataFrame, source: str) -> DataFrame:
    """Leave-one-out: (source, fold): the number, from 0, of the fold that the source evaluates; it trains all others."""
    return rank(df.select(source).distinct(), [source], "fold").withColumn("fold", F.col("fold") - 1)


def fold_role(own: Column | str, fold: Column | int) -> Column:
    """What a source does in a fold."""
    return F.when((F.col(own) if isinstance(own, str) else own) == fold, "eval").otherwise("train")
