"""Ranks and running sums over all rows of a table, dealt out by ranges of the order so that no task has them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: bounds between ranges: that many keys come to the driver, and rows of sums meet in one task
BOUNDS = 64


def _bucket(df: DataFrame, key: Column) -> Column:
    """The number of bounds below a row's key. The bounds are the keys with the least hashes; any would be right."""
    keys = df.select(key.alias("k"))
    fields = keys.schema["k"].dataType.fields
    found = keys.orderBy(F.xxhash64("k"), "k").limit(BOUNDS).collect()
    if not found:
        return F.lit(0)
    bounds = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r["k"], fields)]) for r in found])
    return F.size(F.filter(bounds, lambda b: b < key))


def running(df: DataFrame, order: list[Column | str], name: str, value: str | None = None) -> DataFrame:
    """``name``: the sum of ``value`` (without it, the number) of the rows up to this one by ``order``, ascending,
    whose columns must tell all rows apart. Each range sums its own rows; a row per range is summed besides."""
    key = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(order)])
    one = F.lit(1).cast("long") if value is None else F.col(value)
    x = df.withColumn("_bucket", _bucket(df, key)).withColumn("_key", key)
    sums = x.groupBy("_bucket").agg(F.sum(one).alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.sum(one).over(Window.partitionBy("_bucket").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("_own", own).join(sums, "_bucket").withColumn(name, F.col("_own") + F.col("_before")).drop("_bucket", "_key", "_own", "_before")


def rank(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """``name``: each row's place from 1."""
    return running(df, order, name).withColumn(name, F.col(name).cast("int"))


def starts(groups: DataFrame, order: list[Column | str], size: str, name: str) -> DataFrame:
    """``name``: the sum of the sizes of the groups before each."""
    return running(groups, order, name, size).withColumn(name, F.col(name) - F.col(size))
