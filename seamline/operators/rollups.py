"""Rollups of runs, books and corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import cost

#: currency per million tokens
IN_RATE, OUT_RATE = 0.3, 2.5


def _batch_counts() -> list:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return [
        F.count(F.lit(1)).alias("requests"),
        F.count_if("parse_ok").alias("parsed"),
        F.count_if(~F.col("parse_ok")).alias("failed"),
        F.count_if(F.col("label") == "BORDER").alias("borders"),
        F.count_if(F.col("label") == "NOBORDER").alias("noborders"),
        *map(total, ("prompt_tokens", "output_tokens", "thought_tokens")),
    ]


def _with_cost(counts: DataFrame) -> DataFrame:
    rate = F.greatest("requests", F.lit(1))
    return (
        counts.withColumn("avg_prompt", F.col("prompt_tokens") / rate)
        .withColumn("avg_output", F.col("output_tokens") / rate)
        .withColumn("cost", cost("prompt_tokens", "output_tokens", "thought_tokens", IN_RATE, OUT_RATE))
    )


def batch_summary(df: DataFrame, *keys: str) -> DataFrame:
    """Requests, parses, tokens and cost of prediction rows."""
    return _with_cost(df.groupBy(*keys).agg(*_batch_counts()))


def book_summary(df: DataFrame) -> DataFrame:
    """A row per slug: rates, border-terminated scene lengths, runs, pairs, gaps, failures, cost, first text.

    One order of a book's rows and one aggregate serve all columns: a border knows the border before it, from which
    follow its scene's length, its run's start and the gap; the book's last row, if it is no border, ends a scene too.
    """
    w = Window.partitionBy("slug").orderBy("idx")
    x = df.withColumn("border", F.col("parse_ok") & (F.coalesce("label", F.lit("")) == "BORDER"))
    x = x.withColumn("_at", F.when(F.col("border"), F.col("idx")))
    x = x.withColumn("_before", F.last("_at", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("_n", F.row_number().over(w)).withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
    x = x.withColumn("_opens", F.when(F.col("border") & F.coalesce(F.col("idx") - F.col("_before") > 1, F.lit(True)), F.col("idx")))
    x = x.withColumn("_start", F.last("_opens", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.coalesce("_before", F.lit(-1))
    length = F.when(F.col("border"), F.greatest(F.lit(1), F.col("idx") - before)).when(F.col("_last"), F.col("_n") - before - 1)
    x = x.withColumn("_len", length.cast("long")).withColumn("_run", F.when(F.col("border"), F.col("idx") - F.col("_start") + 1))
    gap = F.when(F.col("border"), F.col("idx") - F.col("_before"))
    books = x.groupBy("slug").agg(
        *_batch_counts(),
        F.expr("percentile(_len, 0.5)").alias("median_len"),
        F.avg("_len").alias("mean_len"),
        F.min("_len").alias("min_len"),
        F.max("_len").alias("max_len"),
        (F.count_if(F.col("_len") <= 2) / F.count("_len")).alias("short_rate"),
        F.max_by(F.when(F.col("border"), F.struct(F.col("_run").cast("long").alias("n"), F.col("_start").alias("start"))), F.when(F.col("border"), F.struct("_run", (-F.col("_start")).alias("s")))).alias("_longest"),
        F.count_if(gap == 1).alias("pairs"),
        F.count_if(gap >= 10).alias("gaps"),
        F.min_by("text", "idx").alias("first_text"),
    )
    return _with_cost(books).select(
        "slug", F.col("requests").alias("n"), "parsed", "borders", "failed", "cost", (F.col("parsed") / F.col("requests")).alias("parse_rate"), (F.col("borders") / F.col("requests")).alias("border_rate"),
        "median_len", "mean_len", "min_len", "max_len", "short_rate", F.coalesce("_longest.n", F.lit(0)).alias("run_len"), F.col("_longest.start").alias("run_start"), "pairs", "gaps", "first_text",
    )


def corpus_row(books: DataFrame) -> DataFrame:
    """One row: sums, means, a median of medians, least and largest."""
    return books.agg(
        F.sum("n").alias("n"), F.sum("borders").alias("borders"), F.avg("border_rate").alias("border_rate"), F.avg("parse_rate").alias("parse_rate"),
        F.expr("percentile(median_len, 0.5)").alias("median_len"), F.avg("mean_len").alias("mean_len"), F.min("min_len").alias("min_len"), F.max("max_len").alias("max_len"),
    )


def outliers(df: DataFrame, value: str, least: float = 2.0) -> DataFrame:
    """Rows whose value is ``least`` or more population deviations from the mean, with ``z`` and ``side``.

    Mean and deviation are one row, joined to all; a deviation of 0 counts as 1.
    """
    s = df.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    x = df.crossJoin(s).withColumn("z", (F.col(value) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0))
    return x.where(F.abs("z") >= least).withColumn("side", F.when(F.col("z") > 0, "HIGH").otherwise("LOW")).drop("_m", "_s")


def failed_keys(df: DataFrame) -> DataFrame:
    return df.where("not parse_ok").groupBy("slug").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def guardrail(calls: DataFrame, first_n: int = 40, least: int = 2, fail_rate: float = 0.25, limit_rate: float = 0.5) -> DataFrame:
    """(doc, abort_at, why): the first call of a run at which it should stop, replayed from its log (doc, seq, ok, kind)."""
    w = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    x = calls.withColumn("_n", F.count(F.lit(1)).over(w))
    x = x.withColumn("_fail", F.count_if(~F.col("ok")).over(w) / F.col("_n")).withColumn("_limit", F.count_if(F.coalesce(F.col("kind") == "rate_limit", F.lit(False))).over(w) / F.col("_n"))
    fatal = F.coalesce(F.col("kind").isin("auth_error", "billing_error", "model_not_found"), F.lit(False))
    early = (F.col("_n") <= first_n) & (F.col("_n") >= least)
    why = F.when(fatal, F.col("kind")).when(early & (F.col("_limit") >= limit_rate), "rate_limit").when(early & (F.col("_fail") > fail_rate), "failures")
    return x.withColumn("why", why).where("why is not null").groupBy("doc").agg(F.min("seq").alias("abort_at"), F.min_by("why", "seq").alias("why"))
