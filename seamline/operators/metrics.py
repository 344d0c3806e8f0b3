"""Precision, recall and F1, exact and within a tolerance; per document, macro and micro."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import starts


def ratio(n, d) -> Column:
    """n / d, 0 where d is 0."""
    n, d = (F.col(x) if isinstance(x, str) else x for x in (n, d))
    return F.when(d > 0, n / d).otherwise(0.0)


def with_prf(df: DataFrame, places: int | None = None) -> DataFrame:
    """precision, recall, f1 from tp, fp, fn; rounded last if ``places`` are given."""
    p, r = ratio("tp", F.col("tp") + F.col("fp")), ratio("tp", F.col("tp") + F.col("fn"))
    x = df.withColumn("precision", p).withColumn("recall", r)
    x = x.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    if places is None:
        return x
    return x.withColumns({c: F.round(c, places) for c in ("precision", "recall", "f1")})


def confusion(df: DataFrame, *keys: str) -> DataFrame:
    p, g = F.col("pred"), F.col("gold")
    return df.groupBy(*keys).agg(
        F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"), F.count_if(~p & ~g).alias("tn")
    )


def exact(df: DataFrame, *keys: str) -> DataFrame:
    x = with_prf(confusion(df, *keys))
    return x.withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")))


def tolerant(df: DataFrame, tolerances=(0, 1, 3), *keys: str, sampled: str | None = None, own: str | None = None) -> DataFrame:
    """(keys, doc, tol, tp, fp, fn): a gold border is hit if a prediction lies within ``tol``, a prediction is
    right if a gold border does. Hits are counted on the gold side, so tp + fp needn't be the predictions.

    With ``sampled``, rows outside the sample have no prediction and aren't missed, but count as gold for
    precision. With ``own``, other rows are neighbours that are looked at but not counted.
    """
    p = F.col("pred") & F.col(sampled) if sampled else F.col("pred")
    scored = tolerant_flags(df.withColumn("pred", p), {"pred": "pred"}, tolerances, *keys, counted=sampled, own=own)
    return scored.drop("name")


def tolerant_flags(df: DataFrame, flags: dict[str, str], tolerances=(0, 1, 3), *keys: str, counted: str | None = None, own: str | None = None) -> DataFrame:
    """(keys, doc, name, tol, tp, fp, fn) of several columns of predictions, by their names. One shuffle by document
    and one order serve all names and tolerances: range frames share them."""
    w = Window.partitionBy(*keys, "doc").orderBy("idx")
    here = F.col(own) if own else F.lit(True)
    x = df.select(*keys, "doc", "idx", F.col("gold").alias("_g"), (F.col(counted) if counted else F.lit(True)).alias("_in"), here.alias("_own"), *[F.col(c).alias(f"_p{k}") for k, c in enumerate(flags.values())])
    near = {}
    for t in tolerances:
        frame = w.rangeBetween(-t, t)
        near[f"_g_{t}"] = F.max("_g").over(frame)
        near |= {f"_p{k}_{t}": F.max(f"_p{k}").over(frame) for k in range(len(flags))}
    x = x.select("*", *[c.alias(n) for n, c in near.items()])
    gold = F.col("_g") & F.col("_in") & F.col("_own")
    aggs = [
        F.struct(
            F.lit(name).alias("name"),
            F.lit(t).alias("tol"),
            F.count_if(gold & F.col(f"_p{k}_{t}")).alias("tp"),
            F.count_if(F.col(f"_p{k}") & F.col("_own") & ~F.col(f"_g_{t}")).alias("fp"),
            F.count_if(gold & ~F.col(f"_p{k}_{t}")).alias("fn"),
        )
        for k, name in enumerate(flags)
        for t in tolerances
    ]
    return x.groupBy(*keys, "doc").agg(F.array(*aggs).alias("_t")).select(*keys, "doc", F.inline("_t"))


def tolerant_concatenated(df: DataFrame, tolerances=(0, 1, 3), block: int = 50_000) -> DataFrame:
    """(tol, tp, fp, fn) of all documents one after another by (doc, idx), so that tolerances reach over their ends.

    Rows are dealt out in blocks of places, each lent the rows next to it that lie within the largest tolerance:
    no task has more than a block.
    """
    reach, at = max(tolerances), F.floor(F.col("idx") / block)
    lent = F.array_distinct(F.array(F.floor((F.col("idx") - reach) / block), at, F.floor((F.col("idx") + reach) / block)))
    x = concatenated(df).select("idx", "pred", "gold", at.alias("_at"), F.explode(lent).alias("doc")).withColumn("_mine", F.col("_at") == F.col("doc"))
    return tolerant(x, tolerances, own="_mine").groupBy("tol").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def macro(scores: DataFrame, *keys: str, places: int | None = None) -> DataFrame:
    """Unweighted means over documents; of values rounded before, if ``places`` are given."""
    x = with_prf(scores, places)
    return x.groupBy(*keys).agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def micro(scores: DataFrame, *keys: str) -> DataFrame:
    return with_prf(scores.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def dense(df: DataFrame, doc: str = "doc", idx: str = "idx", flag: str = "gold") -> DataFrame:
    """Every index from 0 to the document's last; absent ones aren't flagged."""
    full = df.groupBy(doc).agg(F.max(idx).alias("_m")).select(doc, F.explode(F.sequence(F.lit(0), F.col("_m"))).alias(idx))
    return full.join(df.select(doc, idx, flag), [doc, idx], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def concatenated(df: DataFrame) -> DataFrame:
    """Documents one after another, rows numbered by (doc, idx) from 0; starts are sums of the sizes of the documents
    before, by ranges of documents."""
    n = starts(df.groupBy("doc").agg(F.count(F.lit(1)).alias("_n")), ["doc"], "_n", "_start").drop("_n")
    own = F.row_number().over(Window.partitionBy("doc").orderBy("idx")) - 1
    return df.withColumn("_own", own).join(n, "doc").withColumn("idx", F.col("_own") + F.col("_start")).drop("_own", "_start")


def score_card(df: DataFrame) -> DataFrame:
    """Per document: rows, borders of both sides, over-prediction (null without gold)."""
    x = df.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.count_if("gold").alias("n_gold"), F.count_if("pred").alias("n_pred"))
    return x.withColumn("over_prediction", F.when(F.col("n_gold") > 0, F.col("n_pred") / F.col("n_gold")))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
