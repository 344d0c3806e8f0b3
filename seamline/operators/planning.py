"""Ranking, budgets and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import OTHER_NEW_TOKENS, new_tokens
from .ranges import rank, running


def budget_prefix(df: DataFrame, cost: str, order: list, budget: float) -> DataFrame:
    """Rows in ascending order while the running cost stays within the budget; the first always, none after an
    overflow. Costs are summed by ranges of the order, whose columns must tell all rows apart."""
    x = rank(running(df, order, "_run", cost), order, "_k")
    over = x.agg(F.min(F.when(F.col("_run") > budget, F.col("_k"))).alias("_over"))
    return x.crossJoin(over).where("_k = 1 or _over is null or _k < _over").drop("_run", "_k", "_over")


def top_k(df: DataFrame, k: int, keys: list[str], order: list) -> DataFrame:
    """Rows ranked 1 to ``k`` in each group, with ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def order_key(mode: str, slug: str = "slug", count: str = "n") -> list[Column]:
    """The order of a mode: by the slug's number, by slug, or by count (largest first)."""
    from ..functions.labels import stem_number

    return {"numeric": [stem_number(slug).isNull(), stem_number(slug), F.col(slug)], "slug": [F.col(slug)], "count": [-F.col(count), F.col(slug)]}[mode]


def best_gap(scores: DataFrame) -> DataFrame:
    """(doc, gap, f1): the gap with the best f1; the smallest of equals."""
    return scores.groupBy("doc").agg(F.max_by(F.struct("gap", "f1"), F.struct("f1", (-F.col("gap")).alias("g"))).alias("b")).select("doc", "b.*")


def improvement_gate(scores: DataFrame, enough: float = 0.76, windows: tuple[int, ...] = (32, 64)) -> DataFrame:
    """(action, window): stop if the best f1 is enough, else a run with each of the wider windows."""
    best = scores.agg(F.max(F.coalesce("f1", F.lit(0.0))).alias("_best"))
    runs = F.array(*[F.struct(F.lit("run").alias("action"), F.lit(w).alias("window")) for w in windows])
    stop = F.array(F.struct(F.lit("stop").alias("action"), F.lit(None).cast("int").alias("window")))
    return best.select(F.inline(F.when(F.col("_best") >= enough, stop).otherwise(runs)))


def by_precedence(df: DataFrame, names: list[str], layers: list[str]) -> DataFrame:
    """Each setting from the last of the layers (structs, lowest first) that has it."""
    keep = [c for c in df.columns if c not in layers]
    return df.select(*keep, *[F.coalesce(*[F.col(f"{layer}.{n}") for layer in reversed(layers)]).alias(n) for n in names])


def settings(df: DataFrame, defaults: dict[str, object], file: str, environment: str, job: str) -> DataFrame:
    """Each row's settings: ``defaults`` (name to value, whose type holds), under what its configuration file says (JSON
    text, null for none), under its environment (a map of names in capitals to texts; empty ones don't count), under
    its job's metadata (JSON text). The rows looked at before a run, where the file doesn't say, are 20 in a debugging
    run, else 0; the tokens of an answer, where the file doesn't say, follow the job's format."""
    kinds = {bool: "boolean", int: "int", float: "double", str: "string"}

    def layer(read):
        return F.struct(*[read(n).try_cast(kinds[type(v)]).alias(n) for n, v in defaults.items()])

    said = lambda c, n: F.get_json_object(c, f"$.{n}")
    x = df.withColumns(
        {
            "_defaults": F.struct(*[F.lit(v).alias(n) for n, v in defaults.items()]),
            "_file": layer(lambda n: said(file, n)),
            "_environment": layer(lambda n: F.nullif(F.try_element_at(environment, F.lit(n.upper())), F.lit(""))),
            "_job": layer(lambda n: said(job, n)),
            "_rows": said(file, "eval_preflight_rows").try_cast("int"),
            "_tokens": F.coalesce(said(file, "eval_max_new_tokens").try_cast("int"), F.when(said(job, "target_format").isNotNull(), new_tokens(said(job, "target_format")))),
        }
    )
    x = by_precedence(x, list(defaults), ["_defaults", "_file", "_environment", "_job"])
    rows = F.coalesce("_rows", F.when(F.col("debug"), 20).otherwise(0)) if "debug" in defaults else F.coalesce("_rows", F.lit(0))
    return x.withColumn("eval_preflight_rows", rows).withColumn("eval_max_new_tokens", F.coalesce("_tokens", F.lit(OTHER_NEW_TOKENS))).drop("_rows", "_tokens")
