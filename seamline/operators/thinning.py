"""Thinning of predicted borders: rules from labels to labels, and the scenarios that name them.

Each rule takes rows (``doc``, ``idx``, ``pred``, ...) and changes ``pred``. Positions are ranks among the
rows present, so sparse samples are compressed first.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import strip


def _by_doc():
    return Window.partitionBy("doc").orderBy("idx")


def ranked(df: DataFrame) -> DataFrame:
    return df if "pos" in df.columns else df.withColumn("pos", F.row_number().over(_by_doc()) - 1)


def min_gap(df: DataFrame, gap: int) -> DataFrame:
    """A border stays if it is ``gap`` or more positions after the last one that stayed."""
    return min_gaps(df, {"pred": gap})


def min_gaps(df: DataFrame, flags: dict[str, int]) -> DataFrame:
    """``min_gap`` of several columns of borders, each with its gap, in one pass over the documents' rows in order.

    Which border stays depends on all before it, so the pass goes from row to row; it remembers the last one that
    stayed, and holds a batch of rows however long a document is.
    """
    x = ranked(df).withColumn("_row", F.row_number().over(_by_doc())).sortWithinPartitions("doc", "_row").drop("_row")
    at = {c: k for k, c in enumerate(x.columns)}

    def run(batches):
        doc, last = None, dict.fromkeys(flags)
        for b in batches:
            cols = list(b.columns)
            docs, pos = b.column(at["doc"]), np.asarray(b.column(at["pos"]))
            new = {}
            for name, gap in flags.items():
                on = np.flatnonzero(np.asarray(b.column(at[name]).fill_null(False)))
                keep, here, before = np.zeros(b.num_rows, bool), doc, last[name]
                for i, d, p in zip(on.tolist(), docs.take(pa.array(on)).to_pylist(), pos[on].tolist()):
                    if d != here or before is None or p - before >= gap:
                        keep[i], here, before = True, d, p
                new[name] = before if here is not None and b.num_rows and docs[b.num_rows - 1].as_py() == here else None
                cols[at[name]] = pa.array(keep)
            if b.num_rows:
                doc, last = docs[b.num_rows - 1].as_py(), new
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return x.mapInArrow(run, x.schema)


def burst_collapse(df: DataFrame) -> DataFrame:
    """Of adjacent borders every second one goes, as each is compared with what the rule gave before it."""
    x = ranked(df)
    run = F.col("pos") - F.row_number().over(Window.partitionBy("doc", "pred").orderBy("pos"))
    x = x.withColumn("_run", run)
    nth = F.row_number().over(Window.partitionBy("doc", "pred", "_run").orderBy("pos"))
    return x.withColumn("pred", F.col("pred") & (nth % 2 == 1)).drop("_run")


def cluster_merge(df: DataFrame, radius: int = 3) -> DataFrame:
    """Of borders in steps of ``radius`` or less the surest stays; the first of equals; one without confidence only among such."""
    x = ranked(df)
    before = F.lag("pos").over(Window.partitionBy("doc", "pred").orderBy("pos"))
    x = x.withColumn("_new", F.coalesce(F.col("pos") - before > radius, F.lit(True)).cast("int"))
    x = x.withColumn("_cluster", F.sum("_new").over(Window.partitionBy("doc", "pred").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    best = F.row_number().over(Window.partitionBy("doc", "pred", "_cluster").orderBy(F.col("conf").desc_nulls_last(), "pos"))
    return x.withColumn("pred", F.col("pred") & (best == 1)).drop("_new", "_cluster")


def confidence_threshold(df: DataFrame, least: float = 0.85) -> DataFrame:
    """Borders surer than nothing known but below ``least`` go."""
    return df.withColumn("pred", F.col("pred") & ~F.coalesce(F.col("conf") < least, F.lit(False)))


def n_per_k(df: DataFrame, k: int, most: int = 1) -> DataFrame:
    """The first ``most`` borders of each block of ``k`` positions stay."""
    if k <= 0:
        raise ValueError("k must be positive")
    x = ranked(df).withColumn("_block", F.floor(F.col("pos") / k))
    nth = F.row_number().over(Window.partitionBy("doc", "_block", "pred").orderBy("pos"))
    return x.withColumn("pred", F.col("pred") & (nth <= most)).drop("_block")


# fixed values: German cue patterns
SHIFT_START = r"(?iu)^(?:am\s+n[aä]chsten\s+(?:tag|morgen|abend|mittag)|unterdessen|inzwischen|meanwhile|sp[aä]ter|einige\s+(?:tage|wochen|monate|jahre)\s+(?:sp[aä]ter|danach)|darauf|als\s+(?:es\s+)?(?:morgen|abend|nacht)\s+wurde)"
CONTINUES = r"(?iu)^(?:(?:er|sie|es|ihm|ihr|ihnen|sein|der|die|das|dem|den|des)\b|(?:und|aber|doch|denn|also|deshalb|darum|daher|dann|noch|auch|nur)\b)"
TEMPORAL = r"(?iu)\b(?:dann|darauf|sp[aä]ter|pl[oö]tzlich|bald|nun|jetzt|sofort|w[aä]hrend)\b|\bam\s+(?:morgen|abend|tag|nachmittag)\b|\bdes\s+(?:andern|n[aä]chsten)\s+(?:tages|morgens)\b"


def discourse(df: DataFrame, text: str = "text") -> DataFrame:
    """A border goes if the next sentence begins like a continuation, unless the border's own begins a shift or
    either speaks of time."""
    here = strip(F.coalesce(F.col(text), F.lit("")))
    after = F.coalesce(F.lead(text).over(_by_doc()), F.lit(""))
    keep = here.rlike(SHIFT_START) | (after == "") | F.col(text).rlike(TEMPORAL) | after.rlike(TEMPORAL) | ~strip(after).rlike(CONTINUES)
    return df.withColumn("pred", F.col("pred") & F.coalesce(keep, F.lit(True)))


Rule = Callable[[DataFrame], DataFrame]

SCENARIOS = (
    "none", "min_scene_len_2", "min_scene_len_3", "min_scene_len_4", "min_scene_len_5", "min_scene_len_6", "burst_collapse",
    "burst_collapse_plus_min_scene_len_3", "cluster_merge", "cluster_merge_plus_min_scene_len_3", "confidence_threshold",
    "confidence_threshold_plus_min_scene_len_3", "n_per_k", "n_per_k_15", "discourse", "discourse_plus_min_scene_len_3",
)

_RULES: dict[str, tuple[Callable[..., Rule], set[str]]] = {
    "burst_collapse": (lambda **o: burst_collapse, set()),
    "cluster_merge": (lambda radius=3, **o: lambda d: cluster_merge(d, radius), set()),
    "confidence_threshold": (lambda threshold=0.85, **o: lambda d: confidence_threshold(d, threshold), {"conf"}),
    "discourse": (lambda **o: discourse, {"text"}),
    "n_per_k": (lambda k=15, **o: lambda d: n_per_k(d, k), set()),
}


def rules(scenario: str, **options) -> tuple[list[Rule | int], set[str]]:
    """The rules of a scenario in order, a number for a least gap, and the columns they need."""
    if scenario in ("none", "baseline"):
        return [], set()
    first, _, then = scenario.partition("_plus_")
    out, need = [], set()
    for name in filter(None, (first, then)):
        if m := re.fullmatch(r"min_scene_len_(\d+)", name):
            out.append(int(m[1]))
        elif m := re.fullmatch(r"n_per_k_(\d+)", name):
            out.append(lambda d, k=int(m[1]): n_per_k(d, k))
        elif name in _RULES:
            make, needed = _RULES[name]
            out.append(make(**options))
            need |= needed
        else:
            raise ValueError(f"unsupported scenario: {scenario}")
    return out, need


def sweep_flags(df: DataFrame, scenarios=SCENARIOS, **options) -> tuple[DataFrame, dict[str, str]]:
    """(rows, columns): the rows once, with a column of borders for each scenario. The rules share the documents'
    partitions; least gaps, wherever they stand in a scenario, go over the rows together, so ``n`` scenarios of one
    gap each take one pass."""
    columns = {s: f"_s{k}" for k, s in enumerate(scenarios)}
    x, todo = ranked(df), {}
    for s, c in columns.items():
        todo[s], need = rules(s, **options)
        if missing := need - set(df.columns):
            raise ValueError(f"{s} needs {', '.join(sorted(missing))}")
        x = x.withColumn(c, F.col("pred"))
    while any(todo.values()):
        for s, c in columns.items():
            while todo[s] and not isinstance(todo[s][0], int):
                x = todo[s].pop(0)(x.withColumn("_pred", F.col("pred")).withColumn("pred", F.col(c)))
                x = x.withColumn(c, F.col("pred")).withColumn("pred", F.col("_pred")).drop("_pred")
        if gaps := {columns[s]: steps.pop(0) for s, steps in todo.items() if steps}:
            x = min_gaps(x, gaps)
    return x, columns


def apply_scenario(df: DataFrame, scenario: str, **options) -> DataFrame:
    """``df`` with ``pred`` thinned by the scenario; columns that it needs must be there."""
    x, columns = sweep_flags(df, (scenario,), **options)
    return x.withColumn("pred", F.col(columns[scenario])).drop(columns[scenario])


def sweep(df: DataFrame, scenarios=SCENARIOS, **options) -> DataFrame:
    """The rows under each scenario, named in ``scenario``."""
    x, columns = sweep_flags(df, scenarios, **options)
    each = F.array(*[F.struct(F.lit(s).alias("scenario"), F.col(c).alias("pred")) for s, c in columns.items()])
    return x.select("doc", "idx", "gold", F.inline(each)).select("scenario", "doc", "idx", "gold", "pred")


def verifier_demotion(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """Borders that a verifier said not to keep go; no or no clear decision keeps them."""
    x = df.join(decisions.select("doc", "idx", F.col("keep").alias("_keep")), ["doc", "idx"], "left")
    return x.withColumn("pred", F.col("pred") & F.coalesce("_keep", F.lit(True))).drop("_keep")


def to_verify(df: DataFrame, below: float) -> DataFrame:
    return df.where(F.col("pred") & (F.col("conf").isNull() | (F.col("conf") < below)))
