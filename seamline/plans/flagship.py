"""The flagship: a cached run re-scored. Sequence, greedy thinning, tolerant scores, macro and micro averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import metrics, thinning
from .base import SEQ, sequence
from .ordered import fold_sql, tolerant_sql
from .registry import query
from .scoring import _PRF


@query(f"""WITH {SEQ}, r0 AS (SELECT doc, idx AS pos, pred FROM seq), f AS ({fold_sql('r0', 3)}),
rows_ AS (SELECT s.doc, s.idx, s.gold, f.pos IS NOT NULL AS pred FROM seq s LEFT JOIN f ON s.doc = f.doc AND s.idx = f.pos), t AS ({tolerant_sql('rows_')}), s AS (SELECT *, {_PRF} FROM t)
SELECT tol, count(*) AS documents, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM s GROUP BY tol""")
def rescore_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    t = metrics.with_prf(metrics.tolerant(thinning.min_gap(sequence(spark, sf_dir), 3)))
    return t.groupBy("tol").agg(
        F.count(F.lit(1)).alias("documents"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    )
