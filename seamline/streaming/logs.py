"""Streaming forms of the append-and-resume logs: counts as the log grows, and the guardrail live."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALL = "doc long, seq int, ok boolean, kind string"


def call_counts(calls: DataFrame) -> DataFrame:
    """(doc, calls, failures) of a stream of calls."""
    return calls.groupBy("doc").agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("ok")).alias("failures"))


def replay(calls: DataFrame) -> DataFrame:
    """Write ``calls`` as a log, stream it through ``call_counts`` until it is used up, and give the last state."""
    from ..plans.base import workspace

    spark = calls.sparkSession
    log, state = workspace(spark, "calls"), workspace(spark, "state")
    out = workspace(spark, "counts")
    calls.write.parquet(log)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream = spark.readStream.schema(CALL).parquet(log)
    q = call_counts(stream).writeStream.outputMode("complete").option("checkpointLocation", state).queryName(f"q{uuid.uuid4().hex}").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    return spark.read.parquet(out)


FATAL = ("auth_error", "billing_error", "model_not_found")


def live_guardrail(calls: DataFrame, first_n: int = 40, least: int = 2, fail_rate: float = 0.25, limit_rate: float = 0.5) -> DataFrame:
    """(doc, abort_at, why): runs that should stop, as soon as the stream shows it: at once on a fatal error, and early in
    a run on too many limits or failures. State is three counts a run; a batch's calls of a run are taken in order."""

    def step(key, frames, state):
        n, bad, limits, done = state.get if state.exists else (0, 0, 0, False)
        found = None
        if not done:
            for seq, ok, kind in pd.concat(list(frames)).sort_values("seq")[["seq", "ok", "kind"]].itertuples(index=False):
                n, bad, limits = n + 1, bad + (not ok), limits + (kind == "rate_limit")
                early = least <= n <= first_n
                why = kind if kind in FATAL else "rate_limit" if early and limits / n >= limit_rate else "failures" if early and bad / n > fail_rate else None
                if why:
                    found, done = (seq, why), True
                    break
        state.update((n, bad, limits, done))
        if found:
            yield pd.DataFrame({"doc": [key[0]], "abort_at": [found[0]], "why": [found[1]]})

    return calls.groupBy("doc").applyInPandasWithState(step, "doc long, abort_at int, why string", "n long, bad long, limits long, done boolean", "append", "NoTimeout")


def replay_guardrail(calls: DataFrame, batches: int = 3, width: int = 15) -> DataFrame:
    """Append ``calls`` to a log in ``batches`` parts of ``width`` calls a run (the last has the rest); after each the
    stream goes on from its checkpoint. Gives what ``live_guardrail`` said."""
    from ..plans.base import workspace

    spark = calls.sparkSession
    log, state, out = workspace(spark, "calls"), workspace(spark, "state"), workspace(spark, "stops")
    part = F.least(F.floor(F.col("seq") / width), F.lit(batches - 1))
    for k in range(batches):
        calls.where(part == k).select("doc", "seq", "ok", "kind").write.mode("append").parquet(log)
        live = live_guardrail(spark.readStream.schema(CALL).parquet(log)).writeStream.outputMode("append").option("checkpointLocation", state)
        live.trigger(availableNow=True).foreachBatch(lambda d, _: d.write.mode("append").parquet(out)).start().awaitTermination()
    return spark.read.schema("doc long, abort_at int, why string").parquet(out)
