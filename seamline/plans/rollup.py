"""Queries: rollups (A) and the streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, ranges, rollups
from ..operators import windows as W
from .base import PRED, SEQ, predictions, sequence, table
from .ordered import _SUGGEST, _overrides, patch_plans
from .registry import query

_COST = "(prompt_tokens * 0.3 + (output_tokens + thought_tokens) * 2.5) / 1000000"
_BATCH = f"""{PRED}, bs0 AS (SELECT slug, count(*) AS requests, count(*) FILTER (WHERE parse_ok) AS parsed, count(*) FILTER (WHERE NOT parse_ok) AS failed, count(*) FILTER (WHERE label = 'BORDER') AS borders, count(*) FILTER (WHERE label = 'NOBORDER') AS noborders,
CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(coalesce(sum(thought_tokens), 0) AS BIGINT) AS thought_tokens FROM pr GROUP BY slug),
bs AS (SELECT *, prompt_tokens / requests AS avg_prompt, output_tokens / requests AS avg_output, CAST({_COST} AS DOUBLE) AS cost FROM bs0)"""


@query(f"WITH {_BATCH} SELECT * FROM bs")
def a1_batch_summary(spark, d):
    return rollups.batch_summary(predictions(spark, d), "slug")


_BOOK = f"""{_BATCH}, br AS (SELECT slug, idx, text, parse_ok AND coalesce(label, '') = 'BORDER' AS border FROM pr),
ln AS (SELECT slug, greatest(1, idx - lag(idx, 1, -1) OVER (PARTITION BY slug ORDER BY idx)) AS len FROM br WHERE border UNION ALL SELECT slug, n - last - 1 FROM (SELECT slug, count(*) AS n, coalesce(max(CASE WHEN border THEN idx END), -1) AS last FROM br GROUP BY slug) x WHERE n - last - 1 > 0),
ls AS (SELECT slug, median(len) AS median_len, avg(len) AS mean_len, min(len) AS min_len, max(len) AS max_len, count(*) FILTER (WHERE len <= 2) / count(*) AS short_rate FROM ln GROUP BY slug),
rn AS (SELECT slug, count(*) AS n, min(idx) AS s FROM (SELECT slug, idx, idx - row_number() OVER (PARTITION BY slug ORDER BY idx) AS g FROM br WHERE border) x GROUP BY slug, g),
lr AS (SELECT slug, n AS run_len, s AS run_start FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY n DESC, s) AS k FROM rn) x WHERE k = 1),
gp AS (SELECT slug, count(*) FILTER (WHERE nx = idx + 1) AS pairs, count(*) FILTER (WHERE nx - idx >= 10) AS gaps FROM (SELECT slug, idx, lead(idx) OVER (PARTITION BY slug ORDER BY idx) AS nx FROM br WHERE border) x GROUP BY slug),
ft AS (SELECT slug, min_by(text, idx) AS first_text FROM br GROUP BY slug),
bk AS (SELECT bs.slug, requests AS n, parsed, borders, failed, cost, parsed / requests AS parse_rate, borders / requests AS border_rate, median_len, mean_len, min_len, max_len, short_rate, coalesce(run_len, 0) AS run_len, run_start, coalesce(pairs, 0) AS pairs, coalesce(gaps, 0) AS gaps, first_text
FROM bs LEFT JOIN ls ON bs.slug = ls.slug LEFT JOIN lr ON bs.slug = lr.slug LEFT JOIN gp ON bs.slug = gp.slug LEFT JOIN ft ON bs.slug = ft.slug)"""


@query(f"WITH {_BOOK} SELECT * FROM bk")
def a2_book_summary(spark, d):
    return rollups.book_summary(predictions(spark, d))


@query(f"WITH {_BOOK} SELECT slug, n, round(border_rate, 4) AS border_rate, round(median_len, 1) AS median_len, round(mean_len, 2) AS mean_len FROM bk")
def a3_corpus_stats(spark, d):
    b = rollups.book_summary(predictions(spark, d))
    return b.select("slug", "n", F.round("border_rate", 4).alias("border_rate"), F.round("median_len", 1).alias("median_len"), F.round("mean_len", 2).alias("mean_len"))


_ALL = "SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(borders) AS BIGINT) AS borders, avg(border_rate) AS border_rate, avg(parse_rate) AS parse_rate, median(median_len) AS median_len, avg(mean_len) AS mean_len, min(min_len) AS min_len, max(max_len) AS max_len FROM bk"


@query(f"WITH {_BOOK} {_ALL}")
def a4_corpus_row(spark, d):
    return rollups.corpus_row(rollups.book_summary(predictions(spark, d)))


@query("""WITH s AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), m AS (SELECT avg(total) AS a, stddev_pop(total) AS sd FROM s)
SELECT o_custkey, round((total - a) / sd, 6) AS z, CASE WHEN total > a THEN 'HIGH' ELSE 'LOW' END AS side FROM s, m WHERE abs((total - a) / sd) >= 2""")
def a5_outliers(spark, d):
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    return rollups.outliers(s, "total").select("o_custkey", F.round("z", 6).alias("z"), "side")


@query(f"""WITH {SEQ}, sc AS (SELECT *, sum(CAST(pred AS INTEGER)) OVER (PARTITION BY doc ORDER BY idx) AS scene FROM seq), sl AS (SELECT *, count(*) OVER (PARTITION BY doc, scene) AS len, coalesce(lag(pred) OVER (PARTITION BY doc ORDER BY idx), FALSE) OR coalesce(lead(pred) OVER (PARTITION BY doc ORDER BY idx), FALSE) AS beside FROM sc)
SELECT doc, count(*) FILTER (WHERE pred AND beside) AS merge_candidates, count(*) FILTER (WHERE NOT pred AND len >= 10) AS split_candidates, min_by(event_type, idx) AS opening, NOT bool_or(pred AND idx = 0) AS forced_opening FROM sl GROUP BY doc""")
def a6_candidate_totals(spark, d):
    x = W.candidates(sequence(spark, d), "pred")
    return x.groupBy("doc").agg(
        F.count_if("merge_candidate").alias("merge_candidates"), F.count_if("split_candidate").alias("split_candidates"), F.min_by("event_type", "idx").alias("opening"),
        (~F.bool_or(F.col("pred") & (F.col("idx") == 0))).alias("forced_opening"),
    )


@query(f"WITH {_BOOK} SELECT median(border_rate) AS median_rate, max(border_rate) - min(border_rate) AS rate_range, avg(parse_rate) AS mean_parse, avg(CASE WHEN failed > 3 THEN 1.0 ELSE 0.0 END) AS flagged_share FROM bk")
def a7_report_scalars(spark, d):
    b = rollups.book_summary(predictions(spark, d))
    return b.agg(F.expr("percentile(border_rate, 0.5)").alias("median_rate"), (F.max("border_rate") - F.min("border_rate")).alias("rate_range"), F.avg("parse_rate").alias("mean_parse"), F.avg(F.when(F.col("failed") > 3, 1.0).otherwise(0.0)).alias("flagged_share"))


@query(f"WITH {_BATCH} SELECT count(*) FILTER (WHERE parsed / requests >= 0.9) AS complete, CAST(sum(requests) FILTER (WHERE parsed / requests >= 0.9) AS BIGINT) AS sentences, sum(cost) FILTER (WHERE parsed / requests >= 0.9 AND requests % 2 = 1) AS spent FROM bs")
def a8_progress_totals(spark, d):
    b = rollups.batch_summary(predictions(spark, d), "slug")
    done, seeded = F.col("parsed") / F.col("requests") >= 0.9, F.col("requests") % 2 == 0
    return b.agg(F.count_if(done).alias("complete"), F.sum(F.when(done, F.col("requests"))).alias("sentences"), F.sum(F.when(done & ~seeded, F.col("cost"))).alias("spent"))


@query(f"WITH {_SUGGEST} SELECT confidence, method, label, count(*) AS n FROM plan GROUP BY ALL")
def a9_patch_counters(spark, d):
    p = patch_plans(predictions(spark, d), _overrides(spark, d))
    return p.groupBy("confidence", "method", "label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc())


@query(f"WITH {_BOOK} SELECT slug, n, border_rate, median_len, 0 AS row_order FROM bk UNION ALL SELECT 'ALL', n, border_rate, median_len, 1 FROM ({_ALL}) z")
def a10_detail_and_total(spark, d):
    from ..sources.sinks import with_total

    b = rollups.book_summary(predictions(spark, d))
    return with_total(b.select("slug", "n", "border_rate", "median_len"), rollups.corpus_row(b).select("n", "border_rate", "median_len"), "slug")


@query(f"WITH {_BATCH} SELECT slug, requests, requests = parsed + failed AS consistent, (SELECT count(*) FROM pr) = (SELECT sum(requests) FROM bs) AS corpus_ok FROM bs")
def a11_merge_stats(spark, d):
    x = predictions(spark, d)
    b = rollups.batch_summary(x, "slug")
    check = b.agg(F.sum("requests").alias("s")).crossJoin(x.agg(F.count(F.lit(1)).alias("c"))).select((F.col("s") == F.col("c")).alias("corpus_ok"))
    return b.select("slug", "requests", (F.col("requests") == F.col("parsed") + F.col("failed")).alias("consistent")).crossJoin(check)


_UP = f"""{PRED}, u AS (SELECT key, slug, idx, 0 AS p, event_id AS seq, label FROM pr WHERE event_id % 13 <> 0 UNION ALL SELECT key, slug, idx, 1, event_id, 'PATCHED' FROM pr WHERE event_id % 5 = 0),
up AS (SELECT key, slug, idx, label FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY p DESC, seq DESC) AS k FROM u) x WHERE k = 1)"""


def _upserted(spark, d):
    x = predictions(spark, d).select("key", "slug", "idx", F.col("event_id").alias("seq"), "label")
    base = x.where("seq % 13 <> 0")
    later = x.where("seq % 5 = 0").withColumn("label", F.lit("PATCHED"))
    return align.upsert(base, later, "key", "seq")


@query(f"WITH {_UP} SELECT slug, idx, label, CAST(row_number() OVER (ORDER BY slug, idx) AS INTEGER) AS position FROM up")
def a12_upsert(spark, d):
    return W.global_position(_upserted(spark, d), ["slug"], ["idx"]).select("slug", "idx", "label", "position")


@query(f"WITH {_UP} SELECT key, label, CAST(row_number() OVER (ORDER BY key) AS INTEGER) AS position FROM up")
def a13_corpus_merge(spark, d):
    # keys sort as strings; those of one slug stand together, as they share what precedes the colon
    x = _upserted(spark, d).withColumn("prefix", F.concat("slug", F.lit(":")))
    return W.global_position(x, ["prefix"], ["key"]).select("key", "label", "position")


@query(f"WITH {PRED} SELECT slug, array_to_string(list(DISTINCT key ORDER BY key), ',') AS keys, CAST(row_number() OVER (ORDER BY CAST(regexp_extract(slug, '([0-9]+)', 1) AS BIGINT)) AS INTEGER) AS by_number FROM pr WHERE NOT parse_ok GROUP BY slug")
def a14_failed_keys(spark, d):
    from ..functions.labels import stem_number

    f = rollups.failed_keys(predictions(spark, d))
    return ranges.rank(f.select("slug", F.array_join("keys", ",").alias("keys")), [stem_number("slug"), "slug"], "by_number")


_CALLS = f"{SEQ}, cl AS (SELECT doc, idx AS seq, k % 6 <> 0 AS ok, CASE WHEN k % 12 = 0 THEN 'rate_limit' WHEN k % 6 = 0 AND k > 90 THEN 'auth_error' WHEN k % 6 = 0 THEN 'api_error' END AS kind FROM seq)"


def _calls(spark, d):
    k = F.col("k")
    kind = F.when(k % 12 == 0, "rate_limit").when((k % 6 == 0) & (k > 90), "auth_error").when(k % 6 == 0, "api_error")
    return sequence(spark, d).select("doc", F.col("idx").alias("seq"), (k % 6 != 0).alias("ok"), kind.alias("kind"))


_GUARD = f"""WITH {_CALLS}, r AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (WHERE NOT ok) OVER w AS bad, count(*) FILTER (WHERE kind = 'rate_limit') OVER w AS lim FROM cl WINDOW w AS (PARTITION BY doc ORDER BY seq)),
y AS (SELECT doc, seq, CASE WHEN kind IN ('auth_error', 'billing_error', 'model_not_found') THEN kind WHEN n BETWEEN 2 AND 40 AND lim / n >= 0.5 THEN 'rate_limit' WHEN n BETWEEN 2 AND 40 AND bad / n > 0.25 THEN 'failures' END AS why FROM r)
SELECT doc, min(seq) AS abort_at, min_by(why, seq) AS why FROM y WHERE why IS NOT NULL GROUP BY doc"""


@query(_GUARD)
def a15_guardrail(spark, d):
    return rollups.guardrail(_calls(spark, d))


@query(f"WITH {_BOOK} SELECT bk.slug, n, parse_rate, border_rate, median_len, coalesce(b.borders, '') AS borders FROM bk LEFT JOIN (SELECT slug, array_to_string(list(idx ORDER BY idx), ',') AS borders FROM br WHERE border GROUP BY slug) b ON bk.slug = b.slug")
def a16_book_review(spark, d):
    x = predictions(spark, d)
    found = F.array_sort(F.collect_list(F.when(F.col("parse_ok") & (F.col("label") == "BORDER"), F.col("idx"))))
    borders = x.groupBy("slug").agg(F.array_join(found.cast("array<string>"), ",").alias("borders"))
    return rollups.book_summary(x).select("slug", "n", "parse_rate", "border_rate", "median_len").join(borders, "slug", "left")


@query(f"""WITH {_BATCH} SELECT slug, requests AS sentences, CAST(CASE WHEN cost * (requests % 3) > 0 THEN cost ELSE requests * 0.004 END AS DOUBLE) AS cost, 'seeded' AS status FROM bs WHERE starts_with(slug, 'u1') AND parsed / requests < 0.95""")
def a17_seed_ledger(spark, d):
    b = rollups.batch_summary(predictions(spark, d).where(F.startswith("key", F.lit("u1"))), "slug")
    done = b.where("parsed / requests >= 0.95").select("slug")
    paid = F.col("cost") * (F.col("requests") % 3)
    x = b.select("slug", F.col("requests").alias("sentences"), F.when(paid > 0, F.col("cost")).otherwise(F.col("requests") * 0.004).alias("cost"), F.lit("seeded").alias("status"))
    return align.remaining(x, done, ["slug"])


@query(f"WITH {SEQ} SELECT CASE WHEN doc % 10 = 0 THEN 'val' WHEN doc % 10 = 1 THEN 'eval' ELSE 'train' END AS split, count(*) FILTER (WHERE gold) AS border, count(*) FILTER (WHERE NOT gold) AS noborder, count(DISTINCT doc) AS sources FROM seq GROUP BY 1")
def a18_split_counts(spark, d):
    split = F.when(F.col("doc") % 10 == 0, "val").when(F.col("doc") % 10 == 1, "eval").otherwise("train")
    x = sequence(spark, d).withColumn("split", split).withColumn("label", F.when(F.col("gold"), "border").otherwise("noborder"))
    n = x.groupBy("split").pivot("label", ["border", "noborder"]).agg(F.count(F.lit(1)))
    return n.join(x.groupBy("split").agg(F.countDistinct("doc").alias("sources")), "split")


@query(f"WITH {_CALLS} SELECT doc, count(*) AS calls, count(*) FILTER (WHERE NOT ok) AS failures FROM cl GROUP BY doc")
def stream_call_counts(spark, d):
    """Running counts of calls per run, kept by a streaming aggregation that reads the log as it grows."""
    from ..streaming.logs import replay

    return replay(_calls(spark, d))


@query(_GUARD)
def stream_guardrail(spark, d):
    """The guardrail live: the log arrives in three parts, and each run's state says when it should stop."""
    from ..streaming.logs import replay_guardrail

    return replay_guardrail(_calls(spark, d))
