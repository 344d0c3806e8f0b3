"""Queries: metrics (M), joins and alignment (J), sampling (X), planning (T)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.labels import alerts
from ..operators import align, metrics, planning, ranges, sampling
from .base import PRED, SAMPLE, SENT, SEQ, predictions, sample, sentences, sequence, table
from .ordered import tolerant_sql
from .registry import query

_P = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END"
_R = "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END"
_PRF = f"{_P} AS precision, {_R} AS recall, CASE WHEN {_P} + {_R} > 0 THEN 2 * {_P} * {_R} / ({_P} + {_R}) ELSE 0.0 END AS f1"
_CONF = "count(*) FILTER (WHERE pred AND gold) AS tp, count(*) FILTER (WHERE pred AND NOT gold) AS fp, count(*) FILTER (WHERE NOT pred AND gold) AS fn, count(*) FILTER (WHERE NOT pred AND NOT gold) AS tn"


@query(f"WITH {SEQ}, c AS (SELECT doc, {_CONF} FROM seq GROUP BY doc) SELECT *, {_PRF}, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM c")
def m1_exact(spark, d):
    return metrics.exact(sequence(spark, d), "doc")


def _sampled_sql(tols=(0, 1, 3)):
    parts = [
        f"""SELECT doc, {t} AS tol, count(*) FILTER (WHERE gold AND s AND np) AS tp, count(*) FILTER (WHERE p AND NOT ng) AS fp, count(*) FILTER (WHERE gold AND s AND NOT np) AS fn FROM (
    SELECT doc, p, gold, s, bool_or(p) OVER w AS np, bool_or(gold) OVER w AS ng FROM m WINDOW w AS (PARTITION BY doc ORDER BY idx RANGE BETWEEN {t} PRECEDING AND {t} FOLLOWING)) z GROUP BY doc"""
        for t in tols
    ]
    return f"m AS (SELECT doc, idx, gold, event_id % 3 = 0 AS s, pred AND event_id % 3 = 0 AS p FROM seq), t AS ({' UNION ALL '.join(parts)})"


@query(f"WITH {SEQ}, {_sampled_sql()} SELECT *, {_PRF} FROM t")
def m2_tolerant_sampled(spark, d):
    x = sequence(spark, d).withColumn("sampled", F.col("event_id") % 3 == 0)
    return metrics.with_prf(metrics.tolerant(x, (0, 1, 3), sampled="sampled"))


@query(f"WITH {SEQ}, t AS ({tolerant_sql('seq', (0, 1, 3, 5))}) SELECT *, {_PRF} FROM t")
def m3_tolerant_dense(spark, d):
    return metrics.with_prf(metrics.tolerant(sequence(spark, d), (0, 1, 3, 5)))


@query(f"WITH {SAMPLE}, f AS (SELECT doc, unnest(range(0, max(idx) + 1)) AS idx FROM sam GROUP BY doc) SELECT f.doc, CAST(f.idx AS INTEGER) AS idx, coalesce(s.gold, FALSE) AS gold FROM f LEFT JOIN sam s ON f.doc = s.doc AND f.idx = s.idx")
def m4_dense_gold(spark, d):
    return metrics.dense(sample(spark, d))


_CARD = "SELECT doc, count(*) AS n, count(*) FILTER (WHERE gold) AS n_gold, count(*) FILTER (WHERE pred) AS n_pred, CASE WHEN count(*) FILTER (WHERE gold) > 0 THEN count(*) FILTER (WHERE pred) / count(*) FILTER (WHERE gold) END AS over_prediction FROM seq GROUP BY doc"


@query(f"WITH {SEQ} {_CARD}")
def m5_score_card(spark, d):
    return metrics.score_card(sequence(spark, d))


_T = f"t AS ({tolerant_sql('seq')}), s AS (SELECT *, {_PRF} FROM t)"


@query(f"""WITH {SEQ}, {_T} SELECT tol, 'unrounded' AS mode, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM s GROUP BY tol
UNION ALL SELECT tol, 'rounded', avg(round(precision, 4)), avg(round(recall, 4)), avg(round(f1, 4)) FROM s GROUP BY tol""")
def m6_macro(spark, d):
    t = metrics.tolerant(sequence(spark, d))
    return metrics.union_all([metrics.macro(t, "tol", places=p).withColumn("mode", F.lit(m)) for p, m in ((None, "unrounded"), (4, "rounded"))])


@query(f"WITH {SEQ}, t0 AS ({tolerant_sql('seq')}), t AS (SELECT tol, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM t0 GROUP BY tol) SELECT *, {_PRF} FROM t")
def m7_micro(spark, d):
    return metrics.micro(metrics.tolerant(sequence(spark, d)), "tol")


@query(f"WITH {SEQ}, q AS (SELECT 'all' AS doc, row_number() OVER (ORDER BY doc, idx) - 1 AS idx, pred, gold FROM seq), t AS ({tolerant_sql('q')}) SELECT tol, tp, fp, fn FROM t")
def m8_concatenated(spark, d):
    return metrics.tolerant_concatenated(sequence(spark, d))


_M9 = f"""{PRED}, dr AS (SELECT slug, count(*) AS n, avg(CASE WHEN (coalesce(label, '') = 'BORDER') = gold THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) FILTER (WHERE NOT parse_ok) / count(*) AS parse_failure_rate,
avg(length(raw)) AS avg_chars, CASE WHEN count(*) FILTER (WHERE gold) > 0 THEN count(*) FILTER (WHERE coalesce(label, '') = 'BORDER') / count(*) FILTER (WHERE gold) END AS over_prediction FROM pr GROUP BY slug)"""


def document_results(pred):
    border = F.coalesce("label", F.lit("")) == "BORDER"
    return pred.groupBy("slug").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(border == F.col("gold"), 1.0).otherwise(0.0)).alias("accuracy"),
        (F.count_if(~F.col("parse_ok")) / F.count(F.lit(1))).alias("parse_failure_rate"),
        F.avg(F.length("raw")).alias("avg_chars"),
        F.when(F.count_if("gold") > 0, F.count_if(border) / F.count_if("gold")).alias("over_prediction"),
    )


@query(f"WITH {_M9} SELECT * FROM dr")
def m9_document_result(spark, d):
    return document_results(predictions(spark, d))


@query(f"WITH {_M9} SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS n, avg(accuracy) AS accuracy, avg(parse_failure_rate) AS parse_failure_rate, avg(avg_chars) AS avg_chars, avg(over_prediction) AS over_prediction FROM dr")
def m10_run_rollup(spark, d):
    x = document_results(predictions(spark, d))
    return x.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("n"), *[F.avg(c).alias(c) for c in ("accuracy", "parse_failure_rate", "avg_chars", "over_prediction")])


@query(f"""WITH {PRED} SELECT slug, count(*) FILTER (WHERE NOT parse_ok) AS failures, count(*) FILTER (WHERE NOT parse_ok) / count(*) AS failure_rate, avg(length(raw)) AS avg_chars,
coalesce(array_to_string(list_slice(list(key ORDER BY idx) FILTER (WHERE NOT parse_ok), 1, 3), ','), '') AS samples FROM pr GROUP BY slug""")
def m11_parse_diagnostics(spark, d):
    x = predictions(spark, d)
    failing = F.collect_list(F.when(~F.col("parse_ok"), F.struct("idx", "key")))
    return x.groupBy("slug").agg(
        F.count_if(~F.col("parse_ok")).alias("failures"), (F.count_if(~F.col("parse_ok")) / F.count(F.lit(1))).alias("failure_rate"), F.avg(F.length("raw")).alias("avg_chars"),
        F.array_join(F.transform(F.slice(F.array_sort(failing), 1, 3), lambda s: s["key"]), ",").alias("samples"),
    )


_J8 = f"""{SEQ}, j AS (SELECT doc, count(*) FILTER (WHERE value > 60 AND value > 40 AND k % 2 = 0 OR value > 60 AND k % 2 = 0) AS shared, count(*) FILTER (WHERE value > 60 AND NOT (value > 40 AND k % 2 = 0)) AS only_a, count(*) FILTER (WHERE value > 40 AND k % 2 = 0 AND NOT value > 60) AS only_b FROM seq WHERE value > 40 GROUP BY doc)"""


def _second_run(spark, d):
    return sequence(spark, d).withColumn("pred", (F.col("value") > 40) & (F.col("k") % 2 == 0))


@query(f"WITH {_J8} SELECT doc, shared, shared / nullif(shared + only_b, 0) AS precision_vs_reference, shared / nullif(shared + only_a, 0) AS recall_vs_reference, only_b - only_a AS border_delta FROM j WHERE shared + only_a + only_b > 0")
def m12_agreement(spark, d):
    x = align.compare_runs(sequence(spark, d), _second_run(spark, d))
    return x.select("doc", "shared", F.try_divide("shared", F.col("shared") + F.col("only_b")).alias("precision_vs_reference"), F.try_divide("shared", F.col("shared") + F.col("only_a")).alias("recall_vs_reference"), (F.col("only_b") - F.col("only_a")).alias("border_delta"))


_TAGS = "tg AS (SELECT doc, CASE WHEN pred AND NOT gold THEN 'fp' ELSE 'fn' END AS kind, event_type AS tag FROM seq WHERE pred <> gold)"


@query(f"WITH {SEQ}, {_TAGS} SELECT doc, tag, kind, count(*) AS n FROM tg GROUP BY GROUPING SETS ((doc, tag), (doc), (tag), (kind))")
def m13_error_tags(spark, d):
    x = sequence(spark, d).where("pred <> gold").select("doc", F.when(F.col("pred"), "fp").otherwise("fn").alias("kind"), F.col("event_type").alias("tag"))
    return x.groupingSets([["doc", "tag"], ["doc"], ["tag"], ["kind"]], "doc", "tag", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SEQ}, c AS (SELECT doc, {_CONF} FROM seq WHERE conf IS NULL OR conf >= 0.3 GROUP BY doc), s AS (SELECT *, {_PRF} FROM c) SELECT avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM s")
def m14_stage_two_macro(spark, d):
    return metrics.macro(metrics.confusion(sequence(spark, d).where("conf IS NULL OR conf >= 0.3"), "doc"))


@query(f"""WITH {SEQ}, g AS (SELECT doc, idx, gold, CASE WHEN doc % 10 = 3 THEN FALSE ELSE pred END AS pred FROM seq), t AS ({tolerant_sql('g', (3,))}), s AS (SELECT *, {_PRF} FROM t)
SELECT count(*) AS documents, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, avg(f1) AS macro_f1, (SELECT count(*) FILTER (WHERE pred) / count(*) FILTER (WHERE gold) FROM g) AS over_prediction FROM s""")
def m15_corpus_scoring(spark, d):
    gold = sequence(spark, d).select("doc", "idx", "gold")
    preds = sequence(spark, d).where("doc % 10 <> 3").select("doc", "idx", "pred").unionByName(sequence(spark, d).select((F.col("doc") + 100_000).alias("doc"), "idx", "pred"))
    x = gold.join(preds, ["doc", "idx"], "left").withColumn("pred", F.coalesce("pred", F.lit(False)))
    t = metrics.with_prf(metrics.tolerant(x, (3,)))
    over = x.agg((F.count_if("pred") / F.count_if("gold")).alias("over_prediction"))
    return t.agg(F.count(F.lit(1)).alias("documents"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.avg("f1").alias("macro_f1")).crossJoin(over)


@query(f"WITH {SEQ} SELECT count(*) FILTER (WHERE gold) AS n_border, count(*) FILTER (WHERE NOT gold) AS n_noborder, (SELECT count(*) FROM events) AS expected FROM seq")
def m16_label_counts(spark, d):
    x = sequence(spark, d).agg(F.count_if("gold").alias("n_border"), F.count_if(~F.col("gold")).alias("n_noborder"))
    return x.crossJoin(table(spark, d, "events").agg(F.count(F.lit(1)).alias("expected")))


@query(f"""WITH {PRED}, r AS (SELECT slug, count(*) FILTER (WHERE gold) AS g, count(*) FILTER (WHERE coalesce(label, '') = 'BORDER') AS p, count(*) FILTER (WHERE NOT parse_ok) / count(*) AS fr FROM pr GROUP BY slug)
SELECT slug, concat_ws(';', CASE WHEN g > 0 AND p < 12 THEN 'few_predicted_borders' END, CASE WHEN fr > 0.1 THEN 'parse_failures' END) AS warnings FROM r""")
def m17_report(spark, d):
    r = predictions(spark, d).groupBy("slug").agg(F.count_if("gold").alias("g"), F.count_if(F.coalesce("label", F.lit("")) == "BORDER").alias("p"), (F.count_if(~F.col("parse_ok")) / F.count(F.lit(1))).alias("fr"))
    w = alerts(((F.col("g") > 0) & (F.col("p") < 12), "few_predicted_borders"), (F.col("fr") > 0.1, "parse_failures"))
    return r.select("slug", F.array_join(w, ";").alias("warnings"))


# -- joins -------------------------------------------------------------------------------------------------


def _gold_docs(spark, d):
    x = table(spark, d, "documents").select(F.col("source").alias("doc"), "doc_id", "text", (F.length("text") % 2 == 0).alias("gold"))
    return x.withColumn("idx", F.row_number().over(Window.partitionBy("doc").orderBy("doc_id")) - 1)


_J1 = """g AS (SELECT source AS doc, doc_id, text, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS idx FROM documents),
p AS (SELECT doc, idx, doc_id AS seq, text, CASE WHEN doc_id % 3 = 0 THEN 'BORDER' ELSE 'NOBORDER' END AS label FROM g WHERE doc_id % 4 <> 1),
tx AS (SELECT doc, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, min_by(label, seq) AS first_label, max_by(label, seq) AS last_label FROM p GROUP BY ALL),
j AS (SELECT g.doc, g.idx, coalesce(p.label, tx.{0}, 'NOBORDER') AS label, CASE WHEN p.label IS NOT NULL THEN 'index' WHEN tx.t IS NOT NULL THEN 'text' ELSE 'none' END AS matched_by
FROM g LEFT JOIN p ON g.doc = p.doc AND g.idx = p.idx LEFT JOIN tx ON g.doc = tx.doc AND tx.t = trim(regexp_replace(g.text, '\\s+', ' ', 'g')))"""


def _fallback(spark, d, last):
    g = _gold_docs(spark, d)
    p = g.where("doc_id % 4 <> 1").select("doc", "idx", F.col("doc_id").alias("seq"), "text", F.when(F.col("doc_id") % 3 == 0, "BORDER").otherwise("NOBORDER").alias("label"))
    return align.fallback_join(g.select("doc", "idx", "text"), p, last).select("doc", "idx", "label", "matched_by")


@query(f"WITH {_J1.format('first_label')} SELECT * FROM j")
def j1_fallback_join_first(spark, d):
    return _fallback(spark, d, False)


@query(f"WITH {_J1.format('last_label')} SELECT * FROM j")
def j1_fallback_join_last(spark, d):
    return _fallback(spark, d, True)


@query(f"WITH {SEQ} SELECT a.doc, a.idx FROM seq a WHERE a.pred AND EXISTS (SELECT 1 FROM seq b WHERE b.doc = a.doc AND b.gold AND b.idx BETWEEN a.idx - 2 AND a.idx + 2)")
def j2_tolerance_join(spark, d):
    x = sequence(spark, d)
    return align.within_tolerance(x.where("pred").select("doc", "idx"), x.where("gold").select("doc", "idx"), 2)


def _spans(spark, d):
    s = sentences(spark, d)
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("end", F.sum(F.length("text") + 1).over(w)).withColumn("begin", F.col("end") - F.length("text") - 1)
    inner = s.select(F.col("doc_id").alias("doc"), "begin", "end")
    outer = s.where("idx % 5 = 0").select(F.col("doc_id").alias("doc"), F.floor(F.col("idx") / 5).alias("scene"), (F.col("begin") + F.when(F.col("idx") % 2 == 0, 0).otherwise(3)).alias("begin"), (F.col("begin") + 400).alias("end"))
    return inner, outer


_SPANS = f"""{SENT}, sp0 AS (SELECT doc_id AS doc, idx, text, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS e FROM sent), inn AS (SELECT doc, idx, CAST(e - length(text) - 1 AS BIGINT) AS b, CAST(e AS BIGINT) AS e FROM sp0),
outr AS (SELECT doc, idx // 5 AS scene, b + CASE WHEN idx % 2 = 0 THEN 0 ELSE 3 END AS b, b + 400 AS e FROM inn WHERE idx % 5 = 0)"""


@query(f"WITH {_SPANS} SELECT o.doc, CAST(o.scene AS BIGINT) AS scene, min(i.b) AS first_begin FROM inn i JOIN outr o ON i.doc = o.doc AND i.b >= o.b AND i.e <= o.e GROUP BY o.doc, o.scene")
def j3_containment(spark, d):
    return align.contained_in(*_spans(spark, d))


@query(f"WITH {_SPANS} SELECT o.doc, CAST(o.scene AS BIGINT) AS scene, (SELECT min(i.b) FROM inn i WHERE i.doc = o.doc AND i.b >= o.b) AS first_begin FROM outr o")
def j3_begin_only(spark, d):
    return align.next_begin(*_spans(spark, d))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j4_anti_join(spark, d):
    return align.remaining(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"]).select("doc_id")


@query("SELECT d.doc_id, d.lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def j5_semi_join(spark, d):
    return align.selected(table(spark, d, "documents"), table(spark, d, "labels").where("quality = 1"), ["doc_id"]).select("doc_id", "lang")


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j6_lookup(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")


@query("SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 64 WHEN c_mktsegment = 'MACHINERY' THEN 128 ELSE 32 END AS max_tokens, CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 0.2 ELSE 0.0 END AS DOUBLE) AS temperature FROM customer")
def j7_profile_merge(spark, d):
    profiles = spark.createDataFrame([("BUILDING", 64, 0.2), ("MACHINERY", 128, None)], "c_mktsegment string, max_tokens int, temperature double")
    x = table(spark, d, "customer").join(F.broadcast(profiles), "c_mktsegment", "left")
    return x.select("c_custkey", "c_mktsegment", F.coalesce("max_tokens", F.lit(32)).alias("max_tokens"), F.coalesce("temperature", F.lit(0.0)).alias("temperature"))


@query(f"WITH {_J8} SELECT * FROM j WHERE shared + only_a + only_b > 0")
def j8_compare_runs(spark, d):
    return align.compare_runs(sequence(spark, d), _second_run(spark, d))


@query("""WITH p AS (SELECT o_custkey AS c, count(*) AS orders FROM orders GROUP BY o_custkey), x AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 10 END AS expected_orders FROM customer)
SELECT x.c, x.expected_orders, p.orders, x.expected_orders IS NULL OR coalesce(abs(coalesce(p.orders, 0) - x.expected_orders) <= 1.0, FALSE) AS ok FROM x LEFT JOIN p ON x.c = p.c""")
def j9_verify_counts(spark, d):
    parsed = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.count(F.lit(1)).alias("orders"))
    expected = table(spark, d, "customer").select(F.col("c_custkey").alias("c"), F.when(F.col("c_custkey") % 7 != 0, 10).alias("expected_orders"))
    return align.verify_counts(parsed, expected, ["c"], ["orders"]).select("c", "expected_orders", "orders", "ok")


@query("SELECT DISTINCT o_custkey, o_orderpriority FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders z WHERE z.o_custkey = o.o_custkey AND z.o_orderpriority = o.o_orderpriority AND z.o_orderstatus = 'F')")
def j10_completed_pairs(spark, d):
    o = table(spark, d, "orders")
    pairs = o.select("o_custkey", "o_orderpriority").distinct()
    return align.remaining(pairs, o.where("o_orderstatus = 'F'"), ["o_custkey", "o_orderpriority"])


@query(f"WITH {PRED}, l AS (SELECT slug, count(*) FILTER (WHERE parse_ok) / count(*) >= 0.9 AS done FROM pr GROUP BY slug) SELECT slug FROM l WHERE NOT done")
def j11_open_slugs(spark, d):
    x = predictions(spark, d).groupBy("slug").agg(F.when(F.count_if("parse_ok") / F.count(F.lit(1)) >= 0.9, "complete").otherwise("open").alias("status"))
    ledger = x.select(F.create_map("slug", F.struct("status")).alias("books"))
    done = ledger.select(F.explode("books").alias("slug", "entry")).where("entry.status = 'complete'").select("slug")
    return align.remaining(x.select("slug"), done, ["slug"])


# -- sampling ----------------------------------------------------------------------------------------------

_EVEN = "SELECT doc, idx FROM (SELECT n.doc, n.idx, row_number() OVER (PARTITION BY n.doc ORDER BY n.idx) - 1 AS r, count(*) OVER (PARTITION BY n.doc) AS size, need FROM {0} n JOIN (SELECT doc, {1} AS need FROM seq GROUP BY doc) b ON n.doc = b.doc WHERE need > 0) z WHERE size <= need OR r IN (SELECT unnest(list_transform(range(0, need), lambda i: CAST(floor(i * (size / need)) AS BIGINT))))"
_X1 = f"{SEQ}, oth AS (SELECT doc, idx FROM seq WHERE NOT gold)"


@query(f"WITH {_X1} SELECT doc, idx, TRUE AS gold FROM seq WHERE gold UNION ALL SELECT doc, idx, FALSE FROM ({_EVEN.format('oth', 'count(*) FILTER (WHERE gold)')}) e")
def x1_stratified(spark, d):
    return sampling.stratified(sequence(spark, d)).select("doc", "idx", "gold")


_ORDER = "md5(concat_ws('|', 42, doc, idx))"


@query(f"WITH {SEQ} SELECT doc, idx FROM (SELECT doc, idx, row_number() OVER (PARTITION BY doc ORDER BY {_ORDER}, idx) AS k FROM seq WHERE gold) x WHERE k <= 5")
def x2_capped_sample(spark, d):
    return sampling.capped(sequence(spark, d).where("gold"), 5, 42).select("doc", "idx")


@query(f"WITH {SEQ} SELECT doc, idx, gold FROM seq")
def x3_full_sample(spark, d):
    return sequence(spark, d).select("doc", "idx", "gold")


@query(f"WITH {SEQ} {_EVEN.format('seq', '7')}")
def x4_evenly(spark, d):
    return sampling.evenly(sequence(spark, d), F.lit(7)).select("doc", "idx")


_N = "SELECT doc, count(*) FILTER (WHERE gold) AS b, count(*) FILTER (WHERE NOT gold) AS o FROM seq GROUP BY doc"


@query(f"WITH {SEQ}, n AS ({_N}) SELECT doc, CAST(greatest(1, round_even(o * 0.25, 0)) AS BIGINT) AS pct, CAST(greatest(1, round_even(o * 0.1, 0)) AS BIGINT) AS paper, CAST(least(floor(b * 2.0), o) AS BIGINT) AS ratio, o AS everything FROM n")
def x5_negative_policy(spark, d):
    x = sequence(spark, d).groupBy("doc").agg(F.count_if("gold").alias("b"), F.count_if(~F.col("gold")).alias("o"))
    want = lambda m, v=0.0: sampling.negatives_wanted(m, F.col("b"), F.col("o"), v)
    return x.select("doc", want("pct", 0.25).alias("pct"), want("paper").alias("paper"), want("ratio", 2.0).alias("ratio"), want("ratio", 0.0).alias("everything"))


_DISTANCE = "least(idx - last_value(CASE WHEN gold THEN idx END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY idx ROWS UNBOUNDED PRECEDING), first_value(CASE WHEN gold THEN idx END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - idx)"


@query(f"""WITH {SEQ}, n AS (SELECT *, gold OR coalesce({_DISTANCE} <= 1, FALSE) AS near, count(*) FILTER (WHERE NOT gold) OVER (PARTITION BY doc) AS others FROM seq),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, near ORDER BY {_ORDER}, idx) AS nth, count(*) FILTER (WHERE near AND NOT gold) OVER (PARTITION BY doc) AS have FROM n)
SELECT doc, idx, gold FROM r WHERE near OR nth <= greatest(1, round_even(others * 0.5, 0)) - have""")
def x6_hard_negatives(spark, d):
    return sampling.hard_negatives(sequence(spark, d), 1, 0.5, 42).select("doc", "idx", "gold")


@query("""WITH s AS (SELECT DISTINCT source FROM documents), k AS (SELECT source, row_number() OVER (ORDER BY md5(concat_ws('|', 42, source)), source) AS k, count(*) OVER () AS n FROM s)
SELECT doc_id, source, k <= greatest(1, floor(n * 0.2)) AS held_out FROM documents JOIN k USING (source)""")
def x7_holdout(spark, d):
    return sampling.holdout(table(spark, d, "documents"), "source", 0.2, seed=42).select("doc_id", "source", "held_out")


@query("""WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source, CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS fold, n AS n_eval, CAST(sum(n) OVER () AS BIGINT) - n AS n_train,
CASE WHEN row_number() OVER (ORDER BY source) = 3 THEN 'eval' ELSE 'train' END AS role_in_fold_2 FROM s""")
def x8_folds(spark, d):
    x = table(spark, d, "documents")
    n = x.groupBy("source").agg(F.count(F.lit(1)).alias("n_eval")).crossJoin(x.agg(F.count(F.lit(1)).alias("_all")))
    return sampling.folds(x, "source").join(n, "source").select("source", "fold", "n_eval", (F.col("_all") - F.col("n_eval")).alias("n_train"), sampling.fold_role("fold", 2).alias("role_in_fold_2"))


@query("SELECT DISTINCT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text FROM (SELECT c.*, length(text) > 200 AS pred, role = 'user' AS gold FROM conversations c) x WHERE pred AND NOT gold")
def x9_hard_negative_texts(spark, d):
    from ..functions.labels import collapse_space

    x = table(spark, d, "conversations").where((F.length("text") > 200) & (F.col("role") != "user"))
    return x.select(collapse_space("text", lower=True).alias("text")).distinct()


_DIMS = ("time", "location", "character", "action")
_X10 = " || ".join(f"'{n}: ' || CASE WHEN k % {m} = 0 THEN 'change' ELSE 'same' END || chr(10)" for n, m in zip(_DIMS, (2, 3, 5, 7)))


@query(f"""WITH {SEQ} SELECT doc, idx, {_X10} || 'Answer: ' || CASE WHEN gold THEN 'BORDER' ELSE 'NOBORDER' END AS cot, '{{"label":"' || CASE WHEN gold THEN 'BORDER' ELSE 'NOBORDER' END || '"}}' AS json FROM seq""")
def x10_targets(spark, d):
    x = sequence(spark, d)
    reasons = alerts(*[(F.col("k") % m == 0, n) for n, m in zip(_DIMS, (2, 3, 5, 7))])
    label = F.when(F.col("gold"), "BORDER").otherwise("NOBORDER")
    lines = [F.concat(F.lit(f"{n}: "), F.when(F.array_contains("reasons", n), "change").otherwise("same"), F.lit("\n")) for n in _DIMS]
    return x.withColumn("reasons", reasons).select("doc", "idx", F.concat(*lines, F.lit("Answer: "), label).alias("cot"), F.to_json(F.struct(label.alias("label"))).alias("json"))


# -- planning ----------------------------------------------------------------------------------------------


@query(f"WITH {SEQ} SELECT doc, idx, conf, rank FROM (SELECT doc, idx, conf, CAST(row_number() OVER (PARTITION BY doc ORDER BY conf DESC NULLS LAST, idx) AS INTEGER) AS rank FROM seq WHERE pred AND NOT gold) x WHERE rank <= 5")
def t1_top_false_positives(spark, d):
    x = sequence(spark, d).where("pred and not gold")
    return planning.top_k(x, 5, ["doc"], [F.col("conf").desc_nulls_last(), "idx"]).select("doc", "idx", "conf", "rank")


_F3 = f"t AS ({tolerant_sql('seq', (3,))}), s AS (SELECT doc, {_PRF} FROM t)"


@query(f"WITH {SEQ}, {_F3} SELECT doc, f1, CAST(row_number() OVER (ORDER BY coalesce(f1, 0) DESC, coalesce(recall, 0) DESC, doc) AS INTEGER) AS rank FROM s")
def t2_ranked_runs(spark, d):
    s = metrics.with_prf(metrics.tolerant(sequence(spark, d), (3,)))
    return ranges.rank(s.select("doc", "f1", "recall"), [-F.coalesce("f1", F.lit(0.0)), -F.coalesce("recall", F.lit(0.0)), "doc"]).select("doc", "f1", "rank")


@query("SELECT name, origin, balance, segment FROM (SELECT c_name AS name, 'customer' AS origin, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, 'supplier', s_acctbal, NULL FROM supplier) x WHERE balance > 9000")
def t3_candidate_union(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.lit("customer").alias("origin"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("origin"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True).where("balance > 9000").orderBy(F.col("balance").desc(), "name")


def _budget_sql(budget: str) -> str:
    return f"""SELECT doc, n FROM (SELECT doc, n, row_number() OVER w AS k, max(CASE WHEN run > {budget} THEN 1 ELSE 0 END) OVER w AS over FROM
    (SELECT doc, n, sum(n) OVER (ORDER BY n DESC, doc) AS run FROM b) y WINDOW w AS (ORDER BY n DESC, doc)) z WHERE over = 0 OR k = 1"""


_B = "b AS (SELECT doc, count(*) AS n FROM seq GROUP BY doc)"


@query(f"WITH {SEQ}, {_B} {_budget_sql('3000')}")
def t4_budget_prefix(spark, d):
    b = sequence(spark, d).groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    return planning.budget_prefix(b, "n", [-F.col("n"), "doc"], 3000).select("doc", "n")


@query(f"WITH {SEQ}, {_B} {_budget_sql('(5000 - 1200)')}")
def t5_headroom(spark, d):
    b = sequence(spark, d).groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    return planning.budget_prefix(b, "n", [-F.col("n"), "doc"], 5000 - 1200).select("doc", "n")


@query(f"""WITH {PRED}, b AS (SELECT slug, count(*) AS n FROM pr GROUP BY slug) SELECT slug, CAST(row_number() OVER (ORDER BY CAST(regexp_extract(slug, '([0-9]+)', 1) AS BIGINT), slug) AS INTEGER) AS by_number,
CAST(row_number() OVER (ORDER BY slug) AS INTEGER) AS by_slug, CAST(row_number() OVER (ORDER BY n DESC, slug) AS INTEGER) AS by_count FROM b""")
def t6_order_modes(spark, d):
    b = predictions(spark, d).groupBy("slug").agg(F.count(F.lit(1)).alias("n"))
    for mode, name in (("numeric", "by_number"), ("slug", "by_slug"), ("count", "by_count")):
        b = ranges.rank(b, planning.order_key(mode), name)
    return b.drop("n")


@query(f"WITH {SEQ} SELECT doc, idx FROM seq WHERE idx < 10")
def t7_first_n(spark, d):
    return planning.top_k(sequence(spark, d), 10, ["doc"], ["idx"]).select("doc", "idx")


_SETS = f"{SEQ}, a AS (SELECT doc, idx FROM seq WHERE pred), b AS (SELECT doc, idx FROM seq WHERE gold)"


@query(f"WITH {_SETS} SELECT 'both' AS part, doc, idx FROM (SELECT * FROM a INTERSECT SELECT * FROM b) x UNION ALL SELECT 'only_pred', doc, idx FROM (SELECT * FROM a EXCEPT SELECT * FROM b) y UNION ALL SELECT 'all', doc, idx FROM (SELECT * FROM a UNION ALL SELECT * FROM b) z")
def t8_set_operations(spark, d):
    x = sequence(spark, d)
    a, b = x.where("pred").select("doc", "idx"), x.where("gold").select("doc", "idx")
    return metrics.union_all([p.select(F.lit(n).alias("part"), "doc", "idx") for n, p in (("both", a.intersect(b)), ("only_pred", a.subtract(b)), ("all", a.unionAll(b)))])


@query(f"WITH {PRED} SELECT slug, bool_and(label IS NOT NULL) AS complete, bool_and(CASE WHEN idx < 5 THEN parse_ok END) AS head_ok FROM pr GROUP BY slug")
def t9_completeness(spark, d):
    return predictions(spark, d).groupBy("slug").agg(F.bool_and(F.col("label").isNotNull()).alias("complete"), F.bool_and(F.when(F.col("idx") < 5, F.col("parse_ok"))).alias("head_ok"))


@query(f"WITH {SEQ}, {_F3}, b AS (SELECT max(coalesce(f1, 0)) AS best FROM s) SELECT 'stop' AS action, CAST(NULL AS INTEGER) AS \"window\" FROM b WHERE best >= 0.76 UNION ALL SELECT 'run', w FROM b, (VALUES (32), (64)) v(w) WHERE best < 0.76")
def p15_improvement_gate(spark, d):
    return planning.improvement_gate(metrics.with_prf(metrics.tolerant(sequence(spark, d), (3,))))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 5 WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS epochs, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'base' END AS model, p_size % 4 = 0 AS debug,
CASE WHEN p_size % 3 = 0 THEN '/d' ELSE 'data' END AS data_dir, CASE WHEN p_size % 10 = 0 THEN 7 WHEN p_size % 4 = 0 THEN 20 ELSE 0 END AS eval_preflight_rows, CASE WHEN p_size % 5 = 0 THEN 256 ELSE 96 END AS eval_max_new_tokens FROM part""")
def j12_config_precedence(spark, d):
    """Defaults under a file, an environment whose empty values don't count, and a job's metadata."""
    size = F.col("p_size")
    file = F.struct(F.lit(2).alias("epochs"), F.col("p_brand").alias("model"), (size % 4 == 0).alias("debug"), F.when(size % 10 == 0, 7).alias("eval_preflight_rows"))
    x = table(spark, d, "part").select(
        "p_partkey",
        F.when(size % 2 == 0, F.to_json(file)).alias("file"),
        F.when(size % 3 == 0, F.create_map(F.lit("DATA_DIR"), F.lit("/d"), F.lit("MODEL"), F.lit(""))).alias("environment"),
        F.when(size % 5 == 0, F.lit('{"epochs": 5, "target_format": "cot_list"}')).alias("job"),
    )
    return planning.settings(x, {"epochs": 1, "model": "base", "debug": False, "data_dir": "data"}, "file", "environment", "job").drop("file", "environment", "job")
