"""Queries: ordered context (C, W) and thinning (P)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics, planning, thinning
from ..operators import windows as W
from .base import PRED, SAMPLE, SENT, SEQ, predictions, sample, sentences, sequence, table
from .registry import query

_CONV = "conv AS (SELECT conv_id AS doc, CAST(turn AS INTEGER) AS idx, text FROM conversations)"


def _conv(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("idx"), "text")


def _joined(a: str, c: str = "text", sep: str = " ") -> str:
    return f"coalesce(array_to_string(list({c}) OVER (PARTITION BY doc ORDER BY idx ROWS BETWEEN {a}), '{sep}'), '')"


@query(f"""WITH {_CONV} SELECT doc, idx, concat_ws(' ', nullif({_joined('2 PRECEDING AND 1 PRECEDING')}, ''), '<sentence>' || text || '</sentence>', nullif({_joined('1 FOLLOWING AND 2 FOLLOWING')}, '')) AS context FROM conv""")
def c1_tagged_context(spark, d):
    return W.tagged_context(_conv(spark, d), 2).select("doc", "idx", "context")


@query(f"""WITH {_CONV} SELECT doc, idx, {_joined('3 PRECEDING AND 1 PRECEDING', sep='|')} AS left_context, {_joined('1 FOLLOWING AND 3 FOLLOWING', sep='|')} AS right_context FROM conv""")
def c2_context_lists(spark, d):
    x = W.context(_conv(spark, d), 3)
    return x.select("doc", "idx", F.array_join("left", "|").alias("left_context"), F.array_join("right", "|").alias("right_context"))


# a fold over the turns: who is open, whose turn it is, what the next neighbour costs, whether it fits
_LEFT = "(st.lo AND st.l < len(ls) AND (i % 2 = 0 OR NOT (st.ro AND st.r < len(rs))))"
_RIGHT = f"(NOT {_LEFT} AND st.ro AND st.r < len(rs))"
_PRICE = f"(CASE WHEN {_LEFT} THEN ls[st.l + 1] WHEN {_RIGHT} THEN rs[st.r + 1] ELSE 0 END)"
_FITS = f"(st.used + {_PRICE} <= 40)"
_TURN = f"""{{'l': st.l + CASE WHEN {_LEFT} AND {_FITS} THEN 1 ELSE 0 END, 'r': st.r + CASE WHEN {_RIGHT} AND {_FITS} THEN 1 ELSE 0 END, 'used': st.used + CASE WHEN {_FITS} THEN {_PRICE} ELSE 0 END,
'lo': st.lo AND (NOT {_LEFT} OR {_FITS}), 'ro': st.ro AND (NOT {_RIGHT} OR {_FITS})}}"""


@query(rf"""WITH {SENT}, n AS (SELECT doc_id AS doc, idx, CAST(greatest(1, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) AS BIGINT) AS n FROM sent),
c AS (SELECT doc, idx, coalesce(list_reverse(list(n) OVER (PARTITION BY doc ORDER BY idx ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)), []) AS ls, coalesce(list(n) OVER (PARTITION BY doc ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 40 FOLLOWING), []) AS rs FROM n),
z AS (SELECT doc, idx, list_reduce(range(0, len(ls) + len(rs) + 4), lambda st, i: {_TURN}, {{'l': CAST(0 AS BIGINT), 'r': CAST(0 AS BIGINT), 'used': CAST(0 AS HUGEINT), 'lo': TRUE, 'ro': TRUE}}) AS s FROM c)
SELECT doc, idx, CAST(s.l AS INTEGER) AS n_left, CAST(s.r AS INTEGER) AS n_right, CAST(s.used AS INTEGER) AS words_used FROM z""")
def c3_token_budget(spark, d):
    x = sentences(spark, d).withColumnRenamed("doc_id", "doc")
    return W.token_budget(x, 40).select("doc", "idx", "n_left", "n_right", "words_used")


_C4 = f"""WITH {_CONV}, c AS (SELECT doc, idx, text, row_number() OVER w - 1 AS l, count(*) OVER (PARTITION BY doc) - row_number() OVER w AS r FROM conv WINDOW w AS (PARTITION BY doc ORDER BY idx)),
t AS (SELECT *, least(l, greatest(3, 5 - r)) AS nl FROM c) SELECT doc, idx, CAST(nl AS INTEGER) AS n_left, CAST(least(r, 5 - nl) AS INTEGER) AS n_right FROM t"""


@query(_C4)
def c4_neighbour_budget(spark, d):
    x = W.neighbour_budget(_conv(spark, d), 5)
    return x.select("doc", "idx", F.size("left").alias("n_left"), F.size("right").alias("n_right"))


@query(f"""WITH {_CONV} SELECT doc, idx, 'sentence' AS mode, {_joined('2 PRECEDING AND 1 PRECEDING')} AS left_context FROM conv UNION ALL SELECT doc, idx, 'window', {_joined('3 PRECEDING AND 1 PRECEDING')} FROM conv""")
def c5_context_modes(spark, d):
    window = 3
    parts = [W.context(_conv(spark, d), k).select("doc", "idx", F.lit(m).alias("mode"), F.array_join("left", " ").alias("left_context")) for m, k in (("sentence", window - 1), ("window", window))]
    return metrics.union_all(parts)


@query(f"""WITH {_CONV}, c AS (SELECT doc, idx, list(text) OVER (PARTITION BY doc ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS a, row_number() OVER (PARTITION BY doc ORDER BY idx) - 1 AS p FROM conv)
SELECT doc, idx, array_to_string(list_transform(a, lambda s, i: CAST(i AS VARCHAR) || '. ' || s), chr(10)) AS chunk, CAST(least(p, 2) + 1 AS INTEGER) AS target_local_id, CAST(len(a) AS INTEGER) AS chunk_len FROM c""")
def c6_numbered_chunk(spark, d):
    return W.numbered_chunk(_conv(spark, d), 2).select("doc", "idx", "chunk", F.col("target_local_id").cast("int").alias("target_local_id"), "chunk_len")


@query(f"""WITH {_CONV}, r AS (SELECT doc, idx, concat_ws(' ', nullif({_joined('1 PRECEDING AND 1 PRECEDING')}, ''), '<sentence>' || text || '</sentence>', nullif({_joined('1 FOLLOWING AND 1 FOLLOWING')}, '')) AS context FROM conv)
SELECT CAST(doc AS VARCHAR) || ':' || CAST(idx AS VARCHAR) AS key, 'Label: ' || context AS prompt FROM r WHERE doc % 2 = 0""")
def c7_requests(spark, d):
    x = W.tagged_context(_conv(spark, d), 1)
    keys = table(spark, d, "conversations").where("conv_id % 2 = 0").select(F.col("conv_id").alias("doc")).distinct()
    x = x.join(keys, "doc", "left_semi")
    return x.select(F.concat_ws(":", F.col("doc").cast("string"), F.col("idx").cast("string")).alias("key"), F.concat(F.lit("Label: "), "context").alias("prompt"))


_C8 = f"""WITH {SEQ}, s AS (SELECT doc, idx, sum(CAST(gold AS INTEGER)) OVER (PARTITION BY doc ORDER BY idx) AS scene, count(*) OVER (PARTITION BY doc) AS total FROM seq),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, scene ORDER BY idx) - 1 AS rn, count(*) OVER (PARTITION BY doc, scene) AS n FROM s)
SELECT doc, scene, idx, CASE WHEN rn = 0 THEN 'first' ELSE 'middle' END AS kind FROM r
WHERE (rn = 0 AND idx >= 2) OR (rn > 0 AND n - 1 >= 3 AND rn - 1 = (n - 1) // 2 AND total - idx - 1 >= 2)"""


@query(_C8)
def c8_few_shot(spark, d):
    x = sequence(spark, d).withColumn("scene", W.running_scene("gold"))
    w = Window.partitionBy("doc", "scene")
    x = x.withColumn("rn", F.row_number().over(w.orderBy("idx")) - 1).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("doc")))
    first = (F.col("rn") == 0) & (F.col("idx") >= 2)
    middle = (F.col("rn") > 0) & (F.col("n") - 1 >= 3) & (F.col("rn") - 1 == F.floor((F.col("n") - 1) / 2)) & (F.col("total") - F.col("idx") - 1 >= 2)
    return x.where(first | middle).select("doc", "scene", "idx", F.when(F.col("rn") == 0, "first").otherwise("middle").alias("kind"))


@query(f"""WITH {SEQ}, u AS (SELECT * FROM seq WHERE k % 5 <> 0) SELECT doc, idx, event_type, coalesce(lag(event_type) OVER (PARTITION BY doc ORDER BY idx) <> event_type, TRUE) AS changed FROM u""")
def w1_scene_changed(spark, d):
    x = sequence(spark, d).where("k % 5 <> 0")
    return x.select("doc", "idx", "event_type", W.changed("event_type").alias("changed"))


@query(f"WITH {SEQ} SELECT doc, idx, gold OR idx = 0 AS opened FROM seq")
def w2_opening_border(spark, d):
    return sequence(spark, d).select("doc", "idx", W.opened("gold").alias("opened"))


@query(f"WITH {SEQ} SELECT doc, idx, CAST(sum(CAST(gold OR idx = 0 AS INTEGER)) OVER (PARTITION BY doc ORDER BY idx) AS BIGINT) AS scene_id FROM seq")
def w3_scene_id(spark, d):
    x = sequence(spark, d).withColumn("o", W.opened("gold"))
    return x.select("doc", "idx", W.running_scene("o").alias("scene_id"))


_SCENE = f"{SEQ}, sc AS (SELECT *, sum(CAST(pred AS INTEGER)) OVER (PARTITION BY doc ORDER BY idx) AS scene FROM seq), sl AS (SELECT *, count(*) OVER (PARTITION BY doc, scene) AS scene_len FROM sc)"


@query(f"WITH {_SCENE} SELECT doc, idx, scene_len FROM sl")
def w4_segment_len(spark, d):
    return W.segment_lengths(sequence(spark, d), "pred").select("doc", "idx", "scene_len")


_W5 = """SELECT doc, idx AS seq, CAST(greatest(1, idx - lag(idx, 1, -1) OVER (PARTITION BY doc ORDER BY idx)) AS BIGINT) AS scene_len FROM seq WHERE pred
UNION ALL SELECT doc, n AS seq, n - last - 1 AS scene_len FROM (SELECT doc, CAST(count(*) AS INTEGER) AS n, coalesce(max(CASE WHEN pred THEN idx END), -1) AS last FROM seq GROUP BY doc) x WHERE n - last - 1 > 0"""


@query(f"WITH {SEQ} {_W5}")
def w5_border_terminated_len(spark, d):
    return W.border_terminated_lengths(sequence(spark, d), "pred")


@query(f"""WITH {_SCENE} SELECT doc, idx, pred AND (coalesce(lag(pred) OVER w, FALSE) OR coalesce(lead(pred) OVER w, FALSE)) AS merge_candidate, NOT pred AND scene_len >= 10 AS split_candidate,
(pred AND (coalesce(lag(pred) OVER w, FALSE) OR coalesce(lead(pred) OVER w, FALSE))) OR (NOT pred AND scene_len >= 10) AS review_flag FROM sl WINDOW w AS (PARTITION BY doc ORDER BY idx)""")
def w6_review_candidates(spark, d):
    return W.candidates(sequence(spark, d), "pred").select("doc", "idx", "merge_candidate", "split_candidate", "review_flag")


@query(f"""WITH {SEQ}, b AS (SELECT doc, idx AS b, lead(idx) OVER (PARTITION BY doc ORDER BY idx) AS nx FROM seq WHERE pred)
SELECT doc, count(*) AS pairs, array_to_string(list_slice(list(b ORDER BY b), 1, 5), ',') AS examples FROM b WHERE nx = b + 1 GROUP BY doc""")
def w7_consecutive_pairs(spark, d):
    return W.consecutive_pairs(sequence(spark, d), "pred").withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


@query(f"""WITH {SEQ}, g AS (SELECT doc, idx, idx - row_number() OVER (PARTITION BY doc ORDER BY idx) AS g FROM seq WHERE pred), r AS (SELECT doc, count(*) AS n, min(idx) AS s FROM g GROUP BY doc, g)
SELECT doc, n AS run_len, s AS run_start FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, s) AS k FROM r) x WHERE k = 1""")
def w8_longest_run(spark, d):
    return W.longest_run(sequence(spark, d), "pred")


@query(f"WITH {SEQ}, b AS (SELECT doc, lead(idx) OVER (PARTITION BY doc ORDER BY idx) - idx AS g FROM seq WHERE pred) SELECT doc, count(*) FILTER (WHERE g >= 4) AS gaps FROM b GROUP BY doc")
def w9_wide_gaps(spark, d):
    return W.wide_gaps(sequence(spark, d), "pred", 4)


@query(f"""WITH {SEQ}, b AS (SELECT doc, idx - lag(idx) OVER (PARTITION BY doc ORDER BY idx) AS g FROM seq WHERE gold), a AS (SELECT doc, avg(g) AS avg_gap, min(g) AS min_gap, max(g) AS max_gap FROM b GROUP BY doc),
n AS (SELECT doc, count(*) FILTER (WHERE gold) / count(*) AS border_rate FROM seq GROUP BY doc) SELECT n.doc, avg_gap, min_gap, max_gap, border_rate FROM n LEFT JOIN a ON n.doc = a.doc""")
def w10_gap_stats(spark, d):
    return W.gap_stats(sequence(spark, d), "gold")


@query(f"""WITH {SAMPLE} SELECT a.doc, a.idx, p.event_type AS prev_label, n.event_type AS next_label FROM sam a LEFT JOIN sam p ON p.doc = a.doc AND p.idx = a.idx - 1 AND p.k % 3 <> 0 LEFT JOIN sam n ON n.doc = a.doc AND n.idx = a.idx + 1 AND n.k % 3 <> 0""")
def w11_label_at_offset(spark, d):
    x = sample(spark, d).withColumn("ok", F.col("k") % 3 != 0)
    return x.select("doc", "idx", W.label_at_offset("event_type", -1, "ok").alias("prev_label"), W.label_at_offset("event_type", 1, "ok").alias("next_label"))


_NEAR = """last_value(CASE WHEN ok THEN {0} END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY idx RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING)"""
_NEXT = """first_value(CASE WHEN ok THEN {0} END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY idx RANGE BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"""


@query(f"""WITH {SAMPLE}, o AS (SELECT *, k % 3 <> 0 AS ok FROM sam) SELECT doc, idx, {_NEAR.format('event_type')} AS prev_label, idx - {_NEAR.format('idx')} AS prev_dist, {_NEXT.format('event_type')} AS next_label, {_NEXT.format('idx')} - idx AS next_dist FROM o""")
def w12_nearest_valid(spark, d):
    x = sample(spark, d).withColumn("ok", F.col("k") % 3 != 0)
    return W.nearest_valid(x, "event_type", "ok").select("doc", "idx", "prev_label", "prev_dist", "next_label", "next_dist")


_DIST = "least(idx - last_value(CASE WHEN gold THEN idx END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY idx ROWS UNBOUNDED PRECEDING), first_value(CASE WHEN gold THEN idx END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - idx)"


@query(f"WITH {SEQ} SELECT doc, idx, {_DIST} AS distance FROM seq")
def w13_border_distance(spark, d):
    return sequence(spark, d).select("doc", "idx", W.distance_to("gold").alias("distance"))


@query(f"WITH {SEQ} SELECT doc, idx, lag(idx) OVER w AS prev_idx, lag(gold) OVER w AS prev_gold, lag(pred) OVER w AS prev_pred, lead(idx) OVER w AS next_idx, lead(gold) OVER w AS next_gold, lead(pred) OVER w AS next_pred FROM seq WINDOW w AS (PARTITION BY doc ORDER BY idx)")
def w14_prev_next_rows(spark, d):
    w = W.by_doc()
    row = F.struct("idx", "gold", "pred")
    x = sequence(spark, d).withColumn("p", F.lag(row).over(w)).withColumn("n", F.lead(row).over(w))
    return x.select("doc", "idx", *[F.col(f"{s}.{c}").alias(f"{name}_{c}") for s, name in (("p", "prev"), ("n", "next")) for c in ("idx", "gold", "pred")])


@query(f"""WITH {SAMPLE} SELECT doc, idx, (pred AND NOT gold) AND (coalesce(bool_or(gold) OVER (PARTITION BY doc ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), FALSE)
OR coalesce(bool_or(gold) OVER (PARTITION BY doc ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), FALSE)) AS near FROM sam""")
def w15_opposite_near(spark, d):
    x = sample(spark, d).withColumn("fp", F.col("pred") & ~F.col("gold"))
    return W.opposite_near(x, "fp", "gold", 2).select("doc", "idx", "near")


# -- thinning ----------------------------------------------------------------------------------------------


def fold_sql(rows: str, gap: int) -> str:
    """Kept border positions of each doc of ``rows`` (doc, pos, pred): the greedy fold over one-element lists."""
    return f"""SELECT doc, unnest(list_reduce(list_transform(list(pos ORDER BY pos) FILTER (WHERE pred), lambda v: [v]), lambda acc, v: CASE WHEN v[1] - acc[len(acc)] >= {gap} THEN list_concat(acc, v) ELSE acc END)) AS pos
FROM {rows} GROUP BY doc HAVING count(*) FILTER (WHERE pred) > 0"""


def _kept(df):
    return df.select("doc", "idx", "pred")


@query(f"WITH {SEQ}, r AS (SELECT doc, idx AS pos, pred FROM seq), f AS ({fold_sql('r', 3)}) SELECT r.doc, r.pos AS idx, f.pos IS NOT NULL AS pred FROM r LEFT JOIN f ON r.doc = f.doc AND r.pos = f.pos")
def p1_min_gap(spark, d):
    return _kept(thinning.min_gap(sequence(spark, d), 3))


_RUN = "SELECT doc, idx, gold, conf, pred, pos - row_number() OVER (PARTITION BY doc, pred ORDER BY pos) AS run, pos FROM {0}"


@query(f"WITH {SEQ}, g AS ({_RUN.format('(SELECT *, idx AS pos FROM seq) q')}) SELECT doc, idx, pred AND row_number() OVER (PARTITION BY doc, pred, run ORDER BY pos) % 2 = 1 AS pred FROM g")
def p2_burst_collapse(spark, d):
    return _kept(thinning.burst_collapse(sequence(spark, d)))


_CLUSTER = """c1 AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY doc, pred ORDER BY idx) <= 3 THEN 0 ELSE 1 END AS is_new FROM seq),
c2 AS (SELECT *, sum(is_new) OVER (PARTITION BY doc, pred ORDER BY idx ROWS UNBOUNDED PRECEDING) AS cl FROM c1),
c3 AS (SELECT doc, idx, gold, conf, pred AND row_number() OVER (PARTITION BY doc, pred, cl ORDER BY conf DESC NULLS LAST, idx) = 1 AS pred FROM c2)"""


@query(f"WITH {SEQ}, {_CLUSTER} SELECT doc, idx, pred FROM c3")
def p3_cluster_merge(spark, d):
    return _kept(thinning.cluster_merge(sequence(spark, d), 3))


@query(f"WITH {SEQ} SELECT doc, idx, pred AND NOT coalesce(conf < 0.5, FALSE) AS pred FROM seq")
def p4_confidence_threshold(spark, d):
    return _kept(thinning.confidence_threshold(sequence(spark, d), 0.5))


@query(f"WITH {SEQ} SELECT doc, idx, pred AND row_number() OVER (PARTITION BY doc, idx // 5, pred ORDER BY idx) <= 1 AS pred FROM seq")
def p5_n_per_k(spark, d):
    return _kept(thinning.n_per_k(sequence(spark, d), 5))


_DE_START = r"(?i)^(?:am\s+n[aäÄ]chsten\s+(?:tag|morgen|abend|mittag)|unterdessen|inzwischen|meanwhile|sp[aäÄ]ter|einige\s+(?:tage|wochen|monate|jahre)\s+(?:sp[aäÄ]ter|danach)|darauf|als\s+(?:es\s+)?(?:morgen|abend|nacht)\s+wurde)"
_EDGE, _END = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
_DE_CONT = rf"(?i)^(?:er|sie|es|ihm|ihr|ihnen|sein|der|die|das|dem|den|des|und|aber|doch|denn|also|deshalb|darum|daher|dann|noch|auch|nur){_END}"
_DE_TIME = rf"(?i){_EDGE}(?:dann|darauf|sp[aäÄ]ter|pl[oöÖ]tzlich|bald|nun|jetzt|sofort|w[aäÄ]hrend|am\s+(?:morgen|abend|tag|nachmittag)|des\s+(?:andern|n[aäÄ]chsten)\s+(?:tages|morgens)){_END}"


def _german(spark, d):
    x = sentences(spark, d).where("lang = 'de'")
    return x.select(F.col("doc_id").alias("doc"), "idx", "text", (F.length("text") % 3 == 0).alias("pred"))


_DE = f"{SENT}, de AS (SELECT doc_id AS doc, idx, text, length(text) % 3 = 0 AS pred, coalesce(lead(text) OVER (PARTITION BY doc_id ORDER BY idx), '') AS nx FROM sent WHERE lang = 'de')"


@query(f"""WITH {_DE} SELECT doc, idx, pred AND (regexp_matches(trim(text), '{_DE_START}') OR nx = '' OR regexp_matches(text, '{_DE_TIME}') OR regexp_matches(nx, '{_DE_TIME}') OR NOT regexp_matches(trim(nx), '{_DE_CONT}')) AS pred FROM de""")
def p6_discourse(spark, d):
    return _kept(thinning.discourse(_german(spark, d)))


_P7 = f"""WITH {SEQ}, {_CLUSTER}, m AS (SELECT doc, idx AS pos, pred FROM c3), f AS ({fold_sql('m', 3)}), t AS (SELECT doc, idx AS pos, pred AND NOT coalesce(conf < 0.85, FALSE) AS pred FROM seq), ft AS ({fold_sql('t', 3)})
SELECT 'cluster_merge_plus_min_scene_len_3' AS scenario, doc, pos AS idx FROM f UNION ALL SELECT 'confidence_threshold_plus_min_scene_len_3', doc, pos FROM ft"""


@query(_P7)
def p7_scenario(spark, d):
    x = sequence(spark, d)
    names = ("cluster_merge_plus_min_scene_len_3", "confidence_threshold_plus_min_scene_len_3")
    return thinning.sweep(x, names).where("pred").select("scenario", "doc", "idx")


def tolerant_sql(rows: str, tols=(0, 1, 3), key: str = "") -> str:
    """doc, tol, tp, fp, fn of ``rows`` (doc, idx, pred, gold)."""
    k = f"{key}, " if key else ""
    parts = [
        f"""SELECT {k}doc, {t} AS tol, count(*) FILTER (WHERE gold AND np) AS tp, count(*) FILTER (WHERE pred AND NOT ng) AS fp, count(*) FILTER (WHERE gold AND NOT np) AS fn FROM (
    SELECT {k}doc, pred, gold, bool_or(pred) OVER w AS np, bool_or(gold) OVER w AS ng FROM {rows} WINDOW w AS (PARTITION BY {k}doc ORDER BY idx RANGE BETWEEN {t} PRECEDING AND {t} FOLLOWING)) z GROUP BY {k}doc"""
        for t in tols
    ]
    return " UNION ALL ".join(parts)


_SWEEP = ("none", "min_scene_len_3", "burst_collapse", "cluster_merge", "confidence_threshold", "n_per_k")
_SWEEP_SQL = f"""{SEQ}, {_CLUSTER}, r0 AS (SELECT doc, idx AS pos, pred FROM seq), f3 AS ({fold_sql('r0', 3)}), g AS ({_RUN.format('(SELECT *, idx AS pos FROM seq) q')}),
sw AS (SELECT 'none' AS scenario, doc, idx, gold, pred FROM seq
UNION ALL SELECT 'min_scene_len_3', s.doc, s.idx, s.gold, f3.pos IS NOT NULL FROM seq s LEFT JOIN f3 ON s.doc = f3.doc AND s.idx = f3.pos
UNION ALL SELECT 'burst_collapse', doc, idx, gold, pred AND row_number() OVER (PARTITION BY doc, pred, run ORDER BY pos) % 2 = 1 FROM g
UNION ALL SELECT 'cluster_merge', doc, idx, gold, pred FROM c3
UNION ALL SELECT 'confidence_threshold', doc, idx, gold, pred AND NOT coalesce(conf < 0.85, FALSE) FROM seq
UNION ALL SELECT 'n_per_k', doc, idx, gold, pred AND row_number() OVER (PARTITION BY doc, idx // 15, pred ORDER BY idx) <= 1 FROM seq)"""


@query(f"WITH {_SWEEP_SQL}, t AS ({tolerant_sql('sw', key='scenario')}) SELECT scenario, tol, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM t GROUP BY scenario, tol")
def p8_scenario_sweep(spark, d):
    t = metrics.tolerant_flags(*thinning.sweep_flags(sequence(spark, d), _SWEEP), (0, 1, 3)).withColumnRenamed("name", "scenario")
    return t.groupBy("scenario", "tol").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


_GAPS = "".join(f", m{g} AS ({fold_sql('r0', g)})" for g in (2, 3, 4))
_GAP_ROWS = " UNION ALL ".join(f"SELECT {g} AS gap, s.doc, s.idx, s.gold, m{g}.pos IS NOT NULL AS pred FROM seq s LEFT JOIN m{g} ON s.doc = m{g}.doc AND s.idx = m{g}.pos" for g in (2, 3, 4))
_F1 = "CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))) ELSE 0.0 END"


@query(f"""WITH {SEQ}, r0 AS (SELECT doc, idx AS pos, pred FROM seq){_GAPS}, rows_ AS ({_GAP_ROWS}), t AS ({tolerant_sql('rows_', (3,), 'gap')}), s AS (SELECT gap, doc, {_F1} AS f1 FROM t)
SELECT doc, gap, f1 FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY f1 DESC, gap) AS k FROM s) x WHERE k = 1""")
def p9_best_gap(spark, d):
    x = sequence(spark, d)
    swept = thinning.sweep_flags(x, [f"min_scene_len_{g}" for g in (2, 3, 4)])
    gap = F.split_part("name", F.lit("_"), F.lit(-1)).cast("int")
    scores = metrics.with_prf(metrics.tolerant_flags(*swept, (3,))).select(gap.alias("gap"), "doc", "f1")
    return planning.best_gap(scores)


@query(f"WITH {SEQ} SELECT doc, idx, pred AND NOT (k % 4 = 0) AS pred FROM seq")
def p10_verifier_demotion(spark, d):
    x = sequence(spark, d)
    decisions = x.where("pred and k % 3 <> 1 or k % 4 = 0").select("doc", "idx", F.when(F.col("k") % 4 == 0, False).when(F.col("k") % 3 == 0, True).alias("keep"))
    return _kept(thinning.verifier_demotion(x, decisions))


@query(f"WITH {SEQ} SELECT doc, idx, conf FROM seq WHERE pred AND (conf IS NULL OR conf < 0.6)")
def p11_to_verify(spark, d):
    return thinning.to_verify(sequence(spark, d), 0.6).select("doc", "idx", "conf")


# -- patching ----------------------------------------------------------------------------------------------

RANK = {"high": 3, "medium": 2, "low": 1}


def patch_plans(pred, overrides=None):
    """(key, slug, idx, label, confidence, method): a plan for each unparsed row; manual overrides win.

    The cascade is one CASE over neighbours by exact index, the nearest within five, and the prose's end.
    """
    from ..functions.responses import prose_tail_label

    ok = F.col("parse_ok") & F.col("label").isin("BORDER", "NOBORDER")
    x = pred.withColumn("_ok", ok)
    x = x.withColumn("p1", W.label_at_offset("label", -1, "_ok", "slug")).withColumn("n1", W.label_at_offset("label", 1, "_ok", "slug"))
    x = W.nearest_valid(x, "label", "_ok", 5, "slug").where("not parse_ok").withColumn("tail", prose_tail_label("raw"))
    plan = lambda label, conf, method: F.struct(label.alias("label"), F.lit(conf).alias("confidence"), F.lit(method).alias("method"))
    p1, n1, no = F.col("p1"), F.col("n1"), F.lit("NOBORDER")
    x = x.withColumn(
        "plan",
        F.when(F.col("tail").isNotNull(), plan(F.col("tail"), "high", "thinking_prose_tail"))
        .when(p1 == n1, plan(p1, "high", "neighbor_agreement"))
        .when(F.col("prev_label") == F.col("next_label"), plan(F.col("prev_label"), "medium", "wide_neighbor_agreement"))
        .when((p1 == "BORDER") & ~n1.eqNullSafe("BORDER"), plan(no, "medium", "after_border_continuation"))
        .when((n1 == "BORDER") & ~p1.eqNullSafe("BORDER"), plan(no, "medium", "before_border_continuation"))
        .when(p1.isNotNull() & n1.isNull(), plan(p1, "medium", "prev_only"))
        .when(n1.isNotNull() & p1.isNull(), plan(n1, "medium", "next_only"))
        .otherwise(plan(no, "low", "default_noborder")),
    )
    x = x.select("key", "slug", "idx", "plan.*")
    if overrides is None:
        return x
    x = x.join(overrides.select("key", F.col("label").alias("_o")), "key", "left")
    given = F.col("_o").isNotNull()
    return x.select(
        "key", "slug", "idx", F.coalesce("_o", "label").alias("label"), F.when(given, "high").otherwise(F.col("confidence")).alias("confidence"), F.when(given, "manual_override").otherwise(F.col("method")).alias("method")
    )


def _overrides(spark, d):
    return predictions(spark, d).where("event_id % 121 = 0").select("key", F.lit("BORDER").alias("label"))


_OK = "parse_ok AND label IN ('BORDER', 'NOBORDER')"
_TAIL = """CASE WHEN contains(right(p.raw, 500), 'NOBORDER') AND NOT contains(replace(right(p.raw, 500), 'NOBORDER', ''), 'BORDER') THEN 'NOBORDER'
WHEN ends_with(rtrim(right(p.raw, 500)), 'NOBORDER') OR contains(right(p.raw, 500), 'answer NOBORDER') THEN 'NOBORDER' WHEN contains(right(right(p.raw, 500), 120), 'BORDER') THEN 'BORDER' END"""
_SUGGEST = f"""{PRED}, nb AS (SELECT p.*, {_TAIL} AS tail, a.label AS p1, b.label AS n1,
    (SELECT max_by(q.label, q.idx) FROM pr q WHERE q.slug = p.slug AND q.idx BETWEEN p.idx - 5 AND p.idx - 1 AND q.parse_ok) AS pw,
    (SELECT min_by(q.label, q.idx) FROM pr q WHERE q.slug = p.slug AND q.idx BETWEEN p.idx + 1 AND p.idx + 5 AND q.parse_ok) AS nw
    FROM pr p LEFT JOIN pr a ON a.slug = p.slug AND a.idx = p.idx - 1 AND a.parse_ok LEFT JOIN pr b ON b.slug = p.slug AND b.idx = p.idx + 1 AND b.parse_ok WHERE NOT p.parse_ok),
plans AS (SELECT key, slug, idx, event_id, CASE WHEN tail IS NOT NULL THEN {{'l': tail, 'c': 'high', 'm': 'thinking_prose_tail'}}
    WHEN p1 = n1 THEN {{'l': p1, 'c': 'high', 'm': 'neighbor_agreement'}} WHEN pw = nw THEN {{'l': pw, 'c': 'medium', 'm': 'wide_neighbor_agreement'}}
    WHEN p1 = 'BORDER' AND coalesce(n1, '') <> 'BORDER' THEN {{'l': 'NOBORDER', 'c': 'medium', 'm': 'after_border_continuation'}}
    WHEN n1 = 'BORDER' AND coalesce(p1, '') <> 'BORDER' THEN {{'l': 'NOBORDER', 'c': 'medium', 'm': 'before_border_continuation'}}
    WHEN p1 IS NOT NULL AND n1 IS NULL THEN {{'l': p1, 'c': 'medium', 'm': 'prev_only'}} WHEN n1 IS NOT NULL AND p1 IS NULL THEN {{'l': n1, 'c': 'medium', 'm': 'next_only'}}
    ELSE {{'l': 'NOBORDER', 'c': 'low', 'm': 'default_noborder'}} END AS z FROM nb),
plan AS (SELECT key, slug, idx, CASE WHEN event_id % 121 = 0 THEN 'BORDER' ELSE z.l END AS label, CASE WHEN event_id % 121 = 0 THEN 'high' ELSE z.c END AS confidence, CASE WHEN event_id % 121 = 0 THEN 'manual_override' ELSE z.m END AS method FROM plans)"""


@query(f"WITH {_SUGGEST} SELECT key, slug, idx, label, confidence, method FROM plan")
def p12_patch_cascade(spark, d):
    return patch_plans(predictions(spark, d), _overrides(spark, d))


def patched(pred, plans, least: str = "medium"):
    """``pred`` with the labels of plans of at least this confidence; (.., parse_ok, label, manual_fix)."""
    sure = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    chosen = plans.where(sure >= RANK[least]).select("key", F.col("label").alias("_l"), F.col("method").alias("manual_fix"))
    x = pred.join(chosen, "key", "left")
    return x.withColumn("label", F.coalesce("_l", "label")).withColumn("parse_ok", F.col("parse_ok") | F.col("_l").isNotNull()).drop("_l")


@query(f"""WITH {_SUGGEST} SELECT pr.key, pr.parse_ok OR z.key IS NOT NULL AS parse_ok, coalesce(z.label, pr.label) AS label, z.method AS manual_fix FROM pr LEFT JOIN (SELECT * FROM plan WHERE confidence IN ('high', 'medium')) z ON pr.key = z.key""")
def p13_apply_patches(spark, d):
    x = predictions(spark, d)
    return patched(x, patch_plans(x, _overrides(spark, d))).select("key", "parse_ok", "label", "manual_fix")


@query(f"WITH {_SWEEP_SQL}, t AS ({tolerant_sql('sw', (0, 1, 3, 5), 'scenario')}) SELECT scenario, tol, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM t WHERE scenario IN ('none', 'min_scene_len_3', 'burst_collapse') GROUP BY scenario, tol")
def p14_what_if(spark, d):
    swept = thinning.sweep_flags(sequence(spark, d), ("none", "min_scene_len_3", "burst_collapse"))
    t = metrics.tolerant_flags(*swept, (0, 1, 3, 5)).withColumnRenamed("name", "scenario")
    return t.groupBy("scenario", "tol").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


@query(f"WITH {SEQ}, t AS ({tolerant_sql('seq', (3,))}), n AS (SELECT doc, count(*) FILTER (WHERE pred) / nullif(count(*) FILTER (WHERE gold), 0) AS over_prediction FROM seq GROUP BY doc) SELECT t.doc, tp, fp, fn, {_F1} AS f1, over_prediction FROM t JOIN n ON t.doc = n.doc")
def p16_single_document(spark, d):
    x = sequence(spark, d)
    t = metrics.with_prf(metrics.tolerant(x, (3,))).select("doc", "tp", "fp", "fn", "f1")
    return t.join(metrics.score_card(x).select("doc", "over_prediction"), "doc")
