"""Rules on hand-worked inputs and against plain loops."""

import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seamline.functions import labels as L
from seamline.functions import parsers as P
from seamline.operators import align, metrics, planning, rollups, sampling, thinning
from seamline.operators import windows as W

SCHEMA = "doc string, idx int, pred boolean, gold boolean, conf double"


def rows(spark, flags, conf=None, gold=None, doc="d"):
    conf, gold = conf or [None] * len(flags), gold or [False] * len(flags)
    return spark.createDataFrame([(doc, i, bool(p), bool(g), c) for i, (p, g, c) in enumerate(zip(flags, gold, conf))], SCHEMA)


def kept(df):
    return [r.idx for r in df.where("pred").orderBy("idx").collect()]


def at(*positions, n=12):
    return [i in positions for i in range(n)]


def greedy(flags, gap):
    out, last = [], -(10**9)
    for i, f in enumerate(flags):
        if f and i - last >= gap:
            out.append(i)
            last = i
    return out


def test_min_gap(spark):
    assert kept(thinning.min_gap(rows(spark, at(0, 1, 4, 5, 9)), 3)) == [0, 4, 9]


def test_burst_collapse_alternates(spark):
    assert kept(thinning.burst_collapse(rows(spark, [1, 1, 1]))) == [0, 2]


def test_cluster_merge_keeps_the_surest(spark):
    df = rows(spark, [0, 1, 0, 1, 0, 1], [None, 0.7, None, 0.95, None, 0.8])
    assert kept(thinning.cluster_merge(df, 3)) == [3]
    assert kept(thinning.cluster_merge(rows(spark, [1, 1, 0], [None, 0.1, None]), 3)) == [1]
    assert kept(thinning.cluster_merge(rows(spark, [1, 1, 0], [0.5, 0.5, None]), 3)) == [0]


def test_confidence_threshold_keeps_unknown(spark):
    assert kept(thinning.confidence_threshold(rows(spark, [1, 1, 1], [0.8, None, 0.9]), 0.85)) == [1, 2]


def test_n_per_k(spark):
    assert kept(thinning.n_per_k(rows(spark, at(0, 3, 5, 9, 10)), 5)) == [0, 5, 10]
    with pytest.raises(ValueError):
        thinning.n_per_k(rows(spark, [1]), 0)


def test_all_short_sequences(spark):
    """Greedy thinning against a loop, and the collapse as thinning by two, over all sequences of seven flags."""
    parts = [rows(spark, f, doc=str(k)) for k, f in enumerate([])]
    assert parts == []
    flags = list(itertools.product([0, 1], repeat=7))
    data = [(str(k), i, bool(p), False, None) for k, f in enumerate(flags) for i, p in enumerate(f)]
    df = spark.createDataFrame(data, SCHEMA)

    def by_doc(x):
        got = {str(k): [] for k in range(len(flags))}
        for r in x.where("pred").orderBy("doc", "idx").collect():
            got[r.doc].append(r.idx)
        return got

    for gap in (2, 3):
        assert by_doc(thinning.min_gap(df, gap)) == {str(k): greedy(f, gap) for k, f in enumerate(flags)}
    assert by_doc(thinning.burst_collapse(df)) == by_doc(thinning.min_gap(df, 2))
    once = thinning.min_gap(df, 3)
    assert by_doc(thinning.min_gap(once, 3)) == by_doc(once)


def test_scenarios_are_known(spark):
    for s in thinning.SCENARIOS:
        thinning.rules(s)
    with pytest.raises(ValueError):
        thinning.rules("nonsense")
    with pytest.raises(ValueError):
        thinning.apply_scenario(rows(spark, [1]), "discourse")


def test_tolerant_is_counted_on_the_gold_side(spark):
    df = rows(spark, at(4, 6, n=10), gold=at(5, n=10))
    got = {r.tol: (r.tp, r.fp, r.fn) for r in metrics.tolerant(df, (0, 1)).collect()}
    assert got == {0: (0, 2, 1), 1: (1, 0, 0)}


def test_scene_lengths(spark):
    x = rows(spark, at(0, 5, n=10))
    assert [r.scene_len for r in W.border_terminated_lengths(x, "pred").orderBy("seq").collect()] == [1, 5, 4]
    assert {r.scene_len for r in W.segment_lengths(x, "pred").collect()} == {5}
    assert [r.scene_len for r in W.border_terminated_lengths(rows(spark, [0] * 10), "pred").collect()] == [10]


def test_longest_run(spark):
    r = W.longest_run(rows(spark, at(1, 2, 5, 6, 9)), "pred").head()
    assert (r.run_len, r.run_start) == (2, 1)


def test_neighbour_budget(spark):
    df = spark.createDataFrame([("d", i, f"s{i}") for i in range(12)], "doc string, idx int, text string")
    r = W.neighbour_budget(df, 5).where("idx = 1").head()
    assert (r.left, r.right) == (["s0"], ["s2", "s3", "s4", "s5"])


def token_loop(n, i, budget):
    l, r, used, lo, ro, left = 0, 0, 0, True, True, True
    while True:
        lo, ro = lo and l < i, ro and r < len(n) - i - 1
        if not lo and not ro:
            return l, r
        go_left = lo and (left or not ro)
        c = n[i - 1 - l] if go_left else n[i + 1 + r]
        if used + c <= budget:
            used += c
            l, r = (l + 1, r) if go_left else (l, r + 1)
        elif go_left:
            lo = False
        else:
            ro = False
        left = not left


def test_token_budget(spark):
    counts = [3, 1, 7, 2, 2, 9, 1, 1, 4, 2]
    df = spark.createDataFrame([("d", i, " ".join(["w"] * n)) for i, n in enumerate(counts)], "doc string, idx int, text string")
    got = {r.idx: (r.n_left, r.n_right) for r in W.token_budget(df, 10).collect()}
    assert got == {i: token_loop(counts, i, 10) for i in range(len(counts))}


def test_budget_prefix(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate((10, 20, 30))], "i int, c int")
    assert [r.i for r in planning.budget_prefix(df, "c", ["i"], 25).collect()] == [0]
    assert [r.i for r in planning.budget_prefix(df, "c", ["i"], 5).collect()] == [0]


def test_stratified_sample_is_even(spark):
    df = rows(spark, [0] * 20, gold=at(3, 9, 14, n=20))
    got = [r.idx for r in sampling.stratified(df).where("not gold").orderBy("idx").collect()]
    others = [i for i in range(20) if i not in (3, 9, 14)]
    assert got == [others[int(i * len(others) / 3)] for i in range(3)]
    assert sampling.stratified(rows(spark, [0] * 5)).count() == 0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 60), st.integers(1, 60))
def test_even_positions(spark, size, n):
    df = spark.range(size).select(F.lit("d").alias("doc"), F.col("id").alias("idx"))
    got = sorted(r.idx for r in sampling.evenly(df, F.lit(n)).collect())
    assert got == (list(range(size)) if size <= n else [int(i * (size / n)) for i in range(n)])


def test_hard_negatives(spark):
    df = rows(spark, [0] * 21, gold=at(1, n=21)).where("idx in (0, 1, 2, 3, 10, 20)")
    got = {r.idx for r in sampling.hard_negatives(df, 3, 0.5, 1).collect()}
    assert {0, 1, 2, 3} <= got and len(got - {1}) >= 3


def test_upsert_later_wins(spark):
    s = "key string, seq int, v string"
    base = spark.createDataFrame([("a", 1, "old"), ("b", 1, "b1"), ("b", 2, "b2"), (None, 1, "x")], s)
    later = spark.createDataFrame([("a", 0, "new")], s)
    assert {(r.key, r.v) for r in align.upsert(base, later, "key", "seq").collect()} == {("a", "new"), ("b", "b2")}


def test_guardrail_stops_at_once_on_fatal(spark):
    calls = spark.createDataFrame([("d", 0, True, None), ("d", 1, False, "auth_error")], "doc string, seq int, ok boolean, kind string")
    r = rollups.guardrail(calls).head()
    assert (r.abort_at, r.why) == (1, "auth_error")


def test_labels(spark):
    df = spark.createDataFrame([("1",), (None,), (" no ",), ("Border",)], "v string")
    got = [(r.a, r.b) for r in df.select(L.nullable_label("v").alias("a"), L.total_label("v").alias("b")).collect()]
    assert got == [(None, "BORDER"), (None, "NOBORDER"), ("NOBORDER", "NOBORDER"), ("BORDER", "BORDER")]
    r = spark.range(1).select(L.sequence_length(F.lit(512)).alias("a"), L.sequence_length(F.lit(2048)).alias("b")).head()
    assert (r.a, r.b) == (1280, 2816)


def test_parsers():
    assert P.tolerant('One.\nTwo.\n{"label": "BORDER", "confidence": 0.9}') == ("BORDER", 0.9, True, "", "json")
    assert P.tolerant('{"label": "NO')[2] is False
    assert P.tolerant("Long prose. Final: BORDER")[0::4] == ("BORDER", "regex_fallback")
    assert P.strict("Long prose. Final: BORDER")[2] is False
    assert P.tolerant("The answer is NOBORDER here.")[0] == "NOBORDER"
    assert P.tolerant('{"a": } {"label": "yes"}')[0] == "BORDER"
    assert P.json_candidate('{"label": 1} trailing') == '{"label": 1} trailing'
    assert P.json_candidate('prose {"label": 1} trailing') == '{"label": 1}'
    assert P.family_output("L", '{"label": "BORDER"} trailing')[2] == "json_parse_error"
    assert P.family_output("H", "none of them")[0] == "NOBORDER"
    assert P.family_output("I", '{"a": 1}')[2] == "json_not_array"
    assert P.family_output("Z", "x")[2] == "unsupported_family:Z"


def test_live_guardrail(spark, tmp_path):
    from seamline.streaming.logs import CALL, live_guardrail

    spark.createDataFrame([(1, i, i % 2 == 0, None) for i in range(6)] + [(2, i, True, None) for i in range(6)], CALL).coalesce(1).write.parquet(str(tmp_path / "log"))
    got = []
    stream = spark.readStream.schema(CALL).parquet(str(tmp_path / "log"))
    q = live_guardrail(stream).writeStream.outputMode("append").trigger(availableNow=True).foreachBatch(lambda d, _: got.extend(map(tuple, d.collect()))).start()
    q.awaitTermination()
    assert got == [(1, 1, "failures")]
