"""Operators that deal a whole table out in ranges, blocks or stretches, against plain loops with small limits."""

import random

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from seamline.functions import labels as L
from seamline.functions import responses as R
from seamline.operators import align, metrics, planning, ranges, sampling, thinning


@pytest.mark.parametrize("n", [0, 1, 7, 3000])
def test_ranks_and_running_sums(spark, n, monkeypatch):
    monkeypatch.setattr(ranges, "BOUNDS", 5)
    rng = random.Random(n)
    rows = [(rng.choice([None, *range(4)]), k, rng.randint(-3, 9)) for k in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "a int, b int, v int").repartition(7)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1]))
    sums, total = {}, 0
    for k, r in enumerate(order, 1):
        total += r[2]
        sums[r[1]] = k, total
    x = ranges.running(ranges.rank(df, ["a", -F.col("b")]), ["a", -F.col("b")], "run", "v")
    assert {r.b: (r["rank"], r.run) for r in x.collect()} == sums


def test_no_window_has_all_rows(spark):
    """Only the sums of ranges meet in one task."""
    plan = ranges.rank(spark.range(1000), ["id"])._jdf.queryExecution().optimizedPlan().toString()
    alone = [line for line in plan.split("\n") if "Window" in line and "_bucket" in line and "windowspecdefinition(_bucket" in line and "_key" not in line]
    assert alone and plan.count("windowspecdefinition") == len(alone) + 1


def test_budget_with_gains_and_ties(spark):
    rng = random.Random(3)
    for budget in (-1, 0, 10, 25, 1000):
        rows = [(k, rng.randint(-5, 12)) for k in range(40)]
        want, total = [], 0
        for k, c in rows:
            total += c
            if total > budget and k:
                break
            want.append(k)
            if total > budget:
                break
        got = planning.budget_prefix(spark.createDataFrame(rows, "k int, c int"), "c", ["k"], budget)
        assert sorted(r.k for r in got.collect()) == want


def test_concatenated_scores_reach_over_blocks(spark):
    rng = random.Random(4)
    rows = [(d, i, rng.random() < 0.2, rng.random() < 0.2) for d in (3, 1, 2, 9) for i in range(rng.randint(1, 40))]
    flat = [(p, g) for _, _, p, g in sorted(rows)]
    got = {r.tol: (r.tp, r.fp, r.fn) for r in metrics.tolerant_concatenated(spark.createDataFrame(rows, "doc int, idx int, pred boolean, gold boolean"), (0, 1, 3), block=7).collect()}
    for t in (0, 1, 3):
        near = lambda side, k: any(x[side] for x in flat[max(0, k - t) : k + t + 1])
        tp = sum(g and near(0, k) for k, (_, g) in enumerate(flat))
        assert got[t] == (tp, sum(p and not near(1, k) for k, (p, _) in enumerate(flat)), sum(g for _, g in flat) - tp)


def test_gaps_over_batches(spark):
    """Several columns, documents and batches; other columns stay as they are."""
    rng = random.Random(5)
    rows = [(f"d{d}", i, rng.choice([True, False, None]), rng.random() < 0.5, f"text {d} {i}") for d in range(6) for i in range(rng.randint(1, 300))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        out = thinning.min_gaps(spark.createDataFrame(rows, "doc string, idx int, a boolean, b boolean, text string").repartition(5), {"a": 3, "b": 4}).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, last = {}, {}
    for d, i, a, b, text in sorted(rows):
        kept = []
        for name, on, gap in (("a", a, 3), ("b", b, 4)):
            keep = bool(on) and i - last.get((d, name), -99) >= gap
            if keep:
                last[d, name] = i
            kept.append(keep)
        want[d, i] = (*kept, text)
    assert {(r.doc, r.idx): (r.a, r.b, r.text) for r in out} == want


def test_scenarios_together_are_as_one_by_one(spark):
    rng = random.Random(6)
    rows = [(d, i, rng.random() < 0.4, rng.random() < 0.2, rng.choice([None, 0.1, 0.9]), rng.choice(["Sie ging.", "Am Morgen kam er.", "Dann"])) for d in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "doc int, idx int, pred boolean, gold boolean, conf double, text string")
    x, columns = thinning.sweep_flags(df)
    together = {s: {(r.doc, r.idx) for r in x.where(F.col(c)).collect()} for s, c in columns.items()}
    for s in ("none", "min_scene_len_4", "cluster_merge_plus_min_scene_len_3", "discourse_plus_min_scene_len_3", "n_per_k"):
        assert together[s] == {(r.doc, r.idx) for r in thinning.apply_scenario(df, s).where("pred").collect()}
    scores = metrics.tolerant_flags(x, columns, (0, 2)).collect()
    for s in ("burst_collapse", "min_scene_len_3"):
        one = {(r.doc, r.tol): (r.tp, r.fp, r.fn) for r in metrics.tolerant(thinning.apply_scenario(df, s), (0, 2)).collect()}
        assert one == {(r.doc, r.tol): (r.tp, r.fp, r.fn) for r in scores if r.name == s}


def test_containment_by_stretches(spark):
    rng = random.Random(7)
    inner = [(d, b, b + rng.randint(0, 30)) for d in range(3) for b in rng.sample(range(400), 60)]
    outer = [(d, k, b, b + rng.randint(-5, 120)) for d in range(4) for k, b in enumerate(rng.sample(range(400), 12))]
    want = {}
    for d, k, b, e in outer:
        if found := [x for y, x, z in inner if y == d and x >= b and z <= e]:
            want[d, k] = min(found)
    got = align.contained_in(spark.createDataFrame(inner, "doc int, begin int, end int"), spark.createDataFrame(outer, "doc int, scene int, begin int, end int"), width=16)
    assert {(r.doc, r.scene): r.first_begin for r in got.collect()} == want


def test_folds_are_numbers(spark):
    df = spark.createDataFrame([(s,) for s in "cabca"], "s string")
    x = sampling.folds(df, "s")
    assert {r.s: r.fold for r in x.collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r.s: r.r for r in x.withColumn("r", sampling.fold_role("fold", 1)).collect()} == {"a": "train", "b": "eval", "c": "train"}


def test_holdout_and_caps_by_plain_hashes(spark):
    from hashlib import md5

    df = spark.createDataFrame([(f"s{k % 11}", k) for k in range(50)], "s string, k int")
    order = sorted({f"s{k}" for k in range(11)}, key=lambda s: md5(f"5|{s}".encode()).hexdigest())
    got = {r.s for r in sampling.holdout(df, "s", 0.3, seed=5).where("held_out").collect()}
    assert got == set(order[:3])
    assert {r.s for r in sampling.holdout(df, "s", 0.01, seed=5).where("held_out").collect()} == set(order[:1])
    assert {r.s for r in sampling.holdout(df, "s", named=["s1"]).where("held_out").collect()} == {"s1"}
    kept = {(r.s, r.k) for r in sampling.capped(df, 2, 9, "s", "k").collect()}
    assert kept == {(s, k) for s in order for k in sorted((k for k in range(50) if f"s{k % 11}" == s), key=lambda k: (md5(f"9|{s}|{k}".encode()).hexdigest(), k))[:2]}


def test_schema_of_an_unknown_family_is_an_error(spark):
    schemas = {"B": "b.json", "A": None}
    df = spark.createDataFrame([("B",), ("A",)], "f string")
    assert [r[0] for r in df.select(L.schema_file("f", schemas)).collect()] == ["b.json", None]
    for name in ("Z", None):
        with pytest.raises(SparkRuntimeException, match="unknown family"):
            spark.createDataFrame([(name,)], "f string").select(L.schema_file("f", schemas)).collect()


def test_json_with_more_after_it_says_nothing(spark):
    texts = ['{"reason": "a", "confidence": 0.5}', '{"reason": "a", "confidence": 0.5} so', '{"reason": "a"}, {"reason": "b"}', ' {"reason": "a", "confidence": "0.5"}\n', "", None, "x", '{"a": }']
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(R.reason("t").alias("r"), R.confidence("t").alias("c")).collect()
    assert [tuple(r) for r in got] == [("a", 0.5), ("", None), ("", None), ("a", 0.5), ("", None), ("", None), ("", None), ("", None)]


def test_settings_by_precedence(spark):
    rows = [(1, None, None, None), (2, '{"epochs": 2, "debug": true}', {"DATA_DIR": "/d", "EPOCHS": "7"}, None), (3, '{"eval_preflight_rows": 3, "debug": true, "eval_max_new_tokens": 11}', {"DATA_DIR": ""}, '{"epochs": 4, "target_format": "cot_list"}')]
    df = spark.createDataFrame(rows, "id int, f string, e map<string, string>, j string")
    got = planning.settings(df, {"epochs": 1, "debug": False, "data_dir": "data"}, "f", "e", "j").orderBy("id").collect()
    assert [(r.epochs, r.debug, r.data_dir, r.eval_preflight_rows, r.eval_max_new_tokens) for r in got] == [(1, False, "data", 0, 96), (7, True, "/d", 20, 96), (4, True, "data", 3, 11)]


def test_folders_and_tokens(spark):
    r = spark.range(1).select(
        L.run_folder(F.lit("/r"), F.lit("prompting"), F.lit("d"), F.lit("x")).alias("a"), L.run_folder(F.lit("/r"), F.lit("reproduction"), F.lit("d"), F.lit("x")).alias("b"), L.run_folder(F.lit("/r"), F.lit("prompting"), F.lit("d")).alias("c"),
        *[L.new_tokens(F.lit(k)).alias(k) for k in ("cot_list", "json", "no_cot", "other")],
    ).head()
    assert tuple(r) == ("/r/outputs/runs/prompting/d/x", "/r/outputs/reproduction/d/x", "/r/outputs/runs/prompting/d", 256, 96, 128, 96)
