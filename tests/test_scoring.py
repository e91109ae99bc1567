"""Truth values of the metric operators."""
import math

import pytest
from pyspark.sql import functions as F

from tallymark.operators import calibrate as C
from tallymark.operators import scoring as M


def curve_rows(spark, conf, ok):
    return spark.createDataFrame([("t", float(c), bool(o), 0.0, 0.0, None, None) for c, o in zip(conf, ok)], "task string, conf double, ok boolean, nll double, brier double, mae double, rps double")


def coverage(spark, conf, ok, budget):
    return M.risk_curve(curve_rows(spark, conf, ok), ["task"]).groupBy("task").agg(M.coverage_expr(budget).alias("c")).first()["c"]


def test_ties_are_accepted_together(spark):
    conf, ok = [0.9] * 10, [True] * 9 + [False]
    assert coverage(spark, conf, ok, 0.05) == 0.0
    assert coverage(spark, conf, ok, 0.1) == 1.0


def test_non_monotone_risk(spark):
    rows = curve_rows(spark, [.99, .99, .9, .8], [True, False, True, True])
    c = M.risk_curve(rows, ["task"]).orderBy(F.desc("threshold")).collect()
    assert [r["accepted"] for r in c] == [2, 3, 4]
    assert [round(r["risk"], 6) for r in c] == [0.5, 0.333333, 0.25]
    assert coverage(spark, [.99, .99, .9, .8], [True, False, True, True], 0.25) == 1.0


def test_threshold_none_abstains(spark):
    rows = curve_rows(spark, [.9, .8], [False, False])
    cuts = M.select_threshold(rows, ["task"], 0.1)
    out = M.apply_threshold(rows, ["task"], cuts).first()
    assert out["cut"] is None and out["accepted"] == 0 and out["risk"] is None


def test_ece_edges_are_left_closed(spark):
    rows = curve_rows(spark, [0.1, 0.3, 1.0], [True, False, True])
    assert [r["b"] for r in rows.select(M.ece_bin("conf").alias("b")).collect()] == [1, 2, 9]   # 3*0.1 is above 0.3
    assert math.isclose(M.ece(rows, ["task"]).first()["ece"], (0.9 + 0.3 + 0.0) / 3)


def preds(spark, rows):
    return spark.createDataFrame(rows, "id bigint, group_id string, source string, task string, question string, type string, variant string, keys array<string>, label int, p array<double>, logits array<double>, inference_temperature double")


def two(i, group, p, label=0, source="s", task="t"):
    return (i, group, source, task, "q", "choice", "clean", ["a", "b"], label, [p, 1 - p], [math.log(p), math.log(1 - p)], 1.0)


def test_temper_and_raw_round_trip(spark):
    d = preds(spark, [two(1, "g", 0.8), two(2, "g", 0.3)])
    hot = M.temper(d, 2.0)
    assert hot.first()["inference_temperature"] == 2.0 and hot.first()["p"][0] < 0.8
    assert all(abs(a["p"][0] - b["p"][0]) < 1e-12 for a, b in zip(M.raw(hot).orderBy("id").collect(), d.orderBy("id").collect()))
    assert M.temper(d, 1.0).orderBy("id").first()["p"] == [0.8, 0.19999999999999996]


def test_fit_refuses_tempered_rows(spark):
    with pytest.raises(Exception, match="raw logits"):
        C.fit_temperature(M.temper(preds(spark, [two(1, "g", 0.8)]), 2.0)).collect()


def test_paired_flip_reports_duplicates_and_incomplete(spark):
    rows = [("p1", "a"), ("p1", "b"), ("p2", "a"), ("p2", "a"), ("p3", "b")]
    d = spark.createDataFrame([(p, "q", s, ["x", "y"], [0.9, 0.1] if s == "a" else [0.2, 0.8], 0 if s == "a" else 1) for p, s in rows], "pair_id string, question string, sibling string, keys array<string>, p array<double>, label int")
    out = M.paired_flip(d).first()
    assert (out["errors"], out["pairs"], out["flip_rate"], out["both_correct_rate"]) == (2, 1, 1.0, 1.0)


def test_bootstrap_of_one_cluster_is_degenerate(spark):
    a, b = preds(spark, [two(i, "g", 0.9) for i in range(10)]), preds(spark, [two(i, "g", 0.9, label=0 if i else 1) for i in range(10)])
    b = b.withColumn("label", F.lit(0)).withColumn("p", F.when(F.col("id") < 9, F.array(F.lit(0.1), F.lit(0.9))).otherwise(F.col("p"))).withColumn("logits", F.transform("p", lambda x: F.log(x)))
    out = C.paired_bootstrap(a, b, "acc", "micro", 20).first()
    assert [out["delta"], out["lo"], out["hi"]] == pytest.approx([0.9, 0.9, 0.9]) and out["groups"] == 1


@pytest.mark.parametrize("metric", ["nll", "ece", "aurc"])
def test_self_comparison_is_zero(spark, metric):
    a = preds(spark, [two(i, f"g{i % 7}", 0.5 + (i % 40) / 100, label=i % 2) for i in range(60)])
    out = C.paired_bootstrap(a, a, metric, "micro", 10).first()
    assert [out["delta"], out["lo"], out["hi"]] == pytest.approx([0.0, 0.0, 0.0], abs=1e-12)


def test_pairing_violations(spark):
    a = preds(spark, [two(1, "g", 0.8), two(2, "g", 0.8)])
    b = preds(spark, [two(1, "g", 0.8), two(1, "g", 0.8)])
    assert {(r["id"], r["reason"]) for r in C.pairing_violations(a, b).collect()} == {(1, "duplicate"), (2, "missing")}


def test_folds_keep_groups_together_and_cover_sources(spark):
    d = preds(spark, [two(i, f"g{i // 3}", 0.7, source=f"s{i % 2}") for i in range(120)])
    rows = C.grouped_folds(d, 5, "x").select("source", "group_id", "fold").distinct().collect()
    assert len(rows) == len({(r["source"], r["group_id"]) for r in rows})
    assert {s: len({r["fold"] for r in rows if r["source"] == s}) for s in ("s0", "s1")} == {"s0": 5, "s1": 5}


def test_out_of_fold_lowers_ece_of_overconfident_rows(spark):
    import random
    rng = random.Random(1)
    rows = []
    for i in range(600):
        p = 0.55 + 0.4 * rng.random()
        sharp = p ** 3 / (p ** 3 + (1 - p) ** 3)
        rows.append(two(i, f"g{i}", min(sharp, 1 - 1e-9), label=0 if rng.random() < p else 1))
    d = preds(spark, rows)
    oof, _ = C.out_of_fold(d, 5, "x")
    e = lambda x: M.ece(M.row_scores(x), ["task"]).first()["ece"]
    assert e(oof) < e(d)


def test_draws_are_the_same_with_and_without_a_broadcast(spark):
    """Sums per draw by arrays in every task and by a shuffle of the picks; every sample holds as many picks as units."""
    from tallymark.operators import draws
    rows = [(src, g, arm, float(i % 7), 1) for i, (src, g) in enumerate((s, f"{s}{k}") for s, n in (("a", 40), ("b", 1), (None, 3)) for k in range(n)) for arm in ("x", "y")]
    sums = spark.createDataFrame([r for r in rows if r[0]], "source string, group_id string, arm string, v double, n bigint")
    units = C.resampling_units(sums, "s")
    ways = [sorted(map(tuple, draws.sums_per_draw(sums, units, 30, "s", ["arm"], ["v", "n"], broadcast=b).collect())) for b in (True, False)]
    assert ways[0] == ways[1] and len(ways[0]) == 31 * 2
    assert {r[3] for r in ways[0]} == {41.0}
    assert len({r[2] for r in ways[0]}) > 10
    assert draws.sums_per_draw(sums.limit(0), units, 5, "s", ["arm"], ["v", "n"]).collect() == []


def test_curve_metrics_per_draw_equal_rebuilt_curves(spark):
    import numpy as np
    from tallymark.operators import draws
    rng = np.random.default_rng(1)
    rows = [("s", int(k % 25), "x", float(c), 1, int(rng.random() < 0.3)) for k, c in enumerate(rng.integers(1, 9, 200) / 10)]
    sums = spark.createDataFrame(rows, "source string, group_id bigint, arm string, conf double, n bigint, x bigint").groupBy("source", "group_id", "arm", "conf").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    units = C.resampling_units(sums, "s")
    fast = {r["s"]: r["v"] for r in draws.curve_per_draw(sums, units, 12, "s", ["arm"], draws.area).collect()}
    slow = C._statistic(draws.sums_per_draw(sums, units, 12, "s", ["arm", "conf"], ["x", "n"], broadcast=False), ["s", "arm"], "aurc").collect()
    assert {r["s"] for r in slow} == set(fast) and all(abs(fast[r["s"]] - r["v"]) < 1e-12 for r in slow)


def test_dealt_blocks_of_units_and_confidences_give_the_same_draws(spark, monkeypatch):
    """Several blocks per stratum and several buckets of confidences, some rows at 1 exactly: the same sums and curve values as from arrays
    that every task holds."""
    import numpy as np
    from tallymark.operators import draws
    monkeypatch.setattr(draws, "ROWS_AT_ONCE", 60)
    rng = np.random.default_rng(2)
    rows = [(f"s{k % 3}", int(rng.integers(0, 40)), ("x", None)[k % 2], float(c), 1, int(rng.random() < 0.3)) for k, c in enumerate(rng.integers(1, 21, 900) / 20)]
    sums = spark.createDataFrame(rows, "source string, group_id bigint, arm string, conf double, n bigint, x bigint").groupBy("source", "group_id", "arm", "conf").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    units = C.resampling_units(sums, "s")
    value = lambda d, *c: {(r["s"], r["arm"]): tuple(r[k] for k in c) for r in d.collect()}
    a, b = (value(draws.sums_per_draw(sums, units, 20, "s", ["arm"], ["x", "n"], broadcast=w), "x", "n") for w in (True, False))
    assert a == b and len(a) == 42
    for curve in (draws.area, draws.coverage(0.2)):
        a, b = (value(draws.curve_per_draw(sums, units, 20, "s", ["arm"], curve, broadcast=w), "v") for w in (True, False))
        assert a.keys() == b.keys() and len(a) == 42
        assert all(abs(a[k][0] - b[k][0]) < 1e-12 for k in a)


def test_settled_rows_know_their_size(spark):
    """A settled table is estimated by what was written, not by the small file its rows came from: Spark must not broadcast it for that."""
    from tallymark.session import settle
    d = settle(spark.range(1000).select(F.explode(F.sequence(F.lit(0), F.lit(999))).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("x")).withColumn("x", F.sha2(F.concat("x", F.col("k").cast("string")), 256)))
    assert d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > 30_000_000


def test_order_stability_reads_its_runs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def tick(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    rows = [("t", i, "q", o, ["a", "b"], [0.6, 0.4] if o == 0 or i % 2 else [0.3, 0.7], "a") for i in range(10) for o in range(2)]
    schema = "task string, id bigint, question string, order_no int, keys array<string>, p array<double>, truth string"
    got = M.order_stability(spark.createDataFrame(rows, schema).mapInPandas(tick, schema)).collect()
    assert len(got) == 1 and got[0]["n"] == 10 and abs(got[0]["flip_rate"] - 0.5) < 1e-12 and abs(got[0]["mean_spread"] - 0.15) < 1e-12
    assert seen.value == 20
