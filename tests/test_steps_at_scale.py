"""Steps that grew faster than their input or went through the driver: what they read, repeat and hold."""
import hashlib
import math

from pyspark.sql import functions as F

from tallymark.functions import text as TX
from tallymark.functions import vectors as V
from tallymark.operators import calibrate as C
from tallymark.operators import draws
from tallymark.operators import perturb as A
from tallymark.operators import rules as RU
from tallymark.operators import events as B
from tallymark.operators import ledger as L
from tallymark.operators import scoring as M
from tallymark.sources.fixtures import Tables


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_unit_sums_of_nine_megabytes_stay_off_the_driver(spark):
    """a table that needed hundreds of MB to be turned into arrays was collected."""
    sums = spark.range(460_000).select((F.col("id") % 5).cast("string").alias("source"), "id", F.lit(1.0).alias("x")).withColumnRenamed("id", "group_id")
    units = sums.select("source", "group_id", F.lit(1).cast("bigint").alias("unit"), F.lit(1).cast("bigint").alias("units"))
    assert draws._tagged(sums, units, "s", "source", "group_id", ["x"], 20)[1:] == (460_000, False)


def test_totals_of_a_curve_are_drawn_from_units_not_from_confidences(spark, monkeypatch):
    """The totals above a bucket need one row per unit and bucket."""
    rows = [("s", k % 5, k / 1000, 1, k % 3 == 0) for k in range(600)]
    sums = spark.createDataFrame(rows, "source string, group_id bigint, conf double, n bigint, x boolean").withColumn("x", F.col("x").cast("bigint")).withColumn("arm", F.lit("a"))
    seen, drawn = [], draws._drawn
    monkeypatch.setattr(draws, "_drawn", lambda rows, count, *more: seen.append((count, rows.count())) or drawn(rows, count, *more))
    units = C.resampling_units(sums, "s")
    a, b = ({r["s"]: r["v"] for r in draws.curve_per_draw(sums, units, 12, "s", ["arm"], draws.area, broadcast=w).collect()} for w in (False, True))
    assert seen == [(5, 5)] and a.keys() == b.keys() and all(abs(a[s] - b[s]) < 1e-12 for s in b)


def test_sums_of_a_block_with_and_without_laying_out_its_cells(spark, monkeypatch):
    """a block multiplies counts with its units' cells, nulls stay null; the same as with the rows gathered per sample."""
    rows = [("s", k % 40, ("x", "y", None)[k % 3], float(k % 7), None if k % 3 == 1 else 1.0) for k in range(400)]
    sums = spark.createDataFrame(rows, "source string, group_id bigint, bin string, v double, w double").groupBy("source", "group_id", "bin").agg(F.sum("v").alias("v"), F.sum("w").alias("w"))
    units, made = C.resampling_units(sums, "s"), []
    for limit in (draws.LAID_OUT, 0):
        monkeypatch.setattr(draws, "LAID_OUT", limit)
        table = sums.join(units, ["source", "group_id"]).select("bin", "v", "w", "unit", "units", F.lit(77).cast("bigint").alias("key"), F.lit(0).alias("_piece"), F.lit(0).alias("_block")).toArrow()
        out = draws._block_sums(["bin"], ["v", "w"], 10, 1000, 1)(table).to_pylist()
        made.append(sorted(((r["s"], str(r["bin"]), r["v"], r["w"]) for r in out), key=str))
    assert made[0] == made[1] and {r[3] for r in made[0] if r[1] == "y"} == {None} and len(made[0]) == 33


def test_blank_runs_and_folds_without_a_lookup_per_character(spark):
    """F25, F29, F36, F42."""
    blanks = "\t\n\x0b\x0c\r\x1c\x1f \x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"
    texts = [f"a{b}b" for b in blanks] + [f"{b} x {b}{b}y  z{b}" for b in blanks] + ["Stra\u00dfe \u017f \u03a3\u03c2", "a\u200bb", "", "   ", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", TX.collapse("t").alias("c"), TX.norm_text("t").alias("n")).collect()
    for t, c, n in got:
        want = None if t is None else " ".join(t.split())
        assert c == want and (t is None or n == want.lower().replace("\u00df", "ss").replace("\u017f", "s").replace("\u03c2", "\u03c3"))
    assert "translate" not in plan(spark.createDataFrame([("a",)], "t string").select(F.col("t"), TX.norm_text(F.concat("t", F.uuid())).alias("n")))


def test_texts_are_measured_once_for_their_length_bucket(spark):
    """a filter on the bucket measured them again."""
    d = spark.createDataFrame([(5, True), (60, False), (70, True), (5000, True), (None, True)], "size int, ok boolean")
    got = M.accuracy_by_length(d.withColumn("size", F.col("size") + F.length(F.uuid()) * 0), ((0, 50), (50, 200)))
    assert {tuple(r) for r in got.collect()} == {("0-50", 1, 1.0), ("50-200", 2, 0.5)}
    e = M.accuracy_by_length(d.withColumn("size", F.factorial(F.col("size") % 3) + F.col("size")), ((0, 50), (50, 200)))
    assert plan(e).count("factorial") == 1


def test_edits_and_tiers_are_plain_expressions(spark):
    """candidates were filtered and sorted by functions of arrays, which Spark does not compile."""
    tiers = (("f", 0, 10, "low"), ("f", 10, 20, "high"), ("g", 0, 20, "any"))
    cases = spark.createDataFrame([("c1", "f", 5), ("c2", "g", 5), ("c3", "f", None), ("c4", None, 5)], "case_id string, family string, q int")
    edits = [("up", {"q": F.col("q") + 10}), ("out", {"q": F.col("q") + 100})]
    pairs, report = RU.counterfactual_pairs(cases, edits, lambda f: RU.tier_expr(tiers, F.col("family"), f["q"]), None)
    assert [(r["case_id"], r["edit"], r["label_a"], r["label_b"]) for r in pairs.collect()] == [("c1", "up", "low", "high")]
    assert {tuple(r) for r in report.collect()} == {("f", None, 1), ("g", "labels_equal", 1), ("f", "label_undetermined", 1), (None, "label_undetermined", 1)}
    d = RU.decisive_edits(cases.filter("family is not null").withColumn("route", F.lit(1)), 0, [{"kind": "gt", "fields": ["q"], "threshold": 7}], ["q"], {"q": [1, 9]}, ("route", (1, 2)))
    assert {(r["case_id"], r["pair_kind"], r["sibling"], r["q"], r["label"], r["route"]) for r in d.collect()} == {
        ("c1", "relevant", "a", 5, False, 1), ("c1", "relevant", "b", 9, True, 1), ("c1", "irrelevant", "a", 5, False, 1), ("c1", "irrelevant", "b", 5, False, 2),
        ("c2", "relevant", "a", 5, False, 1), ("c2", "relevant", "b", 9, True, 1), ("c2", "irrelevant", "a", 5, False, 1), ("c2", "irrelevant", "b", 5, False, 2)}
    assert "array_sort" not in plan(d) and "lambda" not in plan(pairs)


def test_ablated_cases_and_controls_come_from_one_reading(spark):
    """F24."""
    cases = spark.range(3).select(F.col("id").cast("string").alias("case_id"), F.lit(5).alias("q"))
    d = A.ablate_evidence(cases, ["q"], lambda f: F.when(f["q"] > 3, "a").when(f["q"] <= 3, "b"), uniform_target=2)
    assert "Union" not in plan(d) and plan(d).count("Range") == 1
    assert {(r["id"], r["control_id"], r["q"], tuple(r["target"] or ())) for r in d.filter("case_id = '1'").collect()} == {("unknowable/1", "unknowable_control/1", None, (0.5, 0.5)), ("unknowable_control/1", None, 5, ())}


def test_dates_are_cast_not_parsed(spark):
    """every refused format threw."""
    d = spark.createDataFrame([("May 1, 2020, February 31, 2020, 2020-13-01, March 05, 2020 and 2020-05-01",)], "t string").select(A.date_facts(F.concat("t", F.substring(F.uuid(), 1, 0))).alias("f"))
    assert "gettimestamp" not in plan(d).lower() and "try_to_timestamp" not in plan(d).lower()
    assert d.first()["f"].startswith("March 05, 2020 is 57 days before May 1, 2020. 2020-05-01 is the same day as May 1, 2020. ")


def test_bodies_shown_before_the_masks_are_not_parsed_again(spark):
    """every profile parsed the bodies of its transactions."""
    from tallymark.operators import events as B
    rid = "a" * 24
    v = spark.createDataFrame([("e", "full", "x", 0, f"/artifacts/{rid}", '{"shown":1}', f'"{rid}"')], "episode_id string, profile string, actor_id string, ordinal bigint, path string, req string, resp string")
    v = v.withColumn("request_body", F.lit("{}")).withColumn("response_body", F.lit("{}"))
    assert [tuple(r) for r in B.alias_ids(v).select("actor", "path", "req", "resp").collect()] == [("u0", "/artifacts/r0", '{"shown":1}', '"r0"')]
    assert [r["req"] for r in B.alias_ids(v.drop("req", "resp")).collect()] == ["{}"]


def test_trials_of_a_screen_are_scored_once(spark, tmp_path):
    """the questions were scored again for the accuracy of each source."""
    from tallymark.plans import catalog
    rows = [(k, k % 3, "FOP"[k % 3], f"{k % 5 + 1}-X") for k in range(60)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    d = catalog.queries()["L9_screen"](spark, str(tmp_path))
    assert "sha2" not in plan(d) and d.count() == 6


def orders(spark, rows, path):
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    return Tables(spark, str(path))


def test_predictors_are_handed_arrow_batches(spark):
    """arrays were converted element by element; options were scored in arrays of their own."""
    q = spark.createDataFrame([(7, "status", ["F", "O", "P"], 1), (123456, "urgent", ["false", "true"], None), (8, "urgent", ["false", "true"], 0)], "id bigint, question string, keys array<string>, label int")
    s = M.score_batch(q.coalesce(1), M.hash_predictor("A", 1.2, max_tokens=7))
    assert "MapInArrow" in plan(s)
    got = {r["id"]: r for r in s.collect()}
    assert got[123456]["reject_reason"] == "too_long" and got[123456]["p"] is None and got[123456]["latency_ms"] is None and got[123456]["tokens"] == 8
    z = [int(hashlib.sha256(f"A:7:status:{k}".encode()).hexdigest()[:8], 16) % 6000 / 1000.0 + (1.2 if k == "O" else 0.0) for k in "FOP"]
    e = [math.exp(x - max(z)) for x in z]
    assert got[7]["logits"] == z and all(abs(a - b / sum(e)) < 1e-12 for a, b in zip(got[7]["p"], e)) and len(got[8]["p"]) == 2 and got[8]["reject_reason"] is None


def test_metric_blocks_score_their_rows_once(spark):
    """curve, totals and bins each scored the rows; a summary now makes the blocks that are asked for."""
    rows = spark.createDataFrame([(k, "t", "s", "clean", "choice", k % 2, [0.25 + k / 100, 0.75 - k / 100]) for k in range(20)], "id bigint, task string, source string, variant string, type string, label int, p array<double>")
    blocks = M.summarize(rows)
    assert not blocks._made and "LogicalRDD" not in plan(blocks["variants"]) and list(blocks._made) == ["variants"]
    assert blocks["variants"].first()["n"] == 20 and set(blocks) >= {"objective", "clean", "tasks", "heldout_tasks", "permutation", "calibrated_clean"}


def test_option_scores_are_compiled_columns(spark, tmp_path):
    """hashes, softmax and rounding ran as interpreted lambdas, once per option."""
    t = orders(spark, [(1, 1, "F", "1-URGENT"), (2, None, "P", "5-LOW"), (None, 3, "O", "3-M")], tmp_path)
    d = t.decisions("A")
    assert "lambdafunction" not in plan(d) and "lambdafunction" not in plan(t.permuted("A"))
    z = F.transform("keys", lambda k, i: (TX.h32(F.lit("A"), F.col("id"), F.col("task"), k) % 6000) / F.lit(1000.0) + F.when(i == F.col("label"), F.lit(1.2)).otherwise(0.0))
    was = t.questions().withColumn("logits", z).withColumn("p", V.settled(V.softmax("logits")))
    cols = ["id", "task", "keys", "logits", "p"]
    assert sorted(map(str, d.select(*cols).collect())) == sorted(map(str, was.select(*cols).collect())) and d.count() == 9


def test_lines_of_windows_are_measured_and_joined_once(spark):
    """chunks of a view and the records of its windows were put together again for each reader."""
    lines = spark.createDataFrame([("e", "full", k, 3, f"r{k}", k) for k in range(30)], "episode_id string, profile string, pos bigint, size bigint, request_id string, ordinal bigint")
    w = B.budget_windows(lines, 10)
    r = B.window_records(w, lines)
    assert "collect_list" not in plan(w) and "collect_list" not in plan(r)
    assert sorted((x["window"], x["window_count"], x["request_ids"]) for x in r.collect()) == [(k, 10, [f"r{3 * k + j}" for j in range(3)]) for k in range(10)]


def test_features_are_read_from_stored_measures(spark):
    """moments, quantiles and distinct counts each read the transactions again."""
    tx = spark.createDataFrame([("e", "a", k, 1000 * k, 1000 * k + 40, "GET", f"/documents/{k % 3}?x", 200) for k in range(8)], "episode_id string, actor_id string, event_id bigint, start_ms bigint, completed_ms bigint, method string, path string, status int")
    s, t = B.structural_features(tx), B.timing_features(tx)
    assert "LogicalRDD" not in plan(s) and plan(t).count("LogicalRDD") <= 1
    assert s.first()["distinct_resources"] == 3 and {r["measure"]: r["median"] for r in t.collect()} == {"start_gap_ms": 1000.0, "response_ms": 40.0, "actor_start_gap_ms": 1000.0, "actor_idle_ms": 960.0}


def test_siblings_are_joined_without_a_broadcast(spark, tmp_path):
    """files of few compressed bytes passed for a small side, the driver built tables of all prediction rows."""
    rows = [(i, i % 7, f"{i % 5 + 1}-P", "FOP"[i % 3]) for i in range(60)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    paired = Tables(spark, str(tmp_path)).paired("A")
    assert "Broadcast" not in paired._jdf.queryExecution().executedPlan().toString()
    assert paired.count() == 180 and paired.filter("id % 14 < 7 and sibling = 'b' or id % 14 >= 7 and sibling = 'a'").isEmpty()


def test_input_guards_compute_their_inputs_once(spark):
    """the filter on the reason moved below the projections and repeated every step of the confidence at every mention."""
    rows = [(0, 0.5, 1, 0.1, "old"), (1, float("nan"), 1, 0.1, "old"), (2, 1.5, 0, 0.1, "old"), (3, None, 0, 0.1, "old"), (4, 0.5, 2, 0.1, "old"), (5, 0.5, None, 0.1, "old"), (6, 0.5, 1, 1.5, "old"), (7, 1.0, 0, None, "old")]
    d = spark.createDataFrame(rows, "id int, c double, correct int, budget double, reason string")
    for i in range(4):
        d = d.withColumn("c", F.log(F.exp("c")) + F.sha2(F.col("id").cast("string"), 256).startswith("_").cast("int"))
    out = M.input_guards(d, "c")
    assert plan(out).count("sha2(") == plan(d).count("sha2(") and out.columns == d.columns
    assert {r["id"]: r["reason"] for r in out.collect()} == {1: "confidence", 2: "confidence", 3: "confidence", 4: "correctness", 5: "correctness", 6: "budget", 7: "budget"}


def curve_sums(spark, n=1):
    import numpy as np
    rng = np.random.default_rng(5)
    rows = [(f"s{k % 3}", int(rng.integers(0, 40)), "xy"[k % 2], float(c), n, int(rng.random() < (1 - c) / 2)) for k, c in enumerate(rng.integers(1, 81, 1200) / 80)]
    sums = spark.createDataFrame(rows, "source string, group_id bigint, arm string, conf double, n bigint, x bigint").groupBy("source", "group_id", "arm", "conf").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    return sums if n > 1 else sums.withColumn("n", F.lit(1).cast("bigint")).withColumn("x", F.least("x", F.lit(1)).cast("bigint"))


def test_a_coverage_opens_only_blocks_that_can_hold_it(spark, monkeypatch):
    """every block of confidences was gone through in every sample, though totals tell that most have no say."""
    monkeypatch.setattr(draws, "ROWS_AT_ONCE", 60)
    seen, made = spark.sparkContext.accumulator(0), draws._curve_parts

    def counted(curve):
        run = made(curve)

        def ticked(table, above):
            seen.add(above.num_rows)
            return run(table, above)
        return ticked
    monkeypatch.setattr(draws, "_curve_parts", counted)
    sums = curve_sums(spark)
    units, spent = C.resampling_units(sums, "s"), []
    for curve in (draws.area, draws.coverage(0.1)):
        before = seen.value
        a, b = ({(r["s"], r["arm"]): r["v"] for r in draws.curve_per_draw(sums, units, 30, "s", ["arm"], curve, broadcast=w).collect()} for w in (True, False))
        assert a.keys() == b.keys() and len(a) == 62 and all(abs(a[k] - b[k]) < 1e-12 for k in a)
        spent.append(seen.value - before)
    assert 0 < spent[1] < spent[0] / 2


def test_curves_with_many_rows_a_unit_and_many_picks(spark, monkeypatch):
    """picks are held in bytes while they fit; several rows of one unit and confidence, and numbers that do not fit, give the same."""
    monkeypatch.setattr(draws, "ROWS_AT_ONCE", 100)
    monkeypatch.setattr(draws, "LEVELS_AT_ONCE", 37)
    for n, most in ((1, 255), (1, 2), (3, 255)):
        monkeypatch.setattr(draws, "PICKS_IN_A_BYTE", most)
        sums = curve_sums(spark, n)
        units = C.resampling_units(sums, "s")
        a, b = ({(r["s"], r["arm"]): r["v"] for r in draws.curve_per_draw(sums, units, 20, "s", ["arm"], draws.area, broadcast=w).collect()} for w in (True, False))
        assert a.keys() == b.keys() and len(a) == 42 and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_metrics_of_one_comparison_share_their_draws(spark, monkeypatch):
    """every metric summed, ranked and drew the same units again."""
    drawn, made = [], draws.sums_per_draw
    monkeypatch.setattr(draws, "sums_per_draw", lambda *a, **k: drawn.append(a[5]) or made(*a, **k))
    rows = [(k, f"s{k % 2}", k % 20, "clean", "t", "choice", ["a", "b"], k % 2, [0.5 + k % 7 / 20, 0.5 - k % 7 / 20], [k % 7 / 5, 0.0]) for k in range(120)]
    a = spark.createDataFrame(rows, "id bigint, source string, group_id bigint, variant string, task string, type string, keys array<string>, label int, p array<double>, logits array<double>").withColumn("question", F.col("task"))
    b = a.withColumn("p", F.array(F.col("p")[0] - 0.1, F.col("p")[1] + 0.1)).withColumn("logits", F.array(F.col("logits")[0] - 0.3, F.lit(0.0)))
    got = {r["metric"]: r for r in C.compare_deltas(a, b, "s", "s", 20).collect()}
    assert drawn == [["x_nll", "x_acc", "x_brier", "n"]]
    for metric, r in got.items():
        want = C.paired_bootstrap(a, b, metric, "macro", 20, "boot").first()
        assert all(abs(r[c] - want[c]) < 1e-12 for c in ("delta", "lo", "hi")) and (r["samples"], r["groups"]) == (want["samples"], want["groups"]) == (20, 20)


def test_folds_are_joined_once_and_only_asked_results_are_stored(spark, monkeypatch):
    """The fit and the tempering each joined all rows with their folds, and the interval stored the blocks' histogram."""
    joined, blocks, made, block = [], [], C.grouped_folds, M.metrics
    monkeypatch.setattr(C, "grouped_folds", lambda df, *a: made(df.mapInPandas(lambda it: map(tick, it), df.schema), *a))
    monkeypatch.setattr(M, "metrics", lambda *a: blocks.append(a) or block(*a))
    seen = spark.sparkContext.accumulator(0)

    def tick(pdf):
        seen.add(len(pdf))
        return pdf
    rows = [(k, f"s{k % 2}", k % 20, "clean", "t", "choice", ["a", "b"], k % 2, [0.5 + k % 7 / 20, 0.5 - k % 7 / 20], [k % 7 / 5, 0.0], 1.0) for k in range(200)]
    d = spark.createDataFrame(rows, "id bigint, source string, group_id bigint, variant string, task string, type string, keys array<string>, label int, p array<double>, logits array<double>, inference_temperature double").withColumn("question", F.col("task"))
    out = C.cross_validated_temperature(d, 5, "cv", 20)
    row = out["interval"].first()
    assert row["raw_lo"] <= row["raw_hi"] and not blocks and seen.value <= 3 * 200        # rows, units and their number
    assert {r["arm"]: r["n"] for r in out["blocks"].collect()} == {"raw": 200, "out_of_fold": 200} and seen.value <= 3 * 200


def test_pairs_of_trials_draw_every_trial_once(spark, monkeypatch):
    """the sums of a baseline were stored and drawn once per trial that is compared with it."""
    drawn, made = [], draws.sums_per_draw
    monkeypatch.setattr(draws, "sums_per_draw", lambda sums, *a, **k: drawn.append(sums.count()) or made(sums, *a, **k))
    rows = [(f"T{t}", k, f"s{k % 2}", k % 20, "clean", "t", "choice", k % 2, [0.5 + (k + t) % 7 / 20, 0.5 - (k + t) % 7 / 20], [(k + t) % 7 / 5, 0.0]) for t in range(4) for k in range(120)]
    d = spark.createDataFrame(rows, "trial string, id bigint, source string, group_id bigint, variant string, task string, type string, label int, p array<double>, logits array<double>").withColumn("question", F.col("task"))
    pairs = spark.createDataFrame([("T1", "T0"), ("T2", "T0"), ("T3", "T1"), ("T9", None)], "trial string, baseline string")
    got = {r["trial"]: r for r in L.paired_against(d, pairs, "nll", "macro", 20, "boot").collect()}
    assert drawn == [4 * 20] and sorted(got) == ["T1", "T2", "T3"]
    for trial, base in (("T1", "T0"), ("T2", "T0"), ("T3", "T1")):
        want = C.paired_bootstrap(d.filter(F.col("trial") == trial), d.filter(F.col("trial") == base), "nll", "macro", 20, "boot").first()
        assert all(abs(got[trial][c] - want[c]) < 1e-12 for c in ("delta", "lo", "hi")) and got[trial]["groups"] == 20


def test_a_curve_with_stored_totals_is_not_shuffled_to_join_them(spark):
    """the ranked rows were shuffled once more to meet a few totals."""
    rows = [(f"T{k % 3}", (k % 101) / 100, k % 4 > 0, 0.5, 0.5, None, None) for k in range(900)] + [(None, 0.5, True, 0.1, 0.1, None, None)]
    s = spark.createDataFrame(rows, "trial string, conf double, ok boolean, nll double, brier double, mae double, rps double")
    kept, shuffles = [], []
    for stored in (False, True):
        c = M.risk_curve(s, ["trial"], stored)
        kept.append(sorted((tuple(r) for r in c.select("trial", "conf", "n", "cum_n", "cum_errors", "coverage", "risk").collect()), key=str))
        shuffles.append(c._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
    assert kept[0] == kept[1] and len(kept[0]) == 304 and shuffles[1] < shuffles[0]
