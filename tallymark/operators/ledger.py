"""Experiment ledger (L): trials, eligibility, leaderboards, gates, screens."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import spread
from ..session import settle
from . import calibrate as C
from . import scoring as M

# parameters that do not belong to a recipe (fixed values)
INFRA_KEYS = ("base", "seed", "base_revision", "dtype", "checkpointing", "batch", "accum", "perm_frac")
HOURLY_RATE = 3.95
# screening thresholds (fixed values)
GATES = {"isolation": 0.001, "task_acc": 0.05, "variant_acc": 0.05, "flip": 0.05, "pairs_min": 0.7, "confident_errors_max": 0.1, "transfer_acc": 0.02, "transfer_brier": 0.02}
RESULT = ("config map<string,string>, suite_sha256 string, transfer_suite_sha256 string, legacy boolean, device string, wall_seconds double, clean struct<acc:double,nll:double,brier:double>, "
          "transfer struct<acc:double,brier:double,confident_error_rate:double,pairs:double>, gates map<string,boolean>")


def collect_trials(spark, path):
    """L1: result files below <study>/<trial>/ as flat rows; study and trial come from the path, cost only for GPU runs."""
    r = spark.read.schema(RESULT).option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn("_f", F.col("_metadata.file_path"))
    part = lambda name: F.regexp_extract("_f", rf"{name}=([^/]+)/", 1)
    return r.select(part("study").alias("study"), part("trial").alias("trial"), "legacy", F.col("config")["base"].alias("base"), F.col("config")["seed"].cast("bigint").alias("seed"), "config",
                    F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("config")))), 256).alias("config_sha256"), "suite_sha256", "transfer_suite_sha256",
                    F.col("clean.acc").alias("dev_acc"), F.col("clean.nll").alias("dev_nll"), F.col("clean.brier").alias("dev_brier"), F.col("transfer.acc").alias("transfer_acc"), F.col("transfer.brier").alias("transfer_brier"),
                    F.col("transfer.confident_error_rate").alias("transfer_conf_err"), F.col("transfer.pairs").alias("heldout_pairs"), "gates", F.forall(F.map_values("gates"), lambda g: g).alias("gates_passed"),
                    F.col("wall_seconds").alias("wall_s"), F.when(F.col("device") == "cuda", F.round(F.lit(HOURLY_RATE) * F.col("wall_seconds") / 3600, 2)).alias("est_usd"))


def eligible(trials, dev_digests, suite=None, transfer=None):
    """L2: complete, isolated, scored on transfer, not legacy, and on the same development bytes as the reference suites.
    dev_digests = (suite_sha256, dev_sha256), one row per frozen suite."""
    g = lambda k: F.coalesce(F.col("gates")[k], F.lit(False))
    ok = g("complete_coverage") & g("isolation_and_packing") & F.coalesce(F.col("gates")["transfer_complete"], F.lit(True)) & F.col("transfer_acc").isNotNull() & ~F.col("legacy")
    d = dev_digests.select("suite_sha256", F.col("dev_sha256").alias("_d"))
    t = trials.join(d, "suite_sha256", "left").join(d.select(F.col("suite_sha256").alias("transfer_suite_sha256"), F.col("_d").alias("_t")), "transfer_suite_sha256", "left")
    if suite is not None:
        want = dev_digests.filter(F.col("suite_sha256") == suite).agg(F.first("dev_sha256").alias("_ws"))
        t = t.crossJoin(F.broadcast(want))                                  # one-row side
        ok = ok & F.col("_d").eqNullSafe(F.col("_ws"))
    if transfer is not None:
        want = dev_digests.filter(F.col("suite_sha256") == transfer).agg(F.first("dev_sha256").alias("_wt"))
        t = t.crossJoin(F.broadcast(want))                                  # one-row side
        ok = ok & F.col("_t").eqNullSafe(F.col("_wt"))
    return t.withColumn("eligible", ok).select(*trials.columns, "eligible")


def leaderboard(trials):
    """L3: by transfer accuracy (missing last), then Brier, then nll. One row per trial."""
    order = [F.col("transfer_acc").desc_nulls_last(), F.coalesce("transfer_brier", F.lit(1.0)).asc(), F.coalesce("dev_nll", F.lit(9.0)).asc(), F.col("trial").asc()]
    return trials.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def recipe(config):
    """Digest of a config without its seed, keys sorted."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.filter(F.map_entries(config), lambda e: e["key"] != "seed")))), 256)


def incumbent(trials, history=None):
    """L4: champion per base over eligible trials: the latest ledger champion when all its trials are still eligible, else the
    recipe with at least two seeds, best mean transfer accuracy, then lowest Brier. history = (round, base, trials[])."""
    e = trials.filter("eligible").withColumn("recipe", recipe(F.col("config")))
    by = e.groupBy("base", "recipe").agg(F.countDistinct("seed").alias("seeds"), F.avg("transfer_acc").alias("transfer_acc"), F.avg("dev_acc").alias("dev_acc"), F.avg("transfer_brier").alias("brier"),
                                         F.array_sort(F.collect_set("trial")).alias("trials"))        # the seeds of one recipe
    best = F.struct((F.col("seeds") >= 2).alias("two"), F.col("transfer_acc").alias("acc"), (-F.col("brier")).alias("b"), F.col("recipe").alias("r"))
    w = Window.partitionBy("base")
    ranked = by.withColumn("_best", F.max(best).over(w))
    if history is None:
        return ranked.filter(F.col("_best.r") == F.col("recipe")).drop("_best")
    last = history.groupBy("base").agg(F.max_by("trials", "round").alias("champ"))
    champ = last.select("base", "champ", F.explode("champ").alias("trial")).join(e.select("base", "trial", "recipe"), ["base", "trial"], "left") \
        .groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.count("recipe").alias("ok"), F.min("recipe").alias("held"))
    ranked = ranked.join(champ, "base", "left").withColumn("_pick", F.when(F.col("n") == F.col("ok"), F.col("held")).otherwise(F.col("_best.r")))
    return ranked.filter(F.col("_pick") == F.col("recipe")).drop("_best", "_pick", "n", "ok", "held")


def challenge(champion_rows, challenger_rows, samples=1000, seed="boot", noninferiority=0.01):
    """The challenger is accepted when its macro accuracy delta is positive and the lower bound is at worst -1 point. A
    pair that cannot be paired is recorded as not accepted."""
    bad = C.pairing_violations(challenger_rows, champion_rows).limit(1).agg(F.count(F.lit(1)).alias("unpaired"))
    b = C.paired_bootstrap(challenger_rows, champion_rows, "acc", "macro", samples, seed)
    j = b.crossJoin(F.broadcast(bad))                                       # one-row sides
    return j.withColumn("accepted", (F.col("unpaired") == 0) & (F.col("delta") > 0) & (F.col("lo") >= -noninferiority))


def gate_report(metrics, baseline, extra):
    """Named gates of every trial against its baseline. metrics/baseline = long (trial | base_trial, kind, name, n, value)
    with kinds task_acc, variant_acc, flip, transfer_acc, transfer_brier; extra = per-trial booleans and rates: complete,
    isolated, transfer_complete, pairs, confident_errors. Missing or differently sized counterparts give a `mismatch` row."""
    j = metrics.join(baseline.select("trial", "kind", "name", F.col("n").alias("bn"), F.col("value").alias("bv")), ["trial", "kind", "name"], "full_outer")
    v, b = F.col("value"), F.col("bv")
    ok = (F.when(F.col("kind").isin("task_acc"), v >= b - GATES["task_acc"]).when(F.col("kind") == "variant_acc", v >= b - GATES["variant_acc"]).when(F.col("kind") == "flip", v <= b + GATES["flip"])
          .when(F.col("kind") == "transfer_acc", v >= b - GATES["transfer_acc"]).when(F.col("kind") == "transfer_brier", v <= b + GATES["transfer_brier"]))
    gate = (F.when(F.col("kind") == "task_acc", "no_task_accuracy_regression_over_5pp").when(F.col("kind") == "variant_acc", F.concat("name", F.lit("_not_worse"))).when(F.col("kind") == "flip", "permutation_not_worse")
            .when(F.col("kind") == "transfer_acc", "transfer_accuracy_not_worse").otherwise("transfer_brier_not_worse"))
    bad = v.isNull() | b.isNull() | (F.col("kind").isin("variant_acc", "flip") & (F.col("n") != F.col("bn")))
    rel = j.groupBy("trial", gate.alias("gate")).agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("passed"), F.max(bad).alias("mismatch"))
    own = extra.select("trial", F.inline(F.array(*[F.struct(F.lit(n).alias("gate"), c.alias("passed")) for n, c in (
        ("complete_coverage", F.col("complete")), ("isolation_and_packing", F.col("isolated")), ("transfer_complete", F.col("transfer_complete")),
        ("heldout_pairs_at_least_70pct", F.col("pairs") >= GATES["pairs_min"]), ("transfer_confident_errors_below_10pct", F.col("confident_errors") <= GATES["confident_errors_max"]))])))
    return rel.unionByName(own.withColumn("mismatch", F.lit(False)))


def study_baselines(trials):
    """The baseline of each trial: the first non-legacy trial (by name) of its (base, seed)."""
    first = trials.filter(~F.col("legacy")).groupBy("base", "seed").agg(F.min("trial").alias("baseline"))
    return trials.join(first, ["base", "seed"], "left").withColumn("is_baseline", F.col("trial").eqNullSafe(F.col("baseline")))


def paired_against(rows, pairs, metric, aggregation, samples, seed):
    """Bootstrap of many trials at once: pairs = (trial, baseline); all pairs share one set of draws. Every trial is scored and summed
    and drawn once; the pair list, one row per trial, meets its values of every sample."""
    pairs = settle(pairs.select("trial", "baseline"))
    few = lambda df: spread.counted_broadcast(df, 200)
    used = pairs.select(F.explode(F.array("trial", "baseline")).alias("trial")).distinct()
    s = M.row_scores(M.scored_rows(rows).join(few(used), "trial", "left_semi"))
    sums = settle(C._sums(s.withColumn("part", F.col("task") if aggregation == "macro" else F.lit("all")), ["trial", "source", "group_id", "part"], metric))
    units = C.resampling_units(sums.join(few(pairs.select(F.col("baseline").alias("trial")).distinct()), "trial", "left_semi"), seed)
    values = settle(C.drawn_values(sums, units, metric, samples, seed, ["trial", "part"]))                 # samples x trials x parts
    cand = values.join(few(pairs.select("trial")), "trial").withColumnRenamed("trial", "pair").withColumn("arm", F.lit("candidate"))
    ref = values.join(few(pairs.select(F.col("trial").alias("pair"), F.col("baseline").alias("trial"))), "trial").drop("trial").withColumn("arm", F.lit("reference"))
    return C.interval_row(cand.unionByName(ref), units, samples, ["pair"]).withColumnRenamed("pair", "trial")


def rank_study(trials, rows, gates, samples=1000, seed="boot"):
    """Later trials with gates and the paired nll interval against their baseline; a candidate passes every gate and its
    upper bound is below zero."""
    b = study_baselines(trials)
    pairs = b.filter(~F.col("legacy") & ~F.col("is_baseline")).select("trial", "baseline")
    ci = paired_against(rows, pairs, "nll", "macro", samples, seed).select("trial", "delta", "lo", "hi")
    g = gates.groupBy("trial").agg(F.bool_and("passed").alias("gates_passed"))
    out = b.join(ci, "trial", "left").join(g.withColumnRenamed("gates_passed", "gates_ok"), "trial", "left")
    return out.withColumn("candidate", F.coalesce(F.col("gates_ok") & (F.col("hi") < 0), F.lit(False)))


def release_check(trials):
    """Per recipe: at least two seeds and every trial through every gate; the failing gates are listed."""
    t = trials.withColumn("recipe", recipe(F.col("config")))
    failing = F.filter(F.map_keys("gates"), lambda k: ~F.col("gates")[k])
    g = t.groupBy("base", "recipe").agg(F.countDistinct("seed").alias("seeds"), F.bool_and("gates_passed").alias("passed"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(failing)))).alias("failing"))
    return g.withColumn("candidate", F.col("passed") & (F.col("seeds") >= 2))


def screen(arms, sources, controls, rule, tol=1e-12):
    """arms = (arm, ord, coverage, acc, aurc, nll); sources = (arm, source, acc). Every arm that is not a control is compared with
    every control (two or so rows); all checks must hold. Winners are ranked by coverage, aurc, nll, registration order."""
    ctl = arms.filter(F.col("arm").isin(*controls)).select(F.col("arm").alias("control"), F.col("coverage").alias("c_cov"), F.col("acc").alias("c_acc"), F.col("aurc").alias("c_aurc"))
    cand = arms.filter(~F.col("arm").isin(*controls))
    s = sources.select(F.col("arm"), "source", F.col("acc").alias("s_acc"))
    sc = s.filter(~F.col("arm").isin(*controls)).join(s.filter(F.col("arm").isin(*controls)).select(F.col("arm").alias("control"), "source", F.col("s_acc").alias("b_acc")), "source") \
        .groupBy("arm", "control").agg(F.bool_and(F.col("s_acc") - F.col("b_acc") >= rule["source"] - tol).alias("sources_ok"))
    j = cand.withColumn("control", F.explode(F.array(*[F.lit(c) for c in controls]))).join(ctl, "control").join(sc, ["arm", "control"])
    ok = ((F.col("coverage") - F.col("c_cov") >= rule["coverage"] - tol) & (F.col("acc") - F.col("c_acc") >= rule["acc"] - tol) & (F.col("aurc") - F.col("c_aurc") <= rule["aurc"] + tol) & F.col("sources_ok"))
    v = j.groupBy("arm").agg(F.bool_and(ok).alias("passes"))
    out = cand.join(v, "arm")
    place = F.row_number().over(Window.partitionBy("passes").orderBy(F.col("coverage").desc(), "aurc", "nll", "ord"))
    return out.withColumn("place", F.when(F.col("passes"), place).cast("bigint"))


def matched_arms_audit(arms, loss_keys, registered):
    """arms = (arm, config map, steps, tokens, records, digest): what differs besides the registered loss knobs."""
    rest = F.to_json(F.map_from_entries(F.array_sort(F.filter(F.map_entries("config"), lambda e: ~e["key"].isin(*loss_keys)))))
    loss = F.concat_ws(",", *[F.concat(F.lit(k + "="), F.coalesce(F.col("config")[k], F.lit("0"))) for k in loss_keys])
    a = arms.withColumn("_rest", rest).withColumn("_loss", loss)
    same = a.agg(*[F.countDistinct(c).alias(n) for c, n in (("_rest", "conditions"), ("steps", "steps"), ("tokens", "tokens"), ("records", "records"), ("digest", "digest"))])
    shared = same.select(F.lit("*").alias("arm"), F.explode(F.array_compact(F.array(*[F.when(F.col(n) > 1, f"{n}_differ") for n in ("conditions", "steps", "tokens", "records", "digest")]))).alias("finding"))
    reg = a.join(registered.select("arm", F.col("loss").alias("_want")), "arm", "left").filter(~F.col("_loss").eqNullSafe(F.col("_want"))).select("arm", F.lit("unregistered_loss").alias("finding"))
    return shared.unionByName(reg)


def knob_diff(trials, defaults):
    """Parameters of a trial that differ from the defaults (key, value) and are not infrastructure."""
    k = trials.select("trial", F.explode("config").alias("key", "value")).filter(~F.col("key").isin(*INFRA_KEYS))
    d = k.join(defaults, ["key", "value"], "left_anti")
    return d.groupBy("trial").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "key", "value"))), ",").alias("knobs"))


def study_readout(trials, task_acc, rows, reference, tasks, samples=1000, seed="boot"):
    """A wide row per trial: development, transfer, paired delta against the reference trial, one column per task, and the
    ship criteria."""
    wide = task_acc.groupBy("trial").pivot("task", list(tasks)).agg(F.max("acc"))
    ref = trials.filter(F.col("trial") == reference).select(F.col("transfer_acc").alias("r_acc"))
    pairs = trials.filter(F.col("trial") != reference).select("trial", F.lit(reference).alias("baseline"))
    ci = paired_against(rows, pairs, "acc", "macro", samples, seed).select("trial", "delta", "lo", "hi")
    j = trials.join(wide, "trial").join(ci, "trial", "left").crossJoin(F.broadcast(ref))                # one-row side
    j = j.withColumn("beats_ref_ci", F.col("lo") > 0).withColumn("acc_ge_ref", F.col("transfer_acc") >= F.col("r_acc")).withColumn("brier_ok", F.col("transfer_brier") <= 0.34)
    return j.withColumn("ship", F.coalesce(F.col("beats_ref_ci") & F.col("acc_ge_ref") & F.col("brier_ok"), F.lit(False))).drop("r_acc")


def file_hash_diff(a, b, evaluator=()):
    """Every file of two provenance tables (file, sha) as matching, changed or missing on one side; `refuse` marks a change in
    an evaluator file."""
    j = a.select("file", F.col("sha").alias("a")).join(b.select("file", F.col("sha").alias("b")), "file", "full_outer")
    status = F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").when(F.col("a") == F.col("b"), "matching").otherwise("changed")
    return j.select("file", status.alias("status")).withColumn("refuse", (F.col("status") != "matching") & F.col("file").isin(*evaluator))


def usage_accounting(calls, price, cap, by=("model",), at="at_ms", chunk=86400000):
    """Calls, tokens, retries and cost per model, and the first call whose running cost passes the cap. The running total
    is carried from day to day."""
    by = list(by)
    c = calls.withColumn("_o", F.struct(at, "call_id")).select(*by, "call_id", at, "tokens", "retries", "_o")
    r = spread.running_totals(c, by, "_o", F.floor(F.col(at) / chunk), ["tokens"])
    over = F.col("cum_tokens") * F.lit(price) / 1e6 > cap
    return r.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.sum("retries").alias("retries"), (F.sum("tokens") * F.lit(price) / 1e6).alias("cost"),
                              F.min_by("call_id", F.when(over, F.col("_o"))).alias("breach_call"), F.max(over).alias("breached"))
