"""Metrics over prediction rows (M): per-row scores, calibration error, selective prediction, stability, error review.

A prediction row has id, group_id, source, task, question, type, variant, keys[], label (zero-based), p[] and usually
logits[]. Confidence is rounded to six decimals before anything is ranked by it, so a metric group never has more than
1,000,001 distinct confidences: curves and calibration bins are computed from that histogram, not from the rows.
"""
from collections.abc import Mapping
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import spread
from ..functions import vectors as V
from ..session import settle

TOP_BINS = (0.9, 0.95, 0.99)
EDGES = tuple(i * 0.1 for i in range(11))   # left-closed bins; the last one is closed on both sides


def _lng(cond):
    return cond.cast("bigint")


def scored_rows(df):
    """Clean variants of knowable records."""
    return df.filter((F.col("variant") == "clean") & (F.col("source") != "unknowable"))


# ---- distributions -------------------------------------------------------------------------------------------------
def validate_distribution(df, answer="answer", keys="keys"):
    """V6: answers (map key->p) against the expected keys. Adds `reason` (null when valid), raw_probability_sum,
    zero_count and the renormalised, key-aligned `p`."""
    vals = F.map_values(answer)
    total = V.asum(vals)
    k = F.size(keys)
    reason = (F.when(F.array_sort(F.map_keys(answer)) != F.array_sort(keys), "keys_differ")
              .when(~F.forall(vals, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1)), "out_of_range")
              .when(F.abs(F.col("raw_probability_sum") - 1) > F.greatest(F.lit(1e-5), k * 0.005 + 1e-8), "sum_off"))
    out = df.withColumn("raw_probability_sum", total)
    out = out.withColumn("reason", reason).withColumn("zero_count", F.size(F.filter(vals, lambda x: x == 0)).cast("bigint"))
    aligned = F.transform(keys, lambda key: F.element_at(F.col(answer), key) / F.col("raw_probability_sum"))
    return out.withColumn("p", F.when(F.col("reason").isNull(), aligned))


def prediction_rows(records, answers):
    """M2: answers joined to their questions on (id, question); unmatched or invalid answers carry a reason."""
    a = answers.select("id", "question", "answer", F.lit(True).alias("_hit"))
    j = records.join(a, ["id", "question"], "full_outer")
    j = validate_distribution(j)
    missing = F.when(F.col("_hit").isNull(), "missing_answer").when(F.col("keys").isNull(), "unexpected_answer").otherwise(F.col("reason"))
    parent = F.coalesce(F.col("parent_id"), F.when(F.col("variant") == "clean", F.col("id")).otherwise(F.col("group_id")))
    return j.withColumn("reason", missing).withColumn("parent", parent).drop("_hit", "answer")


def normalize_answers(df):
    """M3: endpoint-style answers as distributions: a yes/no answer p becomes {false: 1-p, true: p}."""
    yn = F.map_from_arrays(F.array(F.lit("false"), F.lit("true")), F.array(1 - F.col("noul"), F.col("noul")))
    return df.withColumn("answer", F.when(F.col("type") == "noul", yn).otherwise(F.col("probabilities")))


def answers(df):
    """M4: the answer each question type reports, rounded half-even to four decimals."""
    k = F.size("p")
    mode = V.argmax0("p")
    top = F.array_max("p")
    spread_ = V.asum(F.transform("p", lambda x, i: x * F.abs(i - V.argmax0("p"))))
    conf = (F.when(F.col("type") == "choice", F.when(k == 1, 1.0).otherwise((top - 1.0 / k) / (1 - 1.0 / k)))
            .when(F.col("type") == "score", F.when(k == 1, 1.0).otherwise(1 - spread_ / (k - 1))))
    value = F.when(F.col("type") == "noul", V.at("p", F.lit(1))).when(F.col("type") == "score", V.mean_level("p"))
    return (df.withColumn("value", F.bround(value, 4)).withColumn("confidence", F.bround(conf, 4))
            .withColumn("choice", F.when(F.col("type") == "choice", V.at("keys", mode))))


def temper(df, temperature):
    """M5: rows as a predictor calibrated at `temperature` returns them. T=1 keeps the recorded p."""
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    z = F.col("logits") if "logits" in df.columns else V.floor_log("p")
    out = df.withColumn("logits", V.let(F.array_max(z), lambda m: F.transform(z, lambda x: (x - m) / t)))
    out = out.withColumn("p", F.when(t == 1.0, F.col("p")).otherwise(V.softmax("logits")))
    return out.withColumn("inference_temperature", F.coalesce(F.col("inference_temperature"), F.lit(1.0)) * t)


def raw(df):
    """M5: undo the recorded inference temperature. Needs logits."""
    if "logits" not in df.columns:
        raise ValueError("raw rows cannot be restored without logits")
    t = F.coalesce(F.col("inference_temperature"), F.lit(1.0))
    out = df.withColumn("logits", F.transform("logits", lambda x: x * t))
    return out.withColumn("p", F.when(t == 1.0, F.col("p")).otherwise(V.softmax("logits"))).withColumn("inference_temperature", F.lit(1.0))


def row_scores(df):
    """M6: additive quantities of every row."""
    nll = V.nll_logits("logits", "label") if "logits" in df.columns else V.nll_probs("p", "label")
    is_score = F.col("type") == "score"
    out = (df.withColumn("ok", V.argmax0("p") == F.col("label")).withColumn("conf", F.array_max("p"))
           .withColumn("nll", nll).withColumn("brier", V.brier("p", "label"))
           .withColumn("mae", F.when(is_score, F.abs(V.mean_level("p") - F.col("label"))))
           .withColumn("rps", F.when(is_score, V.rps("p", "label"))))
    return (out.withColumn("confident_error", (F.col("conf") >= 0.9) & ~F.col("ok"))
            .withColumn("confidence_bias", F.col("conf") - F.col("ok").cast("double")))


# ---- calibration error and curves ----------------------------------------------------------------------------------
def ece_bin(conf, bins=10):
    """Bin number by explicit edges, not by flooring."""
    c = F.col(conf) if isinstance(conf, str) else conf
    return reduce(lambda acc, e: acc + F.when(c >= F.lit(e), 1).otherwise(0),
                  [i * (1.0 / bins) if bins != 10 else EDGES[i] for i in range(1, bins)], F.lit(0))


def histogram(scored, by):
    """Sufficient statistics per (group, confidence): one map-side-combined shuffle of the rows."""
    return scored.groupBy(*by, "conf").agg(
        F.count(F.lit(1)).alias("n"), F.sum(_lng(~F.col("ok"))).alias("errors"), F.sum("nll").alias("s_nll"),
        F.sum("brier").alias("s_brier"), F.sum("mae").alias("s_mae"), F.sum("rps").alias("s_rps"), F.count("mae").alias("n_score"))


def ece_from_bins(binned, by):
    """Sum over bins of |accuracy - confidence| weighted by share; `binned` has (by, bin, n, correct, s_conf)."""
    return binned.groupBy(*by).agg((F.sum(F.abs(F.col("correct") - F.col("s_conf"))) / F.sum("n")).alias("ece"))


def ece(scored, by):
    """M7."""
    b = scored.groupBy(*by, ece_bin("conf").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("double")).alias("correct"), F.sum("conf").alias("s_conf"))
    return ece_from_bins(b, by)


def risk_curve(scored, by, stored=False):
    """Per distinct confidence, whole ties accepted together: accepted, errors, coverage, risk. `stored` settles the totals per
    group and step of confidence, for large inputs."""
    return _curve(histogram(scored, by), by, stored)


def _curve(hist, by, stored=False):
    c = spread.running_totals(hist, by, "conf", F.floor(F.col("conf") * 1000), ["n", "errors"], descending=True, stored=stored)
    return (c.withColumn("threshold", F.col("conf")).withColumn("accepted", F.col("cum_n")).withColumn("cum_err", F.col("cum_errors"))
            .withColumn("coverage", F.col("cum_n") / F.col("tot_n")).withColumn("risk", F.col("cum_errors") / F.col("cum_n")))


def coverage_expr(budget):
    """M11 over a curve: the largest accepted share whose errors stay within the budget."""
    return F.coalesce(F.max(F.when(F.col("cum_errors") <= F.lit(float(budget)) * F.col("cum_n"), F.col("cum_n"))), F.lit(0)) / F.max("tot_n")


def aurc_expr():
    """M11 over a curve: right-step integral over whole confidence groups."""
    return F.sum(F.col("n") * F.col("cum_errors") / F.col("cum_n")) / F.max("tot_n")


def selective_exprs(fraction, tag):
    """M9 over a curve: rows at or above the confidence of the ceil(fraction*n)-th row."""
    inside = (F.col("cum_n") - F.col("n")) < F.greatest(F.ceil(F.col("tot_n") * F.lit(float(fraction))), F.lit(1))
    n = F.sum(F.when(inside, F.col("n")))
    return [(n / F.max("tot_n")).alias(f"coverage_{tag}"), (F.sum(F.when(inside, F.col("n") - F.col("errors"))) / n).alias(f"accuracy_{tag}"),
            F.min(F.when(inside, F.col("conf"))).alias(f"cutoff_{tag}")]


def selective(scored, by, fractions):
    return _curve(histogram(scored, by), by).groupBy(*by).agg(*[e for tag, f in fractions.items() for e in selective_exprs(f, tag)])


def metrics(scored, by):
    """M8: the full metric block per group from one histogram. `by` may be empty."""
    if not by:
        if not scored.isStreaming and scored.isEmpty():
            raise ValueError("metrics of an empty population")
        return metrics(scored.withColumn("_all", F.lit(0)), ["_all"]).drop("_all")
    hist = settle(histogram(scored, by))         # totals, curve and bins need different columns: from a plan each would score the rows again
    high = [F.col("conf") >= t for t in TOP_BINS]
    n = F.sum("n")
    n_score = F.sum("n_score")

    def share(cond, num):
        return F.sum(F.when(cond, num)) / F.sum(F.when(cond, F.col("n")))
    aggs = [n.alias("n"), (F.sum("s_nll") / n).alias("nll"), (1 - F.sum("errors") / n).alias("acc"), (F.sum("s_brier") / n).alias("brier"),
            (F.sum(F.col("conf") * F.col("n")) / n).alias("mean_conf"),
            (F.sum(F.when(high[0], F.col("errors")).otherwise(0)) / n).alias("confident_error_rate"),
            (F.sum(F.when(high[0], F.col("n")).otherwise(0)) / n).alias("coverage_at_0_9"),
            share(high[0], F.col("n") - F.col("errors")).alias("accuracy_at_0_9"), share(high[0], F.col("errors")).alias("error_rate_at_0_9"),
            coverage_expr(0.05).alias("coverage_at_5pct_error"), coverage_expr(0.01).alias("coverage_at_1pct_error"), aurc_expr().alias("aurc"),
            (F.sum(F.col("conf") * F.col("n")) / n - (1 - F.sum("errors") / n)).alias("confidence_bias"),
            (F.sum("s_mae") / F.nullif(n_score, F.lit(0))).alias("score_mae"), (F.sum("s_rps") / F.nullif(n_score, F.lit(0))).alias("rps")]
    for t, cond in zip(TOP_BINS, high):
        tag = str(t)[2:]
        aggs += [F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(f"top_{tag}_n"), F.sum(F.when(cond, F.col("errors")).otherwise(0)).alias(f"top_{tag}_errors"),
                 share(cond, F.col("errors")).alias(f"top_{tag}_rate")]
    for tag, f in (("50", 0.5), ("80", 0.8)):
        aggs += selective_exprs(f, tag)
    block = _curve(hist, by).groupBy(*by).agg(*aggs)
    bins = hist.groupBy(*by, ece_bin("conf").alias("bin")).agg(
        F.sum("n").alias("n"), F.sum((F.col("n") - F.col("errors")).cast("double")).alias("correct"), F.sum(F.col("conf") * F.col("n")).alias("s_conf"))
    return spread.join_keys(block, ece_from_bins(bins, by), by)


def select_threshold(scored, by, budget, min_accepted=1):
    """The lowest confidence on the curve within the error budget; null means abstain on everything."""
    c = _curve(histogram(scored, by), by)
    fits = (F.col("cum_errors") <= F.lit(float(budget)) * F.col("cum_n")) & (F.col("cum_n") >= min_accepted)
    return c.groupBy(*by).agg(F.min(F.when(fits, F.col("conf"))).alias("cut"))


def apply_threshold(scored, by, cuts):
    """A fixed threshold per group applied to another table."""
    j = scored.join(spread.counted_broadcast(cuts, 200), by)      # one row per group
    took = F.coalesce(F.col("conf") >= F.col("cut"), F.lit(False))
    out = j.groupBy(*by).agg(F.max("cut").alias("cut"), F.count(F.lit(1)).alias("n"), F.sum(_lng(took)).alias("accepted"),
                             F.sum(_lng(took & ~F.col("ok"))).alias("errors"))
    return out.withColumn("coverage", F.col("accepted") / F.col("n")).withColumn("risk", F.col("errors") / F.nullif(F.col("accepted"), F.lit(0)))


def input_guards(df, confidence="confidence", correct="correct", budget="budget"):
    """Rows whose inputs a curve must refuse. Reasons are exploded, not filtered: a filter moves below the projections that make its
    inputs and repeats them at every mention."""
    c, b = F.col(confidence), F.col(budget)
    reason = (F.when(c.isNull() | F.isnan(c) | (c < 0) | (c > 1), "confidence").when(F.col(correct).isNull() | ~F.col(correct).isin(0, 1), "correctness")
              .when(b.isNull() | F.isnan(b) | (b < 0) | (b > 1), "budget"))
    return df.withColumn("reason", F.explode(F.array_compact(F.array(reason))))


# ---- report blocks -------------------------------------------------------------------------------------------------
def objective(scored):
    """Minus the macro mean over tasks of nll, evidence-removed tasks left out (their controls stay)."""
    keep = ~F.col("task").startswith("unknowable_") | F.col("task").startswith("unknowable_control")
    per = scored.filter(keep).groupBy("task").agg(F.avg("nll").alias("nll"))
    return per.agg((-F.avg("nll")).alias("objective"), F.count(F.lit(1)).alias("tasks"))


def summarize(rows, temperature=1.0, heldout_sources=()):
    """The blocks of an evaluation as tables: objective, clean, tasks, variants, heldout_tasks (tasks of sources the scored
    model never trained on), permutation, unknowable, calibrated_clean (at `temperature`), paired_flip (where rows have pairs) and
    counts of odd distributions (where rows carry them). An empty clean population is refused. A metric block stores its
    histogram, so a block is made when it is first asked for."""
    clean = rows.filter(F.col("variant") == "clean")
    knowable = scored_rows(rows)
    if knowable.isEmpty():
        raise ValueError("there are no clean rows to summarize")
    scored = row_scores(clean)
    out = {"objective": lambda: objective(scored), "clean": lambda: metrics(row_scores(knowable), []), "tasks": lambda: metrics(scored, ["task"]),
           "variants": lambda: metrics(row_scores(rows), ["variant"]),
           "heldout_tasks": lambda: metrics(scored.filter(F.col("source").isin(*heldout_sources)), ["task"]) if heldout_sources else None,
           "permutation": lambda: permutation_stability(clean, rows.filter(F.col("variant") == "permuted")),
           "calibrated_clean": lambda: metrics(row_scores(temper(knowable, temperature)), [])}
    if "control_id" in rows.columns:
        out["unknowable"] = lambda: unknowable_report(clean)
    if "pair_id" in rows.columns:
        out["paired_flip"] = lambda: paired_flip(clean)
    if {"raw_probability_sum", "zero_count"} <= set(rows.columns):
        out["counts"] = lambda: rows.agg(F.sum(_lng(F.abs(F.col("raw_probability_sum") - 1) > 1e-5)).alias("raw_sums_outside_1e_5"), F.sum("zero_count").alias("returned_zeros"))
    return Blocks(out)


class Blocks(Mapping):
    """Named tables, each made once, when it is first asked for."""

    def __init__(self, makers):
        self._makers, self._made = makers, {}

    def __getitem__(self, name):
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self):
        return iter(self._makers)

    def __len__(self):
        return len(self._makers)


def permutation_stability(clean, permuted):
    """Permuted rows against their clean parent, probabilities realigned by option key."""
    c = clean.select(F.col("id").alias("parent"), "question", F.col("keys").alias("c_keys"), F.col("p").alias("c_p"))
    j = permuted.filter(F.col("type") == "choice").join(c, ["parent", "question"])
    j = j.withColumn("aligned", V.realign("p", "keys", "c_keys"))
    return j.agg(F.count(F.lit(1)).alias("n"), F.avg(V.max_abs_delta("aligned", "c_p")).alias("mean_max_delta"),
                 F.avg((V.argmax0("aligned") != V.argmax0("c_p")).cast("double")).alias("flip_rate"))


def order_stability(runs, by=("task",)):
    """runs = (id, question, order_no, keys, p, truth). Flip rate of the top option and spread of the correct one."""
    top = V.at("keys", V.argmax0("p"))
    right = F.element_at(F.col("p"), F.array_position("keys", F.col("truth")).cast("int"))
    per = runs.groupBy(*by, "id", "question").agg((F.min(top) != F.max(top)).alias("flip"), (F.max(right) - F.min(right)).alias("gap"))
    per = settle(per)                                           # read by quantiles and by means
    q = spread.spread_quantiles(per, list(by), "gap", {"p90_spread": 0.9}, F.floor(F.col("_v") * 1000))
    m = per.groupBy(*by).agg(F.avg(F.col("flip").cast("double")).alias("flip_rate"), F.avg("gap").alias("mean_spread"))
    return spread.join_keys(q, m, list(by))


def rotation_average(runs, field="logits", floor=1e-12):
    """Mean logit (or mean floored log p) per option over the rotations of one question, then softmax.
    A question has at most as many rotations as options, so the collected list is bounded."""
    z = F.col("logits") if field == "logits" else V.floor_log("p", floor)
    base = runs.withColumn("canon", F.array_sort("keys"))
    base = base.withColumn("z", V.let(z, lambda v: F.transform("canon", lambda k: F.element_at(v, F.array_position("keys", k).cast("int")))))
    g = base.groupBy("id", "task").agg(F.array_sort(F.collect_list(F.struct("rotation", "z"))).alias("rs"), F.first("canon").alias("keys"))
    total = F.aggregate(F.slice(F.col("rs"), F.lit(2), F.size("rs")), F.element_at("rs", 1)["z"], lambda a, r: F.zip_with(a, r["z"], lambda x, y: x + y))
    g = g.withColumn("rotations", F.size("rs").cast("bigint")).withColumn("logits", V.let(total, lambda t: F.transform(t, lambda x: x / F.col("rotations"))))
    return g.withColumn("p", V.softmax("logits")).drop("rs")


def pair_table(rows):
    """One row per (pair, question) with both siblings' prediction and truth keys, and a reason when it is not a pair."""
    pred, truth = V.at("keys", V.argmax0("p")), V.at("keys", "label")
    r = rows.select("pair_id", "question", "sibling", pred.alias("pred"), truth.alias("truth"))
    g = r.groupBy("pair_id", "question").agg(
        F.count(F.lit(1)).alias("n"), F.sum(_lng(F.col("sibling") == "a")).alias("n_a"), F.sum(_lng(F.col("sibling") == "b")).alias("n_b"),
        *[F.max(F.when(F.col("sibling") == s, F.col(c))).alias(f"{c}_{s}") for c in ("pred", "truth") for s in "ab"])
    reason = F.when((F.col("n_a") > 1) | (F.col("n_b") > 1), "duplicate_sibling").when((F.col("n_a") != 1) | (F.col("n_b") != 1), "incomplete_pair")
    return g.withColumn("reason", reason)


def paired_flip(rows):
    """M18 over complete pairs; `errors` counts duplicate or incomplete ones (the caller refuses when it is not zero)."""
    g = pair_table(rows)
    good, rel = F.col("reason").isNull(), F.col("truth_a") != F.col("truth_b")
    both = (F.col("pred_a") == F.col("truth_a")) & (F.col("pred_b") == F.col("truth_b"))

    def rate(cond, event):
        return F.avg(F.when(cond, event.cast("double")))
    return g.groupBy("question").agg(
        F.sum(_lng(~good)).alias("errors"), F.sum(_lng(good & rel)).alias("pairs"),
        rate(good & rel, F.col("pred_a") != F.col("pred_b")).alias("flip_rate"), rate(good & rel, both).alias("both_correct_rate"),
        F.sum(_lng(good & ~rel)).alias("invariant_pairs"), rate(good & ~rel, F.col("pred_a") == F.col("pred_b")).alias("invariance_rate"),
        rate(good & ~rel, both).alias("invariant_both_correct_rate"))


def unknowable_report(rows, by=("task",)):
    """Confidence where the deciding evidence was removed, against the intact controls."""
    top = F.array_max("p")
    u = rows.filter(F.col("source") == "unknowable").select(*by, "question", F.col("control_id").alias("cid"), top.alias("u"))
    c = rows.filter(F.col("source") == "unknowable_control").select(
        *by, "question", F.col("id").alias("cid"), top.alias("c"), (V.argmax0("p") == F.col("label")).alias("ok"))
    d = lambda x: x.cast("double")
    uu = u.join(c.drop("ok"), [*by, "question", "cid"], "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("u").alias("mean_max_p"), F.avg(d(F.col("u") >= 0.9)).alias("share_at_0_9"),
        F.avg(F.col("c") - F.col("u")).alias("paired_confidence_drop"), F.avg(d(F.col("u") < F.col("c"))).alias("share_less_confident"))
    cc = c.groupBy(*by).agg(F.avg("c").alias("control_mean_max_p"), F.avg(d(F.col("c") >= 0.9)).alias("control_share_at_0_9"), F.avg(d(F.col("ok"))).alias("control_acc"))
    return uu.join(cc, list(by), "left")


def none_diagnostics(rows, none_key="none_of_these"):
    """Probability of the none-option where it is wrong (present) and right (absent)."""
    pn = F.element_at(F.col("p"), F.array_position("keys", F.lit(none_key)).cast("int"))
    pick = V.at("keys", V.argmax0("p"))
    r = rows.select("variant", pn.alias("pn"), (V.argmax0("p") == F.col("label")).alias("ok"), (pick == none_key).alias("picks"))
    return r.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"), F.avg("pn").alias("mean_p_none"), F.avg((F.col("pn") > 0.5).cast("double")).alias("p_none_above_half"),
        F.avg(F.col("ok").cast("double")).alias("acc"), F.avg(F.col("picks").cast("double")).alias("picks_none_rate"))


def iia_shift(base, extended):
    """Change of the log-odds between the two top options after an irrelevant one is added."""
    b = base.select("id", "question", F.col("keys").alias("k0"), F.col("p").alias("p0"))
    j = extended.select("id", "question", "keys", "p").join(b, ["id", "question"])
    # highest probability first, ties in option order
    rank = F.array_sort(F.transform("p0", lambda x, i: F.struct((-x).alias("s"), i.alias("i"))))
    j = j.withColumn("top", rank).withColumn("p1", V.realign("p", "keys", "k0"))
    lo = lambda p: F.log(F.greatest(V.at(p, F.col("top")[0]["i"]), F.lit(1e-6))) - F.log(F.greatest(V.at(p, F.col("top")[1]["i"]), F.lit(1e-6)))
    j = j.withColumn("shift", lo("p1") - lo("p0")).withColumn("size", F.abs("shift")).withColumn("_g", F.lit(0))
    q = spread.spread_quantiles(j, ["_g"], "size", {"p90_abs_shift": 0.9})
    m = j.groupBy("_g").agg(F.avg("size").alias("mean_abs_shift"), F.avg("shift").alias("mean_shift"))
    return spread.join_keys(q, m, ["_g"]).drop("_g")


def isolation_deltas(runs, base="alone", others=("packed", "sibling", "repeated"), limit=0.001):
    """runs = (id, question, condition, p). The same question asked under several conditions."""
    g = runs.groupBy("id", "question").agg(*[F.max(F.when(F.col("condition") == c, F.col("p"))).alias(c) for c in (base, *others)])
    flat = g.select("question", F.inline(F.array(*[
        F.struct(F.lit(c).alias("comparison"), V.max_abs_delta(base, c).alias("delta"), (V.argmax0(c) != V.argmax0(base)).alias("flip")) for c in others])))
    return flat.groupBy("comparison").agg(F.count(F.lit(1)).alias("n"), F.max("delta").alias("max_delta"), F.sum(_lng(F.col("flip"))).alias("argmax_flips")) \
        .withColumn("passed", F.col("max_delta") < limit)


def probe_summary(runs, truth_key):
    """Probability of the probed answer per condition."""
    pv = F.element_at(F.col("p"), F.array_position("keys", F.lit(truth_key)).cast("int"))
    return runs.groupBy("condition").agg(F.avg(pv).alias("mean_p"), F.min(pv).alias("min_p"), F.max(pv).alias("max_p"))


def nll_floor_sensitivity(df, floors=(1e-3, 1e-6, 1e-9)):
    """Macro-over-task mean nll at several probability floors, in one pass over the rows."""
    py = V.at("p", "label")
    per = df.filter(F.col("variant") == "clean").groupBy("task").agg(*[F.avg(-F.log(F.greatest(py, F.lit(f)))).alias(f"f{i}") for i, f in enumerate(floors)])
    macro = per.agg(*[F.avg(f"f{i}").alias(f"f{i}") for i in range(len(floors))])
    return macro.select(F.inline(F.array(*[F.struct(F.lit(float(f)).alias("floor"), F.col(f"f{i}").alias("nll")) for i, f in enumerate(floors)])))


def loss_columns(df, smoothing=0.1, brier_w=1.0, gamma=2.0, ord_w=1.0):
    """Training losses per row; `teacher` (p of another model), `target` and `perm_p` are optional aligned arrays."""
    lp = F.transform("p", lambda x: F.log(x))
    ce = -V.at(lp, "label")
    out = df.withColumn("ce", ce)
    out = out.withColumn("smoothed", (1 - smoothing) * F.col("ce") + smoothing * -V.asum(lp) / F.size("p"))
    out = out.withColumn("ce_brier", F.col("ce") + brier_w * V.brier("p", "label"))
    out = out.withColumn("focal", F.pow(1 - F.exp(-F.col("ce")), F.lit(float(gamma))) * F.col("ce"))
    out = out.withColumn("ordinal", F.col("ce") + F.when(F.col("type") == "score", ord_w * V.rps("p", "label")).otherwise(0.0))
    if "target" in df.columns:
        out = out.withColumn("soft", -V.asum(F.zip_with("target", "p", lambda t, x: t * F.log(x))))
    if "teacher" in df.columns:
        t = F.transform("teacher", lambda x: F.greatest(x, F.lit(1e-6)))
        t = V.let(t, lambda a: V.let(V.asum(a), lambda s: F.transform(a, lambda x: x / s)))
        kl = V.asum(F.zip_with(t, "p", lambda a, x: a * (F.log(a) - F.log(x))))
        same = F.array_sort("teacher_keys") == F.array_sort("keys") if "teacher_keys" in df.columns else F.lit(True)
        out = out.withColumn("anchor_kl", F.when(same, kl))
    if "perm_p" in df.columns:
        sym = V.asum(F.zip_with("p", "perm_p", lambda a, b: 0.5 * (a - b) * (F.log(a) - F.log(b))))
        out = out.withColumn("permutation_kl", sym)
    return out


def equal_case_agreement(records, rows):
    """records = (id, case_id, target[]); rows = (id, p[]) for the answered ones. Averages inside a case first."""
    j = records.join(rows.select("id", "p"), "id", "left")
    agree = (V.argmax0("p") == V.argmax0("target")).cast("double")
    tvd = V.asum(F.zip_with("p", "target", lambda a, b: F.abs(a - b))) / 2
    j = j.withColumn("agree", agree).withColumn("tvd", tvd)
    per = j.groupBy("case_id").agg(
        F.count("p").alias("n_ans"), F.count(F.lit(1)).alias("n_all"), F.avg("agree").alias("a1"), F.avg("tvd").alias("t1"),
        F.avg(F.coalesce("agree", F.lit(0.0))).alias("a2"), F.avg(F.coalesce("tvd", F.lit(1.0))).alias("t2"))
    wide = per.agg(F.sum("n_ans").alias("r1"), F.count(F.when(F.col("n_ans") > 0, 1)).alias("c1"), F.avg("a1").alias("a1"), F.avg("t1").alias("t1"),
                   F.sum("n_all").alias("r2"), F.count(F.lit(1)).alias("c2"), F.avg("a2").alias("a2"), F.avg("t2").alias("t2"))
    return wide.select(F.inline(F.array(*[F.struct(F.lit(name).alias("population"), F.col(f"r{i}").alias("rows"), F.col(f"c{i}").alias("cases"),
                                                   F.col(f"a{i}").alias("agreement"), F.col(f"t{i}").alias("tvd")) for i, name in ((1, "evaluated"), (2, "all_rows"))])))


def accuracy_by_length(df, buckets, size="size"):
    """Accuracy per size bucket [lo, hi)."""
    name = reduce(lambda acc, b: acc.when((F.col(size) >= b[0]) & (F.col(size) < b[1]), f"{b[0]}-{b[1]}"), buckets[1:],
                  F.when((F.col(size) >= buckets[0][0]) & (F.col(size) < buckets[0][1]), f"{buckets[0][0]}-{buckets[0][1]}"))
    # sizes outside all buckets are left out after the sums: a filter before them would measure every text twice
    return df.withColumn("bucket", name).groupBy("bucket").agg(F.count("bucket").alias("n"), F.avg(F.col("ok").cast("double")).alias("acc")).filter("n > 0")


def tie_and_zero_audit(scored, by=("task",), budget=0.05):
    """The largest confidence tie, zero probabilities, confident errors, and the coverage an order-dependent rule
    would have reported (its best and worst case, because it depends on row order inside a tie)."""
    by = list(by)
    h = scored.withColumn("zeros", F.size(F.filter("p", lambda x: x == 0)).cast("bigint")).groupBy(*by, "conf").agg(
        F.count(F.lit(1)).alias("n"), F.sum(_lng(~F.col("ok"))).alias("errors"), F.sum("zeros").alias("zeros"),
        F.sum(_lng(F.col("confident_error"))).alias("ce"))
    c = _curve(h, by)
    prev_n, prev_e = F.col("cum_n") - F.col("n"), F.col("cum_errors") - F.col("errors")
    # correct rows first inside a tie: all correct ones, then as many errors as the budget still allows
    best = F.greatest(F.least(F.floor(((prev_n + F.col("n") - F.col("errors")) * budget - prev_e * 1.0) / (1 - budget) + 1e-9), F.col("errors")), F.lit(0))
    fits = prev_e <= F.lit(budget) * (prev_n + F.col("n") - F.col("errors"))
    return c.groupBy(*by).agg(
        F.max("n").alias("largest_tie"), F.sum("zeros").alias("zero_probabilities"), F.sum("ce").alias("confident_errors"), coverage_expr(budget).alias("whole_tie_coverage"),
        (F.coalesce(F.max(F.when(fits, prev_n + F.col("n") - F.col("errors") + best)), F.lit(0)) / F.max("tot_n")).alias("best_order_coverage"))


def failure_packet(scored, seed="audit", threshold=0.9):
    """Every confident error and one matched correct confident row of the same (task, option count), without
    replacement. Returns (blind table, key table); case names come from a digest, so they reveal nothing."""
    s = scored.filter(F.col("conf") >= threshold).withColumn("k", F.size("keys").cast("bigint"))
    s = s.withColumn("o", F.sha2(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"), F.col("question")), 256))
    e = spread.spread_rank(s.filter(~F.col("ok")), ["task", "k"], ["o"], spread.hash_bucket("o"))
    c = spread.spread_rank(s.filter(F.col("ok")), ["task", "k"], ["o"], spread.hash_bucket("o"))
    cols = ["id", "question", "task", "k", "rank", "o", "keys", "label", "p"]
    matched = c.select(*cols).join(e.select("task", "k", "rank"), ["task", "k", "rank"], "left_semi")
    both = e.select(*cols, F.lit("confident_error").alias("kind")).unionByName(matched.select(*cols, F.lit("matched_correct").alias("kind")))
    both = both.withColumn("case", F.substring(F.sha2(F.concat_ws(":", F.lit("case"), F.col("o")), 256), 1, 12))
    key = both.select("case", "kind", "id", "question", "task", V.at("keys", "label").alias("label"), V.at("keys", V.argmax0("p")).alias("prediction"))
    return both.select("case", "id", "question", "task", "k"), key


def top_errors(scored, limit=60):
    """The wrong rows, most confident first (a top-k report)."""
    return scored.filter(~F.col("ok")).orderBy(F.col("conf").desc(), "id", "question").limit(limit)


def accuracy_by_source(scored):
    """Per source and over ALL; the total comes from the per-source, per-bin sums, not from a second scan."""
    b = scored.groupBy("source", ece_bin("conf").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("double")).alias("correct"), F.sum("conf").alias("s_conf"), F.sum("nll").alias("s_nll"),
        F.sum("mae").alias("s_mae"), F.count("mae").alias("n_mae"))
    cols = ["n", "correct", "s_conf", "s_nll", "s_mae", "n_mae"]
    r = b.select("*", F.explode(F.array(F.col("source"), F.lit("ALL"))).alias("scope")).groupBy("scope", "bin").agg(*[F.sum(c).alias(c) for c in cols])
    n = F.sum("n")
    return r.groupBy("scope").agg(n.alias("n"), (F.sum("correct") / n).alias("acc"), (F.sum(F.abs(F.col("correct") - F.col("s_conf"))) / n).alias("ece"),
                                  (F.sum("s_nll") / n).alias("nll"), (F.sum("s_conf") / n).alias("mean_conf"),
                                  (F.sum("s_mae") / F.nullif(F.sum("n_mae"), F.lit(0))).alias("score_mae"))


# ---- predictors ----------------------------------------------------------------------------------------------------
SCORED_SCHEMA = "id bigint, question string, reject_reason string, p array<double>, logits array<double>, latency_ms double, tokens bigint"
_DOUBLES = pa.list_(pa.float64())
SCORED = pa.schema([("id", pa.int64()), ("question", pa.string()), ("reject_reason", pa.string()), ("p", _DOUBLES), ("logits", _DOUBLES), ("latency_ms", pa.float64()), ("tokens", pa.int64())])


def score_batch(records, make_predictor):
    """Score records with a predictor built once per Python worker partition. A predictor takes a pandas batch and
    returns one row per question with p, optional logits, latency, tokens, or a reject_reason. Batches cross as Arrow, because
    mapInPandas converts arrays element by element."""
    def run(batches):
        predictor = make_predictor()
        for batch in batches:
            yield pa.RecordBatch.from_pandas(predictor(batch.to_pandas()), schema=SCORED, preserve_index=False)
    return records.mapInArrow(run, SCORED_SCHEMA)


def coverage_counters(scored):
    """M1: requested / evaluated / rejected and latency quantiles."""
    s = scored.withColumn("_g", F.lit(0))
    n = s.groupBy("_g").agg(F.count(F.lit(1)).alias("requested"), F.count("p").alias("evaluated"),
                            F.count("reject_reason").alias("rejected"), F.sum("tokens").alias("tokens"))
    q = spread.spread_quantiles(s.filter(F.col("p").isNotNull()), ["_g"], "latency_ms", {"median_ms": 0.5, "p95_ms": 0.95}).drop("n")
    return spread.join_keys(n, q, ["_g"]).drop("_g")


def hash_predictor(model="A", bonus=1.2, max_tokens=None):
    """A predictor for tests and demos: logits from digests of the question, no model."""
    import hashlib

    import numpy as np

    def make():
        def score(batch):
            ids, questions, keys = batch["id"].tolist(), batch["question"].tolist(), batch["keys"].tolist()
            size = np.fromiter(map(len, keys), np.int64, len(keys))
            tokens = size + np.fromiter((len(str(i)) for i in ids), np.int64, len(ids))
            late = tokens > max_tokens if max_tokens is not None else np.zeros(len(ids), bool)
            heads = [hashlib.sha256(f"{model}:{i}:{q}:{k}".encode()).digest()[:4] for i, q, ks in zip(ids, questions, keys) for k in ks]
            at = np.arange(size.max(initial=0))
            there = at < size[:, None]
            z = np.full(there.shape, -np.inf)
            z[there] = np.frombuffer(b"".join(heads), ">u4") % 6000 / 1000.0
            z += np.where(at == batch["label"].to_numpy()[:, None], bonus, 0.0)
            e = np.exp(z - z.max(axis=1, keepdims=True))
            p = e / e.sum(axis=1, keepdims=True)
            rows = lambda a: [None if gone else x[:n] for gone, x, n in zip(late.tolist(), a, size.tolist())]
            return pd.DataFrame({"id": batch["id"], "question": questions, "reject_reason": np.where(late, "too_long", None), "p": rows(p), "logits": rows(z),
                                 "latency_ms": np.where(late, np.nan, tokens * 3 % 17), "tokens": tokens})
        return score
    return make
