"""Temperature fits, folds and the group bootstrap (C).

Scale notes. A grid fit never keeps row x temperature pairs: they are summed map-side to one number per (group, temperature).
The bootstrap works on per-unit sums; a draw is a multiplicity of each unit (see `draws`), so rows are never resampled.
"""
import math
from functools import reduce
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..functions import spread
from ..functions import vectors as V
from ..functions.text import sha
from ..session import settle
from . import draws
from . import scoring as M
from .splits import grouped_folds


def grid(points=81):
    """Log grid over 0.25..4."""
    lo, hi = math.log(0.25), math.log(4.0)
    return [math.exp(lo + i * (hi - lo) / (points - 1)) for i in range(points)]


def _batch_losses(by, temperatures):
    """Arrow batches of (*by, logits, label, weight) become one row per group of the batch and grid position."""
    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table.filter(pc.is_valid(table.column("_z")))
            if not table.num_rows:
                continue
            group, first = draws._codes(table, by)
            z = table.column("_z").combine_chunks()
            sizes = z.value_lengths().to_numpy(zero_copy_only=False)
            wide = np.full((len(sizes), max(1, int(sizes.max()))), -np.inf)
            wide[np.arange(wide.shape[1]) < sizes[:, None]] = z.flatten().to_numpy(zero_copy_only=False)
            wide -= wide.max(axis=1, keepdims=True)
            y = wide[np.arange(len(sizes)), table.column("label").to_numpy().astype(np.int64)]
            w = table.column("_w").to_numpy()
            losses = np.empty((len(first), len(temperatures)))
            for i, t in enumerate(temperatures):
                losses[:, i] = np.bincount(group, weights=w * (np.log(np.exp(wide / t).sum(axis=1)) - y / t), minlength=len(first))
            weights = np.bincount(group, weights=w, minlength=len(first))
            at = np.repeat(np.arange(len(first)), len(temperatures))
            keys = table.select(by).take(pa.array(first)).take(pa.array(at)).combine_chunks()
            yield pa.RecordBatch.from_arrays([*[keys.column(c).combine_chunks() for c in by], pa.array(np.tile(np.arange(len(temperatures)), len(first)), pa.int64()), pa.array(losses.ravel()), pa.array(weights[at])], [*by, "ti", "loss", "w"])
    return run


def grid_losses(df, by, points=81, weight=None):
    """Summed (weighted) nll and weight per (group, grid position). Every batch of rows is summed where it is read, so only
    groups x positions are shuffled. Rows served at a temperature are refused inside the plan."""
    by, temperatures = list(by), grid(points)
    z = F.col("logits")
    if "inference_temperature" in df.columns:
        z = F.when(F.coalesce(F.col("inference_temperature"), F.lit(1.0)) != 1.0, F.raise_error(F.lit("fit temperature on raw logits"))).otherwise(z)
    rows = df.select(*by, z.alias("_z"), "label", (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("_w"))
    schema = rows.select(*by).schema.add("ti", "long").add("loss", "double").add("w", "double")
    summed = rows.mapInArrow(_batch_losses(by, temperatures), schema).groupBy(*by, "ti").agg(F.sum("loss").alias("loss"), F.sum("w").alias("w"))
    return summed.withColumn("t", F.element_at(F.array(*[F.lit(t) for t in temperatures]), (F.col("ti") + 1).cast("int")))


def _best(losses, by, value):
    """First grid position with the smallest loss."""
    return losses.groupBy(*by).agg(F.min_by("t", F.struct(value, F.col("ti"))).alias("temperature"), F.min(value).alias("loss"), F.max("w").alias("w"))


def fit_temperature(df, aggregation="micro", points=81, by=(), weight=None):
    """Temperature with the smallest mean nll, every row equal (micro) or every task equal (macro)."""
    by = list(by)
    if not by:
        return fit_temperature(df.withColumn("_all", F.lit(0)), aggregation, points, ["_all"], weight).drop("_all")
    clean = M.scored_rows(df)
    if aggregation == "macro":
        per = grid_losses(clean, [*by, "task"], points).withColumn("mean", F.col("loss") / F.col("w"))
        losses = per.groupBy(*by, "ti", "t").agg(F.avg("mean").alias("mean"), F.sum("w").alias("w"))
    elif aggregation == "micro":
        losses = grid_losses(clean, by, points, weight).withColumn("mean", F.col("loss") / F.col("w"))
    else:
        raise ValueError("aggregation must be micro or macro")
    return _best(losses, by, F.col("mean"))


def temper_by(df, temperatures, by):
    """Rows tempered by a per-group temperature; groups without one keep T=1. The table has one row per group."""
    j = df.join(spread.counted_broadcast(temperatures.select(*by, "temperature"), 200), list(by), "left") if by else df.crossJoin(F.broadcast(temperatures.select("temperature")))   # one-row side
    return M.temper(j.withColumn("_t", F.coalesce("temperature", F.lit(1.0))), F.col("_t")).drop("_t", "temperature")


def even_odd_report(df, points=81, position="id"):
    """Fitted on the even records, reported on the odd ones before and after."""
    t = fit_temperature(df.filter(F.col(position) % 2 == 0), "micro", points)
    held = M.scored_rows(df).filter(F.col(position) % 2 == 1)
    arms = held.withColumn("arm", F.lit("before")).unionByName(temper_by(held, t, ()).withColumn("arm", F.lit("after")))
    s = M.row_scores(arms)
    nll = s.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg("nll").alias("nll"))
    return nll.join(M.ece(s, ["arm"]), "arm").crossJoin(F.broadcast(t.select("temperature")))   # one-row side


def fit_temperature_by_group(df, points=81, least=30):
    """One temperature per (type, option count capped at 6); groups under 30 rows get 1.0."""
    d = df.withColumn("k", F.least(F.size("keys"), F.lit(6)).cast("bigint"))
    f = fit_temperature(d, "micro", points, ["type", "k"])
    return f.withColumn("n", F.col("w").cast("bigint")).withColumn("temperature", F.when(F.col("w") < least, 1.0).otherwise(F.col("temperature"))).drop("w", "loss")


def fold_temperatures(df, folds, seed, aggregation="micro", points=81, weight=None, stored=False):
    """(rows with fold, temperature per fold fitted on the other folds). The grid is summed once per (fold, task); a
    fold's complement is the total minus its own sums, weighted by the column `weight` if it is named. `stored` rows are settled with their fold, for callers that
    read all their columns again."""
    rows = grouped_folds(M.scored_rows(df), folds, seed)
    rows = settle(rows) if stored else rows
    per = grid_losses(rows, ["fold", "task"], points, weight)
    total = per.groupBy("task", "ti", "t").agg(F.sum("loss").alias("tl"), F.sum("w").alias("tw"))
    pairs = total.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(folds - 1).cast("bigint"))))
    own = per.select("fold", "task", "ti", "loss", "w")
    comp = pairs.join(own, ["fold", "task", "ti"], "left").select(
        "fold", "task", "ti", "t", (F.col("tl") - F.coalesce("loss", F.lit(0.0))).alias("loss"), (F.col("tw") - F.coalesce("w", F.lit(0.0))).alias("w")).filter(F.col("w") > 0)
    if aggregation == "macro":
        mean = comp.groupBy("fold", "ti", "t").agg(F.avg(F.col("loss") / F.col("w")).alias("mean"), F.sum("w").alias("w"))
    else:
        mean = comp.groupBy("fold", "ti", "t").agg((F.sum("loss") / F.sum("w")).alias("mean"), F.sum("w").alias("w"))
    return rows, _best(mean, ["fold"], F.col("mean"))


def out_of_fold(df, folds=5, seed="cv", aggregation="micro", points=81):
    """Every row tempered with the temperature of the folds it is not in."""
    rows, temps = fold_temperatures(df, folds, seed, aggregation, points)
    return temper_by(rows, temps, ["fold"]), temps


# ---- bootstrap -----------------------------------------------------------------------------------------------------
KEY = ["id", "question"]


def pairing_violations(a, b):
    """Why two prediction tables cannot be paired (must be empty): duplicates, missing examples, different labels,
    option order or metadata."""
    def side(df, tag):
        meta = F.struct("source", "group_id", "task", "type")
        return M.scored_rows(df).groupBy(*KEY).agg(F.count(F.lit(1)).alias(f"n_{tag}"), F.max("label").alias(f"label_{tag}"), F.max("keys").alias(f"keys_{tag}"), F.max(meta).alias(f"meta_{tag}"))
    j = side(a, "a").join(side(b, "b"), KEY, "full_outer")
    reason = (F.when(F.col("n_a").isNull() | F.col("n_b").isNull(), "missing").when((F.col("n_a") > 1) | (F.col("n_b") > 1), "duplicate")
              .when((F.col("label_a") != F.col("label_b")) | (F.col("keys_a") != F.col("keys_b")), "labels_differ").when(F.col("meta_a") != F.col("meta_b"), "metadata_differs"))
    return j.select(*KEY, reason.alias("reason")).filter(F.col("reason").isNotNull())


def resampling_units(df, seed, strata="source", group="group_id"):
    """Distinct (stratum, group) with a rank inside its stratum and the stratum size."""
    u = df.select(strata, group).distinct().withColumn("_o", sha(F.lit(seed), F.col(strata), F.col(group)))
    return settle(spread.spread_rank(u, [strata], ["_o"], spread.hash_bucket("_o"), "unit", total="units").drop("_o"))


ARMS = ("candidate", "reference")


class Metric(NamedTuple):
    """What the bootstrap needs to know about a metric. kind `additive`: `expr` gives a row's value, the metric is its mean.
    kind `bins`: the calibration error. kind `curve`: `expr` is an aggregate over the risk-coverage curve columns (conf, n,
    errors, cum_n, cum_errors, tot_n), recomputed in every draw; `draw`, if given, does the same for whole blocks of samples."""
    name: str
    kind: str
    expr: Callable = None
    draw: Callable = None


METRICS = {}


def register_metric(name, kind, expr=None, draw=None):
    if kind not in ("additive", "bins", "curve"):
        raise ValueError(f"unsupported metric kind: {kind}")
    METRICS[name] = Metric(name, kind, expr, draw)
    return METRICS[name]


def _flag(c):
    return c.cast("double")


register_metric("acc", "additive", lambda: _flag(F.col("ok")))
register_metric("nll", "additive", lambda: F.col("nll"))
register_metric("brier", "additive", lambda: F.col("brier"))
register_metric("mean_conf", "additive", lambda: F.col("conf"))
register_metric("confident_error_rate", "additive", lambda: _flag(F.col("confident_error")))
register_metric("coverage_at_0_9", "additive", lambda: _flag(F.col("conf") >= 0.9))
register_metric("confidence_bias", "additive", lambda: F.col("confidence_bias"))
register_metric("ece", "bins")
register_metric("aurc", "curve", M.aurc_expr, draws.area)
register_metric("coverage_at_5pct_error", "curve", lambda: M.coverage_expr(0.05), draws.coverage(0.05))
register_metric("coverage_at_1pct_error", "curve", lambda: M.coverage_expr(0.01), draws.coverage(0.01))


def _metric(name):
    if name not in METRICS:
        raise ValueError(f"unsupported bootstrap metric: {name}")
    return METRICS[name]


def _statistic(df, by, metric):
    """Value of one metric per group from the sums of _sums."""
    m = _metric(metric)
    if m.kind == "additive":
        return df.groupBy(*by).agg((F.sum("x") / F.sum("n")).alias("v"))
    if m.kind == "bins":
        b = df.groupBy(*by, "bin").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        return b.groupBy(*by).agg((F.sum(F.abs("x")) / F.sum("n")).alias("v"))
    h = df.groupBy(*by, "conf").agg(F.sum("n").alias("n"), F.sum("x").alias("errors"))
    curve = spread.running_totals(h, by, "conf", F.floor(F.col("conf") * 100), ["n", "errors"], descending=True)
    return curve.groupBy(*by).agg(m.expr().alias("v"))


def _sums(scored, keys, metric):
    """Per unit and task: the sufficient sums of a metric (arm kept as a column)."""
    m = _metric(metric)
    if m.kind == "additive":
        return scored.groupBy(*keys).agg(F.sum(m.expr()).alias("x"), F.count(F.lit(1)).alias("n"))
    if m.kind == "bins":
        return scored.groupBy(*keys, M.ece_bin("conf").alias("bin")).agg(F.sum(F.col("ok").cast("double") - F.col("conf")).alias("x"), F.count(F.lit(1)).alias("n"))
    return scored.groupBy(*keys, "conf").agg(F.sum((~F.col("ok")).cast("bigint")).alias("x"), F.count(F.lit(1)).alias("n"))


def _delta(stat, by, arms=ARMS):
    p = stat.groupBy(*by, "part").agg(*[F.max(F.when(F.col("arm") == a, F.col("v"))).alias(a) for a in arms])
    return p.groupBy(*by).agg(F.avg(F.col(arms[0]) - F.col(arms[1])).alias("delta"))


KEEP = ["source", "group_id", "task", "ok", "conf", "nll", "brier", "confident_error", "confidence_bias"]


def interval(c):
    """Percentile interval over the drawn samples (one value per sample; sample -1 is the point estimate)."""
    v = F.when(F.col("s") >= 0, F.col(c))
    return [F.percentile(v, F.lit(0.025)).alias(f"{c}_lo"), F.percentile(v, F.lit(0.975)).alias(f"{c}_hi")]


def bootstrap_arms(both, metric, samples, seed, by=(), aggregation="macro"):
    """Point delta and percentile interval per `by` for scored rows with `arm` (candidate/reference) and `part` columns. All
    pairs share the draws; the resampled units are those of the reference rows."""
    return bootstrap_sums(settle(_sums(both, [*by, "source", "group_id", "arm", "part"], metric)), metric, samples, seed, by, aggregation)


def bootstrap_sums(sums, metric, samples, seed, by=(), aggregation="macro"):
    """`bootstrap_arms` from the settled sums of `_sums`, which may come in several rows per unit and arm."""
    by = list(by)
    units = resampling_units(sums.filter(F.col("arm") == "reference"), seed)
    return interval_row(drawn_values(sums, units, metric, samples, seed, [*by, "arm", "part"]), units, samples, by)


def drawn_values(sums, units, metric, samples, seed, keys):
    """(s, *keys, v): the metric of every sample from the sums of `_sums`."""
    m = _metric(metric)
    stat = draws.curve_per_draw(sums, units, samples, seed, keys, m.draw) if m.draw else None
    return _drawn_statistic(sums, units, metric, samples, seed, keys) if stat is None else stat


def _drawn_statistic(sums, units, metric, samples, seed, keys):
    within = {"additive": [], "bins": ["bin"], "curve": ["conf"]}[_metric(metric).kind]
    return _statistic(draws.sums_per_draw(sums, units, samples, seed, [*keys, *within], ["x", "n"]), ["s", *keys], metric)


def _statistics(both, metrics, samples, seed, by):
    """(units, {metric: its values in every sample}) of `bootstrap_arms` for several metrics: additive ones are summed and drawn as columns
    of one table, curves share their ranks and totals."""
    by, unit = list(by), [*by, "source", "group_id", "arm", "part"]
    keys, kind = [*by, "arm", "part"], lambda k: [m for m in dict.fromkeys(metrics) if _metric(m).kind == k]
    additive, curves, stats, units = kind("additive"), [m for m in kind("curve") if _metric(m).draw], {}, None
    drawn_from = lambda sums: units or resampling_units(sums.filter(F.col("arm") == "reference"), seed)
    if additive:
        sums = settle(both.groupBy(*unit).agg(*[F.sum(_metric(m).expr()).alias(f"x_{m}") for m in additive], F.count(F.lit(1)).alias("n")))
        units = drawn_from(sums)
        drawn = draws.sums_per_draw(sums, units, samples, seed, keys, [*[f"x_{m}" for m in additive], "n"])
        drawn = settle(drawn) if len(additive) > 1 else drawn
        stats.update({m: _statistic(drawn.select("s", *keys, F.col(f"x_{m}").alias("x"), "n"), [*by, "s", "arm", "part"], m) for m in additive})
    if curves:
        sums = settle(_sums(both, unit, curves[0]))                                # the same for every curve
        units = drawn_from(sums)
        drawn = draws.curves_per_draw(sums, units, samples, seed, keys, [_metric(m).draw for m in curves])
        stats.update({m: d for m, d in zip(curves, drawn) if d is not None})
    for m in metrics:
        if m not in stats:
            sums = settle(_sums(both, unit, m))
            units = drawn_from(sums)
            stats[m] = _drawn_statistic(sums, units, m, samples, seed, keys)
    return units, stats


def interval_row(stat, units, samples, by):
    """Point delta and percentile interval per `by` from the values (s, *by, arm, part, v) of every sample."""
    d = _delta(stat, [*by, "s"])
    out = d.groupBy(*by).agg(F.max(F.when(F.col("s") < 0, F.col("delta"))).alias("delta"), *interval("delta"))
    n = units.agg(F.count(F.lit(1)).alias("groups"))
    return out.crossJoin(F.broadcast(n)).withColumnRenamed("delta_lo", "lo").withColumnRenamed("delta_hi", "hi") \
        .withColumn("samples", F.lit(samples).cast("bigint"))                                # one-row side


def arm_rows(a, b, aggregation, *extra):
    both = M.row_scores(M.scored_rows(a)).select(*KEEP, *extra, F.lit("candidate").alias("arm")).unionByName(
        M.row_scores(M.scored_rows(b)).select(*KEEP, *extra, F.lit("reference").alias("arm")))
    return both.withColumn("part", F.col("task") if aggregation == "macro" else F.lit("all"))


def paired_bootstrap(a, b, metric="nll", aggregation="macro", samples=1000, seed="boot"):
    """Candidate minus reference with a percentile interval. Groups are resampled inside each source, so sibling
    questions move together; additive metrics average, the others are recomputed per draw from (confidence, error)
    histograms; macro is the mean of per-task deltas. Check pairing_violations first."""
    return _paired(arm_rows(a, b, aggregation), metric, aggregation, samples, seed)


def _paired(both, metric, aggregation, samples, seed):
    return _paired_row(bootstrap_arms(both, metric, samples, seed, aggregation=aggregation), metric, aggregation)


def _paired_all(both, metrics, aggregation, samples, seed):
    """One row of `_paired` per metric."""
    units, stats = _statistics(both, metrics, samples, seed, ())
    parts = [_paired_row(interval_row(stats[m], units, samples, []), m, aggregation) for m in metrics]
    return reduce(lambda x, y: x.unionByName(y), parts)


def _paired_row(out, metric, aggregation):
    return out.withColumn("metric", F.lit(metric)).withColumn("aggregation", F.lit(aggregation)).select("metric", "aggregation", "delta", "lo", "hi", "samples", "groups")


def cross_validated_temperature(df, folds=5, seed="cv", samples=1000, aggregation="micro", points=81):
    """C4: raw and out-of-fold metric `blocks` and the `interval` row. The interval is the ECE of both arms and their difference over
    group resamples; `separated` when the difference excludes zero. Rows meet their fold once, with what is scored of them; blocks and
    interval store sums of their own, so each is made when it is first asked for."""
    cols = ["source", "group_id", "task", "type", "label", "p", "logits"]
    served = ["variant", *(["inference_temperature"] if "inference_temperature" in df.columns else [])]      # what scored rows and fits ask for
    rows, temps = fold_temperatures(df.select(*cols, *served), folds, seed, aggregation, points, stored=True)
    oof = temper_by(rows, temps, ["fold"])
    scored = M.row_scores(rows.select(*cols, F.lit("raw").alias("arm")).unionByName(oof.select(*cols, F.lit("out_of_fold").alias("arm"))))
    return M.Blocks({"blocks": lambda: M.metrics(scored, ["arm"]), "interval": lambda: ece_interval(scored, samples, seed)})


def ece_interval(scored, samples, seed, arms=("raw", "out_of_fold")):
    sums = settle(_sums(scored, ["source", "group_id", "arm"], "ece"))
    units = resampling_units(sums.filter(F.col("arm") == arms[0]), seed)
    drawn = draws.sums_per_draw(sums, units, samples, seed, ["arm", "bin"], ["x", "n"])
    v = _statistic(drawn, ["s", "arm"], "ece").groupBy("s").agg(*[F.max(F.when(F.col("arm") == x, F.col("v"))).alias(x) for x in arms])
    v = v.withColumn("delta", F.col(arms[1]) - F.col(arms[0]))
    out = v.agg(*[e for c in (*arms, "delta") for e in interval(c)])
    return out.withColumn("separated", (F.col("delta_hi") < 0) | (F.col("delta_lo") > 0))


def workload_arms(df, folds=5, seed="cv", points=121):
    """Rows of the four arms raw / shipped / workload / workload_oof, with an `arm` column."""
    served = M.scored_rows(df)
    restored = M.raw(served)
    t = fit_temperature(restored, "micro", points)
    oof, _ = out_of_fold(restored, folds, seed, "micro", points)
    cols = ["id", "question", "source", "group_id", "task", "type", "label", "keys", "p", "logits", "variant"]
    arm = lambda d, n: d.select(*cols, F.lit(n).alias("arm"))
    return arm(restored, "raw").unionByName(arm(served, "shipped")).unionByName(arm(temper_by(restored, t, ()), "workload")).unionByName(arm(oof, "workload_oof"))


def workload_intervals(arms, samples=1000, seed="cv", metrics=("ece", "brier", "coverage_at_5pct_error", "aurc")):
    """workload_oof minus shipped with paired group-bootstrap intervals, one row per metric. `arms` should be settled."""
    side = lambda name: arms.filter(F.col("arm") == name).drop("arm")
    both = settle(arm_rows(side("workload_oof"), side("shipped"), "micro"))        # scored once for all metrics
    return _paired_all(both, metrics, "micro", samples, seed)


def workload_report(arms):
    """Metric block per arm; accuracy is the same in all of them (`accuracy_changed` is false)."""
    b = M.metrics(M.row_scores(arms), ["arm"])
    base = b.filter(F.col("arm") == "raw").select(F.col("acc").alias("_acc"))
    return b.crossJoin(F.broadcast(base)).withColumn("accuracy_changed", F.abs(F.col("acc") - F.col("_acc")) > 1e-12).drop("_acc")   # one-row side


# ---- episode-weighted panels ---------------------------------------------------------------------------------------
def episode_weights(df, panel=(), episode="parent", name="weight"):
    """1 / windows of the episode inside the panel, by an aggregate and a join (no window over a hot episode)."""
    n = df.groupBy(*panel, episode).agg((1.0 / F.count(F.lit(1))).alias(name))
    return df.join(n, [*panel, episode])


def group_sufficient_stats(scored, keys, weight="weight"):
    """Per group: weighted counts of accuracy, nll, brier and ten bins of weighted (accuracy - confidence)."""
    w = F.col(weight)
    ok = F.col("ok").cast("double")
    b = M.ece_bin("conf")
    return scored.withColumn("_b", b).groupBy(*keys).agg(
        F.sum(w).alias("w"), F.sum(w * ok).alias("acc"), F.sum(w * F.col("nll")).alias("nll"), F.sum(w * F.col("brier")).alias("brier"),
        *[F.sum(F.when(F.col("_b") == i, w * (ok - F.col("conf"))).otherwise(0.0)).alias(f"b{i}") for i in range(10)])


BINS = [f"b{i}" for i in range(10)]


def summarize_stats(stats, by):
    """Weighted accuracy, nll, brier and ECE per `by` from group sums."""
    tot = stats.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("w", "acc", "nll", "brier", *BINS)])
    e = sum((F.abs(F.col(c)) for c in BINS[1:]), F.abs(F.col("b0")))
    return tot.select(*by, *[(F.col(c) / F.col("w")).alias(c) for c in ("acc", "nll", "brier")], (e / F.col("w")).alias("ece"))


def panel_rows(df):
    """One row per panel a window belongs to: view x regime(all, own) x length(all, 1-2 or 3+ transactions)."""
    return (df.withColumn("p_regime", F.explode(F.array(F.lit("all"), F.col("regime"))))
            .withColumn("p_length", F.explode(F.array(F.lit("all"), F.when(F.col("n_requests") <= 2, "transactions_1_2").otherwise("transactions_3_plus"))))
            .withColumn("panel", F.concat_ws("/", "view", "p_regime", "p_length")).drop("p_regime", "p_length"))


def panel_counts(df):
    """Windows, episodes and groups per panel, and the histogram of transactions per window."""
    p = panel_rows(df)
    c = p.groupBy("panel").agg(F.count(F.lit(1)).alias("windows"), F.countDistinct("parent").alias("episodes"), F.countDistinct("group_id").alias("groups"))
    hist = p.groupBy("panel", "n_requests").agg(F.count(F.lit(1)).alias("n"))
    return c, hist


def paired_panels(parent, candidate, samples, seed="panel", metrics=("acc", "nll", "brier", "ece")):
    """Per panel and metric: both models and candidate minus parent with group-bootstrap intervals. Inputs are scored
    window rows; all sources and views of a group move together."""
    def stats(df, arm):
        p = episode_weights(panel_rows(df), ["panel"])
        return group_sufficient_stats(p, ["panel", "group_id"]).withColumn("arm", F.lit(arm))
    both = settle(stats(parent, "parent").unionByName(stats(candidate, "candidate")))
    units = resampling_units(both.filter(F.col("arm") == "parent"), seed, strata="panel")
    drawn = draws.sums_per_draw(both, units, samples, seed, ["panel", "arm"], ["w", "acc", "nll", "brier", *BINS], strata="panel")
    arr = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])
    flat = summarize_stats(drawn, ["s", "panel", "arm"]).select("s", "panel", "arm", F.inline(arr))
    wide = flat.groupBy("s", "panel", "metric").agg(*[F.max(F.when(F.col("arm") == a, F.col("v"))).alias(a) for a in ("parent", "candidate")]).withColumn("delta", F.col("candidate") - F.col("parent"))
    return wide.groupBy("panel", "metric").agg(*[F.max(F.when(F.col("s") < 0, F.col(c))).alias(c) for c in ("parent", "candidate", "delta")], *[e for c in ("parent", "candidate", "delta") for e in interval(c)])


def episode_temperature(df, points=121):
    """Macro fit with the episode as the task, on full views of the calibration split: each row weighs 1/windows, so the
    grid is summed to one number per temperature."""
    full = df.filter((F.col("variant") == "clean") & (F.col("split") == "calibration"))
    return fit_temperature(episode_weights(full), "micro", points, weight="weight")


def calibration_by_source(df, temperature):
    """C11: (episode-weighted raw and calibrated metrics per source, excluded views). `temperature` is a one-row table."""
    cal = df.filter(F.col("split") == "calibration")
    full = cal.filter(F.col("variant") == "clean")
    counts = full.groupBy("source").agg(F.count(F.lit(1)).alias("windows"), F.countDistinct("parent").alias("episodes"), F.countDistinct("group_id").alias("groups"),
                                        F.sum(F.conv(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 8), 16, 10).cast("bigint")).alias("ids_digest"))
    arms = full.withColumn("arm", F.lit("raw")).unionByName(temper_by(full, temperature, ()).withColumn("arm", F.lit("calibrated")))
    s = group_sufficient_stats(episode_weights(M.row_scores(arms), ["arm"]), ["arm", "source"])
    m = summarize_stats(s, ["arm", "source"])
    excluded = cal.filter(F.col("variant") != "clean").groupBy("variant").agg(F.count(F.lit(1)).alias("n"))
    return m.join(counts, "source"), excluded


def calibration_evidence(df, folds=5, seed="calibration", samples=1000, points=121):
    """C11: how far the fit can be trusted: (fold per group, temperature per fold, blocks, ECE interval) over the full views of the
    calibration split. Groups are kept whole across all sources. A fold's temperature gives every episode of the other folds
    the same weight, which is carried through the sums of the grid; blocks are raw and out of fold, weighted by windows and by
    episodes; the interval resamples groups and counts windows."""
    full = df.filter((F.col("variant") == "clean") & (F.col("split") == "calibration")).withColumn("source", F.lit("all"))
    rows, temperatures = fold_temperatures(episode_weights(full), folds, seed, "micro", points, "weight")
    temperatures = settle(temperatures.select("fold", "temperature"))
    tempered = temper_by(rows, temperatures, ["fold"])
    cols = ["id", "parent", "source", "group_id", "task", "type", "label", "keys", "p", "logits", "weight"]
    scored = settle(M.row_scores(rows.select(*cols, F.lit("raw").alias("arm")).unionByName(tempered.select(*cols, F.lit("out_of_fold").alias("arm")))))
    blocks = [summarize_stats(group_sufficient_stats(scored.withColumn("_w", w), ["arm"], "_w"), ["arm"]).withColumn("weighting", F.lit(name))
              for name, w in (("windows", F.lit(1.0)), ("episodes", F.col("weight")))]
    return rows.select("group_id", "fold").distinct(), temperatures, blocks[0].unionByName(blocks[1]), ece_interval(scored, samples, seed)


def join_predictions(expected, rows):
    """Every expected window with its prediction and the first violated contract (null = joined cleanly). Unexpected
    predictions appear with reason `unexpected`."""
    e = expected.select("id", F.col("keys").alias("e_keys"), F.col("label").alias("e_label"), F.struct("group_id", "parent", "source", "variant").alias("e_meta"), F.lit(True).alias("_e"))
    dup = rows.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("keys", "label", "p", "logits", F.struct("group_id", "parent", "source", "variant").alias("meta"))).alias("r"))
    j = e.join(dup, "id", "full_outer")
    p, z = F.col("r.p"), F.col("r.logits")
    reason = (F.when(F.col("_e").isNull(), "unexpected").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "duplicate")
              .when((F.col("r.keys") != F.col("e_keys")) | (F.col("r.label") != F.col("e_label")), "labels").when(F.col("r.meta") != F.col("e_meta"), "lineage")
              .when(z.isNull() | p.isNull() | (F.size(p) != F.size("e_keys")) | (F.size(z) != F.size(p)), "shape")
              .when(F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1)) | (F.abs(V.asum(p) - 1) > 1e-6), "distribution")
              .when(V.max_abs_delta(p, V.softmax(z)) > 1e-5, "logits_disagree"))
    return j.select("id", reason.alias("reason"), F.col("r.p").alias("p"), F.col("r.logits").alias("logits"))


def episode_lineage_audit(df, views=("clean", "prefix_loss", "sampled_loss")):
    """Findings (subject, code): duplicate ids, groups in two splits, windows of one episode that disagree on lineage,
    unknown views, windows without requests."""
    ids = df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").cast("string").alias("subject"), F.lit("duplicate_id").alias("code"))
    grp = df.groupBy("group_id").agg(F.min("split").alias("a"), F.max("split").alias("b")).filter("a <> b").select(F.col("group_id").cast("string").alias("subject"), F.lit("group_crosses_splits").alias("code"))
    lin = F.struct("split", "group_id", "regime", F.col("keys"), "label")
    ep = df.groupBy("parent").agg(F.min(lin).alias("a"), F.max(lin).alias("b")).filter("a <> b").select(F.col("parent").cast("string").alias("subject"), F.lit("episode_lineage").alias("code"))
    row = df.select(F.col("id").cast("string").alias("subject"), F.explode(F.array_compact(F.array(
        F.when(~F.col("variant").isin(*views), "unknown_view"), F.when(F.col("n_requests") < 1, "no_requests")))).alias("code"))
    return ids.unionByName(grp).unionByName(ep).unionByName(row)


def compare_deltas(a, b, suite_a, suite_b, samples=1000, seed="boot", metrics=("nll", "acc", "brier")):
    """C14: run a minus run b on the same suite: macro delta and group-bootstrap interval per metric."""
    if suite_a != suite_b:
        raise ValueError("the runs were scored on different suites")
    both = arm_rows(a, b, "macro")
    if any(_metric(m).kind != "additive" for m in metrics):
        both = settle(both)                                                        # scored once for all metrics; additive ones read it once
    return _paired_all(both, metrics, "macro", samples, seed)


def compare_runs(a, b, suite_a, suite_b):
    """C14: per-task blocks of two runs side by side. Refuses different suites."""
    if suite_a != suite_b:
        raise ValueError("the runs were scored on different suites")
    blk = lambda d, tag: M.row_scores(M.scored_rows(d)).groupBy("task").agg(F.avg(F.col("ok").cast("double")).alias(f"acc_{tag}"), F.avg("nll").alias(f"nll_{tag}"), F.avg("brier").alias(f"brier_{tag}"))
    return blk(a, "a").join(blk(b, "b"), "task")
