"""Splits, samples and folds (P). Order is always a digest order, so a split does not depend on partitioning."""
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import spread
from ..functions.text import sha


def _ranked(df, by, salt, *parts):
    d = df.withColumn("_o", sha(*([F.lit(salt)] if salt is not None else []), *[F.col(p) for p in parts]))
    return spread.spread_rank(d, by, ["_o"], spread.hash_bucket("_o"), "_rk").drop("_o")


def _total(df, by=()):
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")) if by else df.agg(F.count(F.lit(1)).alias("_n"))


def split_by_state(df, f_cal, f_dev, seed, key="skey"):
    """Distinct states in seeded digest order: first round(n*dev) development, next round(n*cal) calibration, rest train."""
    keys = _ranked(df.select(key).distinct(), [], seed, key).crossJoin(F.broadcast(_total(df.select(key).distinct())))   # one-row side
    nd = F.bround(F.col("_n") * F.lit(float(f_dev)))
    nc = F.bround(F.col("_n") * F.lit(float(f_cal)))
    part = F.when(F.col("_rk") <= nd, "development").when(F.col("_rk") <= nd + nc, "calibration").otherwise("train")
    return df.join(keys.select(key, part.alias("split")), key)


def empty_partitions(df, splits, by="split"):
    """Names of expected partitions without rows (must be empty)."""
    want = df.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    return want.join(df.select(F.col(by).alias("split")).distinct(), "split", "left_anti")


def split_with_holdout(synthetic, real, seed, key="skey"):
    """Real rows half calibration, half development; synthetic rows train unless a real row has the same state."""
    r = split_by_state(real, 0.5, 0.5, seed, key).withColumn("split", F.when(F.col("split") == "development", "development").otherwise("calibration"))
    s = synthetic.join(real.select(key).distinct(), key, "left_anti").withColumn("split", F.lit("train"))
    return r.unionByName(s)


def carve_partitions(df, sizes, order="row_sha", holdout=()):
    """Inside each source the first `development` rows, then `test`, then `calibration`, the rest train; rows of a
    held-out source beyond the evaluation parts are not used."""
    ranked = spread.spread_rank(df, ["source"], [order], spread.hash_bucket(order), "_rk")
    d, t, c = sizes["development"], sizes["development"] + sizes["test"], sizes["development"] + sizes["test"] + sizes["calibration"]
    r = F.col("_rk")
    part = F.when(r <= d, "development").when(r <= t, "test")
    if holdout:
        part = part.when(F.col("source").isin(*holdout), None)
    return ranked.withColumn("split", part.when(r <= c, "calibration").otherwise("train")).drop("_rk").filter(F.col("split").isNotNull())


def calibration_groups_per_family(df, k, group="group_id", family="family", position="position"):
    """The first k whole groups of each family (by first position) calibrate; a family with <= k groups is reported."""
    g = df.groupBy(family, group).agg(F.min(position).alias("_p"))
    first = spread.first_n(g, [family], ["_p", group], k, spread.magnitude_bucket("_p", 256)).select(family, group)
    out = df.join(first.withColumn("_c", F.lit(True)), [family, group], "left")
    short = _total(g, [family]).filter(F.col("_n") <= k)
    return out.withColumn("split", F.when(F.col("_c"), "calibration").otherwise("train")).drop("_c"), short


def alternate_pairs(df, by, order, bucket):
    """P5: pairs alternate between development and test along `order` inside `by`."""
    p = spread.spread_rank(df.select(*by, "pair_id", *order).distinct(), by, order, bucket, "_rk")
    p = p.select("pair_id", F.when(F.col("_rk") % 2 == 1, "development").otherwise("test").alias("split"))
    return df.join(p, "pair_id")


def sample_groups_by_family(df, split, quota, salt, group="group_id", family="family"):
    """(rows, problems): the first `quota` groups per family in salted digest order, whole groups; problems are groups in
    two families, rows of another split, and families short of the quota."""
    g = df.groupBy(group).agg(F.min(family).alias(family), F.max(family).alias("_f2"), F.max(F.col("split") != split).alias("_wrong"))
    problems = g.filter((F.col(family) != F.col("_f2")) | F.col("_wrong")).select(
        F.col(group).cast("string").alias("subject"), F.when(F.col(family) != F.col("_f2"), "straddles_families").otherwise("wrong_split").alias("problem"))
    o = sha(F.lit(salt), F.lit(split), F.col(family), F.col(group))
    top = spread.first_n(g.withColumn("_o", o), [family], ["_o"], quota, spread.hash_bucket("_o"))
    short = _total(g, [family]).filter(F.col("_n") < quota).select(F.col(family).cast("string").alias("subject"), F.lit("underfilled").alias("problem"))
    return df.join(top.select(group), group, "left_semi"), problems.unionByName(short)


def sample_replay_groups(df, k, salt, fits="fits", group="group_id", source="source"):
    """(rows, rejected groups): k groups per source whose rows all fit, in digest order."""
    g = df.groupBy(source, group).agg(F.bool_and(fits).alias("_ok"))
    o = sha(F.lit(salt), F.col(source), F.col(group))
    top = spread.first_n(g.filter("_ok").withColumn("_o", o), [source], ["_o"], k, spread.hash_bucket("_o"))
    return df.join(top.select(source, group), [source, group], "left_semi"), g.filter(~F.col("_ok")).select(source, group)


def first_groups_per_source(df, k, group="group_id", source="source", position="position"):
    """Smoke subset: the first k units of each source; the test split is emptied."""
    d = df.filter(F.col("split") != "test")
    g = d.groupBy("split", source, group).agg(F.min(position).alias("_p"))
    top = spread.first_n(g, ["split", source], ["_p", group], k, spread.magnitude_bucket("_p", 256))
    return d.join(top.select("split", source, group), ["split", source, group], "left_semi")


def sample_whole_groups(df, n, salt, group="group_id"):
    """N groups in salted digest order (a top-n, so only n survive each map task), with all their rows."""
    top = df.select(group).distinct().withColumn("_o", sha(F.lit(salt), F.col(group))).orderBy("_o").limit(n)
    return df.join(top.select(group), group, "left_semi")


def grouped_folds(df, folds, seed, group="group_id", source="source"):
    """P10: fold per row, disjoint in (source, group). Units are numbered source by source in digest order, so round-robin
    continues from one source to the next and folds stay balanced."""
    units = df.select(source, group).distinct()
    ranked = _ranked(units, [source], seed, source, group)
    sizes = _total(units, [source])
    off = sizes.select(source, F.coalesce(F.sum("_n").over(Window.orderBy(source).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    fold = ((F.col("_rk") - 1 + F.col("_off")) % folds).cast("bigint")
    return df.join(ranked.join(off, source).select(source, group, fold.alias("fold")), [source, group])


def hash_fold(group, k=5):
    """First eight hex digits of a digest-valued group id, modulo k."""
    return (F.conv(F.substring(group, 1, 8), 16, 10).cast("bigint") % k).cast("bigint")


def audit_partitions(df, kept=None, row_id="id", group="group_id", family="family"):
    """Duplicate ids, groups in two splits or two families, groups half kept and half dropped."""
    ids = df.groupBy(row_id).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col(row_id).cast("string").alias("subject"), F.lit("duplicate_id").alias("problem"))
    aggs = [F.min(c).alias(f"lo_{c}") for c in ("split", family)] + [F.max(c).alias(f"hi_{c}") for c in ("split", family)]
    if kept:
        aggs += [F.min(F.col(kept).cast("int")).alias("lo_k"), F.max(F.col(kept).cast("int")).alias("hi_k")]
    g = df.groupBy(group).agg(*aggs)
    checks = [(F.col("lo_split") != F.col("hi_split"), "group_crosses_splits"), (F.col(f"lo_{family}") != F.col(f"hi_{family}"), "group_crosses_families")]
    if kept:
        checks.append((F.col("lo_k") != F.col("hi_k"), "group_half_kept"))
    codes = F.array_compact(F.array(*[F.when(cond, code) for cond, code in checks]))
    return ids.unionByName(g.select(F.col(group).cast("string").alias("subject"), F.explode(codes).alias("problem")))


def registered_filter(df, expected, flag, group="group_id"):
    """(kept rows, count differences, groups per source). `expected` has (source, rows); differences must be empty
    before the filter may be used."""
    got = df.groupBy("source").agg(F.count(F.lit(1)).alias("got"))
    diff = got.join(expected.select("source", F.col("rows").alias("want")), "source", "full_outer").filter(~F.col("got").eqNullSafe(F.col("want")))
    kept = df.filter(F.col(flag))
    return kept, diff, kept.select("source", group).distinct().groupBy("source").agg(F.count(F.lit(1)).alias("groups"))


def assemble_suite(public, arms, inherited):
    """(rows, unequal arms): public train/calibration plus equally large generated arms, development and test taken
    unchanged from another suite."""
    sizes = reduce(lambda a, b: a.unionByName(b), [df.groupBy("split").agg(F.count(F.lit(1)).alias("n")).withColumn("arm", F.lit(name)) for name, df in arms.items()])
    unequal = sizes.groupBy("split").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count(F.lit(1)).alias("arms")) \
        .filter((F.col("lo") != F.col("hi")) | (F.col("arms") != len(arms)))
    rows = public.filter(F.col("split").isin("train", "calibration")).withColumn("arm", F.lit("public"))
    for name, df in arms.items():
        rows = rows.unionByName(df.withColumn("arm", F.lit(name)))
    kept = inherited.filter(F.col("split").isin("development", "test")).withColumn("arm", F.lit("inherited"))
    return rows.unionByName(kept), unequal


GENERATED = ("public", "inherited")       # arms that are taken over; every other arm of a suite is generated


def suite_lineage(parents, row="id", key="skey"):
    """What a suite was made of: per parent and split the records and an order-free digest of their ids and states (count, sum
    and xor of row hashes), so that one aggregate per parent tells later whether it is still the same."""
    parts = []
    for name, df in parents.items():
        h = F.sha2(F.concat_ws(":", "split", F.col(row).cast("string"), key), 256)
        num, tail = (F.conv(F.substring(h, at, 12), 16, 10).cast("bigint") for at in (1, 13))
        parts.append(df.groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.sum(num.cast("decimal(38,0)")).cast("string").alias("digest_sum"), F.bit_xor(tail).alias("digest_xor")).withColumn("parent", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def changed_parents(lineage, parents, **columns):
    """(parent, split) whose records are not those the lineage was written from, appeared or went."""
    was = lineage.select("parent", "split", F.struct("records", "digest_sum", "digest_xor").alias("was"))
    now = suite_lineage(parents, **columns).select("parent", "split", F.struct("records", "digest_sum", "digest_xor").alias("now"))
    return was.join(now, ["parent", "split"], "full").filter(~F.col("was").eqNullSafe(F.col("now"))).select("parent", "split")


def suite_collisions(rows, row="id", key="skey", group="group_id"):
    """Why an assembled suite must be refused, one row per (code, subject): `public_leak` a state of public train or calibration
    rows that the inherited development or test rows hold; `reserved_state` a state of a generated arm that any row taken over
    holds; `shared_state` a state in two groups of the generated arms; `repeated_id` an id with more than one row. One aggregate
    by state and one by id; no rows are paired."""
    made = ~F.col("arm").isin(*GENERATED)
    flag = lambda c: F.max(c.cast("int")) == 1
    by_state = rows.groupBy(key).agg(flag(F.col("arm") == "public").alias("public"), flag(F.col("arm") == "inherited").alias("inherited"), flag(made).alias("made"),
                                     F.min(F.when(made, F.struct("arm", group))).alias("lo"), F.max(F.when(made, F.struct("arm", group))).alias("hi"))
    codes = F.array_compact(F.array(F.when(F.col("public") & F.col("inherited"), "public_leak"), F.when(F.col("made") & (F.col("public") | F.col("inherited")), "reserved_state"), F.when(F.col("lo") != F.col("hi"), "shared_state")))
    states = by_state.select(F.explode(codes).alias("code"), F.col(key).cast("string").alias("subject"))
    ids = rows.groupBy(row).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("repeated_id").alias("code"), F.col(row).cast("string").alias("subject"))
    return states.unionByName(ids)


def checked_suite(public, arms, inherited, **columns):
    """The assembled rows, refused inside the plan when the generated arms are unequal or anything collides. The check is one
    row beside the rows, so nothing runs before the suite is read."""
    rows, unequal = assemble_suite(public, arms, inherited)
    faults = suite_collisions(rows, **columns).select("code").unionByName(unequal.select(F.lit("unequal_arms").alias("code")))
    verdict = faults.agg(F.count(F.lit(1)).alias("_faults"), F.min("code").alias("_code"))
    held = rows.crossJoin(F.broadcast(verdict))                                                      # one-row side
    stop = F.raise_error(F.concat(F.lit("suite refused: "), F.col("_code"), F.lit(", faults in all: "), F.col("_faults").cast("string")))
    return held.filter(F.when(F.col("_faults") > 0, stop.cast("boolean")).otherwise(F.lit(True))).drop("_faults", "_code")
