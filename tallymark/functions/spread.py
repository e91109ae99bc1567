"""Ranks, running totals, previous-row values and exact quantiles for groups of any size.

A plain window over one key sorts the whole key in one task. Here a key is first cut into buckets that are monotone in the
order (a hash prefix, a rounded confidence, a day); the window runs inside (key, bucket), and a small table of bucket
totals - bounded by keys x buckets - carries the offset from one bucket to the next. Results are exact.
"""
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import settle
from .text import _c


def _on(left, right, keys):
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


BROADCAST_BYTES = 32 << 20


def counted_broadcast(df, row_bytes, limit=BROADCAST_BYTES):
    """Marks a side table for broadcast where its counted rows times `row_bytes` stay within `limit`; otherwise Spark joins as it sees fit."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def join_keys(left, right, keys, how="inner"):
    """Equi-join that also matches null keys and keeps one copy of the key columns."""
    keep = [right[c] for c in right.columns if c not in keys]
    return left.join(right, _on(left, right, keys), how).select(*[left[c] for c in left.columns], *keep)


def hash_bucket(hex_col, digits=3):
    """Bucket of a hex digest: its first digits, so 16**digits buckets of equal expected size."""
    return F.substring(_c(hex_col), 1, digits)


def spread_rank(df, by, order, bucket, name="rank", total=None, many=False):
    """1-based row number inside `by`, in `order` (ascending columns), never sorting a whole group in one task.
    `bucket` must not decrease along `order`. `total` names an extra column with the group size. `many`: groups may be nearly as many
    as rows; Spark guesses the offsets' size from compressed files, so they are kept from a broadcast."""
    b = df.withColumn("_b", bucket)
    counts = b.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_n").over(Window.partitionBy(*by)).alias(total)] if total else []
    offsets = counts.select(*by, "_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"), *extra)
    inner = b.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_b").orderBy(*order)))
    out = join_keys(inner, offsets.hint("merge") if many else offsets, [*by, "_b"])
    return out.withColumn(name, (F.col("_r") + F.col("_off")).cast("bigint")).drop("_r", "_off", "_b")


PRUNED = 1000   # quotas up to spark.sql.optimizer.windowGroupLimitThreshold are cut inside each map task


def first_n(df, by, order, n, bucket):
    """The first n rows of every group along `order` (None = all). Small quotas use a plain rank, which Spark prunes before the
    shuffle; larger ones use the bucketed rank, so that no group is sorted in one task."""
    if n is None:
        return df
    if n <= PRUNED:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= n).drop("_rk")
    return spread_rank(df, by, order, bucket, "_rk").filter(F.col("_rk") <= n).drop("_rk")


def running_totals(df, by, order, bucket, sums, descending=False, stored=False):
    """Adds `cum_<c>` (inclusive running sum along `order`) and `tot_<c>` (group total) for every column in `sums`.
    Rows of one group must differ in `order`. `stored` settles the offsets, one row per group and bucket: Spark then knows that they are
    few and does not shuffle the rows once more to join them."""
    b = df.withColumn("_b", bucket)
    totals = b.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    o = (lambda c: _c(c).desc()) if descending else (lambda c: _c(c).asc())
    w = Window.partitionBy(*by).orderBy(o("_b")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = totals.select(*by, "_b", *[F.coalesce(F.sum(f"_t_{c}").over(w), F.lit(0)).alias(f"_o_{c}") for c in sums],
                            *[F.sum(f"_t_{c}").over(whole).alias(f"tot_{c}") for c in sums])
    offsets = settle(offsets) if stored else offsets
    inside = Window.partitionBy(*by, "_b").orderBy(o(order)).rowsBetween(Window.unboundedPreceding, 0)
    inner = b.select("*", *[F.sum(c).over(inside).alias(f"_i_{c}") for c in sums])
    out = join_keys(inner, offsets, [*by, "_b"])
    for c in sums:
        out = out.withColumn(f"cum_{c}", F.col(f"_i_{c}") + F.col(f"_o_{c}"))
    return out.drop("_b", *[f"_i_{c}" for c in sums], *[f"_o_{c}" for c in sums])


def previous(df, by, order, cols, chunk, prefix="prev_"):
    """Values of the previous row inside `by` along `order`. Windows run per (by, chunk); the last row of each chunk is
    handed to the next one through a per-chunk table."""
    c = df.withColumn("_c", chunk)
    inside = Window.partitionBy(*by, "_c").orderBy(*order)
    carry = F.struct(*[_c(x).alias(x) for x in cols])
    inner = c.select("*", F.lag(carry).over(inside).alias("_prev"), F.row_number().over(inside).alias("_rn"))
    tails = c.groupBy(*by, "_c").agg(F.max_by(carry, F.struct(*[_c(x) for x in order])).alias("_tail"))
    tails = tails.select(*by, "_c", F.lag("_tail").over(Window.partitionBy(*by).orderBy("_c")).alias("_carry"))
    out = join_keys(inner, tails, [*by, "_c"])
    prev = F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_prev"))
    for x in cols:
        out = out.withColumn(f"{prefix}{x}", prev[x])
    return out.drop("_c", "_prev", "_rn", "_carry")


def magnitude_bucket(value, per_octave=32):
    """Monotone bucket for numbers of unknown range: sign and logarithm of the magnitude."""
    v = _c(value).cast("double")
    return (F.signum(v) * F.floor(F.log2(1.0 + F.abs(v)) * per_octave)).cast("bigint")


def spread_quantiles(df, by, value, qs, bucket=None):
    """Exact linear-interpolation quantiles per group from a histogram of distinct values: no per-group value list is
    ever held in one task. `qs` maps output name -> fraction. Also returns n."""
    hist = settle(df.groupBy(*by, _c(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n")))       # totals and ranks read it
    hist = running_totals(hist, by, "_v", magnitude_bucket("_v") if bucket is None else bucket, ["_n"])
    cum, tot = F.col("cum__n"), F.col("tot__n")

    def at_rank(r):
        return F.max(F.when((cum >= r + 1) & (cum - F.col("_n") <= r), F.col("_v")))
    aggs = []
    for name, q in qs.items():
        pos = (tot - 1) * F.lit(float(q))
        aggs += [at_rank(F.floor(pos)).alias(f"_lo_{name}"), at_rank(F.ceil(pos)).alias(f"_hi_{name}"),
                 F.max(pos - F.floor(pos)).alias(f"_f_{name}")]
    out = hist.groupBy(*by).agg(F.sum("_n").alias("n"), *aggs)
    return out.select(*by, "n", *[(F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * F.col(f"_f_{k}")).alias(k)
                                  for k in qs])


def carry_last(df, by, order, value, chunk, name, inclusive=True):
    """Last non-null `value` (a column) at or before each row inside `by` along `order`: an as-of lookup without sorting a
    whole key in one task. Inside a chunk a window finds it; otherwise the nearest earlier chunk that had one supplies it."""
    c = df.withColumn("_c", chunk).withColumn("_v", value)
    upto = Window.partitionBy(*by, "_c").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    inner = c.withColumn("_in", F.last("_v", ignorenulls=True).over(upto))
    tails = c.filter(F.col("_v").isNotNull()).groupBy(*by, "_c").agg(F.max_by("_v", F.struct(*[_c(o) for o in order])).alias("_tail"))
    every = c.select(*by, "_c").distinct().join(tails, [*by, "_c"], "left")
    before = Window.partitionBy(*by).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carry = every.select(*by, "_c", F.last("_tail", ignorenulls=True).over(before).alias("_carry"))
    out = join_keys(inner, carry, [*by, "_c"])
    return out.withColumn(name, F.coalesce("_in", "_carry")).drop("_c", "_v", "_in", "_carry")
