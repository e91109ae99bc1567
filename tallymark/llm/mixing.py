"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions. JVM side only."""
from pyspark.sql import functions as F

from ..functions.spread import running_totals, spread_rank
from .common import WORD, no_clash, small_side, stored, text_of

CYCLE = (5, 2, 1)
BUCKET_BITS = 12


def cycle_weights(sources, cycle=CYCLE):
    """(source, ..., weight): the sources in code-point order, null last, take the weights of `cycle` in turn. The rank runs
    inside buckets of the first three characters, so that many sources do not meet in one task."""
    named = sources.withColumn("_null", F.col("source").isNull().cast("int"))
    bucket = F.concat(F.col("_null").cast("string"), F.coalesce(F.substring("source", 1, 3), F.lit("")))
    ranked = spread_rank(named, [], ["_null", "source"], bucket, "_rank")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.pmod(F.col("_rank") - 1, F.lit(len(cycle))) + 1).cast("int"))
    return ranked.withColumn("weight", pick).drop("_null", "_rank")


def water_level(sources, budget, max_epochs):
    """Level L with sum(min(max_epochs * size, weight * L)) = budget: sources above their cap are clamped and the rest of
    the budget is dealt to the others by weight, until none is above. Each round is one aggregate of the source table."""
    cap, level, clamped = F.col("source_size") * max_epochs, 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= cap
        row = sources.agg(F.sum(F.when(full, cap)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open"), F.count(F.when(full, 1)).alias("n")).first()
        if row["n"] == clamped or not row["open"]:
            return level if row["open"] else float("inf")
        level, clamped = (budget - float(row["held"] or 0.0)) / row["open"], row["n"]


def targets(sized, weights=None, share=1.5, max_epochs=2):
    """(source, source_size, weight, target) of a stored (source, size) table. `weights` is a function from the source
    table to the same with a positive column weight; by default the cycle 5, 2, 1."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = stored((weights or cycle_weights)(sources), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources, total * share, max_epochs)
    cap = (F.col("source_size") * max_epochs).cast("double")
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)) if level != float("inf") else cap)


def mix(docs, weights=None, share=1.5, max_epochs=2, seed="mix"):
    """One row per document: doc_id, source, size, source_size, target, repeats (0 .. max_epochs) and taken = size * repeats.

    Every document of a source is repeated floor(target / source_size) times; the rest of the target goes to whole documents
    in seeded hash order until their running size reaches it. The document at the edge leaves a remainder; documents of at
    most a quarter of it, in the same order, are then added or given back to close it. Null texts have size 0, a null source
    is a source of its own, and sizes of zero are never repeated. Repeated rows count each for themselves; rows equal in id
    and size are interchangeable. All totals run per (source, hash bucket), so a hot source is spread over all tasks."""
    sized = stored(docs.select("doc_id", "source", F.regexp_count(text_of("text"), F.lit(WORD)).cast("bigint").alias("size")), "sizes")
    goal = small_side(targets(sized, weights, share, max_epochs).withColumnRenamed("source", "_src"), 400)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    keyed = sized.join(goal, F.col("source").eqNullSafe(F.col("_src")), "left").drop("_src")
    keyed = keyed.withColumn("whole", F.floor(ratio)).withColumn("_goal", F.col("target") - F.col("whole") * F.col("source_size"))
    order = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")), 256), 1, 15), 16, 10).cast("bigint")
    keyed = keyed.withColumn("_key", order)
    bucket = F.shiftright("_key", 60 - BUCKET_BITS)
    first = running_totals(keyed, ["source"], "_key", bucket, ["size"])
    first = stored(first.withColumn("_in", 2 * F.col("cum_size") - F.col("size") <= 2 * F.col("_goal")).drop("cum_size", "tot_size"), "first-pass")
    rest = first.groupBy("source").agg((F.max("_goal") - F.coalesce(F.sum(F.when(F.col("_in"), F.col("size"))), F.lit(0))).alias("_rest"))
    rest = small_side(stored(rest.withColumnRenamed("source", "_src"), "remainders"), 400)
    near = first.join(rest, F.col("source").eqNullSafe(F.col("_src")), "left").drop("_src")
    fits = (F.col("size") > 0) & (4 * F.col("size") <= F.abs("_rest")) & (F.col("_in") == (F.col("_rest") < 0))
    flip = running_totals(near.withColumn("_small", F.when(fits, F.col("size")).otherwise(0)), ["source"], "_key", bucket, ["_small"])
    flipped = fits & (F.col("cum__small") <= F.abs("_rest"))
    repeats = F.when(F.col("size") > 0, F.col("whole") + (F.col("_in") != flipped).cast("bigint")).otherwise(F.lit(0)).cast("bigint")
    repeats = F.least(repeats, F.lit(max_epochs).cast("bigint"))
    return flip.select("doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken"))


def mixed_documents(docs, **how):
    """The documents themselves, each as often as the mix repeats it; see `mix`. Rows that share a doc_id are taken equally
    often."""
    plan = mix(docs, **how).filter("repeats > 0").groupBy(F.col("doc_id").alias("_id")).agg(F.max("repeats").alias("_repeats"))
    again = docs.join(plan, docs["doc_id"].eqNullSafe(F.col("_id")))
    return again.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("bigint"), "_repeats")).alias("_copy")).drop("_copy")
