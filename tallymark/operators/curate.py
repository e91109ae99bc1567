"""Fingerprints, duplicates, decontamination, unique selection (D). Exact matches only."""
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import spread
from ..functions.text import norm_text
from ..session import settle, written


def row_digest(df, cols, canonical=True, name="digest"):
    """Digest of a whole record as JSON, columns sorted by name (canonical) or in the given order."""
    cols = sorted(cols) if canonical else list(cols)
    return df.withColumn(name, F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256))


def semantic_hash(df, policy="policy", case="case", name="semantic"):
    """D3: policy/case states hash independently of sentence order."""
    parts = F.array_sort(F.transform(F.split(F.col(case), r"\. "), lambda s: F.regexp_replace(s, r"\.+$", "")))
    return df.withColumn(name, F.sha2(F.concat_ws("|", F.col(policy), F.array_join(parts, "|")), 256))


def longest_leaf(leaves, id_col="id"):
    """Fingerprint of the longest string leaf of each state (first one among equals). Leaf rows: (id, pos, value)."""
    g = leaves.groupBy(id_col).agg(F.max_by("value", F.struct(F.length("value").alias("l"), (-F.col("pos")).alias("p"))).alias("leaf"))
    return g.withColumn("fingerprint", F.sha2(norm_text("leaf"), 256))


def drop_exact_duplicates(df, fp, order):
    """The first row of every fingerprint. Copies collapse map-side, and the join back is on the unique order column,
    so a fingerprint shared by a third of all rows costs nothing extra."""
    first = df.groupBy(F.col(fp)).agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_semi")


def conflicting_states(df, key="skey", qid="qid", instructions="instructions", label="label"):
    """State keys that carry two labels for one question."""
    g = df.groupBy(key, qid, instructions).agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
    return g.filter(F.col("lo") != F.col("hi")).select(key).distinct()


def drop_label_conflicts(df, key="skey", **cols):
    return df.join(conflicting_states(df, key, **cols), key, "left_anti")


def exclude_states(df, other, key="skey"):
    """(clean rows, leaked rows) against the states of another table."""
    known = other.select(key).distinct()
    return df.join(known, key, "left_anti"), df.join(known, key, "left_semi")


def reserve(*tables):
    """The reserved set: fingerprints and (source, split, row) origins over all given (fp, repo, split, row) tables."""
    u = tables[0].select("fp", "repo", "split", "row")
    for t in tables[1:]:
        u = u.unionByName(t.select("fp", "repo", "split", "row"))
    return u.select("fp").distinct(), u.filter(F.col("repo").isNotNull()).select("repo", "split", "row").distinct()


def admit_fresh(candidates, reserved_fp, reserved_origin):
    """Each candidate with the reason it is refused (null when fresh)."""
    c = candidates.join(reserved_fp.withColumn("_f", F.lit(True)), "fp", "left")
    c = c.join(reserved_origin.withColumn("_o", F.lit(True)), ["repo", "split", "row"], "left")
    return c.withColumn("reason", F.when(F.col("_f"), "state_reserved").when(F.col("_o"), "origin_reserved")).drop("_f", "_o")


def set_digest(df, col):
    """Order-free digest of a set of strings: count, 64-bit sums and xor of per-row hashes, hashed once more. Unlike a digest of
    the sorted, joined set it never brings the set together in one task."""
    d = df.select(F.sha2(F.col(col).cast("string"), 256).alias("_h"))
    num = F.conv(F.substring("_h", 1, 12), 16, 10).cast("bigint")
    tail = F.conv(F.substring("_h", 13, 12), 16, 10).cast("bigint")
    return d.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(num.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest_sum"),
                 F.coalesce(F.bit_xor(tail), F.lit(0)).alias("digest_xor"))


def admit_groups(df, reserved, quota, group="group_id", family="family", key="skey", size="size", max_size=None):
    """Whole groups are refused when any member is reserved or too large; the first `quota` groups per family stay."""
    bad = df.join(reserved.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    over = (F.col(size) > max_size) if max_size is not None else F.lit(False)
    g = bad.groupBy(family, group).agg(F.max(F.coalesce(F.col("_hit"), F.lit(False)) | over).alias("_bad")).withColumn("_o", F.sha2(F.col(group).cast("string"), 256))
    ok = spread.first_n(g.filter(~F.col("_bad")), [family], ["_o"], quota, spread.hash_bucket("_o"))
    return df.join(ok.select(family, group), [family, group], "left_semi")


def overlap(a, b, key="skey"):
    """Keys present on both sides (must be empty)."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def _decided(live):
    """Splits undecided pairs (ord, h1, h2) of the rule "first in order wins at each hash": (kept, undecided) as written tables of
    (ord, h1, h2). A pair that no undecided one precedes at either hash is kept. A pair that exactly one precedes is kept where that
    one is not, so such pairs form chains, which are followed by doubling their steps. Whatever shares a hash with a kept
    pair is dropped. Pairs behind two or more undecided ones wait, unless they are dropped."""
    ends = live.select("ord", F.explode(F.array_distinct(F.array("h1", "h2"))).alias("h"))
    one = ends.groupBy("h").agg(F.min("ord").alias("_m"))
    two = ends.join(one, "h").filter(F.col("ord") > F.col("_m")).groupBy("h").agg(F.min("ord").alias("_m2"))
    least = written(one.join(two, "h", "left"), "least")
    # at each hash: none before, the one before, or (-1) more than one; orders are made non-negative by their table
    before = F.when(F.col("ord") == F.col("_m"), F.lit(None).cast("bigint")).when(F.col("ord") == F.col("_m2"), F.col("_m")).otherwise(F.lit(-1))
    seen = ends.join(least, "h").select("ord", before.alias("_b")).groupBy("ord").agg(F.min("_b").alias("_lo"), F.max("_b").alias("_hi"))
    kind = F.when(F.col("_lo").isNull(), "kept").when((F.col("_lo") >= 0) & (F.col("_lo") == F.col("_hi")), "chain").otherwise("waits")
    # a step leads to the pair before and turns the answer round; kept and waiting pairs lead to themselves
    steps = seen.withColumn("kind", kind).select("ord", F.when(F.col("kind") == "chain", F.col("_lo")).otherwise(F.col("ord")).alias("to"), (F.col("kind") == "chain").alias("odd"), "kind")
    steps = written(steps, "steps")
    while True:
        ahead = steps.filter("kind = 'chain'").select(F.col("ord").alias("to"), F.col("to").alias("_to"), F.col("odd").alias("_odd"))
        if ahead.limit(1).count() == 0:
            break
        ends_here = steps.filter("kind <> 'chain'").select(F.col("ord").alias("to"), F.col("kind").alias("_end"))
        chain = steps.filter("kind = 'chain'").join(ahead, "to", "left").join(ends_here, "to", "left")
        moved = chain.select("ord", F.coalesce("_to", "to").alias("to"), (F.col("odd") != F.coalesce("_odd", F.lit(False))).alias("odd"),
                             F.when(F.col("_end").isNull(), "chain").when(F.col("_end") == "waits", "waits").when((F.col("_end") == "kept") != F.col("odd"), "kept").otherwise("dropped").alias("kind"))
        # a pair that has reached an end becomes an end itself: others may still lead to it
        steps = written(moved.unionByName(steps.filter("kind <> 'chain'")), "steps")
    named = written(live.join(steps.select("ord", "kind"), "ord"), "decided")
    kept = named.filter("kind = 'kept'").select("ord", "h1", "h2")
    taken = kept.select(F.explode(F.array("h1", "h2")).alias("_h")).distinct()
    left = named.filter("kind = 'waits'")
    for side in ("h1", "h2"):
        left = left.join(taken, F.col(side) == F.col("_h"), "left_anti")
    return kept, written(left.select("ord", "h1", "h2"), "undecided")


def unique_pairs_by_family(pairs, n=None):
    """Pairs (family, ord, h1, h2) in order of the unique, non-negative `ord`: a pair is skipped when either hash belongs to an
    earlier kept pair, and a family stops at n (no limit when None). Without a limit every round decides all pairs that come first at
    both hashes and all chains behind them, and only the undecided rest goes on: a chain of any length takes the logarithm of its
    length in steps. With a limit only kept pairs block, so the state is the kept set (families x n rows): each round
    recomputes it from the previous one, and every round settles at least the next pair in order, usually all."""
    pairs = written(pairs, "pairs")
    if n is None:
        live, parts = pairs.select("ord", "h1", "h2"), []
        while live.limit(1).count():
            kept, live = _decided(live)
            parts.append(kept.select("ord"))
        return pairs.join(reduce(lambda a, b: a.unionByName(b), parts), "ord", "left_semi") if parts else pairs.limit(0)
    kept, before = None, None
    while True:
        free = pairs
        if kept is not None:
            first = kept.select("ord", F.explode(F.array("h1", "h2")).alias("h")).groupBy("h").agg(F.min("ord").alias("m"))
            for side in ("h1", "h2"):
                free = free.join(first.select(F.col("h").alias(side), F.col("m").alias(f"_m_{side}")), side, "left")
            free = free.filter(~F.coalesce(F.least("_m_h1", "_m_h2") < F.col("ord"), F.lit(False))).drop("_m_h1", "_m_h2")
        kept = written(spread.first_n(free, ["family"], ["ord"], n, spread.magnitude_bucket("ord", 256)), "kept-pairs")
        state = tuple(kept.agg(F.count(F.lit(1)), F.sum(F.xxhash64("ord").cast("decimal(38,0)"))).first())
        if state == before:
            return kept
        before = state


def _sortable(df, column):
    """Text of a column that sorts as its values do: whole numbers shifted to be positive and of one width, anything else as it is."""
    if isinstance(df.schema[column].dataType, T.IntegralType):
        return F.lpad((F.col(column).cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), 20, "0")
    return F.col(column).cast("string")


def select_unique(df, n, seen=None, key="skey", order="row_sha", fits="fits", row="id"):
    """Per source (in name order) the first n rows by `order` whose key no earlier kept row has, size-admitted rows only.

    Source i can be blocked by at most (i-1)*n keys, so only its first i*n distinct keys matter: the candidate table is
    bounded by sources^2 * n whatever the input size. Acceptance is then settled in rounds: a key is blocked where an
    earlier source accepted it, and each source accepts its first n unblocked keys; after round r the first r sources are
    final, and usually two or three rounds reach the fixed point. Rows with equal digests follow in the order of the unique
    column `row`: numbers by value, texts of any length by code point.
    Returns (accepted rows, per-source report)."""
    digest, order = order, "_place"
    df = df.withColumn(order, F.concat_ws(":", digest, _sortable(df, row)) if row in df.columns else F.col(digest))
    sources = df.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    sources = sources.withColumn("rank", F.row_number().over(Window.orderBy("source")))   # one row per source
    count = sources.count()
    small = lambda t: spread.counted_broadcast(t, 200)                                    # tables with one row per source
    d = df.join(small(sources.select("source", "rank")), "source")
    fit = d.filter(F.col(fits))
    if seen is not None:
        fit = fit.join(seen.select(key).distinct(), key, "left_anti")
    keys = fit.groupBy("source", "rank", key).agg(F.min(order).alias("o"))
    top = spread.spread_rank(keys, ["source"], ["o"], spread.hash_bucket("o"), "_rk")      # `order` is a digest
    cand = settle(top.filter(F.col("_rk") <= F.col("rank") * n).drop("_rk"))
    state = cand.withColumn("acc", F.lit(False))
    for _ in range(count + 1):
        earlier = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        blocked = state.withColumn("blocked", F.coalesce(F.max("acc").over(earlier), F.lit(False)))
        free = F.when(F.col("blocked"), 0).otherwise(1)
        running = spread.running_totals(blocked.withColumn("_free", free), ["source"], "o", spread.hash_bucket("o"), ["_free"])
        new = settle(running.withColumn("now", ~F.col("blocked") & (F.col("cum__free") <= n)))
        changed = not new.filter(F.col("acc") != F.col("now")).isEmpty()
        state = new.select("source", "rank", key, "o", F.col("now").alias("acc"))
        if not changed:
            break
    acc = state.filter("acc").select("source", "rank", key, "o")
    ends = acc.groupBy("source").agg(F.max("o").alias("last"), F.count(F.lit(1)).alias("accepted"))
    ends = sources.select("source").join(ends, "source", "left").withColumn("accepted", F.coalesce("accepted", F.lit(0)))
    considered = d.join(small(ends), "source").filter((F.col("accepted") < n) | (F.col(order) <= F.col("last")))
    owner = acc.groupBy(key).agg(F.min(F.struct("rank", "o")).alias("first"), F.collect_list(F.struct("rank", "o")).alias("all"))   # at most one per source
    c = considered.join(owner, key, "left")
    if seen is not None:
        c = c.join(seen.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left")
    else:
        c = c.withColumn("_seen", F.lit(None).cast("boolean"))
    before = F.exists("all", lambda a: (a["rank"] < F.col("rank")) | ((a["rank"] == F.col("rank")) & (a["o"] < F.col(order))))
    dup = F.coalesce(F.col("_seen"), F.lit(False)) | F.coalesce(before, F.lit(False))
    report = c.groupBy("source").agg(
        F.count(F.lit(1)).alias("considered"), F.sum(dup.cast("bigint")).alias("duplicate_state"),
        F.sum((~dup & ~F.col(fits)).cast("bigint")).alias("context_rejected"), F.max("accepted").alias("accepted"))
    rows = d.join(acc.select("source", F.col("o").alias(order)), ["source", order], "left_semi").drop("rank", order)
    return rows, report.withColumn("short", F.col("accepted") < n)
