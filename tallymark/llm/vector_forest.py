"""Near-duplicate vectors by a forest of random-projection trees.

Equal vectors of one label form one class; everything after works on classes. A tree splits the classes of a label at the middle
of their projections on a random direction, again and again, until a leaf holds about LEAF; rows near a split go to both sides.
The places of the splits are fitted on a bounded sample of a node (SAMPLE rows of each, LEVELS levels at a time), every
class is dealt. Leaves are compared exhaustively on 16-bit codes of the unit vectors: a code's cosine is off by a known bound at
most, so only pairs that near to the threshold are verified on the vectors themselves.

Splits would tear large groups of near copies apart. Where a node's sample shows such a group, the mean of its rows becomes a
pivot, and every row within half the threshold's angle of a pivot belongs to its ball: by the triangle inequality all rows of
a ball are linked, so they are counted by one sum and never compared with each other, whatever their number.

A pair that meets in several leaves is counted in one of them, that with the least id of all the leaves both stand in. A leaf
therefore emits one count per row and the edges of a spanning star per connected part, never its pairs; the stars of all leaves
and the verified pairs are united to components.
"""
import math
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from .common import small_side, stored
from .near_dup import components

THRESHOLD = 0.93
LEAF = 1024               # classes of a leaf aimed at; leaves above twice this are split again
OVERLAP = 0.03            # share of a node on either side of a split that goes to both children
LEVELS = 5                # levels fitted at a time
SAMPLE = 4096             # classes of a node that fit its splits
LEAST_TREES = 4
RECALL = 0.97             # of pairs at the threshold; sets the number of trees
SURVIVAL = 0.93           # chance that a pair at cosine 0.93 stays together at one split (64 dimensions, by calculation)
PIVOT_SAMPLE = 2048       # classes of a node among which large groups are looked for
LEAST_BALL = 24           # rows of that sample that make a group
SCALE = 32767
BLOCK = 512
_HALF = 0.5 + OVERLAP


def depth_of(size, leaf=LEAF):
    """Levels until a node of `size` is cut to `leaf`."""
    return max(0, math.ceil(math.log(leaf / max(size, 1)) / math.log(_HALF)))


def trees_for(size, leaf=LEAF):
    """Trees that find a pair at the threshold with a chance of RECALL, when each loses some at every level."""
    together = SURVIVAL ** depth_of(size, leaf)
    return LEAST_TREES if together > 1 - 1e-9 else max(LEAST_TREES, math.ceil(math.log(1 - RECALL) / math.log(1 - together)))


def _vectors(column):
    """(rows, matrix of doubles) of each length among the non-null vectors; a null component reads as nan."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) if len(column) else np.zeros(0, int)
    for size in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == size)
        flat = column.take(pa.array(rows)).flatten()
        yield rows, flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), size)


def _usable(column):
    """(rows, vectors, unit vectors) of those that have a direction: neither zero nor with null or non-finite components."""
    for rows, m in _vectors(column):
        good = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
        rows, m = rows[good], m[good] + 0.0                       # -0.0 equals 0.0
        if len(rows):
            u = m / np.abs(m).max(axis=1, keepdims=True)
            yield rows, m, u / np.sqrt((u * u).sum(axis=1, keepdims=True))


def _classes(what):
    """mapInArrow over (vec_id, label_key, embedding): class, and with `what` "code" the 16-bit code or "unit" the unit vector."""
    def run(batches):
        for batch in batches:
            keys, column = batch.column(1).to_pylist(), batch.column(2)
            names, sizes, extra = [None] * batch.num_rows, [0] * batch.num_rows, [None] * batch.num_rows
            for rows, m, u in _usable(column):
                codes = np.rint(u * SCALE).astype(np.int16) if what == "code" else u
                for k, r in enumerate(rows.tolist()):
                    if keys[r] is not None:
                        names[r] = xxhash.xxh3_128_digest(struct.pack("<q", keys[r]) + m[k].tobytes())
                        sizes[r] = m.shape[1]
                        extra[r] = codes[k].tobytes() if what else None
            columns = [batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(sizes, pa.int32())] + ([pa.array(extra, pa.binary())] if what else [])
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label_key", "class", "dim"] + ([what] if what else []))
    return run


def _unit_rows(codes):
    return np.frombuffer(b"".join(codes), np.int16).reshape(len(codes), -1).astype(np.float32) / np.float32(SCALE)


def _directions(node, tree, levels, size):
    rng = np.random.default_rng([node & 0xFFFFFFFFFFFFFFFF, tree & 0xFFFFFFFF])
    d = rng.standard_normal((2 ** levels - 1, size))
    return (d / np.linalg.norm(d, axis=1, keepdims=True)).astype(np.float32)


def _code_error(size):
    """Most that the 16-bit code of a unit vector of `size` components can be off."""
    return math.sqrt(size) * 0.5 / SCALE


def _ball_bound(threshold, size):
    """Cosine to a pivot from which two rows are linked for certain: half the threshold's angle, less what codes may be off."""
    return math.cos(max(0.0, math.acos(threshold) / 2 - 2 * _code_error(size) - 1e-5))


def _pivots(x, bound):
    """Mean directions of the large groups of near copies among the rows of x, the largest first."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near, out = x @ x.T >= bound, []
    while len(x) and (count := near.sum(axis=1)).max() >= LEAST_BALL:
        group = near[count.argmax()].copy()
        for _ in range(3):
            pivot = x[group].mean(axis=0)
            pivot /= np.linalg.norm(pivot)
            inside = x @ pivot >= bound
            if not inside.any():
                break
            group |= inside
        out.append(pivot.astype(np.float32))
        near[group] = near[:, group] = False
    return out


def _ties(names):
    """A shift far below any spread of projections, by class, so that a node of equal directions can be split as well."""
    return np.array([int.from_bytes(n[:4], "little") for n in names], np.float64) * (1e-6 / 2**32)


def _descend(x, ties, node, tree, levels, place):
    """(rows, leaf number) of the rows of one node. `place(k, values)` gives the two bounds of split k, or None where there is none."""
    directions = _directions(node, tree, levels, x.shape[1])
    here = {0: np.arange(len(x))}
    for _ in range(levels):
        below = {}
        for k, rows in here.items():
            values = x[rows] @ directions[k] + ties[rows]
            lo, hi = place(k, values)
            below[2 * k + 1], below[2 * k + 2] = rows[values <= hi], rows[values >= lo]
        here = below
    return here


def _fit(threshold, leaf, levels_at_once):
    """Sampled rows of a node, sorted by node, become the bounds of its splits for every tree and the pivots of its balls."""
    def fitted(rows):
        node, size = rows[0]["node"], rows[0]["size"]
        tree = rows[0]["tree"]
        levels = min(levels_at_once, max(1, depth_of(size, leaf)))
        distinct = {r["class"]: r["code"] for r in rows}
        x, ties = _unit_rows(list(distinct.values())), _ties(list(distinct))
        pivots = [p.tobytes() for p in _pivots(x[:PIVOT_SAMPLE], _ball_bound(threshold, x.shape[1]))]
        for t in range(trees_for(size, leaf)) if tree is None else [tree]:
            bounds = np.zeros((2 ** levels - 1, 2))

            def place(k, values, bounds=bounds):
                bounds[k] = np.quantile(values, [0.5 - OVERLAP, _HALF]) if len(values) else (0.0, 0.0)
                return bounds[k]
            _descend(x, ties, node, t, levels, place)
            yield node, t, bounds.ravel().tolist(), pivots
            pivots = []                         # once per node

    def run(batches):
        for rows in _groups(batches, "node"):
            out = list(zip(*fitted(rows)))
            types = [pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["node", "tree", "bounds", "pivots"])
    return run


def _groups(batches, key):
    """Lists of consecutive rows that share `key`."""
    rows = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and rows[0][key] != row[key]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


CARRIED = ("row", "class", "first_id", "n", "label_key", "code")
ROUTED = "row bigint, class binary, first_id bigint, n bigint, label_key bigint, code binary, ball bigint, leaves array<bigint>, trees array<int>"


def _name(node, tree, k):
    return struct.unpack("<q", xxhash.xxh3_64_digest(struct.pack("<qqq", node, tree, k)))[0]


def _route(threshold):
    """Rows with the splits of the nodes that they stand in (`splits`: node, tree, bounds, pivots) go down to the leaves behind them
    and into the ball of the nearest pivot, if they are in none."""
    def run(batches):
        for batch in batches:
            codes, names = batch.column("code").to_pylist(), batch.column("class").to_pylist()
            leaves, trees, balls = (batch.column(c).to_pylist() for c in ("leaves", "trees", "ball"))
            nearest, todo = [0.0] * len(balls), {}
            for r, splits in enumerate(batch.column("splits").to_pylist()):
                for s in splits or []:
                    todo.setdefault((s["node"], s["tree"]), (s["bounds"], s["pivots"], []))[2].append(r)
                if splits:
                    gone = {s["node"] for s in splits}
                    kept = [k for k, leaf in enumerate(leaves[r]) if leaf not in gone]
                    leaves[r], trees[r] = [leaves[r][k] for k in kept], [trees[r][k] for k in kept]
                nearest[r] = 2.0 if balls[r] is not None else 0.0
            for (node, tree), (bounds, pivots, rows) in sorted(todo.items()):
                bounds = np.array(bounds).reshape(-1, 2)
                x, ties = _unit_rows([codes[r] for r in rows]), _ties([names[r] for r in rows])
                if pivots:
                    to = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ np.stack([np.frombuffer(p, np.float32) for p in pivots]).T
                    best, bound = to.argmax(axis=1), _ball_bound(threshold, x.shape[1])
                    for i in np.flatnonzero(to.max(axis=1) >= bound).tolist():
                        value = float(to[i, best[i]])
                        if value > nearest[rows[i]]:
                            nearest[rows[i]], balls[rows[i]] = value, _name(node, tree, -1 - int(best[i]))
                for k, inside in _descend(x, ties, node, tree, (len(bounds) + 1).bit_length() - 1, lambda k, values, bounds=bounds: bounds[k]).items():
                    leaf = _name(node, tree, k)
                    for i in inside.tolist():
                        leaves[rows[i]].append(leaf)
                        trees[rows[i]].append(tree)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in CARRIED], pa.array(balls, pa.int64()), pa.array(leaves, pa.list_(pa.int64())), pa.array(trees, pa.list_(pa.int32()))],
                                             [*CARRIED, "ball", "leaves", "trees"])
    return run


def _compare(threshold):
    """Rows sorted by (leaf, row) become (a, b, links): links of row a found here (b null), a spanning edge a-b (links 0), or a pair
    a-b to be verified (links null)."""
    def leaf_rows(rows):
        leaf = rows[0]["leaf"]
        x = _unit_rows([r["code"] for r in rows])
        ids, n, keys = (np.array([r[c] for r in rows], np.int64) for c in ("row", "n", "label_key"))
        m, slack = len(rows), 2.1 * _code_error(x.shape[1]) + 1e-5
        # rows of no ball differ from each other
        ball = np.unique([-1 - k if r["ball"] is None else r["ball"] for k, r in enumerate(rows)], return_inverse=True)[1] if any(r["ball"] is not None for r in rows) else np.arange(m)
        # leaves with a lesser id that several of these rows share as well: their pairs are counted there
        owners = {}
        for k, r in enumerate(rows):
            for other in r["leaves"]:
                if other < leaf:
                    owners.setdefault(other, []).append(k)
        shared = [k for k in owners.values() if len(k) > 1]
        member = np.zeros((m, len(shared)), np.float32)
        for c, k in enumerate(shared):
            member[k, c] = 1
        links, label, unsure = np.zeros(m, np.int64), np.arange(m), []
        first, second = [], []
        for lo in range(0, m, BLOCK):
            cosine = x[lo:lo + BLOCK] @ x[lo:].T
            near = np.triu(cosine >= threshold - slack, 1)
            if shared:
                near &= (member[lo:lo + BLOCK] @ member[lo:].T) == 0
            i, j = np.nonzero(near)
            value = cosine[i, j]
            i, j = i + lo, j + lo
            ok = (keys[i] == keys[j]) & (ball[i] != ball[j])
            i, j, sure = i[ok], j[ok], value[ok] >= threshold + slack
            unsure.append(np.stack([i[~sure], j[~sure]]))
            first.append(i[sure]), second.append(j[sure])
        i, j = np.concatenate(first), np.concatenate(second)
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        while True:
            less = label.copy()
            np.minimum.at(less, i, label[j])
            np.minimum.at(less, j, label[i])
            less = less[less]
            if (less == label).all():
                break
            label = less
        found, tied, open_pairs = np.flatnonzero(links), np.flatnonzero(label != np.arange(m)), np.concatenate(unsure, axis=1)
        none = pa.nulls(len(found), pa.int64())
        a = np.concatenate([ids[found], ids[tied], ids[open_pairs[0]]])
        b = pa.concat_arrays([none, pa.array(ids[label[tied]], pa.int64()), pa.array(ids[open_pairs[1]], pa.int64())])
        count = pa.concat_arrays([pa.array(links[found], pa.int64()), pa.array(np.zeros(len(tied), np.int64)), pa.nulls(open_pairs.shape[1], pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, count], ["a", "b", "links"])

    def run(batches):
        for rows in _groups(batches, "leaf"):
            if len(rows) > 1:
                yield leaf_rows(rows)
    return run


def _verify(threshold):
    def run(batches):
        for batch in batches:
            left, right = (batch.column(c).to_pylist() for c in ("ua", "ub"))
            ok = [float(np.frombuffer(p) @ np.frombuffer(q)) >= threshold for p, q in zip(left, right)]
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(ok, pa.bool_()))
    return run


def _split_large(routed, threshold, leaf, levels):
    """Splits nodes above twice `leaf` until there are none: fit on a sample of each, deal their rows. A node that one round of splits
    doesn't make small enough comes back in the next."""
    level = 0
    while True:
        places = routed.select("class", "code", F.explode(F.arrays_zip("leaves", "trees")).alias("_p")).select("class", "code", F.col("_p.leaves").alias("node"), F.col("_p.trees").alias("tree"))
        sizes = stored(places.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 2 * leaf), f"large-nodes-{level}")
        if not sizes.limit(1).count():
            return routed
        inside = places.join(small_side(sizes.select(F.col("node").alias("_node"), "size"), 24), F.col("node") == F.col("_node")).drop("_node")
        splits = stored(_fitted(inside, threshold, leaf, levels), f"splits-{level}")
        mine = places.select("class", "node").join(small_side(splits.withColumnRenamed("node", "_node"), 600), F.col("node") == F.col("_node"))
        mine = mine.groupBy(F.col("class").alias("_class")).agg(F.collect_list(F.struct("node", "tree", "bounds", "pivots")).alias("splits"))
        routed = stored(routed.join(mine, F.col("class") == F.col("_class"), "left").drop("_class").mapInArrow(_route(threshold), ROUTED), f"routed-{level}")
        level += 1


def _fitted(rows, threshold, leaf, levels):
    """Splits of the nodes of `rows` (node, tree, size, class, code), from about SAMPLE rows of each, chosen by hash."""
    share = F.lit(float(SAMPLE)) / F.col("size")
    chosen = F.pmod(F.xxhash64("node", "class"), F.lit(1 << 40)) < share * (1 << 40)
    return rows.filter(chosen).select("node", "tree", "size", "class", "code").repartition("node").sortWithinPartitions("node", "class").mapInArrow(_fit(threshold, leaf, levels), "node bigint, tree int, bounds array<double>, pivots array<binary>")


def near_vectors(vectors, threshold=THRESHOLD, leaf=LEAF, levels=LEVELS):
    """vec_id, n_links, component_id and kept for every row of `vectors` (vec_id, embedding, label).

    Rows are linked where their labels are equal and not null and the cosine, in double precision, is at least `threshold`.
    n_links counts the other rows linked directly, component_id is the smallest vec_id reachable, kept says that it is the row's
    own. Null, empty and zero vectors, vectors with null or non-finite components and vectors of different lengths are linked
    with nothing. Rows that repeat a vector are linked with each other; rows that share a vec_id count each for itself;
    a null vec_id is the smallest of a component only where it has no other. An empty table gives none.
    Every link counted is exact; a pair is missed with the chance that no tree keeps it in one leaf (see `trees_for`)."""
    given = vectors.select("vec_id", F.when(F.col("label").isNotNull(), F.xxhash64("label")).alias("label_key"), F.col("embedding"))
    base = stored(given.mapInArrow(_classes(None), "vec_id bigint, label_key bigint, class binary, dim int"), "vectors")
    coded = given.mapInArrow(_classes("code"), "vec_id bigint, label_key bigint, class binary, dim int, code binary").filter("class is not null")

    root = F.xxhash64(F.lit("root"), "label_key", "dim")
    sizes = base.filter("class is not null").select(root.alias("node"), "class").groupBy("node").agg(F.approx_count_distinct("class").cast("bigint").alias("size"))
    sizes = stored(sizes, "label-sizes")
    large = sizes.filter(F.col("size") > leaf).withColumnRenamed("node", "_node")
    sampled = coded.withColumn("node", root).join(small_side(large, 24), F.col("node") == F.col("_node")).withColumn("tree", F.lit(None).cast("int"))
    splits = stored(_fitted(sampled, threshold, leaf, levels).groupBy("node").agg(F.collect_list(F.struct("node", "tree", "bounds", "pivots")).alias("splits")), "root-splits")
    classes = coded.groupBy("class").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("label_key").alias("label_key"), F.first("dim").alias("dim"), F.first("code").alias("code"))
    rooted = classes.withColumn("row", F.monotonically_increasing_id()).withColumn("_root", root).join(small_side(splits.withColumnRenamed("node", "_node"), 600 * 32), F.col("_root") == F.col("_node"), "left").drop("_node")
    rooted = rooted.withColumn("leaves", F.array("_root")).withColumn("trees", F.array(F.lit(-1))).withColumn("ball", F.lit(None).cast("bigint"))
    routed = _split_large(stored(rooted.mapInArrow(_route(threshold), ROUTED), "routed"), threshold, leaf, levels)
    placed = routed.select(F.explode("leaves").alias("leaf"), "row", "n", "label_key", "code", "ball", "leaves")
    found = stored(placed.repartition("leaf").sortWithinPartitions("leaf", "row").mapInArrow(_compare(threshold), "a bigint, b bigint, links bigint"), "compared")
    return _united(base, given, routed, found, threshold)


def _united(base, given, routed, found, threshold):
    members = routed.select("row", "class", "first_id", "n")
    in_balls = routed.filter("ball is not null").select("row", "n", "ball")
    balls = stored(in_balls.groupBy(F.col("ball").alias("_ball")).agg(F.sum("n").alias("_all"), F.min("row").alias("_least")), "balls")
    in_balls = in_balls.join(small_side(balls, 40), F.col("ball") == F.col("_ball"))
    unsure = found.filter("links is null").select("a", "b")
    asked = stored(unsure.select(F.col("a").alias("row")).union(unsure.select(F.col("b").alias("row"))).distinct().join(members, "row").select("row", "class", "n"), "to-verify")
    wanted = small_side(asked.select(F.col("class").alias("_class")), 40)
    units = given.mapInArrow(_classes("unit"), "vec_id bigint, label_key bigint, class binary, dim int, unit binary").filter("class is not null")
    units = units.join(wanted, F.col("class") == F.col("_class"), "left_semi").groupBy("class").agg(F.first("unit").alias("unit")).join(asked, "class")
    side = {s: units.select(F.col("row").alias(s), F.col("unit").alias(f"u{s}"), F.col("n").alias(f"n{s}")) for s in "ab"}
    verified = unsure.join(side["a"], "a").join(side["b"], "b").select("a", "b", "na", "nb", "ua", "ub")
    verified = stored(verified.mapInArrow(_verify(threshold), "a bigint, b bigint, na bigint, nb bigint"), "verified")
    counts = found.filter("b is null").select("a", "links").union(verified.select("a", "nb")).union(verified.select("b", "na")).union(in_balls.select("row", F.col("_all") - F.col("n")))
    counts = counts.groupBy(F.col("a").alias("row")).agg(F.sum("links").alias("links"))
    united = components(found.filter("links = 0").select("a", "b").union(verified.select("a", "b")).union(in_balls.select(F.col("row").alias("a"), F.col("_least").alias("b")))).withColumnRenamed("id", "row")
    named = stored(members.join(counts, "row", "left").join(united, "row", "left").withColumn("component", F.coalesce("component", "row")), "named")
    label = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_class = named.join(label, "component").select(F.col("class").alias("_class"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = base.join(by_class, F.col("class") == F.col("_class"), "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
