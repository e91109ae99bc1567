"""Near-duplicate documents by a chosen-path similarity join over word shingles.

Documents with equal shingle sets form one class; everything after works on classes. A class keeps 64 minwise values. A tree
is a path hash that every class extends by the minwise token of one or two coordinates, which the path itself selects; classes
that share a path share a node. Small nodes are compared exhaustively on the minwise values, larger ones branch again, and
independent trees repeat this until a pair at the threshold is missed with a chance of about one in ten thousand. Every
candidate is confirmed on the full shingle sets, and links become components by alternating large- and small-star steps.

Groups of copies that no minwise token tells apart would make nodes with quadratically many pairs. A first round therefore
keeps only a spanning forest of such a node's candidates. A second round revisits exactly the nodes that were cut short,
branches them further, and emits every remaining candidate between different components, so no link between components is
passed over: what is never emitted is a pair already connected.
"""
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from .common import small_side, stored, text_of
from .units import grouped

COORDINATES = 64
TREES = 6
NODE_LIMIT = 256          # largest node compared exhaustively
MOST_LEVELS = 5           # levels before a node counts as dense
SLACK = 4.0               # standard deviations below the threshold at which a pair is still a candidate
DENSE = 4                 # candidates per member above which a node keeps a spanning forest only
DENSE_BLOCK = 1024        # rows of a dense node's largest component that stand in one block
BITS = 4096               # bits of the set summary that bounds an intersection from above
EDGES_PER_FILE = 100_000
MOST_WORDS = 300_000
_MULTIPLIERS = np.random.default_rng(20).integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    """64-bit hash of a word; emptied between documents when it grows too large."""
    def __missing__(self, word):
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h):
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts, width, cache):
    """Sorted distinct 64-bit shingle hashes of each byte string, words lower-cased in A-Z. Fewer words than `width` are one
    shingle; no words give an empty set."""
    if len(cache) > MOST_WORDS:
        cache.clear()
    lists = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    hashes = np.fromiter((cache[w] for ws in lists for w in ws), np.uint64, int(counts.sum()))
    rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for j in range(width):
        rolled = _mix(rolled + hashes[j:j + len(rolled)] + np.uint64(0x9E3779B97F4A7C15))
    at = 0
    for ws, n in zip(lists, counts.tolist()):
        if n >= width:
            yield np.unique(rolled[at:at + n - width + 1])
        else:
            yield np.array([xxhash.xxh3_64_intdigest(b" ".join(ws))] if n else [], np.uint64)
        at += n


def minwise(s):
    """Low 16 bits of the least hash of a set under each coordinate's hash function."""
    least = np.full(COORDINATES, 2**32 - 1, np.uint64)
    for lo in range(0, len(s), 16384):
        least = np.minimum(least, ((s[None, lo:lo + 16384] * _MULTIPLIERS[:, None]) >> np.uint64(32)).min(axis=1))
    return (least & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16)


def set_bits(s):
    """BITS-wide bitmap of a set: a bit that only one of two sets has stands for at least one element that only it has."""
    flags = np.zeros(BITS, np.uint8)
    flags[(s & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(flags).tobytes()


def _sketches(width):
    def run(batches):
        cache = _Words()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            for lo, hi in grouped(texts):
                sizes, digests, rows, bits = [], [], [], []
                for s in shingle_sets(texts[lo:hi], width, cache):
                    sizes.append(len(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    rows.append(minwise(s) if len(s) else None)
                    bits.append(set_bits(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(rows, pa.list_(pa.int16())), pa.array(bits, pa.binary())],
                                                 ["doc_id", "n_shingles", "class", "minwise", "bits"])
    return run


def _full_sets(width):
    def run(batches):
        cache = _Words()
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for lo, hi in grouped(texts):
                sets = list(shingle_sets(texts[lo:hi], width, cache))
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["class", "shingles"])
    return run


def _branch(rows, parent):
    """The nodes a class goes to from node `parent` (a column): the path selects one coordinate, and by a coin a second."""
    def pick(salt):
        return F.pmod(F.xxhash64(parent, F.lit(salt)), F.lit(COORDINATES)).cast("int")
    chosen = F.when(F.xxhash64(parent, F.lit("coin")) % 2 == 0, F.array(pick("first"), pick("second"))).otherwise(F.array(pick("first")))
    nodes = F.array_distinct(F.transform(chosen, lambda c: F.xxhash64(parent, c, F.get("minwise", c))))
    return rows.withColumn("_children", nodes).withColumn("node", F.explode("_children")).drop("_children")


def _roots(classes):
    """Level-one rows (node, class, n, minwise, ...) of all trees."""
    trees = classes.withColumn("_tree", F.explode(F.array(*[F.lit(t).cast("bigint") for t in range(TREES)])))
    return _branch(trees, F.xxhash64("_tree")).drop("_tree")


def _candidates(node, sizes, sig, component, guest, bits, least, ratio):
    """Index pairs within equal nodes of sorted rows whose sizes, minwise values and set bitmaps allow the threshold, with the
    number of equal minwise values. Rows of one component and two guests are not paired."""
    first, second, equal = [], [], []
    live = np.arange(len(node))
    for d in range(1, len(node)):
        live = live[live + d < len(node)]
        live = live[node[live] == node[live + d]]
        if not len(live):
            break
        i, j = live, live + d
        ok = np.minimum(sizes[i], sizes[j]) >= ratio * np.maximum(sizes[i], sizes[j]) - 1e-9
        if component is not None:
            ok &= component[i] != component[j]
        if guest is not None:
            ok &= ~(guest[i] & guest[j])
        i, j = i[ok], j[ok]
        same = (sig[i] == sig[j]).sum(axis=1)
        ok = same >= least
        if bits is not None and ok.any():
            i, j, same = i[ok], j[ok], same[ok]
            most = np.minimum(sizes[i] - np.bitwise_count(bits[i] & ~bits[j]).sum(axis=1, dtype=np.int64), sizes[j] - np.bitwise_count(bits[j] & ~bits[i]).sum(axis=1, dtype=np.int64))
            ok = most * (1 + ratio) >= ratio * (sizes[i] + sizes[j]) - 1e-6
        first.append(i[ok]), second.append(j[ok]), equal.append(same[ok])
    if not first:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(first), np.concatenate(second), np.concatenate(equal)


def _forest(i, j, weight, size):
    """Positions of the pairs that form a maximum spanning forest."""
    root, keep = list(range(size)), []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for k in np.argsort(-weight, kind="stable").tolist():
        a, b = find(int(i[k])), find(int(j[k]))
        if a != b:
            root[a] = b
            keep.append(k)
    return np.array(keep, np.int64)


def _compare(threshold, whole_nodes, cross_only):
    """Compares rows sorted by (block, class), block by block. Emits candidate pairs; with `whole_nodes` false also one row
    (node, null, null) for every node of which only a forest was kept. Blocks hold at most about twice NODE_LIMIT rows."""
    sigma = math.sqrt(threshold * (1 - threshold) / COORDINATES)
    least = math.floor((threshold - SLACK * sigma) * COORDINATES)

    def blocks(batches):
        kept = None
        for batch in batches:
            t = pa.Table.from_batches([batch] if kept is None else [kept, batch]).combine_chunks().to_batches()
            if not t:
                continue
            t = t[0]
            block = t.column("block").to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(block != block[-1], False)) if len(block) and block[0] == block[-1] else int(np.flatnonzero(block != block[-1])[-1]) + 1
            kept = t.slice(cut)
            if cut:
                yield t.slice(0, cut)
        if kept is not None and kept.num_rows:
            yield kept

    def run(batches):
        for t in blocks(batches):
            n = t.num_rows
            block, node = (t.column(c).to_numpy(zero_copy_only=False) for c in ("block", "node"))
            sizes = t.column("n").to_numpy(zero_copy_only=False)
            sig = t.column("minwise").flatten().to_numpy(zero_copy_only=False).reshape(n, COORDINATES)
            component = guest = bits = None
            if "bits" in t.schema.names:
                guest = t.column("guest").to_numpy(zero_copy_only=False)
                bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(n, BITS // 64)
            if cross_only:
                component = t.column("component").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            i, j, equal = _candidates(block, sizes, sig, component, guest, bits, least, threshold)
            flagged = np.zeros(0, np.int64)
            if not whole_nodes and len(i):
                starts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [n]])
                which = np.searchsorted(starts, i, side="right") - 1
                order = np.argsort(which, kind="stable")
                i, j, equal, which = i[order], j[order], equal[order], which[order]
                edges = np.concatenate([[0], np.flatnonzero(np.diff(which)) + 1, [len(which)]])
                keep, cut_nodes = [], []
                for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    b = which[lo]
                    members = int(starts[b + 1] - starts[b])
                    if hi - lo > DENSE * members:
                        keep.append(lo + _forest(i[lo:hi] - starts[b], j[lo:hi] - starts[b], equal[lo:hi], members))
                        cut_nodes.append(node[starts[b]])
                    else:
                        keep.append(np.arange(lo, hi))
                keep = np.concatenate(keep)
                i, j, flagged = i[keep], j[keep], np.array(cut_nodes, np.int64)
            names = t.column("class")
            none = pa.nulls(len(flagged), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.nulls(len(i), pa.int64()), pa.array(flagged, pa.int64())]), pa.concat_arrays([names.take(pa.array(i)).cast(pa.binary()), none]),
                                              pa.concat_arrays([names.take(pa.array(j)).cast(pa.binary()), none])], ["node", "a", "b"])
    return run


def _in_blocks(rows, threshold, whole_nodes, cross_only=False):
    columns = ["block", "node", "class", "n", "minwise"] + [c for c in ("component", "guest", "bits") if cross_only and c in rows.columns]
    dealt = rows.select(*columns).repartition("block").sortWithinPartitions("block", "class")
    return dealt.mapInArrow(_compare(threshold, whole_nodes, cross_only), "node bigint, a binary, b binary")


def _confirm(pairs, docs, members, threshold, width):
    """The pairs whose full shingle sets reach the threshold. Only texts of classes in a pair are read again."""
    ids = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
    ids = small_side(stored(ids.join(members, "class").select(F.col("first_id").alias("_id")).distinct(), "pair-members"), 24)
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(F.col("_id")), "left_semi").select(text_of("text").alias("text"))
    sets = texts.mapInArrow(_full_sets(width), "class binary, shingles array<bigint>").dropDuplicates(["class"])
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("_sa"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("_sb"))
    both = pairs.join(left, "a").join(right, "b")
    shared = both.select("a", "b", F.size(F.array_intersect("_sa", "_sb")).alias("_i"), (F.size("_sa") + F.size("_sb")).alias("_n"))
    percent = round(threshold * 100)
    return shared.filter(100 * F.col("_i") >= percent * (F.col("_n") - F.col("_i"))).select("a", "b")


def components(links):
    """(id, component) for every id in the links (a, b): the least id it is connected to. Alternates large-star and
    small-star steps on a stored edge table until it stops changing; a hub's edges are only ever reduced by key. Tables are
    written in files of about EDGES_PER_FILE edges, never more edges than before."""
    def state(e):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def least(e):
        return e.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while (now := state(edges)) != before:
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("_m").alias("v")).filter("u <> v").distinct()
        small = large.join(least(large), "u")
        small = small.select(F.col("v").alias("u"), F.col("_m").alias("v")).union(small.select("u", F.col("_m").alias("v"))).filter("u <> v").distinct()
        edges = stored(small.coalesce(8 + now[0] // EDGES_PER_FILE), "edges")
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def _relabel(links, found):
    """Links between classes as links between the components already found."""
    for side in ("a", "b"):
        links = links.join(found.select(F.col("id").alias(side), F.col("component").alias("_c")), side, "left").withColumn(side, F.coalesce("_c", side)).drop("_c")
    return links


def _second_round(classes, bits, flagged, comps, threshold):
    """Candidates between components in the nodes that the first round cut short. Small nodes are compared in full; nodes with
    one component in the majority are dense and handled by `_dense`; the others branch, down to MOST_LEVELS."""
    labelled = classes.join(comps.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    labelled = stored(labelled, "labelled-classes")
    rows = _roots(labelled).join(small_side(flagged, 24), "node", "left_semi")
    parts = []
    for level in range(1, MOST_LEVELS + 1):
        shape = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("_lo"), F.max("component").alias("_hi"))
        mixed = stored(shape.filter("_lo <> _hi").select(F.col("node").alias("_node"), "size"), f"sizes-{level}")
        rows = rows.join(small_side(mixed, 32), F.col("node") == F.col("_node")).drop("_node")
        large = mixed.filter(F.col("size") > NODE_LIMIT).limit(1).count()
        rows = stored(rows, f"mixed-{level}") if large else rows           # several readers from here on
        parts.append(_in_blocks(rows.filter(F.col("size") <= NODE_LIMIT).withColumn("block", F.col("node")), threshold, True, True))
        if not large:
            break
        rows = rows.filter(F.col("size") > NODE_LIMIT)
        per = rows.groupBy("node", "component").agg(F.count(F.lit(1)).alias("_k"), F.first("size").alias("size"))
        top = per.groupBy("node").agg(F.max_by("component", F.struct("_k", "component")).alias("_top"), (F.max("_k") * 2 >= F.max("size")).alias("_dense"))
        top = stored(top, f"majorities-{level}")
        last = level == MOST_LEVELS
        parts.append(_dense(rows.join(small_side(top if last else top.filter("_dense"), 64), "node"), bits, threshold))
        if last:
            break
        rows = rows.join(small_side(top.filter("not _dense").select("node"), 24), "node", "left_semi").drop("size").withColumnRenamed("node", "_parent")
        rows = _branch(rows, F.col("_parent")).drop("_parent")
    pairs = parts[0]
    for p in parts[1:]:
        pairs = pairs.union(p)
    return pairs.select("a", "b").distinct()


def _dense(rows, bits, threshold):
    """Nodes that stay large: the largest component is cut into blocks and every other row visits all blocks of its node, so
    each pair of different components meets and pairs inside the largest are never formed. Bitmaps of the sets bound the
    intersections from above, which leaves few pairs below the threshold to be confirmed."""
    blocks = F.ceil(F.col("size") / DENSE_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("class"), blocks).cast("int")
    visits = F.when(F.col("component") == F.col("_top"), F.array(own)).otherwise(F.sequence(F.lit(0), blocks - 1))
    placed = rows.join(bits, "class").withColumn("_part", F.explode(visits)).withColumn("block", F.xxhash64("node", "_part"))
    return _in_blocks(placed.withColumn("guest", (F.col("component") != F.col("_top")) & (F.col("_part") > 0)), threshold, True, True)


def near_duplicates(docs, shingle=5, threshold=0.8):
    """doc_id, n_shingles, component_id and kept for every row of `docs` (doc_id, text).

    Documents are linked where their shingle sets have a Jaccard similarity of at least `threshold`; component_id is the
    smallest doc_id reachable over links, and kept says that it is the row's own. Texts without words have an empty set and
    are linked with nothing. Repeated rows with one doc_id all keep; rows with equal ids and different texts are judged
    by their text. Null doc_ids are linked like others, but are never a component's smallest id unless it has no other."""
    docs = docs.select("doc_id", "text")
    base = stored(docs.select("doc_id", text_of("text").alias("text")).mapInArrow(_sketches(shingle), "doc_id bigint, n_shingles bigint, class binary, minwise array<smallint>, bits binary"), "sketches")
    filled = base.filter("class is not null")
    classes = stored(filled.groupBy("class").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("minwise").alias("minwise"), F.first("bits").alias("bits")), "classes")
    members = classes.select("class", "first_id")
    sketches = classes.drop("first_id", "bits")

    rows = _roots(sketches)
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > NODE_LIMIT)
    big = stored(sizes.withColumnRenamed("node", "_node"), "large-nodes")
    parts = F.ceil(F.col("_size") / NODE_LIMIT).cast("int")
    block = F.when(F.col("_node").isNull(), F.col("node")).otherwise(F.xxhash64("node", F.pmod(F.xxhash64("class"), parts)))
    placed = rows.join(small_side(big, 32), F.col("node") == F.col("_node"), "left").withColumn("block", block)
    first = stored(_in_blocks(placed, threshold, False).distinct(), "first-round")
    links = stored(_confirm(stored(first.filter("node is null").select("a", "b"), "pairs"), docs, members, threshold, shingle), "links")
    flagged = stored(first.filter("node is not null").select("node").union(big.select(F.col("_node").alias("node"))).distinct(), "cut-nodes")
    comps = stored(components(links), "components")
    named = members.join(comps.withColumnRenamed("id", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    if flagged.limit(1).count():
        more = stored(_second_round(sketches, classes.select("class", "bits"), flagged, comps, threshold), "second-round")
        joined = components(_relabel(_confirm(more, docs, members, threshold, shingle), comps)).withColumnRenamed("component", "_joined")
        named = named.join(joined, F.col("component") == F.col("id"), "left").withColumn("component", F.coalesce("_joined", "component")).drop("id", "_joined")
    named = stored(named, "class-components")
    label = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_class = named.join(label, "component").select("class", "component_id")
    out = base.select("doc_id", "n_shingles", "class").join(by_class, "class", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
