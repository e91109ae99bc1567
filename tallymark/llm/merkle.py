"""A Merkle manifest of a dataset, kept by appends, with a witness for every row.

Leaves stand in (source, doc_id) order. They are appended to aligned blocks of 3^7 leaves. Inside a block an appender keeps the
open subtrees; a leaf's witness is attached to the subtree that holds it and grows by two siblings whenever a run of three is
complete. Block roots are appended to blocks of the next group in the same way, until one node per source is left; these
subroots, in order of source, are appended to the tree of the dataset. A witness is therefore kept in segments, one per block
on the way up, so a later append rewrites only the last, open block of each group of a source and never a closed one.
"""
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import small_side, stored

FAN = 3
BLOCK_LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "source string, pos bigint, digest binary, witness binary, doc_id bigint, changed binary, root boolean"


def _digest(*fields):
    """sha256 (32 bytes) of the fields, each as `-` if null, else its UTF-8 byte count, `:` and its text."""
    def one(f):
        s = f.cast("string")
        return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))
    return F.unhex(F.sha2(F.concat(*[one(f) for f in fields]), 256))


def leaves(docs, changed=None):
    """source, doc_id, digest of every row of `docs`; `changed` (rows as they are found later: a column in place of the text,
    null where the text still stands) adds the digest of the changed row."""
    cols = {c: F.col(c) for c in FIELDS}
    later = F.lit(None).cast("binary") if changed is None else F.when(changed.isNotNull(), _digest(*{**cols, "text": changed}.values()))
    return docs.select("source", "doc_id", _digest(*cols.values()).alias("digest"), later.alias("changed"))


def _place(rows, by, order):
    """Adds `pos`, the 0-based rank along `order` inside `by`. Rows are dealt by ranges of (by, order), so a large group spans
    many tasks; a table of one row per group and range carries the offsets. Equal rows are told apart by where they were read."""
    dealt = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*by, *order, "_at").sortWithinPartitions(*by, *order, "_at")
    dealt = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "placed")
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    runs = dealt.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stored(runs.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_run"), "_shift"), "runs")
    on = F.col("_part") == F.col("_run")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = dealt.join(small_side(runs, 200), on)
    return out.withColumn("pos", F.col("_at") + F.col("_shift")).select(*rows.columns, "pos")


class Appender:
    """The open subtrees of one block. A subtree is (digest, first leaf, end of its leaves)."""

    def __init__(self):
        self.open, self.witnesses = [], []

    def append(self, digest):
        node, level = (digest, len(self.witnesses), len(self.witnesses) + 1), 0
        self.witnesses.append([])
        while node:
            if level == len(self.open):
                self.open.append([])
            self.open[level].append(node)
            node = self._close(level) if len(self.open[level]) == FAN else None
            level += 1

    def _close(self, level):
        """Completes the run that is open at `level`: every leaf below gets its subtree's siblings. Returns the parent."""
        run, self.open[level] = self.open[level], []
        for i, (_, lo, hi) in enumerate(run):
            siblings = b"".join(d for k, (d, _, _) in enumerate(run) if k != i)
            for w in self.witnesses[lo:hi]:
                w.append(siblings)
        return hashed(*[d for d, _, _ in run]), run[0][1], run[-1][2]

    def seal(self, levels):
        """Completes the short runs up to height `levels`, where one node is left, and returns its digest."""
        self.open += [[] for _ in range(levels + 1 - len(self.open))]
        for level in range(levels):
            if self.open[level]:
                self.open[level + 1].append(self._close(level))
        return self.open[levels][0][0]


def hashed(*digests):
    return sha256(b"".join(digests).hex().encode()).digest()


def levels_of(n):
    """Levels above n nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _seal_blocks(block_levels):
    """Rows sorted by (source, block, pos) become segments of witnesses, followed by one root row per block."""
    def sealed(key, rows, block):
        source, number, n = key
        root = block.seal(min(block_levels, levels_of(n)))
        out = [[source] * len(rows) + [source], [r["pos"] for r in rows] + [number], [r["digest"] for r in rows] + [root], [b"".join(w) for w in block.witnesses] + [None],
               [r["doc_id"] for r in rows] + [None], [r["changed"] for r in rows] + [None], [False] * len(rows) + [True]]
        types = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["source", "pos", "digest", "witness", "doc_id", "changed", "root"])

    def run(batches):
        key, rows, block = None, [], Appender()
        for batch in batches:
            for row in batch.to_pylist():
                here = (row["source"], row["block"], row["n"])
                if here != key and rows:
                    yield sealed(key, rows, block)
                    rows, block = [], Appender()
                key = here
                rows.append(row)
                block.append(row["digest"])
        if rows:
            yield sealed(key, rows, block)
    return run


@dataclass
class Manifest:
    """A manifest with blocks of 3^block_levels. `groups[0]` holds the leaves (source, pos, digest, witness segment, doc_id, changed), `groups[g]` the block roots of the
    group below, `top` one root per source (source, pos 0, digest), `counts` the leaves per source (source, n)."""
    block_levels: int = BLOCK_LEVELS
    groups: list = field(default_factory=list)
    top: object = None
    counts: object = None

    @property
    def block(self):
        return FAN ** self.block_levels


def _same_source(left, right):
    return left["source"].eqNullSafe(right["source"])


def _climb(manifest, new, counts):
    """Appends nodes (source, pos, digest, doc_id, changed) to the lowest group and whatever they touch to the groups above."""
    groups, changed_nodes, g, size = [], new, 0, manifest.block
    none = {"witness": F.lit(None).cast("binary"), "doc_id": F.lit(None).cast("bigint"), "changed": F.lit(None).cast("binary")}
    while True:
        old = manifest.groups[g] if g < len(manifest.groups) else manifest.top.withColumns(none) if manifest.groups and g == len(manifest.groups) else None
        rows, untouched = changed_nodes, None
        if old is not None:
            old = old.withColumn("block", F.floor(F.col("pos") / size))
            touched = small_side(stored(changed_nodes.select("source", F.floor(F.col("pos") / size).alias("block")).distinct(), "touched"), 200)
            same_block = _same_source(old, touched) & (old["block"] == touched["block"])
            replaced = changed_nodes.select("source", "pos")
            untouched = old.join(touched, same_block, "left_anti").drop("block")
            reopened = old.join(touched, same_block, "left_semi")
            reopened = reopened.join(replaced, _same_source(reopened, replaced) & (reopened["pos"] == replaced["pos"]), "left_anti")
            rows = reopened.select(*changed_nodes.columns).unionByName(changed_nodes)
        n = F.ceil(F.col("n") / F.lit(float(size ** g))).cast("bigint") if g else F.col("n")
        named = counts.select(F.col("source").alias("_source"), n.alias("n"))
        placed = rows.withColumn("block", F.floor(F.col("pos") / size)).join(small_side(named, 100), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        dealt = placed.repartition("source", "block").sortWithinPartitions("source", "block", "pos")
        done = stored(dealt.mapInArrow(_seal_blocks(manifest.block_levels), NODE), f"segments-{g}")
        segments = done.filter("not root").drop("root")
        groups.append(segments if untouched is None else stored(segments.unionByName(untouched.select(*segments.columns)), f"group-{g}"))
        roots = done.filter("root").select("source", "pos", "digest", "doc_id", "changed")
        if not counts.filter(F.col("n") > size ** (g + 1)).limit(1).count():
            top = roots.select("source", "pos", "digest")
            if manifest.top is not None:
                rest = manifest.top.join(top, _same_source(manifest.top, top), "left_anti")
                top = top.unionByName(rest)
            return Manifest(manifest.block_levels, groups, stored(top, "subroots"), counts)
        changed_nodes, g = roots, g + 1


def append(docs, manifest=None, changed=None, block_levels=BLOCK_LEVELS):
    """The manifest with the rows of `docs` appended: in each source they follow what it holds, in order of doc_id (nulls first;
    rows that share one by digest). Appends are aligned: a source's later batch must hold larger ids for the order to be that of
    one append of everything. An empty batch changes nothing. Columns other than FIELDS are not read."""
    manifest = manifest or Manifest(block_levels)
    new = leaves(docs, changed)
    if manifest.counts is None:
        placed = _place(new, ["source"], ["doc_id", "digest"])
        return _climb(manifest, placed, stored(placed.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "counts"))
    held = manifest.counts.withColumnRenamed("source", "_source").withColumnRenamed("n", "_n")
    placed = _place(new, ["source"], ["doc_id", "digest"]).join(small_side(held, 100), F.col("source").eqNullSafe(F.col("_source")), "left")
    placed = stored(placed.withColumn("pos", F.col("pos") + F.coalesce("_n", F.lit(0))).drop("_source", "_n"), "leaves")
    counts = stored(manifest.counts.unionByName(placed.groupBy("source").agg(F.count(F.lit(1)).alias("n"))).groupBy("source").agg(F.sum("n").alias("n")), "counts")
    return _climb(manifest, placed, counts)


def _whole_witness(manifest, name):
    """Block witnesses of the lowest group's blocks: (source, block, tail), the siblings of all groups above joined together."""
    tail = None
    for g in range(len(manifest.groups) - 1, 0, -1):
        seg = manifest.groups[g].select("source", "pos", "witness")
        if tail is not None:
            up = small_side(stored(tail.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "tail"), f"{name}-{g}"), 2000)
            seg = seg.join(up, F.col("source").eqNullSafe(F.col("_source")) & (F.floor(F.col("pos") / manifest.block) == F.col("_block")))
            seg = seg.withColumn("witness", F.concat("witness", "tail"))
        tail = seg.select("source", F.col("pos").alias("block"), F.col("witness").alias("tail"))
    return tail


def witnesses(manifest):
    """Every leaf (source, doc_id, pos, n, digest, changed) with its subroot, the root, and its whole witness: the siblings up to
    its subroot (`witness`), the place of the source among all (`source_pos`, `n_sources`) and the siblings from there to the
    root (`source_witness`)."""
    # the dataset's tree has the subroots as leaves; their sources are found again by position
    sources = stored(_place(manifest.top.select("source", "digest").withColumn("_all", F.lit(0)), ["_all"], ["source"]).drop("_all"), "source-places")
    none = {t: F.lit(None).cast(t) for t in ("string", "bigint", "binary")}
    nodes = sources.select(none["string"].alias("source"), "pos", "digest", none["bigint"].alias("doc_id"), none["binary"].alias("changed"))
    whole = _climb(Manifest(manifest.block_levels), nodes, stored(sources.groupBy(none["string"].alias("source")).agg(F.count(F.lit(1)).alias("n")), "source-count"))
    root, n_sources = whole.top.first(), whole.counts.first()
    up, own = _whole_witness(whole, "dataset"), whole.groups[0].select("pos", "witness")
    if up is not None:
        up = up.select("block", "tail")
        own = own.join(up, F.floor(F.col("pos") / manifest.block) == F.col("block")).select("pos", F.concat("witness", "tail").alias("witness"))
    per_source = sources.select(F.col("source").alias("_source"), F.col("pos").alias("source_pos"), F.col("digest").alias("subroot")).join(own.select(F.col("pos").alias("source_pos"), F.col("witness").alias("source_witness")), "source_pos")
    per_source = per_source.join(manifest.counts.select(F.col("source").alias("_counted"), "n"), F.col("_source").eqNullSafe(F.col("_counted"))).drop("_counted")
    per_source = per_source.withColumn("root", F.unhex(F.lit(root["digest"].hex() if root else None))).withColumn("n_sources", F.lit(n_sources["n"] if n_sources else 0))
    rows = manifest.groups[0].join(small_side(stored(per_source, "per-source"), 2000), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    tail = _whole_witness(manifest, "blocks")
    if tail is not None:
        tail = small_side(stored(tail.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "tail"), "block-witnesses"), 2000)
        rows = rows.join(tail, F.col("source").eqNullSafe(F.col("_source")) & (F.floor(F.col("pos") / manifest.block) == F.col("_block")))
        rows = rows.withColumn("witness", F.concat("witness", "tail"))
    return rows.select("source", "doc_id", "pos", "n", "digest", "changed", "subroot", "root", "witness", "source_pos", "n_sources", "source_witness")


def fold(digest, pos, n, siblings):
    """The root that a leaf's digest and its siblings lead to in a tree of n leaves."""
    at = 0
    while n > 1:
        others = min(FAN, n - pos // FAN * FAN) - 1
        run = [siblings[at + 32 * k:at + 32 * (k + 1)] for k in range(others)]
        run.insert(pos % FAN, digest)
        digest, at, pos, n = hashed(*run), at + 32 * others, pos // FAN, -(-n // FAN)
    return digest


def _verified(batches):
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            proof = r["witness"] + r["source_witness"]
            top = fold(r["changed"] or r["digest"], r["pos"], r["n"], r["witness"])
            top = fold(top, r["source_pos"], r["n_sources"], r["source_witness"])
            out.append((r["doc_id"], r["digest"].hex(), r["subroot"].hex(), r["root"].hex(), sha256(proof.hex().encode()).hexdigest(), top.hex(), top == r["root"]))
        types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def verify(manifest):
    """doc_id, leaf, subroot, root, proof_sha256 (of the whole witness in hexadecimal), folded_root (of the changed row where there
    is one) and verified for every leaf. A dataset of one row has an empty witness; an empty dataset has no rows."""
    return witnesses(manifest).drop("source").mapInArrow(_verified, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def without_newlines(docs):
    """The tampering of the query: where 2 divides crc32 of the decimal doc_id, the text without its line breaks. Rows without
    an id or a text stay as they are."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate(F.col("text"), "\n", ""))


__all__ = ["Appender", "Manifest", "append", "fold", "leaves", "verify", "witnesses", "without_newlines"]
