"""Draws of the group bootstrap and what is summed over them.

A draw of a stratum with N units picks N times among them. The slots of a sample pick by a counter hash (two rounds of a public 32-bit
integer mixer over the stratum's digest, the sample and the slot), so every engine and every partitioning draws alike. Unit sums
are small: where they fit a small broadcast, by count, every task holds them once as arrays, turns a block of samples into
multiplicities and adds up without any shuffle; only totals per sample leave it. Beyond that, blocks of units are dealt out; a task
draws the slots of its block's stratum again, keeps the picks of its own units and emits totals too. Both ways give the same rows.

Curve metrics need no curve per draw: rows are ranked by confidence once, and a draw only changes their weights. Beyond a broadcast,
blocks of rows next to each other in confidence are dealt out instead, after the totals above each block are known.
"""
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import spread
from ..functions.text import h60
from ..session import settle, written

MIXER = 0x45D9F3B                   # multiplier of the mixer, below 2^27, so that no product leaves 64 bits (fixed value)
WORD, LOW = (1 << 32) - 1, (1 << 28) - 1
SAMPLES_AT_ONCE = 8
ROWS_AT_ONCE = 1 << 21              # rows of one dealt block; more where units are more, because every block draws them again,
ROWS_AT_MOST = 1 << 22              # but at most so many,
SLIM_ROWS_AT_MOST = 1 << 23         # or so many of the few columns that a curve needs
SLOTS_AT_ONCE = 1 << 15
LEVELS_AT_ONCE = 1 << 15
PICKS_IN_A_BYTE = 255
MANY_CELLS = 256
MOSTLY = 4                          # a block's units x cells are laid out whole while they are at most this many times its rows,
LAID_OUT = 1 << 25                  # and at most so many numbers
HELD_BYTES = 8 << 20                # arrays that pass through the driver: what it collects and turns over is some 20 times as large


def _mix(x):
    for _ in range(2):
        x = ((x >> np.uint64(16)) ^ x) * np.uint64(MIXER) & np.uint64(WORD)
    return (x >> np.uint64(16)) ^ x


def multiplicities(samples, keys, sizes):
    """Matrix (units, samples): how often each sample picks each unit, strata one after the other."""
    offset = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(sizes)), sizes)
    unit = (np.arange(len(of)) - offset[of] + 1).astype(np.uint64)
    slot, size, base = unit & np.uint64(WORD), sizes.astype(np.uint64)[of], offset[of]
    out = np.empty((len(of), len(samples)))
    for k, s in enumerate(samples):
        if s < 0:
            out[:, k] = 1
            continue
        c = _mix((keys >> np.uint64(28)) + np.uint64(s) & np.uint64(WORD))
        d = _mix(keys & np.uint64(LOW) ^ c)
        hi, lo = _mix(c[of] ^ slot), _mix(d[of] + unit & np.uint64(WORD))
        pick = (hi * np.uint64(LOW + 1) + (lo & np.uint64(LOW))) % size
        out[:, k] = np.bincount(base + pick.astype(np.int64), minlength=len(of))
    return out


def _codes(table, columns):
    """(dense code per row, first row of each code) of the combinations of `columns`; null is a value of its own."""
    code = np.zeros(table.num_rows, np.int64)
    for c in columns:
        d = table.column(c).combine_chunks().dictionary_encode()
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        mine = d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code * (len(d.dictionary) + 1) + mine, return_inverse=True)[1].reshape(-1)
    _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
    return inverse.reshape(-1), first


def _tagged(sums, units, seed, strata, group, columns, row_bytes):
    """Unit sums with unit, units and the stratum's key, their number, and whether they fit a broadcast at `row_bytes` a row."""
    rows = sums.join(units, [strata, group]).withColumn("key", h60(F.lit(seed), F.col(strata)))
    rows = settle(rows.select(strata, "key", "unit", "units", *[c for c in columns if c != strata]))
    count = rows.count()
    return rows, count, count * row_bytes <= HELD_BYTES


def _arrays(rows, strata):
    """(table, place of each row's unit, keys, sizes): the strata one after the other."""
    table = rows.toArrow()
    of, first = _codes(table, [strata])
    column = lambda c, at=slice(None): table.column(c).to_numpy()[at]
    keys, sizes = column("key", first).astype(np.uint64), column("units", first).astype(np.int64)
    return table, (np.cumsum(sizes) - sizes)[of] + column("unit") - 1, keys, sizes


def _per_sample(spark, samples, fn, schema):
    """Rows that `fn(sample numbers)` yields for -1 .. samples-1, in blocks dealt over the cluster."""
    blocks = -(-(samples + 1) // SAMPLES_AT_ONCE)

    def run(batches):
        for batch in batches:
            s = batch.column(0).to_numpy()
            for lo in range(0, len(s), SAMPLES_AT_ONCE):
                yield fn(s[lo:lo + SAMPLES_AT_ONCE])
    # whole blocks per task, as many tasks as there are cores to use
    tasks = min(blocks, max(1, spark.sparkContext.defaultParallelism))
    return spark.range(-1, samples, 1, tasks).mapInArrow(run, schema)


def _counts(sample, key, size, lo, hi):
    """How often the sample picks each of the units lo+1 .. hi of one stratum. All its slots are drawn in short runs, in 32-bit steps that
    stay in a core's cache."""
    if sample < 0:
        return np.ones(hi - lo, np.int64)
    c = _mix(np.uint64(((key >> 28) + sample) & WORD))
    d = np.uint32(_mix(np.uint64(key & LOW) ^ c))
    c, whole, wide = np.uint32(c), hi - lo == size, np.uint64(size)
    run = min(SLOTS_AT_ONCE, size)
    slots, high, low, spare = np.arange(1, run + 1, dtype=np.uint32), *(np.empty(run, np.uint32) for _ in range(3))
    pick, times = np.empty(run, np.uint64), np.empty(run, np.uint64)
    kept = [np.empty(size, np.int64)] if whole else []
    for start in range(0, size, SLOTS_AT_ONCE):
        here = slice(0, min(SLOTS_AT_ONCE, size - start))
        h, w, p, q = high[here], low[here], pick[here], times[here]
        np.add(slots[here], np.uint32(start & WORD), out=w)
        np.bitwise_xor(w, c, out=h)
        np.add(w, d, out=w)                                             # wraps at 32 bits, as the masked sum does
        _mix32(h, spare[here])
        _mix32(w, spare[here])
        np.bitwise_and(w, np.uint32(LOW), out=w)
        np.multiply(h, np.uint64(LOW + 1), out=p)
        np.add(p, w, out=p)
        np.floor_divide(p, wide, out=q)
        np.multiply(q, wide, out=q)
        np.subtract(p, q, out=p)
        found = p.view(np.int64)
        if whole:
            kept[0][start:start + len(found)] = found
        else:
            kept.append(found[(found >= lo) & (found < hi)] - lo)
    return np.bincount(kept[0] if whole else np.concatenate(kept), minlength=hi - lo)


def _mix32(x, spare):
    for _ in range(2):
        np.right_shift(x, np.uint32(16), out=spare)
        np.bitwise_xor(x, spare, out=x)
        np.multiply(x, np.uint32(MIXER), out=x)                         # wraps at 32 bits, as the masked product does
    np.right_shift(x, np.uint32(16), out=spare)
    np.bitwise_xor(x, spare, out=x)


def _filled(table, name):
    """(values with 0 for null, whether a row has one) of a column."""
    column = table.column(name).combine_chunks()
    return column.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _cells(table, by):
    """(rows in the order of their cells, first of each cell and the end, one row of `by` per cell)."""
    cell, first = _codes(table, by)
    order = np.argsort(cell, kind="stable")
    return order, np.append(np.flatnonzero(np.diff(cell[order], prepend=-1)), len(order)), table.select(by).take(pa.array(first))


def _block_sums(by, values, samples, width, pieces):
    """Function from the rows of one block of a stratum's units to what every sample of a piece adds up over them, per cell."""
    def run(table):
        key, size, piece = (table.column(c)[0].as_py() for c in ("key", "units", "_piece"))
        lo = table.column("_block")[0].as_py() * width
        hi = min(lo + width, size)
        order, bounds, named = _cells(table, by)
        at = (table.column("unit").to_numpy() - 1 - lo)[order]
        filled = [_filled(table, c) for c in values]
        known = [valid[order].astype(np.float64) for _, valid in filled if not valid.all()]      # a column without nulls is known wherever a row is
        x = np.column_stack([v[order] for v, _ in filled] + known + [np.ones(len(order))])
        k, cells, mine = len(values), len(bounds) - 1, range(piece - 1, samples, pieces)
        spots = iter(range(k, x.shape[1] - 1))
        seen = [-1 if valid.all() else next(spots) for _, valid in filled]
        out = np.empty((len(mine), cells, x.shape[1]))
        whole = np.zeros((hi - lo, cells * x.shape[1])) if (hi - lo) * cells <= min(MOSTLY * len(order), LAID_OUT // x.shape[1]) else None
        if whole is not None:
            spot = at * cells + np.repeat(np.arange(cells), np.diff(bounds))
            for j in range(x.shape[1]):
                whole[:, j::x.shape[1]] = np.bincount(spot, weights=x[:, j], minlength=(hi - lo) * cells).reshape(hi - lo, cells)
        for i in range(0, len(mine), SAMPLES_AT_ONCE):
            m = np.stack([_counts(s, key, size, lo, hi) for s in mine[i:i + SAMPLES_AT_ONCE]]).astype(np.float64)
            here = slice(i, i + len(m))
            if whole is not None:
                out[here] = (m @ whole).reshape(len(m), cells, x.shape[1])
                continue
            m = np.ascontiguousarray(m.T)[at]
            if cells > MANY_CELLS:
                for j in range(x.shape[1]):
                    out[here, :, j] = np.add.reduceat(m * x[:, j, None], bounds[:-1], axis=0).T
                continue
            for c in range(cells):
                part = slice(bounds[c], bounds[c + 1])
                out[here, c] = m[part].T @ x[part]
        i, c = np.nonzero(out[:, :, -1] > 0)
        out, named = out[i, c], named.take(pa.array(c)).combine_chunks()
        return pa.Table.from_arrays([pa.array(np.array(mine, np.int64)[i]), *named.columns, *[pa.array(out[:, j], mask=out[:, seen[j]] == 0) for j in range(k)]], ["s", *by, *values])
    return run


def _schema(rows, by, values):
    schema = rows.select(*by).schema
    return ", ".join(["s bigint", *[f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields], *[f"`{v}` double" for v in values]])


def _pieces(spark, blocks, least=1):
    """In how many pieces every block takes its samples: few blocks are dealt out to the cores in up to four."""
    return max(least, min(4, -(-2 * spark.sparkContext.defaultParallelism // max(1, blocks))))


def _dealt(rows, keys, pieces, blocks):
    """The rows once per piece, block by block over a fixed number of partitions, so that these are not coalesced by their small size."""
    tasks = blocks * pieces
    spread_over = max((8 if tasks < 128 else 2) * tasks, rows.sparkSession.sparkContext.defaultParallelism)
    pieced = rows.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(pieces - 1).cast("bigint"))))
    return pieced.repartition(spread_over, *keys, "_piece")


def _at_once(units, most):
    """Rows of one dealt block: a block draws the slots of all units, so it should have about as many rows as there are units."""
    return max(ROWS_AT_ONCE, min(units, most))


def _drawn(rows, count, samples, strata, by, values):
    """Sums per sample where the unit sums are too many for a broadcast: blocks of units are dealt out, each adds up its own units'
    rows in every sample, and only (sample, cell) sums leave it. A block draws all slots of its stratum, which is cheap."""
    sizes = rows.groupBy(strata).agg(F.max("units").alias("u")).agg(F.sum("u"), F.count(F.lit(1))).first()
    width = max(1, (sizes[0] or 0) * _at_once(sizes[0] or 0, ROWS_AT_MOST) // max(1, count))
    blocks = -(-(sizes[0] or 0) // width) + sizes[1]
    cells = min(rows.select(*by).distinct().count(), ROWS_AT_ONCE)
    pieces = _pieces(rows.sparkSession, blocks, min(samples + 1, -(-cells * samples // (2 * ROWS_AT_ONCE))))
    dealt = _dealt(rows.withColumn("_stratum", F.col(strata)).withColumn("_block", F.floor((F.col("unit") - 1) / width)), ["_stratum", "_block"], pieces, blocks)
    parts = dealt.groupBy("_stratum", "_block", "_piece").applyInArrow(_block_sums(by, values, samples, width, pieces), _schema(rows, by, values))
    return parts.groupBy("s", *by).agg(*[F.sum(c).alias(c) for c in values])


def _curve_parts(curve):
    """Function from one block of rows that are close in confidence, all strata together, and what lies above them in some samples, to
    the block's part of the curve value in each of these samples."""
    def run(table, above):
        if not above.num_rows or not table.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["_cell", "s", "v"])
        mine, over_n, over_x = (above.column(c).to_numpy() for c in ("s", "_above_n", "_above_x"))
        conf = table.column("conf").to_numpy()
        order = np.argsort(-conf, kind="stable")
        named = table.column("key").combine_chunks().dictionary_encode()
        of, first = named.indices.to_numpy(), np.empty(len(named.dictionary), np.int64)
        first[of] = np.arange(len(of))                                                                  # a row of every stratum
        strata_of = [(table.column("key")[int(f)].as_py(), table.column("units")[int(f)].as_py()) for f in first]
        sizes = np.array([size for _, size in strata_of], np.int64)
        starts = np.cumsum(sizes) - sizes
        place = (starts[of] + table.column("unit").to_numpy() - 1)[order]                               # the strata's units one after the other
        place = place.astype(np.int32) if sizes.sum() < 1 << 31 else place
        n_of, x_of = (_filled(table, c)[0][order] for c in ("n", "x"))
        ends = np.append(np.flatnonzero(np.diff(conf[order]) != 0), len(order) - 1)                      # last row of every level
        single, alone = len(ends) == len(order), bool((n_of == 1).all())
        narrow = alone and bool((x_of <= 1).all())                                                      # picks are small numbers; bytes stay in the cache
        narrow_x = x_of.astype(np.uint8) if narrow else None
        del of, conf, order
        runs = []
        for start in range(0, len(place), LEVELS_AT_ONCE):                                              # runs that stay in a core's cache
            rows = slice(start, min(start + LEVELS_AT_ONCE, len(place)))
            lo, hi = np.searchsorted(ends, (rows.start, rows.stop))
            runs.append((rows, None if single else ends[lo:hi] - start))
        out, run = np.empty(len(mine)), min(LEVELS_AT_ONCE, len(place))
        over_ns, over_es = np.empty(run), np.empty(run)
        room = lambda kind: (kind, np.empty(int(sizes.sum()), kind), np.empty(run, kind), np.empty(run, kind), narrow_x if kind == np.uint8 else x_of)
        kind, counts, weights, errors, x_here = room(np.uint8 if narrow else np.float64)
        for i, sample in enumerate(mine):
            for (key, size), at in zip(strata_of, starts):
                picks = _counts(int(sample), key, size, 0, size)
                if kind == np.uint8 and picks.max() > PICKS_IN_A_BYTE:
                    held = counts
                    kind, counts, weights, errors, x_here = room(np.float64)
                    counts[:at] = held[:at]
                counts[at:at + size] = picks
            cum_n, cum_e, last, parts = over_n[i], over_x[i], over_n[i], []
            for rows, levels in runs:
                w, wrong, n, e = (c[:rows.stop - rows.start] for c in (weights, errors, over_ns, over_es))
                np.take(counts, place[rows], out=w, mode="clip")
                np.multiply(w, x_here[rows], out=wrong)
                if not alone:
                    np.multiply(w, n_of[rows], out=w)
                np.cumsum(w, out=n, dtype=np.float64)
                np.cumsum(wrong, out=e, dtype=np.float64)
                ended = n[-1] + cum_n, e[-1] + cum_e
                if levels is not None:
                    n, e = n[levels], e[levels]
                n += cum_n
                e += cum_e
                cum_n, cum_e = ended
                if levels is not None:
                    w = np.diff(n, prepend=last)
                if len(n):
                    parts.append(curve.part(w, n, e))
                    last = n[-1]
            out[i] = curve.join(np.array(parts))
        cell = np.full(len(mine), table.column("_cell")[0].as_py(), np.int64)
        return pa.Table.from_arrays([pa.array(cell), pa.array(mine.astype(np.int64)), pa.array(out)], ["_cell", "s", "v"])
    return run


def _buckets(rows, by, at_once):
    """Adds `_bucket`: about `at_once` rows of one `by` that are next to each other in confidence, the highest first. Confidences
    are at most 1; the rows at 1 exactly, which may be any number, are a bucket of their own (-1), which is a single level."""
    bin_ = F.coalesce(F.floor(F.col("conf") * 4096), F.lit(-1)).cast("bigint")
    counts = rows.groupBy(*by, bin_.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    above = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(F.col("_bin").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*by, "_bin", F.when(F.col("_bin") >= 4096, -1).otherwise(F.floor(above / at_once)).cast("bigint").alias("_bucket"))
    return spread.join_keys(rows.withColumn("_bin", bin_), counts, [*by, "_bin"]).drop("_bin")


class _Ranked(NamedTuple):
    """Rows dealt to buckets of confidence, and every sample's totals per bucket, for any number of curves."""
    rows: object
    totals: object
    by: list


def _ranked(rows, samples, strata, by):
    sizes = rows.groupBy(strata).agg(F.max("units").alias("u")).agg(F.sum("u")).first()[0] or 0
    rows = written(_buckets(rows, by, _at_once(sizes, SLIM_ROWS_AT_MOST)), "curve")
    cells = [c for c in dict.fromkeys([*by, "_bucket", strata, "key", "unit", "units"])]
    whole = rows.groupBy(*cells).agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    whole = settle(whole)                                     # one row per unit and bucket, no longer per confidence
    totals = _drawn(whole, whole.count(), samples, strata, [*by, "_bucket"], ["n", "x"])
    down = Window.partitionBy(*by, "s").orderBy("_bucket")
    above = lambda c: F.coalesce(F.sum(c).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return _Ranked(rows, settle(totals.select("s", *by, "_bucket", "n", "x", above("n").alias("_above_n"), above("x").alias("_above_x"))), by)


def _ranked_curve(ranked, samples, curve):
    """The curve values where the rows are too many for a broadcast: every sample's totals per bucket of confidences come first, then
    blocks of rows of one bucket take their part of the curve below what lies above them. Where a curve can tell from the totals that a
    bucket has no say in a sample, it is not opened there."""
    rows, totals, by = ranked
    parts, opened = [totals.filter("_bucket < 0").select("s", *by, curve.level(F.col("n"), F.col("x")).alias("v"))], totals.filter("_bucket >= 0")
    if curve.opens is not None:
        end = curve.level(F.col("_above_n") + F.col("n"), F.col("_above_x") + F.col("x"))
        ended = totals.select("*", end.alias("v"), F.max(F.when(end > 0, F.col("_bucket"))).over(Window.partitionBy(*by, "s")).alias("_last"))
        parts = [ended.select("s", *by, "v")]                  # the value at the end of a bucket, which is a level
        opened = ended.filter((F.col("_bucket") >= 0) & (F.col("_last").isNull() | (F.col("_bucket") > F.col("_last"))) & curve.opens(F.col("_above_n") + F.col("n"), F.col("_above_x")))
    few = opened.select(*by, "_bucket").distinct()
    few = settle(few.withColumn("_cell", F.row_number().over(Window.orderBy(*by, "_bucket")).cast("bigint")))         # one row per block
    blocks = few.count()
    pieces = _pieces(rows.sparkSession, blocks)
    slim = spread.join_keys(rows.filter("_bucket >= 0"), spread.counted_broadcast(few, 200), [*by, "_bucket"]) \
        .select("_cell", "conf", "key", *[F.col(c).cast("int").alias(c) for c in ("unit", "units", "n", "x")])
    many = _dealt(slim, ["_cell"], pieces, blocks)
    over = spread.join_keys(opened, spread.counted_broadcast(few, 200), [*by, "_bucket"]).select((F.col("_cell") + 0).alias("_cell"), "s", "_above_n", "_above_x", F.pmod(F.col("s") + 1, F.lit(pieces)).alias("_piece"))
    found = many.groupBy("_cell", "_piece").cogroup(over.groupBy("_cell", "_piece")).applyInArrow(_curve_parts(curve), "_cell bigint, s bigint, v double")
    parts.append(found.join(spread.counted_broadcast(few, 200), "_cell").select("s", *by, "v"))
    whole = totals.groupBy("s", *by).agg(F.sum("n").alias("_n"))
    merged = parts[0].unionByName(parts[1]).groupBy("s", *by).agg(curve.merge("v").alias("v"))
    return spread.join_keys(merged, whole, ["s", *by]).select("s", *by, (F.col("v") / F.col("_n")).alias("v"))


def sums_per_draw(sums, units, samples, seed, by, values, strata="source", group="group_id", broadcast=None):
    """(s, *by, *values): the columns `values` of `sums` (one row per unit and `by`) added up over each sample's picks, for every
    `by` that the sample picks. `units` has stratum, group, unit and units; `broadcast` forces one of the two ways."""
    by, values = list(by), list(values)
    rows, count, fits = _tagged(sums, units, seed, strata, group, [*by, *values], 4 + 8 * len(values))
    if not (fits if broadcast is None else broadcast):
        return _drawn(rows, count, samples, strata, by, values)
    table, place, keys, sizes = _arrays(rows, strata)
    cell, first = _codes(table, by)
    order = np.argsort(cell, kind="stable")
    spark = rows.sparkSession
    starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
    held = spark.sparkContext.broadcast((place[order].astype(np.int32), [table.column(c).to_numpy()[order].astype(np.float64) for c in values], starts, keys, sizes))

    def totals(samples_of_block):
        at, columns, starts, keys, sizes = held.value
        if not len(at):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2 + [pa.array([], pa.float64())] * len(columns), ["s", "cell", *values])
        weight = multiplicities(samples_of_block, keys, sizes)[at]
        out = [np.add.reduceat(weight * c[:, None], starts, axis=0) for c in columns]
        seen = np.add.reduceat(weight, starts, axis=0) > 0
        where = np.nonzero(seen)
        return pa.RecordBatch.from_arrays([pa.array(samples_of_block[where[1]].astype(np.int64)), pa.array(where[0].astype(np.int64)), *[pa.array(o[where]) for o in out]], ["s", "cell", *values])
    drawn = _per_sample(spark, samples, totals, "s bigint, cell bigint, " + ", ".join(f"`{c}` double" for c in values))
    cells = table.select(by).take(pa.array(first)).append_column("cell", pa.array(np.arange(len(first)), pa.int64()))
    if not len(first):
        return drawn.crossJoin(F.broadcast(rows.select(*by).limit(0))).select("s", *by, *values)
    named = spark.createDataFrame(cells, schema=rows.select(*by).schema.add("cell", "long"))
    return drawn.join(F.broadcast(named), "cell").select("s", *by, *values)       # cells are part of the counted rows


def curve_per_draw(sums, units, samples, seed, by, curve, strata="source", group="group_id", broadcast=None):
    """(s, *by, v): `curve(n, cum_n, cum_errors)` over the confidence levels of each `by`, highest first, in every sample. `sums` has one
    row per unit, `by` and confidence with x errors among n rows. None where the rows do not fit a broadcast and `curve` is a plain
    function, which cannot be taken in parts."""
    return curves_per_draw(sums, units, samples, seed, by, [curve], strata, group, broadcast)[0]


def curves_per_draw(sums, units, samples, seed, by, curves, strata="source", group="group_id", broadcast=None):
    """`curve_per_draw` of several curves, which share what does not depend on them."""
    by = list(by)
    rows, count, fits = _tagged(sums, units, seed, strata, group, [*by, "conf", "n", "x"], 20)        # place, n, x and the start of a level
    if fits if broadcast is None else broadcast:
        return [_held_curve(rows, samples, strata, by, curve) for curve in curves]
    ranked = _ranked(rows, samples, strata, by) if any(isinstance(c, Curve) for c in curves) else None
    return [_ranked_curve(ranked, samples, c) if isinstance(c, Curve) else None for c in curves]


def _held_curve(rows, samples, strata, by, curve):
    table, place, keys, sizes = _arrays(rows, strata)
    cell, first = _codes(table, by)
    conf = table.column("conf").to_numpy()
    order = np.lexsort((-conf, cell))
    spark = rows.sparkSession
    new_cell = np.diff(cell[order], prepend=-1) != 0
    levels = np.flatnonzero(new_cell | (np.diff(conf[order], prepend=np.nan) != 0))
    bounds = np.append(np.searchsorted(levels, np.flatnonzero(new_cell)), len(levels))
    held = spark.sparkContext.broadcast((place[order].astype(np.int32), *(table.column(c).to_numpy()[order].astype(np.int32) for c in ("n", "x")), levels, bounds, keys, sizes))

    def values(samples_of_block):
        at, n, x, levels, bounds, keys, sizes = held.value
        s_out, c_out, v_out = [], [], []
        if len(at):
            weight = multiplicities(samples_of_block, keys, sizes)[at]
            rows_of, errors = (np.add.reduceat(weight * c[:, None], levels, axis=0) for c in (n, x))
            for c, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
                cum = rows_of[lo:hi].cumsum(axis=0)
                seen = np.flatnonzero(cum[-1] > 0)
                v = curve(rows_of[lo:hi][:, seen], cum[:, seen], errors[lo:hi][:, seen].cumsum(axis=0))
                s_out.append(samples_of_block[seen]), c_out.append(np.full(len(seen), c)), v_out.append(v)
        whole = [np.concatenate(o) if o else [] for o in (s_out, c_out, v_out)]
        return pa.RecordBatch.from_arrays([pa.array(whole[0], pa.int64()), pa.array(whole[1], pa.int64()), pa.array(whole[2], pa.float64())], ["s", "cell", "v"])
    drawn = _per_sample(spark, samples, values, "s bigint, cell bigint, v double")
    if not len(first):
        return drawn.crossJoin(F.broadcast(rows.select(*by).limit(0))).select("s", *by, "v")
    cells = table.select(by).take(pa.array(first)).append_column("cell", pa.array(np.arange(len(first)), pa.int64()))
    named = spark.createDataFrame(cells, schema=rows.select(*by).schema.add("cell", "long"))
    return drawn.join(F.broadcast(named), "cell").select("s", *by, "v")


class Curve(NamedTuple):
    """A value of the risk-coverage curve that can be taken in parts: `part` of some levels, of one sample or of several (columns),
    cumulated from the highest level of all; `level` the same for levels that are one, as a column; `merge` joins parts as a column and
    `join` as an array, the number of rows divides them. `opens`, if the value is that of a single level, tells as a column whether one
    can be among levels with at most so many rows and at least so many errors up to them; the last such level counts."""
    part: Callable
    level: Callable
    merge: Callable
    join: Callable
    opens: Callable | None = None

    def __call__(self, n, cum_n, cum_errors):
        return self.part(n, cum_n, cum_errors) / cum_n[-1]


# area under the risk-coverage curve of every sample
area = Curve(lambda n, cum_n, cum_errors: (n * cum_errors / np.maximum(cum_n, 1)).sum(axis=0), lambda n, x: x, F.sum, np.sum)


def coverage(budget):
    """The largest accepted share whose errors stay within the budget."""
    within = lambda n, x: x <= F.lit(float(budget)) * n
    return Curve(lambda n, cum_n, cum_errors: np.where(cum_errors <= budget * cum_n, cum_n, 0).max(axis=0), lambda n, x: F.when(within(n, x), n).otherwise(0.0), F.max, np.max, within)
