"""Near vectors against all pairs; deep trees, balls, verified pairs; nulls, zeros, lengths, repeated rows, empty tables."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import vector_forest

ROWS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    usable = [label is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    unit = [np.array(v, np.float32).astype(np.float64) if ok else None for (_, v, _), ok in zip(rows, usable)]
    unit = [None if u is None else u / np.abs(u).max() / np.linalg.norm(u / np.abs(u).max()) for u in unit]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], links[i], least.get(find(i)), r[0] == least.get(find(i))) for i, r in enumerate(rows)), key=str)


def groups(n, sizes, dim=32, noise=0.05, seed=3, labels=2):
    rng = np.random.default_rng(seed)
    rows = [(rng.standard_normal(dim), int(rng.integers(labels))) for _ in range(n)]
    for size in sizes:
        base, label = rng.standard_normal(dim), int(rng.integers(labels))
        rows += [(base + noise * rng.standard_normal(dim) * rng.uniform(0.2, 4), label) for _ in range(size)]
    order = rng.permutation(len(rows))
    return [(int(i), [float(np.float32(x)) for x in rows[k][0]], rows[k][1]) for i, k in enumerate(order)]


def found(spark, rows, **how):
    return sorted(map(tuple, vector_forest.near_vectors(spark.createDataFrame(rows, ROWS), **how).collect()), key=str)


def test_one_leaf_is_exact(spark):
    rows = groups(60, [5, 9, 30, 2, 2])
    assert found(spark, rows) == brute(rows)


def test_defined_results_of_odd_rows(spark):
    rows = groups(10, [4])
    v = rows[0][1]
    rows += [(100, None, 1), (101, [], 1), (102, [0.0] * 32, 1), (103, [math.nan] * 32, 1), (104, [math.inf] + v[1:], 1), (105, [None] + v[1:], 1), (106, v, None), (107, v[:31], rows[0][2]),
             (108, [x * 2 for x in v], rows[0][2]), (109, v, rows[0][2]), (109, v, rows[0][2]), (None, v, rows[0][2]), (None, None, None), (110, [-0.0] * 32, 0), (111, [1e38] * 32, 0), (112, [3e38] * 32, 0)]
    table = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("x") for c in ("row", "leaf", "class", "n_links", "kept")})
    got = vector_forest.near_vectors(table)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert [r[:3] for r in sorted(map(tuple, got.collect()), key=str)] == [r[:3] for r in brute(rows)]
    assert vector_forest.near_vectors(table.limit(0)).collect() == []


@pytest.mark.parametrize("leaf,levels", [(64, 5), (32, 1)])
def test_deep_trees(spark, leaf, levels):
    """Small leaves, so that nodes are split in several rounds: what is linked is exact, what is missed is little, and groups of
    near copies far above a leaf lose none of their links."""
    rows = groups(500, [400] + [3] * 60, noise=0.02)
    got, want = found(spark, rows, leaf=leaf, levels=levels), brute(rows)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)
    assert sum(g[2] == w[2] for g, w in zip(got, want)) >= 0.97 * len(rows)


def test_pairs_near_the_threshold_are_verified(spark):
    """Pairs closer to the threshold than codes can tell are decided by the vectors."""
    base = [1.0, 0.0]
    rows = [(0, base, 1)] + [(k, [math.cos(a), math.sin(a)], 1) for k, a in enumerate((math.acos(0.93) + d for d in (-1e-5, -1e-6, 1e-6, 1e-5)), 1)]
    assert found(spark, rows) == brute(rows)
    assert [r[1] for r in found(spark, rows) if r[0] == 0] == [2]


def test_trees_grow_with_depth():
    assert vector_forest.trees_for(10) == vector_forest.LEAST_TREES
    for size in (5_000, 10**6, 10**8, 10**10):
        together = vector_forest.SURVIVAL ** vector_forest.depth_of(size)
        assert 1 - (1 - together) ** vector_forest.trees_for(size) >= vector_forest.RECALL
