"""Near-duplicate components against all pairs on small tables; dense groups, ties, nulls, copies."""
import random
import re

import numpy as np
import pytest

from tallymark.llm import near_dup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))) if w else frozenset()


def brute(rows, k):
    sets, root = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def corpus(seed, n=120, edits=(0, 1, 2, 4, 8)):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    while len(rows) < n:
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 6, 12, 50, 120]))]
        for _ in range(rng.choice([1, 1, 2, 6, 25])):
            t = list(base)
            for _ in range(rng.choice(edits)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows) * 3, " ".join(t) if rng.random() < 0.8 else "\n".join(t).upper()))
    return rows + [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "É é"), (5004, "é É")]


@pytest.mark.parametrize("k,seed", [(2, 1), (5, 2)])
def test_components_match_all_pairs(spark, k, seed):
    rows = corpus(seed)
    got = near_dup.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, kept string"), shingle=k)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    out = got.collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out} == brute(rows, k)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_second_round_finds_links_that_dense_nodes_cut(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "NODE_LIMIT", 8)
    monkeypatch.setattr(near_dup, "DENSE_BLOCK", 8)
    monkeypatch.setattr(near_dup, "MOST_LEVELS", 2)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(90):
        t = list(base)
        for _ in range(rng.choice([1, 3, 5, 7])):
            t[rng.randrange(60)] = f"r{rng.randrange(10000)}"
        rows.append((i, " ".join(t)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=2).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute(rows, 2)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    schema = "doc_id bigint, text string"
    rows = [(4, "a b c d e f g"), (4, "a b c d e f g"), (2, "a b c d e f g"), (9, "other words here now then again"), (9, None), (None, "lonely text without a number")]
    got = sorted(((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(4, 3, 2, False), (4, 3, 2, False), (2, 3, 2, True), (9, 2, 9, True), (9, 0, 9, True), (-1, 1, None, True)], key=str)
    assert near_dup.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_components_of_long_chains_and_hubs(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 120)] + [(900, 901), (901, 900), (77, 77)]
    rng.shuffle(edges)
    got = {r["id"]: r["component"] for r in near_dup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{500 + i: 500 for i in range(120)}, 900: 900, 901: 900}


def test_minwise_values_estimate_and_bitmaps_bound(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:360], rng.integers(0, 2**63, 40, dtype=np.uint64)])
    same = (near_dup.minwise(np.unique(a)) == near_dup.minwise(np.unique(b))).mean()
    assert abs(same - 360 / 440) < 0.2
    x, y = (np.frombuffer(near_dup.set_bits(s), np.uint64) for s in (a, b))
    assert len(a) - int(np.bitwise_count(x & ~y).sum()) >= 360
    long = rng.integers(0, 2**63, 40000, dtype=np.uint64)
    assert (near_dup.minwise(long) == near_dup.minwise(long[::-1].copy())).all()


def test_stored_tables_keep_no_shuffles_and_can_be_dropped(spark, tmp_path):
    import os
    from tallymark.llm.common import CLEAN_UP, dropped, stored
    before = spark.conf.get(CLEAN_UP, None)
    rows = spark.range(1000).selectExpr("id % 7 as k", "cast(id % 2 as int) as half").groupBy("k", "half").count()
    whole = stored(rows, "whole")
    laid = stored(rows, "laid", by="half", options={"parquet.writer.version": "PARQUET_2_0"})
    assert spark.conf.get(CLEAN_UP, None) == before
    assert sorted(map(tuple, whole.collect())) == sorted((r["k"], r["half"], r["count"]) for r in laid.collect()) and whole.count() == 14
    assert rows.count() == 14 and laid.filter("half = 1").count() == 7
    dropped(whole, laid)
    assert not os.path.exists(whole.stored_at.removeprefix("file:")) and not os.path.exists(laid.stored_at.removeprefix("file:"))
    empty = stored(rows.limit(0), "none", by="half")
    assert empty.count() == 0
    dropped(empty)
