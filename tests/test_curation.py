"""Selection rules against sequential brute force; reading, mapping and splitting contracts."""
import random

import pytest
from pyspark.sql import functions as F

from tallymark.operators import curate as D
from tallymark.operators import splits as P
from tallymark.operators import validate as VA
from tallymark.session import work_dir
from tallymark.sources import labelled as L
from tallymark.sources import suites as S


def sequential_unique(rows, n):
    seen, kept, report = set(), [], {}
    for source in sorted({r[0] for r in rows}):
        got, rep = 0, [0, 0, 0]
        for s, key, order, fits in sorted((r for r in rows if r[0] == source), key=lambda r: r[2]):
            rep[0] += 1
            if key in seen:
                rep[1] += 1
            elif not fits:
                rep[2] += 1
            else:
                seen.add(key)
                kept.append((s, order))
                got += 1
                if got == n:
                    break
        report[source] = (*rep, got)
    return set(kept), report


@pytest.mark.parametrize("seed,n", [(1, 3), (2, 8), (5, 2)])
def test_select_unique_matches_sequential_rule(spark, seed, n):
    rng = random.Random(seed)
    rows = [(rng.choice("abcd"), f"k{rng.randrange(18)}", f"{i:05d}", rng.random() < 0.8) for i in rng.sample(range(100000), 150)]
    got, report = D.select_unique(spark.createDataFrame(rows, "source string, skey string, row_sha string, fits boolean"), n)
    want, rep = sequential_unique(rows, n)
    assert {(r["source"], r["row_sha"]) for r in got.collect()} == want
    assert {r["source"]: (r["considered"], r["duplicate_state"], r["context_rejected"], r["accepted"]) for r in report.collect()} == rep


@pytest.mark.parametrize("seed,n", [(1, 4), (2, None), (3, 2)])
def test_unique_pairs_match_sequential_rule(spark, seed, n):
    rng = random.Random(seed)
    rows = [(rng.choice("xyz"), i, f"h{rng.randrange(25)}", f"h{rng.randrange(25)}") for i in range(80)]
    seen, count, want = set(), {}, set()
    for fam, o, a, b in rows:
        if (n is not None and count.get(fam, 0) >= n) or {a, b} & seen:
            continue
        seen |= {a, b}
        count[fam] = count.get(fam, 0) + 1
        want.add(o)
    got = D.unique_pairs_by_family(spark.createDataFrame(rows, "family string, ord bigint, h1 string, h2 string"), n)
    assert {r["ord"] for r in got.collect()} == want


def test_exact_duplicates_keep_the_first(spark):
    d = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (9, "a")], "id bigint, fp string")
    assert sorted(r["id"] for r in D.drop_exact_duplicates(d, "fp", "id").collect()) == [1, 2]


def test_conflicts_drop_the_whole_state(spark):
    d = spark.createDataFrame([(1, "k", "q", "i", 0), (2, "k", "q", "i", 1), (3, "m", "q", "i", 1)], "id bigint, skey string, qid string, instructions string, label int")
    assert [r["id"] for r in D.drop_label_conflicts(d).collect()] == [3]


def test_split_is_by_state_and_partitioning_invariant(spark):
    d = spark.createDataFrame([(i, f"s{i % 37}") for i in range(200)], "id bigint, skey string")
    a = {(r["id"], r["split"]) for r in P.split_by_state(d, 0.2, 0.2, "x").collect()}
    b = {(r["id"], r["split"]) for r in P.split_by_state(d.orderBy(F.desc("id")).repartition(7), 0.2, 0.2, "x").collect()}
    assert a == b
    assert len({(i % 37, s) for i, s in a}) == 37


def test_label_words_and_levels(spark):
    d = spark.createDataFrame([("yes",), ("OFF",), ("maybe",), (None,)], "value string")
    assert [(r["label"], r["reason"]) for r in VA.map_labels(d, {"type": "noul"}, {}).collect()] == [("true", None), ("false", None), (None, "not a yes/no value"), (None, "empty label")]


def test_request_projection_refuses_labels(spark):
    with pytest.raises(ValueError):
        VA.request_projection(spark.range(1).withColumn("label", F.lit(1)), ("id", "label"))


def test_test_split_is_locked_and_pruned(spark):
    out = work_dir(spark, "suite")
    d = spark.createDataFrame([(1, "train"), (2, "test"), (3, "development")], "id bigint, split string")
    S.freeze_suite(d, out)
    with pytest.raises(ValueError):
        S.load_split(spark, out, "test")
    with pytest.raises(ValueError):
        S.load_split(spark, out, "holdout")
    df = S.load_split(spark, out, "development")
    assert "PartitionFilters: [isnotnull(split" in df._jdf.queryExecution().toString() and df.count() == 1
    with pytest.raises(Exception):
        S.freeze_suite(d, out)
    spark.createDataFrame([(9,)], "id bigint").write.mode("append").parquet(f"{out}/data/split=development")
    with pytest.raises(ValueError, match="manifest"):
        S.load_split(spark, out, "development")


def test_line_numbers_survive_small_splits(spark):
    out = work_dir(spark, "lines")
    spark.range(3000).select(F.format_string("row %d", "id").alias("value")).coalesce(1).write.text(out)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        n = L.number_lines(spark.read.text(out)).withColumn("want", F.substring("value", 5, 9).cast("bigint") + 1)
        assert n.filter(F.col("line") != F.col("want")).count() == 0 and n.count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
