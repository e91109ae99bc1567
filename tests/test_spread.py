"""Bucketed ranks, totals, lags and quantiles against brute force, with one hot key."""
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallymark.functions import spread


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    return pd.DataFrame([(rng.choice("aaaab"), i, rng.randrange(0, 5000) / 1000.0, rng.randrange(100)) for i in range(400)], columns=["k", "i", "v", "w"])


def test_spread_rank_matches_plain_rank(spark, data):
    got = spread.spread_rank(spark.createDataFrame(data).repartition(5), ["k"], ["v", "i"], F.floor("v"), "rank", total="size").toPandas().sort_values("i")
    want = data.sort_values(["k", "v", "i"]).assign(rank=lambda d: d.groupby("k").cumcount() + 1).sort_values("i")
    assert got["rank"].tolist() == want["rank"].tolist()
    assert dict(zip(got.k, got["size"])) == data.groupby("k").size().to_dict()


def test_running_totals_descending(spark, data):
    d = data.drop_duplicates(["k", "v"])
    got = spread.running_totals(spark.createDataFrame(d), ["k"], "v", F.floor(F.col("v") * 2), ["w"], descending=True).toPandas().sort_values("i")
    want = d.sort_values("v", ascending=False).assign(c=lambda x: x.groupby("k").w.cumsum()).sort_values("i")
    assert got.cum_w.tolist() == want.c.tolist()
    assert set(zip(got.k, got.tot_w)) == set(d.groupby("k").w.sum().items())


def test_previous_and_carry_cross_chunks(spark, data):
    df = spark.createDataFrame(data)
    got = spread.previous(df, ["k"], ["v", "i"], ["w"], F.floor("v")).toPandas().sort_values("i")
    want = data.sort_values(["v", "i"]).assign(p=lambda d: d.groupby("k").w.shift()).sort_values("i")
    assert got.prev_w.fillna(-1).tolist() == want.p.fillna(-1).tolist()
    sparse = F.when(F.col("w") < 5, F.col("w"))
    got = spread.carry_last(df, ["k"], ["v", "i"], sparse, F.floor("v"), "last").toPandas().sort_values("i")
    want = data.sort_values(["v", "i"]).assign(s=lambda d: d.w.where(d.w < 5)).assign(l=lambda d: d.groupby("k").s.ffill()).sort_values("i")
    assert got["last"].fillna(-1).tolist() == want.l.fillna(-1).tolist()


def test_spread_quantiles_linear_interpolation(spark, data):
    got = spread.spread_quantiles(spark.createDataFrame(data), ["k"], "w", {"p10": 0.1, "med": 0.5, "p95": 0.95}).toPandas().set_index("k")
    for k, g in data.groupby("k"):
        assert np.allclose(got.loc[k, ["p10", "med", "p95"]].astype(float), np.quantile(g.w, [0.1, 0.5, 0.95]))
        assert got.loc[k, "n"] == len(g)


def test_quantiles_of_negative_values(spark):
    df = spark.createDataFrame([("x", float(v)) for v in (-7, -3, 0, 2, 11)], "k string, v double")
    assert spread.spread_quantiles(df, ["k"], "v", {"q": 0.25}).first()["q"] == -3.0
