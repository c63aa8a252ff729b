"""Percentiles of heavy tails, places without one ordered pass, report keys, and checks of messages."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.operators.kernels import exact_percentile, places
from fleetlens.operators.selection import snapshot_key


def test_percentile_of_heavy_tails(spark):
    """A group far beyond the size that is ranked whole: one extreme outlier, many ties, and a small group beside it."""
    n = 120_000
    rng = np.random.default_rng(5)
    tail = np.r_[rng.lognormal(0, 3, n - 1), 1e18]
    ties = np.where(rng.random(n) < 0.5, 7.0, rng.random(n))
    rows = [("tail", float(v)) for v in tail] + [("ties", float(v)) for v in ties] + [("few", 1.0), ("few", 2.0), ("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(8)
    for p in (0.0, 0.5, 0.95, 0.9999, 1.0):
        got = {r.k: r.value for r in exact_percentile(df, ["k"], "v", p).collect()}
        want = {"tail": np.quantile(tail, p), "ties": np.quantile(ties, p), "few": 1 + p, "one": 4.0}
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert np.isclose(got[k], v, rtol=1e-9), (k, p)


def test_places(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", "b", None]), rnd.random() * 5) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, k string, v double")
    order = [F.asc("k"), F.desc("v"), F.asc("id")]
    got = {r.id: r.place for r in places(df, [F.col("k"), -F.floor("v")], order).collect()}
    want = {r.id: r.p for r in df.select("id", F.row_number().over(Window.orderBy(*order)).alias("p")).collect()}
    assert got == want


def test_equal_parameters_give_one_report(spark):
    texts = ['{"view":"x","ids":[{"b":1,"a":2}]}', '{"ids": [{"a": 2, "b": 1}], "view": "x"}', '{"view":"y"}', "no json", None]
    df = spark.createDataFrame([(t,) for t in texts], "p string").select("p", *snapshot_key(F.lit("server"), F.col("p"), F.current_timestamp()))
    h = {r.p: r.input_hash for r in df.collect()}
    assert h[texts[0]] == h[texts[1]] and len(set(h.values())) == 4
