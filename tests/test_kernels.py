"""Kernels on small inputs with results worked out by hand or by brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.functions.exprs import ipv4_network, ipv4_number, ipv4_text, time_bucket, timestamp, usage_pct
from fleetlens.operators import kernels as K

T0 = dt.datetime(2024, 1, 1)


def series(spark, values, step=60, key="a", cols="k string, ts timestamp, v bigint"):
    return spark.createDataFrame([(key, T0 + dt.timedelta(seconds=i * step), v) for i, v in enumerate(values)], cols)


def test_counter_delta_counts_new_value_after_reset(spark):
    total = series(spark, [0, 1000, 2000, 3000, 0, 1000, 2000], 30)
    idle = series(spark, [0, 800, 1600, 2400, 0, 500, 1000], 30)
    assert K.counter_delta(total, ["k"], "ts", ["v"], 300).first().d_v == 5000
    assert K.counter_delta(idle, ["k"], "ts", ["v"], 300).first().d_v == 3400
    assert K.counter_delta(series(spark, [0, 50, 100, 150, 0, 50, 100], 30), ["k"], "ts", ["v"], 300).first().d_v == 250


def test_counter_delta_skips_unknown_samples_and_the_step_between_buckets(spark):
    rows = K.counter_delta(series(spark, [10, None, 30, 100, 110], 120), ["k"], "ts", ["v"], 300, spans=["v"]).orderBy("bucket").collect()
    assert [r.d_v for r in rows] == [20, 10]
    assert [r.td_v for r in rows] == [240.0, 120.0]


@pytest.mark.parametrize("policy,want", [("raw", [None, 100, -150, 20]), ("clamp", [0, 100, 0, 20]), ("null", [None, 100, None, 20]), ("restart", [0, 100, 50, 20])])
def test_reset_policies(spark, policy, want):
    out = K.lag_delta(series(spark, [100, 200, 50, 70]), ["k"], "ts", ["v"], policy).orderBy("ts").collect()
    assert [r.d_v for r in out] == want


@pytest.mark.parametrize("skip", [False, True])
def test_previous_value_crosses_chunks_of_a_hot_key(spark, skip):
    rng = random.Random(7)
    rows = []
    for key, n in (("hot", 600), ("b", 40), ("c", 3)):
        at = T0
        for _ in range(n):
            at += dt.timedelta(seconds=rng.choice([1, 60, 4000, 90000]))
            rows.append((key, at, rng.choice([None, 1, 2, 3, 9])))
    got = {(r.k, r.ts): r.prev_v for r in K.with_previous(spark.createDataFrame(rows, "k string, ts timestamp, v bigint"), ["k"], "ts", ["v"], 3600, skip).collect()}
    last = {}
    for key, at, v in rows:
        assert got[(key, at)] == last.get(key)
        if v is not None or not skip:
            last[key] = v


@pytest.mark.parametrize("p", [0.0, 0.5, 0.95, 1.0])
def test_exact_percentile_equals_numpy_on_skewed_groups(spark, p):
    rng = np.random.default_rng(3)
    data = {"hot": np.concatenate([rng.exponential(5, 4000).round(1), [1e6]]), "one": np.array([4.0]), "same": np.full(50, 2.5), "few": rng.normal(0, 1, 7)}
    df = spark.createDataFrame([(k, float(x)) for k, xs in data.items() for x in xs], "k string, v double")
    got = {r.k: r.value for r in K.exact_percentile(df, ["k"], "v", p).collect()}
    for k, xs in data.items():
        assert got[k] == pytest.approx(np.quantile(xs, p), abs=1e-9)


def test_locf_totals_equal_the_unrolled_grid(spark):
    rng = random.Random(5)
    rows = [(f"h{h}", T0 + dt.timedelta(minutes=rng.randrange(0, 3000)), rng.randrange(1, 100), rng.randrange(1, 100)) for h in range(12) for _ in range(6)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, used bigint, free bigint").dropDuplicates(["k", "ts"])
    start, end = timestamp("2024-01-01 06:00:00"), timestamp("2024-01-02 20:00:00")
    totals = {r.ts: (r.used, r.free) for r in K.locf_totals(df, ["k"], "ts", ["used", "free"], "3h", start, end).collect()}
    grid = {r.ts: (r.u, r.f) for r in K.locf_grid(df, ["k"], "ts", ["used", "free"], "3h", start, end).groupBy("ts").agg(F.sum("used").alias("u"), F.sum("free").alias("f")).collect()}
    assert {k: v for k, v in totals.items() if v[0]} == grid


def test_locf_carries_and_respects_age(spark):
    df = series(spark, [60, 61], 300)
    s, e = timestamp("2024-01-01 00:00:00"), timestamp("2024-01-01 00:09:00")
    rows = K.locf_grid(df, ["k"], "ts", ["v"], "1m", s, e).orderBy("ts").collect()
    assert [r.v for r in rows] == [60] * 5 + [61] * 5
    aged = K.locf_grid(df, ["k"], "ts", ["v"], "1m", s, e, max_age=120).orderBy("ts").collect()
    assert [r.v for r in aged] == [60] * 3 + [61] * 3


def test_change_events(spark):
    b, a = T0, T0 + dt.timedelta(minutes=1)
    rows = [("h", T0 + dt.timedelta(hours=1), b, a), ("h", T0 + dt.timedelta(hours=2), b + dt.timedelta(seconds=3), a), ("h", T0 + dt.timedelta(hours=3), b, a + dt.timedelta(hours=2)),
            ("h", T0 + dt.timedelta(days=2), b + dt.timedelta(days=1), a)]
    ev = K.change_events(spark.createDataFrame(rows, "k string, ts timestamp, boot timestamp, agent timestamp"), ["k"], "ts", "boot", "agent").orderBy("ts").collect()
    assert [r.kind for r in ev] == ["reboot", "restart", "reboot"]


def test_merge_and_gap_fill(spark):
    s = spark.createDataFrame([(T0, 1.0), (T0 + dt.timedelta(hours=2), 3.0)], "ts timestamp, value double")
    t = spark.createDataFrame([(T0 + dt.timedelta(hours=1), 2.0)], "ts timestamp, value double")
    m = K.merge_series({"a": s, "b": t}).orderBy("ts").collect()
    assert [(r.a, r.b) for r in m] == [(1.0, None), (None, 2.0), (3.0, None)]
    g = K.gap_fill(s, timestamp("2024-01-01 00:00:00"), timestamp("2024-01-01 03:00:00"), "1h").orderBy("ts").collect()
    assert [r.value for r in g] == [1.0, None, 3.0, None]


def test_expressions(spark):
    r = spark.range(1).select(
        ipv4_number(F.lit("10.0.1.7")).alias("n"), ipv4_number(F.lit("10.0.1.700")).alias("bad"), ipv4_text(ipv4_network(ipv4_number(F.lit("10.0.1.77")), F.lit(26))).alias("net"),
        usage_pct(F.lit(None).cast("long"), F.lit(10)).alias("u"), time_bucket(timestamp("2024-01-01 05:59:59"), "3h").alias("b")).first()
    assert (r.n, r.bad, r.net, r.u, r.b) == (167772423, None, "10.0.1.64", None, dt.datetime(2024, 1, 1, 3))
