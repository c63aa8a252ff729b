"""Mergeable counter state, bursts and start changes over several batches, with retries and expiry."""

import datetime as dt
import random

from pyspark.sql import functions as F

from fleetlens.operators import kernels as K
from fleetlens.operators.partials import merge_partials, partial_rollup, rolled
from fleetlens.streaming import streams as W
from fleetlens.streaming.epochs import EpochStore

T0 = dt.datetime(2024, 1, 1)


def counters(spark, n=2000, seed=1):
    """A counter with resets on both sides of bucket borders, a NULL now and then, and one that is never measured."""
    rng, rows, value = random.Random(seed), [], {}
    for i in range(n):
        h = f"h{rng.randint(0, 2)}"
        value[h] = rng.randint(0, 5) if rng.random() < 0.1 else value.get(h, 0) + rng.randint(0, 50)
        rows.append((h, T0 + dt.timedelta(seconds=97 * i), None if rng.random() < 0.05 else value[h], None, float(value[h])))
    return spark.createDataFrame(rows, "host string, ts timestamp, a bigint, b bigint, g double")


def got(df, cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_days_from_five_minute_rows_equal_days_from_samples(spark):
    df = counters(spark)
    five = partial_rollup(df, ["host"], "ts", ["a", "b"], ["g"], 300)
    want = K.counter_delta(df, ["host"], "ts", ["a", "b"], 86400, spans=["a"], extra=[F.avg("g").alias("g_avg"), F.max("g").alias("g_max"), F.count("*").alias("sample_count")])
    cols = ["host", "bucket", "d_a", "td_a", "d_b", "g_max", "sample_count"]
    for parts in (merge_partials(five, ["host"], ["a", "b"], ["g"], 86400),
                  merge_partials(merge_partials(five, ["host"], ["a", "b"], ["g"], 3600).drop("overlaps"), ["host"], ["a", "b"], ["g"], 86400)):  # by hours first
        assert parts.where("overlaps").count() == 0
        assert got(rolled(parts, ["host"], ["a", "b"], ["g"], ["a"]), cols) == got(want, cols)
    assert merge_partials(five.limit(0), ["host"], ["a", "b"], ["g"], 86400).count() == 0


def test_samples_out_of_order_are_rolled_again(spark, tmp_path):
    df = counters(spark, 600)
    r = W.RollupStream(spark, str(tmp_path / "r"), ["host"], "ts", ["a", "b"], ["g"], 300)
    for i in range(3):
        part = df.where(F.abs(F.hash("ts")) % 3 == i)
        r.batch(part, i)
        r.batch(part, i)  # a committed batch that comes again changes nothing
    cols = ["host", "bucket", "d_a", "sample_count"]
    want = got(K.counter_delta(df, ["host"], "ts", ["a", "b"], 300, extra=[F.count("*").alias("sample_count")]), cols)
    assert got(r.table(df), cols) == want
    r.compact()
    r.batch(df.limit(0), 3)
    assert got(r.table(df), cols) == want
    day = got(K.counter_delta(df, ["host"], "ts", ["a", "b"], 86400, extra=[F.count("*").alias("sample_count")]), cols)
    assert got(r.table(df, 86400), cols) == day


def in_batches(spark, folder, schema, *batches):
    """One file for each batch, read one at a time by age."""
    import os
    import time
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        files = [f for f in os.listdir(folder) if f.endswith(".parquet")]
        newest = max(files, key=lambda f: os.path.getmtime(f"{folder}/{f}"))
        os.utime(f"{folder}/{newest}", (time.time() - 1000 + 10 * i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_burst_alerts_once_at_the_third_restart(spark, tmp_path):
    m = lambda x: T0 + dt.timedelta(minutes=x)
    batches = [[("a", m(0)), ("b", m(0)), (None, m(1)), ("c", m(0)), ("c", m(1)), ("c", m(2)), ("c", m(3))],
               [("a", m(59)), ("b", m(60)), ("b", m(61))],  # b: an hour apart is another burst
               [("a", m(110)), ("b", m(400)), ("c", m(62))],  # a: third; c: renewed, alerted before
               [("a", m(160)), ("c", m(500)), ("c", m(501)), ("c", m(502))]]  # a: fourth; c: a second burst
    out = W.burst_alerts(in_batches(spark, str(tmp_path / "in"), "host string, ts timestamp", *batches), "host", "ts")
    assert sorted(map(tuple, out.select("host", "first_at", "events").collect())) == [("a", m(0), 3), ("c", m(0), 4), ("c", m(500), 3)]


def test_start_changes_over_batches_and_expiry(spark, tmp_path):
    h = lambda x: T0 + dt.timedelta(hours=x)
    batches = [[("a", h(1), h(0)), ("b", h(1), h(0)), ("c", h(1), None), ("d", h(1), h(0))],
               [("a", h(2), h(0)), ("a", h(3), h(2)), ("b", h(30), h(29)), ("d", h(25), h(9))],  # b: the last start is older than 24 hours
               [("a", h(4), h(2)), ("a", h(5), h(4)), ("b", h(31), h(29)), ("c", h(31), h(1))]]
    stream = in_batches(spark, str(tmp_path / "in"), "host string, ts timestamp, start timestamp", *batches)
    out = sorted(map(tuple, W.agent_start_changes(stream, "host", "ts", "start").select("host", "changed_at", "agent_started_at").collect()))
    # a's last sample of batch 2 is 27 hours behind the newest time, so its state is gone
    assert out == [("a", h(3), h(2)), ("a", h(5), h(4)), ("d", h(25), h(9))]


def test_epochs_count_once(spark, tmp_path):
    s = EpochStore(spark, str(tmp_path))
    assert s.committed() == -1 and s.read("t") is None
    s.write(spark.range(3), "t", 0)
    assert s.read("t") is None  # not committed
    s.write(spark.range(4), "t", 0)  # tried again
    s.commit(0)
    for e in (1, 2):
        s.write(spark.range(e), "t", e)
        s.commit(e)
    assert s.read("t").count() == 7 and s.read("t", only=1).count() == 1
    assert s.compact("t", lambda d: d.dropDuplicates(["id"])) == 2 and s.read("t").count() == 4
    s.write(spark.range(10, 12), "t", 3)
    s.commit(3)
    assert s.read("t").count() == 6 and s.compact("t", lambda d: d) == 3 and s.read("t").count() == 6
