"""The index of newest samples and mount ends equals the views over the whole history, whatever the order of batches."""

import datetime as dt
import random

from pyspark.sql import functions as F

from fleetlens.fleet import Fleet
from fleetlens.functions.exprs import timestamp
from fleetlens.operators import reports as P
from fleetlens.operators.kernels import pair_pivot
from fleetlens.operators.rollups import rollup_filesystem
from fleetlens.operators.snapshots import recent
from fleetlens.sources.series_index import SeriesIndex
from fleetlens.streaming.ingest_stream import IngestStream

T0 = dt.datetime(2024, 1, 1)
FS = ("server_id bigint, collected_at timestamp, mountpoint string, fstype string, used_bytes bigint, free_bytes bigint, "
      "inodes_used bigint, inodes_free bigint, batch int")
SINCE = "2023-12-01 00:00:00"


def volumes(spark):
    """Samples of four batches: most in order, a fifth late, some without free space, some of virtual file systems."""
    rng, rows = random.Random(5), []
    for h in range(1, 5):
        for mount, kind in (("/", "ext4"), ("/data", None), ("/boot", "ext4"), ("/run", "tmpfs")):
            for m in range(0, 4 * 1440, 211):
                batch = min(3, m // 1440 + (rng.random() < 0.2))
                free = rng.choice([None, 10 ** 6 - 100 * m, 10 ** 6 - 90 * m])
                rows.append((h, T0 + dt.timedelta(minutes=m, seconds=rng.randint(0, 200)), mount, kind, 10 ** 5 + 100 * m, free,
                             rng.choice([None, m]), 10 ** 5 - m, batch))
    return spark.createDataFrame(rows, FS)


def anchor(k):
    return timestamp(f"2024-01-0{k + 2} 00:00:00")


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def pairs(df, at):
    return rows_of(pair_pivot(recent(df, timestamp(SINCE), at), ["server_id", "mountpoint"], "collected_at", ["used_bytes", "free_bytes"]))


def test_batches_in_any_order_equal_the_whole_history(spark, tmp_path):
    every = volumes(spark).cache()
    index = SeriesIndex(spark, str(tmp_path / "index"))
    assert index.newest("filesystem") is None and index.mount_spans() is None
    for k in range(4):
        batch = Fleet(lambda n, k=k: every.where(F.col("batch") == k).drop("batch"))
        index.batch(batch, k, anchor(k), ("filesystem",))
        index.batch(batch, k, anchor(k), ("filesystem",))  # committed already
        seen = every.where(F.col("batch") <= k).drop("batch")
        assert pairs(index.newest("filesystem"), anchor(k)) == pairs(seen, anchor(k)), k
    past = every.drop("batch").where(F.col("collected_at") <= anchor(3))
    whole = P.mount_spans(rollup_filesystem(past, "5m").where("(fstype is null or fstype <> 'tmpfs') and mountpoint <> '/boot'"))
    assert rows_of(P.span_capacity(index.mount_spans("5m"))) == rows_of(P.span_capacity(whole))
    assert index.newest("filesystem").count() <= 2 * 16  # two rows a series, however long the history
    assert len(index.store.epochs("filesystem")[1]) == 2


def test_repeats_ties_and_clocks_ahead(spark, tmp_path):
    def batch(*rows):
        df = spark.createDataFrame([(h, T0 + dt.timedelta(hours=t), "/", "ext4", u, f, 1, 1, 0) for h, t, u, f in rows], FS).drop("batch")
        return Fleet(lambda n: df)

    def newest(at):
        got = recent(index.newest("filesystem"), timestamp(SINCE), timestamp(f"2024-01-01 {at:02d}:00:00"))
        return sorted((r.server_id, r.collected_at.hour, r.used_bytes) for r in got.collect())

    index = SeriesIndex(spark, str(tmp_path / "index"))
    at = lambda h: timestamp(f"2024-01-01 {h:02d}:00:00")
    index.batch(batch((1, 1, 10, 5), (1, 2, 20, 5), (1, 9, 90, 1), (2, 1, None, None)), 0, at(3), ("filesystem",))
    assert newest(3) == [(1, 1, 10), (1, 2, 20), (2, 1, None)]  # hour 9 is ahead
    index.batch(batch((1, 2, 99, 5), (1, 2, 99, 5), (1, 9, 91, 1)), 1, at(4), ("filesystem",))
    assert newest(4) == [(1, 1, 10), (1, 2, 20), (2, 1, None)]  # a repeat takes no place, the stored one stays
    assert len([r for r in newest(10) if r[:2] == (1, 9)]) == 1  # its time has come without a batch
    index.batch(batch(), 2, at(10), ("filesystem",))
    assert [r[:2] for r in newest(10)] == [(1, 2), (1, 9), (2, 1)]
    one = {r.server_id: r for r in index.mount_spans("1h").collect()}
    assert (one[1].av_first, one[1].av_last, one[1].span_days * 24) == (5, 1, 8.0)
    assert one[2].av_first is None and one[2].total_bytes is None and one[2].span_days == 0


def test_a_batch_that_fails_starts_again_from_the_state_before(spark, tmp_path):
    every = volumes(spark).cache()
    index = SeriesIndex(spark, str(tmp_path / "index"))
    index.batch(Fleet(lambda n: every.where("batch = 0").drop("batch")), 0, anchor(0), ("filesystem",))
    before = rows_of(index.newest("filesystem"))
    index.add(every.where("batch = 1").drop("batch"), "filesystem", 1, anchor(1))  # the job dies before the commit
    assert rows_of(index.newest("filesystem")) == before
    index.batch(Fleet(lambda n: every.where("batch = 1").drop("batch")), 1, anchor(1), ("filesystem",))
    assert pairs(index.newest("filesystem"), anchor(1)) == pairs(every.where("batch <= 1").drop("batch"), anchor(1))


def test_the_ingest_stream_keeps_the_index(spark, tmp_path):
    from test_ingest_stream import BATCHES, texts

    index = SeriesIndex(spark, str(tmp_path / "index"), host="agent_id")
    stream = IngestStream(spark, str(tmp_path / "tables"), index=index)
    for epoch, batch in enumerate(BATCHES):
        stream.batch(texts(spark, batch), epoch)
    for table, keys in (("host_metrics", ["agent_id"]), ("disk_io", ["agent_id", "device_id"])):
        want = pair_pivot(stream.table(table), keys, "collected_at", [])
        assert rows_of(pair_pivot(index.newest(table), keys, "collected_at", [])) == rows_of(want) != []
