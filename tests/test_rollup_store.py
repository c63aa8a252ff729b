"""Refreshed rollups with late samples, and known answers for null groups, device rules, array homes and the catalog file."""

import datetime as dt
import random

from pyspark.sql import functions as F
from test_mended import device, host

from fleetlens.fleet import Fleet
from fleetlens.operators.devices import active_disks, active_ifaces
from fleetlens.operators.inventory import storage_tree
from fleetlens.operators.kernels import exact_percentile
from fleetlens.operators.rollups import rollup_net
from fleetlens.schemas import DEVICE
from fleetlens.sources.catalogs import common_releases, load_catalog, save_catalog
from fleetlens.sources.rollup_store import RollupStore

T0 = dt.datetime(2024, 1, 1)
COUNTERS = ("rx_bytes", "tx_bytes", "rx_packets", "tx_packets", "rx_dropped", "tx_dropped", "rx_errors", "tx_errors")


def samples(spark, days):
    """Several samples per five minutes, with counter resets, for two interfaces."""
    rng, rows = random.Random(3), []
    for h in (1, 2):
        v = 0
        for m in range(0, days * 1440, 97):
            for s in (0, 60, 130):
                v = rng.randint(0, 50) if rng.random() < 0.05 else v + rng.randint(0, 100)
                rows.append((h, "e0", T0 + dt.timedelta(minutes=m, seconds=s), *[v] * len(COUNTERS), 1000))
    return spark.createDataFrame(rows, f"server_id bigint, iface_id string, collected_at timestamp, {', '.join(f'{c} bigint' for c in COUNTERS)}, link_speed_bps bigint")


def table(df):
    return sorted(map(tuple, df.select("server_id", "bucket", "d_rx_bytes", "td_rx_bytes", "sample_count").collect()))


def test_refreshes_with_late_samples_equal_a_rebuild(spark, tmp_path):
    every = samples(spark, 6).withColumn("at", F.when(F.pmod(F.xxhash64("server_id", "collected_at"), F.lit(5)) == 0, F.lit(2)).otherwise(F.lit(0)) + F.floor(F.dayofmonth("collected_at") / 3)).cache()
    store = RollupStore(spark, str(tmp_path / "store"), "5m")
    fleet = lambda k: Fleet(lambda n: every.where(F.col("at") <= k).drop("at"))
    for k, day in ((0, 2), (1, 4), (2, 6), (3, 6), (4, 6)):
        batch = every.where(F.col("at") == k)
        store.arrived(batch, "net_io", k)
        store.arrived(batch, "net_io", k)  # a batch that is handed over twice
        store.refresh(fleet(k), dt.date(2024, 1, day), ("net",))
        assert table(store.table(fleet(k), "net")) == table(rollup_net(fleet(k)["net_io"], "5m")), k
    assert store.late_days("net")[0] == [] and store.mark("net")[0] == dt.date(2024, 1, 6)
    assert store.refresh(fleet(4), dt.date(2024, 1, 6), ("net",)) == {"net": 0}
    assert table(store.table(fleet(4), "net")) == table(rollup_net(every, "5m"))


def test_a_refresh_that_stopped_is_done_again(spark, tmp_path, monkeypatch):
    df = samples(spark, 4)
    fleet = Fleet(lambda n: df)
    store = RollupStore(spark, str(tmp_path / "store"), "5m")
    store.refresh(fleet, dt.date(2024, 1, 2), ("net",))
    move, store._move = store._move, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        store.refresh(fleet, dt.date(2024, 1, 4), ("net",))
    except RuntimeError:
        pass
    store._move = move
    assert store.mark("net")[0] == dt.date(2024, 1, 2)
    assert table(store.table(fleet, "net")) == table(rollup_net(df, "5m"))  # below the mark stored, above it from samples
    store.refresh(fleet, dt.date(2024, 1, 4), ("net",))
    assert table(store.table(fleet, "net")) == table(rollup_net(df, "5m"))


def test_only_the_tail_of_the_samples_is_read(spark, tmp_path):
    root = str(tmp_path)
    samples(spark, 6).write.parquet(f"{root}/net_io")
    fleet = Fleet(lambda n: spark.read.parquet(f"{root}/net_io"))
    store = RollupStore(spark, f"{root}/store", "5m")
    store.refresh(fleet, dt.date(2024, 1, 5), ("net",))
    plan = store.table(fleet, "net")._jdf.queryExecution().executedPlan().toString()
    raw = next(x for x in plan.split("\n") if "net_io" in x and "FileScan" in x)
    assert "GreaterThanOrEqual(collected_at,2024-01-05" in raw


def test_percentile_of_null_groups(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", None, 3.0), (None, "x", 5.0), (None, None, 7.0), (None, None, 9.0), ("a", "x", None)], "k string, j string, v double")
    got = {(r.k, r.j): r.value for r in exact_percentile(df, ["k", "j"], "v", 0.5).collect()}
    assert got == {("a", None): 2.0, (None, "x"): 5.0, (None, None): 8.0}
    assert exact_percentile(df, [], "v", 0.5).first().value == 5.0


def test_arrays_live_where_the_first_root_reaches_them(spark):
    devices = [device("md0", "raid", "sdb"), device("sda", "disk"), device("sdb", "disk"), device("md0", "raid", "sda"), device("vol", "lvm", "md0"), device("lost", "lvm", "gone"), device("loop", "raid", "loop")]
    rows = [(r.name, r.kind, r.root_disk, r.depth) for r in storage_tree(host(spark, devices)).collect() if r.name in ("md0", "vol", "lost", "loop")]
    assert sorted(rows, key=str) == sorted([("md0", "raid", "sda", 1), ("md0", "raid_member", "sdb", 1), ("vol", "lvm", "sda", 2), ("lost", "lvm", None, 0), next(r for r in rows if r[0] == "loop")], key=str)


def test_array_below_a_partition_of_the_second_disk_listed_first(spark):
    devices = [device("sdb1", "part", "sdb"), device("md0", "raid", "sdb1"), device("sda", "disk"), device("sdb", "disk"), device("sda1", "part", "sda"), device("md0", "raid", "sda1")]
    rows = {(r.name, r.kind): (r.root_disk, r.path) for r in storage_tree(host(spark, devices)).collect()}
    assert rows["md0", "raid"] == ("sda", "sda/sda1/md0") and rows["md0", "raid_member"] == ("sdb", "sdb/sdb1/md0")


def test_activity_of_hosts_without_devices_and_by_name(spark):
    nic = "array<struct<name:string,kind:string,id:string,id_type:string>>"
    inv = spark.createDataFrame([(1, None, [("eth0", "physical", "7", "mac")]), (2, None, None), (3, None, [])], f"server_id int, block_devices {DEVICE}, net_interfaces {nic}")
    got = active_ifaces(spark.createDataFrame([(1, "name:eth0"), (1, "mac:7"), (1, "mac:8"), (2, "any"), (3, "x"), (9, "x")], "server_id int, iface_id string"), inv)
    assert sorted(map(tuple, got.collect())) == [(1, "mac:7"), (1, "name:eth0"), (2, "any"), (3, "x")]
    disks = active_disks(spark.createDataFrame([(2, "d")], "server_id int, device_id string"), inv)
    assert disks.count() == 1


def test_catalog_file_round_trip(spark, tmp_path):
    cat = common_releases(spark)
    save_catalog(cat, str(tmp_path / "catalog"))
    back = load_catalog(spark, str(tmp_path / "catalog"))
    cols = ["product", "cycle", "build", "support", "eol", "extended"]
    assert sorted(map(str, back.select(*cols).collect())) == sorted(map(str, cat.select(*cols).collect()))
    assert back.where("product = 'ubuntu'").orderBy("pos").first().cycle == "22.04"
