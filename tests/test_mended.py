"""Known answers for deep and reordered storage trees, start changes of busy hosts, and windows of any length."""

import random
import re

from pyspark.sql import functions as F

from fleetlens.functions.exprs import timestamp
from fleetlens.operators.fleet_views import metric_gaps
from fleetlens.operators.inventory import storage_tree
from fleetlens.schemas import DEVICE, VOLUME_GROUP
from fleetlens.streaming import streams as W


def host(spark, devices):
    names = re.findall(r"(\w+):", DEVICE)
    rows = [tuple(d.get(n) for n in names) for d in devices]
    return spark.createDataFrame([(1, rows, None)], f"server_id int, block_devices {DEVICE}, lvm_vgs {VOLUME_GROUP}")


def device(name, kind, parent=None, own=None):
    return {"name": name, "type": kind, "size_bytes": 1 << 30, "parent": parent, "id": own or name}


def test_tree_of_any_depth(spark):
    chain = [device("sda", "disk")] + [device(f"l{i}", "lvm", "sda" if i == 1 else f"l{i - 1}") for i in range(1, 21)]
    rows = {r.name: r for r in storage_tree(host(spark, chain)).collect() if r.name}
    assert rows["l20"].root_disk == "sda" and rows["l20"].depth == 20


def test_second_member_of_a_dynamic_disk_is_a_stub(spark):
    devices = [device("sda", "disk"), device("sdb", "disk"), device("vol", "dynamic", "sda"), device("vol", "dynamic", "sdb")]
    kinds = sorted(r.kind for r in storage_tree(host(spark, devices)).collect() if r.name == "vol")
    assert kinds == ["dynamic", "raid_member"]


def test_start_changes_of_a_busy_host(spark, tmp_path):
    """30,000 shuffled samples of one host arrive in one batch: several Arrow batches, eight changes."""
    rows = [(7, i, i // 3400) for i in range(30_000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "host int, t long, s long").select("host", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t")).alias("ts"), F.timestamp_seconds(F.lit(1_690_000_000) + F.col("s")).alias("start"))
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = W.agent_start_changes(stream, "host", "ts", "start").orderBy("changed_at").collect()
    assert [int(r.changed_at.timestamp()) - 1_700_000_000 for r in out] == [3400 * k for k in range(1, 9)]


def test_gap_window_is_not_cut(spark):
    m = spark.createDataFrame([(1, "2024-01-01 00:00:00")], "server_id int, t string").select("server_id", F.col("t").cast("timestamp").alias("collected_at"))
    inv = spark.createDataFrame([(1, "p", "h")], "server_id int, public_id string, hostname string")
    assert metric_gaps(m, inv, timestamp("2024-01-10 00:00:00"), recent_hours=240).count() == 1
