"""Stored tables: day pruning, idempotent appends, day repair."""

import datetime as dt

from pyspark.sql import functions as F

from fleetlens.fleet import Fleet
from fleetlens.functions.exprs import timestamp
from fleetlens.operators.rollups import rollup_filesystem
from fleetlens.sources import tables as S

T0 = dt.datetime(2024, 1, 1)


def samples(spark, days, used=10):
    rows = [(h, T0 + dt.timedelta(days=d, minutes=m), "/", "ext4", used, 90, 1, 9) for h in (1, 2) for d in days for m in (0, 1, 7)]
    return spark.createDataFrame(rows, "server_id bigint, collected_at timestamp, mountpoint string, fstype string, used_bytes bigint, free_bytes bigint, inodes_used bigint, inodes_free bigint")


def test_append_is_idempotent_and_ranges_prune_days(spark, tmp_path):
    root = str(tmp_path)
    S.append_new(samples(spark, range(4)), root, "filesystem")
    S.append_new(samples(spark, range(2, 6)), root, "filesystem")
    assert spark.read.parquet(f"{root}/filesystem").count() == 6 * 6
    fleet = Fleet.from_parquet(spark, root, timestamp("2024-01-02 00:00:00"), timestamp("2024-01-03 23:00:00"))
    assert fleet["filesystem"].count() == 12
    plan = fleet["filesystem"]._jdf.queryExecution().executedPlan().toString()
    part = plan[plan.index("PartitionFilters"):]
    assert "day" in part[:part.index("]")]


def test_repair_replaces_only_the_touched_days(spark, tmp_path):
    root = str(tmp_path)
    S.write_table(rollup_filesystem(samples(spark, range(3)), "5m"), root, "filesystem_5m")
    S.replace_days(rollup_filesystem(samples(spark, [1], used=60), "5m"), root, "filesystem_5m")
    got = S.read_table(spark, root, "filesystem_5m").groupBy(F.to_date("bucket").alias("d")).agg(F.max("used_pct_max").alias("u"), F.count("*").alias("n")).orderBy("d").collect()
    assert [(round(r.u), r.n) for r in got] == [(10, 4), (40, 4), (10, 4)]


def test_empty_inventory_table_round_trip(spark, tmp_path):
    inv = spark.createDataFrame([(1, "a")], "server_id bigint, hostname string")
    S.write_table(inv, str(tmp_path), "inventory", "overwrite")
    assert Fleet.from_parquet(spark, str(tmp_path))["inventory"].first().hostname == "a"
