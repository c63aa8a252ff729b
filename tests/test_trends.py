"""Trend cases with known answers on tiny fleets."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlens.fleet import Fleet
from fleetlens.functions.exprs import timestamp
from fleetlens.operators.trends import TRENDS, metric_trend

T0 = dt.datetime(2024, 1, 1)
START, END = "2024-01-01 00:00:00", "2024-01-01 01:00:00"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def fleet(spark, **tables):
    inv = spark.createDataFrame([(1, "linux", 4), (2, "linux", 4)], "server_id bigint, os_family string, cpu_cores int")
    inv = inv.withColumns({"block_devices": F.expr("array(named_struct('name','sda','type','disk','id','d','id_type','wwn'))"),
                           "net_interfaces": F.expr("array(named_struct('name','eth0','id','n','id_type','mac','kind','physical'))")})
    return Fleet({"inventory": inv, **tables}.__getitem__)


def host_rows(spark, rows):
    df = spark.createDataFrame(rows, "server_id bigint, collected_at timestamp, cpu_user_s double, cpu_idle_s double")
    return df.withColumns({f"cpu_{s}_s": F.lit(None).cast("double") for s in ("nice", "system", "iowait", "irq", "softirq", "steal")})


def values(df):
    return [round(r.value, 2) for r in df.orderBy("ts").collect()]


def run(f, metric, bucket="1m", **kw):
    return metric_trend(f, metric, timestamp(START), timestamp(END), bucket, **kw)


def test_cpu_reset_instant_is_left_out(spark):
    f = fleet(spark, host_metrics=host_rows(spark, [(1, at(0), 1000.0, 8000.0), (1, at(1), 1100.0, 8800.0), (1, at(2), 50.0, 400.0)]))
    assert values(run(f, "cpu.usage_percent")) == [11.11]


def test_capacity_weighting(spark):
    f = fleet(spark, host_metrics=host_rows(spark, [(1, at(0), 0.0, 0.0), (1, at(1), 90.0, 10.0), (2, at(0), 0.0, 0.0), (2, at(1), 100.0, 900.0)]))
    assert values(run(f, "cpu.usage_percent")) == [17.27]


def test_rate_is_zero_at_a_reset(spark):
    io = spark.createDataFrame([(1, at(0), "wwn:d", 100), (1, at(1), "wwn:d", 220), (1, at(2), "wwn:d", 50), (1, at(1), "dm:x", 9)],
                               "server_id bigint, collected_at timestamp, device_id string, ops_read bigint")
    assert values(run(fleet(spark, disk_io=io), "disk.read_iops")) == [2.0, 0.0]
    named = run(fleet(spark, disk_io=io), "disk.read_iops", collapse=False).collect()
    assert {r.dimension for r in named} == {"sda"}


def test_network_congested(spark):
    net = spark.createDataFrame([(1, at(0), "mac:n", 0, 0, 0, 0, 0, 0), (1, at(1), "mac:n", 400000, 400000, 0, 1000, 0, 0)],
                                "server_id bigint, collected_at timestamp, iface_id string, rx_bytes bigint, tx_bytes bigint, rx_packets bigint, tx_packets bigint, rx_dropped bigint, tx_dropped bigint")
    host = spark.createDataFrame([(1, at(0), 0, None, None), (1, at(1), 50, None, None)],
                                 "server_id bigint, collected_at timestamp, net_tcp_retransmits bigint, net_conntrack_usage int, net_conntrack_limit int")
    assert values(run(fleet(spark, net_io=net, host_metrics=host), "net.congested")) == [0.0, 1.0]
    assert values(run(fleet(spark, net_io=net, host_metrics=host), "net.congested_hosts")) == [0.0, 1.0]


def test_filesystem_values_are_carried(spark):
    fs = spark.createDataFrame([(1, at(0), "/", "ext4", 60, 40), (1, at(5), "/", "ext4", 61, 39), (1, at(0), "/boot", "ext4", 1, 99), (1, at(0), "/run", "tmpfs", 1, 9)],
                               "server_id bigint, collected_at timestamp, mountpoint string, fstype string, used_bytes bigint, free_bytes bigint")
    out = values(run(fleet(spark, filesystem=fs), "fs.usage_percent"))
    assert out == [60.0] * 5 + [61.0] * 56


def test_every_metric_key_has_a_builder_and_unknown_ones_fail(spark):
    assert len(TRENDS) == 34
    with pytest.raises(ValueError):
        run(fleet(spark), "cpu.nothing")
