"""Bucketed trends: ``metric_trend`` turns raw samples into ``(ts, value, dimension)`` for each metric key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.fleet import Fleet
from fleetlens.functions import thresholds as T
from fleetlens.functions.exprs import cpu_busy, cpu_total, data_volume, in_window, ratio, seconds, time_bucket
from fleetlens.operators.devices import (display_names, exploded_disks, exploded_ifaces, physical_disks,
                                         physical_ifaces)
from fleetlens.operators.kernels import (bucket_agg, crossed_any, crossed_hosts, lag_delta, locf_totals,
                                         rate, weighted_ratio)

TS, HOST = "collected_at", "server_id"

# Metric key -> dimension and counter for rates.
RATE_METRICS = {
    "disk.read_iops": ("device_id", "ops_read", 1.0),
    "disk.write_iops": ("device_id", "ops_write", 1.0),
    "disk.read_kbps": ("device_id", "io_read_bytes", 1024.0),
    "disk.write_kbps": ("device_id", "io_write_bytes", 1024.0),
    "net.rx_bytes_per_sec": ("iface_id", "rx_bytes", 1.0),
    "net.tx_bytes_per_sec": ("iface_id", "tx_bytes", 1.0),
    "net.rx_packets_per_sec": ("iface_id", "rx_packets", 1.0),
    "net.tx_packets_per_sec": ("iface_id", "tx_packets", 1.0),
}
PSI_RESOURCE = {"cpu.psi": "cpu", "mem.psi": "memory", "disk.psi": "io"}


@dataclass
class TrendRequest:
    """What every trend needs; ``width`` is the bucket in seconds."""

    fleet: Fleet
    start: Column
    end: Column
    width: int
    agg: str = "avg"
    dimension: str | None = None
    collapse: bool = True

    def rows(self, table: str, lead: bool = False) -> DataFrame:
        """Samples in range; delta series read one bucket earlier."""
        return self.fleet[table].filter(in_window(TS, self.start, self.end, self.width if lead else 0))

    def in_range(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col(TS) >= self.start)

    def hosts(self, *cols: str) -> DataFrame:
        return self.fleet["inventory"].select(HOST, *cols)

    def series(self, df: DataFrame, value: str = "v", dims: tuple[str, ...] = ()) -> DataFrame:
        return bucket_agg(df, TS, value, self.width, self.agg, dims)


def cpu_numerator(metric: str) -> Column:
    return cpu_busy() if metric == "cpu.usage_percent" else F.col("cpu_" + metric.split(".")[1].split("_")[0] + "_s")


def trend_cpu_share(r: TrendRequest, metric: str) -> DataFrame:
    """Share of CPU time per instant, fleet weighted; instants after a reset are left out."""
    df = r.rows("host_metrics", lead=True).select(HOST, TS, cpu_numerator(metric).alias("num"),
                                                  cpu_total().alias("total"))
    d = r.in_range(lag_delta(df, [HOST], TS, ["num", "total"], "raw"))
    d = d.filter((F.col("d_total") > 0) & (F.col("d_num") >= 0))
    return r.series(weighted_ratio(d, TS, F.col("d_num"), F.col("d_total")))


def trend_mem_weighted(r: TrendRequest, metric: str) -> DataFrame:
    part = {"usage": "mem_available_bytes", "available": "mem_available_bytes", "cached": "mem_cached_bytes",
            "buffers": "mem_buffered_bytes"}[metric.split(".")[1].split("_")[0]]
    df = r.rows("host_metrics").filter((F.col("mem_limit_bytes") > 0) & F.col(part).isNotNull())
    num = F.col("mem_limit_bytes") - F.col(part) if metric == "mem.usage_percent" else F.col(part)
    return r.series(weighted_ratio(df, TS, num, F.col("mem_limit_bytes")))


def trend_run_queue(r: TrendRequest, metric: str) -> DataFrame:
    df = r.rows("host_metrics").filter(F.col("cpu_run_queue").isNotNull()).select(HOST, TS, "cpu_run_queue")
    inv = r.hosts("os_family", "cpu_cores").filter(F.col("cpu_cores") > 0)
    v = weighted_ratio(df.join(inv, HOST), TS, F.col("cpu_run_queue"), F.col("cpu_cores"), ("os_family",), 1.0)
    return r.series(v, dims=("os_family",)).withColumnRenamed("os_family", "dimension")


def queue_limit() -> Column:
    return F.when(F.col("os_family") == "windows", T.RUN_QUEUE_PER_CORE_WINDOWS).otherwise(T.RUN_QUEUE_PER_CORE_LINUX)


def _queue_flags(r: TrendRequest) -> DataFrame:
    """Highest run queue per host and bucket first, so only the reduced rows meet the inventory."""
    peak = (r.rows("host_metrics").filter(F.col("cpu_run_queue").isNotNull())
            .groupBy(HOST, time_bucket(TS, r.width).alias("b")).agg(F.max("cpu_run_queue").alias("q")))
    inv = r.hosts("os_family", "cpu_cores").filter(F.col("cpu_cores") > 0)
    return peak.join(inv, HOST).select(
        HOST, F.col("b").alias(TS), ((F.col("q") / F.col("cpu_cores")) / queue_limit() >= 1.0).alias("crossed"))


def trend_cpu_saturation_hosts(r: TrendRequest, metric: str) -> DataFrame:
    return crossed_hosts(_queue_flags(r), TS, F.col("crossed"), r.width, HOST)


def trend_cpu_saturation(r: TrendRequest, metric: str) -> DataFrame:
    return crossed_any(_queue_flags(r), TS, F.col("crossed"), r.width)


def trend_cpu_blocked(r: TrendRequest, metric: str) -> DataFrame:
    df = r.rows("host_metrics").filter(F.col("cpu_blocked").isNotNull()).select(HOST, TS, "cpu_blocked")
    per = df.join(r.hosts("os_family"), HOST).groupBy(TS, "os_family").agg(F.avg("cpu_blocked").alias("v"))
    return r.series(per, dims=("os_family",)).withColumnRenamed("os_family", "dimension")


def _disk_deltas(r: TrendRequest, policy: str) -> DataFrame:
    df = physical_disks(r.rows("disk_io", lead=True), r.fleet["inventory"]).select(
        HOST, "device_id", TS,
        (F.coalesce("op_read_time_s", F.lit(0.0)) + F.coalesce("op_write_time_s", F.lit(0.0))).alias("t"),
        (F.coalesce("ops_read", F.lit(0)) + F.coalesce("ops_write", F.lit(0))).alias("ops"),
        F.coalesce("io_time_s", F.lit(0.0)).alias("io"))
    return r.in_range(lag_delta(df, [HOST, "device_id"], TS, ["t", "ops", "io"], policy))


def await_ms(trusted: bool) -> Column:
    """Milliseconds per operation of a busy device; ``trusted`` also wants 0 <= busy time <= wall time."""
    busy = (F.col("d_ops") > 0) & (F.col("dt") > 0) & (F.col("d_io") / F.col("dt") >= T.DISK_BUSY_MIN)
    if trusted:
        busy = busy & (F.col("d_io") >= 0) & (F.col("d_io") <= F.col("dt"))
    return F.when(busy, F.col("d_t") / F.col("d_ops") * 1000)


def trend_disk_await(r: TrendRequest, metric: str) -> DataFrame:
    per = _disk_deltas(r, "clamp").groupBy(TS).agg(F.max(await_ms(False)).alias("v"))
    return r.series(per)


def trend_disk_saturation_hosts(r: TrendRequest, metric: str) -> DataFrame:
    return crossed_hosts(_disk_deltas(r, "raw"), TS, await_ms(True) > T.AWAIT_MS, r.width, HOST)


def trend_disk_saturation(r: TrendRequest, metric: str) -> DataFrame:
    return crossed_any(_disk_deltas(r, "raw"), TS, await_ms(True) > T.AWAIT_MS, r.width)


def _tcp_deltas(r: TrendRequest) -> DataFrame:
    df = r.rows("host_metrics", lead=True).select(HOST, TS, "net_tcp_retransmits", "net_conntrack_usage",
                                                  "net_conntrack_limit")
    return lag_delta(df, [HOST], TS, ["net_tcp_retransmits"], "clamp")


def _net_deltas(r: TrendRequest, cols: list[str]) -> DataFrame:
    df = physical_ifaces(r.rows("net_io", lead=True), r.fleet["inventory"]).select(HOST, "iface_id", TS, *cols)
    return r.in_range(lag_delta(df, [HOST, "iface_id"], TS, cols, "clamp"))


def trend_net_retrans(r: TrendRequest, metric: str) -> DataFrame:
    """Two fleet series per instant, joined on the instant."""
    retrans = r.in_range(_tcp_deltas(r)).groupBy(TS).agg(F.sum("d_net_tcp_retransmits").alias("n"))
    packets = _net_deltas(r, ["tx_packets"]).groupBy(TS).agg(F.sum("d_tx_packets").alias("d"))
    return r.series(retrans.join(packets, TS).select(TS, (ratio(F.col("n"), F.col("d")) * 100).alias("v")))


def trend_net_drop(r: TrendRequest, metric: str) -> DataFrame:
    d = _net_deltas(r, ["rx_dropped", "tx_dropped", "rx_packets", "tx_packets"])
    return r.series(weighted_ratio(d, TS, F.col("d_rx_dropped") + F.col("d_tx_dropped"),
                                   F.col("d_rx_packets") + F.col("d_tx_packets")))


def _congestion(r: TrendRequest) -> DataFrame:
    d = _net_deltas(r, ["tx_packets", "rx_packets", "rx_dropped", "tx_dropped", "rx_bytes", "tx_bytes"])
    net = d.groupBy(TS, HOST).agg(
        F.sum("d_tx_packets").alias("txp"),
        (F.sum("d_rx_dropped") + F.sum("d_tx_dropped")).alias("drop"),
        (F.sum("d_rx_packets") + F.sum("d_tx_packets")).alias("pkt"),
        ((F.sum("d_rx_bytes") + F.sum("d_tx_bytes")) / 1024.0 / F.nullif(F.max("dt"), F.lit(0.0))).alias("kbps"))
    tcp = _tcp_deltas(r).select(
        TS, HOST, F.col("d_net_tcp_retransmits").alias("retrans"),
        F.when(F.col("net_conntrack_limit") > 0,
               ratio(F.col("net_conntrack_usage"), F.col("net_conntrack_limit"))).alias("track"))
    j = net.join(tcp, [TS, HOST], "left")
    traffic = F.col("kbps").isNull() | (F.col("kbps") >= T.MIN_TRAFFIC_KBPS)
    retrans = F.coalesce(ratio(F.col("retrans"), F.col("txp")) * 100 > T.RETRANS_PCT, F.lit(False))
    drop = F.coalesce(ratio(F.col("drop"), F.col("pkt")) * 100 > T.DROP_PCT, F.lit(False))
    track = F.coalesce(F.col("track") >= T.CONNTRACK_RATIO, F.lit(False))
    return j.withColumn("crossed", (traffic & (retrans | drop)) | track)


def trend_net_congested(r: TrendRequest, metric: str) -> DataFrame:
    return crossed_any(_congestion(r), TS, F.col("crossed"), r.width)


def trend_net_congested_hosts(r: TrendRequest, metric: str) -> DataFrame:
    return crossed_hosts(_congestion(r), TS, F.col("crossed"), r.width, HOST)


def trend_psi(r: TrendRequest, metric: str) -> DataFrame:
    df = r.rows("pressure", lead=True).filter((F.col("resource") == PSI_RESOURCE[metric]) & (F.col("scope") == "some"))
    d = r.in_range(lag_delta(df.select(HOST, TS, "stall_time_s"), [HOST], TS, ["stall_time_s"], "clamp"))
    return r.series(weighted_ratio(d.filter(F.col("dt") > 0), TS, F.col("d_stall_time_s"), F.col("dt")))


def _paging_flags(r: TrendRequest) -> DataFrame:
    df = r.rows("host_metrics", lead=True).select(HOST, TS, "paging_in", "paging_major")
    df = df.join(r.hosts("os_family"), HOST)
    win = F.col("os_family") == "windows"
    df = df.withColumn("p", F.when(win, F.col("paging_in")).otherwise(F.col("paging_major"))) \
        .filter(F.col("p").isNotNull())
    d = r.in_range(lag_delta(df, [HOST], TS, ["p"], "clamp")).filter(F.col("dt") > 0)
    per_s = F.col("d_p") / F.col("dt")
    return d.withColumn("crossed", F.when(win, per_s >= T.WINDOWS_PAGES_IN_PER_S).otherwise(per_s > 0))


def trend_paging_pressure(r: TrendRequest, metric: str) -> DataFrame:
    return crossed_any(_paging_flags(r), TS, F.col("crossed"), r.width)


def trend_paging_pressure_hosts(r: TrendRequest, metric: str) -> DataFrame:
    return crossed_hosts(_paging_flags(r), TS, F.col("crossed"), r.width, HOST)


def trend_fs_usage(r: TrendRequest, metric: str) -> DataFrame:
    """Fleet: carried values summed per bucket. Per mount: ratio per instant."""
    if r.collapse:
        df = r.rows("filesystem", lead=True).filter(data_volume())
        t = locf_totals(df, [HOST, "mountpoint"], TS, ["used_bytes", "free_bytes"], r.width, r.start, r.end)
        total = F.col("used_bytes") + F.col("free_bytes")
        return t.filter(total > 0).select("ts", (ratio(F.col("used_bytes"), total) * 100).alias("value"))
    df = r.rows("filesystem").filter(data_volume() & ((F.col("used_bytes") + F.col("free_bytes")) > 0))
    if r.dimension is not None:
        df = df.filter(F.col("mountpoint") == r.dimension)
    v = weighted_ratio(df, TS, F.col("used_bytes"), F.col("used_bytes") + F.col("free_bytes"), ("mountpoint",))
    return r.series(v, dims=("mountpoint",)).withColumnRenamed("mountpoint", "dimension")


def trend_rate(r: TrendRequest, metric: str) -> DataFrame:
    """Fleet: mean rate per series and bucket, then summed. Per dimension: one line per display name."""
    dim, counter, unit = RATE_METRICS[metric]
    disk = dim == "device_id"
    raw = r.rows("disk_io" if disk else "net_io", lead=True)
    raw = (physical_disks if disk else physical_ifaces)(raw, r.fleet["inventory"])
    if r.dimension is not None and not r.collapse:
        raw = raw.filter(F.col(dim) == r.dimension)
    cnt = F.col(counter) / F.lit(unit) if unit != 1.0 else F.col(counter)
    rates = r.in_range(rate(raw.select(HOST, dim, TS, cnt.alias("cnt")), [HOST, dim], TS, "cnt"))
    rates = rates.filter(F.col("v").isNotNull())
    if r.collapse:
        per = rates.groupBy(HOST, dim, time_bucket(TS, r.width).alias("ts")).agg(F.avg("v").alias("sv"))
        return per.groupBy("ts").agg(F.sum("sv").alias("value"))
    exploded = (exploded_disks if disk else exploded_ifaces)(r.fleet["inventory"])
    named = rates.join(display_names(exploded, dim), [HOST, dim], "left").withColumn(
        "dimension", F.coalesce("display_name", dim))
    return bucket_agg(named, TS, "v", r.width, r.agg, (dim, "dimension")).drop(dim)


TRENDS = {
    **{f"cpu.{p}_percent": trend_cpu_share for p in ("usage", "user", "system", "iowait", "nice")},
    **{f"mem.{p}_percent": trend_mem_weighted for p in ("usage", "available", "cached", "buffers")},
    "cpu.run_queue": trend_run_queue, "cpu.saturation_hosts": trend_cpu_saturation_hosts,
    "cpu.saturation": trend_cpu_saturation, "cpu.blocked": trend_cpu_blocked,
    "disk.io_saturation": trend_disk_await, "disk.saturation_hosts": trend_disk_saturation_hosts,
    "disk.saturation": trend_disk_saturation,
    "net.retrans_percent": trend_net_retrans, "net.drop_percent": trend_net_drop,
    "net.congested": trend_net_congested, "net.congested_hosts": trend_net_congested_hosts,
    "cpu.psi": trend_psi, "mem.psi": trend_psi, "disk.psi": trend_psi,
    "mem.paging_pressure": trend_paging_pressure, "mem.paging_pressure_hosts": trend_paging_pressure_hosts,
    "fs.usage_percent": trend_fs_usage,
    **{m: trend_rate for m in RATE_METRICS},
}


def metric_trend(fleet: Fleet, metric: str, start: Column, end: Column, bucket: int | str, hosts: DataFrame | None = None,
                 agg: str = "avg", dimension: str | None = None, collapse: bool = True) -> DataFrame:
    """``(ts, value, dimension)`` for one metric key; ``hosts=None`` means the whole fleet."""
    if metric not in TRENDS:
        raise ValueError(f"unknown metric {metric}")
    scope = fleet if hosts is None else fleet.select_hosts(hosts)
    r = TrendRequest(scope, start, end, seconds(bucket), agg, dimension, collapse)
    out = TRENDS[metric](r, metric)
    if "dimension" not in out.columns:
        out = out.withColumn("dimension", F.lit(None).cast("string"))
    return out.select("ts", "value", "dimension")
