"""Error axes: machine checks, out-of-memory kills, corrupted memory, interface and disk errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.fleet import Fleet
from fleetlens.functions import rules
from fleetlens.operators.kernels import max_min_delta
from fleetlens.operators.snapshots import recent

HOST, TS = "server_id", "collected_at"


def net_error_totals(net_io: DataFrame) -> DataFrame:
    both = F.coalesce("rx_errors", F.lit(0)) + F.coalesce("tx_errors", F.lit(0))
    per = max_min_delta(net_io.withColumn("_e", both), [HOST, "iface_id"], "_e")
    return per.groupBy(HOST).agg(F.sum("d").alias("net_errors"), F.count("*").alias("ifaces"))


def disk_error_totals(disk_error: DataFrame) -> DataFrame:
    """Increments per natural key, then the count, the sorted kinds that occurred and the last time of one."""
    keys = [HOST, "device_id", "error_kind", "error_class", "member"]
    per = disk_error.groupBy(*keys).agg((F.max("error_count") - F.min("error_count")).alias("d"), F.max(TS).alias("last_at"))
    kind = F.when(F.col("error_class") == "", F.col("error_kind")).otherwise(F.concat_ws("/", "error_kind", "error_class"))
    hit = F.col("d") > 0
    return per.groupBy(HOST).agg(
        F.sum("d").alias("disk_errors"), F.sort_array(F.collect_set(F.when(hit, kind))).alias("disk_error_kinds"),
        F.max(F.when(hit, F.col("last_at"))).alias("last_disk_error_at"))


def host_errors(fleet: Fleet, since: Column, anchor: Column) -> DataFrame:
    """Error increments per host since a bound; corrupted memory is a gauge (newest and highest value)."""
    m = recent(fleet["host_metrics"], since, anchor).groupBy(HOST).agg(
        F.coalesce(F.max("cpu_mce") - F.min("cpu_mce"), F.lit(0)).alias("mce"),
        F.coalesce(F.max("mem_oom_kill") - F.min("mem_oom_kill"), F.lit(0)).alias("oom"),
        F.max_by("mem_hardware_corrupted_bytes", TS).alias("corrupted_now"),
        F.coalesce(F.max("mem_hardware_corrupted_bytes"), F.lit(0)).alias("corrupted_max"), F.count("*").alias("samples"))
    n = net_error_totals(recent(fleet["net_io"], since, anchor))
    d = disk_error_totals(recent(fleet["disk_error"], since, anchor))
    out = fleet["inventory"].select(HOST, "os_family").join(m, HOST, "left").join(n, HOST, "left").join(d, HOST, "left")
    return out.fillna(0, ["mce", "oom", "samples", "net_errors", "ifaces", "disk_errors"])


def fleet_errors(errors: DataFrame) -> DataFrame:
    """Hosts touched per axis, and the hosts that reported at all."""
    return errors.agg(
        F.count_if(F.col("samples") > 0).alias("total"), F.count_if(F.col("mce") > 0).alias("mce_hosts"),
        F.count_if(F.col("oom") > 0).alias("oom_hosts"), F.count_if(F.col("corrupted_max") > 0).alias("corrupted_hosts"),
        F.count_if(F.col("net_errors") > 0).alias("net_error_hosts"), F.count_if(F.col("disk_errors") > 0).alias("disk_error_hosts"))


def error_hosts(fleet: Fleet, since: Column, anchor: Column) -> DataFrame:
    """Hosts with any error, as the union of the three sources."""
    m = recent(fleet["host_metrics"], since, anchor).groupBy(HOST).agg(
        (F.max("cpu_mce") - F.min("cpu_mce")).alias("mce"), (F.max("mem_oom_kill") - F.min("mem_oom_kill")).alias("oom"),
        F.max("mem_hardware_corrupted_bytes").alias("corrupted"))
    host = m.filter((F.col("mce") > 0) | (F.col("oom") > 0) | (F.col("corrupted") > 0)).select(HOST)
    net = net_error_totals(recent(fleet["net_io"], since, anchor)).filter(F.col("net_errors") > 0).select(HOST)
    disk = disk_error_totals(recent(fleet["disk_error"], since, anchor)).filter(F.col("disk_errors") > 0).select(HOST)
    return host.union(net).union(disk).distinct()


def error_signals(errors: DataFrame) -> DataFrame:
    """Rows ``(host, key, state, count)``: no_data, clean, occurred or not_applicable."""
    def row(key: str, count: Column, measured: Column, absent: Column | None = None) -> Column:
        gone = F.lit(False) if absent is None else absent
        state = (F.when(gone, "not_applicable").when(~measured, "no_data").when(count > 0, "occurred").otherwise("clean"))
        return F.struct(F.lit(key).alias("key"), state.alias("state"), F.when(~gone & measured, count).alias("count"))

    c = F.col
    return errors.select(HOST, F.inline(F.array(
        row("cpu_mce", c("mce"), c("samples") > 0), row("mem_oom", c("oom"), c("samples") > 0),
        row("net_errors", c("net_errors"), c("ifaces") > 0), row("disk_errors", c("disk_errors"), F.lit(True)),
        row("mem_corrupted", c("corrupted_now"), c("corrupted_now").isNotNull(), rules.windows()))))
