"""Bucket tables (default five minutes) that pre-reduce the raw samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.exprs import cpu_total, ratio
from fleetlens.operators.kernels import counter_delta

HOST_COUNTERS = ("cpu_total_s", "cpu_idle_s", "cpu_user_s", "cpu_system_s", "cpu_iowait_s", "cpu_steal_s",
                 "paging_major", "paging_out", "paging_in", "mem_oom_kill", "net_tcp_retransmits", "cpu_mce")
DISK_COUNTERS = ("io_read_bytes", "io_write_bytes", "ops_read", "ops_write", "op_read_time_s", "op_write_time_s",
                 "io_time_s")
NET_COUNTERS = ("rx_bytes", "tx_bytes", "rx_packets", "tx_packets", "rx_dropped", "tx_dropped", "rx_errors",
                "tx_errors")


def _pct(part: str, whole: str, complement: bool = False) -> Column:
    share = ratio(F.col(part), F.col(whole))
    value = (F.lit(1.0) - share if complement else share) * 100
    return F.when((F.col(whole) > 0) & F.col(part).isNotNull(), value)


def rollup_host(samples: DataFrame, width: int | str = "5m") -> DataFrame:
    """One row per host and bucket: counter deltas, memory / commit shares, queue gauges, sample count."""
    df = samples.withColumn("cpu_total_s", cpu_total())
    mem = _pct("mem_available_bytes", "mem_limit_bytes", complement=True)
    commit = _pct("mem_commit_usage_bytes", "mem_commit_limit_bytes")
    track = F.when((F.col("net_conntrack_limit") > 0) & F.col("net_conntrack_usage").isNotNull(),
                   ratio(F.col("net_conntrack_usage"), F.col("net_conntrack_limit")))
    has_limit = F.col("mem_limit_bytes") > 0
    return counter_delta(
        df, ["server_id"], "collected_at", HOST_COUNTERS, width, spans=("paging_in",),
        extra=[
            F.avg(mem).alias("mem_pct_avg"), F.max(mem).alias("mem_pct_max"), F.count(mem).alias("mem_sample"),
            F.avg(commit).alias("commit_pct_avg"), F.max(commit).alias("commit_pct_max"),
            F.avg("cpu_run_queue").alias("run_queue_avg"), F.max("cpu_run_queue").alias("run_queue_max"),
            F.avg("cpu_blocked").alias("blocked_avg"), F.max("cpu_blocked").alias("blocked_max"),
            F.avg(track).alias("conntrack_avg"), F.max(track).alias("conntrack_max"),
            F.max("mem_hardware_corrupted_bytes").alias("corrupted_max"),
            F.avg(F.when(has_limit, F.col("mem_available_bytes"))).alias("mem_available_avg"),
            F.avg(F.when(has_limit, F.col("mem_limit_bytes"))).alias("mem_limit_avg"),
            F.avg(_pct("mem_cached_bytes", "mem_limit_bytes")).alias("mem_cached_pct_avg"),
            F.avg(_pct("mem_buffered_bytes", "mem_limit_bytes")).alias("mem_buffered_pct_avg"),
            F.count("*").alias("sample_count"),
        ])


def rollup_filesystem(samples: DataFrame, width: int | str = "5m") -> DataFrame:
    """One row per host, mount and bucket: used shares, size, first / last free space. Pure hash aggregate."""
    from fleetlens.functions.exprs import time_bucket

    total = F.col("used_bytes") + F.col("free_bytes")
    inodes = F.col("inodes_used") + F.col("inodes_free")
    used = F.when(total > 0, ratio(F.col("used_bytes"), total) * 100)
    inode_used = F.when(inodes > 0, ratio(F.col("inodes_used"), inodes) * 100)
    ts = "collected_at"
    return samples.groupBy("server_id", "mountpoint", time_bucket(ts, width).alias("bucket")).agg(
        F.max(used).alias("used_pct_max"), F.avg(used).alias("used_pct_avg"), F.max(total).alias("total_bytes_max"),
        F.min_by("free_bytes", ts).alias("free_first"), F.max_by("free_bytes", ts).alias("free_last"),
        F.max(inode_used).alias("inode_pct_max"), F.min_by("inodes_free", ts).alias("inode_free_first"),
        F.max_by("inodes_free", ts).alias("inode_free_last"), F.max_by("fstype", ts).alias("fstype"),
        F.count("*").alias("sample_count"))


def rollup_disk(samples: DataFrame, width: int | str = "5m") -> DataFrame:
    return counter_delta(samples, ["server_id", "device_id"], "collected_at", DISK_COUNTERS, width,
                         spans=("io_time_s", "ops_read"),
                         extra=[F.avg("pending_ops").alias("pending_avg"), F.max("pending_ops").alias("pending_max"),
                                F.count("*").alias("sample_count")])


def rollup_net(samples: DataFrame, width: int | str = "5m") -> DataFrame:
    return counter_delta(samples, ["server_id", "iface_id"], "collected_at", NET_COUNTERS, width, spans=("rx_bytes",),
                         extra=[F.max("link_speed_bps").alias("link_max"), F.count("*").alias("sample_count")])


def rollup_core(samples: DataFrame, width: int | str = "5m") -> DataFrame:
    parts = ("cpu_user_s", "cpu_nice_s", "cpu_system_s", "cpu_idle_s", "cpu_iowait_s", "cpu_irq_s", "cpu_softirq_s",
             "cpu_steal_s")
    for p in parts:
        if p not in samples.columns:
            samples = samples.withColumn(p, F.lit(None).cast("double"))
    df = samples.withColumn("cpu_total_s", cpu_total())
    return counter_delta(df, ["server_id", "core_id"], "collected_at", ("cpu_total_s", "cpu_idle_s"), width,
                         extra=[F.count("*").alias("sample_count")])


def realtime_union(stored: DataFrame, samples: DataFrame, rollup, width: int | str, high_water: Column) -> DataFrame:
    """Stored buckets below the high-water mark plus buckets computed now from the raw tail at or above it."""
    tail = rollup(samples.filter(F.col("collected_at") >= high_water), width)
    return stored.filter(F.col("bucket") < high_water).unionByName(tail)
