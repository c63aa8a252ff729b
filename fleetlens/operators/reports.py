"""Per-host and fleet statistics over a window, computed from the bucket tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.fleet import Fleet
from fleetlens.functions import thresholds as T
from fleetlens.functions.exprs import data_volume, in_window, ratio, seconds, shift
from fleetlens.operators import rollups as R
from fleetlens.operators.devices import physical_disks, physical_ifaces
from fleetlens.operators.kernels import latest_one

HOST = "server_id"


def p95(c: str | Column) -> Column:
    return F.percentile(c, F.lit(0.95))


class Rollups:
    """The five bucket tables of a fleet; those in ``stored`` are used as they are, missing ones are computed from the
    samples and added to it.

    ``start`` / ``end`` are pushed into the sample scans. ``history_start`` bounds the capacity history (None reads all
    of it, as the growth of a volume needs).
    """

    def __init__(self, fleet: Fleet, start: Column, end: Column, width: int | str = "5m",
                 stored: dict[str, DataFrame] | None = None):
        self.fleet, self.start, self.end, self.width = fleet, start, end, seconds(width)
        self._tables: dict[str, DataFrame] = dict(stored or {})  # what is computed here holds for this window only

    def _rolled(self, name: str, samples: str, fn, bounded: bool = True) -> DataFrame:
        if name not in self._tables:
            df = self.fleet[samples]
            upper = F.col("collected_at") < shift(self.end, self.width)
            df = df.filter((F.col("collected_at") >= self.start) & upper if bounded else upper)
            self._tables[name] = fn(df, self.width)
        df = self._tables[name]
        return df.filter(in_window("bucket", self.start, self.end)) if bounded else df.filter(F.col("bucket") <= self.end)

    @property
    def host(self) -> DataFrame:
        return self._rolled("host", "host_metrics", R.rollup_host)

    @property
    def disk(self) -> DataFrame:
        return physical_disks(self._rolled("disk", "disk_io", R.rollup_disk), self.fleet["inventory"])

    @property
    def net(self) -> DataFrame:
        return physical_ifaces(self._rolled("net", "net_io", R.rollup_net), self.fleet["inventory"])

    @property
    def core(self) -> DataFrame:
        return self._rolled("core", "cpu_core", R.rollup_core)

    @property
    def filesystem_history(self) -> DataFrame:
        return self._rolled("filesystem", "filesystem", R.rollup_filesystem, bounded=False).filter(data_volume())

    @property
    def filesystem(self) -> DataFrame:
        return self.filesystem_history.filter(in_window("bucket", self.start, self.end))


def share(part: str) -> Column:
    """Share of CPU time of a bucket, never negative; NULL without CPU time."""
    return F.when(F.col("d_cpu_total_s") > 0, F.greatest(F.lit(0.0), F.col(part) / F.col("d_cpu_total_s") * 100))


def busy_share() -> Column:
    return F.when(F.col("d_cpu_total_s") > 0,
                  F.greatest(F.lit(0.0), (1 - F.col("d_cpu_idle_s") / F.col("d_cpu_total_s")) * 100))


def host_stats(roll: DataFrame) -> DataFrame:
    """All host statistics in one aggregate. Percentile buffers hold one value per bucket of the window."""
    b = roll.withColumns({
        "cpu_pct": busy_share(), "iowait_pct": share("d_cpu_iowait_s"), "steal_pct": share("d_cpu_steal_s"),
        "pages_rate": F.when(F.col("td_paging_in") > 0, F.greatest(F.lit(0.0), F.col("d_paging_in") / F.col("td_paging_in"))),
        "x": F.unix_timestamp("bucket").cast("double")})
    return b.groupBy(HOST).agg(
        p95("cpu_pct").alias("cpu_p95"), F.percentile("cpu_pct", F.lit(0.5)).alias("cpu_median"),
        F.avg("cpu_pct").alias("cpu_avg"), F.max("cpu_pct").alias("cpu_peak"), F.count("cpu_pct").alias("cpu_sample"),
        F.count("*").alias("total_buckets"),
        p95("iowait_pct").alias("iowait_p95"), F.max("iowait_pct").alias("iowait_peak"),
        p95("run_queue_avg").alias("run_queue_p95"), p95("pages_rate").alias("pages_in_p95"),
        p95("mem_pct_avg").alias("mem_p95"), p95("mem_pct_max").alias("mem_near_peak"),
        F.avg("mem_pct_avg").alias("mem_avg"), F.max("mem_pct_max").alias("mem_peak"),
        F.count("mem_pct_avg").alias("mem_sample"),
        p95("steal_pct").alias("steal_p95"), p95("blocked_avg").alias("blocked_p95"),
        F.bool_or(F.coalesce("d_paging_major", F.lit(0)) > 0).alias("swap_paging"),
        F.bool_or(F.coalesce("d_mem_oom_kill", F.lit(0)) > 0).alias("oom_occurred"),
        F.sum("d_net_tcp_retransmits").alias("retrans_total"), F.max("conntrack_max").alias("conntrack_ratio"),
        (F.regr_slope("cpu_pct", "x") * 86400).alias("cpu_slope"),
        (F.regr_slope("mem_pct_avg", "x") * 86400).alias("mem_slope"))


def worst_mount(fs: DataFrame) -> DataFrame:
    """Highest used and inode share per host, and the mount with the highest used share (ties by name)."""
    per = fs.groupBy(HOST, "mountpoint").agg(F.max("used_pct_max").alias("used"), F.max("inode_pct_max").alias("inode"))
    top = per.groupBy(HOST).agg(F.max("used").alias("disk_used_pct"), F.max("inode").alias("inode_used_pct"))
    name = latest_one(per.filter(F.col("used").isNotNull()), [HOST], [F.desc("used"), F.asc("mountpoint")])
    return top.join(name.select(HOST, F.col("mountpoint").alias("worst_mount")), HOST, "left")


def mount_spans(history: DataFrame) -> DataFrame:
    """Free space at the start and the end of the known history of every mount."""
    return history.groupBy(HOST, "mountpoint").agg(
        F.min_by("free_first", "bucket").alias("av_first"), F.max_by("free_last", "bucket").alias("av_last"),
        F.max("total_bytes_max").alias("total_bytes"),
        F.min_by("inode_free_first", "bucket").alias("in_first"), F.max_by("inode_free_last", "bucket").alias("in_last"),
        F.max("inode_pct_max").alias("inode_used_pct"),
        ((F.unix_timestamp(F.max("bucket")) - F.unix_timestamp(F.min("bucket"))) / F.lit(86400.0)).alias("span_days"))


def runway(first: str, last: str) -> Column:
    """Days until the free space is used up at the observed rate; NULL if it does not fall or is seen too briefly."""
    drop = (F.col(first) - F.col(last)).cast("double")
    known = (drop > 0) & (F.col("span_days") >= T.RATE_SPAN_DAYS) & (F.col(last) >= 0)
    return F.when(known, F.greatest(F.lit(0.0), F.floor(F.col(last) / (drop / F.col("span_days"))).cast("double")))


def capacity_target() -> Column:
    """Size in bytes that lasts: a year ahead for a trusted trend, a month ahead for a short one, else headroom over
    what is used now once the static guard is passed."""
    drop = (F.col("av_first") - F.col("av_last")).cast("double")
    per_day = drop / F.col("span_days")
    used = (F.col("total_bytes") - F.col("av_last")).cast("double")
    used_pct = (1 - F.col("av_last") / F.col("total_bytes")) * 100
    room = F.lit(T.HEADROOM_PCT / 100.0)
    sized = F.col("total_bytes") > 0
    return (F.when((drop > 0) & (F.col("span_days") >= T.TREND_SPAN_DAYS) & sized, used + T.TARGET_RUNWAY_DAYS * per_day)
            .when((drop > 0) & (F.col("span_days") >= T.RATE_SPAN_DAYS) & sized,
                  (used + T.NEAR_HORIZON_DAYS * per_day) / room)
            .when(sized & (F.col("av_last") >= 0) & (used_pct >= T.STATIC_GUARD_PCT), used / room))


def mount_capacity(history: DataFrame) -> DataFrame:
    """Per mount: used share, byte / inode runway, sizing target in bytes, projection for the near horizon."""
    return span_capacity(mount_spans(history))


def span_capacity(spans: DataFrame) -> DataFrame:
    """The capacity figures of ``mount_spans``, computed from the history or kept by an index."""
    drop = (F.col("av_first") - F.col("av_last")).cast("double")
    sized = F.col("total_bytes") > 0
    return spans.withColumns({
        "used_pct": F.when(sized, (1 - F.col("av_last") / F.col("total_bytes")) * 100),
        "byte_runway_days": runway("av_first", "av_last"), "inode_runway_days": runway("in_first", "in_last"),
        "target_raw": capacity_target(),
        "proj_30d_pct": F.when((drop > 0) & (F.col("span_days") >= T.RATE_SPAN_DAYS) & sized,
                               (1 - (F.col("av_last") - T.NEAR_HORIZON_DAYS * (drop / F.col("span_days")))
                                / F.col("total_bytes")) * 100),
    }).withColumn("target_bytes", F.ceil("target_raw"))


def host_runway(capacity: DataFrame) -> DataFrame:
    """Shortest byte and inode runway per host and the mount that drives it."""
    low = capacity.groupBy(HOST).agg(F.min("byte_runway_days").alias("runway_days"),
                                     F.min("inode_runway_days").alias("inode_runway_days"))
    near = capacity.filter(F.col("byte_runway_days").isNotNull() | (F.col("used_pct") >= T.STATIC_GUARD_PCT))
    lead = latest_one(near, [HOST], [F.asc_nulls_last("byte_runway_days"), F.desc_nulls_last("used_pct"),
                                     F.asc("mountpoint")])
    lead = lead.select(HOST, F.col("mountpoint").alias("driving_mount"),
                       F.ceil(F.col("target_raw") / 1e9).cast("double").alias("target_gb"), "proj_30d_pct",
                       F.col("used_pct").alias("driving_used_pct"))
    return low.join(lead, HOST, "left")


def disk_facts(disk: DataFrame) -> DataFrame:
    """Await of the busiest device (p95 over buckets) and the IOPS baseline, from one pass over the disk rollup."""
    busy = F.col("d_io_time_s") / F.nullif(F.col("td_io_time_s"), F.lit(0.0)) >= T.DISK_BUSY_MIN
    ops = F.col("d_ops_read") + F.col("d_ops_write")
    wait = F.when(busy, (F.col("d_op_read_time_s") + F.col("d_op_write_time_s")) / F.nullif(ops, F.lit(0)) * 1000)
    per = disk.groupBy(HOST, "bucket").agg(F.max(wait).alias("worst"), F.sum(ops).alias("ops"),
                                           F.max("td_ops_read").alias("dt"))
    live = F.col("dt") > 0
    out = per.groupBy(HOST).agg(p95("worst").alias("await_p95_ms"), F.sum(F.when(live, F.col("ops"))).alias("o"),
                                F.sum(F.when(live, F.col("dt"))).alias("t"))
    return out.select(HOST, "await_p95_ms", F.when(F.col("t") > 0, F.col("o") / F.col("t")).alias("iops"))


def net_quality(net: DataFrame) -> DataFrame:
    return net.groupBy(HOST).agg(
        (F.sum("d_rx_dropped") + F.sum("d_tx_dropped")).alias("drops"),
        (F.sum("d_rx_packets") + F.sum("d_tx_packets")).alias("packets"), F.sum("d_tx_packets").alias("tx_packets"))


def percore_max(core: DataFrame) -> DataFrame:
    """95th percentile per core, then the busiest core of the host."""
    per = core.withColumn("u", busy_share()).filter(F.col("u").isNotNull()).groupBy(HOST, "core_id").agg(p95("u").alias("c"))
    return per.groupBy(HOST).agg(F.max("c").alias("percore_p95_max"))


def report_aggregate(fleet: Fleet, rolls: Rollups, period_days: float) -> DataFrame:
    """One row per inventory host with every statistic of the window; silent hosts keep NULL statistics."""
    expected = period_days * 86400.0 / rolls.width
    s = fleet["inventory"].join(host_stats(rolls.host), HOST, "left")
    for part in (worst_mount(rolls.filesystem), host_runway(mount_capacity(rolls.filesystem_history)),
                 disk_facts(rolls.disk), net_quality(rolls.net), percore_max(rolls.core)):
        s = s.join(part, HOST, "left")
    return s.withColumns({
        "cpu_sufficiency": F.col("cpu_sample") / F.lit(expected), "mem_sufficiency": F.col("mem_sample") / F.lit(expected),
        "burst_ratio": F.when(F.col("cpu_median") > 0, F.col("cpu_p95") / F.col("cpu_median")),
        "swap_paging": F.coalesce("swap_paging", F.lit(False)), "oom_occurred": F.coalesce("oom_occurred", F.lit(False)),
        "history_hours": F.col("total_buckets") * F.lit(rolls.width / 3600.0),
        "disk_iops": F.floor("iops"),
        "drop_pct": ratio(F.col("drops"), F.col("packets")) * 100,
        "retrans_pct": ratio(F.col("retrans_total"), F.col("tx_packets")) * 100,
    }).drop("iops", "drops", "packets", "tx_packets", "cpu_median")


def _distinct_minus_one(history: DataFrame, col: str, out: str) -> DataFrame:
    """Distinct values first (map-side combined), then a plain count per host."""
    d = history.filter(F.col(col).isNotNull()).select(HOST, col).distinct()
    return d.groupBy(HOST).agg(F.greatest(F.lit(0).cast("bigint"), F.count("*") - 1).alias(out))


def reboot_counts(history: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    return _distinct_minus_one(_between(history, start, end), "boot_time", "reboot_count")


def restart_counts(history: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    return _distinct_minus_one(_between(history, start, end), "agent_started_at", "restart_count")


def _between(df: DataFrame, start: Column | None, end: Column | None) -> DataFrame:
    if start is not None:
        df = df.filter(F.col("collected_at") >= start)
    return df if end is None else df.filter(F.col("collected_at") <= end)


def server_stability(history: DataFrame) -> DataFrame:
    """All-time reboot and restart counts per host."""
    return reboot_counts(history).join(restart_counts(history), HOST, "full_outer").fillna(
        0, ["reboot_count", "restart_count"])


def _baseline(per_dev: DataFrame, sums: dict[str, Column], dt: str, units: dict[str, float]) -> DataFrame:
    per = per_dev.filter(F.col(dt) > 0).groupBy(HOST, "bucket").agg(
        *[F.sum(c).alias(n) for n, c in sums.items()], F.max(dt).alias("dt"))
    aggs = [F.sum("dt").alias("t")]
    for n, u in units.items():
        per_s = F.col(n) / F.col("dt") / F.lit(u)
        aggs += [F.sum(n).alias(f"s_{n}"), p95(per_s).alias(f"{n}_p95"), F.max(per_s).alias(f"{n}_peak")]
    out = per.groupBy(HOST).agg(*aggs)
    cols = [HOST]
    for n, u in units.items():
        cols += [F.when(F.col("t") > 0, F.col(f"s_{n}") / F.col("t") / F.lit(u)).alias(f"{n}_baseline"),
                 F.col(f"{n}_p95"), F.col(f"{n}_peak")]
    return out.select(*cols)


def disk_baseline(disk: DataFrame) -> DataFrame:
    """IOPS and throughput (kB/s): sum of deltas over sum of seconds, p95 and peak of the bucket rates."""
    out = _baseline(disk, {"iops": F.col("d_ops_read") + F.col("d_ops_write"),
                           "kbps": F.col("d_io_read_bytes") + F.col("d_io_write_bytes")}, "td_ops_read",
                    {"iops": 1.0, "kbps": 1024.0})
    return out.withColumn("iops_baseline", F.floor("iops_baseline"))


def net_baseline(net: DataFrame) -> DataFrame:
    return _baseline(net, {"rx": F.col("d_rx_bytes"), "tx": F.col("d_tx_bytes")}, "td_rx_bytes",
                     {"rx": 1024.0, "tx": 1024.0})


def attach_baselines(report: DataFrame, history: DataFrame, rolls: Rollups) -> DataFrame:
    """Report rows with reboot / restart counts (zero when unseen) and disk / net baselines (NULL when unseen)."""
    counts = reboot_counts(history, rolls.start, rolls.end).join(
        restart_counts(history, rolls.start, rolls.end), HOST, "full_outer")
    out = report.join(counts, HOST, "left").fillna(0, ["reboot_count", "restart_count"])
    net = net_baseline(rolls.net).select(HOST, F.col("rx_baseline").alias("net_rx_kbps"),
                                         F.col("tx_baseline").alias("net_tx_kbps"))
    disk = disk_baseline(rolls.disk).select(HOST, F.col("iops_baseline").alias("disk_iops_baseline"),
                                            F.col("kbps_baseline").alias("disk_kbps_baseline"))
    return out.join(net, HOST, "left").join(disk, HOST, "left")


def memory_breakdown(roll: DataFrame) -> DataFrame:
    return roll.groupBy(HOST).agg(
        F.avg("mem_pct_avg").alias("used_pct"), (100 - F.avg("mem_pct_avg")).alias("available_pct"),
        F.avg("mem_cached_pct_avg").alias("cached_pct"), F.avg("mem_buffered_pct_avg").alias("buffers_pct"))


def cpu_breakdown(roll: DataFrame) -> DataFrame:
    def part(c: str) -> Column:
        return F.avg(F.when(F.col("d_cpu_total_s") > 0, F.col(c) / F.col("d_cpu_total_s") * 100))

    return roll.groupBy(HOST).agg(part("d_cpu_user_s").alias("user_pct"), part("d_cpu_system_s").alias("system_pct"),
                                  part("d_cpu_iowait_s").alias("iowait_pct"))


def environment_utilization(rolls: Rollups) -> DataFrame:
    """One row for the fleet. Host buckets are reduced to one row per bucket before the scalars are taken."""
    r = rolls.host
    cpu_ok = (F.col("d_cpu_total_s") > 0) & F.col("d_cpu_idle_s").isNotNull()
    mem_ok = (F.col("mem_limit_avg") > 0) & F.col("mem_available_avg").isNotNull()
    per = r.groupBy("bucket").agg(
        F.sum(F.when(cpu_ok, F.col("d_cpu_idle_s"))).alias("idle"), F.sum(F.when(cpu_ok, F.col("d_cpu_total_s"))).alias("total"),
        F.sum(F.when(mem_ok, F.col("mem_limit_avg") - F.col("mem_available_avg"))).alias("mu"),
        F.sum(F.when(mem_ok, F.col("mem_limit_avg"))).alias("ml"))
    busy = F.greatest(F.lit(0.0), (1 - F.col("idle") / F.col("total")) * 100)
    host = per.agg(
        F.when(F.sum("total") > 0, F.greatest(F.lit(0.0), (1 - F.sum("idle") / F.sum("total")) * 100)).alias("cpu_avg"),
        F.when(F.sum("ml") > 0, F.sum("mu") / F.sum("ml") * 100).alias("mem_avg"),
        p95(F.when(F.col("total") > 0, busy)).alias("cpu_p95"),
        p95(F.when(F.col("ml") > 0, F.col("mu") / F.col("ml") * 100)).alias("mem_p95"))
    fs = rolls.filesystem.filter((F.col("total_bytes_max") > 0) & F.col("used_pct_avg").isNotNull())
    disk = fs.agg((F.sum(F.col("total_bytes_max") * F.col("used_pct_avg") / 100) / F.sum("total_bytes_max") * 100)
                  .alias("disk_avg"))
    size = r.select(HOST).distinct().agg(F.count("*").alias("sample_size"))
    out = host.withColumn("_k", F.lit(1))
    for one in (disk, size):
        out = out.join(one.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")


