"""Newest-state views: dashboards, saturation and signal rows built from the two newest samples of every series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.fleet import Fleet
from fleetlens.functions import rules
from fleetlens.functions import thresholds as T
from fleetlens.functions.exprs import cpu_total, data_volume, elapsed_seconds, not_future, ratio, usage_pct
from fleetlens.operators.devices import active_disks, active_ifaces
from fleetlens.operators.kernels import latest_one, pair_pivot

HOST, TS = "server_id", "collected_at"
PSI_LIMIT_PCT = 10.0


def recent(df: DataFrame, since: Column, anchor: Column) -> DataFrame:
    """Rows since a bound that are not from a clock running ahead."""
    return df.filter((F.col(TS) >= since) & not_future(TS, anchor))


def step(name: str) -> Column:
    """Newest minus previous value; NULL if the counter fell or either is unknown."""
    d = F.col(f"cur_{name}") - F.col(f"prv_{name}")
    return F.when(d >= 0, d)


def per_second(name: str, unit: float = 1.0) -> Column:
    return F.when(F.col("pair_dt") > 0, step(name) / F.lit(unit) / F.col("pair_dt"))


# --- dashboard ----------------------------------------------------------------------------------------------------

def cpu_snapshot(host_metrics: DataFrame) -> DataFrame:
    """CPU shares between the two newest samples; unknown after a reboot."""
    parts = ["cpu_user_s", "cpu_system_s", "cpu_idle_s", "cpu_iowait_s", "cpu_steal_s", "cpu_nice_s"]
    p = pair_pivot(host_metrics.withColumn("cpu_total_s", cpu_total()), [HOST], TS, [*parts, "cpu_total_s", "boot_time"])
    total = F.col("cur_cpu_total_s") - F.col("prv_cpu_total_s")
    same_boot = ~rules.yes(F.abs(elapsed_seconds(F.col("cur_boot_time"), F.col("prv_boot_time"))) > T.BOOT_TOLERANCE_SECONDS)
    ok = same_boot & (total > 0)

    def pct(c: str) -> Column:
        return F.when(ok, F.when((F.col(f"cur_{c}") - F.col(f"prv_{c}")).isNotNull(), F.greatest(
            F.lit(0.0), (F.col(f"cur_{c}") - F.col(f"prv_{c}")) / total * 100)))

    return p.select(HOST, F.col(f"cur_{TS}").alias(TS), F.greatest(F.lit(0.0), 100 - pct("cpu_idle_s")).alias("_u"),
                    pct("cpu_idle_s").alias("_i"), pct("cpu_user_s").alias("user_pct"), pct("cpu_system_s").alias("system_pct"),
                    pct("cpu_iowait_s").alias("iowait_pct"), pct("cpu_steal_s").alias("steal_pct"),
                    pct("cpu_nice_s").alias("nice_pct")).select(
        HOST, TS, F.when(F.col("_i").isNotNull(), F.col("_u")).alias("usage_pct"), "user_pct", "system_pct", "iowait_pct",
        "steal_pct", "nice_pct")


def mem_snapshot(host_metrics: DataFrame) -> DataFrame:
    """Memory of the newest sample: used and available make 100 %, cached and buffers fill the available part."""
    m = latest_one(host_metrics, [HOST], [F.desc(TS)]).filter(F.col("mem_limit_bytes").isNotNull())
    limit = F.col("mem_limit_bytes")
    m = m.withColumn("used_bytes", F.when(F.col("mem_available_bytes").isNotNull(), F.greatest(
        F.lit(0), limit - F.col("mem_available_bytes"))))
    m = m.withColumn("usage_pct", usage_pct(F.col("used_bytes"), limit))
    room = 100 - F.coalesce("usage_pct", F.lit(0.0))

    def clip(v: Column, left: Column) -> Column:
        return F.when(v.isNotNull(), F.least(F.greatest(F.lit(0.0), left), v))

    m = m.withColumn("cached_pct", clip(usage_pct(F.col("mem_cached_bytes"), limit), room))
    room = room - F.coalesce("cached_pct", F.lit(0.0))
    m = m.withColumn("buffers_pct", clip(usage_pct(F.col("mem_buffered_bytes"), limit), room))
    free = F.greatest(F.lit(0.0), room - F.coalesce("buffers_pct", F.lit(0.0)))
    return m.select(HOST, TS, limit.alias("total_bytes"), "used_bytes", "usage_pct", "cached_pct", "buffers_pct",
                    free.alias("free_pct"))


def core_snapshot(cpu_core: DataFrame) -> DataFrame:
    for c in ("cpu_nice_s", "cpu_iowait_s", "cpu_irq_s", "cpu_softirq_s", "cpu_steal_s"):
        if c not in cpu_core.columns:
            cpu_core = cpu_core.withColumn(c, F.lit(None).cast("double"))
    p = pair_pivot(cpu_core.withColumn("cpu_total_s", cpu_total()), [HOST, "core_id"], TS, ["cpu_total_s", "cpu_idle_s"])
    total = F.col("cur_cpu_total_s") - F.col("prv_cpu_total_s")
    idle = F.greatest(F.lit(0.0), (F.col("cur_cpu_idle_s") - F.col("prv_cpu_idle_s")) / total * 100)
    known = (total > 0) & (F.col("cur_cpu_idle_s") - F.col("prv_cpu_idle_s")).isNotNull()
    use = F.when(known, F.greatest(F.lit(0.0), 100 - idle))
    return p.select(HOST, "core_id", use.alias("usage_pct"), rules.yes(use >= T.CPU_CORE_HOLD_PCT).alias("hot"))


def disk_snapshot(disk_io: DataFrame, inventory: DataFrame) -> DataFrame:
    p = pair_pivot(active_disks(disk_io, inventory), [HOST, "device_id"], TS,
                   ["ops_read", "ops_write", "io_read_bytes", "io_write_bytes"])
    return p.select(HOST, "device_id", per_second("ops_read").alias("read_iops"), per_second("ops_write").alias("write_iops"),
                    per_second("io_read_bytes", 1024.0).alias("read_kbps"), per_second("io_write_bytes", 1024.0).alias("write_kbps"))


def net_snapshot(net_io: DataFrame, inventory: DataFrame) -> DataFrame:
    p = pair_pivot(active_ifaces(net_io, inventory), [HOST, "iface_id"], TS,
                   ["rx_bytes", "tx_bytes", "rx_packets", "tx_packets"])
    return p.select(HOST, "iface_id", per_second("rx_bytes", 1024.0).alias("rx_kbps"), per_second("tx_bytes", 1024.0).alias("tx_kbps"),
                    per_second("rx_packets").alias("rx_pps"), per_second("tx_packets").alias("tx_pps"))


def mount_snapshot(filesystem: DataFrame) -> DataFrame:
    m = latest_one(filesystem, [HOST, "mountpoint"], [F.desc(TS)]).filter(data_volume())
    total = F.col("used_bytes") + F.col("free_bytes")
    return m.select(HOST, "mountpoint", total.alias("total_bytes"), "used_bytes", "free_bytes",
                    usage_pct(F.col("used_bytes"), total).alias("usage_pct"))


def latest_dashboard(fleet: Fleet, since: Column, anchor: Column) -> DataFrame:
    """One row per host: CPU, memory, disk and network activity, hottest core and disk use of the newest samples."""
    def rows(name: str) -> DataFrame:
        return recent(fleet[name], since, anchor)

    cpu, mem = cpu_snapshot(rows("host_metrics")), mem_snapshot(rows("host_metrics")).drop(TS)
    cores = core_snapshot(rows("cpu_core")).groupBy(HOST).agg(F.max("usage_pct").alias("core_max_pct"),
                                                              F.count_if("hot").alias("hot_cores"))
    disk = disk_snapshot(rows("disk_io"), fleet["inventory"]).groupBy(HOST).agg(
        F.sum("read_iops").alias("read_iops"), F.sum("write_iops").alias("write_iops"), F.sum("read_kbps").alias("read_kbps"),
        F.sum("write_kbps").alias("write_kbps"))
    net = net_snapshot(rows("net_io"), fleet["inventory"]).groupBy(HOST).agg(
        F.sum("rx_kbps").alias("rx_kbps"), F.sum("tx_kbps").alias("tx_kbps"))
    fs = mount_snapshot(rows("filesystem")).groupBy(HOST).agg(
        (ratio(F.sum("used_bytes"), F.sum("total_bytes")) * 100).alias("disk_usage_pct"))
    out = cpu.withColumnRenamed("usage_pct", "cpu_pct").join(
        mem.withColumnRenamed("usage_pct", "mem_pct"), HOST, "left")
    for part in (cores, disk, net, fs):
        out = out.join(part, HOST, "left")
    return out


# --- saturation ---------------------------------------------------------------------------------------------------

def latest_saturation(fleet: Fleet, since: Column, anchor: Column) -> DataFrame:
    """Saturation inputs per host from the newest pair of each series."""
    os = fleet["inventory"].select(HOST, "os_family")
    m = pair_pivot(recent(fleet["host_metrics"], since, anchor), [HOST], TS,
                   ["cpu_run_queue", "paging_in", "paging_major", "net_tcp_retransmits", "net_conntrack_usage",
                    "net_conntrack_limit", "cpu_blocked"]).join(os, HOST)
    paging = F.when(F.col("os_family") == "windows", per_second("paging_in")).otherwise(per_second("paging_major"))
    host = m.select(HOST, "os_family", F.col("cur_cpu_run_queue").alias("run_queue"), F.col("cur_cpu_blocked").alias("blocked"),
                    paging.alias("paging_rate"), step("net_tcp_retransmits").alias("retrans"),
                    F.when(F.col("cur_net_conntrack_limit") > 0, ratio(
                        F.col("cur_net_conntrack_usage"), F.col("cur_net_conntrack_limit"))).alias("conntrack_ratio"))
    disk = recent(fleet["disk_io"], since, anchor).select(
        HOST, "device_id", TS, (F.coalesce("op_read_time_s", F.lit(0.0)) + F.coalesce("op_write_time_s", F.lit(0.0))).alias("t"),
        (F.coalesce("ops_read", F.lit(0)) + F.coalesce("ops_write", F.lit(0))).alias("ops"),
        F.coalesce("io_time_s", F.lit(0.0)).alias("io"), "pending_ops")
    d = pair_pivot(active_disks(disk, fleet["inventory"]), [HOST, "device_id"], TS, ["t", "ops", "io", "pending_ops"])
    d = d.withColumns({x: F.col(f"cur_{x}") - F.col(f"prv_{x}") for x in ("t", "ops", "io")})
    sound = (F.col("ops") > 0) & (F.col("pair_dt") > 0) & (F.col("io") >= 0) & (F.col("io") <= F.col("pair_dt"))
    slow = sound & (F.col("t") >= 0) & (F.col("io") / F.col("pair_dt") >= T.DISK_BUSY_MIN)
    dd = d.groupBy(HOST).agg(
        F.max(F.when(slow, F.col("t") / F.col("ops") * 1000)).alias("await_ms"),
        F.max(F.when(sound, F.col("io") / F.col("pair_dt") * 100)).alias("disk_util_pct"),
        F.max(F.when(sound, F.col("cur_pending_ops"))).alias("pending_ops"))
    cols = ["tx_packets", "rx_packets", "rx_dropped", "tx_dropped"]
    n = pair_pivot(recent(fleet["net_io"], since, anchor), [HOST, "iface_id"], TS, cols)

    def summed(which: str, *names: str) -> Column:
        """Sum over interfaces of one side of the pairs; an interface without that side adds nothing."""
        v = F.coalesce(f"{which}_{names[0]}", F.lit(0))
        for x in names[1:]:
            v = v + F.coalesce(f"{which}_{x}", F.lit(0))
        return F.sum(F.when(F.col(f"{which}_{TS}").isNotNull(), v))

    nn = n.groupBy(HOST).agg(
        (summed("cur", "tx_packets", "rx_packets") - summed("prv", "tx_packets", "rx_packets")).alias("pkt"),
        (summed("cur", "tx_packets") - summed("prv", "tx_packets")).alias("txp"),
        (summed("cur", "rx_dropped", "tx_dropped") - summed("prv", "rx_dropped", "tx_dropped")).alias("drop"))
    p = pair_pivot(recent(fleet["pressure"].filter(F.col("scope") == "some"), since, anchor), [HOST, "resource"], TS,
                   ["stall_time_s"]).withColumn("rate", per_second("stall_time_s") * 100)
    psi = p.groupBy(HOST).agg(*[F.max(F.when(F.col("resource") == r, F.col("rate"))).alias(f"psi_{a}")
                                for a, r in (("cpu", "cpu"), ("mem", "memory"), ("io", "io"))])
    out = host.join(dd, HOST, "left").join(nn, HOST, "left").join(psi, HOST, "left")
    return out.select(HOST, "os_family", "run_queue", "blocked", "await_ms", "disk_util_pct", "pending_ops", "paging_rate",
                      F.when((F.col("txp") > 0) & (F.col("retrans") >= 0), F.col("retrans") / F.col("txp") * 100).alias("retrans_pct"),
                      F.when((F.col("pkt") > 0) & (F.col("drop") >= 0), F.col("drop") / F.col("pkt") * 100).alias("drop_pct"),
                      "conntrack_ratio", "psi_cpu", "psi_mem", "psi_io")


def psi_supported(kernel: str = "kernel_version") -> Column:
    """Pressure figures exist from kernel 4.20 on; NULL if the version cannot be read."""
    major = F.regexp_extract(kernel, r"^(\d+)\.(\d+)", 1).try_cast("int")
    minor = F.regexp_extract(kernel, r"^(\d+)\.(\d+)", 2).try_cast("int")
    return F.when(major.isNotNull(), (major > 4) | ((major == 4) & (minor >= 20)))


def saturation_signals(saturation: DataFrame, inventory: DataFrame, steal: DataFrame) -> DataFrame:
    """Signal rows ``(host, axis, key, state, value, threshold, saturated)`` on the four axes."""
    s = saturation.join(inventory.select(HOST, "kernel_version", "cpu_cores"), HOST).join(steal, HOST, "left")
    win = rules.windows()

    def row(axis: str, key: str, value: Column, limit: Column, over: Column, absent: Column | None = None) -> Column:
        gone = F.lit(False) if absent is None else absent
        known = value.isNotNull() & ~gone
        return F.struct(F.lit(axis).alias("axis"), F.lit(key).alias("key"),
                        F.when(gone, "not_applicable").when(known, "measured").otherwise("no_data").alias("state"),
                        F.when(known, value).alias("value"), F.when(~gone, limit).alias("threshold"),
                        F.when(known, over).alias("saturated"))

    c, lit = F.col, F.lit
    queue = c("run_queue") / F.when(c("cpu_cores") != 0, c("cpu_cores"))
    no_psi = win | ~F.coalesce(psi_supported(), lit(True))
    use_queue = win & c("await_ms").isNull()
    wait = F.coalesce(c("await_ms"), F.when(win, c("pending_ops")))
    wait_limit = F.when(use_queue, T.DISK_QUEUE_WINDOWS).otherwise(T.AWAIT_MS)

    def psi(axis: str, name: str) -> Column:
        return row(axis, f"{axis}_psi", c(f"psi_{name}"), lit(PSI_LIMIT_PCT), c(f"psi_{name}") >= PSI_LIMIT_PCT, no_psi)

    rows = F.array(
        row("cpu", "cpu_run_queue", queue, rules.queue_line(), queue / rules.queue_line() >= 1.0),
        row("cpu", "cpu_steal", c("steal_pct"), lit(T.CPU_STEAL_BIAS_PCT), c("steal_pct") >= T.CPU_STEAL_BIAS_PCT, win),
        psi("cpu", "cpu"),
        row("cpu", "cpu_blocked", c("blocked"), lit(T.BLOCKED_HIGH), c("blocked") >= T.BLOCKED_HIGH, win),
        row("mem", "mem_paging", c("paging_rate"), F.when(win, T.WINDOWS_PAGES_IN_PER_S).otherwise(0.0), rules.paging_active()),
        psi("mem", "mem"),
        row("disk", "disk_await", wait, wait_limit, wait / wait_limit >= 1.0), psi("disk", "io"),
        row("net", "net_retrans", c("retrans_pct"), lit(T.RETRANS_PCT), c("retrans_pct") >= T.RETRANS_PCT),
        row("net", "net_drop", c("drop_pct"), lit(T.DROP_PCT), c("drop_pct") >= T.DROP_PCT),
        row("net", "net_conntrack", c("conntrack_ratio"), lit(T.CONNTRACK_RATIO), c("conntrack_ratio") >= T.CONNTRACK_RATIO, win))
    return s.select(HOST, F.inline(rows))


def saturation_index(saturation: DataFrame, inventory: DataFrame, net_rate: DataFrame) -> DataFrame:
    """Normalised CPU / disk index (1.0 is the limit), paging and network flags per host."""
    s = saturation.join(inventory.select(HOST, "cpu_cores"), HOST).join(net_rate, HOST, "left")
    return s.select(HOST, rules.cpu_saturation_index().alias("cpu_sat_index"), rules.disk_saturation_index().alias("disk_sat_index"),
                    rules.paging_active().alias("mem_pressure"), rules.net_signal_active().alias("net_congested"),
                    "paging_rate", "disk_util_pct", "net_kbps")


def environment_load(fleet: Fleet, since: Column, anchor: Column, fresh_since: Column) -> DataFrame:
    """Load rows of the hosts whose newest sample is fresh."""
    dash = latest_dashboard(fleet, since, anchor).filter(F.col(TS) >= fresh_since)
    net = dash.select(HOST, (F.coalesce("rx_kbps", F.lit(0.0)) + F.coalesce("tx_kbps", F.lit(0.0))).alias("net_kbps"))
    index = saturation_index(latest_saturation(fleet, since, anchor), fleet["inventory"], net)
    return dash.select(HOST, TS, "cpu_pct", "mem_pct", "used_bytes", "total_bytes").join(index, HOST, "left").join(
        fleet["inventory"].select(HOST, "hostname", "os_family", "cpu_cores"), HOST)


def environment_realtime(load: DataFrame) -> DataFrame:
    """One fleet row: capacity weighted CPU and memory, and how many hosts cross each signal."""
    has_cpu = F.col("cpu_pct").isNotNull() & (F.col("cpu_cores") > 0)
    has_mem = F.col("used_bytes").isNotNull() & (F.col("total_bytes") > 0)
    return load.agg(
        F.count("*").alias("online"),
        (F.sum(F.when(has_cpu, F.col("cpu_pct") * F.col("cpu_cores"))) / F.sum(F.when(has_cpu, F.col("cpu_cores")))).alias("cpu_pct"),
        (F.sum(F.when(has_mem, F.col("used_bytes"))) / F.sum(F.when(has_mem, F.col("total_bytes"))) * 100).alias("mem_pct"),
        F.count_if(F.col("cpu_sat_index") >= 1.0).alias("cpu_saturated"), F.count_if(F.col("disk_sat_index") >= 1.0).alias("disk_saturated"),
        F.count_if("mem_pressure").alias("mem_pressure"), F.count_if("net_congested").alias("net_congested"),
        F.max(TS).alias("last_collected_at"))
