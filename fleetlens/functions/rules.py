"""Right-sizing rules as columns: status, triggers, sizing and confidence per resource, and the host summary.

``assess_host`` adds every column to a statistics DataFrame (see ``resource_stats``); each resource also has its own
function. NULL inputs mean "not measured" throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import thresholds as T

# Order in which hosts are listed, and in which short resources are prescribed.
CLASS_ORDER = {"under_provisioned": 0, "over_provisioned": 1, "idle": 2, "optimal": 3, "insufficient_data": 4}
STATUS_CLASS = {"under": "under_provisioned", "idle": "idle", "over": "over_provisioned", "optimal": "optimal",
                "insufficient": "insufficient_data"}
RESOURCES = ("cpu", "memory", "disk_capacity", "disk_io", "network")

STAT_TYPES = {
    "os_family": "string", "cpu_cores": "int", "cpu_p95": "double", "cpu_peak": "double", "mem_p95": "double",
    "mem_near_peak": "double", "disk_used_pct": "double", "net_kbps": "double", "sufficiency": "double",
    "run_queue_p95": "double", "pages_in_p95": "double", "percore_p95_max": "double", "blocked_p95": "double",
    "oom_occurred": "boolean", "swap_paging": "boolean", "mem_total_mb": "bigint", "await_p95_ms": "double",
    "disk_queue_p95": "double", "disk_iops": "bigint", "runway_days": "double", "inode_runway_days": "double",
    "inode_used_pct": "double", "target_gb": "double", "retrans_pct": "double", "drop_pct": "double",
    "conntrack_ratio": "double", "history_hours": "double", "burst_ratio": "double", "trend_rising": "boolean",
    "steal_p95": "double",
}


def c(name: str) -> Column:
    return F.col(name)


def yes(cond: Column) -> Column:
    """NULL counts as no."""
    return F.coalesce(cond, F.lit(False))


def nothing(kind: str) -> Column:
    return F.lit(None).cast(kind)


def windows() -> Column:
    return yes(c("os_family") == "windows")


def labels(*pairs: tuple[Column, str]) -> Column:
    """Array of the labels whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(yes(cond), F.lit(name)) for cond, name in pairs]))


# --- rule input ---------------------------------------------------------------------------------------------------

def trend_rising(cpu_slope: str = "cpu_slope", mem_slope: str = "mem_slope") -> Column:
    """Utilisation rises by the daily limit on either axis; NULL without any slope or with too little history."""
    known = c(cpu_slope).isNotNull() | c(mem_slope).isNotNull()
    up = yes(c(cpu_slope) >= T.RISING_PCT_PER_DAY) | yes(c(mem_slope) >= T.RISING_PCT_PER_DAY)
    return F.when(known & (c("history_hours") >= T.CONFIDENCE_HOURS), up)


def resource_stats(report: DataFrame, with_disk_activity: bool = False) -> DataFrame:
    """Report row -> rule input. Disk activity joins the idle rule only where the caller asks for it."""
    have = set(report.columns)
    net = F.when(c("net_rx_kbps").isNotNull() | c("net_tx_kbps").isNotNull(),
                 F.coalesce("net_rx_kbps", F.lit(0.0)) + F.coalesce("net_tx_kbps", F.lit(0.0)))
    enough = F.least(F.when(c("cpu_p95").isNotNull(), c("cpu_sufficiency")),
                     F.when(c("mem_p95").isNotNull(), c("mem_sufficiency")))
    return report.withColumns({
        "net_kbps": net if {"net_rx_kbps", "net_tx_kbps"} <= have else nothing("double"),
        "sufficiency": enough, "trend_rising": trend_rising(),
        "mem_total_mb": F.floor(c("mem_total_bytes") / F.lit(1048576)),
        "disk_queue_p95": nothing("double"),
        "disk_iops": c("disk_iops") if with_disk_activity else nothing("bigint")})


def require_stats(df: DataFrame) -> DataFrame:
    """Adds missing rule inputs as NULL."""
    missing = {n: nothing(t) for n, t in STAT_TYPES.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


# --- saturation ---------------------------------------------------------------------------------------------------

def queue_line() -> Column:
    return F.when(windows(), T.RUN_QUEUE_PER_CORE_WINDOWS).otherwise(T.RUN_QUEUE_PER_CORE_LINUX)


def cpu_saturated() -> Column:
    """Run queue per core at the limit of the OS, and utilisation high where it is known."""
    per_core = c("run_queue_p95") / F.when(c("cpu_cores") > 0, c("cpu_cores"))
    return F.when(per_core < queue_line(), False).when(
        per_core.isNotNull(), F.coalesce(c("cpu_p95") >= T.CPU_UNDER_PCT, F.lit(True)))


def mem_saturated() -> Column:
    """High utilisation and paging together."""
    paging = F.when(windows(), c("pages_in_p95") >= T.WINDOWS_PAGES_IN_PER_S).otherwise(yes(c("swap_paging")))
    return F.when(c("mem_p95") < T.MEM_UNDER_PCT, False).when(c("mem_p95").isNotNull(), paging)


def disk_io_saturated() -> Column:
    return F.when(c("await_p95_ms").isNotNull(), c("await_p95_ms") > T.AWAIT_MS).when(
        windows(), c("disk_queue_p95") >= T.DISK_QUEUE_WINDOWS)


def cpu_saturation_index(queue: str = "run_queue", cores: str = "cpu_cores") -> Column:
    return c(queue) / F.when(c(cores) != 0, c(cores)) / queue_line()


def disk_saturation_index(await_ms: str = "await_ms", queue: str = "pending_ops") -> Column:
    return F.coalesce(c(await_ms) / T.AWAIT_MS, F.when(windows(), c(queue) / T.DISK_QUEUE_WINDOWS))


def paging_active(rate: str = "paging_rate") -> Column:
    return yes(F.when(windows(), c(rate) >= T.WINDOWS_PAGES_IN_PER_S).otherwise(c(rate) > 0))


def net_signal_active(retrans: str = "retrans_pct", drop: str = "drop_pct", track: str = "conntrack_ratio",
                      kbps: str = "net_kbps") -> Column:
    loud = ~yes(c(kbps) < T.MIN_TRAFFIC_KBPS)
    return (loud & (yes(c(retrans) > T.RETRANS_PCT) | yes(c(drop) > T.DROP_PCT))) | yes(c(track) >= T.CONNTRACK_RATIO)


# --- resources ----------------------------------------------------------------------------------------------------

def low_precision() -> Column:
    return yes(c("history_hours") < T.CONFIDENCE_HOURS) | yes(c("burst_ratio") > T.BURST_RATIO)


def assess_cpu(df: DataFrame) -> DataFrame:
    df = df.withColumn("cpu_sat", cpu_saturated())
    need = F.greatest(
        F.lit(1).cast("bigint"),
        F.when(yes(c("cpu_p95") > 0), F.ceil(c("cpu_p95") * c("cpu_cores") / T.CPU_TARGET_PCT)).otherwise(1),
        F.when(yes(c("cpu_sat")) & yes(c("run_queue_p95") > 0),
               F.ceil(c("run_queue_p95") / (queue_line() * T.CPU_QUEUE_HEADROOM))))
    df = df.withColumn("cpu_need", F.when(c("cpu_cores") > 0, need))
    df = df.withColumn("cpu_triggers", labels((c("cpu_p95") >= T.CPU_UNDER_PCT, "cpu_util"), (c("cpu_sat"), "cpu_saturation")))
    blind = (c("cpu_p95").isNull() & ~yes(c("cpu_sat"))) | ~yes(c("cpu_cores") > 0)
    short = (F.size("cpu_triggers") > 0) | (c("cpu_need") > c("cpu_cores"))
    spare = (c("cpu_need") < c("cpu_cores")) & ~yes(c("percore_p95_max") >= T.CPU_CORE_HOLD_PCT)
    df = df.withColumn("cpu_status", F.when(blind, "unmeasured").when(short, "under").when(spare, "over").otherwise("optimal"))
    under, over, fine = (c("cpu_status") == s for s in ("under", "over", "optimal"))
    return df.withColumns({
        "cpu_triggers": F.when(under, c("cpu_triggers")).otherwise(F.array().cast("array<string>")),
        "cpu_target": F.when(under & (c("cpu_need") > c("cpu_cores")), c("cpu_need")).when(over, c("cpu_need"))
        .when(fine, c("cpu_cores").cast("bigint")),
        "cpu_floor": F.when(under & (c("cpu_need") <= c("cpu_cores")), c("cpu_cores").cast("bigint") + 1),
        "cpu_gap": c("cpu_sat").isNull() | c("cpu_p95").isNull(),
        "cpu_biased": yes(c("steal_p95") >= T.CPU_STEAL_BIAS_PCT),
        "cpu_low_precision": low_precision(), "cpu_nonstationary": yes(c("trend_rising")),
    }).drop("cpu_need")


def assess_memory(df: DataFrame) -> DataFrame:
    total = c("mem_total_mb")
    raised = F.ceil(total * (1 + T.MEM_HEADROOM_PCT / 100))
    df = df.withColumn("mem_sat", mem_saturated())
    peak = F.coalesce("mem_near_peak", "mem_p95")
    df = df.withColumn("mem_need", F.when(peak > 0, F.ceil(total * peak / T.MEM_TARGET_PCT)))
    oom = yes(c("oom_occurred"))
    df = df.withColumn("mem_triggers", F.when(
        c("mem_p95").isNull(), labels((oom, "mem_oom"))).otherwise(
        labels((c("mem_p95") >= T.MEM_UNDER_PCT, "mem_util"), (c("mem_sat"), "mem_saturation"), (oom, "mem_oom"))))
    df = df.withColumn("mem_status", F.when(F.size("mem_triggers") > 0, "under")
                       .when(c("mem_p95").isNull(), "unmeasured")
                       .when(yes((total > 0) & (c("mem_need") > 0) & (c("mem_need") < total)), "over").otherwise("optimal"))
    wanted = F.greatest(c("mem_need"), F.when(yes(c("mem_sat")) | oom, raised))
    grown = F.when(c("mem_p95").isNotNull() & (total.isNull() | (wanted > total)), wanted)
    under = c("mem_status") == "under"
    return df.withColumns({
        "mem_target": F.when(under, grown).when(c("mem_status") == "over", c("mem_need"))
        .when(c("mem_status") == "optimal", total),
        "mem_floor": F.when(under & grown.isNull(), raised),
        "mem_gap": c("mem_status") == "unmeasured", "mem_biased": F.lit(False),
        "mem_low_precision": low_precision(), "mem_nonstationary": yes(c("trend_rising")),
    }).drop("mem_need")


def assess_disk_capacity(df: DataFrame) -> DataFrame:
    first = F.least("runway_days", "inode_runway_days")
    target = F.when(c("target_gb") >= 1, F.ceil("target_gb"))
    near = yes(first < T.RUNWAY_DAYS)
    bytes_full = c("runway_days").isNull() & yes(c("disk_used_pct") >= T.STATIC_GUARD_PCT)
    inodes_full = c("inode_runway_days").isNull() & yes(c("inode_used_pct") >= T.STATIC_GUARD_PCT)
    known = F.coalesce(first, c("disk_used_pct"), c("inode_used_pct")).isNotNull()
    df = df.withColumns({
        "disk_status": F.when(near | bytes_full | inodes_full, "filling").when(known, "capacity_ok").otherwise("unmeasured"),
        "disk_target": F.when(near, F.when(first == c("runway_days"), target)).when(bytes_full, target)})
    return df.withColumns({
        "disk_triggers": labels((c("disk_status") == "filling", "disk_capacity")),
        "disk_gap": c("disk_status") == "unmeasured", "disk_low_precision": low_precision()})


def assess_disk_io(df: DataFrame) -> DataFrame:
    sat = disk_io_saturated()
    return df.withColumn("io_status", F.when(sat, "io_bound").when(~sat, "io_ok")
                         .when(c("disk_iops").isNotNull(), "io_ok").otherwise("unmeasured")).withColumns({
                             "io_triggers": labels((c("io_status") == "io_bound", "disk_io")),
                             "io_gap": c("io_status") == "unmeasured", "io_biased": F.lit(True),
                             "io_low_precision": low_precision()})


def assess_network(df: DataFrame) -> DataFrame:
    loud = ~yes(c("net_kbps") < T.MIN_TRAFFIC_KBPS)
    df = df.withColumn("net_triggers", labels(
        (loud & (c("retrans_pct") > T.RETRANS_PCT), "net_retrans"), (loud & (c("drop_pct") > T.DROP_PCT), "net_drop"),
        (c("conntrack_ratio") >= T.CONNTRACK_RATIO, "net_conntrack")))
    known = F.coalesce("retrans_pct", "drop_pct", "conntrack_ratio").isNotNull()
    df = df.withColumn("net_status", F.when(F.size("net_triggers") > 0, "congested").when(known, "quality_ok")
                       .otherwise("unmeasured"))
    return df.withColumns({"net_gap": c("net_status") == "unmeasured", "net_low_precision": low_precision()})


# --- host ---------------------------------------------------------------------------------------------------------

def rollup_host(df: DataFrame) -> DataFrame:
    """Host status, root cause and its symptoms from the five resource assessments."""
    cpu, mem, disk, io = c("cpu_status"), c("mem_status"), c("disk_status"), c("io_status")
    cpu_short, mem_short, io_bound = cpu == "under", mem == "under", io == "io_bound"
    short = cpu_short | mem_short | (disk == "filling")
    quiet = (yes(c("cpu_p95") <= T.IDLE_CPU_P95_PCT) & yes(c("net_kbps") * 8 / 1000 <= T.IDLE_NET_MBPS)
             & ~yes(c("disk_iops") > T.IDLE_DISK_IOPS))
    chain = mem_short & yes(c("mem_sat")) & (io_bound | cpu_short)
    blocked = io_bound & cpu_short & yes(c("blocked_p95") >= T.BLOCKED_HIGH)
    return df.withColumns({
        "host_status": F.when(short, "under").when((cpu == "unmeasured") & (mem == "unmeasured"), "insufficient")
        .when(quiet, "idle").when((cpu == "over") | (mem == "over"), "over").otherwise("optimal"),
        "root_cause": F.when(chain, "memory").when(blocked, "disk_io").when(mem_short, "memory").when(cpu_short, "cpu")
        .when(disk == "filling", "disk_capacity"),
        "symptoms": F.when(chain, labels((io_bound, "disk_io"), (cpu_short, "cpu")))
        .when(blocked, labels((cpu_short, "cpu"))).otherwise(F.array().cast("array<string>")),
        "network_congested": c("net_status") == "congested",
        "under_kinds": labels((mem_short, "memory"), (cpu_short, "cpu"), (disk == "filling", "disk_capacity")),
        "saturation_unmeasured": c("cpu_gap") | c("mem_gap") | c("io_gap"),
        "triggers": F.concat("cpu_triggers", "mem_triggers", "disk_triggers", "io_triggers", "net_triggers"),
    })


def host_class(status: Column | None = None) -> Column:
    s = c("host_status") if status is None else status
    return F.create_map(*[F.lit(x) for kv in STATUS_CLASS.items() for x in kv])[s]


def class_rank(cls: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in CLASS_ORDER.items() for x in kv])[cls]


def downsize_allowed(prefix: str) -> Column:
    """An "over" verdict may be acted on only if it is precise, complete, unbiased, stationary and well observed."""
    doubt = c(f"{prefix}_low_precision") | c(f"{prefix}_gap") | c(f"{prefix}_biased") | c(f"{prefix}_nonstationary")
    return (c(f"{prefix}_status") == "over") & ~doubt & yes(c("sufficiency") >= T.MIN_SUFFICIENCY)


def strong_idle() -> Column:
    return yes(c("cpu_peak") <= T.STRONG_IDLE_PEAK_PCT) & yes(c("net_kbps") <= T.STRONG_IDLE_NET_KBPS)


def assess_host(stats: DataFrame) -> DataFrame:
    """All rule columns for every row, in one projection chain without a shuffle."""
    df = require_stats(stats)
    for step in (assess_cpu, assess_memory, assess_disk_capacity, assess_disk_io, assess_network, rollup_host):
        df = step(df)
    return df.withColumns({"classification": host_class(), "cpu_downsize": downsize_allowed("cpu"),
                           "mem_downsize": downsize_allowed("mem")})


def resource_rows(assessed: DataFrame, *keys: str) -> DataFrame:
    """One row per host and resource."""
    def row(kind, prefix, target, floor):
        return F.struct(F.lit(kind).alias("resource"), c(f"{prefix}_status").alias("status"),
                        c(f"{prefix}_triggers").alias("triggers"), target.cast("bigint").alias("target"),
                        floor.cast("bigint").alias("floor"), c(f"{prefix}_gap").alias("coverage_gap"),
                        c(f"{prefix}_low_precision").alias("low_precision"))

    none = nothing("bigint")
    rows = F.array(row("cpu", "cpu", c("cpu_target"), c("cpu_floor")), row("memory", "mem", c("mem_target"), c("mem_floor")),
                   row("disk_capacity", "disk", c("disk_target"), none), row("disk_io", "io", none, none),
                   row("network", "net", none, none))
    return assessed.select(*keys, F.inline(rows))


def assess_mount(mounts: DataFrame) -> DataFrame:
    """Per-mount size in GiB: grow or keep, never shrink. Rows without a known size are left out."""
    gib = F.lit(float(1 << 30))
    now = F.ceil(c("total_bytes") / gib)
    full = yes(c("byte_runway_days") < T.RUNWAY_DAYS) | (
        c("byte_runway_days").isNull() & yes(c("used_pct") >= T.STATIC_GUARD_PCT))
    inode_full = yes(c("inode_runway_days") < T.RUNWAY_DAYS) | (
        c("inode_runway_days").isNull() & yes(c("inode_used_pct") >= T.STATIC_GUARD_PCT))
    exact = full & c("target_bytes").isNotNull()
    sized = F.greatest(now, F.ceil(c("target_bytes") / gib))
    floor = F.greatest(now, F.ceil(now / F.lit(T.HEADROOM_PCT / 100)))
    out = mounts.filter(c("total_bytes") > 0).withColumns({
        "current_gib": now, "recommended_gib": F.when(exact, sized).when(full, floor).otherwise(now)})
    return out.withColumns({
        "action": F.when(exact & (c("recommended_gib") > now), "increase").when(full & ~exact, "increase").otherwise("keep"),
        "estimate_quality": F.when(full & ~exact, "floor").otherwise("exact"),
        "inode_note": ~full & inode_full})
