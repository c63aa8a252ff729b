"""Fleet views: right-sizing, assessment, overview, attention, report rows, lists and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import rules
from fleetlens.functions import thresholds as T
from fleetlens.functions.exprs import bytes_to_gb, shift
from fleetlens.operators.inventory import os_label, primary_ip
from fleetlens.operators.kernels import latest_n, running_offset

HOST = "server_id"
CAUSES = ["cpu_util", "cpu_saturation", "mem_util", "mem_saturation", "disk_capacity", "disk_io"]
RISK = {"under_provisioned": "high", "idle": "attention", "over_provisioned": "attention", "optimal": "normal",
        "insufficient_data": "normal"}
RISK_ORDER = {"high": 0, "attention": 1, "normal": 2}


def _map(d: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[key]


# --- liveness -----------------------------------------------------------------------------------------------------

def online(anchor: Column, ttl: int = T.ONLINE_SECONDS) -> Column:
    return rules.yes(F.col("last_seen_at") > shift(anchor, -ttl))


def metric_gaps(host_metrics: DataFrame, inventory: DataFrame, anchor: Column, gap_minutes: int = 5,
                recent_hours: int = 24) -> DataFrame:
    """Hosts that reported within the recent hours but not within the gap, oldest first."""
    floor = shift(anchor, -recent_hours * 3600)
    last = host_metrics.filter(F.col("collected_at") >= floor).groupBy(HOST).agg(F.max("collected_at").alias("last_metric_at"))
    gone = last.filter((F.col("last_metric_at") < shift(anchor, -gap_minutes * 60))
                       & (F.col("last_metric_at") > shift(anchor, -recent_hours * 3600)))
    return gone.join(inventory.select(HOST, "public_id", "hostname"), HOST)


def collection_status(host_metrics: DataFrame, history: DataFrame, inventory: DataFrame) -> DataFrame:
    m = host_metrics.groupBy(HOST).agg(F.max("collected_at").alias("last_metric_at"))
    h = history.groupBy(HOST).agg(F.max("collected_at").alias("last_inventory_at"))
    return inventory.select(HOST).join(m, HOST, "left").join(h, HOST, "left")


def fleet_status(inventory: DataFrame, host_metrics: DataFrame, anchor: Column) -> DataFrame:
    i = inventory.agg(F.count("*").alias("total_count"), F.count_if(online(anchor)).alias("online_count"))
    m = host_metrics.agg(F.max("collected_at").alias("last_collected_at"))
    return i.withColumn("_k", F.lit(1)).join(m.withColumn("_k", F.lit(1)), "_k").drop("_k")


def duplicate_hostnames(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("hostname").agg(F.count("*").alias("hosts")).filter(F.col("hosts") > 1)


# --- right-sizing -------------------------------------------------------------------------------------------------

def actions() -> Column:
    """Action list of a host: every short resource grows, spare CPU / memory shrinks where allowed, a slow disk moves
    up a tier."""
    def act(res: str, op: str, target: Column) -> Column:
        return F.struct(F.lit(res).alias("resource"), F.lit(op).alias("op"), target.cast("bigint").alias("target"))

    cls = F.col("classification")
    under, over = cls == "under_provisioned", cls == "over_provisioned"
    none = F.lit(None)
    return F.array_compact(F.array(
        F.when(under & (F.col("mem_status") == "under"), act("memory", "increase", F.col("mem_target"))),
        F.when(under & (F.col("cpu_status") == "under"), act("cpu", "increase", F.col("cpu_target"))),
        F.when(under & (F.col("disk_status") == "filling"), act("disk_capacity", "increase", F.col("disk_target"))),
        F.when(over & F.col("cpu_downsize"), act("cpu", "decrease", F.col("cpu_target"))),
        F.when(over & F.col("mem_downsize"), act("memory", "decrease", F.col("mem_target"))),
        F.when(F.col("io_status") == "io_bound", act("disk_io", "tier_up", none))))


def right_sizing_rows(assessed: DataFrame, anchor: Column) -> DataFrame:
    """One row per host: classification, root cause, action kind and actions."""
    dup = duplicate_hostnames(assessed).select("hostname", F.lit(True).alias("_dup"))
    kind = _map({"under_provisioned": "provision", "over_provisioned": "downsize", "idle": "decommission",
                 "insufficient_data": "insufficient", "optimal": "maintain"}, F.col("classification"))
    return assessed.join(dup, "hostname", "left").select(
        HOST, "public_id", "hostname", F.coalesce("_dup", F.lit(False)).alias("hostname_ambiguous"), primary_ip().alias("primary_ip"),
        "os_family", online(anchor).alias("online"), "classification", "root_cause", "symptoms", kind.alias("kind"),
        actions().alias("actions"), "cpu_status", "mem_status", "disk_status", "io_status", "net_status", "network_congested")


def axis_size(prefix: str, current: Column) -> Column:
    """(recommended, action, quality) of CPU or memory; recommended falls back to the current size."""
    st, target, floor = F.col(f"{prefix}_status"), F.col(f"{prefix}_target"), F.col(f"{prefix}_floor")

    def out(rec: Column, action: str, quality: str) -> Column:
        return F.struct(rec.cast("bigint").alias("recommended"), F.lit(action).alias("action"), F.lit(quality).alias("estimate_quality"))

    return (F.when((st == "under") & target.isNotNull(), out(target, "increase", "exact"))
            .when((st == "under") & floor.isNotNull(), out(floor, "increase", "floor"))
            .when(st.isin("under", "unmeasured"), out(current, "keep", "uncertain"))
            .when((st == "over") & F.col(f"{prefix}_downsize") & target.isNotNull(), out(target, "decrease", "exact"))
            .otherwise(out(current, "keep", "exact")))


def sizing_axes(assessed: DataFrame, mounts: DataFrame) -> DataFrame:
    """Long rows: one CPU and one memory axis per host with a known size, one disk axis per sized mount."""
    a = assessed.withColumns({"_c": axis_size("cpu", F.col("cpu_cores")), "_m": axis_size("mem", F.col("mem_total_mb"))})
    cpu = a.filter(F.col("cpu_cores").isNotNull()).select(
        HOST, F.lit("cpu").alias("axis"), F.lit(None).cast("string").alias("mountpoint"), F.col("cpu_cores").cast("bigint").alias("current"), "_c.*")
    mem = a.filter(F.col("mem_total_mb").isNotNull()).select(
        HOST, F.lit("memory").alias("axis"), F.lit(None).cast("string").alias("mountpoint"), F.col("mem_total_mb").cast("bigint").alias("current"), "_m.*")
    disk = rules.assess_mount(mounts).select(
        HOST, F.lit("disk").alias("axis"), "mountpoint", F.col("current_gib").alias("current"),
        F.col("recommended_gib").alias("recommended"), "action", "estimate_quality")
    return cpu.unionByName(mem).unionByName(disk)


def confidence() -> Column:
    doubt = F.lit(False)
    for p in ("cpu", "mem", "disk", "io", "net"):
        doubt = doubt | F.col(f"{p}_low_precision") | F.col(f"{p}_gap")
    doubt = doubt | F.col("cpu_biased") | F.col("cpu_nonstationary")
    return F.when(F.col("classification") == "insufficient_data", "low").when(doubt, "medium").otherwise("high")


def assessment_rows(assessed: DataFrame, mounts: DataFrame, anchor: Column) -> DataFrame:
    """One nested document per host: identity, sizing axes, assessment and diagnostics.

    Axes are collected per host: two plus its mounts."""
    axes = sizing_axes(assessed, mounts).groupBy(HOST).agg(F.sort_array(F.collect_list(F.struct(
        "axis", "mountpoint", "current", "recommended", "action", "estimate_quality"))).alias("axes"))
    a = assessed.join(axes, HOST, "left")
    return a.select(
        HOST, F.struct("public_id", "hostname", primary_ip().alias("primary_ip"), online(anchor).alias("online")).alias("identity"),
        F.struct("os_family", "os_id", "os_version", "kernel_version", "arch", "block_devices", "net_interfaces", "lvm_vgs").alias("reproduction"),
        F.struct("axes").alias("sizing"),
        F.struct("classification", confidence().alias("confidence")).alias("assessment"),
        F.struct(F.when(F.col("root_cause") == "disk_capacity", "disk").otherwise(F.col("root_cause")).alias("root_cause"),
                 F.when(F.col("io_status") == "io_bound", "high_iops").alias("disk_io_tier_hint"), "network_congested").alias("diagnostics"))


def export_documents(rows: DataFrame, window_days: int, generated_at: Column) -> DataFrame:
    """One JSON document per host with the envelope fields; NULL keys are left out."""
    return rows.select(HOST, F.to_json(F.struct(
        F.lit("assessment").alias("kind"), F.lit(window_days).alias("window_days"), generated_at.alias("generated_at"),
        *[c for c in rows.columns if c != HOST])).alias("document"))


# --- action targets -----------------------------------------------------------------------------------------------

def active_causes() -> Column:
    return F.array_intersect(F.array(*[F.lit(x) for x in CAUSES]), F.col("triggers"))


def action_targets(assessed: DataFrame) -> DataFrame:
    """Severity per host: paging first, then the number of causes, then the highest utilisation; hosts that waste
    score by how little they use. ``place`` follows class, severity and name."""
    peak = F.coalesce(F.greatest("cpu_p95", "mem_p95", "disk_used_pct"), F.lit(0.0))
    cls = F.col("classification")
    a = assessed.withColumns({"causes": active_causes(), "class_rank": rules.class_rank(cls)})
    paging = F.when(F.array_contains("triggers", "mem_saturation"), 10000.0).otherwise(0.0)
    score = F.when(cls == "under_provisioned", paging + F.size("causes") * 100.0 + peak).otherwise(100.0 - peak)
    return a.withColumn("severity", score)


def target_order() -> list[Column]:
    return [F.asc("class_rank"), F.desc("severity"), F.asc("hostname")]


def efficiency_totals(targets: DataFrame) -> DataFrame:
    waste = F.col("classification").isin("over_provisioned", "idle")
    disk = F.expr("aggregate(filter(coalesce(block_devices, array()), d -> d.type = 'disk'), 0L, (x, d) -> x + coalesce(d.size_bytes, 0L))")
    return targets.agg(
        F.count("*").alias("total"), F.count_if(F.col("classification") == "under_provisioned").alias("under_count"),
        F.count_if(waste).alias("efficiency_count"), F.sum(F.when(waste, F.col("cpu_cores"))).alias("efficiency_vcpus"),
        F.sum(F.when(waste, F.col("mem_total_bytes"))).alias("efficiency_mem_bytes"), F.sum(F.when(waste, disk)).alias("efficiency_disk_bytes"))


def top_under(targets: DataFrame, n: int = 3) -> DataFrame:
    return targets.filter(F.col("classification") == "under_provisioned").orderBy(F.desc("severity"), F.asc("hostname")).limit(n)


def cause_counts(targets: DataFrame) -> DataFrame:
    under = targets.filter(F.col("classification") == "under_provisioned")
    return under.select(F.explode("causes").alias("cause")).groupBy("cause").agg(F.count("*").alias("hosts"))


# --- counts and distributions -------------------------------------------------------------------------------------

def classification_counts(assessed: DataFrame) -> DataFrame:
    """All five classes, also empty ones, with their share in percent."""
    frame = assessed.sparkSession.createDataFrame([(c, r) for c, r in rules.CLASS_ORDER.items()], "classification string, class_rank int")
    n = assessed.groupBy("classification").agg(F.count("*").alias("n"))
    j = frame.join(n, "classification", "left").select("classification", "class_rank", F.coalesce("n", F.lit(0)).alias("hosts"))
    total = F.sum("hosts").over(Window.partitionBy(F.lit(1)))  # five rows
    return j.withColumn("share_pct", F.when(total > 0, F.col("hosts") / total * 100).otherwise(0.0))


def share_offsets(counts: DataFrame) -> DataFrame:
    """Start of each class segment on a 100 % ring."""
    return running_offset(counts, [F.asc("class_rank")], "share_pct")


def distribution(df: DataFrame, category: str) -> DataFrame:
    """Count per category and its size relative to the largest."""
    n = df.groupBy(category).agg(F.count("*").alias("hosts"))
    top = n.agg(F.max("hosts").alias("_top")).withColumn("_k", F.lit(1))
    return n.withColumn("_k", F.lit(1)).join(top, "_k").select(category, "hosts", (F.col("hosts") / F.col("_top") * 100).alias("pct_of_max"))


def os_counts(inventory: DataFrame) -> DataFrame:
    """Hosts by family, distribution and version with the kernels seen."""
    kernels = inventory.filter(F.col("kernel_version").isNotNull()).select("os_family", "os_id", "os_version", "kernel_version").distinct() \
        .groupBy("os_family", "os_id", "os_version").agg(F.array_join(F.sort_array(F.collect_list("kernel_version")), ",").alias("kernels"))
    n = inventory.groupBy("os_family", "os_id", "os_version").agg(F.count("*").alias("hosts"))
    return n.join(kernels, ["os_family", "os_id", "os_version"], "left")


def report_totals(assessed: DataFrame) -> DataFrame:
    disk = F.expr("aggregate(filter(coalesce(block_devices, array()), d -> d.type = 'disk'), 0L, (x, d) -> x + coalesce(d.size_bytes, 0L))")
    return assessed.agg(F.sum("cpu_cores").alias("cores"), F.sum("mem_total_bytes").alias("mem_bytes"), F.sum(disk).alias("disk_bytes"))


# --- attention ----------------------------------------------------------------------------------------------------

def attention_signals(gaps: DataFrame, support: DataFrame, restarts: DataFrame, inventory: DataFrame,
                      restart_limit: int = T.FREQUENT_RESTARTS) -> DataFrame:
    """Rows ``(host, kind, detail)``: reporting gaps, systems without free patches, frequent agent restarts."""
    inv = inventory.select(HOST, "hostname")
    gap = gaps.select(HOST, F.lit("gap").alias("kind"), F.col("last_metric_at").cast("string").alias("detail"))
    eol = support.filter(F.col("support").isin("paid_only", "ended")).select(
        HOST, F.lit("os_eol").alias("kind"), F.col("eol").cast("string").alias("detail"))
    restart = restarts.filter(F.col("restart_count") >= restart_limit).select(
        HOST, F.lit("restart").alias("kind"), F.col("restart_count").cast("string").alias("detail"))
    return gap.unionByName(eol).unionByName(restart).join(inv, HOST)


def attention_hosts(signals: DataFrame) -> DataFrame:
    """One row per host with a column per kind and the number of active signals."""
    kinds = ["gap", "os_eol", "restart"]
    cols = [F.max(F.when(F.col("kind") == k, F.col("detail"))).alias(k) for k in kinds]
    active = sum((F.col(k).isNotNull().cast("int") for k in kinds[1:]), F.col(kinds[0]).isNotNull().cast("int"))
    return signals.groupBy(HOST, "hostname").agg(*cols).withColumn("active_count", active)


def attention_limit(signals: DataFrame, n: int) -> DataFrame:
    """The first ``n`` signals of each kind, by host name."""
    return latest_n(signals, ["kind"], [F.asc("hostname"), F.asc(HOST)], n, "_rn").drop("_rn")


def attention_of(signals: DataFrame, hosts: DataFrame) -> DataFrame:
    return signals.join(hosts.select("hostname").distinct(), "hostname", "left_semi")


# --- report rows --------------------------------------------------------------------------------------------------

def diagnosis() -> Column:
    """The most urgent finding of a host, as a key."""
    c, has = F.col, lambda t: F.array_contains("triggers", t)
    mem, cpu = c("mem_status") == "under", c("cpu_status") == "under"
    burst = (rules.yes(c("cpu_variance") >= T.VARIANCE_RATIO) & rules.yes(c("cpu_peak") > T.BURST_PEAK_CPU_PCT)) | (
        rules.yes(c("mem_variance") >= T.VARIANCE_RATIO) & rules.yes(c("mem_peak") > T.BURST_PEAK_MEM_PCT))
    return (F.when(mem & (has("mem_saturation") | has("mem_oom")), "memory_shortage")
            .when(c("io_status") == "io_bound", "disk_io_bottleneck").when(cpu & has("cpu_saturation"), "cpu_saturation")
            .when(mem & has("mem_util"), "memory_pressure").when(cpu & has("cpu_util"), "cpu_pressure")
            .when(c("disk_status") == "filling", "disk_filling").when(c("network_congested"), "network_congested")
            .when(burst, "bursty").when(c("host_status") == "idle", "idle").when(c("host_status") == "over", "spare")
            .otherwise("normal"))


def insufficient_reason() -> Column:
    missing = F.array_compact(F.array(*[F.when(F.col(x).isNull(), F.lit(x)) for x in (
        "cpu_p95", "mem_p95", "run_queue_p95", "await_p95_ms", "disk_used_pct")]))
    return F.when(~F.col("online"), "offline").when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ",")))\
        .otherwise("too_few_samples")


def report_rows(assessed: DataFrame, anchor: Column) -> DataFrame:
    """Report form of the assessed hosts: risk level, variance, uptime and the diagnosis (or why there is none)."""
    a = assessed.withColumns({
        "online": online(anchor), "risk_level": _map(RISK, F.col("classification")),
        "cpu_variance": F.when((F.col("cpu_p95") > 0) & (F.col("cpu_peak") != 0), F.col("cpu_peak") / F.col("cpu_p95")),
        "mem_variance": F.when((F.col("mem_p95") > 0) & (F.col("mem_peak") != 0), F.col("mem_peak") / F.col("mem_p95")),
        "uptime_days": F.greatest(F.lit(0), F.floor((F.unix_timestamp(anchor) - F.unix_timestamp("boot_time")) / 86400)),
        "os_label": os_label(), "primary_ip": primary_ip()})
    return a.withColumns({
        "risk_rank": _map(RISK_ORDER, F.col("risk_level")),
        "diagnosis": F.when(F.col("classification") == "insufficient_data", insufficient_reason()).otherwise(diagnosis())})


def report_order() -> list[Column]:
    return [F.asc("risk_rank"), F.desc(F.coalesce("cpu_p95", F.lit(0.0))), F.asc("hostname")]


def top_risks(rows: DataFrame, view: str, limit: int | None = None) -> DataFrame:
    """Customer view: high risk only. Engineer view: all by risk. CPU p95 breaks ties."""
    cpu = F.desc(F.coalesce("cpu_p95", F.lit(0.0)))
    if view == "customer":
        return rows.filter(F.col("risk_level") == "high").orderBy(cpu, F.asc("hostname"))
    out = rows.orderBy(F.asc("risk_rank"), cpu, F.asc("hostname"))
    return out if limit is None else out.limit(limit)


def capacity_imminent(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("runway_days") < T.RUNWAY_DAYS) & F.col("driving_mount").isNotNull()).select(
        HOST, "hostname", "driving_mount", F.floor("runway_days").alias("days_until_full"), "disk_used_pct").orderBy("days_until_full", "hostname")


def report_kpis(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("total"), F.count_if("online").alias("online"),
        *[F.count_if(F.col("risk_level") == r).alias(f"{r}_count") for r in RISK_ORDER],
        F.avg("cpu_p95").alias("avg_cpu_p95"), F.avg("mem_p95").alias("avg_mem_p95"))


def burst_hosts(rows: DataFrame) -> DataFrame:
    """Hosts whose peak is far above their p95 and high enough to matter."""
    return rows.filter((rules.yes(F.col("cpu_variance") >= T.VARIANCE_RATIO) & rules.yes(F.col("cpu_peak") > T.BURST_PEAK_CPU_PCT)))


def reboot_hosts(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("reboot_count") >= T.FREQUENT_RESTARTS)


def busiest_role(rows: DataFrame, roles: DataFrame, limit_pct: float = 70.0) -> DataFrame:
    """Role with the highest mean CPU p95, if it reaches the limit."""
    m = rows.join(roles, HOST).filter(F.col("cpu_p95").isNotNull()).groupBy("role").agg(F.avg("cpu_p95").alias("avg_cpu_p95"))
    return m.orderBy(F.desc("avg_cpu_p95"), F.asc("role")).limit(1).filter(F.col("avg_cpu_p95") >= limit_pct)


def period_assessment(assessed: DataFrame) -> DataFrame:
    """Utilisation and saturation rows per resource with value, threshold and an over flag."""
    c = F.col

    def row(res: str, kind: str, key: str, value: Column, limit: Column, over: Column) -> Column:
        return F.struct(F.lit(res).alias("resource"), F.lit(kind).alias("kind"), F.lit(key).alias("key"), value.cast("double").alias("value"),
                        limit.cast("double").alias("threshold"), rules.yes(over).alias("over"), value.isNotNull().alias("measured"))

    lit = F.lit
    queue = c("run_queue_p95") / F.when(c("cpu_cores") > 0, c("cpu_cores"))
    rows = F.array(
        row("cpu", "utilization", "cpu_p95", c("cpu_p95"), lit(T.CPU_UNDER_PCT), c("cpu_p95") >= T.CPU_UNDER_PCT),
        row("memory", "utilization", "mem_p95", c("mem_p95"), lit(T.MEM_UNDER_PCT), c("mem_p95") >= T.MEM_UNDER_PCT),
        row("storage", "utilization", "disk_used_pct", c("disk_used_pct"), lit(T.STATIC_GUARD_PCT), c("disk_used_pct") >= T.STATIC_GUARD_PCT),
        row("cpu", "saturation", "run_queue", queue, rules.queue_line(), queue >= rules.queue_line()),
        row("storage", "saturation", "await_ms", c("await_p95_ms"), lit(T.AWAIT_MS), c("await_p95_ms") > T.AWAIT_MS),
        row("network", "saturation", "retrans_pct", c("retrans_pct"), lit(T.RETRANS_PCT), c("retrans_pct") >= T.RETRANS_PCT),
        row("network", "saturation", "drop_pct", c("drop_pct"), lit(T.DROP_PCT), c("drop_pct") >= T.DROP_PCT),
        row("network", "saturation", "conntrack_ratio", c("conntrack_ratio"), lit(T.CONNTRACK_RATIO), c("conntrack_ratio") >= T.CONNTRACK_RATIO))
    return assessed.select(HOST, F.inline(rows))


def environment_overview(assessed: DataFrame, utilization: DataFrame, support_counts: DataFrame, anchor: Column) -> DataFrame:
    """One fleet row: totals, utilisation, class and saturation counts, support counts."""
    c = F.col
    a = assessed.agg(
        F.count("*").alias("hosts"), F.count_if(online(anchor)).alias("online"), F.sum("cpu_cores").alias("cores"),
        F.sum("mem_total_bytes").alias("mem_bytes"),
        *[F.count_if(c("classification") == k).alias(k) for k in rules.CLASS_ORDER],
        F.count_if(rules.yes(c("cpu_sat"))).alias("cpu_saturated"), F.count_if(rules.yes(c("mem_sat"))).alias("mem_saturated"),
        F.count_if(c("io_status") == "io_bound").alias("disk_saturated"), F.count_if(c("network_congested")).alias("net_congested"))
    s = support_counts.agg(*[F.coalesce(F.sum(F.when(c("support").isin(*v), c("hosts"))), F.lit(0)).alias(k) for k, v in (
        ("eol_passed", ["paid_only", "ended"]), ("eol_security_only", ["security_only"]), ("eol_unknown", ["unknown"]), ("eol_supported", ["full"]))])
    out = a.withColumn("_k", F.lit(1))
    for one in (utilization, s):
        out = out.join(one.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")


def server_list(assessed: DataFrame, support: DataFrame, error_hosts: DataFrame, latest_tasks: DataFrame, anchor: Column) -> DataFrame:
    """List rows: class, support stage, operational events and the last task of every host."""
    return (assessed.select(HOST, "public_id", "hostname", "os_family", os_label().alias("os_label"), "cpu_cores",
                            bytes_to_gb(F.col("mem_total_bytes")).alias("mem_gb"), online(anchor).alias("online"), "classification")
            .join(support.select(HOST, "support"), HOST, "left")
            .join(error_hosts.select(HOST, F.lit(True).alias("_e")), HOST, "left")
            .join(latest_tasks.select(HOST, F.col("status").alias("last_task_status")), HOST, "left")
            .withColumn("has_event", F.coalesce("_e", F.lit(False))).drop("_e"))


def list_filter(rows: DataFrame, online_only: bool | None = None, classification: str | None = None, support: str | None = None,
                os_family: str | None = None) -> DataFrame:
    """Optional filters of the list; ``support`` may be ``passed`` for both stages without free patches."""
    if online_only is not None:
        rows = rows.filter(F.col("online") == online_only)
    if classification is not None:
        rows = rows.filter(F.col("classification") == classification)
    if support is not None:
        stages = ["paid_only", "ended"] if support == "passed" else [support]
        rows = rows.filter(F.col("support").isin(stages))
    if os_family is not None:
        rows = rows.filter(F.col("os_family") == os_family)
    return rows


def list_order() -> list[Column]:
    return [F.desc("online"), F.lower("hostname"), F.asc(HOST)]
