"""Wire messages to tables: parsing, validation, duplicates, upserts and history.

A message is one JSON text in the column ``value``. Everything about one message is worked out inside its row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import schemas as X
from fleetlens.functions import thresholds as T
from fleetlens.functions.exprs import elapsed_seconds
from fleetlens.operators.kernels import latest_one, with_previous
from fleetlens.sources import layout as L

CONTRACT_MAJOR = "1"
UUID = r"^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"
AWARE = r"(Z|z|[+-]\d{2}:?\d{2})$"
TYPES = list(X.BY_TYPE)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Message files, one JSON text per line."""
    return spark.read.text(path)


# --- validation ---------------------------------------------------------------------------------------------------

def same_major(version: Column, major: str = CONTRACT_MAJOR) -> Column:
    return F.coalesce(F.split_part(version, F.lit("."), F.lit(1)) == major, F.lit(False))


def version_gate(messages: DataFrame, major: str = CONTRACT_MAJOR) -> DataFrame:
    """Messages of the contract's major version."""
    return messages.filter(same_major(F.get_json_object("value", "$.schema_version"), major))


def _field(name: str) -> Column:
    """One top-level field as text, for the routing filter."""
    return F.get_json_object("value", f"$.{name}")


CHECKED = ("schema_version", "message_type", "message_id", "agent_id", "collected_at", "boot_time", "agent_started_at", "os_family",
           "machine_id", "composite_id", "agent_version", "hostname", "cpu_cores", "mem_total_bytes", "ip_external", "task_id", "status",
           "error_code", "failed_component")


def check_messages(messages: DataFrame, major: str = CONTRACT_MAJOR) -> DataFrame:
    """Adds ``problems``: the names of the violated rules, empty for a good message."""
    return _examined(messages, major).drop("_m", "_keys")


def _examined(messages: DataFrame, major: str) -> DataFrame:
    """Adds ``problems`` and what they were found in: the text is parsed once into ``_m``, with the checked fields and the
    nested inventory blocks as text and the metric namespaces typed, and its keys into ``_keys``."""
    shape = ", ".join(f"{n} string" for n in CHECKED) + ", " + ", ".join(f"`{x}` {X.NAMESPACE}" for x in X.NAMESPACES) + f", {', '.join(f'{n} string' for n in L.FLAT)}, bits string, {L.block_shapes()}, _broken string"
    parsed = messages.withColumns({
        "_m": F.from_json("value", shape, {"columnNameOfCorruptRecord": "_broken"}), "_keys": F.json_object_keys("value")})
    e = {n: F.col(f"_m.{n}") for n in CHECKED}
    kind = e["message_type"]

    def no(v: Column) -> Column:
        return F.coalesce(v, F.lit(False))

    def long(name: str, most: int, least: int = 0, needed: bool = False) -> Column:
        n = F.length(e[name])
        ok = (n <= most) & (n >= least)
        return ~no(ok) if needed else no(~ok)

    def aware(name: str, required: bool) -> Column:
        good = no(e[name].rlike(AWARE) & F.try_to_timestamp(e[name]).isNotNull())
        return good if required else e[name].isNull() | good

    def bad_count(name: str, kind: str) -> Column:
        """Present, but no whole number from 0 up."""
        return e[name].isNotNull() & ~no(e[name].try_cast(kind) >= 0)

    entry = "array<struct<type:string,unit:string,points:" + X.POINTS + ">>"
    metric = F.flatten(F.array(*[F.coalesce(F.map_values(F.col("_m")[x]), F.array().cast(entry)) for x in X.NAMESPACES]))
    bad_metric = F.exists(metric, lambda m: ~no(m["type"].isin("counter", "gauge")) | no(F.length(m["unit"]) > 32))
    missing_ns = F.size(F.array_except(F.array(*[F.lit(x) for x in X.REQUIRED_NAMESPACES]), F.col("_keys"))) > 0
    ips = F.from_json(e["ip_external"], "array<string>")
    bad_ip = F.exists(ips, lambda a: ~no(F.split_part(a, F.lit("/"), F.lit(1)).rlike(L.ADDRESS_FORM)))
    is_inv, is_task, is_err, is_met = (no(kind == k) for k in ("inventory", "task.result", "error", "metrics"))
    rules = [
        ("not_json", F.col("_keys").isNull()),
        ("message_type", ~no(kind.isin(TYPES))), ("schema_version", ~no(e["schema_version"].rlike(r"^\d+\.\d+$"))),
        ("major_version", ~same_major(e["schema_version"], major)), ("message_id", ~no(e["message_id"].rlike(UUID))),
        ("agent_id", ~is_task & ~no(e["agent_id"].rlike(UUID))),
        ("collected_at", ~aware("collected_at", True)), ("boot_time", ~aware("boot_time", False)),
        ("agent_started_at", ~aware("agent_started_at", False)), ("os_family", ~no(e["os_family"].isin("linux", "windows"))),
        ("machine_id", long("machine_id", 64)), ("composite_id", long("composite_id", 64)), ("agent_version", long("agent_version", 32, 1)),
        ("hostname", (is_inv | is_task) & long("hostname", 255, 1, True)),
        ("namespaces", is_met & no(missing_ns)), ("metric", is_met & no(bad_metric)),
        ("cpu_cores", is_inv & bad_count("cpu_cores", "int")), ("mem_total_bytes", is_inv & bad_count("mem_total_bytes", "bigint")),
        ("ip_external", is_inv & no(bad_ip)), ("bits", is_inv & L.fails(F.col("_m.bits"), "count")),
        *[(n, is_inv & L.fails(F.col(f"_m.{n}"), "text", most)) for n, most in L.FLAT.items()],
        *[(n, is_inv & bad) for n, bad in L.block_problems(F.col("_m"), F.col("_keys"), F.col("value"))],
        ("task_id", is_task & long("task_id", 128, 1, True)), ("status", is_task & long("status", 32, 1, True)),
        ("error_code", is_err & long("error_code", 64, 1, True)), ("failed_component", is_err & long("failed_component", 32, 1, True)),
    ]
    return parsed.withColumn("problems", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules])))


def split_valid(messages: DataFrame, major: str = CONTRACT_MAJOR) -> tuple[DataFrame, DataFrame]:
    """(good messages, quarantined messages with their problems)."""
    checked = check_messages(messages, major)
    return checked.filter(F.size("problems") == 0).drop("problems"), checked.filter(F.size("problems") > 0)


def of_type(messages: DataFrame, kind: str) -> DataFrame:
    """Typed rows of one message kind; unknown fields are ignored, empty composite ids become NULL."""
    return _typed(messages.filter(_field("message_type") == kind).select(F.from_json("value", X.BY_TYPE[kind]).alias("m")).select("m.*"))


def parse_any(messages: DataFrame) -> DataFrame:
    """Typed rows of all kinds of messages, each text parsed once; ``kind_of`` takes the rows of one kind out of it."""
    return messages.select(F.from_json("value", X.ANY).alias("m")).select("m.*")


def sorted_out(messages: DataFrame, major: str = CONTRACT_MAJOR) -> DataFrame:
    """One row per message, to be written: bad messages with ``problems``, good ones without; metrics as typed columns
    (taken from the check's parse, for ``kind_of``) in place of their text; all others as text. ``_row`` numbers the rows."""
    bad = F.size("problems") > 0
    metrics = ~bad & (F.col("_m.message_type") == "metrics")
    typed = [F.when(metrics, F.col("_m")[n]).alias(n) for n in X.names(X.METRICS)]
    return _examined(messages, major).select(
        F.when(~metrics, F.col("value")).alias("value"), F.when(bad, F.col("problems")).alias("problems"), *typed, F.monotonically_increasing_id().alias("_row"))


def kind_of(parsed: DataFrame, kind: str) -> DataFrame:
    return _typed(parsed.filter(F.col("message_type") == kind).select(*[f"`{n}`" for n in X.names(X.BY_TYPE[kind])]))


def _typed(rows: DataFrame) -> DataFrame:
    times = [c for c in ("collected_at", "boot_time", "agent_started_at", "completed_at", "first_failed_at", "recovered_at") if c in rows.columns]
    return rows.withColumns({**{c: F.try_to_timestamp(c) for c in times}, "composite_id": F.nullif("composite_id", F.lit(""))})


# --- metrics ------------------------------------------------------------------------------------------------------

def points(ns: str, metric: str) -> str:
    """Points of a metric, an empty array if the namespace or metric is absent."""
    return f"coalesce(`system.{ns}`['{metric}'].points, cast(array() as {X.POINTS}))"


def match(pts: str, **attrs: str | None) -> str:
    """Value of the first point with all attributes; ``None`` wants the key to be absent. Values are SQL."""
    cond = " and ".join(f"p.attr['{k}'] is null" if v is None else f"coalesce(p.attr['{k}'] = {v}, false)" for k, v in attrs.items())
    return f"get(filter({pts}, p -> {cond}), 0).value"


def scalar(ns: str, metric: str) -> str:
    return f"get({points(ns, metric)}, 0).value"


def whole(expr: str, kind: str = "bigint") -> str:
    return f"cast({expr} as {kind})"


def state_sum(state: str) -> str:
    """Sum of the measured values of a CPU state over all cores; NULL if none is measured."""
    return (f"aggregate({points('cpu', 'cpu.time')}, cast(null as double), (a, p) -> "
            f"if(p.attr['state'] = '{state}' and p.value is not null, coalesce(a, 0D) + p.value, a))")


def distinct_attr(key: str, *pts: str) -> str:
    return f"array_distinct(filter(flatten(array({', '.join(f'transform({p}, x -> x.attr[{chr(39)}{key}{chr(39)}])' for p in pts)})), v -> v is not null))"


STATES = ("user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal")


def parse_host(metrics: DataFrame) -> DataFrame:
    """One host row per metrics message."""
    mem, pag = points("memory", "memory.usage"), points("paging", "paging.operations")
    q = "'{}'".format
    cols = {f"cpu_{s}_s": state_sum(s) for s in STATES} | {
        "cpu_logical_count": whole(scalar("cpu", "cpu.logical.count"), "int"), "cpu_run_queue": scalar("cpu", "cpu.run_queue"),
        "cpu_blocked": scalar("cpu", "cpu.blocked"), "cpu_mce": whole(scalar("cpu", "cpu.mce"))} | {
        f"mem_{s}_bytes": whole(match(mem, state=q(s))) for s in ("free", "cached", "buffered", "available", "used")} | {
        "mem_limit_bytes": whole(scalar("memory", "memory.limit")), "mem_commit_usage_bytes": whole(scalar("memory", "memory.commit.usage")),
        "mem_commit_limit_bytes": whole(scalar("memory", "memory.commit.limit")),
        "mem_hardware_corrupted_bytes": whole(scalar("memory", "memory.hardware_corrupted")), "mem_oom_kill": whole(scalar("memory", "memory.oom_kill")),
        "paging_in": whole(match(pag, direction=q("in"), type=None)), "paging_out": whole(match(pag, direction=q("out"), type=None)),
        "paging_major": whole(match(pag, direction=q("in"), type=q("major"))),
        "net_tcp_retransmits": whole(scalar("network", "network.tcp.retransmits")),
        "net_conntrack_usage": whole(scalar("network", "network.conntrack.usage"), "int"),
        "net_conntrack_limit": whole(scalar("network", "network.conntrack.limit"), "int")}
    return metrics.selectExpr("agent_id", "collected_at", "boot_time", "agent_started_at", *[f"{e} as {n}" for n, e in cols.items()])


def _children(metrics: DataFrame, keys: str, name: str, cols: dict[str, str]) -> DataFrame:
    ns = [f"`{n}`" for n in X.NAMESPACES]
    rows = metrics.selectExpr("agent_id", "collected_at", *ns, f"explode({keys}) as {name}")
    return rows.selectExpr("agent_id", "collected_at", name, *[f"{e} as {n}" for n, e in cols.items()])


def _directed(pts: str, dim: str, names: dict[str, str]) -> dict[str, str]:
    return {out: whole(match(pts, device=dim, direction=f"'{d}'")) for out, d in names.items()}


def parse_disk_io(metrics: DataFrame) -> DataFrame:
    io, ops, busy, took, queue = (points("disk", m) for m in ("disk.io", "disk.operations", "disk.io_time", "disk.operation_time", "disk.pending_operations"))
    d = "device_id"
    cols = _directed(io, d, {"io_read_bytes": "read", "io_write_bytes": "write"}) | _directed(ops, d, {"ops_read": "read", "ops_write": "write"}) | {
        "io_time_s": match(busy, device=d), "op_read_time_s": match(took, device=d, direction="'read'"),
        "op_write_time_s": match(took, device=d, direction="'write'"), "pending_ops": match(queue, device=d)}
    return _children(metrics, distinct_attr("device", io, ops, busy, took, queue), d, cols)


def parse_net_io(metrics: DataFrame) -> DataFrame:
    io, pk, er, dr, sp = (points("network", m) for m in ("network.io", "network.packets", "network.errors", "network.dropped", "network.link.speed"))
    d = "iface_id"
    cols: dict[str, str] = {}
    for pts, what in ((io, "bytes"), (pk, "packets"), (er, "errors"), (dr, "dropped")):
        cols |= _directed(pts, d, {f"rx_{what}": "receive", f"tx_{what}": "transmit"})
    cols["link_speed_bps"] = whole(match(sp, device=d))
    return _children(metrics, distinct_attr("device", io, pk, er, dr, sp), d, cols)


def parse_filesystem(metrics: DataFrame) -> DataFrame:
    use, ino = points("filesystem", "filesystem.usage"), points("filesystem", "filesystem.inodes.usage")
    m = "mountpoint"

    def first_attr(key: str, *pts: str) -> str:
        return f"get(filter(transform(filter(concat({', '.join(pts)}), p -> p.attr['mountpoint'] = mountpoint), p -> p.attr['{key}']), v -> v is not null), 0)"

    cols = {"device_id": first_attr("device", use, ino), "fstype": first_attr("type", use)}
    for pts, pre, post in ((use, "", "_bytes"), (ino, "inodes_", "")):
        for s in ("used", "free"):
            cols[f"{pre}{s}{post}"] = whole(match(pts, mountpoint=m, state=f"'{s}'"))
    return _children(metrics, distinct_attr("mountpoint", use, ino), m, cols)


def parse_cpu_core(metrics: DataFrame) -> DataFrame:
    t = points("cpu", "cpu.time")
    keys = f"filter({distinct_attr('cpu', t)}, c -> c rlike '^[0-9]+$')"
    rows = _children(metrics, keys, "cpu", {f"cpu_{s}_s": match(t, cpu="cpu", state=f"'{s}'") for s in STATES})
    return rows.withColumn("core_id", F.col("cpu").cast("int")).drop("cpu")


def parse_pressure(metrics: DataFrame) -> DataFrame:
    ratio, time = points("pressure", "pressure.stall.ratio"), points("pressure", "pressure.stall.time")
    pairs = (f"array_distinct(filter(transform(concat({ratio}, {time}), p -> named_struct('r', p.attr['resource'], 's', p.attr['scope'])), "
             "k -> k.r is not null and k.s is not null))")
    key = {"resource": "k.r", "scope": "k.s"}
    cols = {"resource": "k.r", "scope": "k.s", "stall_time_s": match(time, **key)} | {
        f"ratio_avg{w}": match(ratio, **key, window=f"'{w}'") for w in (10, 60, 300)}
    return _children(metrics, pairs, "k", cols).drop("k")


def parse_disk_error(metrics: DataFrame) -> DataFrame:
    rows = metrics.selectExpr("agent_id", "collected_at", f"explode({points('disk', 'disk.errors')}) as p")
    return rows.filter("p.attr['kind'] is not null").selectExpr(
        "agent_id", "collected_at", "coalesce(p.attr['device'], '') as device_id", "p.attr['kind'] as error_kind",
        "coalesce(p.attr['class'], '') as error_class", "coalesce(p.attr['member'], '') as member", "cast(p.value as bigint) as error_count")


PARSERS = {"host_metrics": parse_host, "disk_io": parse_disk_io, "net_io": parse_net_io, "filesystem": parse_filesystem,
           "cpu_core": parse_cpu_core, "pressure": parse_pressure, "disk_error": parse_disk_error}


def parse_metrics(messages: DataFrame) -> dict[str, DataFrame]:
    """Metrics messages to the host table and its six child tables."""
    rows = of_type(messages, "metrics")
    return {name: parse(rows) for name, parse in PARSERS.items()}


def parse_inventory(messages: DataFrame) -> DataFrame:
    return of_type(messages, "inventory")


def agent_errors(messages: DataFrame) -> DataFrame:
    """Error messages as a log table, one row per message id."""
    return dedupe(of_type(messages, "error"))


def sparse_json(columns: Sequence[str]) -> Column:
    """Nested facts as JSON text without NULL keys."""
    return F.to_json(F.struct(*columns))


# --- duplicates and upserts ---------------------------------------------------------------------------------------

def dedupe(messages: DataFrame, key: str = "message_id", ts: str = "collected_at") -> DataFrame:
    """First occurrence of every message id (map-side limited before the shuffle)."""
    return latest_one(messages, [key], [F.asc(ts)])


def first_rows(messages: DataFrame, key: str = "message_id", ts: str = "collected_at") -> DataFrame:
    """The rows that ``dedupe`` would keep of a written table numbered by ``_row``, as bitmaps of 32,768 numbers: ``(bucket, bits)``.

    Only ids, times and numbers are shuffled, reduced before the shuffle.
    """
    kept = messages.groupBy(key).agg(F.min_by("_row", F.try_to_timestamp(ts)).alias("_row"))
    return kept.groupBy(F.bitmap_bucket_number("_row").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_row")).alias("bits"))


def with_rows(messages: DataFrame, kept: DataFrame, most: int = 4096) -> DataFrame:
    """Messages whose number is in the written bitmaps ``kept``. These are one bit a message; beyond ``most`` of them (4 KB each)
    they are not sent to all tasks, but the messages are shuffled by them."""
    few = kept.count() <= most
    position = F.bitmap_bit_position("_row")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(_place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    found = messages.withColumns({"bucket": F.bitmap_bucket_number("_row"), "_place": position}).join(F.broadcast(kept) if few else kept.hint("merge"), "bucket")
    return found.where(F.getbit(byte, (F.col("_place") % 8).cast("int")) == 1).drop("bucket", "bits", "_place")


def insert_if_absent(new: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose natural key is not stored, one per key."""
    return new.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")


def insert_counts(inserts: dict[str, DataFrame]) -> DataFrame:
    """Inserted rows per table."""
    out = None
    for name, df in inserts.items():
        one = df.agg(F.count("*").alias("inserted")).select(F.lit(name).alias("table_name"), "inserted")
        out = one if out is None else out.unionByName(one)
    return out


def upsert_latest(stored: DataFrame, updates: DataFrame, key: str, ts: str) -> DataFrame:
    """Stored rows and updates merged, last write wins."""
    tagged = stored.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest_one(tagged, [key], [F.desc(ts), F.desc("_new")]).drop("_new")


def register_placeholders(samples: DataFrame, inventory: DataFrame, key: str = "agent_id") -> DataFrame:
    """Inventory plus a stub for every agent that only sent samples; known agents are never overwritten."""
    seen = samples.groupBy(key).agg(F.max("collected_at").alias("last_seen_at"))
    stubs = seen.join(inventory.select(key), key, "left_anti").select(
        key, F.col(key).alias("hostname"), "last_seen_at", F.lit(True).alias("placeholder"))
    return inventory.withColumn("placeholder", F.lit(False)).unionByName(stubs, allowMissingColumns=True)


def append_on_change(rows: DataFrame, key: str, ts: str, tracked: Sequence[str], boot: str = "boot_time") -> DataFrame:
    """Rows where any tracked column differs from the previous row of the key (or that have none).

    The tracked columns are compared through one digest, so only a short text is carried along; boot times may move by
    the tolerance, and unknown against known counts as a change.
    """
    digest = F.sha2(F.to_json(F.struct(*[c for c in tracked if c in rows.columns and c != boot])), 256)
    prev = with_previous(rows.withColumn("_digest", digest), [key], ts, ["_digest", boot])
    moved = (F.col(boot).isNull() != F.col(f"prev_{boot}").isNull()) | F.coalesce(
        F.abs(elapsed_seconds(F.col(boot), F.col(f"prev_{boot}"))) > T.BOOT_TOLERANCE_SECONDS, F.lit(False))
    first = F.col("prev__digest").isNull()
    return prev.filter(first | (F.col("_digest") != F.col("prev__digest")) | moved).select(*rows.columns)
