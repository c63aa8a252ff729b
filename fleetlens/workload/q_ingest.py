"""Messages built from the bound tables and read back, and the streaming operators over the event files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens import schemas as X
from fleetlens.operators import rollups as R
from fleetlens.sources import ingest as G
from fleetlens.streaming import streams as W
from fleetlens.streaming.epochs import passing_shuffles
from fleetlens.streaming.ingest_stream import IngestStream
from fleetlens.workload.q_trends import END
from fleetlens.workload.registry import Context, library, query
from fleetlens.functions.exprs import timestamp

KEY = ["server_id", "collected_at"]


def point(value, **attr):
    pairs = [x for k, v in attr.items() for x in (F.lit(k), v if not isinstance(v, str) else F.lit(v))]
    a = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(a.cast("map<string,string>").alias("attr"), value.cast("double").alias("value"))


def metric(points, kind="counter"):
    return F.struct(F.lit(kind).alias("type"), F.lit("1").alias("unit"), points.alias("points"))


def namespace(**metrics):
    return F.create_map(*[x for k, v in metrics.items() for x in (F.lit(k.replace("__", ".")), v)])


def envelope(df: DataFrame, kind: str, keep: tuple[str, ...] = (), deal: bool = True, **ns) -> DataFrame:
    """Rows to JSON messages; ids and times follow from host and time. ``deal`` shuffles the rows first, for tables of few tasks."""
    c = F.col
    uid = F.md5(F.concat_ws("|", F.lit(kind), *[c(k).cast("string") for k in KEY]))
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    if deal:
        df = df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *KEY)  # building text is the costly part
    return df.select(*keep, F.to_json(F.struct(
        F.lit("1.2").alias("schema_version"), F.lit(kind).alias("message_type"), uid.alias("message_id"),
        F.md5(c("server_id").cast("string")).alias("agent_id"), F.date_format("collected_at", iso).alias("collected_at"),
        F.when(c("server_id") % 3 == 0, "windows").otherwise("linux").alias("os_family"), *[v.alias(k) for k, v in ns.items()])).alias("value"))


AGENT = "md5(cast(server_id as varchar)) as agent_id"
C = F.col


def host_messages(c: Context, deal: bool = True) -> DataFrame:
    states = [point(C(f"cpu_{s}_s"), state=s, cpu="0") for s in G.STATES] + [point(C("cpu_user_s"), state="user", cpu="1")]
    mem = [point(C(f"mem_{s}_bytes"), state=s) for s in ("available", "used", "cached", "buffered")]
    pag = [point(C("paging_major"), direction="in", type="major"), point(C("paging_in"), direction="in"), point(C("paging_out"), direction="out")]
    return envelope(c["host_metrics"], "metrics", deal=deal, **{
        "system.cpu": namespace(cpu__time=metric(F.array(*states)), cpu__run_queue=metric(F.array(point(C("cpu_run_queue"))), "gauge")),
        "system.memory": namespace(memory__usage=metric(F.array(*mem), "gauge"), memory__limit=metric(F.array(point(C("mem_limit_bytes"))), "gauge")),
        "system.disk": F.lit(None).cast("string"), "system.network": namespace(network__tcp__retransmits=metric(F.array(point(C("net_tcp_retransmits"))))),
        "system.paging": namespace(paging__operations=metric(F.array(*pag)))})


def grouped(df: DataFrame, **points) -> DataFrame:
    """All points of one host and time (a handful of dimensions)."""
    return df.groupBy(*KEY).agg(*[F.flatten(F.collect_list(F.array(*p))).alias(n) for n, p in points.items()])


def disk_messages(c: Context, deal: bool = True) -> DataFrame:
    d = C("device_id")
    g = grouped(c["disk_io"], io=[point(C("io_read_bytes"), device=d, direction="read"), point(C("io_write_bytes"), device=d, direction="write")],
                ops=[point(C("ops_read"), device=d, direction="read"), point(C("ops_write"), device=d, direction="write")],
                busy=[point(C("io_time_s"), device=d)], took=[point(C("op_read_time_s"), device=d, direction="read"), point(C("op_write_time_s"), device=d, direction="write")],
                queue=[point(C("pending_ops"), device=d)])
    return envelope(g, "metrics", deal=deal, **{"system.disk": namespace(
        disk__io=metric(C("io")), disk__operations=metric(C("ops")), disk__io_time=metric(C("busy")), disk__operation_time=metric(C("took")),
        disk__pending_operations=metric(C("queue"), "gauge"))})


def net_messages(c: Context) -> DataFrame:
    d = C("iface_id")

    def both(what):
        return [point(C(f"rx_{what}"), device=d, direction="receive"), point(C(f"tx_{what}"), device=d, direction="transmit")]

    g = grouped(c["net_io"], io=both("bytes"), pk=both("packets"), er=both("errors"), dr=both("dropped"), sp=[point(C("link_speed_bps"), device=d)])
    return envelope(g, "metrics", **{"system.network": namespace(
        network__io=metric(C("io")), network__packets=metric(C("pk")), network__errors=metric(C("er")), network__dropped=metric(C("dr")),
        network__link__speed=metric(C("sp"), "gauge"))})


def fs_messages(c: Context) -> DataFrame:
    m = C("mountpoint")
    g = grouped(c["filesystem"], use=[point(C("used_bytes"), mountpoint=m, state="used", type=C("fstype")), point(C("free_bytes"), mountpoint=m, state="free", type=C("fstype"))],
                ino=[point(C("inodes_used"), mountpoint=m, state="used"), point(C("inodes_free"), mountpoint=m, state="free")])
    return envelope(g, "metrics", **{"system.filesystem": namespace(filesystem__usage=metric(C("use"), "gauge"), filesystem__inodes__usage=metric(C("ino"), "gauge"))})


def core_messages(c: Context) -> DataFrame:
    n = C("core_id").cast("string")
    g = grouped(c["cpu_core"], t=[point(C(f"cpu_{s}_s"), cpu=n, state=s) for s in ("user", "system", "idle")] + [point(C("cpu_idle_s"), cpu="all", state="idle")])
    return envelope(g, "metrics", **{"system.cpu": namespace(cpu__time=metric(C("t")))})


def pressure_messages(c: Context) -> DataFrame:
    g = grouped(c["pressure"], t=[point(C("stall_time_s"), resource=C("resource"), scope=C("scope"))],
                r=[point(C("stall_time_s") / 2, resource=C("resource"), scope=C("scope"), window="10")])
    return envelope(g, "metrics", **{"system.pressure": namespace(pressure__stall__time=metric(C("t")), pressure__stall__ratio=metric(C("r"), "gauge"))})


def error_messages(c: Context) -> DataFrame:
    kind, cls = C("error_kind"), C("error_class")
    g = grouped(c["disk_error"], e=[point(C("error_count"), device=C("device_id"), kind=kind, **{"class": F.when(cls != "", cls)})])
    return envelope(g, "metrics", **{"system.disk": namespace(disk__errors=metric(C("e")))})


def rows(messages: DataFrame) -> DataFrame:
    return G.of_type(messages, "metrics")


_HOST = ["cpu_nice_s", "cpu_system_s", "cpu_idle_s", "cpu_iowait_s", "cpu_run_queue", "mem_available_bytes", "mem_used_bytes", "mem_cached_bytes", "mem_limit_bytes", "paging_in", "paging_out", "paging_major", "net_tcp_retransmits"]
query("parse_metrics", f"select {AGENT}, collected_at, {', '.join(_HOST)} from host_metrics", ("host_metrics",), ("cpu_nice_s", "cpu_system_s", "cpu_idle_s", "cpu_iowait_s", "cpu_run_queue"))(
    lambda c: G.parse_host(rows(host_messages(c))).select("agent_id", "collected_at", *_HOST))
query("parse_host_sum", f"select {AGENT}, collected_at, 2 * cpu_user_s as cpu_user_s, cpu_steal_s from host_metrics", ("host_metrics",), ("cpu_user_s", "cpu_steal_s"))(
    lambda c: G.parse_host(rows(host_messages(c))).select("agent_id", "collected_at", "cpu_user_s", "cpu_steal_s"))
for _key, _fn, _parse, _table, _cols, _floats in (
        ("parse_disk_io", disk_messages, G.parse_disk_io, "disk_io", ["device_id", "io_read_bytes", "io_write_bytes", "ops_read", "ops_write", "io_time_s", "op_read_time_s", "op_write_time_s", "pending_ops"], ("io_time_s", "op_read_time_s", "op_write_time_s", "pending_ops")),
        ("parse_net_io", net_messages, G.parse_net_io, "net_io", ["iface_id", "rx_bytes", "tx_bytes", "rx_packets", "tx_packets", "rx_errors", "tx_errors", "rx_dropped", "tx_dropped", "link_speed_bps"], ()),
        ("parse_filesystem", fs_messages, G.parse_filesystem, "filesystem", ["mountpoint", "fstype", "used_bytes", "free_bytes", "inodes_used", "inodes_free"], ()),
        ("parse_cpu_core", core_messages, G.parse_cpu_core, "cpu_core", ["core_id", "cpu_user_s", "cpu_system_s", "cpu_idle_s"], ("cpu_user_s", "cpu_system_s", "cpu_idle_s")),
        ("parse_disk_error", error_messages, G.parse_disk_error, "disk_error", ["device_id", "error_kind", "error_class", "member", "error_count"], ())):
    query(_key, f"select {AGENT}, collected_at, {', '.join(_cols)} from {_table}", (_table,), _floats)(
        lambda c, fn=_fn, parse=_parse, cols=_cols: parse(rows(fn(c))).select("agent_id", "collected_at", *cols))
query("parse_pressure", f"select {AGENT}, collected_at, resource, scope, stall_time_s, stall_time_s / 2 as ratio_avg10 from pressure", ("pressure",), ("stall_time_s", "ratio_avg10"))(
    lambda c: G.parse_pressure(rows(pressure_messages(c))).select("agent_id", "collected_at", "resource", "scope", "stall_time_s", "ratio_avg10"))


def inventory_messages(c: Context, keep: tuple[str, ...] = ()) -> DataFrame:
    i = c["inventory"].withColumn("collected_at", C("last_seen_at"))
    names = ["hostname", "os_id", "os_version", "kernel_version", "product_name", "arch", "cpu_cores", "mem_total_bytes", "block_devices", "net_interfaces", "lvm_vgs", "services", "listen_ports"]
    return envelope(i, "inventory", keep, **{n: C(n) for n in names})


query("parse_inventory", """
    select md5(cast(server_id as varchar)) as agent_id, hostname, os_id, kernel_version, cpu_cores, mem_total_bytes, len(block_devices) as devices, len(services) as services, len(listen_ports) as ports,
           block_devices[1].id as first_device, net_interfaces[1].addresses[1].address as first_address, net_interfaces[1].addresses[1].prefix as first_prefix from inventory""", ("inventory",))(
    lambda c: G.parse_inventory(inventory_messages(c)).select(
        "agent_id", "hostname", "os_id", "kernel_version", "cpu_cores", "mem_total_bytes", F.size("block_devices").alias("devices"), F.size("services").alias("services"), F.size("listen_ports").alias("ports"),
        F.get("block_devices", F.lit(0))["id"].alias("first_device"), F.get(F.get("net_interfaces", F.lit(0))["addresses"], F.lit(0))["address"].alias("first_address"),
        F.get(F.get("net_interfaces", F.lit(0))["addresses"], F.lit(0))["prefix"].alias("first_prefix")))


def mixed_messages(c: Context) -> DataFrame:
    """Inventory messages of which some are damaged, by host number."""
    k, v = C("server_id"), C("value")
    return inventory_messages(c, ("server_id",)).select(
        F.when(k % 11 == 1, F.substring(v, 1, 40)).when(k % 11 == 2, F.regexp_replace(v, '"schema_version":"1.2"', '"schema_version":"2.0"'))
        .when(k % 11 == 3, F.regexp_replace(v, '"os_family":"[a-z]+"', '"os_family":"beos"')).when(k % 11 == 4, F.regexp_replace(v, '"cpu_cores":', '"cpu_cores":-'))
        .when(k % 11 == 5, F.regexp_replace(v, '"hostname":"[^"]*"', '"hostname":""')).when(k % 11 == 6, F.regexp_replace(v, '"collected_at":"([^"]*)Z"', '"collected_at":"$1"'))
        .when(k % 11 == 7, F.regexp_replace(v, '"agent_id":"[^"]*"', '"agent_id":"x"')).otherwise(v).alias("value"))


query("quarantine_invalid", """
    select case server_id % 11 when 1 then 'broken' when 2 then 'major_version' when 3 then 'os_family' when 4 then 'cpu_cores' when 5 then 'hostname' when 6 then 'collected_at' when 7 then 'agent_id' else 'valid' end as verdict, count(*) as messages
    from inventory group by 1""", ("inventory",))(lambda c: _quarantine(c))


def _quarantine(c: Context):
    p = G.check_messages(mixed_messages(c)).select("problems")
    verdict = F.when(F.size("problems") == 0, "valid").when(F.array_contains("problems", "not_json"), "broken").otherwise(F.array_join("problems", ","))
    return p.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("messages"))


query("contract_version_gate", "select count(*) as messages from inventory where server_id % 11 not in (1, 2)", ("inventory",))(lambda c: G.version_gate(mixed_messages(c)).agg(F.count("*").alias("messages")))


def repeated(c: Context) -> DataFrame:
    """Host samples where every third one is delivered twice, the second time an hour later."""
    m = c["host_metrics"].select("server_id", "collected_at", "boot_time", "agent_started_at", F.md5(F.concat_ws("|", "server_id", C("collected_at").cast("string"))).alias("message_id"))
    twice = m.filter((C("server_id") + F.hour("collected_at")) % 3 == 0).withColumn("collected_at", C("collected_at") + F.expr("interval 1 hour"))
    return m.unionByName(twice)


query("dedupe_message_id", "select server_id, count(*) as messages, min(collected_at) as first_at from host_metrics group by 1", ("host_metrics",))(
    lambda c: G.dedupe(repeated(c)).groupBy("server_id").agg(F.count("*").alias("messages"), F.min("collected_at").alias("first_at")))
query("insert_if_absent", f"select server_id, count(*) as inserted from host_metrics where collected_at > timestamp '2024-01-20 00:00:00' group by 1", ("host_metrics",))(
    lambda c: G.insert_if_absent(c["host_metrics"].unionByName(c["host_metrics"]).select(*KEY), c["host_metrics"].filter(C("collected_at") <= timestamp("2024-01-20 00:00:00")), X.NATURAL_KEYS["host_metrics"]).groupBy(
        "server_id").agg(F.count("*").alias("inserted")))
query("insert_counts", "select 'host_metrics' as table_name, count(*) as inserted from host_metrics where collected_at > timestamp '2024-01-20 00:00:00' union all select 'disk_io', count(*) from disk_io where device_id like 'dm%'", ("host_metrics", "disk_io"))(
    lambda c: G.insert_counts({
        "host_metrics": G.insert_if_absent(c["host_metrics"].select(*KEY), c["host_metrics"].filter(C("collected_at") <= timestamp("2024-01-20 00:00:00")), KEY),
        "disk_io": G.insert_if_absent(c["disk_io"].select(*X.NATURAL_KEYS["disk_io"]), c["disk_io"].filter(~C("device_id").startswith("dm")), X.NATURAL_KEYS["disk_io"])}))
query("upsert_latest", """
    select server_id, hostname, last_seen_at from (select server_id, hostname, last_seen_at from inventory where server_id % 2 = 1
      union all select server_id, case when last_seen_at < timestamp '2024-01-30 12:00:00' then 'new-name' else hostname end, greatest(last_seen_at, timestamp '2024-01-30 12:00:00') from inventory where server_id % 2 = 0) x""", ("inventory",))(
    lambda c: _upsert(c))


def _upsert(c: Context):
    i = c["inventory"].select("server_id", "hostname", "last_seen_at")
    updates = i.filter(C("server_id") % 2 == 0).select("server_id", F.lit("new-name").alias("hostname"), timestamp("2024-01-30 12:00:00").alias("last_seen_at"))
    return G.upsert_latest(i, updates, "server_id", "last_seen_at")


query("register_placeholder", """
    select coalesce(i.agent_id, h.agent_id) as agent_id, i.agent_id is null as placeholder, coalesce(i.hostname, h.agent_id) as hostname
    from (select agent_id, hostname from inventory where server_id >= 50) i full join (select distinct 'agent-' || server_id as agent_id from host_metrics) h using (agent_id)""", ("inventory", "host_metrics"))(
    lambda c: G.register_placeholders(c["host_metrics"].select(F.concat(F.lit("agent-"), C("server_id").cast("string")).alias("agent_id"), "collected_at"),
                                      c["inventory"].filter("server_id >= 50").select("agent_id", "hostname")).select("agent_id", "placeholder", "hostname"))
query("append_on_change", """
    select server_id, collected_at from (
      select *, lag(cpu_cores) over w as pc, lag(kernel_version) over w as pk, lag(agent_started_at) over w as pa, lag(boot_time) over w as pb, row_number() over w as rn
      from inventory_history window w as (partition by server_id order by collected_at)) x
    where rn = 1 or cpu_cores is distinct from pc or kernel_version is distinct from pk or agent_started_at is distinct from pa or abs(epoch(boot_time) - epoch(pb)) > 5""", ("inventory_history",))(
    lambda c: G.append_on_change(c["inventory_history"], "server_id", "collected_at", X.TRACKED).select("server_id", "collected_at"))
query("agent_error_log", "select 'agent-' || user_id as agent_id, 'E' || (event_id % 7) as error_code from events where event_type = 'error'", ())(lambda c: _error_log(c))


def _error_log(c: Context):
    """Error events as error messages, every one delivered twice."""
    e = c.table("events").filter("event_type = 'error'")
    m = e.select(F.to_json(F.struct(
        F.lit("1.0").alias("schema_version"), F.lit("error").alias("message_type"), F.md5(C("event_id").cast("string")).alias("message_id"), F.concat(F.lit("agent-"), C("user_id").cast("string")).alias("agent_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("collected_at"), F.lit("linux").alias("os_family"), F.concat(F.lit("E"), (C("event_id") % 7).cast("string")).alias("error_code"),
        F.lit("failed").alias("error_message"), F.lit("disk").alias("failed_component"))).alias("value"))
    return G.agent_errors(m.unionByName(m)).select("agent_id", "error_code")


# --- streams ------------------------------------------------------------------------------------------------------

def event_stream(c: Context) -> DataFrame:
    """The event file as a stream; the zone-less time becomes a timestamp."""
    schema = c.table("events").schema
    s = c.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(c.sf_dir)
    return s.withColumn("ts", C("ts").cast("timestamp")).withColumn("cents", F.round(C("value") * 100).cast("bigint"))


_WD = "over (partition by user_id, event_type, date_trunc('day', ts) order by ts)"
library("ev_inc", f"select user_id, event_type, date_trunc('day', ts) as bucket, cents, case when lag(cents) {_WD} is null then 0 when cents >= lag(cents) {_WD} then cents - lag(cents) {_WD} else cents end as i from (select *, cast(round(value * 100) as bigint) as cents from events) e")
query("stream_rollup_5m", "select user_id, event_type, bucket, cast(sum(i) as bigint) as d_cents, avg(cents) as cents_avg, max(cents) as cents_max, count(*) as sample_count from ev_inc group by 1, 2, 3", ("ev_inc",), ("cents_avg",))(
    lambda c: _event_rollup(c, 86400).table(_events(c)))
query("rollup_from_partials", "select user_id, event_type, bucket, cast(sum(i) as bigint) as d_cents, avg(cents) as cents_avg, max(cents) as cents_max, count(*) as sample_count from ev_inc group by 1, 2, 3", ("ev_inc",), ("cents_avg",))(
    lambda c: _event_rollup(c, 300).table(_events(c), 86400))


def _events(c: Context) -> DataFrame:
    return c.table("events").withColumn("ts", C("ts").cast("timestamp")).withColumn("cents", F.round(C("value") * 100).cast("bigint"))


def _event_rollup(c: Context, width: int) -> W.RollupStream:
    r = W.RollupStream(c.spark, W.work_folder(c.spark, "rollup"), ["user_id", "event_type"], "ts", ["cents"], ["cents"], width)
    return r.run(event_stream(c))


query("realtime_union", "select server_id, bucket, sample_count, run_queue_avg from host_roll", ("host_roll",), ("run_queue_avg",))(lambda c: _realtime(c))


def _realtime(c: Context):
    """Buckets below the mark stand for the stored table, the rest is computed from the raw tail."""
    mark = timestamp("2024-01-21 00:00:00")
    stored = R.rollup_host(c["host_metrics"].filter(C("collected_at") < mark), c.width)
    return R.realtime_union(stored, c["host_metrics"], R.rollup_host, c.width, mark).select("server_id", "bucket", "sample_count", "run_queue_avg")


query("stream_dedupe", "select event_id, user_id from events", ())(lambda c: _stream_dedupe(c))


def _stream_dedupe(c: Context):
    s = event_stream(c).select(F.explode(F.array(C("event_id"), C("event_id"))).alias("event_id"), "user_id", "ts")
    return W.run_available(W.stream_dedupe(s, "event_id", "ts", "24 hours"), "dedupe").select("event_id", "user_id")


library("bursts", """
    select user_id, min(ts) as first_at, count(*) as events from (
      select *, sum(case when prev is null or ts - prev >= interval 1 hour then 1 else 0 end) over (partition by user_id order by ts) as s
      from (select user_id, ts, lag(ts) over (partition by user_id order by ts) as prev from events) a) b group by user_id, s having count(*) >= 3""")
query("restart_burst", "select * from bursts", ("bursts",))(lambda c: W.restart_bursts(c.table("events").withColumn("ts", C("ts").cast("timestamp")), "user_id", "ts"))
query("stream_restart_burst", "select * from bursts", ("bursts",))(lambda c: W.burst_alerts(event_stream(c), "user_id", "ts"))
query("online_state", f"select user_id, max(ts) as last_at, max(ts) > {END} - interval 1 day as online from events group by 1", ())(
    lambda c: W.newest_epoch(W.run_available(W.online_state(event_stream(c), "user_id", "ts", c.end, 86400), "online", "update"), ["user_id"]))
query("agent_start_change", """
    select host, changed_at, agent_started_at from (select user_id as host, ts as changed_at, date_trunc('day', ts) as agent_started_at, lag(date_trunc('day', ts)) over (partition by user_id order by ts) as p, lag(ts) over (partition by user_id order by ts) as seen from events) x
    where p is not null and p <> agent_started_at and changed_at - seen <= interval 24 hour""", ())(
    lambda c: W.agent_start_changes(event_stream(c).withColumn("start", F.date_trunc("day", "ts")), "user_id", "ts", "start"))
query("clock_invariant_alerts", "select agent_id, count(*) as alerts from (select 'agent-' || server_id as agent_id from host_metrics where agent_started_at > collected_at or boot_time > agent_started_at) x group by 1", ("host_metrics",))(
    lambda c: W.clock_alerts(c["host_metrics"].withColumn("agent_id", F.concat(F.lit("agent-"), C("server_id").cast("string")))).groupBy("agent_id").agg(F.count("*").alias("alerts")))
query("stream_clock_alerts", "select user_id from events where event_id % 5 = 0 group by 1", ())(lambda c: _stream_alerts(c))


def _stream_alerts(c: Context):
    """Every fifth event claims an agent start in the future; one alert per host within the quiet time of one batch."""
    s = event_stream(c).select("user_id", C("ts").alias("collected_at"), (C("ts") - F.expr("interval 1 day")).alias("boot_time"),
                               F.when(C("event_id") % 5 == 0, C("ts") + F.expr("interval 1 day")).otherwise(C("ts")).alias("agent_started_at"))
    return W.run_available(W.clock_alerts(s, "user_id", "collected_at", "1 hour"), "alerts").select("user_id").distinct()


query("late_and_future", "select count(*) as kept from events where ts <= timestamp '2024-01-20 00:02:00'", ())(
    lambda c: W.run_available(W.stream_recent(event_stream(c).select("event_id", "ts"), timestamp("2024-01-20 00:00:00"), "ts"), "recent").agg(F.count("*").alias("kept")))
query("stream_upsert_inventory", "select user_id, event_type, ts from events qualify row_number() over (partition by user_id order by ts desc) = 1", ())(
    lambda c: W.upsert_stream(event_stream(c).select("user_id", "event_type", "ts"), "user_id", "ts"))


def with_null(messages: DataFrame, tag: str, *namespaces: str) -> DataFrame:
    """Messages with explicit nulls for namespaces that were not collected, and message ids of their own."""
    more = ", ".join(f'"{n}":null' for n in namespaces)
    own = F.regexp_replace("value", '"message_id":"..', f'"message_id":"{tag}')
    return messages.select(F.concat(F.substr(own, F.lit(1), F.length("value") - 1), F.lit(f", {more}}}")).alias("value"))


query("ingest_stream", """
    select 'host_metrics' as table_name, count(*) as row_count from host_metrics union all select 'disk_io', count(*) from disk_io
    union all select 'cpu_core', 2 * count(*) from host_metrics union all select 'seen', count(distinct server_id) from host_metrics
    union all select 'quarantine', count(*) from inventory where server_id % 11 between 1 and 7
    union all select 'inventory_history', count(*) from inventory where server_id % 11 not between 1 and 7
    union all select 'placeholders', count(distinct server_id) from host_metrics where server_id not in (select server_id from inventory where server_id % 11 not between 1 and 7)""",
      ("host_metrics", "disk_io", "inventory"))(lambda c: _ingest(c))


def _ingest(c: Context) -> DataFrame:
    """All messages, the metrics twice, in one batch that is delivered again after it is committed."""
    folder = W.work_folder(c.spark, "ingest")
    hosts = with_null(host_messages(c, deal=False), "aa", "system.disk")
    disks = with_null(disk_messages(c, deal=False), "bb", "system.cpu", "system.memory", "system.network")
    with passing_shuffles(c.spark):  # samples come out of a shuffle, in tasks enough
        for messages in (hosts, hosts, disks, mixed_messages(c)):
            messages.write.mode("append").option("compression", "gzip").text(f"{folder}/in")
    s = IngestStream(c.spark, folder).run(c.spark.readStream.text(f"{folder}/in"))
    s.batch(c.spark.read.text(f"{folder}/in"), 0)
    counts = {n: s.table(n) for n in ("host_metrics", "cpu_core", "seen", "quarantine", "inventory_history")}
    counts["disk_io"], counts["placeholders"] = s.table("disk_io"), s.table("inventory").where("placeholder")
    return G.insert_counts(counts).withColumnRenamed("inserted", "row_count")
