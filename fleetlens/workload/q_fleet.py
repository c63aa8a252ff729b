"""Snapshots, errors, tasks, selections and fleet views over the bound fleet."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import classify as C
from fleetlens.functions import rules
from fleetlens.functions.exprs import shift, timestamp
from fleetlens.operators import errors as E
from fleetlens.operators import fleet_views as V
from fleetlens.operators import reports as P
from fleetlens.operators import selection as S
from fleetlens.operators import selection_reports as M
from fleetlens.operators import snapshots as N
from fleetlens.operators import tasks as K
from fleetlens.operators.kernels import places
from fleetlens.session import held
from fleetlens.streaming.streams import work_folder
from fleetlens.workload.q_inventory import support
from fleetlens.workload.q_reports import rolls, series_index, verdict
from fleetlens.workload.q_trends import END, START, VOLUME
from fleetlens.workload.registry import Context, library, query

HOST = "server_id"
REC = f"collected_at >= {START} and collected_at <= {END} + interval 2 minutes"


def _pair(table, keys, cols, where="true"):
    """Newest two rows of a key as cur_ / prv_ columns, in plain SQL."""
    side = ", ".join(f"max({c}) filter (where rn = {n}) as {p}_{c}" for c in (*cols, "collected_at") for n, p in ((1, "cur"), (2, "prv")))
    return f"""select {keys}, {side}, epoch(max(collected_at) filter (where rn = 1)) - epoch(max(collected_at) filter (where rn = 2)) as pair_dt
        from (select *, row_number() over (partition by {keys} order by collected_at desc) as rn from {table} where {REC} and {where}) x where rn <= 2 group by {keys}"""


# --- snapshots ----------------------------------------------------------------------------------------------------

library("cpu_pair", _pair("cpu_total", "server_id", ("total", "cpu_idle_s", "cpu_user_s", "cpu_system_s", "boot_time")), ("cpu_total",))
library("cpu_snap", """
    select server_id, cur_collected_at as collected_at, case when ok then greatest(0, 100 - greatest(0, (cur_cpu_idle_s - prv_cpu_idle_s) / dtot * 100)) end as usage_pct,
           case when ok then greatest(0, (cur_cpu_user_s - prv_cpu_user_s) / dtot * 100) end as user_pct,
           case when ok then greatest(0, (cur_cpu_system_s - prv_cpu_system_s) / dtot * 100) end as system_pct
    from (select *, cur_total - prv_total as dtot, cur_total - prv_total > 0 and abs(epoch(cur_boot_time) - epoch(prv_boot_time)) <= 5 as ok from cpu_pair) p""", ("cpu_pair",))
library("mem_snap", f"""
    select server_id, mem_limit_bytes as total_bytes, mem_limit_bytes - mem_available_bytes as used_bytes,
           (mem_limit_bytes - mem_available_bytes) / mem_limit_bytes * 100 as usage_pct, mem_cached_bytes, mem_buffered_bytes, mem_limit_bytes
    from host_metrics where {REC} qualify row_number() over (partition by server_id order by collected_at desc) = 1""", ("host_metrics",))
library("core_snap", "select server_id, core_id, case when cur_t - prv_t > 0 then greatest(0, 100 - greatest(0, (cur_cpu_idle_s - prv_cpu_idle_s) / (cur_t - prv_t) * 100)) end as usage_pct from ("
        + _pair("(select *, cpu_user_s + cpu_system_s + cpu_idle_s as t from cpu_core)", "server_id, core_id", ("t", "cpu_idle_s")) + ") p", ("cpu_core",))


def _rate(c, unit=""):
    return f"case when cur_{c} >= prv_{c} and pair_dt > 0 then (cur_{c} - prv_{c}) {unit} / pair_dt end"


_DC, _NC = ("ops_read", "ops_write", "io_read_bytes", "io_write_bytes"), ("rx_bytes", "tx_bytes", "rx_packets", "tx_packets")
library("disk_snap", f"select server_id, device_id, {_rate('ops_read')} as read_iops, {_rate('ops_write')} as write_iops, {_rate('io_read_bytes', '/ 1024')} as read_kbps, {_rate('io_write_bytes', '/ 1024')} as write_kbps from ("
        + _pair("(select * from disk_io join phys_disk using (server_id, device_id))", "server_id, device_id", _DC) + ") p", ("disk_io", "phys_disk"))
library("net_snap", f"select server_id, iface_id, {_rate('rx_bytes', '/ 1024')} as rx_kbps, {_rate('tx_bytes', '/ 1024')} as tx_kbps, {_rate('rx_packets')} as rx_pps, {_rate('tx_packets')} as tx_pps from ("
        + _pair("(select * from net_io join phys_iface using (server_id, iface_id))", "server_id, iface_id", _NC) + ") p", ("net_io", "phys_iface"))
library("mount_snap", f"""
    select server_id, mountpoint, used_bytes + free_bytes as total_bytes, used_bytes, free_bytes, used_bytes / (used_bytes + free_bytes) * 100 as usage_pct
    from filesystem where {REC} and {VOLUME} qualify row_number() over (partition by server_id, mountpoint order by collected_at desc) = 1""", ("filesystem",))
library("dash", """
    select c.server_id, c.collected_at, c.usage_pct as cpu_pct, m.usage_pct as mem_pct, m.used_bytes, m.total_bytes, core_max_pct, hot_cores, read_iops, write_iops, rx_kbps, tx_kbps, disk_usage_pct
    from cpu_snap c left join mem_snap m using (server_id)
    left join (select server_id, max(usage_pct) as core_max_pct, count(*) filter (where usage_pct >= 85) as hot_cores from core_snap group by 1) k using (server_id)
    left join (select server_id, sum(read_iops) as read_iops, sum(write_iops) as write_iops from disk_snap group by 1) d using (server_id)
    left join (select server_id, sum(rx_kbps) as rx_kbps, sum(tx_kbps) as tx_kbps from net_snap group by 1) n using (server_id)
    left join (select server_id, sum(used_bytes) / sum(total_bytes) * 100 as disk_usage_pct from mount_snap group by 1) f using (server_id)""",
        ("cpu_snap", "mem_snap", "core_snap", "disk_snap", "net_snap", "mount_snap"))
query("pair_pivot", "select server_id, usage_pct, user_pct, system_pct from cpu_snap", ("cpu_snap",), ("usage_pct", "user_pct", "system_pct"))(
    lambda c: N.cpu_snapshot(N.recent(c["host_metrics"], c.start, c.end)).select(HOST, "usage_pct", "user_pct", "system_pct"))
query("snapshot_memory", """
    select server_id, usage_pct, case when mem_cached_bytes is not null then least(greatest(0, 100 - usage_pct), mem_cached_bytes / mem_limit_bytes * 100) end as cached_pct from mem_snap""", ("mem_snap",), ("usage_pct", "cached_pct"))(
    lambda c: N.mem_snapshot(N.recent(c["host_metrics"], c.start, c.end)).select(HOST, "usage_pct", "cached_pct"))
query("snapshot_cores", "select server_id, core_id, usage_pct, coalesce(usage_pct >= 85, false) as hot from core_snap", ("core_snap",), ("usage_pct",))(
    lambda c: N.core_snapshot(N.recent(c["cpu_core"], c.start, c.end)))
query("snapshot_disks", "select * from disk_snap", ("disk_snap",), ("read_iops", "write_iops", "read_kbps", "write_kbps"))(
    lambda c: N.disk_snapshot(N.recent(c["disk_io"], c.start, c.end), c["inventory"]))
query("snapshot_interfaces", "select * from net_snap", ("net_snap",), ("rx_kbps", "tx_kbps", "rx_pps", "tx_pps"))(
    lambda c: N.net_snapshot(N.recent(c["net_io"], c.start, c.end), c["inventory"]))
query("snapshot_mounts", "select * from mount_snap", ("mount_snap",), ("usage_pct",))(lambda c: N.mount_snapshot(N.recent(c["filesystem"], c.start, c.end)))
_DASH = ("cpu_pct", "mem_pct", "core_max_pct", "read_iops", "write_iops", "rx_kbps", "tx_kbps", "disk_usage_pct")
query("latest_dashboard", f"select server_id, hot_cores, {', '.join(_DASH)} from dash", ("dash",), _DASH)(
    lambda c: N.latest_dashboard(c.fleet, c.start, c.end).select(HOST, "hot_cores", *_DASH))
query("latest_dashboard_indexed", f"select server_id, hot_cores, {', '.join(_DASH)} from dash", ("dash",), _DASH)(
    lambda c: N.latest_dashboard(series_index(c).fleet(c.fleet), c.start, c.end).select(HOST, "hot_cores", *_DASH))

library("sat", f"""
    select m.server_id, os_family, cur_cpu_run_queue as run_queue, cur_cpu_blocked as blocked, await_ms, disk_util_pct, pending_ops,
           case when os_family = 'windows' then {_rate('paging_in')} else {_rate('paging_major')} end as paging_rate,
           case when txp > 0 and cur_net_tcp_retransmits >= prv_net_tcp_retransmits then (cur_net_tcp_retransmits - prv_net_tcp_retransmits) / txp * 100 end as retrans_pct,
           case when pkt > 0 and dropped >= 0 then dropped / pkt * 100 end as drop_pct,
           case when cur_net_conntrack_limit > 0 then cur_net_conntrack_usage / cur_net_conntrack_limit end as conntrack_ratio, psi_cpu, psi_mem, psi_io
    from ({_pair("host_metrics", "server_id", ("cpu_run_queue", "cpu_blocked", "paging_in", "paging_major", "net_tcp_retransmits", "net_conntrack_usage", "net_conntrack_limit"))}) m
    join inventory using (server_id)
    left join (select server_id, max(case when sound and t >= 0 and io / pair_dt >= 0.5 then t / ops * 1000 end) as await_ms, max(case when sound then io / pair_dt * 100 end) as disk_util_pct,
                      max(case when sound then cur_pending_ops end) as pending_ops
               from (select *, ops > 0 and pair_dt > 0 and io >= 0 and io <= pair_dt as sound from (
                       select *, cur_t - prv_t as t, cur_ops - prv_ops as ops, cur_io - prv_io as io from (
                         {_pair("(select server_id, device_id, collected_at, op_read_time_s + op_write_time_s as t, ops_read + ops_write as ops, io_time_s as io, pending_ops from disk_io join phys_disk using (server_id, device_id))", "server_id, device_id", ("t", "ops", "io", "pending_ops"))}) a) b) d group by 1) dd using (server_id)
    left join (select server_id, sum(tx_packets + rx_packets) filter (where rn = 1) - sum(tx_packets + rx_packets) filter (where rn = 2) as pkt,
                      sum(tx_packets) filter (where rn = 1) - sum(tx_packets) filter (where rn = 2) as txp,
                      sum(rx_dropped + tx_dropped) filter (where rn = 1) - sum(rx_dropped + tx_dropped) filter (where rn = 2) as dropped
               from (select *, row_number() over (partition by server_id, iface_id order by collected_at desc) as rn from net_io where {REC}) n group by 1) nn using (server_id)
    left join (select server_id, max(case when resource = 'cpu' then r end) as psi_cpu, max(case when resource = 'memory' then r end) as psi_mem, max(case when resource = 'io' then r end) as psi_io
               from (select server_id, resource, {_rate('stall_time_s')} * 100 as r from ({_pair("pressure", "server_id, resource", ("stall_time_s",), "scope = 'some'")}) p) q group by 1) psi using (server_id)""",
        ("host_metrics", "inventory", "disk_io", "phys_disk", "net_io", "pressure"))
_SAT = ("run_queue", "blocked", "await_ms", "disk_util_pct", "pending_ops", "paging_rate", "retrans_pct", "drop_pct", "conntrack_ratio", "psi_cpu", "psi_mem", "psi_io")


def saturation(c: Context):
    return c.once("saturation", lambda: N.latest_saturation(c.fleet, c.start, c.end))


query("latest_saturation", "select * from sat", ("sat",), _SAT)(saturation)
query("latest_saturation_indexed", "select * from sat", ("sat",), _SAT)(
    lambda c: N.latest_saturation(series_index(c).fleet(c.fleet), c.start, c.end))


def _sig(axis, key, value, limit, over, gone="false"):
    return (f"select server_id, '{axis}' as axis, '{key}' as key, case when {gone} then 'not_applicable' when {value} is not null then 'measured' else 'no_data' end as state, "
            f"case when not ({gone}) then cast({value} as double) end as value, case when not ({gone}) then cast({limit} as double) end as threshold, "
            f"case when not ({gone}) and {value} is not null then {over} end as saturated from s")


_W, _NP = "os_family = 'windows'", "os_family = 'windows' or starts_with(kernel_version, '3.')"
library("steal", "select server_id, case when cur_total - prv_total > 0 and abs(epoch(cur_boot_time) - epoch(prv_boot_time)) <= 5 and cur_cpu_steal_s is not null then greatest(0, (cur_cpu_steal_s - prv_cpu_steal_s) / (cur_total - prv_total) * 100) end as steal_pct from ("
        + _pair("cpu_total", "server_id", ("total", "cpu_steal_s", "boot_time")) + ") p", ("cpu_total",))
library("sig_in", "select t.*, kernel_version, cpu_cores, run_queue / cpu_cores as q, case when t.os_family = 'windows' then 2.0 else 1.0 end as line, st.steal_pct from sat t join inventory i using (server_id) left join steal st using (server_id)", ("sat", "inventory", "steal"))
query("saturation_signals", " union all ".join(x.replace(" from s", " from sig_in") for x in [
    _sig("cpu", "cpu_run_queue", "q", "line", "q >= line"), _sig("cpu", "cpu_steal", "steal_pct", "5", "steal_pct >= 5", _W),
    _sig("cpu", "cpu_psi", "psi_cpu", "10", "psi_cpu >= 10", _NP), _sig("cpu", "cpu_blocked", "blocked", "1", "blocked >= 1", _W),
    _sig("mem", "mem_paging", "paging_rate", f"case when {_W} then 20 else 0 end", f"case when {_W} then paging_rate >= 20 else paging_rate > 0 end"),
    _sig("mem", "mem_psi", "psi_mem", "10", "psi_mem >= 10", _NP),
    _sig("disk", "disk_await", f"coalesce(await_ms, case when {_W} then pending_ops end)", f"case when {_W} and await_ms is null then 2 else 20 end", "coalesce(await_ms >= 20, pending_ops >= 2)"),
    _sig("disk", "disk_psi", "psi_io", "10", "psi_io >= 10", _NP), _sig("net", "net_retrans", "retrans_pct", "1", "retrans_pct >= 1"),
    _sig("net", "net_drop", "drop_pct", "0.5", "drop_pct >= 0.5"), _sig("net", "net_conntrack", "conntrack_ratio", "0.8", "conntrack_ratio >= 0.8", _W)]),
      ("sig_in",), ("value", "threshold"))(
    lambda c: N.saturation_signals(saturation(c), c["inventory"], N.cpu_snapshot(N.recent(c["host_metrics"], c.start, c.end)).select(HOST, "steal_pct")))
library("load", """
    select d.server_id, d.collected_at, d.cpu_pct, d.mem_pct, d.used_bytes, d.total_bytes, run_queue / cpu_cores / case when i.os_family = 'windows' then 2.0 else 1.0 end as cpu_sat_index,
           coalesce(await_ms / 20, case when i.os_family = 'windows' then pending_ops / 2 end) as disk_sat_index,
           coalesce(case when i.os_family = 'windows' then paging_rate >= 20 else paging_rate > 0 end, false) as mem_pressure,
           (not coalesce(coalesce(rx_kbps, 0) + coalesce(tx_kbps, 0) < 10, false) and (coalesce(retrans_pct > 1, false) or coalesce(drop_pct > 0.5, false))) or coalesce(conntrack_ratio >= 0.8, false) as net_congested, cpu_cores
    from dash d join sat s using (server_id) join inventory i using (server_id) where d.collected_at >= timestamp '2024-01-30 00:00:00'""", ("dash", "sat", "inventory"))


def load(c: Context):
    return c.once("load", lambda: N.environment_load(c.fleet, c.start, c.end, timestamp("2024-01-30 00:00:00")))


query("saturation_index", "select server_id, cpu_sat_index, disk_sat_index, mem_pressure, net_congested from load", ("load",), ("cpu_sat_index", "disk_sat_index"))(
    lambda c: load(c).select(HOST, "cpu_sat_index", "disk_sat_index", "mem_pressure", "net_congested"))
library("realtime", """
    select count(*) as online, sum(cpu_pct * cpu_cores) filter (where cpu_pct is not null) / sum(cpu_cores) filter (where cpu_pct is not null) as cpu_pct,
           sum(used_bytes) / sum(total_bytes) * 100 as mem_pct, count(*) filter (where cpu_sat_index >= 1) as cpu_saturated, count(*) filter (where disk_sat_index >= 1) as disk_saturated,
           count(*) filter (where mem_pressure) as mem_pressure, count(*) filter (where net_congested) as net_congested, max(collected_at) as last_collected_at from load""", ("load",))
query("environment_realtime", "select * from realtime", ("realtime",), ("cpu_pct", "mem_pct"))(lambda c: N.environment_realtime(load(c)))
query("realtime_capacity_weighted", "select cpu_pct, mem_pct from realtime", ("realtime",), ("cpu_pct", "mem_pct"))(
    lambda c: N.environment_realtime(load(c)).select("cpu_pct", "mem_pct"))

# --- errors -------------------------------------------------------------------------------------------------------

library("errs", f"""
    select i.server_id, i.os_family, coalesce(mce, 0) as mce, coalesce(oom, 0) as oom, corrupted_now, corrupted_max, coalesce(samples, 0) as samples, cast(coalesce(net_errors, 0) as bigint) as net_errors,
           coalesce(ifaces, 0) as ifaces, cast(coalesce(disk_errors, 0) as bigint) as disk_errors, kinds as disk_error_kinds, last_disk_error_at
    from inventory i
    left join (select server_id, max(cpu_mce) - min(cpu_mce) as mce, max(mem_oom_kill) - min(mem_oom_kill) as oom, arg_max(mem_hardware_corrupted_bytes, collected_at) as corrupted_now,
                      max(mem_hardware_corrupted_bytes) as corrupted_max, count(*) as samples from host_metrics where {REC} group by 1) m using (server_id)
    left join (select server_id, sum(d) as net_errors, count(*) as ifaces from (select server_id, iface_id, max(rx_errors + tx_errors) - min(rx_errors + tx_errors) as d from net_io where {REC} group by 1, 2) a group by 1) n using (server_id)
    left join (select server_id, sum(d) as disk_errors, string_agg(distinct kc, ',' order by kc) filter (where d > 0) as kinds, max(last_at) filter (where d > 0) as last_disk_error_at
               from (select server_id, device_id, error_kind || case when error_class = '' then '' else '/' || error_class end as kc, max(error_count) - min(error_count) as d, max(collected_at) as last_at
                     from disk_error where {REC} group by 1, 2, 3) b group by 1) k using (server_id)""", ("inventory", "host_metrics", "net_io", "disk_error"))


def errors(c: Context):
    return c.once("errors", lambda: E.host_errors(c.fleet, c.start, c.end))


query("host_errors", "select * replace (coalesce(disk_error_kinds, '') as disk_error_kinds) from errs", ("errs",))(
    lambda c: errors(c).withColumn("disk_error_kinds", F.coalesce(F.array_join("disk_error_kinds", ","), F.lit(""))))
library("fleet_err", """
    select count(*) filter (where samples > 0) as total, count(*) filter (where mce > 0) as mce_hosts, count(*) filter (where oom > 0) as oom_hosts, count(*) filter (where corrupted_max > 0) as corrupted_hosts,
           count(*) filter (where net_errors > 0) as net_error_hosts, count(*) filter (where disk_errors > 0) as disk_error_hosts from errs""", ("errs",))
query("fleet_errors", "select * from fleet_err", ("fleet_err",))(lambda c: E.fleet_errors(errors(c)))
query("count_filter", "select oom_hosts, net_error_hosts from fleet_err", ("fleet_err",))(lambda c: E.fleet_errors(errors(c)).select("oom_hosts", "net_error_hosts"))
library("err_hosts", "select server_id from errs where mce > 0 or oom > 0 or corrupted_max > 0 or net_errors > 0 or disk_errors > 0", ("errs",))
query("error_hosts", "select * from err_hosts", ("err_hosts",))(lambda c: E.error_hosts(c.fleet, c.start, c.end))
query("error_host_union", f"""
    select server_id from (select server_id from host_metrics where {REC} group by 1 having max(cpu_mce) > min(cpu_mce) or max(mem_oom_kill) > min(mem_oom_kill) or max(mem_hardware_corrupted_bytes) > 0) a
    union select server_id from (select server_id from net_io where {REC} group by 1, iface_id having max(rx_errors + tx_errors) > min(rx_errors + tx_errors)) b
    union select server_id from (select server_id from disk_error where {REC} group by 1, device_id, error_kind having max(error_count) > min(error_count)) c""", ("host_metrics", "net_io", "disk_error"))(
    lambda c: E.error_hosts(c.fleet, c.start, c.end))
query("max_min_delta", f"select server_id, cast(sum(d) as bigint) as net_errors, count(*) as ifaces from (select server_id, iface_id, max(rx_errors + tx_errors) - min(rx_errors + tx_errors) as d from net_io group by 1, 2) a group by 1", ("net_io",))(
    lambda c: E.net_error_totals(c["net_io"]))
query("array_agg_distinct_filter", "select server_id, coalesce(disk_error_kinds, '') as kinds from errs where samples > 0", ("errs",))(
    lambda c: E.disk_error_totals(N.recent(c["disk_error"], c.start, c.end)).select(HOST, F.array_join("disk_error_kinds", ",").alias("kinds")))
query("max_filter", "select server_id, last_disk_error_at from errs where samples > 0", ("errs",))(
    lambda c: E.disk_error_totals(N.recent(c["disk_error"], c.start, c.end)).select(HOST, "last_disk_error_at"))
query("error_signals", " union all ".join(
    f"select server_id, '{k}' as key, case when {gone} then 'not_applicable' when not ({m}) then 'no_data' when {v} > 0 then 'occurred' else 'clean' end as state, case when not ({gone}) and ({m}) then cast({v} as bigint) end as count from errs"
    for k, v, m, gone in (("cpu_mce", "mce", "samples > 0", "false"), ("mem_oom", "oom", "samples > 0", "false"), ("net_errors", "net_errors", "ifaces > 0", "false"),
                          ("disk_errors", "disk_errors", "true", "false"), ("mem_corrupted", "corrupted_now", "corrupted_now is not null", "os_family = 'windows'"))), ("errs",))(
    lambda c: E.error_signals(errors(c)))

# --- tasks --------------------------------------------------------------------------------------------------------

NOW = "timestamp '1999-06-01 00:00:00'"


def now():
    return timestamp("1999-06-01 00:00:00")


library("task_host", "select t.*, hostname, os_family, os_id, os_version from tasks t left join inventory i using (server_id)", ("tasks", "inventory"))
query("task_outer_join", "select task_id, server_id, hostname, status from task_host", ("task_host",))(
    lambda c: K.with_inventory(c["tasks"], c["inventory"]).select("task_id", HOST, "hostname", "status"))
library("task_eff", """
    select task_id, case when p then 'success' when task_policy = false then 'failure' else status end as eff_status,
           case when p then null when task_policy = false then coalesce(failure_reason, 'install_unverified') else failure_reason end as eff_reason
    from (select *, coalesce(task_policy, false) or (task_policy is null and coalesce(status = 'failure' and failure_reason = 'script_failed'
             and ((os_family = 'windows' and exit_code = 2) or (os_family = 'linux' and os_id = 'rocky' and split_part(os_version, '.', 1) = '9' and exit_code = 3)), false)) as p from task_host) t""", ("task_host",))
query("effective_task_status", "select * from task_eff", ("task_eff",))(
    lambda c: K.effective_status(K.with_inventory(c["tasks"], c["inventory"])).select("task_id", "eff_status", "eff_reason"))
query("displayed_task_status", f"select task_id, case when l then 'failure' else status end as shown_status, case when l then 'timeout' else failure_reason end as shown_reason from (select *, coalesce(failure_reason = 'timeout', false) or (status = 'pending' and deadline_at < {NOW}) as l from tasks) t", ("tasks",))(
    lambda c: K.displayed_status(c["tasks"], now()).select("task_id", "shown_status", "shown_reason"))
query("expire_overdue", f"select task_id, case when l then 'failure' else status end as status, case when l then 'timeout' else failure_reason end as failure_reason, case when l then {NOW} end as completed_at from (select *, status = 'pending' and deadline_at < {NOW} as l from tasks) t", ("tasks",))(
    lambda c: K.expire_overdue(c["tasks"], now()).select("task_id", "status", "failure_reason", "completed_at"))
query("pending_servers", f"select distinct server_id from tasks where status = 'pending' and deadline_at >= {NOW}", ("tasks",))(
    lambda c: K.pending_servers(K.expire_overdue(c["tasks"], now())))
library("last_task", "select * from tasks qualify row_number() over (partition by server_id order by created_at desc, task_id desc) = 1", ("tasks",))
query("distinct_on_latest", "select server_id, task_id, status, created_at from last_task", ("last_task",))(lambda c: K.latest_tasks(c["tasks"]).select(HOST, "task_id", "status", "created_at"))
query("latest_task_join", "select server_id, hostname, task_id from inventory left join last_task using (server_id)", ("inventory", "last_task"))(
    lambda c: c["inventory"].select(HOST, "hostname").join(K.latest_tasks(c["tasks"]).select(HOST, "task_id"), HOST, "left"))
query("recent_tasks_page", f"select task_id, created_at from tasks where created_at < {NOW} order by created_at desc, task_id desc limit 50", ("tasks",))(
    lambda c: K.recent_tasks(c["tasks"], 50, now()).select("task_id", "created_at"))
query("apply_task_results", """
    select task_id, coalesce(s, status) as status from tasks left join (
      select o_orderkey as task_id, case when o_shippriority_like = 0 then 'success' else 'failure' end as s from (select o_orderkey, o_orderkey % 2 as o_shippriority_like from orders) r) u using (task_id)""", ("tasks",))(
    lambda c: K.apply_results(c["tasks"], _results(c)).select("task_id", "status"))


def _results(c: Context):
    """Result messages for all orders, each sent twice, and some for tasks nobody knows."""
    o = c.table("orders")
    r = o.select(F.explode(F.array(F.col("o_orderkey"), F.col("o_orderkey"), -F.col("o_orderkey") - 1)).alias("task_id"), F.col("o_orderdate").cast("timestamp").alias("completed_at"))
    return r.select("task_id", "completed_at", F.concat(F.lit("m-"), F.col("task_id").cast("string")).alias("message_id"),
                    F.when(F.col("task_id") % 2 == 0, "success").otherwise("failure").alias("status"), F.lit("download_failed").alias("failure_reason"),
                    F.lit(None).cast("int").alias("exit_code"), F.lit(None).cast("boolean").alias("task_policy"), F.lit("linux").alias("os_family"),
                    F.lit("ubuntu").alias("os_id"), F.lit("22.04").alias("os_version"))


# --- selections and jobs ------------------------------------------------------------------------------------------

query("search_ilike_page", "select server_id, hostname from inventory where hostname ilike '%stomer#0000001%' order by hostname, server_id limit 8", ("inventory",))(
    lambda c: S.search(c["inventory"], "STOMER#0000001", 1, 8).select(HOST, "hostname"))
query("column_projection_list", f"select {', '.join(S.LIST_COLUMNS)} from inventory", ("inventory",))(lambda c: S.list_columns(c["inventory"]))
query("duplicate_hostnames", "select hostname, count(*) as hosts from inventory group by 1 having count(*) > 1", ("inventory",))(lambda c: V.duplicate_hostnames(c["inventory"]))


def _tokens(c: Context):
    """Selection tokens taken from the supplier table: some match a host, some do not."""
    s = c.table("supplier")
    k = F.col("s_suppkey").cast("string")
    names = s.select(F.concat(F.lit("Customer#"), F.lpad(k, 9, "0")).alias("token")).unionByName(s.limit(1).select(F.lit("twin-host").alias("token"))).unionByName(
        s.select(F.concat(F.lit("nohost-"), k).alias("token")))
    ips = s.select(F.concat(F.lit("10.0.1."), k).alias("token"))
    pids = s.select(F.concat(F.lit("pub-"), (F.col("s_suppkey") * 20).cast("string")).alias("token"))
    pairs = s.select(F.lit("twin-host").alias("hostname"), F.concat(F.lit("pub-"), k).alias("discriminator"))
    return names, ips, pids, pairs


library("tok", """
    select 'hostname' as kind, 'Customer#' || lpad(s_suppkey::varchar, 9, '0') as token from supplier union all select 'hostname', 'twin-host' union all select 'hostname', 'nohost-' || s_suppkey from supplier
    union all select 'ip', '10.0.1.' || s_suppkey from supplier union all select 'public_id', 'pub-' || (s_suppkey * 20) from supplier union all select 'pair', 'twin-host~pub-' || s_suppkey from supplier""")
library("known", """
    select server_id, 'hostname' as kind, hostname as token from inventory union all select server_id, 'public_id', public_id from inventory
    union all select server_id, 'ip', a.address from (select server_id, unnest(addresses) as a from (select server_id, unnest(net_interfaces).addresses as addresses from inventory) x) y
    union all select server_id, 'pair', hostname || '~' || public_id from inventory""", ("inventory",))
query("selection_match", "select distinct server_id from known join tok using (kind, token)", ("known", "tok"))(lambda c: S.match_tokens(c["inventory"], *_tokens(c)))
query("anti_unmatched_tokens", "select kind, token from tok t where not exists (select 1 from known k where k.kind = t.kind and k.token = t.token)", ("known", "tok"))(
    lambda c: S.unmatched_tokens(c["inventory"], *_tokens(c)))
query("ambiguous_in_filter", "select token from tok where kind = 'hostname' intersect select hostname from inventory group by 1 having count(*) > 1", ("inventory", "tok"))(
    lambda c: S.ambiguous_names(c["inventory"], _tokens(c)[0]))
query("batch_get", "select server_id, public_id, hostname from inventory where public_id in (select token from tok where kind = 'public_id')", ("inventory", "tok"))(
    lambda c: S.batch_get(c["inventory"].select(HOST, "public_id", "hostname"), _tokens(c)[2].withColumnRenamed("token", "public_id")))
query("optional_dimension_filter", "select server_id, device_id, count(*) as samples from disk_io where device_id = 'name:sdb' group by 1, 2", ("disk_io",))(
    lambda c: S.optional_filter(S.optional_filter(c["disk_io"], "device_id", "name:sdb"), "server_id", None).groupBy(HOST, "device_id").agg(F.count("*").alias("samples")))
query("json_key_match", """
    select job_id from report_jobs where json_extract_string(input_params, '$.server_id') in (select token from tok where kind = 'public_id')
      or exists (select 1 from (select unnest(from_json(json_extract(input_params, '$.server_ids'), '["varchar"]')) as p) x where p in (select token from tok where kind = 'public_id'))""", ("report_jobs", "tok"))(
    lambda c: S.jobs_matching(c["report_jobs"], _tokens(c)[2].withColumnRenamed("token", "public_id")).select("job_id"))
query("report_history", f"""
    select job_id, job_type, created_at from report_jobs where scope = 'server' and input_params like '%server_ids%' and created_at > {NOW} - interval 90 day""", ("report_jobs",))(
    lambda c: S.job_history(S.jobs_matching(c["report_jobs"], days=90, now=now()), "all", "selection").select("job_id", "job_type", "created_at"))
query("history_merge_top", "select job_id, created_at from report_jobs order by created_at desc, job_id limit 20", ("report_jobs",))(
    lambda c: S.newest_jobs(S.job_history(c["report_jobs"]), 20).select("job_id", "created_at"))
query("report_retention", f"select job_id from report_jobs where created_at >= {NOW} - interval 90 day", ("report_jobs",))(
    lambda c: S.retained(c["report_jobs"], now(), 90, "created_at").select("job_id"))
query("snapshot_report", "select distinct sha256(scope || '|' || input_params) as input_hash, date_trunc('minute', created_at) as anchor_minute from report_jobs where status = 'running' and sha256(scope || '|' || input_params) || date_trunc('minute', created_at) not in (select sha256(scope || '|' || input_params) || date_trunc('minute', created_at) from report_jobs where status = 'done')", ("report_jobs",))(
    lambda c: _snapshots(c))


def _snapshots(c: Context):
    """Running jobs whose result is not stored yet."""
    j = c["report_jobs"]
    keyed = j.select("status", *S.snapshot_key(F.col("scope"), F.col("input_params"), F.col("created_at")))
    return S.new_snapshots(keyed.filter("status = 'running'").drop("status"), keyed.filter("status = 'done'").drop("status"))


# --- liveness and lists -------------------------------------------------------------------------------------------

library("gaps", f"""
    select m.server_id, last_metric_at, public_id, hostname from (select server_id, max(collected_at) as last_metric_at from host_metrics where collected_at >= {END} - interval 24 hour group by 1) m
    join inventory using (server_id) where last_metric_at < {END} - interval 5 minute and last_metric_at > {END} - interval 24 hour""", ("host_metrics", "inventory"))


def gaps(c: Context):
    return V.metric_gaps(c["host_metrics"], c["inventory"], c.end)


query("metric_gap", "select * from gaps", ("gaps",))(gaps)
query("collection_status", "select server_id, m as last_metric_at, h as last_inventory_at from inventory left join (select server_id, max(collected_at) as m from host_metrics group by 1) a using (server_id) left join (select server_id, max(collected_at) as h from inventory_history group by 1) b using (server_id)",
      ("inventory", "host_metrics", "inventory_history"))(lambda c: V.collection_status(c["host_metrics"], c["inventory_history"], c["inventory"]))
query("latest_metric_at", "select max(collected_at) as last_collected_at from host_metrics", ("host_metrics",))(
    lambda c: V.fleet_status(c["inventory"], c["host_metrics"], c.end).select("last_collected_at"))
query("fleet_status", f"select count(*) as total_count, count(*) filter (where last_seen_at > {END} - interval 300 second) as online_count, (select max(collected_at) from host_metrics) as last_collected_at from inventory", ("inventory", "host_metrics"))(
    lambda c: V.fleet_status(c["inventory"], c["host_metrics"], c.end))
query("online_map", f"select server_id, last_seen_at > {END} - interval 300 second as online from inventory", ("inventory",))(lambda c: c["inventory"].select(HOST, V.online(c.end).alias("online")))
query("future_skew_filter", f"select server_id, max(collected_at) as last_at from host_metrics where collected_at <= timestamp '2024-01-20 00:00:00' + interval 2 minute group by 1", ("host_metrics",))(
    lambda c: N.recent(c["host_metrics"], timestamp("1970-01-01 00:00:00"), timestamp("2024-01-20 00:00:00")).groupBy(HOST).agg(F.max("collected_at").alias("last_at")))

# --- assessed fleet -----------------------------------------------------------------------------------------------

_CLASS = "case host_status when 'under' then 'under_provisioned' when 'over' then 'over_provisioned' when 'insufficient' then 'insufficient_data' else host_status end"
library("assessed", f"""
    select v.*, {_CLASS} as classification, last_seen_at > {END} - interval 300 second as online,
      [case when cpu_status = 'under' and coalesce(cpu_p95 >= 70, false) then 'cpu_util' end, case when cpu_status = 'under' and coalesce(cpu_sat, false) then 'cpu_saturation' end,
       case when coalesce(mem_p95 >= 90, false) then 'mem_util' end, case when coalesce(mem_sat, false) then 'mem_saturation' end,
       case when disk_status = 'filling' then 'disk_capacity' end, case when io_status = 'io_bound' then 'disk_io' end] as causes,
      not low_precision and not (cpu_sat is null or cpu_p95 is null) and not coalesce(steal_p95 >= 5, false) and not coalesce(trend_rising, false) and coalesce(sufficiency >= 0.7, false) as cpu_ok,
      not low_precision and not coalesce(trend_rising, false) and coalesce(sufficiency >= 0.7, false) as mem_ok
    from verdict v""", ("verdict",))
library("targets", """
    select *, case classification when 'under_provisioned' then 0 when 'over_provisioned' then 1 when 'idle' then 2 when 'optimal' then 3 else 4 end as class_rank,
      case when classification = 'under_provisioned' then case when coalesce(mem_sat, false) then 10000.0 else 0.0 end + list_count(causes) * 100.0 + coalesce(greatest(cpu_p95, mem_p95, disk_used_pct), 0)
           else 100.0 - coalesce(greatest(cpu_p95, mem_p95, disk_used_pct), 0) end as severity from assessed""", ("assessed",))


def targets(c: Context):
    return c.once("targets", lambda: V.action_targets(verdict(c)))


query("classification_counts", """
    select classification, class_rank, coalesce(n, 0) as hosts, coalesce(n, 0) * 100.0 / (select count(*) from assessed) as share_pct
    from (values ('under_provisioned', 0), ('over_provisioned', 1), ('idle', 2), ('optimal', 3), ('insufficient_data', 4)) f(classification, class_rank)
    left join (select classification, count(*) as n from assessed group by 1) a using (classification)""", ("assessed",), ("share_pct",))(lambda c: V.classification_counts(verdict(c)))
query("running_offset", """
    select classification, coalesce(sum(share) over (order by class_rank rows between unbounded preceding and 1 preceding), 0) as start_pct from (
      select classification, class_rank, count(t.server_id) * 100.0 / (select count(*) from targets) as share
      from (values ('under_provisioned', 0), ('over_provisioned', 1), ('idle', 2), ('optimal', 3), ('insufficient_data', 4)) f(classification, class_rank) left join targets t using (classification, class_rank) group by 1, 2) s""", ("targets",), ("start_pct",))(
    lambda c: V.share_offsets(V.classification_counts(verdict(c))).select("classification", F.col("offset").cast("double").alias("start_pct")))
query("action_targets", "select server_id, classification, severity, coalesce(array_to_string(causes, ','), '') as causes from targets", ("targets",), ("severity",))(
    lambda c: targets(c).select(HOST, "classification", "severity", F.array_join("causes", ",").alias("causes")))
query("rank_order_classification", "select server_id, hostname, row_number() over (order by class_rank, severity desc, hostname, server_id) as place from targets", ("targets",))(
    lambda c: places(targets(c), [F.col("class_rank"), -F.floor("severity")], [*V.target_order(), F.asc(HOST)]).select(HOST, "hostname", "place"))
query("top_under_hosts", "select server_id, hostname, severity from targets where classification = 'under_provisioned' order by severity desc, hostname limit 3", ("targets",), ("severity",))(
    lambda c: V.top_under(targets(c)).select(HOST, "hostname", "severity"))
query("cause_counts", "select cause, count(*) as hosts from (select unnest(causes) as cause from targets where classification = 'under_provisioned') x where cause is not null group by 1", ("targets",))(lambda c: V.cause_counts(targets(c)))
query("report_totals", """
    select cast(sum(cpu_cores) as bigint) as cores, cast(sum(mem_total_bytes) as bigint) as mem_bytes, (select cast(sum(size_bytes) as bigint) from dev where type = 'disk') as disk_bytes from inventory""", ("inventory", "dev"))(
    lambda c: V.report_totals(c["inventory"]))
query("efficiency_totals", """
    select count(*) as total, count(*) filter (where classification = 'under_provisioned') as under_count, count(*) filter (where classification in ('over_provisioned', 'idle')) as efficiency_count,
           cast(sum(cpu_cores) filter (where classification in ('over_provisioned', 'idle')) as bigint) as efficiency_vcpus,
           cast(sum(mem_total_bytes) filter (where classification in ('over_provisioned', 'idle')) as bigint) as efficiency_mem_bytes,
           cast(sum(disk_bytes) filter (where classification in ('over_provisioned', 'idle')) as bigint) as efficiency_disk_bytes from targets join layers using (server_id)""", ("targets", "layers"))(
    lambda c: V.efficiency_totals(targets(c)))
query("right_sizing_rows", """
    select server_id, hostname, hostname = 'twin-host' as hostname_ambiguous, ip as primary_ip, online, classification, root_cause,
           case classification when 'under_provisioned' then 'provision' when 'over_provisioned' then 'downsize' when 'idle' then 'decommission' when 'insufficient_data' then 'insufficient' else 'maintain' end as kind,
           coalesce(array_to_string([
             case when classification = 'under_provisioned' and mem_status = 'under' then 'memory:increase:' || coalesce(mem_target::bigint::varchar, '-') end,
             case when classification = 'under_provisioned' and cpu_status = 'under' then 'cpu:increase:' || coalesce(cpu_target::bigint::varchar, '-') end,
             case when classification = 'under_provisioned' and disk_status = 'filling' then 'disk_capacity:increase:' || coalesce(disk_target::bigint::varchar, '-') end,
             case when classification = 'over_provisioned' and cpu_status = 'over' and cpu_ok then 'cpu:decrease:' || coalesce(cpu_target::bigint::varchar, '-') end,
             case when classification = 'over_provisioned' and mem_status = 'over' and mem_ok then 'memory:decrease:' || coalesce(mem_target::bigint::varchar, '-') end,
             case when io_status = 'io_bound' then 'disk_io:tier_up:-' end], ','), '') as actions
    from assessed left join (select server_id, arg_min(ip, pos) as ip from (select server_id, pos, unnest(addresses).address as ip from nic) x group by 1) p using (server_id)""", ("assessed", "nic"))(
    lambda c: V.right_sizing_rows(verdict(c), c.end).select(
        HOST, "hostname", "hostname_ambiguous", "primary_ip", "online", "classification", "root_cause", "kind",
        F.expr("array_join(transform(actions, a -> concat_ws(':', a.resource, a.op, coalesce(cast(a.target as string), '-'))), ',')").alias("actions")))
_AX = """select server_id, '{a}' as axis, cast(null as varchar) as mountpoint, cast({cur} as bigint) as current,
    cast(case when {p}_status = 'under' then coalesce({p}_target, {p}_floor) when {p}_status = 'over' and {p}_ok then {p}_target else {cur} end as bigint) as recommended,
    case when {p}_status = 'under' then 'increase' when {p}_status = 'over' and {p}_ok then 'decrease' else 'keep' end as action,
    case when {p}_status = 'under' then case when {p}_target is not null then 'exact' else 'floor' end when {p}_status = 'unmeasured' then 'uncertain' else 'exact' end as estimate_quality from assessed"""
library("axes", _AX.format(a="cpu", p="cpu", cur="cpu_cores") + " union all " + _AX.format(a="memory", p="mem", cur="mem_total_mb") + """
    union all select server_id, 'disk', mountpoint, current_gib, case when f and target_raw is not null then greatest(current_gib, cast(ceil(ceil(target_raw) / 1073741824) as bigint))
             when f then greatest(current_gib, cast(ceil(current_gib / 0.7) as bigint)) else current_gib end,
           case when f and (target_raw is null or ceil(ceil(target_raw) / 1073741824) > current_gib) then 'increase' else 'keep' end, case when f and target_raw is null then 'floor' else 'exact' end
    from (select *, cast(ceil(total_bytes / 1073741824) as bigint) as current_gib, coalesce(byte_runway_days < 30, false) or (byte_runway_days is null and used_pct >= 85) as f from mount_calc) m""", ("assessed", "mount_calc"))


def mounts(c: Context):
    return P.mount_capacity(rolls(c).filesystem_history)


query("sizing_axes", "select * from axes", ("axes",))(lambda c: V.sizing_axes(verdict(c), mounts(c)))
library("asmt", """
    select server_id, classification, case when classification = 'insufficient_data' then 'low'
      when low_precision or cpu_sat is null or cpu_p95 is null or mem_status = 'unmeasured' or disk_status = 'unmeasured' or io_status = 'unmeasured' or net_status = 'unmeasured'
        or coalesce(steal_p95 >= 5, false) or coalesce(trend_rising, false) then 'medium' else 'high' end as confidence,
      case root_cause when 'disk_capacity' then 'disk' else root_cause end as root_cause, case when io_status = 'io_bound' then 'high_iops' end as disk_io_tier_hint, n as axes
    from assessed left join (select server_id, count(*) as n from axes group by 1) a using (server_id)""", ("assessed", "axes"))
query("assessment_rows", "select * from asmt", ("asmt",))(
    lambda c: V.assessment_rows(verdict(c), mounts(c), c.end).select(
        HOST, "assessment.classification", "assessment.confidence", "diagnostics.root_cause", "diagnostics.disk_io_tier_hint", F.size("sizing.axes").alias("axes")))
query("export_assessment_json", "select server_id, classification, confidence, axes from asmt", ("asmt",))(
    lambda c: V.export_documents(V.assessment_rows(verdict(c), mounts(c), c.end), 14, c.end).select(
        HOST, F.get_json_object("document", "$.assessment.classification").alias("classification"), F.get_json_object("document", "$.assessment.confidence").alias("confidence"),
        F.json_array_length(F.get_json_object("document", "$.sizing.axes")).alias("axes")))
library("overview", f"""
    select count(*) as hosts, count(*) filter (where online) as online, cast(sum(cpu_cores) as bigint) as cores, cast(sum(mem_total_bytes) as bigint) as mem_bytes,
           {', '.join(f"count(*) filter (where classification = '{k}') as {k}" for k in rules.CLASS_ORDER)},
           count(*) filter (where cpu_sat) as cpu_saturated, count(*) filter (where mem_sat) as mem_saturated, count(*) filter (where io_status = 'io_bound') as disk_saturated,
           count(*) filter (where net_status = 'congested') as net_congested from assessed""", ("assessed",))
query("environment_overview", """
    select o.*, e.*, (select count(*) from os_support where support in ('paid_only', 'ended')) as eol_passed, (select count(*) from os_support where support = 'security_only') as eol_security_only,
           (select count(*) from os_support where support = 'unknown') as eol_unknown, (select count(*) from os_support where support = 'full') as eol_supported from overview o, env_util e""",
      ("overview", "env_util", "os_support"), ("cpu_avg", "mem_avg", "cpu_p95", "mem_p95", "disk_avg"))(
    lambda c: V.environment_overview(verdict(c), P.environment_utilization(rolls(c)), _support_counts(c), c.end))


def _support_counts(c: Context):
    return support(c).groupBy("support").agg(F.count("*").alias("hosts"))


library("rep", f"""
    select *, case classification when 'under_provisioned' then 'high' when 'idle' then 'attention' when 'over_provisioned' then 'attention' else 'normal' end as risk_level,
           case when cpu_p95 > 0 and cpu_peak <> 0 then cpu_peak / cpu_p95 end as cpu_variance, case when mem_p95 > 0 and mem_peak <> 0 then mem_peak / mem_p95 end as mem_variance,
           greatest(0, cast(floor((epoch({END}) - epoch(boot_time)) / 86400) as bigint)) as uptime_days
    from assessed""", ("assessed",))
library("rep_rows", """
    select *, case risk_level when 'high' then 0 when 'attention' then 1 else 2 end as risk_rank,
      case when classification = 'insufficient_data' then case when not online then 'offline' else 'missing:' || array_to_string([case when cpu_p95 is null then 'cpu_p95' end, case when mem_p95 is null then 'mem_p95' end,
             case when run_queue_p95 is null then 'run_queue_p95' end, case when await_p95_ms is null then 'await_p95_ms' end, case when disk_used_pct is null then 'disk_used_pct' end], ',') end
        when mem_status = 'under' and (coalesce(mem_sat, false) or oom_occurred) then 'memory_shortage' when io_status = 'io_bound' then 'disk_io_bottleneck'
        when cpu_status = 'under' and coalesce(cpu_sat, false) then 'cpu_saturation' when mem_status = 'under' and mem_p95 >= 90 then 'memory_pressure'
        when cpu_status = 'under' and cpu_p95 >= 70 then 'cpu_pressure' when disk_status = 'filling' then 'disk_filling' when net_status = 'congested' then 'network_congested'
        when (cpu_variance >= 1.5 and cpu_peak > 30) or (mem_variance >= 1.5 and mem_peak > 50) then 'bursty' when host_status = 'idle' then 'idle' when host_status = 'over' then 'spare' else 'normal' end as diagnosis
    from rep""", ("rep",))


def rep(c: Context):
    return c.once("report_rows", lambda: V.report_rows(verdict(c), c.end))


query("report_rows", "select server_id, risk_level, diagnosis, cpu_variance, mem_variance, uptime_days, online from rep_rows", ("rep_rows",), ("cpu_variance", "mem_variance"))(
    lambda c: rep(c).select(HOST, "risk_level", "diagnosis", "cpu_variance", "mem_variance", "uptime_days", "online"))
query("report_row_order", "select server_id, row_number() over (order by risk_rank, coalesce(cpu_p95, 0) desc, hostname, server_id) as place from rep_rows", ("rep_rows",))(
    lambda c: places(rep(c), [F.col("risk_rank"), -F.floor(F.coalesce("cpu_p95", F.lit(0.0)))], [*V.report_order(), F.asc(HOST)]).select(HOST, "place"))
query("top_risks", "select server_id, risk_level, cpu_p95 from rep_rows where risk_level = 'high'", ("rep_rows",), ("cpu_p95",))(
    lambda c: V.top_risks(rep(c), "customer").select(HOST, "risk_level", "cpu_p95"))
query("top_risks_engineer", "select server_id, risk_level from rep_rows order by risk_rank, coalesce(cpu_p95, 0) desc, hostname limit 10", ("rep_rows",))(
    lambda c: V.top_risks(rep(c), "engineer", limit=10).select(HOST, "risk_level"))
query("capacity_imminent", "select server_id, hostname, driving_mount, cast(floor(runway_days) as bigint) as days_until_full, disk_used_pct from rep_rows where runway_days < 30 and driving_mount is not null", ("rep_rows",), ("disk_used_pct",))(
    lambda c: V.capacity_imminent(rep(c)))
query("report_kpis", """
    select count(*) as total, count(*) filter (where online) as online, count(*) filter (where risk_level = 'high') as high_count, count(*) filter (where risk_level = 'attention') as attention_count,
           count(*) filter (where risk_level = 'normal') as normal_count, avg(cpu_p95) as avg_cpu_p95, avg(mem_p95) as avg_mem_p95 from rep_rows""", ("rep_rows",), ("avg_cpu_p95", "avg_mem_p95"))(lambda c: V.report_kpis(rep(c)))
query("avg_of_p95", "select avg(cpu_p95) as avg_cpu_p95, avg(mem_p95) as avg_mem_p95 from host_stat", ("host_stat",), ("avg_cpu_p95", "avg_mem_p95"))(
    lambda c: P.host_stats(rolls(c).host).agg(F.avg("cpu_p95").alias("avg_cpu_p95"), F.avg("mem_p95").alias("avg_mem_p95")))
query("burst_hosts", "select server_id from rep_rows where cpu_variance >= 1.5 and cpu_peak > 30", ("rep_rows",))(lambda c: V.burst_hosts(rep(c)).select(HOST))
query("reboot_hosts", "select server_id, reboot_count from rep_rows where reboot_count >= 3", ("rep_rows",))(lambda c: V.reboot_hosts(rep(c)).select(HOST, "reboot_count"))
library("roles", "select server_id, coalesce(role, 'unknown') as role from inventory left join (select server_id, category as role from work qualify row_number() over (partition by server_id order by instances desc, category) = 1) r using (server_id)", ("inventory", "work"))
query("role_avg_max", "select role, avg(cpu_p95) as avg_cpu_p95 from host_stat join roles using (server_id) where cpu_p95 is not null group by 1 order by 2 desc, 1 limit 1", ("host_stat", "roles"), ("avg_cpu_p95",))(
    lambda c: V.busiest_role(P.host_stats(rolls(c).host).select(HOST, "cpu_p95"), C.infer_role(C.workload_counts(c["inventory"]), c["inventory"]), 0.0))
query("distribution_desc", "select segment, count(*) as hosts, count(*) * 100.0 / max(count(*)) over () as pct_of_max from inventory group by 1", ("inventory",), ("pct_of_max",))(lambda c: V.distribution(c["inventory"], "segment"))
query("os_three_level_counts", "select os_family, os_id, os_version, count(*) as hosts, string_agg(distinct kernel_version, ',' order by kernel_version) as kernels from inventory group by 1, 2, 3", ("inventory",))(lambda c: V.os_counts(c["inventory"]))
_PER = [("cpu", "utilization", "cpu_p95", "cpu_p95", "70.0", ">="), ("memory", "utilization", "mem_p95", "mem_p95", "90.0", ">="), ("storage", "utilization", "disk_used_pct", "disk_used_pct", "85.0", ">="),
        ("cpu", "saturation", "run_queue", "run_queue_p95 / cpu_cores", "case when os_family = 'windows' then 2.0 else 1.0 end", ">="), ("storage", "saturation", "await_ms", "await_p95_ms", "20.0", ">"),
        ("network", "saturation", "retrans_pct", "retrans_pct", "1.0", ">="), ("network", "saturation", "drop_pct", "drop_pct", "0.5", ">="), ("network", "saturation", "conntrack_ratio", "conntrack_ratio", "0.8", ">=")]
query("period_assessment", " union all ".join(f"select server_id, '{r}' as resource, '{k}' as kind, '{n}' as key, cast({v} as double) as value, cast({t} as double) as threshold, coalesce({v} {op} {t}, false) as over, {v} is not null as measured from assessed" for r, k, n, v, t, op in _PER),
      ("assessed",), ("value", "threshold"))(lambda c: V.period_assessment(verdict(c)))
library("attn", f"""
    select server_id, hostname, kind, detail from (
      select server_id, 'gap' as kind, strftime(last_metric_at, '%Y-%m-%d %H:%M:%S') as detail from gaps
      union all select server_id, 'os_eol', eol::varchar from os_support where support in ('paid_only', 'ended')
      union all select server_id, 'restart', n::varchar from (select server_id, count(distinct agent_started_at) - 1 as n from inventory_history
        where collected_at >= {END} - interval 1 hour and collected_at <= {END} group by 1) r where n >= 3) s join inventory using (server_id)""", ("gaps", "os_support", "inventory_history", "inventory"))


def signals(c: Context):
    return V.attention_signals(gaps(c), support(c), P.restart_counts(c["inventory_history"], shift(c.end, -3600), c.end), c["inventory"])


query("attention_rows", "select * from attn", ("attn",))(signals)
query("attention_signals", """
    select server_id, hostname, max(detail) filter (where kind = 'gap') as gap, max(detail) filter (where kind = 'os_eol') as os_eol, max(detail) filter (where kind = 'restart') as restart, count(distinct kind) as active_count from attn group by 1, 2""", ("attn",))(
    lambda c: V.attention_hosts(signals(c)))
query("attention_limit_each", "select server_id, kind from attn qualify row_number() over (partition by kind order by hostname, server_id) <= 5", ("attn",))(lambda c: V.attention_limit(signals(c), 5).select(HOST, "kind"))
query("attention_selection_filter", "select server_id, kind from attn where hostname in (select token from tok where kind = 'hostname')", ("attn", "tok"))(
    lambda c: V.attention_of(signals(c), _tokens(c)[0].withColumnRenamed("token", "hostname")).select(HOST, "kind"))
library("slist", """
    select a.server_id, public_id, hostname, os_family, cpu_cores, online, classification, support, e.server_id is not null as has_event, last_status as last_task_status
    from assessed a left join os_support using (server_id) left join err_hosts e using (server_id) left join (select server_id, status as last_status from last_task) t using (server_id)""", ("assessed", "os_support", "err_hosts", "last_task"))


def slist(c: Context):
    return c.once("server_list", lambda: V.server_list(verdict(c), support(c), E.error_hosts(c.fleet, c.start, c.end), K.latest_tasks(c["tasks"]), c.end))


query("server_list", "select server_id, public_id, hostname, os_family, cpu_cores, online, classification, support, has_event, last_task_status from slist", ("slist",))(
    lambda c: slist(c).drop("os_label", "mem_gb"))
query("server_list_filter", "select server_id, hostname, row_number() over (order by lower(hostname), server_id) as place from slist where online and os_family = 'linux' and support in ('paid_only', 'ended')", ("slist",))(
    lambda c: places(V.list_filter(slist(c), True, None, "passed", "linux"), [F.substring(F.lower("hostname"), 1, 14)], V.list_order()).select(HOST, "hostname", "place"))
query("host_report_bundle", """
    select a.server_id, classification, cpu_p95, used_pct, user_pct, oom, reboot_count from assessed a left join (select server_id, avg(mem_pct_avg) as used_pct from host_bkt group by 1) m using (server_id)
    left join (select server_id, avg(d_cpu_user_s / d_cpu_total_s * 100) filter (where d_cpu_total_s > 0) as user_pct from host_bkt group by 1) u using (server_id) left join errs using (server_id)""",
      ("assessed", "host_bkt", "errs"), ("cpu_p95", "used_pct", "user_pct"))(
    lambda c: verdict(c).select(HOST, "classification", "cpu_p95", "reboot_count").join(P.memory_breakdown(rolls(c).host).select(HOST, "used_pct"), HOST, "left").join(
        P.cpu_breakdown(rolls(c).host).select(HOST, "user_pct"), HOST, "left").join(errors(c).select(HOST, "oom"), HOST, "left"))
query("environment_report", """
    select 'class:' || classification as section, count(*) as hosts from assessed group by 1 union all select 'cause:' || cause, count(*) from (select unnest(causes) as cause from targets where classification = 'under_provisioned') x where cause is not null group by 1
    union all select 'support:' || support, count(*) from os_support group by 1 union all select 'attention:' || kind, count(*) from attn group by 1
    union all select 'imminent', count(*) from rep_rows where runway_days < 30 and driving_mount is not null""", ("assessed", "targets", "os_support", "attn", "rep_rows"))(
    lambda c: _environment_report(c))


def _environment_report(c: Context):
    """The counted sections of the fleet report in one long table."""
    def part(prefix, df, key):
        return df.groupBy(key).agg(F.count("*").alias("hosts")).select(F.concat(F.lit(prefix + ":"), F.col(key)).alias("section"), "hosts")

    t = targets(c)
    under = t.filter(F.col("classification") == "under_provisioned").select(F.explode("causes").alias("cause"))
    soon = rep(c).filter((F.col("runway_days") < 30) & F.col("driving_mount").isNotNull()).agg(F.count("*").alias("hosts"))
    return (part("class", t, "classification").unionByName(part("cause", under, "cause")).unionByName(part("support", support(c), "support"))
            .unionByName(part("attention", signals(c), "kind")).unionByName(soon.select(F.lit("imminent").alias("section"), "hosts")))


# --- many selections ----------------------------------------------------------------------------------------------

library("sel_tok", "select kind as selection, kind, token from tok union all select kind || ':' || token, kind, token from tok", ("tok",))
library("members", "select distinct selection, server_id from known join sel_tok using (kind, token) union all select '*', server_id from inventory", ("known", "sel_tok", "inventory"))
library("sections", """
    select server_id, 'class:' || classification as section from assessed
    union all select server_id, 'cause:' || cause from (select server_id, unnest(causes) as cause from targets where classification = 'under_provisioned') x where cause is not null
    union all select server_id, 'support:' || support from os_support union all select distinct server_id, 'attention:' || kind from attn
    union all select server_id, 'imminent' from rep_rows where runway_days < 30 and driving_mount is not null""", ("assessed", "targets", "os_support", "attn", "rep_rows"))


def selected_tokens(c: Context):
    """A selection for each kind of token, and one for each token."""
    names, ips, pids, pairs = _tokens(c)
    pairs = pairs.select(F.concat_ws("~", "hostname", "discriminator").alias("token"))
    tokens = None
    for kind, df in (("hostname", names), ("ip", ips), ("public_id", pids), ("pair", pairs)):
        df = df.select(F.explode(F.array(F.lit(kind), F.concat(F.lit(kind + ":"), "token"))).alias("selection"), F.lit(kind).alias("kind"), "token")
        tokens = df if tokens is None else tokens.unionByName(df)
    return tokens


def _written(c: Context, name: str, build):
    """A table written once for all reports."""
    def table():
        path = work_folder(c.spark, name)
        build().write.parquet(path)
        return c.spark.read.parquet(path)

    return c.once(name, table)


def facts(c: Context):
    return _written(c, "host-facts", lambda: M.host_facts(c["inventory"], V.report_rows(targets(c), c.end), support(c), signals(c)))


def assessed_rows(c: Context):
    with held(c.spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):  # tables of all hosts, in small files, would pass through the driver
        return _written(c, "assessment-rows", lambda: V.assessment_rows(verdict(c), mounts(c), c.end))


def members(c: Context):
    return M.selection_members(c["inventory"], selected_tokens(c))


query("selection_report_counts", "select selection, section, count(*) as hosts from sections join members using (server_id) where section is not null group by 1, 2", ("sections", "members"))(
    lambda c: M.section_counts(facts(c), members(c)))
query("selection_report_summary", """
    select selection, coalesce(hosts, 0) as hosts, cpu_cores, cpu_p95_avg, cpu_p95_max, mem_p95_avg, coalesce(under_count, 0) as under_count, coalesce(efficiency_count, 0) as efficiency_count,
           coalesce(high_risk, 0) as high_risk, coalesce(tokens, 0) as tokens, coalesce(unmatched, 0) as unmatched
    from (select selection, count(*) as tokens, count(*) filter (where not exists (select 1 from known k where k.kind = t.kind and k.token = t.token)) as unmatched
          from (select distinct * from sel_tok) t group by 1) a
    full join (select selection, count(*) as hosts, cast(sum(i.cpu_cores) as bigint) as cpu_cores, avg(cpu_p95) as cpu_p95_avg, max(cpu_p95) as cpu_p95_max, avg(mem_p95) as mem_p95_avg,
                 count(*) filter (where classification = 'under_provisioned') as under_count, count(*) filter (where classification in ('over_provisioned', 'idle')) as efficiency_count,
                 count(*) filter (where risk_level = 'high') as high_risk
               from members join inventory i using (server_id) left join (select server_id, cpu_p95, mem_p95, classification, risk_level from rep_rows) r using (server_id) group by 1) b using (selection)""",
      ("known", "sel_tok", "members", "inventory", "rep_rows"), ("cpu_p95_avg", "cpu_p95_max", "mem_p95_avg"))(
    lambda c: M.selection_summary(facts(c), members(c), M.selection_tokens(c["inventory"], selected_tokens(c))).drop("mem_total_bytes"))
query("selection_report_top", """
    select selection, server_id, i.hostname, risk_level, row_number() over (partition by selection order by risk_rank nulls last, coalesce(cpu_p95, 0) desc, i.hostname, server_id) as place
    from members join inventory i using (server_id) left join (select server_id, risk_level, risk_rank, cpu_p95 from rep_rows) r using (server_id) qualify place <= 3""",
      ("members", "inventory", "rep_rows"))(lambda c: M.top_hosts(facts(c), members(c), 3).select("selection", HOST, "hostname", "risk_level", "place"))


def _envelopes(c: Context):
    """The header documents read back into columns, with the documents of each selection counted."""
    e = M.assessment_envelopes(assessed_rows(c), c["inventory"], members(c), selected_tokens(c), 14, c.end, c.end)

    def text(key):
        return F.array_join(F.from_json(F.get_json_object("document", f"$.{key}"), "array<string>"), ",")

    heads = e.filter("part = 'envelope'").select(
        "selection", F.get_json_object("document", "$.count").cast("bigint").alias("hosts"), F.get_json_object("document", "$.window.days").cast("bigint").alias("days"),
        F.substring(F.get_json_object("document", "$.window.start"), 1, 10).alias("window_start"), text("filter.ip").alias("ips"),
        *[text(f"warnings.{k}").alias(k) for k in ("ambiguous_hostnames", "unresolved_pairs", "unmatched_filters")])
    docs = e.filter("part = 'server'").groupBy("selection").agg(F.count(F.get_json_object("document", "$.assessment.classification")).alias("documents"))
    return heads.join(M.spread(docs), "selection", "left").fillna(0, ["documents"])


query("assessment_envelopes", f"""
    select selection, coalesce(hosts, 0) as hosts, 14 as days, strftime({END} - interval 14 day, '%Y-%m-%d') as window_start, coalesce(ips, '') as ips, coalesce(ambiguous_hostnames, '') as ambiguous_hostnames,
           coalesce(unresolved_pairs, '') as unresolved_pairs, coalesce(unmatched_filters, '') as unmatched_filters, coalesce(hosts, 0) as documents
    from (select selection, string_agg(token, ',' order by token) filter (where kind = 'ip') as ips, string_agg(token, ',' order by token) filter (where kind = 'hostname' and n > 1) as ambiguous_hostnames,
                 string_agg(token, ',' order by token) filter (where kind = 'pair' and n = 0) as unresolved_pairs, string_agg(token, ',' order by token) filter (where kind <> 'pair' and n = 0) as unmatched_filters
          from (select *, (select count(distinct server_id) from known k where k.kind = t.kind and k.token = t.token) as n from (select distinct * from sel_tok) t) u group by 1) a
    full join (select selection, count(*) as hosts from members join (select server_id from asmt) x using (server_id) group by 1) b using (selection)""", ("sel_tok", "known", "members", "asmt"))(_envelopes)
