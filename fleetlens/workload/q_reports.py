"""Rollups, window statistics, capacity, baselines and rule outcomes over the bound fleet."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from fleetlens.fleet import Fleet
from fleetlens.functions import rules
from fleetlens.functions.exprs import timestamp
from fleetlens.operators import reports as P
from fleetlens.operators import rollups as R
from fleetlens.sources.rollup_store import ROLLUPS, RollupStore
from fleetlens.sources.series_index import SeriesIndex
from fleetlens.streaming.streams import work_folder
from fleetlens.workload.registry import Context, library, query
from fleetlens.workload.q_trends import END, START, VOLUME

HOST = "server_id"
DAY = "date_trunc('day', collected_at)"


def _inc(cols, keys):
    """Reset-safe increments inside a day, written with plain windows."""
    w = f"over (partition by {keys}, {DAY} order by collected_at)"
    return ", ".join(
        f"case when {c} is null then null when lag({c} ignore nulls) {w} is null then 0 "
        f"when {c} >= lag({c} ignore nulls) {w} then {c} - lag({c} ignore nulls) {w} else {c} end as i_{c}" for c in cols)


def _sums(cols, kind):
    return ", ".join(f"cast(sum(i_{c}) as {kind}) as d_{c}" for c in cols)


_HD = ("cpu_total_s", "cpu_idle_s", "cpu_user_s", "cpu_system_s", "cpu_iowait_s", "cpu_steal_s")
_HL = ("paging_major", "paging_out", "paging_in", "mem_oom_kill", "net_tcp_retransmits", "cpu_mce")
_MEM = "case when mem_limit_bytes > 0 and mem_available_bytes is not null then (1 - mem_available_bytes / mem_limit_bytes) * 100 end"
_COMMIT = "case when mem_commit_limit_bytes > 0 then mem_commit_usage_bytes / mem_commit_limit_bytes * 100 end"
_TRACK = "case when net_conntrack_limit > 0 then net_conntrack_usage / net_conntrack_limit end"
library("host_roll", f"""
    select server_id, {DAY} as bucket, {_sums(_HD, 'double')}, {_sums(_HL, 'bigint')},
           epoch(max(collected_at) filter (where paging_in is not null)) - epoch(min(collected_at) filter (where paging_in is not null)) as td_paging_in,
           avg({_MEM}) as mem_pct_avg, max({_MEM}) as mem_pct_max, count({_MEM}) as mem_sample,
           avg({_COMMIT}) as commit_pct_avg, max({_COMMIT}) as commit_pct_max,
           avg(cpu_run_queue) as run_queue_avg, max(cpu_run_queue) as run_queue_max,
           avg(cpu_blocked) as blocked_avg, max(cpu_blocked) as blocked_max,
           avg({_TRACK}) as conntrack_avg, max({_TRACK}) as conntrack_max,
           max(mem_hardware_corrupted_bytes) as corrupted_max,
           avg(mem_available_bytes) as mem_available_avg, avg(mem_limit_bytes) as mem_limit_avg,
           avg(mem_cached_bytes / mem_limit_bytes * 100) as mem_cached_pct_avg,
           avg(mem_buffered_bytes / mem_limit_bytes * 100) as mem_buffered_pct_avg, count(*) as sample_count
    from (select *, {_inc(_HD + _HL, 'server_id')} from (select *, total as cpu_total_s from cpu_total) t) x group by 1, 2""",
        ("cpu_total",))
_FU = "case when used_bytes + free_bytes > 0 then used_bytes / (used_bytes + free_bytes) * 100 end"
_FI = "case when inodes_used + inodes_free > 0 then inodes_used / (inodes_used + inodes_free) * 100 end"
library("fs_roll", f"""
    select server_id, mountpoint, {DAY} as bucket, max({_FU}) as used_pct_max, avg({_FU}) as used_pct_avg,
           max(used_bytes + free_bytes) as total_bytes_max, arg_min(free_bytes, collected_at) as free_first,
           arg_max(free_bytes, collected_at) as free_last, max({_FI}) as inode_pct_max,
           arg_min(inodes_free, collected_at) as inode_free_first, arg_max(inodes_free, collected_at) as inode_free_last,
           arg_max(fstype, collected_at) as fstype, count(*) as sample_count
    from filesystem group by 1, 2, 3""", ("filesystem",))
_DL = ("io_read_bytes", "io_write_bytes", "ops_read", "ops_write")
_DD = ("op_read_time_s", "op_write_time_s", "io_time_s")
library("disk_roll", f"""
    select server_id, device_id, {DAY} as bucket, {_sums(_DL, 'bigint')}, {_sums(_DD, 'double')},
           epoch(max(collected_at)) - epoch(min(collected_at)) as td_io_time_s,
           epoch(max(collected_at)) - epoch(min(collected_at)) as td_ops_read,
           avg(pending_ops) as pending_avg, max(pending_ops) as pending_max, count(*) as sample_count
    from (select *, {_inc(_DL + _DD, 'server_id, device_id')} from disk_io) x group by 1, 2, 3""", ("disk_io",))
_NL = ("rx_bytes", "tx_bytes", "rx_packets", "tx_packets", "rx_dropped", "tx_dropped", "rx_errors", "tx_errors")
library("net_roll", f"""
    select server_id, iface_id, {DAY} as bucket, {_sums(_NL, 'bigint')},
           epoch(max(collected_at)) - epoch(min(collected_at)) as td_rx_bytes, max(link_speed_bps) as link_max,
           count(*) as sample_count
    from (select *, {_inc(_NL, 'server_id, iface_id')} from net_io) x group by 1, 2, 3""", ("net_io",))
library("core_roll", f"""
    select server_id, core_id, {DAY} as bucket, {_sums(('cpu_total_s', 'cpu_idle_s'), 'double')}, count(*) as sample_count
    from (select *, {_inc(('cpu_total_s', 'cpu_idle_s'), 'server_id, core_id')}
          from (select *, cpu_user_s + cpu_system_s + cpu_idle_s as cpu_total_s from cpu_core) t) x group by 1, 2, 3""", ("cpu_core",))

_HOST_FLOATS = tuple(f"d_{c}" for c in _HD) + (
    "td_paging_in", "mem_pct_avg", "mem_pct_max", "commit_pct_avg", "commit_pct_max", "run_queue_avg", "run_queue_max",
    "blocked_avg", "blocked_max", "conntrack_avg", "conntrack_max", "mem_cached_pct_avg", "mem_buffered_pct_avg",
    "mem_available_avg", "mem_limit_avg")


def _gib(df, *cols):
    return df.withColumns({c: F.col(c) / F.lit(float(1 << 30)) for c in cols})


query("rollup_host_5m", "select * replace (mem_available_avg / 1073741824 as mem_available_avg, mem_limit_avg / 1073741824 as mem_limit_avg) from host_roll",
      ("host_roll",), _HOST_FLOATS)(lambda c: _gib(R.rollup_host(c["host_metrics"], c.width), "mem_available_avg", "mem_limit_avg"))
query("rollup_filesystem_5m", "select * from fs_roll", ("fs_roll",), ("used_pct_max", "used_pct_avg", "inode_pct_max"))(
    lambda c: R.rollup_filesystem(c["filesystem"], c.width))
query("rollup_disk_5m", "select * from disk_roll", ("disk_roll",), tuple(f"d_{c}" for c in _DD) + (
    "td_io_time_s", "td_ops_read", "pending_avg", "pending_max"))(lambda c: R.rollup_disk(c["disk_io"], c.width))
query("rollup_net_5m", "select * from net_roll", ("net_roll",), ("td_rx_bytes",))(lambda c: R.rollup_net(c["net_io"], c.width))
query("rollup_core_5m", "select * from core_roll", ("core_roll",), ("d_cpu_total_s", "d_cpu_idle_s"))(
    lambda c: R.rollup_core(c["cpu_core"], c.width))
# the width the tables are made for: five minutes
query("rollup_host_300s", """
    select server_id, time_bucket(interval '5 minutes', collected_at) as bucket, count(*) as sample_count,
           avg(cpu_run_queue) as run_queue_avg from host_metrics group by 1, 2""", ("host_metrics",), ("run_queue_avg",))(
    lambda c: R.rollup_host(c["host_metrics"], "5m").select(HOST, "bucket", "sample_count", "run_queue_avg"))


def rolls(c: Context) -> P.Rollups:
    return P.Rollups(c.fleet, c.start, c.end, c.width, c.plans.setdefault("rollup_tables", {}))


_BW = f"bucket >= {START} and bucket <= {END}"
library("host_bkt", f"""
    select *, case when d_cpu_total_s > 0 then greatest(0, (1 - d_cpu_idle_s / d_cpu_total_s) * 100) end as cpu_pct,
           case when d_cpu_total_s > 0 then greatest(0, d_cpu_iowait_s / d_cpu_total_s * 100) end as iowait_pct,
           case when d_cpu_total_s > 0 then greatest(0, d_cpu_steal_s / d_cpu_total_s * 100) end as steal_pct,
           case when td_paging_in > 0 then greatest(0, d_paging_in / td_paging_in) end as pages_rate
    from host_roll where {_BW}""", ("host_roll",))
library("host_stat", """
    select server_id, quantile_cont(cpu_pct, 0.95) as cpu_p95, quantile_cont(cpu_pct, 0.5) as cpu_median, avg(cpu_pct) as cpu_avg,
           max(cpu_pct) as cpu_peak, count(cpu_pct) as cpu_sample, count(*) as total_buckets,
           quantile_cont(iowait_pct, 0.95) as iowait_p95, max(iowait_pct) as iowait_peak,
           quantile_cont(run_queue_avg, 0.95) as run_queue_p95, quantile_cont(pages_rate, 0.95) as pages_in_p95,
           quantile_cont(mem_pct_avg, 0.95) as mem_p95, quantile_cont(mem_pct_max, 0.95) as mem_near_peak,
           avg(mem_pct_avg) as mem_avg, max(mem_pct_max) as mem_peak, count(mem_pct_avg) as mem_sample,
           quantile_cont(steal_pct, 0.95) as steal_p95, quantile_cont(blocked_avg, 0.95) as blocked_p95,
           bool_or(coalesce(d_paging_major, 0) > 0) as swap_paging, bool_or(coalesce(d_mem_oom_kill, 0) > 0) as oom_occurred,
           cast(sum(d_net_tcp_retransmits) as bigint) as retrans_total, max(conntrack_max) as conntrack_ratio,
           case when count(cpu_pct) > 1 then regr_slope(cpu_pct, epoch(bucket)) * 86400 end as cpu_slope,
           case when count(mem_pct_avg) > 1 then regr_slope(mem_pct_avg, epoch(bucket)) * 86400 end as mem_slope
    from host_bkt group by 1""", ("host_bkt",))
library("worst", f"""
    select server_id, max(u) as disk_used_pct, max(i) as inode_used_pct, arg_max(mountpoint, (u, -rk)) as worst_mount
    from (select *, row_number() over (partition by server_id order by mountpoint) as rk from (
            select server_id, mountpoint, max(used_pct_max) as u, max(inode_pct_max) as i from fs_roll
            where {_BW} and {VOLUME} group by 1, 2) m) n group by 1""", ("fs_roll",))
library("mount_calc", f"""
    select *, case when total_bytes > 0 then (1 - av_last / total_bytes) * 100 end as used_pct,
           case when fall > 0 and span_days >= 1.25 and av_last >= 0 then floor(av_last / (fall / span_days)) end as byte_runway_days,
           case when in_first - in_last > 0 and span_days >= 1.25 and in_last >= 0
                then floor(in_last / ((in_first - in_last) / span_days)) end as inode_runway_days,
           case when fall > 0 and span_days >= 14 and total_bytes > 0 then (total_bytes - av_last) + 365 * (fall / span_days)
                when fall > 0 and span_days >= 1.25 and total_bytes > 0 then ((total_bytes - av_last) + 30 * (fall / span_days)) / 0.7
                when total_bytes > 0 and (1 - av_last / total_bytes) * 100 >= 85 then (total_bytes - av_last) / 0.7 end as target_raw,
           case when fall > 0 and span_days >= 1.25 and total_bytes > 0
                then (1 - (av_last - 30 * (fall / span_days)) / total_bytes) * 100 end as proj_30d_pct
    from (select server_id, mountpoint, arg_min(free_first, bucket) as av_first, arg_max(free_last, bucket) as av_last,
                 arg_min(free_first, bucket) - arg_max(free_last, bucket) as fall, max(total_bytes_max) as total_bytes,
                 arg_min(inode_free_first, bucket) as in_first, arg_max(inode_free_last, bucket) as in_last,
                 max(inode_pct_max) as inode_used_pct, (epoch(max(bucket)) - epoch(min(bucket))) / 86400.0 as span_days
          from fs_roll where bucket <= {END} and {VOLUME} group by 1, 2) s""", ("fs_roll",))
library("runway", """
    select server_id, runway_days, inode_runway_days, driving_mount, target_gb, proj_30d_pct, driving_used_pct
    from (select server_id, min(byte_runway_days) as runway_days, min(inode_runway_days) as inode_runway_days from mount_calc group by 1) r
    left join (select server_id, mountpoint as driving_mount, ceil(target_raw / 1e9) as target_gb, proj_30d_pct, used_pct as driving_used_pct
               from mount_calc where byte_runway_days is not null or used_pct >= 85
               qualify row_number() over (partition by server_id order by byte_runway_days asc nulls last, used_pct desc nulls last, mountpoint) = 1) t
    using (server_id)""", ("mount_calc",))
library("disk_dev", f"select * from disk_roll join phys_disk using (server_id, device_id) where {_BW}", ("disk_roll", "phys_disk"))
library("net_dev", f"select * from net_roll join phys_iface using (server_id, iface_id) where {_BW}", ("net_roll", "phys_iface"))
library("disk_fact", """
    select server_id, await_p95_ms, cast(floor(iops) as bigint) as disk_iops from
      (select server_id, quantile_cont(w, 0.95) as await_p95_ms from (
         select server_id, bucket, max(case when d_io_time_s / nullif(td_io_time_s, 0) >= 0.5
                then (d_op_read_time_s + d_op_write_time_s) / nullif(d_ops_read + d_ops_write, 0) * 1000 end) as w
         from disk_dev group by 1, 2) a group by 1) x
    left join (select server_id, sum(o) / sum(t) as iops from (
         select server_id, bucket, sum(d_ops_read + d_ops_write) as o, max(td_ops_read) as t from disk_dev group by 1, 2) b where t > 0 group by 1) y
    using (server_id)""", ("disk_dev",))
library("net_fact", """
    select server_id, sum(d_rx_dropped) + sum(d_tx_dropped) as drops, sum(d_rx_packets) + sum(d_tx_packets) as pk, sum(d_tx_packets) as txp
    from net_dev group by 1""", ("net_dev",))
library("core_fact", f"""
    select server_id, max(q) as percore_p95_max from (
      select server_id, core_id, quantile_cont(case when d_cpu_total_s > 0 then greatest(0, (1 - d_cpu_idle_s / d_cpu_total_s) * 100) end, 0.95) as q
      from core_roll where {_BW} group by 1, 2) c where q is not null group by 1""", ("core_roll",))
REPORT_COLS = (
    "server_id, hostname, os_family, cpu_cores, mem_total_bytes, cpu_p95, cpu_avg, cpu_peak, iowait_p95, iowait_peak, run_queue_p95, "
    "pages_in_p95, mem_p95, mem_avg, mem_peak, mem_near_peak, disk_used_pct, worst_mount, cpu_sufficiency, mem_sufficiency, steal_p95, "
    "burst_ratio, blocked_p95, swap_paging, oom_occurred, history_hours, await_p95_ms, disk_iops, inode_used_pct, conntrack_ratio, "
    "runway_days, inode_runway_days, driving_mount, target_gb, proj_30d_pct, driving_used_pct, drop_pct, retrans_pct, cpu_slope, "
    "mem_slope, percore_p95_max").split(", ")
REPORT_FLOATS = tuple(x for x in REPORT_COLS if x not in (
    "server_id", "hostname", "os_family", "cpu_cores", "mem_total_bytes", "worst_mount", "swap_paging", "oom_occurred", "disk_iops", "driving_mount"))
library("report", """
    select i.*, cpu_p95, cpu_avg, cpu_peak, iowait_p95, iowait_peak, run_queue_p95, pages_in_p95, mem_p95, mem_avg, mem_peak,
           mem_near_peak, disk_used_pct, worst_mount, cpu_sample / 14.0 as cpu_sufficiency, mem_sample / 14.0 as mem_sufficiency,
           steal_p95, case when cpu_median > 0 then cpu_p95 / cpu_median end as burst_ratio, blocked_p95,
           coalesce(swap_paging, false) as swap_paging, coalesce(oom_occurred, false) as oom_occurred,
           total_buckets * 24.0 as history_hours, await_p95_ms, disk_iops, inode_used_pct, conntrack_ratio, runway_days,
           inode_runway_days, driving_mount, target_gb, proj_30d_pct, driving_used_pct,
           drops / nullif(pk, 0) * 100 as drop_pct, retrans_total / nullif(txp, 0) * 100 as retrans_pct, cpu_slope, mem_slope, percore_p95_max
    from inventory i left join host_stat using (server_id) left join worst using (server_id) left join runway using (server_id)
    left join disk_fact using (server_id) left join net_fact using (server_id) left join core_fact using (server_id)""",
        ("inventory", "host_stat", "worst", "runway", "disk_fact", "net_fact", "core_fact"))


def report(c: Context):
    return c.once("report", lambda: P.report_aggregate(c.fleet, rolls(c), 14.0))


query("report_aggregate", f"select {', '.join(REPORT_COLS)} from report", ("report",), REPORT_FLOATS)(
    lambda c: report(c).select(*REPORT_COLS))
query("left_join_stats", "select server_id, cpu_p95, mem_p95 from inventory left join host_stat using (server_id)",
      ("inventory", "host_stat"), ("cpu_p95", "mem_p95"))(
    lambda c: c["inventory"].select(HOST).join(P.host_stats(rolls(c).host).select(HOST, "cpu_p95", "mem_p95"), HOST, "left"))
query("exact_percentiles", "select server_id, cpu_p95, cpu_median, cpu_avg, cpu_peak, cpu_sample from host_stat", ("host_stat",),
      ("cpu_p95", "cpu_median", "cpu_avg", "cpu_peak"))(
    lambda c: P.host_stats(rolls(c).host).select(HOST, "cpu_p95", "cpu_median", "cpu_avg", "cpu_peak", "cpu_sample"))
query("near_peak", "select server_id, mem_near_peak from host_stat", ("host_stat",), ("mem_near_peak",))(
    lambda c: P.host_stats(rolls(c).host).select(HOST, "mem_near_peak"))
query("trend_slope", "select server_id, cpu_slope, mem_slope from host_stat", ("host_stat",), ("cpu_slope", "mem_slope"))(
    lambda c: P.host_stats(rolls(c).host).select(HOST, "cpu_slope", "mem_slope"))
query("argmax_tiebreak", "select * from worst", ("worst",), ("disk_used_pct", "inode_used_pct"))(
    lambda c: P.worst_mount(rolls(c).filesystem))
query("first_last_span", "select server_id, mountpoint, av_first, av_last, span_days from mount_calc", ("mount_calc",), ("span_days",))(
    lambda c: P.mount_spans(rolls(c).filesystem_history).select(HOST, "mountpoint", "av_first", "av_last", "span_days"))
query("mount_capacity", """
    select server_id, mountpoint, total_bytes, inode_used_pct, used_pct, byte_runway_days, inode_runway_days, proj_30d_pct,
           cast(ceil(target_raw) as bigint) as target_bytes from mount_calc""", ("mount_calc",),
      ("inode_used_pct", "used_pct", "byte_runway_days", "inode_runway_days", "proj_30d_pct"))(
    lambda c: P.mount_capacity(rolls(c).filesystem_history).select(
        HOST, "mountpoint", "total_bytes", "inode_used_pct", "used_pct", "byte_runway_days", "inode_runway_days", "proj_30d_pct", "target_bytes"))
query("min_plus_driver_row", "select * from runway", ("runway",),
      ("runway_days", "inode_runway_days", "target_gb", "proj_30d_pct", "driving_used_pct"))(
    lambda c: P.host_runway(P.mount_capacity(rolls(c).filesystem_history)))
query("percore_max_p95", "select * from core_fact", ("core_fact",), ("percore_p95_max",))(lambda c: P.percore_max(rolls(c).core))
query("disk_await_stats", "select * from disk_fact", ("disk_fact",), ("await_p95_ms",))(
    lambda c: P.disk_facts(rolls(c).disk).select(HOST, "await_p95_ms", F.floor("iops").alias("disk_iops")))

_BASE = {
    "disk": ("select server_id, bucket, sum(d_ops_read + d_ops_write) as a, sum(d_io_read_bytes + d_io_write_bytes) as b, max(td_ops_read) as dt from disk_dev where td_ops_read > 0 group by 1, 2", "disk_dev"),
    "net": ("select server_id, bucket, sum(d_rx_bytes) as a, sum(d_tx_bytes) as b, max(td_rx_bytes) as dt from net_dev where td_rx_bytes > 0 group by 1, 2", "net_dev")}
library("disk_base", f"""
    select server_id, cast(floor(sum(a) / sum(dt)) as bigint) as iops_baseline, quantile_cont(a / dt, 0.95) as iops_p95, max(a / dt) as iops_peak,
           sum(b) / sum(dt) / 1024 as kbps_baseline, quantile_cont(b / dt / 1024, 0.95) as kbps_p95, max(b / dt / 1024) as kbps_peak
    from ({_BASE['disk'][0]}) p group by 1""", ("disk_dev",))
library("net_base", f"""
    select server_id, sum(a) / sum(dt) / 1024 as rx_baseline, quantile_cont(a / dt / 1024, 0.95) as rx_p95, max(a / dt / 1024) as rx_peak,
           sum(b) / sum(dt) / 1024 as tx_baseline, quantile_cont(b / dt / 1024, 0.95) as tx_p95, max(b / dt / 1024) as tx_peak
    from ({_BASE['net'][0]}) p group by 1""", ("net_dev",))
query("baseline_rate", "select * from disk_base", ("disk_base",), ("iops_p95", "iops_peak", "kbps_baseline", "kbps_p95", "kbps_peak"))(
    lambda c: P.disk_baseline(rolls(c).disk))
query("baseline_rate_net", "select * from net_base", ("net_base",), ("rx_baseline", "rx_p95", "rx_peak", "tx_baseline", "tx_p95", "tx_peak"))(
    lambda c: P.net_baseline(rolls(c).net))

library("reboots", f"""
    select server_id, greatest(0, count(distinct boot_time) - 1) as reboot_count from inventory_history
    where collected_at >= {START} and collected_at <= {END} group by 1""", ("inventory_history",))
library("restarts", f"""
    select server_id, greatest(0, count(distinct agent_started_at) - 1) as restart_count from inventory_history
    where collected_at >= {START} and collected_at <= {END} group by 1""", ("inventory_history",))
query("distinct_minus_one", "select * from reboots", ("reboots",))(lambda c: P.reboot_counts(c["inventory_history"], c.start, c.end))
query("distinct_minus_one_restarts", "select * from restarts", ("restarts",))(lambda c: P.restart_counts(c["inventory_history"], c.start, c.end))
query("server_stability", """
    select server_id, greatest(0, count(distinct boot_time) - 1) as reboot_count, greatest(0, count(distinct agent_started_at) - 1) as restart_count
    from inventory_history group by 1""", ("inventory_history",))(lambda c: P.server_stability(c["inventory_history"]))
query("memory_breakdown", """
    select server_id, avg(mem_pct_avg) as used_pct, 100 - avg(mem_pct_avg) as available_pct, avg(mem_cached_pct_avg) as cached_pct,
           avg(mem_buffered_pct_avg) as buffers_pct from host_bkt group by 1""", ("host_bkt",),
      ("used_pct", "available_pct", "cached_pct", "buffers_pct"))(lambda c: P.memory_breakdown(rolls(c).host))
query("cpu_breakdown", """
    select server_id, avg(d_cpu_user_s / d_cpu_total_s * 100) filter (where d_cpu_total_s > 0) as user_pct,
           avg(d_cpu_system_s / d_cpu_total_s * 100) filter (where d_cpu_total_s > 0) as system_pct,
           avg(d_cpu_iowait_s / d_cpu_total_s * 100) filter (where d_cpu_total_s > 0) as iowait_pct from host_bkt group by 1""",
      ("host_bkt",), ("user_pct", "system_pct", "iowait_pct"))(lambda c: P.cpu_breakdown(rolls(c).host))
library("env_util", f"""
    select (select greatest(0, (1 - sum(d_cpu_idle_s) / sum(d_cpu_total_s)) * 100) from host_bkt where d_cpu_total_s > 0) as cpu_avg,
           (select sum(mem_limit_avg - mem_available_avg) / sum(mem_limit_avg) * 100 from host_bkt) as mem_avg,
           (select quantile_cont(v, 0.95) from (select greatest(0, (1 - sum(d_cpu_idle_s) / sum(d_cpu_total_s)) * 100) as v from host_bkt where d_cpu_total_s > 0 group by bucket) a) as cpu_p95,
           (select quantile_cont(v, 0.95) from (select sum(mem_limit_avg - mem_available_avg) / sum(mem_limit_avg) * 100 as v from host_bkt group by bucket) b) as mem_p95,
           (select sum(total_bytes_max * used_pct_avg / 100) / sum(total_bytes_max) * 100 from fs_roll where {_BW} and {VOLUME}) as disk_avg,
           (select count(distinct server_id) from host_bkt) as sample_size""", ("host_bkt", "fs_roll"))
query("environment_utilization", "select * from env_util", ("env_util",), ("cpu_avg", "mem_avg", "cpu_p95", "mem_p95", "disk_avg"))(
    lambda c: P.environment_utilization(rolls(c)))
query("global_scalars", "select cpu_avg, mem_avg, disk_avg, sample_size from env_util", ("env_util",), ("cpu_avg", "mem_avg", "disk_avg"))(
    lambda c: P.environment_utilization(rolls(c)).select("cpu_avg", "mem_avg", "disk_avg", "sample_size"))
query("weighted_used_pct", f"select server_id, sum(total_bytes_max * used_pct_avg / 100) / sum(total_bytes_max) * 100 as used_pct from fs_roll where {_BW} and {VOLUME} group by 1",
      ("fs_roll",), ("used_pct",))(
    lambda c: rolls(c).filesystem.groupBy(HOST).agg(
        (F.sum(F.col("total_bytes_max") * F.col("used_pct_avg") / 100) / F.sum("total_bytes_max") * 100).alias("used_pct")))
library("report_full", """
    select r.*, coalesce(reboot_count, 0) as reboot_count, coalesce(restart_count, 0) as restart_count, rx_baseline as net_rx_kbps,
           tx_baseline as net_tx_kbps, iops_baseline as disk_iops_baseline, kbps_baseline as disk_kbps_baseline,
           case when rx_baseline is not null or tx_baseline is not null then coalesce(rx_baseline, 0) + coalesce(tx_baseline, 0) end as net_kbps,
           least(case when cpu_p95 is not null then cpu_sufficiency end, case when mem_p95 is not null then mem_sufficiency end) as sufficiency,
           case when (cpu_slope is not null or mem_slope is not null) and history_hours >= 30
                then coalesce(cpu_slope >= 0.2, false) or coalesce(mem_slope >= 0.2, false) end as trend_rising
    from report r left join reboots using (server_id) left join restarts using (server_id) left join net_base using (server_id)
    left join disk_base using (server_id)""", ("report", "reboots", "restarts", "net_base", "disk_base"))


def full_report(c: Context):
    return c.once("full_report", lambda: P.attach_baselines(report(c), c["inventory_history"], rolls(c)))


query("attach_baselines", """select server_id, reboot_count, restart_count, net_rx_kbps, net_tx_kbps, disk_iops_baseline, disk_kbps_baseline from report_full""",
      ("report_full",), ("net_rx_kbps", "net_tx_kbps", "disk_kbps_baseline"))(
    lambda c: full_report(c).select(HOST, "reboot_count", "restart_count", "net_rx_kbps", "net_tx_kbps", "disk_iops_baseline", "disk_kbps_baseline"))
query("resource_stats", "select server_id, net_kbps, sufficiency, trend_rising, mem_total_mb from report_full", ("report_full",), ("net_kbps", "sufficiency"))(
    lambda c: rules.resource_stats(full_report(c)).select(HOST, "net_kbps", "sufficiency", "trend_rising", "mem_total_mb"))

# --- rules --------------------------------------------------------------------------------------------------------

_LINE = "case when os_family = 'windows' then 2.0 else 1.0 end"
library("verdict", f"""
    select *, case when unseen then 'insufficient' end as _x,
      case when short then 'under' when unseen then 'insufficient'
           when coalesce(cpu_p95 <= 3, false) and coalesce(net_kbps * 8 / 1000 <= 2, false) then 'idle'
           when cpu_status = 'over' or mem_status = 'over' then 'over' else 'optimal' end as host_status,
      case when mem_status = 'under' and coalesce(mem_sat, false) and (io_status = 'io_bound' or cpu_status = 'under') then 'memory'
           when io_status = 'io_bound' and cpu_status = 'under' and coalesce(blocked_p95 >= 1, false) then 'disk_io'
           when mem_status = 'under' then 'memory' when cpu_status = 'under' then 'cpu' when disk_status = 'filling' then 'disk_capacity' end as root_cause
    from (
    select *, cpu_status = 'under' or mem_status = 'under' or disk_status = 'filling' as short,
           cpu_status = 'unmeasured' and mem_status = 'unmeasured' as unseen,
           case when cpu_status = 'under' then case when cpu_need > cpu_cores then cpu_need end when cpu_status = 'over' then cpu_need
                when cpu_status = 'optimal' then cpu_cores end as cpu_target,
           case when cpu_status = 'under' and cpu_need <= cpu_cores then cpu_cores + 1 end as cpu_floor,
           case when mem_status = 'under' then case when mem_want > mem_total_mb then mem_want end when mem_status = 'over' then mem_need
                when mem_status = 'optimal' then mem_total_mb end as mem_target,
           case when mem_status = 'under' and not coalesce(mem_want > mem_total_mb, false) then cast(ceil(mem_total_mb * 1.3) as bigint) end as mem_floor
    from (
    select *,
      case when cpu_p95 is null and not coalesce(cpu_sat, false) then 'unmeasured'
           when coalesce(cpu_p95 >= 70, false) or coalesce(cpu_sat, false) or cpu_need > cpu_cores then 'under'
           when cpu_need < cpu_cores and not coalesce(percore_p95_max >= 85, false) then 'over' else 'optimal' end as cpu_status,
      case when mem_p95 is null then case when oom_occurred then 'under' else 'unmeasured' end
           when mem_p95 >= 90 or coalesce(mem_sat, false) or oom_occurred then 'under'
           when mem_need > 0 and mem_need < mem_total_mb then 'over' else 'optimal' end as mem_status,
      case when mem_p95 is not null then greatest(mem_need, case when coalesce(mem_sat, false) or oom_occurred then cast(ceil(mem_total_mb * 1.3) as bigint) else 0 end) end as mem_want,
      case when least(runway_days, inode_runway_days) < 30 or (runway_days is null and disk_used_pct >= 85)
                or (inode_runway_days is null and inode_used_pct >= 85) then 'filling'
           when coalesce(runway_days, inode_runway_days, disk_used_pct, inode_used_pct) is not null then 'capacity_ok' else 'unmeasured' end as disk_status,
      case when least(runway_days, inode_runway_days) < 30 then case when runway_days = least(runway_days, inode_runway_days) and target_gb >= 1 then cast(target_gb as bigint) end
           when runway_days is null and disk_used_pct >= 85 and target_gb >= 1 then cast(target_gb as bigint) end as disk_target,
      case when await_p95_ms > 20 then 'io_bound' when await_p95_ms is not null then 'io_ok' else 'unmeasured' end as io_status,
      case when (not coalesce(net_kbps < 10, false) and (coalesce(retrans_pct > 1.0, false) or coalesce(drop_pct > 0.5, false)))
                or coalesce(conntrack_ratio >= 0.8, false) then 'congested'
           when coalesce(retrans_pct, drop_pct, conntrack_ratio) is not null then 'quality_ok' else 'unmeasured' end as net_status
    from (
    select *, cast(greatest(1, case when cpu_p95 > 0 then ceil(cpu_p95 * cpu_cores / 70) else 1 end,
                            case when cpu_sat and run_queue_p95 > 0 then ceil(run_queue_p95 / ({_LINE} * 0.7)) else 0 end) as bigint) as cpu_need,
           case when coalesce(mem_near_peak, mem_p95) > 0 then cast(ceil(mem_total_mb * coalesce(mem_near_peak, mem_p95) / 80) as bigint) end as mem_need
    from (
    select *, case when run_queue_p95 is null then null when run_queue_p95 / cpu_cores < {_LINE} then false else coalesce(cpu_p95 >= 70, true) end as cpu_sat,
           case when mem_p95 is null then null when mem_p95 < 90 then false when os_family = 'windows' then pages_in_p95 >= 20 else swap_paging end as mem_sat,
           coalesce(history_hours < 30, false) or coalesce(burst_ratio > 2, false) as low_precision
    from report_full) a) b) c) d""", ("report_full",))


def verdict(c: Context):
    return c.once("verdict", lambda: rules.assess_host(rules.resource_stats(full_report(c))))


query("assess_cpu", "select server_id, cpu_status, cast(cpu_target as bigint) as cpu_target, cast(cpu_floor as bigint) as cpu_floor, low_precision as cpu_low_precision from verdict", ("verdict",))(
    lambda c: rules.assess_cpu(rules.require_stats(rules.resource_stats(full_report(c)))).select(HOST, "cpu_status", "cpu_target", "cpu_floor", "cpu_low_precision"))
query("assess_memory", "select server_id, mem_status, cast(mem_target as bigint) as mem_target, mem_floor from verdict", ("verdict",))(
    lambda c: rules.assess_memory(rules.require_stats(rules.resource_stats(full_report(c)))).select(HOST, "mem_status", "mem_target", "mem_floor"))
query("assess_disk_capacity", "select server_id, disk_status, disk_target from verdict", ("verdict",))(
    lambda c: rules.assess_disk_capacity(rules.require_stats(rules.resource_stats(full_report(c)))).select(HOST, "disk_status", "disk_target"))
query("assess_disk_io", "select server_id, io_status from verdict", ("verdict",))(
    lambda c: rules.assess_disk_io(rules.require_stats(rules.resource_stats(full_report(c)))).select(HOST, "io_status"))
query("assess_network", "select server_id, net_status from verdict", ("verdict",))(
    lambda c: rules.assess_network(rules.require_stats(rules.resource_stats(full_report(c)))).select(HOST, "net_status"))
query("rollup_host", "select server_id, host_status, root_cause, net_status = 'congested' as network_congested from verdict", ("verdict",))(
    lambda c: verdict(c).select(HOST, "host_status", "root_cause", "network_congested"))
query("downsize_gate", """
    select server_id, cpu_status = 'over' and not low_precision and not (cpu_sat is null or cpu_p95 is null) and not coalesce(steal_p95 >= 5, false)
             and not coalesce(trend_rising, false) and coalesce(sufficiency >= 0.7, false) as cpu_downsize,
           mem_status = 'over' and not low_precision and not coalesce(trend_rising, false) and coalesce(sufficiency >= 0.7, false) as mem_downsize
    from verdict""", ("verdict",))(lambda c: verdict(c).select(HOST, "cpu_downsize", "mem_downsize"))
query("assess_mount", """
    select server_id, mountpoint, current_gib, case when f and target_raw is not null then greatest(current_gib, cast(ceil(ceil(target_raw) / 1073741824) as bigint))
             when f then greatest(current_gib, cast(ceil(current_gib / 0.7) as bigint)) else current_gib end as recommended_gib,
           case when f and target_raw is not null then case when ceil(ceil(target_raw) / 1073741824) > current_gib then 'increase' else 'keep' end
                when f then 'increase' else 'keep' end as action,
           case when f and target_raw is null then 'floor' else 'exact' end as estimate_quality
    from (select *, cast(ceil(total_bytes / 1073741824) as bigint) as current_gib,
                 coalesce(byte_runway_days < 30, false) or (byte_runway_days is null and used_pct >= 85) as f from mount_calc) m""", ("mount_calc",))(
    lambda c: rules.assess_mount(P.mount_capacity(rolls(c).filesystem_history)).select(
        HOST, "mountpoint", "current_gib", "recommended_gib", "action", "estimate_quality"))


# --- stored rollups -----------------------------------------------------------------------------------------------

#: Days at which the stored tables are refreshed; samples after the last one are the tail.
_REFRESHED = ("2024-01-15", "2024-01-29")


def _arrived(step: int):
    """Whether a sample has come by a refresh: those before its day but for late ones, a tenth that comes one refresh later."""
    if step < 0:
        return F.lit(False)
    late = F.pmod(F.xxhash64(HOST, "collected_at"), F.lit(10)) == 0
    shown = [timestamp(f"{d} 00:00:00") for d in ("1970-01-01", *_REFRESHED, "2100-01-01")]
    return (F.col("collected_at") < shown[step]) | ((F.col("collected_at") < shown[step + 1]) & ~late)


def _store(c: Context) -> RollupStore:
    """The bucket tables after three refreshes, each but the first with late samples of days that were materialised before,
    and a last one for the late samples that come with the tail."""
    def build() -> RollupStore:
        store = RollupStore(c.spark, work_folder(c.spark, "rollups"), c.width)
        for step, day in enumerate((*_REFRESHED, _REFRESHED[-1])):
            last = step == len(_REFRESHED)
            now = F.lit(True) if last else _arrived(step)
            if step:
                for samples in {s for s, _ in ROLLUPS.values()}:
                    store.arrived(c[samples].where(now & ~_arrived(step - 1)), samples, step)
            store.refresh(Fleet(lambda n, now=now: c[n].where(now)), dt.date.fromisoformat(day))
        return store

    return c.once("rollup-store", build)


def stored_rolls(c: Context) -> P.Rollups:
    return P.Rollups(c.fleet, c.start, c.end, c.width, _store(c).tables(c.fleet))


query("rollup_refresh_host", "select * replace (mem_available_avg / 1073741824 as mem_available_avg, mem_limit_avg / 1073741824 as mem_limit_avg) from host_roll",
      ("host_roll",), _HOST_FLOATS)(lambda c: _gib(_store(c).table(c.fleet, "host"), "mem_available_avg", "mem_limit_avg"))
query("rollup_refresh_filesystem", "select * from fs_roll", ("fs_roll",), ("used_pct_max", "used_pct_avg", "inode_pct_max"))(
    lambda c: _store(c).table(c.fleet, "filesystem"))
query("rollup_refresh_disk", "select * from disk_roll", ("disk_roll",), tuple(f"d_{c}" for c in _DD) + (
    "td_io_time_s", "td_ops_read", "pending_avg", "pending_max"))(lambda c: _store(c).table(c.fleet, "disk"))
query("report_aggregate_stored", f"select {', '.join(REPORT_COLS)} from report", ("report",), REPORT_FLOATS)(
    lambda c: P.report_aggregate(c.fleet, stored_rolls(c), 14.0).select(*REPORT_COLS))
query("mount_capacity_stored", """
    select server_id, mountpoint, total_bytes, inode_used_pct, used_pct, byte_runway_days, inode_runway_days, proj_30d_pct,
           cast(ceil(target_raw) as bigint) as target_bytes from mount_calc""", ("mount_calc",),
      ("inode_used_pct", "used_pct", "byte_runway_days", "inode_runway_days", "proj_30d_pct"))(
    lambda c: P.mount_capacity(stored_rolls(c).filesystem_history).select(
        HOST, "mountpoint", "total_bytes", "inode_used_pct", "used_pct", "byte_runway_days", "inode_runway_days", "proj_30d_pct", "target_bytes"))
query("environment_utilization_stored", "select * from env_util", ("env_util",), ("cpu_avg", "mem_avg", "cpu_p95", "mem_p95", "disk_avg"))(
    lambda c: P.environment_utilization(stored_rolls(c)))


# --- index of series ----------------------------------------------------------------------------------------------

def series_index(c: Context) -> SeriesIndex:
    """The newest samples and the ends of the mounts after three batches, each but the first with late samples."""
    def build() -> SeriesIndex:
        index = SeriesIndex(c.spark, work_folder(c.spark, "series-index"))
        for step in range(len(_REFRESHED) + 1):
            last = step == len(_REFRESHED)
            new = (F.lit(True) if last else _arrived(step)) & ~_arrived(step - 1)
            now = c.end if last else timestamp(f"{_REFRESHED[step]} 00:00:00")
            index.batch(Fleet(lambda n, new=new: c[n].where(new)), step, now)
        return index

    return c.once("series-index", build)


query("mount_capacity_indexed", """
    select server_id, mountpoint, total_bytes, inode_used_pct, used_pct, byte_runway_days, inode_runway_days, proj_30d_pct,
           cast(ceil(target_raw) as bigint) as target_bytes from mount_calc""", ("mount_calc",),
      ("inode_used_pct", "used_pct", "byte_runway_days", "inode_runway_days", "proj_30d_pct"))(
    lambda c: P.span_capacity(series_index(c).mount_spans(c.width)).select(
        HOST, "mountpoint", "total_bytes", "inode_used_pct", "used_pct", "byte_runway_days", "inode_runway_days", "proj_30d_pct", "target_bytes"))
