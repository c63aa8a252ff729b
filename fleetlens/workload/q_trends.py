"""Bucketed trends over the bound fleet, one query per metric family."""

from __future__ import annotations

from fleetlens.operators.trends import metric_trend
from fleetlens.workload.registry import library, query

START, LEAD, END = ("timestamp '2024-01-17 00:00:00'", "timestamp '2024-01-16 00:00:00'",
                    "timestamp '2024-01-31 00:00:00'")
IN = f"collected_at >= {START} and collected_at <= {END}"
IN_LEAD = f"collected_at >= {LEAD} and collected_at <= {END}"
TS = "date_trunc('day', collected_at) as ts"
NODIM = "cast(null as varchar) as dimension"

library("phys_disk", """
    select distinct server_id, device_id from (
      select server_id, unnest([b.id_type || ':' || b.id, 'name:' || b.name]) as device_id
      from (select server_id, unnest(block_devices) as b from inventory) x where b.type = 'disk') y
    where device_id is not null""", ("inventory",))
library("phys_iface", """
    select distinct server_id, n.id_type || ':' || n.id as iface_id
    from (select server_id, unnest(net_interfaces) as n from inventory) x where n.kind in ('physical', 'bond_master')""",
        ("inventory",))
library("cpu_total", """
    select *, coalesce(cpu_user_s,0)+coalesce(cpu_nice_s,0)+coalesce(cpu_system_s,0)+coalesce(cpu_idle_s,0)
      +coalesce(cpu_iowait_s,0)+coalesce(cpu_irq_s,0)+coalesce(cpu_softirq_s,0)+coalesce(cpu_steal_s,0) as total
    from host_metrics""", ("host_metrics",))
library("disk_steps", f"""
    select server_id, device_id, collected_at, t - lag(t) over w as d_t, ops - lag(ops) over w as d_ops,
           io - lag(io) over w as d_io, epoch(collected_at) - epoch(lag(collected_at) over w) as dt
    from (select server_id, device_id, collected_at, op_read_time_s + op_write_time_s as t, ops_read + ops_write as ops,
                 io_time_s as io from disk_io join phys_disk using (server_id, device_id) where {IN_LEAD}) r
    window w as (partition by server_id, device_id order by collected_at)""", ("disk_io", "phys_disk"))
library("net_steps", f"""
    select server_id, iface_id, collected_at,
           {', '.join(f'greatest({c} - lag({c}) over w, 0) as d_{c}' for c in
                      ('rx_bytes', 'tx_bytes', 'rx_packets', 'tx_packets', 'rx_dropped', 'tx_dropped'))},
           epoch(collected_at) - epoch(lag(collected_at) over w) as dt
    from net_io join phys_iface using (server_id, iface_id) where {IN_LEAD}
    window w as (partition by server_id, iface_id order by collected_at)""", ("net_io", "phys_iface"))
library("tcp_steps", f"""
    select server_id, collected_at,
           greatest(net_tcp_retransmits - lag(net_tcp_retransmits) over (partition by server_id order by collected_at), 0) as d_retrans,
           case when net_conntrack_limit > 0 then net_conntrack_usage / net_conntrack_limit end as track
    from host_metrics where {IN_LEAD}""", ("host_metrics",))


def _trend(metric, **kw):
    return lambda c: metric_trend(c.fleet, metric, c.start, c.end, c.width, **kw)


def _agg(agg):
    return {"avg": "avg(v)", "max": "max(v)", "p95": "quantile_cont(v, 0.95)"}[agg]


def _bucketed(inner, agg="avg", dim=None):
    d = f"{dim} as dimension" if dim else NODIM
    g = f", {dim}" if dim else ""
    return f"select {TS}, {_agg(agg)} as value, {d} from ({inner}) p where v is not null group by date_trunc('day', collected_at){g}"


# M1
_CPU = {"usage": "total - cpu_idle_s", "user": "cpu_user_s", "system": "cpu_system_s", "iowait": "cpu_iowait_s",
        "nice": "cpu_nice_s"}
for _part, _expr in _CPU.items():
    for _a in (("avg", "max", "p95") if _part == "usage" else ("avg",)):
        _name = "trend_cpu_share" + ("" if _part == "usage" else f"_{_part}") + ("" if _a == "avg" else f"_{_a}")
        query(_name, _bucketed(f"""
            select collected_at, sum(d_num) * 100.0 / sum(d_total) as v from (
              select collected_at, num - lag(num) over w as d_num, total - lag(total) over w as d_total
              from (select server_id, collected_at, {_expr} as num, total from cpu_total where {IN_LEAD}) r
              window w as (partition by server_id order by collected_at)) d
            where collected_at >= {START} and d_total > 0 and d_num >= 0 group by collected_at""", _a),
              ("cpu_total",), ("value",))(_trend(f"cpu.{_part}_percent", agg=_a))

# M2
for _part, _num, _guard in (
        ("usage", "mem_limit_bytes - mem_available_bytes", "mem_available_bytes"),
        ("available", "mem_available_bytes", "mem_available_bytes"),
        ("cached", "mem_cached_bytes", "mem_cached_bytes"), ("buffers", "mem_buffered_bytes", "mem_buffered_bytes")):
    query("trend_mem_weighted" + ("" if _part == "usage" else f"_{_part}"), _bucketed(f"""
        select collected_at, cast(sum({_num}) as double) / sum(mem_limit_bytes) * 100 as v from host_metrics
        where {IN} and mem_limit_bytes > 0 and {_guard} is not null group by collected_at""", "p95" if _part == "usage" else "avg"),
          ("host_metrics",), ("value",))(_trend(f"mem.{_part}_percent", agg="p95" if _part == "usage" else "avg"))

# M3 - M6
query("trend_run_queue", _bucketed(f"""
    select collected_at, os_family, sum(cpu_run_queue) / sum(cpu_cores) as v
    from host_metrics join inventory using (server_id) where {IN} and cpu_run_queue is not null and cpu_cores > 0
    group by collected_at, os_family""", dim="os_family"), ("host_metrics", "inventory"), ("value",))(_trend("cpu.run_queue"))

_SAT = f"""select collected_at, server_id, (cpu_run_queue / cpu_cores) / case when os_family = 'windows' then 2.0 else 1.0 end >= 1.0 as crossed
    from host_metrics join inventory using (server_id) where {IN} and cpu_run_queue is not null and cpu_cores > 0"""


def _hosts(flags):
    return f"""select ts, cast(count(*) filter (where ever) as double) as value, {NODIM}
        from (select {TS}, server_id, bool_or(crossed) as ever from ({flags}) f group by 1, 2) g group by ts"""


def _any(flags):
    return f"""select ts, case when ever then 1.0 else 0.0 end as value, {NODIM}
        from (select {TS}, bool_or(crossed) as ever from ({flags}) f group by 1) g"""


query("trend_cpu_saturation_hosts", _hosts(_SAT), ("host_metrics", "inventory"), ("value",))(_trend("cpu.saturation_hosts"))
query("trend_cpu_saturation", _any(_SAT), ("host_metrics", "inventory"), ("value",))(_trend("cpu.saturation"))
query("trend_cpu_blocked", _bucketed(f"""
    select collected_at, os_family, avg(cpu_blocked) as v from host_metrics join inventory using (server_id)
    where {IN} and cpu_blocked is not null group by collected_at, os_family""", dim="os_family"),
      ("host_metrics", "inventory"), ("value",))(_trend("cpu.blocked"))

# M7, M8
query("trend_disk_await", _bucketed(f"""
    select collected_at, max(case when d_ops > 0 and dt > 0 and greatest(d_io, 0) / dt >= 0.5
                             then greatest(d_t, 0) / d_ops * 1000 end) as v
    from disk_steps where collected_at >= {START} group by collected_at"""), ("disk_steps",), ("value",))(_trend("disk.io_saturation"))
_DISK = f"""select collected_at, server_id, case when d_ops > 0 and dt > 0 and d_io >= 0 and d_io <= dt and d_io / dt >= 0.5
    then d_t / d_ops * 1000 end > 20 as crossed from disk_steps where collected_at >= {START}"""
query("trend_disk_saturation_hosts", _hosts(_DISK), ("disk_steps",), ("value",))(_trend("disk.saturation_hosts"))
query("trend_disk_saturation", _any(_DISK), ("disk_steps",), ("value",))(_trend("disk.saturation"))

# M9 - M11
query("trend_net_retrans", _bucketed(f"""
    select collected_at, n * 100.0 / nullif(d, 0) as v
    from (select collected_at, sum(d_retrans) as n from tcp_steps where collected_at >= {START} group by 1) a
    join (select collected_at, sum(d_tx_packets) as d from net_steps where collected_at >= {START} group by 1) b using (collected_at)"""),
      ("tcp_steps", "net_steps"), ("value",))(_trend("net.retrans_percent"))
query("trend_net_drop", _bucketed(f"""
    select collected_at, (sum(d_rx_dropped) + sum(d_tx_dropped)) * 100.0 / nullif(sum(d_rx_packets) + sum(d_tx_packets), 0) as v
    from net_steps where collected_at >= {START} group by 1"""), ("net_steps",), ("value",))(_trend("net.drop_percent"))
_CONG = f"""
    select collected_at, server_id,
           ((kbps is null or kbps >= 10) and (coalesce(d_retrans * 100.0 / nullif(txp, 0) > 1.0, false)
             or coalesce(dropped * 100.0 / nullif(pkt, 0) > 0.5, false))) or coalesce(track >= 0.8, false) as crossed
    from (select collected_at, server_id, sum(d_tx_packets) as txp, sum(d_rx_dropped) + sum(d_tx_dropped) as dropped,
                 sum(d_rx_packets) + sum(d_tx_packets) as pkt,
                 (sum(d_rx_bytes) + sum(d_tx_bytes)) / 1024.0 / nullif(max(dt), 0) as kbps
          from net_steps where collected_at >= {START} group by 1, 2) n
    left join tcp_steps using (collected_at, server_id)"""
query("trend_net_congested", _any(_CONG), ("tcp_steps", "net_steps"), ("value",))(_trend("net.congested"))
query("trend_net_congested_hosts", _hosts(_CONG), ("tcp_steps", "net_steps"), ("value",))(_trend("net.congested_hosts"))

# M12
for _m, _res in (("cpu", "cpu"), ("mem", "memory"), ("disk", "io")):
    query("trend_psi" + ("" if _m == "cpu" else f"_{_m}"), _bucketed(f"""
        select collected_at, sum(greatest(ds, 0)) / nullif(sum(dt), 0) * 100 as v from (
          select collected_at, stall_time_s - lag(stall_time_s) over w as ds,
                 epoch(collected_at) - epoch(lag(collected_at) over w) as dt
          from pressure where resource = '{_res}' and scope = 'some' and {IN_LEAD}
          window w as (partition by server_id order by collected_at)) d
        where collected_at >= {START} and dt > 0 group by 1"""), ("pressure",), ("value",))(_trend(f"{_m}.psi"))

# M13
_PAGE = f"""
    select collected_at, server_id, case when os_family = 'windows' then rate >= 20 else rate > 0 end as crossed from (
      select collected_at, server_id, os_family, greatest(p - lag(p) over w, 0) / (epoch(collected_at) - epoch(lag(collected_at) over w)) as rate
      from (select collected_at, server_id, os_family, case when os_family = 'windows' then paging_in else paging_major end as p
            from host_metrics join inventory using (server_id) where {IN_LEAD}) r where p is not null
      window w as (partition by server_id order by collected_at)) q
    where collected_at >= {START} and rate is not null"""
query("trend_paging_pressure", _any(_PAGE), ("host_metrics", "inventory"), ("value",))(_trend("mem.paging_pressure"))
query("trend_paging_pressure_hosts", _hosts(_PAGE), ("host_metrics", "inventory"), ("value",))(_trend("mem.paging_pressure_hosts"))

# M14, M15
VOLUME = "(fstype is null or fstype not in ('tmpfs', 'devtmpfs', 'overlay', 'squashfs')) and mountpoint not like '/boot%'"
query("trend_fs_usage_locf", f"""
    select b.ts, cast(sum(s.used_bytes) as double) / sum(s.used_bytes + s.free_bytes) * 100 as value, {NODIM}
    from (select unnest(generate_series({START}, {END}, interval 1 day)) as ts) b
    join (select *, lead(collected_at) over (partition by server_id, mountpoint order by collected_at) as next_at
          from filesystem where {IN_LEAD} and {VOLUME}) s
      on s.collected_at < b.ts + interval 1 day and (s.next_at is null or s.next_at >= b.ts + interval 1 day)
    group by b.ts""", ("filesystem",), ("value",))(_trend("fs.usage_percent"))
query("trend_fs_usage_dim", _bucketed(f"""
    select collected_at, mountpoint, cast(sum(used_bytes) as double) / sum(used_bytes + free_bytes) * 100 as v
    from filesystem where {IN} and {VOLUME} group by 1, 2""", "max", "mountpoint"), ("filesystem",), ("value",))(
    _trend("fs.usage_percent", collapse=False, agg="max"))

# M16, M17
_RATES = {"disk.read_iops": ("disk_io", "device_id", "ops_read"), "disk.write_kbps": ("disk_io", "device_id", "io_write_bytes / 1024.0"),
          "disk.write_iops": ("disk_io", "device_id", "ops_write"), "disk.read_kbps": ("disk_io", "device_id", "io_read_bytes / 1024.0"),
          "net.rx_bytes_per_sec": ("net_io", "iface_id", "rx_bytes"), "net.tx_bytes_per_sec": ("net_io", "iface_id", "tx_bytes"),
          "net.rx_packets_per_sec": ("net_io", "iface_id", "rx_packets"), "net.tx_packets_per_sec": ("net_io", "iface_id", "tx_packets")}
for _m, (_t, _d, _c) in _RATES.items():
    _phys = "phys_disk" if _t == "disk_io" else "phys_iface"
    _steps = f"""select collected_at, server_id, {_d} as dim, greatest(cnt - lag(cnt) over w, 0) / (epoch(collected_at) - epoch(lag(collected_at) over w)) as v
        from (select server_id, {_d}, collected_at, {_c} as cnt from {_t} join {_phys} using (server_id, {_d}) where {IN_LEAD}) r
        window w as (partition by server_id, {_d} order by collected_at)"""
    _suffix = "" if _m == "disk.read_iops" else "_" + _m.replace(".", "_")
    query("trend_rate_collapse" + _suffix, f"""
        select ts, sum(sv) as value, {NODIM} from (
          select {TS}, avg(v) as sv from ({_steps}) s where collected_at >= {START} and v is not null group by 1, server_id, dim) g
        group by ts""", (_t, _phys), ("value",))(_trend(_m))
    if _m in ("disk.read_iops", "net.rx_bytes_per_sec"):
        _names = ("(select server_id, coalesce(b.id_type || ':' || b.id, 'name:' || b.name) as dim, b.name as nm from "
                  "(select server_id, unnest(block_devices) as b from inventory) x where b.type = 'disk')" if _t == "disk_io" else
                  "(select server_id, n.id_type || ':' || n.id as dim, n.name as nm from (select server_id, unnest(net_interfaces) as n from inventory) x)")
        query("trend_rate_dim" + _suffix, f"""
            select {TS}, avg(v) as value, coalesce(nm, dim) as dimension from ({_steps}) s left join {_names} n using (server_id, dim)
            where collected_at >= {START} and v is not null group by 1, dim, coalesce(nm, dim)""",
              (_t, _phys, "inventory"), ("value",))(_trend(_m, collapse=False))
