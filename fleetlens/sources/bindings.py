"""Bind the driver tables to the telemetry model.

Every view is one SQL text that Spark and DuckDB both accept; the few functions that differ go through a
``Dialect``. ``events`` gives one sample per host and hour (the sampling grid), its running sums give counters that
reset whenever the host "reboots" (every 36 hours, staggered by host), and the child tables spread those counters
over devices, interfaces, mounts and cores. ``customer`` is the inventory, ``orders`` the task log.

Window partitions here hold at most 36 hourly rows (one boot period), or the hourly grid of one host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ANCHOR = "2024-01-31 00:00:00"
PERIOD_DAYS = 14.0
BUCKET_SECONDS = 86400


class Dialect:
    """SQL spellings that differ between the two engines."""

    def __init__(self, engine: str, sf_dir: str | None = None):
        self.engine = engine
        self.sf_dir = sf_dir
        self.spark = engine == "spark"

    def table(self, name: str) -> str:
        return f"parquet.`{self.sf_dir}/{name}.parquet`" if self.spark else name

    def ts_s(self, e: str) -> str:
        return f"timestamp_seconds({e})" if self.spark else f"make_timestamp(cast(({e}) * 1000000 as bigint))"

    def epoch(self, e: str) -> str:
        return f"unix_seconds(cast({e} as timestamp))" if self.spark else f"cast(epoch({e}) as bigint)"

    def json(self, e: str, path: str) -> str:
        return f"get_json_object({e}, '{path}')" if self.spark else f"json_extract_string({e}, '{path}')"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))" if self.spark else f"(({a}) // ({b}))"

    def seq(self, lo: int, hi: int) -> str:
        return f"explode(sequence({lo}, {hi}))" if self.spark else f"unnest(range({lo}, {hi + 1}))"

    def lst(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def rec(self, **kv: str) -> str:
        if self.spark:
            return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in kv.items()) + ")"
        return "{" + ", ".join(f"'{k}': {v}" for k, v in kv.items()) + "}"

    def s(self, e: str) -> str:
        return f"cast({e} as string)"


def _host_hour(d: Dialect) -> str:
    k = f"cast({d.json('props', '$.k')} as bigint)"
    return f"""
    select user_id as server_id, date_trunc('hour', cast(ts as timestamp)) as collected_at,
           count(*) as n, cast(sum(cast(round(value * 100) as bigint)) as bigint) as v,
           cast(sum({k}) as bigint) as ks, max({k}) as k
    from {d.table('events')} group by 1, 2"""


def _host_cum(d: Dialect) -> str:
    def run(e: str) -> str:
        return f"cast(sum({e}) over w as bigint)"

    ep = d.idiv(f"{d.epoch('collected_at')} + server_id * 7200", "129600")
    return f"""
    select *, {d.epoch('collected_at')} - boot_s as up_s,
           {run('n')} as cn, {run('v')} as cv, {run('ks')} as ck,
           {run('ks * (server_id % 5)')} as cbusy, {run('400 * n - ks * (server_id % 5)')} as cidle,
           {run('case when k >= 98 then 1 else 0 end')} as coom,
           {run('case when k >= 90 then v else 0 end')} as cpage,
           {run('case when k >= 96 then k else 0 end')} as cdrop
    from (select *, ep * 129600 - server_id * 7200 as boot_s from (select *, {ep} as ep from host_hour) a) b
    window w as (partition by server_id, ep order by collected_at rows between unbounded preceding and current row)"""


def _inventory(d: Dialect) -> str:
    nul = "cast(null as string)"
    k = "c_custkey"

    def dev(name, type_, size, fstype, mount, parent, id_, id_type, level=nul, vg=nul):
        return d.rec(name=name, type=f"'{type_}'", size_bytes=f"cast({size} as bigint)", fstype=fstype,
                     mountpoint=mount, parent=parent, id=id_, id_type=id_type, raid_level=level, lvm_vg=vg)

    gib = 1073741824
    win = f"{k} % 3 = 0"
    sda = f"concat('disk-', {d.s(k)}, '-0')"
    sdb = f"case when {win} then {nul} else concat('disk-', {d.s(k)}, '-1') end"
    base = [
        dev("'sda'", "disk", f"{120 * gib}", nul, nul, nul, sda, "'wwn'"),
        dev("'sdb'", "disk", f"{100 * gib} + ({k} % 4) * {50 * gib}", nul, nul, nul,
            sdb, f"case when {win} then {nul} else 'wwn' end"),
        dev("'sda1'", "part", f"{100 * gib}", "'ext4'", "'/'", sda, "'part-a1'", "'partuuid'"),
        dev("'sda2'", "swap", f"{4 * gib}", "'swap'", "'[SWAP]'", sda, "'part-a2'", "'partuuid'"),
    ]
    plain = base + [dev("'sdb1'", "part", f"{100 * gib}", "'xfs'", "'/data'", sdb, "'part-b1'", "'partuuid'")]
    lvm = base + [
        dev("'sdb1'", "part", f"{100 * gib}", "'LVM2_member'", nul, sdb, "'part-b1'", "'partuuid'"),
        dev("'vg0-data'", "lvm", f"{80 * gib}", "'xfs'", "'/data'", "'part-b1'", "'lv-data'", "'dm'", vg="'vg0'"),
    ]
    raid = base + [
        dev("'sda3'", "part", f"{15 * gib}", "'linux_raid_member'", nul, sda, "'part-a3'", "'partuuid'"),
        dev("'sdb2'", "part", f"{15 * gib}", "'linux_raid_member'", nul, sdb, "'part-b2'", "'partuuid'"),
        dev("'md0'", "raid", f"{15 * gib}", "'ext4'", "'/data'", "'part-a3'", "'md-0'", "'md'", "'raid1'"),
        dev("'md0'", "raid", f"{15 * gib}", "'ext4'", "'/data'", "'part-b2'", "'md-0'", "'md'", "'raid1'"),
    ]
    subnet = d.idiv(k, "8")
    net = f"concat('10.', {d.s(f'{d.idiv(subnet, "250")} % 250')}, '.', {d.s(f'{subnet} % 250')}, '.'"
    gw = f"case when {subnet} % 2 = 0 and {k} % 8 >= 4 then '253)' else '254)' end"
    gw0 = f"case when {k} % 11 = 5 then {nul} when {subnet} % 2 = 0 and {k} % 8 >= 4 then {net}, '253') else {net}, '254') end"
    del gw

    def addr(address, prefix):
        return d.rec(address=address, prefix=f"cast({prefix} as int)", family="'ipv4'")

    none_addr = f"cast(null as {'array<struct<address:string,prefix:int,family:string>>' if d.spark else 'struct(address varchar, prefix int, family varchar)[]'})"

    def nic(name, i, kind, speed, addresses, gateway, bond=nul):
        return d.rec(name=name, id=f"concat('if-', {d.s(k)}, '-{i}')", id_type="'mac'", kind=kind,
                     speed_mbps=f"cast({speed} as int)", addresses=addresses, gateway=gateway, bond_mode=bond)

    second = f"case when {k} % 4 = 0 then {d.lst(addr(f'''concat('192.168.', {d.s(f'{d.idiv(k, chr(49) + chr(50))} % 250')}, '.', {d.s(f'1 + {k} % 250')})''', 24))} else {none_addr} end"
    nics = d.lst(
        nic("'eth0'", 0, "'physical'", f"case when {k} % 2 = 0 then 1000 end",
            d.lst(addr(f"{net}, {d.s(f'1 + {k} % 8')})", 24)), gw0),
        nic("'bond0'", 1, f"case when {k} % 2 = 0 then 'bond_master' else 'physical' end", "10000", second, nul,
            f"case when {k} % 2 = 0 then '802.3ad' end"),
        nic("'veth0'", 2, "'virtual'", "cast(null as int)", d.lst(addr("'172.17.0.1'", 16)), nul),
    )

    def svc(unit, pid):
        return d.rec(unit=unit, sub="'running'", pid=f"cast({pid} as int)")

    def sock(port, pid, comm, proto="'tcp'"):
        return d.rec(proto=proto, addr="'0.0.0.0'", port=f"cast({port} as int)", pid=f"cast({pid} as int)", comm=comm)

    ssh_s, ssh_p = svc("'sshd.service'", 10), sock(22, 10, "'sshd'")
    service_sets = [
        (d.lst(ssh_s, svc("'nginx.service'", 20), svc("'app-gateway.service'", 21)),
         d.lst(ssh_p, sock(80, 20, "'nginx'"), sock(443, 20, "'nginx'"), sock(8080, 21, "'java'"))),
        (d.lst(ssh_s, svc("'postgresql@14-main.service'", 30)),
         d.lst(ssh_p, sock(5432, 30, "'postgres'"), sock(5433, 30, "'postgres'"))),
        (d.lst(ssh_s, svc("'docker.service'", 40), svc("'containerd.service'", 41)),
         d.lst(ssh_p, sock(6379, 42, "'redis-server'"))),
        (d.lst(ssh_s, svc("'foobar.service'", 50), svc("'rabbitmq-server.service'", "null")),
         d.lst(ssh_p, sock(5672, "null", "'beam.smp'"), sock(1433, 50, "'foobar'"), sock(60000, 51, "'tmp'"))),
        (d.lst(ssh_s, svc("'systemd-resolved.service'", 60), svc("'dnsmasq.service'", "null")),
         d.lst(ssh_p, sock(53, "null", "'systemd'", "'udp'"), sock(9100, 61, "'node_exporter'"))),
    ]
    services = f"case {k} % 5 " + " ".join(f"when {i} then {s}" for i, (s, _) in enumerate(service_sets[:-1])) + f" else {service_sets[-1][0]} end"
    ports = f"case {k} % 5 " + " ".join(f"when {i} then {p}" for i, (_, p) in enumerate(service_sets[:-1])) + f" else {service_sets[-1][1]} end"
    vgs = d.lst(d.rec(name="'vg0'", size_bytes=f"cast({100 * gib} as bigint)", free_bytes=f"cast({20 * gib} as bigint)"))
    return f"""
    select {k} as server_id, concat('pub-', {d.s(k)}) as public_id, concat('agent-', {d.s(k)}) as agent_id,
           case when {k} % 97 = 5 then 'twin-host' else c_name end as hostname,
           case when {win} then 'windows' else 'linux' end as os_family,
           case when {win} then 'windows' else case {k} % 4 when 0 then 'ubuntu' when 1 then 'rhel'
                when 2 then 'debian' else 'rocky' end end as os_id,
           case when {win} then '10.0' else case {k} % 4 when 0 then '22.04' when 1 then '7.9' when 2 then '12'
                else '9.3' end end as os_version,
           case when {win} then case {k} % 2 when 0 then '17763.5458' else '20348.2322' end
                else case when {k} % 5 = 1 then '3.10.0-1160.el7' else '5.15.0-91' end end as kernel_version,
           case when {win} then case {k} % 2 when 0 then 'Windows Server 2019 Standard'
                else cast(null as string) end end as product_name,
           'x86_64' as arch, cast(1 + {k} % 8 as int) as cpu_cores,
           cast(4 * (1 + {k} % 8) as bigint) * 1024 as mem_total_mb,
           cast(4 * (1 + {k} % 8) as bigint) * 1073741824 as mem_total_bytes,
           c_mktsegment as segment,
           {d.ts_s(f"1706659200 - ({k} % 40) * 60 - case when {k} % 6 = 1 then 86400 else 0 end")} as last_seen_at,
           {d.ts_s(f"1704067200 - {k} * 3600")} as boot_time,
           case {k} % 3 when 0 then {d.lst(*plain)} when 1 then {d.lst(*lvm)} else {d.lst(*raid)} end as block_devices,
           {nics} as net_interfaces, {vgs} as lvm_vgs, {services} as services, {ports} as listen_ports
    from {d.table('customer')}"""


def _host_metrics(d: Dialect) -> str:
    win = "server_id % 3 = 0"

    def linux(e: str, t: str = "double") -> str:
        return f"case when not ({win}) then cast({e} as {t}) end"

    limit = "cast(4 * (1 + server_id % 8) as bigint) * 1073741824"
    pct = "least(99, 40 + (server_id % 6) * 11 + k % 10)"
    avail = f"cast(floor({limit} * (100 - {pct}) / 100) as bigint)"
    start = f"{d.ts_s('boot_s + 60')}"
    return f"""
    select server_id, collected_at, {d.ts_s('boot_s')} as boot_time,
           case when server_id % 3 = 0 and date_trunc('day', collected_at) > {start}
                then date_trunc('day', collected_at) else {start} end as agent_started_at,
           cast(case when {win} then 8 * cbusy else 6 * cbusy end as double) as cpu_user_s,
           {linux('0')} as cpu_nice_s, cast(2 * cbusy as double) as cpu_system_s,
           cast(10 * cidle as double) as cpu_idle_s, {linux('cbusy')} as cpu_iowait_s,
           {linux('0')} as cpu_irq_s, {linux('0')} as cpu_softirq_s, {linux('cbusy')} as cpu_steal_s,
           cast(1 + server_id % 8 as int) as cpu_logical_count,
           cast(k % 13 as double) as cpu_run_queue, {linux('k % 4')} as cpu_blocked,
           cast(case when server_id % 19 = 0 then coom else 0 end as bigint) as cpu_mce,
           {limit} as mem_limit_bytes, {avail} as mem_available_bytes,
           {limit} - {avail} as mem_used_bytes,
           {linux(f'floor({limit} * (k % 20) / 100)', 'bigint')} as mem_cached_bytes,
           {linux(f'floor({limit} * (k % 7) / 100)', 'bigint')} as mem_buffered_bytes,
           {limit} - {avail} + 1048576 as mem_commit_usage_bytes, 2 * ({limit}) as mem_commit_limit_bytes,
           cast(case when server_id % 17 = 0 then (k % 3) * 4096 else 0 end as bigint) as mem_hardware_corrupted_bytes,
           coom as mem_oom_kill,
           {linux('2 * cpage', 'bigint')} as paging_out,
           case when {win} then cv * 150 end as paging_in, case when {win} then cast(null as bigint) else cpage end as paging_major,
           case when server_id % 4 = 0 then ck * 3 else ck end as net_tcp_retransmits,
           {linux('k * 10', 'int')} as net_conntrack_usage, {linux('1000', 'int')} as net_conntrack_limit
    from host_cum"""


def _disk_io(d: Dialect) -> str:
    return f"""
    select server_id, collected_at,
           case when d = 2 then 'dm:dm-0'
                when d = 1 and server_id % 3 = 0 then 'name:sdb'
                else concat('wwn:disk-', {d.s('server_id')}, '-', {d.s('d')}) end as device_id,
           cv * (d + 1) * 1024 as io_read_bytes, cv * 512 as io_write_bytes,
           cv as ops_read, cn * 10 as ops_write,
           cast(up_s * ((server_id + d) % 5) as double) * 0.25 as io_time_s,
           cast(ck * (1 + d) * (server_id % 5) as double) as op_read_time_s,
           cast(cn as double) * 0.5 as op_write_time_s, cast(k % 5 as double) as pending_ops
    from (select *, {d.seq(0, 2)} as d from host_cum) x"""


def _net_io(d: Dialect) -> str:
    return f"""
    select server_id, collected_at, concat('mac:if-', {d.s('server_id')}, '-', {d.s('i')}) as iface_id,
           cv * (server_id % 7) * 300000 * (i + 1) as rx_bytes, cv * (server_id % 7) * 100000 as tx_bytes,
           cv * 2 as rx_packets, cv * (i + 1) + cn as tx_packets,
           case when server_id % 5 = 2 then coom * (i + 1) else 0 end as rx_errors,
           case when server_id % 10 = 7 then coom else 0 end as tx_errors,
           cdrop * (server_id % 3) as rx_dropped, cdrop as tx_dropped,
           case when (server_id + i) % 2 = 0 then cast(1000000000 as bigint) * (i + 1) end as link_speed_bps
    from (select *, {d.seq(0, 2)} as i from host_cum) x"""


def _filesystem(d: Dialect) -> str:
    gib = 1073741824
    return f"""
    select server_id, collected_at, mountpoint, fstype, used_bytes, total - used_bytes as free_bytes,
           inodes_used, 1000000 - inodes_used as inodes_free
    from (
      select server_id, collected_at,
             case m when 0 then '/' when 1 then '/data' when 2 then '/boot' else '/run' end as mountpoint,
             case m when 0 then 'ext4' when 1 then 'xfs' when 2 then 'ext4' else 'tmpfs' end as fstype,
             cast({100 * gib} as bigint) as total,
             least(cast({99 * gib} as bigint),
                   {10 * gib} + case m when 1 then gk * (server_id % 8) * 3500000
                                       when 0 then (server_id % 10) * cast({9 * gib} as bigint) + k * 1000000
                                       else k * 1000 end) as used_bytes,
             least(990000, 1000 + case m when 1 then gk * (server_id % 6) * 60 else k * 10 end) as inodes_used
      from (select server_id, collected_at, k, {d.seq(0, 3)} as m,
                   gk from (select *, cast(sum(ks) over (partition by server_id order by collected_at
                            rows between unbounded preceding and current row) as bigint) as gk from host_hour) g) x
    ) y"""


def _cpu_core(d: Dialect) -> str:
    return f"""
    select server_id, collected_at, cast(c as int) as core_id,
           cast((6 - 3 * c) * cbusy as double) as cpu_user_s, cast(2 * cbusy as double) as cpu_system_s,
           cast(10 * cidle + 3 * c * cbusy as double) as cpu_idle_s
    from (select *, {d.seq(0, 1)} as c from host_cum) x"""


def _pressure(d: Dialect) -> str:
    return f"""
    select server_id, collected_at, case r when 0 then 'cpu' when 1 then 'memory' else 'io' end as resource,
           case f when 0 then 'some' else 'full' end as scope,
           cast(ck * (1 + r) * (2 - f) as double) * 0.5 as stall_time_s
    from (select *, {d.seq(0, 1)} as f from (select *, {d.seq(0, 2)} as r from host_cum where server_id % 3 <> 0) x) y"""


def _disk_error(d: Dialect) -> str:
    return f"""
    select server_id, collected_at, concat('wwn:disk-', {d.s('server_id')}, '-0') as device_id,
           case e when 0 then 'media' else 'link' end as error_kind,
           case e when 0 then 'read' else '' end as error_class, '' as member,
           case when server_id % 3 = e then coom * (e + 1) else 0 end as error_count
    from (select *, {d.seq(0, 1)} as e from host_cum) x"""


def _history(d: Dialect) -> str:
    return f"""
    select m.server_id, m.collected_at, m.boot_time, m.agent_started_at,
           cast(1 + (m.server_id + {d.idiv(d.epoch('m.collected_at'), '864000')}) % 4 as int) as cpu_cores,
           case when m.server_id % 3 = 0 then cast(null as string)
                when {d.epoch('m.collected_at')} % 604800 < 302400 then '5.15.0-91' else '5.15.0-92' end as kernel_version
    from host_metrics m"""


def _tasks(d: Dialect) -> str:
    return f"""
    select o_orderkey as task_id, o_custkey as server_id, concat('agent-', {d.s('o_custkey')}) as agent_id,
           case o_orderstatus when 'P' then 'pending' when 'F' then 'success' else 'failure' end as status,
           case o_orderstatus when 'O' then case o_orderkey % 3 when 0 then 'timeout' when 1 then 'script_failed'
                else 'spawn_error' end end as failure_reason,
           case o_orderstatus when 'O' then cast(case o_orderkey % 4 when 0 then 2 when 1 then 1 when 2 then 3
                else 0 end as int) when 'F' then 0 end as exit_code,
           case when o_orderkey % 50 = 1 then true when o_orderkey % 50 = 2 then false end as task_policy,
           cast(o_orderdate as timestamp) as created_at,
           cast(o_orderdate as timestamp) + interval 1 day as deadline_at
    from {d.table('orders')}"""


def _report_jobs(d: Dialect) -> str:
    q = '"'
    return f"""
    select concat('job-', {d.s('o_orderkey')}) as job_id,
           case when o_orderkey % 2 = 0 then 'customer_report' else 'engineer_report' end as job_type,
           case o_orderkey % 3 when 0 then 'environment' else 'server' end as scope,
           case when o_orderkey % 3 = 2
                then concat('{{{q}server_id{q}:{q}pub-', {d.s('o_custkey')}, '{q},{q}view{q}:{q}customer{q}}}')
                when o_orderkey % 3 = 1
                then concat('{{{q}server_ids{q}:[{q}pub-', {d.s('o_custkey')}, '{q},{q}pub-', {d.s('o_custkey + 1')},
                            '{q}],{q}view{q}:{q}engineer{q}}}')
                else '{{{q}view{q}:{q}customer{q}}}' end as input_params,
           case o_orderstatus when 'P' then 'running' when 'F' then 'done' else 'failed' end as status,
           cast(o_orderdate as timestamp) as created_at
    from {d.table('orders')}"""


def _samples(d: Dialect) -> str:
    return f"""
    select server_id, dim, ts, v_cents,
           cast(sum(v_cents) over (partition by server_id, dim, cast(ts as date) order by ts
                rows between unbounded preceding and current row) as bigint) as cnt
    from (select user_id as server_id, event_type as dim, date_trunc('hour', cast(ts as timestamp)) as ts,
                 cast(sum(cast(round(value * 100) as bigint)) as bigint) as v_cents
          from {d.table('events')} group by 1, 2, 3) x"""


VIEWS = {
    "host_hour": (_host_hour, ()),
    "host_cum": (_host_cum, ("host_hour",)),
    "inventory": (_inventory, ()),
    "host_metrics": (_host_metrics, ("host_hour", "host_cum")),
    "disk_io": (_disk_io, ("host_hour", "host_cum")),
    "net_io": (_net_io, ("host_hour", "host_cum")),
    "filesystem": (_filesystem, ("host_hour",)),
    "cpu_core": (_cpu_core, ("host_hour", "host_cum")),
    "pressure": (_pressure, ("host_hour", "host_cum")),
    "disk_error": (_disk_error, ("host_hour", "host_cum")),
    "inventory_history": (_history, ("host_hour", "host_cum", "host_metrics")),
    "tasks": (_tasks, ()),
    "report_jobs": (_report_jobs, ()),
    "samples": (_samples, ()),
}


def ctes(names: list[str] | tuple[str, ...], d: Dialect) -> list[str]:
    """CTE texts for the named views and what they read, in dependency order."""
    wanted: list[str] = []
    for n in names:
        for dep in (*VIEWS[n][1], n):
            if dep not in wanted:
                wanted.append(dep)
    return [f"{n} as ({VIEWS[n][0](d)})" for n in wanted]


def _prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One telemetry view as a lazy DataFrame over the Parquet tables in ``sf_dir``."""
    _prepare(spark)
    d = Dialect("spark", sf_dir)
    return spark.sql(f"with {', '.join(ctes([name], d))} select * from {name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as it is."""
    _prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
