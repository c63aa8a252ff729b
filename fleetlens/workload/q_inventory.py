"""Inventory side: classification of services, OS support, storage, addresses and subnets."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import classify as C
from fleetlens.functions.exprs import data_volume, timestamp
from fleetlens.operators import devices as D
from fleetlens.operators import inventory as I
from fleetlens.operators.kernels import latest_one
from fleetlens.sources.catalogs import COMMON_RELEASES, common_releases, load_catalog, save_catalog
from fleetlens.streaming.streams import work_folder
from fleetlens.workload.registry import Context, library, query
from fleetlens.workload.q_trends import END, VOLUME

HOST = "server_id"


def _values(rows):
    return "(values " + ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() for v in r) + ")" for r in rows) + ")"


library("kw", f"select * from {_values([(i, k, c) for i, (k, c) in enumerate(C.keyword_pairs())])} t(pos, word, cat)")
library("pc", f"select * from {_values(list(C.port_categories().items()))} t(port, cat)")
library("wk", f"select * from {_values([(n, p) for ns in C.PORTS.values() for n, ps in ns.items() for p in ps])} t(name, port)")
library("base_kw", f"select * from {_values([(k,) for k in C.BASELINE_KEYWORDS])} t(word)")
_BP = ", ".join(map(str, C.BASELINE_PORTS))
library("sock", f"""
    select s.*, c.cat as kcat, pc.cat as pcat,
           exists (select 1 from base_kw b where contains(s.comm, b.word)) or s.port in ({_BP}) as base
    from (select server_id, p.proto as proto, p.port as port, p.pid as pid, lower(coalesce(p.comm, '')) as comm
          from (select server_id, unnest(listen_ports) as p from inventory) x) s
    left join (select comm, arg_min(cat, pos) as cat from (select distinct lower(coalesce(p.comm, '')) as comm from (select unnest(listen_ports) as p from inventory) y) d
               join kw on contains(d.comm, kw.word) group by comm) c using (comm)
    left join pc using (port)""", ("inventory", "kw", "pc", "base_kw"))
library("svc", """
    select server_id, pos, s.unit as unit, s.sub as sub, s.pid as pid, regexp_replace(s.unit, '[.]service$', '') as display_name,
           regexp_replace(lower(s.unit), '[.]service$', '') as name
    from (select server_id, unnest(services) as s, generate_subscripts(services, 1) - 1 as pos from inventory) x""", ("inventory",))
library("svc_named", """
    select v.*, n.cat as name_cat, exists (select 1 from base_kw b where contains(lower(v.unit), b.word)) as baseline
    from svc v left join (select name, arg_min(cat, pos) as cat from (select distinct name from svc) d join kw on contains(d.name, kw.word) group by name) n using (name)""",
        ("svc", "kw", "base_kw"))
library("own", """
    select distinct v.server_id, v.pos, k.proto, k.port, k.kcat, k.pcat, v.pid is not null as exact
    from svc v join sock k on v.server_id = k.server_id and (case when v.pid is not null then k.pid = v.pid else
      (k.comm <> '' and k.comm <> 'systemd' and (contains(k.comm, v.name) or contains(v.name, k.comm)))
      or exists (select 1 from wk where wk.name = v.name and wk.port = k.port) end)""", ("svc", "sock", "wk"))
library("svc_cat", """
    select v.*, coalesce(name_cat, k, p, 'unknown') as category,
           case when pid is null then coalesce(name_cat, k, p, 'unknown') else coalesce(name_cat, 'unknown') end as loose_cat
    from svc_named v left join (select server_id, pos, arg_min(kcat, port * 10 + length(proto)) filter (where kcat is not null) as k,
                                       arg_min(pcat, port * 10 + length(proto)) filter (where pcat is not null) as p
                                from own group by 1, 2) o using (server_id, pos)""", ("svc_named", "own"))
library("matched", """
    select distinct v.server_id, v.pos, v.category, k.proto, k.port from svc_cat v join sock k using (server_id)
    where case when k.pid is not null then k.pid = v.pid else v.loose_cat <> 'unknown' and k.pcat = v.loose_cat end""", ("svc_cat", "sock"))
library("heard", "select distinct server_id, proto, port, coalesce(kcat, pcat) as category from sock where coalesce(kcat, pcat) is not null", ("sock",))
library("work", """
    select server_id, category, case when named is null or category = 'container' then 1 else named end as instances, named is null as listen_only
    from (select server_id, category, count(*) as named from svc_cat where not baseline and category <> 'unknown' group by 1, 2) n
    full join (select distinct server_id, coalesce(kcat, pcat) as category from sock where not base and coalesce(kcat, pcat) is not null) h using (server_id, category)""",
        ("svc_cat", "sock"))

query("keyword_theta_join", "select server_id, unit, name_cat as category from svc_named", ("svc_named",))(
    lambda c: c["inventory"].selectExpr(HOST, "explode(services) as s").selectExpr(
        HOST, "s.unit as unit", "regexp_replace(lower(s.unit), '[.]service$', '') as name").select(
        HOST, "unit", C.match_keyword("name").alias("category")))
query("pid_port_join", "select v.server_id, v.unit, o.proto, o.port from own o join svc v using (server_id, pos)", ("own", "svc"))(
    lambda c: C.service_items(c["inventory"]).selectExpr(HOST, "unit", "explode(attributed) as p").selectExpr(HOST, "unit", "p.proto as proto", "p.port as port"))
query("classify_service", "select server_id, unit, category, baseline from svc_cat", ("svc_cat",))(
    lambda c: C.service_items(c["inventory"]).select(HOST, "unit", "category", "baseline"))
query("match_ports", "select m.server_id, v.unit, m.proto, m.port from matched m join svc v using (server_id, pos)", ("matched", "svc"))(
    lambda c: C.service_items(c["inventory"]).selectExpr(HOST, "unit", "explode(matched) as p").selectExpr(HOST, "unit", "p.proto as proto", "p.port as port"))
query("listen_categories", "select * from heard", ("heard",))(lambda c: C.listen_items(c["inventory"]))
query("workload_counter", "select * from work", ("work",))(lambda c: C.workload_counts(c["inventory"]))
query("infer_role", """
    select server_id, coalesce(role, 'unknown') as role from inventory left join (
      select server_id, category as role from work qualify row_number() over (partition by server_id order by instances desc, category) = 1) r using (server_id)""",
      ("inventory", "work"))(lambda c: C.infer_role(C.workload_counts(c["inventory"]), c["inventory"]))
query("category_union", """
    select server_id, coalesce(cats, '') as categories from inventory left join (
      select server_id, string_agg(category, ',' order by category) as cats from work group by 1) w using (server_id)""", ("inventory", "work"))(
    lambda c: C.service_categories(c["inventory"]).select(HOST, F.array_join("categories", ",").alias("categories")))
query("listen_only_hosts", "select server_id, category from work where listen_only", ("work",))(lambda c: C.listen_only_hosts(c["inventory"]))
_SIG = ", ".join(f"'{s}'" for s in C.SIGNATURE)
query("service_catalog_rollup", f"""
    select f.category, coalesce(t.total_hosts, 0) as total_hosts, r.service, r.hosts
    from {_values([(s,) for s in C.SIGNATURE])} f(category)
    left join (select category, count(*) as total_hosts from work group by 1) t using (category)
    left join (select category, display_name as service, count(distinct server_id) as hosts from svc_cat where not baseline and category <> 'container' group by 1, 2
               union all select 'container', string_agg(distinct display_name, ', ' order by display_name), count(distinct server_id) from svc_cat where category = 'container' and not baseline
               union all select category, '(port)', count(*) from work where listen_only group by 1) r using (category)""", ("work", "svc_cat"))(
    lambda c: C.service_catalog(c["inventory"]))
library("rollup_ports", """
    select server_id, category, proto, port from (select server_id, category, proto, port from matched where category <> 'unknown'
      union select server_id, category, proto, port from heard) u
    join (select server_id, category, min(rk) as rk from (
            select server_id, category, pos as rk from svc_cat where category <> 'unknown'
            union all select server_id, category, 1000000 + port from heard) r group by 1, 2) k using (server_id, category)
    qualify row_number() over (partition by server_id, proto, port order by rk, category) = 1""", ("matched", "heard", "svc_cat"))
query("service_rollup", """
    select k.server_id, k.category, u.display_name as unit, coalesce(p.ports, '') as ports
    from (select server_id, category from svc_cat where category <> 'unknown' union select server_id, category from heard) k
    left join (select server_id, category, arg_min(display_name, case when exists (select 1 from matched m where m.server_id = s.server_id and m.pos = s.pos) then pos else 1000 + pos end) as display_name
               from svc_cat s where category <> 'unknown' group by 1, 2) u using (server_id, category)
    left join (select server_id, category, string_agg(port || '/' || proto, ',' order by port, proto) as ports from rollup_ports group by 1, 2) p using (server_id, category)""",
      ("svc_cat", "matched", "rollup_ports"))(
    lambda c: C.service_rollup(c["inventory"]).select(HOST, "category", "unit", F.expr(
        "coalesce(array_join(transform(ports, p -> concat(p.port, '/', p.proto)), ','), '') as ports")))
query("listen_port_significant", """
    select server_id, port, proto, comm from (select server_id, p.port as port, p.proto as proto, p.comm as comm from (select server_id, unnest(listen_ports) as p from inventory) x) s
    where port < 49152 and not exists (select 1 from rollup_ports r where r.server_id = s.server_id and r.port = s.port)""", ("inventory", "rollup_ports"))(
    lambda c: C.significant_ports(c["inventory"]))

# --- OS support ---------------------------------------------------------------------------------------------------

_TODAY = "date '2024-07-15'"
library("releases", f"""
    select product, cycle, build, cast(support as date) as support, cast(eol as date) as eol, cast(extended as date) as extended, pos
    from {_values([(p, cy, b, s, e, x, i) for i, (p, cy, b, s, e, x) in enumerate(COMMON_RELEASES)])} t(product, cycle, build, support, eol, extended, pos)""")
library("os_hits", f"""
    select i.server_id, i.os_id, r.*, case when extended <= {_TODAY} then 'ended' when eol <= {_TODAY} then case when extended is not null then 'paid_only' else 'ended' end
           when support <= {_TODAY} then 'security_only' else 'full' end as stage
    from inventory i join releases r on r.product = case i.os_id when 'windows' then 'windows-server' when 'rocky' then 'rocky-linux' else i.os_id end
     and case when i.os_id = 'windows' then r.build = split_part(i.kernel_version, '.', 1)
              else i.os_version = r.cycle or starts_with(i.os_version, r.cycle || '.') end""", ("inventory", "releases"))
library("os_support", """
    select server_id, coalesce(support, 'unknown') as support, eol, cycle from inventory left join (
      select server_id, case min(case stage when 'full' then 0 when 'security_only' then 1 when 'paid_only' then 2 else 3 end)
               when 0 then 'full' when 1 then 'security_only' when 2 then 'paid_only' else 'ended' end as support, max(eol) as eol, arg_max(cycle, eol) as cycle
      from os_hits where os_id = 'windows' group by 1
      union all select server_id, arg_min(stage, pos), arg_min(eol, pos), arg_min(cycle, pos) from os_hits where os_id <> 'windows' group by 1) s using (server_id)""",
        ("inventory", "os_hits"))


def support(c: Context):
    return I.os_support(c["inventory"], common_releases(c.spark), F.to_date(F.lit("2024-07-15")))


query("os_support_status", "select server_id, support, cast(eol as varchar) as eol, cycle from os_support", ("os_support",))(
    lambda c: support(c).withColumn("eol", F.col("eol").cast("string")))
query("catalog_prefix_join", "select server_id, cycle from os_support join inventory using (server_id) where os_id <> 'windows'", ("os_support", "inventory"))(
    lambda c: I.os_support(c["inventory"].filter("os_id <> 'windows'"), common_releases(c.spark), F.to_date(F.lit("2024-07-15"))).select(HOST, "cycle"))
query("catalog_build_join", "select server_id, cycle, support from os_support join inventory using (server_id) where os_id = 'windows'", ("os_support", "inventory"))(
    lambda c: I.os_support(c["inventory"].filter("os_id = 'windows'"), common_releases(c.spark), F.to_date(F.lit("2024-07-15"))).select(HOST, "cycle", "support"))
query("os_support_counts", "select support, count(*) as hosts from os_support group by 1", ("os_support",))(lambda c: I.support_counts(support(c)))
query("os_labels", """
    select server_id, case os_id when 'windows' then 'windows-server' when 'rocky' then 'rocky-linux' else os_id end as distro,
           case when os_id = 'windows' and product_name is not null then 'windows 2019' else os_id || ' ' || os_version end as label from inventory""", ("inventory",))(
    lambda c: c["inventory"].select(HOST, I.distro().alias("distro"), I.os_label().alias("label")))
query("load_catalog", "select product, count(*) as releases, cast(max(eol) as varchar) as last_eol, count(distinct server_id) as hosts from os_hits group by 1", ("os_hits",))(
    lambda c: _catalog_use(c))


def _catalog_use(c: Context):
    """Hosts per product of a catalog that is read from its file."""
    path = c.once("catalog-file", lambda: work_folder(c.spark, "catalog"))
    save_catalog(common_releases(c.spark), path)
    cat = load_catalog(c.spark, path)
    inv = c["inventory"].select(HOST, "os_id", "os_version", "kernel_version", I.distro().alias("product"))
    j = inv.join(cat, "product").filter(F.expr(
        "if(os_id = 'windows', build = split_part(kernel_version, '.', 1), os_version = cycle or startswith(os_version, concat(cycle, '.')))"))
    return j.groupBy("product").agg(F.count("*").alias("releases"), F.max("eol").cast("string").alias("last_eol"),
                                    F.count_distinct(HOST).alias("hosts"))


# --- storage ------------------------------------------------------------------------------------------------------

library("dev", "select server_id, b.*, pos from (select server_id, unnest(block_devices) as b, generate_subscripts(block_devices, 1) - 1 as pos from inventory) x", ("inventory",))
library("layers", """
    select server_id, cast(coalesce(sum(size_bytes) filter (where type = 'disk'), 0) as bigint) as disk_bytes, cast(coalesce(sum(size_bytes) filter (where type = 'swap'), 0) as bigint) as swap_bytes,
           cast(coalesce(sum(size_bytes) filter (where mountpoint is not null and type <> 'swap'), 0) as bigint) as volume_bytes from dev group by 1""", ("dev",))
query("storage_layers", """
    select *, greatest(0.0, disk_gb - volume_gb) as unallocated_gb from (
      select *, disk_bytes / 1073741824 as disk_gb, volume_bytes / 1073741824 as volume_gb from layers) l""", ("layers",),
      ("disk_gb", "volume_gb", "unallocated_gb"))(lambda c: I.storage_layers(c["inventory"]))
query("disk_total", "select server_id, disk_bytes from layers", ("layers",))(lambda c: I.storage_layers(c["inventory"]).select(HOST, "disk_bytes"))
query("swap_total", "select server_id, swap_bytes from layers", ("layers",))(lambda c: I.storage_layers(c["inventory"]).select(HOST, "swap_bytes"))
query("storage_tree", f"""
    with recursive home as (select *, row_number() over (partition by server_id, coalesce(id, 'p' || pos) order by pos) as nth from dev),
    walk as (
      select server_id, pos, id, name, type, size_bytes, mountpoint, fstype, nth, case when type = 'disk' then name end as root_disk, name as path, 0 as depth, parent as up from home
      union all
      select w.server_id, w.pos, w.id, w.name, w.type, w.size_bytes, w.mountpoint, w.fstype, w.nth, case when h.type = 'disk' then h.name else w.root_disk end, h.name || '/' || w.path, w.depth + 1, h.parent
      from walk w join home h on h.server_id = w.server_id and h.id = w.up and h.nth = 1),
    node as (select * from walk qualify row_number() over (partition by server_id, pos order by depth desc) = 1),
    gap as (select n.*, n.size_bytes - coalesce((select sum(k.size_bytes) from dev k where k.server_id = n.server_id and k.parent = n.id), 0) as free from node n where type = 'disk'),
    tree as (
      select server_id, root_disk, path, depth, name, case when nth > 1 then 'raid_member' else type end as kind, size_bytes, mountpoint from node
      union all select server_id, root_disk, path || '/(unallocated)', depth + 1, '(unallocated)', 'unallocated', cast(free as bigint), null from gap where free >= 67108864
      union all select n.server_id, n.root_disk, n.path || '/vg0', n.depth + 1, 'vg0', 'vg_free', 20 * cast(1073741824 as bigint), null from node n
        where exists (select 1 from dev k where k.server_id = n.server_id and k.parent = n.id and k.type = 'lvm')),
    lastfs as (select server_id, mountpoint, arg_max(used_bytes, collected_at) as used_bytes, arg_max(free_bytes, collected_at) as free_bytes from filesystem where {VOLUME} group by 1, 2)
    select t.server_id, root_disk, path, depth, name, kind, size_bytes, t.mountpoint, used_bytes, free_bytes
    from tree t left join lastfs f on f.server_id = t.server_id and f.mountpoint = t.mountpoint""", ("dev", "filesystem"))(
    lambda c: I.storage_tree(c["inventory"], latest_one(c["filesystem"].filter(data_volume()), [HOST, "mountpoint"], [F.desc("collected_at")])).drop("fstype"))

# --- network ------------------------------------------------------------------------------------------------------

library("link", f"""
    select server_id, iface_id, arg_max(link_speed_bps, collected_at) as bps from net_io
    where link_speed_bps is not null and collected_at <= {END} group by 1, 2""", ("net_io",))
library("nic", """
    select server_id, pos, n.name as name, n.kind as kind, n.gateway as gateway, n.addresses as addresses, n.speed_mbps as speed_mbps, n.bond_mode as bond_mode, n.id_type || ':' || n.id as iface_id
    from (select server_id, unnest(net_interfaces) as n, generate_subscripts(net_interfaces, 1) - 1 as pos from inventory) x where n.kind in ('physical', 'bond_master')""", ("inventory",))


def link_speed(c: Context):
    return D.latest_link_speed(c["net_io"], timestamp("2024-01-01 00:00:00"), c.end)


query("network_interfaces", """
    select server_id, name, kind, gateway, case when addresses is null then null else len(addresses) end as address_count,
           coalesce(speed_mbps, cast(round(bps / 1000000.0) as bigint)) as speed_mbps from nic left join link using (server_id, iface_id)""", ("nic", "link"))(
    lambda c: I.network_interfaces(c["inventory"], link_speed(c)))
query("latest_link_speed", "select server_id, iface_id, bps as link_speed_bps from link", ("link",))(link_speed)
query("inventory_reproduction", """
    select server_id, 'device' as part, pos, name, type as kind, size_bytes as size, case when raid_level is not null then '1' end as detail from dev
    union all select server_id, 'interface', pos, name, kind, coalesce(speed_mbps, bps // 1000000), case when bond_mode = '802.3ad' then 'lacp' end from nic left join link using (server_id, iface_id)
    union all select server_id, 'volume_group', 0, 'vg0', 'lvm', 100 * cast(1073741824 as bigint), null from inventory""", ("dev", "nic", "link", "inventory"))(
    lambda c: I.reproduction(c["inventory"], link_speed(c)))
query("primary_ip", "select server_id, arg_min(ip, pos) as ip from (select server_id, pos, unnest(addresses).address as ip from nic) x group by 1", ("nic",))(
    lambda c: c["inventory"].select(HOST, I.primary_ip().alias("ip")))
library("member", """
    select distinct server_id, split_part(ip, '.', 1) || '.' || split_part(ip, '.', 2) || '.' || split_part(ip, '.', 3) || '.0/24' as subnet, ip, gateway
    from (select server_id, gateway, unnest(addresses).address as ip from nic) x""", ("nic",))
library("segment", """
    select server_id, m.subnet, ip, case when ways >= 2 then m.subnet || '#' || gateway else m.subnet end as segment, case when ways >= 2 then gateway else one end as segment_gateway
    from member m left join (select subnet, count(distinct gateway) as ways, min(gateway) as one from member group by 1) g on g.subnet = m.subnet
    where coalesce(ways, 0) < 2 or gateway is not null""", ("member",))
library("edge", "select *, count(*) over (partition by segment) as hosts from segment qualify count(*) over (partition by segment) >= 2", ("segment",))
query("subnet_self_join", "select server_id, segment, segment_gateway, ip, hosts from edge", ("edge",))(
    lambda c: I.shared_segments(c["inventory"]).select(HOST, "segment", "segment_gateway", "ip", "hosts"))
query("subnet_topology", "select segment, min(subnet) as subnet, min(segment_gateway) as gateway, count(*) as host_count from edge group by 1", ("edge",))(
    lambda c: I.subnet_summary(I.shared_segments(c["inventory"])).select("segment", "subnet", "gateway", "host_count"))
query("topology_counts", """
    select (select count(distinct server_id) from edge) as host_count, (select count(*) from (select server_id from edge group by 1 having count(*) >= 2) a) as multi_homed_count,
           (select count(distinct segment) from edge) as subnet_count,
           (select count(*) from (select gw from (select distinct segment, segment_gateway as gw from edge) s where gw is not null group by gw having count(*) >= 2) b) as router_count,
           (select count(*) from inventory) - (select count(distinct server_id) from edge) as isolated_count""", ("edge", "inventory"))(
    lambda c: I.topology_counts(c["inventory"]))
query("ip_numeric_order", """
    select server_id, ip, row_number() over (partition by subnet order by cast(split_part(ip, '.', 4) as int), server_id) as place from member""", ("member",))(
    lambda c: _ip_places(c))


def _ip_places(c: Context):
    from pyspark.sql import Window

    w = Window.partitionBy("subnet").orderBy(*I.ip_order("ip"), HOST)  # a subnet holds at most 2^(32 - prefix) addresses
    return I.members(c["inventory"]).select(HOST, "ip", F.row_number().over(w).alias("place"))


query("physical_disk_filter", "select server_id, device_id, count(*) as samples from disk_io join phys_disk using (server_id, device_id) group by 1, 2", ("disk_io", "phys_disk"))(
    lambda c: D.physical_disks(c["disk_io"], c["inventory"]).groupBy(HOST, "device_id").agg(F.count("*").alias("samples")))
query("physical_iface_filter", "select server_id, iface_id, count(*) as samples from net_io join phys_iface using (server_id, iface_id) group by 1, 2", ("net_io", "phys_iface"))(
    lambda c: D.physical_ifaces(c["net_io"], c["inventory"]).groupBy(HOST, "iface_id").agg(F.count("*").alias("samples")))
query("semi_join_inventory", "select count(*) as kept, (select count(*) from disk_io) as total from disk_io join phys_disk using (server_id, device_id)", ("disk_io", "phys_disk"))(
    lambda c: c["disk_io"].agg(F.count("*").alias("total")).withColumn("_k", F.lit(1)).join(
        D.physical_disks(c["disk_io"], c["inventory"]).agg(F.count("*").alias("kept")).withColumn("_k", F.lit(1)), "_k").drop("_k"))
query("lookup_display_name", """
    select server_id, device_id, min(b.name) as display_name from (select server_id, unnest(block_devices) as b from inventory) x
    join phys_disk using (server_id) where b.type = 'disk' and device_id in (b.id_type || ':' || b.id, 'name:' || b.name) group by 1, 2""", ("inventory", "phys_disk"))(
    lambda c: D.display_names(D.exploded_disks(c["inventory"]), "device_id"))
