"""Inventory facts: OS support, labels, storage layers and tree, interfaces, addresses and subnets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.exprs import VIRTUAL_FSTYPES, bytes_to_gb, data_volume, ipv4_network, ipv4_number, ipv4_text
from fleetlens.operators.devices import PHYSICAL_KINDS

HOST = "server_id"

# OS id of the host -> product of the support catalog.
OS_PRODUCT = {"debian": "debian", "ubuntu": "ubuntu", "rhel": "rhel", "rocky": "rocky-linux", "almalinux": "almalinux",
              "centos": "centos", "sles": "sles", "opensuse": "opensuse", "amzn": "amazon-linux", "fedora": "fedora",
              "ol": "oracle-linux", "oracle": "oracle-linux"}
# Kernel build of old Windows servers -> label.
WINDOWS_BUILDS = {"9600": "2012 R2", "9200": "2012", "7601": "2008 R2", "6003": "2008", "3790": "2003", "2195": "2000"}
SUPPORT_ORDER = ["full", "security_only", "paid_only", "ended"]
SPANNING_KINDS = ["raid", "mpath", "dynamic"]
UNALLOCATED_MIN = 64 * 1024 * 1024


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


# --- OS -----------------------------------------------------------------------------------------------------------

def distro(os_id: str = "os_id") -> Column:
    return F.when(F.col(os_id) == "windows", "windows-server").otherwise(
        F.coalesce(_map(OS_PRODUCT)[F.col(os_id)], F.col(os_id), F.lit("")))


def windows_label(product_name: str = "product_name") -> Column:
    """Year (with R2) of a server product name, or the client generation; NULL if the name carries neither."""
    year = F.regexp_extract(product_name, r"(?i)Windows Server (\d{4})", 1)
    r2 = F.col(product_name).rlike(r"(?i)Windows Server \d{4}\s+R2")
    client = F.regexp_extract(product_name, r"(?i)Windows (10|11)\b", 1)
    return F.when(year != "", F.when(r2, F.concat(year, F.lit(" R2"))).otherwise(year)).when(client != "", client)


def os_label() -> Column:
    """``os_id version``; Windows takes the product name, then the version, then the kernel build."""
    build = _map(WINDOWS_BUILDS)[F.split_part(F.col("kernel_version"), F.lit("."), F.lit(1))]
    version = F.when(F.col("os_id") == "windows", F.coalesce(
        windows_label(), F.nullif(F.col("os_version"), F.lit("")), build)).otherwise(F.nullif(F.col("os_version"), F.lit("")))
    text = F.concat_ws(" ", F.nullif(F.col("os_id"), F.lit("")), version)
    return F.when(text == "", "-").otherwise(text)


def support_status(support: Column, eol: Column, extended: Column, today: Column) -> Column:
    """Stage of a release: a missing border means that the stage does not exist."""
    return (F.when(extended <= today, "ended")
            .when(eol <= today, F.when(extended.isNotNull(), "paid_only").otherwise("ended"))
            .when(support <= today, "security_only").otherwise("full"))


def os_support(inventory: DataFrame, catalog: DataFrame, today: Column) -> DataFrame:
    """Support stage per host. The catalog is folded to one row per product (its releases in order), so the inventory
    meets it in one equi join and each host picks its release inside the row."""
    stage = support_status(F.col("support"), F.col("eol"), F.col("extended"), today)
    rank = F.array_position(F.array(*[F.lit(x) for x in SUPPORT_ORDER]), stage)
    folded = catalog.groupBy("product").agg(F.sort_array(F.collect_list(F.struct(
        "pos", "cycle", "build", "eol", stage.alias("stage"), rank.alias("rank")))).alias("releases"))
    j = inventory.select(HOST, "os_id", "os_version", "kernel_version", distro().alias("product")).join(folded, "product", "left")
    j = j.withColumns({
        "_build": F.coalesce(F.split_part("kernel_version", F.lit("."), F.lit(1)), F.lit("")),
        "_ver": F.coalesce("os_version", F.lit(""))})
    j = j.withColumn("hits", F.expr(
        "filter(releases, r -> if(os_id = 'windows', r.build = _build, _ver = r.cycle or startswith(_ver, concat(r.cycle, '.'))))"))
    linux = F.get("hits", F.lit(0))
    last = F.expr("element_at(array_sort(hits, (a, b) -> case when a.eol <> b.eol then if(a.eol > b.eol, -1, 1) else a.pos - b.pos end), 1)")
    mild = F.expr("array_min(transform(hits, r -> r.rank))").cast("int")
    win = F.col("os_id") == "windows"
    some = F.size("hits") > 0
    j = j.withColumn("_rep", F.when(some, F.when(win, last).otherwise(linux)))
    status = F.when(some, F.when(win, F.get(F.array(*[F.lit(x) for x in SUPPORT_ORDER]), mild - 1)).otherwise(F.col("_rep.stage")))
    return j.select(HOST, F.coalesce(status, F.lit("unknown")).alias("support"), F.col("_rep.eol").alias("eol"),
                    F.col("_rep.cycle").alias("cycle"))


def support_counts(support: DataFrame) -> DataFrame:
    return support.groupBy("support").agg(F.count("*").alias("hosts"))


# --- storage ------------------------------------------------------------------------------------------------------

def storage_layers(inventory: DataFrame) -> DataFrame:
    """Provisioned disk, swap, mounted data volumes and what is left, per host, inside the row."""
    def total(cond: str) -> Column:
        return F.expr(f"aggregate(filter(coalesce(block_devices, array()), d -> {cond}), 0L, "
                      "(a, d) -> a + coalesce(d.size_bytes, 0L))")

    virtual = ", ".join(f"'{t}'" for t in VIRTUAL_FSTYPES)
    volume = ("d.mountpoint is not null and d.mountpoint <> '' and coalesce(d.type, '') <> 'swap' and "
              f"coalesce(d.fstype, '') not in ({virtual}) and not startswith(d.mountpoint, '/boot')")
    s = inventory.select(HOST, total("d.type = 'disk'").alias("disk_bytes"), total("d.type = 'swap'").alias("swap_bytes"),
                         total(volume).alias("volume_bytes"))
    disk, vol = bytes_to_gb(F.col("disk_bytes")), F.when(F.col("volume_bytes") > 0, bytes_to_gb(F.col("volume_bytes")))
    return s.withColumns({"disk_gb": disk, "volume_gb": vol,
                          "unallocated_gb": F.bround(F.greatest(F.lit(0.0), disk - vol), 2)})


def storage_tree(inventory: DataFrame, latest_mounts: DataFrame | None = None) -> DataFrame:
    """Block devices as a tree: root disk, path and depth per node, arrays placed once, free gaps added.

    The devices of a host are one array, so each node climbs to its root inside the row; the length of the
    array bounds the steps, which also ends cycles.
    An array listed under several parents lives where a walk down from the first root reaches it first, whatever the
    order of the list; its other entries are ``raid_member`` stubs.
    """
    # the walk meets the entries in the order of their paths, the positions from a root down: all paths grow one step a
    # round, from the least path of the parent's entries; roots are the disks, then entries without a parent in the list
    root = "x.parent is null or not exists(block_devices, y -> y.id = x.parent)"
    start = f"transform(block_devices, (x, i) -> if({root}, array(if(x.type = 'disk', 0, 1), i), cast(null as array<int>)))"
    grow = ("transform(block_devices, (x, i) -> coalesce(if(" + root + ", acc[i], null), concat(array_min(filter(transform(block_devices, (y, j) -> "
            "if(y.id = x.parent and j <> i, acc[j], null)), p -> p is not null)), array(i))))")
    paths = F.expr(f"aggregate(sequence(1, greatest(1, size(block_devices))), {start}, (acc, k) -> {grow})")
    nodes = inventory.select(HOST, "lvm_vgs", "block_devices").withColumn("paths", paths)
    # the home of every entry's id: the entry with the least path, of entries that no root reaches the first one
    home = ("transform(block_devices, (x, i) -> array_min(filter(transform(block_devices, (y, j) -> if(y.id = x.id, named_struct('far', paths[j] is null, 'path', paths[j], 'pos', j), null)), "
            "p -> p is not null)).pos)")
    nodes = nodes.withColumn("homes", F.expr(home)).select(HOST, "lvm_vgs", "block_devices", "homes", F.posexplode("block_devices").alias("pos", "d"))
    nodes = nodes.select(HOST, "pos", "lvm_vgs", "block_devices", "homes", "d.*")
    # climb: the parent entry is the home of the parent's id
    step = ("named_struct('up', p.parent, 'root', if(p.type = 'disk', p.name, acc.root), 'path', concat(p.name, '/', acc.path), "
            "'depth', acc.depth + 1)")
    climb = F.expr(
        "aggregate(sequence(1, size(block_devices)), named_struct('up', parent, 'root', if(type = 'disk', name, cast(null as string)), "
        "'path', name, 'depth', 0), (acc, i) -> coalesce(get(transform(filter(block_devices, (x, j) -> x.id = acc.up and homes[j] = j), "
        f"p -> {step}), 0), named_struct('up', cast(null as string), 'root', acc.root, 'path', acc.path, 'depth', acc.depth)))")
    nodes = nodes.withColumn("c", climb).withColumns({
        "root_disk": F.col("c.root"), "path": F.col("c.path"), "depth": F.col("c.depth"),
        "first_pos": F.col("homes")[F.col("pos")]})
    stub = F.col("id").isNotNull() & (F.col("pos") != F.col("first_pos"))
    kids = F.expr("aggregate(filter(block_devices, x -> x.parent = id), 0L, (a, x) -> a + coalesce(x.size_bytes, 0L))")
    nodes = nodes.withColumns({"kind": F.when(stub & F.col("type").isin(SPANNING_KINDS), "raid_member").otherwise(F.col("type")),
                               "gap": F.when(F.col("type") == "disk", F.coalesce("size_bytes", F.lit(0)) - F.coalesce(kids, F.lit(0)))})
    nodes = nodes.filter(~stub | F.col("type").isin(SPANNING_KINDS))
    base = nodes.select(HOST, "root_disk", "path", "depth", "name", "kind", "size_bytes", "mountpoint", "fstype")
    gaps = nodes.filter(F.col("gap") >= UNALLOCATED_MIN).select(
        HOST, "root_disk", F.concat("path", F.lit("/(unallocated)")).alias("path"), (F.col("depth") + 1).alias("depth"),
        F.lit("(unallocated)").alias("name"), F.lit("unallocated").alias("kind"), F.col("gap").alias("size_bytes"),
        F.lit(None).cast("string").alias("mountpoint"), F.lit(None).cast("string").alias("fstype"))
    vg = nodes.withColumn("vg", F.expr("array_distinct(transform(filter(block_devices, x -> x.parent = id and x.type = 'lvm' "
                                       "and x.lvm_vg is not null), x -> x.lvm_vg))"))
    vg = vg.select(HOST, "root_disk", "path", "depth", "lvm_vgs", F.explode("vg").alias("vg")).selectExpr(
        HOST, "root_disk", "concat(path, '/', vg) as path", "depth + 1 as depth", "vg as name", "'vg_free' as kind",
        "get(transform(filter(lvm_vgs, v -> v.name = vg), v -> v.free_bytes), 0) as size_bytes",
        "cast(null as string) as mountpoint", "cast(null as string) as fstype")
    tree = base.unionByName(gaps).unionByName(vg)
    if latest_mounts is None:
        return tree
    usage = latest_mounts.filter(data_volume()).select(HOST, "mountpoint", "used_bytes", "free_bytes")
    return tree.join(usage, [HOST, "mountpoint"], "left")


# --- network ------------------------------------------------------------------------------------------------------

def interfaces(inventory: DataFrame) -> DataFrame:
    n = inventory.select(HOST, F.posexplode("net_interfaces").alias("pos", "n"))
    return n.select(HOST, "pos", "n.*").filter(F.col("kind").isin(PHYSICAL_KINDS))


def network_interfaces(inventory: DataFrame, link_speed: DataFrame) -> DataFrame:
    """Physical interfaces; an unknown speed falls back to the newest link gauge of ``id_type:id``."""
    n = interfaces(inventory).withColumn("iface_id", F.concat("id_type", F.lit(":"), "id"))
    j = n.join(link_speed, [HOST, "iface_id"], "left")
    return j.select(HOST, "name", "kind", "gateway", F.size("addresses").alias("address_count"), F.coalesce(
        F.col("speed_mbps").cast("bigint"), F.bround(F.col("link_speed_bps") / 1e6).cast("bigint")).alias("speed_mbps"))


def primary_ip() -> Column:
    """First IPv4 address of the first physical interface that has one."""
    kinds = ", ".join(f"'{k}'" for k in PHYSICAL_KINDS)
    return F.expr(f"get(flatten(transform(filter(net_interfaces, n -> n.kind in ({kinds})), n -> transform(filter("
                  "coalesce(n.addresses, array()), a -> a.family = 'ipv4'), a -> a.address))), 0)")


def members(inventory: DataFrame) -> DataFrame:
    """(host, network) membership: usable IPv4 addresses of physical interfaces, one per host and network."""
    a = interfaces(inventory).select(HOST, "pos", "gateway", F.posexplode("addresses").alias("apos", "a"))
    num = ipv4_number(F.col("a.address"))
    a = a.select(HOST, "pos", "apos", "gateway", F.col("a.address").alias("ip"), num.alias("num"), F.col("a.prefix").alias("prefix"),
                 F.col("a.family").alias("family"))
    ok = ((F.col("family") == "ipv4") & F.col("num").isNotNull() & (F.col("prefix") > 0) & (F.col("prefix") < 32)
          & (F.floor(F.col("num") / F.lit(1 << 24)) != 127) & (F.floor(F.col("num") / F.lit(1 << 16)) != 43518))
    a = a.filter(ok).withColumn("net", ipv4_network(F.col("num"), F.col("prefix")))
    first = F.struct("pos", "apos")
    g = a.groupBy(HOST, "net", "prefix").agg(F.min_by("ip", first).alias("ip"), F.min_by("num", first).alias("num"),
                                             F.min_by("gateway", first).alias("gateway"))
    return g.withColumn("subnet", F.concat(ipv4_text(F.col("net")), F.lit("/"), F.col("prefix").cast("string")))


def subnet_segments(inventory: DataFrame) -> DataFrame:
    """Members by segment: a subnet with two or more gateways is split by gateway (members without one drop out)."""
    m = members(inventory)
    ways = m.filter(F.col("gateway").isNotNull()).select("subnet", "gateway").distinct().groupBy("subnet").agg(
        F.count("*").alias("ways"), F.min("gateway").alias("only_gateway"))
    j = m.join(ways, "subnet", "left").withColumn("split", F.coalesce(F.col("ways") >= 2, F.lit(False)))
    j = j.filter(~F.col("split") | F.col("gateway").isNotNull())
    return j.select(HOST, "subnet", "ip", "num", "net",
                    F.when(F.col("split"), F.concat("subnet", F.lit("#"), "gateway")).otherwise(F.col("subnet")).alias("segment"),
                    F.when(F.col("split"), F.col("gateway")).otherwise(F.col("only_gateway")).alias("segment_gateway"))


def shared_segments(inventory: DataFrame) -> DataFrame:
    """Host - segment edges of segments with at least two hosts."""
    s = subnet_segments(inventory)
    big = s.groupBy("segment").agg(F.count("*").alias("hosts")).filter(F.col("hosts") >= 2)
    return s.join(big, "segment")


def subnet_summary(edges: DataFrame) -> DataFrame:
    return edges.groupBy("segment").agg(F.min("subnet").alias("subnet"), F.min("net").alias("net"),
                                        F.min("segment_gateway").alias("gateway"), F.count("*").alias("host_count"))


def topology_counts(inventory: DataFrame) -> DataFrame:
    """One row: segments, hosts in them, multi-homed hosts, shared gateways, isolated hosts."""
    e = shared_segments(inventory)
    per_host = e.groupBy(HOST).agg(F.count("*").alias("n"))
    h = per_host.agg(F.count("*").alias("host_count"), F.count_if(F.col("n") >= 2).alias("multi_homed_count"))
    s = subnet_summary(e)
    seg = s.agg(F.count("*").alias("subnet_count"))
    gw = s.filter(F.col("gateway").isNotNull()).groupBy("gateway").agg(F.count("*").alias("n")).agg(
        F.count_if(F.col("n") >= 2).alias("router_count"))
    total = inventory.agg(F.count("*").alias("total"))
    out = h
    for one in (seg, gw, total):
        out = out.withColumn("_k", F.lit(1)).join(one.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return out.withColumn("isolated_count", F.col("total") - F.col("host_count")).drop("total")


def ip_order(address: str) -> list[Column]:
    """Sort keys: addresses by number, unreadable ones last."""
    return [F.asc_nulls_last(ipv4_number(address)), F.asc(address)]


def reproduction(inventory: DataFrame, link_speed: DataFrame) -> DataFrame:
    """Normalised device and interface facts as long rows: RAID level number, bond mode, sizes, speeds."""
    d = inventory.select(HOST, F.posexplode("block_devices").alias("pos", "d")).select(
        HOST, F.lit("device").alias("part"), "pos", F.col("d.name").alias("name"), F.col("d.type").alias("kind"),
        F.col("d.size_bytes").alias("size"), raid_level(F.col("d.raid_level")).cast("string").alias("detail"))
    n = interfaces(inventory).withColumn("iface_id", F.concat("id_type", F.lit(":"), "id")).join(link_speed, [HOST, "iface_id"], "left")
    n = n.select(HOST, F.lit("interface").alias("part"), "pos", "name", "kind",
                 F.coalesce(F.col("speed_mbps").cast("bigint"), F.floor(F.col("link_speed_bps") / 1000000)).alias("size"),
                 bond_mode(F.col("bond_mode")).alias("detail"))
    v = inventory.select(HOST, F.posexplode("lvm_vgs").alias("pos", "v")).select(
        HOST, F.lit("volume_group").alias("part"), "pos", F.col("v.name").alias("name"), F.lit("lvm").alias("kind"),
        F.col("v.size_bytes").alias("size"), F.lit(None).cast("string").alias("detail"))
    return d.unionByName(n).unionByName(v)


# Kernel bond mode -> reported mode.
BOND_MODES = {"802.3ad": "lacp", "active-backup": "active-backup", "balance-rr": "balance-rr", "balance-xor": "balance-xor",
              "broadcast": "broadcast", "balance-tlb": "balance-tlb", "balance-alb": "balance-alb"}


def raid_level(v: Column) -> Column:
    """Number of a RAID level such as ``raid1`` or ``10``; other kinds have none."""
    digits = F.regexp_extract(F.lower(v), r"^(?:raid)?(\d+)$", 1)
    return F.nullif(digits, F.lit("")).cast("int")


def bond_mode(v: Column) -> Column:
    return _map(BOND_MODES)[v]
