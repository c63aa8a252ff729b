"""Which disks and interfaces are physical, taken from the nested inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Interface kinds that carry real traffic.
PHYSICAL_KINDS = ["physical", "bond_master"]


def exploded_disks(inventory: DataFrame) -> DataFrame:
    """One row per (host, device key) of a real disk; a disk is known by ``id_type:id`` or by ``name:<name>``."""
    d = inventory.select("server_id", F.posexplode("block_devices").alias("pos", "b")).filter(F.col("b.type") == "disk")
    keys = F.array(F.concat(F.col("b.id_type"), F.lit(":"), F.col("b.id")), F.concat(F.lit("name:"), F.col("b.name")))
    return d.select("server_id", "pos", F.col("b.name").alias("name"),
                    F.explode(F.array_compact(keys)).alias("device_id"))


def exploded_ifaces(inventory: DataFrame) -> DataFrame:
    n = inventory.select("server_id", F.posexplode("net_interfaces").alias("pos", "n"))
    return n.filter(F.col("n.kind").isin(PHYSICAL_KINDS)).select(
        "server_id", "pos", F.col("n.name").alias("name"),
        F.concat(F.col("n.id_type"), F.lit(":"), F.col("n.id")).alias("iface_id")).filter(F.col("iface_id").isNotNull())


def physical_disks(samples: DataFrame, inventory: DataFrame) -> DataFrame:
    """Samples of devices the inventory lists as disks; unknown devices are left out."""
    return samples.join(exploded_disks(inventory).select("server_id", "device_id").distinct(),
                        ["server_id", "device_id"], "left_semi")


def physical_ifaces(samples: DataFrame, inventory: DataFrame) -> DataFrame:
    return samples.join(exploded_ifaces(inventory).select("server_id", "iface_id").distinct(),
                        ["server_id", "iface_id"], "left_semi")


def _active(samples: DataFrame, inventory: DataFrame, devices: str, keys: DataFrame, dim: str) -> DataFrame:
    hosts = inventory.groupBy("server_id").agg(F.max(F.coalesce(F.size(devices), F.lit(0)) > 0).alias("_listed"))
    known = keys.select("server_id", dim).distinct().withColumn("_known", F.lit(True))
    j = samples.join(hosts, "server_id").join(known, ["server_id", dim], "left")
    return j.filter(~F.col("_listed") | F.col("_known")).select(*samples.columns)


def active_disks(samples: DataFrame, inventory: DataFrame) -> DataFrame:
    """Samples for a host's activity: those of listed disks; all of a host whose inventory lists no device."""
    return _active(samples, inventory, "block_devices", exploded_disks(inventory), "device_id")


def active_ifaces(samples: DataFrame, inventory: DataFrame) -> DataFrame:
    """The same for interfaces, which are also known by ``name:<name>``."""
    n = inventory.select("server_id", F.explode("net_interfaces").alias("n")).filter(F.col("n.kind").isin(PHYSICAL_KINDS))
    keys = F.array(F.concat(F.col("n.id_type"), F.lit(":"), F.col("n.id")), F.concat(F.lit("name:"), F.col("n.name")))
    return _active(samples, inventory, "net_interfaces", n.select("server_id", F.explode(F.array_compact(keys)).alias("iface_id")), "iface_id")


def display_names(exploded: DataFrame, dim: str) -> DataFrame:
    """First name per (host, dimension key), in inventory order."""
    return exploded.groupBy("server_id", dim).agg(F.min_by("name", "pos").alias("display_name"))


def latest_link_speed(net_io: DataFrame, since, until) -> DataFrame:
    """Newest known link speed per interface (map-side combined)."""
    rows = net_io.filter(F.col("link_speed_bps").isNotNull() & (F.col("collected_at") >= since)
                         & (F.col("collected_at") <= until))
    return rows.groupBy("server_id", "iface_id").agg(F.max_by("link_speed_bps", "collected_at").alias("link_speed_bps"))


