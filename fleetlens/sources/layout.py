"""Rules of the nested blocks of an inventory message: storage, network, boot, mounts, services and sockets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields of each block with their kind and limit. text: longest length (with a least length as a second
# number); count: whole number from 0 (up to a limit); whole: any whole number; real: number from 0; flag: true or false;
# list: a JSON list; ip: a bare address; one: one of some words. A "!" marks fields that must be there.
DEVICE = {
    "name": ("text!", 128), "type": ("text!", 32), "size_bytes": ("count",), "fstype": ("text", 64), "mountpoint": ("text", 255), "parent": ("text", 128),
    "id": ("text", 128), "id_type": ("text", 16), "partition_table": ("text", 8), "sector_size": ("count",), "serial": ("text", 128), "wwn": ("text", 64),
    "rotational": ("flag",), "part_number": ("count",), "part_start_bytes": ("count",), "part_type": ("text", 64), "part_name": ("text", 128), "part_flags": ("list",),
    "fs_uuid": ("text", 64), "fs_label": ("text", 128), "block_size": ("count",), "mount_options": ("list",), "fs_freq": ("whole",), "fs_passno": ("whole",),
    "lvm_vg": ("text", 128), "lvm_lv": ("text", 128), "lvm_segtype": ("text", 32), "lvm_stripes": ("count",), "lvm_stripe_size_kib": ("count",),
    "raid_chunk_kib": ("count",), "raid_metadata": ("text", 16), "raid_uuid": ("text", 64), "crypt_type": ("text", 16),
}
ADDRESS = {"address": ("ip!", 64), "prefix": ("count", 128), "family": ("one!", "ipv4", "ipv6"), "origin": ("text", 16)}
ROUTE = {"dest": ("text!", 64, 1), "via": ("text", 64)}
INTERFACE = {
    "name": ("text!", 256), "id": ("text", 64), "id_type": ("text", 16), "kind": ("text", 32), "speed_mbps": ("count",), "gateway": ("ip", 64), "mtu": ("count",),
    "dns": ("list",), "bond_mode": ("text", 32), "vlan_id": ("count",), "addresses": ADDRESS, "routes": ROUTE,
}
VOLUME_GROUP = {
    "name": ("text!", 128), "size_bytes": ("count",), "free_bytes": ("count",), "data_percent": ("real",), "metadata_percent": ("real",), "vg_uuid": ("text", 64),
    "extent_size_bytes": ("count",), "pv_ids": ("list",),
}
SERVICE = {"unit": ("text!", 255, 1), "sub": ("text!", 64), "pid": ("count",), "exe": ("text", 255)}
SOCKET = {"proto": ("one!", "tcp", "tcp6", "udp", "udp6"), "addr": ("text!", 64), "port": ("count!", 65535), "uid": ("count",), "pid": ("whole",), "comm": ("text", 64)}
BOOT = {"kernel_cmdline": ("text", 4096), "root_ref_type": ("text", 16), "grub_install_target": ("text", 128)}
MOUNT = {"source": ("text!", 512, 1), "target": ("text!", 512, 1), "fstype": ("text", 64), "options": ("list",), "fs_freq": ("whole",), "fs_passno": ("whole",)}
BLOCKS = {"block_devices": DEVICE, "net_interfaces": INTERFACE, "lvm_vgs": VOLUME_GROUP, "services": SERVICE, "listen_ports": SOCKET, "nonblock_mounts": MOUNT}
MAY_BE_NULL = ("services", "nonblock_mounts")
# Longest texts of the top level of an inventory message.
FLAT = {"os_id": 64, "os_version": 64, "os_codename": 64, "kernel_version": 64, "cpu_model": 255, "arch": 32, "boot_firmware": 8, "edition": 64, "product_name": 128, "timezone": 64}

OCTET = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
ADDRESS_FORM = rf"^({OCTET}\.){{3}}{OCTET}$|^[0-9a-fA-F:.]*:[0-9a-fA-F:.]*$"


def shape(fields: dict) -> str:
    """The fields as a struct of texts, so that a wrong type is seen and not lost."""
    return "struct<" + ",".join(f"{n}:" + (f"array<{shape(k)}>" if isinstance(k, dict) else "string") for n, k in fields.items()) + ">"


def block_shapes() -> str:
    return ", ".join(f"{n} array<{shape(f)}>" for n, f in BLOCKS.items()) + f", boot {shape(BOOT)}"


def _no(v: Column) -> Column:
    return F.coalesce(v, F.lit(False))


def _whole(v: Column) -> Column:
    n = v.try_cast("decimal(38,6)")
    return _no(n == F.floor(n))


def fails(value: Column, kind: str, *limit) -> Column:
    """Does a text break the rule of its field?"""
    needed, kind = kind.endswith("!"), kind.rstrip("!")
    if kind == "text":
        good = (F.length(value) <= limit[0]) & (F.length(value) >= (limit[1] if len(limit) > 1 else 0))
    elif kind == "count":
        good = _whole(value) & (value.try_cast("decimal(38,6)") >= 0)
        good = good & (value.try_cast("decimal(38,6)") <= limit[0]) if limit else good
    elif kind == "whole":
        good = _whole(value)
    elif kind == "real":
        good = value.try_cast("double") >= 0
    elif kind == "flag":
        good = value.isin("true", "false")
    elif kind == "list":
        good = value.startswith("[")
    elif kind == "one":
        good = value.isin(*limit)
    else:  # a bare address; an empty gateway counts as none
        good = (value.rlike(ADDRESS_FORM) & (F.length(value) <= limit[0])) | (F.lit(not needed) & (value == ""))
    return ~_no(good) if needed else value.isNotNull() & ~_no(good)


def entry_fails(entry: Column, fields: dict) -> Column:
    """Does an entry of a block break any rule? A null entry does."""
    tests = [F.exists(F.coalesce(entry[n], F.array()), _entry(k)) if isinstance(k, dict) else fails(entry[n], *k) for n, k in fields.items()]
    return entry.isNull() | reduce(lambda a, b: a | b, tests)


def _entry(fields: dict) -> Callable[[Column], Column]:
    return lambda e: entry_fails(e, fields)


def block_problems(parsed: Column, keys: Column, value: Column) -> list[tuple[str, Column]]:
    """(name, broken) for every block of a parsed message; ``keys`` are the names that the message has, ``value`` its text.

    A block that is not there is empty. One that is there must be a list; only ``MAY_BE_NULL`` may be null.
    """
    def lost(n: str) -> Column:
        there = F.get_json_object(value, f"$.{n}").isNotNull() if n in MAY_BE_NULL else _no(F.array_contains(keys, n))
        return parsed[n].isNull() & there

    out = [(n, _no(F.exists(parsed[n], _entry(f))) | lost(n)) for n, f in BLOCKS.items()]
    boot = parsed["boot"]
    return [*out, ("boot", boot.isNotNull() & reduce(lambda a, b: a | b, [fails(boot[n], *k) for n, k in BOOT.items()]))]
