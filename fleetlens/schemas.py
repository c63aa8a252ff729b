"""Wire schemas of the messages agents publish."""

from __future__ import annotations

POINTS = "array<struct<attr:map<string,string>,value:double>>"
NAMESPACE = f"map<string,struct<type:string,unit:string,points:{POINTS}>>"
NAMESPACES = ("system.cpu", "system.memory", "system.disk", "system.network", "system.paging", "system.filesystem", "system.pressure")
REQUIRED_NAMESPACES = NAMESPACES[:4]



def _fields(ddl: str) -> list[str]:
    """The fields of a schema text: commas inside brackets belong to a type."""
    out, depth = [""], 0
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append("")
        else:
            out[-1] += ch
    return out


def names(ddl: str) -> list[str]:
    return [f.split()[0].strip("`") for f in _fields(ddl)]


ENVELOPE = ("schema_version string, message_type string, message_id string, agent_id string, collected_at string, boot_time string, "
            "agent_started_at string, os_family string, composite_id string, machine_id string, agent_version string")

DEVICE = ("array<struct<name:string,type:string,size_bytes:bigint,fstype:string,mountpoint:string,parent:string,id:string,id_type:string,"
          "raid_level:string,lvm_vg:string,partition_table:string,sector_size:bigint,serial:string,wwn:string,rotational:boolean,part_number:int,"
          "part_start_bytes:bigint,part_type:string,part_name:string,part_flags:array<string>,fs_uuid:string,fs_label:string,block_size:bigint,"
          "mount_options:array<string>,fs_freq:int,fs_passno:int,lvm_lv:string,lvm_segtype:string,lvm_stripes:int,lvm_stripe_size_kib:bigint,"
          "raid_chunk_kib:bigint,raid_metadata:string,raid_uuid:string,crypt_type:string>>")
INTERFACE = ("array<struct<name:string,id:string,id_type:string,kind:string,speed_mbps:int,addresses:array<struct<address:string,prefix:int,"
             "family:string,origin:string>>,gateway:string,mtu:int,dns:array<string>,routes:array<struct<dest:string,via:string>>,bond_mode:string,vlan_id:int>>")
VOLUME_GROUP = ("array<struct<name:string,size_bytes:bigint,free_bytes:bigint,data_percent:double,metadata_percent:double,vg_uuid:string,"
                "extent_size_bytes:bigint,pv_ids:array<string>>>")
SERVICE = "array<struct<unit:string,sub:string,pid:int,exe:string>>"
SOCKET = "array<struct<proto:string,addr:string,port:int,uid:int,pid:int,comm:string>>"

METRICS = ENVELOPE + ", " + ", ".join(f"`{n}` {NAMESPACE}" for n in NAMESPACES)
INVENTORY = (ENVELOPE + ", hostname string, os_id string, os_version string, os_codename string, kernel_version string, arch string, bits int, "
             "boot_firmware string, secure_boot boolean, edition string, product_name string, timezone string, rtc_utc boolean, cpu_cores int, "
             "cpu_model string, mem_total_bytes bigint, ip_external array<string>, "
             f"block_devices {DEVICE}, net_interfaces {INTERFACE}, lvm_vgs {VOLUME_GROUP}, services {SERVICE}, listen_ports {SOCKET}, "
             "boot struct<kernel_cmdline:string,root_ref_type:string,grub_install_target:string>, "
             "nonblock_mounts array<struct<source:string,target:string,fstype:string,options:array<string>,fs_freq:int,fs_passno:int>>")
ERROR = ENVELOPE + ", error_code string, error_message string, failed_component string, retry_count int, first_failed_at string, recovered_at string"
TASK_RESULT = (ENVELOPE + ", hostname string, os_id string, os_version string, task_id string, status string, failure_reason string, exit_code int, "
               "signal_no int, task_policy boolean, duration_ms bigint, stdout_tail string, stderr_tail string, completed_at string")
#: Every field of every message kind, so that a mixed batch is parsed once.
ANY = ", ".join(dict.fromkeys([f.strip() for kind in (METRICS, INVENTORY, ERROR, TASK_RESULT) for f in _fields(kind)]))
BY_TYPE = {"metrics": METRICS, "inventory": INVENTORY, "error": ERROR, "task.result": TASK_RESULT}

# Natural keys: a repeated delivery never makes a second row.
NATURAL_KEYS = {
    "host_metrics": ["server_id", "collected_at"], "disk_io": ["server_id", "collected_at", "device_id"],
    "net_io": ["server_id", "collected_at", "iface_id"], "filesystem": ["server_id", "collected_at", "mountpoint"],
    "cpu_core": ["server_id", "collected_at", "core_id"], "pressure": ["server_id", "collected_at", "resource", "scope"],
    "disk_error": ["server_id", "collected_at", "device_id", "error_kind", "error_class", "member"],
    "inventory_history": ["server_id", "collected_at"],
}
# Columns whose change makes a new inventory history row (boot time is compared with a tolerance).
TRACKED = ["agent_version", "os_family", "os_id", "os_version", "os_codename", "kernel_version", "arch", "bits", "boot_firmware",
           "secure_boot", "edition", "product_name", "timezone", "rtc_utc", "cpu_cores", "cpu_model", "mem_total_bytes",
           "agent_started_at", "block_devices", "net_interfaces", "lvm_vgs", "boot", "nonblock_mounts", "ip_external", "services", "listen_ports"]
