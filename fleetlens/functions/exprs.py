"""Column expressions shared by the operators: time buckets, ratios, units, IPv4 arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket widths and look-back ranges, in seconds.
BUCKETS = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "3h": 10800, "6h": 21600, "12h": 43200,
           "1d": 86400}
RANGES = {"15m": 900, "1h": 3600, "6h": 21600, "24h": 86400, "7d": 604800, "14d": 1209600, "30d": 2592000}
AUTO_BUCKET = {"15m": "1m", "1h": "5m", "6h": "15m", "24h": "30m", "7d": "3h", "14d": "6h", "30d": "12h"}

# File systems that hold no data volume.
VIRTUAL_FSTYPES = ["tmpfs", "devtmpfs", "overlay", "squashfs", "proc", "sysfs", "cgroup", "cgroup2", "mqueue",
                   "debugfs", "tracefs", "securityfs", "pstore", "bpf", "configfs", "ramfs", "autofs", "hugetlbfs",
                   "fusectl", "nsfs", "efivarfs", "binfmt_misc"]

GIB = 1 << 30


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds(width: int | str) -> int:
    """Bucket width in seconds; accepts the short names of ``BUCKETS``."""
    return BUCKETS[width] if isinstance(width, str) else int(width)


def time_bucket(ts: str | Column, width: int | str) -> Column:
    """Start of the epoch-aligned (UTC) bucket that holds ``ts``; independent of the session time zone."""
    us = seconds(width) * 1_000_000
    m = F.unix_micros(col(ts))
    return F.timestamp_micros(m - F.pmod(m, F.lit(us)))


def timestamp(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def shift(ts: Column, secs: float) -> Column:
    """``ts`` moved by a number of seconds."""
    return F.timestamp_micros(F.unix_micros(ts) + F.lit(int(secs * 1_000_000)))


def elapsed_seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` with NULL for a zero denominator."""
    return num.cast("double") / F.when(den != 0, den.cast("double"))


def in_window(ts: str | Column, start: Column, end: Column, lead_seconds: int = 0) -> Column:
    """``start - lead <= ts <= end``; delta series read one bucket earlier through ``lead_seconds``."""
    t = col(ts)
    return (t >= shift(start, -lead_seconds)) & (t <= end)


def not_future(ts: str | Column, anchor: Column, skew_seconds: int = 120) -> Column:
    """Rows whose clock runs ahead of the anchor by more than the skew are not "latest"."""
    return col(ts) <= shift(anchor, skew_seconds)


def data_volume(fstype: str | Column = "fstype", mountpoint: str | Column = "mountpoint") -> Column:
    """Real data volumes: no virtual file system, nothing under /boot; an unknown file system counts as data."""
    fs = col(fstype)
    return (fs.isNull() | ~fs.isin(VIRTUAL_FSTYPES)) & ~col(mountpoint).startswith("/boot")


def bytes_to_gib(v: Column, digits: int = 2) -> Column:
    """GiB rounded half-even; zero and unknown sizes are NULL."""
    return F.when(v != 0, F.bround(v.cast("double") / F.lit(float(GIB)), digits))


def bytes_to_gb(v: Column, digits: int = 1) -> Column:
    """Display size (2^30); an unknown size is NULL and zero stays zero."""
    return F.bround(v.cast("double") / F.lit(float(GIB)), digits)


def usage_pct(used: Column, total: Column) -> Column:
    """Share of ``total`` in percent, never below zero; unknown stays unknown."""
    return F.when((total > 0) & used.isNotNull(), F.greatest(F.lit(0.0), used.cast("double") / total.cast("double") * 100))


def cpu_total() -> Column:
    """Sum of the CPU counters; parts an OS does not know count as zero."""
    parts = ["cpu_user_s", "cpu_nice_s", "cpu_system_s", "cpu_idle_s", "cpu_iowait_s", "cpu_irq_s", "cpu_softirq_s",
             "cpu_steal_s"]
    out = F.coalesce(F.col(parts[0]), F.lit(0.0))
    for p in parts[1:]:
        out = out + F.coalesce(F.col(p), F.lit(0.0))
    return out


def cpu_busy() -> Column:
    """CPU counters without idle time."""
    return cpu_total() - F.coalesce(F.col("cpu_idle_s"), F.lit(0.0))


def ipv4_number(address: str | Column) -> Column:
    """Dotted IPv4 text as a number; NULL if it is not four octets up to 255."""
    a = col(address)
    octets = F.split(a, r"\.")
    well_formed = a.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$")
    o = [F.get(octets, F.lit(i)).try_cast("int") for i in range(4)]
    in_range = (o[0] <= 255) & (o[1] <= 255) & (o[2] <= 255) & (o[3] <= 255)
    n = ((o[0].cast("long") * 256 + o[1]) * 256 + o[2]) * 256 + o[3]
    return F.when(well_formed & in_range, n)


def ipv4_network(number: Column, prefix: Column) -> Column:
    """Network number of an address: the host bits cleared."""
    span = F.pow(F.lit(2.0), F.lit(32) - prefix).cast("long")
    return number - F.pmod(number, span)


def ipv4_text(number: Column) -> Column:
    def octet(power: int) -> Column:
        return F.pmod(F.floor(number / F.lit(256 ** power)), F.lit(256)).cast("string")

    return F.concat_ws(".", octet(3), octet(2), octet(1), octet(0))
