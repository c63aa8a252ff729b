"""One stream into all tables equals the batch functions; every nested rule rejects a message."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fleetlens import schemas as X
from fleetlens.sources import ingest as G
from fleetlens.sources import layout as L
from fleetlens.streaming.ingest_stream import IngestStream

AGENTS = ["00000000-0000-4000-8000-0000000000%02d" % i for i in range(4)]


def message(kind, n, agent, at, **kw):
    return json.dumps({"schema_version": "1.0", "message_type": kind, "message_id": "00000000-0000-4000-9000-%012d" % n, "agent_id": agent,
                       "collected_at": (dt.datetime(2024, 1, 1) + dt.timedelta(hours=at)).strftime("%Y-%m-%dT%H:%M:%SZ"), "os_family": "linux"} | kw)


def point(value, **attr):
    return {"attr": attr, "value": value}


def counter(*points):
    return {"type": "counter", "unit": "1", "points": list(points)}


def sample(n, agent, at):
    return message("metrics", n, agent, at, **{
        "system.cpu": {"cpu.time": counter(point(5 + at, cpu="0", state="user"), point(7, cpu="1", state="user"))}, "system.memory": None,
        "system.disk": {"disk.io": counter(point(at, device="sda", direction="read")), "disk.errors": counter(point(1, device="sda", kind="smart"))},
        "system.network": {"network.io": counter(point(at, device="eth0", direction="receive"))},
        "system.filesystem": {"filesystem.usage": counter(point(10, mountpoint="/", state="used", type="ext4"))},
        "system.pressure": {"pressure.stall.time": counter(point(at, resource="cpu", scope="some"))}})


def inventory(n, agent, at, **kw):
    return message("inventory", n, agent, at, **({"hostname": "h", "cpu_cores": 4} | kw))


ERROR = {"error_code": "E1", "failed_component": "disk"}
TASK = {"hostname": "h", "task_id": "t", "status": "ok", "duration_ms": 1, "stdout_tail": "", "stderr_tail": "", "completed_at": "2024-01-01T00:00:00Z"}
BATCHES = [
    [sample(1, AGENTS[0], 0), sample(2, AGENTS[1], 0), inventory(3, AGENTS[0], 0), inventory(4, AGENTS[0], 1), message("error", 5, AGENTS[0], 1, **ERROR), "{broken"],
    [sample(1, AGENTS[0], 0), sample(6, AGENTS[0], 30), sample(7, AGENTS[0], 30), inventory(8, AGENTS[0], 2, cpu_cores=8), inventory(9, AGENTS[2], 2), message("error", 5, AGENTS[0], 1, **ERROR)],
    [sample(10, AGENTS[1], 1), inventory(11, AGENTS[0], 3, cpu_cores=8), inventory(12, AGENTS[2], 3, hostname=""), message("task.result", 13, AGENTS[0], 3, **TASK), inventory(14, AGENTS[3], 3, cpu_cores=1)],
]
TABLES = [*G.PARSERS, "agent_errors", "task_results", "inventory", "inventory_history", "quarantine"]


def texts(spark, rows):
    return spark.createDataFrame([(t,) for t in rows], "value string")


def wanted(spark):
    """The same tables by the batch functions over all messages at once."""
    good, bad = G.split_valid(texts(spark, [m for b in BATCHES for m in b]))
    good = texts(spark, [r.value for r in good.collect()])
    parsed = G.parse_metrics(G.dedupe(good.withColumn("message_id", F.get_json_object("value", "$.message_id")).withColumn("collected_at", F.get_json_object("value", "$.collected_at"))).select("value"))
    out = {n: G.insert_if_absent(r, r.limit(0), ["agent_id" if k == "server_id" else k for k in X.NATURAL_KEYS[n]]) for n, r in parsed.items()}
    inv = G.dedupe(G.parse_inventory(good))
    out["agent_errors"], out["task_results"] = G.agent_errors(good), G.dedupe(G.of_type(good, "task.result"))
    out["inventory"] = G.register_placeholders(parsed["host_metrics"], G.latest_one(inv, ["agent_id"], [F.desc("collected_at")]))
    out["inventory_history"] = G.append_on_change(inv, "agent_id", "collected_at", X.TRACKED)
    out["quarantine"] = bad.select("value", "problems")
    return out


def rows(df, cols):
    return sorted(json.dumps(r.asDict(True), default=str, sort_keys=True) for r in df.select(*cols).collect())


def same(spark, stream):
    for name, want in wanted(spark).items():
        got = stream.table(name)
        assert rows(got, want.columns) == rows(want, want.columns), name


def test_stream_equals_batch_with_a_retry(spark, tmp_path, monkeypatch):
    s = IngestStream(spark, str(tmp_path / "s"))
    assert s.table("inventory") is None
    s.batch(texts(spark, BATCHES[0]), 0)
    with monkeypatch.context() as m:  # the second batch writes its sample tables and dies before the others
        m.setattr(s, "_inventory", lambda rows, epoch: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            s.batch(texts(spark, BATCHES[1]), 1)
    assert s.table("host_metrics").count() == 2
    s.batch(texts(spark, BATCHES[1]), 1)
    s.batch(texts(spark, BATCHES[1]), 1)
    s.compact()
    s.batch(texts(spark, BATCHES[2]), 2)
    s.compact()
    same(spark, s)
    assert s.table("inventory").where("placeholder").count() == 1


def test_first_rows_are_those_of_the_earliest_delivery(spark, tmp_path):
    """Two tasks of 40,000 and 30,000 rows: every third id comes again, with another time; 4 KB bitmaps sent along or shuffled."""
    at = F.timestamp_seconds((F.col("id") * 7919) % 100_003).cast("string")
    n = F.col("id") + F.when(F.col("id") >= 40_000, 2**33 - 40_000).otherwise(0)
    rows = spark.range(70_000).select((F.col("id") % 50_000).cast("string").alias("message_id"), at.alias("collected_at"), n.cast("long").alias("_row"))
    first = {}
    for r in rows.collect():
        first[r.message_id] = min(first.get(r.message_id, ("9",)), (r.collected_at, r._row))
    G.first_rows(rows).write.parquet(str(tmp_path / "first"))
    kept = spark.read.parquet(str(tmp_path / "first"))
    for most in (4096, 0):
        out = G.with_rows(rows, kept, most)
        assert out.columns == rows.columns
        assert sorted(r._row for r in out.collect()) == sorted(v[1] for v in first.values())


def test_a_batch_caches_nothing_and_leaves_no_work_tables(spark, tmp_path, monkeypatch):
    """Of messages with one id the earliest counts in all tables; nothing is cached, and shuffle files are let go by query."""
    s, seen = IngestStream(spark, str(tmp_path / "s")), []
    spark.catalog.clearCache()
    for rdd in list(spark.sparkContext._jsc.getPersistentRDDs().values()):
        rdd.unpersist(True)
    key, inventories = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", s._inventory

    def look(rows, epoch):
        seen.append((spark.sparkContext._jsc.getPersistentRDDs().size(), spark.conf.get(key)))
        inventories(rows, epoch)

    monkeypatch.setattr(s, "_inventory", look)
    before = spark.conf.get(key)
    late = json.loads(sample(1, AGENTS[0], 5)) | {"system.disk": {"disk.io": counter(point(1, device="sdz", direction="read"))}}
    s.batch(texts(spark, [json.dumps(late), sample(1, AGENTS[0], 4), sample(2, AGENTS[0], 5), "{broken"]), 0)
    assert seen == [(0, "true")] and spark.conf.get(key) == before
    assert {r.device_id for r in s.table("disk_io").collect()} == {"sda"} and s.table("host_metrics").count() == 2
    assert s.table("quarantine").collect()[0].value == "{broken"
    assert not (tmp_path / "s/tables/parsed").exists() and not (tmp_path / "s/tables/first_rows").exists()


GOOD = {
    "block_devices": [{"name": "sda", "type": "disk", "size_bytes": 10, "partition_table": "gpt", "rotational": False, "part_flags": ["boot"], "mount_options": [], "raid_level": 5, "fs_freq": 0}, {"name": "md0", "type": "raid", "raid_level": "linear"}],
    "net_interfaces": [{"name": "eth0", "addresses": [{"address": "fe80::1", "prefix": 64, "family": "ipv6", "origin": "dhcp"}], "gateway": "", "routes": [{"dest": "0.0.0.0/0", "via": None}], "dns": ["10.0.0.2"]}],
    "lvm_vgs": [{"name": "vg", "data_percent": 12.5, "pv_ids": ["a"]}], "services": None, "listen_ports": [{"proto": "tcp6", "addr": "::", "port": 65535}],
    "boot": {"kernel_cmdline": "ro"}, "nonblock_mounts": [{"source": "tmpfs", "target": "/run", "options": ["rw"]}],
}
BAD_VALUE = {"text": "x" * 5000, "count": -1, "whole": "one", "real": -0.5, "flag": "maybe", "list": "a", "one": "sctp", "ip": "300.1.1.1"}
NEEDED = {"text": "n", "count": 1, "one": {"family": "ipv4", "proto": "udp"}, "ip": "10.0.0.1"}


def entry(fields, name=None, value=None, leave=False):
    """A good entry with only the fields that must be there, and one of them (or another one) set or left out."""
    out = {n: NEEDED[k[0].rstrip("!")][n] if k[0].startswith("one") else NEEDED[k[0].rstrip("!")] for n, k in fields.items() if not isinstance(k, dict) and k[0].endswith("!")}
    if name and leave:
        del out[name]
    elif name:
        out[name] = value
    return out


def broken_blocks():
    for block, fields in {**L.BLOCKS, "boot": L.BOOT}.items():
        wrap = (lambda e: e) if block == "boot" else (lambda e: [e])
        for n, k in fields.items():
            if isinstance(k, dict):
                for m, j in k.items():
                    yield block, wrap(entry(fields) | {n: [entry(k, m, BAD_VALUE[j[0].rstrip("!")])]})
            else:
                yield block, wrap(entry(fields, n, BAD_VALUE[k[0].rstrip("!")]))
                if k[0].endswith("!"):
                    yield block, wrap(entry(fields, n, leave=True))
        if block != "boot":
            yield block, [None]
            yield block, "text"
            if block not in L.MAY_BE_NULL:
                yield block, None


def test_every_nested_rule_rejects(spark):
    fine = [inventory(1, AGENTS[0], 0, **GOOD), inventory(2, AGENTS[0], 0)] + [inventory(3 + i, AGENTS[0], 0, **{b: [entry(f)]}) for i, (b, f) in enumerate(L.BLOCKS.items())]
    wrong = list(broken_blocks())
    rows = texts(spark, fine + [inventory(100 + i, AGENTS[0], 0, **{b: v}) for i, (b, v) in enumerate(wrong)] + [inventory(99, AGENTS[0], 0, arch="x" * 33)])
    got = {r.n: list(r.problems) for r in G.check_messages(rows).select(F.get_json_object("value", "$.message_id").substr(-12, 12).cast("int").alias("n"), "problems").collect()}
    assert all(got[i + 1] == [] for i in range(len(fine))), {i: got[i + 1] for i in range(len(fine))}
    assert got[99] == ["arch"] and len(wrong) > 100
    assert [(b, json.dumps(v)[:90], got[100 + i]) for i, (b, v) in enumerate(wrong) if got[100 + i] != [b]] == []


def test_layout_fields_survive_the_parse(spark):
    r = G.parse_inventory(texts(spark, [inventory(1, AGENTS[0], 0, **GOOD)])).first()
    assert (r.block_devices[0].partition_table, r.block_devices[0].part_flags, r.block_devices[0].rotational, r.block_devices[1].raid_level) == ("gpt", ["boot"], False, "linear")
    assert (r.net_interfaces[0].addresses[0].origin, r.net_interfaces[0].routes[0].dest) == ("dhcp", "0.0.0.0/0")
    assert len(r.block_devices[0].asDict()) == 34
