"""Messages in, tables out; streams equal batches."""

import datetime as dt
import json

from pyspark.sql import functions as F

from fleetlens.operators import kernels as K
from fleetlens.sources import ingest as G
from fleetlens.streaming import streams as W

UID = "00000000-0000-4000-8000-00000000000%d"


def metrics(i=1, **kw):
    base = {"schema_version": "1.0", "message_type": "metrics", "message_id": UID % i, "agent_id": UID % 9, "collected_at": "2024-01-01T00:00:00Z", "os_family": "linux",
            "system.cpu": {"cpu.time": {"type": "counter", "unit": "s", "points": [
                {"attr": {"cpu": "0", "state": "user"}, "value": 5}, {"attr": {"cpu": 1, "state": "user"}, "value": 7}, {"attr": {"cpu": "0", "state": "idle"}, "value": None}]}},
            "system.memory": {"memory.limit": {"type": "gauge", "unit": "By", "points": [{"value": 1024.9}]}},
            "system.disk": None, "system.network": None,
            "system.paging": {"paging.operations": {"type": "counter", "unit": "1", "points": [
                {"attr": {"direction": "in", "type": "major"}, "value": 3}, {"attr": {"direction": "in"}, "value": 4}]}}}
    base.update(kw)
    return json.dumps({k: v for k, v in base.items() if v != "drop"})


def frame(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_metrics_point_rules(spark):
    r = G.parse_metrics(frame(spark, metrics()))
    h = r["host_metrics"].first()
    assert (h.cpu_user_s, h.cpu_idle_s, h.mem_limit_bytes, h.paging_in, h.paging_major, h.paging_out) == (12.0, None, 1024, 4, 3, None)
    assert sorted((c.core_id, c.cpu_user_s) for c in r["cpu_core"].collect()) == [(0, 5.0), (1, 7.0)]
    assert r["disk_io"].count() == 0 and r["pressure"].count() == 0


def test_quarantine_names_the_broken_rule(spark):
    texts = [metrics(), "{oops", metrics(schema_version="2.1"), metrics(message_id="x"), metrics(collected_at="2024-01-01T00:00:00"), metrics(os_family="mac"),
             metrics(**{"system.disk": "drop"}), metrics(**{"system.cpu": {"a": {"type": "delta", "unit": "s", "points": []}}})]
    good, bad = G.split_valid(frame(spark, *texts))
    assert good.count() == 1
    assert sorted(",".join(r.problems) for r in bad.filter("not array_contains(problems, 'not_json')").collect()) == [
        "collected_at", "major_version", "message_id", "metric", "namespaces", "os_family"]
    assert bad.filter("array_contains(problems, 'not_json')").count() == 1


def test_addresses_and_counts_are_checked(spark):
    def inventory(i, **kw):
        return json.dumps({"schema_version": "1.0", "message_type": "inventory", "message_id": UID % i, "agent_id": UID % 9, "collected_at": "2024-01-01T00:00:00Z", "os_family": "linux", "hostname": "h"} | kw)

    fine = [inventory(1, ip_external=["10.0.0.255/24", "fe80::1"], cpu_cores=4), inventory(2, cpu_cores=None), inventory(3, mem_total_bytes=0)]
    wrong = [inventory(4, ip_external=["999.1.1.1"]), inventory(5, cpu_cores="four"), inventory(6, mem_total_bytes=-1), inventory(7, ip_external=["1.2.3.256"])]
    good, bad = G.split_valid(frame(spark, *fine, *wrong))
    assert good.count() == 3
    assert sorted(",".join(r.problems) for r in bad.collect()) == ["cpu_cores", "ip_external", "ip_external", "mem_total_bytes"]


def test_duplicates_and_history(spark):
    t = [dt.datetime(2024, 1, 1, h) for h in range(5)]
    rows = [("h", t[0], t[0], 4), ("h", t[1], t[0], 4), ("h", t[2], t[0] + dt.timedelta(seconds=4), 4), ("h", t[3], t[0], 8), ("h", t[4], None, 8)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, boot_time timestamp, cpu_cores int")
    kept = G.append_on_change(df, "k", "ts", ["cpu_cores"]).orderBy("ts").collect()
    assert [r.ts for r in kept] == [t[0], t[3], t[4]]
    assert G.insert_if_absent(df.unionByName(df), df.limit(0), ["k", "ts"]).count() == 5


def event_files(spark, folder, rows):
    df = spark.createDataFrame(rows, "host string, ts timestamp, cnt bigint")
    for i in range(3):  # three files, so three micro-batches
        df.filter(F.abs(F.hash("host", "ts")) % 3 == i).coalesce(1).write.mode("append").parquet(folder)
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_rollup_and_bursts_equal_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"h{i % 4}", t0 + dt.timedelta(seconds=37 * i), (i * 7919) % 101) for i in range(200)]
    batch, stream = event_files(spark, str(tmp_path / "e"), rows)
    store = W.RollupStream(spark, str(tmp_path / "r"), ["host"], "ts", ["cnt"], ["cnt"], 300).run(stream)
    rolled = store.table(batch)
    want = K.counter_delta(batch, ["host"], "ts", ["cnt"], 300, extra=[F.count("*").alias("sample_count")])
    cols = ["host", "bucket", "d_cnt", "sample_count"]
    assert sorted(map(tuple, rolled.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert store.compact() == 2 and sorted(map(tuple, store.table(batch).select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_stream_duplicates_and_upsert(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"h{i % 3}", t0 + dt.timedelta(minutes=i), i % 10) for i in range(30)]
    _, stream = event_files(spark, str(tmp_path / "e"), rows)
    once = W.run_available(W.stream_dedupe(stream, "cnt", "ts", "24 hours"), "d")
    assert sorted(r.cnt for r in once.collect()) == list(range(10))
    _, stream = event_files(spark, str(tmp_path / "f"), rows)
    newest = W.upsert_stream(stream, "host", "ts")
    assert sorted((r.host, r.ts) for r in newest.collect()) == [(f"h{i % 3}", t0 + dt.timedelta(minutes=i)) for i in (27, 28, 29)]
