"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each query runs to a ``noop`` sink, so nothing is
collected and nothing is cached between queries. ``memory_p95_raw`` and ``memory_p95_rollup`` answer the same question
from the samples and from a stored bucket table.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from fleetlens.operators.rollups import rollup_host  # noqa: E402
from fleetlens.session import build_session  # noqa: E402
from fleetlens.workload import QUERIES  # noqa: E402
from fleetlens.workload.registry import Context  # noqa: E402

HEADLINE = [
    "lag_delta", "lag_delta_lineitem", "rate", "counter_delta", "bucket_rate_trend", "exact_percentile_lineitem", "asof_locf", "change_events",
    "rollup_host_5m", "rollup_filesystem_5m", "rollup_disk_5m", "rollup_net_5m", "report_aggregate", "environment_utilization", "mount_capacity",
    "trend_cpu_share", "trend_mem_weighted", "trend_cpu_saturation_hosts", "trend_disk_saturation_hosts", "trend_net_congested_hosts",
    "trend_fs_usage_locf", "trend_rate_collapse", "latest_dashboard", "latest_saturation", "host_errors", "rollup_host", "action_targets",
    "classify_service", "storage_tree", "subnet_topology", "os_support_status", "effective_task_status", "parse_metrics", "stream_rollup_5m",
]


def timed(df_of) -> float:
    t = time.perf_counter()
    df_of().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - t, 3)


def memory_p95(buckets):
    per = buckets.groupBy("bucket").agg((F.sum(F.col("l") - F.col("a")) / F.sum("l") * 100).alias("v"))
    return per.agg(F.percentile("v", F.lit(0.95)).alias("p95"))


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus), **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
                                                                  "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    timed(lambda: QUERIES["bucket_agg"](spark, sf))  # JVM warm-up
    times: dict[str, float] = {}
    for n in names:
        try:
            times[n] = timed(lambda n=n: QUERIES[n](spark, sf))
        except Exception as e:  # one broken query must not hide the others
            times[n] = -1.0
            print(f"{n}: {e}", file=sys.stderr)
    if "report_aggregate_stored" in QUERIES and not os.environ.get("BENCH_QUERIES"):
        QUERIES["rollup_refresh_host"](spark, sf)  # the stored tables are refreshed outside of reports
        for n in ("report_aggregate_stored", "environment_utilization_stored", "mount_capacity_stored"):
            times[n] = timed(lambda n=n: QUERIES[n](spark, sf))
    c = Context(spark, sf)
    root = tempfile.mkdtemp(prefix="run-")
    rollup_host(c["host_metrics"], c.width).write.mode("overwrite").parquet(f"{root}/host_rollup")
    c["host_metrics"].write.mode("overwrite").parquet(f"{root}/host_metrics")
    raw = spark.read.parquet(f"{root}/host_metrics")
    stored = spark.read.parquet(f"{root}/host_rollup")
    times["memory_p95_raw"] = timed(lambda: memory_p95(raw.select(
        F.col("collected_at").alias("bucket"), F.col("mem_limit_bytes").alias("l"), F.col("mem_available_bytes").alias("a"))))
    times["memory_p95_rollup"] = timed(lambda: memory_p95(stored.select(
        "bucket", F.col("mem_limit_avg").alias("l"), F.col("mem_available_avg").alias("a"))))
    print(json.dumps({"metric": "fleet telemetry headline queries", "value": round(sum(t for t in times.values() if t > 0), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
