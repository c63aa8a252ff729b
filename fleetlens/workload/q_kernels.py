"""Generic time-series operators over the event samples and the line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions.exprs import bytes_to_gib, data_volume, in_window, timestamp
from fleetlens.operators import kernels as K
from fleetlens.operators import trends as M
from fleetlens.operators.selection import keyset_page
from fleetlens.workload.q_trends import END, LEAD, START, VOLUME
from fleetlens.workload.registry import Context, library, query

SER = ["server_id", "dim"]


def line_series(c: Context):
    """Daily quantity per supplier and return flag: one sample per series and day."""
    li = c.table("lineitem")
    return li.groupBy(F.col("l_suppkey").alias("server_id"), F.col("l_returnflag").alias("dim"), F.col("l_shipdate").cast("timestamp").alias("ts")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"))


library("line_series", "select l_suppkey as server_id, l_returnflag as dim, l_shipdate as ts, cast(sum(cast(l_quantity as bigint)) as bigint) as qty, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as cents from lineitem group by 1, 2, 3")
_W = "over (partition by server_id, dim order by ts)"

# --- deltas and windows -------------------------------------------------------------------------------------------

query("lag_delta", f"select server_id, dim, ts, cnt - lag(cnt) {_W} as d_cnt, epoch(ts) - epoch(lag(ts) {_W}) as dt from samples", ("samples",), ("dt",))(
    lambda c: K.lag_delta(c["samples"], SER, "ts", ["cnt"]).select(*SER, "ts", "d_cnt", "dt"))
query("lag_delta_lineitem", f"select server_id, dim, ts, qty - lag(qty) {_W} as d_qty from line_series", ("line_series",))(
    lambda c: K.lag_delta(line_series(c), SER, "ts", ["qty"], chunk=366 * 86400).select(*SER, "ts", "d_qty"))
query("lag_delta_clamp", f"select server_id, dim, ts, greatest(cnt - lag(cnt) {_W}, 0) as d_cnt from samples", ("samples",))(
    lambda c: K.lag_delta(c["samples"], SER, "ts", ["cnt"], "clamp").select(*SER, "ts", "d_cnt"))
query("lag_delta_drop", f"select server_id, dim, ts, d as d_cnt from (select *, cnt - lag(cnt) {_W} as d from samples) x where d >= 0", ("samples",))(
    lambda c: K.lag_delta(c["samples"], SER, "ts", ["cnt"], "drop").select(*SER, "ts", "d_cnt"))
query("lag_delta_null", f"select server_id, dim, ts, case when cnt >= lag(cnt) {_W} then cnt - lag(cnt) {_W} end as d_cnt from samples", ("samples",))(
    lambda c: K.lag_delta(c["samples"], SER, "ts", ["cnt"], "null").select(*SER, "ts", "d_cnt"))
query("rate", f"select server_id, dim, ts, greatest(cnt - lag(cnt) {_W}, 0) / (epoch(ts) - epoch(lag(ts) {_W})) as v from samples", ("samples",), ("v",))(
    lambda c: K.rate(c["samples"], SER, "ts", "cnt").select(*SER, "ts", "v"))
_WB = "over (partition by server_id, dim, date_trunc('day', ts) order by ts)"
library("inc", f"select *, date_trunc('day', ts) as bucket, case when lag(cnt) {_WB} is null then 0 when cnt >= lag(cnt) {_WB} then cnt - lag(cnt) {_WB} else cnt end as i from (select *, cnt as raw from samples) s", ("samples",))
query("counter_delta", "select server_id, dim, bucket, cast(sum(i) as bigint) as d_cnt from inc group by 1, 2, 3", ("inc",))(
    lambda c: K.counter_delta(c["samples"], SER, "ts", ["cnt"], c.width))
query("counter_time_delta", "select server_id, dim, bucket, epoch(max(ts)) - epoch(min(ts)) as td_cnt from inc group by 1, 2, 3", ("inc",), ("td_cnt",))(
    lambda c: K.counter_delta(c["samples"], SER, "ts", ["cnt"], c.width, spans=["cnt"]).select(*SER, "bucket", "td_cnt"))
query("latest_n_per_key", "select server_id, dim, ts, v_cents, rn from (select *, row_number() over (partition by server_id, dim order by ts desc) as rn from samples) x where rn <= 3", ("samples",))(
    lambda c: K.latest_n(c["samples"], SER, [F.desc("ts")], 3).select(*SER, "ts", "v_cents", "rn"))
query("change_events", """
    select server_id, collected_at, kind from (
      select *, case when lag(boot_time) over w is null or abs(epoch(boot_time) - epoch(lag(boot_time) over w)) > 5 then 'reboot'
                     when agent_started_at is distinct from lag(agent_started_at) over w then 'restart' end as kind
      from inventory_history window w as (partition by server_id order by collected_at)) x where kind is not null""", ("inventory_history",))(
    lambda c: K.change_events(c["inventory_history"], ["server_id"], "collected_at", "boot_time", "agent_started_at").select("server_id", "collected_at", "kind"))

# --- buckets and ratios -------------------------------------------------------------------------------------------

for _a, _e in (("avg", "avg(v_cents)"), ("max", "max(v_cents)"), ("p95", "quantile_cont(v_cents, 0.95)")):
    query("bucket_agg" + ("" if _a == "avg" else f"_{_a}"), f"select date_trunc('day', ts) as ts, cast({_e} as double) as value, dim from samples group by 1, dim", ("samples",), ("value",))(
        lambda c, a=_a: K.bucket_agg(c["samples"].withColumn("v_cents", F.col("v_cents").cast("double")), "ts", "v_cents", c.width, a, ["dim"]))
query("bucket_agg_3h", "select time_bucket(interval '3 hours', ts) as ts, avg(v_cents) as value, dim from samples group by 1, dim", ("samples",), ("value",))(
    lambda c: K.bucket_agg(c["samples"], "ts", "v_cents", "3h", "avg", ["dim"]))
query("capacity_weighted_ratio", "select date_trunc('day', ts) as ts, avg(v) as value from (select ts, sum(v_cents) / sum(cnt) * 100 as v from samples group by 1) x where v is not null group by 1", ("samples",), ("value",))(
    lambda c: K.bucket_agg(K.weighted_ratio(c["samples"], "ts", F.col("v_cents"), F.col("cnt")), "ts", "v", c.width))
query("capacity_weighted_ratio_lineitem", "select ts, dim, sum(qty) * 100.0 / sum(cents) as v from line_series group by 1, 2", ("line_series",), ("v",))(
    lambda c: K.weighted_ratio(line_series(c), "ts", F.col("qty"), F.col("cents"), ["dim"]))
query("bool_or_ever", "select date_trunc('day', ts) as bucket, server_id, bool_or(v_cents > 5000) as ever from samples group by 1, 2", ("samples",))(
    lambda c: K.ever_crossed(c["samples"], "ts", F.col("v_cents") > 5000, c.width, ["server_id"]))
query("exact_percentile_split", "select dim, quantile_cont(v_cents, 0.95) as value from samples group by 1", ("samples",), ("value",))(
    lambda c: K.exact_percentile(c["samples"], ["dim"], "v_cents", 0.95))
query("exact_percentile_lineitem", "select l_returnflag as dim, quantile_cont(l_extendedprice, 0.95) as value from lineitem group by 1", (), ("value",))(
    lambda c: K.exact_percentile(c.table("lineitem").withColumnRenamed("l_returnflag", "dim"), ["dim"], "l_extendedprice", 0.95))
query("percentile_stats", "select server_id, dim, quantile_cont(v_cents, 0.95) as p95, quantile_cont(v_cents, 0.5) as median, avg(v_cents) as avg, cast(max(v_cents) as double) as peak, count(*) as samples from samples group by 1, 2", ("samples",), ("p95", "median", "avg", "peak"))(
    lambda c: K.percentile_stats(c["samples"].withColumn("v_cents", F.col("v_cents").cast("double")), SER, "v_cents"))
query("unit_conversion", "select server_id, round_even(mem_total_bytes / 1073741824, 2) as mem_gib from inventory", ("inventory",), ("mem_gib",))(
    lambda c: c["inventory"].select("server_id", bytes_to_gib(F.col("mem_total_bytes")).alias("mem_gib")))

# --- filters and joins --------------------------------------------------------------------------------------------

query("time_window_filter", f"select server_id, dim, ts from samples where ts >= {LEAD} and ts <= {END}", ("samples",))(
    lambda c: c["samples"].filter(in_window("ts", c.start, c.end, 86400)).select(*SER, "ts"))
query("data_volume_filter", f"select mountpoint, fstype, count(*) as samples from filesystem where {VOLUME} group by 1, 2", ("filesystem",))(
    lambda c: c["filesystem"].filter(data_volume()).groupBy("mountpoint", "fstype").agg(F.count("*").alias("samples")))
query("join_inventory", "select os_family, sum(cpu_cores) as cores, count(*) as samples from samples join inventory using (server_id) group by 1", ("samples", "inventory"), ("cores",))(
    lambda c: _join_inventory(c))


def _join_inventory(c: Context):
    """Samples are reduced per host before they meet the inventory."""
    per = c["samples"].groupBy("server_id").agg(F.count("*").alias("n"))
    j = per.join(c["inventory"].select("server_id", "os_family", "cpu_cores"), "server_id")
    return j.groupBy("os_family").agg(F.sum(F.col("cpu_cores") * F.col("n")).cast("double").alias("cores"), F.sum("n").alias("samples"))


query("left_join_composite", f"""
    select collected_at, server_id, txp, d_retrans from (select collected_at, server_id, cast(sum(d_tx_packets) as bigint) as txp from net_steps where collected_at >= {START} group by 1, 2) n
    left join tcp_steps using (collected_at, server_id)""", ("net_steps", "tcp_steps"))(lambda c: _composite(c))


def _composite(c: Context):
    r = M.TrendRequest(c.fleet, c.start, c.end, c.width)
    net = M._net_deltas(r, ["tx_packets"]).groupBy("collected_at", "server_id").agg(F.sum("d_tx_packets").alias("txp"))
    tcp = M._tcp_deltas(r).select("collected_at", "server_id", F.col("d_net_tcp_retransmits").alias("d_retrans"))
    return net.join(tcp, ["collected_at", "server_id"], "left")


query("join_on_instant", "select ts, a, b from (select ts, sum(v_cents)::bigint as a from samples where dim = 'click' group by 1) x join (select ts, sum(v_cents)::bigint as b from samples where dim = 'view' group by 1) y using (ts)", ("samples",))(
    lambda c: c["samples"].filter("dim = 'click'").groupBy("ts").agg(F.sum("v_cents").alias("a")).join(
        c["samples"].filter("dim = 'view'").groupBy("ts").agg(F.sum("v_cents").alias("b")), "ts"))
_GRID = f"(select unnest(generate_series({START}, {END}, interval 1 day)) as ts)"
query("asof_locf", f"""
    select server_id, dim, ts, v_cents from (select b.ts, s.server_id, s.dim, s.v_cents, row_number() over (partition by b.ts, s.server_id, s.dim order by s.ts desc) as rn
      from {_GRID} b join samples s on s.ts < b.ts + interval 1 day and s.ts >= {START}) x where rn = 1""", ("samples",))(
    lambda c: K.locf_grid(c["samples"].filter(in_window("ts", c.start, c.end)), SER, "ts", ["v_cents"], c.width, c.start, c.end))
query("last_value_locf", f"""
    select server_id, dim, ts, v_cents from (select b.ts, s.server_id, s.dim, s.v_cents, row_number() over (partition by b.ts, s.server_id, s.dim order by s.ts desc) as rn
      from {_GRID} b join samples s on s.ts < b.ts + interval 1 day and date_trunc('day', s.ts) >= b.ts - interval 2 day) x where rn = 1""", ("samples",))(
    lambda c: K.locf_grid(c["samples"], SER, "ts", ["v_cents"], c.width, c.start, c.end, max_age=2 * 86400))
query("cross_join_grid", f"select server_id, ts from {_GRID} b, (select distinct server_id from samples) t", ("samples",))(
    lambda c: K.target_grid(c["samples"].select("server_id").distinct(), c.start, c.end, c.width))
_SERIES = "(select date_trunc('day', ts) as ts, avg(v_cents) as value from samples where dim = '{}' group by 1)"


def _series(c: Context, dim: str):
    return K.bucket_agg(c["samples"].filter(F.col("dim") == dim), "ts", "v_cents", c.width)


query("merge_series", f"""select ts, a.value as click, b.value as view, e.value as purchase from {_SERIES.format('click')} a full join {_SERIES.format('view')} b using (ts) full join {_SERIES.format('purchase')} e using (ts)""", ("samples",), ("click", "view", "purchase"))(
    lambda c: K.merge_series({d: _series(c, d) for d in ("click", "view", "purchase")}))
query("merge_ts_union", "select distinct ts from samples where dim in ('click', 'error')", ("samples",))(
    lambda c: c["samples"].filter("dim = 'click'").select("ts").union(c["samples"].filter("dim = 'error'").select("ts")).distinct())
query("gap_fill_grid", f"select b.ts, value from (select unnest(generate_series({START}, {END} + interval 3 day, interval 1 day)) as ts) b left join {_SERIES.format('click')} s using (ts)", ("samples",), ("value",))(
    lambda c: K.gap_fill(_series(c, "click"), c.start, timestamp("2024-02-03 00:00:00"), c.width))
query("keyset_page", "select server_id, dim, ts from samples where ts < timestamp '2024-01-25 00:00:00' and ts >= timestamp '2024-01-25 00:00:00' - interval 30 day order by ts desc, server_id, dim limit 100", ("samples",))(
    lambda c: keyset_page(c["samples"], "ts", timestamp("2024-01-25 00:00:00"), 100, 30, tie=SER).select(*SER, "ts"))
query("bucket_rate_trend", f"""
    select date_trunc('day', ts) as ts, dim, quantile_cont(v, 0.95) as value from (
      select ts, dim, greatest(cnt - lag(cnt) {_W}, 0) / (epoch(ts) - epoch(lag(ts) {_W})) as v from samples) x where v is not null group by 1, 2""", ("samples",), ("value",))(
    lambda c: K.bucket_agg(K.rate(c["samples"], SER, "ts", "cnt"), "ts", "v", c.width, "p95", ["dim"]))
