"""Generic time-series operators over ``(entity keys, ts, value)`` DataFrames.

Skew. A single entity may hold a large share of all rows, so no operator here sorts the whole history of an entity
in one task. Windows run per ``(keys, time chunk)``; what has to cross a chunk border (one carried row per chunk) is
computed by a map-side combined aggregate and attached by an equi join on the same partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.exprs import elapsed_seconds, ratio, seconds, time_bucket

DAY = 86400
SKETCH = 10_000  # accuracy of the quantile sketches that enclose a percentile
SMALL_GROUP = 20_000  # rows of a group that is ranked whole
POLICIES = ("raw", "clamp", "drop", "null", "restart")


# --- previous values and deltas -----------------------------------------------------------------------------------

def with_previous(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], chunk: int = DAY,
                  skip_nulls: bool = False, prefix: str = "prev_") -> DataFrame:
    """Attach the previous row's ``cols`` (by ``ts`` within ``keys``) as ``prev_<c>``.

    Rows are shuffled once, by keys and time chunk. The last row of every chunk is reduced with map-side combine,
    carried to the next chunk of the same key, and joined back on the partitioning the window already needs.
    ``skip_nulls`` carries the last non-null value instead of the last row. Rows without key or time are no samples
    and are left out.
    """
    keys = list(keys)
    # keys and time are never NULL in a sample; saying so on both branches lets Spark reuse the exchanges below them
    for k in [*keys, ts]:
        df = df.filter(F.col(k).isNotNull())
    chunked = df.withColumn("_chunk", F.floor(F.unix_micros(F.col(ts)) / F.lit(chunk * 1_000_000)))
    w = Window.partitionBy(*keys, "_chunk").orderBy(ts)
    if skip_nulls:
        past = w.rowsBetween(Window.unboundedPreceding, -1)
        local = {c: F.last(c, ignorenulls=True).over(past) for c in cols}
        tail = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"_t_{c}") for c in cols]
    else:
        local = {c: F.lag(c).over(w) for c in cols}
        tail = [F.max_by(c, ts).alias(f"_t_{c}") for c in cols]
    inner = chunked.withColumns({f"_p_{c}": e for c, e in local.items()} | {"_rn": F.row_number().over(w)})
    tails = chunked.groupBy(*keys, "_chunk").agg(*tail)
    wk = Window.partitionBy(*keys).orderBy("_chunk")
    if skip_nulls:
        carry = [F.last(f"_t_{c}", ignorenulls=True).over(wk.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_c_{c}")
                 for c in cols]
    else:
        carry = [F.lag(f"_t_{c}").over(wk).alias(f"_c_{c}") for c in cols]
    heads = tails.select(*keys, "_chunk", *carry)
    joined = inner.join(heads, [*keys, "_chunk"], "left")
    if skip_nulls:
        value = {c: F.coalesce(F.col(f"_p_{c}"), F.col(f"_c_{c}")) for c in cols}
    else:
        value = {c: F.when(F.col("_rn") == 1, F.col(f"_c_{c}")).otherwise(F.col(f"_p_{c}")) for c in cols}
    return joined.select(*df.columns, *[v.alias(f"{prefix}{c}") for c, v in value.items()])


def apply_policy(value: Column, prev: Column, policy: str) -> Column:
    """Counter increment under a reset policy.

    ``raw`` plain difference; ``clamp`` never below zero, and zero without a previous value; ``null`` unknown after a
    reset; ``restart`` counts the new value after a reset and zero for the first sample. ``drop`` equals ``null`` here;
    the caller removes the row.
    """
    d = value - prev
    if policy == "raw":
        return d
    if policy == "clamp":
        return F.greatest(d, F.lit(0))
    if policy in ("null", "drop"):
        return F.when(d >= 0, d)
    if policy == "restart":
        return F.when(value.isNull(), None).when(prev.isNull(), value - value).when(d >= 0, d).otherwise(value)
    raise ValueError(f"policy must be one of {POLICIES}")


def lag_delta(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], policy: str = "raw",
              chunk: int = DAY) -> DataFrame:
    """Add ``d_<c>`` per counter and ``dt`` (seconds since the previous sample)."""
    prev = with_previous(df, keys, ts, [*cols, ts], chunk)
    out = prev.withColumns({f"d_{c}": apply_policy(F.col(c), F.col(f"prev_{c}"), policy) for c in cols}
                           | {"dt": elapsed_seconds(F.col(ts), F.col(f"prev_{ts}"))})
    if policy == "drop":
        for c in cols:
            out = out.filter(F.col(f"d_{c}").isNotNull())
    return out.drop(*[f"prev_{c}" for c in [*cols, ts]])


def rate(df: DataFrame, keys: Sequence[str], ts: str, value: str, chunk: int = DAY) -> DataFrame:
    """Per-second rate ``v`` of a counter: clamped at resets, NULL for the first sample."""
    d = lag_delta(df, keys, ts, [value], "clamp", chunk)
    return d.withColumn("v", F.when(F.col("dt") > 0, F.col(f"d_{value}") / F.col("dt")))


def counter_increments(df: DataFrame, keys: Sequence[str], ts: str, counters: Sequence[str],
                       width: int | str) -> DataFrame:
    """Reset-safe increments ``inc_<c>`` inside each bucket; the step between two buckets is not counted.

    The window partition is one bucket of one series, so a hot entity is split by time.
    """
    span = (f"over (partition by {', '.join(keys)}, bucket order by {ts} "
            "rows between unbounded preceding and 1 preceding)")
    before = df.withColumn("bucket", time_bucket(ts, width)).selectExpr(
        "*", *[f"last({c}, true) {span} as _p_{c}" for c in counters])
    return before.selectExpr(*df.columns, "bucket", *[
        f"case when {c} is null then null when _p_{c} is null then {c} - {c} when {c} >= _p_{c} then {c} - _p_{c} "
        f"else {c} end as inc_{c}" for c in counters])


def counter_delta(df: DataFrame, keys: Sequence[str], ts: str, counters: Sequence[str], width: int | str,
                  extra: Sequence[Column] = (), spans: Sequence[str] = ()) -> DataFrame:
    """Bucket table: ``d_<c>`` per counter, ``td_<c>`` (seconds from first to last sample) for ``spans``, and any
    further aggregates. One exchange: the aggregate runs on the partitioning of the window."""
    inc = counter_increments(df, keys, ts, counters, width)
    aggs = [F.expr(f"sum(inc_{c}) as d_{c}") for c in counters]
    aggs += [F.expr(f"(max(if({c} is null, null, unix_micros({ts}))) - min(if({c} is null, null, unix_micros({ts})))) "
                    f"/ 1e6D as td_{c}") for c in spans]
    return inc.groupBy(*keys, "bucket").agg(*aggs, *extra)


def max_min_delta(df: DataFrame, keys: Sequence[str], value: str, out: str = "d") -> DataFrame:
    """Increment of a counter as max - min per key (map-side combined)."""
    return df.groupBy(*keys).agg((F.max(value) - F.min(value)).alias(out))


# --- buckets and ratios -------------------------------------------------------------------------------------------

def aggregate_of(value: Column, agg: str) -> Column:
    """avg or max; the 95th percentile has an operator of its own, ``exact_percentile``."""
    if agg == "avg":
        return F.avg(value)
    if agg == "max":
        return F.max(value)
    raise ValueError("agg must be avg, max or p95")


def bucket_agg(df: DataFrame, ts: str, value: str, width: int | str, agg: str = "avg",
               dims: Sequence[str] = ()) -> DataFrame:
    """Samples or a series of instants to buckets: ``(ts, value, *dims)``.

    The percentile is taken by ``exact_percentile``: hosts report at their own instants, so a bucket of a large fleet
    holds any number of values.
    """
    rows = df.filter(F.col(value).isNotNull()).withColumn("_b", time_bucket(ts, width))
    if agg == "p95":
        out = exact_percentile(rows, ["_b", *dims], value, 0.95)
    else:
        out = rows.groupBy("_b", *dims).agg(aggregate_of(F.col(value), agg).alias("value"))
    return out.select(F.col("_b").alias("ts"), "value", *dims)


def weighted_ratio(df: DataFrame, ts: str, num: Column, den: Column, dims: Sequence[str] = (),
                   scale: float = 100.0) -> DataFrame:
    """Per instant ``sum(num) / sum(den) * scale`` as ``v``."""
    return (df.groupBy(ts, *dims).agg(F.sum(num).alias("_n"), F.sum(den).alias("_d"))
            .select(ts, *dims, (ratio(F.col("_n"), F.col("_d")) * F.lit(scale)).alias("v")))


def ever_crossed(df: DataFrame, ts: str, flag: Column, width: int | str, keys: Sequence[str] = ()) -> DataFrame:
    """Per bucket (and key): did any sample cross? NULL when nothing was decidable."""
    return df.groupBy(time_bucket(ts, width).alias("_b"), *keys).agg(F.bool_or(flag).alias("ever")) \
        .withColumnRenamed("_b", "bucket")


def crossed_hosts(df: DataFrame, ts: str, flag: Column, width: int | str, host: str) -> DataFrame:
    """Number of hosts that crossed at least once per bucket: ``(ts, value)``."""
    return (ever_crossed(df, ts, flag, width, [host]).groupBy("bucket")
            .agg(F.count_if(F.col("ever")).cast("double").alias("value"))
            .withColumnRenamed("bucket", "ts"))


def crossed_any(df: DataFrame, ts: str, flag: Column, width: int | str) -> DataFrame:
    """1.0 when any sample of the bucket crossed, else 0.0: ``(ts, value)``."""
    return ever_crossed(df, ts, flag, width).select(
        F.col("bucket").alias("ts"), F.when(F.col("ever"), 1.0).otherwise(0.0).alias("value"))


# --- latest rows --------------------------------------------------------------------------------------------------

def latest_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first ``n`` rows per key. Spark limits each group before the shuffle, so a hot key moves n rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def latest_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return latest_n(df, keys, order, 1, "_rn").drop("_rn")


def pair_pivot(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """Newest and second newest row of a key side by side: ``cur_<c>``, ``prv_<c>`` and ``pair_dt`` seconds."""
    two = latest_n(df, keys, [F.col(ts).desc()], 2)
    aggs = []
    for c in [*cols, ts]:
        aggs.append(F.max(F.when(F.col("rn") == 1, F.col(c))).alias(f"cur_{c}"))
        aggs.append(F.max(F.when(F.col("rn") == 2, F.col(c))).alias(f"prv_{c}"))
    return two.groupBy(*keys).agg(*aggs).withColumn(
        "pair_dt", elapsed_seconds(F.col(f"cur_{ts}"), F.col(f"prv_{ts}")))


# --- carry forward and gaps ---------------------------------------------------------------------------------------

def _bucket_last(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], width: int) -> DataFrame:
    """Last fully measured sample per key and bucket (map-side combined)."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    return (df.filter(ok).groupBy(*keys, time_bucket(ts, width).alias("bucket"))
            .agg(*[F.max_by(c, ts).alias(c) for c in cols], F.max(ts).alias("sample_ts")))


def locf_spans(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], width: int | str, start: Column,
               end: Column, max_age: int | None = None) -> DataFrame:
    """Validity spans ``[from_bucket, until_bucket)`` of carried values on the bucket grid ``start .. end``.

    Every series is first reduced to one row per bucket, so the window per series is bounded by the grid.
    """
    step = seconds(width)
    last = _bucket_last(df, keys, ts, cols, step)
    w = Window.partitionBy(*keys).orderBy("bucket")
    grid_lo, grid_hi = time_bucket(start, step), time_bucket(end, step)
    after_end = F.timestamp_micros(F.unix_micros(grid_hi) + F.lit(step * 1_000_000))
    nxt = F.coalesce(F.lead("bucket").over(w), after_end)
    if max_age is not None:
        expiry = F.timestamp_micros(F.unix_micros(time_bucket(F.col("sample_ts"), step))
                                    + F.lit((max_age // step + 1) * step * 1_000_000))
        nxt = F.least(nxt, expiry)
    return (last.withColumn("until_bucket", F.least(nxt, after_end))
            .withColumn("from_bucket", F.greatest(F.col("bucket"), grid_lo))
            .filter(F.col("from_bucket") < F.col("until_bucket")).drop("bucket"))


def locf_grid(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], width: int | str, start: Column,
              end: Column, max_age: int | None = None) -> DataFrame:
    """As-of values per bucket and key: each validity span is unrolled into exactly the rows it answers."""
    step = seconds(width)
    spans = locf_spans(df, keys, ts, cols, step, start, end, max_age)
    last = F.timestamp_micros(F.unix_micros(F.col("until_bucket")) - F.lit(step * 1_000_000))
    return spans.select(*keys, *cols, F.explode(
        F.sequence(F.col("from_bucket"), last, F.expr(f"interval {step} seconds"))).alias("ts"))


def locf_totals(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], width: int | str, start: Column,
                end: Column) -> DataFrame:
    """Fleet totals of carried values per bucket without unrolling series x buckets.

    A span adds its value where it begins and takes it away where it ends; a running total over the (small) grid
    gives the sum of all values alive in each bucket.
    """
    step = seconds(width)
    spans = locf_spans(df, keys, ts, cols, step, start, end)
    ups = spans.select(F.col("from_bucket").alias("ts"), *[F.col(c).alias(c) for c in cols])
    downs = spans.select(F.col("until_bucket").alias("ts"), *[(-F.col(c)).alias(c) for c in cols])
    steps = ups.unionByName(downs).groupBy("ts").agg(*[F.sum(c).alias(c) for c in cols])
    grid = time_grid(df.sparkSession, start, end, step)
    w = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)  # one row per grid bucket
    return grid.join(steps, "ts", "left").select("ts", *[F.sum(c).over(w).alias(c) for c in cols])


def time_grid(spark, start: Column, end: Column, width: int | str) -> DataFrame:
    """All bucket starts from ``start`` to ``end``."""
    step = seconds(width)
    return spark.range(1).select(F.explode(F.sequence(
        time_bucket(start, step), time_bucket(end, step), F.expr(f"interval {step} seconds"))).alias("ts"))


def gap_fill(series: DataFrame, start: Column, end: Column, width: int | str) -> DataFrame:
    """Series aligned to the grid; buckets without a value are NULL."""
    return time_grid(series.sparkSession, start, end, width).join(series, "ts", "left")


def target_grid(targets: DataFrame, start: Column, end: Column, width: int | str) -> DataFrame:
    """Every bucket for every target row."""
    step = seconds(width)
    return targets.withColumn("ts", F.explode(F.sequence(
        time_bucket(start, step), time_bucket(end, step), F.expr(f"interval {step} seconds"))))


def merge_series(series: dict[str, DataFrame]) -> DataFrame:
    """Outer merge of ``(ts, value)`` series; one column per series, NULL where a series has no bucket."""
    tagged = None
    for name, s in series.items():
        part = s.select("ts", F.lit(name).alias("_s"), "value")
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("ts").agg(*[F.max(F.when(F.col("_s") == n, F.col("value"))).alias(n) for n in series])


def first_last_span(df: DataFrame, keys: Sequence[str], ts: str, first: Sequence[str] = (), last: Sequence[str] = (),
                    extra: Sequence[Column] = ()) -> DataFrame:
    """First / last values by time and the span in days."""
    return df.groupBy(*keys).agg(
        *[F.min_by(c, ts).alias(f"first_{c}") for c in first], *[F.max_by(c, ts).alias(f"last_{c}") for c in last],
        ((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / F.lit(86400e6)).alias("span_days"), *extra)


def percentile_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """p95, median, avg, max and count per key over rollup rows (one per bucket, so the buffer is bounded)."""
    return df.groupBy(*keys).agg(
        F.percentile(value, F.lit(0.95)).alias("p95"), F.percentile(value, F.lit(0.5)).alias("median"),
        F.avg(value).alias("avg"), F.max(value).alias("peak"), F.count(value).alias("samples"))


def exact_percentile(df: DataFrame, keys: Sequence[str], value: str, p: float) -> DataFrame:
    """Exact interpolated percentile for groups of any size and shape, without one task holding a group.

    Pass 1 (map-side combined) gives count, range and a quantile sketch per group. The sketch's rank error is at most
    one in ``SKETCH``, so that two of its quantiles enclose the wanted ranks whatever the distribution. Pass 2 counts the
    values below them as one number and the distinct values between them, which are at most 8 in ``SKETCH`` of the
    group's rows besides ties; only these are ranked. Groups of up to ``SMALL_GROUP`` rows are ranked whole.
    """
    keys = list(keys)
    src = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    eps = 4 / SKETCH
    around = F.percentile_approx("_v", [max(0.0, p - eps), min(1.0, p + eps)], SKETCH)
    rng = src.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"), around.alias("_q"))
    small, pos = F.col("_n") <= SMALL_GROUP, F.lit(p) * (F.col("_n") - 1)
    rng = rng.select(
        *keys, (F.col("_lo") if p <= eps else F.when(small, F.col("_lo")).otherwise(F.col("_q")[0])).alias("_from"),
        (F.col("_hi") if p >= 1 - eps else F.when(small, F.col("_hi")).otherwise(F.col("_q")[1])).alias("_to"), pos.alias("_pos"))
    # null keys form groups too
    rng = rng.toDF(*[f"_k{i}" for i in range(len(keys))], "_from", "_to", "_pos")
    same = [src[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    near = (src.join(rng, same) if keys else src.crossJoin(rng)).filter(F.col("_v") <= F.col("_to"))
    # everything below is one group, NULL, which comes first in the order
    counts = near.groupBy(*keys, F.when(F.col("_v") >= F.col("_from"), F.col("_v")).alias("_w")).agg(F.count("*").alias("_c"), F.first("_pos").alias("_pos"))
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_w")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_upto", F.sum("_c").over(w)).withColumn("_before", F.col("_upto") - F.col("_c"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_upto")), F.col("_w")))

    at0, at1 = at(F.floor("_pos")), at(F.ceil("_pos"))
    return ranked.groupBy(*keys).agg((at0 + (at1 - at0) * F.max(F.col("_pos") - F.floor("_pos"))).alias("value"))


# --- changes ------------------------------------------------------------------------------------------------------

def differs(a: Column, b: Column) -> Column:
    """Null-safe inequality."""
    return ~a.eqNullSafe(b)


def change_events(history: DataFrame, keys: Sequence[str], ts: str, boot: str, agent: str,
                  tolerance_seconds: int = 5) -> DataFrame:
    """``reboot`` where the boot time moved by more than the tolerance (or on the first row), else
    ``restart`` where the agent start changed. Other rows are dropped."""
    prev = with_previous(history.filter(F.col(boot).isNotNull()), keys, ts, [boot, agent, ts])
    moved = F.abs(elapsed_seconds(F.col(boot), F.col(f"prev_{boot}"))) > tolerance_seconds
    kind = (F.when(F.col(f"prev_{boot}").isNull() | moved, F.lit("reboot"))
            .when(differs(F.col(agent), F.col(f"prev_{agent}")), F.lit("restart")))
    return prev.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(*keys, ts, "kind", boot, agent)


def running_offset(df: DataFrame, order: Sequence[Column], value: str, out: str = "offset") -> DataFrame:
    """Sum of the values before each row; for share charts over a few categories."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))


def places(df: DataFrame, coarse: Sequence[Column], order: Sequence[Column], out: str = "place") -> DataFrame:
    """``df`` with the place of every row in ``order``, from 1.

    ``coarse`` are ascending columns that begin the order (rounded, or a prefix of a name): rows are numbered inside the
    groups they form, and only the groups' sizes, a small table, are added up in one task.
    """
    names = [f"_g{i}" for i in range(len(coarse))]
    rows = df.withColumns(dict(zip(names, coarse, strict=True)))
    before = running_offset(rows.groupBy(*names).agg(F.count("*").alias("_n")), [F.asc(n) for n in names], "_n", "_before").drop("_n")
    numbered = rows.withColumn("_row", F.row_number().over(Window.partitionBy(*names).orderBy(*order)))
    before = before.toDF(*[f"_of{n}" for n in names], "_before")
    return numbered.join(before, [numbered[n].eqNullSafe(F.col(f"_of{n}")) for n in names]).withColumn(out, F.col("_before") + F.col("_row")).select(*df.columns, out)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return latest_n(df, keys, order, n, "_rn").drop("_rn")


