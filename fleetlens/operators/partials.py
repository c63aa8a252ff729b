"""Counter summaries that merge: the state of a rollup does not grow with its samples.

A partial row stands for the samples of one series in one bucket (and one micro-batch, in a stream). For each counter it
holds the first and the last measured sample and the reset-safe increment between them; two partials that follow each
other in time merge into one of the same form, the step from the last value of one to the first of the next included.
So five-minute rows roll up to hours and days, and batches to buckets, without the samples. Partials whose times overlap
(samples that came out of order) can't be merged; ``merge_partials`` marks such buckets, and only they are rolled again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.exprs import time_bucket
from fleetlens.operators.kernels import counter_increments

SPAN = ("first_at", "last_at", "sample_count")


def _gauge_names(gauges: Sequence[str]) -> list[str]:
    return [f"{g}_{a}" for g in gauges for a in ("sum", "n", "max")]


def partial_rollup(samples: DataFrame, keys: Sequence[str], ts: str, counters: Sequence[str], gauges: Sequence[str], width: int | str) -> DataFrame:
    """``c_<counter>`` struct(first(t, v), last(t, v), inc), ``<gauge>_sum/_n/_max``, first_at, last_at and sample_count for every
    series and bucket. A counter that is never measured has NULL parts."""
    inc = counter_increments(samples, keys, ts, counters, width)
    aggs = []
    for c in counters:
        seen = F.when(F.col(c).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(c).alias("v")))
        aggs.append(F.struct(F.min(seen).alias("first"), F.max(seen).alias("last"), F.sum(f"inc_{c}").alias("inc")).alias(f"c_{c}"))
    for g in gauges:
        aggs += [F.sum(g).alias(f"{g}_sum"), F.count(g).alias(f"{g}_n"), F.max(g).alias(f"{g}_max")]
    return inc.groupBy(*keys, "bucket").agg(*aggs, F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count("*").alias("sample_count"))


def _fold(parts: str) -> str:
    step = "if(y.first.v >= x.last.v, y.first.v - x.last.v, y.first.v)"
    return (f"aggregate(filter({parts}, (y, i) -> i > 0), get({parts}, 0), (x, y) -> "
            f"named_struct('first', x.first, 'last', y.last, 'inc', x.inc + {step} + y.inc))")


def merge_partials(partials: DataFrame, keys: Sequence[str], counters: Sequence[str], gauges: Sequence[str], width: int | str | None = None) -> DataFrame:
    """Partials merged by series and bucket, into wider buckets where ``width`` is given; the result has the same form, with
    ``overlaps`` for the buckets whose parts are not one after the other.

    A group holds the narrow buckets of a wide one times the batches that touched them; ``compact`` of a stream merges
    the batches, so the list stays short whatever the number of samples.
    """
    src = partials if width is None else partials.withColumn("bucket", time_bucket("bucket", width))
    part = [F.array_sort(F.collect_list(F.when(F.col(f"c_{c}.first").isNotNull(), F.col(f"c_{c}")))).alias(f"c_{c}") for c in counters]
    gauge = [F.max(n).alias(n) if n.endswith("_max") else F.sum(n).alias(n) for n in _gauge_names(gauges)]
    rows = src.groupBy(*keys, "bucket").agg(
        *part, *gauge, F.array_sort(F.collect_list(F.struct("first_at", "last_at"))).alias("_spans"),
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("sample_count").alias("sample_count"))
    return rows.selectExpr(*keys, "bucket", *[f"{_fold(f'c_{c}')} as c_{c}" for c in counters], *_gauge_names(gauges), *SPAN,
                           "exists(transform(_spans, (s, i) -> i > 0 and s.first_at <= get(_spans, i - 1).last_at), late -> late) as overlaps")


def rolled(partials: DataFrame, keys: Sequence[str], counters: Sequence[str], gauges: Sequence[str], spans: Sequence[str] = ()) -> DataFrame:
    """The bucket table of partials: ``d_<counter>``, ``td_<counter>`` for ``spans``, avg and max of gauges, sample count."""
    return partials.selectExpr(
        *keys, "bucket", *[f"c_{c}.inc as d_{c}" for c in counters],
        *[f"(unix_micros(c_{c}.last.t) - unix_micros(c_{c}.first.t)) / 1e6D as td_{c}" for c in spans],
        *[e for g in gauges for e in (f"{g}_sum / nullif({g}_n, 0) as {g}_avg", f"{g}_max")], "sample_count")
