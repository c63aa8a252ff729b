"""Stored rollups that stay right when samples come late.

A store keeps, below one folder,

- the bucket tables, laid out by day;
- a log of late days: which days below a table's high-water mark a batch of samples has touched;
- the marks: for every table how far it is materialised, and up to which batch the log is worked off.

``refresh`` rebuilds whole days from the samples, the late ones and the new complete ones, replaces exactly these day
folders, and then moves the mark. A refresh that fails half-way, or runs twice, rebuilds the same days again. Readers get
the stored buckets below the mark and the rest from the samples above it. Buckets must not reach across midnight UTC.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.fleet import Fleet
from fleetlens.functions.exprs import seconds, timestamp
from fleetlens.operators import rollups as R
from fleetlens.sources.tables import DAY, replace_days

#: Bucket table: samples it is made of, and how.
ROLLUPS: dict[str, tuple[str, Callable[[DataFrame, int | str], DataFrame]]] = {
    "host": ("host_metrics", R.rollup_host), "disk": ("disk_io", R.rollup_disk), "net": ("net_io", R.rollup_net),
    "core": ("cpu_core", R.rollup_core), "filesystem": ("filesystem", R.rollup_filesystem),
}
TS = "collected_at"
MARK_SCHEMA = "name string, high_water date, batch_upto long, seq long"
LATE_SCHEMA = "day date, batch long"


class RollupStore:
    """Bucket tables of a fleet below ``root``; ``width`` divides a day."""

    def __init__(self, spark: SparkSession, root: str, width: int | str = "5m"):
        if 86400 % seconds(width):
            raise ValueError(f"a day is not a multiple of {width}")
        self.spark, self.root, self.width = spark, root.rstrip("/"), width

    # --- log and marks

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def mark(self, name: str) -> tuple[dt.date | None, int]:
        """The day up to which ``name`` is materialised (that day not included), and the last batch of its log that is worked off."""
        path = f"{self.root}/marks"
        if not self._exists(path):
            return None, -1
        row = self.spark.read.schema(MARK_SCHEMA).parquet(path).where(F.col("name") == name).agg(F.max_by(F.struct("high_water", "batch_upto"), "seq").alias("m")).first()
        return (row.m.high_water, row.m.batch_upto) if row and row.m else (None, -1)

    def _move(self, name: str, day: dt.date, batch_upto: int) -> None:
        path = f"{self.root}/marks"
        last = self.spark.read.schema(MARK_SCHEMA).parquet(path).agg(F.max("seq")).first()[0] if self._exists(path) else None
        row = self.spark.createDataFrame([(name, day, batch_upto, (last or 0) + 1)], MARK_SCHEMA)
        row.coalesce(1).write.mode("append").parquet(path)

    def arrived(self, batch: DataFrame, samples: str, batch_id: int) -> None:
        """Logs the days of a batch of ``samples`` that lie below the mark of a table made of them.

        Batches are numbered upwards; a batch that is logged again replaces its own entry.
        """
        for name, (source, _) in ROLLUPS.items():
            high, _ = self.mark(name)
            if source == samples and high is not None:
                late = batch.where(F.to_date(TS) < F.lit(high)).select(F.to_date(TS).alias("day")).distinct().withColumn("batch", F.lit(batch_id).cast("long"))
                late.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/late/{name}/{batch_id}")

    def late_days(self, name: str) -> tuple[list[dt.date], int]:
        """Logged days that are not rebuilt yet (a calendar bounds them), and the last batch of the log."""
        path = f"{self.root}/late/{name}"
        done = self.mark(name)[1]
        if not self._exists(path):
            return [], done
        log = self.spark.read.schema(LATE_SCHEMA).option("recursiveFileLookup", "true").parquet(path).where(F.col("batch") > done)
        row = log.agg(F.array_sort(F.collect_set("day")).alias("days"), F.max("batch").alias("upto")).first()
        return list(row.days), done if row.upto is None else row.upto

    # --- refresh and reading

    def refresh(self, fleet: Fleet, until: Column | dt.date, names: tuple[str, ...] = tuple(ROLLUPS)) -> dict[str, int]:
        """Materialises all complete days before ``until`` and rebuilds the late ones; the number of days rebuilt per table."""
        end = until if isinstance(until, dt.date) else self.spark.range(1).select(F.to_date(until).alias("d")).first().d
        rebuilt = {}
        for name in names:
            source, rollup = ROLLUPS[name]
            high, _ = self.mark(name)
            late, upto = self.late_days(name)
            late = [d for d in late if high is not None and d < high]
            spans = [(d, d + dt.timedelta(days=1)) for d in late] + ([(high, end)] if high is None or high < end else [])
            rows = self.samples_of(fleet[source], spans)
            rolled = rollup(rows, self.width)
            if self._exists(f"{self.root}/{name}"):
                replace_days(rolled, self.root, name)
            else:
                rolled.withColumn(DAY, F.to_date("bucket")).hint("rebalance", DAY).write.partitionBy(DAY).parquet(f"{self.root}/{name}")
            self._move(name, max(end, high or end), upto)
            rebuilt[name] = len(late) + (max(0, (end - high).days) if high else 0)
        return rebuilt

    @staticmethod
    def samples_of(samples: DataFrame, spans: list[tuple[dt.date | None, dt.date]]) -> DataFrame:
        """Samples of some spans of days, as ranges of the time column, which reach the scan."""
        keep = F.lit(False)
        for a, b in spans:
            to = F.col(TS) < timestamp(f"{b} 00:00:00")
            keep = keep | (to if a is None else (F.col(TS) >= timestamp(f"{a} 00:00:00")) & to)
        return samples.where(keep)

    def table(self, fleet: Fleet, name: str) -> DataFrame:
        """Stored buckets below the mark, and those above it from the samples."""
        source, rollup = ROLLUPS[name]
        high, _ = self.mark(name)
        if high is None:
            return rollup(fleet[source], self.width)
        return R.realtime_union(self.spark.read.parquet(f"{self.root}/{name}").drop(DAY), fleet[source], rollup, self.width, timestamp(f"{high} 00:00:00"))

    def tables(self, fleet: Fleet) -> dict[str, DataFrame]:
        """All bucket tables, as ``operators.reports.Rollups`` takes them."""
        return {name: self.table(fleet, name) for name in ROLLUPS}
