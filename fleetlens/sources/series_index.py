"""The newest samples of every series and the ends of every mount's history, kept up to date batch by batch.

Dashboards need two samples per series and a capacity runway needs the first and the last free space of a mount; neither
should scan the history. A batch is merged into one row set per table whose size depends on the number of series only:

- ``newest``: the two newest samples of a series, all columns. A sample that comes again does not take a second place; of
  samples of one instant the stored one stays.
- ``mounts``: one row per data volume with its earliest and latest sample and its largest size and inode share. All parts
  merge by minimum or maximum, so late and repeated samples are right whenever they come.

Samples from a clock that runs ahead wait beside the index until their time has come, so they displace nothing and none
is lost. Each batch writes new folders and counts once it is committed (see ``streaming.epochs``): a batch that fails and
comes again, with its number, starts from the state before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.fleet import Fleet
from fleetlens.functions.exprs import data_volume, not_future, ratio, time_bucket
from fleetlens.schemas import NATURAL_KEYS
from fleetlens.streaming.epochs import EPOCH, EpochStore

HOST, TS = "server_id", "collected_at"
#: Tables of series; an error counter is read over a window, not by its newest pair.
SERIES = tuple(t for t in NATURAL_KEYS if t not in ("disk_error", "inventory_history"))
MOUNTS = "mounts"


def series_keys(table: str, host: str = HOST) -> list[str]:
    return [host if k == HOST else k for k in NATURAL_KEYS[table] if k != TS]


def newest_samples(samples: DataFrame, keys: list[str], n: int = 2, stored: str | None = None) -> DataFrame:
    """The samples of the ``n`` newest instants of every series, one per instant.

    Ranks are limited before the shuffle, so a busy series moves few rows per task; the choice among samples of one instant
    (``stored`` ones first, then by content) runs on the same partitioning.
    """
    body = [c for c in samples.columns if c != stored]
    ranked = samples.withColumn("_place", F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.desc(TS)))).filter(F.col("_place") <= n)
    order = ([F.desc(stored)] if stored else []) + [F.xxhash64(*body)]
    one = ranked.withColumn("_one", F.row_number().over(Window.partitionBy(*keys, TS).orderBy(*order))).filter(F.col("_one") == 1)
    return one.select(*body)


def mount_ends(samples: DataFrame, host: str = HOST) -> DataFrame:
    """Earliest and latest sample of every data volume, its largest size and inode share."""
    inodes = F.col("inodes_used") + F.col("inodes_free")
    return samples.filter(data_volume()).groupBy(host, "mountpoint").agg(
        F.min(TS).alias("first_at"), F.max(TS).alias("last_at"),
        F.min_by("free_bytes", TS).alias("av_first"), F.max_by("free_bytes", TS).alias("av_last"),
        F.min_by("inodes_free", TS).alias("in_first"), F.max_by("inodes_free", TS).alias("in_last"),
        F.max(F.col("used_bytes") + F.col("free_bytes")).alias("total_bytes"),
        F.max(F.when(inodes > 0, ratio(F.col("inodes_used"), inodes) * 100)).alias("inode_used_pct"))


def merge_ends(parts: DataFrame, host: str = HOST) -> DataFrame:
    """One row per volume from any number of partial ones."""
    return parts.groupBy(host, "mountpoint").agg(
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"),
        F.min_by("av_first", "first_at").alias("av_first"), F.max_by("av_last", "last_at").alias("av_last"),
        F.min_by("in_first", "first_at").alias("in_first"), F.max_by("in_last", "last_at").alias("in_last"),
        F.max("total_bytes").alias("total_bytes"), F.max("inode_used_pct").alias("inode_used_pct"))


class SeriesIndex:
    """Index tables below ``root``. ``host`` is the column that names a host in the samples."""

    def __init__(self, spark: SparkSession, root: str, host: str = HOST):
        self.spark, self.host = spark, host
        self.store = EpochStore(spark, root)

    # --- writing

    def add(self, samples: DataFrame, table: str, epoch: int, now: Column) -> None:
        """Merges the samples of one table of batch ``epoch``; nothing happens if the batch is committed."""
        if epoch <= self.store.committed():
            return
        keys = series_keys(table, self.host)
        waiting = self._state(f"{table}.ahead")
        rows = samples if waiting is None else samples.unionByName(waiting, allowMissingColumns=True)
        ripe = not_future(TS, now)
        self.store.write(rows.filter(~ripe).dropDuplicates([*keys, TS]), f"{table}.ahead", epoch)
        due, known = rows.filter(ripe), self._state(table)
        both = due.withColumn("_stored", F.lit(False))
        if known is not None:
            both = both.unionByName(known.withColumn("_stored", F.lit(True)), allowMissingColumns=True)
        self.store.write(newest_samples(both, keys, stored="_stored"), table, epoch)
        if table == "filesystem":
            ends, before = mount_ends(due, self.host), self._state(MOUNTS)
            self.store.write(ends if before is None else merge_ends(before.unionByName(ends), self.host), MOUNTS, epoch)

    def commit(self, epoch: int) -> None:
        """Makes batch ``epoch`` count, and deletes states older than the one before it, which running readers may still use."""
        if epoch <= self.store.committed():
            return
        self.store.commit(epoch)
        for table in (*SERIES, MOUNTS):
            for name in (table, f"{table}.ahead"):
                for old in self.store.epochs(name)[1][:-2]:
                    self.store.forget(f"{name}/{EPOCH}={old}")

    def batch(self, fleet: Fleet, epoch: int, now: Column, tables: tuple[str, ...] = SERIES) -> None:
        """One whole batch: the samples of several tables, then the commit."""
        for table in tables:
            self.add(fleet[table], table, epoch, now)
        self.commit(epoch)

    def _state(self, table: str) -> DataFrame | None:
        """The newest committed state; a table that a batch did not touch keeps its older one."""
        epochs = self.store.epochs(table)[1]
        return self.store.read(table, only=epochs[-1]).drop(EPOCH) if epochs else None

    # --- reading

    def newest(self, table: str) -> DataFrame | None:
        """The newest samples of every series and those that wait for their time; None before the first batch.

        Valid for anchors from the ``now`` of the last batch on: the views leave out what is ahead of their anchor and take
        the newest two of the rest.
        """
        rows, waiting = self._state(table), self._state(f"{table}.ahead")
        return rows if rows is None or waiting is None else rows.unionByName(waiting, allowMissingColumns=True)

    def fleet(self, base: Fleet) -> Fleet:
        """``base`` with the indexed samples in place of the whole sample tables, for ``operators.snapshots``."""
        def load(name: str) -> DataFrame:
            rows = self.newest(name) if name in SERIES else None
            return base[name] if rows is None else rows

        return Fleet(load)

    def mount_spans(self, width: int | str = "5m") -> DataFrame | None:
        """What ``operators.reports.mount_spans`` gives for the whole history, in buckets of ``width``."""
        ends = self._state(MOUNTS)
        if ends is None:
            return None
        first, last = (F.unix_timestamp(time_bucket(c, width)) for c in ("first_at", "last_at"))
        return ends.select(self.host, "mountpoint", "av_first", "av_last", "total_bytes", "in_first", "in_last", "inode_used_pct",
                           ((last - first) / F.lit(86400.0)).alias("span_days"))
