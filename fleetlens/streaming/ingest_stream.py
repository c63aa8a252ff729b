"""One stream of messages into all stored tables.

A micro-batch is checked and parsed once into a compressed table, from which it fans out column by column: metrics to the host table and its six child tables, inventory to
the newest row per agent and to the history of changes, errors and task results to their logs, bad messages to the
quarantine. All writes of a batch count together (see ``epochs``), so a batch that fails half-way and comes again leaves
every row once.

Nothing is cached: the table of the batch, of columns, is a small part of the text and goes with the commit, and shuffle
files go with the query that wrote them, so the disk holds those of one table at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import schemas as X
from fleetlens.operators.kernels import latest_one
from fleetlens.sources import ingest as G
from fleetlens.sources.rollup_store import RollupStore
from fleetlens.sources.series_index import SERIES, SeriesIndex
from fleetlens.sources.tables import DAY
from fleetlens.streaming.epochs import EPOCH, EpochStore, passing_shuffles

AGENT, TS = "agent_id", "collected_at"
LOGS = {"agent_errors": "error", "task_results": "task.result"}
PARSED, FIRST = "parsed", "first_rows"  # of the batch that is being taken in


def _keys(table: str) -> list[str]:
    return [AGENT if k == "server_id" else k for k in X.NATURAL_KEYS[table]]


class IngestStream:
    """Stored tables below ``root``. ``rollups``, if given, learns of late days (samples below its marks) with every batch;
    ``index`` (with host column ``agent_id``) takes the newest samples and the ends of the mounts."""

    def __init__(self, spark: SparkSession, root: str, rollups: RollupStore | None = None, index: SeriesIndex | None = None):
        self.spark, self.root, self.rollups, self.index = spark, root.rstrip("/"), rollups, index
        self.store = EpochStore(spark, f"{self.root}/tables")

    def run(self, stream: DataFrame) -> IngestStream:
        """Takes in the messages (column ``value``) that are available now."""
        q = stream.writeStream.option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).foreachBatch(self.batch).start()
        q.awaitTermination()
        return self

    def batch(self, messages: DataFrame, epoch: int) -> None:
        """One micro-batch; does nothing if the epoch is committed."""
        if epoch <= self.store.committed():
            return
        with passing_shuffles(self.spark):
            self._take_in(messages, epoch)

    def _take_in(self, messages: DataFrame, epoch: int) -> None:
        parsed = self._kept(G.sorted_out(messages), PARSED, epoch)
        self.store.write(parsed.where("problems is not null").select("value", "problems"), "quarantine", epoch)
        samples = parsed.where("message_type = 'metrics'")
        first = self._kept(G.first_rows(samples), FIRST, epoch)
        metrics = G.kind_of(G.with_rows(samples, first), "metrics")
        for table, parse in G.PARSERS.items():
            self._samples(parse(metrics), table, epoch)
        self.store.write(metrics.groupBy(AGENT).agg(F.max(TS).alias(TS)), "seen", epoch)
        others = G.parse_any(parsed.where("problems is null and value is not null"))
        self._inventory(G.dedupe(G.kind_of(others, "inventory")), epoch)
        for table, kind in LOGS.items():
            rows = G.dedupe(G.kind_of(others, kind))
            self.store.write(self._absent(rows, self.store.read(table), ["message_id"]), table, epoch)
        if self.index:
            self.index.commit(epoch)
        self.store.commit(epoch)
        for table in (PARSED, FIRST):
            self.store.forget(table)

    def _kept(self, rows: DataFrame, table: str, epoch: int) -> DataFrame:
        """Rows written for the time of the batch. What a batch that failed has left is replaced."""
        path = f"{self.store.root}/{table}/{EPOCH}={epoch}"
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    @staticmethod
    def _absent(rows: DataFrame, stored: DataFrame | None, keys: Sequence[str]) -> DataFrame:
        return rows.dropDuplicates(list(keys)) if stored is None else G.insert_if_absent(rows, stored, keys)

    def _samples(self, rows: DataFrame, table: str, epoch: int) -> None:
        """Samples whose natural key is not stored; only the stored days that the batch touches are compared."""
        rows = rows.withColumn(DAY, F.to_date(TS))
        stored = self.store.read(table)
        if stored is not None and DAY in stored.columns:
            days = [r[0] for r in rows.select(DAY).distinct().collect()]  # days of one batch, which a calendar bounds
            stored = stored.where(F.col(DAY).isin(days))
        self.store.write(self._absent(rows, stored, _keys(table)), table, epoch, by=DAY)
        if self.rollups:
            self.rollups.arrived(rows, table, epoch)
        if self.index and table in SERIES:
            self.index.add(rows.drop(DAY), table, epoch, F.current_timestamp())

    def _inventory(self, rows: DataFrame, epoch: int) -> None:
        """The newest row per agent of the batch; and for the history, the rows that differ from the one before, stored or new."""
        self.store.write(latest_one(rows, [AGENT], [F.desc(TS), F.desc("message_id")]), "inventory", epoch)
        rows = rows.dropDuplicates([AGENT, TS])
        stored = self.store.read("inventory_history")
        both = rows.withColumn("_old", F.lit(False))
        if stored is not None:
            known = stored.drop(EPOCH).join(rows.select(AGENT).distinct(), AGENT, "left_semi")
            both = G.insert_if_absent(rows, known, [AGENT, TS]).withColumn("_old", F.lit(False)).unionByName(known.withColumn("_old", F.lit(True)))
        changed = G.append_on_change(both, AGENT, TS, X.TRACKED).where("not _old").drop("_old")
        self.store.write(changed, "inventory_history", epoch)

    # --- reading

    def table(self, name: str) -> DataFrame | None:
        """Committed rows of a table; None before the first batch. ``inventory`` is the newest row per agent, with a placeholder
        for agents of which only samples came."""
        rows = self.store.read(name)
        if rows is None:
            return None
        if name == "inventory":
            current = latest_one(rows, [AGENT], [F.desc(TS), F.desc(EPOCH)]).drop(EPOCH)
            return G.register_placeholders(self.store.read("seen").select(AGENT, TS), current, AGENT)
        return rows.drop(EPOCH, DAY)

    def compact(self) -> None:
        """Folds the batches of each table: the newest row per agent, the last time an agent was seen, and the samples by day."""
        self.store.compact("inventory", lambda r: latest_one(r, [AGENT], [F.desc(TS), F.desc(EPOCH)]))
        self.store.compact("seen", lambda r: r.groupBy(AGENT).agg(F.max(TS).alias(TS)))
        for table in G.PARSERS:
            self.store.compact(table, lambda r: r, by=DAY)
        for table in ("inventory_history", "quarantine", *LOGS):
            self.store.compact(table, lambda r: r)
