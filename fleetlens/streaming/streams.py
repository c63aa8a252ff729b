"""Structured Streaming forms of the rollups, duplicate filter, bursts, liveness and upserts.

Streams come from any source with ``readStream`` (files, Kafka); sinks are Parquet folders written by ``foreachBatch``
below a shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from fleetlens.functions import thresholds as T
from fleetlens.functions.exprs import col, elapsed_seconds, time_bucket
from fleetlens.operators.kernels import latest_one, with_previous
from fleetlens.operators.partials import merge_partials, partial_rollup, rolled
from fleetlens.session import ensure_checkpoint_dir
from fleetlens.streaming.epochs import EpochStore, run_with_state


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark)}/fleetlens/{name}-{uuid.uuid4().hex}"


def _with_epoch(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("epoch", IntegerType())])


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is available now into a Parquet folder and return it with the batch number ``epoch``."""
    spark = stream.sparkSession
    root = work_folder(spark, name)
    schema = stream.schema

    def write(batch: DataFrame, epoch: int) -> None:
        # a retried batch replaces its own folder, so every row is stored once
        batch.write.mode("overwrite").parquet(f"{root}/data/epoch={epoch}")

    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).foreachBatch(write).start())
    q.awaitTermination()
    return spark.read.schema(_with_epoch(schema)).parquet(f"{root}/data")


def newest_epoch(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Latest version of every updated group."""
    return latest_one(table, keys, [F.desc("epoch")]).drop("epoch")


# --- rollups ------------------------------------------------------------------------------------------------------

class RollupStream:
    """Tumbling rollup of a stream whose state is a table of mergeable partial rows, whatever the number of samples.

    Each micro-batch adds one partial row for each series and bucket it touches, so samples of any age count and nothing
    waits for a watermark. Buckets whose partials overlap in time, because samples came out of order, are rolled again
    from the stored samples; ``compact`` folds the batches, and keeps the partials of those buckets apart.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], ts: str, counters: Sequence[str], gauges: Sequence[str], width: int | str):
        self.root, self.keys, self.ts, self.counters, self.gauges, self.width = root, list(keys), ts, list(counters), list(gauges), width
        self.store = EpochStore(spark, f"{root}/tables")

    def batch(self, samples: DataFrame, epoch: int) -> None:
        if epoch <= self.store.committed():
            return
        self.store.write(partial_rollup(samples, self.keys, self.ts, self.counters, self.gauges, self.width), "partials", epoch)
        self.store.commit(epoch)

    def run(self, stream: DataFrame) -> RollupStream:
        """Takes in what is available now."""
        q = stream.writeStream.option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).foreachBatch(self.batch).start()
        q.awaitTermination()
        return self

    def compact(self) -> int:
        def fold(partials: DataFrame) -> DataFrame:
            at = [*self.keys, "bucket"]
            merged = merge_partials(partials, self.keys, self.counters, self.gauges)
            apart = _same_key_join(partials, merged.where("overlaps").select(*at), at)
            return merged.where("not overlaps").drop("overlaps").unionByName(apart.drop("epoch"))

        return self.store.compact("partials", fold)

    def table(self, samples: DataFrame, width: int | str | None = None) -> DataFrame:
        """The buckets (of a multiple of the width, if given); ``samples`` are all stored samples, of which only those of
        overlapping buckets are used: the join carries the keys and times of these buckets only."""
        partials = self.store.read("partials")
        if partials is None:
            partials = partial_rollup(samples.limit(0), self.keys, self.ts, self.counters, self.gauges, self.width)
        merged = merge_partials(partials, self.keys, self.counters, self.gauges, width)
        wide = self.width if width is None else width
        at = [*self.keys, "bucket"]
        again = _same_key_join(samples.withColumn("bucket", time_bucket(self.ts, wide)), merged.where("overlaps").select(*at), at)
        redone = partial_rollup(again.drop("bucket"), self.keys, self.ts, self.counters, self.gauges, wide)
        whole = merged.where("not overlaps").drop("overlaps").unionByName(redone)
        return rolled(whole, self.keys, self.counters, self.gauges)


def _same_key_join(rows: DataFrame, wanted: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in ``wanted``; a NULL key equals a NULL key."""
    right = wanted.select(*[F.col(c).alias(f"_w_{c}") for c in on])
    return rows.join(right, [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in on], "left_semi")


# --- filters and alerts -------------------------------------------------------------------------------------------

def stream_dedupe(stream: DataFrame, key: str = "message_id", ts: str = "collected_at", horizon: str = "24 hours") -> DataFrame:
    return stream.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([key])


def stream_recent(stream: DataFrame, anchor: Column, ts: str = "collected_at", late: str = "16 days") -> DataFrame:
    """Late rows are taken within the watermark; rows from a clock running ahead are left out."""
    return stream.withWatermark(ts, late).filter(F.col(ts) <= F.timestamp_micros(
        F.unix_micros(anchor) + F.lit(T.FUTURE_SKEW_SECONDS * 1_000_000)))


def _reach(micros: Column) -> Column:
    """Interval of a session window; sessions that touch are one, so it ends a microsecond before the gap."""
    return F.make_interval(secs=((micros - 1) / F.lit(1_000_000)).cast("decimal(18,6)"))


def restart_bursts(restarts: DataFrame, key: str, ts: str, gap_seconds: int = 3600, limit: int = T.FREQUENT_RESTARTS) -> DataFrame:
    """Sessions of a table's events less than ``gap_seconds`` apart with at least ``limit`` events."""
    s = restarts.groupBy(key, F.session_window(ts, _reach(F.lit(gap_seconds * 1_000_000))).alias("_w")).agg(F.count("*").alias("events"))
    return s.filter(F.col("events") >= limit).select(key, F.col("_w.start").alias("first_at"), "events")


def burst_alerts(stream: DataFrame, key: str, ts: str, gap_seconds: int = 3600, limit: int = T.FREQUENT_RESTARTS, keep_seconds: int = 0) -> DataFrame:
    """One alert for each burst, in the batch in which it reaches ``limit`` events: key, first_at, events so far.

    The state is one row per burst that may go on: first and last event, number, and whether it was alerted. A batch's events
    are merged with the open bursts as sessions, an open burst being one event whose gap reaches past its last; every
    event renews it, and it expires when the newest event of the stream is ``gap`` (and ``keep_seconds``, for late events)
    ahead of its last. Rows without key or time are left out. Sessions are merged before the shuffle, so a hot key moves its sessions only.
    """
    gap = gap_seconds * 1_000_000

    def step(batch: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        new = batch.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
            key, F.col(ts).alias("at"), F.col(ts).alias("last_at"), F.lit(1).cast("long").alias("events"), F.lit(False).alias("alerted"))
        rows = new if state is None else new.unionByName(state.select(key, F.col("first_at").alias("at"), "last_at", "events", "alerted"))
        reach = F.unix_micros("last_at") - F.unix_micros("at") + gap
        bursts = rows.groupBy(key, F.session_window("at", _reach(reach)).alias("_w")).agg(
            F.max("last_at").alias("last_at"), F.sum("events").alias("events"), F.max("alerted").alias("alerted"))
        bursts = bursts.select(key, F.col("_w.start").alias("first_at"), "last_at", "events", "alerted").withColumn("due", F.col("events") >= limit).persist()
        newest = bursts.agg(F.max("last_at")).first()[0]
        alive = F.lit(False) if newest is None else F.unix_micros("last_at") + gap + keep_seconds * 1_000_000 > F.unix_micros(F.lit(newest))
        alerts = bursts.where("due and not alerted").select(key, "first_at", "events")
        return alerts, bursts.where(alive).select(key, "first_at", "last_at", "events", (F.col("alerted") | F.col("due")).alias("alerted"))

    out = run_with_state(stream, work_folder(stream.sparkSession, "bursts"), step)
    return _or_empty(out, stream, f"{key} {dict(stream.dtypes)[key]}, first_at timestamp, events long")


def _or_empty(out: DataFrame | None, stream: DataFrame, schema: str) -> DataFrame:
    return stream.sparkSession.createDataFrame([], schema) if out is None else out.drop("epoch")


def clock_alerts(messages: DataFrame, key: str = "agent_id", ts: str = "collected_at", quiet: str = "1 hour") -> DataFrame:
    """Messages that break boot <= agent start <= collected, at most one per host within the quiet time; messages without
    an agent start are skipped."""
    bad = messages.filter((F.col("boot_time") > F.col("agent_started_at")) | (F.col("agent_started_at") > F.col(ts)))
    return bad.withWatermark(ts, quiet).dropDuplicatesWithinWatermark([key]) if messages.isStreaming else bad


# --- state per host -----------------------------------------------------------------------------------------------

KEEP_START_SECONDS = 24 * 3600


def agent_start_changes(stream: DataFrame, key: str, ts: str, start: str) -> DataFrame:
    """Agent start times that differ from the last one of the host seen within 24 hours: host, changed_at, agent_started_at.

    The state is the last sample of each host, gone 24 hours after it by the newest time of the stream. Inside a batch every
    sample is compared with the one before by the chunked kernel, so the samples of a busy host are spread over tasks.
    Samples without start are skipped; of samples of one host and time the latest start counts. A late sample is
    compared with the last one before it that is known.
    """
    def step(batch: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        new = batch.select(col(key).alias("host"), col(ts).alias("ts"), col(start).alias("start")).where("host is not null and ts is not null and start is not null")
        new = new.groupBy("host", "ts").agg(F.max("start").alias("start")).withColumn("new", F.lit(True))
        rows = (new if state is None else new.unionByName(state.select("host", "ts", "start", F.lit(False).alias("new")))).persist()
        seen = with_previous(rows, ["host"], "ts", ["ts", "start"]).where("new and start <> prev_start")
        hits = seen.where(elapsed_seconds(F.col("ts"), F.col("prev_ts")) <= KEEP_START_SECONDS)
        newest = rows.agg(F.max("ts")).first()[0]
        last = rows.groupBy("host").agg(F.max(F.struct("ts", "start")).alias("s")).select("host", "s.ts", "s.start")
        alive = F.lit(False) if newest is None else elapsed_seconds(F.lit(newest), F.col("ts")) <= KEEP_START_SECONDS
        return hits.select("host", F.col("ts").alias("changed_at"), F.col("start").alias("agent_started_at")), last.where(alive)

    out = run_with_state(stream, work_folder(stream.sparkSession, "starts"), step)
    return _or_empty(out, stream, f"host {dict(stream.dtypes)[key]}, changed_at timestamp, agent_started_at timestamp")


def online_state(stream: DataFrame, key: str, ts: str, anchor: Column, ttl: int = T.ONLINE_SECONDS) -> DataFrame:
    """Last sample per host as a running aggregate (update mode); a host is online within the time to live."""
    last = stream.groupBy(key).agg(F.max(ts).alias("last_at"))
    return last.withColumn("online", F.col("last_at") > F.timestamp_micros(F.unix_micros(anchor) - F.lit(ttl * 1_000_000)))


# --- upserts ------------------------------------------------------------------------------------------------------

def upsert_stream(stream: DataFrame, key: str, ts: str, name: str = "inventory") -> DataFrame:
    """Keep the newest row per key over all batches: each batch writes its newest rows, reading merges them."""
    spark = stream.sparkSession
    root = work_folder(spark, name)
    schema = stream.schema

    def write(batch: DataFrame, epoch: int) -> None:
        latest_one(batch, [key], [F.desc(ts)]).write.mode("overwrite").parquet(f"{root}/data/epoch={epoch}")

    q = (stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start())
    q.awaitTermination()
    stored = spark.read.schema(_with_epoch(schema)).parquet(f"{root}/data")
    return latest_one(stored, [key], [F.desc(ts), F.desc("epoch")]).drop("epoch")
