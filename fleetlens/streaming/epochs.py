"""Tables that grow by micro-batches and count a batch once, however often it is tried.

Every batch (epoch) writes a folder of its own in each table and is committed by one marker file at the end. Readers see
committed epochs only; a batch that is tried again replaces its own folders, and does nothing once it is committed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "epoch"
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)


class EpochStore:
    """Tables below ``root``: ``<table>/epoch=N`` holds the rows of one batch, ``_commits/N`` says that batch N is whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _names(self, path: str) -> list[str]:
        fs, where = self._path(path)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def committed(self) -> int:
        """The last committed epoch, -1 before the first."""
        return max((int(n) for n in self._names("_commits") if n.isdigit()), default=-1)

    def commit(self, epoch: int) -> None:
        fs, where = self._path(f"_commits/{epoch}")
        fs.create(where, True).close()

    def write(self, rows: DataFrame, table: str, epoch: int, by: str | None = None) -> None:
        """The rows of one batch; ``by`` lays them out by a column, rebalanced so that a day is neither many files nor one slow writer."""
        if by:
            rows = rows.hint("rebalance", by)
        w = rows.write.mode("overwrite")
        (w.partitionBy(by) if by else w).parquet(f"{self.root}/{table}/{EPOCH}={epoch}")

    def epochs(self, table: str) -> tuple[int, list[int]]:
        """The newest compacted state (-1: none) and the committed epochs after it."""
        last = self.committed()
        base = max((int(n.split("=")[1]) for n in self._names(f"{table}.base") if f"{n}.done" in self._names(f"{table}.base") and n.startswith("upto=")), default=-1)
        return base, sorted(e for e in (int(n.split("=")[1]) for n in self._names(table) if n.startswith(f"{EPOCH}=")) if base < e <= last)

    def read(self, table: str, only: int | None = None) -> DataFrame | None:
        """Rows of the committed epochs with their ``epoch`` (the compacted ones with the last they stand for), or of one epoch; None without any."""
        base, epochs = self.epochs(table)
        parts = [self.spark.read.parquet(f"{self.root}/{table}.base/upto={base}").withColumn(EPOCH, F.lit(base))] if base >= 0 and only is None else []
        chosen = epochs if only is None else [e for e in epochs if e == only]
        if chosen:
            parts.append(self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{table}/{EPOCH}={e}" for e in chosen]))
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)

    def compact(self, table: str, fold: Callable[[DataFrame], DataFrame], by: str | None = None) -> int:
        """Folds the committed epochs of a table into one folder; the epochs that the folder before stood for are deleted, so that
        running readers keep theirs. The epoch up to which the table is folded."""
        rows, last = self.read(table), self.committed()
        old, epochs = self.epochs(table)
        if rows is None or not epochs:
            return old
        folded = fold(rows)
        folded = folded.drop(EPOCH) if EPOCH in folded.columns else folded
        w = (folded.hint("rebalance", by) if by else folded).write.mode("overwrite")
        (w.partitionBy(by) if by else w).parquet(f"{self.root}/{table}.base/upto={last}")
        fs, done = self._path(f"{table}.base/upto={last}.done")
        fs.create(done, True).close()
        for n in self._names(table):
            if n.startswith(f"{EPOCH}=") and int(n.split("=")[1]) <= old:
                self.forget(f"{table}/{n}")
        for n in self._names(f"{table}.base"):
            if n.startswith("upto=") and not n.endswith(".done") and int(n.split("=")[1]) < old:
                self.forget(f"{table}.base/{n}.done")
                self.forget(f"{table}.base/{n}")
        return last

    def forget(self, path: str) -> None:
        """Deletes a folder of this store that no committed state needs any more."""
        fs, where = self._path(path)
        fs.delete(where, True)


def run_with_state(stream: DataFrame, root: str, step: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]], out: str = "out") -> DataFrame | None:
    """Runs what is available through ``step(batch, state) -> (rows out, new state)`` and returns the rows of all batches.

    The state is a table as well: each batch reads that of the committed epoch before and writes its own, so a batch that
    is tried again starts from the same state. Steps drop what has expired; older states are deleted.
    """
    store = EpochStore(stream.sparkSession, f"{root}/tables")

    def batch(rows: DataFrame, epoch: int) -> None:
        last = store.committed()
        if epoch <= last:
            return
        rows = rows.persist()
        result, state = step(rows, store.read("state", only=last))
        store.write(result, out, epoch)
        store.write(state, "state", epoch)
        store.commit(epoch)
        rows.unpersist()
        if last >= 1:
            store.forget(f"state/{EPOCH}={last - 1}")

    q = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(batch).start()
    q.awaitTermination()
    return store.read(out)
