"""Helpers shared by the operators: tables in the shared folder, joins with hot keys, connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Rows of two or three numbers each that may be broadcast: some tens of MB, counted before the broadcast.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only for a local master without it."""
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables of one run below the shared folder.

    ``keep`` writes a table and reads it back: that cuts the lineage, survives lost executors, and gives the optimizer
    the table's real size. ``drop`` deletes tables that no later plan reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self._paths.pop(id(t), None)
            if path:
                self.delete(path)

    def tidy(self) -> None:
        """Lets Spark's cleaner remove the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()

    def delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def hot_join(left: DataFrame, right: DataFrame, on: Iterable[str], how: str = "left") -> DataFrame:
    """Equi-join in which one key may hold a large share of ``left``.

    A side that was grouped by the key already would be joined as it lies, and adaptive execution cannot split what it
    has not shuffled for the join. The extra key is a function of the others: it changes no match, but both sides are
    dealt out for the join, so that large partitions of ``left`` are split (or a small ``right`` is broadcast). It is one
    bit, which costs next to nothing in the shuffle.
    """
    on = list(on)
    j = F.pmod(F.xxhash64(*[F.col(c) for c in on]), F.lit(2)).cast("tinyint")
    return left.withColumn("_j", j).join(right.withColumn("_j", j), [*on, "_j"], how).drop("_j")


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a kept table of numbers) with a broadcast hint, if counting shows at most ``rows`` rows; else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def components(tmp: Scratch, links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``links(a, b)``: label is the smallest id that the node can reach.

    Each round hangs every node below its smallest neighbour, follows these parents to their ends by doubling, and
    replaces the ends of all links; links within one label vanish. A round removes at least half of the nodes that
    still have links. Only grouped minima and joins; nothing is collected but emptiness.
    """
    two = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = tmp.keep(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    labels: DataFrame | None = None
    while True:
        parent = tmp.keep(two(edges).groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "parents")
        while True:
            up = parent.select(F.col("node").alias("label"), F.col("label").alias("top"))
            nxt = tmp.keep(hot_join(parent, up, ["label"]).select("node", F.coalesce("top", "label").alias("label"), (F.col("top") < F.col("label")).alias("moved")), "parents")
            tmp.drop(parent)
            parent = nxt
            if parent.where("moved").isEmpty():
                break
        parent = parent.select("node", "label")
        if labels is None:
            labels = parent
        else:
            labels = tmp.keep(hot_join(labels, parent.select(F.col("node").alias("label"), F.col("label").alias("top")), ["label"]).select("node", F.coalesce("top", "label").alias("label")), "labels")
        ends = hot_join(edges.select(F.col("a").alias("node"), "b"), parent, ["node"], "inner").select(F.col("label").alias("a"), F.col("b").alias("node"))
        ends = hot_join(ends, parent, ["node"], "inner").select("a", F.col("label").alias("b")).where("a <> b")
        nxt = tmp.keep(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        tmp.drop(edges)
        edges = nxt
        if edges.isEmpty():
            tmp.drop(edges)
            return labels


def give_back() -> None:
    """Returns what Arrow and the C library hold but no longer use to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a function for mapInArrow, after which the worker keeps no unused memory.

    A worker waits for further tasks beside the executor's JVM, through later stages too; what it holds counts against
    the executor's memory all that time.
    """

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def slices(b: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``most`` bytes in ``column``, or one row."""
    size = np.cumsum(pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield b.slice(at, end - at)
        at = end


def split_words(texts: pa.Array, fold: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of a column of UTF-8 texts as one binary column, and the number of words of every text.

    ``fold`` maps each byte to that of the word, or to 0 between words.
    """
    texts = pa.concat_arrays([texts.cast(pa.large_binary())])  # offsets from 0
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = fold[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]]
    at = at - at[0]
    inside = raw != 0
    before = np.empty(len(raw), bool)
    before[:1], before[1:] = False, inside[:-1]
    before[at[:-1][at[:-1] < len(raw)]] = False  # texts follow each other without a gap
    start = np.flatnonzero(inside & ~before)
    number = np.diff(np.searchsorted(start, at)).astype(np.int64)
    data = raw[inside]
    ends = np.cumsum(inside, dtype=np.int64)[start - 1] if len(start) else np.empty(0, np.int64)
    ends[: int(len(start) > 0 and start[0] == 0)] = 0
    offsets = np.append(ends, len(data)).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    return found.cast(pa.binary()) if len(data) < 1 << 31 else found, number
