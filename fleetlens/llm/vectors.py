"""Integer vectors in shards of bounded size, and queries that visit every shard."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import Scratch

SHARD = 8192  # vectors
BLOCK = 256  # queries that are scored at once
SCALE = 256


def integer_vectors(vectors: DataFrame, *cols: Column) -> DataFrame:
    """``(vec_id, v, ...)``: components as floor(256 * x); without null ids and vectors, and those with null or non-finite components."""
    x = F.col("embedding").cast("array<double>")
    sound = F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(c * SCALE).cast("long"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, v).alias("v"), *cols).where("v is not null and vec_id is not null")


def matrix(col: pa.Array) -> np.ndarray:
    """Lists of integers as rows; shorter ones are padded with zeros."""
    at = col.offsets.to_numpy()
    flat = col.values.to_numpy()
    size = np.diff(at)
    dim = int(size.max()) if len(size) else 0
    if len(size) and (size == dim).all():
        return flat[at[0] : at[-1]].reshape(len(size), dim).astype(np.int64)
    out = np.zeros((len(size), dim), np.int64)
    inside = np.arange(dim) < size[:, None]
    out[inside] = flat[at[0] : at[-1]]
    return out


def products(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices: by doubles where these hold every sum exactly."""
    dim = max(m.shape[1], q.shape[1])
    m, q = (np.pad(a, ((0, 0), (0, dim - a.shape[1]))) for a in (m, q))
    top = lambda a: int(np.abs(a).max()) if a.size else 0
    if top(m) * top(q) * max(1, dim) < 1 << 53:
        return m.astype(np.float64) @ q.astype(np.float64).T
    return m @ q.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, equal ones by smaller id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def shards(tmp: Scratch, vectors: DataFrame, build: Callable[[pa.Table], dict[str, pa.Array]], schema: str) -> tuple[DataFrame, int]:
    """One row per shard of at most about SHARD vectors, with what ``build`` makes of it, and the number of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = [b for b in batches if b.num_rows]
        if parts:
            cols = build(pa.Table.from_batches(parts).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *cols.values()], names=["shard", *cols])

    n = max(1, -(-vectors.count() // SHARD))
    return tmp.keep(vectors.repartition(n).mapInArrow(run, f"shard int, {schema}"), "shards"), n


def visit(built: DataFrame, n: int, asked: DataFrame, run: Callable[[dict, pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """Every row of ``asked`` meets every shard: the stated query set against all rows, in blocks of BLOCK.

    A shard is sent once, and the queries stream past it: a task holds one shard and one block. ``run`` gets the
    shard's columns and a table of queries.
    """
    names = [c for c in asked.columns]
    each = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("is_query", F.lit(True))
    both = built.withColumn("is_query", F.lit(False)).unionByName(each, allowMissingColumns=True)
    both = both.repartition(n, "shard").sortWithinPartitions("shard", "is_query")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict = {}
        for b in batches:
            kind, shard = b.column("is_query").to_pylist(), b.column("shard").to_pylist()
            at = 0
            while at < b.num_rows:
                if not kind[at]:
                    now = {c: b.column(c)[at].as_py() for c in b.schema.names if c not in names}
                    at += 1
                    continue
                end = at
                while end < b.num_rows and end < at + BLOCK and kind[end] and shard[end] == shard[at]:
                    end += 1
                if now.get("shard") == shard[at]:
                    yield run(now, pa.Table.from_batches([b.slice(at, end - at)]).select(names).combine_chunks())
                at = end

    return both.mapInArrow(stream, schema)
