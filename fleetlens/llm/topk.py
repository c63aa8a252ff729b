"""Exact top-k by integer inner product over an impact-ordered index, score at a time.

Index: the vectors lie in shards of bounded size. In a shard every dimension has a posting list in the order of its
quantised components; vectors with equal quantised component form a segment. Search: the impact of a segment is the
query's component times the quantised one, without its sign. Segments are processed by classes of descending impact,
in every dimension a class is one run from either end of the list. Accumulators hold the sum and the number of what is
processed. What is not processed lies below the class's limit in each dimension, so the rest of every score is bounded. The best accumulators are scored exactly, and processing stops once the bound proves that only a small share of
the vectors can reach the k-th of these scores, at the latest when all segments are done. These possible members are
scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.common import Scratch
from fleetlens.llm.vectors import best, integer_vectors, matrix, shards, visit

LEVELS = 1024  # quantised components of a dimension, at most; the intervals are as narrow as that allows
FIRST, STEP = 1 / 24, 0.7  # least impact of the first class, as a share of the highest, and of each class against the one before
CLASSES = 12  # after which all the rest is processed
RESCORED = 64  # one in so many vectors may be left as possible members when processing stops


class Index:
    """The posting lists of one shard."""

    def __init__(self, ids: np.ndarray, m: np.ndarray):
        self.ids, self.m = ids, m
        self.width = 1
        while m.size and int(m.max() // self.width) - int(m.min() // self.width) >= LEVELS:
            self.width *= 2
        level = m // self.width
        self.least = int(level.min()) if m.size else 0
        top = int(level.max()) if m.size else 0
        n, dim = m.shape
        order = np.argsort(level, axis=0, kind="stable").T
        self.postings = np.ascontiguousarray(order)
        self.levels = np.ascontiguousarray(np.take_along_axis(level.T, order, axis=1), np.float64)
        # first posting of every level and beyond the last one, per dimension
        bins = np.arange(self.least, top + 2)
        self.first = np.stack([np.searchsorted(row, bins) for row in self.levels]) if dim else np.zeros((0, len(bins)), np.int64)
        self.top = top

    def search(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, dict]:
        """Ids and scores of the best ``k`` vectors without those of id ``own``, ties to smaller ids, and what it took."""
        n, dim = self.m.shape
        q = np.pad(q, (0, max(0, dim - len(q))))[:dim]
        others = self.ids != own
        free = int(others.sum())
        if not free:
            return np.empty(0, np.int64), np.empty(0, np.int64), {"rescored": 0, "postings": 0}
        k = min(k, free)
        w = self.width
        size = np.abs(q).astype(np.float64)
        edge = max(abs(self.least), abs(self.top)) * w  # largest quantised component
        limit = float(size.max() * edge) if dim else 0.0
        unit = dim + 1  # an accumulator holds its sum times this, plus the number of its postings
        acc = np.zeros(n)
        slack = float(size.sum()) * (w - 1)  # the processed part of a score lies in its sum plus or minus this
        dims = np.arange(dim)
        low, high = np.zeros(dim, np.int64), np.full(dim, n)  # postings outside [low, high) are processed
        done = 0
        maybe = np.flatnonzero(others)
        for c in range(CLASSES + 1):
            if c < CLASSES:
                limit = limit * (STEP if c else FIRST)
                with np.errstate(divide="ignore", invalid="ignore"):
                    keep = np.where(size > 0, np.floor(limit / size / w), np.inf)  # levels from -keep to keep stay
                a = self.first[dims, np.clip(-keep, self.least, self.top + 1).astype(np.int64) - self.least]
                b = self.first[dims, np.clip(keep + 1, self.least, self.top + 1).astype(np.int64) - self.least]
                a = np.maximum(a, low)
                b = np.maximum(a, np.minimum(b, high))
            else:
                a = b = high.copy()
            cuts = [(d, low[d], a[d]) for d in np.flatnonzero(a > low)] + [(d, b[d], high[d]) for d in np.flatnonzero(b < high)]
            if cuts:
                gains = np.concatenate([self.levels[d, s:e] * f for (d, s, e), f in zip(cuts, (q[[d for d, _, _ in cuts]] * float(w * unit)).tolist(), strict=True)])
                gains += 1
                acc += np.bincount(np.concatenate([self.postings[d, s:e] for d, s, e in cuts]), gains, minlength=n)
                done += len(gains)
            low, high = a, b
            sums = np.floor(acc / unit)
            # what is left of a vector lies below the limit in each of its dimensions, and below one interval more
            rest = (dim - (acc - sums * unit)) * (limit if c < CLASSES else 0.0) + slack
            lead = np.argpartition(np.where(others, sums, -np.inf), -min(4 * k, free))[-min(4 * k, free) :]
            kth = np.sort(self.m[lead] @ q)[-k]
            maybe = np.flatnonzero(others & (sums + rest >= kth))
            if len(maybe) <= max(4 * k, n // RESCORED):
                break  # proof: nobody else reaches the k-th exact score found so far
        score = self.m[maybe] @ q
        at = best(score, self.ids[maybe], k)
        return self.ids[maybe][at], score[at], {"rescored": len(maybe), "postings": done}


def _build(t: pa.Table) -> dict[str, pa.Array]:
    m = matrix(t.column("v").chunk(0))
    kind = next((k for k in (np.int16, np.int32) if m.size and np.iinfo(k).min <= m.min() and m.max() <= np.iinfo(k).max), np.int64)
    raw = lambda x: pa.array([x.tobytes()], pa.binary())
    return {"ids": raw(t.column("vec_id").to_numpy()), "matrix": raw(m.astype(kind)), "bytes": pa.array([np.dtype(kind).itemsize], pa.int32()), "dim": pa.array([m.shape[1]], pa.int32())}


def _search(k: int):
    held: dict[int, Index] = {}  # the shard at hand

    def run(shard: dict, asked: pa.Table) -> pa.RecordBatch:
        if shard["shard"] not in held:
            held.clear()
            ids = np.frombuffer(shard["ids"], np.int64)
            m = np.frombuffer(shard["matrix"], f"i{shard['bytes']}").reshape(len(ids), shard["dim"]).astype(np.int64)
            held[shard["shard"]] = Index(ids, m)
        index = held[shard["shard"]]
        out: list[list] = [[], [], []]
        for own, v in zip(asked.column("query_id").to_pylist(), asked.column("v").to_pylist(), strict=True):
            found, scores, _ = index.search(np.asarray(v, np.int64), own, k)
            out[0] += [own] * len(found)
            out[1] += found.tolist()
            out[2] += scores.tolist()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, tmp: Scratch | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows of ``vectors`` for each row of ``queries``.

    Both have (vec_id, embedding, ...). A query never finds rows of its own vec_id. Vectors that are null or hold null or
    non-finite components take no part, nor rows without an id; a shorter vector counts as padded with zeros; empty
    vectors score 0. Equal scores go to the smaller vec_id. Rows that repeat a vec_id are candidates each; of repeated
    queries the one with the smallest vector counts. Scores times dimensions must stay below 2 ** 53. Empty gives empty.
    """
    tmp = tmp or Scratch(vectors.sparkSession)
    built, n = shards(tmp, integer_vectors(vectors), _build, "ids binary, matrix binary, bytes int, dim int")
    asked = integer_vectors(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    found = visit(built, n, asked, _search(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with s as (select vec_id, [floor(256 * cast(x as double)) for x in embedding] as v from embeddings
  where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
p as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score from s q, s c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""
