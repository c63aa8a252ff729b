"""Hard negatives by slots: the positives' upper limits split the scores below them into disjoint slots.

An anchor's positives are its best rows of the same label. A positive of score p asks for rows of other labels from
p / 2 up to 0.95 p. These windows overlap, but their upper limits, in descending order, cut the scores into disjoint
slots: slot j reaches from limit j down to above limit j + 1. The best ``k`` of every slot are enough: every shard keeps the best ``k`` per slot
(a combiner), grouped ranking merges the shards, and for the window under limit j the slots j, j + 1, ... are merged
in descending order until ``k`` are found; those below the window's lower limit go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.common import Scratch
from fleetlens.llm.vectors import best, integer_vectors, matrix, products, shards, visit

UPPER, LOWER = 95, 50  # of 100 parts of the positive's score


def _build(t: pa.Table) -> dict[str, pa.Array]:
    m = matrix(t.column("v").chunk(0))
    raw = lambda x: pa.array([np.ascontiguousarray(x, np.int64).tobytes()], pa.binary())
    return {"ids": raw(t.column("vec_id").to_numpy()), "labels": raw(t.column("label").to_numpy()), "matrix": raw(m), "dim": pa.array([m.shape[1]], pa.int32())}


def _scores(shard: dict, asked: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.frombuffer(shard[c], np.int64) for c in ("ids", "labels"))
    m = np.frombuffer(shard["matrix"], np.int64).reshape(len(ids), shard["dim"])
    return ids, labels, products(m, matrix(asked.column("v").chunk(0))).T


def _positives(k: int):
    def run(shard: dict, asked: pa.Table) -> pa.RecordBatch:
        ids, labels, scores = _scores(shard, asked)
        out: list[list] = [[], [], []]
        for own, label, s in zip(asked.column("anchor_id").to_pylist(), asked.column("label").to_pylist(), scores, strict=True):
            same = np.flatnonzero((labels == label) & (ids != own))
            at = same[best(s[same], ids[same], k)]
            out[0] += [own] * len(at)
            out[1] += ids[at].tolist()
            out[2] += s[at].astype(np.int64).tolist()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["anchor_id", "vec_id", "score"])

    return run


def _slots(k: int):
    """The best ``k`` rows of every slot of every anchor; ``limits`` descend."""

    def run(shard: dict, asked: pa.Table) -> pa.RecordBatch:
        ids, labels, scores = _scores(shard, asked)
        out: list[list] = [[], [], [], []]
        for own, label, limits, s in zip(*(asked.column(c).to_pylist() for c in ("anchor_id", "label", "limits")), scores, strict=True):
            other = np.flatnonzero((labels != label) & (ids != own) & (s <= limits[0]))
            slot = np.searchsorted(-np.array(limits), -s[other], side="right") - 1  # the last limit that is not below the score
            for j in range(len(limits)):
                mine = other[slot == j]
                at = mine[best(s[mine], ids[mine], k)]
                out[0] += [own] * len(at)
                out[1] += [j] * len(at)
                out[2] += ids[at].tolist()
                out[3] += s[at].astype(np.int64).tolist()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["anchor_id", "slot", "vec_id", "score"])

    return run


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, k: int = 3, tmp: Scratch | None = None) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Both tables have (vec_id, embedding, label, ...). For every anchor and each of its ``positives`` best other rows of the same label, the first ``k`` rows of other
    labels whose score s satisfies 50 p <= 100 s <= 95 p. Components count as floor(256 x); higher scores come first, ties
    by smaller vec_id. Rows without id or label, and vectors that are null or hold null or non-finite components, take no
    part; shorter vectors are padded with zeros. An anchor never finds rows of its own vec_id; of anchors that repeat an
    id, the one with the smallest vector and label counts; other rows that repeat an id count each. Negative positive
    scores have no window. Extra columns are ignored; empty gives empty. Scores must stay below 2 ** 53.
    """
    tmp = tmp or Scratch(vectors.sparkSession)
    label = F.col("label").cast("long").alias("label")
    sound = integer_vectors(vectors, label).where("label is not null")
    built, n = shards(tmp, sound, _build, "ids binary, labels binary, matrix binary, dim int")
    asked = integer_vectors(anchors, label).where("label is not null").groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("v", "label")).alias("a"))
    asked = tmp.keep(asked.select("anchor_id", "a.v", "a.label"), "anchors")
    found = visit(built, n, asked, _positives(positives), "anchor_id long, vec_id long, score long")
    best_of = tmp.keep(_first(found, ["anchor_id"], positives).where("score >= 0").withColumn("upper", F.expr(f"score * {UPPER} div 100")), "positives")
    limits = best_of.groupBy("anchor_id").agg(F.sort_array(F.collect_set("upper"), asc=False).alias("limits"), F.collect_list(F.struct(F.col("vec_id").alias("id"), "score", "upper")).alias("positives"))
    limits = tmp.keep(limits, "limits")
    found = visit(built, n, asked.join(limits.select("anchor_id", "limits"), "anchor_id"), _slots(k), "anchor_id long, slot long, vec_id long, score long")
    # at most ``k`` rows a slot and ``positives`` slots an anchor from here on
    slots = _first(found, ["anchor_id", "slot"], k).groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("slot", "rank", "vec_id", "score"))).alias("slots"))
    each = limits.join(slots, "anchor_id").select("anchor_id", "slots", "limits", F.explode("positives").alias("p"))
    # slots lie in descending order of score, so a window's best are the first entries from its own slot on
    own = F.array_position("limits", F.col("p.upper")) - 1
    suffix = F.slice(F.filter("slots", lambda s: s["slot"] >= own), 1, k)
    chosen = F.filter(suffix, lambda s: s["score"] * 100 >= F.col("p.score") * LOWER)
    out = each.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.posexplode(chosen).alias("at", "s"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("s.vec_id").alias("negative_id"), "positive_score", F.col("s.score").alias("negative_score"))


ORACLE = """
with s as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * cast(x as double)) for x in embedding] as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
d as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, cast(list_dot_product(a.v, c.v) as bigint) as score from s a, s c where a.vec_id % 50 = 0 and c.vec_id <> a.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from d where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
w as (select anchor_id, positive_id, positive_score, vec_id as negative_id, score as negative_score, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank
  from p join d using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from w where rank <= 3
"""
