"""Exact duplicates across immutable snapshots and an incoming batch.

The rows are dealt into snapshots. For each snapshot the distinct digests of its texts are cut into shards of bounded
size, and every shard gets a static binary-fuse filter: 16-bit fingerprints, 1.13 to 1.3 slots for a digest, never a
false negative. The digests of a later batch visit the filters of all earlier snapshots. What no filter knows is new and
costs no join. Positives join the exact buckets (the digests of those snapshots), and one text for each digest and
snapshot is compared byte by byte. Copies within a batch are grouped by digest and length on their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import Scratch, hot_join, sized, text_or_empty

SNAPSHOTS = 4  # in the order of their numbers; the last one is the incoming batch
SHARD_KEYS = 100_000  # expected digests in one filter shard
WHITE_SPACE = "[\\x20\\x09-\\x0D]+"
ARITY = 3
NO_ID = -(1 << 63)  # stands for a null doc_id where texts are fetched


# ---- binary-fuse filter: three slots in neighbouring segments, solved by peeling ---------------------------------
def _mix(z: np.ndarray, seed: int) -> np.ndarray:
    z = z + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    z = (z ^ (z >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return z ^ (z >> np.uint64(33))


def _layout(n: int) -> tuple[int, int]:
    """Length of a segment (a power of two) and number of slots for ``n`` keys."""
    segment = 1 << int(min(18, max(2, np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    count = max(1, -(-int(n * factor) // segment) - ARITY + 1)
    return segment, (count + ARITY - 1) * segment


def _slots(keys: np.ndarray, seed: int, segment: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    h = _mix(keys, seed)
    first = ((h >> np.uint64(32)) * np.uint64(slots - (ARITY - 1) * segment)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    a = first
    b = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    c = (first + np.uint64(2 * segment)) ^ (h & mask)
    # the xor stays inside the aligned segment of its slot
    return np.stack([a, b, c]).astype(np.int64), (_mix(h, 1) & np.uint64(0xFFFF)).astype(np.uint16)


def build_filter(keys: np.ndarray) -> tuple[int, int, bytes]:
    """``(seed, number of keys, fingerprints)`` of distinct 64-bit keys; seeds are tried until peeling succeeds."""
    keys = np.unique(keys)
    n = len(keys)
    segment, slots = _layout(n)
    table = np.zeros(slots, np.uint16)
    for seed in range(1, 200):
        at, prints = _slots(keys, seed, segment, slots)
        flat = at.ravel()
        degree = np.bincount(flat, minlength=slots)
        which = np.zeros(slots, np.int64)
        np.bitwise_xor.at(which, flat, np.tile(np.arange(n), ARITY))
        alive = np.ones(n, bool)
        layers: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            free = np.flatnonzero(degree == 1)
            if not len(free):
                break
            k, pos = np.unique(which[free], return_index=True)
            layers.append((k, free[pos]))
            alive[k] = False
            gone = at[:, k].ravel()
            np.subtract.at(degree, gone, 1)
            np.bitwise_xor.at(which, gone, np.tile(k, ARITY))
        if alive.any():
            continue
        for k, own in reversed(layers):
            v = prints[k] ^ table[at[0, k]] ^ table[at[1, k]] ^ table[at[2, k]] ^ table[own]
            table[own] = v
        return seed, n, table.tobytes()
    raise ValueError("no seed peels: keys are not distinct")


def in_filter(keys: np.ndarray, seed: int, n: int, prints: bytes) -> np.ndarray:
    """Whether each key may be in the filter: always true for keys it was built from, else with odds of 1 to 65,536."""
    segment, slots = _layout(n)
    at, want = _slots(keys, seed, segment, slots)
    t = np.frombuffer(prints, np.uint16)
    return (t[at[0]] ^ t[at[1]] ^ t[at[2]]) == want


def _filters(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    seed, n, prints = build_filter(rows.column("key").to_numpy().view(np.uint64))
    return pa.table({"snapshot": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int64()), "seed": pa.array([seed], pa.int32()),
                     "n": pa.array([n], pa.int64()), "prints": pa.array([prints], pa.binary())})


def _screen(key: tuple[pa.Scalar, ...], filters: pa.Table, digests: pa.Table) -> pa.Table:
    """Digests of one shard against the filters of all earlier snapshots in that shard."""
    batch = digests.column("snapshot").to_numpy()
    keys = digests.column("key").to_numpy().view(np.uint64)
    hits, of = [], []
    for snap, seed, n, prints in zip(*(filters.column(c).to_pylist() for c in ("snapshot", "seed", "n", "prints")), strict=True):
        rows = np.flatnonzero(batch > snap)
        rows = rows[in_filter(keys[rows], seed, n, prints)]
        hits.append(rows)
        of.append(np.full(len(rows), snap, np.int32))
    at = np.concatenate(hits) if hits else np.empty(0, np.int64)
    got = digests.select(["digest", "n_bytes", "snapshot"]).take(pa.array(at))
    return got.append_column("earlier", pa.array(np.concatenate(of) if of else np.empty(0, np.int32), pa.int32()))


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WHITE_SPACE, "")


def exact_duplicates(docs: DataFrame, snapshot: Column | None = None, tmp: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without the six ASCII white-space characters; null counts as empty, so null,
    empty and white-space texts form one group. Of a group the row with the most code points in its original text stays,
    then the smallest doc_id; null doc_ids come last. Rows that repeat a doc_id and length count in the group's size, and
    all of them carry ``kept`` if theirs is the id that stays. ``snapshot`` gives the snapshot's number, any whole
    one (null counts as 0); by default ids are dealt out evenly over SNAPSHOTS. Extra columns are ignored; empty gives empty.
    """
    spark = docs.sparkSession
    tmp = tmp or Scratch(spark)
    snap = F.pmod(F.xxhash64("doc_id"), F.lit(SNAPSHOTS)) if snapshot is None else snapshot
    text = text_or_empty()
    bare = normalised(text)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(snap.cast("int"), F.lit(0)).alias("snapshot"), F.char_length(text).cast("long").alias("cp"),
                       F.unhex(F.sha2(bare, 256)).alias("digest"), F.octet_length(bare).cast("long").alias("n_bytes"))
    base = tmp.keep(base, "digests")
    best = F.max(F.struct("cp", (-F.col("doc_id")).alias("minus_id"))).alias("best")
    groups = tmp.keep(base.groupBy("digest", "n_bytes", "snapshot").agg(F.count(F.lit(1)).alias("size"), best), "groups")

    # filters of the snapshots, one for each shard of digests
    k, first_snap, last_snap = groups.agg(F.count_distinct("snapshot"), F.min("snapshot"), F.max("snapshot")).first()
    shards = max(1, -(-groups.count() // (SHARD_KEYS * max(1, k))))
    key = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    keyed = groups.select("digest", "n_bytes", "snapshot", key.alias("key"), F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard"))
    filters = keyed.where(F.col("snapshot") < F.lit(last_snap)).select("snapshot", "shard", "key").groupBy("snapshot", "shard").applyInArrow(
        _filters, "snapshot int, shard long, seed int, n long, prints binary")
    filters = tmp.keep(filters, "filters")
    positive = filters.groupBy("shard").cogroup(keyed.where(F.col("snapshot") > F.lit(first_snap)).groupBy("shard")).applyInArrow(
        _screen, "digest binary, n_bytes long, snapshot int, earlier int")

    # exact buckets, then the bytes of one text for each digest and snapshot
    bucket = groups.select("digest", "n_bytes", F.col("snapshot").alias("earlier"), F.coalesce(-F.col("best.minus_id"), F.lit(NO_ID)).alias("old_id"))
    new = groups.select("digest", "n_bytes", "snapshot", F.coalesce(-F.col("best.minus_id"), F.lit(NO_ID)).alias("new_id"))
    found = hot_join(hot_join(positive, bucket, ["digest", "n_bytes", "earlier"], "inner"), new, ["digest", "n_bytes", "snapshot"], "inner")
    found = tmp.keep(found.select("digest", "n_bytes", "snapshot", "earlier", "old_id", "new_id"), "found")
    ids = tmp.keep(found.select(F.col("old_id").alias("doc_id")).unionByName(found.select(F.col("new_id").alias("doc_id"))).distinct(), "ids")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text")).join(sized(ids), "doc_id", "left_semi")
    texts = tmp.keep(texts.select("doc_id", bare.alias("bare")).withColumn("digest", F.unhex(F.sha2("bare", 256))), "texts")
    old = texts.select(F.col("doc_id").alias("old_id"), "digest", F.col("bare").alias("old_bare")).dropDuplicates(["old_id", "digest"])
    fresh = texts.select(F.col("doc_id").alias("new_id"), "digest", F.col("bare").alias("new_bare")).dropDuplicates(["new_id", "digest"])
    same = hot_join(hot_join(found, old, ["old_id", "digest"], "inner"), fresh, ["new_id", "digest"], "inner").where(F.col("old_bare").eqNullSafe(F.col("new_bare")))
    # the snapshot in which a text first occurs names its class; copies that no earlier snapshot confirms stand alone
    first = same.groupBy("digest", "n_bytes", "snapshot").agg(F.min("earlier").alias("first"))
    named = groups.join(first, ["digest", "n_bytes", "snapshot"], "left").withColumn("first", F.coalesce("first", "snapshot"))
    total = named.groupBy("digest", "n_bytes", "first").agg(F.sum("size").alias("group_size"), F.max("best").alias("best"))
    verdict = named.select("digest", "n_bytes", "snapshot", "first").join(total, ["digest", "n_bytes", "first"])
    verdict = tmp.keep(verdict.select("digest", "n_bytes", "snapshot", "group_size", "best"), "verdict")
    tmp.drop(found, ids, texts, filters, groups)
    out = hot_join(base, verdict, ["digest", "n_bytes", "snapshot"], "inner")
    keep = -F.col("best.minus_id")
    kept = (F.col("doc_id").eqNullSafe(keep)) & (F.col("cp") == F.col("best.cp"))
    return out.select("doc_id", keep.alias("keep_id"), "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
with n as (select doc_id, length(coalesce(text, '')) as cp, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') as bare from documents),
g as (select bare, count(*) as group_size, arg_min(doc_id, (-cp, doc_id)) as keep_id from n group by bare)
select n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id as kept, sha256(n.bare) as text_sha256 from n join g using (bare)
"""

