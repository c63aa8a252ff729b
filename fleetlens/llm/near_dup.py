"""Near duplicates: bottom-k sketches from one hash function, inverted lists of retained values, exact Jaccard.

1. Every text becomes the set of its distinct w-word shingles, as 64-bit hashes; its sketch is the K smallest of them.
   Texts with equal sets form one class; from here on only classes count.
2. Two sets with similarity 0.8 or more share at least S of their K retained values (all sets of at most K values: by
   arithmetic; larger ones: but for a probability near 1e-7). So they also share one of the K - S + 1 values of each
   sketch that the fewest sketches retain. Only these enter the inverted lists: values that everybody retains stay out.
3. First pass: every list links its members to one member, chosen at random for each list. That is linear in the number
   of list rows, and joins groups of thousands of near copies through many different members.
4. The union-sketch estimate drops pairs that cannot be similar; the rest is compared on full sets. First every document
   with its smallest partner only: the other pairs matter where their ends are not one component by then. A text thus
   travels about once, and not once for each list.
5. Second pass: only lists whose members are not one component by then. Every member outside a list's largest component
   is compared on full sets, in blocks, with all members of other components in the lists that have the same largest
   component. Together both passes find every component; no list has a cap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import Scratch, components, hot_join, lean, sized, slices

K = 64  # retained values of a sketch
SHARED = 32  # that two similar sets share at least, if they have more values
SMALL = 51  # sets of at most so many values, and all sets similar to them, are retained whole
BLOCK_BYTES = 4_000_000  # of texts or sketches in one block of the second pass
PART = 2_000_000  # bytes of texts whose sets are made at once


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a UTF-8 text; of all words, if there are fewer.

    bytes.lower and bytes.split know exactly A-Z and the six white-space characters of ASCII.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    a = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    n = min(width, len(a))
    out = np.full(len(a) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + a[i : len(a) - n + 1 + i])
    return np.unique(out)


def _bytes(col: pa.Array) -> list[bytes | None]:
    return col.cast(pa.large_binary()).to_pylist()


def _sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """``shingles`` of the texts of a part, made once for equal texts; nothing is remembered beyond the part."""
    values = _bytes(texts)
    sets = {t: shingles(t, width) for t in set(values)}
    return [sets[t] for t in values]


def _sketcher(width: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for whole in batches for p in slices(whole, "text", PART)):
            sets = _sets(b.column("text"), width)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([s[:K].tobytes() for s in sets], pa.binary())], names=["doc_id", "text_hash", "n", "digest", "sketch"])

    return run


@lean
def _retained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sk = [np.frombuffer(x, np.int64) for x in b.column("sketch").to_pylist()]
        sizes = [len(x) for x in sk]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate(sk) if sk else np.empty(0, np.int64)), pa.array(np.repeat(b.column("doc").to_numpy(), sizes)),
            pa.array(np.repeat(b.column("n").to_numpy(), sizes))], names=["value", "doc", "n"])


@lean
def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The upper halves of the retained values: where two agree, the values may; where values agree, they do."""
    for b in batches:
        half = [(np.frombuffer(x, np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes() for x in b.column("sketch").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(half, pa.binary())], names=["doc", "payload"])


def _union_estimate(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the bottom-K sketches leave similarity 0.8 possible: shared values among the K smallest of the union."""
    union = np.union1d(a, b)[:K]
    both = np.intersect1d(a, b, assume_unique=True)
    shared = len(both) if len(union) < K else int(np.searchsorted(both, union[-1], side="right"))
    return shared >= (SHARED if len(union) >= K else -(-len(union) * 4 // 5))


@lean
def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [np.frombuffer(v, np.uint64) for v in b.column("sketch_a").to_pylist()]
        y = [np.frombuffer(v, np.uint64) for v in b.column("sketch_b").to_pylist()]
        ok = pa.array([_union_estimate(p, q) for p, q in zip(x, y, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(ok)


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    inter = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * inter >= 80 * (len(x) + len(y) - inter)


def _exact(width: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (q for whole in batches for p in slices(whole, "text_b", PART) for q in slices(p, "text_a", PART)):
            x, y = _sets(b.column("text_a"), width), _sets(b.column("text_b"), width)
            ok = pa.array([_similar(p, q) for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(ok)

    return run


def _against(left: pa.Table, right: pa.Table, members: list[np.ndarray], probe, possible) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(probe's position, its doc, positions of members)`` where ``possible(shared, n, m)`` holds between components."""
    comps, n = (left.column(c).to_numpy() for c in ("comp", "n"))
    order = np.argsort(n, kind="stable")  # sets of a similar size lie together
    comps, n, members = comps[order], n[order], [members[i] for i in order]
    if not members:
        return
    every = np.concatenate(members)
    starts = np.r_[0, np.cumsum([len(f) for f in members])].astype(np.int64)
    for k, (doc, comp, m) in enumerate(zip(*(right.column(c).to_pylist() for c in ("doc", "comp", "n")), strict=True)):
        lo, hi = np.searchsorted(5 * n, 4 * m), np.searchsorted(4 * n, 5 * m, side="right")
        if not (comps[lo:hi] != comp).any():
            continue
        f = probe(k)
        some = every[starts[lo] : starts[hi]]
        at = np.minimum(np.searchsorted(f, some), len(f) - 1)
        shared = np.add.reduceat((f[at] == some).astype(np.int64), starts[lo:hi] - starts[lo])
        yield k, doc, order[lo + np.flatnonzero((comps[lo:hi] != comp) & possible(shared, n[lo:hi], m))]


def _similar_sizes(shared: np.ndarray, n: np.ndarray, m: int) -> np.ndarray:
    return 100 * shared >= 80 * (n + m - shared)


def _sketch_possible(shared: np.ndarray, n: np.ndarray, m: int) -> np.ndarray:
    """The same bound as for the lists: whole sets are compared, of larger ones half of the retained values must agree."""
    whole = np.maximum(n, m) <= K
    return np.where(whole, _similar_sizes(shared, n, m), shared >= SHARED)


def _block_ends(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of a block that have a possible partner, by their sketches."""
    ids = left.column("doc").to_numpy()
    sk = [np.frombuffer(x, np.uint32) for x in left.column("payload").to_pylist()]
    other = right.column("payload").to_pylist()
    ends: set[int] = set()
    for _, doc, found in _against(left, right, sk, lambda k: np.frombuffer(other[k], np.uint32), _sketch_possible):
        if len(found):
            ends.add(doc)
            ends.update(ids[found].tolist())
    return pa.table({"main": pa.array([key[0].as_py()] * len(ends), pa.int64()), "doc": pa.array(sorted(ends), pa.int64())})


def _block_links(width: int):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        """Links between a block of probes (``right``) and a block of members (``left``), on full sets."""
        ids, comps = left.column("doc").to_numpy(), left.column("comp").to_numpy()
        full = _sets(left.column("payload"), width)
        other = _bytes(right.column("payload"))
        out_a, out_b = [], []
        for _, doc, found in _against(left, right, full, lambda k: shingles(other[k], width), _similar_sizes):
            _, first = np.unique(comps[found], return_index=True)  # one link joins two components
            out_a += [doc] * len(first)
            out_b += ids[found[first]].tolist()
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def _blocks(tmp: Scratch, rows: DataFrame, run, schema: str) -> DataFrame:
    """Every block of the members of a ``main`` meets every block of its probes, the members of other components."""
    bytes_ = F.octet_length("payload")
    weight = rows.groupBy("main").agg(F.ceil(F.sum(bytes_) / BLOCK_BYTES).cast("int").alias("blocks"),
                                      F.ceil(F.sum(F.when(F.col("comp") != F.col("main"), bytes_)) / BLOCK_BYTES).cast("int").alias("parts"))
    weight = sized(tmp.keep(weight.where("parts > 0"), "blocks"))
    rows = rows.join(weight, "main").select("main", "blocks", "parts", "doc", "comp", "n", "payload")
    at = lambda n: F.pmod(F.xxhash64("doc"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = rows.withColumn("block", at("blocks")).withColumn("part", each("parts")).drop("blocks", "parts")
    probes = rows.where("comp <> main").withColumn("part", at("parts")).withColumn("block", each("blocks")).drop("blocks", "parts")
    probes = probes.toDF(*probes.columns)
    return members.groupBy("main", "block", "part").cogroup(probes.groupBy("main", "block", "part")).applyInArrow(run, schema)


def near_duplicates(docs: DataFrame, width: int = 5, tmp: Scratch | None = None) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs(doc_id, text, ...)``.

    Words are maximal runs without ASCII white space, A-Z in lower case; two documents are linked if their shingle sets
    have a similarity of at least 0.8; ``component_id`` is the smallest doc_id reachable, ``kept`` marks that document.
    Null and empty texts, and texts of white space only, have no shingle and are linked with nothing. Rows that repeat a
    doc_id belong to one document, whose first text (by digest) counts; every row is returned. A null doc_id is never
    linked: component null, kept. Extra columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    tmp = tmp or Scratch(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sk = tmp.keep(texts.mapInArrow(_sketcher(width), "doc_id long, text_hash long, n long, digest binary, sketch binary"), "sketches")
    solid = sk.where("n > 0 and doc_id is not null")
    # one digest for a doc_id, then one doc_id for a digest
    once = tmp.keep(solid.groupBy("doc_id").agg(F.min(F.struct("digest", "n")).alias("s"), F.count(F.lit(1)).alias("rows")).select("doc_id", "s.digest", "s.n", "rows"), "documents")
    classes = tmp.keep(once.groupBy("digest", "n").agg(F.min("doc_id").alias("doc")), "classes")
    reps = solid.join(sized(classes.select(F.col("doc").alias("doc_id"), "digest")), ["doc_id", "digest"], "left_semi").select(F.col("doc_id").alias("doc"), "text_hash", "n", "sketch")
    if not once.where("rows > 1").isEmpty():
        reps = reps.dropDuplicates(["doc"])
    reps = tmp.keep(reps, "reps")
    # from here on sketches are read from the classes only; every row keeps its size
    sizes = tmp.keep(sk.select("doc_id", "n"), "sizes")
    tmp.drop(sk)
    tmp.tidy()

    lists = tmp.keep(_lists(reps), "lists")
    tmp.tidy()
    links = _first_pass(tmp, texts, reps, lists, width)
    tmp.tidy()
    labels = components(tmp, links)
    more = _second_pass(tmp, texts, reps, lists, labels, width)
    if not more.isEmpty():
        labels = components(tmp, links.unionByName(more))
    tmp.drop(links, more, reps)

    of_class = hot_join(classes.select("digest", F.col("doc").alias("node")), labels, ["node"]).select("digest", F.coalesce("label", "node").alias("component_id"))
    of_class = tmp.keep(of_class, "components")
    of_doc = tmp.keep(hot_join(once.select("doc_id", "digest"), of_class, ["digest"]).select("doc_id", "component_id"), "members")
    out = hot_join(sizes, of_doc, ["doc_id"])
    comp = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"))


def _lists(reps: DataFrame) -> DataFrame:
    """``(value, members, doc, n)``: the inverted lists of at least two members."""
    rows = reps.select("doc", "n", "sketch").mapInArrow(_retained, "value long, doc long, n long")
    counts = rows.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = hot_join(rows, counts, ["value"], "inner")
    # values retained by one sketch come first in the order and take their places, but have no list
    size = F.least(F.col("n"), F.lit(K))
    least = F.when(F.col("n") <= SMALL, F.ceil(F.col("n") * 4 / 5)).otherwise(F.lit(SHARED))
    room = (size - least + 1 - (size - F.size("vs"))).cast("int")
    # dealt out as plain rows, which are smaller than arrays of one
    per = shared.repartition("doc", "n").groupBy("doc", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("vs"))
    prefix = per.select("doc", "n", F.slice("vs", 1, F.greatest(room, F.lit(0))).getField("value").alias("prefix")).where(F.size("prefix") > 0)
    listed = prefix.select("doc", "n", F.explode("prefix").alias("value"))
    lengths = listed.groupBy("value").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return hot_join(listed, lengths, ["value"], "inner").select("value", "members", "doc", "n")


def _texts(tmp: Scratch, texts: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the wanted documents, filtered where they are read; of rows that repeat a doc_id, the class's text.

    Texts travel to the comparisons, not their sets, which are several times as large in a shuffle.
    """
    want = hot_join(reps.select("doc", "text_hash"), wanted.select("doc"), ["doc"], "inner").select(F.col("doc").alias("doc_id"), "text_hash")
    return texts.join(sized(tmp.keep(want, "wanted-texts")), ["doc_id", "text_hash"], "left_semi").select(F.col("doc_id").alias("doc"), "text")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()


def _first_pass(tmp: Scratch, texts: DataFrame, reps: DataFrame, lists: DataFrame, width: int) -> DataFrame:
    order = F.xxhash64("doc", "value")
    hub = lists.groupBy("value").agg(F.min(F.struct(order.alias("o"), F.col("doc"), F.col("n"))).alias("hub"))
    near = F.col("n") * 4 <= F.col("hub.n") * 5
    near &= F.col("hub.n") * 4 <= F.col("n") * 5
    pairs = hot_join(lists.select("value", "doc", "n"), hub, ["value"], "inner").where(near & (F.col("doc") != F.col("hub.doc")))
    pairs = tmp.keep(pairs.select(F.least("doc", "hub.doc").alias("a"), F.greatest("doc", "hub.doc").alias("b")).distinct(), "candidates")
    side = lambda t, x, c: t.select(F.col("doc").alias(x), F.col(c).alias(f"{c}_{x}"))
    wanted = tmp.keep(_ends(pairs), "wanted")
    some = reps.select("doc", "sketch").join(sized(wanted), "doc", "left_semi")
    both = hot_join(hot_join(pairs, side(some, "a", "sketch"), ["a"], "inner"), side(some, "b", "sketch"), ["b"], "inner")
    likely = tmp.keep(both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(_estimate, "a long, b long"), "pairs")
    tmp.drop(pairs, wanted)
    star = tmp.keep(likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "star-pairs")
    links = _linked(tmp, texts, reps, star, width)
    label = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    labels = components(tmp, links)
    rest = hot_join(hot_join(likely.join(star, ["a", "b"], "left_anti"), label("a"), ["a"]), label("b"), ["b"])
    rest = tmp.keep(rest.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b"), "other-pairs")
    more = _linked(tmp, texts, reps, rest, width)
    out = tmp.keep(links.unionByName(more), "links")
    tmp.drop(likely, star, links, labels, rest, more)
    return out


def _linked(tmp: Scratch, texts: DataFrame, reps: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """The pairs that are similar on full sets. The text of ``b`` joins first: in most pairs ``a`` is one of few hubs."""
    side = lambda c, name: _texts(tmp, texts, reps, tmp.keep(pairs.select(F.col(c).alias("doc")).distinct(), "wanted")).select(F.col("doc").alias(c), F.col("text").alias(name))
    both = hot_join(hot_join(pairs, side("b", "text_b"), ["b"], "inner"), side("a", "text_a"), ["a"], "inner")
    return tmp.keep(both.select("a", "b", "text_a", "text_b").mapInArrow(_exact(width), "a long, b long"), "links")


def _second_pass(tmp: Scratch, texts: DataFrame, reps: DataFrame, lists: DataFrame, labels: DataFrame, width: int) -> DataFrame:
    """Links between components within lists of three and more members; lists of two are done with the first pass.

    All open lists with the same largest component are one comparison: a text travels once for them, not once a list.
    """
    three = lists.where("members > 2")
    comp = hot_join(three.select("value", "n", F.col("doc").alias("node")), labels, ["node"]).select("value", "n", F.col("node").alias("doc"), F.coalesce("label", "node").alias("comp"))
    comp = tmp.keep(comp, "list-components")
    per = comp.groupBy("value", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("value").agg(
        F.count(F.lit(1)).alias("parts"), F.max_by("comp", F.struct("k", "comp")).alias("main")).where("parts > 1")
    rows = tmp.keep(hot_join(comp, per.select("value", "main"), ["value"], "inner").select("main", "doc", "comp", "n").distinct(), "open-rows")
    if rows.isEmpty():
        return tmp.keep(tmp.spark.createDataFrame([], "a long, b long"), "links")
    # first on sketches; texts travel for documents that may have a partner
    wanted = tmp.keep(rows.select("doc").distinct(), "wanted")
    short = reps.select("doc", "sketch").join(sized(wanted), "doc", "left_semi").mapInArrow(_shortened, "doc long, payload binary")
    some = tmp.keep(hot_join(rows, short, ["doc"], "inner"), "open-sketches")
    ends = tmp.keep(_blocks(tmp, some, _block_ends, "main long, doc long").distinct(), "ends")
    wanted = tmp.keep(ends.select("doc").distinct(), "wanted")
    tmp.drop(some)
    left = tmp.keep(hot_join(rows, ends, ["main", "doc"], "inner"), "open-rows")
    some = tmp.keep(hot_join(left, _texts(tmp, texts, reps, wanted).dropDuplicates(["doc"]).withColumnRenamed("text", "payload"), ["doc"], "inner"), "open-texts")
    out = tmp.keep(_blocks(tmp, some, _block_links(width), "a long, b long"), "links")
    tmp.drop(comp, rows, ends, wanted, left, some)
    return out
