"""Benchmark decontamination over a distributed positional inverted index of the training documents.

Index: documents are dealt into chunks of bounded bytes; a chunk is a part of the index with its own positions. For every
term of a chunk one row holds the sorted positions of all its occurrences (a posting list). A frequent term thus has many lists
of bounded length, and no list ever leaves its chunk. The index is a table, and later benchmarks can be run over it again.
Search: the lists of the benchmark's terms meet per chunk. For each window of a benchmark item, the lists are
intersected from its rarest term in that chunk on, each shifted by the term's place in the window: what remains are the starts of
exact occurrences. Proximity: from the rarest term's occurrences on, every other term must lie within the span on either
side; what remains is checked for the least span that holds all terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import Scratch, hot_join, sized, slices, split_words, text_or_empty

WINDOW = 10  # words
SLACK = 5  # words beside those of the window that a proximity match may span
CHUNK_BYTES = 16_000_000  # of text in one chunk, but for a single longer document
ITEM_WORDS = 2_000_000  # of benchmark items that are searched at once
GAP = 1  # positions between two documents, so that no phrase reaches across

#: Word bytes map to themselves in lower case, all others to 0.
_FOLD = np.zeros(256, np.uint8)
_FOLD[48:58], _FOLD[97:123], _FOLD[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
_FOLD[65:91] = np.arange(97, 123)


_SCHEMA = "chunk long, place int, doc_id long, n_words long, term binary, postings binary"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents (place, doc_id, n_words, first position) and rows of terms (term, positions) of every chunk."""
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 32
    names = ["chunk", "place", "doc_id", "n_words", "term", "postings"]
    for b in batches:
        for part in slices(b, "text", CHUNK_BYTES):
            found, number = split_words(part.column("text"), _FOLD)
            n = part.num_rows
            empty = pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.array(np.arange(n, dtype=np.int32)), part.column("doc_id"), pa.array(number), empty, empty], names=names)
            if len(found):
                coded = found.dictionary_encode()
                ids = coded.indices.to_numpy()
                position = (np.arange(len(ids)) + GAP * np.repeat(np.arange(n), number)).astype(np.int32)
                order = np.argsort(ids, kind="stable")
                k = len(coded.dictionary)
                offsets = np.append(0, 4 * np.cumsum(np.bincount(ids, minlength=k))).astype(np.int32)
                lists = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(position[order].tobytes())])
                none = lambda t: pa.nulls(k, t)  # noqa: E731,B023
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, chunk)), none(pa.int32()), none(pa.int64()), none(pa.int64()), coded.dictionary, lists], names=names)
            chunk += 1


def build_index(docs: DataFrame, tmp: Scratch) -> DataFrame:
    """The index of ``docs(doc_id, text)`` as a kept table; rows without a term describe the documents."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return tmp.keep(texts.mapInArrow(_index, _SCHEMA), "index")


def item_windows(texts: list[str | None], width: int = WINDOW) -> list[list[tuple[bytes, ...]]]:
    """Distinct windows of every text: ``width`` consecutive words, or all words if there are fewer."""
    found, number = split_words(pa.array([t or "" for t in texts], pa.string()), _FOLD)
    every, out, at = found.to_pylist(), [], 0
    for n in number.tolist():
        w = every[at : at + n]
        at += n
        out.append(list(dict.fromkeys(tuple(w[i : i + width]) for i in range(max(1, n - width + 1)))) if n else [])
    return out


def phrase_starts(window: tuple[bytes, ...], lists: dict[bytes, np.ndarray]) -> np.ndarray:
    """Positions where the window's words follow each other: lists intersected from the rarest term on."""
    terms = sorted(((len(lists[t]), i, t) for i, t in enumerate(window)))
    _, i, t = terms[0]
    starts = lists[t] - i
    for _, i, t in terms[1:]:
        have = lists[t]
        at = np.searchsorted(have, starts + i)
        at[at == len(have)] = 0
        starts = starts[have[at] == starts + i]
        if not len(starts):
            break
    return starts


def near_spans(window: tuple[bytes, ...], lists: dict[bytes, np.ndarray], span: int, bounds: np.ndarray) -> list[tuple[int, int]]:
    """``(first, last)`` of stretches of at most ``span`` positions in one document that hold every distinct word of the window.

    ``bounds``: first positions of all documents, and the end. One stretch, the shortest and among equal ones the first, for each occurrence of the rarest word that has any.
    """
    terms = sorted({t: len(lists[t]) for t in window}.items(), key=lambda x: (x[1], x[0]))
    mid = lists[terms[0][0]]
    for t, _ in terms[1:]:
        have = lists[t]
        mid = mid[np.searchsorted(have, mid - span + 1) < np.searchsorted(have, mid + span - 1, side="right")]
        if not len(mid):
            return []
    out = []
    for p in mid.tolist():
        d = int(np.searchsorted(bounds, p, side="right"))
        around = (max(p - span + 1, bounds[d - 1]), min(p + span, bounds[d]))
        near = [lists[t][slice(*np.searchsorted(lists[t], around))] for t, _ in terms[1:]]
        ends = []
        for s in sorted({p, *(int(x) for l in near for x in l if x <= p)}, reverse=True):
            last = p
            for l in near:
                k = int(np.searchsorted(l, s))
                if k == len(l):
                    break
                last = max(last, int(l[k]))
            else:
                if last - s < span:
                    ends.append((last - s, s, last))
        if ends:
            _, s, e = min(ends)
            out.append((s, e))
    return out


def _search(items: list[tuple[int, list[tuple[bytes, ...]]]], slack: int | None):
    """All matches of ``items`` (number, windows) within a chunk: (place, item, first word, words, exact)."""
    by_window: dict[tuple[bytes, ...], list[int]] = {}
    for number, windows in items:
        for w in windows:
            by_window.setdefault(w, []).append(number)

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        term, posts = rows.column("term").to_pylist(), rows.column("postings").to_pylist()
        lists = {t: np.frombuffer(p, np.int32) for t, p in zip(term, posts, strict=True) if t is not None}
        docs = rows.filter(rows.column("term").is_null()).sort_by("place")
        place, number = docs.column("place").to_numpy(), docs.column("n_words").to_numpy()
        bounds = np.append(0, np.cumsum(number + GAP))
        first = bounds[:-1]  # position of every document's first word
        out: list[list] = [[], [], [], [], []]

        def put(owners: list[int], starts: np.ndarray, sizes: np.ndarray, exact: bool) -> None:
            d = np.searchsorted(first, starts, side="right") - 1
            for o in owners:
                for c, v in zip(out, (place[d], [o] * len(d), starts - first[d], sizes, [exact] * len(d)), strict=True):
                    c.extend(v.tolist() if isinstance(v, np.ndarray) else v)

        for w, owners in by_window.items():
            if not all(t in lists for t in w):
                continue
            starts = phrase_starts(w, lists)
            if len(starts):
                put(owners, starts, np.full(len(starts), len(w)), True)
            if slack is not None:
                spans = np.array(near_spans(w, lists, len(w) + slack, bounds), np.int64).reshape(-1, 2)
                if len(spans):
                    put(owners, spans[:, 0], spans[:, 1] - spans[:, 0] + 1, False)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        t = pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["place", "item", "first_word", "words", "exact"])
        return t.add_column(0, "chunk", pa.array([key[0].as_py()] * t.num_rows, pa.int64()))

    return run


def matches(index: DataFrame, items: DataFrame, width: int = WINDOW, slack: int | None = None, tmp: Scratch | None = None) -> DataFrame:
    """``(chunk, place, item_id, first_word, words, exact)``: every occurrence of a window of ``items(item_id, text)``.

    Exact occurrences always; with ``slack`` also proximity matches: stretches of at most ``slack`` words more than the
    window has, which hold all its distinct words in any order. ``chunk`` and ``place`` name a document of the index.
    The items are searched in blocks of at most ITEM_WORDS words, each a bounded broadcast, so their number has no limit.
    """
    spark = index.sparkSession
    tmp = tmp or Scratch(spark)
    rows = tmp.keep(items.select(F.col("item_id").cast("string").alias("item_id"), text_or_empty().alias("text")).withColumn("words", F.length("text")), "items")
    n = max(1, -(-(rows.agg(F.sum("words")).first()[0] or 0) // ITEM_WORDS))
    out = None
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).select("item_id", "text").distinct().orderBy("item_id", "text").collect()
        windows = item_windows([r.text for r in part], width)
        names = sorted({r.item_id for r in part}, key=lambda x: (x is not None, x))
        number = {name: i for i, name in enumerate(names)}
        numbered = [(number[r.item_id], w) for r, w in zip(part, windows, strict=True)]
        vocabulary = sorted({t for _, ws in numbered for w in ws for t in w})
        wanted = sized(spark.createDataFrame([(bytearray(t),) for t in vocabulary], "term binary"))
        lists = index.where("term is not null").join(wanted, "term", "left_semi").select("chunk", "place", "n_words", "term", "postings")
        chunks = lists.unionByName(index.where("term is null").select("chunk", "place", "n_words", "term", "postings"))
        found = chunks.groupBy("chunk").applyInArrow(_search(numbered, slack), "chunk long, place int, item long, first_word long, words long, exact boolean")
        label = spark.createDataFrame(list(enumerate(names)), "item long, item_id string")
        found = found.join(F.broadcast(label), "item").select("chunk", "place", "item_id", "first_word", "words", "exact")
        out = found if out is None else out.unionByName(found)
    return out


def contaminated(docs: DataFrame, items: DataFrame, width: int = WINDOW, slack: int | None = SLACK, tmp: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items.

    Words are maximal runs of a-z (A-Z folded), 0-9 and characters beyond ASCII. A window is ``width`` consecutive words of an
    item, or all of them if there are fewer. ``n_hit`` counts the words of the document inside any exact occurrence of a
    window, ``n_items`` the distinct item ids with one, ``items_sha256`` hashes these ids, sorted as strings and joined
    by commas (of none: the hash of the empty string); ``n_near_items`` counts the ids with a proximity match.
    Null and empty texts have no words and no windows. Rows that repeat a doc_id or text, or have no doc_id, each give a
    row. Items that repeat an id count as one; items without id hit, count as one and are left out of the hash. Extra
    columns are ignored; without documents the result is empty, without items nothing is hit.
    """
    tmp = tmp or Scratch(docs.sparkSession)
    index = build_index(docs, tmp)
    found = tmp.keep(matches(index, items, width, slack, tmp), "matches")
    # words inside any occurrence: occurrences of one document by their first words, each counts what lies beyond the ones before
    spans = found.where("exact").select("chunk", "place", "first_word", "words").distinct()
    hit = spans.groupBy("chunk", "place").agg(F.sort_array(F.collect_list(F.struct("first_word", (F.col("first_word") + F.col("words")).alias("end")))).alias("s"))
    step = lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(a["end"], x["first_word"]))).alias("n"), F.greatest(a["end"], x["end"]).alias("end"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    hit = hit.select("chunk", "place", F.aggregate("s", start, step, lambda a: a["n"]).alias("n_hit"))
    ids = found.groupBy("chunk", "place").agg(
        F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("item_id")))).alias("ids"), F.max(F.col("exact") & F.col("item_id").isNull()).alias("unnamed"),
        (F.count_distinct(F.when(~F.col("exact"), F.col("item_id"))) + F.max((~F.col("exact") & F.col("item_id").isNull()).cast("int"))).cast("long").alias("n_near_items"))
    rows = index.where("term is null").select("chunk", "place", "doc_id", "n_words")
    out = hot_join(hot_join(rows, hit, ["chunk", "place"]), ids, ["chunk", "place"])
    n_hit, names = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("ids", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), (F.size(names) + F.coalesce(F.col("unnamed"), F.lit(False)).cast("int")).cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("n_near_items", F.lit(0).cast("long")).alias("n_near_items"))


def oracle(width: int = WINDOW, slack: int = SLACK) -> str:
    """The same in SQL; proximity: the least stretch from an occurrence of one of the window's words that holds them all."""
    split = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
with d as (select row_number() over () as r, doc_id, {split.format("coalesce(text, '')")} as w from documents),
i as (select item_id, {split.format("coalesce(text, '')")} as w from benchmark),
wn as (select distinct item_id, w[k:k + least(len(w), {width}) - 1] as win from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - {width} + 1))) as k from i where len(w) > 0)),
sizes as (select distinct len(win) as n from wn),
pl as (select r, k, n, w[k:k + n - 1] as win from (select r, w, unnest(generate_series(1, len(w))) as k from d where len(w) > 0), sizes where k + n - 1 <= len(w)),
f as (select r, k, n, item_id from pl join wn on pl.win = wn.win),
hits as (select r, count(distinct p) as n_hit from (select r, unnest(generate_series(k, k + n - 1)) as p from f) group by r),
ids as (select r, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as s from f group by r),
wt as (select item_id, win, unnest(list_distinct(win)) as t, len(win) + {slack} as span, len(list_distinct(win)) as terms from wn),
tok as (select r, k, w[k] as t from (select r, w, unnest(generate_series(1, len(w))) as k from d where len(w) > 0)),
df as (select t, count(*) as f from tok group by t),
rare as (select item_id, win, span, terms, arg_min(wt.t, (f, wt.t)) as t from wt join df on df.t = wt.t group by all having count(*) = terms),
c as (select distinct rare.win, span, terms, tok.r, tok.k from rare join tok on rare.t = tok.t),
c2 as (select win, span, terms, r, k, generate_series(greatest(1, k - span + 1), k) as starts, w from c join d using (r)),
near as (select distinct win, r from c2 where len(list_distinct([x for x in w[greatest(1, k - span + 1):k + span - 1] if list_contains(win, x)])) = terms
  and len([s for s in starts if len(list_distinct([x for x in w[s:s + span - 1] if list_contains(win, x)])) = terms]) > 0),
nr as (select r, count(distinct item_id) as n_near_items from near join wn using (win) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(s, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated, cast(coalesce(n_near_items, 0) as bigint) as n_near_items from d left join hits using (r) left join ids using (r) left join nr using (r)
"""
