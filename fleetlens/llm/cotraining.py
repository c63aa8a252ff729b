"""Quality by co-training: a text view and a metadata view teach each other, then both score every document.

Text view: hashed words and their beginnings, as inflected and compound words share a stem. Metadata view: source, language, and the layout of the page (length, line lengths, shares of
character classes, repeated characters). Each view is a logistic model. Both are fitted on a bounded sample of labelled
documents. In every round Spark scores all documents with both views, each view hands the other some of the
unlabelled documents it is sure of, drawn from the whole corpus by hash, and the views are fitted again with them. A held-out part of the
labelled sample, never trained on, calibrates both views and sets the threshold. The sample lies in a table and is fitted
in executor tasks, one per model; only weights reach the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.common import Scratch, hot_join, lean, slices, split_words, text_or_empty

LABELLED = 6_000  # the bound of the labelled sample
ROUNDS = 2
AGAIN = 40  # steps of a fit that goes on from the one of the round before
CONFIDENT = 600  # pseudo-labels that a view hands over in the first round, at most; in round r, r times as many
SURE = 0.95  # and the least probability of one
WORD_BITS = 18
BEGINNINGS = (4, 5, 6, 7)  # bytes of a word that are hashed besides the word, if it is longer
META_BITS = 10
LAYOUT = 12  # columns of the metadata view that are numbers
COST_GOOD = 5.0  # what the loss of a share of the good held-out documents costs, against the same share of the bad ones kept
WORDS = 400_000  # remembered words
LONG_WORD = 64  # longer words are not remembered
BLOCK = 1 << 19  # entries of sparse rows that are summed at once
PART = 2_000_000  # bytes of texts whose features are made at once

_slots: dict[bytes, int] = {}
#: Classes of bytes: letters in lower and upper case, digits, white space, line ends, bytes beyond ASCII, pipes, full stops and commas, other signs.
_CLASSES = np.full(256, 8, np.uint8)
_CLASSES[97:123], _CLASSES[65:91], _CLASSES[48:58], _CLASSES[128:] = 0, 1, 2, 5
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Words: ASCII in lower case, between ASCII white space.
_FOLD = np.arange(256).astype(np.uint8)
_FOLD[65:91] += 32
_FOLD[_SPACE] = 0
_CLASSES[[9, 11, 12, 13, 32]], _CLASSES[10], _CLASSES[124], _CLASSES[[44, 46]] = 3, 4, 6, 7


def _word_slots(words: list[bytes], raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(word, slot)`` pairs: every word's own slot, and one for each beginning that is shorter than the word."""
    known = _slots
    if len(known) > WORDS:
        known.clear()
    own = np.empty(len(words), np.int32)
    for i, w in enumerate(words):
        s = known.get(w)
        if s is None:
            s = xxhash.xxh3_64_intdigest(w.strip(b".,;:!?")) & ((1 << WORD_BITS) - 1)
            if len(w) <= LONG_WORD:
                known[w] = s
        own[i] = s
    of, slot = [np.arange(len(words))], [own]
    word, h = of[0], np.zeros(len(words), np.uint64)
    for k in range(max(BEGINNINGS)):
        more = size[word] > k + 1
        word, h = word[more], h[more]
        h = (h + raw[start[word] + k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if k + 1 in BEGINNINGS:
            of.append(word)
            slot.append((h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - WORD_BITS)).astype(np.int32))
    return np.concatenate(of), np.concatenate(slot)


def text_rows(texts: pa.Array) -> Rows:
    """Slots and weights (square roots of counts, length 1) of the words of whole texts and of their beginnings.

    Every distinct word of the texts is hashed once.
    """
    n = len(texts)
    found, number = split_words(texts, _FOLD)
    if not len(found):
        return Rows.of_arrays(n, np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.float32))
    coded = found.dictionary_encode()
    size = len(coded.dictionary)
    kind = np.int64 if pa.types.is_large_binary(coded.dictionary.type) else np.int32
    at = np.frombuffer(coded.dictionary.buffers()[1], kind)[: size + 1].astype(np.int64)
    raw = np.frombuffer(coded.dictionary.buffers()[2], np.uint8)
    of, slot = _word_slots(coded.dictionary.to_pylist(), raw, at[:-1], np.diff(at))
    order = np.argsort(of, kind="stable")
    of, slot = of[order], slot[order]
    first = np.searchsorted(of, np.arange(size + 1))
    # distinct words of every text, then distinct slots
    pairs, times = np.unique(np.repeat(np.arange(n), number) * size + coded.indices.to_numpy(), return_counts=True)
    word, doc = pairs % size, pairs // size
    each = (first[1:] - first[:-1])[word]
    entry = np.repeat(first[word] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
    key = (np.repeat(doc, each) << WORD_BITS) | slot[entry]
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    value = np.add.reduceat(np.repeat(times, each)[order], begin).astype(np.float64)
    doc, idx = (key[begin] >> WORD_BITS).astype(np.int32), (key[begin] & ((1 << WORD_BITS) - 1)).astype(np.int32)
    norm = np.sqrt(np.bincount(doc, value, minlength=n))
    return Rows.of_arrays(n, doc, idx, (np.sqrt(value) / norm[doc]).astype(np.float32))


def meta_features(text: bytes, source: str | None, lang: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed source and language, and layout numbers scaled to about 1."""
    slot = lambda s: LAYOUT + xxhash.xxh3_64_intdigest(s.encode()) % ((1 << META_BITS) - LAYOUT)
    raw = np.frombuffer(text, np.uint8)
    n = max(1, len(raw))
    share = np.bincount(_CLASSES[raw], minlength=9) / n
    lines = float(share[4] * n) + 1
    same = float(np.count_nonzero(raw[1:] == raw[:-1])) / n
    numbers = [1.0, np.log1p(len(raw)) / 8, np.log1p(len(raw) / lines) / 6, *(np.sqrt(share[[1, 2, 5, 6, 7, 8]])), np.sqrt(share[3]), np.sqrt(same), float(len(raw) == 0)]
    idx = np.r_[np.arange(LAYOUT), slot(f"s:{source}"), slot(f"l:{lang}")].astype(np.int32)
    return idx, np.r_[numbers, 0.3, 0.3].astype(np.float32)


@dataclass
class View:
    weights: np.ndarray
    bias: float = 0.0
    scale: float = 1.0  # calibration: probability = sigmoid(scale * margin + shift)
    shift: float = 0.0

    def margin(self, rows: Rows) -> np.ndarray:
        return rows.sums(self.weights) + self.bias

    def logit(self, rows: Rows) -> np.ndarray:
        return self.scale * self.margin(rows) + self.shift


class Rows:
    """Sparse rows; sums over them go by blocks of entries, so that no temporary array is as long as all entries."""

    def __init__(self, feats: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(feats)
        self.of = np.repeat(np.arange(self.n, dtype=np.int32), [len(i) for i, _ in feats])
        self.idx = np.concatenate([i for i, _ in feats]) if feats else np.empty(0, np.int32)
        self.val = np.concatenate([v for _, v in feats]) if feats else np.empty(0, np.float32)

    @staticmethod
    def of_arrays(n: int, of: np.ndarray, idx: np.ndarray, val: np.ndarray) -> Rows:
        out = Rows([])
        out.n, out.of, out.idx, out.val = n, of, idx, val
        return out

    @staticmethod
    def join(parts: list[Rows]) -> Rows:
        at = np.cumsum([0, *(p.n for p in parts)])
        cat = lambda xs, t: np.concatenate(xs) if xs else np.empty(0, t)
        return Rows.of_arrays(int(at[-1]), cat([p.of + np.int32(a) for p, a in zip(parts, at, strict=False)], np.int32), cat([p.idx for p in parts], np.int32), cat([p.val for p in parts], np.float32))

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for a in range(0, len(self.idx), BLOCK):
            yield self.of[a : a + BLOCK], self.idx[a : a + BLOCK], self.val[a : a + BLOCK]

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Weighted sum of each row."""
        out = np.zeros(self.n)
        for of, idx, val in self.blocks():
            out[of[0] : of[-1] + 1] += np.bincount(of - of[0], weights[idx] * val)
        return out

    def gradient(self, g: np.ndarray, size: int) -> np.ndarray:
        """Sum of the rows, each times its ``g``."""
        out = np.zeros(size)
        for of, idx, val in self.blocks():
            out += np.bincount(idx, g[of] * val, minlength=size)
        return out

    def take(self, keep: np.ndarray) -> Rows:
        """Rows of a boolean mask."""
        new = (np.cumsum(keep) - 1).astype(np.int32)
        e = keep[self.of]
        return Rows.of_arrays(int(keep.sum()), new[self.of[e]], self.idx[e], self.val[e])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: Rows, y: np.ndarray, size: int, steps: int = 120, l2: float = 1e-4, rate: float = 0.5, start: View | None = None) -> View:
    """Logistic regression by full-batch Adam, from ``start`` if given; both classes get the same total weight."""
    pos = max(1e-9, y.mean())
    weight = np.where(y > 0.5, 0.5 / pos, 0.5 / max(1e-9, 1 - pos)) / max(1, len(y))
    v = View(start.weights, start.bias) if start else View(np.zeros(size))
    m, s, mb, sb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        g = weight * (_sigmoid(v.margin(rows)) - y)
        grad = rows.gradient(g, size) + l2 * v.weights
        gb = g.sum()
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.99**t
        v.weights = v.weights - rate * (m / a) / (np.sqrt(s / b) + 1e-6)
        v.bias -= rate * (mb / a) / (np.sqrt(sb / b) + 1e-6)
        rate = max(0.02, rate * 0.98)
    return v


def calibrate(v: View, margin: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling by Newton steps, with smoothed targets."""
    up, down = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    t = np.where(y > 0.5, up, down)
    x = np.stack([margin, np.ones_like(margin)])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(w @ x)
        h = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x @ (p - t))
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    v.scale, v.shift = float(w[0]), float(w[1])


def threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut, between two held-out scores, at which lost good and kept bad documents together cost least; the lowest of equal ones."""
    order = np.argsort(p, kind="stable")
    p, y = p[order], y[order]
    lost, kept = np.r_[0, np.cumsum(y)] / max(1, y.sum()), 1 - np.r_[0, np.cumsum(1 - y)] / max(1, (1 - y).sum())
    ends = np.r_[0.0, p, 1.0]
    cost = np.where(ends[1:] > ends[:-1], COST_GOOD * lost + kept, np.inf)  # equal scores stay on one side
    at = int(np.argmin(cost))
    return float((ends[at] + ends[at + 1]) / 2)


@dataclass
class Model:
    """Two calibrated views, the weight of each, the threshold below which a document is rejected, and the share of class 1."""

    text: View
    meta: View
    mix: np.ndarray
    threshold: float
    share: float

    def views(self, text: Rows, meta: Rows) -> tuple[np.ndarray, np.ndarray]:
        return _sigmoid(self.text.logit(text)), _sigmoid(self.meta.logit(meta))

    def score(self, text: Rows, meta: Rows) -> np.ndarray:
        return _sigmoid(self.mix @ np.stack([self.text.logit(text), self.meta.logit(meta), np.ones(text.n)]))


SIZES = {"text": 1 << WORD_BITS, "meta": 1 << META_BITS}


def fit_views(views: dict[str, Rows], y: np.ndarray, held: np.ndarray, taught: dict[str, tuple[Rows, np.ndarray]], before: Model | None) -> Model | None:
    """Both views on the rows that are not held out and what the other view taught; None if a class is missing among the rows trained on or held out."""
    if not len(y) or len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        return None
    train, test = y[~held], y[held]
    fitted, logits = {}, []
    for k, rows in views.items():
        more, labels = taught.get(k, (Rows([]), np.empty(0)))
        again = {"start": getattr(before, k), "steps": AGAIN, "rate": 0.1} if before else {}
        v = fitted[k] = fit(Rows.join([rows.take(~held), more]), np.r_[train, labels], SIZES[k], **again)
        hold = rows.take(held)
        calibrate(v, v.margin(hold), test)
        logits.append(v.logit(hold))
        v.weights = v.weights.astype(np.float32)
    x = np.stack([*logits, np.ones(len(test))])
    mix = np.array([0.5, 0.5, 0.0])
    for _ in range(50):  # combination of the calibrated views, with a small penalty
        p = _sigmoid(mix @ x)
        mix = mix - np.clip(np.linalg.solve((x * (p * (1 - p))) @ x.T + 0.05 * np.eye(3), x @ (p - test) + 0.05 * (mix - np.array([0.5, 0.5, 0]))), -1, 1)
    return Model(fitted["text"], fitted["meta"], mix, threshold(_sigmoid(mix @ x), test), float(train.mean()))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``PART`` bytes of text, or one row: features take many times the memory of their texts.

    Words are remembered for these batches only, as the worker outlives them.
    """
    try:
        for b in batches:
            at = 0
            for p in slices(pa.RecordBatch.from_arrays([b.column("text").cast(pa.string())], names=["text"]), "text", PART):
                yield b.slice(at, p.num_rows)
                at += p.num_rows
    finally:
        _slots.clear()


def _features(b: pa.RecordBatch) -> tuple[Rows, Rows]:
    """Both views of a batch with text, and source and lang if it has them."""
    get = lambda c: b.column(c).cast(pa.string()).to_pylist() if c in b.schema.names else [None] * b.num_rows
    texts = b.column("text").cast(pa.string()).fill_null("")
    raw = texts.cast(pa.binary()).to_pylist()
    return text_rows(texts), Rows([meta_features(t, s, g) for t, s, g in zip(raw, get("source"), get("lang"), strict=True)])


_STORED = "ti binary, tv binary, mi binary, mv binary"


@lean
def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of documents, a row for each; all columns but those of the document stay."""
    for b in _parts(batches):
        cols: list[list[bytes]] = []
        for rows in _features(b):
            ends = np.searchsorted(rows.of, np.arange(rows.n + 1))
            cols += [[x[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)] for x in (rows.idx, rows.val)]
        kept = [c for c in b.schema.names if c not in ("text", "source", "lang")]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(c, pa.binary()) for c in cols)], names=[*kept, "ti", "tv", "mi", "mv"])


def _fitter(models: dict[str, Model | None] | None):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """One model from its sample: rows with a view are pseudo-labels for that view."""
        name = key[0].as_py()
        found = rows.sort_by([("doc_id", "ascending"), ("view", "ascending")]).to_pylist()
        load = lambda rs, a, b: Rows([(np.frombuffer(r[a], np.int32), np.frombuffer(r[b], np.float32)) for r in rs])
        known = [r for r in found if r["view"] is None]
        views = {"text": load(known, "ti", "tv"), "meta": load(known, "mi", "mv")}
        held = np.array([xxhash.xxh3_64_intdigest(str(r["doc_id"])) % 4 == 0 for r in known], bool)
        taught = {}
        for v, (a, b) in {"text": ("ti", "tv"), "meta": ("mi", "mv")}.items():
            mine = [r for r in found if r["view"] == v]
            taught[v] = (load(mine, a, b), np.array([r["label"] for r in mine], float))
        m = fit_views(views, np.array([r["label"] for r in known], float), held, taught, models and models[name])
        return pa.table([pa.array([name], pa.string()), pa.array([pickle.dumps(m)], pa.binary())], names=["model", "fitted"])

    return run


def _sure(models: dict[str, Model | None]):
    """(doc_id, model, view, label) wherever one view is sure enough to teach the other."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            text, meta = _features(b)
            out: list[list] = [[], [], [], []]
            ids = b.column("doc_id").to_numpy()
            for name, m in models.items():
                for view, p in zip(("meta", "text"), m.views(text, meta) if m else (), strict=False):
                    for label, sure in ((0, p <= 1 - SURE), (1, p >= SURE)):
                        some = ids[sure].tolist()
                        for c, v in zip(out, (some, [name] * len(some), [view] * len(some), [label] * len(some)), strict=True):
                            c += v
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "model", "view", "label"])

    return run


def train(docs: DataFrame, labels: DataFrame, good: dict[str, Column], labelled: int = LABELLED, rounds: int = ROUNDS, tmp: Scratch | None = None) -> dict[str, Model | None]:
    """A model per entry of ``good``, fitted on at most ``labelled`` labelled documents, those with the smallest hashes of their ids."""
    spark = docs.sparkSession
    tmp = tmp or Scratch(spark)
    texts = _views(docs).where("doc_id is not null")
    marks = [F.min(c.cast("int")).alias(n) for n, c in good.items()]
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*marks)
    known = tmp.keep(known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi").where(F.coalesce(*good).isNotNull()), "labels")
    sample = F.broadcast(known.orderBy(F.xxhash64(F.col("doc_id"), F.lit(7))).limit(labelled))  # at most ``labelled`` rows
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(n).alias("label")) for n in good])).alias("p")
    given = texts.join(sample, "doc_id").dropDuplicates(["doc_id"]).mapInArrow(_stored, f"doc_id long, {', '.join(f'`{n}` int' for n in good)}, {_STORED}")
    given = tmp.keep(given, "sample").select("doc_id", "ti", "tv", "mi", "mv", pairs).select("doc_id", "p.model", "p.label", F.lit(None).cast("string").alias("view"), "ti", "tv", "mi", "mv").where("label is not null")
    models: dict[str, Model | None] | None = None
    rows = given
    for r in range(rounds + 1):
        fitted = rows.groupBy("model").applyInArrow(_fitter(models), "model string, fitted binary")
        # a model without any label has no group
        models = {n: None for n in good} | {x.model: pickle.loads(x.fitted) for x in tmp.keep(fitted, "models").collect()}  # noqa: S301
        if r == rounds or not any(models.values()):
            return models
        # labelled documents are scored too and leave as rows of four small columns: no text is dealt out for that
        sure = texts.mapInArrow(_sure(models), "doc_id long, model string, view string, label int").distinct()
        sure = tmp.keep(hot_join(sure, known.select("doc_id"), ["doc_id"], "left_anti"), "sure")
        share = F.coalesce(*[F.when(F.col("model") == n, F.when(F.col("label") == 1, m.share).otherwise(1 - m.share)) for n, m in models.items() if m])
        w = Window.partitionBy("model", "view", "label").orderBy(F.xxhash64(F.col("doc_id"), F.lit(r)), "doc_id")
        most = CONFIDENT * (r + 1)
        chosen = sure.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).where(F.col("k") <= F.greatest(F.lit(1.0), share * most)).drop("k")
        chosen = tmp.keep(chosen, "pseudo-labels")
        ids = F.broadcast(chosen.select("doc_id").distinct())  # at most four times ``most`` per model
        taught = tmp.keep(texts.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_stored, f"doc_id long, {_STORED}"), "pseudo-features")
        rows = given.unionByName(chosen.join(taught, "doc_id").select(*given.columns))
    return models


def _views(docs: DataFrame) -> DataFrame:
    cast = lambda c: (F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(c)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), cast("source"), cast("lang"))


def score(docs: DataFrame, models: dict[str, Model | None]) -> DataFrame:
    """``docs`` with ``<name>_score`` for every model and ``keep``: no score lies below its model's threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    names = list(models)
    taken = set(docs.columns)
    own = {n: next(c for c in (f"{n}_score", *(f"{n}_score_{i}" for i in range(len(taken) + 1))) if c not in taken) for n in names}
    keep = next(c for c in ("keep", *(f"keep_{i}" for i in range(len(taken) + 1))) if c not in taken)
    extra = [pa.field(own[n], pa.float64()) for n in names] + [pa.field(keep, pa.bool_())]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            text, meta = _features(b)
            good = np.ones(b.num_rows, bool)
            cols = []
            for n in names:
                m = shared.value[n]
                p = m.score(text, meta) if m else np.full(b.num_rows, np.nan)
                good &= ~(p < m.threshold) if m else True
                cols.append(pa.array(p, pa.float64(), mask=np.isnan(p)))
            yield pa.RecordBatch.from_arrays([*b.columns, *cols, pa.array(good, pa.bool_())], schema=pa.schema([*b.schema, *extra]))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"`{own[n]}` double" for n in names] + [f"`{keep}` boolean"])
    return docs.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row and column of ``docs(doc_id, text, source, lang, ...)`` with quality_score, clean_score and keep.

    ``labels(doc_id, quality, toxic)`` has 1 for good quality and 1 for toxic; one model is fitted for each. Missing
    labels, and a missing source or lang column, are allowed; a doc_id that is labelled twice counts as the worse. If a
    class has no labelled document, that model rejects nothing and its scores are null. Null counts as empty text. Equal
    rows get equal scores; columns of ``docs`` with the names of new ones stay, and the new ones get a number.
    """
    return score(docs, train(docs, labels, {"quality": F.col("quality") == 1, "clean": F.col("toxic") == 0}))
