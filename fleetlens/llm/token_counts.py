"""Token counts without token ids: each distinct pre-token is counted once.

1. Every task counts in how many of its documents a unit between spaces occurs, and splits each distinct unit into
   pre-tokens once; the sums give all distinct pre-tokens and how widespread they are.
2. The library counts the pieces of each distinct pre-token once.
3. Per document, pre-token frequencies meet these counts. The most widespread pre-tokens (at most ``HEAD`` of them, a
   bounded table) are looked up where the document is read; every other pre-token travels as a row (document, pre-token,
   frequency) to a join. The sum of frequency times pieces is the document's number of tokens.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetlens.llm.common import Scratch, hot_join, slices, split_words, text_or_empty

HEAD = 400_000  # pre-tokens that every worker holds
LIMIT = 1024
FLUSH = 600_000  # distinct units that a task gathers before it passes their pre-tokens on
UNITS = 500_000  # remembered units of text
LONG_UNIT = 64  # longer ones are not remembered
PART = 8_000_000  # bytes of texts that are split at once

#: The fixed pre-token pattern of the vocabulary.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SIGNS = frozenset(".,;:!?")
#: White space before a space, a space or a zero byte at either end or inside: the units between spaces are then not independent.
_UNEVEN = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] |^ | \z|\x00"
_SPACES = np.arange(256).astype(np.uint8)
_SPACES[32] = 0


def pre_tokens(unit: str) -> list[str]:
    """What the pattern finds in a unit; letters alone, and letters before one sign, need no pattern."""
    body = unit[1:] if unit[:1] == " " else unit
    if body.isalpha():
        return [unit]
    if body[-1:] in SIGNS and body[:-1].isalpha():
        return [unit[:-1], unit[-1]]
    return PATTERN.findall(unit)


class Pieces:
    """Frequencies of pre-tokens in a text, and pieces in a pre-token, as the tokenizer file defines them."""

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        # the byte alphabet of the vocabulary: printable Latin-1 stands for itself, other bytes follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Pre-tokens, and the number of special strings, each of which is one token."""
        special = 0
        parts = [text]
        if self.cut and any(s in text for s in self.special):
            parts = self.cut.split(text)
            special = len(parts) - 1
        out: Counter = Counter()
        for p in parts:
            out.update(PATTERN.findall(p))
        return out, special

    def count(self, pre_token: str) -> int:
        return len(self.tok.model.tokenize(pre_token.encode().decode("latin-1").translate(self.alphabet)))


    def units(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct units of texts; row, unit and number of each distinct pair; the rows that must be split as a whole.

        A unit is what lies up to the next space, with the space before it. In other texts no pre-token crosses its ends.
        """
        whole = pc.match_substring_regex(texts, _UNEVEN)
        for x in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, x))
        found, number = split_words(pc.if_else(whole, pa.scalar("", texts.type), texts), _SPACES)
        if not len(found):
            none = np.empty(0, np.int64)
            return [], none, none, none, np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        coded = found.dictionary_encode()
        code = 2 * coded.indices.to_numpy().astype(np.int64) + 1
        code[np.append(0, np.cumsum(number)[:-1])[number > 0]] -= 1  # the first unit has no space before it
        size = 2 * len(coded.dictionary)
        pairs, times = np.unique(np.repeat(np.arange(len(texts)), number) * size + code, return_counts=True)
        code = pairs % size
        here = np.zeros(size, bool)
        here[code] = True
        used = np.flatnonzero(here)
        unit = (np.cumsum(here) - 1)[code]
        words = coded.dictionary.cast(pa.large_string() if pa.types.is_large_binary(coded.dictionary.type) else pa.string()).to_pylist()
        return [(" " if c & 1 else "") + words[c >> 1] for c in used.tolist()], pairs // size, unit, times, np.flatnonzero(whole.to_numpy(zero_copy_only=False))


_loaded: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _spread(path: str):
    """Pre-tokens and about how many documents of this task hold them."""

    def flush(units: Counter, seen: Counter) -> pa.RecordBatch:
        for u, n in units.items():
            for x in pre_tokens(u):
                seen[x] += n
        return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["piece", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(path)
        units: Counter = Counter()
        seen: Counter = Counter()
        for b in batches:
            for part in slices(b, "text", PART):
                texts = part.column("text")
                names, _, unit, _, whole = p.units(texts)
                units.update(dict(zip(names, np.bincount(unit, minlength=len(names)).tolist(), strict=True)))
                for i in whole.tolist():
                    seen.update(p.frequencies(texts[i].as_py())[0].keys())
                if len(units) + len(seen) > FLUSH:
                    yield flush(units, seen)
                    units, seen = Counter(), Counter()
        yield flush(units, seen)

    return run


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("piece"), b.column("docs"), pa.array([p.count(x) for x in b.column("piece").to_pylist()], pa.int64())], names=["piece", "docs", "n"])

    return run


def _documents(path: str, head):
    """A row for each document with the sum over the head; a row for each other pre-token in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        p, table = _pieces(path), head.value
        known: dict[str, tuple[int, tuple[str, ...]]] = {}  # pieces of a unit in the head, and its other pre-tokens
        nothing: tuple[str, ...] = ()

        def split(u: str) -> tuple[int, tuple[str, ...]]:
            pieces = [(x, table.get(x)) for x in pre_tokens(u)]
            out = (sum(n for _, n in pieces if n is not None), tuple(x for x, n in pieces if n is None) or nothing)
            if len(u) <= LONG_UNIT:
                known[u] = out
            return out

        start = TaskContext.get().partitionId() << 40
        for b in batches:
            for part in slices(b, "text", PART):
                if len(known) > UNITS:
                    known.clear()
                texts = part.column("text")
                names, doc, unit, times, whole = p.units(texts)
                found = [known.get(u) or split(u) for u in names]
                total = np.bincount(doc, np.array([n for n, _ in found], float)[unit] * times if len(found) else None, minlength=len(texts)).astype(np.int64)
                # other pre-tokens of each unit, then of each pair of document and unit
                rare = [x for _, xs in found for x in xs]
                many = np.array([len(xs) for _, xs in found], np.int64)
                first = np.cumsum(many) - many
                each = many[unit] if len(found) else np.empty(0, np.int64)
                place = np.repeat(first[unit] - np.cumsum(each) + each, each) + np.arange(int(each.sum())) if len(found) else np.empty(0, np.int64)
                rows, piece, f = [np.repeat(doc, each)], [pa.array(rare, pa.string()).take(pa.array(place))], [np.repeat(times, each)]
                for i in whole.tolist():
                    freq, special = p.frequencies(texts[i].as_py())
                    total[i] += special + sum(n * table[x] for x, n in freq.items() if x in table)
                    others = [x for x in freq if x not in table]
                    rows.append(np.full(len(others), i))
                    piece.append(pa.array(others, pa.string()))
                    f.append(np.array([freq[x] for x in others], np.int64))
                k = len(texts)
                row, n = np.concatenate([np.arange(k), *rows]) + start, sum(len(x) for x in rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row), pa.concat_arrays([part.column("doc_id"), pa.nulls(n, pa.int64())]), pa.concat_arrays([pc.binary_length(texts).cast(pa.int64()), pa.nulls(n, pa.int64())]),
                    pa.concat_arrays([pa.nulls(k, pa.string()), *piece]), pa.array(np.concatenate([total, *f]).astype(np.int64))], names=["row", "doc_id", "n_bytes", "piece", "f"])
                start += k

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, tmp: Scratch | None = None) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row of ``docs(doc_id, text, ...)``.

    The numbers are those of the tokenizer file without added special tokens, truncation or padding; special strings
    inside a text are one token each, the library's default. Null counts as empty: 0 bytes, 0 tokens. Rows that repeat a
    doc_id or text, or have a null doc_id, each give their own row. Extra columns are ignored; empty gives empty.
    """
    spark = docs.sparkSession
    tmp = tmp or Scratch(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    pieces = texts.select("text").mapInArrow(_spread(tokenizer), "piece string, docs long").groupBy("piece").agg(F.sum("docs").alias("docs"))
    pieces = tmp.keep(pieces.mapInArrow(_count(tokenizer), "piece string, docs long, n long"), "pieces")
    # smallest spread at which at most HEAD pre-tokens remain: few rows, one for each power of two
    level = F.floor(F.log2("docs")).cast("int")
    least, have = 64, 0
    for lv, k in sorted(((r[0], r[1]) for r in pieces.groupBy(level.alias("lv")).count().collect()), reverse=True):
        if have + k > HEAD:
            break
        least, have = lv, have + k
    common = pieces.where(level >= least).select("piece", "n")
    head = spark.sparkContext.broadcast({r[0]: r[1] for r in common.toLocalIterator()})
    rare = pieces.where(level < least).select("piece", "n")

    rows = texts.mapInArrow(_documents(tokenizer, head), "row long, doc_id long, n_bytes long, piece string, f long")
    # rows of documents get a key that no pre-token equals, so that they are dealt out evenly
    rows = rows.withColumn("main", F.col("piece").isNull()).withColumn("piece", F.coalesce("piece", F.concat(F.lit("\x00 "), F.col("row").cast("string"))))
    n = F.when(F.col("main"), F.lit(1)).otherwise(F.col("n"))
    out = hot_join(rows, rare, ["piece"]).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("f") * n).alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
