"""Secrets in texts: fixed patterns, and random strings that a subword vocabulary cannot compress.

Natural words and identifiers made of words have long entries in the vocabulary; random strings fall apart into pieces of
one or two characters. A candidate is a run of key characters; digests of well-known lengths, UUIDs, account numbers,
and runs of digits (numbers, dates, versions; digits alone have about the same characters per token whatever they say)
are taken out first; what has few characters per token is a span of kind ``random``, with or without digits. Words with
signs between them are measured without the signs, and are none if most of them are entries of the vocabulary. Spans of the fixed patterns stay whatever the test says.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import text_or_empty

CHARS_PER_TOKEN = 2.0
KINDS = ("assign", "access", "hex", "random")

#: Fixed patterns of the base kinds, and the words one of which every assignment contains.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("passw", "secret", "token", "api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Known digests (md5, sha1, sha224, sha256, sha384, sha512 in hexadecimal) and identifiers.
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
IDENTIFIERS = re.compile(r"(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})|[A-Z]{2}[0-9]{13,32}|[0-9]+(?:[-_/+=]+[0-9]+)*|[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T_][0-9]{2}-?[0-9]{2}(?:-?[0-9]{2})?Z?")
#: Words and numbers with signs between them, as in paths and names; without the signs they are measured.
SEGMENTS = re.compile(r"(?:[A-Za-z]+|[0-9]{1,8})(?:[-_/+=]+(?:[A-Za-z]+|[0-9]{1,8}))+")

_loaded: dict[str, tiktoken.Encoding] = {}


def _encoding(path: str) -> tiktoken.Encoding:
    if path not in _loaded:
        import public_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, kinds numbered as in ``KINDS``; whole matches, in code points."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def is_random(s: str, enc: tiktoken.Encoding, most: float = CHARS_PER_TOKEN) -> bool:
    core = s.strip("=+/_-")
    if len(core) < 16 or DIGEST.fullmatch(core) or IDENTIFIERS.fullmatch(core):
        return False
    if not SEGMENTS.fullmatch(core):
        return len(core) <= most * len(enc.encode_ordinary(core))
    parts = [(len(w), len(enc.encode_ordinary(w))) for w in re.split("[-_/+=]+", core)]
    size = sum(c for c, _ in parts)
    return size < 2 * sum(c for c, n in parts if n > 1) and size <= most * sum(n for _, n in parts)


def _missed(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that overlap none of ``base``; both are sorted by start, and one pass over them suffices."""
    out, at, reach = [], 0, 0  # reach: the furthest end of the base spans that begin before this span's end
    for x in spans:
        while at < len(base) and base[at][0] < x[2]:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= x[0]:
            out.append(x)
    return out


def _scan(path: str, most: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(path)
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                base = sorted(base_spans(t))
                more = _missed([(m.start(), 3, m.end()) for m in CANDIDATE.finditer(t) if is_random(m.group(), enc, most)], base)
                show = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                row = (doc, *n, hashlib.sha256(show(base).encode()).hexdigest(), show(sorted(base + more)))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def secret_scan(docs: DataFrame, ranks: str, chars_per_token: float = CHARS_PER_TOKEN) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` for every row of ``docs(doc_id, text, ...)``.

    ``spans`` lists kind:start:end by start and kind; ``base_sha256`` is the digest of the list without the random ones
    (of the empty string, if there are none). Null counts as empty. Repeated rows give a row each; a null doc_id stays
    null. Extra columns are ignored; empty gives empty. ``ranks`` is a tiktoken rank file.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return texts.mapInArrow(_scan(ranks, chars_per_token), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
