"""Hierarchical packing of documents into training sequences of several lengths.

Documents are tokenised where they are read, each followed by an end id, and packed there; nothing is shuffled. What is
longer than the longest window fills whole windows. Each rest goes to the smallest tier (256, 512, 1024, 2048) that
holds it. The tiers are packed from the longest down: a rest opens a window of its tier, the largest shorter rests that
fit fill the gap, and the last gap is filled by cutting one more. What a batch cannot complete waits for the next batch;
at the end of a partition it is poured into windows in one run, so that at most one sequence of a partition is padded.
Sequences of one tier form step groups of equal token counts.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetlens.llm.common import text_or_empty

WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 16 * WINDOW  # of one step group
END_ID = 1
CHUNKS = 400_000  # remembered chunks of text, and as many words

#: The fixed pre-token pattern of the vocabulary.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_NOT_SPACE_THERE = "\x1c\x1d\x1e\x1f"  # white space for str.split, but not for the tokenizer


_BEYOND_LATIN_1 = re.compile("[^\x00-\xff]")


class Ids(dict):
    """Chunk of text without white space -> its token ids, as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.special = tuple(t.content for t in self.tok.get_added_tokens_decoder().values())
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}

    @staticmethod
    def raw(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def by_library(self, text: str) -> bytes:
        return self.raw(self.tok.encode(text, add_special_tokens=False).ids)

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > CHUNKS:
            self.clear()
        # beyond Latin-1, and for special strings, the library normalises and splits
        if chunk.isascii() and chunk.isalpha():
            out = self.word(chunk.lower())
        elif _BEYOND_LATIN_1.search(chunk) or any(s in chunk for s in self.special):
            out = self.by_library(chunk)
        else:
            out = b"".join(map(self.word, PATTERN.findall(chunk.lower())))
        self[chunk] = out
        return out

    def word(self, w: str) -> bytes:
        got = self.words.get(w)
        if got is None:
            if len(self.words) > CHUNKS:
                self.words.clear()
            got = self.words[w] = self.raw([t.id for t in self.tok.model.tokenize(w.encode().decode("latin-1").translate(self.alphabet))])
        return got

    def document(self, text: str) -> bytes:
        if any(c in text for c in _NOT_SPACE_THERE):
            return self.by_library(text)
        return b"".join(map(self.__getitem__, text.split()))


assert unicodedata.is_normalized("NFC", "".join(map(chr, range(256))))  # why Latin-1 chunks need no normalisation

_loaded: dict[str, Ids] = {}


class Packer:
    """Packs rests ``(doc, start, ids, doc_tokens)``; ``emit`` gets the finished sequences, lists of pieces."""

    def __init__(self, emit):
        self.emit = emit
        self.tiers: dict[int, list[tuple[int, int]]] = {w: [] for w in TIERS}  # sorted (length, number of the item)
        self.held: list[tuple] = []
        self.items: dict[int, tuple] = {}
        self.count = 0

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        n = len(ids) // 4
        at = 0
        while n - at >= WINDOW:
            self.emit(WINDOW, [(doc, start + at, ids[4 * at : 4 * (at + WINDOW)], total)])
            at += WINDOW
        if n > at:
            self.put((doc, start + at, ids[4 * at :], total))

    def put(self, item: tuple) -> None:
        n = len(item[2]) // 4
        self.items[self.count] = item
        insort(self.tiers[next(w for w in TIERS if w >= n)], (n, self.count))
        self.count += 1

    def take(self, most: int) -> tuple | None:
        """The longest waiting rest of at most ``most`` tokens."""
        for w in reversed(TIERS):
            rests = self.tiers[w]
            i = bisect_right(rests, (most, self.count))
            if i:
                return self.items.pop(rests.pop(i - 1)[1])
        return None

    def shortest(self, over: int, below: int) -> tuple | None:
        """The shortest waiting rest of more than ``over`` tokens in tiers up to ``below``: the one that is cut."""
        for w in TIERS:
            rests = self.tiers[w]
            i = bisect_left(rests, (over + 1, -1))
            if w <= below and i < len(rests):
                return self.items.pop(rests.pop(i)[1])
        return None

    def pack(self) -> None:
        for w in reversed(TIERS):
            waiting = []
            while self.tiers[w]:
                pieces = [self.items.pop(self.tiers[w].pop()[1])]
                gap = w - len(pieces[0][2]) // 4
                while gap:
                    more = self.take(gap)
                    if more is None:
                        long = self.shortest(gap, w)
                        if long is None:
                            break
                        more = (long[0], long[1], long[2][: 4 * gap], long[3])
                        self.put((long[0], long[1] + gap, long[2][4 * gap :], long[3]))
                    pieces.append(more)
                    gap -= len(more[2]) // 4
                if gap:
                    waiting.append(pieces)
                else:
                    self.emit(w, pieces)
            for pieces in waiting:  # no filler is left below this tier
                self.held.extend(pieces)
        for item in self.held:
            self.put(item)
        self.held = []

    def finish(self) -> None:
        """Pours all rests into windows; a last window that stays open shrinks to the tiers below, and its end is padded."""
        self.pack()
        flow = [self.items[k] for w in reversed(TIERS) for _, k in self.tiers[w]]
        left = sum(len(i[2]) // 4 for i in flow)
        pieces: list[tuple] = []
        room = 0
        for doc, start, ids, total in flow:
            n, at = len(ids) // 4, 0
            while at < n:
                if not room:
                    room = size = next((w for w in reversed(TIERS) if w <= left), left)  # what is left at the end is padded
                k = min(room, n - at)
                pieces.append((doc, start + at, ids[4 * at : 4 * (at + k)], total))
                at, room, left = at + k, room - k, left - k
                if not room:
                    self.emit(size if size in TIERS else WINDOW, pieces)
                    pieces = []


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def _packed(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if path not in _loaded:
            _loaded[path] = Ids(path)
        ids = _loaded[path]
        base = TaskContext.get().partitionId() << 36
        out: list[tuple] = []
        state = {"sequence": base, "group": base}
        groups: dict[int, tuple[int, int]] = {}

        def emit(size: int, pieces: list[tuple]) -> None:
            group, room = groups.get(size, (0, 0))
            if room < size:
                group, room = state["group"], STEP_TOKENS
                state["group"] += 1
            groups[size] = (group, room - size)
            offset = 0
            for doc, start, raw, total in pieces:
                n = len(raw) // 4
                out.append((doc, start, n, zlib.crc32(raw), total, state["sequence"], offset, size, group) + ((raw,) if with_ids else ()))
                offset += n
            state["sequence"] += 1

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()] + [pa.binary()] * with_ids
            names = [c.split()[0] for c in SCHEMA.split(", ")] + ["ids"] * with_ids
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        packer = Packer(emit)
        end = END_ID.to_bytes(4, "little")
        for b in batches:
            for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                raw = ids.document(t) + end
                packer.add(doc, 0, raw, len(raw) // 4)
            packer.pack()
            yield flush()
        packer.finish()
        yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document in a sequence, with ``with_ids`` also the ids themselves.

    A document is its ids by the tokenizer file, without added special tokens, and the end id; null and empty texts are
    the end id alone. ``start`` counts the document's ids before the piece, ``offset`` the sequence's. A sequence of
    fewer tokens than its tier is padded to the longest window. Rows that repeat a doc_id, or have none, are packed as
    documents of their own. Extra columns are ignored; empty gives empty.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return texts.mapInArrow(_packed(tokenizer, with_ids), SCHEMA + (", ids binary" if with_ids else ""))
