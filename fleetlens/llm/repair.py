"""Repair of the structure of conversations: least edits to a grammar by a run-length dynamic program.

A conversation must read ``(s?(ua)+)?`` by the initials of its roles. Every row is a symbol of role and fault; a symbol's
step is a 4 x 4 min-plus matrix over the states of the grammar (start, after s, after u, after a), insertions included.

1. Equal rows of one turn become one row with a number; flags are columns. The rows are dealt out by ranges of
   (conversation, turn, role, text) and sorted, so that also a conversation that holds a third of all rows spreads over
   many tasks. The sorted rows are cut into slices of bounded size.
2. In a slice, equal consecutive symbols are collapsed to runs. A run advances by cached binary powers of its symbol's
   matrix; the product over its runs is the slice's matrix.
3. Only conversations at the edge of a slice may go on in the next one. For these (at most two a slice) the matrices of a
   conversation's slices, 4 x 4 numbers each, give the least cost that is left at the end of every slice.
4. Each slice unrolls its choices: at every row the first of D, I, K, R that keeps the least cost. Slices of an edge
   conversation do so from each state they may begin in, and a chain over the slices picks.
5. The chosen edits meet the texts of the slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import Scratch, hot_join

SLICE_ROWS, SLICE_BYTES = 8192, 8_000_000
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
INF = 1 << 60

START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: By state: what an initial leads to.
MOVES = ({"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U})
GONE = 8  # the symbol of a row that must go; others: 2 * position of the initial in KINDS, plus 1 if truncated
KINDS = "uas?"


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product of a matrix with a matrix or a vector."""
    if b.ndim == 1:
        return np.minimum((a + b).min(axis=1), INF)
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), INF)


def _insertions() -> np.ndarray:
    one = np.full((4, 4), INF)
    for i, to in enumerate(MOVES):
        one[i, i] = 0
        for c in to:
            if c in ROLES:
                one[i, to[c]] = INSERT
    return times(one, one)  # two insertions lead to every state that any number of them leads to


def edits(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, next state, cost) of what may be done with a row, without insertions."""
    yield "D", state, DELETE
    if symbol != GONE:
        kind, more = KINDS[symbol // 2], TRUNCATED * (symbol % 2)
        if kind in MOVES[state]:
            yield "K", MOVES[state][kind], more
        for c in ROLES:
            if c in MOVES[state]:
                yield "R", MOVES[state][c], REROLE + more


INSERTIONS = _insertions()
#: Least cost from a state at the end.
END = np.array([0 if s in (START, AFTER_A) else min(int(INSERTIONS[s, t]) for t in (START, AFTER_A)) for s in range(4)], np.int64)


@cache
def power(symbol: int, k: int) -> np.ndarray:
    """The matrix of 2 ** k equal symbols."""
    if k:
        half = power(symbol, k - 1)
        return times(half, half)
    op = np.full((4, 4), INF)
    for s in range(4):
        for _, to, cost in edits(symbol, s):
            op[s, to] = min(op[s, to], cost)
    return times(INSERTIONS, op)


def advance(symbol: int, n: int, after: np.ndarray) -> np.ndarray:
    """``n`` equal symbols before ``after``: a vector of least costs, or a matrix."""
    k = 0
    while n:
        if n & 1:
            after = times(power(symbol, k), after)
        n >>= 1
        k += 1
    return after


def unroll(runs: list[tuple[int, int]], state: int, after: np.ndarray, last: bool) -> tuple[str, int]:
    """Letters of the edits from ``state`` on, the ASCII-least of the cheapest, and the state at the end.

    ``after`` holds the least costs behind the runs. Insertions behind the last row belong to the next slice, or to this
    one if it is the ``last``.
    """
    bounds = [after]
    for symbol, n in reversed(runs):
        bounds.append(advance(symbol, n, bounds[-1]))
    out: list[str] = []
    for (symbol, n), rest in zip(runs, bounds[-2::-1], strict=True):
        known: dict[int, list[tuple[str, int]]] = {}
        for left in range(n - 1, -1, -1):
            # the costs behind a run's rows soon differ by a constant only: choices are remembered by state and differences
            behind = advance(symbol, left, rest)
            key = (state, *(behind - behind.min()).tolist())
            if key not in known:
                known[key] = _choice(symbol, state, behind)
            letters, state = known[key]
            out.append(letters)
    if last:
        while after[state]:
            c = "u" if "u" in MOVES[state] else "a"
            out.append("I")
            state = MOVES[state][c]
    return "".join(out), state


def _choice(symbol: int, state: int, behind: np.ndarray) -> tuple[str, int]:
    """Insertions and the edit of one row, with the least cost, the ASCII-least of these."""
    letters = ""
    best = int(times(power(symbol, 0), behind)[state])
    while True:
        options = {letter: (to, cost) for letter, to, cost in edits(symbol, state) if cost + behind[to] == best}
        if "D" in options:
            return letters + "D", options["D"][0]
        c = next(c for c in MOVES[state] if c in ROLES)
        to = MOVES[state][c]
        if INSERT + int(times(power(symbol, 0), behind)[to]) == best:
            letters, state, best = letters + "I", to, best - INSERT
            continue
        letter = "K" if "K" in options else "R"
        return letters + letter, options[letter][0]


def repaired_lines(letters: str, state: int, rows: list[tuple[str, str, int]]) -> tuple[list[str], int]:
    """``role:text`` of what the edits leave of ``rows`` (role, text, number of equal rows)."""
    out, at = [], iter([(r, t) for r, t, n in rows for _ in range(n)])
    for x in letters:
        role, text = (None, "") if x == "I" else next(at)
        if x == "D":
            continue
        if x == "K":
            c = role[:1]
        else:
            c = next(c for c in MOVES[state] if c in ROLES)
            role = ROLES[c]
        out.append(f"{role}:{text}")
        state = MOVES[state][c]
    return out, state


# ---- Spark side

_PLACED = "slice long, place int, conv string, turn long, role string, text string, n long, symbol int, fault string"


def _place(most: int):
    """Cuts the sorted rows of a partition into slices of at most ``most`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        now, rows, size = TaskContext.get().partitionId() << 32, 0, 0
        for b in batches:
            slices, places = [], []
            for length in pc.binary_length(b.column("text")).to_pylist():
                if rows >= most or size >= SLICE_BYTES:
                    now, rows, size = now + 1, 0, 0
                slices.append(now)
                places.append(rows)
                rows, size = rows + 1, size + length
            yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), pa.array(places, pa.int32()), *b.columns], names=["slice", "place", *b.schema.names])

    return run


def _groups(rows: pa.Table) -> Iterator[tuple[str, dict[str, list]]]:
    """Conversations of a slice, each with its columns in order of place."""
    rows = rows.sort_by("place")
    cols = {c: rows.column(c).to_pylist() for c in rows.column_names}
    conv = cols["conv"]
    cuts = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield conv[a], {c: v[a:b] for c, v in cols.items()}


def _illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


_SUMMARY = "conv string, slice long, edge boolean, symbols binary, numbers binary, matrix array<long>, initial string, final string, blank long, duplicate long, truncated long, illegal long"


def _summaries(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    out: dict[str, list] = {c.split()[0]: [] for c in _SUMMARY.split(", ")}
    groups = list(_groups(rows))
    for i, (conv, g) in enumerate(groups):
        runs: list[list[int]] = []
        counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        illegal, before = 0, None
        for role, n, symbol, fault in zip(g["role"], g["n"], g["symbol"], g["fault"], strict=True):
            first = 1 if symbol != GONE else 0  # of equal rows of one turn, all but the first are duplicates
            for s, k in ((symbol, first), (GONE, n - first)):
                if k and runs and runs[-1][0] == s:
                    runs[-1][1] += k
                elif k:
                    runs.append([s, k])
            if fault:
                counts[fault] += first or n
            counts["duplicate"] += first and n - 1
            initial = role[:1]
            illegal += (before is not None and _illegal(before, initial)) + (n - 1) * _illegal(initial, initial)
            before = initial
        matrix = np.where(np.eye(4, dtype=bool), 0, INF)
        for s, k in reversed(runs):
            matrix = advance(s, k, matrix)
        row = {"conv": conv, "slice": key[0].as_py(), "edge": i in (0, len(groups) - 1), "symbols": bytes(s for s, _ in runs), "numbers": np.array([k for _, k in runs], np.int64).tobytes(),
               "matrix": matrix.ravel().tolist(), "initial": g["role"][0][:1], "final": before, "illegal": illegal, **counts}
        for c, v in row.items():
            out[c].append(v)
    kinds = {"edge": pa.bool_(), "symbols": pa.binary(), "numbers": pa.binary(), "matrix": pa.list_(pa.int64()), "conv": pa.string(), "initial": pa.string(), "final": pa.string()}
    return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})


def _backward(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """For every slice of a conversation: least costs behind it, whether it is the first or the last, and whether its border is illegal."""
    found = rows.sort_by("slice").to_pylist()
    after, out = END, []
    for i in range(len(found) - 1, -1, -1):
        r = found[i]
        border = int(i > 0 and _illegal(found[i - 1]["final"], r["initial"]))
        out.append((r["conv"], r["slice"], after.tolist(), i == 0, i == len(found) - 1, border))
        after = times(np.array(r["matrix"], np.int64).reshape(4, 4), after)
    cols = list(zip(*out, strict=True))
    kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.bool_(), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["conv", "slice", "after", "first", "last", "border"])


def _unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv", "slice", "edge", "cost", "letters", "ends"]
    for b in batches:
        out: list[list] = [[] for _ in names]
        for r in b.to_pylist():
            runs = list(zip(r["symbols"], np.frombuffer(r["numbers"], np.int64).tolist(), strict=True))
            alone = r["after"] is None  # not at an edge: the whole conversation
            after = END if alone else np.array(r["after"], np.int64)
            begins = [START] if alone or r["first"] else list(range(4))
            found = [unroll(runs, s, after, alone or r["last"]) for s in begins]
            cost = int(times(np.array(r["matrix"], np.int64).reshape(4, 4), after)[START]) if alone or r["first"] else 0
            for c, v in zip(out, (r["conv"], r["slice"], r["edge"], cost, [x for x, _ in found], [e for _, e in found]), strict=True):
                c.append(v)
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)


def _forward(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The state in which every slice of a conversation begins."""
    state, out = START, []
    for r in rows.sort_by("slice").to_pylist():
        out.append((r["conv"], r["slice"], state))
        state = r["ends"][state]
    cols = list(zip(*out, strict=True))
    return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int32()), strict=True)], names=["conv", "slice", "state"])


def _texts(key: tuple[pa.Scalar, ...], rows: pa.Table, chosen: pa.Table) -> pa.Table:
    """What is left of every conversation in a slice: its hash, or its text if it may go on in other slices."""
    by = {r["conv"]: r for r in chosen.to_pylist()}
    out: list[tuple] = []
    for conv, g in _groups(rows):
        r = by[conv]
        lines, _ = repaired_lines(r["letters"], r["state"], list(zip(g["role"], g["text"], g["n"], strict=True)))
        body = "\n".join(lines).encode()
        out.append((conv, r["slice"], None if r["edge"] else hashlib.sha256(body).hexdigest(), body if r["edge"] and lines else None))
    cols = list(zip(*out, strict=True))
    return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["conv", "slice", "sha", "body"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of conversations whose parts come in order: only the state of a hash is held."""
    conv, state, begun = None, None, False
    done: tuple[list, list] = ([], [])
    for b in batches:
        for c, body in zip(b.column("conv").to_pylist(), b.column("body").to_pylist(), strict=True):
            if state is None or c != conv:
                if state is not None:
                    done[0].append(conv)
                    done[1].append(state.hexdigest())
                conv, state, begun = c, hashlib.sha256(), False
            if body is not None:
                state.update(b"\n" + body if begun else body)
                begun = True
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in done], names=["conv", "whole"])
        done = ([], [])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], pa.string()), pa.array([state.hexdigest()], pa.string())], names=["conv", "whole"])


def damaged(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` after a fixed damage by crc32("conv_id:turn") % 20; nulls there, and null roles and texts, count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    role, text = space("role"), space("text")
    out = rows.select("conv_id", "turn", kind.alias("kind"), F.when(kind == 4, "user").otherwise(role).alias("role"),
                      F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"))
    return out.where("kind <> 0").withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def repair(rows: DataFrame, ids: DataFrame | None = None, slice_rows: int = SLICE_ROWS, tmp: Scratch | None = None) -> DataFrame:
    """One row per conversation of ``rows(conv_id, turn, role, text, ...)``, and per other conv_id of ``ids``: conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows go by turn, null turns first; rows of one turn by role and text. Null roles and texts count as one space. The first fault of a row counts: blank
    (white space only), duplicate (role and text seen earlier), truncated (the last character that is not white space is
    none of ``.!?``). ``gaps`` are the missing whole numbers between the first and the last turn; without turns 0, null if beyond 64 bits. ``illegal``
    counts neighbours whose initials are not su, ua or au. ``audit`` has the initials of the cheapest edits (Keep 0,
    Rerole 3, Delete 4, Insert 3; truncated rows that stay 3), ASCII-least of equal ones. A null conv_id is a
    conversation of its own. A conversation without rows has zeros, an empty audit and the hash of the empty string.
    Equal role and text are found by SHA-256. Extra columns are ignored; empty gives empty.
    A hash cannot be split: the repaired text of a conversation beyond one slice streams through one task, which holds one part at a time.
    """
    spark = rows.sparkSession
    tmp = tmp or Scratch(spark)
    conv = F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("conv")
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    base = rows.select(conv, F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    base = base.withColumn("h", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    # equal rows of one turn are one row with a number, which also keeps hot rows apart from the ranges
    once = tmp.keep(base.groupBy("conv", "turn", "h").agg(F.min("role").alias("role"), F.min("text").alias("text"), F.count(F.lit(1)).alias("n")), "rows")
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    again = tmp.keep(once.groupBy("conv", "h").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("turns")).where("turns > 1").select("conv", "h", F.col("f.turn").alias("seen")), "repeated")
    solid = F.regexp_replace("text", "[\\x20\\x09-\\x0D]+$", "")
    blank, late = F.length(solid) == 0, F.col("h2").isNotNull() & ~F.col("turn").eqNullSafe(F.col("seen"))
    cut = ~F.substring(solid, -1, 1).isin(".", "!", "?")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "u", 0).when(initial == "a", 2).when(initial == "s", 4).otherwise(6)
    rows_ = hot_join(once, again.withColumn("h2", F.col("h")), ["conv", "h"]).withColumn("fault", F.when(blank, "blank").when(late, "duplicate").when(cut, "truncated"))
    gone = F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False))
    rows_ = rows_.withColumn("symbol", F.when(gone, GONE).otherwise(kind + F.col("fault").isNotNull().cast("int")))
    rows_ = rows_.select("conv", "turn", "role", "text", "n", "symbol", "fault")
    keys = ["conv", "turn", "role", "text"]
    placed = tmp.keep(rows_.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_place(slice_rows), _PLACED), "placed")

    slim = placed.select("slice", "place", "conv", "role", "n", "symbol", "fault")
    summary = tmp.keep(slim.groupBy("slice").applyInArrow(_summaries, _SUMMARY), "slices")
    edge = summary.where("edge").select("conv", "slice", "matrix", "initial", "final")
    back = tmp.keep(edge.groupBy("conv").applyInArrow(_backward, "conv string, slice long, after array<long>, first boolean, last boolean, border long"), "edges")
    both = summary.join(back, ["conv", "slice"], "left")
    unrolled = both.select("conv", "slice", "edge", "symbols", "numbers", "matrix", "after", "first", "last").mapInArrow(_unrolled, "conv string, slice long, edge boolean, cost long, letters array<string>, ends array<int>")
    unrolled = tmp.keep(unrolled, "choices")
    states = unrolled.where("edge").select("conv", "slice", "ends").groupBy("conv").applyInArrow(_forward, "conv string, slice long, state int")
    state = F.coalesce("state", F.lit(START))
    chosen = unrolled.join(states, ["conv", "slice"], "left").select("conv", "slice", "edge", "cost", F.get("letters", state).alias("letters"), state.alias("state"))
    chosen = tmp.keep(chosen, "chosen")
    texts = placed.select("slice", "place", "conv", "role", "text", "n").groupBy("slice").cogroup(chosen.select("slice", "conv", "edge", "letters", "state").groupBy("slice"))
    texts = tmp.keep(texts.applyInArrow(_texts, "conv string, slice long, sha string, body binary"), "texts")
    parts = texts.where("sha is null").select("conv", "slice", "body").repartition("conv").sortWithinPartitions("conv", "slice")
    whole = parts.select("conv", "body").mapInArrow(_hashes, "conv string, whole string")

    counts = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    sums = both.groupBy("conv").agg(*counts, F.sum(F.col("illegal") + F.coalesce("border", F.lit(0))).alias("illegal"))
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slice", "letters"))), lambda x: x["letters"]), "")
    audits = chosen.groupBy("conv").agg(F.sum("cost").alias("cost"), pieces.alias("audit"))
    hashes = texts.where("sha is not null").select("conv", F.col("sha").alias("repaired_sha256")).unionByName(whole.select("conv", F.col("whole").alias("repaired_sha256")))
    turns = once.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.count("turn").alias("k"))
    gaps = F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(F.try_subtract(F.try_subtract("hi", "lo"), F.col("k") - 1))
    out = sums.join(audits, "conv").join(hashes, "conv").join(turns.select("conv", gaps.alias("gaps")), "conv")
    wanted = rows if ids is None else rows.select("conv_id").unionByName(ids.select("conv_id"))
    every = wanted.select(conv).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    gaps = F.when(F.col("cost").isNull(), F.lit(0).cast("long")).otherwise(F.col("gaps")).alias("gaps")
    return every.join(out, "conv", "left").select(
        F.nullif("conv", F.lit("")).cast("long").alias("conv_id"), gaps, zero("blank"), zero("duplicate"), zero("truncated"), zero("illegal"), zero("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def oracle() -> str:
    """The same in SQL: a recursion over the rows that carries cost, letters and text for each state of the grammar."""
    def add(x: str, cost: str, letter: str, line: str | None) -> str:
        body = f"{x}.b" if line is None else f"{x}.b || {line} || chr(10)"
        return f"{{'c': {x}.c + {cost}, 's': {x}.s || '{letter}', 'b': {body}}}"

    def least(*xs: str) -> str:
        return f"list_min([{', '.join(xs)}])"

    def when(test: str, x: str) -> str:
        return f"case when {test} then {x} else z end"

    u, a, w = "'user:'", "'assistant:'", "\\x20\\x09-\\x0D"
    ins = lambda x, role: add(x, "3", "I", role)
    twice = lambda x: f"{{'c': {x}.c + 6, 's': {x}.s || 'II', 'b': {x}.b || 'user:' || chr(10) || 'assistant:' || chr(10)}}"
    close = f"""y.z, y.t0 as i0, y.ts as js, {least("y.tu", ins("y.t0", u), ins("y.ts", u), ins("y.ta", u))} as iu, {least("y.ta", ins("y.tu", a), twice("y.t0"), twice("y.ts"))} as ia"""
    to_u = [x for s in ("i0", "js", "ia") for x in (when("not del and k = 'u'", add(s, "tr", "K", "line")), when("not del", add(s, "3 + tr", "R", "'user:' || text")))]
    to_a = [when("not del and k = 'a'", add("iu", "tr", "K", "line")), when("not del", add("iu", "3 + tr", "R", "'assistant:' || text"))]
    key = "coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')"
    return f"""
with recursive o as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  xor(list_reduce(list_prepend(4294967295, flatten([[ascii(x), -1, -1, -1, -1, -1, -1, -1, -1] for x in string_split({key}, '')])),
    lambda c, x: case when x >= 0 then xor(c, x) when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end), 4294967295) % 20 as kind from conversations),
d as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
  unnest(case when kind = 3 then [0, 1] else [0] end) as copy from o where kind <> 0),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, regexp_replace(text, '[{w}]+$', '') as solid from d),
g as (select *, substr(role, 1, 1) as k, case when solid = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
  when right(solid, 1) not in ('.', '!', '?') then 'truncated' else 'none' end as fault, lag(role) over (partition by conv_id order by i) as prev from n),
r as (select conv_id, i, k, text, fault in ('blank', 'duplicate') as del, case when fault = 'truncated' then 3 else 0 end as tr, role || ':' || text as line from g),
dp as (select distinct conv_id, 0::bigint as i, {{'c': 1000000000::bigint, 's': '', 'b': ''}} as z, {{'c': 0::bigint, 's': '', 'b': ''}} as t0, {{'c': 1000000000::bigint, 's': '', 'b': ''}} as ts,
    {{'c': 1000000000::bigint, 's': '', 'b': ''}} as tu, {{'c': 1000000000::bigint, 's': '', 'b': ''}} as ta from conversations
  union all select conv_id, i, z, {add("i0", "4", "D", None)}, {least(add("js", "4", "D", None), when("not del and k = 's'", add("i0", "tr", "K", "line")))},
    {least(add("iu", "4", "D", None), *to_u)}, {least(add("ia", "4", "D", None), *to_a)}
  from (select r.*, {close} from dp y join r on r.conv_id is not distinct from y.conv_id and r.i = y.i + 1)),
e as (select conv_id, {least("t0", "ta", ins("tu", a), twice("ts"))} as f from dp y qualify row_number() over (partition by conv_id order by i desc) = 1),
s as (select conv_id, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
  count(*) filter (fault = 'truncated') as truncated, count(*) filter (prev is not null and substr(prev, 1, 1) || k not in ('su', 'ua', 'au')) as illegal from g group by conv_id)
select e.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  f.c as cost, f.s as audit, sha256(substr(f.b, 1, greatest(len(f.b) - 1, 0))) as repaired_sha256 from e left join s on s.conv_id is not distinct from e.conv_id
"""
