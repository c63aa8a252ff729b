"""Hard negatives, conversation repair and benchmark decontamination against brute force, and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest

from fleetlens.llm import contamination, negatives, repair

VECTORS = "vec_id long, embedding array<float>, label int"
TURNS = "conv_id long, turn long, role string, text string"


# ---- hard negatives
def negatives_by_hand(rows, anchors):
    def sound(i, v, label):
        return i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)

    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], label) for i, v, label in rows if sound(i, v, label)]
    asked = {}
    for i, v, label in anchors:
        if sound(i, v, label):
            x = ([int(np.floor(256 * float(np.float32(c)))) for c in v], label)
            asked[i] = min(asked.get(i, x), x)
    out = set()
    for i, (v, label) in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, l) for j, w, l in good if j != i)
        for s, j in [(s, j) for s, j, l in scored if l == label][:5]:
            window = [(t, k) for t, k, l in scored if l != label and 50 * -s <= 100 * -t <= 95 * -s]
            out |= {(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(window[:3])}
    return out


def test_hard_negatives_against_brute_force(spark, frame):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-6, 9, 5) / 16).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(300)]  # many ties
    rows += [(300 + i, rows[50][1], i % 3) for i in range(60)]  # a hot vector
    rows += [(400, None, 1), (401, [0.5, None], 1), (450, [float("nan")] * 5, 1), (451, [float("inf")], 0), (452, [0.25], 1), (453, [], 2), (350, [0.5] * 5, None), (100, rows[3][1], 2), (100, rows[4][1], 0), (None, [1.0], 1)]
    df = frame(rows, VECTORS, "shard int, score long, anchor_id long, slot int").repartition(5)
    out = [(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in negatives.hard_negatives(df, df.where("vec_id % 50 = 0")).collect()]
    want = negatives_by_hand(rows, [r for r in rows if r[0] is not None and r[0] % 50 == 0])
    assert sorted(out) == sorted(want) and len(want) > 40
    empty = frame([], VECTORS, "shard int")
    assert negatives.hard_negatives(empty, empty).count() == 0
    assert negatives.hard_negatives(df, empty).count() == 0


# ---- conversation repair
def damage_by_hand(rows):
    out = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out += [(c, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def repair_by_hand(rows):
    """Known grammar, straight recursion over positions: least (cost, letters)."""
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append(((t is not None, t or 0), " " if role is None else role, " " if text is None else text))
    out = {}
    for c, g in groups.items():
        g.sort()
        seen, faults = set(), []
        for _, role, text in g:
            solid = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        moves = {"": "su", "s": "u", "u": "a", "a": "u"}

        @cache
        def best(i, state, room, g=g, faults=faults, moves=moves):
            options = []
            if i == len(g) and state in ("", "a"):
                options.append((0, "", ()))
            if room:
                for x in moves[state]:
                    if x != "s":
                        cost, letters, lines = best(i, x, room - 1)
                        options.append((cost + 3, "I" + letters, (f"{'user' if x == 'u' else 'assistant'}:", *lines)))
            if i < len(g):
                cost, letters, lines = best(i + 1, state, 2)
                options.append((cost + 4, "D" + letters, lines))
                if faults[i] not in ("blank", "duplicate"):
                    more = 3 * (faults[i] == "truncated")
                    _, role, text = g[i]
                    for x in moves[state]:
                        cost, letters, lines = best(i + 1, x, 2)
                        if role[:1] == x:
                            options.append((cost + more, "K" + letters, (f"{role}:{text}", *lines)))
                        if x != "s":
                            options.append((cost + more + 3, "R" + letters, (f"{'user' if x == 'u' else 'assistant'}:{text}", *lines)))
            return min(options, default=(10**9, "", ()))

        for i in range(len(g), 0, -200):
            best(max(0, i - 200), "", 2)  # shallow recursion for long conversations
        cost, letters, lines = best(0, "", 2)
        turns = [t[1] for t, *_ in g if t[0]]
        first = [role[:1] for _, role, _ in g]
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                  sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False)), cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(df, ids=None, **kw):
    return {r.conv_id: tuple(r)[1:] for r in repair.repair(df, ids, **kw).collect()}


def random_turns(rng, convs, most):
    texts = ["One.", "Two!", "three", "four? ", " ", "", "Five.\n", "six,", None, "Zwölf ☃."]
    return [(c, t if rng.random() < 0.9 else rng.choice([None, t + 2]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts) if rng.random() < 0.4 else f"Text {rng.random()}.")
            for c in range(convs) for t in range(rng.randint(0, most))]


@pytest.mark.parametrize("most", [8192, 7])
def test_repair_against_recursion(frame, most):
    rng = random.Random(most)
    rows = random_turns(rng, 150, 9) + [(900, t, "user" if t % 2 else "assistant", f"A {t}.") for t in range(60)] + [(901, t % 3, "user", "same") for t in range(80)] + [(None, 1, "user", "no id."), (None, None, None, None)]
    rows += [(902, t, ["user", "user", "system", "assistant", "x"][rng.randint(0, 4)], rng.choice([f"B {t}.", f"B {t}", "again."])) for t in range(90)]
    df = frame(rows, TURNS, "symbol int, slice long, n long, fault string, conv string").repartition(3)
    got, want = repaired(df, slice_rows=most), repair_by_hand(rows)
    assert got == want


def test_repair_after_damage(frame):
    rows = random_turns(random.Random(5), 200, 12)
    df = frame(rows, TURNS, "kind int, copy int")
    got, hurt = repaired(repair.damaged(df), df), damage_by_hand(rows)
    want = repair_by_hand(hurt)
    gone = {r[0] for r in rows} - set(want)
    assert {c: got[c] for c in want} == want and set(got) == set(want) | gone
    assert all(got[c] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone)


def test_repair_long_runs_and_empty(frame):
    rows = [(1, t, "user", f"{t}.") for t in range(3000)] + [(2, t, "assistant" if t % 2 else "user", f"{t}") for t in range(1500)] + [(3, 0, "user", "x." * 100_000), (3, 1, "assistant", "y.")]
    got = repaired(frame(rows, TURNS, "n long"), slice_rows=400)
    assert (got[1][5], got[1][6]) == (4500, "KR" * 1500)
    assert (got[2][5], got[2][6]) == (4500, "K" * 1500)
    assert got[3][6] == "KK" and got[3][7] == hashlib.sha256(("user:" + "x." * 100_000 + "\nassistant:y.").encode()).hexdigest()
    assert repaired(frame([], TURNS, "n long")) == {}


def test_repair_powers():
    for symbol in range(9):
        step = repair.power(symbol, 0)
        slow = np.where(np.eye(4, dtype=bool), 0, repair.INF)
        for n in range(1, 40):
            slow = repair.times(step, slow)
            assert (repair.advance(symbol, n, np.where(np.eye(4, dtype=bool), 0, repair.INF)) == slow).all()


# ---- benchmark decontamination
def split(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits_by_hand(docs, items, width, slack):
    out = []
    wins = [(i, w[k : k + width]) for i, t in items for w in [split(t)] if w for k in range(max(1, len(w) - width + 1))]
    for doc, t in docs:
        w = split(t)
        hit, ids, near = set(), set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    ids.add(i)
            if any(set(win) <= set(w[k : k + len(win) + slack]) for k in range(len(w))):
                near.add(i)
        names = sorted(str(i) for i in ids if i is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit), len(near)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_contamination_against_brute_force(frame):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice(["a", "b", "ab", "C", "d9", "é", "Ω", "zz"]) + rng.choice([" ", ", ", "\n", "-", "  ", "\x7f"]) for _ in range(n))
    items = [(i, text(rng.randint(0, 9))) for i in range(25)] + [(3, "a b"), (None, "ab zz a"), (30, None), (31, ""), (32, "..."), (33, "never seen word"), (10, "AB, Zz!")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(120)] + [(5, "a b"), (None, "ab zz a ab zz a"), (None, None), (200, None), (201, ""), (202, " \t.\x00"), (5, "a b"), (203, "xx " * 30_000 + "AB-zz a")]
    docs += [(300 + i, "ab") for i in range(200)] + [(600, "zz")]  # neighbours whose words must not meet
    d = frame([(i, t, "en", "s") for i, t in docs], "doc_id long, text string, lang string, source string", "chunk long, place int, n_words long, item_id long, words long")
    b = frame(items, "item_id long, text string", "words long, chunk long")
    for width, slack in ((4, 2), (10, 5), (1, 0)):
        got = [tuple(r) for r in contamination.contaminated(d.repartition(3), b, width=width, slack=slack).collect()]
        assert order(got) == order(hits_by_hand(docs, items, width, slack)), (width, slack)
    none = contamination.contaminated(d, b.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.contaminated or r.n_near_items for r in none)
    assert contamination.contaminated(d.limit(0), b).count() == 0


def test_index_is_read_again(spark, frame):
    from fleetlens.llm.common import Scratch

    tmp = Scratch(spark)
    index = contamination.build_index(frame([(1, "the cat sat on the mat"), (2, "the mat, the cat")], "doc_id long, text string"), tmp)
    found = lambda *items: sorted((r.item_id, r.first_word, r.words, r.exact) for r in contamination.matches(index, frame(list(items), "item_id string, text string"), slack=1, tmp=tmp).collect())
    exact = lambda *items: [r[:3] for r in found(*items) if r[3]]
    assert exact(("x", "The Cat")) == [("x", 0, 2), ("x", 2, 2)]
    assert exact(("y", "on the"), ("z", "cat mat")) == [("y", 3, 2)]


def test_chunks_are_bounded():
    import pyarrow as pa

    from fleetlens.llm.common import slices

    b = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4, 5]), pa.array(["aaaa", "bbbb", "c" * 30, None, "dd"])], names=["doc_id", "text"])
    assert [p.column("doc_id").to_pylist() for p in slices(b, "text", 10)] == [[1, 2], [3], [4, 5]]
