from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from plumbline.llm import prefix_trie as p
from plumbline.llm.prefix_trie import Graft


def brute(rows: list[tuple], graft: Graft | None) -> set[tuple]:
    turns: dict[int, list] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % graft.heads if graft else 0
        base = c - int(np.fmod(c, graft.span)) if graft else c
        built[c] = tuple(turns.get(base, [])[:h] + own[h:]) if base != c else tuple(own)
    members: dict[tuple, list[int]] = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children: dict[tuple, list] = {k: [] for k in members}
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = (len(members[k]) - 1) * words + sum(saved[x] for x in children[k])
    out = set()
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if built[c] == k)
        parent = min(members[k[:-1]]) if k else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.add((min(m), len(k), parent, len(m), len(children[k]), leaves[k], saved[k], digest))
    assert len(out) == len(members)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)


def random_rows(seed: int, convs: range, longest: int) -> list[tuple]:
    rng = random.Random(seed)
    texts = [None, "", "one", "two words", "a b c\x1fd", "x  y\tz"]
    rows = []
    for c in convs:
        if rng.random() < 0.8:
            rows += [(c, i, rng.choice(["user", "user", "assistant", None]), rng.choice(texts[: rng.choice([1, 3, 6])])) for i in range(rng.randrange(1, longest))]
    return rows


@pytest.mark.parametrize("graft", [None, Graft(), Graft(span=7, heads=3)])
@pytest.mark.parametrize("most_cells", [p.MOST_CELLS, 8])
def test_equals_brute_force(spark, graft, most_cells, monkeypatch):
    """With few cells many estimates are too high, below prefixes proved alone too."""
    monkeypatch.setattr(p, "ROWS_AT_ONCE", 5)
    rows = random_rows(1, range(-30, 150), 7)
    rows += [(None, 0, "user", "lost"), *rows[:9], (500, None, "b", "late"), (500, None, "a", "first"), (500, 1, "a", "x")]
    rows += [(600 + i, j, "user", f"copy {j}") for i in range(40) for j in range(30)]  # one path, many members
    got = p.prefix_trie(frame(spark, rows), graft, most_cells=most_cells)
    assert got.columns == p.NODE
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows, graft)


def test_a_full_sketch_shuffles_everything_and_changes_nothing(spark, monkeypatch):
    rows = random_rows(2, range(60), 6)
    monkeypatch.setattr(p, "screened", lambda t, bits, real=p.screened: real(t, np.full_like(bits, 255)))
    assert {tuple(r) for r in p.prefix_trie(frame(spark, rows), Graft()).collect()} == brute(rows, Graft())


def test_estimates_are_never_too_low(spark):
    rows = random_rows(5, range(300), 6)
    table = p.prefixes(frame(spark, rows)).cache()
    for most in (8, 1 << 12, 1 << 20):
        marked = p.screened(table, p.sketch(table, table.count(), most)).collect()
        times: dict = {}
        for r in marked:
            times[bytes(r.node)] = times.get(bytes(r.node), 0) + 1
        assert all(times[bytes(r.node)] == 1 for r in marked if r.alone)
        assert all(r.parent is None or times[bytes(r.parent)] == 1 for r in marked if r.parent_alone)
    assert sum(r.alone for r in marked) == sum(n == 1 for n in times.values())  # a wide sketch screens all singletons


def test_one_conversation_turnless_ones_and_empty_tables(spark):
    only = frame(spark, [(7, 0, "user", "hi there")])
    assert {tuple(r) for r in p.prefix_trie(only).collect()} == brute([(7, 0, "user", "hi there")], None)
    turnless = [(c, 0, "user", "x") for c in range(101, 120)]  # no conversation 100: short ones keep nothing
    assert {tuple(r) for r in p.prefix_trie(frame(spark, turnless), Graft()).collect()} == brute(turnless, Graft())
    assert p.prefix_trie(only.limit(0)).count() == 0
    named = only.selectExpr("conv_id id", "turn at", "role who", "text said", "1 node", "2 depth", "3 conv_id")
    assert p.prefix_trie(named, conv_id="id", turn="at", role="who", text="said").count() == 2


def test_long_and_repeated_conversations(spark):
    rows = [(c, i, "user", f"turn {i}") for c in (1, 2) for i in range(4000)] + [(3, i, "user", "y") for i in range(4000)]
    got = {tuple(r) for r in p.prefix_trie(frame(spark, rows)).collect()}
    assert len(got) == 8001
    root = next(r for r in got if r[1] == 0)
    assert root[:7] == (1, 0, None, 3, 2, 2, 8000)
