from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import suffix_dedup as s


def brute(texts: list[str | None], length: int) -> list[tuple[int, list[list[int]], str]]:
    octets = [(t or "").encode() for t in texts]
    times = Counter(b[i : i + length] for b in octets for i in range(len(b) - length + 1))
    out = []
    for b in octets:
        hit = [False] * len(b)
        for i in range(len(b) - length + 1):
            if times[b[i : i + length]] > 1:
                hit[i : i + length] = [True] * length
        runs, i = [], 0
        while i < len(b):
            j = i
            while j < len(b) and hit[j] == hit[i]:
                j += 1
            if hit[i]:
                runs.append([i, j])
            i = j
        out.append((len(b), runs, hashlib.sha256(bytes(x for x, h in zip(b, hit, strict=True) if not h)).hexdigest()))
    return out


def planted(rng: random.Random, letters: str, n: int, size: int, passages: int, longest: int) -> list[str]:
    make = lambda k: "".join(rng.choice(letters) for _ in range(k))
    shared = [make(rng.randrange(2, longest)) for _ in range(passages)]
    texts = []
    for _ in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else make(rng.randrange(size)) for _ in range(rng.randrange(5))]
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize(("length", "gram", "letters"), [(12, 3, "ab"), (20, 6, "abcd"), (24, 8, "aé\x00"), (200, 32, "abcdefgh ")])
def test_equals_brute_force(spark, length, gram, letters):
    rng = random.Random(length)
    texts = planted(rng, letters, 60, 3 * length, 6, 3 * length)
    texts += [texts[3], texts[3], None, "", "a" * (5 * length), "ab" * length, "x" * (length - 1), "x" * (length - 1)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    expected = brute(texts, length)
    got = s.find_repeats(frame, length=length, gram=gram).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_bytes, r.removed, r.kept_sha256) == expected[r.doc_id]
    assert any(e[1] for e in expected)


@pytest.mark.parametrize("segment", [1, 7, 64])
def test_segments_change_nothing(spark, segment):
    rng = random.Random(segment)
    texts = planted(rng, "abcd", 30, 150, 5, 60)
    texts += ["".join(rng.choice("abcdefgh") for _ in range(900)), texts[2], "a" * 100, None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    expected = brute(texts, 20)
    for r in s.find_repeats(frame, length=20, gram=6, segment=segment).collect():
        assert (r.n_bytes, r.removed, r.kept_sha256) == expected[r.doc_id]


def test_text_longer_than_a_segment(spark):
    rng = random.Random(5)
    make = lambda k: rng.randbytes(-(-k // 2)).hex()[:k]
    alone, passage = make(s.SEGMENT + 5000), "#" + make(600) + "#"
    cut = s.SEGMENT - 300
    held = "!" + alone[1 : cut] + passage + alone[cut:]
    frame = spark.createDataFrame([(0, make(s.SEGMENT + 5000)), (1, held), (2, passage)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.removed) for r in s.find_repeats(frame).collect()}
    assert got[0] == (s.SEGMENT + 5000, [])
    assert got[1] == (len(held), [[cut, cut + len(passage)]])
    assert got[2] == (len(passage), [[0, len(passage)]])


def test_anchors_depend_on_the_window_alone(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("ab") for _ in range(900)).encode()
    whole = s.anchors(text, 40, 8)
    decided = {w: int(p) for p, _, f, l in zip(*whole, strict=True) for w in range(f, l + 1)}
    assert sorted(decided) == list(range(900 - 40 + 1))
    for w, place in decided.items():
        assert int(s.anchors(text[w : w + 40], 40, 8)[0][0]) == place - w
    monkeypatch.setattr(s, "SEGMENT", 64)
    cut = s.anchors(text, 40, 8)
    assert {w: int(p) for p, _, f, l in zip(*cut, strict=True) for w in range(f, l + 1)} == decided


def test_multikey_quicksort_orders_rows():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, (3000, 9)).astype(np.uint64)
    order = s.multikey_quicksort(words)
    assert sorted(order.tolist()) == list(range(3000))
    assert words[order].tolist() == sorted(words.tolist())


def test_odd_rows(spark, odd_documents):
    frame = odd_documents.withColumnRenamed("n_words", "removed")
    got = s.find_repeats(frame)
    assert got.columns.count("removed") == 1
    rows = got.collect()
    texts = [r.text for r in rows]
    assert len(rows) == odd_documents.count()
    assert [(r.n_bytes, r.removed, r.kept_sha256) for r in rows] == brute(texts, 200)
    assert s.find_repeats(frame.limit(0)).count() == 0
