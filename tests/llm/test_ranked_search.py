from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import ranked_search as s


def terms(text: str | None) -> list[str]:
    found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in found]


def brute(docs: list[tuple], items: list[tuple], top: int) -> list[tuple]:
    held = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c, n in held:
            m = 75 + (25 * n * n_docs) // total
            score = 0
            for t, times in Counter(terms(text)).items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, (doc is not None, doc or 0), doc))
        out += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def check(spark, docs, items, top=3, **options):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame(items, "item_id string, text string").repartition(2)
    got = s.top_documents(frame, asked, top, **options)
    assert got.dtypes == [("item_id", "string"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, top)


def corpus(rng: random.Random, n: int) -> tuple[list, list]:
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    make = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    docs = [(i, make(rng.choice([0, 1, 5, 40, 200]))) for i in range(n)]
    items = [(f"i{k}", make(rng.choice([1, 4, 30]))) for k in range(25)]
    docs += [(n + i, f"{make(3)} {items[i % 5][1]} {make(10)}") for i in range(40)]
    return docs, items


@pytest.mark.parametrize("rows", [7, 1 << 14])
def test_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(s, "BUCKET_ROWS", rows)
    monkeypatch.setattr(s, "BUCKET_POSTINGS", 300 if rows == 7 else 1 << 20)
    docs, items = corpus(random.Random(rows), 500)
    check(spark, docs, items, seeds=20)


def test_odd_rows_ties_and_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(s, "PIECE", 16)
    docs, items = corpus(random.Random(1), 60)
    docs += [docs[30], docs[30], (None, docs[30][1]), (7, None), (8, ""), (9, "- !"), (-5, "Élan É1 one-TWO three" * 9)]
    docs += [(100 + i, "the same copy") for i in range(50, 0, -1)] + [(3, "x" * 70_000 + " solo " * 900)]
    items += [items[0], (None, "élan É1 ONE two"), ("n", None), ("e", ""), ("none", "absent"), ("c", "same same copy"), ("s", "solo")]
    check(spark, docs, items, top=20)
    check(spark, docs, items, top=20, block_bytes=9000, seeds=5)


def test_bounds_prune_and_long_copies_do_not_hide_others(spark):
    """Buckets in order of length: the first sets the threshold, the bounds then leave little to score."""
    rng = np.random.default_rng(0)
    items = s.Items([([b"rare", b"common"], [1, 1])])
    items.weigh(4000, 400_000, {0: 20, 1: 3000})
    best = s.Best([0], 20)

    def bucket(n, impact, has_rare):
        terms = np.concatenate([np.array([0, 1] if has_rare else [1], dtype=np.int32)] * n)
        sizes = np.full(n, 2 if has_rare else 1)
        impacts = rng.integers(impact // 2, impact, len(terms)).astype(np.int64)
        rows = np.repeat(np.arange(n), sizes)
        length = np.sqrt(np.bincount(rows, weights=(impacts * items.root[terms]) ** 2))
        return s.search_bucket(items, best, np.arange(n), np.ones(n, bool), length, np.cumsum(sizes), terms, impacts)

    assert bucket(20, 800_000, True)["scored"] == 20
    assert bucket(2000, 800_000, False) in ({"coordinates": 1}, {"buckets": 1})
    assert bucket(2000, 1000, True) == {"buckets": 1}


def test_empty_tables_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x")], "id int, body string, score int, rank string")
    items = spark.createDataFrame([(4, "b c", 1)], "key long, said string, doc_id int")
    names = {"doc_id": "id", "text": "body", "item_id": "key", "item_text": "said"}
    assert [tuple(r)[:3] for r in s.top_documents(docs, items, **names).collect()] == [(4, 1, 1)]
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        empty = s.top_documents(d, i, **names)
        assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]
