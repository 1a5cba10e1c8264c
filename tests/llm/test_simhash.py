from __future__ import annotations

import random
import re

import xxhash

from plumbline.llm import simhash


def brute_fingerprint(text: str | None, n: int = 4) -> int:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows: list[tuple[int | None, str | None]], radius: int = 4) -> set[tuple]:
    codes = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x: int) -> int:
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius:
                group[find(i)] = find(j)
    least: dict[int, int | None] = {}
    for i, (doc, _) in enumerate(rows):
        known = [x for x in (least.get(find(i)), doc) if x is not None]
        least[find(i)] = min(known, default=None)
    return {(doc, f"{codes[i]:016x}", least[find(i)]) for i, (doc, _) in enumerate(rows)}


def test_components_equal_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(120):
        base = [rng.choice(words) for _ in range(rng.choice([3, 4, 30, 90]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            if rng.random() < 0.6:
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = brute(rows)
    assert len({r[2] for r in expected}) < len(rows)
    for tile in (7, simhash.TILE):
        got = simhash.near_duplicates(frame, tile=tile).collect()
        assert {tuple(r) for r in got} == expected
        assert len(got) == len(rows)


def test_chain_of_fingerprints_is_one_component(spark):
    """A chain longer than any star step reaches at once, its ends 60 bits apart."""
    codes = [(1 << i) - 1 for i in range(0, 61, 4)]
    prints = spark.createDataFrame([(c,) for c in codes], "fingerprint long")
    roots = simhash.components(simhash.links(prints, 4, 3)).collect()
    assert {r.node for r in roots} == set(codes) - {0}
    assert {r.root for r in roots} == {0}


def test_tiles_of_dense_groups_return_stars(spark):
    import numpy as np

    near = np.array([(1 << i) | (1 << j) for i in range(40) for j in range(i)], dtype=np.int64)
    a, b = simhash.link_tiles(near, None, 4)
    assert len(a) == len(near) - 1 and len(set(b.tolist())) == 1


def test_odd_rows(spark, odd_documents):
    got = simhash.near_duplicates(odd_documents).collect()
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    assert {tuple(r) for r in got} == brute(rows)
    assert len(got) == len(rows)
    assert simhash.near_duplicates(odd_documents.limit(0)).collect() == []


def test_first_of_each_keeps_one_row_and_all_columns(spark, odd_documents):
    kept = simhash.first_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(0) == 1 and ids.count(4) == 1 and 1 not in ids and 5 not in ids and ids.count(None) == 1
