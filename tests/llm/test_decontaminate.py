from __future__ import annotations

import pickle
import random
import re

from plumbline.llm import decontaminate as d


def words(text: str | None) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(text: str | None, items: list[tuple[int, str | None]]) -> tuple[int, set[int], list[str], int]:
    w, hit, found, longest = words(text), set(), set(), 0
    for item, other in items:
        v = words(other)
        n = min(10, len(v))
        for q in range(len(v) - n + 1 if v else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[q : q + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(item))
                    m = n
                    while p + m < len(w) and q + m < len(v) and w[p + m] == v[q + m]:
                        m += 1
                    longest = max(longest, m)
    return len(w), hit, sorted(found), longest


def check(spark, docs, items, **options):
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.contamination for r in d.contamination(frame, bench, **options).collect()}
    assert len(got) == len(docs)
    for i, text in enumerate(docs):
        n, hit, found, longest = brute(text, items)
        assert got[i].n_words == n
        assert {p for a, b in got[i].spans for p in range(a, b)} == hit
        assert sorted(got[i]["items"]) == found and got[i].longest == longest


def test_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["a", "b", "Cé", "d9", "漢"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, make(rng.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(12)] + [(7, None), (99, "zz yy"), (99, "xx")]
    items = [x for x in items if len(words(x[1])) != 1] + [(50, "solo")]
    docs = [make(rng.choice([0, 5, 30, 200])) for _ in range(40)] + [None, "", "- - -", "zz YY", "say Solo!"]
    docs += [f"{make(20)}-{items[4][1]}_{make(5)}", items[3][1] * 3]
    check(spark, docs, items)
    check(spark, docs, items, block_bytes=60)  # several blocks


def test_long_repeated_and_nameless_items(spark):
    rng = random.Random(9)
    make = lambda n: " ".join(rng.choice(["a", "b", "c", "d9", "é"]) for _ in range(n))
    long, often, nameless = make(300), make(12), "no id has this one"
    items = [(1, long)] + [(i, often) for i in range(2, 40)]
    docs = [f"x {long} y", f"z {' '.join(long.split()[40:140])} z", f"{make(3)} {often}", f"see {nameless}!", make(50)]
    check(spark, docs, items)
    check(spark, docs, items, block_bytes=100)
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame([*items, (None, nameless), (None, often)], "item_id long, text string")
    got = {r.doc_id: r.contamination for r in d.contamination(frame, bench, block_bytes=100).collect()}
    assert got[3].spans == [[1, 6]] and got[3]["items"] == [] and got[3].longest == 5
    assert sorted(got[2]["items"]) == sorted(str(i) for i in range(2, 40))
    assert {r.doc_id for r in d.clean_documents(frame, bench).collect()} <= {4}


def test_memory_follows_the_words_of_an_item():
    text = " ".join(map(str, range(50_000))).encode()
    tests = d.TestSuffixes([("1", text)], 10)
    assert len(pickle.dumps(tests)) < 8_000_000
    assert d.search_shard([d.words_of(text)], tests) == [(50_000, [[0, 50_000]], ["1"], 50_000)]


def test_shards_of_any_size_agree(spark, monkeypatch):
    docs = [b"p q r s t u v w x y z".split(), [], b"q r s t u v w x y z k l".split()] * 3
    tests = d.TestSuffixes([("1", b"p q r s t u v w x y z"), ("2", b"k l")], 10)
    whole = d.search_shard(docs, tests)
    assert whole == [x for doc in docs for x in d.search_shard([doc], tests)]
    assert whole[0] == (11, [[0, 11]], ["1"], 11) and whole[2] == (12, [[0, 12]], ["1", "2"], 10)


def test_odd_rows_and_empty_tables(spark, odd_documents):
    bench = spark.createDataFrame([(1, "one two three"), (2, None), (None, "one")], "item_id long, text string")
    got = d.contamination(odd_documents.withColumnRenamed("lang", "contamination"), bench)
    assert got.columns.count("contamination") == 1 and "n_words" in got.columns
    hit = [r.doc_id for r in got.collect() if r.contamination["items"]]
    assert sorted(hit, key=str) == sorted([4, 4, 5, None], key=str)
    assert d.contamination(odd_documents.limit(0), bench).count() == 0
    assert d.clean_documents(odd_documents, bench.limit(0)).count() == odd_documents.count()
    assert d.clean_documents(odd_documents, bench).columns == odd_documents.columns
