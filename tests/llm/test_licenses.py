from __future__ import annotations

import math
from collections import Counter

from plumbline.llm import licenses as c


def brute_cosine(words: list[bytes], template: list[bytes], idf, other: float) -> float:
    a = {w: n * idf.get(w, other) for w, n in Counter(words).items()}
    b = {w: n * idf[w] for w, n in Counter(template).items()}
    norm = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    return sum(x * b.get(w, 0) for w, x in a.items()) / norm if norm else 0.0


def test_best_equals_all_cosines(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(["the license of the work", "free of rights", None, ""])], "doc_id long, text string")
    vocabulary = {w for forms in c.TEMPLATES.values() for f in forms for w in c.terms(f.encode())}
    total, frequencies = c.document_frequencies(frame, vocabulary)
    assert total == 4 and frequencies[b"of"] == 2 and frequencies[b"work"] == 1
    matcher = c.Matcher(c.TEMPLATES, total, frequencies, 0.4)
    lines = ["All rights reserved", "rights reserved by nobody", "under the MIT License", "the of", "zzz", ""]
    lines += [f for forms in c.TEMPLATES.values() for f in forms]
    for line in lines:
        words = c.terms(line.encode())
        scores = [
            (-brute_cosine(words, c.terms(f.encode()), matcher.idf, matcher.other), n) for n, forms in c.TEMPLATES.items() for f in forms
        ]
        best = min((round(s, 9), n) for s, n in scores)
        got = matcher.best(words)
        if -best[0] >= 0.4:
            assert math.isclose(got[0], -best[0], abs_tol=1e-6) and got[1] == best[1]
        else:
            assert got == (0.0, "")


def test_lines_inheritance_and_ties(spark):
    rows = [
        ("r/LICENSE", "Released under the MIT License."),
        ("r/a/LICENSE", "x y z\nAll rights reserved."),
        ("r/a/COPYING", "All rights reserved."),
        ("r/a/b/one.txt", "nothing here"),
        ("r/a/b/two.txt", "some words\nLicensed under the Apache License, Version 2.0.\nmore words"),
        ("r/c/three.txt", None),
        ("r/ab/four.txt", ""),
        ("s/five.txt", "words"),
        ("six.txt", "words"),
        (None, "words"),
        ("r/c/three.txt", None),
    ]
    frame = spark.createDataFrame(rows, "path string, text string").repartition(3)
    got = Counter((r.path, r.license, r.line, r.effective, r.origin) for r in c.inherit(c.scan(frame)).collect())
    assert got == Counter(
        [
            ("r/LICENSE", "MIT", 1, "MIT", "own"),
            ("r/a/LICENSE", "Proprietary", 2, "Proprietary", "own"),
            ("r/a/COPYING", "Proprietary", 1, "Proprietary", "own"),
            ("r/a/b/one.txt", None, None, "Proprietary", "/r/a"),
            ("r/a/b/two.txt", "Apache-2.0", 2, "Apache-2.0", "own"),
            ("r/c/three.txt", None, None, "MIT", "/r"),
            ("r/c/three.txt", None, None, "MIT", "/r"),
            ("r/ab/four.txt", None, None, "MIT", "/r"),
            ("s/five.txt", None, None, None, None),
            ("six.txt", None, None, None, None),
            (None, None, None, None, None),
        ]
    )


def test_odd_rows(spark, odd_documents):
    frame = odd_documents.withColumnRenamed("n_words", "license").withColumnRenamed("lang", "path")
    found = c.inherit(c.scan(frame))
    assert found.count() == odd_documents.count() and found.columns.count("license") == 1
    assert {r.effective for r in found.collect()} == {None}
    assert c.inherit(c.scan(frame.limit(0))).count() == 0
