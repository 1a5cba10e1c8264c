from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text, values
from plumbline.operators import leakage, reconcile


def tokens(spark, body):
    row = spark.createDataFrame([(body,)], "t string").select(text.number_tokens(F.col("t")).alias("n")).collect()[0]
    return [(t.raw, t.is_percent) for t in row.n]


@pytest.mark.parametrize(
    "body, want",
    [
        ("1,900 of 2000 at 95%", [("1900", False), ("2000", False), ("95", True)]),
        ("interval-2 and x7 and v1.2.3", []),
        ("on 08/07/2026 we saw 15/60", [("15", False), ("60", False)]),
        ("12 kg, 3mm, 4 hours, 5 h.", [("4", False)]),
        ("0.375 and 12.5 percent", [("0.375", False), ("12.5", True)]),
        ("-5 then 6", [("6", False)]),
        ("9" * 20 + " or 8", [("9" * 20, False), ("8", False)]),
        ("3-fold 10-20", []),
    ],
)
def test_number_tokens(spark, body, want):
    got = tokens(spark, body)
    if body == "3-fold 10-20":
        assert ("3", False) not in got and ("20", False) not in got
    else:
        assert got == want


def test_rate_readings(spark):
    df = spark.createDataFrame([("0.50 and 50 and 50% and 200",)], "t string")
    got = df.select(F.inline(text.rate_readings(text.number_tokens(F.col("t"))))).collect()
    assert [(r.raw, r.rate, round(r.tolerance, 6)) for r in got] == [("0.50", 0.5, 0.005), ("50", 0.5, 0.005), ("50", 0.5, 0.005)]


def twin_quantity(ints, rates):
    """Distinct readings by trying every role for every stated integer."""
    found = []
    for n, m, e in itertools.product(sorted(set(ints)), repeat=3):
        k = n - m
        if not (1 <= m < n and k in ints and 1 <= e <= m and min(ints) >= 0):
            continue
        roles = [n, m, k, e]
        if any(ints.count(v) < roles.count(v) for v in roles):
            continue
        for value, decimals in rates:
            tol = 0.5 * 10.0**-decimals + 1e-12
            sub, whole = abs(value - e / m) <= tol, abs(value - e / n) <= tol
            if sub != whole:
                found.append((n, m, k, e, "retained" if sub else "complete"))
    return found


def test_quantity_reconcile_matches_brute_force(spark):
    rng = random.Random(11)
    docs, want = [], {}
    for i in range(60):
        n = rng.randint(4, 40)
        m = rng.randint(1, n - 1)
        e = rng.randint(1, m)
        rate = round(e / (m if rng.random() < 0.5 else n), 3)
        ints = [n, m, n - m, e] + [rng.randint(1, 40) for _ in range(rng.randint(0, 3))]
        rng.shuffle(ints)
        docs.append((i, " then ".join(map(str, ints)) + f" with rate {rate:.3f} in all"))
        found = twin_quantity(ints, [(rate, 3)]) if 0 < rate <= 1 else []
        one = len({f[:4] for f in found}) == 1 and len({f[4] for f in found}) == 1
        want[i] = ("not_applicable" if not found else "applicable" if one else "ambiguous", found[0][4] if one and found else None, len(found))
    got = reconcile.quantity_reconcile(spark.createDataFrame(docs, "d int, t string"), "d", "t").collect()
    assert {r.d: (r.applicability, r.denominator, r.readings) for r in got} == want


def test_too_many_numbers_is_unsupported_not_partial(spark):
    body = " ".join(str(i) for i in range(1, 60)) + " rate 0.5"
    got = reconcile.quantity_reconcile(spark.createDataFrame([(1, body)], "d int, t string"), "d", "t").collect()[0]
    assert got.applicability == "unsupported"


def test_state_table_and_orientation(spark):
    df = spark.createDataFrame([(1, "states 10, 20 and 30 of 60 with mean 1.33 and sd 0.75"), (2, "nothing 5")], "d int, t string")
    got = {r.d: r for r in reconcile.state_table_reconcile(df, "d", "t").collect()}
    assert got[2].applicability == "not_applicable"
    assert got[1].tables >= 1
    panel = spark.createDataFrame([(1, "Of 200 markers 30 agree, 0.15."), (2, "Of 200 markers 30 agree, 85%."), (3, "200 and 100 agree 0.5")], "d int, t string")
    ways = {r.d: (r.applicability, r.orientation) for r in reconcile.orientation_reconcile(panel, "d", "t").collect()}
    assert ways == {1: ("applicable", "direct"), 2: ("applicable", "complement"), 3: ("not_applicable", None)}


def test_corroboration_counts_other_documents(spark):
    docs = spark.createDataFrame(
        [("p", 1, "10 7 3 2"), ("p", 2, "we saw 2 and 3, 7 of 10, also 99"), ("p", 3, "10 7 3"), ("q", 4, "10 7 3 2")], "project string, d int, t string"
    )
    numbers = reconcile.stated_numbers(docs, "d", "t").join(docs.select("project", "d"), "d")
    readings = docs.select("project", "d", *[F.lit(v).cast("long").alias(n) for n, v in (("complete", 10), ("retained", 7), ("removed", 3), ("events", 2))])
    got = {r.d: r.corroborating for r in reconcile.corroboration(readings, numbers, "d", "project").collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 0}


def test_leakage_is_exact_for_every_item_length(spark):
    rng = random.Random(4)
    vocabulary = ["alpha", "beta", "gamma", "de lta", "é", "zz", "a", "b\nc", "of", "the"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))) for i in range(80)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([1, 1, 2, 2, 3, 4, 5, 6, 8, 9])]
    items += [(100 + i, docs[i][1][3:40]) for i in range(8)] + [(200, "a"), (201, "lph"), (202, "")]
    got = leakage.contained_texts(
        spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    ).collect()
    want = {(d, i) for d, body in docs for i, needle in items if needle and needle in body}
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


def test_leakage_gives_a_text_and_an_item_once(spark):
    said = ["alpha beta gamma", "alpha beta gamma delta", "nothing", "alpha beta gamma"]
    docs = spark.createDataFrame([(1, t) for t in said], "doc_id int, text string")
    items = spark.createDataFrame([(i, "alpha beta gamma") for i in range(3)], "item_id int, text string")
    got = leakage.contained_texts(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, i) for i in range(3) for _ in range(3)]


def test_leakage_sees_through_normal_forms(spark):
    docs = spark.createDataFrame([(1, "one\r\ntwo café three four")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "one\ntwo café three")], "item_id int, text string")
    assert leakage.contained_texts(docs, items).count() == 1


def test_spans_and_claims(spark):
    body = "# Title\n\n  Dose increased growth relative to placebo. \nplain Dose DECREASED risk relative to none"
    spans = text.document_spans(spark.createDataFrame([(1, body)], "d int, text string"), "text")
    got = [(r.line, r.start_column, r.end_column, r.text) for r in spans.orderBy("line").collect()]
    assert got[0] == (3, 3, 45, "Dose increased growth relative to placebo.") and [g[0] for g in got] == [3, 4, 5]
    assert [(r.direction, r.comparison) for r in text.directional_claims(spans).orderBy("line").collect()] == [
        ("positive", "Dose versus placebo"), ("negative", "Dose versus none"),
    ]


def test_paths_timestamps_pointers_and_decimals(spark):
    paths = ["a/b.csv", "/a", "a/../b", "a//b", "a/.", " a", "a\\b", ".hidden", "a/b/"]
    got = [r.s for r in spark.createDataFrame([(p,) for p in paths], "p string").select(values.safe_relative_path(F.col("p")).alias("s")).collect()]
    assert got == [True, False, False, False, False, False, False, True, False]
    stamps = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00",), ("2024-01-01T02:00:00+02:00",)], "t string")
    seen = [r.t for r in stamps.select(F.unix_micros(values.utc_timestamp(F.col("t"))).alias("t")).collect()]
    assert seen[0] == seen[2] and seen[1] is None
    grades = spark.createDataFrame([('{"a":{"b":[1,2]}}', " [1, 2]"), ('{"a":1,"a":2}', "1"), ('{"a":{}}', "1")], "a string, e string")
    assert [r.grade for r in values.json_grade(grades, "a", "e", "/a/b").collect()] == ["match", "malformed", "missing"]
    numbers = spark.createDataFrame([("1.500",), ("0.000",), ("100",), ("10.0",)], "n string")
    assert [r.n for r in numbers.select(text.decimal_text(F.col("n")).alias("n")).collect()] == ["1.5", "0", "100", "10"]
