"""Rows that once gave wrong answers."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from plumbline.functions import ids, text, values
from plumbline.operators import filters, graph, ordering
from plumbline.sources import records


def test_canonical_json_keeps_numbers_apart(spark):
    texts = ['{"b":1,"a":1.0}', "1e-7", "1" * 60, "-0", "-0.0", '"\\ud83d\\ude00é"', '{"k":1.5,"k":2}', "[1.0", "NaN", "1e999", '{"\U0001f600":1.0,"￿":2}', None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    want = ['{"a":1.0,"b":1}', "1e-07", "1" * 60, "0", "-0.0", '"\U0001f600é"', None, None, None, None, '{"￿":2,"\U0001f600":1.0}', None]
    assert [r.c for r in frame.select(ids.canonical_json(F.col("t")).alias("c")).collect()] == want


def test_grade_needs_the_same_spelling(spark):
    rows = [("[1]", "1", "match"), ("[1.0]", "1", "mismatch"), ("[1.0]", "1.0", "match"), ("[" + "9" * 50 + "]", "9" * 49 + "8", "mismatch"), ("[]", "1", "missing"), ("[1.5", "1", "malformed")]
    frame = spark.createDataFrame([r[:2] for r in rows], "a string, b string")
    assert [r.grade for r in values.json_grade(frame, "a", "b", "/0").collect()] == [r[2] for r in rows]


def test_canonical_json_is_what_python_writes(spark):
    """Escapes in small letters and only where they must be, keys by code point, one value and no more."""
    values_ = [{"\U0001f600": 1, "\uf000": [2], "z": "\x1f\x7f\u2028/\\\"", "a": " \t"}, "\ud800x", "\\ud800", [[[]]], {"": {}}, "  spaced  out ", 10**20, 0.1, "é\n"]
    texts = [json.dumps(v) for v in values_] + [json.dumps(v, indent=1, ensure_ascii=False) for v in values_ if v != "\ud800x"]
    texts += ["[" * 150 + "]" * 150, "[" * 600 + "]" * 600, json.dumps({"k": "x" * 100_000}), ' {"b":"é" , "a":"x y"}\r\n']
    want = []
    for t in texts:
        spelt = json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        want.append(re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", spelt))
    bad = ['{"a":true} x', "1 2", "[],", '{"a":1}{}', "", " ", '{"a":1,"a":1}', "01", "[1,]", "'a'", "\ufeff1", '"\x01"', '"a\nb"', "tru", "1\x0b", "\xa01", "[" * 300_000 + "]" * 300_000]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts + bad)], "i int, t string")
    rows = frame.select("i", ids.canonical_json(F.col("t")).alias("c"), ids.semantic_digest(F.col("t")).alias("d")).orderBy("i").collect()
    assert [r.c for r in rows] == want + [None] * len(bad)
    assert rows[1].c != rows[2].c and len({r.d for r in rows[:9]}) == 9
    again = spark.createDataFrame([(r.i, r.c) for r in rows[: len(texts)]], "i int, t string").select("i", ids.canonical_json(F.col("t")).alias("c"))
    assert [r.c for r in again.orderBy("i").collect()] == want


def test_pointers_name_places_in_arrays_and_keys_of_objects(spark):
    cases = [("[[1]]", "/0/0", "1"), ('{"0":{"0":"\\u0061"}}', "/0/0", '"a"'), ('[{"0":2}]', "/0/0", "2"), ("[7]", "/00", None), ('{"00":7}', "/00", "7"), ('{"a\'b":3}', "/a'b", "3"), ('{"a":null}', "/a", "null"), ('{"a":1} x', "/a", None), ("[1]", "/1", None), ("1", "/0", None), ("[5]", "", "[5]")]
    for text_, pointer, want in cases:
        frame = spark.createDataFrame([(text_,)], "t string")
        assert frame.select(values.json_at(F.col("t"), pointer).alias("v")).head().v == want, (text_, pointer)


def test_a_store_reads_back_what_it_wrote(spark, tmp_path):
    bodies = ['{"record_type":"t","record_id":"%d","x":%s}' % (i, x) for i, x in enumerate(["1.0", "1e-7", '"\\u001F"', '"\\ud800"', '{"\U0001f600":1,"\uf000":2}', "1", '"a\\nb"'])] * 40
    frame = spark.createDataFrame([("t", str(i), b) for i, b in enumerate(bodies)], "record_type string, record_id string, body string").coalesce(1)
    path = str(tmp_path / "store")
    records.write_records(frame, path)
    (file,) = (tmp_path / "store" / "record_type=t").glob("part*")
    (file.parent / f".{file.name}.crc").unlink()  # the checksum of the file as Spark wrote it
    with open(file, "ab") as f:
        f.write(b'\n[1]\n{"a"\n\xff\xfe\n{"a":1,"a":2}\n{"record_id":"1","record_type":"u"}\n{"record_id":"9","record_type":"t"}\r\n{"record_id":"1","record_type":"t"}')
    n = len(bodies)
    want = {n + 1: "malformed", n + 2: "not_an_object", n + 3: "malformed", n + 4: "malformed", n + 5: "not_canonical", n + 6: "wrong_type", n + 7: "not_canonical", n + 8: "torn"}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = {r.line_number: r.problem for r in records.read_records(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i: want.get(i) for i in range(1, n + 9)}


def test_references_with_other_fields_and_inside_sources(spark):
    body = {
        "one": {"record_type": "t", "record_id": "1", "note": {"source_kind": "k", "locator": "n"}},
        "two": {"source_kind": "k", "locator": "l", "ref": {"record_type": "u", "record_id": "2"}, "more": {"source_kind": "k", "locator": "m"}},
        "odd": {"record_type": 7, "record_id": "3"},
    }
    frame = spark.createDataFrame([("r", "0", json.dumps(body))], "record_type string, record_id string, body string")
    _, edges, places = records.evidence_index(frame)
    assert {(e.pointer, e.target_id) for e in edges.collect()} == {("/one", "1"), ("/two/ref", "2")}
    assert {(p.pointer, p.locator) for p in places.collect()} == {("/one/note", "n"), ("/two", "l")}


def test_a_group_with_neither_level_is_unsupported(spark):
    frame = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "g string, c string")
    got = {r.g: (r.reference_rows, r.applicability) for r in filters.contrast_filter(frame, "c", "x", "y", ["g"]).collect()}
    assert got == {"a": (1, "applicable"), "b": (0, "unsupported")}


def test_tied_positions_do_not_depend_on_input_order(spark):
    rows = [("g", 1, 5), ("g", 1, 3), ("g", 2, 4), ("g", 2, 9), ("g", 3, 1)]
    for size in (100, 2):
        for some in (rows, rows[::-1]):
            got = ordering.monotone_check(spark.createDataFrame(some, "g string, o int, v int"), ["g"], "o", "v", rows_per_block=size)
            assert [(r.n_rows, r.decreases) for r in got.collect()] == [(5, 2)]


def test_lineage_goes_to_the_end(spark):
    edges = spark.createDataFrame([(str(i), "next", str(i + 1)) for i in range(12)], "source string, relation string, target string")
    seeds = spark.createDataFrame([("0",)], "seed string")
    assert {(r.node, r.depth) for r in graph.lineage_closure(edges, seeds).collect()} == {(str(i), i) for i in range(1, 13)}
    assert graph.lineage_closure(edges, seeds, 3).count() == 3


def test_long_numbers_and_sequences_have_no_upper_bound(spark):
    frame = spark.createDataFrame([("counted 123456789012345678 cells", "A" * 20_000 + "\nspecimen 1")], "t string, s string")
    row = frame.select(text.number_tokens(F.col("t")).alias("n"), text.sequence_record(F.col("s")).alias("r"), text.sequence_record(F.col("s"), longest=10_000).alias("b")).head()
    assert [n.raw for n in row.n] == ["123456789012345678"] and row.r and not row.b


def test_a_record_is_parsed_once(spark, tmp_path):
    """Reading, indexing and grading plan one Python step a text, over every core, and none in the JVM's parser."""
    texts = ['{"b":1,"a":1}', '{"a":1,"a":1}', '{"a":"x","b":{"c":"y","c":"y"}}', '{"a":"\\n","a":"\\n"}', '{"a":"\\"","b":1}', '{"a" :1}']
    want = ['{"a":1,"b":1}', None, None, None, '{"a":"\\"","b":1}', '{"a":1}']
    assert [ids.canonical_text(t) for t in texts] == want
    frame = spark.createDataFrame([("t", str(i), t) for i, t in enumerate(texts)], "record_type string, record_id string, body string").coalesce(1)
    plan = frame.select(ids.canonical_json(F.col("body")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "parse_json" not in plan
    frame.write.parquet(str(tmp_path / "one"))
    base, edges, places = records.evidence_index(spark.read.parquet(str(tmp_path / "one")))
    assert {r.record_id: r.body for r in base.collect()} == dict(zip(map(str, range(6)), want))
    assert base.select("body").count() == 6 and edges.count() == places.count() == 0
    read = [len(x.inputFiles()) for x in (base, edges, places)]
    assert read[0] == read[1] == read[2] > 1  # one table for all parts, written by more than one task
