from __future__ import annotations

import gzip
import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import diff, evaluation, graph, leakage, linking, ordering
from plumbline.plans import CheckRegistry
from plumbline.sources import delimited, files, records


def all_simple_paths(edges, s, t, limit):
    out, stack = [], [(s, (s,), 0)]
    while stack:
        node, path, used = stack.pop()
        if used == limit:
            continue
        for a, b in edges:
            if a == node and b not in path:
                if b == t:
                    out.append((*path, b))
                else:
                    stack.append((b, (*path, b), used + 1))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_unique_paths_match_enumeration(spark, seed):
    rng = random.Random(seed)
    nodes = "abcdefg"
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(11)]
    edges = [(a, b) for a, b in edges if a != b]
    pairs = [(a, b) for a in nodes for b in nodes]
    rows = [(a, b, "ok") for a, b in edges] + [("a", "b", "no"), ("a", "a", "ok")]
    got = graph.unique_paths(
        spark.createDataFrame(rows, "source string, target string, profile string"),
        spark.createDataFrame(pairs, "source string, target string"), ["ok"], 4,
    ).collect()
    assert len(got) == len(pairs)
    for r in got:
        found = all_simple_paths(edges, r.source, r.target, 4) if r.source != r.target else []
        assert min(r.n_paths, 2) == min(len(found), 2)
        assert (tuple(r.path) if r.path else None) == (found[0] if len(found) == 1 else None)


def test_closure_goes_to_the_end_unless_limited(spark):
    edges = spark.createDataFrame([(f"n{i}", "next", f"n{i + 1}") for i in range(12)] + [("n3", "back", "n0")], "source string, relation string, target string")
    seeds = spark.createDataFrame([("n0",)], "seed string")
    for limit, last in ((None, 12), (8, 8)):
        got = graph.lineage_closure(edges, seeds, limit).collect()
        assert {r.node: r.depth for r in got} == {f"n{i}": i for i in range(1, last + 1)}


def test_draws_match_hashlib(spark):
    digest = "sha256:" + hashlib.sha256(b"x").hexdigest()
    for size in (7, 125, 2**31 - 1):
        df = spark.range(40).select(F.col("id"), evaluation.counter_draw("d-v1", digest, F.col("id"), F.col("id") + 3, size).alias("i"))
        for r in df.collect():
            block = b"d-v1\0" + bytes.fromhex(digest[7:]) + b"".join(v.to_bytes(8, "big") for v in (r.id, r.id + 3, 0))
            value = int.from_bytes(hashlib.sha256(block).digest(), "big")
            assert value < 2**256 - 2**256 % size and r.i == value % size


def outcome_rows(spark, rows):
    schema = (
        "case_id string, problem_id string, comparison_status string, metric_input_status string, metric_eligible boolean, "
        "opportunities array<struct<state:string,applicability_status:string,coverage_status:string,execution_class:string,candidate_ids:array<string>>>, "
        "candidates array<struct<candidate_id:string,status:string>>, roots array<struct<root_id:string,status:string>>"
    )
    return spark.createDataFrame(rows, schema)


def case(i, problem, status="bounded_root_match", root="boundedly_localized", eligible=True):
    op = ("finding_candidate", "applicable", "covered", "completed", [f"c{i}"])
    return (f"k{i}", problem, "reconciled", "complete", eligible, [op], [(f"c{i}", status)], [(f"r{i}", root)])


def test_packed_draws_add_up_to_the_counted_ones(spark):
    digest = "sha256:" + hashlib.sha256(b"y").hexdigest()
    sums = spark.createDataFrame([(i, i * i, 1 if i % 3 else None) for i in range(53)], "idx long, a long, b long")
    made = {}
    for block in (7, 53, 1 << 17):
        rows = evaluation.resampled_totals(sums.repartition(3), 53, "d-v1", digest, 70, block=block).collect()
        made[block] = sorted(tuple(r) for r in rows)
    drawn = spark.range(70 * 53).select(
        F.floor(F.col("id") / 53).alias("replicate"),
        evaluation.counter_draw("d-v1", digest, F.floor(F.col("id") / 53), F.pmod("id", F.lit(53)), 53).alias("idx"),
    )
    expected = drawn.join(sums, "idx").groupBy("replicate").agg(F.sum("a"), F.coalesce(F.sum("b"), F.lit(0))).collect()
    assert made[7] == made[53] == made[1 << 17] == sorted(tuple(r) for r in expected)


def test_metrics_and_zero_denominators(spark):
    df = outcome_rows(spark, [case(1, "p"), case(2, "p", "false_root_localization", "missed"), case(3, "q", eligible=False)])
    got = {r.metric_name: r for r in evaluation.metric_pairs(df.repartition(3)).collect()}
    assert got["workflow_unsafe_candidate_probability"].estimate == 0.5
    assert (got["finding_candidate_precision"].numerator, got["finding_candidate_precision"].denominator) == (1, 2)
    assert got["adjudicated_root_recall"].estimate == 0.5
    none = {r.metric_name: r for r in evaluation.metric_pairs(df.where("case_id = 'k3'")).collect()}
    assert none["finding_candidate_precision"].estimate is None and none["detector_error_rate"].estimate == 0.0


def test_bootstrap_needs_two_clusters(spark):
    digest = "sha256:" + hashlib.sha256(b"x").hexdigest()
    one = evaluation.cluster_bootstrap(outcome_rows(spark, [case(1, "p")]), "problem_id", digest, replicates=20).collect()
    assert {r.status for r in one} == {"not_estimable"}
    rows = [case(i, f"p{i % 5}", "false_root_localization" if i % 5 == 0 else "bounded_root_match") for i in range(20)]
    a = evaluation.cluster_bootstrap(outcome_rows(spark, rows), "problem_id", digest, replicates=80).collect()
    b = evaluation.cluster_bootstrap(outcome_rows(spark, rows[::-1]).repartition(6), "problem_id", digest, replicates=80).collect()
    assert sorted(a) == sorted(b)
    unsafe = {r.metric_name: r for r in a}["workflow_unsafe_candidate_probability"]
    draws = []
    for replicate in range(80):
        picks = []
        for position in range(5):
            block = b"plumbline-bootstrap-v1\0" + bytes.fromhex(digest[7:]) + b"".join(v.to_bytes(8, "big") for v in (replicate, position, 0))
            picks.append(int.from_bytes(hashlib.sha256(block).digest(), "big") % 5)
        draws.append(sum(p == 0 for p in picks) * 4 / 20)
    draws.sort()
    assert (unsafe.lower, unsafe.upper) == (draws[1], draws[77])


def test_segment_clock_in_many_blocks(spark):
    rng = random.Random(9)
    rows, t = [], {"a": 0, "b": 0}
    for i in range(300):
        s = "a" if rng.random() < 0.8 else "b"
        t[s] += rng.randint(0, 20) * 1_000_000
        rows.append((s, t[s], i, rng.choice(["active", "paused"])))
    df = spark.createDataFrame(rows, "s string, t long, k long, state string").withColumn("at", F.timestamp_micros("t"))
    options = dict(paused_state="paused", hard_seconds=600.0)
    got = [
        sorted(ordering.segment_clock(df.repartition(5), "s", "at", "k", "state", rows_per_block=n, **options).collect())
        for n in (10_000, 40)
    ]
    assert got[0] == got[1]
    for r in got[0]:
        active = paused = 0
        last = mode = exhausted = None
        for _, at, _, state in sorted((x for x in rows if x[0] == r.s), key=lambda x: (x[1], x[2])):
            gap = 0 if last is None else at - last
            if exhausted is None:
                if mode == "paused":
                    paused += gap
                else:
                    active += gap
                if active >= 600_000_000:
                    exhausted = at
            last, mode = at, state
        assert (r.active_seconds, r.paused_seconds, r.exhausted_micros) == (active / 1e6, paused / 1e6, exhausted)


def test_greedy_budget_matches_a_walk(spark):
    rng = random.Random(6)
    rows = [(f"s{i % 2}", f"f{i:03d}", rng.choice([1, 5, 20, 90, 300])) for i in range(120)]
    got = files.greedy_budget(spark.createDataFrame(rows, "s string, f string, n long"), "s", "n", 400, ["s", "f"]).collect()
    want, used = {}, {"s0": 0, "s1": 0}
    for s, f, n in sorted(rows):
        want[f] = used[s] + n <= 400
        used[s] += n if want[f] else 0
    assert {r.f: r.fits for r in got} == want


def test_asset_inventory_tiers(spark, tmp_path):
    sizes = {"run.py": 100, "big.csv": 50_000, "huge.csv": 90_000, "tail.csv": 70_000, "note.txt": 10}
    rows = []
    for name, n in sizes.items():
        (tmp_path / name).write_bytes(os.urandom(n))
        rows.append(("s", str(tmp_path / name), name, n, name == "big.csv", False))
    df = spark.createDataFrame(rows, "snapshot string, path string, relative string, size long, material boolean, preferred boolean")
    declared = spark.createDataFrame([("s", "tail.csv", "sha256:declared")], "snapshot string, relative string, digest string")
    budget = files.Budget(full=1_000, sampled=12_288, material=60_000)
    got = {r.relative: r for r in files.asset_inventory(df, budget, declared=declared).collect()}
    assert {k: v.tier for k, v in got.items()} == {
        "run.py": "full_digest", "note.txt": "full_digest", "big.csv": "full_digest", "huge.csv": "weak_fingerprint", "tail.csv": "manifest",
    }
    assert got["huge.csv"].bytes_read == 12_288 and got["tail.csv"].digest == "sha256:declared"
    assert got["big.csv"].digest == "sha256:" + hashlib.sha256((tmp_path / "big.csv").read_bytes()).hexdigest()


def test_strict_delimited_reading(spark, tmp_path):
    (tmp_path / "ok.csv").write_text('id,v\n1,"a,\nb"\n2,\n')
    (tmp_path / "ragged.tsv").write_text("id\tv\n1\ta\tx\n2\n")
    (tmp_path / "bytes.csv").write_bytes(b"id,v\n1,\xff\n")
    ok = delimited.read_delimited(spark, str(tmp_path / "ok.csv"), ["id", "v"]).orderBy("id").collect()
    assert [(r.id, r.v, r._bad) for r in ok] == [("1", "a,\nb", False), ("2", "", False)]
    assert all(r._bad for r in delimited.read_delimited(spark, str(tmp_path / "ragged.tsv"), ["id", "v"]).collect())
    assert delimited.read_delimited(spark, str(tmp_path / "bytes.csv"), ["id", "v"]).collect()[0]._bad


def test_header_inventory_statuses(spark, tmp_path):
    bodies = {"a.csv": "x,y\n", "dup.csv": "v,v\n1,2\n", "empty.csv": "", "blank.tsv": "a\t\n", "broken.csv.gz": "not gzip"}
    for name, body in bodies.items():
        (tmp_path / name).write_text(body)
    with gzip.open(tmp_path / "z.tsv.gz", "wt") as handle:
        handle.write("a\tb\n")
    rows = [(str(tmp_path / n), "d", "d", 1, True, n == "a.csv") for n in [*bodies, "z.tsv.gz"]] + [(str(tmp_path / "a.csv") + "x", "d", "e", 1, True, True)]
    df = spark.createDataFrame(rows, "path string, digest string, declared_digest string, artifacts int, is_produced boolean, is_consumed boolean")
    got = {os.path.basename(r.path): r for r in delimited.header_inventory(df).collect()}
    assert {k: v.structure_status for k, v in got.items()} == {
        "a.csv": "partial", "dup.csv": "opaque", "empty.csv": "unavailable", "blank.tsv": "opaque", "broken.csv.gz": "opaque", "z.tsv.gz": "partial",
    }
    assert got["a.csv"].data_role == "intermediate" and got["z.tsv.gz"].variables == ["a", "b"] and got["z.tsv.gz"].encoding == "gzip"


def test_column_types(spark):
    rows = [("1", "1.5", "true", "", " 7 ", "1__0", "inf"), ("", "2e3", "FALSE", "", "+8", "1", "nan")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g string")
    got = {r.column_name: (r.storage_type, r.levels) for r in delimited.column_profile(df, list("abcdefg")).collect()}
    assert got == {"a": ("integer", 2), "b": ("number", 2), "c": ("boolean", 2), "d": ("unknown", 1), "e": ("integer", 2), "f": ("string", 2), "g": ("number", 2)}


def test_evidence_index_walk(spark):
    body = {"refs": [{"record_type": "t", "record_id": "1"}], "deep": {"x/y": {"record_type": "u", "record_id": "2"}}, "source": {"source_kind": "file_span", "locator": "p:1", "path": "p"}}
    df = spark.createDataFrame([("r", "0", json.dumps(body))], "record_type string, record_id string, body string")
    _, edges, places = records.evidence_index(df)
    assert {(e.pointer, e.target_type, e.target_id) for e in edges.collect()} == {("/refs/0", "t", "1"), ("/deep/x~1y", "u", "2")}
    assert [(p.pointer, p.locator) for p in places.collect()] == [("/source", "p:1")]


def test_span_containment_across_blocks(spark):
    rng = random.Random(8)
    inner = [("p", s, s + rng.randint(0, 9)) for s in (rng.randint(1, 400) for _ in range(80))]
    outer = [("p", s, s + rng.randint(0, 150)) for s in (rng.randint(1, 400) for _ in range(6))]
    got = linking.span_containment(
        spark.createDataFrame(inner, "path string, start_line long, end_line long"), spark.createDataFrame(outer, "path string, start_line long, end_line long"), 16
    ).collect()
    for r in got:
        assert r.inside == any(r.start_line >= s and r.end_line <= e for _, s, e in outer)


def test_digests_ignore_order_but_not_content(spark):
    a = spark.createDataFrame([("x", "k"), ("y", "k")], "id string, s string")
    b = spark.createDataFrame([("y", "k"), ("x", "k")], "id string, s string")
    c = spark.createDataFrame([("x", "k"), ("z", "k")], "id string, s string")
    same, other = diff.identifier_equality(a, b, "id").collect()[0], diff.identifier_equality(a, c, "id").collect()[0]
    assert same.comparison_outcome == "conformant" and same.left_digest == same.right_digest
    assert other.left_digest != other.right_digest and (other.left_only, other.right_only) == (1, 1)
    twice = diff.identifier_equality(a.unionByName(a), b, "id").collect()[0]
    assert twice.applicability == "unsupported"


def test_removing_a_check_leaves_its_siblings(spark):
    registry = CheckRegistry()
    one = lambda inputs: inputs["obs"]
    from plumbline.outcomes import as_observations

    base = spark.createDataFrame([("c1", "applicable", "conformant", "r")], "id string, applicability string, comparison_outcome string, reason string")
    inputs = {"obs": as_observations(base, "first", "id")}
    registry.register("first", one)
    registry.register("second", lambda _: inputs["missing"])
    full = {r.check_id: r.applicability for r in registry.evaluate(spark, inputs).collect()}
    assert full == {"first": "applicable", "second": "unsupported"}
    registry.remove("second")
    assert [r.check_id for r in registry.evaluate(spark, inputs).collect()] == ["first"]


def test_a_check_that_fails_on_executors_leaves_its_siblings(spark):
    from plumbline.outcomes import as_observations

    base = spark.createDataFrame([(f"c{i}", "applicable", "conformant", "r") for i in range(9)], "id string, applicability string, comparison_outcome string, reason string")
    registry = CheckRegistry()
    registry.register("sound", lambda i: as_observations(i["obs"], "sound", "id"))
    registry.register("breaks, late", lambda i: as_observations(i["obs"].where(F.raise_error(F.col("id")).isNull()), "breaks, late", "id"))
    got = registry.evaluate(spark, {"obs": base}).collect()
    assert sum(r.check_id == "sound" for r in got) == 9
    assert [(r.applicability, r.case_id) for r in got if r.check_id == "breaks, late"] == [("unsupported", None)]
    assert CheckRegistry().evaluate(spark, {}).count() == 0


def test_index_differences_are_found_row_by_row(spark):
    from plumbline.sources import records

    rows = [("t", f"r{i}", json.dumps({"refs": [{"record_type": "u", "record_id": f"x{i}"}] * 2})) for i in range(30)]
    made = spark.createDataFrame(rows, "record_type string, record_id string, body string")
    base, edges, places = records.evidence_index(made)
    assert records.verify_index(made, base, edges, places).count() == 0
    twice = edges.unionByName(edges.where("source_id = 'r3'"))
    spoilt = twice.where("not (source_id = 'r5' and pointer = '/refs/1')").withColumn("target_id", F.expr("if(source_id = 'r7', null, target_id)"))
    got = {(r.part, r.record_id, r.pointer, r.problem) for r in records.verify_index(made, base.where("record_id <> 'r9'"), spoilt, places).collect()}
    assert got == {
        ("record", "r9", None, "missing"), ("edge", "r5", "/refs/1", "missing"),
        *(("edge", "r3", f"/refs/{i}", "repeated") for i in range(2)),
        *(("edge", "r7", f"/refs/{i}", p) for i in range(2) for p in ("missing", "not_in_records")),
    }


def test_clock_stream_has_a_timer_and_gives_up_idle_segments(spark, tmp_path):
    from plumbline.streaming.segments import stream_segment_time

    folder, out = tmp_path / "in", str(tmp_path / "out")
    batches = [
        [("a", 0, 1, "run"), ("b", 5, 1, "run"), ("c", 0, 1, "wait")],
        [("b", 30, 2, "wait"), ("b", 20, 3, "run"), ("a", 40, 2, "run")],  # b's come in the wrong order
        [("d", 300, 1, "run"), ("b", 35, 4, "run")],
        [("a", 10, 9, "run"), ("b", 310, 5, "run")],  # a's is behind the watermark
        [("d", 900, 2, "run")],
    ]
    for rows in batches:
        frame = spark.createDataFrame(rows, "segment string, s long, tie long, state string")
        frame.select("segment", F.timestamp_seconds("s").alias("at"), "tie", "state").coalesce(1).write.mode("append").parquet(str(folder))
    schema = "segment string, at timestamp, tie long, state string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    clocks = stream_segment_time(stream, paused_state="wait", hard_seconds=100, watermark="30 seconds", idle_seconds=400)
    save = lambda batch, n: batch.write.parquet(f"{out}/batch={n}")
    clocks.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).collect()
    last = {s: max((r for r in rows if r.segment == s), key=lambda r: r.batch) for s in "abcd"}
    second = 1_000_000
    # a: the limit passes 100 s after its first event, with no event near it; its late event is only counted.
    assert (last["a"].limit_micros, last["a"].exhausted_micros, last["a"].rejected, last["a"].released) == (100 * second, None, 1, True)
    # b: runs 5-20, 20-30, waits 30-35, runs 35-310.
    assert (last["b"].events, last["b"].paused_micros, last["b"].limit_micros, last["b"].exhausted_micros) == (5, 5 * second, 110 * second, 310 * second)
    assert last["c"].limit_micros is None and last["c"].released
    assert (last["d"].events, last["d"].limit_micros, last["d"].released) == (2, 400 * second, False)
    assert len({r.batch for r in rows}) >= 5


def test_ingest_keeps_records_of_any_lateness(spark, tmp_path):
    from plumbline.streaming import records as record_stream

    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    names = "record_type string, record_id string, seq long, at timestamp, digest string"
    day = "2026-01-0{} 00:00:00"
    batches = [
        [("t", "a", 2, day.format(5), "d2")],
        [("t", "b", 1, day.format(8), "d1"), ("t", "b", 1, day.format(8), "d1")],
        [("t", "late", 1, day.format(1), "d1"), ("t", "a", 1, day.format(2), "d1"), ("t", "a", 3, day.format(3), "d3")],
        [("t", "late", 1, day.format(1), "d1")],
    ]
    for rows in batches:
        frame = spark.createDataFrame(rows, "record_type string, record_id string, seq long, at string, digest string")
        frame.withColumn("at", frame["at"].cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(names).parquet(source)
        record_stream.ingest(stream, store, str(tmp_path / "checkpoint")).awaitTermination()
    kept = spark.read.parquet(store)
    assert kept.count() == 6 and kept.select("batch").distinct().count() == 4
    now = record_stream.current(kept)
    assert sorted((r.record_id, r.seq) for r in now.collect()) == [("a", 3), ("b", 1), ("late", 1)]


def test_payloads_are_read_in_every_encoding(spark):
    needle = "Hidden answér 42"
    said = f"prefix {needle} suffix"
    hits = [
        said.encode(), b"\xef\xbb\xbf" + needle.encode(), said.encode("utf-16"), said.encode("utf-16-le"), said.encode("utf-16-be"), b"\x01\x00\x02" + said.encode("utf-16-be"),
        b"\xff\x00 junk " + said.encode(), "Hidden answe\u0301r 42".encode(), b"\xfe" + said.encode("utf-16-le") + b"\xd8",
    ]
    misses = [b"", None, b"\x00", b"\xff\xfe", needle[1:].encode("utf-16-le"), needle.encode("utf-32-le"), b"\xff" * 9]
    frame = spark.createDataFrame(list(enumerate(hits + misses)), "doc_id long, payload binary")
    items = spark.createDataFrame([(1, needle)], "item_id long, text string")
    got = leakage.leakage_scan(frame, items, payload="payload", markers=items).collect()
    assert {(r.doc_id, r.reason) for r in got} == {(i, why) for i in range(len(hits)) for why in ("text", "marker")} and len(got) == 2 * len(hits)


def test_required_matrix_lists_gaps_and_doubles_alone(spark):
    types = ["x", "y"]
    blocks = [("p", "b1"), ("p", "b2"), ("q", "b1"), ("q", "b1"), ("none", "b1")]
    envelopes = [("p", "e1"), ("p", "e2"), ("p", "e3"), ("q", "e1")]
    whole = [(p, b, e, c) for p, b in set(blocks) for q, e in envelopes if p == q for c in types]
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    names = "plan block_id envelope_id cell_type"

    def found(rows):
        out = linking.required_matrix(frame(rows, names), frame(blocks, "plan block_id"), frame(envelopes, "plan envelope_id"), "plan", types)
        return sorted(tuple(r[c] for c in [*names.split(), "assigned"]) for r in out.collect())

    assert found(whole) == []
    gone = [whole[0], whole[3], ("q", "b1", "e1", "x")]
    rows = [r for r in whole if r not in gone] + [whole[5]] * 2 + [("p", "b9", "e1", "x"), ("p", "b1", "e9", "x"), ("p", "b1", "e1", "z"), ("q", "b1", "e2", "x")]
    want = {(*r, 0) for r in gone} | ({(*whole[5], 3)} if whole[5] not in gone else {(*whole[5], 2)})
    assert found(rows) == sorted(want)


def test_cycles_and_parallel_edges_leave_one_path(spark):
    edges = [("a", "b"), ("b", "c"), ("b", "x"), ("x", "b"), ("x", "b"), ("c", "d"), ("d", "c"), ("d", "e"), ("p", "q"), ("p", "q"), ("q", "p"), ("q", "r")]
    pairs = [("a", "c"), ("a", "d"), ("a", "e"), ("a", "x"), ("x", "e"), ("p", "r"), ("r", "p"), ("e", "a"), ("a", "zz"), ("a", "a")]
    got = graph.unique_paths(
        spark.createDataFrame([(*e, "ok") for e in edges], "source string, target string, profile string"),
        spark.createDataFrame(pairs, "source string, target string"), ["ok"], 7,
    )
    want = {(s, t): all_simple_paths(edges, s, t, 7) if s != t else [] for s, t in pairs}
    for r in got.collect():
        assert r.n_paths == min(2, len(want[r.source, r.target])), r
        assert r.n_paths != 1 or tuple(r.path) == want[r.source, r.target][0]


@pytest.mark.parametrize("lines_per_block", [2_000_000, 3])
def test_tables_are_bound_by_their_own_headers(spark, tmp_path, lines_per_block):
    cells = [["1", 'say "hi"', "a,b"], ["2", "two\nlines\n\nmore", ""], ["3", "", "é"], ["4", "x\n", "y"]]

    def spelt(rows, quoted=True):
        return "".join(",".join('"' + c.replace('"', '""') + '"' if quoted else c for c in row) + "\r\n" for row in rows)

    files_ = {
        "ok.csv": "id,note,more\n" + spelt(cells),
        "moved.csv": '"more",id,"note"\n' + spelt([[c, a, b] for a, b, c in cells]),
        "short.csv": "id,other\n1,2\n",
        "twice.csv": "id,id,note\n1,1,2\n",
        "blank.csv": "id,,note\n1,2,3\n",
        "open.csv": 'id,note\n1,"a\n2,b\n',
        "ragged.csv": 'id,note\n1,a\n2\n3,b,c\n4,x"y"z\n5,d',
        "none.csv": "id,note\n",
    }
    for name, text in files_.items():
        (tmp_path / name).write_bytes(text.replace("\r\n", "\n").encode() if name == "ok.csv" else text.encode())
    (tmp_path / "good.csv.gz").write_bytes(gzip.compress(b"note,id\nz,9\n"))
    (tmp_path / "cut.csv.gz").write_bytes(gzip.compress(b"id,note\n" + bytes(range(65, 91)) * 9000)[:-12])
    (tmp_path / "fake.csv.gz").write_bytes(b"id,note\n1,2\n")
    (tmp_path / "bytes.csv").write_bytes(b"id,note\n1,\xff\n2,b\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20")
    try:
        found, rows = delimited.read_tables(spark, str(tmp_path), ["id", "note"], lines_per_block=lines_per_block)
        status = {os.path.basename(r.file): (r.status, r.n_rows, r.n_bad) for r in found.collect()}
        got = sorted((os.path.basename(r.file), r.id, r.note, r._bad) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    read = {"ok.csv": (4, 0), "moved.csv": (4, 0), "ragged.csv": (5, 3), "none.csv": (0, 0), "good.csv.gz": (1, 0), "bytes.csv": (2, 1)}
    refused = {"short.csv": "columns_missing", "twice.csv": "header_duplicated", "blank.csv": "header_unavailable", "open.csv": "unclosed_quote", "cut.csv.gz": "invalid_compression", "fake.csv.gz": "invalid_compression"}
    assert status == {k: ("read", *v) for k, v in read.items()} | {k: (v, 0, 0) for k, v in refused.items()}
    want = [(f, a, b, False) for f in ("ok.csv", "moved.csv") for a, b, _ in cells]
    want += [("good.csv.gz", "9", "z", False), ("ragged.csv", "1", "a", False), ("ragged.csv", "5", "d", False), ("bytes.csv", "2", "b", False)]
    assert [g for g in got if not g[3]] == sorted(want)
    assert [g[0] for g in got if g[3]] == ["bytes.csv", "ragged.csv", "ragged.csv", "ragged.csv"]


def test_claims_of_one_hot_comparison_are_linked(spark):
    claims = spark.range(3000).select(
        F.col("id").alias("claim_id"), F.lit("score").alias("object"),
        F.when(F.col("id") % 3 > 0, "A versus B").when(F.col("id") % 6 == 0, F.concat(F.lit("G versus "), F.col("id").cast("string"))).otherwise("no comparison").alias("comparison"),
    )
    pairs = claims.where("comparison LIKE 'G%'").select("claim_id", F.lit("G").alias("left_group"), F.substring("comparison", 10, 9).alias("right_group"))
    results = pairs.unionByName(spark.createDataFrame([(7, "a", "B")], "claim_id long, left_group string, right_group string")).select(
        F.col("claim_id").alias("result_id"), "left_group", "right_group", F.lit("Score ").alias("outcome_column"), F.concat_ws(" versus ", "left_group", "right_group").alias("comparison")
    )
    twice = results.where("result_id = 12")
    got = linking.link_claims(claims, results.unionByName(twice)).collect()
    assert len(got) == 3000
    for r in got:
        want = (1, 7) if r.claim_id % 3 else (2, None) if r.claim_id == 12 else (1, r.claim_id) if r.claim_id % 6 == 0 else (0, None)
        assert (r.candidates, r.result_id) == want


def test_ambiguous_claims_with_null_and_repeated_records(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", None), ("d", None), ("d", 3), (None, 4)], "path string, record int")
    assert set(map(tuple, diff.ambiguous_claims(df, "path", "record").collect())) == {("a", 1), ("d", 3), (None, 4)}


def test_clock_stream_is_the_same_for_any_number_of_buckets(spark, tmp_path):
    from plumbline.streaming.segments import stream_segment_time

    rng, folder = random.Random(3), str(tmp_path / "in")
    for part in range(3):
        rows = [(f"s{rng.randrange(12)}", 100 * part + rng.randrange(130), part * 1000 + i, rng.choice(["run", "wait"])) for i in range(60)]
        frame = spark.createDataFrame(rows, "segment string, s long, tie long, state string")
        frame.select("segment", F.timestamp_seconds("s").alias("at"), "tie", "state").coalesce(1).write.mode("append").parquet(folder)
    found = []
    for buckets in (1, 500):
        out = str(tmp_path / f"out{buckets}")
        stream = spark.readStream.schema("segment string, at timestamp, tie long, state string").option("maxFilesPerTrigger", 1).parquet(folder)
        clocks = stream_segment_time(stream, paused_state="wait", hard_seconds=90, watermark="20 seconds", idle_seconds=60, buckets=buckets)
        save = lambda batch, n, out=out: batch.write.parquet(f"{out}/batch={n}")
        clocks.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", str(tmp_path / f"cp{buckets}")).trigger(availableNow=True).start().awaitTermination()
        found.append(sorted(map(str, spark.read.parquet(out).collect())))
    assert found[0] == found[1] and len(found[0]) > 24


def test_pairs_are_walked_from_the_end_they_share(spark, monkeypatch):
    leaves = range(40)
    edges = [("a", "b"), ("y", "z")] + [("b", f"leaf{i}") for i in leaves] + [(f"x{i}", "y") for i in leaves]
    pairs = [("a", f"leaf{i}") for i in leaves] + [(f"x{i}", "z") for i in leaves]
    walked, write = [], graph.cut_lineage

    def counted(df):
        table = write(df)
        if "h" in table.columns:
            walked.append(table.count())
        return table

    monkeypatch.setattr(graph, "cut_lineage", counted)
    got = graph.unique_paths(
        spark.createDataFrame([(*e, "ok") for e in edges], "source string, target string, profile string"),
        spark.createDataFrame(pairs, "source string, target string"), ["ok"],
    ).collect()
    assert {(r.source, r.target): r.path for r in got} == {(s, t): ([s, "b", t] if s == "a" else [s, "y", t]) for s, t in pairs}
    assert sum(walked) < 100  # 42 from each shared end; 324 with the walks from every leaf


@pytest.mark.parametrize("seed", range(3))
def test_paths_from_either_end_match_enumeration(spark, seed):
    rng = random.Random(seed)
    nodes = "abcdefgh"
    edges = [e for e in ((rng.choice(nodes), rng.choice(nodes)) for _ in range(16)) if e[0] != e[1]]
    # Walked from g, from a, and from the side with fewer ends; no walk for one node or none.
    pairs = [(s, "g") for s in "bcde"] + [("a", t) for t in nodes] + [("f", "h"), ("g", "g"), ("g", None), (None, None)]
    got = graph.unique_paths(
        spark.createDataFrame([(*e, "ok") for e in edges], "source string, target string, profile string"),
        spark.createDataFrame([*pairs, pairs[0]], "source string, target string"), ["ok"], 5,
    ).collect()
    assert {(r.source, r.target) for r in got} == set(pairs) and len(got) == len(pairs)
    for r in got:
        found = all_simple_paths(edges, r.source, r.target, 5) if r.source != r.target else []
        assert r.n_paths == min(len(found), 2), r
        assert (tuple(r.path) if r.path else None) == (found[0] if len(found) == 1 else None)
