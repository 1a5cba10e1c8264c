from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.contracts import DesignContract, LoopContract, SensitivityContract
from plumbline.operators import design, engines, groups


def test_mean_difference_gates(spark):
    rows = [("a", "treated", "2"), ("a", "treated", "4"), ("a", "control", "1"), ("b", "treated", "2"), ("c", "treated", "x"), ("c", "control", "1")]
    df = spark.createDataFrame(rows, "case string, g string, v string")
    got = {r.case: r for r in groups.mean_difference(df, "g", "v", "treated", "control", ["case"]).collect()}
    assert got["a"].mean_difference == 2.0 and got["a"].orientation == "treated_minus_control"
    assert got["b"].applicability == got["c"].applicability == "unsupported"
    assert got["b"].mean_difference is None


def test_effect_relevance(spark):
    rows = [("bad", "g1", "0.01", "0.05"), ("bad", "g2", "0.01", "2"), ("good", "g", "0.05", "1.0"), ("none", "g", "0.5", "0"), ("broken", "g", "0.01", None)]
    df = spark.createDataFrame(rows, "f string, g string, padj string, e string")
    got = {r.f: r for r in groups.effect_relevance(df, ["f"], "padj", "e", 0.05, 1.0).collect()}
    assert (got["bad"].below_floor, got["bad"].comparison_outcome) == (1, "nonconformant")
    assert got["good"].comparison_outcome == "conformant"
    assert got["none"].below_floor_fraction == 0.0
    assert got["broken"].applicability == "unsupported"


def test_ols_sign_matches_least_squares(spark):
    rng = random.Random(2)
    rows = [("g", f"d{i}", str(i % 3), str(round(1.5 * (i % 3) + rng.random(), 6))) for i in range(12)]
    rows += [("few", f"d{i}", str(i % 3), "1.0") for i in range(5)] + [("odd", f"d{i}", "3", "1") for i in range(8)]
    df = spark.createDataFrame(rows, "f string, donor string, x string, y string")
    said = spark.createDataFrame([("g", 0.4), ("few", 0.4), ("odd", 1.0)], "f string, effect double")
    got = {r.f: r for r in groups.ols_sign(df, ["f"], "donor", "x", "y", said, "effect").collect()}
    x, y = np.array([float(r[2]) for r in rows[:12]]), np.array([float(r[3]) for r in rows[:12]])
    design_matrix = np.column_stack([np.ones(12), x])
    beta, residual, *_ = np.linalg.lstsq(design_matrix, y, rcond=None)
    error = math.sqrt(residual[0] / 10 * np.linalg.inv(design_matrix.T @ design_matrix)[1, 1])
    assert math.isclose(got["g"].slope, beta[1]) and math.isclose(got["g"].slope_se, error)
    assert got["g"].comparison_outcome == "conformant"
    assert got["few"].reason == "too few donors" and got["odd"].applicability == "unsupported"
    flipped = groups.ols_sign(df, ["f"], "donor", "x", "y", said, "effect", counts_effect_allele=False)
    assert {r.f: r.comparison_outcome for r in flipped.collect()}["g"] == "nonconformant"


def loop_case(spark, delta=-1.0, drop=None):
    bins = [(f"b{i:02d}", i * 10, False) for i in range(60)]
    contacts = []
    for s, condition in (("s1", "wt"), ("s2", "wt"), ("s3", "ko"), ("s4", "ko")):
        for i in range(55):
            n = 10 if i != 20 else (40 if condition == "wt" else 20)
            if (s, i) != drop:
                contacts.append((s, condition, f"b{i + 5:02d}", f"b{i:02d}", n))
    return (
        spark.createDataFrame(contacts, "sample string, condition string, bin_i string, bin_j string, observed_count long"),
        spark.createDataFrame(bins, "bin_id string, start long, masked boolean"),
        spark.createDataFrame([("t", "b20", "b25")], "target_id string, bin_i string, bin_j string"),
        spark.createDataFrame([("t", delta)], "target_id string, delta double"),
    )


LOOP = LoopContract(10, 0, 600, "wt", "ko", ["sample"], 0.01)


def test_loop_strength_quartet(spark):
    good = groups.loop_strength(*loop_case(spark), LOOP).collect()[0]
    assert math.isclose(good.recomputed_delta, -1.0) and good.background_pairs == 54
    assert good.comparison_outcome == "conformant"
    assert groups.loop_strength(*loop_case(spark, delta=1.0), LOOP).collect()[0].comparison_outcome == "nonconformant"
    sparse = groups.loop_strength(*loop_case(spark, drop=("s1", 3)), LOOP).collect()[0]
    assert sparse.applicability == "unsupported" and "stratum" in sparse.reason


def test_loop_strength_counts_pairs_of_masked_bins_where_no_sample_does(spark):
    """Masked bins as near end, far end and both; a stratum no sample covers is refused, with its pairs counted."""
    contacts, bins, targets, results = loop_case(spark)
    masked = bins.withColumn("masked", F.col("bin_id").isin("b00", "b05", "b10", "b58"))
    met = sum(a in (0, 5, 10, 58) or a + 5 in (0, 5, 10, 58) for a in range(55))
    full = groups.loop_strength(contacts, masked, targets, results, LOOP).collect()[0]
    assert (full.background_pairs, full.applicability) == (55 - met - 1, "applicable")
    some = contacts.where("NOT (bin_j = 'b03')")
    short = groups.loop_strength(some, masked, targets, results, LOOP).collect()[0]
    assert short.background_pairs == 55 - met - 1 and "stratum" in short.reason
    elsewhere = contacts.where("sample = 's2' AND bin_j = 'b01'").withColumn("bin_j", F.lit("b50"))  # s2 has no pair five apart
    absent = groups.loop_strength(contacts.where("sample <> 's2'").unionByName(elsewhere), masked, targets, results, LOOP).collect()[0]
    assert "stratum" in absent.reason
    for wrong in (contacts.unionByName(contacts.limit(1)), contacts.withColumn("bin_i", F.when(F.col("bin_i") == "b30", "zz").otherwise(F.col("bin_i"))), contacts.withColumn("sample", F.nullif("sample", F.lit("s1")))):
        assert groups.loop_strength(wrong, bins, targets, results, LOOP).collect()[0].reason == "the contacts are invalid"


def test_replicate_sensitivity_and_user_engine(spark):
    said = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.02), ("f", "c", 0.9), ("g", "a", 0.9)], "f string, feature string, reported_padj double")
    redone = spark.createDataFrame([("f", "a", 0.01, 0.1), ("f", "b", 0.5, 9.0)], "f string, feature string, padj double, se double")
    got = {r.f: r for r in groups.replicate_sensitivity(said, redone, ["f"], "feature", SensitivityContract()).collect()}
    assert (got["f"].testable, got["f"].survivors, got["f"].powered_fraction) == (2, 1, 0.5)
    assert got["g"].applicability == "unsupported"
    bulk = spark.createDataFrame([(f"r{i}", i % 2, "x", 5 + i) for i in range(6)], "replicate string, arm int, feature string, total long")
    fit = lambda pdf: pd.DataFrame({"feature": pdf.feature[:1], "replicates": [len(pdf)], "effect": [1.0], "se": [0.5], "p": [0.1]})
    assert engines.user_engine(bulk, fit).collect()[0].replicates == 6
    assert engines.log_cpm_ols(bulk).collect()[0].replicates == 6


def test_pseudobulk_gates(spark):
    cells = [("r%d" % i, "c" if i < 3 else "t", g, 1 + i) for i in range(6) for g in ("x", "y")] + [("r0", "c", "zero", 0)]
    df = spark.createDataFrame(cells, "r string, c string, f string, v long")
    ok = groups.pseudobulk(df, "r", "c", "f", "v", "c", "t").collect()
    assert {row.applicability for row in ok} == {"applicable"} and {row.f for row in ok} == {"x", "y"}
    few = groups.pseudobulk(df.where("r <> 'r5'"), "r", "c", "f", "v", "c", "t").collect()
    assert {row.reason for row in few} == {"too few replicates in one level"}


def design_rows(spark, rows):
    return spark.createDataFrame(rows, "case string, cell string, donor string, condition string, batch string, lane string")


CONTRACT = DesignContract("condition", "control", "treated", ["donor"], ["donor", "batch"], required_adjustments=["batch"], fitted_fixed=["batch"])


def test_design_integrity_finds_merged_groups_and_pairs(spark):
    df = design_rows(spark, [
        ("x", "c1", "d1", "control", "b1", "l1"), ("x", "c2", "d1", "treated", "b1", "l1"), ("x", "c3", "d2", "control", "b2", "l1"),
        ("x", "c4", "d2", "treated", "b2", ""), ("x", "c5", "d3", "other", "b2", ""),
        ("clean", "c1", "d1", "control", "b1", ""), ("clean", "c2", "d2", "treated", "b1", ""), ("clean", "c3", "d3", "treated", "b2", ""), ("clean", "c4", "d4", "control", "b2", ""),
        ("gap", "c1", "", "control", "b1", ""), ("gap", "c2", "d2", "treated", "b1", ""),
        ("one", "c1", "d1", "control", "b1", ""),
    ])
    got = {r.case: r for r in design.design_integrity(df, CONTRACT, ["case"]).collect()}
    assert (got["x"].merged_groups, got["x"].complete_pairs, got["x"].pairing_omitted) == (2, 2, True)
    assert got["x"].comparison_outcome == "nonconformant" and got["x"].contrast_rows == 4
    assert got["clean"].comparison_outcome == "conformant"
    assert got["gap"].applicability == got["one"].applicability == "unsupported"


@pytest.mark.parametrize("seed, factors, per_task", [(0, 2, 10**6), (1, 2, 1), (2, 3, 10**6), (3, 3, 2), (4, 4, 3), (5, 1, 1)])
def test_aliasing_matches_matrix_rank(spark, seed, factors, per_task):
    """By elimination in one task, in many parts that meet, and by potentials around cycles."""
    rng = random.Random(seed)
    rows, want = [], {}
    for case in range(12):
        cells = []
        levels = [[f"{f}{i}" for i in range(rng.choice([2, 3, 5]))] for f in range(factors)]
        effect = {x: rng.choice([0, 0, 1]) for x in itertools.chain(*levels)}
        for cell in itertools.product(*levels):
            if rng.random() < (0.8 if case % 4 < 3 else 0.3):
                total = sum(effect[x] for x in cell)
                arm = total == 1 if case % 2 else rng.random() < 0.5
                cells.append((str(case), *cell, "t" if arm else "c"))
        cells = cells or [(str(case), *[x[0] for x in levels], "t")]
        rows += [(*c, 1) for c in cells]
        columns = [[1.0] * len(cells)]
        for pos in range(1, factors + 1):
            for level in sorted({c[pos] for c in cells})[1:]:
                columns.append([float(c[pos] == level) for c in cells])
        x = np.array(columns).T
        y = np.array([[float(c[-1] == "t")] for c in cells])
        want[str(case)] = bool(np.linalg.matrix_rank(np.hstack([x, y])) == np.linalg.matrix_rank(x))
    names = list("abde"[:factors])
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in ["case", *names, "arm"]) + ", _n long")
    contract = DesignContract("arm", "c", "t", ["a"], ["a"], required_adjustments=names)
    assert {r.case: r.aliased for r in design.aliasing(df, contract, ["case"], equations_per_task=per_task).collect()} == want
    assert factors == 1 or set(want.values()) == {True, False}


@pytest.mark.parametrize("per_task", [10**6, 1000])
def test_aliasing_has_no_highest_number_of_levels(spark, per_task):
    """One case without a key, 6,000 levels: a path of cells with one cycle that closes, or does not."""
    n = 3000
    path = [(f"a{i}", f"b{i}", "t" if i % 3 == 0 else "c") for i in range(n)] + [(f"a{i + 1}", f"b{i}", "c") for i in range(n - 1)]
    contract = DesignContract("arm", "c", "t", ["b"], ["b"], required_adjustments=["a", "b"])
    potential = {"a0": 0}
    for i in range(n):
        potential[f"b{i}"] = potential[f"a{i}"] - (i % 3 == 0)
        potential[f"a{i + 1}"] = potential[f"b{i}"]
    # A cell over half the path may only say what the path says.
    far = next((i, j) for i in range(5, n) for j in (n - 1 - i,) if potential[f"a{i}"] - potential[f"b{j}"] in (0, 1))
    value = potential[f"a{far[0]}"] - potential[f"b{far[1]}"]
    for said in (value, 1 - value):
        frame = spark.createDataFrame([*path, (f"a{far[0]}", f"b{far[1]}", "t" if said else "c")], "a string, b string, arm string").repartition(8)
        got = design.aliasing(frame, contract, [], equations_per_task=per_task).collect()
        assert [r.aliased for r in got] == [said == value]


def test_a_missing_level_leaves_its_case_undecided(spark):
    rows = [("k", "x", None, "t"), ("k", "y", "u", "c"), ("m", "x", "", "t"), ("n", "x", "u", "t"), ("n", "y", "u", "c")]
    contract = DesignContract("arm", "c", "t", ["b"], ["b"], required_adjustments=["a", "b"])
    frame = spark.createDataFrame(rows, "case string, a string, b string, arm string")
    assert {r.case: r.aliased for r in design.aliasing(frame, contract, ["case"]).collect()} == {"k": None, "m": None, "n": True}
    assert design.aliasing(frame.limit(0), contract, ["case"]).count() == 0


def test_unit_multiplicity_and_empty_keys(spark):
    df = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "a"), ("y", ""), ("y", "b")], "case string, unit string")
    got = {r.case: r for r in design.unit_multiplicity(df, ["unit"], ["case"]).collect()}
    assert (got["x"].nominal_n, got["x"].effective_n, got["x"].repeated_units) == (3, 2, 1)
    assert got["y"].applicability == "unsupported"


def test_dependence_counts_checks_of_every_binding(spark):
    fixed = ["established"] * len(design.DIMENSIONS)
    names = ", ".join(f"{d}_state string" for d in design.DIMENSIONS)
    rows = [(c, *fixed, "t", p, "u", "claim", "evaluation_candidate", 0, 0) for c, p in ((1, "p"), (2, "p"), (3, None), (4, "p"))]
    cases = spark.createDataFrame(rows, f"case_id int, {names}, analysis_target string, procedure_ref string, unit_definition string, affected_target_ref string, output_ceiling string, unresolved int, unsupported int")
    units = spark.createDataFrame([(c, 1) for c in (1, 2, 3, 4)], "case_id int, repeated_units int")
    checks = [(c, s, "absent", "t", p, "u") for c, p in ((1, "p"), (2, "p"), (3, None)) for s in design.SAFEGUARDS]
    checks += [(2, design.SAFEGUARDS[0], "present", "t", None, "u")]  # looked for twice, once for another procedure
    checks += [(4, design.SAFEGUARDS[0], "present", "t", "p", "u")] * 7  # one safeguard seven times
    found = spark.createDataFrame(checks, "case_id int, safeguard_id string, state string, analysis_target string, procedure_ref string, unit_definition string")
    for n_cases in (None, 10**7):
        got = {r.case_id: (r.reason_code, r.safeguards_present) for r in design.dependence_decision(cases, units, found, n_cases=n_cases).collect()}
        assert got == {
            1: ("repeated_units_without_dependence_safeguard", 0), 2: ("unresolved_safeguard_binding", 1),
            3: ("repeated_units_without_dependence_safeguard", 0), 4: ("incomplete_safeguard_protocol", 7),
        }


def test_declared_units_reject_other_columns(spark):
    from plumbline.contracts import ContractError

    df = spark.createDataFrame([("x", "c1", "s", "p1"), ("x", "c2", "s", "p1")], "case_id string, cell_id string, sample_id string, participant_id string")
    got = design.declared_units(df, "single_cell").collect()[0]
    assert (got.repeated_units, got.applicability) == (1, "applicable")
    with pytest.raises(ContractError):
        design.declared_units(df, "longitudinal")
    twice = design.declared_units(df.unionByName(df.limit(1)), "single_cell").collect()[0]
    assert twice.applicability == "unsupported"
    assert df.where(F.col("case_id") == "x").count() == 2


def test_aliasing_does_not_depend_on_counts(spark):
    rows = [("k", a, b, "t" if a == "0" else "c", 10**10) for a in "01" for b in "xy"]
    contract = DesignContract("arm", "c", "t", ["b"], ["b"], required_adjustments=["a", "b"])
    schema = "case string, a string, b string, arm string, _n long"
    aliased = lambda r: [x.aliased for x in design.aliasing(spark.createDataFrame(r, schema), contract, ["case"]).collect()]
    assert aliased(rows) == [True]
    assert aliased([*rows, ("k", "0", "x", "c", 2)]) == [False]
    odd = [("k", a, b, "t" if a == b else "c", 10**10) for a in "01" for b in "01"]
    assert aliased(odd) == [False]


def test_a_case_with_many_levels_is_decided(spark):
    rows = [("k", str(i), str(-i), "t" if i % 2 else "c", 1) for i in range(2100)] + [("m", "0", "x", "t", 1), ("m", "1", "x", "c", 1)]
    contract = DesignContract("arm", "c", "t", ["b"], ["b"], required_adjustments=["a", "b"])
    frame = spark.createDataFrame(rows, "case string, a string, b string, arm string, _n long")
    assert {r.case: r.aliased for r in design.aliasing(frame, contract, ["case"]).collect()} == {"k": True, "m": True}


def test_aliasing_attaches_rows_of_nodes_with_many_edges(spark, monkeypatch):
    weights = []
    attach = design.attach
    monkeypatch.setattr(design, "attach", lambda rows, table, keys, weight: weights.append(weight) or attach(rows, table, keys, weight))
    cells = spark.createDataFrame([(0, "hub", str(i), i % 2) for i in range(40)] + [(0, "x", "0", 1), (0, "x", "1", 1)], "site int, _f0 string, _f1 string, y int")
    assert [r.site for r in design._broken_cycles(cells, ["site"]).distinct().collect()] == [0] and set(weights) == {"_n"}


@pytest.mark.parametrize("heavy_parts", [0, 2000])
def test_aliasing_graph_shrinks_turn_by_turn(spark, monkeypatch, heavy_parts):
    """Levels read in order or attached, one case without a name; what the turns write in all is no more than the rows."""
    rng, rows = random.Random(7), []
    for case in (None, "k", "m", "n"):
        left, right = ([rng.choice([0, 0, 1]) for _ in range(400)] for _ in "ab")
        pairs = {(rng.randrange(400), rng.randrange(400)) for _ in range(600)}
        rows += [(case, f"a{i}", f"b{j}", "t" if left[i] + right[j] else "c") for i, j in pairs if left[i] + right[j] < 2]
        (i, k), (j, m) = [x for x in range(400) if not left[x]][:2], [x for x in range(400) if not right[x]][:2]
        rows += [(case, f"a{x}", f"b{y}", "c") for x, y in ((i, j), (i, m), (k, j))] + [(case, f"a{k}", f"b{m}", "t" if case in (None, "m") else "c")]
    written, cut = [], design.cut_lineage
    monkeypatch.setattr(design, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    monkeypatch.setattr(design, "HEAVY_PARTS", heavy_parts, raising=False)
    monkeypatch.setattr(design, "ROWS_PER_TASK", 0, raising=False)
    frame = spark.createDataFrame(rows, "case string, a string, b string, arm string").repartition(4)
    contract = DesignContract("arm", "c", "t", ["b"], ["b"], required_adjustments=["a", "b"])
    got = {r.case: r.aliased for r in design.aliasing(frame, contract, ["case"], equations_per_task=100).collect()}
    assert got == {None: False, "k": True, "m": False, "n": True}
    sizes = [table.count() for table in written]
    assert sum(sizes) < 4 * len(rows), sizes
