from __future__ import annotations

import random
from decimal import Decimal, localcontext
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from plumbline import skew
from plumbline.contracts import ContractError, MultiplicityContract
from plumbline.operators import multiplicity as M
from plumbline.operators import validate as V

CONTRACT = MultiplicityContract("family", "test_id", "p", "q", "call", "0.05")


def twin(values):
    """Adjusted values as exact fractions, from the definition."""
    order = sorted(range(len(values)), key=lambda i: (values[i], i))
    out, low = [None] * len(values), Fraction(1)
    for rank in range(len(order), 0, -1):
        i = order[rank - 1]
        low = min(low, values[i] * len(values) / rank)
        out[i] = low
    return out


@pytest.mark.parametrize("rows_per_block", [10_000, 25])
def test_adjusted_values_match_the_definition(spark, rows_per_block):
    rng = random.Random(1)
    rows = []
    for family, n in (("a", 150), ("b", 40), ("c", 1)):
        ps = [Fraction(rng.choice([rng.randint(0, 1000), 5, 1000]), 1000) for _ in range(n)]
        rows += [(family, f"{family}{i}", float(p), float(q)) for i, (p, q) in enumerate(zip(ps, twin(ps)))]
    df = spark.createDataFrame(rows, "family string, id string, p double, want double").repartition(5)
    got = M.bh_adjust(df, ["family"], "p", rows_per_block=rows_per_block).collect()
    assert len(got) == len(rows)
    assert all(abs(r.adjusted - r.want) < 1e-12 for r in got)


def families(spark, change=None):
    """One family whose adjusted values are exact decimals, so a report can state them."""
    ps = ["0.01", "0.02", "0.04", "0.04", "0.5"]
    qs = ["0.05", "0.05", "0.05", "0.05", "0.5"]
    rows = [["f", f"t{i}", p, q, "true" if Decimal(q) <= Decimal("0.05") else "FALSE"] for i, (p, q) in enumerate(zip(ps, qs))]
    if change:
        change(rows)
    return spark.createDataFrame([tuple(r) for r in rows], "family string, test_id string, p string, q string, call string")


def verdict(spark, change=None):
    return M.bh_check(families(spark, change), CONTRACT).collect()[0]


def test_conformant_report(spark):
    r = verdict(spark)
    assert (r.applicability, r.comparison_outcome, r.adjusted_mismatches, r.reported_discoveries) == ("applicable", "conformant", 0, 4)


def test_wrong_value_is_found(spark):
    r = verdict(spark, lambda rows: rows[1].__setitem__(3, "0.050000000000000001"))
    assert (r.comparison_outcome, r.adjusted_mismatches) == ("nonconformant", 1)


def test_wrong_call_is_found(spark):
    r = verdict(spark, lambda rows: rows[4].__setitem__(4, "true"))
    assert (r.comparison_outcome, r.call_mismatches) == ("nonconformant", 1)


@pytest.mark.parametrize("column, value", [(2, "not-a-number"), (2, "1.2"), (3, "-0.1"), (4, "yes"), (1, ""), (1, "t0"), (2, "NaN"), (2, "1.0000000000000000000000001"), (3, "0x1")])
def test_one_bad_row_stops_the_family(spark, column, value):
    r = verdict(spark, lambda rows: rows[2].__setitem__(column, value))
    assert (r.applicability, r.comparison_outcome) == ("unsupported", "unknown")
    assert r.adjusted_mismatches is None and r.reason


def test_bad_family_leaves_others_alone(spark):
    good = families(spark)
    bad = families(spark, lambda rows: [row.__setitem__(0, "g") for row in rows] and rows[0].__setitem__(2, "x"))
    got = {r.family: r.comparison_outcome for r in M.bh_check(good.unionByName(bad).repartition(6), CONTRACT).collect()}
    assert got == {"f": "conformant", "g": "unknown"}


def test_exact_equality_agrees_with_fifty_digits(spark):
    rng = random.Random(3)
    ps = [Decimal(rng.randint(1, 60)) / 64 for _ in range(60)]
    with localcontext() as ctx:
        ctx.prec = 50
        want = [min(Decimal(v.numerator) / Decimal(v.denominator), Decimal(1)) for v in twin([Fraction(p) for p in ps])]
    rows = [("f", f"t{i}", str(p), str(w.quantize(Decimal(10) ** -18)), "true") for i, (p, w) in enumerate(zip(ps, want))]
    df = spark.createDataFrame(rows, "family string, test_id string, p string, q string, call string")
    _, out = M.bh_recheck_rows(df, CONTRACT)
    got = {r.test_id: r.adjusted_differs for r in out.collect()}
    for (_, i, _, q, _), w in zip(rows, want):
        assert got[i] == (Decimal(q) != w)


def test_correction_scope(spark):
    ps = [Fraction(i, 100) for i in (1, 2, 3, 50, 60)]
    full, part = twin(ps), twin(ps[:3])
    rows = [("full", f"{i}", str(float(p)), str(float(q))) for i, (p, q) in enumerate(zip(ps, full))]
    rows += [("part", f"{i}", str(float(p)), str(float(part[i])) if i < 3 else None) for i, p in enumerate(ps)]
    rows += [("odd", f"{i}", str(float(p)), "0.9") for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "family string, id string, p string, q string")
    got = {r.family: r.scope for r in M.correction_scope(df, ["family"], "id", "p", "q", scale=12).collect()}
    assert got == {"full": "complete", "part": "subset", "odd": "mismatch"}


def test_correction_scope_is_the_same_when_rows_are_dealt(spark, monkeypatch):
    ps = [[Fraction(f * i, 4000) for i in range(1, 41)] for f in range(1, 9)]
    rows = [(f"f{n}", f"{i}", str(float(p)), str(float(q)) if n % 2 or i < 20 else None) for n, x in enumerate(ps) for i, (p, q) in enumerate(zip(x, twin(x)))]
    df = spark.createDataFrame(rows, "family string, id string, p string, q string")
    whole = sorted(M.correction_scope(df, ["family"], "id", "p", "q", scale=12).collect(), key=str)
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 30)
    levels = M.bh_levels(df.withColumn("p", F.col("p").cast("double")), ["family"], "p", rows=320)
    assert levels.rdd.getNumPartitions() >= 10
    assert sorted(M.correction_scope(df, ["family"], "id", "p", "q", scale=12).collect(), key=str) == whole


def test_binding_needs_distinct_existing_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    for roles in ({"x": "a", "y": "a"}, {"x": "c"}):
        with pytest.raises(ContractError):
            V.bind_columns(df, roles)


def test_empty_family_is_unsupported(spark):
    gate = V.family_gate(V.validate_cells(families(spark), [V.nonempty("test_id")]), ["family"], ["test_id"])
    expected = spark.createDataFrame([("f",), ("empty",)], "family string")
    got = {r.family: (r.applicability, r.n_rows) for r in V.with_empty_families(gate, expected, ["family"]).collect()}
    assert got == {"f": ("applicable", 5), "empty": ("unsupported", 0)}


SPELLINGS = ["0", "-0", "0.000", "1", "1.0", "01", "+1", " 1 ", "1_0e-1", "1e0", "1E-30", "5e-324", "0.1234567890123456789012345678901234567890", ".5", "5.", "0.10"]


def test_numbers_are_read_exactly(spark):
    from pyspark.sql import functions as F

    from plumbline.functions import exact as E

    bad = ["", ".", "e5", "1e", "nan", "inf", "--1", "1 0", "0x1", "1__0", None]
    rows = [(x,) for x in SPELLINGS + ["-0.5", "1.1", "1e5", *bad]]
    read = spark.createDataFrame(rows, "t string").select("t", E.parse(F.col("t")).alias("n"), E.in_unit(E.parse(F.col("t"))).alias("unit"))
    for r in read.collect():
        try:
            value = Decimal(r.t) if r.t is not None else Decimal("nan")
        except ArithmeticError:
            value = Decimal("nan")
        if not value.is_finite():
            assert r.n is None and not r.unit, r.t
            continue
        digits = Fraction(int(r.n.digits or 0)) * Fraction(10) ** (r.n.exponent - len(r.n.digits) if r.n.digits else 0)
        assert (-digits if r.n.negative else digits) == Fraction(value) and r.unit == (0 <= value <= 1), r.t


def test_quotients_order_exactly(spark):
    from pyspark.sql import functions as F

    from plumbline.functions import exact as E

    rng = random.Random(8)
    rows = [(rng.choice(SPELLINGS[:1] + SPELLINGS[9:]), rng.choice([1, 2, 3, 7, 10, 999, 10**13 - 1, 10**12])) for _ in range(60)]
    rows += [("0.3333333333333333333333333333333333333333", 10**12 - 1), ("0.3333333333333333333333333333333333333334", 10**12 - 1)]
    rows += [(f"{k}e-3", k) for k in range(1, 40)]
    frame = spark.createDataFrame(rows, "t string, r long")
    keyed = frame.select("t", "r", E.quotient_key(E.parse(F.col("t")), F.col("r"), E.digits_for(40)).alias("k")).collect()
    for a in keyed:
        for b in keyed:
            x, y = Fraction(Decimal(a.t)) / a.r, Fraction(Decimal(b.t)) / b.r
            assert (a.k < b.k, a.k == b.k) == (x < y, x == y), (a, b)
    some = frame.select(E.parse(F.col("t")).alias("n"), "r", "t")
    two = some.crossJoin(some.select(F.col("n").alias("m"), F.col("r").alias("s"), F.col("t").alias("u")))
    one = [F.col("n"), F.col("r"), E.double_of(F.col("n"))]
    other = [F.col("m"), F.col("s"), E.double_of(F.col("m"))]
    for r in two.select("t", "r", "u", "s", E.compare_quotients(*one, *other).alias("sign")).collect():
        x, y = Fraction(Decimal(r.t)) / r.r, Fraction(Decimal(r.u)) / r.s
        assert r.sign == (x > y) - (x < y), r


@pytest.mark.parametrize("rows_per_block", [10_000, 25])
def test_long_and_tiny_p_values_are_compared_exactly(spark, rows_per_block):
    rng = random.Random(11)
    rows, want = [], {}
    for family in ("deep", "long"):
        ps = [Decimal(rng.randint(1, 9999)).scaleb(-38) if family == "deep" else Decimal(rng.randint(1, 10**19)).scaleb(-19) for _ in range(64)]
        for i, (p, q) in enumerate(zip(ps, twin([Fraction(p) for p in ps]))):
            with localcontext() as ctx:
                ctx.prec = 60
                near = (Decimal(q.numerator) / Decimal(q.denominator)).quantize(Decimal(10) ** -55).normalize()
            text = format(near, "f") if rng.random() < 0.5 else f"{near:e}"
            rows.append((family, f"{family}{i}", f"{p:e}", text, str(q <= Fraction(1, 20))))
            want[f"{family}{i}"] = Fraction(near) != q
    frame = spark.createDataFrame(rows, "family string, test_id string, p string, q string, call string").repartition(4)
    gate, out = M.bh_recheck_rows(frame, CONTRACT, rows_per_block=rows_per_block)
    assert {r.applicability for r in gate.collect()} == {"applicable"}
    got = out.collect()
    assert {r.test_id: r.adjusted_differs for r in got} == want and len(set(want.values())) == 2
    assert not any(r.call_differs for r in got)


def test_adjusting_refuses_a_family_with_a_bad_value(spark):
    bad = [("nan", float("nan")), ("wide", 1.7), ("none", None)]
    rows = [(f, i, 0.01 * i) for f in ("good", "nan", "wide", "none") for i in range(1, 5)] + [(f, 0, p) for f, p in bad]
    got = M.bh_adjust(spark.createDataFrame(rows, "family string, id int, p double"), ["family"], "p").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.applicability == "applicable") == (r.family == "good") == (r.adjusted is not None) == (r.rank is not None)


def test_scope_of_a_bad_family_is_unknown(spark):
    rows = [("ok", "a", "0.01", "0.01"), ("cell", "a", "0.01", "0.01"), ("cell", "b", "x", None), ("cell2", "a", "0.01", "y"), ("twice", "a", "0.01", None), ("twice", "a", "0.02", None)]
    frame = spark.createDataFrame(rows, "family string, id string, p string, q string")
    got = {r.family: (r.applicability, r.scope) for r in M.correction_scope(frame, ["family"], "id", "p", "q").collect()}
    assert got == {"ok": ("applicable", "complete"), "cell": ("unsupported", None), "cell2": ("unsupported", None), "twice": ("unsupported", None)}


def test_hostile_families_are_numbered_without_one_window(spark):
    from plumbline.plans.statistics import hostile

    table = spark.range(1000).selectExpr("'A' AS family", "concat('t', id) AS test_id", "'0.5' AS p", "'0.5' AS reported", "'true' AS call")
    rows = hostile(table)
    assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {r.p for r in rows.where("family = 'deep'").collect()} == {f"{n}e-38" for n in range(1, 1001)}
    assert [rows.where(f"family = '{f}' AND {bad}").count() for f, bad in (("twice", "test_id = 'x'"), ("nan", "p = 'NaN'"), ("wide", "p LIKE '1.%'"))] == [2, 1, 1]


@pytest.mark.parametrize("scale", [6, None])
def test_correction_scope_judges_families_where_they_are(spark, monkeypatch, scale):
    """The same verdicts for families in one place, in blocks, and with long numbers; rows in one place are not written."""
    rng, rows, want = random.Random(5), [], {}
    unit = Fraction(1, 10**6)
    for n, family in enumerate(["a", "b", "c", "d", None, "far", "twice", "bad"]):
        size = 20 if family is None else 60
        ps = [Fraction(rng.randint(0, 200) ** 2, 40_000) + (Fraction(1, 10**20) * (family == "far")) for _ in range(size)]
        given = [i for i in range(size) if n % 2 or i % 3]
        values = twin([ps[i] for i in given]) if n < 3 else [twin(ps)[i] for i in given]
        said = {i: min(int(v / unit + Fraction(1, 2)) + (n == 2 and i % 7 == 0), 10**6) * unit for i, v in zip(given, values)}
        spelt = lambda v: str(Decimal(v.numerator) / Decimal(v.denominator))
        rows += [(family, f"{i}", spelt(min(p, Fraction(1))), spelt(said[i]) if i in said else None) for i, p in enumerate(ps)]
        if family in ("twice", "bad"):
            rows += [(family, "3" if family == "twice" else "60", "0.5" if family == "twice" else "?", None)]
            want[family] = ("unsupported", None, None, None, None, None)
            continue

        def wrong(i, value):
            low, high = said[i] - unit / 2, said[i] + unit / 2
            return said[i] != value if scale is None else not (high > 1 if value == 1 else (low <= 0 or value >= low) and value < high)

        full, part = twin([min(p, Fraction(1)) for p in ps]), dict(zip(given, twin([min(ps[i], Fraction(1)) for i in given])))
        misses = sum(wrong(i, full[i]) for i in given), sum(wrong(i, part[i]) for i in given)
        want[family] = ("applicable", size, len(given), *misses, "complete" if not misses[0] else "mismatch" if misses[1] else "subset")
    assert scale is None or {w[-1] for w in want.values()} == {"complete", "subset", "mismatch", None}
    df = spark.createDataFrame(rows, "family string, id string, p string, q string").repartition(5)

    def verdicts(frame, **how):
        out = M.correction_scope(frame, ["family"], "id", "p", "q", scale=scale, **how).collect()
        return {r.family: (r.applicability, r.family_rows, r.corrected_rows, r.full_mismatches, r.subset_mismatches, r.scope) for r in out}

    assert verdicts(df) == want
    assert verdicts(df, rows_per_block=50) == want
    written = []
    for module in (M, skew):
        monkeypatch.setattr(module, "cut_lineage", lambda x, cut=module.cut_lineage: written.append(cut(x)) or written[-1])
    near = df.where("family IS NULL OR family <> 'far'")
    assert verdicts(near.repartition(3, "family"), together=True) == {k: v for k, v in want.items() if k != "far"}
    assert [table.count() for table in written] == [len(want) - 1]
    written.clear()
    verdicts(near)
    assert sum(table.count() for table in written) <= near.count() + 2 * len(want)
