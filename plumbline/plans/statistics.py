"""Queries for the statistical recheck operators."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.contracts import (
    DesignContract,
    LoopContract,
    MultiplicityContract,
    Predicate,
    SensitivityContract,
)
from plumbline.operators import design, filters, groups, multiplicity
from plumbline.operators import validate as V
from plumbline.plans.registry import Tables, query
from plumbline.session import cut_lineage
from plumbline.skew import dealt, numbered, per_key
from plumbline.operators.engines import log_cpm_ols as engine_se


def tests(t: Tables) -> DataFrame:
    """One hypothesis per line item with the exact p-value (k/10000)^2."""
    return t.lineitem.select(
        F.col("l_returnflag").alias("family"),
        F.col("l_suppkey").alias("supplier"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long")).alias("test_id"),
        F.expr("(l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 10000").alias("k"),
        F.col("l_extendedprice").alias("price"),
    ).withColumn("p", p_of("k"))


def p_of(k: str) -> Column:
    return (F.col(k) * F.col(k)).cast("decimal(12,0)") * F.lit(Decimal("0.00000001"))


# SQL twins.  bh(): distinct levels k of a family, rank of the last tie, the step that sets the
# adjusted value.  Ratios k*k/rank are compared as exact fractions scaled to integers.
TESTS = """tests AS (
  SELECT l_returnflag AS family, l_suppkey AS supplier,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS test_id, l_extendedprice AS price,
    (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 10000 AS k FROM lineitem)"""


def bh(family: str, source: str = "tests", name: str = "lv") -> str:
    return f"""{name}_n AS (SELECT {family} AS fam, k, count(*) AS n FROM {source} GROUP BY ALL),
{name}_r AS (SELECT fam, k, n, sum(n) OVER (PARTITION BY fam ORDER BY k) AS r, sum(n) OVER (PARTITION BY fam) AS m FROM {name}_n),
{name}_s AS (SELECT fam, k, r, m, CAST(k AS HUGEINT)*k*1000000000000000000 // r AS q FROM {name}_r),
{name} AS (SELECT fam, k, r, m, min(struct_pack(q := q, k := k, r := r)) OVER (PARTITION BY fam ORDER BY k DESC) AS s FROM {name}_s)"""


@query(
    "bh_adjust",
    f"WITH {TESTS}, {bh('supplier')}, state AS (SELECT supplier, bool_or(supplier % 17 = 3 AND k % 10 = 1 OR supplier % 17 = 4 AND k % 10 = 2 "
    "OR supplier % 17 = 5 AND k % 10 = 3) AS bad FROM tests GROUP BY ALL) "
    "SELECT t.supplier, t.test_id, CASE WHEN bad THEN 'unsupported' ELSE 'applicable' END AS applicability, "
    "CASE WHEN NOT bad THEN CAST(l.r AS BIGINT) END AS rank_of_last_tie, CASE WHEN NOT bad THEN least((s.k*s.k/1e8)*m/s.r, 1.0) END AS adjusted "
    "FROM tests t JOIN lv l ON t.supplier = l.fam AND t.k = l.k JOIN state USING (supplier)",
)
def bh_adjust(t: Tables) -> DataFrame:
    family, k = F.col("supplier") % 17, F.col("k") % 10
    p = (
        F.when((family == 3) & (k == 1), F.lit(float("nan")))
        .when((family == 4) & (k == 2), F.lit(None))
        .when((family == 5) & (k == 3), F.lit(1.7))
        .otherwise(F.col("p").cast("double"))
    )
    return multiplicity.bh_adjust(tests(t).select("supplier", "test_id", p.alias("p")), ["supplier"], "p").select(
        "supplier", "test_id", "applicability", F.col("rank").alias("rank_of_last_tie"), "adjusted"
    )


def reported(t: Tables) -> DataFrame:
    """A report of the recheck: values rounded half up to 8 decimals, some of them changed."""
    rows = tests(t)
    # Doubles keep these ratios apart: k * k / rank of different value differ by more than their rounding.
    rows = rows.withColumn("number", F.col("p").cast("double"))
    levels = multiplicity.bh_levels(rows, ["family"], "number").withColumn("best_p", F.col("best_p").cast("decimal(20,8)"))
    units = F.expr(
        "least((cast(best_p * 100000000 as bigint) * family_size * 2 + best_rank) div (2 * best_rank), 100000000)"
    )
    levels = levels.select("family", "number", "n_tests", units.cast("bigint").alias("u"))
    joined = multiplicity.attach(rows, levels, ["family", "number"], "n_tests")
    changed = F.when((F.col("k") % 97 == 0) & (F.col("u") > 1), F.col("u") - 1).otherwise(F.col("u"))
    table = cut_lineage(
        joined.select(
            "family",
            "test_id",
            F.col("p").cast("string").alias("p"),
            (changed.cast("decimal(10,0)") * F.lit(Decimal("0.00000001"))).cast("string").alias("reported"),
            F.when((F.col("u") <= 5000000) != (F.col("k") % 101 == 7), F.lit("true")).otherwise(F.lit("False")).alias("call"),
        )
    )
    return cut_lineage(table.unionByName(hostile(table)))


def hostile(table: DataFrame) -> DataFrame:
    """Families of the same rows with p-values of 1e-30 and less, a repeated test, one cell that is not a number, and
    one beyond 1.  The first is sound and stays below every level, the others are refused."""
    # One family may hold a third of all rows, so its rows are numbered part by part.
    few = cut_lineage(numbered(table.where("family = 'A'"), ["test_id"]).withColumn("n", F.col("idx") + 1).drop("idx"))
    deep = few.select(
        F.lit("deep").alias("family"), "test_id", F.concat("n", F.lit("e-38")).alias("p"), F.lit("0.00000000").alias("reported"), F.lit("TRUE").alias("call")
    )
    twice = few.withColumns({"family": F.lit("twice"), "test_id": F.when(F.col("n") == 2, F.lit("x")).when(F.col("n") == 1, F.lit("x")).otherwise(F.col("test_id"))})
    nan = few.withColumns({"family": F.lit("nan"), "p": F.when(F.col("n") == 3, F.lit("NaN")).otherwise(F.col("p"))})
    wide = few.withColumns({"family": F.lit("wide"), "p": F.when(F.col("n") == 3, F.lit("1.0000000000000000000001")).otherwise(F.col("p"))})
    out = deep
    for part in (twice, nan, wide):
        out = out.unionByName(part.select(*table.columns))
    return out


HOSTILE = """SELECT v.family, n AS n_rows, v.state AS applicability, v.reason, CASE WHEN v.state = 'applicable' THEN n END AS reported_discoveries,
      CASE WHEN v.state = 'applicable' THEN n END AS recomputed_discoveries, CASE WHEN v.state = 'applicable' THEN 0 END AS adjusted_mismatches,
      CASE WHEN v.state = 'applicable' THEN 0 END AS call_mismatches, CASE WHEN v.state = 'applicable' THEN 'conformant' ELSE 'unknown' END AS comparison_outcome
    FROM (SELECT count(*) AS n FROM tests WHERE family = 'A'), (VALUES ('deep', 'applicable', NULL), ('twice', 'unsupported', 'identifiers are duplicated'),
      ('nan', 'unsupported', 'raw is not an exact decimal in [0, 1]'), ('wide', 'unsupported', 'raw is not an exact decimal in [0, 1]')) v(family, state, reason)
    WHERE n > 2"""

REPORTED = f"""{TESTS}, {bh('family')},
reported AS (SELECT t.family, t.test_id, t.k, l.m, l.s.k AS bk, l.s.r AS br,
  least((CAST(l.s.k AS HUGEINT)*l.s.k*l.m*2 + l.s.r) // (2*l.s.r), 100000000) AS u
  FROM tests t JOIN lv l ON t.family = l.fam AND t.k = l.k),
marked AS (SELECT *, CASE WHEN k % 97 = 0 AND u > 1 THEN u - 1 ELSE u END AS stated,
  (u <= 5000000) <> (k % 101 = 7) AS called, CAST(bk AS HUGEINT)*bk*m <= CAST(br AS HUGEINT)*5000000 AS true_call FROM reported),
diffed AS (SELECT *, stated <> u AS differs FROM marked)"""

CONTRACT = MultiplicityContract("family", "test_id", "p", "reported", "call", "0.05")


@query(
    "bh_check",
    f"""WITH {REPORTED} SELECT family, count(*) AS n_rows, 'applicable' AS applicability, NULL AS reason,
    count(*) FILTER (WHERE called) AS reported_discoveries, count(*) FILTER (WHERE true_call) AS recomputed_discoveries,
    count(*) FILTER (WHERE differs) AS adjusted_mismatches, count(*) FILTER (WHERE called <> true_call) AS call_mismatches,
    CASE WHEN count(*) FILTER (WHERE differs) = 0 AND count(*) FILTER (WHERE called <> true_call) = 0 THEN 'conformant' ELSE 'nonconformant' END
      AS comparison_outcome FROM diffed GROUP BY family UNION ALL {HOSTILE}""",
)
def bh_check(t: Tables) -> DataFrame:
    checked = multiplicity.bh_check(reported(t), CONTRACT, reported_scale=8)
    return checked.select(
        "family", "n_rows", "applicability", "reason", "reported_discoveries", "recomputed_discoveries",
        "adjusted_mismatches", "call_mismatches", "comparison_outcome",
    )


@query(
    "bh_mismatch_rows",
    f"""WITH {REPORTED} SELECT family, test_id, differs AS adjusted_differs, called <> true_call AS call_differs
    FROM diffed WHERE differs OR called <> true_call""",
)
def bh_mismatch_rows(t: Tables) -> DataFrame:
    _, rows = multiplicity.bh_recheck_rows(reported(t), CONTRACT, reported_scale=8)
    return rows.where(F.col("adjusted_differs") | F.col("call_differs")).select(
        "family", "test_id", "adjusted_differs", "call_differs"
    )


@query(
    "correction_scope",
    f"""WITH {TESTS}, part AS (SELECT * FROM tests WHERE supplier % 3 <> 0 OR price < 50000),
    {bh('supplier', 'part', 'pt')}, {bh('supplier', 'tests', 'fl')},
    said AS (SELECT p.supplier, p.k, least((CAST(s.k AS HUGEINT)*s.k*m*2 + s.r) // (2*s.r), 100000000) AS u
      FROM part p JOIN pt ON p.supplier = pt.fam AND p.k = pt.k),
    judged AS (SELECT said.supplier, count(*) AS corrected_rows,
      count(*) FILTER (WHERE u <> least((CAST(fl.s.k AS HUGEINT)*fl.s.k*fl.m*2 + fl.s.r) // (2*fl.s.r), 100000000)) AS full_mismatches
      FROM said JOIN fl ON said.supplier = fl.fam AND said.k = fl.k GROUP BY ALL),
    sizes AS (SELECT supplier, count(*) AS family_rows FROM tests GROUP BY ALL),
    state AS (SELECT supplier, bool_or(supplier % 13 = 5 AND k < 5000) AS bad FROM tests GROUP BY ALL)
    SELECT s.supplier, CASE WHEN bad THEN 'unsupported' ELSE 'applicable' END AS applicability, CASE WHEN NOT bad THEN s.family_rows END AS family_rows,
      CASE WHEN NOT bad THEN corrected_rows END AS corrected_rows, CASE WHEN NOT bad THEN full_mismatches END AS full_mismatches,
      CASE WHEN NOT bad THEN CAST(0 AS BIGINT) END AS subset_mismatches,
      CASE WHEN bad THEN NULL WHEN full_mismatches = 0 THEN 'complete' ELSE 'subset' END AS scope
    FROM sizes s JOIN judged USING (supplier) JOIN state USING (supplier)""",
)
def correction_scope(t: Tables) -> DataFrame:
    sizes = t.lineitem.groupBy("l_suppkey").count()
    n_rows, largest = sizes.agg(F.sum("count"), F.max("count")).head()
    together = (largest or 0) <= multiplicity.ROWS_PER_BLOCK
    inside = (F.col("supplier") % 3 != 0) | (F.col("price") < 50000)
    rows = tests(t).select("supplier", "test_id", "k", "p", inside.alias("inside"))
    if together:
        # A supplier's rows are in one place from here on.
        rows = dealt(rows.drop("p"), ["supplier"], n_rows).withColumn("k2", F.col("k") * F.col("k"))
        rows = multiplicity.ranked_together(rows, ["supplier"], "k2", {"part": F.col("inside")})
        u = "least((part_step.best * part_size * 2 + part_step.rank) div (2 * part_step.rank), 100000000)"
        said = rows.withColumn("p", p_of("k")).withColumn("u", F.expr(u))
    else:
        rows = rows.withColumn("number", F.col("p").cast("double"))
        levels = multiplicity.bh_levels(rows.where("inside"), ["supplier"], "number", rows=n_rows).withColumn("best_p", F.col("best_p").cast("decimal(20,8)"))
        u = "least((cast(best_p * 100000000 as bigint) * family_size * 2 + best_rank) div (2 * best_rank), 100000000)"
        levels = levels.select("supplier", "number", "n_tests", F.expr(u).cast("bigint").alias("u"))
        said = multiplicity.attach(rows, levels, ["supplier", "number"], "n_tests")
    said = said.withColumn("asserted", F.when(F.col("inside"), F.col("u").cast("decimal(10,0)") * F.lit(Decimal("0.00000001"))))
    # One supplier in thirteen has a cell that no number can be read from.
    p = F.when((F.col("supplier") % 13 == 5) & (F.col("k") < 5000), F.lit("n/a")).otherwise(F.col("p").cast("string"))
    return multiplicity.correction_scope(
        said.withColumn("p", p), ["supplier"], "test_id", "p", "asserted", scale=8, together=together
    ).drop("reason")


@query(
    "pvalue_family_gate",
    f"""WITH {TESTS}, g AS (SELECT supplier, count(*) AS n_rows, count(DISTINCT test_id) AS n_keys,
    count(*) FILTER (WHERE price < 910) AS bad FROM (SELECT * FROM tests UNION ALL SELECT * FROM tests WHERE supplier % 7 = 0 AND k < 100) GROUP BY ALL),
    r AS (SELECT *, CASE WHEN bad > 0 THEN 'p is not in [0, 1]' WHEN n_rows > n_keys THEN 'identifiers are duplicated' END AS reason FROM g)
    SELECT supplier, n_rows, n_keys, reason, CASE WHEN reason IS NULL THEN 'applicable' ELSE 'unsupported' END AS applicability FROM r""",
)
def pvalue_family_gate(t: Tables) -> DataFrame:
    p = F.when(F.col("price") < 910, F.lit("not-a-number")).otherwise(F.col("p").cast("string"))
    twice = tests(t).unionByName(tests(t).where("supplier % 7 = 0 AND k < 100"))
    rows = V.validate_cells(
        twice.withColumn("p", p), [V.nonempty("test_id"), V.trimmed("test_id"), V.unit_interval("p")]
    )
    gate = V.family_gate(rows, ["supplier"], ["test_id"])
    return gate.select("supplier", "n_rows", "n_keys", "reason", "applicability")


@query(
    "validate_cells",
    """SELECT event_id, CASE WHEN event_type = 'view' AND value < 5 THEN 'event_type is empty'
    WHEN event_id % 50 = 0 THEN 'event_type is not trimmed' WHEN value > 20 THEN 'share is not in [0, 1]'
    ELSE '' END AS first_reason FROM events""",
)
def validate_cells(t: Tables) -> DataFrame:
    rows = t.events.select(
        "event_id",
        F.when((F.col("event_type") == "view") & (F.col("value") < 5), F.lit(""))
        .when(F.col("event_id") % 50 == 0, F.concat(F.col("event_type"), F.lit(" ")))
        .otherwise(F.col("event_type"))
        .alias("event_type"),
        (F.col("value") / 20).cast("string").alias("share"),
    )
    checked = V.validate_cells(
        rows, [V.nonempty("event_type"), V.trimmed("event_type"), V.finite("share"), V.unit_interval("share")]
    )
    return checked.select(
        "event_id", F.coalesce(F.try_element_at("reasons", F.lit(1)), F.lit("")).alias("first_reason")
    )


@query(
    "bind_columns",
    "SELECT o_orderkey AS unit, o_custkey AS site, o_orderstatus AS level FROM orders",
)
def bind_columns(t: Tables) -> DataFrame:
    return V.bind_columns(t.orders, {"unit": "o_orderkey", "site": "o_custkey", "level": "o_orderstatus"})


@query(
    "binary_domain",
    """WITH g AS (SELECT s.source, count(*) AS n_rows, bool_and(coalesce(quality IN (0,1), false)) AS quality,
    bool_and(coalesce(toxic IN (0,1), false)) AS toxic FROM documents s LEFT JOIN labels USING (doc_id) GROUP BY ALL)
    SELECT source, n_rows, 'quality' AS column_name, quality AS is_binary FROM g
    UNION ALL SELECT source, n_rows, 'toxic', toxic FROM g""",
)
def binary_domain(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    return V.binary_domain(joined, ["quality", "toxic"], ["source"])


@query(
    "line_model_guard",
    r"""SELECT doc_id, CASE WHEN starts_with(text, chr(65279)) THEN 'byte_order_mark'
    WHEN regexp_matches(text, '[\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]') THEN 'ambiguous_lines'
    ELSE 'single' END AS line_model FROM documents""",
)
def line_model_guard(t: Tables) -> DataFrame:
    return V.line_model_guard(t.documents.select("doc_id", "text"), "text").select("doc_id", "line_model")


FUNNEL = [
    Predicate("l_quantity", ">=", 10.0),
    Predicate("l_discount", "<", 0.05),
    Predicate("l_linestatus", "==", "F"),
    Predicate("l_linenumber", "not_in", (1, 7)),
]


@query(
    "literal_filter",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 10
    AND l_discount < 0.05 AND l_linestatus = 'F' AND l_linenumber NOT IN (1, 7)""",
)
def literal_filter(t: Tables) -> DataFrame:
    return filters.literal_filter(t.lineitem, FUNNEL).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "selection_funnel",
    """WITH k AS (SELECT l_returnflag, l_quantity >= 10 AS a, l_discount < 0.05 AS b, l_linestatus = 'F' AS c,
      l_linenumber NOT IN (1,7) AS d FROM lineitem),
    g AS (SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE a) AS a, count(*) FILTER (WHERE b) AS b, count(*) FILTER (WHERE c) AS c, count(*) FILTER (WHERE d) AS d,
      count(*) FILTER (WHERE a AND b) AS ab, count(*) FILTER (WHERE a AND b AND c) AS abc, count(*) FILTER (WHERE a AND b AND c AND d) AS abcd FROM k GROUP BY ALL)
    SELECT l_returnflag, n AS n_rows, 1 AS step, 'l_quantity >= 10.0' AS predicate, 'threshold' AS decision_kind,
      a AS kept_alone, a AS kept_so_far, n - a AS removed_here FROM g
    UNION ALL SELECT l_returnflag, n, 2, 'l_discount < 0.05', 'threshold', b, ab, a - ab FROM g
    UNION ALL SELECT l_returnflag, n, 3, 'l_linestatus == F', 'filter', c, abc, ab - abc FROM g
    UNION ALL SELECT l_returnflag, n, 4, 'l_linenumber not_in (1, 7)', 'filter', d, abcd, abc - abcd FROM g""",
)
def selection_funnel(t: Tables) -> DataFrame:
    return filters.selection_funnel(t.lineitem, FUNNEL, ["l_returnflag"])


@query(
    "contrast_filter",
    """WITH marked AS (SELECT user_id, CASE WHEN user_id % 11 = 3 THEN 'other' ELSE event_type END AS event_type FROM events)
    SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS reference_rows, count(*) FILTER (WHERE event_type = 'view') AS test_rows,
    CASE WHEN count(*) FILTER (WHERE event_type = 'click') > 0 AND count(*) FILTER (WHERE event_type = 'view') > 0 THEN 'applicable'
    ELSE 'unsupported' END AS applicability FROM marked GROUP BY user_id""",
)
def contrast_filter(t: Tables) -> DataFrame:
    marked = F.when(F.col("user_id") % 11 == 3, F.lit("other")).otherwise(F.col("event_type"))  # groups without either level
    return filters.contrast_filter(t.events.withColumn("event_type", marked), "event_type", "click", "view", ["user_id"])


@query(
    "significant_subset",
    f"WITH {TESTS} SELECT family, test_id FROM tests WHERE k * k <= 2500000",
)
def significant_subset(t: Tables) -> DataFrame:
    return filters.significant_subset(tests(t), "p", 0.025).select("family", "test_id")


@query(
    "pvalue_domain_count",
    f"""WITH {TESTS}, g AS (SELECT supplier, count(*) AS n_rows, bool_and(k*k/9.99e7 <= 1) AS good FROM tests GROUP BY ALL)
    SELECT supplier, n_rows, CASE WHEN good THEN n_rows END AS calibrated_pvalues,
    CASE WHEN good THEN 'applicable' ELSE 'unsupported' END AS applicability FROM g""",
)
def pvalue_domain_count(t: Tables) -> DataFrame:
    stretched = tests(t).withColumn("p", F.col("k") * F.col("k") / F.lit(9.99e7))
    return filters.pvalue_domain_count(stretched, "p", ["supplier"])


@query(
    "open_items",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O'
    AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def open_items(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", F.lit("open")).otherwise(F.lit("answered"))
    verified = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return filters.open_items(t.orders.withColumn("status", status), verified, "o_custkey", "status").select(
        "o_orderkey", "o_custkey"
    )


@query(
    "mean_difference",
    """WITH g AS (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'A') AS left_rows, count(*) FILTER (WHERE l_returnflag = 'N') AS right_rows,
    avg(l_quantity) FILTER (l_returnflag = 'A') AS l, avg(l_quantity) FILTER (l_returnflag = 'N') AS r
    FROM lineitem WHERE l_returnflag IN ('A','N') GROUP BY ALL)
    SELECT l_suppkey, left_rows, right_rows, round(l - r, 8) AS mean_difference, 'A versus N' AS comparison,
    'unknown' AS orientation, 'applicable' AS applicability FROM g""",
)
def mean_difference(t: Tables) -> DataFrame:
    return groups.mean_difference(t.lineitem, "l_returnflag", "l_quantity", "A", "N", ["l_suppkey"]).select(
        "l_suppkey", "left_rows", "right_rows", F.round("mean_difference", 8).alias("mean_difference"),
        "comparison", "orientation", "applicability",
    )


@query(
    "effect_relevance",
    f"""WITH {TESTS}, g AS (SELECT supplier, count(*) AS n_rows, count(*) FILTER (WHERE k*k <= 5000000) AS significant_rows,
    count(*) FILTER (WHERE k*k <= 5000000 AND abs(price - 30000) < 2500) AS below_floor FROM tests GROUP BY ALL)
    SELECT supplier, n_rows, significant_rows, below_floor,
    round(CASE WHEN significant_rows > 0 THEN below_floor / significant_rows ELSE 0 END, 8) AS below_floor_fraction,
    'applicable' AS applicability,
    CASE WHEN below_floor = 0 THEN 'conformant' ELSE 'nonconformant' END AS comparison_outcome FROM g""",
)
def effect_relevance(t: Tables) -> DataFrame:
    rows = tests(t).withColumn("effect", F.col("price") - 30000)
    return groups.effect_relevance(rows, ["supplier"], "p", "effect", 0.05, 2500.0).withColumn(
        "below_floor_fraction", F.round("below_floor_fraction", 8)
    )


@query(
    "unit_multiplicity",
    """WITH u AS (SELECT o_orderpriority, o_custkey, count(*) AS n FROM orders GROUP BY ALL)
    SELECT o_orderpriority, CAST(sum(n) AS BIGINT) AS nominal_n, count(*) AS effective_n,
    count(*) FILTER (WHERE n > 1) AS repeated_units, max(n) AS largest_unit, 'applicable' AS applicability
    FROM u GROUP BY o_orderpriority""",
)
def unit_multiplicity(t: Tables) -> DataFrame:
    return design.unit_multiplicity(t.orders, ["o_custkey"], ["o_orderpriority"], rows=t.orders.count())


def dependence_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    states = F.array(*[F.lit(s) for s in ("established", "established", "established", "refuted", "unknown", "unsupported")])

    def state(divisor: int) -> F.Column:
        digit = F.floor(F.col("c_custkey") / divisor) % 23
        return F.get(states, F.when(digit < 20, F.lit(0)).otherwise(digit - 17).cast("int"))

    cases = t.customer.select(
        F.col("c_custkey").alias("case_id"),
        *[state(i + 1).alias(f"{d}_state") for i, d in enumerate(design.DIMENSIONS)],
        F.lit("target").alias("analysis_target"),
        F.lit("procedure").alias("procedure_ref"),
        F.lit("unit").alias("unit_definition"),
        F.when(F.col("c_custkey") % 11 != 0, F.lit("claim")).alias("affected_target_ref"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit("question_only"))
        .otherwise(F.lit("evaluation_candidate"))
        .alias("output_ceiling"),
        F.lit(0).alias("unresolved"),
        F.lit(0).alias("unsupported"),
    )
    orders = t.orders.withColumn("case_id", F.col("o_custkey"))
    units = design.unit_multiplicity(orders, ["o_orderpriority"], ["case_id"], rows=t.orders.count())
    checks = t.customer.select(
        F.col("c_custkey").alias("case_id"),
        F.posexplode(F.array(*[F.lit(s) for s in design.SAFEGUARDS])).alias("pos", "safeguard_id"),
    ).where((F.col("case_id") % 13 != 1) | (F.col("pos") != 3))
    checks = checks.select(
        "case_id",
        "safeguard_id",
        F.when((F.col("case_id") + F.col("pos")) % 37 == 0, F.lit("present"))
        .when((F.col("case_id") + F.col("pos")) % 71 == 0, F.lit("unknown"))
        .otherwise(F.lit("absent"))
        .alias("state"),
        F.lit("target").alias("analysis_target"),
        F.when((F.col("case_id") % 17 == 4) & (F.col("pos") == 0), F.lit("other"))
        .otherwise(F.lit("procedure"))
        .alias("procedure_ref"),
        F.lit("unit").alias("unit_definition"),
    )
    return cases, units, checks


def _dim_sql(i: int) -> str:
    digit = f"((c_custkey // {i}) % 23)"
    return (
        f"CASE WHEN {digit} < 20 THEN 'established' WHEN {digit} = 20 THEN 'refuted' "
        f"WHEN {digit} = 21 THEN 'unknown' ELSE 'unsupported' END"
    )


_DIMS = ", ".join(f"{_dim_sql(i + 1)} AS d{i}" for i in range(7))


@query(
    "dependence_decision",
    f"""WITH c AS (SELECT c_custkey AS case_id, {_DIMS} FROM customer),
    u AS (SELECT o_custkey AS case_id, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL),
    r AS (SELECT case_id, count(*) FILTER (WHERE n > 1) AS repeated FROM u GROUP BY ALL),
    s AS (SELECT c_custkey AS case_id, unnest(range(7)) AS pos FROM customer),
    k AS (SELECT case_id, count(*) AS checked, count(*) FILTER (WHERE (case_id + pos) % 37 = 0) AS present,
      count(*) FILTER (WHERE (case_id + pos) % 37 <> 0 AND (case_id + pos) % 71 = 0) AS unknown,
      count(*) FILTER (WHERE case_id % 17 = 4 AND pos = 0) AS unbound
      FROM s WHERE case_id % 13 <> 1 OR pos <> 3 GROUP BY ALL),
    j AS (SELECT c.*, coalesce(r.repeated, 0) AS repeated, k.* EXCLUDE case_id,
      [d0,d1,d2,d3,d4,d5,d6] AS ds FROM c LEFT JOIN r USING (case_id) JOIN k USING (case_id)),
    z AS (SELECT *, CASE WHEN list_contains(ds, 'unsupported') THEN 'unsupported_evidence'
      WHEN list_contains(ds, 'unknown') THEN 'unresolved_semantics'
      WHEN d0 <> 'established' OR d1 <> 'established' THEN 'unit_membership_not_established'
      WHEN repeated = 0 THEN 'one_observation_per_independent_unit'
      WHEN d2 = 'refuted' THEN 'observations_not_bound_to_analysis'
      WHEN d4 = 'refuted' THEN 'procedure_not_bound_to_analysis'
      WHEN checked < 7 THEN 'incomplete_safeguard_protocol'
      WHEN unknown > 0 THEN 'unresolved_safeguard_check'
      WHEN unbound > 0 THEN 'unresolved_safeguard_binding'
      WHEN present > 0 THEN 'applicable_safeguard_present'
      WHEN d3 = 'refuted' THEN 'observations_not_entered_separately'
      WHEN d5 = 'refuted' THEN 'row_independence_not_used'
      WHEN d6 <> 'established' OR case_id % 11 = 0 THEN 'affected_target_not_established'
      WHEN case_id % 5 = 0 THEN 'output_ceiling_blocks_candidate'
      ELSE 'repeated_units_without_dependence_safeguard' END AS reason_code FROM j)
    SELECT case_id, reason_code, repeated AS repeated_units, present AS safeguards_present,
    CASE WHEN reason_code IN ('unsupported_evidence') THEN 'unsupported'
      WHEN reason_code IN ('one_observation_per_independent_unit', 'observations_not_bound_to_analysis',
        'procedure_not_bound_to_analysis', 'applicable_safeguard_present', 'observations_not_entered_separately',
        'row_independence_not_used') THEN 'covered_negative'
      WHEN reason_code = 'repeated_units_without_dependence_safeguard' THEN 'evaluation_candidate'
      ELSE 'question' END AS outcome FROM z""",
)
def dependence_decision(t: Tables) -> DataFrame:
    return design.dependence_decision(*dependence_inputs(t), n_cases=t.customer.count())


DESIGN = DesignContract(
    condition="event_type", reference_level="click", test_level="view", replicate=["user_id"],
    aggregation=["user_id", "batch"], required_adjustments=["day"], fitted_fixed=[], mode="unpaired",
)


@query(
    "design_integrity",
    """WITH e AS (SELECT user_id % 7 AS site, user_id, event_type, day(ts) AS day,
      CASE WHEN event_id % 40 = 0 THEN '' ELSE CAST(user_id % 4 AS VARCHAR) || event_type[1] END AS batch FROM events),
    x AS (SELECT * FROM e WHERE event_type IN ('click','view')),
    t AS (SELECT site, count(*) AS row_count, count(*) FILTER (WHERE event_type IN ('click','view')) AS contrast_rows,
      count(*) FILTER (WHERE event_type = 'click') AS reference_rows, count(*) FILTER (WHERE event_type = 'view') AS test_rows,
      count(*) FILTER (WHERE event_type IN ('click','view') AND batch = '') AS missing_aggregation_rows FROM e GROUP BY ALL),
    a AS (SELECT site, count(*) FILTER (WHERE k = 2) AS merged_groups FROM (SELECT site, user_id, batch, count(DISTINCT event_type) AS k
      FROM x WHERE batch <> '' GROUP BY ALL) GROUP BY ALL),
    p AS (SELECT site, count(*) FILTER (WHERE k = 2) AS complete_pairs, count(*) FILTER (WHERE k = 1) AS incomplete_pairs FROM
      (SELECT site, user_id, count(DISTINCT event_type) AS k FROM x GROUP BY ALL) GROUP BY ALL),
    l AS (SELECT site, max(k) = 1 AS aliased FROM (SELECT site, day, count(DISTINCT event_type) AS k FROM x GROUP BY ALL) GROUP BY ALL)
    SELECT site, row_count, contrast_rows, reference_rows, test_rows, missing_aggregation_rows, merged_groups,
      complete_pairs, incomplete_pairs, complete_pairs > 0 AS pairing_omitted, false AS paired_unusable,
      'day' AS omitted_adjustments, aliased, 'applicable' AS applicability, 'nonconformant' AS comparison_outcome
    FROM t JOIN a USING (site) JOIN p USING (site) JOIN l USING (site)""",
)
def design_integrity(t: Tables) -> DataFrame:
    batch = F.when(F.col("event_id") % 40 == 0, F.lit("")).otherwise(
        F.concat((F.col("user_id") % 4).cast("string"), F.substring("event_type", 1, 1))
    )
    rows = t.events.select(
        (F.col("user_id") % 7).alias("site"), "user_id", "event_type", F.dayofmonth("ts").alias("day"), batch.alias("batch")
    )
    return design.design_integrity(rows, DESIGN, ["site"]).drop("reason")


@query(
    "aliasing_one_factor",
    """SELECT site, max(k) = 1 AS aliased FROM (SELECT l_suppkey % 50 AS site, l_orderkey % 5 AS block,
    count(DISTINCT CASE WHEN l_suppkey % 10 = 0 AND l_orderkey % 5 < 3 OR l_suppkey % 10 <> 0 AND l_orderkey % 2 = 0
      THEN 't' ELSE 'c' END) AS k FROM lineitem GROUP BY ALL) GROUP BY site""",
)
def aliasing_one_factor(t: Tables) -> DataFrame:
    arm = F.when(
        ((F.col("l_suppkey") % 10 == 0) & (F.col("l_orderkey") % 5 < 3))
        | ((F.col("l_suppkey") % 10 != 0) & (F.col("l_orderkey") % 2 == 0)),
        F.lit("t"),
    ).otherwise(F.lit("c"))
    cells = t.lineitem.select(
        (F.col("l_suppkey") % 50).alias("site"), (F.col("l_orderkey") % 5).alias("block"), arm.alias("arm"), F.lit(1).alias("_n")
    )
    contract = DesignContract("arm", "c", "t", ["block"], ["block"], required_adjustments=["block"])
    return design.aliasing(cells, contract, ["site"])


@query(
    "aliasing_factors",
    """SELECT l_suppkey % 20 AS site, (l_suppkey % 20) % 4 = 0 AS aliased FROM lineitem GROUP BY ALL""",
)
def aliasing_factors(t: Tables) -> DataFrame:
    # Sites divisible by four hold the condition constant in each level of (a); others vary in every cell.
    arm = F.when(
        F.when(F.col("site") % 4 == 0, F.col("a") < 2).otherwise(F.col("l_partkey") % 2 == 0), F.lit("t")
    ).otherwise(F.lit("c"))
    cells = (
        t.lineitem.select(
            (F.col("l_suppkey") % 20).alias("site"),
            (F.col("l_orderkey") % 4).alias("a"),
            (F.col("l_orderkey") % 3).alias("b"),
            F.col("l_linenumber").alias("c"),
            "l_partkey",
        )
        .withColumn("arm", arm)
        .withColumn("_n", F.lit(1))
    )
    contract = DesignContract("arm", "c", "t", ["b"], ["b"], required_adjustments=["a", "b", "c"])
    return design.aliasing(cells, contract, ["site"])


@query(
    "aliasing_levels",
    """SELECT l_suppkey % 2 AS site, l_suppkey % 2 = 0 AS aliased FROM lineitem GROUP BY ALL""",
)
def aliasing_levels(t: Tables) -> DataFrame:
    """Two adjustments with nearly a level a row: orders' lines by four and parts by supplier.  The condition follows the
    order; at odd sites two orders and two parts more make a square that no sum of levels explains."""
    site = F.col("l_suppkey") % 2
    rows = t.lineitem.select(
        site.alias("site"),
        F.concat_ws("-", "l_orderkey", F.col("l_linenumber") % 4).alias("a"),
        F.concat_ws("-", "l_partkey", "l_suppkey").alias("b"),
        F.when(F.col("l_orderkey") % 2 == 1, F.lit("t")).otherwise(F.lit("c")).alias("arm"),
    )
    square = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(arm).alias("arm")) for a, b, arm in ("AXt", "AYc", "BXc", "BYc")]))
    more = t.lineitem.select(site.alias("site")).where("site = 1").distinct().select("site", square.alias("x")).select("site", "x.*")
    contract = DesignContract("arm", "c", "t", ["b"], ["b"], required_adjustments=["a", "b"])
    return design.aliasing(rows.unionByName(more), contract, ["site"], equations_per_task=10_000)


@query(
    "ols_sign",
    """WITH d AS (SELECT p_brand AS feature, l_orderkey, count(*) AS n, any_value(l_orderkey % 3) AS g,
      any_value(((l_orderkey * 37) % 101) + 10 * (l_orderkey % 3) * (CAST(substr(p_brand, 7) AS INT) % 3 - 1)) AS y
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    f AS (SELECT feature, count(*) AS n_donors, count(*) FILTER (WHERE g = 0) AS class_0, count(*) FILTER (WHERE g = 1) AS class_1,
      count(*) FILTER (WHERE g = 2) AS class_2, sum(g) / (2 * count(*)) AS allele_frequency, regr_slope(y, 2 - g) AS slope,
      regr_sxx(y, 2 - g) AS sxx, regr_syy(y, 2 - g) AS syy, regr_sxy(y, 2 - g) AS sxy FROM d GROUP BY ALL)
    SELECT feature, n_donors, class_0, class_1, class_2, round(allele_frequency, 8) AS allele_frequency,
      round(slope, 6) AS slope, round(sqrt((syy - sxy * sxy / sxx) / (n_donors - 2) / sxx), 6) AS slope_se,
      'applicable' AS applicability,
      CASE WHEN slope > 0 THEN 'conformant' ELSE 'nonconformant' END AS comparison_outcome FROM f""",
)
def ols_sign(t: Tables) -> DataFrame:
    pull = F.substring("p_brand", 7, 10).cast("int") % 3 - 1
    n_lines = t.lineitem.count()
    parts = dealt(t.part.select("p_partkey", F.col("p_brand").alias("feature"), pull.alias("pull")), ["p_partkey"], n_lines)
    lines = t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    dosage = F.first(F.col("l_orderkey") % 3).alias("dosage")
    y = F.first((F.col("l_orderkey") * 37) % 101 + 10 * (F.col("l_orderkey") % 3) * F.col("pull")).alias("y")
    # Dealt by feature and donor, so that the operator groups the rows where they are.
    rows = per_key(lines, ["feature", "l_orderkey"], n_lines, [dosage, y], [F.first("dosage").alias("dosage"), F.first("y").alias("y")])
    said = t.part.select(F.col("p_brand").alias("feature")).distinct().withColumn("effect", F.lit(1.5))
    fit = groups.ols_sign(rows, ["feature"], "l_orderkey", "dosage", "y", said, "effect", counts_effect_allele=False)
    return fit.select(
        "feature", "n_donors", "class_0", "class_1", "class_2", F.round("allele_frequency", 8).alias("allele_frequency"),
        F.round("slope", 6).alias("slope"), F.round("slope_se", 6).alias("slope_se"), "applicability", "comparison_outcome",
    )


LOOP = LoopContract(
    resolution=10, view_start=0, view_end=700, reference_level="N", test_level="A", replicate=["sample"], tolerance=0.05
)


def loop_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A 70-bin grid taken from part keys; contact counts are line items between two bins, 1 at least, of every flag."""
    place = F.col("p_partkey") % 70
    name = lambda c: F.concat(F.lit("b"), F.lpad(c.cast("string"), 3, "0"))
    bins = t.part.select(name(place).alias("bin_id"), (place * 10).alias("start"), (place == 33).alias("masked")).distinct()
    sample = F.concat(F.col("l_returnflag"), (F.col("l_linenumber") % 2).cast("string"))
    items = t.lineitem.select(sample.alias("sample"), F.col("l_returnflag").alias("condition"), (F.col("l_partkey") % 70).alias("i"), (5 + F.col("l_suppkey") % 2).alias("d"))
    # Samples list every pair five apart, and of those six apart all but one.
    places = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(69).cast("long"))).alias("i")
    every = items.select("sample", "condition").distinct().select("sample", "condition", places).select("*", F.explode(F.array(F.lit(5), F.lit(6))).alias("d"))
    pixels = items.unionByName(every).where("i + d < 70 AND NOT (d = 6 AND i = 60)").groupBy("sample", "condition", "i", "d").agg(F.count("*").alias("observed_count"))
    contacts = pixels.select("sample", "condition", name(F.col("i")).alias("bin_i"), name(F.col("i") + F.col("d")).alias("bin_j"), "observed_count")
    # Five bins apart at every place, off the grid's end too; six and sixty apart; one bin alone; a bin that is not there.
    i = F.col("start") / 10
    far = bins.select(i.cast("long").alias("i")).select("i", F.explode(F.array(F.lit(5), F.lit(6), F.lit(60), F.lit(0), F.lit(1000))).alias("d")).where("d = 5 OR i = 7")
    targets = far.select(F.concat_ws("-", "i", "d").alias("target_id"), name(F.col("i")).alias("bin_i"), name(F.col("i") + F.col("d")).alias("bin_j"))
    results = targets.where("target_id <> '9-5'").select("target_id", F.lit(0.1).alias("delta"))
    return contacts, bins, targets, results.unionByName(results.where("target_id = '8-5'"))


@query(
    "loop_strength",
    """WITH c AS (SELECT sample, condition, i, count(*) AS n FROM (SELECT concat(l_returnflag, l_linenumber % 2) AS sample, l_returnflag AS condition, l_partkey % 70 AS i
      FROM lineitem WHERE l_suppkey % 2 = 0 UNION ALL SELECT DISTINCT concat(l_returnflag, l_linenumber % 2), l_returnflag, unnest(range(70)) FROM lineitem)
      WHERE i + 5 < 70 AND condition IN ('N', 'A') GROUP BY ALL),
    b AS (SELECT sample, condition, i, n, sum(n) FILTER (i NOT IN (33, 28)) OVER (PARTITION BY sample) AS open_sum FROM c),
    s AS (SELECT sample, condition, i, log2(n / ((open_sum - n) / 62.0)) AS v FROM b WHERE i NOT IN (33, 28)),
    m AS (SELECT i, avg(v) FILTER (condition = 'N') AS r, avg(v) FILTER (condition = 'A') AS t FROM s GROUP BY ALL),
    q AS (SELECT unnest(range(70)) AS i, 5 AS d UNION ALL SELECT 7, unnest([6, 60, 0, 1000])),
    w AS (SELECT i || '-' || d AS target_id, i, d, CASE WHEN i + d >= 70 OR (d = 5 AND i IN (33, 28)) THEN 'the target is unavailable or masked'
      WHEN d = 0 THEN 'the target is off the grid' WHEN d = 60 THEN 'too few background pairs' WHEN d = 6 THEN 'a replicate lacks part of the distance stratum'
      WHEN i IN (8, 9) THEN 'the reported delta is absent or not unique' END AS reason FROM q)
    SELECT target_id, CASE d WHEN 5 THEN CASE WHEN i < 65 THEN 62 END WHEN 6 THEN 61 WHEN 60 THEN 9 END::BIGINT AS background_pairs,
      round(CASE WHEN d = 5 AND i NOT IN (33, 28) THEN r END, 6) AS reference_mean, round(CASE WHEN d = 5 AND i NOT IN (33, 28) THEN t END, 6) AS test_mean,
      round(CASE WHEN d = 5 AND i NOT IN (33, 28) THEN t - r END, 6) AS recomputed_delta,
      CASE WHEN reason IS NULL THEN 'applicable' ELSE 'unsupported' END AS applicability,
      CASE WHEN reason IS NOT NULL THEN 'unknown' WHEN abs(0.1 - (t - r)) <= 0.05 THEN 'conformant' ELSE 'nonconformant' END AS comparison_outcome, reason
    FROM w LEFT JOIN m USING (i)""",
)
def loop_strength(t: Tables) -> DataFrame:
    fit = F.col("distance") == 50  # six bins apart have means too, of pairs that are there, but no verdict
    return groups.loop_strength(*loop_inputs(t), LOOP).select(
        "target_id", "background_pairs", *[F.when(fit & ~F.col("target_id").isin("33-5", "28-5"), F.round(c, 6)).alias(c) for c in ("reference_mean", "test_mean", "recomputed_delta")],
        "applicability", "comparison_outcome", "reason",
    )


@query(
    "distance_pairs",
    """WITH b AS (SELECT DISTINCT p_brand AS chrom, p_partkey // 25 AS place FROM part)
    SELECT x.chrom, x.place AS lo, y.place AS hi FROM b x JOIN b y ON x.chrom = y.chrom AND y.place = x.place + 3""",
)
def distance_pairs(t: Tables) -> DataFrame:
    place = F.floor(F.col("p_partkey") / 25)
    bins = t.part.select(F.col("p_brand").alias("chrom"), place.alias("start")).distinct()
    bins = bins.withColumn("bin_id", F.col("start")).withColumn("masked", F.lit(False)).withColumn("d", F.lit(3))
    return groups.distance_pairs(bins, ["chrom"], "d").select(
        "chrom", F.col("pair.lo").alias("lo"), F.col("pair.hi").alias("hi")
    )


@query(
    "replicate_sensitivity",
    f"""WITH {TESTS}, f AS (SELECT family, supplier, min(k) AS k, avg(price) AS price FROM tests GROUP BY ALL),
    v AS (SELECT family, k, supplier FROM f WHERE k * k <= 5000000 AND supplier % 9 <> 0),
    g AS (SELECT family, count(*) AS testable, count(*) FILTER (WHERE k * 3 <= 500) AS survivors,
      count(*) FILTER (WHERE (0.2 + supplier % 10 / 50.0) * 2.8015852132 <= 1.0) AS d FROM v GROUP BY ALL)
    SELECT family, testable, survivors, round(survivors / testable, 8) AS survival_rate,
      round(d / testable, 8) AS powered_fraction, d / testable >= 0.5 AS powered, 'applicable' AS applicability FROM g""",
)
def replicate_sensitivity(t: Tables) -> DataFrame:
    best = tests(t).groupBy("family", "supplier").agg(F.min("k").alias("k"))
    said = best.select("family", F.col("supplier").alias("feature"), (F.col("k") * F.col("k") / 1e8).alias("reported_padj"))
    redone = best.where("supplier % 9 <> 0").select(
        "family",
        F.col("supplier").alias("feature"),
        (F.col("k") * 3 / 1e4).alias("padj"),
        (0.2 + F.col("supplier") % 10 / 50.0).alias("se"),
    )
    out = groups.replicate_sensitivity(said, redone, ["family"], "feature", SensitivityContract())
    return out.withColumn("survival_rate", F.round("survival_rate", 8)).withColumn(
        "powered_fraction", F.round("powered_fraction", 8)
    )


@query(
    "reported_recomputed_join",
    f"""WITH {TESTS}, f AS (SELECT family, supplier, min(k) AS k FROM tests GROUP BY ALL)
    SELECT family, supplier AS feature, k FROM f WHERE k * k <= 5000000 AND supplier % 9 <> 0""",
)
def reported_recomputed_join(t: Tables) -> DataFrame:
    best = tests(t).groupBy("family", F.col("supplier").alias("feature")).agg(F.min("k").alias("k"))
    said = best.withColumn("reported_padj", F.col("k") * F.col("k") / 1e8)
    redone = best.where("feature % 9 <> 0").select("family", "feature", F.lit(0.1).alias("se"))
    return filters.significant_subset(said, "reported_padj", 0.05).join(redone, ["family", "feature"]).select(
        "family", "feature", "k"
    )


@query(
    "pseudobulk",
    """WITH c AS (SELECT user_id, user_id % 2 AS arm, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT concat('u', user_id) AS replicate, CASE WHEN arm = 0 THEN 'control' ELSE 'treated' END AS condition,
    event_type AS feature, n AS total, 'applicable' AS applicability FROM c""",
)
def pseudobulk(t: Tables) -> DataFrame:
    cells = t.events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("replicate"),
        F.when(F.col("user_id") % 2 == 0, F.lit("control")).otherwise(F.lit("treated")).alias("condition"),
        F.col("event_type").alias("feature"),
        F.lit(1).alias("value"),
    )
    bulk = groups.pseudobulk(cells, "replicate", "condition", "feature", "value", "control", "treated")
    return bulk.select("replicate", "condition", "feature", "total", "applicability")


@query(
    "replicate_engine",
    """WITH c AS (SELECT user_id, user_id % 2 AS arm, event_type, count(*) AS n FROM events GROUP BY ALL),
    z AS (SELECT user_id, sum(n) AS s FROM c GROUP BY ALL),
    v AS (SELECT event_type, arm, ln(1 + n * 1000000.0 / s) AS y FROM c JOIN z USING (user_id)),
    f AS (SELECT event_type AS feature, count(*) AS replicates, regr_slope(y, arm) AS effect,
      regr_sxx(y, arm) AS sxx, regr_syy(y, arm) AS syy, regr_sxy(y, arm) AS sxy FROM v GROUP BY ALL)
    SELECT feature, replicates, round(effect, 6) AS effect,
      round(sqrt((syy - sxy*sxy/sxx) / (replicates - 2) / sxx), 6) AS se FROM f""",
)
def replicate_engine(t: Tables) -> DataFrame:
    bulk = t.events.groupBy(
        F.col("user_id").alias("replicate"), (F.col("user_id") % 2).alias("arm"), F.col("event_type").alias("feature")
    ).agg(F.count("*").alias("total"))
    out = engine_se(bulk)
    return out.select("feature", "replicates", F.round("effect", 6).alias("effect"), F.round("se", 6).alias("se"))
