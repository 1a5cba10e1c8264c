"""Queries that score detector outcomes and decide over evidence."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import decide, evaluation
from plumbline.plans.registry import Tables, query

INPUT_DIGEST = "sha256:" + hashlib.sha256(b"orders").hexdigest()
DOMAIN = "plumbline-bootstrap-v1"


def outcomes(t: Tables) -> DataFrame:
    """Every order is a case; states come from its key."""
    k = F.col("o_orderkey")
    named = lambda *pairs: F.struct(*[c.alias(n) for n, c in pairs])
    cid = lambda j: F.concat(F.lit("c"), k.cast("string"), F.lit(f"-{j}"))

    def opportunity(j: int):
        s = F.pmod(k * 3 + j, F.lit(10))
        return named(
            ("state", F.when(s == 0, F.lit("detector_error")).when(s == 1, F.lit("insufficient_semantics"))
             .when(s == 2, F.lit("execution_evidence_unavailable")).when(s == 3, F.lit("unsupported_path")).otherwise(F.lit("finding_candidate"))),
            ("applicability_status", F.when(s >= 4, F.lit("applicable")).otherwise(F.lit("uncertain"))),
            ("coverage_status", F.when(s >= 5, F.lit("covered")).otherwise(F.lit("partially_covered"))),
            ("execution_class", F.when(s == 0, F.lit("detector_error")).otherwise(F.lit("completed"))),
            ("candidate_ids", F.array(cid(0)) if j == 0 else F.array(cid(0), cid(1))),
        )

    first = F.get(
        F.array(*[F.lit(x) for x in ("bounded_root_match", "overstated_root_match", "false_root_localization", "out_of_declared_scope", "bounded_root_match")]),
        (k % 5).cast("int"),
    )
    s2 = (k + 1) % 6
    second = F.when(s2 == 0, F.lit("false_root_localization")).when(s2 < 4, F.lit("bounded_root_match")).otherwise(F.lit("out_of_declared_scope"))
    root = F.get(
        F.array(*[F.lit(x) for x in ("boundedly_localized", "boundedly_localized", "localized_but_overstated", "missed")]), (k % 4).cast("int")
    )
    families = F.array(F.lit("clean_execution"), F.lit("static_closed_scope"), F.lit("error_bearing"))
    return t.orders.select(
        k.alias("case_id"),
        F.col("o_custkey").alias("problem_id"),
        F.get(families, (k % 3).cast("int")).alias("proof_family"),
        F.when(k % 7 == 3, F.lit("comparison_excluded")).otherwise(F.lit("reconciled")).alias("comparison_status"),
        F.when(k % 11 == 5, F.lit("legacy_projection")).otherwise(F.lit("complete")).alias("metric_input_status"),
        (k % 13 != 2).alias("metric_eligible"),
        F.array(opportunity(0), opportunity(1)).alias("opportunities"),
        F.array(named(("candidate_id", cid(0)), ("status", first)), named(("candidate_id", cid(1)), ("status", second))).alias("candidates"),
        F.array(named(("root_id", F.concat(F.lit("root"), k.cast("string"))), ("status", root))).alias("roots"),
    )


OUTCOMES = """b AS (SELECT o_orderkey AS k, o_custkey, (o_orderkey % 11 <> 5)::BIGINT AS co, (o_orderkey % 11 <> 5 AND o_orderkey % 7 <> 3 AND o_orderkey % 13 <> 2)::BIGINT AS el,
  (o_orderkey*3) % 10 AS s0, (o_orderkey*3 + 1) % 10 AS s1, (o_orderkey % 5 IN (1,2))::BIGINT AS u0, (o_orderkey % 5 IN (1,2) OR (o_orderkey+1) % 6 = 0)::BIGINT AS u1,
  ['clean_execution','static_closed_scope','error_bearing'][1 + o_orderkey % 3] AS fam FROM orders),
terms AS (SELECT b.*, el*u1 AS n0, el AS d0,
  el*((s0<>0)::BIGINT*u0 + (s1<>0)::BIGINT*u1) AS n1, el*((s0<>0)::BIGINT + (s1<>0)::BIGINT) AS d1,
  el*((s0>=5)::BIGINT*u0 + (s1>=5)::BIGINT*u1) AS n2, el*((s0>=5)::BIGINT + (s1>=5)::BIGINT) AS d2,
  el*((k%5 IN (0,4))::BIGINT + ((k+1)%6 IN (1,2,3))::BIGINT) AS n3, el*((k%5<>3)::BIGINT + ((k+1)%6<4)::BIGINT) AS d3,
  el*((k%5=2)::BIGINT + ((k+1)%6=0)::BIGINT) AS n4, el*(k%5=1)::BIGINT AS n5,
  el*(k%4<>3)::BIGINT AS n6, el*(k%4<2)::BIGINT AS n7,
  co*((s0 IN (1,2))::BIGINT + (s1 IN (1,2))::BIGINT) AS n8, co*2 AS d8, co*((s0=3)::BIGINT + (s1=3)::BIGINT) AS n9,
  co*((s0=0)::BIGINT + (s1=0)::BIGINT) AS n10, co*(k%7=3)::BIGINT AS n11 FROM b)"""
_DEN = ["d0", "d1", "d2", "d3", "d3", "d3", "d0", "n6", "d8", "d8", "d8", "co"]


def metric_rows(source: str, keys: str = "") -> str:
    """SQL that stacks the twelve (numerator, denominator) sums of a grouped source."""
    return " UNION ALL ".join(
        f"SELECT {keys} '{name}' AS metric_name, CAST(n{i} AS BIGINT) AS numerator, CAST({_DEN[i]} AS BIGINT) AS denominator, "
        f"CASE WHEN {_DEN[i]} > 0 THEN CAST(n{i} AS DOUBLE) / CAST({_DEN[i]} AS DOUBLE) END AS estimate FROM {source}"
        for i, name in enumerate(evaluation.METRICS)
    )


_SUMS = ", ".join(f"sum({c}) AS {c}" for c in [*[f"n{i}" for i in range(12)], "d0", "d1", "d2", "d3", "d8", "co"])


@query("metric_pairs", f"WITH {OUTCOMES}, g AS (SELECT {_SUMS} FROM terms) {metric_rows('g')}")
def metric_pairs(t: Tables) -> DataFrame:
    return evaluation.metric_pairs(outcomes(t))


@query(
    "stratified_metrics",
    f"""WITH {OUTCOMES}, g AS (SELECT fam, count(*) AS cases, {_SUMS} FROM terms WHERE fam <> 'error_bearing' GROUP BY fam)
    {metric_rows('g', 'fam AS proof_family, cases AS case_count,')}
    UNION ALL SELECT 'documented_external_execution', 0, NULL, NULL, NULL, NULL""",
)
def stratified_metrics(t: Tables) -> DataFrame:
    return evaluation.stratified_metrics(outcomes(t), "proof_family")


@query(
    "public_counts",
    f"""WITH {OUTCOMES}, g AS (SELECT count(DISTINCT o_custkey) AS problem_clusters, count(*) AS workflows, sum(d8) AS opportunities,
      sum(co*((s0>=5)::BIGINT + (s1>=5)::BIGINT)) AS applicable_covered_opportunities, sum(d3) AS evaluation_candidates, sum(el) AS adjudicated_roots,
      sum(n3) AS bounded_root_matches, sum(n5) AS overstated_root_matches, sum(n4) AS false_root_localizations, sum(n7) AS boundedly_localized_roots,
      sum(n6 - n7) AS localized_but_overstated_roots, sum(el - n6) AS missed_roots, sum(n8) AS abstentions, sum(n9) AS unsupported_opportunities,
      sum(n10) AS detector_errors, sum(n11) AS unresolved_comparisons FROM terms)
    SELECT count_name, CAST(value AS BIGINT) AS value FROM (UNPIVOT (SELECT COLUMNS(*)::BIGINT FROM g) ON COLUMNS(*) INTO NAME count_name VALUE value)""",
)
def public_counts(t: Tables) -> DataFrame:
    return evaluation.public_counts(outcomes(t))


@query(
    "excluded_cases",
    """SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 11 = 5 THEN 'projection_unavailable' ELSE 'comparison_excluded' END AS reason
    FROM orders WHERE o_orderkey % 11 = 5 OR o_orderkey % 7 = 3""",
)
def excluded_cases(t: Tables) -> DataFrame:
    return evaluation.excluded_cases(outcomes(t))


def _fold(digest: str) -> str:
    value = "0::BIGINT"
    for i in range(8):
        word = f"CAST('0x' || substr({digest}, {1 + 8 * i}, 8) AS BIGINT)"
        value = f"(({value} * 4294967296 + {word}) % size)"
    return value


@query(
    "cluster_bootstrap",
    f"""WITH {OUTCOMES}, cl AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || c_mktsegment AS cluster, {_SUMS} FROM terms JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    ix AS (SELECT *, row_number() OVER (ORDER BY cluster) - 1 AS idx FROM cl), sz AS (SELECT count(*) AS size FROM cl),
    d AS (SELECT r.range AS replicate, p.range AS pos, size, sha256(from_hex('{DOMAIN.encode().hex()}00{INPUT_DIGEST[7:]}' || lpad(to_hex(r.range), 16, '0') || lpad(to_hex(p.range), 16, '0') || '0000000000000000')) AS h
      FROM sz, range(10000) r, range((SELECT size FROM sz)) p),
    dr AS (SELECT replicate, {_fold('h')} AS idx FROM d),
    g AS (SELECT replicate, {_SUMS} FROM dr JOIN ix USING (idx) GROUP BY replicate),
    m AS ({metric_rows('g')}),
    v AS (SELECT metric_name, count(estimate) AS n, count(*) - count(estimate) AS bad FROM m GROUP BY ALL),
    k AS (SELECT metric_name, estimate, row_number() OVER (PARTITION BY metric_name ORDER BY estimate) AS k FROM m WHERE estimate IS NOT NULL)
    SELECT metric_name, 'estimated' AS status, max(estimate) FILTER (WHERE k = (n + 39) // 40) AS lower, max(estimate) FILTER (WHERE k = (39*n + 39) // 40) AS upper,
      n AS valid_replicates, bad AS invalid_replicates, false AS few_clusters FROM v JOIN k USING (metric_name) GROUP BY ALL""",
)
def cluster_bootstrap(t: Tables) -> DataFrame:
    group = F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), "c_mktsegment").alias("cluster")
    cases = outcomes(t).join(t.customer.select(F.col("c_custkey").alias("problem_id"), group), "problem_id")
    return evaluation.cluster_bootstrap(cases, "cluster", INPUT_DIGEST, domain=DOMAIN)


def mapped(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = t.orders.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("k"))
    pick = lambda step, *v: F.get(F.array(*[F.lit(x) for x in v]), (F.floor(F.col("k") / step) % len(v)).cast("int"))
    roots = o.where("k % 3 = 0").select("case_id", F.col("k").alias("root_id"))
    first = roots.groupBy("case_id").agg(F.min("root_id").alias("root_id"))
    mappings = o.join(first, "case_id", "left").select(
        "case_id", F.col("k").alias("candidate_id"), F.when(F.col("k") % 8 != 0, F.col("root_id")).alias("root_id"),
        pick(1, "same_first_material_divergence", "same_first_material_divergence", "downstream").alias("relation"),
        pick(2, "within_adjudicated_bounds", "exceeds_adjudicated_bounds", "unresolved").alias("boundedness"),
        pick(3, "within_adjudicated_scope", "not_applicable", "outside_declared_scope", "exceeds_adjudicated_scope").alias("scope"),
        pick(5, "exact", "exact", "related").alias("class_relation"),
    )
    return o.select("case_id", F.col("k").alias("candidate_id")), roots, mappings


MAPPED = """o AS (SELECT o_custkey AS case_id, o_orderkey AS k FROM orders),
f AS (SELECT case_id, min(k) AS root FROM o WHERE k % 3 = 0 GROUP BY ALL),
m AS (SELECT o.case_id, k, CASE WHEN k % 8 <> 0 THEN root END AS root, k % 3 <> 2 AS same, (k // 2) % 3 AS bd, (k // 3) % 4 AS sc, (k // 5) % 3 <> 2 AS exact FROM o LEFT JOIN f USING (case_id)),
j AS (SELECT *, CASE WHEN sc = 2 THEN 'out_of_declared_scope' WHEN root IS NOT NULL AND same AND exact AND bd = 0 AND sc IN (0,1) THEN 'bounded_root_match'
  WHEN root IS NOT NULL AND same AND exact AND (bd = 1 OR sc = 3) THEN 'overstated_root_match' ELSE 'false_root_localization' END AS status FROM m)"""


@query(
    "candidate_outcomes",
    f"WITH {MAPPED} SELECT case_id, k AS candidate_id, status, CASE WHEN status IN ('bounded_root_match','overstated_root_match') THEN root END AS root_id FROM j",
)
def candidate_outcomes(t: Tables) -> DataFrame:
    return evaluation.outcome_reconcile(*mapped(t))[0]


@query(
    "root_outcomes",
    f"""WITH {MAPPED}, h AS (SELECT case_id, root, bool_or(status = 'bounded_root_match') AS b, count(*) AS n FROM j WHERE status IN ('bounded_root_match','overstated_root_match') GROUP BY ALL)
    SELECT o.case_id, k AS root_id, CASE WHEN b THEN 'boundedly_localized' WHEN n > 0 THEN 'localized_but_overstated' ELSE 'missed' END AS status, coalesce(n, 0) AS matched_candidates
    FROM o LEFT JOIN h ON o.case_id = h.case_id AND o.k = h.root WHERE k % 3 = 0""",
)
def root_outcomes(t: Tables) -> DataFrame:
    return evaluation.outcome_reconcile(*mapped(t))[1]


@query(
    "run_summary",
    """WITH r AS (SELECT l_orderkey AS run, l_linenumber = 7 AND l_quantity > 45 AS err, l_discount AS d, l_tax AS x FROM lineitem)
    SELECT run, CASE WHEN bool_or(err) THEN 'detector_error' ELSE 'completed' END AS execution,
      CASE WHEN bool_or(d > 0.08) THEN 'uncertain' WHEN bool_or(d > 0.02) THEN 'applicable' ELSE 'not_applicable' END AS applicability,
      CASE WHEN bool_and(x < 0.05) THEN 'covered' WHEN bool_and(x >= 0.05 AND x < 0.07) THEN 'not_covered' WHEN bool_or(x >= 0.07) THEN 'unknown' ELSE 'partially_covered' END AS coverage
    FROM r GROUP BY run""",
)
def run_summary(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("run"),
        F.when((F.col("l_linenumber") == 7) & (F.col("l_quantity") > 45), F.lit("detector_error")).otherwise(F.lit("no_issue")).alias("state"),
        F.when(F.col("l_discount") > 0.08, F.lit("uncertain")).when(F.col("l_discount") > 0.02, F.lit("applicable")).otherwise(F.lit("not_applicable")).alias("applicability"),
        F.when(F.col("l_tax") < 0.05, F.lit("covered")).when(F.col("l_tax") < 0.07, F.lit("not_covered")).otherwise(F.lit("unknown")).alias("coverage"),
    )
    return evaluation.run_summary(rows, "run")


def reviews(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_custkey").alias("case_id"),
        F.col("o_orderstatus").alias("provider"),
        (1 + F.col("o_orderkey") % 2).alias("stage"),
        F.when(F.col("o_orderkey") % 40 == 0, F.lit(-1)).otherwise(F.col("o_orderkey")).alias("context_id"),
        F.when(F.col("o_custkey") % 4 == 0, F.lit("no_demonstrated_issue_within_scope"))
        .when(F.col("o_orderkey") % 60 == 1, F.lit("no_demonstrated_issue_within_scope"))
        .otherwise(F.lit("demonstrated_issue"))
        .alias("verdict"),
        F.when(F.col("o_orderkey") % 70 == 3, F.lit("b")).otherwise(F.lit("a")).alias("issue_class"),
        (F.col("o_orderkey") % 90 == 5).alias("unresolved"),
        (F.col("o_orderkey") % 95 == 6).alias("dissent"),
    )


@query(
    "panel_participation",
    """WITH a AS (SELECT o_custkey AS case_id, o_orderstatus AS provider, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS s1, count(*) FILTER (WHERE o_orderkey % 2 = 1) AS s2,
      count(DISTINCT CASE WHEN o_orderkey % 40 = 0 THEN -1 ELSE o_orderkey END) AS ctx, count(*) AS n FROM orders GROUP BY ALL),
    d AS (SELECT case_id, provider, s1, s2, n AS ctx, 1 AS k FROM a WHERE case_id % 9 <> 0 OR provider <> 'F'
      UNION ALL SELECT case_id, provider, s1, s2, n, 1 FROM a WHERE case_id % 10 = 0
      UNION ALL SELECT DISTINCT case_id, 'Z', 0, 0, 0, 1 FROM a WHERE case_id % 15 = 0),
    g AS (SELECT case_id, provider, sum(k) AS k, max(s1) AS s1, max(s2) AS s2, max(ctx) AS ctx FROM d GROUP BY ALL)
    SELECT coalesce(a.case_id, g.case_id) AS case_id, coalesce(a.provider, g.provider) AS provider, CASE WHEN k IS NULL THEN 'undeclared_provider' WHEN a.n IS NULL THEN 'absent_provider'
      WHEN k > 1 THEN 'declared_twice' WHEN a.ctx <> g.ctx OR a.s1 <> g.s1 OR a.s2 <> g.s2 THEN 'counts_differ' ELSE 'ok' END AS participation
    FROM a FULL JOIN g ON a.case_id = g.case_id AND a.provider = g.provider""",
)
def panel_participation(t: Tables) -> DataFrame:
    r = reviews(t)
    said = r.groupBy("case_id", "provider").agg(
        F.count_if(F.col("stage") == 1).alias("stage1"), F.count_if(F.col("stage") == 2).alias("stage2"), F.count("*").alias("contexts")
    )
    zero = F.lit(0).cast("long")
    declared = (
        said.where("case_id % 9 <> 0 OR provider <> 'F'")
        .unionByName(said.where("case_id % 10 = 0"))
        .unionByName(
            r.where("case_id % 15 = 0").select("case_id").distinct().select(
                "case_id", F.lit("Z").alias("provider"), zero.alias("stage1"), zero.alias("stage2"), zero.alias("contexts")
            )
        )
    )
    return evaluation.panel_participation(r, declared)


@query(
    "panel_agreement",
    """WITH r AS (SELECT o_custkey AS case_id, o_orderkey AS k, CASE WHEN o_orderkey % 40 = 0 THEN -1 ELSE o_orderkey END AS ctx,
      CASE WHEN o_custkey % 4 = 0 OR o_orderkey % 60 = 1 THEN 'n' ELSE 'd' END AS v, CASE WHEN o_orderkey % 70 = 3 THEN 'b' ELSE 'a' END AS c FROM orders),
    g AS (SELECT case_id, count(*) AS reviews, count(DISTINCT ctx) AS contexts, bool_or(k % 90 = 5) AS op, bool_or(k % 95 = 6) AS di, min(v) AS v0, max(v) AS v1, count(DISTINCT c) AS cs FROM r GROUP BY ALL)
    SELECT case_id, reviews, contexts, CASE WHEN contexts < reviews THEN 'shared_context' WHEN op THEN 'unresolved_question' WHEN di THEN 'material_dissent'
      WHEN v0 <> v1 THEN 'split_verdict' WHEN v0 = 'd' AND cs > 1 THEN 'split_issue_class' ELSE 'eligible' END AS panel FROM g""",
)
def panel_agreement(t: Tables) -> DataFrame:
    return evaluation.panel_agreement(reviews(t))


@query(
    "decision_agreement",
    """SELECT o_custkey AS case_id, count(*) AS decisions, CASE WHEN bool_or(o_orderkey % 25 = 0) THEN 'unresolved'
      WHEN count(DISTINCT o_orderstatus) = 1 THEN 'agreed' ELSE 'disagreed' END AS decision FROM orders GROUP BY ALL""",
)
def decision_agreement(t: Tables) -> DataFrame:
    rows = t.orders.select(
        F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("reviewer"), F.sha2("o_orderstatus", 256).alias("digest"),
        (F.col("o_orderkey") % 25 == 0).alias("unresolved"),
    )
    return evaluation.decision_agreement(rows)


ROLES = ("positive", "corrected_twin", "hard_negative", "ambiguous", "unsupported", "removal", "replay")


@query(
    "baseline_coverage",
    """WITH comp AS (SELECT s_suppkey AS c, CASE WHEN s_suppkey % 2 = 0 THEN 'calculation_check' ELSE 'scientific_check' END AS kind FROM supplier),
    cs AS (SELECT l_suppkey AS c, ['positive','corrected_twin','hard_negative','ambiguous','unsupported','removal','replay'][1 + l_orderkey % 7] AS role, count(*) AS n
      FROM lineitem WHERE NOT (l_suppkey % 5 = l_orderkey % 7) GROUP BY ALL),
    need AS (SELECT * FROM (VALUES ('positive_or_applicable','positive',2),('corrected_or_conformant','corrected_twin',0),('hard_negative','hard_negative',0),('matching_close_negative','hard_negative',1),
      ('ambiguity_or_unsupported_boundary','ambiguous',2),('ambiguity_or_unsupported_boundary','unsupported',2),('removal_and_sibling_isolation','removal',2),('semantic_replay','replay',2)) v(requirement, role, k)),
    g AS (SELECT comp.c AS component_id, kind AS component_kind, requirement, CAST(coalesce(sum(n), 0) AS BIGINT) AS cases FROM comp JOIN need ON k = 2 OR (k = 0 AND kind = 'calculation_check') OR (k = 1 AND kind = 'scientific_check')
      LEFT JOIN cs ON cs.c = comp.c AND cs.role = need.role GROUP BY ALL)
    SELECT *, cases > 0 AS satisfied, bool_and(cases > 0) OVER (PARTITION BY component_id) AS component_complete FROM g""",
)
def baseline_coverage(t: Tables) -> DataFrame:
    components = t.supplier.select(
        F.col("s_suppkey").alias("component_id"),
        F.when(F.col("s_suppkey") % 2 == 0, F.lit("calculation_check")).otherwise(F.lit("scientific_check")).alias("component_kind"),
    )
    cases = t.lineitem.where("NOT (l_suppkey % 5 = l_orderkey % 7)").select(
        F.col("l_orderkey").alias("case_id"),
        F.get(F.array(*[F.lit(r) for r in ROLES]), (F.col("l_orderkey") % 7).cast("int")).alias("case_role"),
        F.array("l_suppkey").alias("component_refs"),
    )
    return evaluation.baseline_coverage(components, cases)


KINDS = "['finding','conditional_concern','material_question','disclosure']"


@query(
    "assessment_delta",
    f"""WITH r AS (SELECT o_custkey, {KINDS}[1 + o_orderkey % 4] AS kind, o_orderkey % 5 <> 0 AS b, o_orderkey % 6 <> 0 AS a FROM orders)
    SELECT o_custkey, """
    + ", ".join(
        f"count(*) FILTER (WHERE kind = '{k}' AND b) AS {k}_before, count(*) FILTER (WHERE kind = '{k}' AND a) AS {k}_after, "
        f"count(*) FILTER (WHERE kind = '{k}' AND a) - count(*) FILTER (WHERE kind = '{k}' AND b) AS {k}_delta"
        for k in evaluation.ASSESSMENT_KINDS
    )
    + " FROM r WHERE a OR b GROUP BY o_custkey",
)
def assessment_delta(t: Tables) -> DataFrame:
    kind = F.get(F.array(*[F.lit(k) for k in evaluation.ASSESSMENT_KINDS]), (F.col("o_orderkey") % 4).cast("int"))
    rows = t.orders.select("o_custkey", "o_orderkey", kind.alias("kind"))
    return evaluation.assessment_delta(rows.where("o_orderkey % 5 <> 0"), rows.where("o_orderkey % 6 <> 0"), "o_custkey", "kind")


def regression_sides(t: Tables) -> tuple[DataFrame, ...]:
    c = F.col("c_custkey")
    expected = t.customer.select(
        c.alias("case_id"), F.lit(1).alias("findings"), F.lit(2).alias("concerns"), F.lit(0).alias("executions"),
        F.lit(0).alias("model_calls"), F.lit("REPORTED").alias("final_state"),
    )
    observed = t.customer.select(
        c.alias("case_id"),
        F.when(c % 31 == 0, 2).when(c % 31 == 1, 0).otherwise(1).alias("findings"),
        F.when(c % 29 == 0, 3).otherwise(2).alias("concerns"),
        F.when(c % 23 == 0, 1).otherwise(0).alias("executions"),
        F.when(c % 19 == 0, 1).otherwise(0).alias("model_calls"),
        F.when(c % 17 == 0, F.lit("FAILED")).otherwise(F.lit("REPORTED")).alias("final_state"),
    )
    items = t.orders.select(
        F.col("o_custkey").alias("case_id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("question")).when(F.col("o_orderkey") % 3 == 1, F.lit("disclosure")).otherwise(F.lit("observation")).alias("plane"),
        F.col("o_orderkey").cast("string").alias("key"),
        F.lit("question_only").alias("ceiling"),
        F.lit("applicable").alias("applicability"),
        F.lit("conformant").alias("outcome"),
        F.col("o_orderkey").alias("k"),
    )
    before = items.where("k % 41 <> 0").drop("k")
    after = items.where("k % 43 <> 0").select(
        "case_id", "plane", "key",
        F.when(F.col("k") % 53 == 0, F.lit("disclosure")).otherwise(F.col("ceiling")).alias("ceiling"),
        F.when(F.col("k") % 59 == 0, F.lit("ambiguous")).otherwise(F.col("applicability")).alias("applicability"),
        F.when(F.col("k") % 61 == 0, F.lit("nonconformant")).otherwise(F.col("outcome")).alias("outcome"),
    )
    return expected, observed, before, after


@query(
    "regression_compare",
    """WITH i AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderkey % 3 AS pl, o_orderkey % 41 <> 0 AS b, o_orderkey % 43 <> 0 AS a,
      CASE WHEN o_orderkey % 53 = 0 THEN 'changed output ceiling' WHEN o_orderkey % 59 = 0 THEN 'applicability changed' WHEN o_orderkey % 61 = 0 THEN 'calculation comparison outcome changed' END AS ch FROM orders),
    s AS (SELECT c, bool_or(pl = 0 AND b AND NOT a) AS lq, bool_or(pl = 0 AND a AND NOT b) AS nq, bool_or(pl = 1 AND b AND NOT a) AS md, bool_or(pl = 1 AND a AND NOT b) AS nd,
      bool_or(pl = 2 AND a <> b) AS inv, min_by(ch, CAST(k AS VARCHAR)) FILTER (WHERE pl = 2 AND a AND b AND ch IS NOT NULL) AS ch FROM i GROUP BY ALL)
    SELECT c_custkey AS case_id, CASE WHEN c_custkey % 31 = 0 THEN 'unexpected Finding' WHEN c_custkey % 29 = 0 THEN 'unexpected ConditionalConcern' WHEN lq THEN 'lost question' WHEN nq THEN 'new false question'
      WHEN md THEN 'missing Disclosure' WHEN nd THEN 'new Disclosure' WHEN inv THEN 'calculation observation inventory changed' WHEN ch IS NOT NULL THEN ch
      WHEN c_custkey % 23 = 0 THEN 'project execution detected' WHEN c_custkey % 19 = 0 THEN 'model access detected' WHEN c_custkey % 17 = 0 THEN 'final audit state changed'
      WHEN c_custkey % 31 = 1 THEN 'assessment counts changed' END AS regression FROM customer LEFT JOIN s ON c = c_custkey""",
)
def regression_compare(t: Tables) -> DataFrame:
    return evaluation.regression_compare(*regression_sides(t))


@query(
    "resource_rollup",
    """WITH r AS (SELECT o_custkey AS run, CAST(sum(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey ELSE 0 END) AS BIGINT) AS source_bytes, CAST(sum(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey ELSE 0 END) AS BIGINT) AS sampled_bytes,
      count(*) FILTER (WHERE o_orderstatus = 'F') AS hit, count(*) FILTER (WHERE o_orderstatus = 'O') AS miss, count(*) FILTER (WHERE o_orderstatus = 'P') AS invalidated FROM orders GROUP BY ALL)
    SELECT c_custkey AS run, coalesce(source_bytes, 0) AS source_bytes, coalesce(sampled_bytes, 0) AS sampled_bytes, coalesce(hit, 0) AS hit, coalesce(miss, 0) AS miss, coalesce(invalidated, 0) AS invalidated,
      CAST(0 AS BIGINT) AS uncacheable, greatest(c_acctbal, 0.0) AS active_seconds, CAST(c_nationkey AS DOUBLE) AS paused_seconds FROM customer LEFT JOIN r ON run = c_custkey""",
)
def resource_rollup(t: Tables) -> DataFrame:
    run = F.col("o_custkey").alias("run")
    reads = t.orders.select(run, F.col("o_orderkey").alias("bytes"), (F.col("o_orderkey") % 4 == 0).alias("is_sampled"))
    reuse = t.orders.select(
        run, F.when(F.col("o_orderstatus") == "F", F.lit("hit")).when(F.col("o_orderstatus") == "O", F.lit("miss")).otherwise(F.lit("invalidated")).alias("reuse")
    )
    clocks = t.customer.select(
        F.col("c_custkey").alias("run"), F.col("c_acctbal").alias("active_seconds"), F.col("c_nationkey").cast("double").alias("paused_seconds")
    )
    return evaluation.resource_rollup(reads, reuse, clocks, "run")


@query(
    "threshold_gate",
    f"""WITH {OUTCOMES}, gr AS (SELECT o_custkey % 20 AS set_id, {_SUMS} FROM terms GROUP BY ALL), m AS ({metric_rows('gr', 'set_id,')}),
    rq AS (SELECT set_id, metric_name || ':estimate' AS requirement, CASE WHEN metric_name LIKE '%precision' THEN estimate >= 0.56 ELSE estimate <= 0.165 END AS holds FROM m
      WHERE metric_name IN ('finding_candidate_precision', 'false_root_localization_rate')),
    cq AS (SELECT o_custkey % 20 AS set_id, 'count:workflows' AS requirement, count(*) >= 740 AS holds FROM orders GROUP BY ALL),
    e AS (SELECT * FROM rq UNION ALL SELECT * FROM cq UNION ALL SELECT DISTINCT set_id, 'absent_metric:estimate', false FROM m WHERE set_id % 5 = 0)
    SELECT set_id AS policy_id, requirement, holds, bool_and(holds) OVER (PARTITION BY set_id) AS policy_passes FROM e""",
)
def threshold_gate(t: Tables) -> DataFrame:
    cases = outcomes(t).withColumn("set_id", F.col("problem_id") % 20)
    nothing = F.lit(None).cast("double")
    metrics = evaluation.metric_pairs(cases, ["set_id"]).select(
        "set_id", "metric_name", "estimate", nothing.alias("lower"), nothing.alias("upper"), F.lit("estimated").alias("status")
    )
    counts = cases.groupBy("set_id").agg(F.count("*").alias("value")).withColumn("count_name", F.lit("workflows"))
    sets = cases.select("set_id").distinct()

    def need(metric: str, operator: str, threshold: float, where: str = "true") -> DataFrame:
        return sets.where(where).select(
            F.col("set_id").alias("policy_id"), "set_id", F.lit(metric).alias("metric_name"), F.lit("estimate").alias("statistic"),
            F.lit(operator).alias("operator"), F.lit(threshold).alias("threshold"), F.lit(True).alias("need_interval"),
        )

    requirements = (
        need("finding_candidate_precision", "at_least", 0.56)
        .unionByName(need("false_root_localization_rate", "at_most", 0.165))
        .unionByName(need("absent_metric", "at_most", 0.5, "set_id % 5 = 0"))
    )
    minimums = sets.select(
        F.col("set_id").alias("policy_id"), "set_id", F.lit("workflows").alias("count_name"), F.lit("at_least").alias("comparison"), F.lit(740).alias("required")
    )
    return evaluation.threshold_gate(metrics, counts, requirements, minimums)


@query(
    "lineage_grade",
    """WITH g AS (SELECT o_orderkey AS k, d, CASE WHEN o_orderkey % 5 = 0 THEN 'complete' WHEN o_orderkey % 7 = 0 THEN 'unavailable' WHEN o_orderkey % 11 = 0 THEN 'missing'
      WHEN (o_orderkey + d) % 3 = 0 THEN 'partial' WHEN (o_orderkey + d) % 3 = 1 THEN 'missing' ELSE 'opaque' END AS s FROM orders, range(6) r(d) WHERE o_orderkey % 13 <> 1 OR d <> 2)
    SELECT k AS o_orderkey, CASE WHEN count(*) <> 6 THEN 'invalid' WHEN bool_and(s = 'complete') THEN 'complete' WHEN bool_or(s = 'missing') AND NOT bool_or(s IN ('complete','partial')) THEN 'missing'
      WHEN bool_and(s = 'unavailable') THEN 'unavailable' ELSE 'partial' END AS lineage_status FROM g GROUP BY k""",
)
def lineage_grade(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("d")
    rows = t.orders.select("o_orderkey", F.posexplode(F.array(*[F.lit(x) for x in decide.LINEAGE_DIMENSIONS])).alias("d", "dimension")).where("o_orderkey % 13 <> 1 OR d <> 2")
    status = (
        F.when(k % 5 == 0, F.lit("complete")).when(k % 7 == 0, F.lit("unavailable")).when(k % 11 == 0, F.lit("missing"))
        .when((k + d) % 3 == 0, F.lit("partial")).when((k + d) % 3 == 1, F.lit("missing")).otherwise(F.lit("opaque"))
    )
    return decide.lineage_grade(rows.withColumn("status", status), "o_orderkey")


def admission_inputs(t: Tables) -> tuple[DataFrame, ...]:
    k = F.col("o_orderkey")
    results = t.orders.select(
        k.alias("result_id"), F.col("o_orderpriority").alias("detector_id"),
        F.when(k % 17 == 0, F.lit("uncertain")).otherwise(F.lit("applicable")).alias("applicability"),
        F.when(k % 19 == 0, F.lit("partially_covered")).otherwise(F.lit("covered")).alias("coverage"),
        F.when(k % 23 == 0, 1).otherwise(0).alias("gaps"),
        F.when(k % 29 == 0, 1).otherwise(0).alias("unavailable"),
        F.when(k % 31 == 0, 1).otherwise(0).alias("unresolved_premises"),
        F.when(k % 37 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("p1"), F.lit("p2"))).alias("declared_premises"),
        k.cast("string").alias("digest"),
        F.when(k % 41 == 0, F.lit("x")).otherwise(k.cast("string")).alias("expected_digest"),
        (k % 43 != 0).alias("draft_matches"),
    )
    premises = t.orders.select(
        k.alias("result_id"), F.explode(F.array(F.lit("p1"), F.lit("p2"), F.lit("p3"))).alias("premise_id")
    ).where("result_id % 47 <> 0 OR premise_id <> 'p2'").select(
        "result_id", "premise_id", (F.col("premise_id") != "p3").alias("material"),
        F.when((F.col("result_id") % 53 == 0) & (F.col("premise_id") == "p1"), F.lit("unknown")).otherwise(F.lit("established")).alias("state"),
        F.lit(1).alias("evidence"),
    )
    checks = t.orders.select(
        k.alias("result_id"), F.explode(F.array(F.lit("k1"), F.lit("k2"))).alias("check_id")
    ).where("result_id % 59 <> 0 OR check_id <> 'k2'").select(
        "result_id", "check_id",
        F.when(F.col("check_id") == "k2", F.lit("not_applicable")).otherwise(F.lit("completed")).alias("status"),
        F.when(F.col("check_id") == "k2", F.lit("not_applicable")).when(F.col("result_id") % 61 == 0, F.lit("counterevidence_found"))
        .otherwise(F.lit("no_counterevidence")).alias("outcome"),
    )
    required = t.orders.select(F.col("o_orderpriority").alias("detector_id")).distinct().select(
        "detector_id", F.explode(F.array(F.lit("k1"), F.lit("k2"))).alias("check_id")
    )
    return results, premises, checks, required


@query(
    "finding_admission",
    """WITH g AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 17 = 0 THEN 'applicability' WHEN o_orderkey % 19 = 0 OR o_orderkey % 23 = 0 THEN 'coverage' WHEN o_orderkey % 29 = 0 THEN 'unavailable_evidence'
      WHEN o_orderkey % 31 = 0 OR o_orderkey % 37 = 0 THEN 'premise_declaration' WHEN o_orderkey % 53 = 0 THEN 'premise_not_established' WHEN o_orderkey % 47 = 0 THEN 'premise_sets_differ'
      WHEN o_orderkey % 61 = 0 THEN 'counterevidence' WHEN o_orderkey % 59 = 0 THEN 'counterevidence_incomplete' WHEN o_orderkey % 43 = 0 THEN 'draft' WHEN o_orderkey % 41 = 0 THEN 'digest' END AS gate FROM orders)
    SELECT k AS result_id, gate AS failed_gate, gate IS NULL AS admitted FROM g""",
)
def finding_admission(t: Tables) -> DataFrame:
    return decide.finding_admission(*admission_inputs(t))


@query(
    "relation_check",
    """WITH s AS (SELECT o_orderkey AS k, o_orderkey % 3 AS f, substr('abcde', 1 + CAST(o_orderkey % 5 AS INT)) AS o, (o_custkey % 4) AS r FROM orders)
    SELECT k AS o_orderkey, CASE WHEN f = 0 THEN CASE WHEN ['a','b','c','d'][1 + r] = o[1] THEN 'compatible' ELSE 'conflict' END
      WHEN f = 1 AND r = 3 THEN 'abstained' WHEN f = 1 THEN CASE WHEN contains(o, ['a','b','c','d'][1 + r]) AND contains(o, 'e') AND NOT contains(o, 'd') THEN 'compatible' ELSE 'conflict' END
      WHEN f = 2 AND NOT (contains(o, ['a','b','c','d'][1 + r]) AND contains(o, 'c')) THEN 'abstained'
      ELSE CASE WHEN strpos(o, ['a','b','c','d'][1 + r]) < strpos(o, 'c') THEN 'compatible' ELSE 'conflict' END END AS relation FROM s""",
)
def relation_check(t: Tables) -> DataFrame:
    form = F.get(F.array(F.lit("value_equals"), F.lit("set_relation"), F.lit("step_precedes")), (F.col("o_orderkey") % 3).cast("int"))
    letter = F.get(F.array(*[F.lit(x) for x in "abcd"]), (F.col("o_custkey") % 4).cast("int"))
    seen = F.split(F.substring(F.lit("abcde"), 1 + F.col("o_orderkey").cast("int") % 5, F.lit(5)), "")
    required = F.when(F.col("o_orderkey") % 3 == 0, F.array(letter)).when(F.col("o_orderkey") % 3 == 1, F.array(letter, F.lit("e"))).otherwise(F.array(letter, F.lit("c")))
    rows = t.orders.select("o_orderkey", form.alias("form"), required.alias("required"), seen.alias("observed"), F.array(F.lit("d")).alias("forbidden"))
    return decide.relation_check(rows).select("o_orderkey", "relation")


@query(
    "model_compatibility",
    """WITH s AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS count, ['raw_counts','transformed_continuous','normalized_continuous'][1 + o_custkey % 3] AS scale, o_orderstatus = 'F' AS nb FROM orders)
    SELECT o_orderkey, CASE WHEN count THEN scale = 'raw_counts' AND nb ELSE scale <> 'raw_counts' AND NOT nb END AS compatible FROM s""",
)
def model_compatibility(t: Tables) -> DataFrame:
    rows = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("count_likelihood")).otherwise(F.lit("location_test")).alias("required"),
        F.get(F.array(F.lit("raw_counts"), F.lit("transformed_continuous"), F.lit("normalized_continuous")), (F.col("o_custkey") % 3).cast("int")).alias("scale"),
        F.when(F.col("o_orderstatus") == "F", F.lit("negative_binomial_count_likelihood")).otherwise(F.lit("generic_continuous_location_test")).alias("observed"),
    )
    return decide.model_compatibility(rows, "required", "scale", "observed").select("o_orderkey", "compatible")


@query(
    "observation_reduce",
    """WITH o AS (SELECT DISTINCT o_custkey AS c, CASE WHEN o_orderkey % 90 = 1 THEN 'ambiguous' WHEN o_orderkey % 9 < 4 THEN 'applicable' WHEN o_orderkey % 9 < 6 THEN 'unsupported' ELSE 'not_applicable' END AS s,
      CASE WHEN o_orderkey % 50 = 2 THEN 'odd' ELSE 'op' END AS op, CASE WHEN o_orderkey % 70 = 3 THEN 'p2' ELSE 'p1' END AS path, o_orderstatus AS plane FROM orders),
    g AS (SELECT c, count(*) AS n, count(DISTINCT (s, op)) AS eq, bool_or(s = 'ambiguous') AS amb, bool_or(s = 'applicable') AS app, bool_or(s = 'unsupported') AS uns, bool_or(s = 'not_applicable') AS na,
      count(DISTINCT op) FILTER (WHERE s = 'applicable') AS ops, bool_or(s = 'unsupported' AND op = 'odd') AS u_odd, bool_or(s = 'unsupported' AND op = 'op') AS u_op, min(op) FILTER (WHERE s = 'applicable') AS a0 FROM o GROUP BY ALL),
    p AS (SELECT DISTINCT c FROM (SELECT c, plane, count(DISTINCT path) AS k FROM o WHERE s = 'applicable' GROUP BY ALL) WHERE k > 1)
    SELECT c_custkey AS check_id, coalesce(n, 0) AS observations, coalesce(eq, 0) AS equivalence_groups, CASE WHEN amb THEN 'ambiguous' WHEN app AND (ops <> 1 OR p.c IS NOT NULL) THEN 'ambiguous'
      WHEN app AND ((u_odd AND a0 <> 'odd') OR (u_op AND a0 <> 'op')) THEN 'ambiguous' WHEN app THEN 'applicable' WHEN uns OR c_custkey % 8 = 0 THEN 'unsupported' WHEN na THEN 'not_applicable' ELSE 'unsupported' END AS state
    FROM customer LEFT JOIN g ON g.c = c_custkey LEFT JOIN p ON p.c = c_custkey WHERE g.c IS NOT NULL OR c_custkey % 8 = 0""",
)
def observation_reduce(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    state = F.when(k % 90 == 1, F.lit("ambiguous")).when(k % 9 < 4, F.lit("applicable")).when(k % 9 < 6, F.lit("unsupported")).otherwise(F.lit("not_applicable"))
    rows = t.orders.select(
        F.col("o_custkey").alias("check_id"), state.alias("state"), F.when(k % 50 == 2, F.lit("odd")).otherwise(F.lit("op")).alias("operand"),
        F.lit("scope").alias("scope_endpoint"), F.when(k % 70 == 3, F.lit("p2")).otherwise(F.lit("p1")).alias("path"), F.lit("target").alias("target"),
        F.col("o_orderstatus").alias("plane"),
    )
    rows = rows.withColumn("digest", F.sha2(F.concat_ws("|", "state", "operand", "path", "plane"), 256)).withColumn(
        "equivalence_key", F.concat_ws("|", "state", "operand")
    )
    failures = t.customer.where("c_custkey % 8 = 0").select(F.col("c_custkey").alias("check_id"), F.lit("adapter").alias("adapter_id"))
    return decide.observation_reduce(rows, failures)
