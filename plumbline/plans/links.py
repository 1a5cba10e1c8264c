"""Queries for joins, sets, snapshots, graphs, order and leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import ids
from plumbline.operators import diff, graph, leakage, linking, ordering
from plumbline.plans.registry import Tables, query
from plumbline.plans.texts import CLAIMS, claim_lines
from plumbline.skew import running, with_blocks
from plumbline.functions import text


def line_keys(t: Tables) -> tuple[DataFrame, DataFrame]:
    left = t.lineitem.select(
        F.col("l_suppkey").alias("family"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("measure")
    )
    right = t.lineitem.where("l_suppkey % 10 <> 3 OR l_orderkey % 100 <> 0").select(
        F.col("l_suppkey").alias("family"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_tax").alias("p")
    )
    return left, right


KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]
KEYED = """l AS (SELECT l_suppkey AS family, l_orderkey, l_linenumber, l_partkey, l_quantity AS measure FROM lineitem),
r AS (SELECT l_suppkey AS family, l_orderkey, l_linenumber, l_partkey, l_tax AS p FROM lineitem WHERE l_suppkey % 10 <> 3 OR l_orderkey % 100 <> 0),
lk AS (SELECT family, l_orderkey, l_linenumber, l_partkey, count(*) AS n FROM l GROUP BY ALL),
rk AS (SELECT family, l_orderkey, l_linenumber, l_partkey, count(*) AS n FROM r GROUP BY ALL),
b AS (SELECT family, l_orderkey, coalesce(lk.n, 0) AS ln, coalesce(rk.n, 0) AS rn FROM lk FULL JOIN rk USING (family, l_orderkey, l_linenumber, l_partkey)),
tot AS (SELECT family, count(*) AS keys, count(*) FILTER (WHERE rn = 0) AS left_only, count(*) FILTER (WHERE ln = 0) AS right_only,
  count(*) FILTER (WHERE ln > 1 OR rn > 1) AS repeated, bool_and(ln = 1 AND rn = 1) AS total FROM b GROUP BY ALL)"""


@query("key_totality", f"WITH {KEYED} SELECT * FROM tot")
def key_totality(t: Tables) -> DataFrame:
    return linking.key_totality(*line_keys(t), KEYS, ["family"])


@query(
    "total_key_join",
    f"""WITH {KEYED} SELECT l.family, l.l_orderkey, l.l_linenumber, l.l_partkey, measure, p FROM l JOIN tot ON l.family = tot.family AND total
    JOIN r ON l.family = r.family AND l.l_orderkey = r.l_orderkey AND l.l_linenumber = r.l_linenumber AND l.l_partkey = r.l_partkey""",
)
def total_key_join(t: Tables) -> DataFrame:
    return linking.total_key_join(*line_keys(t), KEYS, ["family"])


def claims(t: Tables) -> DataFrame:
    found = text.directional_claims(text.document_spans(claim_lines(t), "text"))
    return found.select(F.col("p_partkey").alias("claim_id"), "subject", "object", "comparison", "direction")


def results(t: Tables) -> DataFrame:
    """Verified mean differences of size between the colours of two parts, per type."""
    side = F.split("p_name", " ")
    base = t.part.groupBy(
        F.element_at(side, 1).alias("left_group"), F.element_at(side, -1).alias("right_group"), F.col("p_type")
    ).agg(F.count("*").alias("n"), F.sum(F.col("p_size") - 25).alias("value"), F.min("p_partkey").alias("k"))
    return base.select(
        F.concat(F.lit("r"), F.col("k").cast("string")).alias("result_id"),
        "left_group",
        "right_group",
        F.concat(F.col("p_type"), F.lit("  Price")).alias("outcome_column"),
        F.concat_ws(" versus ", "left_group", "right_group").alias("comparison"),
        F.col("value").cast("double").alias("value"),
        F.when(F.col("k") % 3 == 0, F.lit("control_minus_treated"))
        .when(F.col("k") % 3 == 1, F.lit("treated_minus_control"))
        .otherwise(F.lit("unknown"))
        .alias("orientation"),
        F.concat(F.lower("p_type"), F.lit(" price")).alias("scale"),
    ).where("k % 17 <> 0").unionByName(
        base.where("k % 5 = 0").select(
            F.concat(F.lit("twin"), F.col("k").cast("string")).alias("result_id"),
            "left_group",
            "right_group",
            F.concat(F.col("p_type"), F.lit(" price")).alias("outcome_column"),
            F.concat_ws(" Versus ", "left_group", "right_group").alias("comparison"),
            F.col("value").cast("double").alias("value"),
            F.lit("unknown").alias("orientation"),
            F.lit("other").alias("scale"),
        )
    )


RESULTS = """base AS (SELECT split_part(p_name, ' ', 1) AS lg, split_part(p_name, ' ', -1) AS rg, p_type, sum(p_size - 25) AS value, min(p_partkey) AS k
  FROM part GROUP BY ALL),
results AS (SELECT 'r' || k AS result_id, lg, rg, lower(p_type) || ' price' AS o, CAST(value AS DOUBLE) AS value,
  CASE WHEN k % 3 = 0 THEN 'control_minus_treated' WHEN k % 3 = 1 THEN 'treated_minus_control' ELSE 'unknown' END AS orientation,
  lower(p_type) || ' price' AS scale FROM base WHERE k % 17 <> 0
  UNION ALL SELECT 'twin' || k, lg, rg, lower(p_type) || ' price', CAST(value AS DOUBLE), 'unknown', 'other' FROM base WHERE k % 5 = 0),
found AS (SELECT lower(lg) AS lg, lower(rg) AS rg, o, count(*) AS candidates, min(result_id) AS solo FROM results GROUP BY ALL),
linked AS (SELECT p_partkey AS claim_id, a, z, object, direction, coalesce(candidates, 0) AS candidates,
  CASE WHEN candidates = 1 THEN solo END AS result_id FROM claims LEFT JOIN found ON lower(a) = lg AND lower(z) = rg AND object = o),
peers AS (SELECT lower(a) AS a, lower(z) AS z, object, count(*) FILTER (WHERE direction = 'positive') AS pos,
  count(*) FILTER (WHERE direction = 'negative') AS neg FROM claims GROUP BY ALL)"""


@query("link_claims", f"WITH {CLAIMS}, {RESULTS} SELECT claim_id, candidates, result_id FROM linked")
def link_claims(t: Tables) -> DataFrame:
    return linking.link_claims(claims(t), results(t)).select("claim_id", "candidates", "result_id")


@query(
    "conflicting_peers",
    f"""WITH {CLAIMS}, {RESULTS} SELECT p_partkey AS claim_id, CASE WHEN direction = 'positive' THEN neg ELSE pos END AS opposite_peers
    FROM claims c JOIN peers p ON lower(c.a) = p.a AND lower(c.z) = p.z AND c.object = p.object""",
)
def conflicting_peers(t: Tables) -> DataFrame:
    return linking.conflicting_peers(claims(t)).select("claim_id", "opposite_peers")


@query(
    "direction_check",
    f"""WITH {CLAIMS}, {RESULTS}, j AS (SELECT claim_id, direction, CASE WHEN orientation = 'control_minus_treated' THEN -value ELSE value END AS v,
      orientation, scale = linked.object AS same,
      (SELECT CASE WHEN linked.direction = 'positive' THEN neg ELSE pos END FROM peers p WHERE lower(linked.a) = p.a AND lower(linked.z) = p.z AND linked.object = p.object) AS opposite
      FROM linked LEFT JOIN results USING (result_id)),
    k AS (SELECT *, coalesce(v IS NOT NULL AND orientation <> 'unknown' AND same, false) AS known FROM j)
    SELECT claim_id, CASE WHEN known AND v > 0 THEN 'positive' WHEN known AND v < 0 THEN 'negative' END AS recomputed_direction,
      CASE WHEN NOT known OR opposite > 0 THEN 'unresolved' WHEN v > 0 AND direction = 'positive' OR v < 0 AND direction = 'negative' THEN 'agree' ELSE 'conflict' END AS agreement
    FROM k""",
)
def direction_check(t: Tables) -> DataFrame:
    linked = linking.link_claims(linking.conflicting_peers(claims(t)), results(t))
    return linking.direction_check(linked, results(t)).select("claim_id", "recomputed_direction", "agreement")


@query(
    "unique_candidates",
    "SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL HAVING count(*) = 1",
)
def unique_candidates(t: Tables) -> DataFrame:
    return linking.unique_candidates(
        t.orders.select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey", "o_orderpriority"]
    )


@query(
    "reference_violations",
    """WITH d AS (SELECT CAST(o_orderkey AS VARCHAR) AS record_id FROM orders WHERE o_orderkey % 50 <> 1
      UNION ALL SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 400 = 0)
    SELECT 'duplicate_id' AS violation, record_id, count(*) AS occurrences FROM d GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT 'dangling:line', CAST(l_orderkey AS VARCHAR), count(*) FROM lineitem
      WHERE CAST(l_orderkey AS VARCHAR) NOT IN (SELECT record_id FROM d) GROUP BY ALL""",
)
def reference_violations(t: Tables) -> DataFrame:
    records = t.orders.where("o_orderkey % 50 <> 1").select("o_orderkey").unionByName(
        t.orders.where("o_orderkey % 400 = 0").select("o_orderkey")
    )
    return linking.reference_violations(records, "o_orderkey", {"line": (t.lineitem, "l_orderkey")})


@query(
    "scope_classify",
    """WITH s AS (SELECT DISTINCT o_custkey AS case_id, o_orderkey AS ref FROM orders WHERE o_orderpriority = '1-URGENT'),
    f AS (SELECT o_custkey AS case_id, o_orderkey AS finding_id, o_orderstatus AS issue_class FROM orders)
    SELECT f.case_id, f.finding_id, issue_class, CASE WHEN f.case_id NOT IN (SELECT case_id FROM s) THEN 'unresolved'
      WHEN issue_class IN ('O', 'F') AND s.ref IS NOT NULL THEN 'in_scope' ELSE 'out_of_scope' END AS scope
    FROM f LEFT JOIN s ON f.case_id = s.case_id AND f.finding_id = s.ref""",
)
def scope_classify(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("finding_id"), "o_orderstatus", "o_orderpriority")
    findings = o.select("case_id", "finding_id", F.col("o_orderstatus").alias("issue_class"))
    subjects = o.select("case_id", "finding_id", F.col("finding_id").alias("ref"))
    refs = o.where("o_orderpriority = '1-URGENT'").select("case_id", F.col("finding_id").alias("ref"))
    classes = o.select("case_id", F.explode(F.array(F.lit("O"), F.lit("F"))).alias("issue_class")).distinct()
    return linking.scope_classify(findings, subjects, refs, classes)


@query(
    "span_containment",
    """WITH i AS (SELECT l_suppkey AS path, l_partkey AS start_line, l_partkey + l_linenumber AS end_line, l_orderkey FROM lineitem WHERE l_returnflag <> 'N'),
    o AS (SELECT l_suppkey AS path, l_partkey AS start_line, l_partkey + CAST(l_quantity AS BIGINT) * 3 AS end_line FROM lineitem WHERE l_returnflag = 'N')
    SELECT i.*, EXISTS (SELECT 1 FROM o WHERE o.path = i.path AND i.start_line >= o.start_line AND i.end_line <= o.end_line) AS inside FROM i""",
)
def span_containment(t: Tables) -> DataFrame:
    inner = t.lineitem.where("l_returnflag <> 'N'").select(
        F.col("l_suppkey").alias("path"), F.col("l_partkey").alias("start_line"),
        (F.col("l_partkey") + F.col("l_linenumber")).alias("end_line"), "l_orderkey",
    )
    outer = t.lineitem.where("l_returnflag = 'N'").select(
        F.col("l_suppkey").alias("path"), F.col("l_partkey").alias("start_line"),
        (F.col("l_partkey") + F.col("l_quantity").cast("long") * 3).alias("end_line"),
    )
    return linking.span_containment(inner, outer)


@query(
    "required_matrix",
    """WITH types AS (SELECT unnest(['error_bearing','corrected_twin','valid_alternative','hard_negative','ambiguous','unsupported','renamed_implementation']) AS cell_type),
    a AS (SELECT c_nationkey AS plan, o_orderpriority AS envelope_id, o_orderstatus AS block_id,
      ['error_bearing','corrected_twin','valid_alternative','hard_negative','ambiguous','unsupported','renamed_implementation'][1 + o_orderkey % 7] AS cell_type,
      count(*) AS assigned FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    e AS (SELECT DISTINCT c_nationkey AS plan, o_orderpriority AS envelope_id FROM orders JOIN customer ON o_custkey = c_custkey),
    b AS (SELECT DISTINCT c_nationkey AS plan, o_orderstatus AS block_id FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT b.plan, b.block_id, e.envelope_id, t.cell_type, coalesce(a.assigned, 0) AS assigned FROM b JOIN e USING (plan) CROSS JOIN types t
    LEFT JOIN a ON a.plan = b.plan AND a.block_id = b.block_id AND a.envelope_id = e.envelope_id AND a.cell_type = t.cell_type
    WHERE coalesce(a.assigned, 0) <> 1""",
)
def required_matrix(t: Tables) -> DataFrame:
    o = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("plan")), "o_custkey")
    kinds = F.array(*[F.lit(c) for c in linking.CELL_TYPES])
    assigned = o.select(
        "plan", F.col("o_orderpriority").alias("envelope_id"), F.col("o_orderstatus").alias("block_id"),
        F.get(kinds, (F.col("o_orderkey") % 7).cast("int")).alias("cell_type"),
    )
    envelopes = o.select("plan", F.col("o_orderpriority").alias("envelope_id")).distinct()
    blocks = o.select("plan", F.col("o_orderstatus").alias("block_id")).distinct()
    return linking.required_matrix(assigned, blocks, envelopes, "plan")


def graded(t: Tables) -> tuple[DataFrame, DataFrame]:
    price = F.round(F.col("o_totalprice") * 100).cast("long")
    cents = price + F.when(F.col("o_orderkey") % 6 == 0, 7).otherwise(F.col("o_orderkey") % 3)
    actual = t.orders.select(
        F.col("o_orderkey").alias("record"),
        F.inline(
            F.array(
                F.struct(F.lit("price").alias("field"), cents.cast("string").alias("actual")),
                F.struct(F.lit("status").alias("field"), F.when(F.col("o_orderkey") % 10 == 0, F.lit("Q")).otherwise(F.col("o_orderstatus")).alias("actual")),
                F.struct(F.lit("customer").alias("field"), F.when(F.col("o_orderkey") % 8 == 0, F.lit("1.0")).otherwise(F.col("o_custkey").cast("string")).alias("actual")),
            )
        ),
    ).where("record % 9 <> 0 OR field <> 'status'")
    spec = lambda f, kind, e, tol, low: F.struct(
        F.lit(f).alias("field"), F.lit(kind).alias("kind"), e.alias("expected"),
        F.lit(tol).cast("double").alias("tolerance"), F.lit(low).cast("double").alias("min_value"), F.lit(None).cast("double").alias("max_value"),
    )
    expected = t.orders.select(
        F.col("o_orderkey").alias("record"),
        F.inline(
            F.array(
                spec("price", "numeric", price.cast("string"), 2.0, 150000.0),
                spec("status", "string", F.col("o_orderstatus"), None, None),
                spec("customer", "integer", F.col("o_custkey").cast("string"), None, 0.0),
            )
        ),
    )
    return actual, expected


GRADED = """g AS (SELECT o_orderkey AS record, CAST(round(o_totalprice * 100) AS BIGINT) AS price, CASE WHEN o_orderkey % 6 = 0 THEN 7 ELSE o_orderkey % 3 END AS d FROM orders),
m AS (SELECT record, 'price' AS field, CAST(d AS DOUBLE) AS absolute_error, d <= 2 AND price + d >= 150000 AS matches FROM g
  UNION ALL SELECT record, 'status', NULL, record % 10 <> 0 AND record % 9 <> 0 FROM g
  UNION ALL SELECT record, 'customer', NULL, record % 8 <> 0 FROM g)"""


@query("tolerance_compare", f"WITH {GRADED} SELECT record, field, absolute_error, matches FROM m")
def tolerance_compare(t: Tables) -> DataFrame:
    return linking.tolerance_compare(*graded(t), ["record", "field"]).select("record", "field", "absolute_error", "matches")


@query(
    "record_grade",
    f"""WITH {GRADED} SELECT record, count(*) AS fields, count(*) FILTER (WHERE matches) AS matching, bool_and(matches) AS all_match FROM m GROUP BY record""",
)
def record_grade(t: Tables) -> DataFrame:
    return linking.record_grade(linking.tolerance_compare(*graded(t), ["record", "field"]), ["record"])


@query(
    "report_vs_table",
    """WITH r AS (SELECT least(l_suppkey, l_partkey % 100) AS lo, greatest(l_suppkey, l_partkey % 100) AS hi, l_linestatus, l_linenumber, count(*) AS n, min(l_tax) AS v
      FROM lineitem WHERE l_suppkey <> l_partkey % 100 AND l_returnflag <> 'N' GROUP BY ALL),
    t AS (SELECT DISTINCT l_suppkey AS left_id, l_partkey % 100 AS right_id, l_linestatus, l_linenumber FROM lineitem WHERE l_returnflag = 'N')
    SELECT left_id, right_id, t.l_linestatus, t.l_linenumber, coalesce(n, 0) AS reports, CASE WHEN n = 1 THEN v END AS reported,
      CASE WHEN n = 1 THEN 'applicable' ELSE 'unsupported' END AS applicability
    FROM t LEFT JOIN r ON left_id <> right_id AND least(left_id, right_id) = lo AND greatest(left_id, right_id) = hi
      AND t.l_linestatus = r.l_linestatus AND t.l_linenumber = r.l_linenumber""",
)
def report_vs_table(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("left_id"), (F.col("l_partkey") % 100).alias("right_id"), "l_linestatus", "l_linenumber", "l_tax", "l_returnflag"
    )
    targets = rows.where("l_returnflag = 'N'").select("left_id", "right_id", "l_linestatus", "l_linenumber").distinct()
    said = rows.where("l_returnflag <> 'N'").select(
        F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"), "l_linestatus", "l_linenumber", "l_tax"
    )
    return linking.report_vs_table(targets, said, ["l_linestatus", "l_linenumber"], "l_tax")


@query(
    "span_verify",
    """WITH f AS (SELECT doc_id AS path, 'sha256:' || sha256(text) AS digest, string_split(CASE WHEN ends_with(text, chr(10)) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS lines FROM documents),
    r AS (SELECT *, 1 + path % 3 AS s, 2 + path % 4 AS e FROM f)
    SELECT path, CASE WHEN path % 19 = 0 THEN 'digest_mismatch' WHEN s > e OR e > len(lines) THEN 'outside_file'
      WHEN path % 7 = 0 THEN 'quote_mismatch' ELSE 'verified' END AS span_status FROM r""",
)
def span_verify(t: Tables) -> DataFrame:
    files = t.documents.select(F.col("doc_id").alias("path"), "text")
    lines = F.split(F.regexp_replace("text", r"\n$", ""), "\n")
    s, e = 1 + F.col("path") % 3, 2 + F.col("path") % 4
    quote = F.array_join(F.slice(lines, s, F.greatest(e - s + 1, F.lit(0))), "\n")
    refs = files.select(
        "path",
        F.when(F.col("path") % 19 == 0, F.lit("sha256:0")).otherwise(ids.sha256_digest(F.col("text"))).alias("digest"),
        s.alias("start_line"),
        e.alias("end_line"),
        F.when(F.col("path") % 7 == 0, F.concat(quote, F.lit("!"))).otherwise(quote).alias("quoted"),
        F.lit(None).cast("int").alias("start_column"),
        F.lit(None).cast("int").alias("end_column"),
    )
    return linking.span_verify(refs, files, "path", "text").select("path", "span_status")


def snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    before = t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate")
    changed = F.when(F.col("o_orderkey") % 13 == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))
    kept = before.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", changed)
    added = before.where("o_orderkey % 17 = 0").withColumn("o_orderkey", -1 - F.col("o_orderkey"))
    return before, kept.unionByName(added)


CHANGES = """d AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'removed' WHEN o_orderkey % 13 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM orders
  UNION ALL SELECT -1 - o_orderkey, 'added' FROM orders WHERE o_orderkey % 17 = 0)"""


@query("snapshot_diff", f"WITH {CHANGES} SELECT k AS o_orderkey, change FROM d")
def snapshot_diff(t: Tables) -> DataFrame:
    before, after = snapshots(t)
    digest = ids.sha256_digest(F.concat_ws("|", "o_orderstatus", F.col("o_orderdate").cast("string"))).alias("digest")
    return diff.snapshot_diff(before.select("o_orderkey", digest), after.select("o_orderkey", digest), ["o_orderkey"], "digest")


@query(
    "workspace_divergence",
    f"""WITH {CHANGES} SELECT 'o' || k AS path FROM d WHERE change <> 'unchanged' UNION SELECT 'o' || o_orderkey FROM orders WHERE o_orderkey % 101 = 0""",
)
def workspace_divergence(t: Tables) -> DataFrame:
    def shape(df: DataFrame) -> DataFrame:
        return df.select(
            F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"), F.lit("file").alias("kind"),
            F.length("o_orderstatus").alias("size"), F.sha2("o_orderstatus", 256).alias("fingerprint"),
        )

    before, after = snapshots(t)
    unreadable = shape(before.where("o_orderkey % 101 = 0")).select("path")
    return diff.divergence(shape(before), shape(after), unreadable)


@query(
    "merge_divergence",
    """WITH c AS (SELECT o_custkey AS run, o_orderstatus || (o_orderkey % 5) AS path, epoch_us(o_orderdate) AS seen FROM orders)
    SELECT run, path, min(first_seen) AS first_detected_at FROM (SELECT run, path, min(seen) OVER (PARTITION BY run) AS first_seen FROM c) GROUP BY ALL""",
)
def merge_divergence(t: Tables) -> DataFrame:
    seen = t.orders.select(
        F.col("o_custkey").alias("run"),
        F.concat("o_orderstatus", (F.col("o_orderkey") % 5).cast("string")).alias("path"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("detected_at"),
    )
    return diff.merge_divergence(seen, "run")


@query(
    "checksum_verify",
    """SELECT doc_id AS path, CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 10 = 1 THEN 'unexpected'
      WHEN doc_id % 10 = 2 THEN 'drifted' ELSE 'verified' END AS status FROM documents""",
)
def checksum_verify(t: Tables) -> DataFrame:
    docs = t.documents.select(F.col("doc_id").alias("path"), ids.sha256_digest(F.col("text")).alias("digest"))
    declared = docs.where("path % 10 <> 1").withColumn("digest", F.when(F.col("path") % 10 == 2, F.lit("sha256:0")).otherwise(F.col("digest")))
    return diff.checksum_verify(declared, docs.where("path % 10 <> 0"))


@query(
    "cache_reuse",
    """SELECT 'scope' || o_orderkey AS scope_key, CASE WHEN o_orderkey % 11 = 0 THEN 'invalidated' WHEN o_orderkey % 23 = 5 THEN 'uncacheable'
      WHEN o_orderkey % 13 = 0 THEN 'invalidated' ELSE 'hit' END AS reuse, o_orderkey % 11 <> 0 AS is_current FROM orders
    UNION ALL SELECT 'scope' || (-1 - o_orderkey), CASE WHEN pm = 5 THEN 'uncacheable' ELSE 'miss' END, true
      FROM (SELECT o_orderkey, ((-1 - o_orderkey) % 23 + 23) % 23 AS pm FROM orders WHERE o_orderkey % 17 = 0)""",
)
def cache_reuse(t: Tables) -> DataFrame:
    def keyed(df: DataFrame) -> DataFrame:
        return df.select(
            F.concat(F.lit("scope"), F.col("o_orderkey").cast("string")).alias("scope_key"),
            diff.cache_key([F.lit("component"), F.lit("1"), F.col("o_orderstatus"), F.col("o_orderkey")]).alias("cache_key"),
            (F.pmod("o_orderkey", F.lit(23)) != 5).alias("cacheable"),
        )

    before, after = snapshots(t)
    return diff.cache_reuse(keyed(before).drop("cacheable"), keyed(after))


SETSQL = lambda c: (
    f"'sha256:' || sha256(concat_ws(':', count({c}), " + ", ".join(
        f"coalesce(sum(CAST('0x' || substr(sha256({c}), {1 + 15 * i}, 15) AS BIGINT)), 0)" for i in range(4)
    ) + "))"
)


@query(
    "identifier_equality",
    f"""WITH l AS (SELECT l_linenumber AS side, CAST(l_partkey AS VARCHAR) AS id FROM lineitem WHERE l_linenumber <> 7 OR l_partkey % 2 = 0 GROUP BY ALL),
    r AS (SELECT DISTINCT l_linenumber AS side, CAST(p_partkey AS VARCHAR) AS id FROM part, (SELECT DISTINCT l_linenumber FROM lineitem)),
    b AS (SELECT coalesce(l.side, r.side) AS side, l.id AS a, r.id AS b FROM l FULL JOIN r ON l.side = r.side AND l.id = r.id)
    SELECT side, count(a) AS left_count, count(b) AS right_count, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS overlap,
      count(*) FILTER (WHERE b IS NULL) AS left_only, count(*) FILTER (WHERE a IS NULL) AS right_only,
      {SETSQL('a')} AS left_digest, {SETSQL('b')} AS right_digest, 'applicable' AS applicability,
      CASE WHEN count(*) FILTER (WHERE b IS NULL OR a IS NULL) = 0 THEN 'conformant' ELSE 'nonconformant' END AS comparison_outcome
    FROM b GROUP BY side""",
)
def identifier_equality(t: Tables) -> DataFrame:
    left = t.lineitem.where("l_linenumber <> 7 OR l_partkey % 2 = 0").select(
        F.col("l_linenumber").alias("side"), F.col("l_partkey").alias("id")
    ).distinct()
    right = t.part.select(F.explode(F.sequence(F.lit(1), F.lit(7))).alias("side"), F.col("p_partkey").alias("id"))
    return diff.identifier_equality(left, right, "id", ["side"])


@query(
    "multiset_difference",
    """WITH l AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL),
    r AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL)
    SELECT o_custkey, o_orderpriority, greatest(coalesce(l.n, 0) - coalesce(r.n, 0), 0) AS left_surplus,
      greatest(coalesce(r.n, 0) - coalesce(l.n, 0), 0) AS right_surplus
    FROM l FULL JOIN r USING (o_custkey, o_orderpriority) WHERE coalesce(l.n, 0) <> coalesce(r.n, 0)""",
)
def multiset_difference(t: Tables) -> DataFrame:
    return diff.multiset_difference(
        t.orders.where("o_orderkey % 2 = 0"), t.orders.where("o_orderkey % 2 = 1"), ["o_custkey", "o_orderpriority"]
    )


@query(
    "symmetric_difference",
    """WITH l AS (SELECT DISTINCT l_partkey || '-' || l_suppkey AS k FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'),
    r AS (SELECT DISTINCT l_partkey || '-' || l_suppkey AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')
    SELECT coalesce(l.k, r.k) AS k, CASE WHEN l.k IS NULL THEN 'right' ELSE 'left' END AS side FROM l FULL JOIN r ON l.k = r.k WHERE l.k IS NULL OR r.k IS NULL""",
)
def symmetric_difference(t: Tables) -> DataFrame:
    key = F.concat_ws("-", "l_partkey", "l_suppkey").alias("k")
    early = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return diff.symmetric_difference(t.lineitem.where(early).select(key), t.lineitem.where(~early).select(key), "k")


@query(
    "difference_examples",
    """WITH d AS (SELECT l_suppkey, l_returnflag, l_partkey * 100000 + l_orderkey AS v FROM lineitem)
    SELECT l_suppkey, l_returnflag, rn AS position, v, total FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY v) AS rn,
      count(*) OVER (PARTITION BY l_suppkey, l_returnflag) AS total FROM d) WHERE rn <= 64""",
)
def difference_examples(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", "l_returnflag", (F.col("l_partkey") * 100000 + F.col("l_orderkey")).alias("v"))
    return diff.difference_examples(rows, ["l_suppkey"], "l_returnflag", "v")


@query(
    "union_dedupe",
    """WITH u AS (SELECT l_orderkey, l_returnflag || l_linestatus AS digest, CASE WHEN l_linenumber < 4 THEN 0 ELSE 1 END AS part FROM lineitem)
    SELECT l_orderkey, count(DISTINCT digest) AS contents, substr(min(part || digest), 2) AS kept FROM u GROUP BY ALL HAVING count(DISTINCT digest) > 1""",
)
def union_dedupe(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("digest"), "l_linenumber")
    first, second = rows.where("l_linenumber < 4").drop("l_linenumber"), rows.where("l_linenumber >= 4").drop("l_linenumber")
    kept, gaps = diff.union_dedupe([first, second], "l_orderkey", "digest", drop_conflicts=False)
    return gaps.join(kept.withColumnRenamed("digest", "kept"), "l_orderkey")


@query(
    "union_dedupe_kept",
    """WITH u AS (SELECT l_orderkey, l_returnflag || l_linestatus AS digest, CASE WHEN l_linenumber < 4 THEN '0' ELSE '1' END AS part FROM lineitem)
    SELECT l_orderkey, substr(min(part || digest), 2) AS digest FROM u GROUP BY ALL""",
)
def union_dedupe_kept(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("digest"), "l_linenumber")
    first, second = rows.where("l_linenumber < 4").drop("l_linenumber"), rows.where("l_linenumber >= 4").drop("l_linenumber")
    return diff.union_dedupe([first, second], "l_orderkey", "digest", drop_conflicts=False)[0]


@query(
    "ambiguous_claims",
    """SELECT l_partkey || '-' || l_quantity::BIGINT AS path, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) = 1""",
)
def ambiguous_claims(t: Tables) -> DataFrame:
    path = F.concat_ws("-", "l_partkey", F.col("l_quantity").cast("long")).alias("path")
    return diff.ambiguous_claims(t.lineitem.select(path, "l_suppkey"), "path", "l_suppkey")


@query(
    "obligation_difference",
    """WITH s AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS present FROM orders GROUP BY ALL)
    SELECT o_custkey, array_to_string(list_filter(['1-URGENT', '2-HIGH', '5-LOW'], lambda x: NOT list_contains(present, x)), '|') AS omitted,
      '5-LOW' AS contradictory, array_to_string(list_filter(['3-MEDIUM', '5-LOW'], lambda x: list_contains(present, x)), '|') AS present_forbidden FROM s""",
)
def obligation_difference(t: Tables) -> DataFrame:
    # Five priorities at most, so the set is small whatever the customer.
    held = t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("present"))
    rows = held.select(
        "o_custkey", "present", F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("5-LOW")).alias("required"),
        F.array(F.lit("3-MEDIUM"), F.lit("5-LOW")).alias("forbidden"),
    )
    out = diff.obligation_difference(rows, "required", "present", "forbidden")
    return out.select("o_custkey", *[F.array_join(c, "|").alias(c) for c in ("omitted", "contradictory", "present_forbidden")])


def nation_graph(t: Tables) -> DataFrame:
    """region -> nation -> customer -> order, with a shortcut and a doubled edge for some."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rn = t.nation.select(name("r", "n_regionkey").alias("source"), F.lit("holds").alias("relation"), name("n", "n_nationkey").alias("target"))
    nc = t.customer.select(name("n", "c_nationkey").alias("source"), F.lit("serves").alias("relation"), name("c", "c_custkey").alias("target"))
    co = t.orders.select(name("c", "o_custkey").alias("source"), F.lit("placed").alias("relation"), name("o", "o_orderkey").alias("target"))
    twin = co.where("pmod(cast(substr(target, 2) as bigint), 7) = 0")
    back = co.where("pmod(cast(substr(target, 2) as bigint), 50) = 0").select(F.col("target").alias("source"), F.lit("of").alias("relation"), F.col("source").alias("target"))
    edges = rn.unionByName(nc).unionByName(co).unionByName(twin).unionByName(back)
    return edges.withColumn("profile", F.when(F.col("relation") == "serves", F.lit("b")).otherwise(F.lit("a")))


@query(
    "unique_paths",
    """WITH j AS (SELECT o_orderkey AS o, c_custkey AS c, n_nationkey AS n, n_regionkey AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
    SELECT 'r' || r AS source, 'o' || o AS target, CASE WHEN o % 7 = 0 THEN 2 ELSE 1 END AS n_paths,
      CASE WHEN o % 7 <> 0 THEN 'r' || r || '>n' || n || '>c' || c || '>o' || o END AS path FROM j
    UNION ALL SELECT 'c' || c, 'r' || r, 0, NULL FROM j WHERE o % 10 = 0 GROUP BY ALL""",
)
def unique_paths(t: Tables) -> DataFrame:
    places = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    region = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    o = t.orders.join(places, F.col("o_custkey") == F.col("c_custkey"))
    down = o.select(region.alias("source"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("target"))
    up = o.where("o_orderkey % 10 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("source"), region.alias("target"))
    found = graph.unique_paths(nation_graph(t), down.unionByName(up.distinct()), ["a", "b"])
    return found.select("source", "target", "n_paths", F.array_join("path", ">").alias("path"))


@query(
    "lineage_closure",
    """WITH j AS (SELECT o_orderkey AS o, c_custkey AS c, n_nationkey AS n, n_regionkey AS r FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey)
    SELECT 'r' || r AS seed, 'n' || n AS node, 1 AS depth, 'holds' AS relations FROM j GROUP BY ALL
    UNION ALL SELECT 'r' || r, 'c' || c, 2, 'holds/serves' FROM j WHERE c IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'r' || r, 'o' || o, 3, 'holds/serves/placed' FROM j WHERE o IS NOT NULL GROUP BY ALL""",
)
def lineage_closure(t: Tables) -> DataFrame:
    seeds = t.region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("seed"))
    return graph.lineage_closure(nation_graph(t).select("source", "relation", "target"), seeds)


@query(
    "leakage_texts",
    """SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(nfc_normalize(d.text), nfc_normalize(b.text))""",
)
def leakage_texts(t: Tables) -> DataFrame:
    return leakage.contained_texts(t.documents.select("doc_id", "text"), t.benchmark.select("item_id", "text"))


@query(
    "leakage_scan",
    """WITH m AS (SELECT item_id, string_split(text, ' ')[3] || ' ' || string_split(text, ' ')[4] AS text FROM benchmark),
    x AS (SELECT DISTINCT sha256(text) AS digest FROM conversations UNION SELECT sha256(text) FROM documents WHERE doc_id % 97 = 0)
    SELECT DISTINCT doc_id, 'text' AS reason FROM documents d JOIN benchmark b ON contains(d.text, b.text)
    UNION SELECT DISTINCT doc_id, 'marker' FROM documents d JOIN m ON contains(d.text, m.text)
    UNION SELECT doc_id, 'digest' FROM documents WHERE sha256(text) IN (SELECT digest FROM x)
    UNION SELECT doc_id, 'path' FROM documents WHERE source IN ('src3', 'src11')""",
)
def leakage_scan(t: Tables) -> DataFrame:
    word = F.split("text", " ")
    markers = t.benchmark.select("item_id", F.concat_ws(" ", F.get(word, F.lit(2)), F.get(word, F.lit(3))).alias("text"))
    digests = t.conversations.select("text").unionByName(t.documents.where("doc_id % 97 = 0").select("text"))
    paths = t.documents.where("source IN ('src3', 'src11')").select(F.col("source").alias("path")).distinct()
    return leakage.leakage_scan(
        t.documents.select("doc_id", "text", F.col("source").alias("path")),
        t.benchmark.select("item_id", "text"),
        markers=markers,
        forbidden_digests=digests.select(ids.sha256_digest(F.col("text")).alias("digest")),
        forbidden_paths=paths,
    )


@query(
    "leakage_payloads",
    """WITH m AS (SELECT item_id, string_split(text, ' ')[3] || ' ' || string_split(text, ' ')[4] AS text FROM benchmark)
    SELECT DISTINCT doc_id, 'text' AS reason FROM documents d JOIN benchmark b ON contains(nfc_normalize(d.text), nfc_normalize(b.text))
    UNION SELECT DISTINCT doc_id, 'marker' FROM documents d JOIN m ON contains(nfc_normalize(d.text), nfc_normalize(m.text))
    UNION SELECT doc_id, 'digest' FROM documents WHERE doc_id % 6 = 5 AND text IN (SELECT text FROM documents WHERE doc_id % 30 = 5)""",
)
def leakage_payloads(t: Tables) -> DataFrame:
    """The documents as bytes: UTF-16 of both orders, with and without a mark, after an odd byte, and UTF-8."""
    n, text = F.col("doc_id") % 6, F.col("text")
    little, big, narrow = F.encode(text, "UTF-16LE"), F.encode(text, "UTF-16BE"), F.encode(text, "UTF-8")
    payload = (
        F.when(n == 0, F.concat(F.lit(b"\xff\xfe"), little)).when(n == 1, big).when(n == 2, F.concat(F.lit(b"\xef\xbb\xbf"), narrow))
        .when(n == 3, F.concat(F.lit(b"\x00\xff\x01"), little)).when(n == 4, F.concat(F.lit(b"\xfe\xff"), big)).otherwise(narrow)
    )
    documents = t.documents.select("doc_id", payload.alias("payload"))
    word = F.split("text", " ")
    markers = t.benchmark.select("item_id", F.concat_ws(" ", F.get(word, F.lit(2)), F.get(word, F.lit(3))).alias("text"))
    known = documents.where("doc_id % 30 = 5").select(ids.sha256_digest(F.col("payload")).alias("digest"))
    return leakage.leakage_scan(documents, t.benchmark.select("item_id", "text"), payload="payload", markers=markers, forbidden_digests=known)


@query(
    "latest_per_id",
    """SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus,
    epoch_us(max(o_orderdate)) AS at FROM orders GROUP BY o_custkey""",
)
def latest_per_id(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"))
    return ordering.latest_per_id(rows, ["o_custkey"], ["at", "o_orderkey"])


@query(
    "merge_by_id",
    """WITH u AS (SELECT o_custkey, o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS part FROM orders)
    SELECT o_custkey, max_by(o_orderstatus, (part, o_orderkey)) AS o_orderstatus, max_by(o_orderkey, (part, o_orderkey)) AS o_orderkey,
      min(part) AS first_part, min_by(o_orderkey, (part, o_orderkey)) AS first_order FROM u GROUP BY ALL""",
)
def merge_by_id(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus")
    return ordering.merge_by_id(
        rows.where("o_orderkey % 3 <> 0"), rows.where("o_orderkey % 3 = 0"), ["o_custkey"], "o_orderkey"
    )


@query(
    "monotone_check",
    """WITH l AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id // 3, value) AS p FROM events)
    SELECT user_id, count(*) AS n_rows, count(*) FILTER (WHERE value < p) AS decreases, bool_and(coalesce(value >= p, true)) AS monotone FROM l GROUP BY ALL""",
)
def monotone_check(t: Tables) -> DataFrame:
    placed = t.events.select("user_id", F.expr("event_id div 3").alias("place"), "value")  # positions shared by several rows
    return ordering.monotone_check(placed, ["user_id"], "place", "value")


@query(
    "segment_clock",
    """WITH g AS (SELECT user_id, epoch_us(ts) AS t, event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w, 0) AS gap,
      coalesce(lag(event_type) OVER w = 'error', false) AS paused FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, CASE WHEN paused THEN 0 ELSE gap END AS act, sum(CASE WHEN paused THEN 0 ELSE gap END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS spent FROM g),
    k AS (SELECT *, spent - act < 1500000000000 AS open FROM s)
    SELECT user_id, count(*) AS events, CAST(sum(CASE WHEN open THEN act ELSE 0 END) AS BIGINT) / 1e6 AS active_seconds,
      CAST(sum(CASE WHEN open AND paused THEN gap ELSE 0 END) AS BIGINT) / 1e6 AS paused_seconds,
      min(CASE WHEN spent >= 1500000000000 THEN t END) AS exhausted_micros, max(spent) >= 1500000000000 AS exhausted FROM k GROUP BY ALL""",
)
def segment_clock(t: Tables) -> DataFrame:
    return ordering.segment_clock(
        t.events, "user_id", "ts", "event_id", "event_type", paused_state="error", hard_seconds=1_500_000.0
    )


@query(
    "ledger_links",
    """WITH s AS (SELECT o_custkey AS ledger, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq, o_orderkey AS k FROM orders),
    n AS (SELECT ledger, seq, CASE WHEN k % 29 = 0 THEN 'run' ELSE 'run' || seq END AS run,
      CASE WHEN k % 31 = 0 THEN 'lost' ELSE 'run' || (seq - 1) END AS parent FROM s),
    f AS (SELECT ledger, run, min(seq) AS first, count(*) AS c FROM n GROUP BY ALL),
    j AS (SELECT n.*, f.c, p.first AS pf FROM n JOIN f USING (ledger, run) LEFT JOIN f p ON p.ledger = n.ledger AND p.run = n.parent)
    SELECT ledger, seq, run, parent, CASE WHEN c > 1 THEN 'repeated_run' ELSE 'unlinked_parent' END AS fault FROM j
    WHERE c > 1 OR (seq > 1 AND coalesce(pf >= seq, true))""",
)
def ledger_links(t: Tables) -> DataFrame:
    keyed = t.orders.select(F.col("o_custkey").alias("ledger"), F.col("o_orderkey").alias("k"))
    blocked, blocks = with_blocks(keyed, "k", 2_000_000)
    rows = running(blocked, blocks, ["ledger"], [F.col("k")], F.lit(1).cast("long"), "sum", "seq")
    run = F.when(F.col("k") % 29 == 0, F.lit("run")).otherwise(F.concat(F.lit("run"), F.col("seq").cast("string")))
    parent = F.when(F.col("k") % 31 == 0, F.lit("lost")).otherwise(F.concat(F.lit("run"), (F.col("seq") - 1).cast("string")))
    segments = rows.select("ledger", "seq", run.alias("run"), parent.alias("parent"))
    return ordering.ledger_links(segments, "ledger", "seq", "run", "parent")


@query(
    "canonical_digest",
    """WITH leaf AS (SELECT o_custkey % 50 AS site, CAST('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 3) AS INT) AS b,
      sha256(o_orderkey || '|{"o_orderstatus":"' || o_orderstatus || '","o_custkey":' || o_custkey || '}') AS d FROM orders),
    bk AS (SELECT site, b, count(*) AS n, concat_ws(':', sum(CAST('0x' || substr(d, 1, 15) AS BIGINT)), sum(CAST('0x' || substr(d, 16, 15) AS BIGINT)),
      sum(CAST('0x' || substr(d, 31, 15) AS BIGINT)), sum(CAST('0x' || substr(d, 46, 15) AS BIGINT))) AS x FROM leaf GROUP BY ALL)
    SELECT site, CAST(sum(n) AS BIGINT) AS records, 'sha256:' || sha256(string_agg(x, '|' ORDER BY b)) AS digest FROM bk GROUP BY site""",
)
def canonical_digest(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("site", F.col("o_custkey") % 50)
    return ordering.canonical_digest(rows, ["site"], "o_orderkey", ["o_orderstatus", "o_custkey"])


@query(
    "priority_order",
    """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'analysis_source' WHEN page_id % 5 = 1 THEN 'data_or_result' WHEN page_id % 5 = 2 THEN 'report_candidate' ELSE 'other' END AS role,
    CASE WHEN page_id % 5 IN (0, 2) THEN 0 WHEN page_id % 5 = 1 THEN 3 WHEN page_id % 5 = 3 THEN 1 ELSE 2 END AS priority FROM pages""",
)
def priority_order(t: Tables) -> DataFrame:
    k = F.col("page_id") % 5
    stem = F.col("page_id").cast("string")
    path = (
        F.when(k == 0, F.concat(F.lit("src/"), stem, F.lit(".R")))
        .when(k == 1, F.concat(F.lit("data/"), stem, F.lit(".tsv")))
        .when(k == 2, F.concat(F.lit("out/Report-"), stem, F.lit(".html")))
        .when(k == 3, F.concat(stem, F.lit(".sha256")))
        .otherwise(F.concat(F.lit("misc/"), stem))
    )
    files = t.pages.select("page_id", path.alias("path"), (k == 4).alias("material"), (F.col("page_id") % 2 == 0).alias("preferred"))
    return ordering.priority_order(files, "path", "material", "preferred").select("page_id", "role", "priority")
