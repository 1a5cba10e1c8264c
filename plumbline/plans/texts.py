"""Queries over text: spans, claims, stated quantities, declarations and grades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import ids, text, values
from plumbline.operators import reconcile
from plumbline.plans.registry import Tables, query
from plumbline.skew import spread


@query(
    "document_spans",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n
      FROM documents),
    s AS (SELECT doc_id, n, line, regexp_replace(line, '^\s+', '') AS ls, regexp_replace(line, '\s+$', '') AS rs,
      regexp_replace(regexp_replace(line, '^\s+', ''), '\s+$', '') AS t FROM l)
    SELECT doc_id, CAST(n AS BIGINT) AS line, CAST(length(line) - length(ls) + 1 AS BIGINT) AS start_column,
      CAST(length(rs) + 1 AS BIGINT) AS end_column, t AS text FROM s WHERE t <> '' AND NOT starts_with(t, '#')""",
)
def document_spans(t: Tables) -> DataFrame:
    return text.document_spans(t.documents.select("doc_id", "text"), "text").select(
        "doc_id",
        F.col("line").cast("long").alias("line"),
        F.col("start_column").cast("long").alias("start_column"),
        F.col("end_column").cast("long").alias("end_column"),
        "text",
    )


@query(
    "text_identity",
    r"""SELECT doc_id, 'sha256:' || sha256(text) AS digest,
    'doc:' || substr(sha256(CAST(doc_id AS VARCHAR) || chr(31) || lang || chr(31) || source), 1, 20) AS stable_id,
    sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS key_digest,
    length(replace(text, chr(10), '')) AS flat_length FROM documents""",
)
def text_identity(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id",
        ids.sha256_digest(F.col("text")).alias("digest"),
        ids.stable_id("doc", F.col("doc_id"), F.col("lang"), F.col("source")).alias("stable_id"),
        F.sha2(text.text_key(F.col("text")), 256).alias("key_digest"),
        F.length(F.replace(text.normalize_newlines(F.col("text")), F.lit("\n"), F.lit(""))).cast("long").alias("flat_length"),
    )


@query(
    "normalized_text_digest",
    r"""SELECT doc_id, sha256(nfc_normalize(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)))) AS digest
    FROM documents""",
)
def normalized_text_digest(t: Tables) -> DataFrame:
    return spread(t.documents).select("doc_id", F.sha2(text.normalize_text(F.col("text")), 256).alias("digest"))


@query(
    "set_digest",
    """WITH h AS (SELECT lang, sha256(text) AS d FROM documents)
    SELECT lang, 'sha256:' || sha256(concat_ws(':', count(*), sum(CAST('0x' || substr(d, 1, 15) AS BIGINT)),
      sum(CAST('0x' || substr(d, 16, 15) AS BIGINT)), sum(CAST('0x' || substr(d, 31, 15) AS BIGINT)),
      sum(CAST('0x' || substr(d, 46, 15) AS BIGINT)))) AS digest FROM h GROUP BY lang""",
)
def set_digest(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(ids.set_digest(F.col("text")).alias("digest"))


def reports(t: Tables) -> DataFrame:
    """One report per customer, stating counts taken from its orders."""
    n = t.orders.groupBy("o_custkey").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("o_orderstatus") != "P").alias("m"),
        F.count_if((F.col("o_orderstatus") == "F")).alias("e"),
        F.count_if(F.col("o_orderstatus") == "O").alias("o"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"),
    )
    base = F.when(F.col("o_custkey") % 2 == 0, F.col("m")).otherwise(F.col("n"))
    # Integer arithmetic, so that the stated digits do not depend on float rounding.
    permille = F.expr("cast((2000 * e + b) div (2 * b) as string)")
    stated = n.withColumn("b", F.greatest(base, F.lit(1))).withColumn("p", F.lpad(permille, 4, "0"))
    return stated.select(
        F.col("o_custkey").alias("doc_id"),
        "n", "m", "e", "o", "u",
        F.expr("(2000 * e + b) div (2 * b)").alias("permille"),
        F.concat(
            F.lit("# Report on 08/07/2026\nWe planned "), F.col("n"), F.lit(" orders; "), F.col("m"), F.lit(" were kept and "),
            F.col("n") - F.col("m"), F.lit(" dropped, in group-3 over 12 kg and 1.5 km.\nOf these "), F.col("e"),
            F.lit(" were final, a share of "), F.substring("p", 1, 1), F.lit("."), F.substring("p", 2, 3), F.lit(".\n"),
        ).alias("text"),
    )


REPORTS = """c AS (SELECT o_custkey AS doc_id, count(*) AS n, count(*) FILTER (WHERE o_orderstatus <> 'P') AS m,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS e, count(*) FILTER (WHERE o_orderstatus = 'O') AS o,
  count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS u FROM orders GROUP BY ALL),
r AS (SELECT *, greatest(CASE WHEN doc_id % 2 = 0 THEN m ELSE n END, 1) AS b FROM c),
p AS (SELECT *, (2000*e + b) // (2*b) AS permille FROM r),
w AS (SELECT doc_id, v, count(*) AS n FROM (SELECT doc_id, unnest([n, m, n - m, e]) AS v FROM p) GROUP BY ALL),
one AS (SELECT doc_id, v, n FROM w WHERE v >= 1)"""

NEED = (
    "{a}.n >= 1 + ({a}.v = {b}.v)::INT + ({a}.v = {c}.v)::INT + ({a}.v = {d}.v)::INT"
)
OWN = " AND ".join(
    NEED.format(a=a, b=b, c=c, d=d)
    for a, b, c, d in (("x", "y", "z", "k"), ("y", "x", "z", "k"), ("z", "x", "y", "k"), ("k", "x", "y", "z"))
)


@query(
    "quantity_reconcile",
    f"""WITH {REPORTS},
    q AS (SELECT x.doc_id, x.v AS complete, y.v AS retained, z.v AS removed, k.v AS events, p.permille / 1000.0 AS rate
      FROM one x JOIN one y USING (doc_id) JOIN one z USING (doc_id) JOIN one k USING (doc_id) JOIN p USING (doc_id)
      WHERE y.v + z.v = x.v AND k.v <= y.v AND {OWN} AND p.permille > 0),
    f AS (SELECT *, abs(rate - events / retained) <= 0.0005 + 1e-12 AS sub, abs(rate - events / complete) <= 0.0005 + 1e-12 AS whole FROM q),
    g AS (SELECT doc_id, count(*) AS readings, count(DISTINCT sub) AS ops, count(DISTINCT (complete, retained, removed, events)) AS acc,
      min(complete) AS complete, min(retained) AS retained, min(removed) AS removed, min(events) AS events,
      min(CASE WHEN sub THEN 'retained' ELSE 'complete' END) AS denominator FROM f WHERE sub <> whole GROUP BY ALL),
    j AS (SELECT p.doc_id, coalesce(readings, 0) AS readings, CASE WHEN readings IS NULL THEN 'not_applicable'
      WHEN ops = 1 AND acc = 1 THEN 'applicable' ELSE 'ambiguous' END AS applicability,
      complete, retained, removed, events, denominator FROM p LEFT JOIN g USING (doc_id))
    SELECT doc_id, applicability, readings, CASE WHEN applicability = 'applicable' THEN complete END AS complete,
      CASE WHEN applicability = 'applicable' THEN retained END AS retained,
      CASE WHEN applicability = 'applicable' THEN removed END AS removed,
      CASE WHEN applicability = 'applicable' THEN events END AS events,
      CASE WHEN applicability = 'applicable' THEN denominator END AS denominator FROM j""",
)
def quantity_reconcile(t: Tables) -> DataFrame:
    return reconcile.quantity_reconcile(reports(t), "doc_id", "text")


@query(
    "accounting_present",
    f"""WITH {REPORTS},
    q AS (SELECT DISTINCT x.doc_id FROM one x JOIN one y USING (doc_id) JOIN one z USING (doc_id) JOIN one k USING (doc_id)
      WHERE y.v + z.v = x.v AND k.v <= y.v AND {OWN})
    SELECT p.doc_id, q.doc_id IS NOT NULL AS accounting_present FROM p LEFT JOIN q USING (doc_id)""",
)
def accounting_present(t: Tables) -> DataFrame:
    return reconcile.accounting_present(reconcile.stated_numbers(reports(t), "doc_id", "text"), "doc_id")


@query(
    "corroboration",
    f"""WITH {REPORTS},
    need AS (SELECT doc_id % 40 AS project, doc_id, v, n FROM w),
    wanted AS (SELECT doc_id, count(*) AS k FROM need GROUP BY ALL),
    met AS (SELECT a.doc_id, b.doc_id AS other, count(*) AS met FROM need a JOIN need b
      ON a.project = b.project AND a.v = b.v AND a.doc_id <> b.doc_id AND b.n >= a.n GROUP BY ALL),
    agreed AS (SELECT doc_id, count(*) AS c FROM met JOIN wanted USING (doc_id) WHERE met = k GROUP BY ALL)
    SELECT p.doc_id % 40 AS project, p.doc_id, coalesce(c, 0) AS corroborating FROM p LEFT JOIN agreed USING (doc_id)""",
)
def corroboration(t: Tables) -> DataFrame:
    docs = reports(t)
    readings = docs.select(
        (F.col("doc_id") % 40).alias("project"), "doc_id", F.col("n").alias("complete"), F.col("m").alias("retained"),
        (F.col("n") - F.col("m")).alias("removed"), F.col("e").alias("events"),
    )
    numbers = reconcile.stated_numbers(docs, "doc_id", "text").withColumn("project", F.col("doc_id") % 40)
    return reconcile.corroboration(readings, numbers, "doc_id", "project").select("project", "doc_id", "corroborating")


@query(
    "state_table_reconcile",
    f"""WITH {REPORTS}, d AS (SELECT doc_id, m - e AS c0, e AS c1, n - m AS c2, n AS total,
        (2000 * (e + 2*(n - m)) + n) // (2*n) AS permille FROM p),
    a AS (SELECT doc_id, v, count(*) AS n FROM (SELECT doc_id, unnest([c0, c1, c2, total]) AS v FROM d) GROUP BY ALL),
    q AS (SELECT x.doc_id, y.v AS c0, z.v AS c1, k.v AS c2, x.v AS total, d.permille / 1000.0 AS mean
      FROM a x JOIN a y USING (doc_id) JOIN a z USING (doc_id) JOIN a k USING (doc_id) JOIN d USING (doc_id)
      WHERE x.v >= 3 AND y.v + z.v + k.v = x.v AND (y.v > 0)::INT + (z.v > 0)::INT + (k.v > 0)::INT >= 2 AND {OWN}),
    f AS (SELECT * FROM q WHERE abs(mean - (c1 + 2*c2) / total) <= 0.0005 + 1e-12),
    g AS (SELECT doc_id, count(*) AS tables, min(c0) AS c0, min(c1) AS c1, min(c2) AS c2, min(total) AS total FROM f GROUP BY ALL)
    SELECT p.doc_id, coalesce(tables, 0) AS tables, CASE WHEN tables IS NULL THEN 'not_applicable'
      WHEN tables = 1 THEN 'applicable' ELSE 'ambiguous' END AS applicability,
      CASE WHEN tables = 1 THEN c0 END AS c0, CASE WHEN tables = 1 THEN c1 END AS c1, CASE WHEN tables = 1 THEN c2 END AS c2,
      CASE WHEN tables = 1 THEN total END AS total FROM p LEFT JOIN g USING (doc_id)""",
)
def state_table_reconcile(t: Tables) -> DataFrame:
    d = reports(t).select(
        "doc_id", (F.col("m") - F.col("e")).alias("c0"), F.col("e").alias("c1"), (F.col("n") - F.col("m")).alias("c2"), "n"
    )
    permille = F.lpad(F.expr("cast((2000 * (c1 + 2 * c2) + n) div (2 * n) as string)"), 4, "0")
    docs = d.select(
        "doc_id",
        F.concat(
            F.lit("States: "), "c0", F.lit(" / "), "c1", F.lit(" / "), "c2", F.lit(" of "), "n", F.lit(" with mean "),
            F.substring(permille, 1, 1), F.lit("."), F.substring(permille, 2, 3), F.lit("."),
        ).alias("text"),
    )
    return reconcile.state_table_reconcile(docs, "doc_id", "text").drop("mean_text", "sd_text")


@query(
    "orientation_reconcile",
    f"""WITH {REPORTS}, d AS (SELECT doc_id, n AS t, e AS a, (200 * (CASE WHEN doc_id % 2 = 0 THEN e ELSE n - e END) + n) // (2*n) AS pct FROM p),
    v AS (SELECT DISTINCT doc_id, unnest([t, a]) AS v FROM d),
    q AS (SELECT x.doc_id, x.v AS t, y.v AS a, pct / 100.0 AS rate FROM v x JOIN v y USING (doc_id) JOIN d USING (doc_id)
      WHERE y.v >= 1 AND y.v < x.v AND pct > 0),
    f AS (SELECT *, abs(rate - a / t) <= 0.005 + 1e-12 AS dir, abs(rate - (t - a) / t) <= 0.005 + 1e-12 AS com FROM q),
    g AS (SELECT doc_id, count(DISTINCT (t, a)) AS pairs, count(DISTINCT dir) AS ways, min(t) AS t, min(a) AS a,
      min(CASE WHEN dir THEN 'direct' ELSE 'complement' END) AS o FROM f WHERE dir <> com GROUP BY ALL)
    SELECT d.doc_id, coalesce(pairs, 0) AS pairs, CASE WHEN pairs IS NULL THEN 'not_applicable'
      WHEN pairs = 1 AND ways = 1 THEN 'applicable' ELSE 'ambiguous' END AS applicability,
      CASE WHEN pairs = 1 AND ways = 1 THEN g.t END AS markers, CASE WHEN pairs = 1 AND ways = 1 THEN g.a END AS agreements,
      CASE WHEN pairs = 1 AND ways = 1 THEN o END AS orientation FROM d LEFT JOIN g USING (doc_id)""",
)
def orientation_reconcile(t: Tables) -> DataFrame:
    share = F.expr("(200 * (case when doc_id % 2 = 0 then e else n - e end) + n) div (2 * n)")
    docs = reports(t).select(
        "doc_id", F.concat(F.lit("Of "), "n", F.lit(" markers "), "e", F.lit(" agree ("), share, F.lit(" %).")).alias("text")
    )
    return reconcile.orientation_reconcile(docs, "doc_id", "text")


@query(
    "denominator_check",
    f"""WITH {REPORTS}, s AS (SELECT doc_id, n, m, e, permille / 1000.0 AS rate FROM p),
    f AS (SELECT *, n > 0 AND m > 0 AND abs(rate - e / n) <= 0.0005 + 1e-12 AS pl, n > 0 AND m > 0 AND abs(rate - e / m) <= 0.0005 + 1e-12 AS re FROM s),
    u AS (SELECT *, CASE WHEN n = 0 OR m = 0 THEN 'neither' WHEN pl AND re THEN 'either' WHEN pl THEN 'planned'
      WHEN re THEN 'retained' ELSE 'neither' END AS used FROM f)
    SELECT doc_id, n AS planned, m AS retained, e AS events, used,
      CASE WHEN used IN ('planned', 'retained') THEN 'applicable' ELSE 'not_applicable' END AS applicability,
      CASE WHEN used = 'planned' THEN 'conformant' WHEN used = 'retained' THEN 'nonconformant' ELSE 'not_applicable' END AS comparison_outcome
    FROM u""",
)
def denominator_check(t: Tables) -> DataFrame:
    docs = reports(t)
    counts = docs.select("doc_id", F.col("n").alias("planned"), F.col("m").alias("retained"), F.col("e").alias("events"))
    said = docs.select(
        "doc_id", (F.col("permille") / 1000.0).alias("rate"), F.lit(3).alias("decimals"), F.lit("planned").alias("claims")
    )
    # A count of zero retained rows has no ratio; the guard keeps the division away from it.
    safe = counts.withColumn("retained", F.nullif("retained", F.lit(0)))
    return reconcile.denominator_check(safe, "doc_id", said).withColumn("retained", F.coalesce("retained", F.lit(0)))


@query(
    "number_tokens",
    f"""WITH {REPORTS}, tok AS (SELECT doc_id, unnest([n, m, n - m, e]) AS v FROM p)
    SELECT doc_id, CAST(v AS VARCHAR) AS raw, true AS is_integer, CAST(0 AS INTEGER) AS decimals FROM tok
    UNION ALL SELECT doc_id, printf('%d.%03d', permille // 1000, permille % 1000), false, 3 FROM p""",
)
def number_tokens(t: Tables) -> DataFrame:
    return reports(t).select("doc_id", F.inline(text.number_tokens(F.col("text")))).select(
        "doc_id", "raw", "is_integer", "decimals"
    )


def claim_lines(t: Tables) -> DataFrame:
    line = F.concat(
        F.initcap(F.element_at(F.split("p_name", " "), 1)), F.lit(" "),
        F.when(F.col("p_size") % 2 == 0, F.lit("increased")).otherwise(F.lit("decreased")), F.lit(" "),
        F.lower("p_type"), F.lit(" price relative to "), F.element_at(F.split("p_name", " "), -1),
        F.when(F.col("p_partkey") % 3 == 0, F.lit(".")).otherwise(F.lit("")),
    )
    quoted = F.when(F.col("p_partkey") % 10 == 7, F.concat(F.lit("Perhaps not: "), line)).otherwise(line)
    return t.part.select("p_partkey", F.concat(F.lit("# Claims\n\n  "), quoted, F.lit("  \n")).alias("text"))


CLAIMS = """claims AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', -1) AS z,
  lower(p_type) || ' price' AS object, CASE WHEN p_size % 2 = 0 THEN 'positive' ELSE 'negative' END AS direction
  FROM part WHERE p_partkey % 10 <> 7)"""


@query(
    "directional_claims",
    f"""WITH {CLAIMS} SELECT p_partkey, 3 AS line, upper(a[1]) || lower(a[2:]) AS subject, object,
    upper(a[1]) || lower(a[2:]) || ' versus ' || z AS comparison, direction FROM claims""",
)
def directional_claims(t: Tables) -> DataFrame:
    return text.directional_claims(text.document_spans(claim_lines(t), "text")).select(
        "p_partkey", "line", "subject", "object", "comparison", "direction"
    )


@query(
    "quantitative_claims",
    """SELECT s_suppkey, CAST(s_nationkey + 1 AS BIGINT) * 1000 AS resolution_bp, 'case' AS left_label, 'control' AS right_label,
    'strength' AS measure, CAST(s_suppkey AS VARCHAR) || '.5' AS left_value, CAST(s_nationkey AS VARCHAR) AS right_value,
    s_suppkey + 0.5 - s_nationkey = s_suppkey - s_nationkey + 0.5 AS difference_agrees
    FROM supplier WHERE s_suppkey % 4 <> 1""",
)
def quantitative_claims(t: Tables) -> DataFrame:
    label = F.when(F.col("s_suppkey") % 4 == 1, F.lit("control-minus-case")).otherwise(F.lit("case-minus-control"))
    difference = F.col("s_suppkey") - F.col("s_nationkey") + F.lit(0.5)
    docs = t.supplier.select(
        "s_suppkey",
        F.concat(
            F.lit("At the queried "), F.col("s_nationkey") + 1, F.lit(" kb pixel, the mean case strength is **"), "s_suppkey",
            F.lit(".5**, the mean control strength is **"), "s_nationkey", F.lit("**, and the "), label,
            F.lit(" difference is **"), F.format_string("%.1f", difference), F.lit("** log2 units."),
        ).alias("text"),
    )
    claims = text.quantitative_claims(text.document_spans(docs, "text"))
    agrees = F.col("estimate").cast("double") == F.col("left_value").cast("double") - F.col("right_value").cast("double")
    return claims.select(
        "s_suppkey", "resolution_bp", "left_label", "right_label", "measure", "left_value", "right_value",
        agrees.alias("difference_agrees"),
    )


@query(
    "sensitivity_claims",
    """SELECT s_suppkey, 'unfiltered_leave_one_out_mean' AS alternative, CAST(s_suppkey AS VARCHAR) AS case_value,
    CAST(s_nationkey AS VARCHAR) AS control_value, CAST(s_suppkey - s_nationkey AS VARCHAR) AS delta
    FROM supplier WHERE s_suppkey % 3 <> 0
    UNION ALL SELECT s_suppkey, 'quality_filtered_robust_median', CAST(s_suppkey AS VARCHAR),
    CAST(s_nationkey AS VARCHAR), CAST(s_suppkey - s_nationkey AS VARCHAR) FROM supplier WHERE s_suppkey % 2 = 0""",
)
def sensitivity_claims(t: Tables) -> DataFrame:
    triple = F.concat(
        F.lit("gives case="), "s_suppkey", F.lit(", control="), "s_nationkey", F.lit(", and delta="),
        F.col("s_suppkey") - F.col("s_nationkey"), F.lit("."),
    )
    one = F.concat(F.lit("An unfiltered leave-one-out mean "), triple)
    two = F.concat(F.lit("A robust median on the quality-filtered background "), triple)
    docs = t.supplier.select(
        "s_suppkey",
        F.concat_ws(
            "\n", one, F.when(F.col("s_suppkey") % 3 == 0, one), F.when(F.col("s_suppkey") % 2 == 0, two)
        ).alias("text"),
    )
    return text.sensitivity_claims(text.document_spans(docs, "text"), "s_suppkey")


@query(
    "multiplicity_declaration",
    """SELECT c_custkey, CASE WHEN k < 2 OR k IN (4) THEN 'ambiguous' WHEN k = 2 THEN 'not_applicable'
      WHEN k = 3 THEN 'ambiguous' ELSE 'applicable' END AS applicability,
    CASE WHEN k > 4 THEN '0.' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END AS alpha,
    CASE WHEN k > 4 THEN 't' || c_custkey || '.csv' END AS table_path FROM (SELECT *, c_custkey % 9 AS k FROM customer) WHERE k <> 8""",
)
def multiplicity_declaration(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 9
    whole = F.concat(
        F.lit("Multiplicity contract: Benjamini-Hochberg false-discovery-rate control at alpha 0."),
        F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit(" over the complete tested family in `t"), "c_custkey",
        F.lit(".csv`. Raw p-values are in `p`, reported adjusted p-values are in `q`, and final discovery calls are in `call`."),
    )
    primary = F.lit(
        "There is one preregistered primary hypothesis and no multiple-testing adjustment governs this decision."
    )
    partial = F.lit("Here only selected hits are kept; the complete set of tested hypotheses is unavailable.")
    body = (
        F.when(k == 0, F.concat_ws("\n", whole, whole))
        .when(k == 1, F.concat_ws("\n", whole, primary))
        .when(k == 2, primary)
        .when(k == 3, partial)
        .when(k == 4, F.concat_ws("\n", whole, F.lit("Holm was tried as well.")))
        .when(k == 8, F.lit("Nothing is declared."))
        .otherwise(whole)
    )
    docs = t.customer.select("c_custkey", body.alias("text"))
    return text.multiplicity_declaration(docs, "text").select("c_custkey", "applicability", "alpha", "table_path")


@query(
    "json_grade",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 17 = 1 THEN 'malformed' WHEN event_id % 11 = 0 THEN 'missing'
      WHEN CAST(json_extract(props, '$.k') AS INT) % 3 = 0 AND event_id % 13 > 2 THEN 'match' ELSE 'mismatch' END AS grade FROM events""",
)
def json_grade(t: Tables) -> DataFrame:
    n = F.col("event_id")
    place = F.concat(F.lit('{"a/b": ['), F.col("props"), F.lit("]}"))
    props = (
        F.when(n % 7 == 0, F.concat(F.lit("{"), F.col("props")))
        .when(n % 17 == 1, F.concat(place, F.when(n % 2 == 0, F.lit(" true")).otherwise(F.lit("\n,"))))  # more than one value
        .when(n % 11 == 0, F.lit('{"other": 1}'))
        .when(n % 5 == 0, F.concat(F.lit('{"a\\u002fb": {"0": '), F.col("props"), F.lit("}}")))
        .when(n % 5 == 1, F.concat(F.lit('{"a/b": {"0": '), F.col("props"), F.lit("}}")))
        .otherwise(place)
    )
    k = F.get_json_object("props", "$.k").cast("int")
    # Values that equal the number and are spelt otherwise, or differ in the last of fifty digits, do not match.
    other = F.when(n % 13 == 0, F.concat(k, F.lit(".0"))).when(n % 13 == 1, F.concat(k, F.lit("e0"))).otherwise(F.concat(F.repeat(F.lit("9"), F.lit(49)), k))
    number = F.when(n % 13 > 2, k.cast("string")).otherwise(other)
    key = F.when(n % 2 == 0, F.lit('{ "k" : ')).otherwise(F.lit('{"\\u006B":'))
    want = F.when(k % 3 == 0, F.concat(key, number, F.lit("}"))).otherwise(F.lit('{"k": -1}'))
    rows = t.events.select("event_id", props.alias("actual"), want.alias("expected"))
    return values.json_grade(rows, "actual", "expected", "/a~1b/0").select("event_id", "grade")


@query(
    "canonical_json",
    r"""WITH c AS (SELECT event_id, CASE WHEN event_id % 15 IN (5, 13, 14) THEN NULL ELSE '{"a":' || CASE event_id % 15 WHEN 6 THEN '"' || chr(92) || 'u001f"'
        WHEN 7 THEN '"' || chr(92) || 'ud800' || event_type || '"' WHEN 8 THEN '"' || chr(92) || chr(92) || 'ud800"' WHEN 9 THEN '"/' || chr(233) || chr(128512) || '"'
        WHEN 10 THEN '"' || chr(92) || 'n' || chr(92) || '""' ELSE '"' || event_type || '"' END || ',"n":' || CASE event_id % 15 WHEN 1 THEN '1.0' WHEN 2 THEN '1e-07'
        WHEN 3 THEN repeat('1234567890', 5) || event_id WHEN 4 THEN '-0.0' WHEN 11 THEN '{"B":[],"' || chr(61440) || '":1,"' || chr(128512) || '":{}}'
        WHEN 12 THEN repeat('[', 300) || repeat(']', 300) ELSE '1' END || ',"z":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' END AS canonical FROM events)
      SELECT *, 'sha256:' || sha256(canonical) AS digest FROM c""",
)
def canonical_json(t: Tables) -> DataFrame:
    m = F.col("event_id") % 15
    number = (
        F.when(m == 1, F.lit("1.0")).when(m == 2, F.lit("0.0000001"))
        .when(m == 3, F.concat(F.repeat(F.lit("1234567890"), F.lit(5)), F.col("event_id")))
        .when(m == 4, F.lit("-0.0")).when(m == 5, F.lit('1, "n": 2'))  # repeats a key
        .when(m == 11, F.lit('{"\U0001f600": { }, "B":[\n], "\uf000" :1}'))
        .when(m == 12, F.lit("[" * 300 + "]" * 300)).otherwise(F.lit("1"))
    )
    word = (
        F.when(m == 6, F.lit('"\\u001F"')).when(m == 7, F.concat(F.lit('"\\uD800'), F.col("event_type"), F.lit('"')))
        .when(m == 8, F.lit('"\\\\ud800"')).when(m == 9, F.lit('"\\/\\u00E9\\uD83D\\uDE00"')).when(m == 10, F.lit('"\\u000a\\""'))
        .otherwise(F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))
    )
    rest = F.when(m == 13, F.lit("} x")).when(m == 14, F.lit("}\n{}")).otherwise(F.lit("}\t"))
    raw = F.concat(F.lit('{ "z" : '), F.get_json_object("props", "$.k"), F.lit(', "n":'), number, F.lit(', "a" : '), word, rest)
    return t.events.select("event_id", ids.canonical_json(raw).alias("canonical"), ids.semantic_digest(raw).alias("digest"))


@query(
    "path_roles",
    r"""WITH u AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages)
    SELECT page_id, NOT regexp_matches(path, '(^|/)(\.{0,2})(/|$)') AND NOT contains(path, '\') AND path <> '' AND trim(path) = path AS safe,
      'analysis_source' AS script_role, 'python' AS language FROM u""",
)
def path_roles(t: Tables) -> DataFrame:
    path = F.regexp_replace("url", "^https?://", "")
    script = F.concat(F.lit("src/p"), F.col("page_id").cast("string"), F.lit(".PY"))
    return t.pages.select(
        "page_id",
        values.safe_relative_path(path).alias("safe"),
        values.role_of(script).alias("script_role"),
        values.language_of(script).alias("language"),
    )


@query(
    "utc_timestamps",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE epoch_us(ts) - 7200000000 END AS micros FROM events""",
)
def utc_timestamps(t: Tables) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    said = F.when(F.col("event_id") % 5 == 0, stamp).otherwise(F.concat(stamp, F.lit("+02:00")))
    return t.events.select("event_id", F.unix_micros(values.utc_timestamp(said)).alias("micros"))


@query(
    "sequence_records",
    """SELECT c_custkey, c_custkey % 4 = 0 AS is_record FROM customer""",
)
def sequence_records(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 4
    residues = F.translate(F.substring(F.sha2(F.col("c_name"), 256), 1, 40), "0123456789", "ghiklmnpqr")
    body = (
        F.when(k == 0, F.concat_ws("\n", residues, F.lit("enzyme 7 (bovine)")))
        .when(k == 1, F.concat_ws("\n", residues, F.lit("ACDE")))
        .when(k == 2, residues)
        .otherwise(F.concat_ws("\n", F.substring(residues, 1, 10), F.lit("enzyme 7")))
    )
    return t.customer.select("c_custkey", text.sequence_record(body).alias("is_record"))


@query(
    "decimal_text",
    """SELECT o_orderkey, CASE WHEN k % 100 = 0 THEN CAST(k // 100 AS VARCHAR) WHEN k % 10 = 0
      THEN printf('%d.%d', k // 100, k % 100 // 10) ELSE printf('%d.%02d', k // 100, k % 100) END AS canonical
    FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS k FROM orders)""",
)
def decimal_text(t: Tables) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long").cast("decimal(18,0)") / 100
    return t.orders.select("o_orderkey", text.decimal_text(cents.cast("decimal(18,4)")).alias("canonical"))


@query(
    "line_numbers",
    """SELECT doc_id, CAST(length(left(text, n_chars // 2)) - length(replace(left(text, n_chars // 2), chr(10), '')) + 1 AS INTEGER) AS line
    FROM documents""",
)
def line_numbers(t: Tables) -> DataFrame:
    middle = F.floor(F.col("n_chars") / 2).cast("int")
    return t.documents.select("doc_id", text.line_number_at(F.col("text"), middle).alias("line"))
