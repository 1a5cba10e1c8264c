"""Joins that link or refuse: unique matches, integrity, tolerance, spans and scope."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import LINE_BREAK, text_key
from plumbline.session import cut_lineage
from plumbline.skew import attach


def unique_candidates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key occurs exactly once; nothing is picked among several."""
    values = [c for c in df.columns if c not in key]
    return (
        df.groupBy(*key)
        .agg(F.count("*").alias("_n"), F.any_value(F.struct(*values)).alias("_v"))
        .where("_n = 1")
        .select(*key, "_v.*")
    )


def key_totality(left: DataFrame, right: DataFrame, keys: Sequence[str], case: Sequence[str] = ()) -> DataFrame:
    """Per case: do both sides hold the same keys, each exactly once?"""
    keys, case = list(keys), list(case)

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*case, *keys).agg(F.count("*").alias(name))

    both = side(left, "_l").join(side(right, "_r"), [*case, *keys], "full_outer").na.fill(0, ["_l", "_r"])
    return both.groupBy(*case).agg(
        F.count("*").alias("keys"),
        F.count_if(F.col("_r") == 0).alias("left_only"),
        F.count_if(F.col("_l") == 0).alias("right_only"),
        F.count_if((F.col("_l") > 1) | (F.col("_r") > 1)).alias("repeated"),
        F.every((F.col("_l") == 1) & (F.col("_r") == 1)).alias("total"),
    )


def total_key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], case: Sequence[str]) -> DataFrame:
    """Inner join of the cases whose key join is proven one to one and total."""
    good = key_totality(left, right, keys, case).where("total").select(*case, "keys")
    kept = attach(left, good, case, "keys").where(F.col("keys").isNotNull()).drop("keys")
    return kept.join(right, [*case, *keys])


def link_claims(claims: DataFrame, results: DataFrame) -> DataFrame:
    """Link a claim to a result when exactly one result aligns with it.

    ``claims``: claim_id, object, comparison ('A versus B').  ``results``: result_id,
    left_group, right_group, outcome_column, comparison.  Adds ``candidates`` and, for exactly
    one, ``result_id``.
    """
    parts = F.split("comparison", " versus ")
    said = claims.withColumn(
        "_key",
        F.when(
            F.size(parts) == 2,
            F.struct(
                text_key(F.get(parts, F.lit(0))).alias("l"),
                text_key(F.get(parts, F.lit(1))).alias("r"),
                text_key(F.col("object")).alias("o"),
            ),
        ),
    )
    found = results.where(
        text_key(F.col("comparison")) == text_key(F.concat_ws(" versus ", "left_group", "right_group"))
    ).groupBy(
        F.struct(
            text_key(F.col("left_group")).alias("l"),
            text_key(F.col("right_group")).alias("r"),
            text_key(F.col("outcome_column")).alias("o"),
        ).alias("_key")
    ).agg(F.count("*").alias("candidates"), F.min("result_id").alias("_only"))
    # Claims about one comparison may be a large share of all.
    load = said.where("_key IS NOT NULL").groupBy("_key").agg(F.count("*").alias("_claims"))
    return (
        attach(said, found.join(load, "_key"), ["_key"], "_claims")
        .withColumn("candidates", F.coalesce("candidates", F.lit(0)))
        .withColumn("result_id", F.when(F.col("candidates") == 1, F.col("_only")))
        .drop("_key", "_only", "_claims")
    )


def conflicting_peers(claims: DataFrame) -> DataFrame:
    """Opposite-direction peers of each claim, counted per key instead of paired up.

    ``claims``: claim_id, subject, object, comparison, direction.
    """
    keyed = claims.withColumn(
        "_key",
        F.struct(*[text_key(F.col(c)).alias(c) for c in ("subject", "object", "comparison")]),
    )
    ways = keyed.groupBy("_key").agg(
        F.count("*").alias("_rows"),
        F.count_if(F.col("direction") == "positive").alias("_pos"),
        F.count_if(F.col("direction") == "negative").alias("_neg"),
    )
    opposite = F.when(F.col("direction") == "positive", F.col("_neg")).otherwise(F.col("_pos"))
    # A claim with no stated direction differs from every peer that has one.
    undirected = ~F.coalesce(F.col("direction").isin("positive", "negative"), F.lit(False))
    return (
        attach(keyed, ways, ["_key"], "_rows")
        .withColumn("opposite_peers", F.when(undirected, F.col("_pos") + F.col("_neg")).otherwise(opposite))
        .drop("_key", "_rows", "_pos", "_neg")
    )


def direction_check(linked: DataFrame, results: DataFrame) -> DataFrame:
    """Claimed direction against the sign of the linked value after orientation.

    ``linked``: claim_id, result_id, object, comparison, direction, opposite_peers.
    ``results``: result_id, value, orientation, scale.
    """
    value = F.when(F.col("orientation") == "control_minus_treated", -F.col("value")).otherwise(F.col("value"))
    sign = F.when(value > 0, F.lit("positive")).when(value < 0, F.lit("negative"))
    known = (
        F.col("result_id").isNotNull()
        & F.col("value").isNotNull()
        & ~F.isnan("value")
        & F.coalesce(F.col("orientation").isin("treated_minus_control", "control_minus_treated"), F.lit(False))
        & F.coalesce(text_key(F.col("scale")) == text_key(F.col("object")), F.lit(False))
    )
    return (
        linked.join(results.select("result_id", "value", "orientation", "scale"), "result_id", "left")
        .withColumn("recomputed_direction", F.when(known, sign))
        .withColumn(
            "agreement",
            F.when((F.col("opposite_peers") > 0) | ~known, F.lit("unresolved"))
            .when(F.col("direction").eqNullSafe(F.col("recomputed_direction")), F.lit("agree"))
            .otherwise(F.lit("conflict")),
        )
    )


def reference_violations(
    records: DataFrame, record_id: str, references: Mapping[str, tuple[DataFrame, str]]
) -> DataFrame:
    """Duplicate record ids and references that resolve to no record, as one table."""
    out = records.groupBy(F.col(record_id).cast("string").alias("record_id")).agg(F.count("*").alias("occurrences"))
    found = out.where("occurrences > 1").select(F.lit("duplicate_id").alias("violation"), "record_id", "occurrences")
    ids = records.select(F.col(record_id).cast("string").alias("record_id"))
    for name, (frame, column) in references.items():
        refs = frame.groupBy(F.col(column).cast("string").alias("record_id")).agg(F.count("*").alias("occurrences"))
        dangling = refs.join(ids, "record_id", "left_anti")
        found = found.unionByName(
            dangling.select(F.lit(f"dangling:{name}").alias("violation"), "record_id", "occurrences")
        )
    return found


def scope_classify(findings: DataFrame, subjects: DataFrame, scope_refs: DataFrame, scope_classes: DataFrame) -> DataFrame:
    """in_scope when the class is declared and a subject is a scope reference.

    ``findings``: case_id, finding_id, issue_class.  ``subjects``: case_id, finding_id, ref.
    ``scope_refs``: case_id, ref.  ``scope_classes``: case_id, issue_class.
    """
    hit = (
        subjects.join(scope_refs.distinct(), ["case_id", "ref"], "left_semi")
        .select("case_id", "finding_id")
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    declared = scope_classes.distinct().withColumn("_class", F.lit(True))
    scoped = scope_refs.select("case_id").distinct().withColumn("_scoped", F.lit(True))
    return (
        findings.join(hit, ["case_id", "finding_id"], "left")
        .join(declared, ["case_id", "issue_class"], "left")
        .join(scoped, "case_id", "left")
        .select(
            "case_id",
            "finding_id",
            "issue_class",
            F.when(F.col("_scoped").isNull(), F.lit("unresolved"))
            .when(F.col("_hit") & F.col("_class"), F.lit("in_scope"))
            .otherwise(F.lit("out_of_scope"))
            .alias("scope"),
        )
    )


SPAN_BUCKET = 64


def span_containment(inner: DataFrame, outer: DataFrame, bucket: int = SPAN_BUCKET) -> DataFrame:
    """Is each inner span inside some outer span of its path?

    Spans: path, start_line, end_line.  An outer span is filed under every block of lines it
    covers and an inner span under the block of its first line, so long paths are split over
    many tasks.  In each block only the farthest end per start matters, and of those only the
    running maximum.
    """
    covers = (
        outer.where(F.col("start_line").isNotNull() & F.col("end_line").isNotNull())
        .select(
            "path",
            F.explode(F.sequence(F.floor(F.col("start_line") / bucket), F.floor(F.col("end_line") / bucket))).alias("_b"),
            F.greatest(F.pmod(F.col("start_line"), F.lit(bucket)), F.lit(0)).alias("_s"),
            F.col("start_line"),
            F.col("end_line").alias("_end"),
        )
        .select(
            "path",
            "_b",
            F.when(F.floor(F.col("start_line") / bucket) == F.col("_b"), F.col("_s")).otherwise(0).alias("_s"),
            "_end",
        )
        .groupBy("path", "_b", "_s")
        .agg(F.max("_end").alias("_end"))
        .groupBy("path", "_b")
        .agg(F.collect_list(F.struct("_s", "_end")).alias("_covers"))
    )
    reach = F.array_max(
        F.transform(
            F.filter("_covers", lambda c: c["_s"] <= F.pmod(F.col("start_line"), F.lit(bucket))), lambda c: c["_end"]
        )
    )
    return (
        inner.withColumn("_b", F.floor(F.col("start_line") / bucket))
        .join(covers, ["path", "_b"], "left")
        .withColumn("inside", F.coalesce(reach >= F.col("end_line"), F.lit(False)))
        .drop("_b", "_covers")
    )


# The control cells every block and envelope must hold once.
CELL_TYPES = (
    "error_bearing",
    "corrected_twin",
    "valid_alternative",
    "hard_negative",
    "ambiguous",
    "unsupported",
    "renamed_implementation",
)


def required_matrix(
    assignments: DataFrame, blocks: DataFrame, envelopes: DataFrame, plan: str, cell_types: Sequence[str] = CELL_TYPES
) -> DataFrame:
    """(block, envelope, cell type) cells of a plan without exactly one assignment.

    ``blocks``: plan, block_id.  ``envelopes``: plan, envelope_id.  The declared lists meet on
    their plan; the cell types are a fixed list.  Assignments are counted for each block and type; only where they
    are fewer than the plan's envelopes are envelopes looked through for those without one.
    """
    keys = [plan, "block_id", "envelope_id", "cell_type"]
    blocks, envelopes = blocks.select(plan, "block_id").distinct(), envelopes.select(plan, "envelope_id").distinct()
    declared = (
        assignments.where(F.col("cell_type").isin(*cell_types))
        .groupBy(*keys)
        .agg(F.count("*").alias("assigned"))
        .join(blocks, [plan, "block_id"], "left_semi")
        .join(envelopes, [plan, "envelope_id"], "left_semi")
    )
    declared = cut_lineage(declared)
    width = envelopes.groupBy(plan).agg(F.count("*").alias("_width"))
    lines = blocks.join(width, plan).withColumn("cell_type", F.explode(F.array(*[F.lit(c) for c in cell_types])))
    filled = declared.groupBy(plan, "block_id", "cell_type").agg(F.count("*").alias("_filled"))
    short = lines.join(filled, [plan, "block_id", "cell_type"], "left").where(F.coalesce("_filled", F.lit(0)) < F.col("_width"))
    gaps = short.select(plan, "block_id", "cell_type").join(envelopes, plan).join(declared, keys, "left_anti")
    again = declared.where("assigned <> 1").select(*keys, "assigned")
    return again.unionByName(gaps.select(*keys, F.lit(0).cast("long").alias("assigned")))


def tolerance_compare(actual: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Field by field: inclusive absolute tolerance and range, exact integer or exact string.

    ``actual``: keys, actual (string).  ``expected``: keys, kind, expected (string), tolerance,
    min_value, max_value.  An absent field does not match.
    """
    a, e = F.col("actual").try_cast("double"), F.col("expected").try_cast("double")
    within_range = (F.col("min_value").isNull() | (a >= F.col("min_value"))) & (
        F.col("max_value").isNull() | (a <= F.col("max_value"))
    )
    numeric = (F.abs(a - e) <= F.col("tolerance")) & within_range
    whole = F.col("actual").rlike(r"^-?[0-9]+$") & (F.col("actual").try_cast("long") == F.col("expected").try_cast("long"))
    match = (
        F.when(F.col("kind") == "numeric", numeric)
        .when(F.col("kind") == "integer", whole & within_range)
        .otherwise(F.col("actual") == F.col("expected"))
    )
    return (
        expected.join(actual, list(keys), "left")
        .withColumn("absolute_error", F.when(F.col("kind") == "numeric", F.abs(a - e)))
        .withColumn("matches", F.coalesce(match, F.lit(False)))
    )


def record_grade(compared: DataFrame, record: Sequence[str]) -> DataFrame:
    return compared.groupBy(*record).agg(
        F.count("*").alias("fields"),
        F.count_if("matches").alias("matching"),
        F.every("matches").alias("all_match"),
    )


def report_vs_table(targets: DataFrame, reported: DataFrame, scope: Sequence[str], value: str) -> DataFrame:
    """The single reported value of an unordered pair within its scope; none when not unique."""

    def pair(df: DataFrame) -> DataFrame:
        filled = (F.col("left_id").cast("string") != "") & (F.col("right_id").cast("string") != "")
        ok = filled & (F.col("left_id") != F.col("right_id"))
        return df.withColumn("_lo", F.when(ok, F.least("left_id", "right_id"))).withColumn(
            "_hi", F.when(ok, F.greatest("left_id", "right_id"))
        )

    keys = [*scope, "_lo", "_hi"]
    stated = pair(reported).groupBy(*keys).agg(F.count("*").alias("reports"), F.min(value).alias("_v"))
    return (
        pair(targets)
        .join(stated, keys, "left")
        .withColumn("reports", F.coalesce("reports", F.lit(0)))
        .withColumn("reported", F.when(F.col("reports") == 1, F.col("_v")))
        .withColumn(
            "applicability", F.when(F.col("reports") == 1, F.lit("applicable")).otherwise(F.lit("unsupported"))
        )
        .drop("_lo", "_hi", "_v")
    )


def span_verify(refs: DataFrame, files: DataFrame, path: str, text: str) -> DataFrame:
    """Does each cited span resolve: digest, line range, exact quotation, column window?

    ``refs``: path, digest, start_line, end_line, quoted, start_column, end_column.
    ``files``: path and text.  Adds ``span_status``.
    """
    lines = F.split(F.regexp_replace(F.col(text), r"(?:\r\n|[\n\r])$", ""), LINE_BREAK)
    cited = refs.select(path).distinct()
    store = files.join(cited, path, "left_semi").select(
        path, F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("_digest"), lines.alias("_lines")
    )
    start, end = F.col("start_line"), F.col("end_line")
    inside = (start >= 1) & (start <= end) & (end <= F.size("_lines"))
    window = F.slice("_lines", F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0)))
    no_span = start.isNull() & end.isNull() & F.col("quoted").isNull()
    one_line = (start == end) & F.col("start_column").isNotNull() & F.col("end_column").isNotNull()
    width = F.length(F.get("_lines", (start - 1).cast("int"))) + 1
    in_line = (F.col("start_column") >= 1) & (F.col("start_column") <= F.col("end_column")) & (F.col("end_column") <= width)
    status = (
        F.when(F.col("_digest").isNull(), F.lit("missing_file"))
        .when(~F.col("digest").eqNullSafe(F.col("_digest")), F.lit("digest_mismatch"))
        .when(no_span, F.lit("verified"))
        .when(start.isNull() | end.isNull(), F.lit("incomplete_span"))
        .when(~inside, F.lit("outside_file"))
        .when(F.col("quoted").isNotNull() & (F.array_join(window, "\n") != F.col("quoted")), F.lit("quote_mismatch"))
        .when(F.col("quoted").isNotNull() & one_line & ~in_line, F.lit("outside_line"))
        .otherwise(F.lit("verified"))
    )
    return refs.join(store, path, "left").withColumn("span_status", status).drop("_digest", "_lines")


def unsupported_reviews(reviews: DataFrame, refs: DataFrame, review: str) -> DataFrame:
    """Reviews that cite no span at all."""
    return reviews.join(refs.select(review).distinct(), review, "left_anti")
