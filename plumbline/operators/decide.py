"""Decisions over evidence: lineage grades, admission, relations, reductions, compatibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lineage dimensions, clean check results and compatible models.
LINEAGE_DIMENSIONS = (
    "report_origin",
    "result_origin",
    "computational_origin",
    "input_origin",
    "execution_origin",
    "semantic_origin",
)
GRADES = ("complete", "partial", "missing", "unavailable", "opaque")
COMPATIBLE_MODELS = (
    ("count_likelihood", "raw_counts", "negative_binomial_count_likelihood"),
    ("location_test", "transformed_continuous", "generic_continuous_location_test"),
    ("location_test", "normalized_continuous", "generic_continuous_location_test"),
)


def lineage_grade(grades: DataFrame, claim: str) -> DataFrame:
    """Aggregate status of a claim's six grades.  ``grades``: claim, dimension, status."""
    is_ = lambda v: F.coalesce(F.col("status") == v, F.lit(False))
    stats = grades.groupBy(claim).agg(
        F.count("*").alias("_n"),
        F.count_distinct(F.when(F.col("dimension").isin(*LINEAGE_DIMENSIONS), F.col("dimension"))).alias("_dims"),
        F.every(F.coalesce(F.col("status").isin(*GRADES), F.lit(False))).alias("_legal"),
        F.every(is_("complete")).alias("_complete"),
        F.every(is_("unavailable")).alias("_unavailable"),
        F.some(is_("missing")).alias("_missing"),
        F.some(is_("complete") | is_("partial")).alias("_positive"),
    )
    size = len(LINEAGE_DIMENSIONS)
    status = (
        F.when((F.col("_n") != size) | (F.col("_dims") != size) | ~F.col("_legal"), F.lit("invalid"))
        .when(F.col("_complete"), F.lit("complete"))
        .when(F.col("_missing") & ~F.col("_positive"), F.lit("missing"))
        .when(F.col("_unavailable"), F.lit("unavailable"))
        .otherwise(F.lit("partial"))
    )
    return stats.select(claim, status.alias("lineage_status"))


def _members_differ(left: DataFrame, right: DataFrame, once: bool = False) -> DataFrame:
    """Per result: do the two member lists differ as sets?  With ``once`` a repeat on the right
    counts as a difference.  Members are counted, never gathered."""
    tagged = left.withColumn("_s", F.lit(0)).unionByName(right.withColumn("_s", F.lit(1)))
    per_member = tagged.groupBy("result_id", "_m").agg(
        F.count_if(F.col("_s") == 0).alias("_l"), F.count_if(F.col("_s") == 1).alias("_r")
    )
    wrong = (F.col("_l") == 0) | (F.col("_r") == 0) | (F.lit(once) & (F.col("_r") > 1))
    return per_member.groupBy("result_id").agg(F.some(wrong).alias("_differ"))


def finding_admission(results: DataFrame, premises: DataFrame, checks: DataFrame, required: DataFrame) -> DataFrame:
    """Which gate stops each candidate finding; ``admitted`` when none does.

    ``results``: result_id, detector_id, applicability, coverage, gaps, unavailable, unresolved_premises,
    declared_premises (array), digest, expected_digest, draft_matches.  ``premises``: result_id,
    premise_id, material, state, evidence (count).  ``checks``: result_id, check_id, status,
    outcome.  ``required``: detector_id, check_id.
    """
    established = (F.col("state") == "established") & (F.col("evidence") > 0)
    material = premises.where("material")
    met = material.groupBy("result_id").agg(F.every(F.coalesce(established, F.lit(False))).alias("_established"))
    clean = ((F.col("status") == "completed") & (F.col("outcome") == "no_counterevidence")) | (
        (F.col("status") == "not_applicable") & (F.col("outcome") == "not_applicable")
    )
    run = checks.groupBy("result_id").agg(F.every(F.coalesce(clean, F.lit(False))).alias("_clean"))
    need = required.groupBy("detector_id").agg(
        F.count("*").alias("_need"), F.count_distinct("check_id").alias("_kinds")
    )
    wanted = results.select("result_id", "detector_id").join(required.distinct(), "detector_id")
    joined = (
        results.join(met, "result_id", "left")
        .join(run, "result_id", "left")
        .join(need, "detector_id", "left")
        .join(
            _members_differ(
                results.select("result_id", F.explode("declared_premises").alias("_m")),
                material.select("result_id", F.col("premise_id").alias("_m")),
            ).withColumnRenamed("_differ", "_premises_differ"),
            "result_id",
            "left",
        )
        .join(
            _members_differ(
                wanted.select("result_id", F.col("check_id").alias("_m")),
                checks.select("result_id", F.col("check_id").alias("_m")),
                once=True,
            ).withColumnRenamed("_differ", "_checks_differ"),
            "result_id",
            "left",
        )
    )
    declared = F.col("declared_premises")
    gate = (
        F.when(~F.col("applicability").eqNullSafe("applicable"), F.lit("applicability"))
        .when(~F.col("coverage").eqNullSafe("covered") | (F.col("gaps") > 0), F.lit("coverage"))
        .when(F.col("unavailable") > 0, F.lit("unavailable_evidence"))
        .when(
            (F.size(declared) == 0)
            | (F.size(F.array_distinct(declared)) != F.size(declared))
            | (F.col("unresolved_premises") > 0),
            F.lit("premise_declaration"),
        )
        .when(~F.coalesce("_established", F.lit(False)), F.lit("premise_not_established"))
        .when(F.coalesce("_premises_differ", F.lit(True)), F.lit("premise_sets_differ"))
        .when(
            F.col("_need").isNull() | (F.col("_kinds") != F.col("_need")) | ~F.coalesce("_clean", F.lit(False)),
            F.lit("counterevidence"),
        )
        .when(F.coalesce("_checks_differ", F.lit(True)), F.lit("counterevidence_incomplete"))
        .when(~F.col("draft_matches"), F.lit("draft"))
        .when(~F.col("digest").eqNullSafe(F.col("expected_digest")), F.lit("digest"))
    )
    return joined.select("result_id", gate.alias("failed_gate"), gate.isNull().alias("admitted"))


def relation_check(df: DataFrame) -> DataFrame:
    """Closed relations between a required and an observed operand.

    Columns: form (value_equals, set_relation, step_precedes), required, observed and forbidden
    (arrays; a value is a one-element array).  Adds ``relation``.
    """
    required, observed, forbidden = F.col("required"), F.col("observed"), F.col("forbidden")
    contradictory = F.size(F.array_intersect(required, forbidden)) > 0
    compatible = (F.size(F.array_except(required, observed)) == 0) & (
        F.size(F.array_intersect(observed, forbidden)) == 0
    )
    first = F.array_position(observed, F.get(required, F.lit(0)))
    second = F.array_position(observed, F.get(required, F.lit(1)))
    word = lambda ok: F.when(ok, F.lit("compatible")).otherwise(F.lit("conflict"))
    return df.withColumn(
        "relation",
        F.when(F.col("form") == "value_equals", word(F.get(required, F.lit(0)).eqNullSafe(F.get(observed, F.lit(0)))))
        .when((F.col("form") == "set_relation") & contradictory, F.lit("abstained"))
        .when(F.col("form") == "set_relation", word(compatible))
        .when((F.col("form") == "step_precedes") & ((first == 0) | (second == 0)), F.lit("abstained"))
        .when(F.col("form") == "step_precedes", word(first < second))
        .otherwise(F.lit("abstained")),
    )


def model_compatibility(df: DataFrame, required: str, scale: str, observed: str) -> DataFrame:
    """Is the observed method family one the required family and response scale allow?"""
    count = F.col(required) == "count_likelihood"
    rows = [
        (count if family == "count_likelihood" else ~count) & (F.col(scale) == s) & (F.col(observed) == method)
        for family, s, method in COMPATIBLE_MODELS
    ]
    ok = rows[0]
    for row in rows[1:]:
        ok = ok | row
    return df.withColumn("compatible", F.coalesce(ok, F.lit(False)))


def observation_reduce(observations: DataFrame, failures: DataFrame) -> DataFrame:
    """One state per check from many observers; equal observations count once.

    ``observations``: check_id, digest, equivalence_key, state, operand, scope_endpoint, path,
    target, plane.  ``failures``: check_id, adapter_id.
    """
    distinct = observations.dropDuplicates(["check_id", "digest"])
    applicable = F.col("state") == "applicable"
    stats = distinct.groupBy("check_id").agg(
        F.count("*").alias("observations"),
        F.count_distinct("equivalence_key").alias("equivalence_groups"),
        F.some(F.col("state") == "ambiguous").alias("_ambiguous"),
        F.some(applicable).alias("_applicable"),
        F.some(F.col("state") == "unsupported").alias("_unsupported"),
        F.some(F.col("state") == "not_applicable").alias("_na"),
        F.count_distinct(F.when(applicable, F.col("operand"))).alias("_operands"),
        F.count_distinct(F.when(applicable, F.col("scope_endpoint"))).alias("_scopes"),
        F.min(F.when(applicable, F.col("operand"))).alias("_a0"),
        F.min(F.when(F.col("state") == "unsupported", F.col("operand"))).alias("_u0"),
        F.max(F.when(F.col("state") == "unsupported", F.col("operand"))).alias("_u1"),
    )
    held = distinct.where(applicable).withColumn("_t", F.coalesce("target", F.lit("null")))
    per_plane = held.groupBy("check_id", "plane").agg(F.count_distinct("_t").alias("_targets"))
    per_path = held.groupBy("check_id", "_t", "plane").agg(F.count_distinct("path").alias("_paths"))
    split = (
        per_plane.where("_targets <> 1")
        .select("check_id")
        .unionByName(per_path.where("_paths <> 1").select("check_id"))
        .distinct()
        .withColumn("_split", F.lit(True))
    )
    failed = failures.select("check_id").distinct().withColumn("_failed", F.lit(True))
    joined = (
        stats.join(failed, "check_id", "full_outer")
        .join(split, "check_id", "left")
    )
    disagree = (F.col("_operands") != 1) | (F.col("_scopes") != 1) | F.coalesce("_split", F.lit(False))
    unscoped = F.col("_u0").isNotNull() & ((F.col("_u0") != F.col("_a0")) | (F.col("_u1") != F.col("_a0")))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    state = (
        F.when(yes("_ambiguous"), F.lit("ambiguous"))
        .when(yes("_applicable") & disagree, F.lit("ambiguous"))
        .when(yes("_applicable") & unscoped, F.lit("ambiguous"))
        .when(yes("_applicable"), F.lit("applicable"))
        .when(yes("_failed") | yes("_unsupported"), F.lit("unsupported"))
        .when(yes("_na"), F.lit("not_applicable"))
        .otherwise(F.lit("unsupported"))
    )
    return joined.select(
        "check_id",
        F.coalesce("observations", F.lit(0)).alias("observations"),
        F.coalesce("equivalence_groups", F.lit(0)).alias("equivalence_groups"),
        state.alias("state"),
    )
