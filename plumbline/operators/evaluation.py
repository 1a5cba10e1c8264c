"""Scoring detector outcomes: metrics, strata, bootstrap, panels, baselines, regressions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.diff import multiset_difference
from plumbline.session import cut_lineage
from plumbline.skew import numbered, spread

# Outcome states and the names and order of the metrics.
UNSAFE = ("overstated_root_match", "false_root_localization")
RESOLVED = ("bounded_root_match", "overstated_root_match", "false_root_localization")
RESOLVED_ROOTS = ("boundedly_localized", "localized_but_overstated", "missed")
ABSTENTIONS = ("insufficient_semantics", "execution_evidence_unavailable")
CONTROL_FAMILIES = ("clean_execution", "documented_external_execution", "static_closed_scope")
METRICS = (
    "workflow_unsafe_candidate_probability",
    "completed_opportunity_false_positive_rate",
    "applicable_covered_opportunity_false_positive_rate",
    "finding_candidate_precision",
    "false_root_localization_rate",
    "overstatement_rate",
    "adjudicated_root_recall",
    "bounded_root_localization_accuracy",
    "abstention_rate",
    "unsupported_rate",
    "detector_error_rate",
    "unresolved_comparison_rate",
)
REPLICATES = 10_000
#: Bootstrap: clusters whose sums are held at once, draws of a replicate packed in one row, draws of one group.
CLUSTERS_PER_BLOCK = 1 << 17
DRAWS_PER_ROW = 1 << 20
DRAWS_PER_GROUP = 1 << 23


def _how_many(array: str, test) -> Column:
    return F.size(F.filter(array, test))


def _case_terms() -> dict[str, tuple[Column, Column]]:
    """Numerator and denominator one case adds to each metric; nested arrays stay in the row."""
    complete = F.coalesce(F.col("metric_input_status") == "complete", F.lit(False))
    eligible = (
        complete
        & F.coalesce(F.col("comparison_status") == "reconciled", F.lit(False))
        & F.coalesce(F.col("metric_eligible"), F.lit(False))
    )
    unsafe_ids = F.transform(F.filter("candidates", lambda c: c["status"].isin(*UNSAFE)), lambda c: c["candidate_id"])
    done = lambda p: p["execution_class"] == "completed"
    covered = lambda p: (
        done(p) & (p["applicability_status"] == "applicable") & (p["coverage_status"] == "covered")
    )
    unsafe = lambda p: F.arrays_overlap(p["candidate_ids"], unsafe_ids)

    def if_(gate: Column, value: Column) -> Column:
        return F.when(gate, value).otherwise(0)

    def among(array: str, *states: str) -> Column:
        return _how_many(array, lambda x: x["status"].isin(*states))

    def opportunities(test) -> Column:
        return _how_many("opportunities", test)

    n_candidates = if_(eligible, among("candidates", *RESOLVED))
    n_roots = if_(eligible, among("roots", *RESOLVED_ROOTS))
    located = if_(eligible, among("roots", "boundedly_localized", "localized_but_overstated"))
    n_opportunities = if_(complete, F.size("opportunities"))
    return {
        METRICS[0]: (if_(eligible, (F.size(unsafe_ids) > 0).cast("int")), eligible.cast("int")),
        METRICS[1]: (
            if_(eligible, opportunities(lambda p: done(p) & unsafe(p))),
            if_(eligible, opportunities(done)),
        ),
        METRICS[2]: (
            if_(eligible, opportunities(lambda p: covered(p) & unsafe(p))),
            if_(eligible, opportunities(covered)),
        ),
        METRICS[3]: (if_(eligible, among("candidates", "bounded_root_match")), n_candidates),
        METRICS[4]: (if_(eligible, among("candidates", "false_root_localization")), n_candidates),
        METRICS[5]: (if_(eligible, among("candidates", "overstated_root_match")), n_candidates),
        METRICS[6]: (located, n_roots),
        METRICS[7]: (if_(eligible, among("roots", "boundedly_localized")), located),
        METRICS[8]: (if_(complete, opportunities(lambda p: p["state"].isin(*ABSTENTIONS))), n_opportunities),
        METRICS[9]: (if_(complete, opportunities(lambda p: p["state"] == "unsupported_path")), n_opportunities),
        METRICS[10]: (
            if_(complete, opportunities(lambda p: p["execution_class"] == "detector_error")),
            n_opportunities,
        ),
        METRICS[11]: (
            if_(complete, F.coalesce(F.col("comparison_status") == "comparison_excluded", F.lit(False)).cast("int")),
            complete.cast("int"),
        ),
    }


def _wide_pairs(outcomes: DataFrame, group: Sequence[str]) -> DataFrame:
    """Sums n0, d0, n1, d1 ... per group; each case is reduced to its own numbers first."""
    terms = _case_terms()
    columns = [c.cast("long").alias(x + str(i)) for i, m in enumerate(METRICS) for x, c in zip("nd", terms[m])]
    cases = spread(outcomes).select(*group, *columns)
    sums = [F.sum(f"{x}{i}").alias(f"{x}{i}") for i in range(len(METRICS)) for x in "nd"]
    return cases.groupBy(*group).agg(*sums)


def _stack(keys: Sequence[str], wide: DataFrame) -> DataFrame:
    rows = ", ".join(f"'{name}', n{i}, d{i}" for i, name in enumerate(METRICS))
    long = wide.select(*keys, F.expr(f"stack({len(METRICS)}, {rows}) as (metric_name, numerator, denominator)"))
    return long.withColumn(
        "estimate", F.when(F.col("denominator") > 0, F.col("numerator") / F.col("denominator"))
    )


def metric_pairs(outcomes: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """The twelve metrics, one row each per group; the estimate is null on a zero denominator.

    ``outcomes``: case_id, problem_id, comparison_status, metric_input_status, metric_eligible,
    opportunities array<struct<state, applicability_status, coverage_status, execution_class,
    candidate_ids>>, candidates array<struct<candidate_id, status>>, roots
    array<struct<root_id, status>>.
    """
    return _stack(list(group), _wide_pairs(outcomes, group))


def public_counts(outcomes: DataFrame) -> DataFrame:
    """The sixteen headline counts, one row each."""
    terms = _case_terms()
    complete = F.coalesce(F.col("metric_input_status") == "complete", F.lit(False))
    eligible = (
        complete & (F.col("comparison_status") == "reconciled") & F.coalesce(F.col("metric_eligible"), F.lit(False))
    )

    def roots(status: str) -> Column:
        return F.when(eligible, _how_many("roots", lambda r: r["status"] == status)).otherwise(0)

    covered = F.when(
        complete,
        _how_many(
            "opportunities",
            lambda p: (p["execution_class"] == "completed")
            & (p["applicability_status"] == "applicable")
            & (p["coverage_status"] == "covered"),
        ),
    ).otherwise(0)
    counts: dict[str, Column] = {
        "problem_clusters": F.count_distinct("problem_id"),
        "workflows": F.count("*"),
        "opportunities": F.sum(terms[METRICS[8]][1]),
        "applicable_covered_opportunities": F.sum(covered),
        "evaluation_candidates": F.sum(terms[METRICS[3]][1]),
        "adjudicated_roots": F.sum(terms[METRICS[6]][1]),
        "bounded_root_matches": F.sum(terms[METRICS[3]][0]),
        "overstated_root_matches": F.sum(terms[METRICS[5]][0]),
        "false_root_localizations": F.sum(terms[METRICS[4]][0]),
        "boundedly_localized_roots": F.sum(roots("boundedly_localized")),
        "localized_but_overstated_roots": F.sum(roots("localized_but_overstated")),
        "missed_roots": F.sum(roots("missed")),
        "abstentions": F.sum(terms[METRICS[8]][0]),
        "unsupported_opportunities": F.sum(terms[METRICS[9]][0]),
        "detector_errors": F.sum(terms[METRICS[10]][0]),
        "unresolved_comparisons": F.sum(terms[METRICS[11]][0]),
    }
    wide = outcomes.agg(*[c.cast("long").alias(n) for n, c in counts.items()])
    rows = ", ".join(f"'{n}', `{n}`" for n in counts)
    return wide.select(F.expr(f"stack({len(counts)}, {rows}) as (count_name, value)"))


def stratified_metrics(outcomes: DataFrame, family: str) -> DataFrame:
    """Metrics per control family; a family without cases is one row without metrics."""
    metrics = metric_pairs(outcomes.where(F.col(family).isin(*CONTROL_FAMILIES)), [family])
    cases = outcomes.groupBy(family).agg(F.count("*").alias("case_count"))
    listed = outcomes.sparkSession.createDataFrame([(f,) for f in CONTROL_FAMILIES], f"{family} string")
    return (
        listed.join(cases, family, "left")
        .na.fill(0, ["case_count"])
        .join(metrics, family, "left")
    )


def excluded_cases(outcomes: DataFrame) -> DataFrame:
    reason = F.when(F.col("metric_input_status") != "complete", F.lit("projection_unavailable")).when(
        F.col("comparison_status") == "comparison_excluded", F.lit("comparison_excluded")
    )
    return outcomes.select("case_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def counter_draw(domain: str, input_digest: str, replicate: Column, position: Column, size: int) -> Column:
    """Cluster index drawn by SHA-256 counter mode: 256-bit value modulo ``size``.

    The value is folded 32 bits at a time.  A draw that rejection sampling would repeat has
    probability below 2**-220 for any size that fits an int.
    """
    if not 0 < size < 2**31:
        raise ValueError("size must fit a positive int")

    def eight(c: Column) -> Column:
        return F.lpad(F.hex(c.cast("long")), 16, "0")

    block = F.concat(
        F.lit(domain.encode().hex() + "00" + input_digest.removeprefix("sha256:")),
        eight(replicate),
        eight(position),
        F.lit("0" * 16),
    )
    digest = F.sha2(F.unhex(block), 256)
    value = F.lit(0).cast("long")
    for i in range(8):
        word = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")
        value = F.pmod(value * F.lit(1 << 32) + word, F.lit(size).cast("long"))
    return value


def resampled_totals(
    sums: DataFrame, size: int, domain: str, input_digest: str, replicates: int, *, block: int = CLUSTERS_PER_BLOCK
) -> DataFrame:
    """Column totals of every replicate over the clusters it draws, as :func:`counter_draw` numbers them.

    ``sums``: idx from 0 to ``size - 1`` and whole numbers.  The draws of a replicate leave the task that makes them as
    one packed row for each block of clusters (4 bytes a draw, no row a draw).  They meet the block's sums in groups of
    bounded size, are counted by cluster, and only one total for each replicate and block is merged.
    """
    if size >= 2**31:
        raise ValueError("size must fit a positive int")
    spark: SparkSession = sums.sparkSession
    names = [c for c in sums.columns if c != "idx"]
    sums = sums.fillna(0)
    head = domain.encode() + b"\0" + bytes.fromhex(input_digest.removeprefix("sha256:"))
    parts = -(-size // DRAWS_PER_ROW)
    together = max(1, min(DRAWS_PER_GROUP // max(1, min(size, block)), -(-replicates // 64)))
    groups = -(-replicates // together)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["block", "part", "replicate", "draws"]
        for batch in batches:
            rows, held = [], 0
            for i in batch["id"]:
                replicate, part = divmod(int(i), parts)
                start = head + replicate.to_bytes(8, "big")
                places = range(part * DRAWS_PER_ROW, min(size, (part + 1) * DRAWS_PER_ROW))
                digests = (hashlib.sha256(start + p.to_bytes(8, "big") + bytes(8)).digest() for p in places)
                idx = np.fromiter((int.from_bytes(d, "big") % size for d in digests), np.int64, len(places))
                idx.sort()
                edges = np.flatnonzero(np.diff(idx // block)) + 1
                for run in np.split(idx, edges):
                    at = int(run[0]) // block
                    rows.append((at, replicate // together, replicate, (run - at * block).astype("<u4").tobytes()))
                held += len(idx)
                if held >= DRAWS_PER_GROUP:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    def add(drawn: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        matrix = table.sort_values("idx")[names].to_numpy(dtype=np.int64)
        totals = [np.bincount(np.frombuffer(d, dtype="<u4"), minlength=len(matrix)) @ matrix for d in drawn["draws"]]
        made = pd.DataFrame(np.array(totals, dtype=np.int64).reshape(-1, len(names)), columns=names)
        made.insert(0, "replicate", drawn["replicate"].to_numpy())
        return made.groupby("replicate", as_index=False).sum()

    packed = spark.range(0, replicates * parts).mapInPandas(draw, "block bigint, part bigint, replicate bigint, draws binary")
    every = F.sequence(F.lit(0).cast("long"), F.lit(max(1, groups) - 1).cast("long"))
    placed = sums.withColumn("block", F.floor(F.col("idx") / block)).withColumn("part", F.explode(every))
    schema = "replicate bigint, " + ", ".join(f"{n} bigint" for n in names)
    met = packed.groupBy("block", "part").cogroup(placed.groupBy("block", "part")).applyInPandas(add, schema)
    return met.groupBy("replicate").agg(*[F.sum(n).alias(n) for n in names])


def cluster_bootstrap(
    outcomes: DataFrame, cluster: str, input_digest: str, *, domain: str = "plumbline-bootstrap-v1", replicates: int = REPLICATES
) -> DataFrame:
    """Percentile intervals by resampling whole problem clusters with replacement.

    Clusters are summed once; each replicate adds up the clusters it drew.  The interval is the
    order statistics ceil(n/40) and ceil(39n/40) of the valid replicates.
    """
    sums = numbered(_wide_pairs(outcomes, [cluster]), [cluster])
    sums = cut_lineage(sums)
    size = sums.count()
    drawn = resampled_totals(sums.drop(cluster), size, domain, input_digest, replicates)
    long = cut_lineage(_stack(["replicate"], drawn))
    per_metric = long.groupBy("metric_name").agg(
        F.count("estimate").alias("valid_replicates"), F.count_if(F.col("estimate").isNull()).alias("invalid_replicates")
    )
    ranked = (
        long.where(F.col("estimate").isNotNull())
        .withColumn("k", F.row_number().over(Window.partitionBy("metric_name").orderBy("estimate")))
        .join(per_metric, "metric_name")
        .groupBy("metric_name")
        .agg(
            F.max(F.when(F.col("k") == F.ceil(F.col("valid_replicates") / 40), F.col("estimate"))).alias("lower"),
            F.max(F.when(F.col("k") == F.ceil(39 * F.col("valid_replicates") / 40), F.col("estimate"))).alias("upper"),
        )
    )
    enough = (F.lit(size) >= 2) & (F.col("valid_replicates") >= 2)
    return per_metric.join(ranked, "metric_name", "left").select(
        "metric_name",
        F.when(enough, F.lit("estimated")).otherwise(F.lit("not_estimable")).alias("status"),
        F.when(enough, F.col("lower")).alias("lower"),
        F.when(enough, F.col("upper")).alias("upper"),
        "valid_replicates",
        "invalid_replicates",
        F.lit(size < 20).alias("few_clusters"),
    )


def outcome_reconcile(candidates: DataFrame, roots: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidate statuses, root statuses) from adjudicated mappings.

    ``candidates``: case_id, candidate_id.  ``roots``: case_id, root_id.  ``mappings``: case_id,
    candidate_id, root_id, relation, boundedness, scope, class_relation.
    """
    same = (
        F.col("root_id").isNotNull()
        & (F.col("relation") == "same_first_material_divergence")
        & (F.col("class_relation") == "exact")
    )
    status = (
        F.when(F.col("scope") == "outside_declared_scope", F.lit("out_of_declared_scope"))
        .when(
            same
            & (F.col("boundedness") == "within_adjudicated_bounds")
            & F.col("scope").isin("within_adjudicated_scope", "not_applicable"),
            F.lit("bounded_root_match"),
        )
        .when(
            same
            & ((F.col("boundedness") == "exceeds_adjudicated_bounds") | (F.col("scope") == "exceeds_adjudicated_scope")),
            F.lit("overstated_root_match"),
        )
        .otherwise(F.lit("false_root_localization"))
    )
    judged = (
        candidates.join(mappings, ["case_id", "candidate_id"])
        .withColumn("status", status)
        .withColumn(
            "root_id",
            F.when(F.col("status").isin("bounded_root_match", "overstated_root_match"), F.col("root_id")),
        )
        .select("case_id", "candidate_id", "status", "root_id")
    )
    matched = judged.where(F.col("root_id").isNotNull()).groupBy("case_id", "root_id").agg(
        F.some(F.col("status") == "bounded_root_match").alias("_bounded"),
        F.count("*").alias("matched_candidates"),
    )
    rooted = roots.join(matched, ["case_id", "root_id"], "left").select(
        "case_id",
        "root_id",
        F.when(F.col("_bounded"), F.lit("boundedly_localized"))
        .when(F.col("_bounded").isNotNull(), F.lit("localized_but_overstated"))
        .otherwise(F.lit("missed"))
        .alias("status"),
        F.coalesce("matched_candidates", F.lit(0)).alias("matched_candidates"),
    )
    return judged, rooted


def run_summary(results: DataFrame, run: str) -> DataFrame:
    """Execution, applicability and coverage of each run from its results."""
    has = lambda c, v: F.some(F.coalesce(F.col(c) == v, F.lit(False)))
    whole = lambda c, v: F.every(F.coalesce(F.col(c) == v, F.lit(False)))
    return results.groupBy(run).agg(
        F.when(has("state", "detector_error"), F.lit("detector_error")).otherwise(F.lit("completed")).alias("execution"),
        F.when(has("applicability", "uncertain"), F.lit("uncertain"))
        .when(has("applicability", "applicable"), F.lit("applicable"))
        .otherwise(F.lit("not_applicable"))
        .alias("applicability"),
        F.when(whole("coverage", "covered"), F.lit("covered"))
        .when(whole("coverage", "not_covered"), F.lit("not_covered"))
        .when(has("coverage", "unknown"), F.lit("unknown"))
        .otherwise(F.lit("partially_covered"))
        .alias("coverage"),
    )


def panel_participation(reviews: DataFrame, declared: DataFrame) -> DataFrame:
    """Actual against declared participation per case and provider.

    ``reviews``: case_id, provider, stage, context_id.  ``declared``: case_id, provider, stage1,
    stage2, contexts.
    """
    actual = reviews.groupBy("case_id", "provider").agg(
        F.count_if(F.col("stage") == 1).alias("_s1"),
        F.count_if(F.col("stage") == 2).alias("_s2"),
        F.count_distinct("context_id").alias("_ctx"),
    )
    said = declared.groupBy("case_id", "provider").agg(
        F.count("*").alias("_n"), F.max("stage1").alias("stage1"), F.max("stage2").alias("stage2"), F.max("contexts").alias("contexts")
    )
    joined = actual.join(said, ["case_id", "provider"], "full_outer")
    fault = (
        F.when(F.col("_n").isNull(), F.lit("undeclared_provider"))
        .when(F.col("_s1").isNull(), F.lit("absent_provider"))
        .when(F.col("_n") > 1, F.lit("declared_twice"))
        .when(
            (F.col("stage1") != F.col("_s1")) | (F.col("stage2") != F.col("_s2")) | (F.col("contexts") != F.col("_ctx")),
            F.lit("counts_differ"),
        )
        .otherwise(F.lit("ok"))
    )
    return joined.select("case_id", "provider", fault.alias("participation"))


def panel_agreement(reviews: DataFrame) -> DataFrame:
    """Can a label rest on the case's reviews: distinct contexts, one verdict, nothing open?

    ``reviews``: case_id, context_id, verdict, issue_class, unresolved, dissent.
    """
    stats = reviews.groupBy("case_id").agg(
        F.count("*").alias("reviews"),
        F.count_distinct("context_id").alias("contexts"),
        F.min("verdict").alias("_v0"),
        F.max("verdict").alias("_v1"),
        F.count_distinct("issue_class").alias("_classes"),
        F.some("unresolved").alias("_open"),
        F.some("dissent").alias("_dissent"),
    )
    fault = (
        F.when(F.col("contexts") < F.col("reviews"), F.lit("shared_context"))
        .when(F.col("_open"), F.lit("unresolved_question"))
        .when(F.col("_dissent"), F.lit("material_dissent"))
        .when(F.col("_v0") != F.col("_v1"), F.lit("split_verdict"))
        .when((F.col("_v0") == "demonstrated_issue") & (F.col("_classes") > 1), F.lit("split_issue_class"))
        .otherwise(F.lit("eligible"))
    )
    return stats.select("case_id", "reviews", "contexts", fault.alias("panel"))


def decision_agreement(projections: DataFrame) -> DataFrame:
    """Two reviewers' decisions agree when their canonical digests are equal and none is open.

    ``projections``: case_id, reviewer, digest, unresolved.
    """
    return projections.groupBy("case_id").agg(
        F.count("*").alias("decisions"),
        F.when(F.some("unresolved"), F.lit("unresolved"))
        .when(F.count_distinct("digest") == 1, F.lit("agreed"))
        .otherwise(F.lit("disagreed"))
        .alias("decision"),
    )


# Evidence roles that satisfy each requirement, by kind of component.
CALCULATION_REQUIREMENTS: Mapping[str, tuple[str, ...]] = {
    "positive_or_applicable": ("positive",),
    "corrected_or_conformant": ("corrected_twin",),
    "hard_negative": ("hard_negative",),
    "ambiguity_or_unsupported_boundary": ("ambiguous", "unsupported"),
    "removal_and_sibling_isolation": ("removal",),
    "semantic_replay": ("replay",),
}
QUESTION_REQUIREMENTS: Mapping[str, tuple[str, ...]] = {
    "positive_or_applicable": ("positive",),
    "matching_close_negative": ("hard_negative",),
    "ambiguity_or_unsupported_boundary": ("ambiguous", "unsupported"),
    "removal_and_sibling_isolation": ("removal",),
    "semantic_replay": ("replay",),
}


def baseline_coverage(components: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per component and requirement: cases that satisfy it, and component completeness.

    ``components``: component_id, component_kind.  ``cases``: case_id, case_role, component_refs.
    """

    def wanted(kind: str, requirements: Mapping[str, tuple[str, ...]]) -> Column:
        listed = [
            F.struct(F.lit(r).alias("requirement"), F.array(*[F.lit(x) for x in roles]).alias("roles"))
            for r, roles in requirements.items()
        ]
        return F.when(F.col("component_kind") == kind, F.array(*listed))

    needs = F.coalesce(
        wanted("calculation_check", CALCULATION_REQUIREMENTS), wanted("scientific_check", QUESTION_REQUIREMENTS)
    )
    rows = components.select("component_id", "component_kind", F.inline(needs))
    found = (
        cases.select(F.explode("component_refs").alias("component_id"), "case_role")
        .groupBy("component_id", "case_role")
        .agg(F.count("*").alias("n"))
    )
    per_role = rows.select("component_id", "component_kind", "requirement", F.explode("roles").alias("case_role"))
    satisfied = (
        per_role.join(found, ["component_id", "case_role"], "left")
        .groupBy("component_id", "component_kind", "requirement")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cases"))
    )
    # A component has at most six requirements, so this window is six rows wide.
    whole = Window.partitionBy("component_id")
    return satisfied.withColumn("satisfied", F.col("cases") > 0).withColumn(
        "component_complete", F.every("satisfied").over(whole)
    )


ASSESSMENT_KINDS = ("finding", "conditional_concern", "material_question", "disclosure")


def assessment_delta(before: DataFrame, after: DataFrame, case: str, kind: str) -> DataFrame:
    """Counts of the four assessment kinds per case before and after, and their difference."""
    tagged = before.select(case, kind, F.lit(-1).alias("s")).unionByName(after.select(case, kind, F.lit(1).alias("s")))
    columns = []
    for k in ASSESSMENT_KINDS:
        at = F.col(kind) == k
        columns += [
            F.count_if(at & (F.col("s") < 0)).alias(f"{k}_before"),
            F.count_if(at & (F.col("s") > 0)).alias(f"{k}_after"),
            F.coalesce(F.sum(F.when(at, F.col("s"))), F.lit(0)).alias(f"{k}_delta"),
        ]
    return tagged.groupBy(case).agg(*columns)


def regression_compare(expected: DataFrame, observed: DataFrame, expected_items: DataFrame, observed_items: DataFrame) -> DataFrame:
    """The first regression class of each case, in a fixed order; null when nothing changed.

    Sides: case_id, findings, concerns, executions, model_calls, final_state.  Items: case_id,
    plane (question, disclosure or observation), key, ceiling, applicability, outcome.
    """
    keyed = ["case_id", "plane", "key"]
    surplus = multiset_difference(expected_items, observed_items, keyed).groupBy("case_id").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("plane") == p, F.col(f"{side}_surplus"))), F.lit(0)).alias(f"{p}_{side}")
            for p in ("question", "disclosure", "observation")
            for side in ("left", "right")
        ]
    )
    pair = expected_items.where("plane = 'observation'").select(
        "case_id", "key", *[F.col(c).alias(f"e_{c}") for c in ("ceiling", "applicability", "outcome")]
    ).join(
        observed_items.where("plane = 'observation'").select(
            "case_id", "key", *[F.col(c).alias(f"o_{c}") for c in ("ceiling", "applicability", "outcome")]
        ),
        ["case_id", "key"],
    )
    differs = lambda c: ~F.col(f"e_{c}").eqNullSafe(F.col(f"o_{c}"))
    # The first differing check in id order decides, as one ordered struct minimum per case.
    change = (
        F.when(differs("ceiling"), F.lit("changed output ceiling"))
        .when(differs("applicability"), F.lit("applicability changed"))
        .when(differs("outcome"), F.lit("calculation comparison outcome changed"))
    )
    changed = (
        pair.withColumn("_c", change)
        .where(F.col("_c").isNotNull())
        .groupBy("case_id")
        .agg(F.min(F.struct("key", "_c")).alias("_first"))
        .select("case_id", F.col("_first._c").alias("_change"))
    )
    e = expected.select("case_id", *[F.col(c).alias(f"e_{c}") for c in expected.columns if c != "case_id"])
    joined = e.join(observed, "case_id").join(surplus, "case_id", "left").join(changed, "case_id", "left")
    over = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    first = (
        F.when(F.col("findings") > F.col("e_findings"), F.lit("unexpected Finding"))
        .when(F.col("concerns") > F.col("e_concerns"), F.lit("unexpected ConditionalConcern"))
        .when(over("question_left"), F.lit("lost question"))
        .when(over("question_right"), F.lit("new false question"))
        .when(over("disclosure_left"), F.lit("missing Disclosure"))
        .when(over("disclosure_right"), F.lit("new Disclosure"))
        .when(over("observation_left") | over("observation_right"), F.lit("calculation observation inventory changed"))
        .when(F.col("_change").isNotNull(), F.col("_change"))
        .when(F.col("executions") != 0, F.lit("project execution detected"))
        .when(F.col("model_calls") != 0, F.lit("model access detected"))
        .when(~F.col("final_state").eqNullSafe(F.col("e_final_state")), F.lit("final audit state changed"))
        .when(
            (F.col("findings") != F.col("e_findings")) | (F.col("concerns") != F.col("e_concerns")),
            F.lit("assessment counts changed"),
        )
    )
    return joined.select("case_id", first.alias("regression"))


def resource_rollup(reads: DataFrame, reuse: DataFrame, clocks: DataFrame, run: str) -> DataFrame:
    """Bytes, time and cache use per run.

    ``reads``: run, bytes, is_sampled.  ``reuse``: run, reuse.  ``clocks``: run, active_seconds,
    paused_seconds.
    """
    io = reads.groupBy(run).agg(
        F.sum(F.when(~F.col("is_sampled"), F.col("bytes")).otherwise(0)).alias("source_bytes"),
        F.sum(F.when(F.col("is_sampled"), F.col("bytes")).otherwise(0)).alias("sampled_bytes"),
    )
    cache = reuse.groupBy(run).agg(
        *[F.count_if(F.col("reuse") == k).alias(k) for k in ("hit", "miss", "invalidated", "uncacheable")]
    )
    time = clocks.groupBy(run).agg(
        F.greatest(F.sum("active_seconds"), F.lit(0.0)).alias("active_seconds"),
        F.greatest(F.sum("paused_seconds"), F.lit(0.0)).alias("paused_seconds"),
    )
    joined = io.join(cache, run, "full_outer").join(time, run, "full_outer")
    return joined.na.fill(0)


def threshold_gate(metrics: DataFrame, counts: DataFrame, requirements: DataFrame, minimums: DataFrame) -> DataFrame:
    """Every requirement of every policy with whether it holds, and whether the policy passes.

    ``metrics``: set_id, metric_name, estimate, lower, upper, status.  ``counts``: set_id,
    count_name, value.  ``requirements``: policy_id, set_id, metric_name, statistic, operator,
    threshold, need_interval.  ``minimums``: policy_id, set_id, count_name, comparison
    ('at_least' or 'equals'), required.
    """
    value = (
        F.when(F.col("statistic") == "estimate", F.col("estimate"))
        .when(F.col("statistic") == "interval_lower", F.col("lower"))
        .when(F.col("statistic") == "interval_upper", F.col("upper"))
    )
    inside = value.between(0, 1) & F.col("threshold").between(0, 1)
    meets = (
        F.when(F.col("operator") == "at_most", value <= F.col("threshold"))
        .when(F.col("operator") == "at_least", value >= F.col("threshold"))
    )
    estimable = ~F.col("need_interval") | (F.col("status") == "estimated")
    rated = requirements.join(metrics, ["set_id", "metric_name"], "left").select(
        "policy_id",
        F.concat_ws(":", "metric_name", "statistic").alias("requirement"),
        F.coalesce(inside & meets & estimable, F.lit(False)).alias("holds"),
    )
    counted = minimums.join(counts, ["set_id", "count_name"], "left").select(
        "policy_id",
        F.concat(F.lit("count:"), "count_name").alias("requirement"),
        F.coalesce(
            F.when(F.col("comparison") == "equals", F.col("value") == F.col("required")).otherwise(
                (F.col("required") >= 1) & (F.col("value") >= F.col("required"))
            ),
            F.lit(False),
        ).alias("holds"),
    )
    every = rated.unionByName(counted)
    verdict = every.groupBy("policy_id").agg(F.every("holds").alias("policy_passes"))
    return every.join(verdict, "policy_id")
