"""Repeated units, dependence decisions, design integrity and aliasing."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.contracts import ContractError, DesignContract
from plumbline.outcomes import APPLICABLE, UNSUPPORTED, outcome_of
from plumbline.session import cut_lineage
from plumbline.skew import HEAVY_PARTS, ROWS_PER_TASK, attach, dealt, per_key

# The safeguards a dependence case must have looked for.
SAFEGUARDS = (
    "safeguard:unit-level-aggregation",
    "safeguard:grouped-random-effects",
    "safeguard:cluster-correlated-estimation",
    "safeguard:cluster-adjusted-uncertainty",
    "safeguard:paired-or-blocked-procedure",
    "safeguard:unit-level-resampling",
    "safeguard:registered-dependence-aware-procedure",
)
# Evidence dimensions of a dependence case.
DIMENSIONS = (
    "unit_definition",
    "membership",
    "analysis_input",
    "separate_entry",
    "procedure",
    "row_independence",
    "affected_target",
)
# Equations over 0 and 1 are solved in this field; an answer differs from that over the rationals only where the prime
# divides a subdeterminant.
PRIME = (1 << 61) - 1
#: Equations reduced in one task before parts of a case meet, and parts that meet at once.
EQUATIONS_PER_TASK = 200_000
PARTS_TOGETHER = 8
#: Buckets in which the cells of levels are counted, to tell levels that could fill a task.
LEVEL_BUCKETS = 1 << 16


def unit_counts(df: DataFrame, keys: Sequence[str], case: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    observations = "observations"
    return per_key(df, [*case, *keys], rows, [F.count("*").alias(observations)], [F.sum(observations).alias(observations)])


def unit_multiplicity(df: DataFrame, keys: Sequence[str], case: Sequence[str] = (), *, rows: int | None = None) -> DataFrame:
    """Nominal and effective N: exact keys, no trimming; one empty key stops the case.  ``rows`` is the number of rows if known."""
    empty = F.lit(False)
    for key in keys:
        empty = empty | F.col(key).isNull() | (F.col(key).cast("string") == "")
    counts = unit_counts(df, keys, case, rows)
    return (
        counts.groupBy(*case)
        .agg(
            F.sum("observations").alias("nominal_n"),
            F.count("*").alias("effective_n"),
            F.count_if(F.col("observations") > 1).alias("repeated_units"),
            F.max("observations").alias("largest_unit"),
            F.some(empty).alias("_empty"),
        )
        .withColumn("applicability", F.when(F.col("_empty"), F.lit(UNSUPPORTED)).otherwise(F.lit(APPLICABLE)))
        .drop("_empty")
    )


def dependence_decision(cases: DataFrame, units: DataFrame, safeguards: DataFrame, *, n_cases: int | None = None) -> DataFrame:
    """Outcome and reason of each case, from the first rule of the ladder that holds.

    ``cases``: case_id, one ``<dimension>_state`` per dimension, analysis_target, procedure_ref,
    unit_definition, affected_target_ref, output_ceiling, unresolved (count), unsupported (count).
    ``units``: case_id, repeated_units (see :func:`unit_multiplicity`).
    ``safeguards``: case_id, safeguard_id, state, analysis_target, procedure_ref, unit_definition.
    ``n_cases``: the number of cases if it is known; they are dealt by it.
    """
    cases = dealt(cases, ["case_id"], n_cases)
    binding = ["analysis_target", "procedure_ref", "unit_definition"]
    own = cases.select("case_id", *[F.col(b).alias(f"_own_{b}") for b in binding])
    unbound = F.lit(False)
    for b in binding:
        unbound = unbound | ~F.col(b).eqNullSafe(F.col(f"_own_{b}"))
    which = F.lit(None).cast("int")
    for i, safeguard in enumerate(SAFEGUARDS):
        which = F.when(F.col("safeguard_id") == safeguard, F.lit(1 << i)).otherwise(which)
    # Checks of one binding are counted before they meet their case: one row, not one for each safeguard.
    bound = (
        safeguards.where(F.col("safeguard_id").isin(*SAFEGUARDS))
        .groupBy("case_id", *binding)
        .agg(
            F.bit_or(which).alias("_which"),
            F.count("*").alias("_checks"),
            F.count_if(F.col("state") == "unsupported").alias("_unsupported"),
            F.count_if(F.col("state") == "unknown").alias("_unknown"),
            F.count_if(F.col("state") == "present").alias("safeguards_present"),
        )
    )
    checks = (
        bound.join(own, "case_id")
        .groupBy("case_id")
        .agg(
            F.bit_count(F.bit_or("_which")).alias("safeguards_checked"),
            F.sum("_unsupported").alias("_unsupported"),
            F.sum("_unknown").alias("_unknown"),
            F.sum(F.when(unbound, F.col("_checks")).otherwise(0)).alias("_unbound"),
            F.sum("safeguards_present").alias("safeguards_present"),
        )
    )
    joined = cases.join(units.select("case_id", "repeated_units"), "case_id", "left").join(checks, "case_id", "left")

    def state(dimension: str, value: str) -> Column:
        return F.col(f"{dimension}_state") == value

    def any_state(value: str, dimensions: Sequence[str] = DIMENSIONS) -> Column:
        out = F.lit(False)
        for d in dimensions:
            out = out | state(d, value)
        return out

    def not_established(dimensions: Sequence[str]) -> Column:
        out = F.lit(False)
        for d in dimensions:
            out = out | (F.col(f"{d}_state") != "established")
        return out

    def count(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    ladder: list[tuple[Column, str, str]] = [
        ((count("unsupported") > 0) | any_state("unsupported"), "unsupported", "unsupported_evidence"),
        ((count("unresolved") > 0) | any_state("unknown"), "question", "unresolved_semantics"),
        (not_established(("unit_definition", "membership")), "question", "unit_membership_not_established"),
        (count("repeated_units") == 0, "covered_negative", "one_observation_per_independent_unit"),
        (state("analysis_input", "refuted"), "covered_negative", "observations_not_bound_to_analysis"),
        (state("procedure", "refuted"), "covered_negative", "procedure_not_bound_to_analysis"),
        (count("safeguards_checked") < len(SAFEGUARDS), "question", "incomplete_safeguard_protocol"),
        (count("_unsupported") > 0, "unsupported", "unsupported_safeguard_check"),
        (count("_unknown") > 0, "question", "unresolved_safeguard_check"),
        (count("_unbound") > 0, "question", "unresolved_safeguard_binding"),
        (count("safeguards_present") > 0, "covered_negative", "applicable_safeguard_present"),
        (state("separate_entry", "refuted"), "covered_negative", "observations_not_entered_separately"),
        (state("row_independence", "refuted"), "covered_negative", "row_independence_not_used"),
        (
            not_established(("affected_target",)) | F.col("affected_target_ref").isNull(),
            "question",
            "affected_target_not_established",
        ),
        (F.col("output_ceiling") != "evaluation_candidate", "question", "output_ceiling_blocks_candidate"),
        (
            not_established(("analysis_input", "separate_entry", "procedure", "row_independence")),
            "question",
            "candidate_premise_not_established",
        ),
        (F.lit(True), "evaluation_candidate", "repeated_units_without_dependence_safeguard"),
    ]
    rank = F.lit(None).cast("int")
    for i in reversed(range(len(ladder))):
        rank = F.when(ladder[i][0], F.lit(i)).otherwise(rank)
    outcomes = F.array(*[F.lit(o) for _, o, _ in ladder])
    reasons = F.array(*[F.lit(r) for _, _, r in ladder])
    return joined.withColumn("_rule", rank).select(
        "case_id",
        F.get(outcomes, F.col("_rule")).alias("outcome"),
        F.get(reasons, F.col("_rule")).alias("reason_code"),
        count("repeated_units").alias("repeated_units"),
        count("safeguards_present").alias("safeguards_present"),
    )


def _clean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for name in dict.fromkeys(columns):
        df = df.withColumn(name, F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))))
    return df


def _any_empty(columns: Sequence[str]) -> Column:
    out = F.lit(False)
    for name in columns:
        out = out | (F.col(name).cast("string") == "")
    return out


def design_integrity(df: DataFrame, contract: DesignContract, case: Sequence[str]) -> DataFrame:
    """Per case: arms, merged aggregation groups, pairing, omitted and aliased adjustments."""
    c, case = contract, list(case)
    pairing = list(c.pairing or c.replicate)
    used = [c.condition, *c.replicate, *c.aggregation, *pairing, *c.required_adjustments]
    cells = (
        _clean(df.select(*dict.fromkeys([*case, *used])), used)
        .groupBy(*dict.fromkeys([*case, *used]))
        .agg(F.count("*").alias("_n"))
    )
    contrast = cells.where(F.col(c.condition).isin(c.reference_level, c.test_level))
    weight = F.col("_n")
    is_ref, is_test = F.col(c.condition) == c.reference_level, F.col(c.condition) == c.test_level
    totals = cells.groupBy(*case).agg(
        F.sum(weight).alias("row_count"),
        F.sum(F.when(is_ref | is_test, weight).otherwise(0)).alias("contrast_rows"),
        F.sum(F.when(is_ref, weight).otherwise(0)).alias("reference_rows"),
        F.sum(F.when(is_test, weight).otherwise(0)).alias("test_rows"),
        F.sum(F.when((is_ref | is_test) & _any_empty(c.aggregation), weight).otherwise(0)).alias(
            "missing_aggregation_rows"
        ),
        F.some((is_ref | is_test) & _any_empty(pairing)).alias("_pair_missing"),
        F.some((is_ref | is_test) & _any_empty(c.required_adjustments)).alias("_adjust_missing"),
    )

    def levels(keys: Sequence[str]) -> DataFrame:
        keys = [k for k in dict.fromkeys(keys) if k not in case]
        return contrast.where(~_any_empty(keys)).groupBy(*case, *keys).agg(
            F.countDistinct(c.condition).alias("_levels")
        )

    merged = levels(c.aggregation).groupBy(*case).agg(F.count_if(F.col("_levels") == 2).alias("merged_groups"))
    pairs = levels(pairing).groupBy(*case).agg(
        F.count_if(F.col("_levels") == 2).alias("complete_pairs"),
        F.count_if(F.col("_levels") == 1).alias("incomplete_pairs"),
    )
    omitted = sorted(set(c.required_adjustments) - set(c.fitted_fixed) - set(c.fitted_random))
    aliased = aliasing(contrast, c, case)
    joined = totals.join(merged, case, "left").join(pairs, case, "left").join(aliased, case, "left")
    zero = {n: F.coalesce(F.col(n), F.lit(0)) for n in ("merged_groups", "complete_pairs", "incomplete_pairs")}
    reason = (
        F.when(
            (F.col("reference_rows") == 0) | (F.col("test_rows") == 0), F.lit("both contrast levels must be present")
        )
        .when(F.col("_pair_missing"), F.lit("a pairing or replicate value is missing"))
        .when(F.col("_adjust_missing"), F.lit("an adjustment value is missing"))
        .when(F.col("aliased").isNull(), F.lit("aliasing is not decidable"))
    )
    shaped = joined.select(
        *case, "row_count", "contrast_rows", "reference_rows", "test_rows", "missing_aggregation_rows",
        *[column.alias(name) for name, column in zero.items()],
        (F.lit(c.mode == "unpaired") & (zero["complete_pairs"] > 0)).alias("pairing_omitted"),
        (F.lit(c.mode == "paired") & (zero["complete_pairs"] == 0)).alias("paired_unusable"),
        F.lit(",".join(omitted)).alias("omitted_adjustments"),
        F.col("aliased"),
        reason.alias("reason"),
    )
    clean = (
        (F.col("missing_aggregation_rows") == 0)
        & (F.col("merged_groups") == 0)
        & ~F.col("pairing_omitted")
        & ~F.col("paired_unusable")
        & (F.col("omitted_adjustments") == "")
        & ~F.col("aliased")
    )
    state = F.when(F.col("reason").isNull(), F.lit(APPLICABLE)).otherwise(F.lit(UNSUPPORTED))
    return shaped.withColumn("applicability", state).withColumn(
        "comparison_outcome", outcome_of(F.col("applicability"), clean)
    )


def aliasing(
    contrast: DataFrame, contract: DesignContract, case: Sequence[str], *, equations_per_task: int = EQUATIONS_PER_TASK
) -> DataFrame:
    """Is the test indicator in the span of intercept and dummy-coded adjustments, per case?

    It is if ``indicator = sum of one unknown a level`` can be solved over the distinct cells of levels.  One
    adjustment: every level holds one condition.  Two: the levels of the smaller are the nodes of a graph, the cells of
    a level of the larger are differences between them, and potentials must agree around every cycle.  More: the
    adjustment with most levels is eliminated by subtracting one cell of each level from the others, the rest by sparse
    elimination.  No number of levels is too high.  A missing level leaves its case undecided, with null.
    """
    c, case, factors = contract, list(case), list(contract.required_adjustments)
    if not factors:
        return contrast.select(*case).distinct().withColumn("aliased", F.lit(False))
    tested = (F.col(c.condition) == c.test_level).cast("int")
    levels = [F.col(f).cast("string").alias(f"_f{i}") for i, f in enumerate(factors)]
    key = case or ["_one"]
    rows = (contrast if case else contrast.withColumn("_one", F.lit(0))).select(*key, *levels, tested.alias("y"))
    named = [F.col(f"_f{i}") for i in range(len(factors))]
    gap = F.lit(False)
    for level in named:
        gap = gap | level.isNull() | (F.trim(level) == "")
    if len(factors) == 2:
        # Cases are numbered, so that a case whose own name is missing is one like others.
        rows = cut_lineage(rows)
        state = cut_lineage(rows.groupBy(*key).agg(F.bool_or(gap).alias("gap")).withColumn("_case", F.monotonically_increasing_id()))
        own = reduce(Column.__and__, [rows[k].eqNullSafe(state[k]) for k in key])
        decidable = rows.join(state.where("NOT gap"), own).where("y IS NOT NULL").select("_case", "_f0", "_f1", "y")
        broken = _broken_cycles(decidable, ["_case"], equations_per_task)
        verdict = state.join(broken.distinct().withColumn("_broken", F.lit(True)), "_case", "left")
        return verdict.select(*case, F.when(~F.col("gap"), F.col("_broken").isNull()).alias("aliased"))
    # A cell has the levels of every adjustment; how often it occurs cannot change a span.
    cells = cut_lineage(
        rows.groupBy(*key, *[f"_f{i}" for i in range(len(factors))])
        .agg(F.max("y").alias("y"), (F.max("y") != F.min("y")).alias("both"))
    )
    state = cells.groupBy(*key).agg(F.bool_or(gap).alias("gap"), F.bool_or("both").alias("both"))
    decidable = cells.join(state.where("NOT gap AND NOT both"), key, "left_semi").drop("both")
    if len(factors) == 1:
        broken = decidable.limit(0).select(*key)  # every cell is a level, so it is solved by its own unknown
    else:
        broken = _unsolvable(_differences(decidable, key, len(factors)), key, equations_per_task)
    verdict = state.join(broken.distinct().withColumn("_broken", F.lit(True)), key, "left")
    aliased = F.when(F.col("gap"), F.lit(None)).otherwise(~F.col("both") & F.col("_broken").isNull())
    return verdict.select(*case, aliased.alias("aliased"))


def _links(cells: DataFrame, key: list[str]) -> DataFrame:
    """Edges (a, b, d), ``x[a] - x[b] = d``, between the levels of one adjustment; the one with most levels is gone.

    The cells of a level say the same unknown, so each tells its difference to the one before.  Levels are dealt and
    read in order; those that could fill a task, with all that share their bucket, are compared to their least cell,
    which is attached.  A cell repeated with another ``y`` becomes an edge from a level to itself.
    """
    total, *sizes = cells.agg(F.count("*"), *[F.approx_count_distinct(F.xxhash64(*key, f)) for f in ("_f0", "_f1")]).head()
    swept, kept = ("_f0", "_f1") if sizes[0] > sizes[1] else ("_f1", "_f0")
    heavy = "true"  # what fits in one task is attached as a whole
    if total > ROWS_PER_TASK:
        cells = cells.withColumn("_bucket", F.pmod(F.xxhash64(*key, swept), F.lit(LEVEL_BUCKETS)))
        loads = cells.groupBy("_bucket").agg(F.count("*").alias("_n")).where(F.col("_n") * HEAVY_PARTS > total)
        buckets = [str(r[0]) for r in loads.select("_bucket").collect()]  # fewer than HEAVY_PARTS
        heavy = f"_bucket IN ({', '.join(buckets)})" if buckets else "false"
    in_order = Window.partitionBy(*key, swept).orderBy(kept, "y")
    light = dealt(cells.where(f"NOT ({heavy})").select(*key, swept, kept, "y"), [*key, swept], total)
    links = light.withColumn("_other", F.lag(F.struct(F.col(kept).alias("b"), "y")).over(in_order))
    if heavy != "false":
        distinct = cut_lineage(cells.where(heavy).select(*key, swept, kept, "y").distinct())
        least = distinct.groupBy(*key, swept).agg(F.min(F.struct(F.col(kept).alias("b"), "y")).alias("_other"), F.count("*").alias("_n"))
        links = links.unionByName(attach(distinct, least, [*key, swept], "_n").drop("_n"))
    links = links.where("_other IS NOT NULL")
    return links.select(*key, F.col(kept).alias("a"), F.col("_other.b").alias("b"), (F.col("y") - F.col("_other.y")).cast("long").alias("d"))


def _broken_cycles(cells: DataFrame, key: list[str], equations_per_task: int = EQUATIONS_PER_TASK) -> DataFrame:
    """Cases whose two adjustments cannot explain ``y``: potentials that differ around a cycle.

    A cell says the sum of two unknowns; with the larger adjustment gone it is a graph of differences.  In each turn a
    node with one edge is dropped, being in no cycle, and by a coin of its own a node either stays or is replaced by a
    neighbour that stays, from which it can be had back.  So the graph keeps its cycles while it shrinks by a share of
    its nodes, until one task can solve it.  Edges that end up between the same nodes with different values are the
    broken cycles.  Neighbours are only ever reduced to their minimum, so a level of any size is safe.
    """
    found: list[DataFrame] = []

    def settle(links: DataFrame, bound: int | None) -> tuple[DataFrame, int]:
        """One edge between two nodes, the larger first; cases with two that differ are done."""
        turned = links.where("a <> b OR d <> 0").select(
            *key, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), -F.col("d")).otherwise(F.col("d")).alias("d")
        )
        ends = [F.min("d").alias("d"), F.max("e").alias("e")]
        table = cut_lineage(per_key(turned.withColumn("e", F.col("d")), [*key, "a", "b"], bound, ends, ends))
        bad = cut_lineage(table.where("a = b OR d <> e").select(*key).distinct())
        if not bad.isEmpty():
            found.append(bad)
            table = cut_lineage(table.join(bad, key, "left_anti"))
        return table.drop("e"), table.count()

    table, size = settle(_links(cells, key), None)
    turn = 0
    while size > equations_per_task:
        turn += 1
        stays = [F.xxhash64(F.lit(turn), F.col(node)) % 2 == 0 for node in ("a", "b")]
        both = table.unionByName(table.select(*key, F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("d")).alias("d")))
        host = F.when(~stays[0] & stays[1], F.struct("b", "d"))
        # x[a] - x[host] = d; near the end one node has most edges, so its row is attached, not joined plainly.
        seen = [F.min("host").alias("host"), F.sum("_n").alias("_n")]
        near = cut_lineage(per_key(both.select(*key, "a", host.alias("host"), F.lit(1).alias("_n")), [*key, "a"], 2 * size, seen, seen))
        first = attach(table, near, [*key, "a"], "_n").where("_n > 1").select(
            *key, F.coalesce("host.b", "a").alias("a"), "b", (F.col("d") - F.coalesce("host.d", F.lit(0))).alias("d")
        )
        second = attach(first, near.withColumnRenamed("a", "b"), [*key, "b"], "_n").where("_n > 1").select(
            *key, "a", F.coalesce("host.b", "b").alias("b"), (F.col("d") + F.coalesce("host.d", F.lit(0))).alias("d")
        )
        table, size = settle(second, size)
    if size:
        equations = table.select(*key, F.array("a", "b").alias("terms"), F.expr("array(1L, -1L)").alias("signs"), F.col("d").alias("rhs"))
        found.append(_unsolvable(equations, key, equations_per_task))
    return reduce(DataFrame.unionByName, found) if found else table.select(*key)


def _differences(cells: DataFrame, key: list[str], n_factors: int) -> DataFrame:
    """Equations without the adjustment that has most levels: each cell less the least cell of its level.

    ``terms`` are the unknowns of the other adjustments and ``signs`` their coefficients, 1 or -1; ``rhs`` is what they
    must sum to.  Unknowns of larger adjustments sort later, so that they are eliminated first.
    """
    names = [f"_f{i}" for i in range(n_factors)]
    sizes = cells.agg(*[F.approx_count_distinct(f).alias(f) for f in names]).head()
    swept, *rest = sorted(names, key=lambda f: -sizes[f])
    unknowns = F.array(*[F.concat(F.lit(f"{len(rest) - i:03d}:"), F.col(f)) for i, f in enumerate(rest)])
    own = cells.select(*key, F.col(swept).alias("_level"), unknowns.alias("own"), F.col("y").cast("long").alias("y"))
    pivots = own.groupBy(*key, "_level").agg(F.count("*").alias("_n"), F.min(F.struct("own", "y")).alias("_least"))
    paired = attach(own, pivots, [*key, "_level"], "_n").where("own <> _least.own")
    mine, theirs = F.array_except("own", "_least.own"), F.array_except("_least.own", "own")
    return paired.select(
        *key,
        F.concat(mine, theirs).alias("terms"),
        F.concat(F.transform(mine, lambda _: F.lit(1).cast("long")), F.transform(theirs, lambda _: F.lit(-1).cast("long"))).alias("signs"),
        (F.col("y") - F.col("_least.y")).alias("rhs"),
    ).distinct()


def reduce_equations(rows: Iterable[tuple[Sequence[str], Sequence[int], int]]) -> tuple[dict[str, dict[str, int]], bool]:
    """Row echelon form of sparse equations over the field of ``PRIME`` elements, and whether they can be solved.

    A row is kept under its last unknown, with coefficient 1; the right side has the name "".
    """
    basis: dict[str, dict[str, int]] = {}
    for terms, signs, rhs in rows:
        row = {t: int(s) % PRIME for t, s in zip(terms, signs, strict=True)}
        row[""] = int(rhs) % PRIME
        while True:
            row = {t: v for t, v in row.items() if v}
            last = max(row, default=None)
            if last is None:
                break
            if last == "":
                return {}, False
            pivot = basis.get(last)
            if pivot is None:
                scale = pow(row[last], -1, PRIME)
                basis[last] = {t: v * scale % PRIME for t, v in row.items()}
                break
            factor = row[last]
            for t, v in pivot.items():
                row[t] = (row.get(t, 0) - factor * v) % PRIME
    return basis, True


def _unsolvable(equations: DataFrame, key: list[str], equations_per_task: int) -> DataFrame:
    """Cases whose equations contradict each other.

    Each part of a case is reduced to its independent equations, of which there are no more than unknowns; parts are
    then put together, some at a time, and reduced again, until a case is one part.
    """
    table = cut_lineage(equations)
    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.select(*key).schema)
    schema = f"{given}, terms array<string>, signs array<long>, rhs long, sound boolean"

    def independent(pdf: pd.DataFrame) -> pd.DataFrame:
        basis, sound = reduce_equations(zip(pdf["terms"], pdf["signs"], pdf["rhs"], strict=True))
        made = [([t for t in row if t], [v for t, v in row.items() if t], row.get("", 0), True) for row in basis.values()]
        out = pd.DataFrame(made if sound else [([], [], 1, False)], columns=["terms", "signs", "rhs", "sound"])
        for position, name in enumerate(key):
            out.insert(position, name, pdf[name].iat[0])
        return out

    parts = max(1, -(-table.count() // equations_per_task))
    table = table.withColumn("sound", F.lit(True))
    while True:
        part = F.pmod(F.xxhash64("terms", "rhs"), F.lit(parts))
        table = cut_lineage(table.groupBy(*key, part.alias("_part")).applyInPandas(independent, schema))
        if parts == 1:
            return table.where("NOT sound").select(*key).distinct()
        parts = -(-parts // PARTS_TOGETHER)


# Membership columns of the three declaration profiles, with the columns that
# name the analysed observation and the independent unit.
PRESETS = {
    "single_cell": (("cell_id", "sample_id", "participant_id"), "cell_id", "participant_id"),
    "longitudinal": (("measurement_id", "participant_id", "timepoint_id"), "measurement_id", "participant_id"),
    "nested_experiment": (
        ("observation_id", "field_id", "well_id", "specimen_id", "animal_id"),
        "observation_id",
        "animal_id",
    ),
}


def declared_units(df: DataFrame, profile: str) -> DataFrame:
    """Units of each declared case (see :func:`unit_multiplicity`) from a profile's own columns.

    ``df``: case_id and exactly the profile's membership columns.  An empty cell or an
    observation listed twice makes the case unsupported.
    """
    if profile not in PRESETS:
        raise ContractError(f"no profile named {profile}")
    columns, observation, unit = PRESETS[profile]
    if set(df.columns) != {"case_id", *columns}:
        raise ContractError(f"the {profile} profile needs exactly {', '.join(columns)}")
    listed = df.groupBy("case_id", observation).agg(
        F.count("*").alias("_n"), F.some(_any_empty(columns) | _any_null(columns)).alias("_empty"), F.min(unit).alias("_unit")
    )
    units = listed.groupBy("case_id", "_unit").agg(
        F.count("*").alias("_obs"), F.some((F.col("_n") > 1) | F.col("_empty")).alias("_bad")
    )
    return units.groupBy("case_id").agg(
        F.sum("_obs").alias("nominal_n"),
        F.count("*").alias("effective_n"),
        F.count_if(F.col("_obs") > 1).alias("repeated_units"),
        F.when(F.some("_bad"), F.lit(UNSUPPORTED)).otherwise(F.lit(APPLICABLE)).alias("applicability"),
    )


def _any_null(columns: Sequence[str]) -> Column:
    out = F.lit(False)
    for name in columns:
        out = out | F.col(name).isNull()
    return out
