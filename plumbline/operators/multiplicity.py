"""Benjamini-Hochberg over any number of families of any size, and checks built on it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.contracts import MultiplicityContract
from plumbline.functions import exact as E
from plumbline.operators import validate as V
from plumbline.outcomes import APPLICABLE, UNSUPPORTED, outcome_of
from plumbline.session import cut_lineage
from plumbline.skew import attach, dealt, per_key, running, spread, with_blocks

#: Rows of one family that one task scans: its windows hold up to two KB a row.
ROWS_PER_BLOCK = 500_000


def key_digits(df: DataFrame, number: str) -> int:
    """Digits that a key of exact quotients needs, by the longest of the parsed numbers."""
    longest = df.agg(F.max(F.length(F.col(number)["digits"]))).head()[0]
    return E.digits_for(longest or 1)


def bh_levels(
    df: DataFrame, family: Sequence[str], p: str, *, digits: int | None = None, weight: str | None = None,
    rows_per_block: int = ROWS_PER_BLOCK, rows: int | None = None,
) -> DataFrame:
    """One row per (family, distinct p): tests at p, rank, family size and the step that sets
    the adjusted value, ``min(best_p * family_size / best_rank, 1)``.

    Equal p-values share one adjusted value, so only distinct values are ranked; the rank is
    the one of the last of the ties, which gives the smallest ratio.  With ``digits`` the p-values are
    numbers of :mod:`plumbline.functions.exact` and ratios are compared exactly; without, they are doubles.
    ``weight`` names a column that says how many tests a row stands for, ``rows`` is the number of rows if it is known.
    """
    family = list(family)
    approximate = E.double_of(F.col(p)) if digits else F.col(p).cast("double")
    n_tests = (F.sum(weight) if weight else F.count("*")).alias("n_tests")
    levels = per_key(df, [*family, p], rows, [n_tests], [F.sum("n_tests").alias("n_tests")]).withColumn("_d", approximate)
    blocked, blocks = with_blocks(levels, "_d", rows_per_block, group=family)
    n_levels = blocked.count()
    blocked = dealt(blocked, family if blocks == 1 else [*family, "_block"], n_levels)
    ranked = running(blocked, blocks, family, [F.col(p)], F.col("n_tests"), "sum", "rank")
    if digits:
        stepped = _least_ratios(ranked, blocks, family, p, digits, n_levels)
    else:
        step = F.struct((F.col(p) / F.col("rank")).alias("q"), F.col(p).alias("p"), F.col("rank").alias("r"), F.col("_d").alias("d"))
        stepped = running(ranked, blocks, family, [F.col(p)], step, "min", "_step", descending=True)
    size = blocked.groupBy(*family).agg(F.sum("n_tests").alias("family_size"))
    return stepped.join(size, family).select(
        *family,
        p,
        "n_tests",
        "rank",
        "family_size",
        F.col("_step.p").alias("best_p"),
        F.col("_step.r").alias("best_rank"),
        F.col("_step.d").alias("best_double"),
    )


def _least_ratios(ranked: DataFrame, blocks: int, family: list[str], p: str, size: int, n_levels: int) -> DataFrame:
    """Add ``_step``, the level of least ``p / rank`` from each level upwards, exactly.

    Read from the largest p down, a level is a clear record if its ratio lies under all before by the bounds of
    doubles, clearly none if it lies over the least, else contested.  A contested level can only meet the last clear
    record and the contested ones since; only these get the digits of their ratios.
    """
    def scan(df: DataFrame, value: Column, kind: str, out: str, **how) -> DataFrame:
        return running(df, blocks, family, [F.col(p)], value, kind, out, **how)

    ratio = F.col("_d") / F.col("rank")
    seen = scan(ranked, ratio, "min", "_above", descending=True, inclusive=False)
    record = F.col("_above").isNull() | (E.most_of(ratio) < E.least_of(F.col("_above")))
    contested = ~record & (E.least_of(ratio) <= E.most_of(F.col("_above")))
    seen = seen.withColumns({"_record": record, "_contested": contested})
    seen = scan(seen, F.when(F.col("_record"), ratio), "min", "_last", descending=True)
    event = F.when(F.col("_record") | F.col("_contested"), F.struct(F.col(p).alias("p"), F.col("_contested").alias("contested")))
    seen = scan(seen, event, "max", "_next", inclusive=False)
    if blocks == 1:
        seen = dealt(seen.repartition(*family, p), [*family, p], n_levels)  # a family's digits are not spelt in the one task that scans it
    spelt = F.col("_contested") | (F.col("_record") & F.coalesce(F.col("_next.contested"), F.lit(False)))
    seen = seen.withColumn("_digits", E.quotient_key(F.when(spelt, F.col(p)), F.col("rank"), size))
    step = F.struct(F.col("_last").alias("q"), F.col("_digits").alias("digits"), F.col(p).alias("p"), F.col("rank").alias("r"), F.col("_d").alias("d"))
    if blocks == 1:
        seen = dealt(seen, family, n_levels)
    return scan(seen, F.when(F.col("_record") | F.col("_contested"), step), "min", "_step", descending=True)


def adjusted_value(best_p: Column) -> Column:
    return F.least(best_p.cast("double") * F.col("family_size") / F.col("best_rank"), F.lit(1.0))


def bh_adjust(df: DataFrame, family: Sequence[str], p: str, **options) -> DataFrame:
    """All rows with ``applicability``, ``rank`` (of the last tie) and ``adjusted``.

    A family with a p-value that is null, not a number or outside [0, 1] is unsupported as a whole: its rows have no
    rank and no adjusted value, and no other family is affected.
    """
    family = list(family)
    number = F.col(p).try_cast("double")
    sound = F.coalesce(number.between(0, 1) & ~F.isnan(number), F.lit(False))
    rows = df.withColumn("_p", F.when(sound, number))
    state = rows.groupBy(*family).agg(
        F.count("*").alias("_rows"),
        F.when(F.count("_p") == F.count("*"), F.lit(APPLICABLE)).otherwise(F.lit(UNSUPPORTED)).alias("applicability"),
    )
    judged = attach(rows, state, family, "_rows").drop("_rows")
    judged = judged.withColumn("_p", F.when(F.col("applicability") == APPLICABLE, F.col("_p")))
    levels = bh_levels(judged.where(F.col("_p").isNotNull()), family, "_p", **options)
    levels = levels.withColumn("adjusted", adjusted_value(F.col("best_p")))
    levels = levels.drop("family_size", "best_p", "best_rank", "best_double")
    return attach(judged, levels, [*family, "_p"], "n_tests").drop("n_tests", "_p")


def _best_against(number: Column, double: Column) -> Column:
    """-1, 0 or 1: the adjusted value before it is capped at 1, ``best_p * family_size / best_rank``, against a number."""
    return E.compare_quotients(F.col("best_p"), F.col("best_rank"), F.col("best_double"), number, F.col("family_size"), double)


def _with_cap(levels: DataFrame) -> DataFrame:
    """Add ``capped``: the adjusted value is 1."""
    return levels.withColumn("capped", _best_against(E.literal("1"), F.lit(1.0)) >= 0)


def _at_most(alpha: str) -> Column:
    """The adjusted value is at most ``alpha``."""
    below = _best_against(E.literal(alpha), F.lit(float(alpha))) <= 0
    return F.when(F.col("capped"), F.lit(Decimal(alpha) >= 1)).otherwise(below)


def with_differences(judged: DataFrame, reported: str, scale: int | None, out: str) -> DataFrame:
    """Add ``out``: the number ``reported`` differs from ``min(best_p * m / r, 1)``, exactly.

    With ``scale`` the report counts as equal when it is the adjusted value rounded half up to that many decimals; a
    report of more than 36 decimals is no rounded one.  The rows have what :func:`bh_levels` gives, and ``capped``.
    """
    capped, number = F.col("capped"), F.col(reported)
    if scale is None:
        differs = F.when(capped, number != E.literal("1")).otherwise(_best_against(number, E.double_of(number)) != 0)
        return judged.withColumn(out, differs)
    half = F.lit(Decimal(5).scaleb(-scale - 1)).cast("decimal(37,36)")
    short = (number["digits"] == "") | (F.length(number["digits"]) - number["exponent"] <= 36)
    stated = E.text_of(number).cast("decimal(37,36)")
    bounded = judged.withColumns({"_low": F.when(short, stated - half), "_high": F.when(short, stated + half)})
    low, high = F.col("_low"), F.col("_high")
    over = (low <= 0) | (_best_against(E.parse(low), low.cast("double")) >= 0)
    under = _best_against(E.parse(high), high.cast("double")) < 0
    same = F.when(capped, high > 1).otherwise(over & under)
    return bounded.withColumn(out, ~F.coalesce(same, F.lit(False))).drop("_low", "_high")


def bh_recheck_rows(
    df: DataFrame, contract: MultiplicityContract, *, reported_scale: int | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """(gate, rows): family verdicts, and the recomputed rows of families that pass."""
    c = contract
    bound = V.bind_columns(
        df, {"family": c.family, "test_id": c.test_id, "raw": c.raw, "reported": c.adjusted, "call": c.call}
    )
    # Cells are parsed once; the rules, the gate, the ranking and the comparison read the written numbers.
    parsed = cut_lineage(
        spread(bound).select("family", "test_id", E.parse(F.col("raw")).alias("raw"), E.parse(F.col("reported")).alias("reported"), "call")
    )
    rules = [
        V.nonempty("test_id"),
        V.unit_number("raw", F.col("raw")),
        V.unit_number("reported", F.col("reported")),
        V.boolean_text("call"),
    ]
    typed = V.validate_cells(parsed, rules).withColumn("reported_call", F.lower(F.col("call").cast("string")) == "true").drop("call")
    gate = cut_lineage(V.family_gate(typed, ["family"], ["test_id"]))
    state = gate.select("family", "n_rows", "applicability")
    good = attach(typed.drop("reasons"), state, ["family"], "n_rows").where(F.col("applicability") == APPLICABLE)
    good = good.select("family", "test_id", "raw", "reported", "reported_call")
    levels = _with_cap(bh_levels(good, ["family"], "raw", digits=key_digits(typed, "raw"), **options))
    levels = levels.withColumns(
        {"adjusted": adjusted_value(E.text_of(F.col("best_p"))), "recomputed_call": _at_most(str(c.alpha))}
    )
    # Rows of one p-value and one reported value get one comparison.
    said = cut_lineage(good.groupBy("family", "raw", "reported").agg(F.count("*").alias("_n")))
    judged = with_differences(said.join(levels, ["family", "raw"]), "reported", reported_scale, "adjusted_differs").select(
        "family", "raw", "reported", "_n", "adjusted", "recomputed_call", "adjusted_differs"
    )
    rows = attach(good, judged, ["family", "raw", "reported"], "_n").drop("_n")
    return gate, rows.withColumn("call_differs", F.col("reported_call") != F.col("recomputed_call"))


def bh_check(df: DataFrame, contract: MultiplicityContract, **options) -> DataFrame:
    """One verdict per family: reported adjusted values and calls against recomputed ones."""
    gate, rows = bh_recheck_rows(df, contract, **options)
    counts = rows.groupBy("family").agg(
        F.count_if("reported_call").alias("reported_discoveries"),
        F.count_if("recomputed_call").alias("recomputed_discoveries"),
        F.count_if("adjusted_differs").alias("adjusted_mismatches"),
        F.count_if("call_differs").alias("call_mismatches"),
    )
    clean = (F.col("adjusted_mismatches") == 0) & (F.col("call_mismatches") == 0)
    return gate.join(counts, "family", "left").withColumn(
        "comparison_outcome", outcome_of(F.col("applicability"), clean)
    )


def ranked_together(df: DataFrame, family: Sequence[str], units: str, scopes: Mapping[str, Column]) -> DataFrame:
    """Add to each row, for each scope (name -> which rows are in it), what :func:`bh_levels` gives its level:
    ``<name>_size``, the family's tests, and ``<name>_step``, the ``best`` number and ``rank`` that set the adjusted value.

    A family is ranked as a whole where it is: no more than MOST_DIVISOR rows, numbers as longs.  Rows that are dealt by
    family are not shuffled again.  A step is that of a row's own level only if the row is in the scope or shares a level.
    """
    up = Window.partitionBy(*family).orderBy(units)
    down = Window.partitionBy(*family).orderBy(F.col(units).desc())
    whole = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = {f"{name}_rank": F.count(F.when(inside, 1)).over(up) for name, inside in scopes.items()}
    seen |= {f"{name}_size": F.count(F.when(inside, 1)).over(whole) for name, inside in scopes.items()}
    ranked = df.withColumns(seen)
    steps = {}
    for name, inside in scopes.items():
        best, rank = F.col(units), F.col(f"{name}_rank")
        step = F.struct(E.quotient_order(best, rank).alias("ratio"), best.alias("best"), rank.alias("rank"))
        steps[f"{name}_step"] = F.min(F.when(inside, step)).over(down)
    return ranked.withColumns(steps).drop(*[f"{name}_rank" for name in scopes])


def _differs_in_units(scope: str, stated: Column, scale: int | None) -> Column:
    """What :func:`with_differences` tells, of numbers in units."""
    one = 10**E.UNIT_PLACES

    def wide(value: Column) -> Column:
        return value.cast("decimal(19,0)")

    def times(value: Column, count: Column) -> Column:
        return value * count.cast("decimal(10,0)")

    step = F.col(f"{scope}_step")
    total, rank = times(wide(step["best"]), F.col(f"{scope}_size")), step["rank"]
    capped = total >= times(wide(F.lit(one)), rank)
    if scale is None:
        return F.when(capped, stated != one).otherwise(total != times(wide(stated), rank))
    half = 5 * 10 ** (E.UNIT_PLACES - scale - 1)
    low, high = stated - half, stated + half
    return ~F.when(capped, high > one).otherwise(((low <= 0) | (total >= times(wide(low), rank))) & (total < times(wide(high), rank)))


def correction_scope(
    df: DataFrame, family: Sequence[str], test_id: str, p: str, asserted: str, *, scale: int | None = None,
    rows_per_block: int = ROWS_PER_BLOCK, together: bool = False,
) -> DataFrame:
    """Was the correction run over the complete family or only over the corrected rows?

    Rows with a null ``asserted`` value were not corrected.  BH is recomputed over both scopes
    and compared with the asserted values.  A family with a bad p-value, a bad asserted value, or a
    repeated test is unsupported: it has no scope, and its reason is given.

    Families of up to ``rows_per_block`` rows are judged where they are after one shuffle, in whole numbers.  Larger
    ones, and those with a number of more than 18 decimals, are ranked by level in blocks.  ``together`` says that the
    rows are dealt by family already and that no family is larger; the rows are then not written or dealt again.
    """
    family = list(family)
    parsed = df.select(
        *family, test_id, E.parse(F.col(p)).alias("p"), E.parse(F.col(asserted)).alias("asserted"), F.col(asserted).isNotNull().alias("_given")
    )
    asserted_cell = F.when(F.col("_given"), V.unit_number(asserted, F.col("asserted")))
    rules = [V.nonempty(test_id), V.unit_number(p, F.col("p")), asserted_cell]

    def by_level(rows: DataFrame) -> DataFrame:
        typed = V.validate_cells(cut_lineage(rows), rules, "_reasons").drop("_given")
        return _scope_by_level(typed, family, test_id, scale, rows_per_block)

    if scale is not None and scale >= E.UNIT_PLACES:
        return by_level(parsed)
    found, light = [], parsed
    if not together:
        parsed = cut_lineage(parsed)
        sizes = cut_lineage(parsed.groupBy(*family).agg(F.count("*").alias("_n")))
        rows, largest = sizes.agg(F.sum("_n"), F.max("_n")).head()
        most, light = min(rows_per_block, E.MOST_DIVISOR), parsed
        if (largest or 0) > most:
            found.append(sizes.where(F.col("_n") > most).select(*family))
            light = _of_families(parsed, found[0], family, "left_anti")
        light = dealt(light, family, rows)
    judged = cut_lineage(_scope_together(V.validate_cells(light, rules, "_reasons"), family, test_id, scale))
    long = judged.where("_long").select(*family)
    if not long.isEmpty():
        found.append(long)
    judged = judged.where("NOT _long").drop("_long")
    if not found:
        return judged
    return judged.unionByName(by_level(_of_families(parsed, reduce(DataFrame.unionByName, found), family, "left_semi")))


def _of_families(rows: DataFrame, some: DataFrame, family: list[str], how: str) -> DataFrame:
    """Rows of some families, one without a name included, or of the others."""
    some = some.select([F.col(f).alias(f"_{i}") for i, f in enumerate(family)])
    return rows.join(some, reduce(Column.__and__, [F.col(f).eqNullSafe(F.col(f"_{i}")) for i, f in enumerate(family)]), how)


def _scope(state: Column) -> Column:
    return (
        F.when(state != APPLICABLE, F.lit(None))
        .when(F.col("corrected_rows") == 0, F.lit("none"))
        .when((F.col("full_mismatches") == 0), F.lit("complete"))
        .when(F.col("subset_mismatches") == 0, F.lit("subset"))
        .otherwise(F.lit("mismatch"))
    )


def _scope_together(typed: DataFrame, family: list[str], test_id: str, scale: int | None) -> DataFrame:
    """Verdicts of families that are judged where they are; ``_long`` if a number has more decimals than units tell."""
    p, asserted = F.col("p"), F.col("asserted")
    rows = typed.select(
        *family, F.col(test_id).alias("_id"), E.units_of(p).alias("_p"), E.units_of(asserted).alias("_q"), "_given",
        F.try_element_at("_reasons", F.lit(1)).alias("_why"),
        ((E.in_unit(p) & E.units_of(p).isNull()) | (E.in_unit(asserted) & E.units_of(asserted).isNull())).alias("_far"),
    )
    by_id = Window.partitionBy(*family).orderBy("_id")
    rows = rows.withColumn("_again", F.col("_id") == F.lag("_id").over(by_id)).drop("_id")
    ranked = ranked_together(rows, family, "_p", {"full": F.lit(True), "part": F.col("_given")})

    def misses(scope: str) -> Column:
        return F.sum(F.when(F.col("_given"), F.when(_differs_in_units(scope, F.col("_q"), scale), F.lit(1)).otherwise(F.lit(0))))

    sums = ranked.groupBy(*family).agg(
        F.min("_why").alias("_why"), F.bool_or("_again").alias("_again"), F.bool_or("_far").alias("_far"),
        F.count("*").alias("family_rows"), F.count_if("_given").alias("corrected_rows"),
        misses("full").alias("full_mismatches"), misses("part").alias("subset_mismatches"),
    )
    reason = F.coalesce("_why", F.when(F.col("_again"), F.lit("identifiers are duplicated")))
    sums = sums.withColumn("reason", reason).withColumn(
        "applicability", F.when(F.col("reason").isNull(), F.lit(APPLICABLE)).otherwise(F.lit(UNSUPPORTED))
    )
    sound = F.col("applicability") == APPLICABLE
    counts = ["family_rows", "corrected_rows", "full_mismatches", "subset_mismatches"]
    return sums.select(
        *family, "applicability", "reason", *[F.when(sound, F.col(c)).alias(c) for c in counts],
        _scope(F.col("applicability")).alias("scope"), (sound & F.col("_far")).alias("_long"),
    )


def _scope_by_level(typed: DataFrame, family: list[str], test_id: str, scale: int | None, rows_per_block: int) -> DataFrame:
    """Verdicts of families of any size and numbers of any length."""
    rows = typed.count()
    gate = cut_lineage(V.family_gate(typed, family, [test_id], "_reasons", rows=rows))
    digits = key_digits(typed, "p")
    state = gate.select(*family, "n_rows", "applicability")
    exact = attach(typed.drop("_reasons"), state, family, "n_rows").where(F.col("applicability") == APPLICABLE)
    per_value = cut_lineage(per_key(exact, [*family, "p", "asserted"], rows, [F.count("*").alias("n")], [F.sum("n").alias("n")]))
    n_values = per_value.count()
    # The levels need no more than how often each p-value stands in each scope.
    full = bh_levels(per_value, family, "p", digits=digits, weight="n", rows=n_values, rows_per_block=rows_per_block)
    corrected = per_value.where(F.col("asserted").isNotNull())
    part = bh_levels(corrected, family, "p", digits=digits, weight="n", rows=n_values, rows_per_block=rows_per_block)

    def misses(levels: DataFrame, out: str) -> DataFrame:
        steps = dealt(_with_cap(levels).drop("n_tests", "rank"), [*family, "p"], n_values)
        joined = corrected.join(steps, [*family, "p"])
        judged = with_differences(joined, "asserted", scale, "_wrong")
        return judged.groupBy(*family).agg(F.sum(F.when(F.col("_wrong"), F.col("n")).otherwise(0)).alias(out))

    sizes = per_value.groupBy(*family).agg(
        F.sum("n").alias("family_rows"), F.sum(F.when(F.col("asserted").isNotNull(), F.col("n")).otherwise(0)).alias("corrected_rows")
    )
    return (
        gate.select(*family, "applicability", "reason")
        .join(sizes, family, "left")
        .join(misses(full, "full_mismatches"), family, "left")
        .join(misses(part, "subset_mismatches"), family, "left")
        .withColumn("scope", _scope(F.col("applicability")))
    )
