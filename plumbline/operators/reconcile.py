"""Quantities stated in text: accountings that reconcile, one reading or none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import number_tokens, rate_readings
from plumbline.session import cut_lineage
from plumbline.skew import spread

# A document with more stated numbers is outside the bounded scan; the answer
# for it is "unsupported", as for the checks this follows.
MAX_DISTINCT_INTEGERS = 48
MAX_RATE_TOKENS = 32
SLACK = 1e-12


def stated_numbers(df: DataFrame, document: str, text: str) -> DataFrame:
    """Per document: distinct stated integers with how often each occurs, and stated rates.

    Columns: ``integers`` array<struct<v, n>>, ``rates`` (readings), ``decimals`` (tokens) and
    ``in_scan``, false when the document states too many numbers to be scanned completely.
    """
    tokens = spread(df.select(document, text)).select(document, number_tokens(F.col(text)).alias("tokens"))
    whole = F.transform(
        F.filter("tokens", lambda t: t["is_integer"] & ~t["is_percent"]), lambda t: t["value"].cast("long")
    )
    rates = F.filter("tokens", lambda t: ~t["is_integer"] | t["is_percent"])
    shaped = tokens.select(
        document,
        whole.alias("_whole"),
        rates.alias("_rates"),
        F.filter("tokens", lambda t: ~t["is_integer"] & ~t["is_percent"]).alias("decimals"),
    )
    counted = F.transform(
        F.array_distinct("_whole"),
        lambda v: F.struct(v.alias("v"), F.size(F.filter("_whole", lambda w: w == v)).alias("n")),
    )
    return shaped.select(
        document,
        counted.alias("integers"),
        rate_readings(F.col("_rates")).alias("rates"),
        "decimals",
        (
            (F.size(F.array_distinct("_whole")) <= MAX_DISTINCT_INTEGERS) & (F.size("_rates") <= MAX_RATE_TOKENS)
        ).alias("in_scan"),
    )


def _enough(*values: Column) -> Column:
    """Every role has its own token: a value used k times occurs at least k times."""
    checks = []
    for value in values:
        used = reduce(lambda a, b: a + b, [(other == value).cast("int") for other in values])
        checks.append(F.try_element_at("occ", value) >= used)
    return reduce(lambda a, b: a & b, checks)


def _scanned(numbers: DataFrame, document: str, least: int) -> DataFrame:
    """Documents inside the scan with their values and the occurrence map ``occ``."""
    values = F.transform(F.filter("integers", lambda t: t["v"] >= least), lambda t: t["v"])
    return numbers.where("in_scan").select(
        document, F.map_from_entries("integers").alias("occ"), values.alias("vals"), "rates", "decimals"
    )


def _accountings(numbers: DataFrame, document: str) -> DataFrame:
    """Every N = M + K with an event count E <= M, each role from its own token.

    The sum is looked up in the document's own value map, so nothing is shuffled and only
    readings that add up become rows.
    """

    def splits(n: Column) -> Column:
        fits = F.filter("vals", lambda m: (m < n) & F.map_contains_key("occ", n - m))
        return F.transform(fits, lambda m: F.struct(n.alias("complete"), m.alias("retained"), (n - m).alias("removed")))

    quads = (
        _scanned(numbers, document, 1)
        .withColumn("_n", F.explode("vals"))
        .withColumn("_t", F.explode(splits(F.col("_n"))))
        .select("*", "_t.*")
        .withColumn("events", F.explode(F.filter("vals", lambda e: e <= F.col("_t.retained"))))
    )
    return quads.where(_enough(*[F.col(c) for c in ("complete", "retained", "removed", "events")]))


def quantity_interpretations(numbers: DataFrame, document: str) -> DataFrame:
    """Accountings with a stated rate equal to E/M or to E/N, but not to both."""

    def ratio_gap(r: Column, base: str) -> Column:
        return F.abs(r["rate"] - F.col("events") / F.col(base)) <= r["tolerance"] + SLACK

    rated = _accountings(numbers, document).withColumn(
        "r",
        F.explode(F.filter("rates", lambda r: ratio_gap(r, "retained") != ratio_gap(r, "complete"))),
    )
    return rated.select(
        document,
        "complete",
        "retained",
        "removed",
        "events",
        F.col("r.raw").alias("rate_text"),
        F.when(ratio_gap(F.col("r"), "retained"), F.lit("retained")).otherwise(F.lit("complete")).alias("denominator"),
    )


def quantity_reconcile(df: DataFrame, document: str, text: str) -> DataFrame:
    """One row per document: the denominator its stated rate uses, when exactly one is read."""
    numbers = cut_lineage(stated_numbers(df, document, text))
    per_doc = (
        quantity_interpretations(numbers, document)
        .groupBy(document)
        .agg(
            F.count("*").alias("readings"),
            F.count_distinct("denominator").alias("_operands"),
            F.count_distinct("complete", "retained", "removed", "events").alias("_accounts"),
            *[F.min(c).alias(c) for c in ("complete", "retained", "removed", "events", "denominator")],
        )
    )
    one = (F.col("_operands") == 1) & (F.col("_accounts") == 1)
    state = (
        F.when(~F.col("in_scan"), F.lit("unsupported"))
        .when(F.col("readings").isNull(), F.lit("not_applicable"))
        .when(one, F.lit("applicable"))
        .otherwise(F.lit("ambiguous"))
    )
    joined = numbers.select(document, "in_scan").join(per_doc, document, "left").withColumn("applicability", state)
    answer = [
        F.when(F.col("applicability") == "applicable", F.col(c)).alias(c)
        for c in ("complete", "retained", "removed", "events", "denominator")
    ]
    return joined.select(document, "applicability", F.coalesce("readings", F.lit(0)).alias("readings"), *answer)


def accounting_present(numbers: DataFrame, document: str) -> DataFrame:
    """Documents that state N = M + K with an event count, each from its own token."""
    found = _accountings(numbers, document).select(document).distinct().withColumn("_found", F.lit(True))
    return numbers.where("in_scan").select(document).join(found, document, "left").select(
        document, F.coalesce("_found", F.lit(False)).alias("accounting_present")
    )


def corroboration(readings: DataFrame, numbers: DataFrame, document: str, project: str) -> DataFrame:
    """How many other documents of a project state the same four counts, token for token.

    ``readings``: one accounting per row with project and document.  Equal accountings and
    equal number inventories are collapsed first, and each accounting looks for inventories
    through its rarest value only; the other values are checked inside the row.
    """
    roles = ["complete", "retained", "removed", "events"]
    stock = (
        numbers.select(project, F.array_sort("integers").alias("integers"))
        .groupBy(project, "integers")
        .agg(F.count("*").alias("n_docs"))
    )
    posted = stock.select(
        project, "n_docs", F.map_from_entries("integers").alias("occ"), F.explode("integers.v").alias("anchor")
    )
    frequency = posted.groupBy(project, "anchor").agg(F.count("*").alias("_f"))
    accounts = readings.select(project, *roles).distinct()
    anchored = (
        accounts.select("*", F.explode(F.array_distinct(F.array(*roles))).alias("anchor"))
        .join(frequency, [project, "anchor"])
        .groupBy(project, *roles)
        .agg(F.min(F.struct("_f", "anchor")).alias("_a"))
        .select(project, *roles, F.col("_a.anchor").alias("anchor"))
    )
    counts = (
        anchored.join(posted, [project, "anchor"])
        .where(_enough(*[F.col(c) for c in roles]))
        .groupBy(project, *roles)
        .agg(F.sum("n_docs").alias("_docs"))
    )
    own = numbers.select(document, F.map_from_entries("integers").alias("occ"))
    supported = F.coalesce(_enough(*[F.col(c) for c in roles]), F.lit(False)).cast("int")
    return (
        readings.join(own, document, "left")
        .withColumn("_own", supported)
        .drop("occ")
        .join(counts, [project, *roles], "left")
        .withColumn("corroborating", F.coalesce("_docs", F.lit(0)) - F.col("_own"))
        .drop("_docs", "_own")
    )


def state_table_reconcile(df: DataFrame, document: str, text: str) -> DataFrame:
    """Counts of states 0, 1, 2 with total and stated mean that reconcile; one table or none."""
    numbers = cut_lineage(stated_numbers(df, document, text))

    def splits(total: Column) -> Column:
        def with_first(c0: Column) -> Column:
            fits = F.filter("vals", lambda c1: F.map_contains_key("occ", total - c0 - c1) & (c0 + c1 <= total))
            return F.transform(fits, lambda c1: F.struct(c0.alias("c0"), c1.alias("c1"), (total - c0 - c1).alias("c2")))

        return F.flatten(F.transform(F.filter("vals", lambda v: v <= total), with_first))

    tables = (
        _scanned(numbers, document, 0)
        .withColumn("total", F.explode(F.filter("vals", lambda v: v >= 3)))
        .withColumn("_t", F.explode(splits(F.col("total"))))
        .select("*", "_t.*")
    )
    nonzero = reduce(lambda a, b: a + b, [(F.col(f"c{i}") > 0).cast("int") for i in range(3)])
    tables = tables.where((nonzero >= 2) & _enough(*[F.col(n) for n in ("c0", "c1", "c2", "total")]))
    mean = (F.col("c1") + 2 * F.col("c2")) / F.col("total")
    squares = (F.col("c1") + 4 * F.col("c2")) / F.col("total")
    near = lambda t, x: F.abs(t["value"] - x) <= 0.5 * F.pow(F.lit(10.0), -t["decimals"]) + SLACK
    found = (
        tables.withColumn("_mean", mean)
        .withColumn("_sd", F.sqrt(F.greatest(squares - mean * mean, F.lit(0.0))))
        .withColumn("_means", F.filter("decimals", lambda t: near(t, F.col("_mean"))))
        .where(F.size("_means") > 0)
        .withColumn("_others", F.filter("decimals", lambda t: near(t, F.col("_sd"))))
        .select(
            document, "c0", "c1", "c2", "total",
            F.get("_means", F.lit(0))["raw"].alias("mean_text"),
            F.get(
                F.filter("_others", lambda t: t["raw"] != F.get(F.col("_means"), F.lit(0))["raw"]), F.lit(0)
            )["raw"].alias("sd_text"),
        )
    )
    per_doc = found.groupBy(document).agg(
        F.count("*").alias("tables"),
        *[F.min(n).alias(n) for n in ("c0", "c1", "c2", "total", "mean_text", "sd_text")],
    )
    state = (
        F.when(~F.col("in_scan"), F.lit("unsupported"))
        .when(F.col("tables").isNull(), F.lit("not_applicable"))
        .when(F.col("tables") == 1, F.lit("applicable"))
        .otherwise(F.lit("ambiguous"))
    )
    joined = numbers.select(document, "in_scan").join(per_doc, document, "left").withColumn("applicability", state)
    return joined.select(
        document,
        "applicability",
        F.coalesce("tables", F.lit(0)).alias("tables"),
        *[
            F.when(F.col("applicability") == "applicable", F.col(n)).alias(n)
            for n in ("c0", "c1", "c2", "total", "mean_text", "sd_text")
        ],
    )


def orientation_reconcile(df: DataFrame, document: str, text: str) -> DataFrame:
    """Marker total t, agreements a and a rate equal to a/t or (t-a)/t but not both."""
    numbers = cut_lineage(stated_numbers(df, document, text))

    def near(r: Column, ratio: Column) -> Column:
        return F.abs(r["rate"] - ratio) <= r["tolerance"] + SLACK

    def readings(t: Column) -> Column:
        def rated(a: Column) -> Column:
            fits = F.filter("rates", lambda r: near(r, a / t) != near(r, (t - a) / t))
            return F.transform(
                fits,
                lambda r: F.struct(
                    t.alias("markers"),
                    a.alias("agreements"),
                    F.when(near(r, a / t), F.lit("direct")).otherwise(F.lit("complement")).alias("orientation"),
                ),
            )

        return F.flatten(F.transform(F.filter("vals", lambda a: a < t), rated))

    found = (
        _scanned(numbers, document, 1)
        .withColumn("_n", F.explode("vals"))
        .select(document, F.inline(readings(F.col("_n"))))
    )
    per_doc = found.groupBy(document).agg(
        F.count_distinct("markers", "agreements").alias("pairs"),
        F.count_distinct("orientation").alias("_ways"),
        *[F.min(n).alias(n) for n in ("markers", "agreements", "orientation")],
    )
    one = (F.col("pairs") == 1) & (F.col("_ways") == 1)
    state = (
        F.when(~F.col("in_scan"), F.lit("unsupported"))
        .when(F.col("pairs").isNull(), F.lit("not_applicable"))
        .when(one, F.lit("applicable"))
        .otherwise(F.lit("ambiguous"))
    )
    joined = numbers.select(document, "in_scan").join(per_doc, document, "left").withColumn("applicability", state)
    return joined.select(
        document,
        "applicability",
        F.coalesce("pairs", F.lit(0)).alias("pairs"),
        *[
            F.when(F.col("applicability") == "applicable", F.col(n)).alias(n)
            for n in ("markers", "agreements", "orientation")
        ],
    )


def denominator_check(counts: DataFrame, case: str, stated: DataFrame) -> DataFrame:
    """Which denominator a reported rate uses against table counts: planned or retained.

    ``counts``: case, planned, retained, events.  ``stated``: case, rate, decimals, claims
    ('planned' or 'retained').
    """
    margin = 0.5 * F.pow(F.lit(10.0), -F.col("decimals")) + SLACK
    planned = F.abs(F.col("rate") - F.col("events") / F.col("planned")) <= margin
    retained = F.abs(F.col("rate") - F.col("events") / F.col("retained")) <= margin
    used = (
        F.when(planned & retained, F.lit("either"))
        .when(planned, F.lit("planned"))
        .when(retained, F.lit("retained"))
        .otherwise(F.lit("neither"))
    )
    known = F.col("used").isin("planned", "retained")
    return (
        counts.join(stated, case)
        .withColumn("used", F.when((F.col("planned") > 0) & (F.col("retained") > 0), used).otherwise(F.lit("neither")))
        .withColumn("applicability", F.when(known, F.lit("applicable")).otherwise(F.lit("not_applicable")))
        .withColumn(
            "comparison_outcome",
            F.when(~known, F.lit("not_applicable"))
            .when(F.col("used") == F.col("claims"), F.lit("conformant"))
            .otherwise(F.lit("nonconformant")),
        )
        .select(case, "planned", "retained", "events", "used", "applicability", "comparison_outcome")
    )
