"""Recomputed group statistics: means, effects, regressions, loops, replicates."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.contracts import LoopContract, SensitivityContract
from plumbline.outcomes import APPLICABLE, UNSUPPORTED, outcome_of
from plumbline.session import cut_lineage


def _is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def orientation(left: str, right: str) -> str:
    """Direction a left-minus-right difference is stated in."""
    pair = (left.casefold(), right.casefold())
    return {
        ("treated", "control"): "treated_minus_control",
        ("control", "treated"): "control_minus_treated",
    }.get(pair, "unknown")


def mean_difference(
    df: DataFrame, group: str, value: str, left: str, right: str, case: Sequence[str] = ()
) -> DataFrame:
    """mean(left) - mean(right); an empty group or a non-finite value gives no answer."""
    number = F.col(value).try_cast("double")
    at = {side: F.col(group) == level for side, level in (("left", left), ("right", right))}
    stats = df.where(F.col(group).isin(left, right)).groupBy(*case).agg(
        *[F.count_if(at[s]).alias(f"{s}_rows") for s in at],
        *[F.avg(F.when(at[s], number)).alias(f"{s}_mean") for s in at],
        F.every(_is_finite(number)).alias("_finite"),
    )
    reason = (
        F.when(~F.col("_finite"), F.lit("a selected value is not finite"))
        .when((F.col("left_rows") == 0) | (F.col("right_rows") == 0), F.lit("a selected group has no rows"))
    )
    return (
        stats.withColumn("reason", reason)
        .withColumn("applicability", F.when(F.col("reason").isNull(), F.lit(APPLICABLE)).otherwise(F.lit(UNSUPPORTED)))
        .withColumn(
            "mean_difference", F.when(F.col("reason").isNull(), F.col("left_mean") - F.col("right_mean"))
        )
        .withColumn("comparison", F.lit(f"{left} versus {right}"))
        .withColumn("orientation", F.lit(orientation(left, right)))
        .drop("_finite")
    )


def effect_relevance(
    df: DataFrame, family: Sequence[str], adjusted: str, effect: str, alpha: float, floor: float
) -> DataFrame:
    """Significant rows whose effect is below the declared floor."""
    padj, size = F.col(adjusted).try_cast("double"), F.col(effect).try_cast("double")
    significant = padj <= alpha
    bad = ~_is_finite(size) | ~F.coalesce(padj.between(0, 1), F.lit(False))
    stats = df.groupBy(*family).agg(
        F.count("*").alias("n_rows"),
        F.count_if(significant).alias("significant_rows"),
        F.count_if(significant & (F.abs(size) < floor)).alias("below_floor"),
        F.some(bad).alias("_bad"),
    )
    share = F.when(F.col("significant_rows") > 0, F.col("below_floor") / F.col("significant_rows")).otherwise(0.0)
    return (
        stats.withColumn("below_floor_fraction", share)
        .withColumn("applicability", F.when(F.col("_bad"), F.lit(UNSUPPORTED)).otherwise(F.lit(APPLICABLE)))
        .withColumn("comparison_outcome", outcome_of(F.col("applicability"), F.col("below_floor") == 0))
        .drop("_bad")
    )


def ols_sign(
    df: DataFrame,
    feature: Sequence[str],
    donor: str,
    dosage: str,
    response: str,
    reported: DataFrame,
    reported_effect: str,
    *,
    counts_effect_allele: bool = True,
    minimum_donors: int = 6,
    minimum_per_class: int = 1,
) -> DataFrame:
    """Sign of the donor-level slope on the oriented dosage against the reported effect."""
    feature = list(feature)
    raw, y = F.col(dosage).try_cast("double"), F.col(response).try_cast("double")
    x = raw if counts_effect_allele else 2 - raw
    per_donor = df.groupBy(*feature, donor).agg(
        F.count("*").alias("_n"),
        F.first(raw).alias("_raw"),
        F.first(x).alias("_x"),
        F.first(y).alias("_y"),
    )
    classes = [F.count_if(F.col("_raw") == v).alias(f"class_{v}") for v in (0, 1, 2)]
    fit = per_donor.groupBy(*feature).agg(
        F.sum("_n").alias("n_rows"),
        F.count("*").alias("n_donors"),
        F.some(~F.coalesce(F.col("_raw").isin(0.0, 1.0, 2.0), F.lit(False)) | ~_is_finite(F.col("_y"))).alias("_bad"),
        *classes,
        (F.sum("_raw") / (2 * F.count("*"))).alias("allele_frequency"),
        F.regr_slope("_y", "_x").alias("slope"),
        F.regr_sxx("_y", "_x").alias("_sxx"),
        F.regr_syy("_y", "_x").alias("_syy"),
        F.regr_sxy("_y", "_x").alias("_sxy"),
    )
    stated = reported.groupBy(*feature).agg(
        F.count("*").alias("_reports"), F.first(F.col(reported_effect).try_cast("double")).alias("reported_effect")
    )
    supported = sum([(F.col(f"class_{v}") >= minimum_per_class).cast("int") for v in (0, 1, 2)], F.lit(0))
    residual = F.greatest(F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx"), F.lit(0.0))
    error = F.when(
        (F.col("_sxx") > 0) & (F.col("n_donors") > 2),
        F.sqrt(residual / (F.col("n_donors") - 2) / F.col("_sxx")),
    )
    joined = fit.join(stated, feature, "left").withColumn("slope_se", error)
    reason = (
        F.when(F.col("n_rows") > F.col("n_donors"), F.lit("donors are duplicated"))
        .when(F.col("_bad"), F.lit("a dosage or response is invalid"))
        .when(F.col("n_donors") < minimum_donors, F.lit("too few donors"))
        .when(supported < 2, F.lit("too few supported genotype classes"))
        .when(F.coalesce(F.col("slope"), F.lit(0.0)) == 0, F.lit("the slope has no direction"))
        .when(F.coalesce(F.col("_reports"), F.lit(0)) != 1, F.lit("the reported effect is absent or not unique"))
        .when(F.coalesce(F.col("reported_effect"), F.lit(0.0)) == 0, F.lit("the reported effect has no direction"))
    )
    agrees = F.signum("slope") == F.signum("reported_effect")
    return (
        joined.withColumn("reason", reason)
        .withColumn("applicability", F.when(F.col("reason").isNull(), F.lit(APPLICABLE)).otherwise(F.lit(UNSUPPORTED)))
        .withColumn("comparison_outcome", outcome_of(F.col("applicability"), agrees))
        .select(
            *feature, "n_donors", "class_0", "class_1", "class_2", "allele_frequency", "slope", "slope_se",
            "reported_effect", "applicability", "comparison_outcome", "reason",
        )
    )


def pair_key(left: Column, right: Column) -> Column:
    """Unordered pair; null where a member is empty or both are the same."""
    return F.when(
        (left.cast("string") != "") & (right.cast("string") != "") & (left != right),
        F.struct(F.least(left, right).alias("lo"), F.greatest(left, right).alias("hi")),
    )


def distance_pairs(bins: DataFrame, case: Sequence[str], distance: str) -> DataFrame:
    """All bin pairs of a case exactly ``distance`` apart: an equi-join on start + distance.

    ``bins``: case keys, ``bin_id``, ``start``, ``masked`` and the case's ``distance``.
    """
    case = list(case)
    near = bins.select(
        *case, F.col("bin_id").alias("_near"), F.col("masked").alias("_m1"), (F.col("start") + F.col(distance)).alias("start")
    )
    far = bins.select(*case, "start", F.col("bin_id").alias("_far"), F.col("masked").alias("_m2"))
    return near.join(far, [*case, "start"]).select(
        *case, pair_key(F.col("_near"), F.col("_far")).alias("pair"), (F.col("_m1") | F.col("_m2")).alias("masked")
    )


def loop_strength(
    contacts: DataFrame, bins: DataFrame, targets: DataFrame, results: DataFrame, contract: LoopContract
) -> DataFrame:
    """Per target: log2(observed / mean background at the same distance), test minus reference.

    ``bins``: bin_id, start, masked.  ``contacts``: replicate columns, condition, bin_i, bin_j,
    observed_count.  ``targets``: target_id, bin_i, bin_j.  ``results``: target_id, delta.

    No table of bin pairs is made.  A grid of n bins has n - k pairs k bins apart; contacts get their distance from the
    places of their two bins, and samples that hold all pairs of a distance tell how many meet a masked bin.
    """
    c = contract
    replicate = list(c.replicate)
    starts = bins.select("bin_id", "start", "masked")
    grid = starts.agg(
        F.count("*").alias("n"),
        F.countDistinct("bin_id").alias("ids"),
        F.countDistinct("start").alias("places"),
        F.min("start").alias("lo"),
        F.max("start").alias("hi"),
        F.count_if(F.pmod(F.col("start") - c.view_start, F.lit(c.resolution)) != 0).alias("off"),
    )
    expected = (c.view_end - c.view_start + c.resolution - 1) // c.resolution
    whole = grid.select(
        (
            (F.col("n") == expected)
            & (F.col("ids") == expected)
            & (F.col("places") == expected)
            & (F.col("lo") == c.view_start)
            & (F.col("hi") == c.view_start + (expected - 1) * c.resolution)
            & (F.col("off") == 0)
        )
    ).scalar()

    def end(side: str) -> DataFrame:
        return starts.select(
            F.col("bin_id").alias(f"bin_{side}"), F.col("start").alias(f"_s{side}"), F.col("masked").alias(f"_m{side}")
        )

    def placed(rows: DataFrame) -> DataFrame:
        joined = rows.join(end("i"), "bin_i", "left").join(end("j"), "bin_j", "left")
        return joined.withColumns(
            {
                "pair": pair_key(F.col("bin_i"), F.col("bin_j")),
                "distance": F.abs(F.col("_si") - F.col("_sj")),
                "masked": F.col("_mi") | F.col("_mj"),
            }
        ).drop("_si", "_sj", "_mi", "_mj", "bin_i", "bin_j")

    asked = placed(targets.select("target_id", "bin_i", "bin_j")).withColumnRenamed("masked", "target_masked")
    asked = cut_lineage(asked.withColumnRenamed("pair", "target"))
    wanted = asked.select("distance").where(F.col("distance") > 0).distinct()
    counted = cut_lineage(
        placed(contacts.where(F.col("condition").isin(c.reference_level, c.test_level)))
        .groupBy(*replicate, "condition", "pair", "distance", "masked")
        .agg(F.count("*").alias("_n"), F.sum("observed_count").alias("count"), F.min("observed_count").alias("_low"))
    )
    nameless = F.lit(False)
    for name in replicate:
        nameless = nameless | F.col(name).isNull() | (F.col(name).cast("string") == "")
    unfit = (F.col("_n") > 1) | F.col("pair").isNull() | F.col("distance").isNull() | F.coalesce(F.col("_low") < 0, F.lit(True)) | nameless
    samples = counted.groupBy(*replicate).agg((F.countDistinct("condition") > 1).alias("_two"), F.some(unfit).alias("_unfit"))
    any_bad, n_samples = samples.agg(F.coalesce(F.some(F.col("_two") | F.col("_unfit")), F.lit(False)), F.count("*")).head()
    at_distance = counted.join(wanted, "distance", "left_semi")
    stratum = at_distance.groupBy(*replicate, "condition", "distance").agg(
        F.count("*").alias("_seen"),
        F.count_if(~F.col("masked")).alias("_unmasked"),
        F.sum(F.when(~F.col("masked"), F.col("count"))).alias("_open_sum"),
    )
    need = _pair_counts(stratum, wanted, starts, expected, c.view_start, c.resolution)
    sparse = stratum.join(need, "distance").groupBy("distance").agg(
        ((F.count("*") < n_samples) | F.some(F.col("_seen") < F.col("_need"))).alias("_sparse")
    )
    level = (
        asked.join(need, "distance", "left")
        .join(stratum, "distance", "left")
        .join(
            at_distance.select(*replicate, "condition", F.col("pair").alias("target"), F.col("count").alias("_target")),
            [*replicate, "condition", "target"],
            "left",
        )
        .withColumn("background_pairs", F.col("_open") - 1)
        .withColumn("_expected", (F.col("_open_sum") - F.col("_target")) / F.col("background_pairs"))
        .withColumn(
            "_strength",
            F.when(
                (F.col("_target") > 0) & (F.col("_expected") > 0),
                F.log2(F.col("_target") / F.col("_expected")),
            ),
        )
    )
    at_ref, at_test = (F.col("condition") == c.reference_level), (F.col("condition") == c.test_level)
    per_target = level.groupBy("target_id").agg(
        F.first("distance").alias("distance"),
        F.first("background_pairs").alias("background_pairs"),
        F.some("target_masked").alias("_masked"),
        F.count_if(at_ref).alias("reference_replicates"),
        F.count_if(at_test).alias("test_replicates"),
        F.avg(F.when(at_ref, F.col("_strength"))).alias("reference_mean"),
        F.avg(F.when(at_test, F.col("_strength"))).alias("test_mean"),
        F.some(F.col("_strength").isNull()).alias("_flat"),
    ).join(sparse, "distance", "left")
    stated = results.groupBy("target_id").agg(F.count("*").alias("_reports"), F.first("delta").alias("reported_delta"))
    joined = per_target.join(stated, "target_id", "left").withColumn(
        "recomputed_delta", F.col("test_mean") - F.col("reference_mean")
    )
    reason = (
        F.when(~F.coalesce(whole, F.lit(False)), F.lit("the bins are not one complete grid"))
        .when(F.lit(any_bad), F.lit("the contacts are invalid"))
        .when(F.coalesce(F.col("_masked"), F.lit(True)), F.lit("the target is unavailable or masked"))
        .when(
            (F.col("distance") <= 0) | (F.pmod(F.col("distance"), F.lit(c.resolution)) != 0),
            F.lit("the target is off the grid"),
        )
        .when(F.coalesce(F.col("background_pairs"), F.lit(0)) < c.minimum_background, F.lit("too few background pairs"))
        .when(F.coalesce(F.col("_sparse"), F.lit(n_samples > 0)), F.lit("a replicate lacks part of the distance stratum"))
        .when(F.col("_flat"), F.lit("an observed or expected count is not positive"))
        .when(
            (F.col("reference_replicates") == 0) | (F.col("test_replicates") == 0), F.lit("a level has no replicates")
        )
        .when(F.coalesce(F.col("_reports"), F.lit(0)) != 1, F.lit("the reported delta is absent or not unique"))
    )
    error = F.abs(F.col("reported_delta") - F.col("recomputed_delta"))
    slack = F.lit(1e-9) * F.greatest(F.lit(1.0), F.abs("reported_delta"), F.abs("recomputed_delta"))
    return (
        joined.withColumn("reason", reason)
        .withColumn("applicability", F.when(F.col("reason").isNull(), F.lit(APPLICABLE)).otherwise(F.lit(UNSUPPORTED)))
        .withColumn("comparison_outcome", outcome_of(F.col("applicability"), error <= F.lit(c.tolerance) + slack))
        .select(
            "target_id", "distance", "background_pairs", "reference_replicates", "test_replicates",
            "reference_mean", "test_mean", "recomputed_delta", "reported_delta", "applicability",
            "comparison_outcome", "reason",
        )
    )


def _pair_counts(stratum: DataFrame, wanted: DataFrame, starts: DataFrame, n_bins: int, first: int, step: int) -> DataFrame:
    """``distance``, ``_need`` (bin pairs so far apart in a whole grid), ``_open`` (those that meet no masked bin).

    A sample with all pairs of a distance has counted them.  Only for distances that no sample covers are the pairs of
    masked bins listed, each by its near end.
    """
    apart = wanted.where(F.pmod("distance", F.lit(step)) == 0).withColumn("_need", F.greatest(n_bins - F.col("distance") / step, F.lit(0)).cast("long"))
    whole = stratum.join(apart, "distance").where("_seen = _need").groupBy("distance").agg(F.max("_unmasked").alias("_counted"))
    known = cut_lineage(apart.join(whole, "distance", "left"))
    left = known.where("_counted IS NULL AND _need > 0").agg(F.collect_set("distance")).head()[0]
    if not left:
        return known.select("distance", "_need", F.coalesce("_counted", F.lit(0)).alias("_open"))
    masked = starts.where("masked").select("start", F.explode(F.array(*[F.lit(d).cast("long") for d in left])).alias("distance"))
    near = masked.select("distance", F.explode(F.array(F.col("start"), F.col("start") - F.col("distance"))).alias("near"))
    inside = (F.col("near") >= first) & (F.col("near") + F.col("distance") <= first + (n_bins - 1) * step)
    met = near.where(inside).groupBy("distance").agg(F.countDistinct("near").alias("_met"))
    counted = F.coalesce(F.col("_counted"), F.col("_need") - F.coalesce("_met", F.lit(0)))
    return known.join(met, "distance", "left").select("distance", "_need", counted.alias("_open"))

def replicate_sensitivity(
    reported: DataFrame, recomputed: DataFrame, family: Sequence[str], feature: str, contract: SensitivityContract
) -> DataFrame:
    """Survival and power of reported-significant features under a replicate-level model.

    ``reported``: family, feature, reported_padj.  ``recomputed``: family, feature, padj, se.
    """
    c = contract
    keys = [*family, feature]
    z = NormalDist().inv_cdf(1 - c.alpha / 2) + NormalDist().inv_cdf(c.target_power)
    usable = recomputed.where(F.col("padj").isNotNull() & F.col("se").isNotNull())
    valid = reported.where(F.col("reported_padj") <= c.alpha).join(usable, keys)
    found = valid.groupBy(*family).agg(
        F.count("*").alias("testable"),
        F.count_if(F.col("padj") <= c.alpha).alias("survivors"),
        F.count_if(F.col("se") * F.lit(z) <= c.reference_effect).alias("_detectable"),
    )
    return (
        reported.select(*family)
        .distinct()
        .join(found, list(family), "left")
        .select(
            *family,
            F.coalesce("testable", F.lit(0)).alias("testable"),
            F.coalesce("survivors", F.lit(0)).alias("survivors"),
            (F.col("survivors") / F.col("testable")).alias("survival_rate"),
            (F.col("_detectable") / F.col("testable")).alias("powered_fraction"),
            (F.col("_detectable") / F.col("testable") >= c.minimum_powered_fraction).alias("powered"),
            F.when(F.col("testable") > 0, F.lit(APPLICABLE)).otherwise(F.lit(UNSUPPORTED)).alias("applicability"),
        )
    )


def pseudobulk(
    cells: DataFrame,
    replicate: str,
    condition: str,
    feature: str,
    value: str,
    reference: str,
    test: str,
    *,
    minimum_replicates: int = 3,
    case: Sequence[str] = (),
) -> DataFrame:
    """One summed row per replicate and feature, behind the gates the recheck needs."""
    case = list(case)
    bulk = cells.groupBy(*case, replicate, condition, feature).agg(F.sum(value).alias("total"))
    arms = (
        cells.groupBy(*case, replicate)
        .agg(F.min(condition).alias("_c0"), F.max(condition).alias("_c1"), F.min(value).alias("_low"))
        .groupBy(*case)
        .agg(
            F.count_if(F.col("_c0") == reference).alias("reference_replicates"),
            F.count_if(F.col("_c1") == test).alias("test_replicates"),
            F.some(F.col("_c0") != F.col("_c1")).alias("_mixed"),
            F.some(~F.col("_c0").isin(reference, test)).alias("_other"),
            F.min("_low").alias("_low"),
        )
        .withColumn(
            "reason",
            F.when(F.col("_mixed"), F.lit("a replicate has two conditions"))
            .when(F.col("_other"), F.lit("a level outside the contrast is present"))
            .when(F.col("_low") < 0, F.lit("a value is negative"))
            .when(
                F.least("reference_replicates", "test_replicates") < minimum_replicates,
                F.lit("too few replicates in one level"),
            ),
        )
        .select(*case, "reason")
    )
    nonzero = bulk.groupBy(*case, feature).agg(F.sum("total").alias("feature_total")).where("feature_total > 0")
    joined = bulk.join(nonzero, [*case, feature])
    gated = joined.join(arms, case) if case else joined.withColumn("reason", arms.select("reason").scalar())
    return gated.withColumn(
        "applicability", F.when(F.col("reason").isNull(), F.lit(APPLICABLE)).otherwise(F.lit(UNSUPPORTED))
    )
