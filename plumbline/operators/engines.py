"""Replicate-level engines: counts per replicate and feature to an effect and its error."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.skew import attach

RESULT_SCHEMA = "feature string, replicates bigint, effect double, se double, p double"


def log_cpm_ols(bulk: DataFrame) -> DataFrame:
    """Default engine: OLS of log(1 + counts per million) on the 0/1 arm, by aggregation only.

    ``bulk``: replicate, arm, feature, total.
    """
    bulk = bulk.where(F.col("replicate").isNotNull())
    depth = bulk.groupBy("replicate").agg(F.sum("total").alias("_depth"), F.count("*").alias("_rows"))
    y = F.log1p(F.col("total") * 1e6 / F.col("_depth"))
    fit = (
        attach(bulk, depth, ["replicate"], "_rows")
        .select("feature", F.col("arm").cast("double").alias("x"), y.alias("y"))
        .groupBy("feature")
        .agg(
            F.count("*").alias("replicates"),
            F.regr_slope("y", "x").alias("effect"),
            F.regr_sxx("y", "x").alias("_sxx"),
            F.regr_syy("y", "x").alias("_syy"),
            F.regr_sxy("y", "x").alias("_sxy"),
        )
    )
    rest = F.greatest(F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx"), F.lit(0.0))
    usable = (F.col("replicates") > 2) & (F.col("_sxx") > 0)
    return fit.withColumn(
        "se", F.when(usable, F.sqrt(rest / (F.col("replicates") - 2) / F.col("_sxx")))
    ).select("feature", "replicates", "effect", "se")


def user_engine(bulk: DataFrame, fit: Callable[[pd.DataFrame], pd.DataFrame], schema: str = RESULT_SCHEMA) -> DataFrame:
    """A caller's model, one feature (replicates long, never cells) at a time in Arrow batches."""
    return bulk.groupBy("feature").applyInPandas(fit, schema)
