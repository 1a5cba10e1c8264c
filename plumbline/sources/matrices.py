"""Count matrices as coordinate tables: validation, axes and compressed pointers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordering import monotone_check
from plumbline.skew import attach


def matrix_profile(cells: DataFrame, shapes: DataFrame) -> DataFrame:
    """Per matrix: stored cells, total, sign, integrality, bounds and duplicate cells.

    ``cells``: matrix_id, obs_idx, var_idx, value.  ``shapes``: matrix_id, n_obs, n_vars.
    """
    per_cell = cells.groupBy("matrix_id", "obs_idx", "var_idx").agg(
        F.count("*").alias("_n"),
        F.sum(F.col("value").cast("decimal(38,6)")).alias("_sum"),
        F.min("value").alias("_low"),
        F.every(F.col("value") == F.floor("value")).alias("_whole"),
    )
    stats = per_cell.groupBy("matrix_id").agg(
        F.sum("_n").alias("stored"),
        F.count_if(F.col("_n") > 1).alias("duplicate_cells"),
        F.sum("_sum").alias("_total"),
        F.min("_low").alias("_low"),
        F.every("_whole").alias("integer_valued"),
        F.min(F.least("obs_idx", "var_idx")).alias("_least"),
        F.max("obs_idx").alias("_max_obs"),
        F.max("var_idx").alias("_max_var"),
    )
    inside = (F.col("_least") >= 0) & (F.col("_max_obs") < F.col("n_obs")) & (F.col("_max_var") < F.col("n_vars"))
    return shapes.join(stats, "matrix_id", "left").select(
        "matrix_id",
        "n_obs",
        "n_vars",
        F.coalesce("stored", F.lit(0)).alias("stored"),
        F.coalesce("duplicate_cells", F.lit(0)).alias("duplicate_cells"),
        F.coalesce(F.col("_total").cast("double"), F.lit(0.0)).alias("total"),
        F.coalesce(F.col("_low") >= 0, F.lit(True)).alias("nonnegative"),
        F.coalesce("integer_valued", F.lit(True)).alias("integer_valued"),
        F.coalesce(inside, F.lit(True)).alias("inside_axes"),
    )


def axis_decode(codes: DataFrame, categories: DataFrame, axis: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(decoded rows, axis status) of a dictionary-encoded axis.

    ``codes``: axis keys, idx, code.  ``categories``: axis keys, code, value.  A code outside the
    categories or a repeated category makes the axis illegal; uniqueness is always computed.
    """
    axis = list(axis)
    table = categories.groupBy(*axis, "code").agg(F.min("value").alias("value"), F.count("*").alias("_c"))
    spelled = categories.groupBy(*axis, "value").agg(F.count("*").alias("_n")).groupBy(*axis).agg(
        (F.max("_n") > 1).alias("duplicate_categories")
    )
    use = codes.groupBy(*axis, "code").agg(F.count("*").alias("_rows"))
    known = use.join(table, [*axis, "code"], "left")
    status = known.groupBy(*axis).agg(
        F.sum("_rows").alias("n"),
        F.sum(F.when(F.col("value").isNull(), F.col("_rows")).otherwise(0)).alias("illegal_codes"),
        F.every((F.col("_rows") == 1) & F.col("value").isNotNull()).alias("values_unique"),
    ).join(spelled, axis, "left")
    decoded = attach(codes, known.select(*axis, "code", "value", "_rows"), [*axis, "code"], "_rows").drop("_rows")
    return decoded, status


def pointer_check(pointers: DataFrame, nnz: DataFrame) -> DataFrame:
    """Compressed pointers start at 0, never decrease and end at the number of stored values.

    ``pointers``: matrix_id, pos, pointer.  ``nnz``: matrix_id, stored.
    """
    steps = monotone_check(pointers, ["matrix_id"], "pos", "pointer")
    ends = pointers.groupBy("matrix_id").agg(
        F.min_by("pointer", "pos").alias("first"), F.max_by("pointer", "pos").alias("last")
    )
    return steps.join(ends, "matrix_id").join(nnz, "matrix_id", "left").select(
        "matrix_id",
        "n_rows",
        "monotone",
        ((F.col("first") == 0) & F.col("monotone") & F.col("last").eqNullSafe(F.col("stored"))).alias("valid"),
    )
