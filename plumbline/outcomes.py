"""Four-state outcomes and the one output schema every check can be turned into."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States and the outcomes each one allows.
APPLICABLE = "applicable"
NOT_APPLICABLE = "not_applicable"
AMBIGUOUS = "ambiguous"
UNSUPPORTED = "unsupported"
CONFORMANT = "conformant"
NONCONFORMANT = "nonconformant"
UNKNOWN = "unknown"

CHECK_SCHEMA = (
    "check_id string, case_id string, applicability string, comparison_outcome string, "
    "lineage_status string, operands map<string,string>, metrics map<string,double>, "
    "reason string, observation_digest string"
)


def outcome_of(applicability: Column, conformant: Column) -> Column:
    """Comparison outcome a state allows: only an applicable case is ever compared."""
    return (
        F.when(applicability == APPLICABLE, F.when(conformant, F.lit(CONFORMANT)).otherwise(F.lit(NONCONFORMANT)))
        .when(applicability == NOT_APPLICABLE, F.lit(NOT_APPLICABLE))
        .otherwise(F.lit(UNKNOWN))
    )


def lineage_of(applicability: Column) -> Column:
    return (
        F.when(applicability == APPLICABLE, F.lit("complete"))
        .when(applicability == NOT_APPLICABLE, F.lit(NOT_APPLICABLE))
        .otherwise(F.lit("incomplete"))
    )


def illegal(observations: DataFrame) -> DataFrame:
    """Observations whose outcome, lineage or operands their state does not allow."""
    state, result = F.col("applicability"), F.col("comparison_outcome")
    compared = (state == APPLICABLE) & result.isin(CONFORMANT, NONCONFORMANT)
    allowed = (
        compared
        | ((state == NOT_APPLICABLE) & (result == NOT_APPLICABLE))
        | (state.isin(AMBIGUOUS, UNSUPPORTED) & (result == UNKNOWN))
    )
    empty = (state == APPLICABLE) & (F.size("operands") + F.size("metrics") == 0)
    fine = allowed & (F.col("lineage_status") == lineage_of(state)) & ~empty
    return observations.where(~F.coalesce(fine, F.lit(False)))


def as_observations(
    df: DataFrame,
    check_id: str,
    case: str,
    *,
    applicability: str = "applicability",
    outcome: str = "comparison_outcome",
    reason: str | None = "reason",
    operands: Sequence[str] = (),
    metrics: Sequence[str] = (),
) -> DataFrame:
    """Typed check rows to the common schema, with an order-free digest of each row."""
    text = {name: F.col(name).cast("string") for name in operands}
    number = {name: F.col(name).cast("double") for name in metrics}
    shaped = df.select(
        F.lit(check_id).alias("check_id"),
        F.col(case).cast("string").alias("case_id"),
        F.col(applicability).alias("applicability"),
        F.col(outcome).alias("comparison_outcome"),
        lineage_of(F.col(applicability)).alias("lineage_status"),
        _map(text, "string").alias("operands"),
        _map(number, "double").alias("metrics"),
        (F.col(reason) if reason else F.lit(None).cast("string")).alias("reason"),
    )
    parts = ["check_id", "case_id", "applicability", "comparison_outcome", "operands", "metrics", "reason"]
    return shaped.withColumn(
        "observation_digest",
        F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*parts)), 256)),
    )


def _map(columns: Mapping[str, Column], kind: str) -> Column:
    if not columns:
        return F.expr(f"cast(map() as map<string,{kind}>)")
    pairs: list[Column] = []
    for name, column in sorted(columns.items()):
        pairs += [F.lit(name), column]
    return F.create_map(*pairs)


def route(observations: DataFrame) -> DataFrame:
    """Where each observation is reported: question, disclosure or nothing."""
    state, result = F.col("applicability"), F.col("comparison_outcome")
    return observations.withColumn(
        "route",
        F.when(state == AMBIGUOUS, F.lit("question"))
        .when(state == UNSUPPORTED, F.lit("disclosure"))
        .when((state == APPLICABLE) & (result == NONCONFORMANT), F.lit("disclosure"))
        .otherwise(F.lit("none")),
    )
