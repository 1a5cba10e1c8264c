"""Column binding, cell checks and fail-closed family gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.contracts import ContractError
from plumbline.functions import exact
from plumbline.outcomes import APPLICABLE, UNSUPPORTED
from plumbline.skew import per_key

# Number spellings a measurement or a p-value may use.
PVALUE_LEXEME = r"^[0-9]+(\.[0-9]+)?$"
MEASUREMENT_LEXEME = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$"
# Characters that split lines under one newline model and not another
# (VT, FF, FS, GS, RS, NEL, LS, PS), and the byte order mark.
SPLIT_CHARACTERS = r"[\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
BYTE_ORDER_MARK = "\ufeff"


def bind_columns(df: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """Select ``roles`` (role name -> column); every role needs its own existing column."""
    header = df.columns
    if any(not name for name in header) or len(set(header)) != len(header):
        raise ContractError("the header is empty or duplicated")
    bound = list(roles.values())
    if len(set(bound)) != len(bound) or any(name not in header for name in bound):
        raise ContractError("the column binding is incomplete or overlapping")
    return df.select(*[F.col(f"`{column}`").alias(role) for role, column in roles.items()])


def _rule(bad: Column, reason: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.lit(reason))


def nonempty(name: str) -> Column:
    return _rule(F.col(name).isNull() | (F.col(name).cast("string") == ""), f"{name} is empty")


def trimmed(name: str) -> Column:
    return _rule(F.trim(name) != F.col(name), f"{name} is not trimmed")


def finite(name: str) -> Column:
    number = F.col(name).try_cast("double")
    return _rule(
        number.isNull() | F.isnan(number) | (F.abs(number) == F.lit(float("inf"))),
        f"{name} is not a finite number",
    )


def unit_interval(name: str) -> Column:
    number = F.col(name).try_cast("double")
    return _rule(number.isNull() | F.isnan(number) | ~number.between(0, 1), f"{name} is not in [0, 1]")


def exact_unit_decimal(name: str) -> Column:
    """A finite decimal in [0, 1], in plain or exponent spelling, of any number of digits."""
    return exact.let(exact.parse(F.col(name)), lambda number: unit_number(name, number))


def unit_number(name: str, number: Column) -> Column:
    """The same rule where the cell ``name`` is parsed already."""
    return _rule(~exact.in_unit(number), f"{name} is not an exact decimal in [0, 1]")


def boolean_text(name: str) -> Column:
    return _rule(~F.lower(F.col(name).cast("string")).isin("true", "false"), f"{name} is not true or false")


def lexeme(name: str, pattern: str) -> Column:
    """Matches the number grammar and does not underflow to zero."""
    text = F.col(name).cast("string")
    underflow = (text.try_cast("double") == 0) & text.rlike("[1-9]")
    return _rule(~text.rlike(pattern) | underflow, f"{name} is not a supported number")


def validate_cells(df: DataFrame, rules: Sequence[Column], out: str = "reasons") -> DataFrame:
    """Add the reasons a row fails, in rule order; an empty array means the row passes."""
    return df.withColumn(out, F.array_compact(F.array(*rules)))


def family_gate(
    df: DataFrame, family: Sequence[str], key: Sequence[str], reasons: str = "reasons", *, rows: int | None = None
) -> DataFrame:
    """One row per family: unsupported when any row fails or any key repeats.

    ``n_rows`` is the weight to give :func:`plumbline.skew.attach`; ``rows`` is the number of rows if it is known.
    """
    why = F.min(F.try_element_at(reasons, F.lit(1))).alias("_why")
    keyed = per_key(
        df, [*family, *key], rows, [F.count("*").alias("_n"), why], [F.sum("_n").alias("_n"), F.min("_why").alias("_why")]
    )
    return (
        keyed.groupBy(*family)
        .agg(
            F.sum("_n").alias("n_rows"),
            F.count("*").alias("n_keys"),
            F.min("_why").alias("_why"),
        )
        .withColumn(
            "reason",
            F.when(F.col("_why").isNotNull(), F.col("_why")).when(
                F.col("n_rows") > F.col("n_keys"), F.lit("identifiers are duplicated")
            ),
        )
        .withColumn(
            "applicability", F.when(F.col("reason").isNull(), F.lit(APPLICABLE)).otherwise(F.lit(UNSUPPORTED))
        )
        .drop("_why")
    )


def with_empty_families(gate: DataFrame, expected: DataFrame, family: Sequence[str]) -> DataFrame:
    """Declared families without a single row are unsupported too."""
    return expected.select(*family).distinct().join(gate, list(family), "left").select(
        *family,
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("n_keys", F.lit(0)).alias("n_keys"),
        F.when(F.col("n_rows").isNull(), F.lit("the family has no rows")).otherwise(F.col("reason")).alias("reason"),
        F.coalesce("applicability", F.lit(UNSUPPORTED)).alias("applicability"),
    )


def binary_domain(df: DataFrame, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Per group and column: is every cell 0 or 1?  Only a non-empty column proves it."""
    checks = [
        F.coalesce(F.every(F.coalesce(F.col(c).cast("string").isin("0", "1"), F.lit(False))), F.lit(False)).alias(
            f"_b_{c}"
        )
        for c in columns
    ]
    wide = df.groupBy(*group).agg(F.count("*").alias("n_rows"), *checks)
    stacked = ", ".join(f"'{c}', `_b_{c}`" for c in columns)
    return wide.select(*group, "n_rows", F.expr(f"stack({len(columns)}, {stacked}) as (column_name, is_binary)"))


def line_model_guard(df: DataFrame, text: str) -> DataFrame:
    """Reject texts whose lines depend on the newline model, or that start with a mark."""
    return df.withColumn(
        "line_model",
        F.when(F.col(text).startswith(BYTE_ORDER_MARK), F.lit("byte_order_mark"))
        .when(F.col(text).rlike(SPLIT_CHARACTERS), F.lit("ambiguous_lines"))
        .otherwise(F.lit("single")),
    )
