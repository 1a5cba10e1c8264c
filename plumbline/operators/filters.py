"""Literal predicates, selection funnels and the row subsets checks are computed over."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.contracts import ContractError, Predicate

# Operators that make a decision a threshold rather than a plain filter.
THRESHOLD_OPS = ("<", "<=", ">", ">=")


def predicate(p: Predicate) -> Column:
    column = F.col(p.column)
    if p.op in ("in", "not_in"):
        member = column.isin(list(p.value))
        return member if p.op == "in" else ~member
    compare = {
        "==": column.__eq__,
        "!=": column.__ne__,
        "<": column.__lt__,
        "<=": column.__le__,
        ">": column.__gt__,
        ">=": column.__ge__,
    }
    if p.op not in compare:
        raise ContractError(f"unsupported operator {p.op}")
    return compare[p.op](F.lit(p.value))


def literal_filter(df: DataFrame, predicates: Sequence[Predicate]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [predicate(p) for p in predicates]))


def selection_funnel(df: DataFrame, predicates: Sequence[Predicate], group: Sequence[str] = ()) -> DataFrame:
    """One row per predicate: rows kept alone, kept by all predicates so far, and removed."""
    keep = [F.coalesce(predicate(p), F.lit(False)) for p in predicates]
    so_far = [reduce(lambda a, b: a & b, keep[: i + 1]) for i in range(len(keep))]
    wide = df.groupBy(*group).agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(k).alias(f"_alone{i}") for i, k in enumerate(keep)],
        *[F.count_if(k).alias(f"_all{i}") for i, k in enumerate(so_far)],
    )
    rows = []
    for i, p in enumerate(predicates):
        before = "n_rows" if i == 0 else f"_all{i - 1}"
        kind = "threshold" if p.op in THRESHOLD_OPS else "filter"
        label = (p.name or f"{p.column} {p.op} {p.value}").replace("'", "''")
        rows.append(f"{i + 1}, '{label}', '{kind}', _alone{i}, _all{i}, {before} - _all{i}")
    return wide.select(
        *group,
        "n_rows",
        F.expr(
            f"stack({len(rows)}, {', '.join(rows)}) as "
            "(step, predicate, decision_kind, kept_alone, kept_so_far, removed_here)"
        ),
    )


def contrast_filter(df: DataFrame, condition: str, reference: str, test: str, group: Sequence[str] = ()) -> DataFrame:
    """Per group: rows at the two levels; unsupported unless both are present."""
    arms = df.groupBy(*group).agg(
        F.count_if(F.col(condition) == reference).alias("reference_rows"),
        F.count_if(F.col(condition) == test).alias("test_rows"),
    )
    both = (F.col("reference_rows") > 0) & (F.col("test_rows") > 0)
    return arms.withColumn("applicability", F.when(both, F.lit("applicable")).otherwise(F.lit("unsupported")))


def significant_subset(df: DataFrame, adjusted: str, alpha: float) -> DataFrame:
    return df.where(F.col(adjusted) <= alpha)


def pvalue_domain_count(df: DataFrame, column: str, group: Sequence[str] = ()) -> DataFrame:
    """Calibrated p-values per group; one bad cell leaves the whole group without a count."""
    number = F.col(column).try_cast("double")
    good = F.coalesce(number.between(0, 1) & ~F.isnan(number), F.lit(False))
    return df.groupBy(*group).agg(
        F.count("*").alias("n_rows"),
        F.when(F.every(good), F.count("*")).alias("calibrated_pvalues"),
        F.when(F.every(good), F.lit("applicable")).otherwise(F.lit("unsupported")).alias("applicability"),
    )


def open_items(records: DataFrame, verified_runs: DataFrame, run: str, status: str) -> DataFrame:
    return records.where(F.col(status) == "open").join(verified_runs.select(run).distinct(), run, "left_semi")
