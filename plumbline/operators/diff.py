"""Snapshot, set and cache comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ids import set_digest, stable_id
from plumbline.skew import per_key


def snapshot_diff(before: DataFrame, after: DataFrame, key: Sequence[str], identity: str, verified: bool = True) -> DataFrame:
    """added / removed / changed / unchanged per key; nothing is compared unless both verify."""
    key = list(key)
    b = before.select(*key, F.col(identity).alias("_b"), F.lit(True).alias("_in_b"))
    a = after.select(*key, F.col(identity).alias("_a"), F.lit(True).alias("_in_a"))
    joined = b.join(a, key, "full_outer")
    status = (
        F.when(F.lit(not verified), F.lit("unverified"))
        .when(F.col("_in_b").isNull(), F.lit("added"))
        .when(F.col("_in_a").isNull(), F.lit("removed"))
        .when(F.col("_b").eqNullSafe(F.col("_a")), F.lit("unchanged"))
        .otherwise(F.lit("changed"))
    )
    return joined.select(*key, status.alias("change"))


def divergence(initial: DataFrame, current: DataFrame, unreadable: DataFrame) -> DataFrame:
    """Paths that differ in presence, kind, size or fingerprint, or cannot be read.

    Sides: path, kind, size, fingerprint.
    """
    state = F.struct("kind", "size", "fingerprint").alias("state")
    changed = snapshot_diff(initial.select("path", state), current.select("path", state), ["path"], "state").where(
        F.col("change") != "unchanged"
    )
    return changed.select("path").unionByName(unreadable.select("path")).distinct()


def merge_divergence(observations: DataFrame, run: str) -> DataFrame:
    """Changed paths accumulated over checks, each run keeping its first detection time.

    ``observations``: run, path, detected_at; one output row per run and path.
    """
    first = observations.groupBy(run).agg(F.min("detected_at").alias("first_detected_at"))
    return observations.select(run, "path").distinct().join(first, run)


def checksum_verify(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """missing / unexpected / drifted / verified per path.  Sides: path, digest."""
    joined = declared.select("path", F.col("digest").alias("_d")).join(
        actual.select("path", F.col("digest").alias("_a")), "path", "full_outer"
    )
    return joined.select(
        "path",
        F.when(F.col("_a").isNull(), F.lit("missing"))
        .when(F.col("_d").isNull(), F.lit("unexpected"))
        .when(F.col("_d") == F.col("_a"), F.lit("verified"))
        .otherwise(F.lit("drifted"))
        .alias("status"),
    )


def cache_key(parts: Sequence[Column]) -> Column:
    return stable_id("cache", *parts)


def cache_reuse(previous: DataFrame, current: DataFrame) -> DataFrame:
    """hit / miss / invalidated / uncacheable per scope key.

    ``previous``: scope_key, cache_key.  ``current``: scope_key, cache_key, cacheable.  Only
    ``miss`` and ``invalidated`` rows of the current side need computing again.
    """
    joined = previous.select("scope_key", F.col("cache_key").alias("_p")).join(
        current.select("scope_key", F.col("cache_key").alias("_c"), "cacheable"), "scope_key", "full_outer"
    )
    return joined.select(
        "scope_key",
        F.when(F.col("_c").isNull(), F.lit("invalidated"))
        .when(~F.col("cacheable"), F.lit("uncacheable"))
        .when(F.col("_p").isNull(), F.lit("miss"))
        .when(F.col("_p") == F.col("_c"), F.lit("hit"))
        .otherwise(F.lit("invalidated"))
        .alias("reuse"),
        F.col("_c").isNotNull().alias("is_current"),
    )


def identifier_equality(left: DataFrame, right: DataFrame, column: str, case: Sequence[str] = ()) -> DataFrame:
    """Exact equality of two identifier sets per case, with order-free digests of each side.

    Duplicate, empty or untrimmed identifiers make the case unsupported; nothing is normalised.
    """
    case = list(case)

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*case, F.col(column).cast("string").alias("_id")).agg(F.count("*").alias(name))

    both = side(left, "_l").join(side(right, "_r"), [*case, "_id"], "full_outer").na.fill(0, ["_l", "_r"])
    bad = (
        (F.col("_l") > 1) | (F.col("_r") > 1) | F.coalesce((F.col("_id") == "") | (F.trim("_id") != F.col("_id")), F.lit(True))
    )
    out = both.groupBy(*case).agg(
        F.count_if(F.col("_l") > 0).alias("left_count"),
        F.count_if(F.col("_r") > 0).alias("right_count"),
        F.count_if((F.col("_l") > 0) & (F.col("_r") > 0)).alias("overlap"),
        F.count_if(F.col("_r") == 0).alias("left_only"),
        F.count_if(F.col("_l") == 0).alias("right_only"),
        set_digest(F.when(F.col("_l") > 0, F.col("_id"))).alias("left_digest"),
        set_digest(F.when(F.col("_r") > 0, F.col("_id"))).alias("right_digest"),
        F.some(bad).alias("_bad"),
    )
    state = F.when(F.col("_bad"), F.lit("unsupported")).otherwise(F.lit("applicable"))
    equal = (F.col("left_only") == 0) & (F.col("right_only") == 0)
    return (
        out.withColumn("applicability", state)
        .withColumn(
            "comparison_outcome",
            F.when(F.col("_bad"), F.lit("unknown")).when(equal, F.lit("conformant")).otherwise(F.lit("nonconformant")),
        )
        .drop("_bad")
    )


def multiset_difference(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counter subtraction both ways: rows with a surplus on one side."""
    columns = list(columns)
    l = left.groupBy(*columns).agg(F.count("*").alias("_l"))
    r = right.groupBy(*columns).agg(F.count("*").alias("_r"))
    both = l.join(r, columns, "full_outer").na.fill(0, ["_l", "_r"])
    return both.where("_l <> _r").select(
        *columns,
        F.greatest(F.col("_l") - F.col("_r"), F.lit(0)).alias("left_surplus"),
        F.greatest(F.col("_r") - F.col("_l"), F.lit(0)).alias("right_surplus"),
    )


def symmetric_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    l = left.select(key).distinct().withColumn("_l", F.lit(True))
    r = right.select(key).distinct().withColumn("_r", F.lit(True))
    return l.join(r, key, "full_outer").where(F.col("_l").isNull() | F.col("_r").isNull()).select(
        key, F.when(F.col("_l"), F.lit("left")).otherwise(F.lit("right")).alias("side")
    )


def difference_examples(df: DataFrame, case: Sequence[str], side: str, value: str, n: int = 64) -> DataFrame:
    """The first ``n`` values per case and side with the total count: a top-n report.

    Each task keeps only its own first ``n`` per group before anything is shuffled together.
    """
    keys = [*case, side]
    totals = df.groupBy(*keys).agg(F.count("*").alias("total"))
    salt = F.pmod(F.xxhash64(value), F.lit(64)).alias("_salt")
    local = Window.partitionBy(*keys, "_salt").orderBy(value)
    final = Window.partitionBy(*keys).orderBy(value)
    first = (
        df.select(*keys, value, salt)
        .withColumn("_rn", F.row_number().over(local))
        .where(F.col("_rn") <= n)
        .withColumn("position", F.row_number().over(final))
        .where(F.col("position") <= n)
        .select(*keys, "position", value)
    )
    return first.join(totals, keys)


def union_dedupe(parts: Sequence[DataFrame], record_id: str, digest: str, drop_conflicts: bool) -> tuple[DataFrame, DataFrame]:
    """(records, gaps): union by id; one id with several contents is a gap.

    With ``drop_conflicts`` a conflicting id is dropped, otherwise the content from the earliest
    part is kept and the gap recorded.
    """
    united = reduce(
        DataFrame.unionByName, [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    )
    values = [c for c in united.columns if c not in (record_id, "_part")]
    per_id = united.groupBy(record_id).agg(
        F.count_distinct(digest).alias("contents"),
        F.min_by(F.struct(*values), F.struct("_part", digest)).alias("_v"),
    )
    kept = per_id.where("contents = 1") if drop_conflicts else per_id
    return kept.select(record_id, "_v.*"), per_id.where("contents > 1").select(record_id, "contents")


def ambiguous_claims(candidates: DataFrame, path: str, record: str) -> DataFrame:
    """Files claimed by one record only; a file claimed by two is dropped."""
    least, most = F.min(record).alias(record), F.max(record).alias("_most")
    claims = per_key(candidates, [path], candidates.count(), [least, most], [least, F.max("_most").alias("_most")])
    return claims.where(F.col(record) == F.col("_most")).drop("_most")


def obligation_difference(df: DataFrame, required: str, present: str, forbidden: str) -> DataFrame:
    """required minus present, required that are forbidden, present that are forbidden."""
    return df.select(
        "*",
        F.array_sort(F.array_except(required, present)).alias("omitted"),
        F.array_sort(F.array_intersect(required, forbidden)).alias("contradictory"),
        F.array_sort(F.array_intersect(present, forbidden)).alias("present_forbidden"),
    )
