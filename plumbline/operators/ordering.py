"""Latest records, merges, monotone checks, segment clocks and priority order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ids import sha256_digest
from plumbline.functions.values import is_checksum_manifest, role_of
from plumbline.skew import running, with_blocks

ROWS_PER_BLOCK = 2_000_000
# Deadline modes as (scheduling cutoff, hard limit) in seconds.
MODE_LIMITS = {"quick": (120.0, 300.0), "standard": (480.0, 600.0), "publication": (1500.0, 1800.0)}


def latest_per_id(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last record of each id: one aggregation, combined map-side, no window."""
    values = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*key, "_v.*")


def merge_by_id(prior: DataFrame, current: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """prior then current, later wins; ``first_seen`` keeps the first-seen order."""
    values = [c for c in prior.columns if c not in key]
    both = prior.withColumn("_part", F.lit(0)).unionByName(current.withColumn("_part", F.lit(1)))
    return (
        both.groupBy(*key)
        .agg(
            F.max_by(F.struct(*values), F.struct("_part", order)).alias("_v"),
            F.min(F.struct("_part", order)).alias("first_seen"),
        )
        .select(*key, "_v.*", F.col("first_seen._part").alias("first_part"), F.col(f"first_seen.{order}").alias("first_order"))
    )


def monotone_check(
    df: DataFrame, group: Sequence[str], order: str, value: str, *, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Rows per group whose value is below the one before it; groups may be any size.

    Rows that share a position are taken from the least value up, so the order of the input never matters.
    """
    blocked, blocks = with_blocks(df.select(*group, order, value), order, rows_per_block, ties=[value])
    previous = F.struct(F.col(order).alias("o"), F.col(value).alias("v"))
    seen = running(blocked, blocks, group, [F.col(order), F.col(value)], previous, "max", "_prev", inclusive=False)
    return seen.groupBy(*group).agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(value) < F.col("_prev.v")).alias("decreases"),
        F.every(F.coalesce(F.col(value) >= F.col("_prev.v"), F.lit(True))).alias("monotone"),
    )


def segment_clock(
    events: DataFrame,
    segment: str,
    at: str,
    tie: str,
    state: str,
    *,
    paused_state: str,
    hard_seconds: float,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Per segment: time charged to active and paused by the state before each event.

    ``exhausted_at`` is the first event at which active time reaches the hard limit; nothing
    after that event is charged.  Segments may be any size.
    """
    micros = events.select(segment, F.unix_micros(F.col(at).cast("timestamp")).alias("_t"), F.col(tie).alias("_k"), F.col(state).alias("_s"))
    blocked, blocks = with_blocks(micros, "_t", rows_per_block, ties=["_k"])
    order = [F.col("_t"), F.col("_k")]
    before = F.struct(F.col("_t").alias("t"), F.col("_k").alias("k"), F.col("_s").alias("s"))
    gaps = running(blocked, blocks, [segment], order, before, "max", "_prev", inclusive=False)
    gap = F.coalesce(F.col("_t") - F.col("_prev.t"), F.lit(0))
    paused = F.coalesce(F.col("_prev.s") == paused_state, F.lit(False))
    charged = gaps.select(
        segment, "_t", "_k", *(["_block"] if "_block" in gaps.columns else []),
        F.when(paused, F.lit(0)).otherwise(gap).alias("_active"),
        F.when(paused, gap).otherwise(F.lit(0)).alias("_paused"),
    )
    limit = int(hard_seconds * 1_000_000)
    spent = running(charged, blocks, [segment], order, F.col("_active"), "sum", "_spent")
    # Charged: every gap up to and including the first event that reaches the limit.
    open_before = F.col("_spent") - F.col("_active") < limit
    return spent.groupBy(segment).agg(
        F.count("*").alias("events"),
        (F.sum(F.when(open_before, F.col("_active")).otherwise(0)) / 1e6).alias("active_seconds"),
        (F.sum(F.when(open_before, F.col("_paused")).otherwise(0)) / 1e6).alias("paused_seconds"),
        F.min(F.when(F.col("_spent") >= limit, F.col("_t"))).alias("exhausted_micros"),
        (F.max("_spent") >= limit).alias("exhausted"),
    )


def ledger_links(segments: DataFrame, ledger: str, seq: str, run: str, parent: str) -> DataFrame:
    """Segments that repeat a run, or whose parent is not an earlier segment of the ledger."""
    firsts = segments.groupBy(ledger, run).agg(F.min(seq).alias("_first"), F.count("*").alias("_n"))
    root = segments.groupBy(ledger).agg(F.min(seq).alias("_root"))
    parents = firsts.select(ledger, F.col(run).alias(parent), F.col("_first").alias("_parent_first"))
    joined = (
        segments.join(firsts, [ledger, run]).join(root, ledger).join(parents, [ledger, parent], "left")
    )
    orphan = (F.col(seq) > F.col("_root")) & F.coalesce(F.col("_parent_first") >= F.col(seq), F.lit(True))
    fault = F.when(F.col("_n") > 1, F.lit("repeated_run")).when(orphan, F.lit("unlinked_parent"))
    return joined.withColumn("fault", fault).where(F.col("fault").isNotNull()).select(ledger, seq, run, parent, "fault")


def canonical_digest(df: DataFrame, case: Sequence[str], record_id: str, columns: Sequence[str]) -> DataFrame:
    """Digest of each case's records that ignores input order.

    Records are digested by id in 4,096 hash buckets, then the bucket digests in bucket order,
    so no case is ever gathered in one list.
    """
    row = F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"})
    leaf = df.select(
        *case,
        F.conv(F.substring(F.sha2(F.col(record_id).cast("string"), 256), 1, 3), 16, 10).cast("int").alias("_b"),
        F.sha2(F.concat_ws("|", F.col(record_id).cast("string"), row), 256).alias("_d"),
    )
    pieces = [
        F.sum(F.conv(F.substring("_d", 1 + 15 * i, 15), 16, 10).cast("decimal(19,0)")).cast("string") for i in range(4)
    ]
    buckets = leaf.groupBy(*case, "_b").agg(F.count("*").alias("_n"), F.concat_ws(":", *pieces).alias("_x"))
    return buckets.groupBy(*case).agg(
        F.sum("_n").alias("records"),
        sha256_digest(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_x"))), lambda s: s["_x"]), "|")
        ).alias("digest"),
    )


def priority_order(files: DataFrame, path: str, material: str, preferred: str) -> DataFrame:
    """Reading priority: selected material, preferred, sources and reports, manifests, rest, data."""
    role = role_of(F.col(path))
    rank = (
        F.when(role.isin("analysis_source", "report_candidate"), 0)
        .when(is_checksum_manifest(F.col(path)), 1)
        .when(role == "data_or_result", 3)
        .otherwise(2)
    )
    return files.withColumn("role", role).withColumn("priority", rank).orderBy(
        F.desc(material), F.desc(preferred), "priority", path
    )
