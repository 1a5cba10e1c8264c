"""File inventories: identity tiers under byte budgets, manifests and their verification."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.ids import set_digest
from plumbline.functions.values import is_checksum_manifest, language_of, role_of, safe_relative_path
from plumbline.session import cut_lineage
from plumbline.skew import numbered, running, with_blocks

ROWS_PER_BLOCK = 2_000_000
# Byte budgets and the sample size of one region.
FULL_BUDGET = 5_000_000
SAMPLE_BUDGET = 1_000_000
MATERIAL_BUDGET = 16 * 1024 * 1024
SAMPLE_CHUNK = 4096
CHECKSUM_LINE = r"^([a-f0-9]{64})  (.+)$"


@dataclass(frozen=True)
class Budget:
    full: int = FULL_BUDGET
    sampled: int = SAMPLE_BUDGET
    material: int = MATERIAL_BUDGET
    chunk: int = SAMPLE_CHUNK


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path and size of every file below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(folder)
        .select("path", F.col("length").alias("size"))
    )


def greedy_budget(files: DataFrame, snapshot: str, size: str, budget: int, order: Sequence[str | Column]) -> DataFrame:
    """``fits``: taken by a reader that walks each snapshot in order and skips what does not fit.

    A skipped file leaves room for smaller ones, so one running sum is not enough.  Each round
    takes every file up to the first misfit of its snapshot; everything larger than the room
    left then can never fit and goes with it.  Rounds end when no snapshot has a misfit.
    """
    ranked = numbered(files, order)
    left, blocks = with_blocks(ranked.select(snapshot, "idx", F.col(size).alias("_size")), "idx", ROWS_PER_BLOCK)
    left = left.withColumn("_room", F.lit(budget).cast("long"))
    taken: DataFrame | None = None
    while True:
        summed = running(left, blocks, [snapshot], [F.col("idx")], F.col("_size"), "sum", "_upto")
        summed = cut_lineage(summed)
        misfit = summed.where("_upto > _room").groupBy(snapshot).agg(F.min("idx").alias("_miss"))
        state = summed.join(misfit, snapshot, "left")
        now = state.where(F.col("_miss").isNull() | (F.col("idx") < F.col("_miss"))).select(snapshot, "idx", "_size")
        taken = now if taken is None else taken.unionByName(now)
        if misfit.isEmpty():
            break
        spent = now.groupBy(snapshot).agg(F.sum("_size").alias("_spent"))
        rest = state.where(F.col("idx") > F.col("_miss")).join(spent, snapshot, "left")
        room = F.col("_room") - F.coalesce("_spent", F.lit(0))
        left = cut_lineage(
            rest.withColumn("_room", room).where("_size <= _room").select(*left.columns)
        )
    flags = taken.select("idx").withColumn("fits", F.lit(True))
    return ranked.join(flags, "idx", "left").withColumn("fits", F.coalesce("fits", F.lit(False)))


def _full_digest(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as handle:
        while chunk := handle.read(1 << 20):
            digest.update(chunk)
    return "sha256:" + digest.hexdigest()


def _sampled_digest(path: str, size: int, chunk: int, domain: bytes) -> tuple[str, int]:
    read = min(chunk, size)
    spots = sorted({0, max(0, (size - read) // 2), max(0, size - read)})
    digest = hashlib.sha256(domain + size.to_bytes(8, "big"))
    with open(path, "rb") as handle:
        for spot in spots:
            handle.seek(spot)
            data = handle.read(read)
            digest.update(spot.to_bytes(8, "big") + len(data).to_bytes(8, "big") + data)
    return "sha256:" + digest.hexdigest(), read * len(spots)


def asset_inventory(
    files: DataFrame, budget: Budget = Budget(), *, domain: str = "plumbline-sparse-v1", declared: DataFrame | None = None
) -> DataFrame:
    """Identity of every file: full digest, sampled fingerprint, declared checksum or none.

    ``files``: snapshot, path (openable by every executor), relative, size, material, preferred.
    ``declared`` (snapshot, relative, digest) upgrades a file without a full digest to the
    ``manifest`` tier.  Sizes decide the budgets; contents are read once, on the executors.
    """
    role = role_of(F.col("relative"))
    priority = (
        F.when(role.isin("analysis_source", "report_candidate"), 0)
        .when(is_checksum_manifest(F.col("relative")), 1)
        .when(role == "data_or_result", 3)
        .otherwise(2)
    )
    named = files.select(
        "*", role.alias("role"), language_of(F.col("relative")).alias("language"), priority.alias("priority")
    )
    first = greedy_budget(named.where("material"), "snapshot", "size", budget.material, ["snapshot", "preferred", "priority", "relative"])
    chosen = first.drop("idx").withColumnRenamed("fits", "_material")
    rest = chosen.where(~F.col("_material")).drop("_material").unionByName(named.where("NOT material"))
    order = ["snapshot", F.desc("material"), F.desc("preferred"), "priority", "relative"]
    second = greedy_budget(rest, "snapshot", "size", budget.full, order).withColumnRenamed("fits", "_full")
    # Sampled reads: at most three regions a file, in the same order, until the budget is spent.
    sampled, blocks = with_blocks(second.where(~F.col("_full")), "idx", ROWS_PER_BLOCK)
    size, chunk = F.col("size"), F.lit(budget.chunk)
    cost = F.when(size <= chunk, size).when(size == chunk + 1, 2 * chunk).otherwise(3 * chunk)
    spent = running(sampled, blocks, ["snapshot"], [F.col("idx")], cost, "sum", "_before", inclusive=False)
    room = F.lit(budget.sampled) - F.coalesce("_before", F.lit(0))
    plan = F.when(room > 0, F.lit("sampled")).otherwise(F.lit("none"))
    cols = ["snapshot", "path", "relative", "size", "role", "language", "plan", "room"]
    whole = {"plan": F.lit("full"), "room": F.lit(0).cast("long")}
    planned = (
        chosen.where("_material").withColumns(whole).select(*cols)
        .unionByName(second.where("_full").withColumns(whole).select(*cols))
        .unionByName(spent.withColumns({"plan": plan, "room": room.cast("long")}).select(*cols))
    )
    tag = domain.encode() + b"\0"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            digests, reads, tiers = [], [], []
            for path, size, plan_, room_ in zip(batch["path"], batch["size"], batch["plan"], batch["room"]):
                local = path.removeprefix("file:")
                tier, digest, n = "unidentified", None, 0
                try:
                    if plan_ == "full":
                        digest, n, tier = _full_digest(local), os.path.getsize(local), "full_digest"
                    elif plan_ == "sampled":
                        region = min(budget.chunk, max(1, int(room_) // min(3, int(room_))))
                        digest, n = _sampled_digest(local, int(size), region, tag)
                        tier = "weak_fingerprint"
                except OSError:
                    pass
                digests.append(digest)
                reads.append(n)
                tiers.append(tier)
            out = batch.drop(columns=["plan", "room"])
            yield out.assign(tier=tiers, digest=digests, bytes_read=reads)

    schema = (
        "snapshot string, path string, relative string, size bigint, role string, language string, "
        "tier string, digest string, bytes_read bigint"
    )
    found = planned.mapInPandas(read, schema)
    if declared is None:
        return found
    claim = declared.select("snapshot", "relative", F.col("digest").alias("_declared"))
    up = (F.col("tier") != "full_digest") & F.col("_declared").isNotNull()
    return (
        found.join(claim, ["snapshot", "relative"], "left")
        .withColumn("digest", F.when(up, F.col("_declared")).otherwise(F.col("digest")))
        .withColumn("tier", F.when(up, F.lit("manifest")).otherwise(F.col("tier")))
        .drop("_declared")
    )


def checksum_manifest(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(declarations, manifests): one malformed line rejects its manifest, one target declared
    twice is ambiguous and dropped.

    ``lines``: manifest_path, line_number, line.
    """
    target = F.regexp_extract("line", CHECKSUM_LINE, 2)
    content = (F.col("line") != "") & ~F.col("line").startswith("#")
    bad = content & ~(
        F.col("line").rlike(CHECKSUM_LINE) & safe_relative_path(target) & (target != F.col("manifest_path"))
    )
    manifests = lines.groupBy("manifest_path").agg(
        F.count_if(content).alias("declarations"),
        F.when(F.some(bad) | (F.count_if(content) == 0), F.lit("invalid")).otherwise(F.lit("parsed")).alias("status"),
    )
    parsed = manifests.where("status = 'parsed'").select("manifest_path")
    said = lines.where(content & ~bad).join(parsed, "manifest_path", "left_semi").select(
        target.alias("target_path"),
        F.struct(
            F.concat(F.lit("sha256:"), F.regexp_extract("line", CHECKSUM_LINE, 1)).alias("digest"),
            "manifest_path",
            "line_number",
        ).alias("d"),
    )
    one = said.groupBy("target_path").agg(F.count("*").alias("_n"), F.any_value("d").alias("d")).where("_n = 1")
    return one.select("target_path", "d.*"), manifests


def manifest(files: DataFrame, snapshot: str) -> tuple[DataFrame, DataFrame]:
    """(entries, roots): path, digest and size of every file, and one digest of the whole list."""
    entries = files.select(snapshot, "path", "digest", "size")
    roots = entries.groupBy(snapshot).agg(
        F.count("*").alias("files"),
        F.sum("size").alias("bytes"),
        set_digest(F.concat_ws("|", "path", "digest", "size")).alias("root_digest"),
    )
    return entries, roots


def manifest_verify(entries: DataFrame, roots: DataFrame, actual: DataFrame, snapshot: str) -> DataFrame:
    """Per snapshot: exact file set, every digest, and the digest of the list."""
    recomputed = manifest(entries, snapshot)[1].select(snapshot, F.col("root_digest").alias("_root"))
    told = entries.select(snapshot, "path", F.col("digest").alias("_d"), F.lit(1).alias("_in_d"))
    seen = actual.select(snapshot, "path", F.col("digest").alias("_a"), F.lit(1).alias("_in_a"))
    joined = told.join(seen, [snapshot, "path"], "full_outer").groupBy(snapshot).agg(
        F.count_if(F.col("_in_a").isNull()).alias("missing"),
        F.count_if(F.col("_in_d").isNull()).alias("unexpected"),
        F.count_if((F.col("_in_a") + F.col("_in_d") == 2) & ~F.col("_d").eqNullSafe(F.col("_a"))).alias("drifted"),
    )
    clean = (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("drifted") == 0)
    same = F.coalesce(F.col("root_digest") == F.col("_root"), F.lit(False))
    return (
        joined.join(roots.select(snapshot, "root_digest"), snapshot, "left")
        .join(recomputed, snapshot, "left")
        .select(snapshot, "missing", "unexpected", "drifted", same.alias("list_intact"), (clean & same).alias("verified"))
    )
