"""Evidence graphs: the one simple path between two nodes, and bounded closures."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage
from plumbline.skew import HEAVY_PARTS

MAX_PATH_EDGES = 8


def unique_paths(
    edges: DataFrame, pairs: DataFrame, profiles: Sequence[str], max_edges: int = MAX_PATH_EDGES
) -> DataFrame:
    """For each (source, target): the path when exactly one simple path of allowed edges exists.

    ``edges``: source, target, profile.  Parallel edges are collapsed to a multiplicity.  A pair is walked from the end
    that many pairs share, halfway; from its other end only if walks of that length are left.  Walks are counted, one
    row for each end and node, however many there are; a single walk keeps its nodes.
    The shortest walks of a pair are paths, and a walk whose nodes are known is seen to be one.  Only pairs that this
    leaves open, where several longer walks may or may not return to a node, are walked path by path.
    Output: source, target, n_paths (0, 1, or 2 for at least 2), path (node array when exactly one).
    """
    hop = cut_lineage(
        edges.where(F.col("profile").isin(*profiles) & (F.col("source") != F.col("target")))
        .groupBy("source", "target")
        .agg(F.count("*").alias("m"))
        .select(F.col("source").alias("node"), F.col("target").alias("next"), "m")
    )
    back = hop.select(F.col("next").alias("node"), F.col("node").alias("next"), "m")
    asked = _first_ends(cut_lineage(pairs.select("source", "target").distinct()))
    ahead = _from_one_end(hop, back, asked.where("NOT flipped").select("end", "other"), max_edges).withColumn("flipped", F.lit(False))
    behind = _from_one_end(back, hop, asked.where("flipped").select("end", "other"), max_edges).withColumn("flipped", F.lit(True))
    # Few rows share the other end, so it leads the keys that are sorted.
    keys = ["other", "end", "flipped"]
    summed = asked.join(ahead.unionByName(behind), keys, "left").groupBy(*keys).agg(
        (F.sum("known") + F.min_by("open", "n")).alias("low"), (F.sum("open") - F.min_by("open", "n")).alias("open"), F.min("path").alias("path")
    )
    sums = cut_lineage(
        summed.select(
            F.when(F.col("flipped"), F.col("other")).otherwise(F.col("end")).alias("source"),
            F.when(F.col("flipped"), F.col("end")).otherwise(F.col("other")).alias("target"),
            F.coalesce("low", F.lit(0)).alias("low"),
            F.coalesce("open", F.lit(0)).alias("open"),
            F.when(F.col("flipped"), F.reverse("path")).otherwise(F.col("path")).alias("path"),
        )
    )
    undecided = sums.where("low < 2 AND open > 0").select("source", "target")
    if not undecided.isEmpty():
        walked = _walk(hop, undecided, max_edges)
        sums = sums.where("low >= 2 OR open = 0").select("source", "target", "low", "path").unionByName(walked)
    return sums.select(
        "source",
        "target",
        F.least("low", F.lit(2)).cast("long").alias("n_paths"),
        F.when(F.col("low") == 1, F.col("path")).alias("path"),
    )


def _first_ends(asked: DataFrame) -> DataFrame:
    """(end, other, flipped): the end a pair is walked from first; ``flipped`` if that is its target, null if both ends are
    one node or one is null.

    Sources that hold more than 1/HEAVY_PARTS of all pairs go first, then such targets, both broadcast; the other pairs
    go from the side with fewer ends.
    """
    wanted = asked.where("source <> target")
    sources = cut_lineage(wanted.groupBy("source").agg(F.count("*").alias("n")))
    total = sources.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    shared = (F.col("n") > 1) & (F.col("n") * HEAVY_PARTS > total)
    from_source = F.broadcast(sources.where(shared).select("source", F.lit(False).alias("_from_source")))
    left = wanted.join(from_source, "source", "left_anti")
    targets = cut_lineage(left.groupBy("target").agg(F.count("*").alias("n")))
    from_target = F.broadcast(targets.where(shared).select("target", F.lit(True).alias("_from_target")))
    fewer = targets.where(~shared).count() < sources.where(~shared).count()
    side = F.coalesce("_from_source", "_from_target", F.lit(fewer))
    turned = asked.join(from_source, "source", "left").join(from_target, "target", "left").select(
        "source", "target", F.when(F.col("source") != F.col("target"), side).alias("flipped")
    )
    return turned.select(
        F.when(F.col("flipped"), F.col("target")).otherwise(F.col("source")).alias("end"),
        F.when(F.col("flipped"), F.col("source")).otherwise(F.col("target")).alias("other"),
        "flipped",
    )


def _from_one_end(hop: DataFrame, back: DataFrame, pairs: DataFrame, max_edges: int) -> DataFrame:
    """(end, other, n, known, open, path): walks of n edges from ``end`` to ``other``, for ``pairs`` and perhaps further ones.

    One row for each n; ``known`` walks are paths, ``open`` ones may return to a node.
    Walks up to half of ``max_edges`` come from ``end`` alone.  A longer one meets after that half, so others are walked
    back only for ends that have walks of that length.
    """
    half = (max_edges + 1) // 2
    levels, last = _walks(hop, pairs.select("end").distinct(), half)
    known, open_ = F.when(F.col("path").isNull(), 0).otherwise(F.col("ways")), F.when(F.col("path").isNull(), F.col("ways")).otherwise(0)
    found = levels.where("h > 0").select("end", F.col("node").alias("other"), F.col("h").alias("n"), known.alias("known"), open_.alias("open"), "path")
    if max_edges == half or last.isEmpty():
        return found
    longer = pairs.join(last.select("end").distinct(), "end", "left_semi")
    behind, _ = _walks(back, longer.select(F.col("other").alias("end")).distinct(), max_edges - half)
    met = (
        behind.where("h > 0").select(F.col("end").alias("other"), "node", F.col("h").alias("h2"), F.col("ways").alias("w2"), F.col("path").alias("p2"))
        .join(longer, "other")
        .join(last, ["end", "node"])
        .select(
            "end", "other", (F.col("h") + F.col("h2")).alias("n"),
            F.concat("path", F.slice(F.reverse("p2"), 2, max_edges + 1)).alias("path"),
            (F.col("ways") * F.col("w2")).alias("ways"),
        )
    )
    met = met.where("path IS NULL OR size(array_distinct(path)) = size(path)").groupBy("end", "other", "n")
    return found.unionByName(met.agg(F.sum(known).alias("known"), F.sum(open_).alias("open"), F.min("path").alias("path")))


def _walks(hop: DataFrame, ends: DataFrame, edges: int) -> tuple[DataFrame, DataFrame]:
    """(end, node, h, ways, path): walks of h edges from each end to a node, 2 for more than one; and those of ``edges``.

    ``path`` holds the nodes where all walks, over parallel edges, have the same.  If they return to a node they go.
    """
    level = cut_lineage(ends.select("end", F.col("end").alias("node"), F.lit(0).alias("h"), F.lit(1).cast("long").alias("ways"), F.array("end").alias("path")))
    levels = level
    for h in range(1, edges + 1):
        step = (
            level.join(hop, "node")
            .where(F.col("path").isNull() | ~F.array_contains("path", F.col("next")))
            .groupBy(F.col("next").alias("node"), "end")
            .agg(
                F.least(F.sum(F.col("ways") * F.col("m")), F.lit(2)).alias("ways"),
                F.count("*").alias("into"),
                F.min(F.array_append("path", F.col("next"))).alias("path"),
            )
        )
        level = cut_lineage(step.select("end", "node", F.lit(h).alias("h"), "ways", F.when(F.col("into") == 1, F.col("path")).alias("path")))
        if level.isEmpty():
            break
        levels = levels.unionByName(level)
    return levels, level


def _walk(hop: DataFrame, wanted: DataFrame, max_edges: int) -> DataFrame:
    """(source, target, low, path): paths node by node.  Nodes that cannot reach the target within the edges left are
    never entered, and a pair leaves once it has two paths, since a third cannot change its answer."""
    distance = _distance_to(hop, wanted.select("target").distinct(), max_edges)
    toward = cut_lineage(
        hop.join(distance.select("target", F.col("node").alias("next"), F.col("d").alias("d_next")), "next")
    )
    walk = wanted.select(
        "source", "target", F.col("source").alias("node"), F.array("source").alias("path"), F.lit(1).cast("long").alias("ways")
    )
    found: DataFrame | None = None
    for used in range(1, max_edges + 1):
        step = (
            walk.join(toward.where(F.col("d_next") <= max_edges - used), ["target", "node"])
            .where(~F.array_contains("path", F.col("next")))
            .select(
                "source",
                "target",
                F.col("next").alias("node"),
                F.array_append("path", F.col("next")).alias("path"),
                (F.col("ways") * F.col("m")).alias("ways"),
            )
        )
        step = cut_lineage(step)
        done = step.where(F.col("node") == F.col("target")).select("source", "target", "path", "ways")
        found = done if found is None else found.unionByName(done)
        walk = step.where(F.col("node") != F.col("target"))
        if walk.isEmpty():
            break
        settled = found.groupBy("source", "target").agg(F.sum("ways").alias("n")).where("n >= 2")
        walk = walk.join(settled, ["source", "target"], "left_anti")
    return found.groupBy("source", "target").agg(F.sum("ways").alias("low"), F.min("path").alias("path"))


def _distance_to(hop: DataFrame, targets: DataFrame, max_edges: int) -> DataFrame:
    """(target, node, d): least number of edges from node to target, up to ``max_edges``."""
    reached = cut_lineage(targets.select("target", F.col("target").alias("node"), F.lit(0).alias("d")))
    front = reached
    back = hop.select(F.col("node").alias("prior"), F.col("next").alias("node"))
    for d in range(1, max_edges + 1):
        front = cut_lineage(
            front.join(back, "node")
            .select("target", F.col("prior").alias("node"))
            .distinct()
            .join(reached, ["target", "node"], "left_anti")
            .withColumn("d", F.lit(d))
        )
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached


def lineage_closure(edges: DataFrame, seeds: DataFrame, max_edges: int | None = None) -> DataFrame:
    """Descendants of each seed with their depth and the relations of one shortest path.

    The walk ends when it finds no further node, or after ``max_edges`` if given.  ``edges``: source, relation, target.  ``seeds``: seed.
    """
    hop = cut_lineage(edges.select(F.col("source").alias("node"), "relation", F.col("target").alias("next")).distinct())
    reached = cut_lineage(
        seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.lit("").alias("relations"))
    )
    front = reached
    for depth in count(1) if max_edges is None else range(1, max_edges + 1):
        step = front.join(hop, "node").select(
            "seed",
            F.col("next").alias("node"),
            F.concat_ws("/", F.nullif("relations", F.lit("")), "relation").alias("relations"),
        )
        front = cut_lineage(
            step.groupBy("seed", "node")
            .agg(F.min("relations").alias("relations"))
            .join(reached, ["seed", "node"], "left_anti")
            .select("seed", "node", F.lit(depth).alias("depth"), "relations")
        )
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached.where("depth > 0")
