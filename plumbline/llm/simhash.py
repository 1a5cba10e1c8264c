"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are dealt into tiles by population count.  Two fingerprints within ``radius`` bits differ by at
most ``radius`` in population count, in total and summed over the quarters, so tile pairs further apart are skipped.
Each remaining pair of tiles is one task-sized group compared by exclusive-or and bit counts; it returns a star for
each linked group, never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.rows import LOWER, annotate, texts
from plumbline.session import cut_lineage

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints of a tile.  Two tiles are 1 MB and at most 2**34 comparisons, most of them skipped by quarters.
TILE = 1 << 16
#: Comparisons held at once inside a task.
CELLS_AT_ONCE = 1 << 20

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_QUARTERS = np.array([0, 16, 32, 48], dtype=np.uint64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes; no words: 0."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(shingle, len(words))
    last = stops[width - 1 :].tolist()
    first = [0, *(stops[: len(last) - 1] + 1).tolist()]
    hashed = xxhash.xxh64_intdigest
    found = np.fromiter(
        (hashed(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, len(last)
    ).astype(">u8")
    octets = found.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(counts * 2 > len(last)).tobytes(), "big", signed=True)


def fingerprints(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fingerprint`` (long) of each row; null and empty texts have fingerprint 0."""

    def make() -> Callable:
        return lambda column: [[fingerprint(t, shingle) for t in texts(column)]]

    fields = T.StructType([T.StructField("fingerprint", T.LongType(), False)])
    return annotate(documents, [text], make, fields, keep=[doc_id])


def _roots(size: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Joins nodes 0..size-1; each call takes links and returns every node's smallest linked node so far."""
    root = np.arange(size)

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        nonlocal root
        while True:
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                return root
            a, b = a[open_], b[open_]
            np.minimum.at(root, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])
            while not np.array_equal(root[root], root):
                root = root[root]

    return join


def link_tiles(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (fingerprint, smallest-placed fingerprint) that join what is linked in a tile or between two tiles."""
    codes = (left if right is None else np.concatenate([left, right])).astype(np.int64).view(np.uint64)
    quarters = np.bitwise_count((codes[:, None] >> _QUARTERS) & np.uint64(0xFFFF)).astype(np.int64)
    cell = quarters @ np.array([17**3, 17**2, 17, 1])
    order = np.argsort(cell, kind="stable")
    side = np.zeros(len(codes), dtype=bool)
    side[len(left) :] = True
    starts = np.flatnonzero(np.concatenate([[True], np.diff(cell[order]) != 0]))
    stops = np.append(starts[1:], len(order))
    at = quarters[order[starts]]
    of_cell = np.repeat(np.arange(len(starts)), stops - starts)
    join = _roots(len(codes))
    root = np.arange(len(codes))
    for k in range(len(starts)):
        near = np.abs(at[k:] - at[k]).sum(axis=1) <= radius
        mine = order[starts[k] : stops[k]]
        theirs = order[starts[k] :][near[of_cell[starts[k] :] - k]]
        step = max(1, CELLS_AT_ONCE // max(1, len(theirs)))
        for i in range(0, len(mine), step):
            some = mine[i : i + step]
            close = np.bitwise_count(codes[some][:, None] ^ codes[theirs]) <= radius
            if right is not None:
                close &= side[some][:, None] != side[theirs]
            a, b = np.nonzero(close)
            root = join(some[a], theirs[b])
    spokes = np.flatnonzero(root != np.arange(len(codes)))
    return codes[spokes].view(np.int64), codes[root[spokes]].view(np.int64)


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) whose components are those of all fingerprints within ``radius`` bits; ``prints`` are distinct."""
    ones = F.bit_count("fingerprint").cast("int")
    counts = {r[0]: r[1] for r in prints.groupBy(ones.alias("ones")).count().collect()}  # at most 65 rows
    first, tiles = {}, 0
    for n in range(65):
        first[n] = tiles
        tiles += -(-counts.get(n, 0) // tile)
    first[65] = tiles
    bounds = F.array(*[F.lit(first[n]) for n in range(66)])
    here = F.element_at(bounds, ones + 1)
    width = F.greatest(F.element_at(bounds, ones + 2) - here, F.lit(1))
    low = F.element_at(bounds, F.greatest(ones - radius, F.lit(0)) + 1)
    high = F.element_at(bounds, F.least(ones + radius, F.lit(64)) + 2) - 1
    dealt = prints.select(
        "fingerprint",
        (here + F.pmod(F.xxhash64("fingerprint"), width).cast("int")).alias("tile"),
        F.explode(F.sequence(low, high)).alias("other"),
    ).select("fingerprint", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = pdf["low"].iat[0], pdf["high"].iat[0]
        code, tile = pdf["fingerprint"].to_numpy(), pdf["tile"].to_numpy()
        a, b = link_tiles(code[tile == low], None if low == high else code[tile == high], radius)
        return pd.DataFrame({"a": a, "b": b})

    return dealt.groupBy("low", "high").applyInPandas(compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node reachable) for each node of the links (a, b); null-free.

    Alternates large-star and small-star steps, each written as a table, until nothing changes.  A node's
    neighbours are only ever reduced to their minimum, so a node of any degree is safe.
    """
    def written(links: DataFrame) -> tuple[DataFrame, tuple]:
        table = cut_lineage(links.where("a <> b").distinct())
        return table, table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()

    edges, state = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large, _ = written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        edges, now = written(large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")))
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def near_duplicates(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    tile: int = TILE,
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``: the smallest doc_id reachable over links.

    Words are parted by ASCII white space, A-Z in lower case.  Null, empty and wordless texts have fingerprint zero
    and link like any other; equal texts and repeated rows share a fingerprint and so a component; null ids are not
    taken as component ids unless a component has no other.  An empty table gives no rows.
    """
    prints = cut_lineage(fingerprints(documents, doc_id=doc_id, text=text, shingle=shingle))
    classes = cut_lineage(prints.groupBy("fingerprint").agg(F.min(doc_id).alias("first")))
    found = components(links(classes.select("fingerprint"), radius, tile))
    rooted = classes.join(found, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = cut_lineage(rooted.join(least, "root").select("fingerprint", "component_id"))
    return prints.join(labels, "fingerprint").select(
        doc_id, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def first_of_each(documents: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """One document of each component, with its columns: the one whose id names it.

    Rows without an id stay.  Of rows that repeat an id one stays, the first by text.
    """
    found = near_duplicates(documents.where(F.col(doc_id).isNotNull()), doc_id=doc_id, **options)
    chosen = found.where(F.col(doc_id) == F.col("component_id")).select(F.col(doc_id).alias("_id")).distinct()
    kept = documents.join(chosen, F.col(doc_id) == F.col("_id"), "left_semi")
    repeated = kept.groupBy(doc_id).count().where("count > 1").select(F.col(doc_id).alias("_id"))
    once = kept.join(repeated, F.col(doc_id) == F.col("_id"), "left_anti")
    order = Window.partitionBy(doc_id).orderBy(*[c for c in documents.columns if c != doc_id])
    several = kept.join(repeated, F.col(doc_id) == F.col("_id"), "left_semi").withColumn("_n", F.row_number().over(order))
    return once.unionByName(several.where("_n = 1").drop("_n")).unionByName(documents.where(F.col(doc_id).isNull()))
