"""Trie of conversation prefixes, screened by a count-min sketch.

A prefix is a chain digest over its turns.  A count-min sketch over the prefixes of all conversations never counts too
low, so an estimate of one proves that a prefix has one member: it and all behind it are written where they are found.
Only prefixes that may be shared are shuffled and grouped exactly, by digest, without their texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import cut_lineage
from plumbline.skew import attach

#: Rows of the sketch, and most cells of one: 4 x 2**24 cells are 64 MB in a task that counts and 8 MB once screened
#: down to one bit a cell.  Beyond, estimates of one become rarer and more prefixes are grouped exactly.
SKETCH_ROWS = 4
MOST_CELLS = 1 << 24
#: Cells a row for each prefix, while they fit.
CELLS_A_PREFIX = 4
#: Cells that travel together when sketches are merged.
CHUNK = 1 << 16
ROWS_AT_ONCE = 4096

ROOT = hashlib.blake2b(digest_size=16).digest()
PREFIX = "conv_id long, depth long, node binary, parent binary, words long, last boolean"


@dataclass(frozen=True)
class Graft:
    """A conversation c begins with the first ``crc32(c) % heads`` turns of conversation c - c % span in place of its own."""

    span: int = 20
    heads: int = 4

    def turns(self, conv: int) -> int:
        return zlib.crc32(str(conv).encode()) % self.heads


def prefixes(
    conversations: DataFrame,
    graft: Graft | None = None,
    *,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row for each conversation and depth, root included: digests of the prefix and of its parent, ``words`` of
    its last text, ``last`` if the conversation ends there.

    Rows are dealt by the conversation whose turns they may begin with and streamed in order; a task holds the few
    turns that are handed on and one digest, however long a conversation is.
    """
    conv = F.col(f"`{conv_id}`").cast("long")
    named = conversations.select(
        (conv - conv % (graft.span if graft else 1)).alias("base"),
        conv.alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    ).where("conv_id IS NOT NULL")
    ordered = named.repartition("base").sortWithinPartitions(
        "base", F.expr("conv_id <> base"), "conv_id", F.asc_nulls_first("turn"), "role", "text"
    )
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
    names = ["conv_id", "depth", "node", "parent", "words", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[list] = [[] for _ in names]
        pending: list | None = None  # the deepest prefix of the conversation so far
        source, head = None, []  # whose turns are handed on, and they

        def put(last: bool) -> None:
            for column, value in zip(made, [*pending, last], strict=True):
                column.append(value)

        def turn_under(who: bytes, said: bytes) -> None:
            nonlocal pending
            put(False)
            conv, depth, node = pending[:3]
            digest = hashlib.blake2b(node + len(who).to_bytes(8, "little") + who, digest_size=16)
            digest.update(said)
            pending = [conv, depth + 1, digest.digest(), node, len(said.split())]

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds, strict=True)], names=names)
            for column in made:
                column.clear()
            return batch

        current, own, replaced = None, 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                ids = zip(part.column("base").to_pylist(), part.column("conv_id").to_pylist(), strict=True)
                texts = [part.column(c).cast(pa.binary()).to_pylist() for c in ("role", "text")]
                for (base, conv), who, said in zip(ids, *texts, strict=True):
                    if conv != current:
                        if pending is not None:
                            put(True)
                        if base != source:
                            source, head = base, []
                        current, own = conv, 0
                        replaced = graft.turns(conv) if graft and conv != base else 0
                        pending = [conv, 0, ROOT, None, 0]
                        for turn_ in head[:replaced]:
                            turn_under(*turn_)
                    own += 1
                    if graft and conv == base and own < graft.heads:
                        head.append((who, said))
                    if own > replaced:
                        turn_under(who, said)
                if made[0]:
                    yield flush()
        if pending is not None:
            put(True)
            yield flush()

    return ordered.select("base", "conv_id", "role", "text").mapInArrow(run, PREFIX)


def _cells(digests: np.ndarray, width: int) -> np.ndarray:
    """Cells (rows of the sketch x digests) of 16-byte digests; ``width`` is a power of two."""
    halves = digests.view("<u8").reshape(-1, 2)
    steps = np.arange(SKETCH_ROWS, dtype=np.uint64)[:, None]
    return ((halves[:, 0] + steps * (halves[:, 1] | np.uint64(1))) & np.uint64(width - 1)).astype(np.int64)


def _digests(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, 16)


def sketch(table: DataFrame, n_rows: int, most_cells: int = MOST_CELLS) -> np.ndarray:
    """Count-min sketch of the nodes, kept as one bit a cell: whether it counts two or more.

    Tasks count into their own cells, up to two; chunks of cells are added up by chunk, in a stream, and the bits come
    to the driver: at most ``SKETCH_ROWS * most_cells / 8`` bytes.
    """
    width = 1 << 10
    while width < min(CELLS_A_PREFIX * n_rows, most_cells):
        width *= 2
    chunk = min(CHUNK, width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((SKETCH_ROWS, width), dtype=np.uint8)
        for batch in batches:
            for row, cells in enumerate(_cells(_digests(batch.column(0)), width) if batch.num_rows else []):
                found, times = np.unique(cells, return_counts=True)
                counts[row, found] = np.minimum(2, counts[row, found] + np.minimum(times, 2))
        chunks = counts.reshape(-1, chunk)
        for k in np.flatnonzero(chunks.any(axis=1)).tolist():
            bits = [np.packbits(chunks[k] >= n).tobytes() for n in (1, 2)]
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int64()), "one": [bits[0]], "two": [bits[1]]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, one, two in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                one, two = (np.frombuffer(b, dtype=np.uint8) for b in (one, two))
                held = sums.setdefault(k, [np.zeros_like(one), np.zeros_like(two)])
                held[1] |= two | (held[0] & one)
                held[0] |= one
        for k, (_, two) in sums.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int64()), "two": [two.tobytes()]})

    parts = table.select("node").mapInArrow(count, "chunk long, one binary, two binary")
    added = parts.repartition("chunk").mapInArrow(add, "chunk long, two binary")
    bits = np.zeros((SKETCH_ROWS * width // chunk, chunk // 8), dtype=np.uint8)
    for k, two in added.collect():
        bits[k] = np.frombuffer(two, dtype=np.uint8)
    return bits.reshape(SKETCH_ROWS, width // 8)


def screened(table: DataFrame, bits: np.ndarray) -> DataFrame:
    """Add ``alone`` and ``parent_alone``: the estimate proves one member (a root has no parent, which counts as alone)."""
    sent = table.sparkSession.sparkContext.broadcast(bits)
    width = bits.shape[1] * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several = sent.value

        def alone(column: pa.Array) -> np.ndarray:
            cells = _cells(_digests(column), width)
            found = np.take_along_axis(several, cells >> 3, axis=1) >> (7 - (cells & 7)).astype(np.uint8) & 1
            return ~found.all(axis=0)

        for batch in batches:
            if not batch.num_rows:
                continue
            parents = batch.column("parent")
            mine = alone(batch.column("node"))
            theirs = alone(parents.fill_null(ROOT)) | parents.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(mine), pa.array(theirs)], names=[*batch.schema.names, "alone", "parent_alone"]
            )

    return table.mapInArrow(run, f"{PREFIX}, alone boolean, parent_alone boolean")


def _ends(shared: DataFrame) -> DataFrame:
    """``node``, ``ends_sha256`` of the ids of conversations that end at a node, fed one by one to the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        for batch in batches:
            done: tuple[list, list] = ([], [])
            for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node != current:
                    if current is not None:
                        done[0].append(current)
                        done[1].append(digest.hexdigest())
                    current, digest = node, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            if done[0]:
                yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1])], names=["node", "ends_sha256"])
        if current is not None:
            yield pa.RecordBatch.from_pydict({"node": [current], "ends_sha256": [digest.hexdigest()]})

    ordered = shared.where("last").select("node", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id")
    return ordered.mapInArrow(run, "node binary, ends_sha256 string")


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(conversations: DataFrame, graft: Graft | None = None, *, most_cells: int = MOST_CELLS, **names) -> DataFrame:
    """Every distinct prefix of the conversations as a node, the textless root included.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs`` (members),
    ``n_children``, ``n_leaves`` (childless nodes in its subtree), ``saved_tokens`` (over its subtree, the words a
    node's last text would be read again by members after the first), ``ends_sha256`` (ids of members that end there,
    ascending, comma-joined).

    Turns are ordered by ``turn`` (null first), equal turns by role and text; null roles and texts are empty; a repeated
    row is a turn of its own; rows without an id belong to no conversation; an empty table has no nodes, not even a
    root; other columns are left behind.  Two prefixes are one if their 128-bit chain digests are.
    """
    table = cut_lineage(prefixes(conversations, graft, **names))
    marked = screened(table, sketch(table, table.count(), most_cells))
    no_ends = F.sha2(F.lit("").cast("binary"), 256)
    tails = marked.where("alone").select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.col("conv_id")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(no_ends).alias("ends_sha256"),
        "parent",
        "parent_alone",
    )
    shared = cut_lineage(marked.where("NOT alone").drop("alone"))
    nodes = cut_lineage(
        shared.groupBy("node").agg(
            F.min("conv_id").alias("conv_id"),
            F.count("*").alias("n_convs"),
            F.min("depth").alias("depth"),
            F.min("words").alias("words"),
            F.min("parent").alias("parent"),
        )
    )
    tops = tails.where("NOT parent_alone")
    children = nodes.select("parent").unionByName(tops.select("parent")).groupBy("parent").agg(F.count("*").alias("n_children"))
    counted = cut_lineage(
        nodes.join(children.select(F.col("parent").alias("node"), "n_children"), "node", "left").fillna(0, ["n_children"])
    )
    # Subtree sums, without walking it: a member adds its own words from here on, less those of prefixes it is the
    # smallest member of, and one leaf if it is the smallest member of a childless node.
    deepest = F.lit((1 << 63) - 1)
    own = shared.select("conv_id", "depth", "node", "words", F.lit(0).alias("leaf"))
    first = counted.select("conv_id", "depth", F.lit(None).cast("binary").alias("node"), (-F.col("words")).alias("words"), F.lit(0).alias("leaf"))
    nothing = [F.lit(None).cast("binary").alias("node"), F.lit(0).cast("long").alias("words"), F.lit(1).alias("leaf")]
    leaves = counted.where("n_children = 0").select("conv_id", deepest.alias("depth"), *nothing)
    leaves = leaves.unionByName(marked.where("alone AND last").select("conv_id", deepest.alias("depth"), *nothing))
    from_here = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    behind = own.unionByName(first).unionByName(leaves).select(
        "node", F.sum("words").over(from_here).alias("words"), F.sum("leaf").over(from_here).alias("leaf")
    )
    sums = behind.where("node IS NOT NULL").groupBy("node").agg(F.sum("words").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    exact = cut_lineage(
        counted.join(sums, "node").join(_ends(shared), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", no_ends))
    )
    # A parent outside the shared prefixes was proved to have one member: this conversation.
    below = exact.select(*[c for c in NODE if c != "parent_conv_id"], "parent").unionByName(tops.drop("parent_conv_id", "parent_alone"))
    parents = exact.select(F.col("node").alias("parent"), F.col("conv_id").alias("_parent_conv"), F.col("n_children").alias("_weight"))
    placed = attach(below, parents, ["parent"], "_weight").withColumn(
        "parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("_parent_conv", "conv_id"))
    )
    return placed.select(*NODE).unionByName(tails.where("parent_alone").select(*NODE))
