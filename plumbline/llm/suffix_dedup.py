"""Exact removal of repeated passages with a sparse, range-partitioned suffix array.

A repeated string of ``length`` bytes holds the same anchors wherever it stands: an anchor is the place of the least
hash among the short grams of a window, so the text of the window alone decides it.  Suffixes are taken at anchors.

1. Every anchor is reduced to two hashes: of its gram, and of its block, all bytes of the windows it decides.  Grams
   seen once cannot be repeated; blocks seen twice are repeated as a whole.
2. The anchors left (and one of each repeated block) get their bytes and enter two suffix arrays, of what follows the
   gram's start and of what precedes it read backwards.  Sampled splitters range-partition them by leading bytes,
   buckets sort locally by multikey quicksort, and neighbours are compared, across bucket boundaries too.  An
   anchor's longest agreement to the right and to the left bound the windows that can be repeated.
3. Those windows are compared by hash, among anchors of the same gram.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.rows import ROWS_AT_ONCE, annotate, texts
from plumbline.session import cut_lineage

#: Bytes of a string that is removed if it stands anywhere else.
LENGTH = 200
#: Bytes of a gram; windows of LENGTH bytes hold LENGTH - GRAM + 1 grams.
GRAM = 32
#: Bytes of a text worked on at once; windows never straddle, segments overlap by LENGTH - 1, and an anchor of the
#: windows on both sides of a cut is joined again.
SEGMENT = 1 << 22
#: Members of a bucket of a suffix array: about 100 MB with their keys.
ROWS_PER_BUCKET = 100_000
_PLACE = np.uint64((1 << 23) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1


def _gram_hashes(octets: np.ndarray, gram: int) -> np.ndarray:
    """A mixed rolling hash of each gram; widths double."""
    h = octets.astype(np.uint64) + np.uint64(1)
    width = 1
    while width < gram:
        step = min(width, gram - width)
        h = h[: len(h) - step] * np.uint64(pow(_BASE, step, 1 << 64)) + h[step:]
        width += step
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchors(
    octets: bytes, length: int = LENGTH, gram: int = GRAM, segment: int | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text: place, gram hash, first and last start of the windows each decides.

    The least hash of a window wins, the leftmost of equal ones; hashes are compared by their upper 41 bits.  An anchor
    whose windows lie in several segments is one anchor: every place is there once.
    """
    empty = np.zeros(0, dtype=np.int64)
    segment = segment or SEGMENT
    found = []
    for begin in range(0, max(1, len(octets) - length + 1), segment):
        part = np.frombuffer(octets, np.uint8, min(segment + length - 1, len(octets) - begin), begin)
        if len(part) < length:
            break
        h = _gram_hashes(part, gram)
        packed = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        span, width = length - gram + 1, 1
        while width < span:
            step = min(width, span - width)
            packed = np.minimum(packed[: len(packed) - step], packed[step:])
            width += step
        at = (packed & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        place = at[first]
        found.append((place + begin, h[place].view(np.int64), first + begin, last + begin))
    if not found:
        return (empty,) * 4
    place, h, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    opening = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    closing = np.append(opening[1:], len(place)) - 1
    return place[opening], h[opening], first[opening], last[closing]


def anchor_rows(documents: DataFrame, text: str, length: int, gram: int, segment: int = SEGMENT) -> DataFrame:
    """id, version, place, before, after, gram, block of each anchor: its windows start from ``place - before`` to
    ``place - after``, and ``block`` is the hash of their bytes and of the place in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                found, blocks, counts = [], [], []
                for octets in texts(part.column(text)):
                    octets = octets or b""
                    place, h, first, last = anchors(octets, length, gram, segment)
                    found.append((place, place - first, place - last, h))
                    counts.append(len(place))
                    for p, f, q in zip(place.tolist(), first.tolist(), last.tolist(), strict=True):
                        blocks.append(xxhash.xxh3_64_intdigest(octets[f : q + length], seed=p - f))
                place, before, after, h = (np.concatenate(x) for x in zip(*found, strict=True))
                row = pa.array(np.repeat(np.arange(len(counts)), counts))
                arrays = [part.column("id").take(row), part.column("version").take(row)]
                arrays += [pa.array(x.astype(np.int32)) for x in (place, before, after)]
                arrays += [pa.array(h), pa.array(np.array(blocks, dtype=np.uint64).view(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = T.StructType(
        [documents.schema["id"], documents.schema["version"]]
        + [T.StructField(n, T.IntegerType(), False) for n in ("place", "before", "after")]
        + [T.StructField(n, T.LongType(), False) for n in ("gram", "block")]
    )
    names = schema.fieldNames()
    return documents.select("id", "version", text).mapInArrow(run, schema)


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["version"] == b["version"])


def contexts(documents: DataFrame, members: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    """Members with ``right``, the bytes from the gram on, and ``left``, the bytes before it read backwards.

    Short contexts are filled with 0xFF, a byte that no UTF-8 text holds.
    """
    fields = ["place", "before", "after", "gram", "times"]
    wanted = members.groupBy("id", "version").agg(F.collect_list(F.struct(*fields)).alias("members"))
    joined = documents.join(wanted, _same(documents, wanted)).select(
        documents["id"], documents["version"], documents[text].alias("text"), "members"
    )
    back = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                lists = part.column("members")
                row = pc.list_parent_indices(lists)
                flat = lists.flatten()
                octets = texts(part.column("text"))
                right, left = [], []
                for r, p in zip(row.to_pylist(), flat.field("place").to_pylist(), strict=True):
                    right.append(octets[r][p : p + length].ljust(length, b"\xff"))
                    left.append(octets[r][max(0, p - back) : p][::-1].ljust(back, b"\xff"))
                arrays = [part.column("id").take(row), part.column("version").take(row), *(flat.field(f) for f in fields)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(right), pa.array(left)], names=names)

    kinds = {f.name: f for f in members.schema}
    schema = T.StructType(
        [kinds[n] for n in ("id", "version", *fields)] + [T.StructField(n, T.BinaryType(), False) for n in ("right", "left")]
    )
    names = schema.fieldNames()
    return joined.mapInArrow(run, schema)


def multikey_quicksort(words: np.ndarray, small: int = 48) -> np.ndarray:
    """Order of the rows of ``words``: three-way partitioning on one word at a time, from the first word on."""
    order = np.arange(len(words))
    stack = [(0, len(words), 0)]
    while stack:
        low, high, depth = stack.pop()
        if high - low < 2 or depth == words.shape[1]:
            continue
        rows = order[low:high]
        if high - low <= small:
            order[low:high] = rows[np.lexsort(words[rows, depth:].T[::-1])]
            continue
        keys = words[rows, depth]
        pivot = np.partition(keys[:: max(1, len(keys) // 64)], min(len(keys), 64) // 2)[min(len(keys), 64) // 2]
        less, equal, more = keys < pivot, keys == pivot, keys > pivot
        order[low:high] = np.concatenate([rows[less], rows[equal], rows[more]])
        a, b = low + int(less.sum()), high - int(more.sum())
        stack += [(low, a, depth), (a, b, depth + 1), (b, high, depth)]
    return order


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bytes that rows of ``a`` and ``b`` share; filling never agrees with text, and ends an agreement."""
    differ = (a != b) | (a == 0xFF)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _neighbours(right: np.ndarray, left: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For consecutive rows: whether they share the gram, and the bytes they share to the right and to the left."""
    r = _agreement(right[:-1], right[1:])
    return r >= gram, r, _agreement(left[:-1], left[1:])


def _table(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def sorted_neighbours(members: DataFrame, leading: str, length: int, gram: int, partitions: int) -> DataFrame:
    """id, version, place, r, l for each pair of neighbours in a suffix array of the members, from both sides.

    ``leading`` is the context sorted by first.  Splitters are sampled by the range partitioning; the whole context
    is the key, so a passage that many documents hold is cut into several buckets by what stands around it.
    """
    head = F.substring("right", 1, gram) if leading == "left" else F.lit(b"")
    key = F.concat(head, F.col(leading), F.col("right" if leading == "left" else "left"))
    dealt = members.select("id", "version", "place", "right", "left", key.alias("key")).repartitionByRange(partitions, "key")
    back = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        keys = _table(table["key"], length + back + (gram if leading == "left" else 0))
        words = np.pad(keys, ((0, 0), (0, -keys.shape[1] % 8))).view(">u8").astype(np.uint64)
        table = table.drop_columns(["key"]).take(pa.array(multikey_quicksort(words)))
        right, left = _table(table["right"], length), _table(table["left"], back)
        near, r, l = _neighbours(right, left, gram)
        n = len(right)
        who = np.concatenate([np.flatnonzero(near), np.flatnonzero(near) + 1, [0, n - 1]])
        rr, ll = (np.concatenate([x[near], x[near], [0, 0]]).astype(np.int32) for x in (r, l))
        edge = np.zeros(len(who), dtype=np.int8)
        edge[-2:] = [1, 2]  # first and last of the bucket
        out = table.take(pa.array(who))
        empty = pa.array([None] * (len(who) - 2), type=pa.binary())
        ends = [pa.concat_arrays([empty, out[c].combine_chunks().slice(len(who) - 2)]) for c in ("right", "left")]
        bucket = pa.array(np.full(len(who), TaskContext.get().partitionId(), dtype=np.int32))
        arrays = [out["id"].combine_chunks(), out["version"].combine_chunks(), out["place"].combine_chunks()]
        arrays += [pa.array(rr), pa.array(ll), pa.array(edge), bucket, *ends]
        yield from pa.Table.from_arrays(arrays, names=names).to_batches(10_000)

    kinds = {f.name: f for f in members.schema}
    schema = T.StructType(
        [kinds[n] for n in ("id", "version", "place")]
        + [T.StructField(n, T.IntegerType(), False) for n in ("r", "l")]
        + [T.StructField("edge", T.ByteType(), False), T.StructField("bucket", T.IntegerType(), False)]
        + [T.StructField(n, T.BinaryType()) for n in ("right", "left")]
    )
    names = schema.fieldNames()
    found = cut_lineage(dealt.mapInArrow(run, schema))
    inside = found.where("edge = 0").select("id", "version", "place", "r", "l")

    # Two rows a bucket: the last of one is the neighbour of the first of the next.
    order = Window.orderBy("bucket", "edge")
    edges = found.where("edge > 0").select("*", F.struct("id", "version", "place", "right", "left", "edge").alias("me"))
    pairs = edges.select("me", F.lag("me").over(order).alias("before")).where("me.edge = 1 AND before.edge = 2")
    both = T.StructType([*schema.fields[:3], *schema.fields[3:5]])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = batch.column("before"), batch.column("me")
            sides = [np.stack([_table(x.field(c), w) for x in (a, b)]) for c, w in (("right", length), ("left", back))]
            r, l = _agreement(*sides[0]), _agreement(*sides[1])
            near = np.flatnonzero(r >= gram)
            for x in (a, b):
                arrays = [x.field(c).take(pa.array(near)) for c in ("id", "version", "place")]
                arrays += [pa.array(v[near].astype(np.int32)) for v in (r, l)]
                yield pa.RecordBatch.from_arrays(arrays, names=both.fieldNames())

    return inside.unionByName(pairs.mapInArrow(across, both))


def _offsets(members: DataFrame, pairs: DataFrame, length: int) -> DataFrame:
    """Members with ``low`` and ``high``, the offsets (place - start) of windows that can be repeated, ``sure``, the
    ranges of offsets some neighbour proves repeated, and ``open``, the offsets left to compare."""
    seen = pairs.groupBy("id", "version", "place").agg(
        F.max("r").alias("r"),
        F.max("l").alias("l"),
        F.collect_list(F.struct((F.lit(length) - F.col("r")).alias("from"), F.col("l").alias("to"))).alias("near"),
    )
    narrow = members.select("id", "version", "place", "before", "after", "gram", "times")
    joined = narrow.join(seen, _same(narrow, seen) & (narrow["place"] == seen["place"])).select(
        narrow["*"],
        F.greatest("after", F.lit(length) - F.col("r")).alias("low"),
        F.least("before", "l").alias("high"),
        "near",
    )
    live = joined.where("low <= high")
    clipped = F.transform("near", lambda x: F.struct(F.greatest(x["from"], "low").alias("from"), F.least(x["to"], "high").alias("to")))
    sure = F.filter(clipped, lambda x: x["from"] <= x["to"])
    live = live.withColumn("sure", sure).drop("near")
    possible = F.sequence("low", "high")
    return live.withColumn(
        "open", F.filter(possible, lambda o: ~F.exists("sure", lambda x: (x["from"] <= o) & (o <= x["to"])))
    )


def repeated_spans(
    documents: DataFrame, *, text: str = "text", length: int = LENGTH, gram: int = GRAM, segment: int = SEGMENT
) -> DataFrame:
    """id, version, start, end (bytes) of stretches whose every window of ``length`` bytes is repeated."""
    spark = documents.sparkSession
    found = anchor_rows(documents, text, length, gram, segment)
    grams = cut_lineage(found.groupBy("gram").count().where("count > 1").select("gram"))
    shared = cut_lineage(found.join(grams, "gram", "left_semi"))
    place = F.min(F.struct("id", "version", "place", "before", "after")).alias("one")
    blocks = cut_lineage(shared.groupBy("gram", "block").agg(F.count("*").alias("times"), place))
    whole = shared.join(blocks.where("times > 1").select("gram", "block"), ["gram", "block"], "left_semi").select(
        "id", "version", (F.col("place") - F.col("before")).alias("start"), (F.col("place") - F.col("after") + length).alias("end")
    )
    several = cut_lineage(blocks.groupBy("gram").count().where("count > 1").select("gram"))
    members = blocks.join(several, "gram", "left_semi").select("one.*", "gram", "times")
    members = cut_lineage(contexts(documents, members, text, length, gram))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-members.count() // ROWS_PER_BUCKET))
    pairs = [sorted_neighbours(members, side, length, gram, partitions) for side in ("right", "left")]
    judged = cut_lineage(_offsets(members, pairs[0].unionByName(pairs[1]), length))
    alone = judged.where("times = 1")
    sure = alone.select("id", "version", "place", F.inline("sure")).select(
        "id", "version", (F.col("place") - F.col("to")).alias("start"), (F.col("place") - F.col("from") + length).alias("end")
    )

    # Offsets no neighbour settled: every member of the gram that can repeat there is compared by its bytes.
    asked = cut_lineage(alone.select("gram", F.explode("open").alias("offset")).distinct())
    ready = judged.join(asked, "gram").where("offset BETWEEN low AND high")
    bytes_ = members.select("id", "version", "place", "right", "left")
    windows = ready.join(bytes_, _same(ready, bytes_) & (ready["place"] == bytes_["place"])).select(
        ready["id"], ready["version"], ready["place"], "gram", "offset", "times",
        F.sha2(F.concat(F.expr("substring(left, 1, offset)"), F.expr(f"substring(right, 1, {length} - offset)")), 256).alias("window"),
    )
    windows = cut_lineage(windows)
    again = cut_lineage(
        windows.groupBy("gram", "offset", "window").agg(F.sum("times").alias("n")).where("n > 1").drop("n")
    )
    start = F.col("place") - F.col("offset")
    rest = windows.where("times = 1").join(again, ["gram", "offset", "window"], "left_semi").select(
        "id", "version", start.alias("start"), (start + length).alias("end")
    )
    return whole.unionByName(sure).unionByName(rest)


def _merge(spans: list[tuple[int, int]]) -> list[list[int]]:
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return merged


def find_repeats(
    documents: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    segment: int = SEGMENT,
) -> DataFrame:
    """Add ``n_bytes``, ``removed`` (maximal runs of bytes, start and end) and ``kept_sha256`` to each document.

    A byte is removed if a string of ``length`` bytes that covers it starts anywhere else too, in the same text or
    another; strings are judged on the input.  Null and empty texts have no bytes.  Rows that repeat id and text are
    each a place, so their strings are repeated; rows with equal or null ids and different texts are told apart by
    their texts.  Columns named like the new ones are replaced.
    """
    documents = documents.drop("n_bytes", "removed", "kept_sha256")
    version = F.when(F.col(doc_id).isNull(), F.xxhash64(text)).otherwise(F.hash(text).cast("long"))
    keyed = documents.select(F.col(doc_id).alias("id"), version.alias("version"), F.col(text).alias("text"))
    spans = repeated_spans(keyed, length=length, gram=gram, segment=segment).groupBy("id", "version").agg(
        F.collect_set(F.struct("start", "end")).alias("_spans")
    )
    keyed = documents.withColumns({"_id": F.col(doc_id), "_version": version})
    joined = keyed.join(
        spans, keyed["_id"].eqNullSafe(spans["id"]) & (keyed["_version"] == spans["version"]), "left"
    ).select(*[keyed[c] for c in documents.columns], "_spans")

    def make() -> Callable:
        def one(octets: bytes | None, spans: list[dict] | None) -> tuple[int, list[list[int]], str]:
            octets = octets or b""
            removed = _merge([(s["start"], s["end"]) for s in spans or []])
            digest, at = hashlib.sha256(), 0
            for start, end in removed:
                digest.update(octets[at:start])
                at = end
            digest.update(octets[at:])
            return len(octets), removed, digest.hexdigest()

        return lambda t, s: list(zip(*map(one, texts(t), s.to_pylist()), strict=True)) if len(t) else [[], [], []]

    fields = T.StructType(
        [
            T.StructField("n_bytes", T.LongType(), False),
            T.StructField("removed", T.ArrayType(T.ArrayType(T.LongType(), False), False), False),
            T.StructField("kept_sha256", T.StringType(), False),
        ]
    )
    return annotate(joined, [text, "_spans"], make, fields, keep=documents.columns)
