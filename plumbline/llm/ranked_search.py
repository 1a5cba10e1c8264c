"""Ranked lexical search by buckets of impact vectors.

A document is a vector of term impacts, an item a vector of term weights, a score their product.  Impact vectors are
ordered by length and cut into buckets.  The longest give each item a first threshold.  Then the Cauchy-Schwarz bound
skips buckets, and inside one it skips documents; bounds by coordinate leave the items' common terms unread until a
document has met enough of the others.  What survives is scored again in integers, so results are exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.rows import texts
from plumbline.session import cut_lineage, discard
from plumbline.skew import running, with_blocks

TOP = 20
#: Bytes of item vectors that are sent to the tasks at once, and what an item counts besides its terms (its best
#: documents so far are held in every task).  More items go in several blocks, each a pass over the documents.
BLOCK_BYTES = 16 * 1024 * 1024
ITEM_BYTES = 4096
ITEMS_PER_BLOCK = 100_000
#: Most postings and documents of a bucket (a longer document is a bucket of its own), and postings of a partition.
BUCKET_POSTINGS = 1 << 20
BUCKET_ROWS = 1 << 14
PARTITION_POSTINGS = 1 << 21
#: Postings that are dealt to a partition together; several to each, so that hashing evens them out.
PLACE_POSTINGS = 1 << 17
#: Longest vectors that set the first thresholds.
SEEDS = 4096
#: Bytes of a text that are split into terms at once.
PIECE = 1 << 20
#: Room for rounding in bounds, which are doubles; scores are integers.
SLACK = 1 + 1e-9

_TERM_BYTES = bytes(
    b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def term_lists(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time: runs of digits, letters (A-Z in lower case) and non-ASCII characters."""
    plain = text.translate(_TERM_BYTES) if text else b""
    start = 0
    while start < len(plain):
        stop = plain.find(b" ", start + PIECE)
        stop = len(plain) if stop < 0 else stop
        yield plain[start:stop].split()
        start = stop


class Items:
    """A block of items: vocabulary, then for each item its term ids and how often it holds them."""

    def __init__(self, vectors: Sequence[tuple[Sequence[bytes], Sequence[int]]]):
        self.vocabulary: dict[bytes, int] = {}
        self.terms, self.counts = [], []
        for terms, counts in vectors:
            ids = np.fromiter((self.vocabulary.setdefault(bytes(t), len(self.vocabulary)) for t in terms), np.int32, len(terms))
            order = np.argsort(ids)
            self.terms.append(ids[order])
            self.counts.append(np.asarray(counts, dtype=np.int64)[order])

    def weigh(self, n_docs: int, total: int, df: dict[int, int]) -> None:
        """Fix the corpus counts.  A term's weight goes into the item's vector and, by its root, into both lengths."""
        self.n_docs, self.total = n_docs, total
        self.weight = np.zeros(len(self.vocabulary), dtype=np.int64)
        for term, n in df.items():
            self.weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
        self.root = np.sqrt(self.weight.astype(np.float64))
        for i, (terms, counts) in enumerate(zip(self.terms, self.counts, strict=True)):
            used = self.weight[terms] > 0
            self.terms[i], self.counts[i] = terms[used], counts[used]
        self.factors = [c * self.weight[t] for t, c in zip(self.terms, self.counts, strict=True)]
        self.squares = [(c * self.root[t]) ** 2 for t, c in zip(self.terms, self.counts, strict=True)]
        self.lengths = np.array([math.sqrt(s.sum()) for s in self.squares])


class Best:
    """The best documents of each item so far, and the score a document must reach."""

    def __init__(self, thresholds: Sequence[int], top: int):
        self.floor = [max(1, t) for t in thresholds]
        self.rows: list[tuple] = [None] * len(self.floor)
        self.top = top

    def add(self, item: int, score: np.ndarray, doc: np.ndarray, known: np.ndarray) -> None:
        if self.rows[item] is not None:
            score, doc, known = (np.concatenate(x) for x in zip(self.rows[item], (score, doc, known), strict=True))
        order = np.lexsort((doc, known, -score))[: self.top]
        self.rows[item] = score[order], doc[order], known[order]
        if len(order) == self.top:
            self.floor[item] = max(self.floor[item], int(score[order[-1]]))


def search_bucket(items: Items, best: Best, doc: np.ndarray, known: np.ndarray, length: np.ndarray, stops: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> Counter:
    """Offer the documents of a bucket to every item; counts what the bounds left to do.

    Document ``j`` has the postings ``stops[j - 1]:stops[j]`` of ``terms`` and ``impacts``; none is empty.
    """
    done = Counter()
    n = len(doc)
    starts = np.concatenate([[0], stops[:-1]])
    longest = float(length.max()) * SLACK
    order = np.argsort(terms, kind="stable")
    by_term, by_impact = terms[order], impacts[order]
    by_doc = np.repeat(np.arange(n), stops - starts)[order]
    first = np.flatnonzero(np.concatenate([[True], np.diff(by_term) != 0]))
    present, last = by_term[first], np.append(first[1:], len(by_term))
    peak = np.maximum.reduceat(by_impact, first).astype(np.float64)
    dense = np.zeros(len(items.weight), dtype=np.int64)
    for item, held in enumerate(items.terms):
        floor = best.floor[item]
        if items.lengths[item] * longest < floor:  # Cauchy-Schwarz for the whole bucket
            done["buckets"] += 1
            continue
        at = np.searchsorted(present, held)
        at[at == len(present)] = 0
        met = present[at] == held if len(held) else np.zeros(0, dtype=bool)
        if not met.any():
            continue
        at, factor, square = at[met], items.factors[item][met].astype(np.float64), items.squares[item][met]
        most = factor * peak[at]  # what a coordinate can add at most, here
        rank = np.argsort(most)
        # Coordinates whose sum, by either bound, stays under the threshold cannot lift a document alone.
        rest = np.minimum(np.cumsum(most[rank]) * SLACK, np.sqrt(np.cumsum(square[rank])) * longest)
        idle = int(np.searchsorted(rest, floor))
        if idle == len(rank):
            done["coordinates"] += 1
            continue
        focus = rank[idle:]
        lists = [slice(first[k], last[k]) for k in at[focus]]
        found = np.concatenate([by_doc[s] for s in lists])
        worth = np.concatenate([by_impact[s] * f for s, f in zip(lists, factor[focus], strict=True)])
        partial = np.bincount(found, weights=worth, minlength=n)
        bound = partial
        if idle:
            bound = partial + np.minimum(most[rank[:idle]].sum(), math.sqrt(square[rank[:idle]].sum()) * length)
        if n > best.top:  # a part is no more than the score, so the best parts lift the threshold
            floor = max(floor, float(np.partition(partial, n - best.top)[n - best.top]) / SLACK)
        left = np.flatnonzero((partial > 0) & (bound * SLACK >= floor))
        if not len(left):
            continue
        done["scored"] += len(left)
        dense[held] = items.factors[item]
        sizes = stops[left] - starts[left]
        ends = np.cumsum(sizes)
        where = np.arange(ends[-1]) + np.repeat(starts[left] - (ends - sizes), sizes)
        score = np.add.reduceat(dense[terms[where]] * impacts[where], ends - sizes)
        dense[held] = 0
        good = score >= best.floor[item]
        if good.any():
            best.add(item, score[good], doc[left][good], known[left][good])
    return done


INDEX = "doc_id long, n long, terms array<int>, times array<int>"
VECTORS = "doc_id long, length double, terms array<int>, impacts array<int>"


def _index(documents: DataFrame, items: Items) -> DataFrame:
    """Terms of each document that the items hold, with their times, and the number of all its terms."""
    sent = documents.sparkSession.sparkContext.broadcast(items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value.get
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sizes, terms, times = [], [], []
                for text in texts(part.column(1)):
                    counts: Counter = Counter()
                    n = 0
                    for some in term_lists(text):
                        n += len(some)
                        counts.update(map(known, some))
                    counts.pop(None, None)
                    sizes.append(n)
                    terms.append(list(counts))
                    times.append(list(counts.values()))
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(terms, kind), pa.array(times, kind)],
                    names=["doc_id", "n", "terms", "times"],
                )

    return documents.mapInArrow(run, INDEX)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and flat values of a list column without nulls."""
    return column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)


def _vectors(index: DataFrame, sent) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, terms = _lists(batch.column("terms"))
            times = _lists(batch.column("times"))[1].astype(np.int64)
            n = batch.column("n").to_numpy().astype(np.int64)
            m = 75 + (25 * n * items.n_docs) // items.total
            impacts = (1_000_000_000 * times) // (1000 * times + 12 * np.repeat(m, sizes))
            rows = np.repeat(np.arange(batch.num_rows), sizes)
            used = (items.weight[terms] > 0) & (impacts > 0)
            rows, terms, impacts = rows[used], terms[used], impacts[used]
            length = np.sqrt(np.bincount(rows, weights=(impacts * items.root[terms]) ** 2, minlength=batch.num_rows))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=batch.num_rows))]).astype(np.int32)
            made = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (terms, impacts)]
            whole = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(length), *made], names=["doc_id", "length", "terms", "impacts"]
            )
            yield whole.filter(pa.array(np.diff(offsets) > 0))

    return index.where("size(terms) > 0").mapInArrow(run, VECTORS)


def _by_length(vectors: DataFrame) -> DataFrame:
    """Vectors in order of length, dealt into partitions of equal postings.

    Long vectors hold most postings, so partitions are cut by the postings of some hundred classes of length, summed
    beforehand; a class larger than a partition is dealt over several.
    """
    level = F.floor(8 * F.log2("length")).cast("int")
    sums = vectors.groupBy(level.alias("level")).agg(F.sum(F.size("terms").cast("long")).alias("postings")).collect()
    before, starts = 0, []
    for row in sorted(sums, reverse=True):
        starts.append((row.level, before, row.postings))
        before += row.postings
    partitions = max(1, -(-before // PARTITION_POSTINGS))
    classes = vectors.sparkSession.createDataFrame(starts, "level int, before long, postings long")
    share = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)) / (1 << 20)
    placed = vectors.withColumns({"level": level, "share": share}).join(F.broadcast(classes), "level")
    place = F.floor((F.col("before") + F.col("share") * F.col("postings")) / PLACE_POSTINGS)
    dealt = placed.select("doc_id", "length", "terms", "impacts", place.alias("place")).repartition(partitions, "place")
    return dealt.sortWithinPartitions("place", F.desc("length")).drop("place")


def _search(vectors: DataFrame, sent, thresholds: list[int], top: int) -> DataFrame:
    """Best documents of each item in each task: ``item`` (its place in the block), ``doc_id``, ``score``."""
    floors = vectors.sparkSession.sparkContext.broadcast(thresholds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, best = sent.value, Best(floors.value, top)
        parts: list[pa.RecordBatch] = []
        postings = rows = 0

        def search() -> None:
            nonlocal postings, rows
            if parts:
                doc = pa.chunked_array([p.column("doc_id") for p in parts])
                known = doc.is_valid().to_numpy()
                length = np.concatenate([p.column("length").to_numpy() for p in parts])
                sizes, terms = (np.concatenate(x) for x in zip(*[_lists(p.column("terms")) for p in parts], strict=True))
                impacts = np.concatenate([_lists(p.column("impacts"))[1] for p in parts]).astype(np.int64)
                search_bucket(items, best, doc.fill_null(0).to_numpy(), known, length, np.cumsum(sizes, dtype=np.int64), terms, impacts)
            parts.clear()
            postings = rows = 0

        for batch in batches:
            ends = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
            start = 0
            while start < batch.num_rows:
                before = int(ends[start - 1]) if start else 0
                stop = int(np.searchsorted(ends, before + BUCKET_POSTINGS - postings, side="right"))
                stop = min(max(stop, start + (not parts)), start + BUCKET_ROWS - rows, batch.num_rows)
                if stop > start:
                    parts.append(batch.slice(start, stop - start))
                    postings += int(ends[stop - 1]) - before
                    rows += stop - start
                    start = stop
                if start < batch.num_rows:
                    search()
        search()
        for item, found in enumerate(best.rows):
            if found is not None:
                score, doc, known = found
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(score), pa.int32()), pa.array(doc, mask=~known), pa.array(score)],
                    names=["item", "doc_id", "score"],
                )

    return vectors.mapInArrow(run, "item int, doc_id long, score long")


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _item_vectors(items: DataFrame) -> DataFrame:
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = []
            for text in texts(batch.column("text")):
                counts: Counter = Counter()
                for some in term_lists(text):
                    counts.update(some)
                counted.append(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item_id"),
                    pa.array([list(c) for c in counted], pa.list_(pa.binary())),
                    pa.array([list(c.values()) for c in counted], pa.list_(pa.int64())),
                    pa.array([ITEM_BYTES + sum(map(len, c)) + 64 * len(c) for c in counted], pa.int64()),
                ],
                names=["item_id", "terms", "times", "size"],
            )

    made = items.mapInArrow(run, f"item_id {kind}, terms array<binary>, times array<long>, size long")
    return made.withColumn("key", F.xxhash64("terms", F.monotonically_increasing_id()))


def _search_block(documents: DataFrame, block: DataFrame, top: int, seeds: int) -> DataFrame:
    rows = block.select("item_id", "terms", "times").collect()  # a block's bytes at most, or one item
    spark = documents.sparkSession
    items = Items([(r.terms, r.times) for r in rows])
    index = cut_lineage(_index(documents, items))
    n_docs, total, postings = index.agg(
        F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms").cast("long")), F.lit(0))
    ).head()
    # One row for each term of the block.
    df = {r[0]: r[1] for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    items.weigh(n_docs, max(1, total), df)
    sent = spark.sparkContext.broadcast(items)
    vectors = cut_lineage(_by_length(_vectors(index, sent)))
    nothing = [0] * len(rows)
    least = vectors.select("length").orderBy(F.desc("length")).limit(seeds).agg(F.min("length")).head()[0] or 0.0
    first = cut_lineage(_best(_search(vectors.where(F.col("length") >= least), sent, nothing, top), top))
    for item, score in first.where(F.col("rank") == top).select("item", "score").collect():  # one number an item
        nothing[item] = score
    # A vector too short for every item is not even read.
    reach = [max(1, t) / n for t, n in zip(nothing, items.lengths, strict=True) if n > 0]
    needed = (min(reach) if reach else math.inf) / SLACK
    shorter = vectors.where((F.col("length") < least) & (F.col("length") >= needed))
    found = _best(first.drop("rank").unionByName(_search(shorter, sent, nothing, top)), top)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {block.schema['item_id'].dataType.simpleString()}")
    ranked = cut_lineage(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    discard(index, vectors, first)
    return ranked


def top_documents(
    documents: DataFrame,
    items: DataFrame,
    top: int = TOP,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    seeds: int = SEEDS,
) -> DataFrame:
    """``item_id``, ``rank`` (int, from 1), ``doc_id`` (long), ``score`` (long): the best documents of each item.

    Every row of ``items`` is an item and every row of ``documents`` a document, repeated ids and texts too.  Only
    scores above 0 count; equal scores go by ascending ``doc_id``, null first.  Null and empty texts have no terms:
    such items find nothing, such documents are not counted.  Empty tables give no rows; other columns are left behind.
    """
    given = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    asked = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    vectors = cut_lineage(_item_vectors(asked))
    blocked, n_blocks = with_blocks(vectors, "key", ITEMS_PER_BLOCK)
    summed = running(blocked.withColumn("_all", F.lit(0)), n_blocks, ["_all"], [F.col("key")], F.col("size"), "sum", "end")
    dealt = cut_lineage(summed.withColumn("block", F.floor((F.col("end") - F.col("size")) / block_bytes)))
    result = None
    for (block,) in dealt.select("block").distinct().orderBy("block").toLocalIterator():
        found = _search_block(given, dealt.where(F.col("block") == block), top, seeds)
        result = found if result is None else result.unionByName(found)
    if result is None:
        return dealt.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return result
