"""Benchmark decontamination with suffix arrays over the training documents.

Tasks cut their documents into shards of words, sort each shard's suffixes, and look up every suffix of every
benchmark item by binary search.  The documents are never shuffled; the benchmark travels to them in blocks, dealt by
a running sum of bytes over its distinct texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.rows import texts
from plumbline.session import cut_lineage
from plumbline.skew import running, with_blocks

#: Words of a window, and so of the shortest match between long texts.
WINDOW = 10
#: Bytes of benchmark text whose windows are sent to the tasks at once; a larger benchmark goes in several blocks, a
#: longer text in pieces of its windows (each with the text's word ids, four bytes a word).
BLOCK_BYTES = 16 * 1024 * 1024
#: Distinct benchmark texts whose sizes are summed in one task.
TEXTS_PER_BLOCK = 100_000
#: Pairs of a place in documents and one in items that are followed at once, or the places of one window.
PAIRS = 1 << 18
#: Words of a shard; a longer document is a shard of its own.
SHARD_WORDS = 1 << 18

_WORD_BYTES = bytes(
    b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType(), False), False), False),
        T.StructField("items", T.ArrayType(T.StringType(), False), False),
        T.StructField("longest", T.LongType(), False),
    ]
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


class TestSuffixes:
    """A block of benchmark items: vocabulary, word ids of each text once, and where each distinct window starts.

    A row is the item or items of a text, the text and, for a piece of a text, its number and the number of pieces:
    a piece has its share of the window starts.  Memory grows with the words, whatever the length of an item.
    """

    def __init__(self, rows: Sequence[tuple], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.window = window
        self.items: list[list[str]] = []
        parts, starts, at = [np.zeros(1, dtype=np.uint32)], [], 1
        places: dict[int, list[np.ndarray]] = defaultdict(list)
        for items, text, *piece in rows:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], dtype=np.uint32)
            if not len(ids):
                continue
            length = min(window, len(ids))
            number, of = piece or (0, 1)
            n = len(ids) - length + 1
            places[length].append(np.arange(at + n * number // of, at + n * (number + 1) // of))
            starts.append(at)
            self.items.append([items] if isinstance(items, str) else list(items))
            parts += [ids, np.zeros(1, dtype=np.uint32)]  # no word parts the texts
            at += len(ids) + 1
        self.words = np.concatenate(parts)
        self.starts = np.array(starts, dtype=np.int64)
        self.windows: dict[int, np.ndarray] = {}
        #: For each length, all places by window, and where those of each distinct window begin and end.
        self.places: dict[int, np.ndarray] = {}
        self.bounds: dict[int, np.ndarray] = {}
        for length, found in places.items():
            where = np.concatenate(found)
            if not len(where):
                continue
            keys = _keys(self.words[where[:, None] + np.arange(length)], length, 0)
            order = np.argsort(keys, kind="stable")
            where, keys = where[order], keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.windows[length] = self.words[where[first][:, None] + np.arange(length)]
            self.places[length], self.bounds[length] = where, np.append(first, len(where))
        self.shortest = min(self.windows, default=window)


def _keys(table: np.ndarray, width: int, fill: int) -> np.ndarray:
    """Rows of word ids as byte strings that sort like the rows; short rows are filled up."""
    full = np.full((len(table), width), fill, dtype=">u4")
    full[:, : table.shape[1]] = table
    return np.ascontiguousarray(full).view(f"S{4 * width}").ravel()


def search_shard(docs: Sequence[list[bytes]], tests: TestSuffixes) -> list[tuple[int, list, list, int]]:
    """For each document: words, hit word spans, items found, words of the longest verbatim match.

    A suffix can match only if it starts with enough words known to the benchmark, so only those enter the array.
    """
    known = tests.vocabulary.get
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])  # one unknown word parts the documents
    ids = np.zeros(int(starts[-1]) + tests.window, dtype=np.uint32)
    for words, at in zip(docs, starts, strict=False):
        ids[at : at + len(words)] = [known(w, 0) for w in words]
    ends = np.where(ids == 0, np.arange(len(ids)), len(ids))
    run = np.minimum.accumulate(ends[::-1])[::-1] - np.arange(len(ids))
    places = np.flatnonzero(run >= tests.shortest)
    keys = _keys(ids[places[:, None] + np.arange(tests.window)], tests.window, 0)
    order = np.argsort(keys, kind="stable")
    array, keys = places[order], keys[order]

    covered = np.zeros(len(ids) + 1, dtype=np.int64)
    texts_hit: list[set[int]] = [set() for _ in docs]
    longest = np.zeros(len(docs), dtype=np.int64)
    for length, table in tests.windows.items():
        low = np.searchsorted(keys, _keys(table, tests.window, 0), "left")
        high = np.searchsorted(keys, _keys(table, tests.window, 0xFFFFFFFF), "right")
        bounds = tests.bounds[length]
        for which in np.flatnonzero(high > low):
            found = array[low[which] : high[which]]
            np.add.at(covered, found, 1)
            np.add.at(covered, found + length, -1)
            owner = np.searchsorted(starts, found, "right") - 1
            places = tests.places[length][bounds[which] : bounds[which + 1]]
            behind = np.unique(np.searchsorted(tests.starts, places, "right") - 1).tolist()
            for doc in np.unique(owner):
                texts_hit[doc].update(behind)
            np.maximum.at(longest, owner, length)
            for begin in range(0, len(places), max(1, PAIRS // len(found))):
                group = places[begin : begin + max(1, PAIRS // len(found))]
                p, q = np.repeat(found, len(group)), np.tile(group, len(found))
                # A match that also agrees one word earlier is followed from there.
                new = (ids[p - 1] != tests.words[q - 1]) | (tests.words[q - 1] == 0) | (p == 0)
                p, q, step = p[new], q[new], length
                while len(p):
                    more = p + step < len(ids)
                    p, q = p[more], q[more]
                    word = tests.words[q + step]
                    more = (word != 0) & (ids[p + step] == word)
                    p, q = p[more], q[more]
                    step += 1
                    np.maximum.at(longest, np.searchsorted(starts, p, "right") - 1, step)
    items = [set().union(*(tests.items[t] for t in hit)) for hit in texts_hit]
    hit = np.cumsum(covered) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    spans: list[list[list[int]]] = [[] for _ in docs]
    for start, end in edges.reshape(-1, 2).tolist():
        doc = int(np.searchsorted(starts, start, "right")) - 1
        spans[doc].append([start - int(starts[doc]), end - int(starts[doc])])
    return [(int(n), s, sorted(i), int(m)) for n, s, i, m in zip(sizes, spans, items, longest, strict=True)]


def _pass(documents: DataFrame, text: str, tests: TestSuffixes, out: str) -> DataFrame:
    """Search every document for one block of the benchmark; the rows keep their columns and gain ``out``."""
    sent = documents.sparkSession.sparkContext.broadcast(tests)
    schema = T.StructType([*documents.schema.fields, T.StructField(out, HITS, False)])
    kind = pa.struct(
        [
            ("n_words", pa.int64()),
            ("spans", pa.list_(pa.list_(pa.int64()))),
            ("items", pa.list_(pa.string())),
            ("longest", pa.int64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = sent.value

        def finish(parts: list[pa.RecordBatch], docs: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
            found = search_shard(docs, tests)
            at = 0
            for part in parts:
                rows = [dict(zip(HITS.fieldNames(), x, strict=True)) for x in found[at : at + part.num_rows]]
                at += part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, type=kind)], names=schema.fieldNames())

        parts: list[pa.RecordBatch] = []
        docs: list[list[bytes]] = []
        held = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                docs += [words_of(t) for t in texts(part.column(text))]
                parts.append(part)
                held += sum(map(len, docs[len(docs) - part.num_rows :]))
                if held >= SHARD_WORDS:
                    yield from finish(parts, docs)
                    parts, docs, held = [], [], 0
        if parts:
            yield from finish(parts, docs)

    return documents.mapInArrow(run, schema)


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    out: str = "contamination",
) -> DataFrame:
    """Add struct ``out`` to each document: ``n_words``, hit word ``spans``, ``items`` found, ``longest`` match.

    Words are runs of digits, letters (A-Z in lower case) and non-ASCII characters.  A word is hit if it lies in an
    occurrence of ``window`` consecutive words of an item, or of all words of a shorter item.  Null and empty texts
    have no words; items without words match nothing; items without an id hit words but are not listed; repeated
    documents are judged one by one; an empty benchmark hits nothing.  A column of the documents named like ``out`` is replaced.
    """
    documents = documents.drop(out)
    named = benchmark.select(F.col(item).cast("string").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    # A repeated text is one row with all its ids; every hit document lists them in one row too.
    distinct = named.groupBy("text").agg(F.collect_set("item").alias("items")).where("text <> ''")
    sized = cut_lineage(distinct.withColumn("size", F.octet_length("text").cast("long")).withColumn("key", F.xxhash64("text")))
    blocked, n_blocks = with_blocks(sized, "key", TEXTS_PER_BLOCK)
    summed = running(blocked.withColumn("_all", F.lit(0)), n_blocks, ["_all"], [F.col("key"), F.col("text")], F.col("size"), "sum", "end")
    first = F.floor((F.col("end") - F.col("size")) / block_bytes)
    last = F.floor((F.col("end") - 1) / block_bytes)
    pieces = cut_lineage(
        summed.select("items", "text", (last - first + 1).alias("of"), F.posexplode(F.sequence(first, last)).alias("number", "block"))
    )
    blocks = 1 + (pieces.agg(F.max("block")).head()[0] or 0)
    for block in range(blocks):
        rows = pieces.where(F.col("block") == block).collect()
        tests = TestSuffixes([(r["items"], r.text.encode(), r.number, r.of) for r in rows], window)
        if block == 0:
            documents = _pass(documents, text, tests, out)
            continue
        joined = _pass(cut_lineage(documents), text, tests, "_next")
        both = F.struct(
            F.col(f"{out}.n_words").alias("n_words"),
            F.concat(f"{out}.spans", "_next.spans").alias("spans"),
            F.array_distinct(F.concat(f"{out}.items", "_next.items")).alias("items"),
            F.greatest(f"{out}.longest", "_next.longest").alias("longest"),
        )
        documents = joined.withColumn(out, both).drop("_next")
    return documents


def hit_words(spans: Column) -> Column:
    """Words covered by spans that may overlap (they do if the benchmark came in several blocks)."""
    start, end = F.lit(0).cast("long"), F.lit(0).cast("long")
    return F.aggregate(
        F.sort_array(spans),
        F.struct(start.alias("n"), end.alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s[1] - F.greatest(s[0], acc["end"]), F.lit(0))).alias("n"),
            F.greatest(acc["end"], s[1]).alias("end"),
        ),
        lambda acc: acc["n"],
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a hit, with their columns."""
    found = contamination(documents, benchmark, out="_contamination", **options)
    return found.where(F.size("_contamination.spans") == 0).drop("_contamination")
