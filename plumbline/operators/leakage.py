"""Documents that contain forbidden content: paths, digests, markers and whole texts."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from plumbline.functions.text import normalize_text
from plumbline.session import cut_lineage
from plumbline.skew import spread

SHINGLE = 6
GRAM = 8
BORDER = 3
NEEDLES_TOGETHER = 1000


# Odd multipliers of the rolling hash, and white space.  Any fixed set of spaces is right, if both sides are cut by it.
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
IS_SPACE = np.zeros(0x3002, dtype=bool)
IS_SPACE[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
SCREEN = 1 << 20


def _mixed(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint64(kind)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    ahead = np.full(size, BASE, dtype=np.uint64)
    back = np.full(size, INVERSE, dtype=np.uint64)
    ahead[0] = back[0] = 1
    return np.cumprod(ahead), np.cumprod(back)


class _Letters:
    """The words of one text and 64-bit hashes of any spans of it, whole arrays at a time."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.blank = IS_SPACE[np.minimum(codes, 0x3001)]
        ahead, self.back = _powers(1 << max(16, (len(codes) + 1).bit_length()))
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * ahead[: len(codes)], out=self.sums[1:])
        edges = np.diff(np.concatenate([[1], self.blank.astype(np.int8), [1]]))
        self.starts, self.ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        self.known: dict[tuple[str, int], np.ndarray] = {}

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start], 0)

    def runs(self, k: int, inner: bool = False) -> np.ndarray:
        """Every run of ``k`` neighbouring words; ``inner``: without the first and the last word."""
        words = self.spans(self.starts, self.ends)
        words = words[1:-1] if inner else words
        n = max(len(words) - k + 1, 0)
        total = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            total = total * np.uint64(BASE) + words[i : i + n]
        return _mixed(total, k)

    def borders(self, a: int, b: int) -> np.ndarray:
        """The last ``a`` letters of each word with the first ``b`` of the next, where they have as many."""
        size = self.ends - self.starts
        if ("tail", a) not in self.known:
            self.known["tail", a] = self.spans(np.maximum(self.ends - a, 0), self.ends)[:-1] * np.uint64(BASE)
        if ("head", b) not in self.known:
            self.known["head", b] = self.spans(self.starts, np.minimum(self.starts + b, len(self.blank)))[1:]
        long = (size[:-1] >= a) & (size[1:] >= b)
        return _mixed(self.known["tail", a] + self.known["head", b], 100 + 10 * a + b)[long]

    def grams(self, q: int) -> np.ndarray:
        """Every run of ``q`` letters inside a word."""
        spaces = np.concatenate([[0], np.cumsum(self.blank)])
        at = np.flatnonzero(spaces[q:] == spaces[: max(len(spaces) - q, 0)])
        return _mixed(self.spans(at, at + q), 1000 + q)

    def keys(self, kind: tuple[str, int, int], inner: bool = False) -> np.ndarray:
        name, a, b = kind
        if name == "run":
            return self.runs(a, inner)
        if name == "border":
            return self.borders(a, b)
        if name == "gram":
            return self.grams(a)
        return np.full(int(self.blank.any()), 7, dtype=np.uint64)

    def kind(self) -> tuple[str, int, int]:
        """The kind of keys that hold for every text around this one."""
        size, n = self.ends - self.starts, len(self.starts)
        if n > 2:
            return "run", min(n - 2, SHINGLE), 0
        if n == 2:
            return "border", min(int(size[0]), BORDER), min(int(size[1]), BORDER)
        return ("gram", min(int(size[0]), GRAM), 0) if n else ("blank", 0, 0)


def _item_keys() -> Callable[[Column], Column]:
    @pandas_udf("kind string, a int, b int, keys array<bigint>")
    def keys(needles: pd.Series) -> pd.DataFrame:
        rows = []
        for letters in map(_Letters, needles):
            kind = letters.kind()
            rows.append((*kind, np.unique(letters.keys(kind, inner=True)).view(np.int64)))
        return pd.DataFrame(rows, columns=["kind", "a", "b", "keys"])

    return keys


def _text_keys(kinds: list[tuple[str, int, int]], screen: np.ndarray) -> Callable[[Column], Column]:
    """The keys of a text whose last bits are those of some item's key."""

    @pandas_udf("array<bigint>")
    def keys(texts: pd.Series) -> pd.Series:
        def read(text: str) -> np.ndarray:
            letters = _Letters(text)
            found = [h[screen[h & np.uint64(SCREEN - 1)]] for h in map(letters.keys, kinds)]
            return np.unique(np.concatenate(found)).view(np.int64)

        return texts.map(read, na_action="ignore")

    return keys


def contained_texts(documents: DataFrame, forbidden: DataFrame, *, document: str = "doc_id", item: str = "item_id") -> DataFrame:
    """Every (document, item) where the item's normalised text occurs in the document's.

    An item is looked up through its rarest key, and only documents that hold the key are
    compared in full.  Keys hold for every containing document, so the answer is exact:

    * three words or more: runs of up to ``SHINGLE`` words between the first and the last word,
      which occur in the document as whole words;
    * two words: the letters on both sides of the gap between them;
    * one word: letter runs, which lie inside one word of the document;
    * only white space: any white space at all.
    """
    return _containments(documents, forbidden, [document], item)


def _containments(documents: DataFrame, forbidden: DataFrame, document: list[str], item: str) -> DataFrame:
    """(document, item) as :func:`contained_texts` gives them, where ``document`` names the columns that tell texts apart."""
    items = cut_lineage(
        forbidden.select(item, normalize_text(F.col("text")).alias("needle"))
        .where(F.length("needle") > 0)
        .withColumn("_keys", _item_keys()("needle"))
    )
    # Kinds of keys in use: at most SHINGLE + BORDER * BORDER + GRAM + 1 rows.
    kinds = sorted(tuple(r) for r in items.select("_keys.kind", "_keys.a", "_keys.b").distinct().collect())
    if not kinds:
        nothing = items.select(item).where(F.lit(False))
        return nothing.select(*[F.lit(None).cast(documents.schema[c].dataType).alias(c) for c in document], item)
    texts = spread(documents.select(*document, "text")).select(*document, normalize_text(F.col("text")).alias("hay"))
    keys = items.select(item, F.explode("_keys.keys").alias("h"))
    # At most SCREEN numbers, however many items there are; the join below asks for the whole key.
    screen = np.zeros(SCREEN, dtype=bool)
    screen[keys.select(F.col("h").bitwiseAND(SCREEN - 1).alias("h")).distinct().toPandas()["h"].to_numpy()] = True
    posted = texts.select(*document, F.explode(_text_keys(kinds, screen)("hay")).alias("h"))
    # Only keys that some item has are kept, so the posting list is as small as the overlap.
    hits = cut_lineage(posted.join(keys.select("h").distinct(), "h", "left_semi"))
    frequency = hits.groupBy("h").agg(F.count("*").alias("_f"))
    anchors = keys.join(frequency, "h").groupBy(item).agg(F.min(F.struct("_f", "h")).alias("_a"))
    candidates = anchors.select(item, F.col("_a.h").alias("h")).join(hits, "h").select(*document, item)
    # A text is normalised once more, not once a candidate: it is met by its candidates together, some at a time.
    place = F.row_number().over(Window.partitionBy(*document).orderBy(item))
    batches = (
        candidates.distinct()
        .withColumn("_batch", F.floor((place - 1) / NEEDLES_TOGETHER))
        .join(items.select(item, "needle"), item)
        .groupBy(*document, "_batch")
        .agg(F.collect_list(F.struct(item, "needle")).alias("_needles"))
    )
    batches = cut_lineage(batches)
    met = spread(documents.select(*document, "text").join(batches.select(*document).distinct(), document, "left_semi"))
    hay = met.select(*document, normalize_text(F.col("text")).alias("hay"))
    found = F.filter("_needles", lambda n: F.contains(F.col("hay"), n["needle"]))
    return hay.join(batches, document).select(*document, F.explode(found).alias("_n")).select(*document, F.col("_n")[item].alias(item))


def decoded_texts(documents: DataFrame, document: str, payload: str) -> DataFrame:
    """(document, text): what the bytes of each document say, once for each way to read them.

    UTF-8 with or without a byte order mark; and, where there is a NUL or another mark, UTF-16 of either byte order from
    the first and from the second byte, so that text inside other bytes is read too.  Only those bytes go to Python.
    """

    @pandas_udf(ArrayType(StringType()))
    def wide(payloads: pd.Series) -> pd.Series:
        def read(data: bytes) -> list[str]:
            found = [data[at:].decode(code, "replace") for code in ("utf-16-le", "utf-16-be") for at in (0, 1)]
            return list(dict.fromkeys([data.decode("utf-8", "replace"), *[t.removeprefix("\ufeff") for t in found]]))

        return payloads.map(read, na_action="ignore")

    data = F.col(payload)
    marked = F.coalesce(F.substring(data, 1, 2).isin(b"\xff\xfe", b"\xfe\xff") | F.contains(data, F.lit(b"\x00")), F.lit(False))
    narrow = F.when(F.substring(data, 1, 3) == F.lit(b"\xef\xbb\xbf"), F.substring(data, 4, 1 << 30)).otherwise(data)
    sent = spread(documents.select(document, payload)).select(document, narrow.alias("_narrow"), wide(F.when(marked, data)).alias("_wide"))
    one = F.array(F.coalesce(F.try_validate_utf8(F.col("_narrow").cast("string")), F.make_valid_utf8(F.col("_narrow").cast("string"))))
    return sent.select(document, F.explode(F.coalesce("_wide", one)).alias("text")).where(F.col("text").isNotNull())


def leakage_scan(
    documents: DataFrame,
    forbidden_texts: DataFrame,
    *,
    payload: str | None = None,
    markers: DataFrame | None = None,
    forbidden_digests: DataFrame | None = None,
    forbidden_paths: DataFrame | None = None,
    document: str = "doc_id",
) -> DataFrame:
    """(document, reason): forbidden path, digest, marker or embedded text.

    ``documents``: id, text and, for paths, path.  ``forbidden_texts`` and ``markers``: item_id,
    text.  ``forbidden_digests``: digest of the exact text.  ``forbidden_paths``: path.  With ``payload``, a column of
    bytes takes the place of the text and is read as :func:`decoded_texts` reads it.
    """
    # Both lists are looked for in one pass; each reading of a payload is a text of its own.
    texts, key = documents, [document]
    if payload is not None:
        texts, key = cut_lineage(decoded_texts(documents, document, payload).withColumn("_reading", F.monotonically_increasing_id())), [document, "_reading"]
    lists = [forbidden_texts.select(F.lit("text").alias("reason"), "text")]
    if markers is not None:
        lists.append(markers.select(F.lit("marker").alias("reason"), "text"))
    wanted = reduce(DataFrame.unionByName, lists).distinct().select(F.concat_ws(":", "reason", F.sha2("text", 256)).alias("_wanted"), "text")
    embedded = _containments(texts, wanted, key, "_wanted")
    found = [embedded.select(document, F.split_part("_wanted", F.lit(":"), F.lit(1)).alias("reason"))]
    if forbidden_digests is not None:
        digested = documents.select(document, F.concat(F.lit("sha256:"), F.sha2(payload or "text", 256)).alias("digest"))
        found.append(
            digested.join(forbidden_digests.select("digest"), "digest", "left_semi").select(
                document, F.lit("digest").alias("reason")
            )
        )
    if forbidden_paths is not None:
        found.append(
            documents.join(forbidden_paths.select("path"), "path", "left_semi").select(
                document, F.lit("path").alias("reason")
            )
        )
    return reduce(DataFrame.unionByName, found).distinct()
