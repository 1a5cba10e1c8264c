"""Language identification by compression.

Each language gets a raw-content dictionary of its own texts.  A text is compressed with every dictionary and the
language whose dictionary leaves the fewest bytes wins; a narrow margin is a rejection.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.rows import annotate, held
from plumbline.session import cut_lineage

#: Bytes of a language's dictionary, and the most rows that fill it.
DICTIONARY_BYTES = 64 * 1024
SAMPLE_ROWS = 400
SAMPLE_PARTS = 64
#: Texts are compressed in blocks, so that a long text does not become its own dictionary.
BLOCK_BYTES = 2048
LEVEL = 6
#: Stands behind every block.  zstandard stores a block that saves too little as it is, which hides the few bytes a
#: dictionary saves on a short one; with this behind it every block is worth compressing and every match counts.
FILLER = bytes(64)
#: Dictionaries are also cut in so many parts; languages that need equally many bytes are told apart by their sums.
PARTS = 4
#: The runner-up must need this share more bytes than the winner, or the text is rejected.
MIN_MARGIN = 0.002
UNKNOWN = "und"
#: Characters of a piece of a long text at least, and the most pieces of one text.
PIECE = 160
MOST_PIECES = 256

GUESS = T.StructType(
    [
        T.StructField("lang_pred", T.StringType(), False),
        T.StructField("score", T.DoubleType(), False),
        T.StructField("margin", T.DoubleType(), False),
    ]
)


def learn(
    labelled: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    dictionary_bytes: int = DICTIONARY_BYTES,
    sample_rows: int = SAMPLE_ROWS,
) -> dict[str, bytes]:
    """A dictionary for each language, from a bounded sample.

    The sample is the ``sample_rows`` different texts of a language with the lowest hashes.  Each may fill an equal
    share of the dictionary, and what short texts leave goes to the longer ones.  Of a text longer than its share,
    pieces are read at hashed places spread over the whole text; a piece that several texts hold is taken once.  Rows
    with a null language or a text without letters teach nothing; an empty table gives no dictionaries.  Only the
    pieces reach the driver.
    """
    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), F.col(text).alias("text")
    )
    # Ranked in parts first, so that the last ranking sees at most SAMPLE_PARTS * sample_rows rows of a language.
    chosen = usable.select("lang", "h").distinct().withColumn("part", F.pmod("h", F.lit(SAMPLE_PARTS)))
    for keys in (["lang", "part"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
        chosen = chosen.withColumn("n", rank).where(F.col("n") <= sample_rows).drop("n")
    chosen = cut_lineage(chosen.select("lang", "h"))
    sizes = chosen.groupBy("lang").agg(F.count("*").alias("n"))
    chosen = chosen.join(F.broadcast(sizes), "lang")
    # Twice the bytes: letters_of shortens texts, and some are shorter than their share.
    share = F.ceil(F.lit(2 * dictionary_bytes) / F.col("n")).cast("int")
    rows = (
        usable.join(F.broadcast(chosen), ["lang", "h"])  # at most sample_rows a language
        .select("lang", "h", _pieces(F.col("text"), F.col("h"), share).alias("pieces"))
        .groupBy("lang", "h")
        .agg(F.min("pieces").alias("pieces"))
        .orderBy("lang", "h")
        .collect()
    )
    found: dict[str, dict[int, list[bytes]]] = {}
    for row in rows:
        known = found.setdefault(row.lang, {})
        known[row.h] = [x for x in map(letters_of, row.pieces) if x]
    return {k: _filled(list(v.values()), dictionary_bytes) for k, v in sorted(found.items())}


def _pieces(text: Column, h: Column, share: Column) -> Column:
    """The text, or pieces of it of ``share`` characters together, each at a hashed place in its part of the text."""
    size = F.char_length(text)
    n = F.greatest(F.lit(1), F.least(F.lit(MOST_PIECES), F.floor(share / PIECE))).cast("int")
    long = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.substring(
            text,
            (F.floor(size * i / n) + F.pmod(F.xxhash64(h, i), F.greatest(F.lit(1), F.floor((size - share) / n))) + 1).cast("int"),
            F.ceil(share / n).cast("int"),
        ),
    )
    return F.when(size <= share, F.array(text)).otherwise(long)


def _filled(texts: list[list[bytes]], room: int) -> bytes:
    """The pieces of all texts; if they do not fit, texts are cut to the one size that fills the room."""
    seen: set[bytes] = set()
    whole = []
    for pieces in texts:
        new = [p for p in pieces if not (p in seen or seen.add(p))]
        whole.append(b" ".join(new))
    whole = [w for w in whole if w]
    left, n, most = room, len(whole), 0
    for size in sorted(len(w) + 1 for w in whole):
        if size * n > left:
            most = left // n
            break
        left, n, most = left - size, n - 1, size
    return b" ".join(w[: max(0, most - 1)] for w in whole)[:room]


_PLAIN = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def letters_of(text: str) -> bytes:
    """The text in lower case, ASCII characters other than letters as single spaces."""
    return b" ".join(text.lower().encode().translate(_PLAIN).split())


class Compressors:
    """One compressor for each language; texts without letters are of no language."""

    def __init__(self, dictionaries: Mapping[str, bytes], block_bytes: int = BLOCK_BYTES, level: int = LEVEL):
        self.names = sorted(dictionaries)
        self.block_bytes = block_bytes
        self.letter = regex.compile(r"\p{L}")
        self.whole = [[_compressor(dictionaries[n], level)] for n in self.names]
        self.parts = []
        for name in self.names:
            octets = dictionaries[name]
            step = -(-len(octets) // PARTS) or 1
            self.parts.append([_compressor(octets[i : i + step], level) for i in range(0, PARTS * step, step)])

    def sizes(self, octets: bytes, compressors: list[list[Callable]] | None = None) -> list[int]:
        """Bytes left by each language, summed over its compressors (by default the one with the whole dictionary)."""
        step = self.block_bytes
        blocks = [octets[i : i + step] + FILLER for i in range(0, len(octets), step)]
        return [sum(len(c(b)) for c in own for b in blocks) for own in compressors or self.whole]

    def guess(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, margin; the score is the winner's share of 2**-bytes.

        Languages with equally few bytes are told apart by the mean over the parts of their dictionaries.  If these are
        equal too the first name is given, with margin 0.
        """
        if not text or not self.names or not self.letter.search(text):
            return UNKNOWN, 0.0, 0.0
        octets = letters_of(text)
        sizes = np.array(self.sizes(octets), dtype=np.float64)
        tied = sizes == sizes.min()
        if tied.sum() > 1:
            fine = np.array(self.sizes(octets, self.parts), dtype=np.float64) / PARTS
            sizes[tied] += fine[tied] - fine[tied].min()
        best = int(sizes.argmin())
        rest = np.delete(sizes, best)
        margin = float(rest.min() / sizes[best] - 1) if len(rest) else 1.0
        return self.names[best], float(1 / np.exp2(sizes[best] - sizes).sum()), margin


def _compressor(octets: bytes, level: int) -> Callable[[bytes], bytes]:
    raw = zstandard.ZstdCompressionDict(octets, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=raw, write_content_size=False, write_dict_id=False).compress


def identify(documents: DataFrame, dictionaries: Mapping[str, bytes], *, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1) and ``margin``; columns of these names are replaced.

    Null texts, texts without a letter, and any text if no language was learnt are ``und`` with score 0.  Nothing but
    the whole text is looked at.
    """

    def make() -> Callable:
        judge = held(("language", tuple(sorted(dictionaries.items()))), lambda: Compressors(dictionaries))
        return lambda column: list(zip(*map(judge.guess, column.to_pylist()), strict=True)) if len(column) else [[]] * 3

    return annotate(documents, [text], make, GUESS)


def confident(
    documents: DataFrame, dictionaries: Mapping[str, bytes], *, text: str = "text", min_margin: float = MIN_MARGIN
) -> DataFrame:
    """The documents whose language is told with at least ``min_margin``, with their own columns.

    Null texts, texts without a letter and ties that nothing settles go; repeated rows are judged alike and all stay.
    """
    # Columns travel under other names, as some may be called like those added; the text goes once.
    own = {c: f"c{i}" for i, c in enumerate(documents.columns)}
    judged = identify(documents.toDF(*own.values()), dictionaries, text=own[text])
    told = judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("margin") >= min_margin))
    return told.select(*[F.col(n).alias(c) for c, n in own.items()])


def training_part(documents: DataFrame, *, doc_id: str = "doc_id", folds: int = 5) -> DataFrame:
    """The rows that may teach: all but those whose crc32 of the id as text is divisible by ``folds``."""
    return documents.where(~held_out(doc_id, folds))


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row is kept from training; rows without an id are."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(True))
