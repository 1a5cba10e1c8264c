"""Quality rules as a ledger of bits.

Every rule is evaluated once for each document.  The ledger keeps its failures as bits beside the measurements they
come from; a policy is a version with a mask of rules, applied later with bitwise operations, as are ablations.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.rows import annotate, texts

#: Words of a window that must not come back.
WINDOW = 8
MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
    "n_distinct_words",
    "n_capitals",
    "n_small_letters",
)
_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in _SYMBOLS)
_CONTINUATION = bytes(range(0x80, 0xC0))
_CAPITALS = bytes(range(65, 91))
#: Small ASCII letters and the first bytes of all characters beyond ASCII.
_SMALL = bytes([*range(97, 123), *range(0xC0, 0x100)])
_ODD = np.array([pow(0x5851F42D4C957F2D, k + 1, 1 << 63) for k in range(WINDOW)], dtype=np.int64)


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over the measurements."""

    bit: int
    name: str
    fails: str

    @property
    def mask(self) -> int:
        return 1 << self.bit


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "10 * n_dup_lines > 5 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule(5, "shouting", "n_capitals > n_small_letters AND n_words >= 20"),
    Rule(6, "few_letters", "2 * (n_capitals + n_small_letters) < word_chars"),
    Rule(7, "few_distinct_words", "7 * n_distinct_words < n_words AND n_words < 200"),
)
BASE = RULES[0].mask | RULES[1].mask
#: Versions of the policy: the rules each applies.
POLICIES: Mapping[str, int] = {
    "base": BASE,
    "2024-1": BASE | RULES[2].mask | RULES[3].mask,
    "2024-2": sum(r.mask for r in RULES),
}
CURRENT = "2024-2"


def repeated_words(words: Sequence[bytes], window: int = WINDOW) -> int:
    """Words that lie in windows found at least twice in the text, first ones included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    mixed = np.fromiter(map(hash, words), np.int64, len(words)) * _ODD[:, None]
    sums = sum(mixed[k, k : k + n] for k in range(window)) if window == WINDOW else np.zeros(n)
    sums.sort()
    if not (sums[1:] == sums[:-1]).any():
        return 0  # equal windows have equal sums
    numbers: dict[bytes, int] = {}
    name = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    # Names of 2, 4, 8 ... words: equal numbers mean equal words.
    width = 1
    while width < window:
        step = min(width, window - width)
        pair = name[: len(name) - step] * len(words) + name[step:]
        name = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        width += step
    twice = np.bincount(name)[name] > 1
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    edges[at] += 1
    edges[at + window] -= 1
    return int((np.cumsum(edges)[:-1] > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    glued = b"".join(words)
    chars = glued.translate(None, _CONTINUATION)
    return (
        len(words),
        len(chars),
        len(text.translate(None, _NOT_SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(set(words)),
        len(chars) - len(chars.translate(None, _CAPITALS)),
        len(chars) - len(chars.translate(None, _SMALL)),
    )


def ledger(documents: DataFrame, *, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add the measurements and ``failed``, a long with the bit of each rule that the whole text fails.

    Words are parted by ASCII white space; null and empty texts measure 0 everywhere.  Columns named like a
    measurement or ``failed`` are replaced.
    """

    def make() -> Callable:
        return lambda column: list(zip(*map(measure, texts(column)), strict=True)) if len(column) else [[]] * len(MEASURES)

    fields = T.StructType([T.StructField(m, T.LongType(), False) for m in MEASURES])
    measured = annotate(documents.drop("failed"), [text], make, fields)
    bits = [F.when(F.expr(r.fails), F.lit(r.mask)).otherwise(F.lit(0)).cast("long") for r in rules]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed)


def passes(mask: int, failed: str | Column = "failed") -> Column:
    """The verdict of a policy: none of its rules failed."""
    return (F.col(failed) if isinstance(failed, str) else failed).bitwiseAND(F.lit(mask).cast("long")) == 0


def apply_policies(rows: DataFrame, policies: Mapping[str, int] = POLICIES) -> DataFrame:
    """Add a boolean ``kept_<version>`` for each version of the policy; no text is read again."""
    return rows.withColumns({f"kept_{version}": passes(mask) for version, mask in policies.items()})


def ablations(rows: DataFrame, mask: int, rules: Sequence[Rule] = RULES) -> DataFrame:
    """For each rule of the policy ``mask``: documents that fail it, that fail it alone, and that would be kept
    without it.

    The ledger is reduced to one row per combination of bits first, so the size of the corpus is met once.
    """
    failed = F.col("failed").bitwiseAND(F.lit(mask).cast("long"))
    combined = rows.groupBy(failed.alias("failed")).count()
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.mask).cast("long").alias("bit")) for r in rules if r.mask & mask]))
    spread = combined.select("failed", "count", each.alias("r"))
    count = F.col("count")
    has = F.col("failed").bitwiseAND(F.col("r.bit")) != 0
    rest = F.col("failed").bitwiseAND(F.bitwise_not("r.bit"))
    return spread.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(has, count).otherwise(0)).alias("n_failed"),
        F.sum(F.when(has & (rest == 0), count).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(rest == 0, count).otherwise(0)).alias("n_kept_without"),
    )
