"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found in each text with their places.  Their hashes are counted by distinct repositories and owners:
a value that many owners hold is a copied example, one that few hold and that looks random is taken for live.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

#: A value held by at least this many owners is a copied example.
MANY_OWNERS = 3
#: Different characters a random-looking value has at least.
DISTINCT_CHARACTERS = 8
PLACEHOLDER = "(?i)example|sample|changeme|placeholder|your|dummy|test|xxxx|0123456|1234567|abcdef"
#: For redaction: words of a placeholder that stand alone in a value, and values that are no more than a sequence.
PLACEHOLDER_ALONE = (
    "(?i)(?:^|[^a-z])(?:example|sample|changeme|placeholder|your|dummy|test)(?:[^a-z]|$)"
    "|^(?:0?1234567[0-9]*|(?:0123456789)?abcdef[a-z]*)$"
)
#: Kinds that are known by their form alone.
WELL_FORMED = ("access", "prefixed", "signed")
#: Running sums are made in blocks of this many matches, so that a text full of matches stays cheap.
BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """``value`` is the group that holds the secret; matches whose value is shorter than ``least`` are dropped.

    Every match of a ``base`` kind is a span; the others are spans only if taken for live.
    """

    name: str
    pattern: str
    value: int
    least: int
    base: bool = True


KINDS = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 18),
    Kind("hex", r"[0-9a-f]{16,}", 0, 16),
    Kind("prefixed", r"\b(?:gh[opsur]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", 0, 15, False),
    Kind("signed", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 32, False),
)


def _running(lengths: Column) -> Column:
    """Sums of all earlier elements, for each element; two levels, so that no array is copied for each element."""

    def within(values: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(values, first, step, lambda acc: acc["out"])

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")),
        lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)),
    )
    totals = F.transform(blocks, lambda v: F.aggregate(v, F.lit(0), lambda a, x: a + x))
    return F.flatten(F.zip_with(blocks, within(totals, F.lit(0)), within))


def matches(text: Column, kind: Kind, order: int) -> Column:
    """Leftmost matches that do not overlap: kind, order, start, end (code points, end exclusive) and value.

    The text between matches and the matches themselves alternate, so places are running sums of their lengths.
    """
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    values = whole if kind.value == 0 else F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.value))
    between = F.split(text, kind.pattern, -1)
    gap = F.transform(F.slice(between, F.lit(1), F.size(whole)), lambda x: F.char_length(x))
    size = F.transform(whole, lambda x: F.char_length(x))
    before = _running(F.zip_with(gap, size, lambda a, b: a + b))
    starts = F.zip_with(before, gap, lambda a, b: a + b)
    found = F.transform(
        F.arrays_zip(starts.alias("start"), size.alias("size"), values.alias("value")),
        lambda x: F.struct(
            F.lit(kind.name).alias("kind"),
            F.lit(order).alias("order"),
            x["start"].alias("start"),
            (x["start"] + x["size"]).alias("end"),
            x["value"].alias("value"),
        ),
    )
    kept = F.filter(found, lambda x: F.char_length(x["value"]) >= kind.least)
    return F.when(text.rlike(kind.pattern), kept).otherwise(F.filter(F.array(_nothing()), lambda x: F.lit(False)))


def _nothing() -> Column:
    return F.struct(
        F.lit("").alias("kind"),
        F.lit(0).alias("order"),
        F.lit(0).alias("start"),
        F.lit(0).alias("end"),
        F.lit("").alias("value"),
    )


def candidates(text: str = "text", kinds: Sequence[Kind] = KINDS) -> Column:
    """All matches of all kinds in a text, by start, then kind; null is an empty text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(*[matches(whole, k, n) for n, k in enumerate(kinds)])
    return F.array_sort(found, lambda a, b: F.coalesce(F.nullif(a["start"] - b["start"], F.lit(0)), a["order"] - b["order"]))


def looks_random(value: Column) -> Column:
    """Letters and digits, many different characters, no word of a placeholder."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    mixed = value.rlike("[A-Za-z]") & value.rlike("[0-9]")
    return mixed & (distinct >= DISTINCT_CHARACTERS) & ~value.rlike(PLACEHOLDER)


def leaks(kind: Column, value: Column) -> Column:
    """Whether a value that few owners hold is redacted: any of a well-formed kind, others with many different
    characters that are no placeholder.  Digits alone are a number, not hexadecimal."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    varied = (distinct >= DISTINCT_CHARACTERS) & ~value.rlike(PLACEHOLDER_ALONE)
    return kind.isin(*WELL_FORMED) | (varied & ((kind != "hex") | value.rlike("[a-f]")))


def ownership(found: DataFrame) -> DataFrame:
    """``hash``, ``n_repositories``, ``n_owners``, ``n_found`` of each candidate in columns hash, repository, owner.

    Equal (hash, repository, owner) are counted before they are dealt out by hash, so a value copied into a third of
    all rows reaches its task as one row for each place that holds it.
    """
    places = found.groupBy("hash", "repository", "owner").agg(F.count("*").alias("n"))
    return places.groupBy("hash").agg(
        F.count_distinct("repository").alias("n_repositories"),
        F.count_distinct("owner").alias("n_owners"),
        F.sum("n").alias("n_found"),
    )


def scan(
    documents: DataFrame,
    *,
    repository: str | Column,
    owner: str | Column,
    text: str = "text",
    keep: Sequence[str] | None = None,
    kinds: Sequence[Kind] = KINDS,
    many_owners: int = MANY_OWNERS,
    out: str = "secrets",
) -> DataFrame:
    """Add ``out``: an array of kind, start, end, base, n_repositories, n_owners, n_found, live, leak; by start, then kind.

    ``keep`` names the columns to carry (default: all, texts too).  Base kinds are always there, others only if
    live, held by fewer than ``many_owners`` owners and random to look at, or a leak: held by as few and of a kind's
    form (``leaks``), which is what is redacted.  A null repository or owner is no place;
    null and empty texts have no secrets; repeated rows each get theirs, and count once for a place.  A column named
    like ``out`` is replaced.
    """
    columns = [c for c in (documents.columns if keep is None else keep) if c != out]
    carried = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    place = [(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in ((repository, "repository"), (owner, "owner"))]
    found = documents.select(carried, *place, candidates(text, kinds).alias("found"))
    rows = cut_lineage(found.withColumn("id", F.monotonically_increasing_id()))
    # Rows without candidates are done; nothing of them is shuffled.
    some = rows.where(F.size("found") > 0)
    each = some.select("id", "repository", "owner", F.inline("found")).withColumn("hash", F.sha2("value", 256))
    # Written, so that the join is of two plain exchanges, whose heavy keys Spark splits.
    each = each.join(cut_lineage(ownership(each.select("hash", "repository", "owner"))), "hash")
    live = (F.col("n_owners") < many_owners) & looks_random(F.col("value"))
    base = F.col("kind").isin([k.name for k in kinds if k.base])
    fields = ["order", "start", "end", "kind", "base", "n_repositories", "n_owners", "n_found", "live", "leak"]
    leak = live | ((F.col("n_owners") < many_owners) & leaks(F.col("kind"), F.col("value")))
    each = each.withColumn("leak", leak).withColumn("live", live).withColumn("base", base).where("base or leak")
    sort = F.sort_array(F.collect_list(F.struct("start", "order", *[f for f in fields if f not in ("start", "order")])))
    judged = some.select("id", "row").join(each.groupBy("id").agg(sort.alias(out)), "id", "left")
    empty = F.lit(None).cast(judged.schema[out].dataType)
    both = judged.select("row", out).unionByName(rows.where(F.size("found") == 0).select("row", empty.alias(out)))
    return both.select("row.*", F.coalesce(out, F.array().cast(judged.schema[out].dataType)).alias(out))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(documents: DataFrame, *, repository: str | Column, owner: str | Column, text: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """The documents with every live or leaked secret replaced by ``mark``; copied examples and everything else stay.

    Spans that overlap are replaced by one mark.  Columns and rows are those of ``documents``.
    """
    found = scan(documents, repository=repository, owner=owner, text=text, out="_secrets", **options)
    spans = F.filter("_secrets", lambda s: s["leak"])
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col(text), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        joined = F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mark)))
        return F.struct(joined.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.char_length(F.col(text))))
    cleaned = F.when(F.size(spans) > 0, F.aggregate(spans, begin, step, rest)).otherwise(F.col(text))
    return found.withColumn(text, cleaned).select(*documents.columns)
