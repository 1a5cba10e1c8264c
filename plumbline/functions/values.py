"""JSON pointers and grading, relative paths, roles, and timestamps."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ids import canonical_at, canonical_json

# Languages and roles by file suffix and name.
LANGUAGES = {
    ".py": "python",
    ".md": "markdown",
    ".qmd": "quarto",
    ".rmd": "r_markdown",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".csv": "csv",
    ".sh": "shell",
}
SOURCE_SUFFIXES = (".py", ".r", ".sh")
DATA_SUFFIXES = (".csv", ".tsv", ".parquet")
OFFSET = r"(Z|[+-]\d{2}:?\d{2}(:\d{2})?)$"


def pointer_tokens(pointer: str) -> list[str]:
    """The keys of a JSON Pointer, with ``~0`` and ``~1`` read."""
    if pointer == "":
        return []
    if not pointer.startswith("/"):
        raise ValueError("a JSON pointer starts with /")
    return [token.replace("~1", "/").replace("~0", "~") for token in pointer[1:].split("/")]


def json_at(text: Column, pointer: str) -> Column:
    """The canonical JSON at a pointer; null for malformed JSON, repeated keys or no such place."""
    pointer_tokens(pointer)  # refuses what is no pointer
    return canonical_at(text, pointer)


def json_grade(df: DataFrame, actual: str, expected: str, pointer: str = "") -> DataFrame:
    """Exact grade: canonical JSON at the pointer equals the canonical expected JSON."""
    got = json_at(F.col(actual), pointer) if pointer else canonical_json(F.col(actual))
    want = canonical_json(F.col(expected))
    return df.withColumn(
        "grade",
        F.when(canonical_json(F.col(actual)).isNull(), F.lit("malformed"))
        .when(got.isNull(), F.lit("missing"))
        .when(got == want, F.lit("match"))
        .otherwise(F.lit("mismatch")),
    )


def safe_relative_path(c: Column) -> Column:
    """Relative, normal, without empty, ``.`` or ``..`` parts, backslashes or NULs."""
    return (
        (c != "")
        & (F.trim(c) == c)
        & ~c.rlike(r"[\\\x00]")
        & ~c.rlike(r"(^|/)(\.{0,2})(/|$)")
    )


def _suffix(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(name, r".(\.[^.]+)$", 1))


def language_of(path: Column) -> Column:
    pairs = [F.lit(x) for item in LANGUAGES.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _suffix(path)), F.lit("unknown"))


def role_of(path: Column) -> Column:
    name = F.lower(F.substring_index(path, "/", -1))
    return (
        F.when(name.contains("report") | name.contains("manuscript"), F.lit("report_candidate"))
        .when(_suffix(path).isin(*SOURCE_SUFFIXES), F.lit("analysis_source"))
        .when(_suffix(path).isin(*DATA_SUFFIXES), F.lit("data_or_result"))
        .otherwise(F.lit("other"))
    )


def is_checksum_manifest(path: Column) -> Column:
    low = F.lower(path)
    return ~path.contains("/") & (low.isin("sha256sums", "sha256sums.txt") | low.endswith(".sha256"))


def utc_timestamp(text: Column) -> Column:
    """ISO-8601 text with a mandatory offset, as a UTC instant; null otherwise."""
    return F.when(text.rlike(OFFSET), F.try_to_timestamp(text))


def seconds_between(start: Column, end: Column) -> Column:
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / 1e6, 6)
