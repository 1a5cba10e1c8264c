"""Text keys, normal forms, spans, number tokens and the sentence grammars of claims."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from plumbline.skew import spread

# --- Fixed values: number grammar, unit symbols and sentence forms -------------------------
NUMBER_TOKEN = (
    r"(?<![\w.])(?<!\w-)(?<!\d-)(?<!-)"
    r"(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)"
    r"(?!\w|\.\d|,\d{3}|-[A-Za-z0-9])"
)
UNIT_SUFFIX = (
    r"\s*(?:km2|ppt|ppm|ppb|km|cm|mm|nm|um|µm|kg|mg|ug|µg|ng|g|ms|min|hrs|hr|h|s|"
    r"ha|mL|ml|L|kbp|mbp|bp)\b"
)
PERCENT_SUFFIX = r"\s*(?:%|percent\b)"
SLASH_DATE = r"(?<![\d/])(\d{1,4})/(\d{1,2})/(\d{1,4})(?![\d/])"
NUMBER = r"-?(?:0|[1-9][0-9]*)(?:[.][0-9]+)?"
DIRECTIONAL = (
    r"(?i)^([A-Za-z][A-Za-z0-9 _-]*?) (increased|decreased) (.+?) "
    r"relative to ([A-Za-z][A-Za-z0-9 _-]*?)[.]?$"
)
QUANTITATIVE = (
    r"^At the queried ([1-9][0-9]*) kb pixel, the mean ([A-Za-z][A-Za-z0-9_-]*) "
    r"([A-Za-z][A-Za-z0-9 _/-]*?) is [*][*](" + NUMBER + r")[*][*], the mean "
    r"([A-Za-z][A-Za-z0-9_-]*) \3 is [*][*](" + NUMBER + r")[*][*], and the "
    r"([A-Za-z][A-Za-z0-9_-]*) difference is [*][*](" + NUMBER + r")[*][*] log2 units[.]$"
)
SENSITIVITY = {
    "unfiltered_leave_one_out_mean": (
        r"An unfiltered leave-one-out mean gives case=(" + NUMBER + r"), control=(" + NUMBER + r"), "
        r"and delta=(" + NUMBER + r")[.]"
    ),
    "quality_filtered_robust_median": (
        r"A robust median on the quality-filtered background gives case=(" + NUMBER + r"), "
        r"control=(" + NUMBER + r"), and delta=(" + NUMBER + r")[.]"
    ),
}
COMPLETE_FAMILY = (
    r"(?i)Multiplicity\s+contract:\s*Benjamini-Hochberg\s+false-discovery-rate\s+control\s+"
    r"at\s+alpha\s+(0(?:\.\d+)?|1(?:\.0+)?)\s+over\s+the\s+complete\s+tested\s+family\s+in\s+`([^`]+)`\.\s+"
    r"Raw\s+p-values\s+are\s+in\s+`([^`]+)`,\s+reported\s+adjusted\s+p-values\s+are\s+in\s+`([^`]+)`,\s+"
    r"and\s+final\s+discovery\s+calls\s+are\s+in\s+`([^`]+)`\."
)
ONE_PRIMARY = (
    r"(?is)one\s+preregistered\s+primary\s+hypothesis.*?"
    r"no\s+multiple-testing\s+adjustment\s+governs\s+this\s+decision"
)
INCOMPLETE_FAMILY = r"(?is)only\s+selected\s+hits.*?complete\s+set\s+of\s+tested\s+hypotheses.*?unavailable"
OTHER_PROCEDURE = r"(?i)\b(?:Storey|weighted|hierarchical|Bonferroni|Holm|Benjamini-Yekutieli)\b"
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWYBXZJUO"
SHORTEST_SEQUENCE = 20
# --------------------------------------------------------------------------------------------

LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
EDGE_SPACE = r"(?U)^\s+|\s+$"


def text_key(c: Column) -> Column:
    """Case-folded text with runs of white space collapsed (``lower`` stands in for casefold)."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^\ufeff", ""), r"\r\n?", "\n")


@pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def normalize_text(c: Column) -> Column:
    """NFC, LF newlines, no byte order mark.

    Spark runs a Python function on every row it is named for, so ASCII text, which is NFC already, goes to it as null
    and stays in the JVM.
    """
    plain = normalize_newlines(c)
    return F.coalesce(nfc(F.when(plain.rlike(r"[^\x00-\x7F]"), plain)), plain)


def line_number_at(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def document_spans(df: DataFrame, text: str) -> DataFrame:
    """One row per nonblank line that is not a heading: 1-based line, columns, trimmed text."""
    others = [c for c in df.columns if c != text]
    lines = spread(df).select(*others, F.posexplode(F.split(F.col(text), LINE_BREAK)).alias("_pos", "_line"))
    bare = F.regexp_replace("_line", EDGE_SPACE, "")
    left = F.length(F.regexp_replace("_line", r"(?U)^\s+", ""))
    return (
        lines.withColumn("text", bare)
        .where((F.col("text") != "") & ~F.col("text").startswith("#"))
        .select(
            *others,
            (F.col("_pos") + 1).alias("line"),
            (F.length("_line") - left + 1).alias("start_column"),
            (F.length(F.regexp_replace("_line", r"(?U)\s+$", "")) + 1).alias("end_column"),
            "text",
        )
    )


def number_tokens(text: Column, largest: float | None = None) -> Column:
    """Array of (raw, value, is_integer, decimals, is_percent) for every stated number.

    The slashes of a date become letters first, so its parts fail the number grammar and
    everything around the date is judged as before.  ``raw`` keeps every digit of any size; tokens above ``largest``
    are left out if it is given.
    """
    masked = F.regexp_replace(text, "(?U)" + SLASH_DATE, "$1x$2x$3")
    pattern = "(?U)" + NUMBER_TOKEN + f"(?!{UNIT_SUFFIX})(?:{PERCENT_SUFFIX})?"
    found = F.regexp_extract_all(masked, F.lit(pattern), 0)

    def token(match: Column) -> Column:
        raw = F.regexp_replace(F.regexp_extract(match, r"^[0-9.,]+", 0), ",", "")
        fraction = F.substring_index(raw, ".", -1)
        whole = ~raw.contains(".")
        return F.struct(
            raw.alias("raw"),
            raw.try_cast("double").alias("value"),
            whole.alias("is_integer"),
            F.when(whole, F.lit(0)).otherwise(F.length(fraction)).alias("decimals"),
            match.rlike(PERCENT_SUFFIX + "$").alias("is_percent"),
        )

    tokens = F.transform(found, token)
    return tokens if largest is None else F.filter(tokens, lambda t: t["value"] <= largest)


def rate_readings(tokens: Column) -> Column:
    """Array of (raw, rate, tolerance): each rate token as the proportions it can state."""

    def readings(t: Column) -> Column:
        tolerance = 0.5 * F.pow(F.lit(10.0), -t["decimals"])
        as_is = F.struct(t["raw"].alias("raw"), t["value"].alias("rate"), tolerance.alias("tolerance"))
        percent = F.struct(
            t["raw"].alias("raw"), (t["value"] / 100.0).alias("rate"), (tolerance / 100.0).alias("tolerance")
        )
        return (
            F.when(t["is_percent"] & (t["value"] > 0) & (t["value"] <= 100), percent)
            .when(t["is_percent"], F.lit(None))
            .when((t["value"] > 0) & (t["value"] <= 1), as_is)
            .when((t["value"] > 1) & (t["value"] <= 100), percent)
        )

    return F.filter(F.transform(tokens, readings), lambda r: r.isNotNull())


def directional_claims(spans: DataFrame) -> DataFrame:
    """Claims of the form ``X increased|decreased Y relative to Z``."""
    part = [F.regexp_extract("text", DIRECTIONAL, i) for i in range(1, 5)]
    return spans.where(F.col("text").rlike(DIRECTIONAL)).select(
        "*",
        part[0].alias("subject"),
        part[2].alias("object"),
        F.concat_ws(" versus ", part[0], part[3]).alias("comparison"),
        F.when(F.lower(part[1]) == "increased", F.lit("positive")).otherwise(F.lit("negative")).alias("direction"),
    )


def quantitative_claims(spans: DataFrame) -> DataFrame:
    """Two stated means and their difference; the contrast label must name both sides."""
    part = [F.regexp_extract("text", QUANTITATIVE, i) for i in range(1, 9)]
    return (
        spans.where(F.col("text").rlike(QUANTITATIVE))
        .where(part[6] == F.concat_ws("-minus-", part[1], part[4]))
        .select(
            "*",
            (part[0].cast("long") * 1000).alias("resolution_bp"),
            part[1].alias("left_label"),
            part[4].alias("right_label"),
            part[2].alias("measure"),
            part[3].alias("left_value"),
            part[5].alias("right_value"),
            part[7].alias("estimate"),
        )
    )


def sensitivity_claims(spans: DataFrame, document: str) -> DataFrame:
    """Stated sensitivity triples; an alternative stated more than once is not an answer."""
    found = []
    for name, pattern in SENSITIVITY.items():
        matches = F.regexp_count("text", F.lit(pattern))
        triple = [F.regexp_extract("text", pattern, i) for i in (1, 2, 3)]
        found.append(
            spans.where(matches > 0)
            .groupBy(document)
            .agg(
                F.sum(matches).alias("_n"),
                *[F.first(c).alias(n) for n, c in zip(("case_value", "control_value", "delta"), triple)],
            )
            .where("_n = 1")
            .select(document, F.lit(name).alias("alternative"), "case_value", "control_value", "delta")
        )
    return found[0].unionByName(found[1])


def multiplicity_declaration(df: DataFrame, text: str) -> DataFrame:
    """Applicability of a BH recheck and the declared alpha, table and columns, per report."""
    n_complete = F.regexp_count(text, F.lit(COMPLETE_FAMILY))
    one, partial = F.col(text).rlike(ONE_PRIMARY), F.col(text).rlike(INCOMPLETE_FAMILY)
    recognised = n_complete + one.cast("int") + partial.cast("int")
    state = (
        F.when(recognised > 1, F.lit("ambiguous"))
        .when(one, F.lit("not_applicable"))
        .when(partial, F.lit("ambiguous"))
        .when((recognised == 1) & F.col(text).rlike(OTHER_PROCEDURE), F.lit("ambiguous"))
        .when(recognised == 1, F.lit("applicable"))
    )
    out = df.withColumn("applicability", state).where(F.col("applicability").isNotNull())
    names = ("alpha", "table_path", "raw_column", "adjusted_column", "call_column")
    for i, name in enumerate(names, start=1):
        value = F.regexp_extract(text, COMPLETE_FAMILY, i)
        out = out.withColumn(name, F.when(F.col("applicability") == "applicable", value))
    return out


def sequence_record(
    c: Column, shortest: int = SHORTEST_SEQUENCE, longest: int | None = None, longest_label: int | None = None
) -> Column:
    """Is the text one sequence line and one label line, and nothing else?  Upper lengths hold only if given."""
    lines = F.split(F.regexp_replace(c, r"(?:\r\n|[\n\r])$", ""), LINE_BREAK)
    sequence, label = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    letters = f"^(?i)[{AMINO_ACIDS}]+$"
    tidy = lambda x: (x != "") & (F.regexp_replace(x, EDGE_SPACE, "") == x)
    bounded = F.length(sequence) >= shortest
    if longest is not None:
        bounded = bounded & (F.length(sequence) <= longest)
    if longest_label is not None:
        bounded = bounded & (F.length(label) <= longest_label)
    return (
        (F.size(lines) == 2)
        & tidy(sequence)
        & tidy(label)
        & bounded
        & sequence.rlike(letters)
        & ~label.startswith(">")
        & label.rlike(r"\p{L}")
        & ~label.rlike(letters)
    )


def decimal_text(c: Column) -> Column:
    """Canonical decimal text: no exponent, no trailing zeros."""
    text = c.cast("string")
    bare = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(text.contains("."), bare).otherwise(text)
