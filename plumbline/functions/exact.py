"""Decimal numbers of any length as columns, and exact comparison of their quotients.

A number is its digits without zeros at either end and the power of ten of ``0.digits``; zero has no digits.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StringType

# Fixed value: the spellings of a finite decimal number.
NUMBER = r"^([+-]?)(\d+)?(?:\.(\d+)?)?(?:[eE]([+-]?\d+))?$"
PLAIN = r"^[0-9]+(\.[0-9]+)?$"
ZERO_EXPONENT = -(1 << 30)
#: Digits that tell two quotients apart beyond those of their numerators, for divisors up to 10**13.
GUARD = 40


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse(text: Column) -> Column:
    """(exponent, digits, negative) of a finite decimal number; null for any other text.

    Structs of non-negative numbers order like the numbers, and are equal exactly if the numbers are.
    """
    given = text.cast("string")
    text = F.regexp_replace(given, r"^\s+|\s+$|_", "")  # underscores group digits

    def read(parts: Column) -> Column:
        whole, power = parts[1], parts[3]
        written = F.concat(whole, parts[2])
        small = F.when(power == "", F.lit(0)).otherwise(F.ltrim(power, F.lit("+")).try_cast("int"))
        split = F.struct(
            F.length(whole).alias("whole"), written.alias("written"), F.ltrim(written, F.lit("0")).alias("lead"),
            small.alias("power"), parts[0].alias("sign"),
        )
        return let(split, number)

    def number(n: Column) -> Column:
        exponent = n["whole"] - F.length(n["written"]) + F.length(n["lead"]) + n["power"]
        return F.when(
            (n["written"] != "") & n["power"].isNotNull(),
            F.struct(
                F.when(n["lead"] == "", F.lit(ZERO_EXPONENT)).otherwise(exponent).alias("exponent"),
                F.rtrim(n["lead"], F.lit("0")).alias("digits"),
                ((n["sign"] == "-") & (n["lead"] != "")).alias("negative"),
            ),
        )

    # The usual spelling is read without regular groups.
    written = F.replace(given, F.lit("."), F.lit(""))
    lead = F.ltrim(written, F.lit("0"))
    plain = F.struct(
        F.when(lead == "", F.lit(ZERO_EXPONENT))
        .otherwise(F.length(F.substring_index(given, ".", 1)) - F.length(written) + F.length(lead))
        .alias("exponent"),
        F.rtrim(lead, F.lit("0")).alias("digits"),
        F.lit(False).alias("negative"),
    )
    parts = F.split(F.regexp_replace(text, NUMBER, "$1|$2|$3|$4"), r"\|")
    return F.when(given.rlike(PLAIN), plain).when(text.rlike(NUMBER), let(parts, read))


def literal(text: str) -> Column:
    return parse(F.lit(text))


def in_unit(number: Column) -> Column:
    """0 <= number <= 1; false for null.  ``number`` is a column or :func:`let`, being named several times."""
    inside = ~number["negative"] & ((number["exponent"] <= 0) | ((number["exponent"] == 1) & (number["digits"] == "1")))
    return F.coalesce(inside, F.lit(False))


def text_of(number: Column) -> Column:
    """A spelling that Spark casts to decimal or double."""
    digits = F.when(number["digits"] == "", F.lit("0")).otherwise(number["digits"])
    power = F.when(number["digits"] == "", F.lit(0)).otherwise(number["exponent"])
    return F.concat(F.lit("0."), digits, F.lit("E"), power.cast("string"))


def double_of(number: Column) -> Column:
    return text_of(number).cast("double")


#: Decimals of the whole numbers in which short numbers are counted, and further digits that tell their quotients apart.
UNIT_PLACES = 18
QUOTIENT_PLACES = 12
#: Divisors up to which they do: quotients that differ, differ by the product of two divisors at least.
MOST_DIVISOR = 10 ** (QUOTIENT_PLACES // 2)


def units_of(number: Column) -> Column:
    """A number in [0, 1] in whole units of ``10**-UNIT_PLACES``; null if it has more decimals, or is no such number."""
    places = number["exponent"] + F.lit(UNIT_PLACES)
    spelt = in_unit(number) & places.between(F.length(number["digits"]), UNIT_PLACES + 1)
    return F.when(in_unit(number) & (number["digits"] == ""), F.lit(0).cast("long")).when(
        spelt, F.rpad(number["digits"], places, F.lit("0")).cast("long")
    )


def quotient_order(units: Column, divisor: Column) -> Column:
    """``units / divisor`` as whole numbers that order like the quotients and are equal exactly if they are.

    ``divisor`` is a long from 1 to MOST_DIVISOR.
    """
    rest = (units % divisor) * F.lit(10**QUOTIENT_PLACES)
    return F.struct(F.call_function("div", units, divisor).alias("whole"), F.call_function("div", rest, divisor).alias("rest"))


#: Doubles read from decimals and their quotients are off by less than this share of their value, above TINY.
SLACK = 1e-14
TINY = 1e-290


def least_of(approximate: Column) -> Column:
    """A lower bound of the number or quotient that a double stands for; grows with the double."""
    return F.when(approximate < TINY, F.lit(0.0)).otherwise(approximate * (1 - SLACK))


def most_of(approximate: Column) -> Column:
    """An upper bound, likewise."""
    return F.when(approximate < TINY, F.lit(2 * TINY)).otherwise(approximate * (1 + SLACK))


def _sign(a: str, a_exponent: int, a_divisor: int, b: str, b_exponent: int, b_divisor: int) -> int:
    """a / a_divisor against b / b_divisor, in whole numbers."""
    if not a or not b:
        return bool(a) - bool(b)
    # Divisors have up to 19 digits, so numbers further apart are not brought together by them.
    if abs(a_exponent - b_exponent) > 40:
        return 1 if a_exponent > b_exponent else -1
    shift = (a_exponent - len(a)) - (b_exponent - len(b))
    left, right = int(a) * b_divisor * 10 ** max(shift, 0), int(b) * a_divisor * 10 ** max(-shift, 0)
    return (left > right) - (left < right)


@pandas_udf(IntegerType())
def _signs(a: pd.DataFrame, a_divisor: pd.Series, b: pd.DataFrame, b_divisor: pd.Series) -> pd.Series:
    rows = zip(a["digits"], a["exponent"], a_divisor, b["digits"], b["exponent"], b_divisor, strict=True)
    return pd.Series([None if r[0] is None or r[3] is None else _sign(r[0], *map(int, r[1:3]), r[3], *map(int, r[4:])) for r in rows], dtype="Int32")


def compare_quotients(a: Column, a_divisor: Column, a_double: Column, b: Column, b_divisor: Column, b_double: Column) -> Column:
    """-1, 0 or 1 as a / a_divisor is less than, equal to or more than b / b_divisor, for numbers not below zero.

    Doubles decide where their bounds lie apart; only the rest is sent to Python's whole numbers.
    """
    x, y = a_double / a_divisor, b_double / b_divisor
    less, more = most_of(x) < least_of(y), least_of(x) > most_of(y)
    digits = _signs(F.when(~less & ~more, a), a_divisor, F.when(~less & ~more, b), b_divisor)
    return F.when(less, F.lit(-1)).when(more, F.lit(1)).otherwise(digits)


def digits_for(longest: int) -> int:
    """Digits of a quotient so that equal keys mean equal quotients, for numerators of ``longest`` digits."""
    return longest + GUARD


def quotient_key(number: Column, divisor: Column, size: int) -> Column:
    """``number / divisor`` as its exponent and first ``size`` digits: texts that order like the quotients.

    ``divisor`` is a positive long.  No digit of the quotient is rounded.  Made in Python, from whole numbers; null for
    a null number.
    """

    def key(digits: str, exponent: int, divisor: int) -> str:
        if not digits:
            return ""
        quotient = str(int(digits) * 10 ** (size + len(str(divisor))) // divisor)
        return f"{(1 << 40) + exponent - len(digits) - size - len(str(divisor)) + len(quotient):013d}{quotient[:size]}"

    @pandas_udf(StringType())
    def keys(number: pd.DataFrame, divisor: pd.Series) -> pd.Series:
        rows = zip(number["digits"], number["exponent"], divisor, strict=True)
        return pd.Series([None if d is None else key(d, int(e), int(by)) for d, e, by in rows], dtype=object)

    return keys(number, divisor)
