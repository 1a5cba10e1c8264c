"""Deterministic identity: digests, stable ids, canonical JSON and order-free set digests."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

UNIT_SEPARATOR = "\x1f"


def sha256_digest(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix:`` and the first 20 hex digits of the digest of the joined parts."""
    joined = F.concat_ws(UNIT_SEPARATOR, *[p.cast("string") for p in parts])
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(joined, 256), 1, 20))


LONE = re.compile("[\ud800-\udfff]")


class _Repeated(ValueError):
    pass


def _once(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    if len({k for k, _ in pairs}) < len(pairs):
        raise _Repeated
    return dict(pairs)


def _refuse(name: str) -> None:
    raise ValueError(name)


# Made once: json.loads and json.dumps make theirs anew for every text.
_READ = json.JSONDecoder(parse_constant=_refuse).decode
_READ_ONCE = json.JSONDecoder(parse_constant=_refuse, object_pairs_hook=_once).decode
_SPELL = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode


def resolve(value: Any, pointer: str) -> Any:
    """The place a JSON pointer names; LookupError if there is none."""
    for token in pointer.split("/")[1:]:
        key = token.replace("~1", "/").replace("~0", "~")
        if isinstance(value, list):
            if not key.isdecimal() or len(key) > 1 and key[0] == "0":
                raise LookupError(key)
            value = value[int(key)]
        elif isinstance(value, dict):
            value = value[key]
        else:
            raise LookupError(key)
    return value


def canonical_value(text: str) -> tuple[Any, str]:
    """The value of a JSON text and its canonical form; ValueError or RecursionError if it has none.

    A key said twice costs its text a string: if the form is the text itself, or has as many quotes and the text no
    escapes, no key was lost.  Only other texts are read again, with every object's keys counted.
    """
    value = _READ(text)
    spelt = _SPELL(value)
    if spelt != text and ("\\" in text or spelt.count('"') != text.count('"')):
        value = _READ_ONCE(text)
        spelt = _SPELL(value)
    return value, spelt if spelt.isascii() else LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", spelt)


def canonical_text(text: str | None, pointer: str = "") -> str | None:
    """One text's canonical form, or that of the place a pointer names; numbers keep integers and fractions apart.

    A lone surrogate, which no UTF-8 text can hold, stays the escape it was written as, in small letters.
    """
    if text is None:
        return None
    try:
        value, spelt = canonical_value(text)
        if pointer:
            spelt = LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", _SPELL(resolve(value, pointer)))
        return spelt
    except (ValueError, LookupError, RecursionError):
        return None


def canonical_at(text: Column, pointer: str) -> Column:
    """Canonical JSON of a text, or of the place a pointer names; read and spelt once, in Arrow batches."""

    @pandas_udf(StringType())
    def spell(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: canonical_text(t, pointer), na_action="ignore")

    return spell(text)


def canonical_json(text: Column) -> Column:
    """Keys sorted by code point, no spaces, only the escapes that must be, 1 and 1.0 apart.

    Null where the text is not exactly one JSON value, repeats a key, nests deeper than Python reads, or has an integer
    of more than 4,300 digits or a number beyond the doubles.
    """
    return canonical_at(text, "")


def reads_as_json(text: str) -> bool:
    """Exactly one JSON value, repeated keys included."""
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def semantic_digest(text: Column) -> Column:
    return sha256_digest(canonical_json(text))


def ordinal_token(domain: str, ordinal: Column) -> Column:
    return stable_id(domain, F.lit("ordinal"), ordinal)


def value_token(domain: str, names: Sequence[str]) -> Column:
    """Token of (columns, values); the same values always give the same token."""
    parts: list[Column] = []
    for name in sorted(names):
        parts += [F.lit(name), F.col(name)]
    return stable_id(domain, *parts)


def set_digest(value: Column) -> Column:
    """Aggregate: digest of a multiset of strings that ignores order and needs O(1) state.

    Each member's digest is cut in four 60-bit numbers that are summed exactly, so partial
    aggregation works and no list of members is ever built.
    """
    digest = F.sha2(value.cast("string"), 256)
    sums = [
        F.coalesce(
            F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(19,0)")),
            F.lit(0).cast("decimal(29,0)"),
        ).cast("string")
        for i in range(4)
    ]
    return sha256_digest(F.concat_ws(":", F.count(value).cast("string"), *sums))
