"""Small tables for the corpus operators."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

#: Texts that trip careless code: null, empty, no words, ties, repeats, non-ASCII, very long.
ODD_TEXTS = [
    None,
    "",
    " \t\n",
    "one",
    "one two three",
    "one two three",
    "Café déjà vu Ünïcode 漢字 \U0001f600 x\x00y\x1cz",
    "a" * 5000,
    "the cat sat on the mat and then the cat sat on the mat again " * 40,
    "the cat sat on the mat and then the cat sat on the mat again " * 40,
    "word " * 30000,
]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """The odd texts, with a repeated row, a null id, null sources and columns whose names operators also use."""
    rows = [(i, t, "en", "src0" if i % 2 else None, f"n{i}") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[4], (None, "one two three", None, None, None)]
    names = ["doc_id", "text", "lang", "source", "n_words"]
    schema = T.StructType([T.StructField(n, T.LongType() if n == "doc_id" else T.StringType()) for n in names])
    return spark.createDataFrame(rows, schema)
