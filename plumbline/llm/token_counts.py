"""Token totals maintained from signed deltas.

A batch of changes is reduced to one signed row per key and committed under its id.  Totals are the sum of the
committed deltas, so no document is counted again, and a batch committed twice, by a retry or by two drivers at once,
counts once.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.rows import annotate

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens")
INSERT, DELETE, REVISE = "insert", "delete", "revise"


def count_tokens(documents: DataFrame, tokenizers: Mapping[str, str], pattern: str, *, text: str = "text") -> DataFrame:
    """Add a long column for each tokenizer with the tokens of the whole text; null and empty texts have none.

    ``tokenizers`` maps a version's name to its file of ranks, readable on every executor.  Special tokens in a text
    are ordinary text.  Columns named like a version are replaced.
    """
    import tiktoken

    def make() -> Callable:
        codes = []
        for name, path in tokenizers.items():
            with open(path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            codes.append(tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
        return lambda column: [[len(c.encode_ordinary(t)) if t else 0 for t in column.to_pylist()] for c in codes]

    fields = T.StructType([T.StructField(n, T.LongType(), False) for n in tokenizers])
    return annotate(documents, [text], make, fields)


def signed(changes: DataFrame) -> DataFrame:
    """One row per key with the signed sums of ``changes``: kind, the keys, tokens, and old_tokens of a revision.

    An insert adds a document and its tokens, a delete takes both away, a revision adds the difference of its counts.
    Null keys are keys of their own, null counts are 0, and rows of any other kind change nothing.
    """
    tokens, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    sign = F.when(F.col("kind") == INSERT, 1).when(F.col("kind") == DELETE, -1)
    documents = F.coalesce(sign, F.lit(0)).cast("long")
    difference = F.when(F.col("kind") == REVISE, tokens - old).otherwise(documents * tokens)
    return changes.groupBy(*KEYS).agg(F.sum(documents).alias("n_docs"), F.sum(difference).cast("long").alias("n_tokens"))


class Ledger:
    """Committed deltas under one folder that every executor reaches.

    A commit writes its delta under an attempt of its own and then one row that names the attempt; only that row makes
    the delta count.  A driver or executor lost before it leaves rows that no reader takes; of two attempts at one
    batch the one with the lesser name counts.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.schemas = {
            "deltas": T.StructType(
                [T.StructField(n, T.StringType()) for n in ("batch", "attempt", *KEYS)]
                + [T.StructField(n, T.LongType()) for n in SUMS]
            ),
            "commits": T.StructType([T.StructField(n, T.StringType()) for n in ("batch", "attempt")]),
        }
        for name, schema in self.schemas.items():
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{name}")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Whether this call committed the batch; False if it was committed before, and then nothing is computed."""
        if not self._read("commits").where(F.col("batch") == batch).isEmpty():
            return False
        attempt = uuid.uuid4().hex
        named = {"batch": F.lit(batch), "attempt": F.lit(attempt)}
        delta = signed(changes).withColumns(named)
        delta.select(*self.schemas["deltas"].names).write.mode("append").parquet(f"{self.folder}/deltas")
        row = self.spark.createDataFrame([(batch, attempt)], self.schemas["commits"])
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return True

    def totals(self, keys: Sequence[str] = KEYS) -> DataFrame:
        """The keys and sums over all committed batches; keys whose sums are all 0 are left out."""
        counted = self._read("commits").groupBy("batch").agg(F.min("attempt").alias("attempt"))
        deltas = self._read("deltas").join(counted, ["batch", "attempt"], "left_semi")
        summed = deltas.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in SUMS])
        return summed.where(" OR ".join(f"{n} <> 0" for n in SUMS))
