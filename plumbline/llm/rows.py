"""Row-wise Arrow helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows handed to an operator's function at once: bounds the Python copies of their texts.
ROWS_AT_ONCE = 512
#: Letters A to Z become a to z; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column; null stays None."""
    return column.cast(pa.binary()).to_pylist()


_held: dict[Hashable, Any] = {}


def held(key: Hashable, build: Callable[[], Any]) -> Any:
    """``build()``, kept by the Python worker until a task on it holds something else.

    A worker serves one operator after the other; without this the tables of all would stay in its memory.
    """
    if key not in _held:
        _held.clear()
        pa.default_memory_pool().release_unused()
        _held[key] = build()
    return _held[key]


def annotate(
    df: DataFrame,
    inputs: Sequence[str],
    make: Callable[[], Callable[..., Sequence[list]]],
    fields: T.StructType,
    *,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add columns that depend on a row's own ``inputs`` only; no shuffle.

    ``make`` runs once in each task and returns a function from the input columns (Arrow arrays) to one list per
    new field.  ``keep`` names the columns to carry (default: all).  A carried column with the name of a new field
    is replaced by it.
    """
    names = fields.fieldNames()
    carried = [c for c in (df.columns if keep is None else keep) if c not in names]
    df = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*carried, *inputs])])
    kinds = [to_arrow_type(f.dataType) for f in fields]
    schema = T.StructType([df.schema[c] for c in carried] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                made = work(*[part.column(c) for c in inputs])
                columns = [part.column(c) for c in carried]
                columns += [pa.array(v, type=k) for v, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*carried, *names])

    return df.mapInArrow(run, schema)
