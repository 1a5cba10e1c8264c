"""Canonical records: stores, the evidence index and imported workflow traces."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from plumbline.functions.ids import LONE, canonical_json, canonical_value, reads_as_json, sha256_digest
from plumbline.session import cut_lineage
from plumbline.skew import spread

# The columns of a task trace, in order.
TRACE_COLUMNS = (
    "task_id", "hash", "native_id", "name", "status", "exit", "submit",
    "duration", "realtime", "%cpu", "peak_rss", "peak_vmem", "rchar", "wchar",
)


def write_records(records: DataFrame, path: str) -> None:
    """Append records (record_type, record_id, body JSON) as canonical lines per type."""
    records.select("record_type", canonical_json(F.col("body")).alias("value")).write.mode("append").partitionBy(
        "record_type"
    ).text(path)


def numbered_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """Lines of text files as ``value``, with ``file``, ``line_number`` in it (from 1) and ``torn``.

    A file is read in splits; a line's number is its place in the split, where rows come in order, after the lines of
    the splits before it, of which one row each is added up.  The last line of a file is torn if no newline ends it,
    which its size tells.  Partition columns are kept.
    """
    read = spark.read.options(**options).text(path, lineSep="\n").select(
        "*",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.col("_metadata.file_size").alias("_size"),
        F.monotonically_increasing_id().alias("_row"),
    )
    read = cut_lineage(read)
    splits = read.groupBy("file", "_split").agg(
        F.count("*").alias("_lines"),
        F.min("_row").alias("_first"),
        F.sum(F.octet_length("value").cast("long") + 1).alias("_bytes"),
        F.first("_size").alias("_size"),
    )
    by_file = Window.partitionBy("file")
    before = by_file.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.select(
        "file",
        "_split",
        "_first",
        F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before"),
        F.sum("_lines").over(by_file).alias("_all"),
        (F.sum("_bytes").over(by_file) > F.col("_size")).alias("_torn"),
    )
    number = F.col("_before") + F.col("_row") - F.col("_first") + 1
    joined = read.drop("_size").join(placed, ["file", "_split"]).withColumn("line_number", number)
    torn = F.col("_torn") & (F.col("line_number") == F.col("_all"))
    return joined.withColumn("torn", torn).drop("_split", "_first", "_before", "_all", "_torn", "_row")


def _stored(text: str | None) -> tuple[str | None, bool, str | None, str | None]:
    """Canonical form, whether it is JSON at all, and the record's type and id where these are plain strings."""
    if text is None:
        return None, False, None, None
    try:
        value, spelt = canonical_value(text)
    except (ValueError, RecursionError):
        return None, reads_as_json(text), None, None
    stated = [value.get(k) if isinstance(value, dict) else None for k in ("record_type", "record_id")]
    # A lone surrogate cannot leave Python as text.
    return spelt, True, *[x if isinstance(x, str) and not LONE.search(x) else None for x in stated]


STORED = T.StructType(
    [
        T.StructField("canonical", T.StringType()),
        T.StructField("sound", T.BooleanType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
    ]
)


@pandas_udf(STORED)
def stored_line(texts: pd.Series) -> pd.DataFrame:
    rows = [_stored(t) for t in texts]
    return pd.DataFrame(rows, columns=STORED.fieldNames())


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Stored lines with file, line number and what is wrong with each.

    ``torn`` (the last line has no newline), ``malformed`` (not UTF-8 or not JSON), ``not_an_object``,
    ``not_canonical`` (not as :func:`write_records` spells it) or ``wrong_type``, the first that holds.  A line is
    parsed once.
    """
    text = F.try_validate_utf8("value")
    lines = numbered_lines(spark, path).withColumn("_text", text).withColumn("_said", stored_line("_text"))

    def stated(name: str) -> Column:
        """What is no plain string is spelt by the variant type."""
        other = F.when(F.col("_said")[name].isNull(), F.col("_said.canonical"))
        return F.coalesce(F.col("_said")[name], F.try_variant_get(F.try_parse_json(other), f"$.{name}", "string"))

    problem = (
        F.when(F.col("torn"), F.lit("torn"))
        .when(~F.col("_said.sound"), F.lit("malformed"))
        .when(~F.ltrim(F.col("_text")).startswith("{"), F.lit("not_an_object"))
        .when(~F.col("_said.canonical").eqNullSafe(F.col("_text")), F.lit("not_canonical"))
        .when(~stated("record_type").eqNullSafe(F.col("record_type")), F.lit("wrong_type"))
    )
    return lines.select(
        "record_type", stated("record_id").alias("record_id"), F.col("value").alias("body"), "file", "line_number", problem.alias("problem")
    )


def _named(value: dict, *keys: str) -> bool:
    for key in keys:
        if not isinstance(value.get(key), str):
            return False
    return True


def _below(value: dict | list, pointer: str) -> Iterator[tuple[dict | list, str]]:
    """The objects and arrays right in a value, with their pointers; nothing else can hold a reference."""
    if isinstance(value, list):
        return ((item, f"{pointer}/{i}") for i, item in enumerate(value) if isinstance(item, (dict, list)))
    return (
        (item, f"{pointer}/{key.replace('~', '~0').replace('/', '~1') if '~' in key or '/' in key else key}")
        for key, item in value.items()
        if isinstance(item, (dict, list))
    )


def _walk(root: dict | list, start: str, edges: list[tuple], spots: list[tuple]) -> None:
    """Outermost references and outermost source references from ``root``; either kind may hold the other."""
    todo = [(root, start, True, True)]
    while todo:
        value, pointer, want_edge, want_spot = todo.pop()
        if isinstance(value, dict):
            if want_edge and _named(value, "record_type", "record_id"):
                edges.append((pointer, value["record_type"], value["record_id"]))
                want_edge = False
            if want_spot and _named(value, "source_kind", "locator"):
                spots.append((pointer, value))
                want_spot = False
        if want_edge or want_spot:
            todo += [(item, at, want_edge, want_spot) for item, at in _below(value, pointer)]


EDGE = {"pointer": "string", "target_type": "string", "target_id": "string"}
PLACE = {
    "pointer": "string", "source_kind": "string", "locator": "string", "path": "string", "digest": "string",
    "start_line": "bigint", "end_line": "bigint",
}
ROWS_AT_ONCE = 2048


def _column(values: list, kind: str) -> pa.Array:
    return pa.array(values, pa.int64() if kind == "bigint" else pa.string())


def _lists(offsets: list[int], rows: list[tuple], fields: dict[str, str]) -> pa.Array:
    """One list of structs for each record, from the rows of all."""
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    made = [_column(list(c), k) for c, k in zip(columns, fields.values(), strict=True)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(made, names=list(fields)))


def _indexed(records: DataFrame) -> DataFrame:
    """(record_type, record_id, body, edges, places): each record with its canonical body and what it refers to.

    A record is parsed once; the table is written once, and all parts of the index read it.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                bodies, edges, spots, ends = [], [], [], [(0, 0)]
                for body in part.column("body").to_pylist():
                    try:
                        content, body = (None, None) if body is None else canonical_value(body)
                    except (ValueError, RecursionError):
                        content, body = None, None
                    for item, at in _below(content, "") if isinstance(content, dict) else ():
                        _walk(item, at, edges, spots)
                    bodies.append(body)
                    ends.append((len(edges), len(spots)))
                places = [
                    (p, v["source_kind"], v["locator"], v.get("path"), v.get("content_digest"), v.get("start_line"), v.get("end_line"))
                    for p, v in spots
                ]
                first, second = ([e[i] for e in ends] for i in range(2))
                columns = [part.column("record_type"), part.column("record_id"), _column(bodies, "string")]
                columns += [_lists(first, edges, EDGE), _lists(second, places, PLACE)]
                yield pa.RecordBatch.from_arrays(columns, names=["record_type", "record_id", "body", "edges", "places"])

    lists = [f"{name} array<struct<{', '.join(f'{c}: {k}' for c, k in fields.items())}>>" for name, fields in (("edges", EDGE), ("places", PLACE))]
    named = spread(records.select("record_type", "record_id", "body"))
    kinds = [f"{c} {named.schema[c].dataType.simpleString()}" for c in ("record_type", "record_id")]
    return cut_lineage(named.mapInArrow(walk, ", ".join([*kinds, "body string", *lists])))


def _edges(indexed: DataFrame) -> DataFrame:
    named = [F.col("record_type").alias("source_type"), F.col("record_id").alias("source_id")]
    return indexed.select(*named, F.inline("edges"))


def _places(indexed: DataFrame) -> DataFrame:
    return indexed.select(F.col("record_type").alias("source_type"), F.col("record_id").alias("source_id"), F.inline("places"))


def evidence_index(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, edges, source locations) of nested records.

    Every typed reference inside a record becomes an edge at its JSON pointer, and every source
    reference a location.  Records are walked in Arrow batches, one record at a time.
    """
    indexed = _indexed(records)
    base = indexed.select("record_type", "record_id", "body", sha256_digest(F.col("body")).alias("digest"))
    return base.distinct(), _edges(indexed).distinct(), _places(indexed)


def table_differences(stored: DataFrame, rebuilt: DataFrame, *, once: bool = False) -> DataFrame:
    """Rows that two tables hold in different numbers, with ``n_stored`` and ``n_rebuilt``.

    Both tables are counted in one shuffle, repeated rows before it.  With ``once`` a rebuilt row counts once however
    often it comes.
    """
    columns = rebuilt.columns
    both = stored.select(*columns, F.lit(1).alias("_s"), F.lit(0).alias("_r")).unionByName(
        rebuilt.select(*columns, F.lit(0).alias("_s"), F.lit(1).alias("_r"))
    )
    again = F.max("_r").cast("long") if once else F.sum("_r")
    counted = both.groupBy(*columns).agg(F.sum("_s").alias("n_stored"), again.alias("n_rebuilt"))
    return counted.where("n_stored <> n_rebuilt")


def verify_index(records: DataFrame, base: DataFrame, edges: DataFrame, places: DataFrame) -> DataFrame:
    """What a stored evidence index (as :func:`evidence_index` returns it) says otherwise than its records.

    One row per differing row of the index: ``part`` (record, edge or location), record, pointer and ``problem``:
    ``missing`` from the index, ``not_in_records`` any more, or ``repeated`` another number of times.
    """
    indexed = _indexed(records)
    digests = indexed.select("record_type", "record_id", sha256_digest(F.col("body")).alias("digest"))
    again = digests, _edges(indexed), _places(indexed)
    parts = []
    for part, stored, rebuilt in zip(("record", "edge", "location"), (base, edges, places), again):
        stated = ["record_type", "record_id"] if part == "record" else ["source_type", "source_id"]
        if part == "record":  # bodies are compared by their digests
            stored = stored.select(*stated, "digest")
        found = table_differences(stored, rebuilt, once=part != "location")
        problem = (
            F.when(F.col("n_stored") == 0, F.lit("missing"))
            .when(F.col("n_rebuilt") == 0, F.lit("not_in_records"))
            .otherwise(F.lit("repeated"))
        )
        pointer = F.lit(None).cast("string") if part == "record" else F.col("pointer")
        parts.append(
            found.select(
                F.lit(part).alias("part"), F.col(stated[0]).alias("record_type"), F.col(stated[1]).alias("record_id"),
                pointer.alias("pointer"), problem.alias("problem"), "n_stored", "n_rebuilt",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def workflow_trace(lines: DataFrame) -> DataFrame:
    """Trace lines with the reason a line is not imported; null for consistent terminal rows.

    ``lines``: trace_id, line_number, line (the header line excluded).
    """
    cells = F.split("line", "\t")
    cell = lambda name: F.get(cells, F.lit(TRACE_COLUMNS.index(name)))
    code = F.when(F.trim(cell("exit")).rlike(r"^[+-]?\d+(_\d+)*$"), F.replace(F.trim(cell("exit")), F.lit("_"), F.lit(""))).try_cast("long")
    consistent = ((cell("status") == "COMPLETED") & (code == 0)) | ((cell("status") == "FAILED") & (code != 0))
    reason = (
        F.when(F.size(cells) != len(TRACE_COLUMNS), F.lit("wrong_width"))
        .when((cell("task_id") == "") | (cell("hash") == "") | (cell("name") == ""), F.lit("missing_identity"))
        .when(code.isNull(), F.lit("exit_not_integer"))
        .when(~consistent, F.lit("inconsistent_status"))
    )
    imported = reason.isNull()
    return lines.select(
        "trace_id",
        "line_number",
        *[F.when(imported, cell(c)).alias(c.strip("%")) for c in ("task_id", "hash", "name", "status")],
        F.when(imported, code).alias("exit"),
        reason.alias("opaque_reason"),
    )
