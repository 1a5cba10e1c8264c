"""Delimited tables: strict reading, header inventory, column profiles."""

from __future__ import annotations

import csv
import gzip
import io
import re
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import cut_lineage
from plumbline.skew import attach, running, with_blocks
from plumbline.sources.records import numbered_lines

# Table suffixes with their separator, and the widest header that is listed.
SEPARATORS = {".csv": ",", ".tsv": "\t", ".csv.gz": ",", ".tsv.gz": "\t"}
MAX_HEADER_COLUMNS = 1024
BAD = "_bad"
# Number spellings Python's int() and float() accept.
_DIGITS = r"\d+(?:_\d+)*"
INTEGER_TEXT = rf"^\s*[+-]?{_DIGITS}\s*$"
NUMBER_TEXT = rf"(?i)^\s*[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf(?:inity)?|nan)\s*$"


def separator_of(path: str) -> str | None:
    low = path.lower()
    for suffix in sorted(SEPARATORS, key=len, reverse=True):
        if low.endswith(suffix):
            return SEPARATORS[suffix]
    return None


def read_delimited(
    spark: SparkSession, path: str, columns: Sequence[str], sep: str | None = None, *, multi_line: bool = True,
    header: bool = True,
) -> DataFrame:
    """All cells as strings (empty cells stay empty strings) plus ``_bad``, true for a row that
    is ragged or not UTF-8, and the folder's partition columns.  Feed ``_bad`` to the family gate: one bad row fails its table.

    ``multi_line=False`` lets Spark split large plain files when no cell holds a line break.
    """
    sep = sep or separator_of(path) or ","
    raw = [T.StructField(c, T.StringType()) for c in columns] + [T.StructField("_corrupt", T.StringType())]
    df = (
        spark.read.schema(T.StructType(raw))
        .option("header", header)
        .option("enforceSchema", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .csv(path)
    )
    broken = F.lit(False)
    for c in columns:
        broken = broken | F.coalesce(F.contains(F.col(c), F.lit("�")), F.lit(False))
    partitions = [c for c in df.columns if c not in columns and c != "_corrupt"]
    return df.select(
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns],
        *partitions,
        (F.col("_corrupt").isNotNull() | broken).alias(BAD),
    )


def _unreadable_archives(spark: SparkSession, path: str) -> DataFrame:
    """``file`` of gzip files that do not decompress to their end; each is read in pieces, whatever it holds."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True).load(path)

    def bad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    with gzip.GzipFile(fileobj=io.BytesIO(content.as_py())) as stream:
                        while stream.read(1 << 20):
                            pass
                except (OSError, EOFError, zlib.error):
                    yield pa.RecordBatch.from_pydict({"file": [file]})

    return found.select("path", "content").mapInArrow(bad, "file string")


def _records(lines: DataFrame, lines_per_block: int) -> tuple[DataFrame, DataFrame]:
    """(records, unclosed): lines joined where a quoted cell holds their break, and files whose last quote stays open.

    A line begins a record if the quotes before it are even.  Quotes are added up over a file in blocks of lines, so a
    file of any size is read by many tasks; files in which every line has its quotes closed are not scanned at all.
    """
    quotes = F.size(F.split("value", '"')) - 1
    counted = lines.withColumn("_quotes", quotes.cast("long"))
    by_file = counted.groupBy("file").agg(F.sum("_quotes").alias("all"), F.bool_or(F.col("_quotes") % 2 == 1).alias("broken"))
    by_file = cut_lineage(by_file)
    whole = lines.join(by_file.where("broken"), "file", "left_anti").withColumnRenamed("line_number", "record")
    some = counted.join(by_file.where("broken AND all % 2 = 0"), "file", "left_semi")
    blocked, blocks = with_blocks(some, "line_number", lines_per_block, ["file"])
    before = running(blocked, blocks, ["file"], [F.col("line_number")], F.col("_quotes"), "sum", "_before", inclusive=False)
    starts = before.withColumn("_start", F.when(F.coalesce("_before", F.lit(0)) % 2 == 0, F.col("line_number")))
    placed = running(starts, blocks, ["file"], [F.col("line_number")], F.col("_start"), "max", "record")
    part = F.sort_array(F.collect_list(F.struct("line_number", "value")))
    joined = placed.groupBy("file", "record").agg(
        F.array_join(F.transform(part, lambda x: x["value"]), "\n").alias("value"), F.bool_and("valid").alias("valid")
    )
    return whole.select("file", "record", "value", "valid").unionByName(joined), by_file.where("all % 2 = 1").select("file")


def read_tables(
    spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",", *, lines_per_block: int = 2_000_000
) -> tuple[DataFrame, DataFrame]:
    """(files, rows) of all tables below ``path``, each bound by its own header.

    ``files``: file, status (``read``, or why no row of it is used: ``invalid_compression``, ``unclosed_quote``,
    ``header_unavailable``, ``header_duplicated``, ``columns_missing``), header, n_rows, n_bad.
    ``rows``: file, record (line it begins on), the wanted ``columns`` by name, and ``_bad`` where a row is not as wide
    as its header, has a quote inside a bare cell, or is not UTF-8.  One bad file leaves the others alone.
    """
    lines = numbered_lines(spark, path, ignoreCorruptFiles="true", recursiveFileLookup="true").select(
        "file",
        "line_number",
        F.regexp_replace(F.make_valid_utf8("value"), "\r$", "").alias("value"),
        F.is_valid_utf8("value").alias("valid"),
    )
    archives = cut_lineage(_unreadable_archives(spark, path))
    lines = cut_lineage(lines.join(archives, "file", "left_anti"))
    records, unclosed = _records(lines, lines_per_block)
    text, quoted = F.when(F.col("valid"), F.col("value")), re.escape(sep)
    raw = F.regexp_extract_all(F.concat(F.lit(sep), text), F.lit(f'{quoted}("(?:[^"]++|"")*+"|[^"{quoted}]*+)'), 1)
    read = F.aggregate("_raw", F.lit(0), lambda n, cell: n + F.length(cell) + 1) == F.length(text) + 1
    plain = F.transform("_raw", lambda c: F.when(c.startswith('"'), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    parsed = records.withColumn("_raw", raw).select("file", "record", F.when(F.coalesce(read, F.lit(False)), plain).alias("cells"))
    parsed = cut_lineage(parsed.join(unclosed, "file", "left_anti"))
    header = parsed.where("record = 1").select("file", F.col("cells").alias("header"))
    sizes = parsed.groupBy("file").agg(F.count("*").alias("n"))
    wanted = F.array(*[F.lit(c) for c in columns])
    status = (
        F.when(F.col("header").isNull() | F.exists("header", lambda h: h == ""), F.lit("header_unavailable"))
        .when(F.size(F.array_distinct("header")) < F.size("header"), F.lit("header_duplicated"))
        .when(F.size(F.array_except(wanted, F.col("header"))) > 0, F.lit("columns_missing"))
        .otherwise(F.lit("read"))
    )
    heads = cut_lineage(sizes.join(header, "file", "left").withColumn("status", status))
    bound = attach(parsed.where("record > 1"), heads.select("file", "header", "status", "n"), ["file"], "n").where("status = 'read'")
    at = {c: F.try_element_at("cells", F.array_position("header", c).cast("int")) for c in columns}
    bad = F.col("cells").isNull() | (F.size("cells") != F.size("header"))
    rows = bound.select("file", "record", *[F.coalesce(v, F.lit("")).alias(c) for c, v in at.items()], bad.alias(BAD))
    counts = rows.groupBy("file").agg(F.count("*").alias("n_rows"), F.count_if(BAD).alias("n_bad"))
    known = heads.select("file", "status", "header").join(counts, "file", "left").fillna(0, ["n_rows", "n_bad"])

    def refused(frame: DataFrame, why: str) -> DataFrame:
        nothing = F.lit(0).cast("long")
        return frame.select("file", F.lit(why).alias("status"), F.lit(None).cast("array<string>").alias("header"), nothing.alias("n_rows"), nothing.alias("n_bad"))

    return known.unionByName(refused(archives, "invalid_compression")).unionByName(refused(unclosed, "unclosed_quote")), rows


def _first_record(path: str) -> tuple[list[str], str]:
    local = path.removeprefix("file:")
    low = local.lower()
    opener = gzip.open if low.endswith(".gz") else open
    try:
        with opener(local, "rb") as handle:
            stream = io.TextIOWrapper(handle, encoding="utf-8", errors="strict", newline="")
            return next(csv.reader(stream, delimiter=separator_of(low) or ",", strict=True), []), "read"
    except (OSError, EOFError, UnicodeDecodeError, csv.Error):
        return [], "unreadable"


def header_inventory(files: DataFrame) -> DataFrame:
    """Header of each table file, read on the executors and only as far as its first record.

    ``files``: path (openable by every executor), digest, declared_digest, artifacts (how many
    records claim the path), is_produced, is_consumed.  Files without a matching digest or
    claimed twice are skipped.
    """
    usable = (F.col("digest") == F.col("declared_digest")) & (F.col("artifacts") <= 1)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            heads = [_first_record(p) for p in batch["path"]]
            yield pd.DataFrame(
                {"path": batch["path"], "names": [h[0] for h in heads], "_read": [h[1] for h in heads]}
            )

    heads = files.where(usable).select("path").mapInPandas(read, "path string, names array<string>, _read string")
    opaque = (
        (F.col("_read") == "unreadable")
        | F.exists("names", lambda n: n == "")
        | (F.size(F.array_distinct("names")) < F.size("names"))
    )
    status = (
        F.when((F.col("_read") == "read") & (F.size("names") == 0), F.lit("unavailable"))
        .when(opaque, F.lit("opaque"))
        .otherwise(F.lit("partial"))
    )
    role = (
        F.when(F.col("is_produced") & F.col("is_consumed"), F.lit("intermediate"))
        .when(F.col("is_produced"), F.lit("output"))
        .when(F.col("is_consumed"), F.lit("input"))
        .otherwise(F.lit("unknown"))
    )
    low = F.lower("path")
    listed = (status == "partial") & (F.size("names") <= MAX_HEADER_COLUMNS)
    return heads.join(files.select("path", "is_produced", "is_consumed"), "path").select(
        "path",
        F.when(low.rlike(r"\.tsv(\.gz)?$"), F.lit("tsv")).otherwise(F.lit("csv")).alias("format"),
        F.when(low.endswith(".gz"), F.lit("gzip")).otherwise(F.lit("plain")).alias("encoding"),
        status.alias("structure_status"),
        role.alias("data_role"),
        F.size("names").alias("n_columns"),
        F.when(listed, F.col("names")).otherwise(F.array().cast("array<string>")).alias("variables"),
    )


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Inferred type and number of distinct levels per column (an empty cell is a level).

    Cells are counted per distinct value first, so each spelling is tested once and a column
    of any size needs two partial aggregations.
    """
    cells = ", ".join(f"'{c}', coalesce(cast(`{c}` as string), '')" for c in columns)
    values = (
        df.select(F.expr(f"stack({len(columns)}, {cells}) as (column_name, cell)"))
        .groupBy("column_name", "cell")
        .agg(F.count("*").alias("n"))
    )
    filled = F.col("cell") != ""

    def all_filled(test) -> F.Column:
        return F.every(F.when(filled, test).otherwise(F.lit(True)))

    return values.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        F.count("*").alias("levels"),
        F.when(F.count_if(filled) == 0, F.lit("unknown"))
        .when(all_filled(F.lower("cell").isin("true", "false")), F.lit("boolean"))
        .when(all_filled(F.col("cell").rlike(INTEGER_TEXT)), F.lit("integer"))
        .when(all_filled(F.col("cell").rlike(NUMBER_TEXT)), F.lit("number"))
        .otherwise(F.lit("string"))
        .alias("storage_type"),
    )
