"""Queries for sources, stores, imports, streams and composed audits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import ids, text, values
from plumbline.operators import design, linking
from plumbline.operators.validate import family_gate
from plumbline.outcomes import as_observations, route
from plumbline.plans.links import RESULTS, claims, results
from plumbline.plans.registry import CheckRegistry, Tables, query
from plumbline.plans.statistics import CONTRACT, HOSTILE, REPORTED, reported
from plumbline.plans.texts import CLAIMS
from plumbline.operators import multiplicity
from plumbline.session import cut_lineage, shared_folder
from plumbline.skew import running, spread, with_blocks
from plumbline.sources import delimited, files, matrices, records
from plumbline.streaming import records as record_stream
from plumbline.streaming.segments import stream_segment_time


def scratch(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "read_delimited",
    """SELECT o_orderkey % 5 AS t, count(*) AS n_rows, CASE WHEN o_orderkey % 5 = 3 THEN 'ragged or undecodable row' END AS reason,
    CASE WHEN o_orderkey % 5 = 3 THEN 'unsupported' ELSE 'applicable' END AS applicability FROM orders GROUP BY ALL""",
)
def read_delimited(t: Tables) -> DataFrame:
    folder = scratch(t, "delimited")
    extra = F.when(F.col("o_orderkey") % 500 == 3, F.lit(",extra")).otherwise(F.lit(""))
    line = F.concat(F.concat_ws(",", "o_orderkey", F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"')), "o_totalprice"), extra)
    t.orders.select((F.col("o_orderkey") % 5).alias("t"), line.alias("value")).write.partitionBy("t").text(folder)
    rows = delimited.read_delimited(t.spark, folder, ["id", "priority", "price"], ",", multi_line=False, header=False)
    reasons = F.when(F.col("_bad"), F.array(F.lit("ragged or undecodable row"))).otherwise(F.array().cast("array<string>"))
    gate = family_gate(rows.withColumn("reasons", reasons), ["t"], ["id"])
    return gate.select(F.col("t").cast("long").alias("t"), "n_rows", "reason", "applicability")


@query(
    "read_tables",
    """WITH o AS (SELECT o_orderkey % 8 AS t, o_orderkey, o_orderpriority, o_orderkey % 8 = 4 AND o_orderkey % 3 = 0 AS bad FROM orders),
    g AS (SELECT t, count(*) AS n, count(*) FILTER (WHERE bad) AS n_bad, sum(o_orderkey) FILTER (WHERE NOT bad) AS ids, sum(length(o_orderpriority)) FILTER (WHERE NOT bad) AS letters FROM o GROUP BY t)
    SELECT t, CASE t WHEN 2 THEN 'columns_missing' WHEN 3 THEN 'header_duplicated' WHEN 6 THEN 'invalid_compression' WHEN 7 THEN 'unclosed_quote' ELSE 'read' END AS status,
      CASE WHEN t IN (2, 3, 6, 7) THEN 0 ELSE n END::BIGINT AS n_rows, n_bad, CASE WHEN t NOT IN (2, 3, 6, 7) THEN ids END::BIGINT AS ids,
      CASE WHEN t NOT IN (2, 3, 6, 7) THEN letters + CASE t WHEN 1 THEN 2 * n ELSE 0 END END::BIGINT AS letters FROM g""",
)
def read_tables(t: Tables) -> DataFrame:
    """Eight tables: plain; other column order with line breaks and quotes inside cells; a column short; a column twice;
    ragged rows; gzip; not gzip under its name; a quote that stays open."""
    folder, n = scratch(t, "tables"), F.col("o_orderkey") % 8
    cell = F.concat(F.lit('"'), F.col("o_orderpriority"), F.when(n == 1, F.lit('""\n')).otherwise(F.lit("")), F.when(n == 7, F.lit("")).otherwise(F.lit('"')))
    first = t.orders.where("o_orderkey % 8 = 7").agg(F.min("o_orderkey")).head()[0]
    line = (
        F.when(n == 1, F.concat_ws(",", cell, F.lit(""), "o_orderkey"))
        .when(n == 4, F.concat_ws(",", "o_orderkey", cell, F.when(F.col("o_orderkey") % 3 == 0, F.lit("x,y")).otherwise(F.lit("x"))))
        .when(n == 7, F.concat_ws(",", "o_orderkey", F.when(F.col("o_orderkey") == F.lit(first), cell).otherwise(F.lit("p")), F.lit("x")))
        .otherwise(F.concat_ws(",", "o_orderkey", cell, F.lit("x")))
    )
    body = t.orders.select(n.alias("t"), F.lit(1).alias("place"), line.alias("value"))
    names = F.when(F.col("t") == 1, "priority,note,id").when(F.col("t") == 2, "id,note,other").when(F.col("t") == 3, "id,id,priority").otherwise("id,priority,note")
    head = body.select("t").distinct().select("t", F.lit(0).alias("place"), names.alias("value"))
    table = cut_lineage(body.unionByName(head).repartition("t").sortWithinPartitions("t", "place"))
    for packed in (False, True):
        rows = table.where((F.col("t") == 5) == packed).repartition("t").sortWithinPartitions("t", "place").drop("place")
        rows.write.mode("append").option("compression", "gzip" if packed else "none").partitionBy("t").text(folder)
    context = t.spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(context._jsc.hadoopConfiguration())
    for found in store.globStatus(path(f"{folder}/t=6/part*")):
        store.rename(found.getPath(), path(f"{folder}/t=6/part.txt.gz"))
    found, rows = delimited.read_tables(t.spark, folder, ["id", "priority"])
    good = rows.where("NOT _bad").groupBy("file").agg(F.sum(F.col("id").cast("long")).alias("ids"), F.sum(F.length("priority").cast("long")).alias("letters"))
    of = F.regexp_extract("file", "/t=(\\d)/", 1).cast("long")
    return found.join(good, "file", "left").select(of.alias("t"), "status", "n_rows", "n_bad", "ids", "letters")


def table_files(t: Tables) -> DataFrame:
    """The orders of each status written as one headed table file per status."""
    folder = scratch(t, "tables")
    rows = t.orders.select(F.col("o_orderstatus").alias("t"), "o_orderkey", "o_custkey", "o_totalprice").repartition("t")
    rows.write.partitionBy("t").option("header", True).option("compression", "none").csv(folder)
    listed = files.list_files(t.spark, folder, "*.csv").where("size > 0")
    return listed.withColumn("status", F.regexp_extract("path", "/t=([A-Z])/", 1))


@query(
    "header_inventory",
    """SELECT o_orderstatus AS status, 'csv' AS format, 'plain' AS encoding, 'partial' AS structure_status,
    CASE o_orderstatus WHEN 'F' THEN 'intermediate' WHEN 'O' THEN 'output' ELSE 'input' END AS data_role, 3 AS n_columns,
    'o_orderkey,o_custkey,o_totalprice' AS variables FROM orders GROUP BY ALL""",
)
def header_inventory(t: Tables) -> DataFrame:
    listed = table_files(t).select(
        "path", "status", F.lit("d").alias("digest"), F.lit("d").alias("declared_digest"), F.lit(1).alias("artifacts"),
        F.col("status").isin("F", "O").alias("is_produced"), F.col("status").isin("F", "P").alias("is_consumed"),
    )
    found = delimited.header_inventory(listed)
    return found.select(
        F.regexp_extract("path", "/t=([A-Z])/", 1).alias("status"), "format", "encoding", "structure_status", "data_role",
        "n_columns", F.array_join("variables", ",").alias("variables"),
    )


@query("asset_inventory")
def asset_inventory(t: Tables) -> DataFrame:
    listed = table_files(t).select(
        (F.ascii("status") % 2).cast("string").alias("snapshot"), "path",
        F.concat(F.lit("data/"), "status", F.lit(".csv")).alias("relative"), "size",
        (F.col("status") == "F").alias("material"), F.lit(False).alias("preferred"),
    )
    budget = files.Budget(full=200_000, sampled=20_000)
    return files.asset_inventory(listed, budget).select("snapshot", "relative", "size", "role", "tier", "digest", "bytes_read")


PROFILED = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "flag", "blank", "mixed"]


@query(
    "column_profile",
    """WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, CAST(o_totalprice AS VARCHAR) AS o_totalprice, o_orderpriority,
      CASE WHEN o_orderkey % 2 = 0 THEN 'TRUE' ELSE 'false' END AS flag, '' AS blank, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE '1_0' || (o_orderkey % 3) END AS mixed FROM orders),
    u AS (UNPIVOT r ON COLUMNS(*) INTO NAME column_name VALUE cell)
    SELECT column_name, count(*) AS n_rows, count(DISTINCT cell) AS levels, CASE column_name WHEN 'o_orderkey' THEN 'integer' WHEN 'o_totalprice' THEN 'number'
      WHEN 'flag' THEN 'boolean' WHEN 'blank' THEN 'unknown' WHEN 'mixed' THEN 'integer' ELSE 'string' END AS storage_type FROM u GROUP BY column_name""",
)
def column_profile(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t.orders.select(
        "*", F.when(k % 2 == 0, F.lit("TRUE")).otherwise(F.lit("false")).alias("flag"), F.lit("").alias("blank"),
        F.when(k % 9 != 0, F.concat(F.lit("1_0"), (k % 3).cast("string"))).alias("mixed"),
    )
    return delimited.column_profile(rows, PROFILED)


def manifest_lines(t: Tables) -> DataFrame:
    body = F.concat(F.sha2("text", 256), F.lit("  docs/"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit(".txt"))
    line = (
        F.when(F.col("doc_id") % 10 == 7, F.lit("# note"))
        .when(F.col("doc_id") % 211 == 0, F.concat(F.lit("bad "), body))
        .when(F.col("doc_id") % 307 == 5, F.concat(F.sha2("text", 256), F.lit("  ../up.txt")))
        .otherwise(body)
    )
    return t.documents.select(F.concat("source", F.lit(".sha256")).alias("manifest_path"), F.col("doc_id").alias("line_number"), line.alias("line"))


@query(
    "checksum_manifest",
    """WITH l AS (SELECT source || '.sha256' AS manifest_path, doc_id AS line_number, doc_id % 10 = 7 AS note, doc_id % 10 <> 7 AND (doc_id % 211 = 0 OR doc_id % 307 = 5) AS bad,
      'docs/' || (doc_id // 2) || '.txt' AS target_path, 'sha256:' || sha256(text) AS digest FROM documents),
    ok AS (SELECT manifest_path FROM l GROUP BY ALL HAVING NOT bool_or(bad)),
    s AS (SELECT * FROM l JOIN ok USING (manifest_path) WHERE NOT note)
    SELECT target_path, any_value(digest) AS digest, any_value(manifest_path) AS manifest_path, any_value(line_number) AS line_number FROM s GROUP BY target_path HAVING count(*) = 1""",
)
def checksum_manifest(t: Tables) -> DataFrame:
    return files.checksum_manifest(manifest_lines(t))[0]


@query(
    "manifest_verify",
    """WITH d AS (SELECT lang, doc_id % 100 AS k FROM documents)
    SELECT lang, count(*) FILTER (WHERE k = 1) AS missing, count(*) FILTER (WHERE k = 2) AS unexpected, count(*) FILTER (WHERE k = 3) AS drifted,
      lang <> 'fr' AS list_intact, count(*) FILTER (WHERE k IN (1,2,3)) = 0 AND lang <> 'fr' AS verified FROM d GROUP BY lang""",
)
def manifest_verify(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 100
    base = t.documents.select(
        "lang", "doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), ids.sha256_digest(F.col("text")).alias("digest"), F.col("n_chars").alias("size")
    )
    entries, roots = files.manifest(base.where(k != 2), "lang")
    roots = roots.withColumn("root_digest", F.when(F.col("lang") == "fr", F.lit("sha256:0")).otherwise(F.col("root_digest")))
    actual = base.where(k != 1).withColumn("digest", F.when(k == 3, F.lit("sha256:1")).otherwise(F.col("digest")))
    return files.manifest_verify(entries, roots, actual, "lang")


@query(
    "matrix_profile",
    """WITH c AS (SELECT user_id % 10 AS matrix_id, user_id // 10 AS o, ascii(event_type) AS v, count(*) AS n FROM events GROUP BY ALL),
    x AS (SELECT matrix_id, o, v, CASE WHEN matrix_id = 3 THEN n + 0.5 WHEN matrix_id = 4 THEN -n ELSE n END AS value FROM c
      UNION ALL SELECT matrix_id, o, v, n FROM c WHERE matrix_id = 5),
    g AS (SELECT matrix_id, o, v, count(*) AS k, sum(value) AS s FROM x GROUP BY ALL)
    SELECT matrix_id, max(o) + 1 AS n_obs, CAST(CASE WHEN matrix_id = 6 THEN 110 ELSE 128 END AS INTEGER) AS n_vars, CAST(sum(k) AS BIGINT) AS stored, count(*) FILTER (WHERE k > 1) AS duplicate_cells,
      CAST(sum(s) AS DOUBLE) AS total, matrix_id <> 4 AS nonnegative, matrix_id <> 3 AS integer_valued, matrix_id <> 6 AS inside_axes FROM g GROUP BY matrix_id""",
)
def matrix_profile(t: Tables) -> DataFrame:
    m = F.col("matrix_id")
    cells = t.events.groupBy(
        (F.col("user_id") % 10).alias("matrix_id"), F.floor(F.col("user_id") / 10).alias("obs_idx"), F.ascii("event_type").alias("var_idx")
    ).agg(F.count("*").cast("double").alias("n"))
    n = F.col("n")
    value = F.when(m == 3, n + 0.5).when(m == 4, -n).otherwise(n)
    stored = cells.withColumn("value", value).drop("n").unionByName(cells.where(m == 5).withColumnRenamed("n", "value"))
    shapes = cells.groupBy("matrix_id").agg((F.max("obs_idx") + 1).alias("n_obs")).withColumn("n_vars", F.when(m == 6, 110).otherwise(128))
    return matrices.matrix_profile(stored, shapes)


@query(
    "axis_decode",
    """WITH c AS (SELECT l_suppkey % 20 AS axis, l_linenumber - 1 AS code, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT axis, CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (WHERE code = 6 AND axis % 4 = 0), 0) AS BIGINT) AS illegal_codes, false AS values_unique, axis % 5 = 0 AS duplicate_categories FROM c GROUP BY axis""",
)
def axis_decode(t: Tables) -> DataFrame:
    codes = t.lineitem.select(
        (F.col("l_suppkey") % 20).alias("axis"), F.col("l_orderkey").alias("idx"), (F.col("l_linenumber") - 1).alias("code")
    )
    seven = F.explode(F.sequence(F.lit(0), F.lit(6)))
    categories = codes.select("axis").distinct().select("axis", seven.alias("code")).where("axis % 4 <> 0 OR code < 6")
    value = F.when((F.col("axis") % 5 == 0) & (F.col("code") == 1), F.lit("level 0")).otherwise(F.concat(F.lit("level "), F.col("code").cast("string")))
    return matrices.axis_decode(codes, categories.withColumn("value", value), ["axis"])[1]


@query(
    "pointer_check",
    """WITH c AS (SELECT user_id % 10 AS m, user_id // 10 AS o, count(*) AS n FROM events GROUP BY ALL)
    SELECT m AS matrix_id, count(*) + 1 AS n_rows, NOT (m = 2 AND bool_or(o = 2)) AS monotone, m <> 7 AND NOT (m = 2 AND bool_or(o = 2)) AS valid FROM c GROUP BY m""",
)
def pointer_check(t: Tables) -> DataFrame:
    m = F.col("matrix_id")
    rows = t.events.groupBy((F.col("user_id") % 10).alias("matrix_id"), F.floor(F.col("user_id") / 10).alias("o")).agg(F.count("*").alias("n"))
    blocked, blocks = with_blocks(rows, "o", 2_000_000)
    upto = running(blocked, blocks, ["matrix_id"], [F.col("o")], F.col("n"), "sum", "upto")
    ends = upto.select("matrix_id", (F.col("o") + 1).alias("pos"), F.col("upto").alias("pointer"))
    starts = rows.select("matrix_id").distinct().select("matrix_id", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("pointer"))
    pointers = ends.unionByName(starts).withColumn("pointer", F.when((m == 2) & (F.col("pos") == 3), 0).otherwise(F.col("pointer")))
    nnz = rows.groupBy("matrix_id").agg(F.sum("n").alias("stored")).withColumn("stored", F.col("stored") + (m == 7).cast("int"))
    return matrices.pointer_check(pointers, nnz)


def order_records(t: Tables) -> DataFrame:
    body = F.concat(
        F.lit('{"source_ref":{"source_kind":"file_span","locator":"o.csv:'), F.col("o_orderkey"), F.lit('","path":"o.csv","start_line":'), F.col("o_orderkey"),
        F.lit('},"record_type":"result","record_id":"o'), F.col("o_orderkey"), F.lit('","refs":[{"note":{"source_kind":"note","locator":"n"},"record_type":"claim","record_id":"c'), F.col("o_custkey"),
        F.lit('"},{"record_type":7,"record_id":"c'), F.col("o_custkey"), F.lit('"},{"record_type":"claim","record_id":"c'), F.col("o_custkey"), F.lit('"}],"a/b":{"record_id":"s'), F.col("o_orderstatus"), F.lit('","record_type":"status"}}'),
    )
    return spread(t.orders).select(F.lit("result").alias("record_type"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("record_id"), body.alias("body"))


def stored_records(t: Tables) -> DataFrame:
    """A store as it was written, with fractions, escapes and floats in its records, and with lines spoilt by hand."""
    store = scratch(t, "records")
    k = F.substring("record_id", 2, 20).cast("long") % 100
    number = F.when(k % 3 == 0, F.lit("1.0")).when(k % 3 == 1, F.lit("0.0000001")).otherwise(F.lit("12345678901234567890"))
    more = F.concat(F.lit('"n":'), number, F.lit(',"s":"\\u001F\\u00e9\\/","'))
    made = order_records(t).withColumn("body", F.regexp_replace("body", '^\\{"', F.concat(F.lit("{"), F.replace(more, F.lit("\\"), F.lit("\\\\")))))
    records.write_records(made.where(~k.isin(1, 2, 4, 5, 6)), store)
    records.write_records(made.where(k == 3).withColumn("record_type", F.lit("claim")), store)
    spoilt = (
        F.when(k == 1, F.concat(F.lit("["), F.col("body"))).when(k == 2, F.concat(F.lit(" "), F.col("body")))
        .when(k == 4, F.concat(F.col("body"), F.lit(" {}"))).when(k == 5, F.lit('["result"]')).otherwise(F.lit('{"a":1,"a":1}'))
    )
    made.where(k.isin(1, 2, 4, 5, 6)).select("record_type", spoilt.alias("value")).write.mode("append").partitionBy("record_type").text(store)
    last = made.agg(F.min_by("body", F.substring("record_id", 2, 20).cast("long")).alias("value"))
    # A line that ends otherwise than in a newline.
    last.select(F.lit("result").alias("record_type"), "value").coalesce(1).write.mode("append").partitionBy("record_type").text(store, lineSep=" ")
    return records.read_records(t.spark, store)


@query(
    "record_store",
    """SELECT 'result' AS record_type, CASE WHEN o_orderkey % 100 NOT IN (1, 4, 5, 6) THEN 'o' || o_orderkey END AS record_id,
      CASE o_orderkey % 100 WHEN 1 THEN 'malformed' WHEN 2 THEN 'not_canonical' WHEN 4 THEN 'malformed' WHEN 5 THEN 'not_an_object' WHEN 6 THEN 'not_canonical' END AS problem FROM orders
    UNION ALL SELECT 'claim', 'o' || o_orderkey, 'wrong_type' FROM orders WHERE o_orderkey % 100 = 3
    UNION ALL SELECT 'result', 'o' || min(o_orderkey), 'torn' FROM orders""",
)
def record_store(t: Tables) -> DataFrame:
    return stored_records(t).select("record_type", "record_id", "problem")


@query(
    "record_lines",
    """SELECT 'result' AS record_type, count(*) + 1 AS n_lines, true AS numbered FROM orders
    UNION ALL SELECT 'claim', count(*), true FROM orders WHERE o_orderkey % 100 = 3 HAVING count(*) > 0""",
)
def record_lines(t: Tables) -> DataFrame:
    """Every file's lines are numbered from 1 to its number of lines."""
    n = F.col("line_number")
    by_file = stored_records(t).groupBy("record_type", "file").agg(
        F.count("*").alias("lines"), ((F.min(n) == 1) & (F.max(n) == F.count("*")) & (F.sum(n) * 2 == F.count("*") * (F.count("*") + 1))).alias("ok")
    )
    return by_file.groupBy("record_type").agg(F.sum("lines").alias("n_lines"), F.bool_and("ok").alias("numbered"))


@query(
    "evidence_edges",
    """SELECT 'result' AS source_type, 'o' || o_orderkey AS source_id, '/refs/' || 2 * i AS pointer, 'claim' AS target_type, 'c' || o_custkey AS target_id FROM orders, range(2) r(i)
    UNION ALL SELECT 'result', 'o' || o_orderkey, '/a~1b', 'status', 's' || o_orderstatus FROM orders""",
)
def evidence_edges(t: Tables) -> DataFrame:
    return records.evidence_index(order_records(t))[1]


@query(
    "index_verify",
    """SELECT 'edge' AS part, 'o' || o_orderkey AS record_id, '/a~1b' AS pointer, 'missing' AS problem FROM orders WHERE o_orderkey % 97 IN (0, 1)
    UNION ALL SELECT 'edge', 'o' || o_orderkey, '/a~1b', 'not_in_records' FROM orders WHERE o_orderkey % 97 = 1
    UNION ALL SELECT 'location', 'o' || o_orderkey, '/source_ref', unnest(['missing', 'not_in_records']) FROM orders WHERE o_orderkey % 97 = 2
    UNION ALL SELECT 'record', 'o' || o_orderkey, NULL, unnest(['missing', 'not_in_records']) FROM orders WHERE o_orderkey % 97 = 3""",
)
def index_verify(t: Tables) -> DataFrame:
    """An index with lost and changed edges, moved locations and changed digests against its records."""
    made = cut_lineage(order_records(t))
    base, edges, places = map(cut_lineage, records.evidence_index(made))
    key = lambda c: F.substring(c, 2, 20).cast("long") % 97
    own = F.col("pointer") == "/a~1b"
    edges = edges.where(~(own & (key("source_id") == 0)))
    edges = edges.withColumn("target_id", F.when(own & (key("source_id") == 1), F.lit("x")).otherwise(F.col("target_id")))
    places = places.withColumn("start_line", F.col("start_line") + (key("source_id") == 2).cast("int"))
    base = base.withColumn("digest", F.when(key("record_id") == 3, F.lit("sha256:0")).otherwise(F.col("digest")))
    return records.verify_index(made, base, edges, places).select("part", "record_id", "pointer", "problem")


@query(
    "evidence_locations",
    """SELECT 'o' || o_orderkey AS source_id, '/source_ref' AS pointer, 'file_span' AS source_kind, 'o.csv:' || o_orderkey AS locator, 'o.csv' AS path, o_orderkey AS start_line FROM orders
    UNION ALL SELECT 'o' || o_orderkey, '/refs/0/note', 'note', 'n', NULL, NULL FROM orders""",
)
def evidence_locations(t: Tables) -> DataFrame:
    return records.evidence_index(order_records(t))[2].select("source_id", "pointer", "source_kind", "locator", "path", "start_line")


@query(
    "workflow_trace",
    """WITH k AS (SELECT o_orderkey AS k, o_orderstatus = 'F' AS failed FROM orders),
    r AS (SELECT *, CASE WHEN k % 50 = 1 THEN 'wrong_width' WHEN k % 50 = 2 THEN 'missing_identity' WHEN k % 50 = 3 THEN 'exit_not_integer' WHEN k % 50 = 4 THEN 'inconsistent_status' END AS reason FROM k)
    SELECT k AS line_number, CASE WHEN reason IS NULL THEN CAST(k AS VARCHAR) END AS task_id, CASE WHEN reason IS NULL THEN CASE WHEN failed THEN 'FAILED' ELSE 'COMPLETED' END END AS status,
      CASE WHEN reason IS NULL THEN CASE WHEN failed THEN 137 ELSE 0 END END::BIGINT AS exit, reason AS opaque_reason FROM r""",
)
def workflow_trace(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    failed = F.col("o_orderstatus") == "F"
    status = F.when(k % 50 == 4, F.lit("ABORTED")).when(failed, F.lit("FAILED")).otherwise(F.lit("COMPLETED"))
    code = F.when(k % 50 == 3, F.lit("-")).when(failed, F.lit("137")).otherwise(F.lit("0"))
    name = F.when(k % 50 == 2, F.lit("")).otherwise(F.lit("align"))
    rest = ["2024-01-01", "1s", "1s", "90%", "1 MB", "1 MB", "1", "1"]
    line = F.concat_ws("\t", k.cast("string"), F.lit("ab/12"), F.lit("77"), name, status, code, *[F.lit(x) for x in rest])
    line = F.when(k % 50 == 1, F.concat(line, F.lit("\tx"))).otherwise(line)
    lines = t.orders.select((k % 7).alias("trace_id"), k.alias("line_number"), line.alias("line"))
    return records.workflow_trace(lines).select("line_number", "task_id", "status", "exit", "opaque_reason")


@query(
    "identity_tokens",
    """SELECT o_orderkey, 'row:' || substr(sha256('ordinal' || chr(31) || o_orderkey), 1, 20) AS ordinal_token,
    'hypothesis:' || substr(sha256(concat_ws(chr(31), 'o_custkey', o_custkey, 'o_orderstatus', o_orderstatus)), 1, 20) AS value_token FROM orders""",
)
def identity_tokens(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        ids.ordinal_token("row", F.col("o_orderkey")).alias("ordinal_token"),
        ids.value_token("hypothesis", ["o_orderstatus", "o_custkey"]).alias("value_token"),
    )


@query(
    "rate_readings",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, k / 100.0 AS rate, CAST(0.005 AS DOUBLE) AS tolerance FROM (SELECT *, CAST(round(l_discount * 100) AS BIGINT) AS k FROM lineitem) WHERE k > 0""",
)
def rate_readings(t: Tables) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    k = F.round(F.col("l_discount") * 100).cast("long")
    stated = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("a rate of "), k, F.lit(" % was seen"))).otherwise(
        F.concat(F.lit("a rate of 0."), F.lpad(k.cast("string"), 2, "0"), F.lit(" was seen"))
    )
    read = t.lineitem.select(*keys, F.inline(text.rate_readings(text.number_tokens(stated))))
    return read.select(*keys, "rate", F.round("tolerance", 9).alias("tolerance"))


@query(
    "declared_units",
    """WITH m AS (SELECT o_custkey % 200 AS case_id, o_orderkey, o_custkey, o_orderkey % 900 = 7 AS empty FROM orders),
    u AS (SELECT case_id, o_custkey, count(*) AS n, bool_or(empty) AS bad FROM m GROUP BY ALL),
    g AS (SELECT case_id, CAST(sum(n) AS BIGINT) AS nominal_n, count(*) AS effective_n, count(*) FILTER (WHERE n > 1) AS repeated_units,
      CASE WHEN bool_or(bad) THEN 'unsupported' ELSE 'applicable' END AS applicability FROM u GROUP BY ALL)
    SELECT p AS profile, g.* FROM g, (SELECT unnest(['single_cell', 'longitudinal', 'nested_experiment']) AS p)""",
)
def declared_units(t: Tables) -> DataFrame:
    base = t.orders.select((F.col("o_custkey") % 200).alias("case_id"), F.col("o_orderkey").alias("_obs"), F.col("o_custkey").alias("_unit"))
    other = F.when(F.col("_obs") % 900 == 7, F.lit("")).otherwise(F.lit("x"))
    out = None
    for profile, (columns, observation, unit) in design.PRESETS.items():
        roles = {observation: F.col("_obs"), unit: F.col("_unit")}
        declared = base.select("case_id", *[roles.get(c, other).alias(c) for c in columns])
        one = design.declared_units(declared, profile).withColumn("profile", F.lit(profile))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "bh_observations",
    f"""WITH {REPORTED} SELECT 'bh_complete_family' AS check_id, family AS case_id, 'applicable' AS applicability,
    CASE WHEN count(*) FILTER (WHERE differs OR called <> true_call) = 0 THEN 'conformant' ELSE 'nonconformant' END AS comparison_outcome, 'complete' AS lineage_status,
    CAST(count(*) FILTER (WHERE differs) AS DOUBLE) AS adjusted_mismatches, 'disclosure' AS route FROM diffed GROUP BY family
    UNION ALL SELECT 'bh_complete_family', family, applicability, comparison_outcome, CASE applicability WHEN 'applicable' THEN 'complete' ELSE 'incomplete' END,
      CAST(adjusted_mismatches AS DOUBLE), CASE applicability WHEN 'applicable' THEN 'none' ELSE 'disclosure' END FROM ({HOSTILE})""",
)
def bh_observations(t: Tables) -> DataFrame:
    checked = multiplicity.bh_check(reported(t), CONTRACT, reported_scale=8)
    seen = as_observations(
        checked, "bh_complete_family", "family", operands=["n_rows"], metrics=["adjusted_mismatches", "call_mismatches"]
    )
    return route(seen).select(
        "check_id", "case_id", "applicability", "comparison_outcome", "lineage_status",
        F.col("metrics")["adjusted_mismatches"].alias("adjusted_mismatches"), "route",
    )


@query(
    "claim_audit",
    f"""WITH {CLAIMS}, {RESULTS}, j AS (SELECT claim_id, direction, CASE WHEN orientation = 'control_minus_treated' THEN -value ELSE value END AS v, orientation, scale = l.object AS same,
      CASE WHEN l.direction = 'positive' THEN neg ELSE pos END AS opp FROM linked l LEFT JOIN results USING (result_id) JOIN peers p ON lower(l.a) = p.a AND lower(l.z) = p.z AND l.object = p.object),
    k AS (SELECT *, coalesce(v IS NOT NULL AND orientation <> 'unknown' AND same, false) AND opp = 0 AS known FROM j)
    SELECT CAST(claim_id AS VARCHAR) AS case_id, CASE WHEN known THEN 'applicable' ELSE 'ambiguous' END AS applicability,
      CASE WHEN NOT known THEN 'unknown' WHEN v > 0 AND direction = 'positive' OR v < 0 AND direction = 'negative' THEN 'conformant' ELSE 'nonconformant' END AS comparison_outcome,
      CASE WHEN NOT known THEN 'question' WHEN v > 0 AND direction = 'positive' OR v < 0 AND direction = 'negative' THEN 'none' ELSE 'disclosure' END AS route FROM k""",
)
def claim_audit(t: Tables) -> DataFrame:
    """Report text to routed verdicts: spans, claims, peers, unique link, direction, outcome."""
    stated, found = claims(t), results(t)
    linked = linking.link_claims(linking.conflicting_peers(stated), found)
    judged = linking.direction_check(linked, found)
    state = F.when(F.col("agreement") == "unresolved", F.lit("ambiguous")).otherwise(F.lit("applicable"))
    outcome = F.when(F.col("agreement") == "agree", F.lit("conformant")).when(F.col("agreement") == "conflict", F.lit("nonconformant")).otherwise(F.lit("unknown"))
    seen = as_observations(
        judged.withColumn("applicability", state).withColumn("comparison_outcome", outcome), "claim_direction", "claim_id",
        reason=None, operands=["direction", "recomputed_direction"],
    )
    return route(seen).select("case_id", "applicability", "comparison_outcome", "route")


def checks() -> CheckRegistry:
    registry = CheckRegistry()

    def repeated(inputs) -> DataFrame:
        found = design.unit_multiplicity(inputs["orders"], ["o_custkey"], ["o_orderpriority"])
        outcome = F.when(F.col("repeated_units") == 0, F.lit("conformant")).otherwise(F.lit("nonconformant"))
        return as_observations(
            found.withColumn("comparison_outcome", outcome), "repeated_units", "o_orderpriority", reason=None, metrics=["repeated_units"]
        )

    def failing(inputs) -> DataFrame:
        return inputs["absent"]

    def failing_on_executors(inputs) -> DataFrame:
        return repeated(inputs).withColumn("reason", F.when(F.col("case_id").isNotNull(), F.raise_error(F.lit("bad row"))))

    registry.register("repeated_units", repeated)
    registry.register("failing_check", failing)
    registry.register("failing_on_executors", failing_on_executors)
    registry.register("watched_twice", repeated)
    registry.register("watched_twice", failing)
    return registry


@query(
    "check_registry",
    """WITH u AS (SELECT o_orderpriority, o_custkey, count(*) AS n FROM orders GROUP BY ALL)
    SELECT 'repeated_units' AS check_id, o_orderpriority AS case_id, 'applicable' AS applicability, CASE WHEN max(n) > 1 THEN 'nonconformant' ELSE 'conformant' END AS comparison_outcome FROM u GROUP BY o_orderpriority
    UNION ALL SELECT 'failing_check', NULL, 'unsupported', 'unknown'
    UNION ALL SELECT 'failing_on_executors', NULL, 'unsupported', 'unknown' UNION ALL SELECT 'watched_twice', NULL, 'ambiguous', 'unknown'""",
)
def check_registry(t: Tables) -> DataFrame:
    seen = checks().evaluate(t.spark, {"orders": t.orders})
    return seen.select("check_id", "case_id", "applicability", "comparison_outcome")


@query(
    "stream_segment_clock",
    """WITH g AS (SELECT user_id, epoch_us(ts) AS t, event_id, event_type, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w, 0) AS gap,
      coalesce(lag(event_type) OVER w = 'error', false) AS paused FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, CASE WHEN paused THEN 0 ELSE gap END AS act, sum(CASE WHEN paused THEN 0 ELSE gap END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS spent FROM g),
    k AS (SELECT *, spent - act < 1500000000000 AS open FROM s),
    m AS (SELECT max(epoch_ms(ts)) - 172800000 AS mark FROM events),
    c AS (SELECT user_id, count(*) AS events, CAST(sum(CASE WHEN open THEN act ELSE 0 END) AS BIGINT) AS active_micros,
      CAST(sum(CASE WHEN open AND paused THEN gap ELSE 0 END) AS BIGINT) AS paused_micros, min(CASE WHEN spent >= 1500000000000 THEN t END) AS exhausted_micros,
      CAST(min(CASE WHEN spent >= 1500000000000 THEN t - (spent - 1500000000000) END) AS BIGINT) AS met,
      CAST(max(t) + 1500000000000 - max(spent) AS BIGINT) AS due, max_by(event_type, (t, event_id)) = 'error' AS stopped FROM k GROUP BY user_id)
    SELECT CAST(user_id AS VARCHAR) AS segment, events, active_micros, paused_micros, exhausted_micros,
      coalesce(met, CASE WHEN NOT stopped AND (due + 999) // 1000 < mark THEN due END) AS limit_micros, CAST(0 AS BIGINT) AS rejected, true AS several_batches FROM c, m""",
)
def stream_segment_clock(t: Tables) -> DataFrame:
    """Events in five parts by time, every seventh up to a day late; the stream goes on when a part has arrived."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = t.events.agg(F.min(micros), F.max(micros)).head()
    day = 86_400_000_000
    place = micros + F.when(F.col("event_id") % 7 == 0, F.lit(day)).otherwise(F.lit(0)) - F.lit(first)
    dealt = t.events.withColumn("part", F.floor(place * 5 / F.lit((last or 0) - (first or 0) + day + 1)))
    folder = scratch(t, "arriving")

    def arrive(part: int) -> None:
        dealt.where(F.col("part") == part).drop("part").write.mode("append").parquet(folder)

    arrive(0)
    stream = t.spark.readStream.schema(t.events.schema).parquet(folder)
    events = stream.select(
        F.col("user_id").cast("string").alias("segment"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("tie"), F.col("event_type").alias("state")
    )
    clocks = stream_segment_time(events, paused_state="error", hard_seconds=1_500_000.0, watermark="2 days")
    sink, checkpoint = scratch(t, "clocks"), scratch(t, "checkpoint")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    for part in range(5):
        if part:
            arrive(part)
        run = clocks.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
    clock = t.spark.read.parquet(sink)
    several = clock.agg((F.countDistinct("batch") >= 5).alias("several_batches")).head()[0]
    now = clock.groupBy("segment").agg(*[F.max_by(c, "batch").alias(c) for c in clock.columns if c not in ("segment", "batch", "released")])
    return now.withColumn("several_batches", F.lit(several))


@query(
    "stream_records",
    """SELECT event_type AS record_type, CAST(user_id AS VARCHAR) AS record_id, max(event_id) AS seq,
      'sha256:' || sha256(max_by(event_id || '|' || event_type || '|' || props, event_id)) AS digest, count(*) AS n_stored, true AS several_batches
    FROM events GROUP BY event_type, user_id""",
)
def stream_records(t: Tables) -> DataFrame:
    """Six files, each with events of all times and sent twice, a micro-batch for each file."""
    folder = scratch(t, "arriving")
    t.events.withColumn("file", F.col("event_id") % 6).repartition(6, "file").write.partitionBy("file").parquet(folder)
    stream = t.spark.readStream.schema(t.spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    rows = stream.select(
        F.col("event_type").alias("record_type"), F.col("user_id").cast("string").alias("record_id"), F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("at"), ids.sha256_digest(F.concat_ws("|", "event_id", "event_type", "props")).alias("digest"),
    )
    twice = rows.unionByName(rows)
    store, checkpoint = scratch(t, "ingest"), scratch(t, "checkpoint")
    record_stream.ingest(twice, store, checkpoint).awaitTermination()
    kept = t.spark.read.parquet(store)
    several = kept.agg((F.countDistinct("batch") > 2).alias("several_batches"))
    stored = kept.dropDuplicates(["record_type", "record_id", "seq", "digest"]).groupBy("record_type", "record_id").agg(F.count("*").alias("n_stored"))
    now = record_stream.current(kept).join(stored, ["record_type", "record_id"])
    return now.select("record_type", "record_id", "seq", "digest", "n_stored", F.lit(several.head()[0]).alias("several_batches"))
