from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import outcomes as O


def test_states_fix_outcome_lineage_and_route(spark):
    rows = [(s, ok) for s in (O.APPLICABLE, O.NOT_APPLICABLE, O.AMBIGUOUS, O.UNSUPPORTED) for ok in (True, False)]
    df = spark.createDataFrame(rows, "applicability string, ok boolean").withColumn("id", F.monotonically_increasing_id())
    df = df.withColumn("comparison_outcome", O.outcome_of(F.col("applicability"), F.col("ok")))
    seen = O.route(O.as_observations(df, "check", "id", reason=None, operands=["ok"]))
    assert O.illegal(seen).count() == 0
    got = {(r.applicability, r.comparison_outcome): (r.lineage_status, r.route) for r in seen.collect()}
    assert got == {
        ("applicable", "conformant"): ("complete", "none"),
        ("applicable", "nonconformant"): ("complete", "disclosure"),
        ("not_applicable", "not_applicable"): ("not_applicable", "none"),
        ("ambiguous", "unknown"): ("incomplete", "question"),
        ("unsupported", "unknown"): ("incomplete", "disclosure"),
    }
    broken = seen.withColumn("comparison_outcome", F.lit("conformant"))
    assert O.illegal(broken).count() == 6
    assert O.illegal(O.as_observations(df.where("applicability = 'applicable'"), "check", "id", reason=None)).count() == 2


def test_digest_depends_on_content_only(spark):
    df = spark.createDataFrame([("a", "applicable", "conformant", 1), ("b", "applicable", "conformant", 2)], "id string, applicability string, comparison_outcome string, n int")
    first = {r.case_id: r.observation_digest for r in O.as_observations(df, "c", "id", reason=None, operands=["n"]).collect()}
    again = {r.case_id: r.observation_digest for r in O.as_observations(df.repartition(3), "c", "id", reason=None, operands=["n"]).collect()}
    assert first == again and first["a"] != first["b"]
