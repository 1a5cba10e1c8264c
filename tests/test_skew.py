from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline import skew
from plumbline.plans import QUERIES
from plumbline.skew import attach, dealt, numbered, per_key, running, with_blocks


def test_attach_answers_heavy_and_light_keys(spark):
    rows = spark.range(2000).select(F.when(F.col("id") < 1500, F.lit(7)).otherwise(F.col("id") % 40).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("w"), F.sum("id").alias("s")).where("k <> 3")
    want = {(r.id, r.s) for r in rows.join(table, "k", "left").collect()}
    for parts in (2, 10, 2000):
        got = attach(rows, table, ["k"], "w", heavy_parts=parts)
        assert {(r.id, r.s) for r in got.collect()} == want


@pytest.mark.parametrize("kind", ["sum", "min", "max"])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running_is_the_same_in_one_block_and_in_many(spark, kind, descending, inclusive):
    rng = random.Random(5)
    data = [("a" if rng.random() < 0.8 else "b", i, rng.randint(0, 50)) for i in range(400)]
    df = spark.createDataFrame(data, "g string, o int, v int")
    answers = []
    for size in (1000, 30):
        blocked, blocks = with_blocks(df, "o", size)
        assert (blocks == 1) == (size == 1000)
        out = running(blocked, blocks, ["g"], [F.col("o")], F.col("v"), kind, "r", descending=descending, inclusive=inclusive)
        answers.append({(r.g, r.o): r.r for r in out.collect()})
    assert answers[0] == answers[1]


def test_numbered_gives_every_position_once(spark):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in range(200)], "k string").repartition(7)
    got = {r.k: r.idx for r in numbered(df, ["k"]).collect()}
    assert got == {f"k{i:03d}": i for i in range(200)}


def test_blocks_split_equal_order_values(spark):
    df = spark.createDataFrame([("a", 5, i, i % 7) for i in range(300)] + [("b", i, i, 1) for i in range(60)], "g string, o int, t int, v int")
    blocked, blocks = with_blocks(df, "o", 40, ties=["t"])
    assert blocks == 9 and max(r["count"] for r in blocked.groupBy("_block").count().collect()) <= 41
    got = running(blocked, blocks, ["g"], [F.col("o"), F.col("t")], F.col("v"), "sum", "r").where("g = 'a'").collect()
    total = 0
    for r in sorted(got, key=lambda r: r.t):
        total += r.v
        assert r.r == total


def test_parts_follow_the_number_of_rows(spark):
    df = spark.range(1000).select((F.col("id") % 3 == 0).alias("hot"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    assert dealt(df, ["k"], 1000, 10).rdd.getNumPartitions() == 100
    assert dealt(df, ["k"], 1000).rdd.getNumPartitions() == df.rdd.getNumPartitions()
    count = [F.count("*").alias("n")]
    got = per_key(df, ["hot", "k"], 1000, count, [F.sum("n").alias("n")], 10)
    assert got.rdd.getNumPartitions() == 100
    assert sorted(got.collect()) == sorted(df.groupBy("hot", "k").agg(*count).collect())


def test_attach_deals_its_join_by_the_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 100)
    rows = spark.range(2000).select((F.col("id") % 500).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("w"), F.sum("id").alias("s"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = attach(rows, table, ["k"], "w", heavy_parts=400)
        assert got.rdd.getNumPartitions() == 20
        assert sorted(got.collect()) == sorted(rows.join(table, "k", "left").select("k", "id", "w", "s").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_groups_are_not_cut_into_blocks(spark):
    df = spark.range(400).select((F.col("id") % 20).alias("g"), "id")
    assert with_blocks(df, "id", 40, group=["g"])[1] == 1
    assert with_blocks(df, "id", 15, group=["g"])[1] > 1


@pytest.mark.parametrize(("name", "table"), [("ols_sign", "lineitem"), ("dependence_decision", "orders"), ("ambiguous_claims", "lineitem")])
def test_queries_deal_rows_by_their_number(spark, monkeypatch, name, table):
    query, folder = QUERIES[name], "/root/testdata/sf0.001"
    parts = -(-spark.read.parquet(f"{folder}/{table}.parquet").count() // 100)
    want = sorted(query(spark, folder).collect(), key=str)
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 100)
    got = query(spark, folder)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert f", {parts})" in "".join(re.findall(r"hashpartitioning\(.*?, \d+\)", plan))
    assert sorted(got.collect(), key=str) == want
