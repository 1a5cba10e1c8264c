"""Named queries with their SQL twins, and named checks that can be removed one by one."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from plumbline.outcomes import CHECK_SCHEMA
from plumbline.session import cut_lineage, shared_folder


class Tables:
    """The given parquet tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` as a query; ``sql`` computes the same rows without Spark."""

    def keep(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


Check = Callable[[Mapping[str, DataFrame]], DataFrame]


@dataclass
class CheckRegistry:
    """Independent checks over shared inputs; each returns the common observation schema.

    Taking one check out leaves the others unchanged.  Each check is planned and written by a job of its own, a few at
    a time, so one that fails while planning or on the executors becomes a row, unsupported, and does not stop its
    siblings.  Two checks registered under one name make that name ambiguous instead of picking one.
    """

    checks: dict[str, list[Check]] = field(default_factory=dict)

    def register(self, name: str, check: Check) -> None:
        self.checks.setdefault(name, []).append(check)

    def remove(self, name: str) -> None:
        self.checks.pop(name, None)

    def evaluate(self, spark: SparkSession, inputs: Mapping[str, DataFrame], *, at_once: int = 4) -> DataFrame:
        empty = spark.createDataFrame([], CHECK_SCHEMA)

        def observe(name: str) -> DataFrame:
            if len(self.checks[name]) > 1:
                return _boundary(spark, name, "ambiguous", "more than one adapter observes this check")
            tag = "check " + name.replace(",", ";")
            spark.addTag(tag)
            try:
                return cut_lineage(empty.unionByName(self.checks[name][0](inputs)))
            except Exception as error:  # a check that fails is isolated to its own row
                return _boundary(spark, name, "unsupported", type(error).__name__)
            finally:
                spark.removeTag(tag)

        shared_folder(spark)  # set once, before the checks ask for it
        with ThreadPoolExecutor(at_once) as pool:
            return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(spark)(observe), sorted(self.checks)), empty)


def _boundary(spark: SparkSession, name: str, state: str, reason: str) -> DataFrame:
    return spark.range(1).select(
        F.lit(name).alias("check_id"),
        F.lit(None).cast("string").alias("case_id"),
        F.lit(state).alias("applicability"),
        F.lit("unknown").alias("comparison_outcome"),
        F.lit("incomplete").alias("lineage_status"),
        F.expr("cast(map() as map<string,string>)").alias("operands"),
        F.expr("cast(map() as map<string,double>)").alias("metrics"),
        F.lit(reason).alias("reason"),
        F.concat(F.lit("sha256:"), F.sha2(F.lit(f"{name}|{state}|{reason}"), 256)).alias("observation_digest"),
    )
