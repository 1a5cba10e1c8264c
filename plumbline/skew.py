"""Plan pieces that keep one heavy key from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

# A key is heavy when it holds more than 1/HEAVY_PARTS of all rows, so there are
# fewer than HEAVY_PARTS heavy keys whatever the data: a proven broadcast bound.
HEAVY_PARTS = 2000
SALTS = 256
# More blocks than this would make the cut points themselves large; blocks grow instead.
MAX_BLOCKS = 5000
SMALL_BYTES = 256 * 1024 * 1024
#: Rows in one task's share where rows are dealt by their number.
ROWS_PER_TASK = 250_000


def dealt(df: DataFrame, keys: Sequence[str | Column], rows: int | None, rows_per_task: int | None = None) -> DataFrame:
    """``df`` dealt by ``keys`` into as many parts as ``rows`` need, so that a task's share does not grow with the input.

    Where the session's shuffle partitions are enough, or ``rows`` is not known, ``df`` is left as it is.
    """
    parts = -(-(rows or 0) // (rows_per_task or ROWS_PER_TASK))
    if parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(parts, *keys)


def per_key(
    df: DataFrame, keys: Sequence[str], rows: int | None, once: Sequence[Column], again: Sequence[Column], rows_per_task: int | None = None
) -> DataFrame:
    """Rows grouped by ``keys``: ``once`` over the rows, ``again`` over what parts of a key gave, under the same names.

    Rows are dealt before they are grouped, a key's rows over many parts, so that neither a part of the input nor a
    heavy key fills one task.
    """
    keys = list(keys)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    salted = df.withColumn("_part", salt)
    spread_out = dealt(salted, [*keys, "_part"], rows, rows_per_task)
    if spread_out is salted:
        return df.groupBy(*keys).agg(*once)
    parts = spread_out.groupBy(*keys, "_part").agg(*once).drop("_part")
    return dealt(parts, keys, rows, rows_per_task).groupBy(*keys).agg(*again)


def attach(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    weight: str,
    *,
    heavy_parts: int = HEAVY_PARTS,
) -> DataFrame:
    """Left-join ``table`` (one row per key, ``weight`` = rows of that key) onto ``rows``.

    The table is written once.  If no key is heavy this is one plain join that Spark plans
    from the table's size.  Otherwise heavy keys are answered from a broadcast of fewer than
    ``heavy_parts`` rows, and their rows are salted away from the join that answers the rest.
    """
    keys = list(keys)
    table = cut_lineage(table)
    load = F.col(weight).cast("double")
    size, total, top = table.agg(F.count("*"), F.sum(load), F.max(load)).head()
    if size <= heavy_parts:
        return rows.join(F.broadcast(table), keys, "left")
    if top * heavy_parts <= total:
        return rows.join(dealt(table, keys, int(total)), keys, "left")
    is_heavy = load * heavy_parts > total
    values = [c for c in table.columns if c not in keys]
    heavy = table.where(is_heavy).select(*keys, F.struct(*values).alias("_hv"))
    light = table.where(~is_heavy).select(*keys, F.struct(*values).alias("_lv"), F.lit(0).alias("_salt"))
    spread = 1 + F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    joined = (
        rows.join(F.broadcast(heavy), keys, "left")
        .withColumn("_salt", F.when(F.col("_hv").isNotNull(), spread).otherwise(0))
        .join(dealt(light, [*keys, "_salt"], int(total)), [*keys, "_salt"], "left")
        .withColumn("_v", F.coalesce("_hv", "_lv"))
    )
    kept = [F.col(c) for c in rows.columns]
    return joined.select(*kept, *[F.col("_v").getField(c).alias(c) for c in values])


def spread(df: DataFrame, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """Give an input too small to be split by its reader to every core before heavy row work.

    Larger inputs already arrive in many splits and are left as they are, unshuffled.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    if int(plan.stats().sizeInBytes()) > small_bytes:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def with_blocks(
    df: DataFrame, order: str, rows_per_block: int, ties: Sequence[str] = (), group: Sequence[str] = ()
) -> tuple[DataFrame, int]:
    """Add ``_block``: position of ``order`` among evenly loaded cut points of the whole frame.

    Returns the frame, written once, and the number of blocks; one block means it is small.
    Only the cut points (one number per block) come back to the driver.  When many rows may
    share one ``order`` value, ``ties`` breaks them and blocks are cut by exact position.  With ``group`` the
    frame stays one block while no group is larger than a block.
    """
    from pyspark.ml.feature import Bucketizer

    df = cut_lineage(df)
    n_rows = df.count()
    blocks = min(max(1, -(-n_rows // rows_per_block)), MAX_BLOCKS)
    if blocks > 1 and group and df.groupBy(*group).count().agg(F.max("count")).head()[0] <= rows_per_block:
        blocks = 1
    if blocks == 1:
        return df.withColumn("_block", F.lit(0)), 1
    if ties:
        placed = numbered(df, [order, *ties])
        return placed.withColumn("_block", F.floor(F.col("idx") * blocks / n_rows).cast("int")).drop("idx"), blocks
    ordered = df.withColumn("_order", F.col(order).cast("double"))
    probs = [i / blocks for i in range(1, blocks)]
    cuts = ordered.agg(F.percentile_approx("_order", probs, max(10_000, 20 * blocks))).head()[0]
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    bucketed = Bucketizer(
        splits=splits, inputCol="_order", outputCol="_block", handleInvalid="keep"
    ).transform(ordered)
    return bucketed.withColumn("_block", F.col("_block").cast("int")).drop("_order"), len(splits) - 1


def running(
    df: DataFrame,
    n_blocks: int,
    group: Sequence[str],
    order: Sequence[Column],
    value: Column,
    kind: str,
    out: str,
    *,
    descending: bool = False,
    inclusive: bool = True,
) -> DataFrame:
    """Running ``sum``, ``min`` or ``max`` of ``value`` in each group, over any group size.

    Rows are scanned inside (group, block); blocks are then carried forward with one row per
    (group, block).  ``df`` must come from :func:`with_blocks` on the leading order column.
    """
    fold = {"sum": F.sum, "min": F.min, "max": F.max}[kind]
    group = list(group)
    ordered = [c.desc() if descending else c.asc() for c in order]
    end = Window.currentRow if inclusive else -1
    if n_blocks == 1:
        window = Window.partitionBy(*group).orderBy(*ordered)
        return df.withColumn(out, fold(value).over(window.rowsBetween(Window.unboundedPreceding, end)))
    local = Window.partitionBy(*group, "_block").orderBy(*ordered)
    scanned = df.withColumn("_local", fold(value).over(local.rowsBetween(Window.unboundedPreceding, end)))
    by_block = F.col("_block").desc() if descending else F.col("_block").asc()
    across = Window.partitionBy(*group).orderBy(by_block).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        df.groupBy(*group, "_block")
        .agg(fold(value).alias("_total"))
        .withColumn("_carry", fold("_total").over(across))
        .drop("_total")
    )
    joined = scanned.join(carry, [*group, "_block"], "left")
    if kind == "sum":
        both = F.when(
            F.coalesce("_carry", "_local").isNotNull(),
            F.coalesce(F.col("_carry"), F.lit(0)) + F.coalesce(F.col("_local"), F.lit(0)),
        )
    else:
        both = (F.least if kind == "min" else F.greatest)("_carry", "_local")
    return joined.withColumn(out, both).drop("_carry", "_local")


def numbered(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``idx`` = 0-based position by ``order``, without gathering the rows in one task."""
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    placed = cut_lineage(placed)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_pid").agg(F.count("*").alias("_n")).select(
        "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    return placed.join(F.broadcast(starts), "_pid").withColumn("idx", F.col("_start") + F.col("_at")).drop(
        "_pid", "_at", "_start"
    )
