"""Running totals and row numbers that never put a whole group in one task.

A window over a group runs in one task, and one repository may hold a third of all
rows. Here the rows are range-partitioned by group and order, so that a large group
spans many partitions; each partition is summed on its own, and only the sums, one
per group and partition, are put in order.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoquarry.session import materialise

_PARTITION_BITS = 33  # where monotonically_increasing_id keeps the partition


def running_totals(
    df: DataFrame,
    group: list[str],
    order: list[str],
    weight: Column | None = None,
    before: str = "before",
    total: str = "total",
    before_all: str | None = None,
) -> DataFrame:
    """Add the sum of `weight` over earlier rows of the group and over the group.

    Rows are ordered by `order`, which has to be unique within a group. Without a
    weight every row counts one, and `before` is its 0-based number. `before_all`
    names a column for the sum over all earlier rows, groups in ascending order.
    The frame is written to the shared folder, so pass slim rows.
    """
    keys = [*group, *order]
    ranged = (
        df.withColumn("_w", F.lit(1).cast("bigint") if weight is None else weight.cast("bigint"))
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    ranged = materialise(ranged, "ranged").withColumn(
        "_part", F.shiftright("_row", _PARTITION_BITS)
    )
    earlier = (Window.unboundedPreceding, -1)

    def sum_of_earlier(value: str, window: Window) -> Column:
        return F.coalesce(F.sum(value).over(window.rowsBetween(*earlier)), F.lit(0))

    blocks = ranged.groupBy(*group, "_part").agg(F.sum("_w").alias("_block"))
    added = blocks.withColumn(
        "_earlier", sum_of_earlier("_block", Window.partitionBy(*group).orderBy("_part"))
    ).withColumn("_total", F.sum("_block").over(Window.partitionBy(*group)))
    if before_all:
        # One row per partition: its number is set, so one task may order them.
        parts = blocks.groupBy("_part").agg(F.sum("_block").alias("_sum"))
        parts = parts.select(
            F.col("_part").alias("_p"), sum_of_earlier("_sum", Window.orderBy("_part")).alias("_base")
        )
        within = sum_of_earlier("_block", Window.partitionBy("_part").orderBy(*group))
        added = (
            added.withColumn("_within", within if group else F.lit(0).cast("bigint"))
            .join(parts, F.col("_part") == F.col("_p"))
            .drop("_p")
        )
    renamed = added.select([F.col(c).alias(f"_b{c}") for c in added.columns])
    same_block = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_b{c}")) for c in [*group, "_part"]])
    local = Window.partitionBy(*group, "_part").orderBy("_row")
    joined = ranged.withColumn("_local", sum_of_earlier("_w", local)).join(renamed, same_block)
    columns = [
        *df.columns,
        (F.col("_b_earlier") + F.col("_local")).alias(before),
        F.col("_b_total").alias(total),
    ]
    if before_all:
        columns.append((F.col("_b_base") + F.col("_b_within") + F.col("_local")).alias(before_all))
    return joined.select(columns)


def dense_numbers(df: DataFrame, monotonic: str, number: str) -> DataFrame:
    """Add 0-based numbers without gaps in the order of `monotonic`, a written column
    of `monotonically_increasing_id`. Rows stay where they are: the offsets of the
    partitions that wrote them, a row each, go to every task."""
    part = F.shiftright(monotonic, _PARTITION_BITS)
    within = F.col(monotonic).bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1))
    sizes = df.groupBy(part.alias("_part")).agg((F.max(within) + 1).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_offset"))
    return (
        df.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(number, F.col("_offset") + within)
        .drop("_part", "_offset")
    )


def number_rows(
    df: DataFrame, group: list[str], order: list[str], index: str, total: str = "_count"
) -> DataFrame:
    """Add the 0-based number of each row in its group, and the group's size."""
    return running_totals(df, group, order, before=index, total=total)
