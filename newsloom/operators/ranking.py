"""Running totals and row numbers over groups of any size.

A window over a whole group is one task per group.  Here the ordered group is cut into
blocks by the leading part of the order key; block totals are summed first (map-side),
a window over the few blocks gives the total before each block, and a window inside the
block adds the rest.  The result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Integer keys of 32 bits fall into at most 65,536 blocks of at most 65,536 keys.
BLOCK_BITS = 16


def integer_block(key: Column, bits: int = BLOCK_BITS) -> Column:
    """Block of an integer order key: neighbours share a block, order is kept."""
    return F.shiftright(key, bits)


def running_total(
    table: DataFrame,
    group: list[str],
    order: list[str | Column],
    block: Column,
    value: Column,
    name: str,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` up to and including the row.

    ``block`` must grow with ``order``, and (group, block, order) should identify a row.
    """
    blocked = table.withColumn("_block", block).withColumn("_value", value)
    totals = blocked.groupBy(*group, "_block").agg(F.sum("_value").alias("_total"))
    earlier_blocks = (
        Window.partitionBy(*group)
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *group,
        "_block",
        F.coalesce(F.sum("_total").over(earlier_blocks), F.lit(0)).alias("_before"),
    )
    inside = (
        Window.partitionBy(*group, "_block")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        blocked.join(offsets, [*group, "_block"])
        .withColumn(name, F.col("_before") + F.sum("_value").over(inside))
        .drop("_block", "_value", "_before")
    )


def row_numbers(
    table: DataFrame,
    group: list[str],
    order: list[str | Column],
    block: Column,
    name: str = "row_no",
) -> DataFrame:
    """Add 1-based row numbers inside each group."""
    return running_total(table, group, order, block, F.lit(1).cast("bigint"), name)
