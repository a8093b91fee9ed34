"""Prefix sums over an ordered group of any size.

A window over a whole group would put a hot group into one task.  Here a group
is cut into blocks of positions; a block is summed by itself, the block totals
are summed by the same operator one level up, and the carry is joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A block spans 2**BLOCK_BITS positions, so that no window frame holds more
#: rows than that when positions are unique within a group.
BLOCK_BITS = 20


def running_sum(df: DataFrame, group: list[str], position: str, value: str, out: str, bits: int = BLOCK_BITS, levels: int = 2) -> DataFrame:
    """``df`` with ``out`` = sum of ``value`` over the rows of the group whose
    ``position`` (bigint) is at most the row's own.

    Rows are expected to be unique on (group, position): aggregate before.
    Null values count as 0; a null group is a group of its own.  ``levels``
    block levels are built: two cover 2**60 positions with at most 2**20 rows
    in a frame.
    """
    if levels == 0:
        w = Window.partitionBy(*group).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(F.coalesce(F.col(value), F.lit(0))).over(w))
    block = f"_block{levels}"
    local = df.withColumn(block, F.shiftright(F.col(position), bits))
    w = Window.partitionBy(*group, block).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    inner = local.withColumn("_local", F.sum(F.coalesce(F.col(value), F.lit(0))).over(w))
    totals = local.groupBy(*group, block).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("_total"))
    carried = running_sum(totals, group, block, "_total", "_upto", bits, levels - 1)
    carry = carried.select(*[F.col(g).alias(f"_c_{g}") for g in group], F.col(block).alias("_c_block"), (F.col("_upto") - F.col("_total")).alias("_carry"))
    on = F.col(block) == F.col("_c_block")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_c_{g}"))
    joined = inner.join(carry.where(F.col("_carry") != 0), on, "left")
    return joined.withColumn(out, F.col("_local") + F.coalesce(F.col("_carry"), F.lit(0))).select(*df.columns, out)
