"""Joins against a side that is unique on its key, when one key of the other
side may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task joins; a heavier key is cut into as many parts
#: as it needs for that.
PART_ROWS = 1 << 20
#: At most so many keys are cut, the heaviest first; their list, which is
#: broadcast, is no longer whatever the input.  Any other key holds less than
#: 1/HOT_KEYS of the rows.
HOT_KEYS = 1 << 16


def salted_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, spread: list[str], how: str = "inner", part_rows: int = PART_ROWS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Equi-join of ``left`` with ``right``, which is unique on ``on`` and is best
    materialised: it is read once for its heavy keys and once for the join.

    ``weight`` is a column of ``right``: how many rows of ``left`` have the key,
    as known from an earlier aggregate.  The rows of a key with more than
    ``part_rows`` are spread by a hash of the columns ``spread`` over
    weight / part_rows parts, and ``right`` repeats the key's row once per part.
    Without such keys it is a plain join.  Nulls in ``on`` match nothing, as in
    SQL.  ``weight`` is not in the result.
    """
    heavy = right.where(F.col(weight) > part_rows).orderBy(F.desc(weight), *on).limit(hot_keys).select(*on, F.ceil(F.col(weight) / part_rows).cast("int").alias("_parts"))
    return _joined(left, right.drop(weight), on, heavy, spread, how)


def follow_join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], how: str = "inner", part_rows: int = PART_ROWS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """As ``salted_join``, with the rows of each key counted in ``left`` itself."""
    held = left.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > part_rows)
    heavy = held.dropna(subset=on).orderBy(F.desc("_n"), *on).limit(hot_keys).select(*on, F.ceil(F.col("_n") / part_rows).cast("int").alias("_parts"))
    return _joined(left, right, on, heavy, spread, how)


def _joined(left: DataFrame, right: DataFrame, on: list[str], heavy: DataFrame, spread: list[str], how: str) -> DataFrame:
    rows = heavy.collect()
    if not rows:
        return left.join(right, on, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(rows, heavy.schema))
    part = F.when(F.col("_parts") > 1, F.pmod(F.xxhash64(*spread), F.col("_parts").cast("bigint")).cast("int")).otherwise(F.lit(0))
    salted = left.join(hot, on, "left").withColumn("_part", part).drop("_parts")
    repeated = right.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return salted.join(repeated, [*on, "_part"], how).drop("_part")
