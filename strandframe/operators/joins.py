"""Look-ups, set operations on keys, and pairs within a group.  Look-ups cut keys
that hold many rows into parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.operators.skew import follow_join


def lookup_two_keys(items: DataFrame, item: str, rows: DataFrame, first: str, second: str, keep: list[str]) -> DataFrame:
    """Items joined to the row whose ``first`` key they equal, else whose
    ``second``; unmatched items leave.  Of several rows with a key the one with
    the smallest ``keep[0]`` counts."""

    def by(key: str, tag: str) -> DataFrame:
        one = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*keep)).alias(tag))
        return one.withColumnRenamed(key, item)

    joined = follow_join(follow_join(items, by(first, "_a"), [item], items.columns, "left"), by(second, "_b"), [item], items.columns, "left")
    found = joined.withColumn("_r", F.coalesce("_a", "_b")).where("_r is not null")
    return found.select(*items.columns, *[F.col(f"_r.{c}").alias(c) for c in keep])


def match_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(both, only_left, only_right): distinct keys on each side."""
    a = left.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_a", F.lit(1))
    b = right.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, key, "full")
    return both.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"))


def common_keys(tables: list[DataFrame], key: str) -> DataFrame:
    """Distinct keys that all tables have."""
    return reduce(lambda a, b: a.intersect(b), [t.select(key).where(F.col(key).isNotNull()) for t in tables])


def with_default(left: DataFrame, right: DataFrame, key: str, column: str, default) -> DataFrame:
    """Left join with a default for rows without a match; ``right`` is unique on key."""
    return follow_join(left, right.select(key, column), [key], left.columns, "left").withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def debiased_pairs(df: DataFrame, group: str, a: str, b: str, value: str) -> DataFrame:
    """(group, a, b, debiased) for a < b: half the difference of the value of (a, b)
    and of (b, a), where both are there.  Both orders are one group of an
    aggregate, so no self-join is needed."""
    low, high = F.least(a, b), F.greatest(a, b)
    grouped = df.where(F.col(a) != F.col(b)).groupBy(group, low.alias("a"), high.alias("b")).agg(F.avg(F.when(F.col(a) < F.col(b), F.col(value))).alias("_f"), F.avg(F.when(F.col(a) > F.col(b), F.col(value))).alias("_r"))
    return grouped.where("_f is not null and _r is not null").select(group, "a", "b", ((F.col("_f") - F.col("_r")) / 2).alias("debiased"))


def split_by_cache(requests: DataFrame, cache: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(hits with their value, distinct missing keys) of requests against a cache
    that is unique on key."""
    asked = requests.select(key).where(F.col(key).isNotNull()).distinct()
    return follow_join(requests, cache.select(key, value), [key], requests.columns), asked.join(cache, key, "left_anti")


def cache_key(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """``out`` = SHA-1 of the JSON of the columns in the order of their names."""
    return df.withColumn(out, F.sha1(F.to_json(F.struct(*sorted(columns)))))
