"""Running totals, ranks and exact quantiles in the order of a column, for groups
of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.session import cut_lineage


def running_totals(df: DataFrame, group: list[str], order: str, sums: dict[str, str], descending: bool = False, ties: list[str] | None = None, highest: dict[str, str] | None = None) -> DataFrame:
    """``df`` with, for each new column of ``sums``, the sum of its column (and for
    each of ``highest`` the greatest value, null passed over) over the rows of the
    group that come up to the row in the order.  Rows are unique on (group, order,
    ties): aggregate what is equal before.

    The rows are cut by range of (group, order, ties) into as many parts as the
    session has shuffle partitions, so neither a group nor one value of the order
    stays together; a window holds one group within one part, and the totals of
    the parts before are carried in: a row per group and part.
    """
    highest = highest or {}
    sort = [F.col(order).desc() if descending else F.col(order).asc(), *[F.col(t).asc() for t in ties or []]]
    ranged = cut_lineage(df.repartitionByRange(*group, *sort).withColumn("_part", F.spark_partition_id()))
    upto = Window.partitionBy("_part", *group).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(c).over(upto).alias(f"_l_{name}") for name, c in sums.items()], *[F.max(c).over(upto).alias(f"_l_{name}") for name, c in highest.items()])
    totals = ranged.groupBy("_part", *group).agg(*[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()], *[F.max(c).alias(f"_t_{name}") for name, c in highest.items()])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(f"_t_{name}").over(before).alias(f"_c_{name}") for name in sums] + [F.max(f"_t_{name}").over(before).alias(f"_c_{name}") for name in highest]
    carry = totals.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g_{g}") for g in group], *carried)
    on = F.col("_part") == F.col("_p")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = local.join(carry, on)
    added = [(F.coalesce(f"_l_{name}", F.lit(0)) + F.coalesce(f"_c_{name}", F.lit(0))).alias(name) for name in sums]
    return joined.select(*df.columns, *added, *[F.greatest(f"_l_{name}", f"_c_{name}").alias(name) for name in highest])


def exact_quantiles(df: DataFrame, group: list[str], value: str, points: list[float]) -> DataFrame:
    """(group, q): the exact quantiles of ``value`` at ``points``, linear between
    neighbouring ranks; null and NaN values are left out.  Equal values are
    counted first and ranked by ``running_totals``; only the two values at each
    quantile are kept, so a group may hold any share of the rows."""
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*group, value).agg(F.count("*").alias("_n"))
    ranked = cut_lineage(running_totals(counts, group, value, {"_upto": "_n"}))
    sizes = ranked.groupBy(*group).agg(F.sum("_n").alias("_size")).select(*[F.col(g).alias(f"_s_{g}") for g in group], "_size")
    on: Column = F.lit(True)
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_s_{g}"))
    # without groups there is one size, which is one row
    sized = ranked.join(sizes, on) if group else ranked.join(F.broadcast(sizes))
    asked = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("_size") - 1)).alias("at")) for i, p in enumerate(points)])
    first, last = F.col("_upto") - F.col("_n"), F.col("_upto") - 1
    held = F.filter(asked, lambda a: ((F.floor(a["at"]) >= first) & (F.floor(a["at"]) <= last)) | ((F.ceil(a["at"]) >= first) & (F.ceil(a["at"]) <= last)))
    near = sized.select(*group, F.col(value).alias("_v"), first.alias("_first"), last.alias("_last"), F.explode(held).alias("a"))
    low = F.max(F.when((F.floor("a.at") >= F.col("_first")) & (F.floor("a.at") <= F.col("_last")), F.col("_v")))
    high = F.max(F.when((F.ceil("a.at") >= F.col("_first")) & (F.ceil("a.at") <= F.col("_last")), F.col("_v")))
    each = near.groupBy(*group, "a.i", "a.at").agg(low.alias("_low"), high.alias("_high"))
    valued = each.select(*group, "i", (F.col("_low") + (F.col("at") - F.floor("at")) * (F.col("_high") - F.col("_low"))).alias("_q"))
    return valued.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "_q"))), lambda s: s["_q"]).alias("q"))


def exact_medians(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """(group, out): the exact median of each group that has values."""
    return exact_quantiles(df, group, value, [0.5]).select(*group, F.get("q", F.lit(0)).alias(out))
