"""Top-k, stratified limits and arg-max with stated tie rules."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.operators.ordered import exact_medians
from strandframe.operators.skew import follow_join
from strandframe.session import cut_lineage


def top_k(df: DataFrame, group: list[str], k: int, order: list[Column]) -> DataFrame:
    """The first ``k`` rows of each group in a total order.  Spark keeps ``k``
    rows per group and task before the shuffle, so a hot group stays small."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def round_robin_rank(df: DataFrame, strata: str, order: list[Column]) -> DataFrame:
    """``df`` with ``turn``: the place of a row within its stratum."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(strata).orderBy(*order)))


def stratified_limit(df: DataFrame, strata: str, order: list[Column], limit: int | None) -> DataFrame:
    """``limit`` rows, the k-th of each stratum before any (k+1)-th, strata by
    name; all rows when ``limit`` is None or 0.  Each stratum is cut to ``limit``
    rows first."""
    if not limit:
        return df
    few = top_k(df, [strata], limit, order)
    return round_robin_rank(few, strata, order).orderBy("turn", strata).limit(limit).drop("turn")


def arg_max(df: DataFrame, group: list[str], value: str, tie: str, keep: list[str]) -> DataFrame:
    """The row of the greatest value of each group, the smallest ``tie`` among equals."""
    best = df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.min(F.struct((-F.col(value)).alias("_neg"), F.col(tie), *[F.col(c) for c in keep if c != tie])).alias("_b"))
    return best.select(*group, *[F.col(f"_b.{c}").alias(c) for c in keep], (-F.col("_b._neg")).alias(value))


def top_events(df: DataFrame, group: list[str], utility: str, tie: str, threshold: float | None, most: int) -> DataFrame:
    """At most ``most`` rows per group by utility descending, those below
    ``threshold`` (if any) left out; a utility equal to it stays."""
    kept = df if threshold is None else df.where(F.col(utility) >= threshold)
    return top_k(kept, group, most, [F.desc(utility), F.col(tie)])


#: Rows of one side that are compared with as many of the other in one task.
TILE = 2048


def matched_references(df: DataFrame, group: str, index: str, vector: str, low: str, gap: int, m: int, centred: bool = False, tile: int = TILE) -> DataFrame:
    """(group, index, ref, sim, place): for each row the ``m`` rows of its group
    that are most alike by cosine, then by lowest ``low``, then by index, among
    those at least ``gap`` places away and not above the group's median of ``low``;
    where there are fewer, the rows of lowest ``low`` that are far enough fill up.
    ``centred`` takes the mean off each vector first.

    Both sides of a group are cut into tiles of about ``tile`` rows.  A task
    multiplies the matrices of two tiles and keeps the best ``m`` of each row of the
    left one, and the best of all tiles are merged; pairs are never written out.
    Null groups, vectors and scores have no rows.
    """
    usable = df.select(group, index, vector, F.col(low).cast("double").alias("_low")).dropna()
    ready = cut_lineage(usable.select(group, index, F.col(vector).cast("array<double>").alias("_v"), "_low"))
    sizes = ready.groupBy(group).agg(F.ceil(F.count("*") / tile).cast("int").alias("_tiles")).join(exact_medians(ready, [group], "_low", "_mid"), group)
    sized = follow_join(ready, sizes, [group], [index]).withColumn("_tile", F.pmod(F.xxhash64(index), F.col("_tiles").cast("bigint")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))
    left = sized.select(group, F.col("_tile").alias("_i"), others.alias("_j"), index, "_v")
    right = sized.select(F.col(group).alias("_g"), others.alias("_k"), F.col("_tile").alias("_l"), F.col(index).alias("ref"), F.col("_v").alias("_w"), "_low", (F.col("_low") <= F.col("_mid")).alias("_half"))
    types = dict(df.dtypes)

    def unit(rows: pd.Series) -> np.ndarray:
        matrix = np.stack(rows.to_numpy()).astype(float)
        matrix = matrix - matrix.mean(axis=1, keepdims=True) if centred else matrix
        return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({group: [], index: [], "ref": [], "sim": [], "_low": [], "_half": []})
        sims = np.round(unit(a["_v"]) @ unit(b["_w"]).T, 12)
        far = np.abs(a[index].to_numpy()[:, None] - b["ref"].to_numpy()[None, :]) >= gap
        lows, refs, half = b["_low"].to_numpy(), b["ref"].to_numpy(), b["_half"].to_numpy(dtype=bool)
        out = []
        for r in range(len(a)):
            alike = np.flatnonzero(far[r] & half)
            alike = alike[np.lexsort((refs[alike], lows[alike], -sims[r, alike]))[:m]]
            # the rows of lowest score that may fill up, at most 2m for those among them that are alike
            lowest = np.flatnonzero(far[r])
            lowest = lowest[np.lexsort((refs[lowest], lows[lowest]))[: 2 * m]]
            out.extend((r, c) for c in np.union1d(alike, lowest))
        rows, columns = np.array(out, dtype=int).reshape(-1, 2).T
        return pd.DataFrame({group: a[group].iloc[0], index: a[index].to_numpy()[rows], "ref": refs[columns], "sim": sims[rows, columns], "_low": lows[columns], "_half": half[columns]})

    near = left.groupBy(group, "_i", "_j").cogroup(right.groupBy("_g", "_k", "_l")).applyInPandas(compare, f"`{group}` {types[group]}, `{index}` {types[index]}, ref {types[index]}, sim double, _low double, _half boolean")
    # the alike ones come first, by similarity; what fills up follows by score
    order = [F.desc("_half"), F.desc(F.when(F.col("_half"), F.col("sim"))), F.col("_low"), F.col("ref")]
    w = Window.partitionBy(group, index).orderBy(*order)
    return near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= m).select(group, index, "ref", "sim", "place")
