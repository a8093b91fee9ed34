"""Ordered sequences: windows by count, islands, transitions, folds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.operators.sweep import clean_intervals, cover_periods

#: Blocks of 2**32 microseconds (71 minutes) are numbered by themselves.
BLOCK_BITS = 32


def count_windows(df: DataFrame, group: list[str], order: list[str], size: int = 8, position: Column | None = None, bits: int = BLOCK_BITS) -> DataFrame:
    """``df`` with ``idx``: the number, from 0, of the chunk of ``size``
    consecutive rows of the group in which a row lies; the last may be short.

    With ``position`` (a bigint that does not fall along the order, such as the
    time in microseconds) the rows are numbered within blocks of 2**bits
    positions and the counts of earlier blocks carried over, so that a group may
    hold any share of the rows.
    """
    if position is None:
        number = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        return df.withColumn("idx", F.floor((number - 1) / size).cast("int"))
    blocked = df.withColumn("_blk", F.shiftright(position, bits))
    number = F.row_number().over(Window.partitionBy(*group, "_blk").orderBy(*order))
    before = Window.partitionBy(*group).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    counts = blocked.groupBy(*group, "_blk").agg(F.count("*").alias("_n"))
    carry = counts.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_blk").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    on = F.col("_blk").eqNullSafe(F.col("_b"))
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    numbered = blocked.withColumn("_k", number).join(carry, on)
    return numbered.select(*df.columns, F.floor((F.col("_before") + F.col("_k") - 1) / size).cast("int").alias("idx"))


def window_bounds(times: Column, duration: Column, rate: float) -> Column:
    """struct<start,end> of a window from the times of its frames: from the first to
    one frame step after the last, but not beyond the duration, and at least 1e-9
    long.  Null without frames; a null duration does not bound it."""
    start, last = F.get(times, F.lit(0)), F.try_element_at(times, F.lit(-1))
    end = F.greatest(F.least(F.coalesce(duration, last + F.lit(1 / rate)), last + F.lit(1 / rate)), start + 1e-9)
    return F.when(F.size(times) > 0, F.struct(start.alias("start"), end.alias("end")))


def islands(df: DataFrame, group: list[str], index: str, gap: int = 0) -> DataFrame:
    """(group, first, last, n): runs of distinct integers of which neighbours differ
    by at most ``gap`` + 1.  An integer is an interval that reaches ``gap`` + 1
    further, and the sweep line merges what touches, in blocks of integers, so a
    group may hold any share of the rows.  Null groups and integers are left out."""
    kind = dict(df.dtypes)[index]
    place = F.col(index).cast("bigint")
    spans = clean_intervals(df.select(*group, index), group, place, place + gap + 1)
    runs = cover_periods(spans, group, count=True)
    return runs.select(*group, F.col("from_pos").cast(kind).alias("first"), (F.col("to_pos") - gap - 1).cast(kind).alias("last"), "n")


def transitions(df: DataFrame, group: list[str], order: str, label: str, add: float = 1.0, bits: int = 20) -> DataFrame:
    """(n00, n01, n10, n11, a, b): counts of neighbouring 0/1 labels within the
    groups, a = P(0 -> 1), b = P(1 -> 0) with ``add`` added to each count.

    ``order`` is an integer, unique in its group.  Neighbours are found within
    blocks of 2**bits of it; across blocks the last label of one meets the first of
    the next, one row a block, so a group may hold any share of the rows.
    """
    blocked = df.select(*group, F.col(order).cast("bigint").alias("_at"), F.col(label).alias("q")).withColumn("_blk", F.shiftright("_at", bits))
    inside = Window.partitionBy(*group, "_blk").orderBy("_at")
    pairs = blocked.select(F.lag("q").over(inside).alias("p"), "q", F.row_number().over(inside).alias("_k")).where("_k > 1").select("p", "q")
    edges = blocked.groupBy(*group, "_blk").agg(F.min(F.struct("_at", "q"))["q"].alias("q"), F.max(F.struct("_at", "q"))["q"].alias("_last"))
    across = edges.select(F.lag("_last").over(Window.partitionBy(*group).orderBy("_blk")).alias("p"), "q")
    both = pairs.unionByName(across).where("p is not null and q is not null")
    n = both.agg(*[F.count_if((F.col("p") == i) & (F.col("q") == j)).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)])
    a = F.try_divide(F.col("n01") + add, F.col("n00") + F.col("n01") + 2 * add)
    b = F.try_divide(F.col("n10") + add, F.col("n10") + F.col("n11") + 2 * add)
    return n.select("*", a.alias("a"), b.alias("b"))


def _padded(profiles: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of the profiles, filled up with NaN; their lengths)."""
    rows = [np.asarray(p if p is not None else [], dtype=float) for p in profiles]
    sizes = np.array([len(r) for r in rows])
    matrix = np.full((len(rows), max(1, int(sizes.max(initial=1)))), np.nan)
    for i, r in enumerate(rows):
        matrix[i, : len(r)] = r
    return matrix, sizes


def hmm_posterior(evidence: Column, a: float, b: float) -> Column:
    """Posterior of the second state at each place of a two-state chain that
    starts in its stationary distribution; ``evidence`` are log-likelihood
    ratios, a = P(0 -> 1), b = P(1 -> 0), clipped at 1e-6.  Forward and backward
    passes over log-odds, linear in the profile, for all profiles of a batch at
    once.  Null or empty evidence gives an empty array."""
    a, b = min(max(a, 1e-6), 1 - 1e-6), min(max(b, 1e-6), 1 - 1e-6)

    def pushed(f: np.ndarray, up: float, stay: float, down: float, rest: float) -> np.ndarray:
        # log((up + stay·e^f) / (down + rest·e^f)) without overflow
        big = np.exp(-np.abs(f))
        num = np.where(f > 0, up * big + stay, up + stay * big)
        den = np.where(f > 0, down * big + rest, down + rest * big)
        return np.log(num / den)

    @F.pandas_udf("array<double>")
    def posterior(profiles: pd.Series) -> pd.Series:
        x, sizes = _padded(profiles)
        n, t = x.shape
        ahead, behind = np.zeros((n, t)), np.zeros((n, t))
        prior = np.full(n, np.log(a / b))
        for i in range(t):
            ahead[:, i] = x[:, i] + prior
            prior = pushed(ahead[:, i], a, 1 - b, 1 - a, b)
        for i in range(t - 2, -1, -1):
            # beyond a profile's end nothing is known
            behind[:, i] = np.where(i + 1 < sizes, pushed(np.nan_to_num(x[:, i + 1]) + behind[:, i + 1], b, 1 - b, 1 - a, a), 0.0)
        q = 1 / (1 + np.exp(-(ahead + behind)))
        return pd.Series([row[:size] for row, size in zip(q, sizes)])

    return posterior(evidence)


def segment_members(profile: Column, level: float | Column, penalty: float | Column) -> Column:
    """Places (from 0) of the best non-empty set of segments: the sum of
    (x - level) over members less ``penalty`` for each segment after the first is
    greatest.  Equal choices prefer to continue, then the first segment, then a
    new one; a segment goes on to the end when that is as good.  One pass forth
    with back pointers and one back, linear in the profile, for all profiles of a
    batch at once."""

    @F.pandas_udf("array<int>")
    def members(profiles: pd.Series, levels: pd.Series, penalties: pd.Series) -> pd.Series:
        x, sizes = _padded(profiles)
        n, t = x.shape
        low, cost = levels.to_numpy(dtype=float), penalties.to_numpy(dtype=float)
        inside, between = np.full(n, -np.inf), np.full(n, -np.inf)
        came = np.zeros((n, t), dtype=np.int8)  # a member's place before: 0 inside, 1 none, 2 between
        left = np.zeros((n, t), dtype=bool)  # between: from inside one place before
        ends = np.zeros(n, dtype=bool)
        for i in range(t):
            new = between - cost
            go = (inside >= 0) & (inside >= new)
            came[:, i] = np.where(go, 0, np.where(new <= 0, 1, 2))
            left[:, i] = between < inside
            gain = x[:, i] - low
            inside, between = np.maximum(np.maximum(inside, 0.0), new) + gain, np.maximum(between, inside)
            ends = np.where(i + 1 == sizes, inside >= between, ends)
        own, over = np.zeros((n, t), dtype=bool), np.zeros(n, dtype=bool)
        here = ends
        for i in range(t - 1, -1, -1):
            live = (i < sizes) & ~over
            own[:, i] = live & here
            over |= own[:, i] & (came[:, i] == 1)
            here = np.where(live, np.where(here, came[:, i] == 0, left[:, i]), here)
        places = np.nonzero(own)[1].astype(np.int32)
        out = np.split(places, np.cumsum(own.sum(axis=1))[:-1])
        return pd.Series(out)

    as_column = [v if isinstance(v, Column) else F.lit(float(v)) for v in (level, penalty)]
    return members(profile, *as_column)


def member_runs(members: Column) -> Column:
    """array<struct<first:int,last:int>> of the runs of consecutive integers: the
    members without one before them and those without one after, side by side."""
    ordered = F.array_sort(F.array_distinct(F.array_compact(members)))
    none = F.array(F.lit(None).cast("int"))
    before, after = F.concat(none, ordered), F.concat(F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1))), none)
    firsts = F.array_compact(F.zip_with(ordered, F.slice(before, 1, F.size(ordered)), lambda m, p: F.when(p.isNull() | (m > p + 1), m)))
    lasts = F.array_compact(F.zip_with(ordered, after, lambda m, q: F.when(m.isNotNull() & (q.isNull() | (q > m + 1)), m)))
    return F.zip_with(firsts, lasts, lambda f, z: F.struct(f.alias("first"), z.alias("last")))


def top_segments(segments: Column, profile: Column, level: float, most: int = 4) -> Column:
    """The ``most`` segments with the greatest sum of (x - level), in order of place."""
    scored = F.transform(segments, lambda s: F.struct((-F.aggregate(F.slice(profile, s["first"] + 1, s["last"] - s["first"] + 1), F.lit(0.0), lambda a, x: a + x - F.lit(level))).alias("cost"), s["first"].alias("first"), s["last"].alias("last")))
    best = F.slice(F.array_sort(scored), 1, most)
    return F.array_sort(F.transform(best, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"))))


def even_sample(size: Column, most: int = 8) -> Column:
    """Distinct places of at most ``most`` evenly spread items of ``size``, ends
    included, halves to even."""
    n = F.least(size, F.lit(most))
    places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.bround(i * (size - 1) / F.greatest(n - 1, F.lit(1)), 0).cast("int"))
    return F.when(size > 0, F.array_distinct(places)).otherwise(F.array().cast("array<int>"))


def extend_over_gaps(present: Column, start: Column, gap: int) -> Column:
    """Last place reached from ``start`` by jumps of at most ``gap`` + 1 between
    present places (an array of integers)."""
    later = F.array_sort(F.filter(present, lambda x: x > start))
    return F.aggregate(later, start, lambda at, x: F.when(x - at <= gap + 1, x).otherwise(at))


def onset_offset(present: Column, seed: Column) -> Column:
    """struct<onset,offset>: the run of true values of a boolean array around
    ``seed`` (from 0); null where the seed is not present.  All values are at
    hand, so the places are one pass and no search is needed."""
    places = F.filter(F.sequence(F.lit(0), F.size(present) - 1), lambda i: ~F.get(present, i))
    before, after = F.array_max(F.filter(places, lambda i: i < seed)), F.array_min(F.filter(places, lambda i: i > seed))
    run = F.struct((F.coalesce(before, F.lit(-1)) + 1).alias("onset"), (F.coalesce(after, F.size(present)) - 1).alias("offset"))
    return F.when(F.coalesce(F.get(present, seed), F.lit(False)), run)
