"""Resampling tests from sufficient statistics of groups.

A replicate weighs sums of groups; the rows are aggregated once.  What reaches
the driver is one row of sums per group (video or cluster) of an evaluation.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.operators.ordered import running_totals
from strandframe.session import cut_lineage

#: Resamples of an interval.
DRAWS = 2000
#: Most clusters (games, say) whose sums or pairs are read to the driver.
MAX_CLUSTERS = 1024


def sums_by_group(df: DataFrame, group: str, columns: list[str]) -> tuple[list, np.ndarray]:
    """Names and column sums of at most MAX_CLUSTERS groups, in order; more are
    refused (``poisson_bootstrap`` takes any number)."""
    rows = df.groupBy(group).agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in columns]).orderBy(group).limit(MAX_CLUSTERS + 1).collect()
    if len(rows) > MAX_CLUSTERS:
        raise ValueError(f"at most {MAX_CLUSTERS} groups can be read to the driver")
    return [r[group] for r in rows], np.array([[r[c] or 0.0 for c in columns] for r in rows]).reshape(len(rows), len(columns))


def exact_permutation(df: DataFrame, group: str, first: str, second: str) -> DataFrame:
    """(n_groups, delta, p): two-sided sign-flip test of Σ(first - second) over all
    2^G sign vectors of at most 20 groups; one vector is one row of a range, its
    sum a fold over the group sums.  Ties within 1e-12 count as extreme."""
    sums = df.groupBy(group).agg((F.sum(first) - F.sum(second)).alias("d"))
    diffs = [r["d"] for r in sums.orderBy(group).limit(21).collect()]
    g = len(diffs)
    if g == 0 or g > 20:
        raise ValueError(f"the exact test takes 1 to 20 groups, not {g if g <= 20 else "more"}")
    observed = sum(diffs)
    flipped = sum((F.when(F.col("id").bitwiseAND(F.lit(1 << i)) > 0, -d).otherwise(d) for i, d in enumerate(diffs)), F.lit(0.0))
    vectors = df.sparkSession.range(0, 1 << g).select(flipped.alias("s"))
    return vectors.agg(F.lit(g).cast("bigint").alias("n_groups"), F.lit(float(observed)).alias("delta"), F.avg((F.abs("s") >= abs(observed) - 1e-12).cast("double")).alias("p"))


def permutation_p(diffs: np.ndarray, draws: int, seed: int) -> float:
    """Sign-flip p-value: exact when 2^G is at most ``draws`` and G at most 20,
    else (1 + extremes) / (1 + draws) of random sign vectors."""
    g, observed = len(diffs), abs(float(np.sum(diffs)))
    if g <= 20 and 2**g <= draws:
        signs = 1 - 2 * ((np.arange(2**g)[:, None] >> np.arange(g)) & 1)
        return float(np.mean(np.abs(signs @ diffs) >= observed - 1e-12))
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(draws, g))
    return float((1 + np.sum(np.abs(signs @ diffs) >= observed - 1e-12)) / (1 + draws))


def bootstrap_ci(sums: np.ndarray, statistic: Callable[[np.ndarray], np.ndarray], draws: int, seed: int, level: float = 0.95) -> tuple[float, float, float]:
    """(estimate, low, high): percentile interval of a statistic of summed rows;
    ``statistic`` maps an array (..., columns) to (...)."""
    n = len(sums)
    counts = np.random.default_rng(seed).multinomial(n, np.full(n, 1 / n), size=draws)
    values = statistic(counts @ sums)
    low, high = np.nanquantile(values, [(1 - level) / 2, (1 + level) / 2])
    return float(statistic(sums.sum(axis=0))), float(low), float(high)


def paired_bootstrap(first: np.ndarray, second: np.ndarray, statistic: Callable[[np.ndarray], np.ndarray], draws: int, seed: int) -> tuple[float, float, float]:
    """(delta, low, high) of a statistic of two methods over the same groups."""
    k = first.shape[1]
    return bootstrap_ci(np.hstack([first, second]), lambda s: statistic(s[..., :k]) - statistic(s[..., k:]), draws, seed)


def student_quantile(p: float, df: int) -> float:
    """Quantile of Student's t by bisection on the incomplete beta function."""

    def beta_fraction(a: float, b: float, x: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 300):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + top * d, 1 + top / c
                d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    def cdf(t: float) -> float:
        x = df / (df + t * t)
        a, b = df / 2, 0.5
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
        if x >= 1:
            tail = 1.0
        else:
            tail = front * beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * beta_fraction(b, a, 1 - x) / b
        return 1 - tail / 2 if t > 0 else tail / 2

    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


@dataclass(frozen=True)
class PairCounts:
    """Of clusters ``names``: ``wins[i, j]`` counts the pairs of a positive of
    cluster i and a negative of cluster j that the score puts in the right order,
    ties half; ``pos`` and ``neg`` count the rows."""

    names: list
    wins: np.ndarray
    pos: np.ndarray
    neg: np.ndarray

    def auc(self, weights: np.ndarray) -> np.ndarray:
        """Pooled AUC when cluster i is taken ``weights[..., i]`` times; NaN
        without both classes."""
        pairs = (weights @ self.pos) * (weights @ self.neg)
        won = np.einsum("...i,ij,...j->...", weights, self.wins, weights)
        return np.where(pairs > 0, won / np.where(pairs > 0, pairs, 1.0), np.nan)


def pair_counts(df: DataFrame, cluster: str, score: str, label: str) -> PairCounts:
    """The pairs of positives and negatives that a score orders rightly, per pair
    of clusters: all that any resample of whole clusters needs for its AUC.

    Rows are counted per (score, cluster) and sorted by range of the score; each
    partition counts its own pairs and its rows per cluster, and pairs across
    partitions are products of those.  What reaches the driver is MAX_CLUSTERS²
    sums and a row per partition and cluster.  Null and NaN scores and null labels
    and clusters are left out; more than MAX_CLUSTERS clusters are refused.
    """
    usable = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score)) & F.col(label).isNotNull() & F.col(cluster).isNotNull())
    names = sorted(r[0] for r in usable.select(cluster).distinct().limit(MAX_CLUSTERS + 1).collect())
    g = len(names)
    if g > MAX_CLUSTERS:
        raise ValueError(f"at most {MAX_CLUSTERS} clusters can be resampled as a whole")
    if not g:
        return PairCounts([], np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    numbers = df.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], f"`{cluster}` {dict(df.dtypes)[cluster]}, _g int")
    counted = usable.groupBy(cluster, F.col(score).cast("double").alias("_s")).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_pos"))
    ranged = counted.join(F.broadcast(numbers), cluster).select("_s", "_g", "_n", "_pos").repartitionByRange("_s").sortWithinPartitions("_s").withColumn("_part", F.spark_partition_id())
    step = max(1, (1 << 22) // g)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wins, pos, neg, part = np.zeros((g, g)), np.zeros(g), np.zeros(g), None
        open_score, open_pos, open_neg = None, np.zeros(g), np.zeros(g)

        def close() -> None:
            nonlocal wins, pos, neg, open_pos, open_neg
            wins += np.outer(open_pos, neg + open_neg / 2)
            pos, neg = pos + open_pos, neg + open_neg
            open_pos, open_neg = np.zeros(g), np.zeros(g)

        for batch in batches:
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                s, c, n, p = (piece.column(i).to_numpy() for i in range(4))
                part = piece.column("_part")[0].as_py()
                if open_score is not None and s[0] != open_score:
                    close()
                distinct, place = np.unique(s, return_inverse=True)
                positive, negative = np.zeros((len(distinct), g)), np.zeros((len(distinct), g))
                np.add.at(positive, (place, c), p)
                np.add.at(negative, (place, c), n - p)
                positive[0] += open_pos
                negative[0] += open_neg
                below = neg + np.cumsum(negative[:-1], axis=0) - negative[:-1]
                wins += positive[:-1].T @ (below + negative[:-1] / 2)
                pos, neg = pos + positive[:-1].sum(axis=0), neg + negative[:-1].sum(axis=0)
                open_score, open_pos, open_neg = distinct[-1], positive[-1], negative[-1]
        if part is not None:
            close()
            i, j = np.divmod(np.arange(g * g), g)
            rows = [(np.full(g * g, -1), i, j, wins.ravel()), (np.full(g, part), np.arange(g), np.zeros(g), pos), (np.full(g, part), np.arange(g), np.ones(g), neg)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[k] for r in rows]).astype(np.float64 if k == 3 else np.int32)) for k in range(4)], names=["part", "i", "j", "n"])

    told = cut_lineage(ranged.mapInArrow(run, "part int, i int, j int, n double"))
    wins = np.zeros((g, g))
    for r in told.where("part < 0").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        wins[r["i"], r["j"]] = r["n"]
    parts = {}
    for r in told.where("part >= 0").collect():
        parts.setdefault(r["part"], np.zeros((2, g)))[r["j"], r["i"]] = r["n"]
    pos, neg = np.zeros(g), np.zeros(g)
    for part in sorted(parts):
        wins += np.outer(parts[part][0], neg)
        pos, neg = pos + parts[part][0], neg + parts[part][1]
    return PairCounts(names, wins, pos, neg)


def cluster_bootstrap_auc(counts: PairCounts, draws: int = DRAWS, seed: int = 0) -> dict[str, float]:
    """AUC of the pooled rows with an interval from whole clusters drawn with
    replacement: t(G-1) on the scaled standard error, and percentiles.  A
    replicate is a weight per cluster on the counted pairs, not a pass over rows."""
    g, rng = len(counts.names), np.random.default_rng(seed)
    none = {name: float("nan") for name in ("low", "high", "pct_low", "pct_high")}
    if not g:
        return {"auc": float("nan"), **none}
    estimate = float(counts.auc(np.ones(g)))
    weights = np.stack([np.bincount(rng.integers(0, g, g), minlength=g) for _ in range(draws)]).astype(float)
    drawn = counts.auc(weights)
    drawn = drawn[~np.isnan(drawn)]
    if len(drawn) < 2 or g < 2:
        return {"auc": estimate, **none}
    half = student_quantile(0.975, g - 1) * float(drawn.std(ddof=1)) * math.sqrt(g / (g - 1))
    return {"auc": estimate, "low": estimate - half, "high": estimate + half, "pct_low": float(np.quantile(drawn, 0.025)), "pct_high": float(np.quantile(drawn, 0.975))}


def poisson_bootstrap(df: DataFrame, group: str, columns: list[str], draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """(draw, columns): the column sums of ``draws`` resamples of groups, of which
    there may be any number: in each draw a group counts a Poisson(1) number of
    times, read off an MD5 of (seed, draw, group), so nothing random is lost with
    an executor.  Draw -1 is the sample itself.  Null groups count as one group."""
    sums = df.groupBy(group).agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in columns])
    spread = sums.withColumn("draw", F.explode(F.sequence(F.lit(-1), F.lit(draws - 1))))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("draw"), F.coalesce(F.col(group).cast("string"), F.lit(""))))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
    times = sum(((u >= F.lit(bound)).cast("int") for bound in poisson_bounds()), F.lit(0))
    times = F.when(F.col("draw") < 0, F.lit(1)).otherwise(times)
    return spread.withColumn("_times", times).groupBy("draw").agg(*[F.sum(F.col(c) * F.col("_times")).alias(c) for c in columns])


def poisson_bounds() -> list[float]:
    """P(Poisson(1) <= k) for k = 0, 1, ... as far as 32 bits tell them apart."""
    bounds, term, total = [], math.exp(-1), 0.0
    for k in range(13):
        total += term
        bounds.append(total)
        term /= k + 1
    return bounds


def signed_rank_statistics(df: DataFrame, difference: str) -> tuple[int, float, float, int]:
    """(n, plus, ties, most) of the non-zero differences: their number, the rank
    sum of the positive ones, Σ(t³ - t) over ties and the largest tie.  Equal sizes
    are counted, then ranked by range; four sums reach the driver."""
    d = F.col(difference).cast("double")
    sizes = df.where(d.isNotNull() & ~F.isnan(d) & (d != 0)).select(F.abs(d).alias("_size"), (d > 0).cast("bigint").alias("_plus"))
    tied = sizes.groupBy("_size").agg(F.count("*").alias("_n"), F.sum("_plus").alias("_plus"))
    ranked = running_totals(tied, [], "_size", {"_upto": "_n"})
    rank, n = F.col("_upto") - (F.col("_n") - 1) / 2, F.col("_n").cast("double")
    row = ranked.agg(F.sum("_n").alias("n"), F.sum(rank * F.col("_plus")).alias("plus"), F.sum(n * n * n - n).alias("ties"), F.max("_n").alias("most")).collect()[0]
    return row["n"] or 0, row["plus"] or 0.0, row["ties"] or 0.0, row["most"] or 0


def signed_rank_p(n: int, plus: float, ties: float, most: int, exact: bool = True) -> float:
    """Two-sided signed-rank p-value: 1 with fewer than ten non-zero differences,
    the exact distribution up to 50 without ties, else the normal approximation
    with tie correction (no continuity correction), which is always taken where
    ``exact`` is false."""
    if n < 10:
        return 1.0
    if exact and n <= 50 and most == 1:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k].copy()
        least = int(min(plus, n * (n + 1) / 2 - plus))
        return float(min(1.0, 2 * ways[: least + 1].sum() / ways.sum()))
    variance = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    z = (plus - n * (n + 1) / 4) / math.sqrt(variance)
    return float(min(1.0, math.erfc(abs(z) / math.sqrt(2))))


def wilcoxon_p(diffs: np.ndarray) -> float:
    """``signed_rank_p`` of differences at hand (one per cluster, say)."""
    d = np.asarray(diffs, dtype=float)
    d = d[(d != 0) & ~np.isnan(d)]
    values, inverse, counts = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse] if len(d) else np.zeros(0)
    return signed_rank_p(len(d), float(rank[d > 0].sum()), float((counts.astype(float) ** 3 - counts).sum()), int(counts.max(initial=0)))
