"""Small models fitted from aggregates: each step is one pass over the rows."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.operators.resample import MAX_CLUSTERS
from strandframe.operators.robust import expit


@dataclass(frozen=True)
class LinearModel:
    """Weights on standardised features; ``constant`` models have none."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    sd: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float

    def predict(self) -> Column:
        """Probability as a column expression of literals."""
        score = F.lit(self.bias)
        for f, m, s, w in zip(self.features, self.mean, self.sd, self.weights, strict=True):
            score = score + (F.col(f) - F.lit(m)) / F.lit(s) * F.lit(w)
        return expit(score)


def _newton_sums(betas: dict[int, np.ndarray], scales: dict[int, tuple[np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gradient and Hessian of each model over the rows (model, target, features) of
    a partition, the features less their mean through their sd; rows that this
    makes NaN are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: (np.zeros(len(b)), np.zeros((len(b), len(b)))) for k, b in betas.items()}
        seen = set()
        for batch in batches:
            model, target, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for k in betas:
                own = model == k
                x = np.column_stack([*((c[own] - m) / s for c, m, s in zip(columns, *scales[k], strict=True)), np.ones(int(own.sum()))])
                told = ~np.isnan(x).any(axis=1)
                if told.any():
                    x, y = x[told], target[own][told]
                    p = 1 / (1 + np.exp(-np.clip(x @ betas[k], -40.0, 40.0)))
                    gradient, hessian = sums[k]
                    gradient += x.T @ (p - y)
                    hessian += (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x
                    seen.add(k)
        if seen:
            yield pa.RecordBatch.from_pydict({"model": pa.array(sorted(seen), pa.int32()), "gradient": [sums[k][0].tolist() for k in sorted(seen)], "hessian": [sums[k][1].ravel().tolist() for k in sorted(seen)]})

    return run


def _fit_each(df: DataFrame, model: str, scales: dict[int, tuple[list[float], list[float]]], features: list[str], target: str, ridge: float, steps: int = 100, tolerance: float = 1e-10) -> dict[int, np.ndarray]:
    """Weights and, last, intercept of the ridge logistic model of each value of
    ``model`` (int): Newton's method, the steps of all models side by side.  A step
    is one pass that sums in Arrow batches; a gradient and a Hessian (d² numbers) of
    each partition and model reach the driver."""
    d = len(features)
    named = df.select(F.col(model).cast("int").alias("_m"), F.col(target).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(features)])
    usable = named.where(F.col("_m").isin(list(scales))).dropna().persist()
    scales = {k: tuple(np.array(v, dtype=float) for v in both) for k, both in scales.items()}
    betas = {k: np.zeros(d + 1) for k in scales}
    penalty, open_ = np.diag([ridge] * d + [0.0]), set(scales)
    try:
        for _ in range(steps):
            if not open_:
                break
            now = {k: betas[k] for k in sorted(open_)}
            rows = usable.mapInArrow(_newton_sums(now, scales), "model int, gradient array<double>, hessian array<double>").collect()
            for k in now:
                own = [r for r in rows if r["model"] == k]
                if not own:
                    open_.discard(k)
                    continue
                gradient = np.sum([r["gradient"] for r in own], axis=0) + penalty @ betas[k]
                hessian = np.sum([r["hessian"] for r in own], axis=0).reshape(d + 1, d + 1)
                move = np.linalg.solve(hessian + penalty + 1e-12 * np.eye(d + 1), gradient)
                betas[k] = betas[k] - move
                if np.abs(move).max() < tolerance:
                    open_.discard(k)
    finally:
        usable.unpersist()
    return betas


def fit_logistic(df: DataFrame, features: list[str], target: str, ridge: float = 1.0, steps: int = 100, tolerance: float = 1e-10) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic model with targets in [0, 1].

    The intercept is not penalised.  Rows with a null or NaN feature or target are
    left out.
    """
    d = len(features)
    beta = _fit_each(df.select("*", F.lit(0).alias("_model")), "_model", {0: ([0.0] * d, [1.0] * d)}, features, target, ridge, steps, tolerance)[0]
    return beta[:d], float(beta[d])


def fit_utilities(df: DataFrame, model: str, features: list[str], target: str, ridge: float = 1.0, least_rows: int = 5) -> dict[int, LinearModel]:
    """Of each value of ``model`` (int) a logistic model of its rows, on features
    scaled to mean 0 and sd 1 (1 where it is below 1e-8); with fewer than
    ``least_rows`` targets or a constant one, a model of the mean alone."""
    moments = [f(c).alias(f"{name}{i}") for i, c in enumerate(features) for name, f in (("m", F.avg), ("s", F.stddev_pop))]
    stats = {r[0]: r for r in df.groupBy(model).agg(F.count(target).alias("n"), F.avg(target).alias("mean"), F.min(target).alias("a"), F.max(target).alias("b"), *moments).collect()}
    scales = {k: ([r[f"m{i}"] for i in range(len(features))], [1.0 if r[f"s{i}"] is not None and r[f"s{i}"] < 1e-8 else r[f"s{i}"] for i in range(len(features))]) for k, r in stats.items() if r["n"] >= least_rows and r["a"] != r["b"]}
    betas = _fit_each(df, model, scales, features, target, ridge) if scales else {}
    out = {}
    for k, r in stats.items():
        if k in betas:
            out[k] = LinearModel(tuple(features), *(tuple(v) for v in scales[k]), tuple(float(w) for w in betas[k][:-1]), float(betas[k][-1]))
        else:
            out[k] = mean_model(r["mean"])
    return out


def mean_model(mean: float | None) -> LinearModel:
    """A model without features, of a mean kept off 0 and 1."""
    mean = min(max(mean if mean is not None else 0.0, 1e-6), 1 - 1e-6)
    return LinearModel((), (), (), (), float(np.log(mean / (1 - mean))))


def fit_utility(df: DataFrame, features: list[str], target: str, ridge: float = 1.0, least_rows: int = 5) -> LinearModel:
    """As ``fit_utilities``, one model of all rows."""
    return fit_utilities(df.select("*", F.lit(0).alias("_model")), "_model", features, target, ridge, least_rows).get(0) or mean_model(None)


def group_folds(groups: list[str], folds: int, seed: int) -> dict[str, int]:
    """Fold of each group: the sorted distinct groups, shuffled, dealt in turn."""
    names = sorted(set(groups))
    k = max(2, min(folds, len(names)))
    random.Random(seed).shuffle(names)
    return {name: i % k for i, name in enumerate(names)}


def cross_fit(df: DataFrame, group: str, features: list[str], target: str, folds: int = 5, seed: int = 0, ridge: float = 1.0, out: str = "oof") -> DataFrame:
    """``df`` with the prediction of a model fitted on the other folds of groups.
    The group names (clusters such as games, at most MAX_CLUSTERS) are read to the
    driver and broadcast with their folds."""
    names = [r[0] for r in df.select(group).where(F.col(group).isNotNull()).distinct().limit(MAX_CLUSTERS + 1).collect()]
    if len(names) > MAX_CLUSTERS:
        raise ValueError(f"at most {MAX_CLUSTERS} groups can be dealt to folds")
    fold_of = group_folds(names, folds, seed)
    spark = df.sparkSession
    keyed = df.join(F.broadcast(spark.createDataFrame(list(fold_of.items()), f"`{group}` string, _fold int")), group)
    dealt = sorted(set(fold_of.values()))
    others = F.array_except(F.array(*[F.lit(fold) for fold in dealt]), F.array("_fold"))
    models = fit_utilities(keyed.select(*dict.fromkeys([*features, target]), F.explode(others).alias("_model")), "_model", features, target, ridge) if dealt else {}
    value = F.lit(None).cast("double")
    for fold in dealt:
        value = F.when(F.col("_fold") == fold, (models.get(fold) or mean_model(None)).predict()).otherwise(value)
    return keyed.withColumn(out, value).drop("_fold")
