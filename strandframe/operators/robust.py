"""Robust and standard scaling by group, log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.operators.ordered import exact_medians
from strandframe.operators.skew import follow_join
from strandframe.session import cut_lineage

#: Factor from median deviation to standard deviation, least scale.
MAD_FACTOR, LEAST_SCALE = 1.4826, 0.25


def centre(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """``out`` = value less the exact median of its group, from ranks; null values
    and groups give null."""
    df = cut_lineage(df)  # read for the medians and again for the join
    medians = exact_medians(df, group, value, "_m")
    return follow_join(df, medians, group, df.columns, "left").withColumn(out, F.col(value) - F.col("_m")).drop("_m")


def robust_z(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """``out`` = (value - median) / max(1.4826 · MAD, 0.25) within the group."""
    centred = cut_lineage(centre(df, group, value, "_d"))
    spread = exact_medians(centred.select(*group, F.abs("_d").alias("_a")), group, "_a", "_mad")
    scales = spread.select(*group, F.greatest(F.col("_mad") * MAD_FACTOR, F.lit(LEAST_SCALE)).alias("_s"))
    return follow_join(centred, scales, group, df.columns, "left").withColumn(out, F.col("_d") / F.col("_s")).drop("_d", "_s")


def standard_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, sd): population sd, 1 where it is below 1e-8."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.when(F.col(f"s_{c}") < 1e-8, 1.0).otherwise(F.col(f"s_{c}")).alias("sd")) for c in columns]))
    return stats.select(rows.alias("r")).select("r.*")


def log_sum_exp(values: Column) -> Column:
    """ln Σ exp(x) of an array, shifted by its maximum; null when empty."""
    top = F.array_max(values)
    return top + F.ln(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def normalise_logprobs(options: Column) -> Column:
    """map<string,double> of log-probabilities, scaled to sum to 1 in probability."""
    total = log_sum_exp(F.map_values(options))
    return F.transform_values(options, lambda _, v: v - total)


def log_odds(options: Column, positive: str, negative: str) -> Column:
    """Difference of two options' log-probabilities."""
    return F.try_element_at(options, F.lit(positive)) - F.try_element_at(options, F.lit(negative))


def collapse_logprobs(tokens: Column, options: list[str], floor: float = -30.0) -> Column:
    """struct<option: double..., truncated>: for each option the log-sum-exp of the
    listed tokens (struct token, logprob) that equal it when trimmed and in lower
    case; a missing option gets the least listed value, or ``floor``."""
    least = F.coalesce(F.array_min(F.transform(tokens, lambda t: t["logprob"])), F.lit(floor))

    def listed(option: str) -> Column:
        same = F.filter(tokens, lambda t: F.lower(F.trim(t["token"])) == option.strip().lower())
        return log_sum_exp(F.transform(same, lambda t: t["logprob"]))

    found = {o: listed(o) for o in options}
    missing = F.lit(False)
    for value in found.values():
        missing = missing | value.isNull()
    return F.struct(*[F.coalesce(v, least).alias(o) for o, v in found.items()], missing.alias("truncated"))


def logit(p: Column) -> Column:
    """Log-odds of a probability clipped at 1e-6."""
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.ln(q) - F.log1p(-q)


def expit(x: Column) -> Column:
    """Logistic function."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
