"""Ranking metrics, thresholds and variance components, exact."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.operators.ordered import exact_quantiles, running_totals
from strandframe.session import cut_lineage


def score_ties(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """Rows per (group, score) with ``n`` rows and ``pos`` positives; null and NaN
    scores and null labels are left out."""
    usable = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score)) & F.col(label).isNotNull())
    return usable.groupBy(*group, score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))


def midranks(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """(group, score, n, pos, midrank): the average rank of the rows of a score."""
    ties = score_ties(df, group, score, label)
    upto = running_totals(ties, group, score, {"upto": "n"})
    return upto.withColumn("midrank", F.col("upto") - (F.col("n") - 1) / 2).drop("upto")


def roc_auc(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """(group, n_pos, n_neg, auc): from midranks; null when a class is missing."""
    sums = midranks(df, group, score, label).groupBy(*group).agg(F.sum("pos").alias("n_pos"), F.sum(F.col("n") - F.col("pos")).alias("n_neg"), F.sum(F.col("midrank") * F.col("pos")).alias("_rank"))
    auc = (F.col("_rank") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg"))
    return sums.select(*group, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), auc).alias("auc"))


def average_precision(df: DataFrame, group: list[str], score: str, label: str, tie: str) -> DataFrame:
    """(group, n_pos, ap): mean over positives of the precision at their place,
    by score descending, then ``tie`` ascending (a total order).  Null without
    positives."""
    usable = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score)) & F.col(label).isNotNull())
    rows = usable.select(*group, score, tie, F.col(label).cast("int").alias("_y"), F.lit(1).alias("_one"))
    placed = running_totals(rows, group, score, {"_k": "_one", "_tp": "_y"}, descending=True, ties=[tie])
    return placed.groupBy(*group).agg(F.sum("_y").alias("n_pos"), F.avg(F.when(F.col("_y") == 1, F.col("_tp") / F.col("_k"))).alias("ap"))


def mcc(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Matthews correlation; 0 when a margin is empty."""
    d = tp.cast("double")
    root = F.sqrt((d + fp) * (d + fn) * (tn.cast("double") + fp) * (tn.cast("double") + fn))
    return F.when(root > 0, (d * tn - fp.cast("double") * fn) / root).otherwise(F.lit(0.0))


def threshold_grid(df: DataFrame, score: str) -> DataFrame:
    """(t): the distinct values, to six decimals, of the 99 percentiles of the
    score and of 0.05 to 0.95 by 0.05."""
    points = exact_quantiles(df, [], score, [i / 100 for i in range(1, 100)])
    fixed = F.array(*[F.lit(round(0.05 * i, 2)) for i in range(1, 20)])
    return points.select(F.explode(F.array_distinct(F.transform(F.concat("q", fixed), lambda t: F.round(t, 6)))).alias("t"))


def confusion_sweep(df: DataFrame, score: str, label: str) -> DataFrame:
    """(t, tp, fp, fn, tn, precision, recall, positive_rate, mcc) at each value of
    the grid, a row being positive when its score is at least ``t``.

    Scores are first counted per grid interval, so the grid (at most 118 values)
    meets as many sums, not the rows.
    """
    df = cut_lineage(df.select(score, label))  # read for the grid and again for the counts
    grid = [r["t"] for r in threshold_grid(df.where(F.col(score).isNotNull()), score).orderBy("t").collect()]
    usable = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    values = F.array(*[F.lit(t) for t in grid])
    cut = Bucketizer(splits=[float("-inf"), *grid, float("inf")], inputCol="_score", outputCol="_place", handleInvalid="keep") if grid else None
    scored = usable.withColumn("_score", F.col(score).cast("double"))
    placed = cut.transform(scored) if cut else scored.withColumn("_place", F.lit(0.0))
    counts = placed.groupBy(F.col("_place").cast("int").alias("place")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))
    total = Window.partitionBy()
    above = Window.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    slots = df.sparkSession.range(0, len(grid) + 1).select(F.col("id").cast("int").alias("place")).join(counts, "place", "left").fillna(0, ["n", "pos"])
    summed = slots.select("place", F.sum("pos").over(above).alias("tp"), F.sum(F.col("n") - F.col("pos")).over(above).alias("fp"), F.sum("pos").over(total).alias("all_pos"), F.sum("n").over(total).alias("all_n")).where("place > 0")
    full = summed.select(F.element_at(values, F.col("place")).alias("t"), "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"), (F.col("all_n") - F.col("all_pos") - F.col("fp")).alias("tn"))
    one = F.lit(1)
    return full.select("*", (F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one)).alias("precision"), (F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one)).alias("recall"), ((F.col("tp") + F.col("fp")) / F.greatest(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), one)).alias("positive_rate"), mcc(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")).alias("mcc"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row of the highest MCC; the smallest threshold among equals."""
    return sweep.orderBy(F.desc(F.round("mcc", 12)), "t").limit(1)


def icc_oneway(df: DataFrame, group: str, score: str) -> DataFrame:
    """(n_groups, between_var, within_var, icc) of groups with two rows or more:
    the unbalanced one-way estimate, the between variance not below 0; null with
    fewer than two groups."""
    per = df.where(F.col(score).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(score).alias("m"), F.coalesce(F.var_samp(score) * (F.count("*") - 1), F.lit(0.0)).alias("ss")).where("n >= 2")
    sums = per.agg(F.count("*").alias("k"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum("ss").alias("ssw"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"))
    msb = (F.col("nmm") - F.col("nm") * F.col("nm") / F.col("total")) / (F.col("k") - 1)
    msw = F.col("ssw") / (F.col("total") - F.col("k"))
    n0 = (F.col("total") - F.col("squares") / F.col("total")) / (F.col("k") - 1)
    enough = F.col("k") >= 2
    between = F.when(enough, F.greatest(F.lit(0.0), (msb - msw) / n0))
    within = F.when(enough, msw)
    return sums.select(F.col("k").alias("n_groups"), between.alias("between_var"), within.alias("within_var"), F.try_divide(between, between + within).alias("icc"))


def log_loss(df: DataFrame, group: list[str], p: str, y: str) -> DataFrame:
    """Mean binary cross-entropy; probabilities clipped at 1e-6."""
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(p)))
    return df.groupBy(*group).agg(F.avg(-(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.log1p(-q))).alias("log_loss"))


def evaluation_aggregate(df: DataFrame, group: list[str]) -> DataFrame:
    """Totals of per-video results (gt_num, pred_num, score_sum, score_iou_sum,
    iou_sum, n_pairs): precision Σs/5N, recall Σs/5M and F1, plain and weighted
    by IoU, and the mean IoU of the pairs; 0 where a denominator is 0."""
    sums = df.groupBy(*group).agg(*[F.sum(c).alias(c) for c in ("gt_num", "pred_num", "score_sum", "score_iou_sum", "iou_sum", "n_pairs")])

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    def f1(p: Column, r: Column) -> Column:
        return ratio(2 * p * r, p + r)

    p, r = ratio(F.col("score_sum"), 5 * F.col("pred_num")), ratio(F.col("score_sum"), 5 * F.col("gt_num"))
    pi, ri = ratio(F.col("score_iou_sum"), 5 * F.col("pred_num")), ratio(F.col("score_iou_sum"), 5 * F.col("gt_num"))
    return sums.select(*group, "pred_num", "gt_num", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), pi.alias("precision_iou"), ri.alias("recall_iou"), f1(pi, ri).alias("f1_iou"), ratio(F.col("iou_sum"), F.col("n_pairs")).alias("mean_iou"))


def f1_threshold(df: DataFrame, utility: str, estimate: str, tie: str, n_gt: int) -> DataFrame:
    """(threshold, n_emitted, f1): the prefix, by estimate descending then
    ``tie``, with the highest 2·Σu/(k+M); no row when nothing is positive.

    The prefix sums run over ranges of the estimate; the best prefix is one
    aggregate.
    """
    usable = df.select(F.col(utility).alias("_u"), estimate, tie, F.lit(1).alias("_one")).where(F.col(estimate).isNotNull())
    prefixes = running_totals(usable, [], estimate, {"k": "_one", "s": "_u"}, descending=True, ties=[tie])
    value = 2 * F.col("s") / (F.col("k") + F.lit(n_gt))
    best = prefixes.withColumn("f1", value).where("f1 > 0").agg(F.min(F.struct((-F.round("f1", 12)).alias("neg"), "k", estimate, "f1")).alias("b"))
    return best.where("b is not null").select(F.col(f"b.{estimate}").alias("threshold"), F.col("b.k").alias("n_emitted"), F.col("b.f1").alias("f1"))


def holm(df: DataFrame, name: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Step-down test of a small table of p-values: (name, p, rank, level,
    rejected); a hypothesis is rejected when it and all smaller ones pass."""
    order = Window.orderBy(p, name)
    ranked = df.select(name, p, F.row_number().over(order).alias("rank"), F.count("*").over(Window.partitionBy()).alias("_m"))
    level = F.lit(alpha) / (F.col("_m") - F.col("rank") + 1)
    passed = F.min((F.col(p) <= level).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.select(name, p, "rank", level.alias("level"), (passed == 1).alias("rejected"))
