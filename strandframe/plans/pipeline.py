"""Composite plans: evidence, events, evaluation and comparison.

Model outputs come as tables (scores, texts, ratings); nothing here calls a model.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions.text import token_key
from strandframe.operators.assign import assign_within
from strandframe.operators.intervals import temporal_iou
from strandframe.operators.metrics import evaluation_aggregate, icc_oneway, roc_auc
from strandframe.operators.ordered import exact_medians
from strandframe.operators.ranking import top_k
from strandframe.operators.resample import DRAWS, paired_bootstrap, permutation_p, signed_rank_p, signed_rank_statistics, sums_by_group
from strandframe.operators.robust import robust_z
from strandframe.session import cut_lineage


def generic_evidence(scores: DataFrame, baseline: DataFrame) -> DataFrame:
    """(vid, idx, lo_raw, lo_abs, rel_z): scores less the video's content-free
    baseline (vid, lo_cf; 0 where missing), and their robust z."""
    joined = scores.join(baseline, "vid", "left").withColumn("lo_abs", F.col("lo_raw") - F.coalesce("lo_cf", F.lit(0.0)))
    return robust_z(joined, ["vid"], "lo_abs", "rel_z").select("vid", "idx", "lo_raw", "lo_abs", "rel_z")


def resolve_events(observations: DataFrame, claims: DataFrame) -> DataFrame:
    """Events of a video from a model's grouping and a fall-back by words.

    ``observations``: vid, obs_id, idx, entity, kind; ``claims``: vid, event, obs
    (text).  A claim counts when it is an integer, names an observation of the
    video and no earlier event has it; unclaimed observations are grouped by their
    entity's word set and kind.  Result: vid, event (text), obs_id, idx.
    """
    valid = claims.select("vid", "event", F.col("obs").try_cast("bigint").alias("obs_id")).where("obs_id is not null")
    first = valid.groupBy("vid", "obs_id").agg(F.min("event").alias("event"))
    claimed = observations.join(first, ["vid", "obs_id"]).select("vid", F.concat(F.lit("m"), F.col("event").cast("string")).alias("event"), "obs_id", "idx")
    rest = observations.join(first, ["vid", "obs_id"], "left_anti")
    named = rest.select("vid", F.concat_ws("|", F.lit("f"), token_key(F.col("entity")), F.lower("kind")).alias("event"), "obs_id", "idx")
    return claimed.unionByName(named)


def rank_hypotheses(events: DataFrame, evidence: DataFrame, most: int) -> DataFrame:
    """(vid, event, members, support, peak, rank): events by distinct windows, then
    highest z, then first window; the first ``most`` of each video."""
    joined = events.select("vid", "event", "idx").distinct().join(evidence, ["vid", "idx"])
    sums = joined.groupBy("vid", "event").agg(F.count("*").alias("support"), F.max("rel_z").alias("peak"), F.min("idx").alias("first_idx"), F.sort_array(F.collect_list("idx")).alias("members"))
    w = Window.partitionBy("vid").orderBy(F.desc("support"), F.desc("peak"), "first_idx", "event")
    return sums.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("first_idx")


def verified_profiles(hypotheses: DataFrame, scores: DataFrame, prior: DataFrame) -> DataFrame:
    """(vid, event, profile): each window's score under the hypothesis (vid, event,
    idx, lo) less the hypothesis' prior (vid, event, lo_prior)."""
    rows = scores.join(hypotheses.select("vid", "event"), ["vid", "event"], "left_semi").join(prior, ["vid", "event"], "left")
    return rows.groupBy("vid", "event").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", (F.col("lo") - F.coalesce("lo_prior", F.lit(0.0))).alias("x")))), lambda s: s["x"]).alias("profile"))


def evaluate(predictions: DataFrame, truth: DataFrame, ratings: DataFrame) -> DataFrame:
    """Per video: gt_num, pred_num, score_sum, score_iou_sum, iou_sum, n_pairs.

    ``predictions`` and ``truth``: vid, pos, spans (merged); ``ratings``: vid,
    gt_pos, pred_pos, rating.  Bugs are matched one to one by the greatest sum of
    ratings; the IoU is taken of the matched pairs."""
    pairs = assign_within(ratings, "vid", "gt_pos", "pred_pos", "rating")
    p = predictions.select("vid", F.col("pos").alias("pred_pos"), F.col("spans").alias("p_spans"))
    g = truth.select("vid", F.col("pos").alias("gt_pos"), F.col("spans").alias("g_spans"))
    rated = pairs.join(p, ["vid", "pred_pos"]).join(g, ["vid", "gt_pos"]).select("vid", "rating", temporal_iou(F.col("g_spans"), F.col("p_spans")).alias("iou"))
    sums = rated.groupBy("vid").agg(F.sum("rating").alias("score_sum"), F.sum(F.col("rating") * F.col("iou")).alias("score_iou_sum"), F.sum("iou").alias("iou_sum"), F.count("*").alias("n_pairs"))
    sizes = truth.groupBy("vid").agg(F.count("*").alias("gt_num")).join(predictions.groupBy("vid").agg(F.count("*").alias("pred_num")), "vid", "full").join(sums, "vid", "left")
    return sizes.fillna(0, ["gt_num", "pred_num", "score_sum", "score_iou_sum", "iou_sum", "n_pairs"])


def compare_methods(results: DataFrame, method: str, cluster: str, draws: int = DRAWS, seed: int = 0) -> list[dict]:
    """Per method after the first: difference of F1, interval over clusters,
    permutation and signed-rank p-values.  Sums per cluster (at most MAX_CLUSTERS)
    reach the driver; the videos are ranked in the cluster."""
    columns = ["score_sum", "pred_num", "gt_num"]
    names = [r[0] for r in results.select(method).distinct().orderBy(method).collect()]

    def f1(s: np.ndarray) -> np.ndarray:
        return 2 * s[..., 0] / np.maximum(5 * (s[..., 1] + s[..., 2]), 1e-12)

    def per_video(name: str, out: str) -> DataFrame:
        sums = results.where(F.col(method) == name).groupBy("vid").agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in columns])
        return sums.select("vid", (2 * F.col("score_sum") / F.greatest(5 * (F.col("pred_num") + F.col("gt_num")), F.lit(1e-12))).alias(out))

    out = []
    for other in names[1:]:
        (ka, a), (kb, b) = (sums_by_group(results.where(F.col(method) == name), cluster, columns) for name in (names[0], other))
        both = cut_lineage(per_video(names[0], "x").join(per_video(other, "y"), "vid", "full"))
        if ka != kb or both.where("x is null or y is null").limit(1).count():
            raise ValueError("the methods do not cover the same videos")
        delta, low, high = paired_bootstrap(b, a, f1, draws, seed)
        ranks = signed_rank_statistics(both.select((F.col("y") - F.col("x")).alias("d")), "d")
        out.append({"method": other, "delta": delta, "low": low, "high": high, "p_permutation": permutation_p(f1(b) - f1(a), draws, seed), "p_signed_rank": signed_rank_p(*ranks)})
    return out


def signal_summary(scored: DataFrame, group: str, score: str, label: str) -> dict:
    """Pooled and median per-group AUC and the intraclass correlation of a signal."""
    pooled = roc_auc(scored, [], score, label).collect()
    per = exact_medians(roc_auc(scored, [group], score, label), [], "auc", "m").collect()
    icc = icc_oneway(scored, group, score).collect()
    return {"pooled_auc": pooled[0]["auc"] if pooled else None, "median_auc": per[0]["m"] if per else None, "icc": icc[0]["icc"]}


def screened_probabilities(evidence: DataFrame, budget: int) -> DataFrame:
    """(vid, idx, p): second-stage probabilities where a window is among the
    ``budget`` best of its video, the first-stage ones elsewhere.  ``evidence``:
    vid, idx, lo_raw, p1, p2."""
    kept = top_k(evidence, ["vid"], budget, [F.desc("lo_raw"), F.col("idx")]).select("vid", "idx", F.lit(True).alias("_kept"))
    return evidence.join(kept, ["vid", "idx"], "left").select("vid", "idx", F.when(F.col("_kept") & F.col("p2").isNotNull(), F.col("p2")).otherwise(F.col("p1")).alias("p"))


def method_table(results: DataFrame, method: str) -> DataFrame:
    """Evaluation totals of each method over the videos that all methods cover."""
    n = results.select(method).distinct().count()
    whole = results.groupBy("vid").agg(F.countDistinct(method).alias("n")).where(F.col("n") == n).select("vid")
    return evaluation_aggregate(results.join(whole, "vid", "left_semi"), [method])
