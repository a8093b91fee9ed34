"""Queries on fitted, searched and assigned results: checked by brute force in the
tests where SQL cannot state them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.functions.text import extract_json, number_grid, parse_rating, repair_json
from strandframe.operators.assign import assign_within, assignment_check
from strandframe.operators.intervals import named_spans, union_spans
from strandframe.operators.metrics import average_precision, best_threshold, confusion_sweep, log_loss
from strandframe.operators.models import cross_fit, fit_utility, group_folds
from strandframe.operators.ranking import arg_max
from strandframe.operators.resample import DRAWS, cluster_bootstrap_auc, pair_counts, poisson_bootstrap, poisson_bounds, signed_rank_p, signed_rank_statistics
from strandframe.operators.robust import logit
from strandframe.operators.search import ground_event
from strandframe.plans.evidence import _PROBABLE, _WINDOWS, _probable, windows
from strandframe.plans.hypotheses import Settings, choose_segmentation, degenerate_reasons, segmentation_cells
from strandframe.plans.pipeline import evaluate, generic_evidence, resolve_events, screened_probabilities
from strandframe.session import cut_lineage
from strandframe.sources.tables import table

CLUSTERS = 12
RATE_DRAWS = DRAWS
GRID_LEVELS, GRID_PENALTIES = [-1.0, -0.5, 0.0, 0.25, 0.5, 1.0, 1.5], [0.0, 0.25, 0.5, 1.0, 2.0, 4.0]
GAMMAS = "0.5, 0.75, 1, 1.5, 2"


def _clustered(spark: SparkSession, folder: str) -> DataFrame:
    cluster = F.concat(F.lit("c"), F.pmod("user_id", F.lit(CLUSTERS)).cast("string"))
    return windows(spark, folder).select("user_id", "idx", cluster.alias("cluster"), "score", F.col("n_events").cast("double").alias("n_events"), F.col("label").cast("double").alias("y"))


def _one(spark: SparkSession, row: dict, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(row.values())], schema)


def fusion_fit(spark, folder):
    """Weights of the standardised logistic model of the window label."""
    model = fit_utility(_clustered(spark, folder), ["score", "n_events"], "y")
    return spark.createDataFrame([*zip(model.features, model.weights, strict=True), ("bias", model.bias)], "feature string, weight double")


def cross_fitted(spark, folder):
    """Out-of-fold probability of each window, folds by cluster."""
    return cross_fit(_clustered(spark, folder), "cluster", ["score", "n_events"], "y", folds=4).select("user_id", "idx", "oof")


def bootstrap_auc(spark, folder):
    """Pooled AUC with its interval over clusters."""
    out = cluster_bootstrap_auc(pair_counts(_clustered(spark, folder), "cluster", "score", "y"), seed=7)
    return _one(spark, out, "auc double, low double, high double, pct_low double, pct_high double")


def bootstrap_rate(spark, folder):
    """Share of positive windows with its interval over users."""
    drawn = poisson_bootstrap(windows(spark, folder).withColumn("one", F.lit(1)), "user_id", ["label", "one"], RATE_DRAWS, 7)
    rate = F.try_divide("label", "one")
    ends = F.percentile(F.when(F.col("draw") >= 0, rate), F.array(F.lit(0.025), F.lit(0.975)))  # of the draws, whose number is fixed
    return drawn.agg(F.max(F.when(F.col("draw") < 0, rate)).alias("rate"), ends.alias("q")).select(F.round("rate", 9).alias("rate"), F.round(F.get("q", F.lit(0)), 9).alias("low"), F.round(F.get("q", F.lit(1)), 9).alias("high"))


def signed_rank(spark, folder):
    """Signed-rank p-value of users' mean scores in even and odd windows."""
    w = windows(spark, folder)
    rows = w.groupBy("user_id").agg(F.avg(F.when(F.col("idx") % 2 == 0, F.col("score"))).alias("a"), F.avg(F.when(F.col("idx") % 2 == 1, F.col("score"))).alias("b")).where("a is not null and b is not null")
    sums = signed_rank_statistics(rows.select(F.round(F.col("a") - F.col("b"), 6).alias("d")), "d")
    return _one(spark, {"n": sums[0], "plus": round(sums[1], 6), "ties": sums[2], "p": round(signed_rank_p(*sums, exact=False), 6)}, "n bigint, plus double, ties double, p double")


def _ratings(spark, folder):
    events = table(spark, folder, "events", "event_id", "user_id", "event_type", "value")
    order = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    placed = events.where("event_type in ('error', 'purchase')").withColumn("k", order - 1)
    g = placed.where("event_type = 'error'").select("user_id", F.col("k").alias("gt_pos"), F.col("value").alias("v"))
    p = placed.where("event_type = 'purchase'").select("user_id", F.col("k").alias("pred_pos"), F.col("value").alias("u"))
    return g.join(p, "user_id").select(F.col("user_id").alias("vid"), "gt_pos", "pred_pos", F.greatest(F.lit(0), 5 - F.floor(F.abs(F.col("v") - F.col("u")) / 4)).cast("int").alias("rating"))


def assignment_totals(spark, folder):
    """Pairs of a best one-to-one matching of each user's events by rating, and
    whether no exchange of partners is better."""
    ratings = cut_lineage(_ratings(spark, folder))
    pairs = cut_lineage(assign_within(ratings, "vid", "gt_pos", "pred_pos", "rating"))
    best = assignment_check(ratings, pairs, "vid", "gt_pos", "pred_pos", "rating")
    return pairs.groupBy("vid").agg(F.count("*").alias("n_pairs")).join(best, "vid")


def fusion_gradient(spark, folder):
    """Whether the fitted weights are where the gradient of the penalised likelihood
    is zero, by feature."""
    rows = _clustered(spark, folder)
    model = fit_utility(rows, ["score", "n_events"], "y")
    missed = model.predict() - F.col("y")
    scaled = {f: (F.col(f) - F.lit(m)) / F.lit(s) for f, m, s in zip(model.features, model.mean, model.sd, strict=True)} | {"bias": F.lit(1.0)}
    sums = rows.agg(*[F.sum(missed * x).alias(f) for f, x in scaled.items()]).collect()[0]
    penalty = dict(zip(model.features, model.weights, strict=True))
    return spark.createDataFrame([(f, abs(sums[f] + penalty.get(f, 0.0)) < 1e-6) for f in scaled], "feature string, flat boolean")


def video_results(spark, folder):
    """Evaluation of each record's spans shifted by a quarter second."""
    records = table(spark, folder, "records", "rec_id", "time_nodes").where("time_nodes is not null")
    entries = records.select(F.col("rec_id").alias("vid"), F.posexplode("time_nodes").alias("pos", "s")).where("size(s) > 0")
    truth = entries.select("vid", "pos", union_spans(named_spans(F.col("s"), "start_s", "end_s")).alias("spans"))
    moved = truth.select("vid", "pos", F.transform("spans", lambda x: F.struct((x["start"] + 0.25).alias("start"), (x["end"] + 0.25).alias("end"))).alias("spans"))
    ratings = truth.select("vid", F.col("pos").alias("gt_pos")).join(moved.select("vid", F.col("pos").alias("pred_pos")), "vid").withColumn("rating", F.when(F.col("gt_pos") == F.col("pred_pos"), 5).otherwise(1))
    return evaluate(moved, truth, ratings).select("vid", "gt_num", "pred_num", "score_sum", "n_pairs")


def evidence_table(spark, folder):
    """Scores less a baseline, with their robust z."""
    scores = windows(spark, folder).select(F.col("user_id").cast("string").alias("vid"), "idx", F.col("score").alias("lo_raw"))
    baseline = scores.groupBy("vid").agg(F.min("lo_raw").alias("lo_cf"))
    return generic_evidence(scores, baseline).select("vid", "idx", F.round("lo_abs", 6).alias("lo_abs"), F.round("rel_z", 6).alias("rel_z"))


def two_stage(spark, folder):
    """Second-stage probabilities where screened, first-stage ones elsewhere."""
    w = _probable(spark, folder)
    rows = w.select(F.col("user_id").alias("vid"), "idx", F.round("score", 6).alias("lo_raw"), F.col("p").alias("p1"), F.round(F.sqrt("p"), 6).alias("p2"))
    return screened_probabilities(rows, 3)


def temperature(spark, folder):
    """Log loss of the probabilities sharpened by each of a grid of factors."""
    grid = spark.range(1).select(F.explode(number_grid(F.lit(GAMMAS))).alias("gamma"))
    w = _probable(spark, folder).select("label", F.explode(F.array(*[F.lit(float(g)) for g in GAMMAS.split(",")])).alias("gamma"), logit(F.col("p")).alias("lo"))
    scored = w.withColumn("q", 1 / (1 + F.exp(-F.col("gamma") * F.col("lo"))))
    losses = log_loss(scored, ["gamma"], "q", "label")
    return losses.join(F.broadcast(grid), "gamma").select("gamma", F.round("log_loss", 6).alias("log_loss"))


def best_temperature(spark, folder):
    """The factor of least log loss, the one nearest 1 among equals."""
    losses = temperature(spark, folder).select(F.lit(1).alias("g"), "gamma", (-F.col("log_loss")).alias("gain"), F.abs(F.col("gamma") - 1).alias("far"))
    return arg_max(losses, ["g"], "gain", "far", ["far", "gamma"]).select("gamma")


def segmentation_grid(spark, folder):
    """Mean IoU of each level and penalty against the runs of error windows."""
    w = windows(spark, folder)
    vid = F.col("user_id").alias("vid")
    profiles = w.groupBy(vid).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", ((F.col("score") - 20) / 5).alias("x")))), lambda s: s["x"]).alias("profile"))
    places = w.select(vid, "idx", "label", F.col("idx").cast("double").alias("start_s"), (F.col("idx") + 1).cast("double").alias("end_s"), F.lit(None).cast("array<double>").alias("frame_times"))
    truth = places.where("label = 1").groupBy("vid").agg(union_spans(F.collect_list(F.struct(F.col("start_s").alias("start"), F.col("end_s").alias("end")))).alias("g_spans"))
    game = F.concat(F.lit("c"), F.col("vid") % CLUSTERS)
    correct = profiles.join(truth, "vid").select("vid", F.lit("e").alias("event"), game.alias("game"), "profile", F.array().cast("array<int>").alias("members"), "g_spans")
    lengths = places.select("vid", F.lit(None).cast("double").alias("duration")).distinct()
    cells = segmentation_cells(correct, places, lengths, GRID_LEVELS, GRID_PENALTIES, Settings())
    folds = group_folds([f"c{i}" for i in range(CLUSTERS)], 5, 0)
    table_, held = choose_segmentation(cells, folds)
    return spark.createDataFrame([(x, p, m, held) for x, p, m in table_], "level double, penalty double, mean_iou double, held_out_iou double")


def grounded_events(spark, folder):
    """Runs grown from each user's highest window over the error windows."""
    rows = windows(spark, folder).select("user_id", "idx", "label")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        marked = set(pdf.loc[pdf["label"] == 1, "idx"])
        runs = ground_event(marked.__contains__, sorted(marked), int(pdf["idx"].max()) + 1, gap=1)
        return pd.DataFrame([(pdf["user_id"].iloc[0], a, b) for a, b in runs], columns=["user_id", "first", "last"])

    return rows.groupBy("user_id").applyInPandas(run, "user_id bigint, first int, last int")


def resolved_events(spark, folder):
    """Events of a user from claims on its observations, the rest by words."""
    events = table(spark, folder, "events", "event_id", "user_id", "event_type", "value")
    seen = events.where("event_type in ('error', 'signup')").select(F.col("user_id").alias("vid"), F.col("event_id").alias("obs_id"), F.pmod("event_id", F.lit(9)).cast("int").alias("idx"), F.concat(F.lit("the "), "event_type", F.lit(" box")).alias("entity"), F.lit("Float").alias("kind"))
    named = (F.col("obs_id") % 3 == 0) & (F.col("obs_id") % 7 != 0)
    claims = seen.select("vid", (F.col("obs_id") % 2).cast("int").alias("event"), F.when(named, F.col("obs_id").cast("string")).otherwise("none").alias("obs"))
    return resolve_events(seen, claims.unionByName(claims.withColumn("event", F.col("event") + 1))).groupBy("vid", "event").agg(F.count("*").alias("n"))


def model_json(spark, folder):
    """JSON objects found in the documents, as they are or repaired."""
    found = table(spark, folder, "documents", "doc_id", "text").select("doc_id", extract_json(F.col("text")).alias("json")).where("json is not null")
    return found.select("doc_id", F.get_json_object("json", "$.no_bugs").alias("no_bugs"), F.length("json").alias("n_chars"))


def repaired_props(spark, folder):
    """Key of the events' properties, read from a spoilt form of the JSON."""
    spoilt = F.concat(F.translate(F.rtrim("props"), '"}', "'"), F.lit(", 'ok': True,}"))
    parsed = table(spark, folder, "events", "event_id", "props").select("event_id", repair_json(spoilt).alias("j"))
    return parsed.select("event_id", F.get_json_object("j", "$.k").cast("bigint").alias("k"), F.get_json_object("j", "$.ok").alias("ok"))


def parsed_ratings(spark, folder):
    """Ratings read from answers made of the events' properties."""
    answer = F.when(F.col("event_id") % 5 == 0, F.lit("no answer")).otherwise(F.concat(F.lit("Sure: "), F.regexp_replace("props", '"k"', '"rating"'), F.lit(" done")))
    rated = table(spark, folder, "events", "event_id", "props").select("event_id", parse_rating(answer).alias("r"))
    return rated.select("event_id", "r.rating", "r.failed")


def signal_gate(spark, folder):
    """Reasons against the score as a signal: its AUC over clusters, and correlation
    and rate of the best threshold."""
    auc = bootstrap_auc(spark, folder).collect()[0]
    best = best_threshold(confusion_sweep(_probable(spark, folder), "p", "label")).select("mcc", "positive_rate", ((F.col("tp") + F.col("fn")) / (F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn"))).alias("base")).collect()[0]
    reasons = degenerate_reasons(auc["low"], best["mcc"], best["positive_rate"], best["base"])
    return spark.createDataFrame([(len(reasons), "; ".join(reasons))], "n_reasons int, reasons string")


def fitted_precision(spark, folder):
    """Average precision of the fitted probabilities by cluster."""
    held = cross_fit(_clustered(spark, folder), "cluster", ["score", "n_events"], "y", folds=4)
    return average_precision(held.withColumn("k", F.col("user_id") * 1000 + F.col("idx")), ["cluster"], "oof", "y", "k")


QUERIES = {f.__name__: f for f in (fusion_fit, fusion_gradient, cross_fitted, bootstrap_auc, bootstrap_rate, signed_rank, assignment_totals, video_results, evidence_table, two_stage, temperature, best_temperature, segmentation_grid, grounded_events, resolved_events, model_json, repaired_props, parsed_ratings, signal_gate, fitted_precision)}

_TEMPERATURE = f"""{_PROBABLE}, g as (select unnest([{GAMMAS}]) as gamma), q as (select cast(gamma as double) as gamma, label, 1 / (1 + exp(-gamma * (ln(p) - ln(1 - p)))) as q from p, g),
l as (select gamma, round(avg(-(label * ln(greatest(1e-6, least(1 - 1e-6, q))) + (1 - label) * ln(1 - greatest(1e-6, least(1 - 1e-6, q))))), 6) as log_loss from q group by gamma)"""

_DRAWN = f"""{_WINDOWS}, g as (select user_id, cast(sum(label) as double) as y, cast(count(*) as double) as n from w group by 1),
d as (select y, n, i as draw, ('0x' || substr(md5('7:' || i || ':' || user_id), 1, 8))::bigint / 4294967296.0 as u from g, (select unnest(range(0, {RATE_DRAWS})) as i)),
r as (select draw, sum(y * t) / sum(n * t) as rate from (select *, {" + ".join(f"cast(u >= {b!r} as int)" for b in poisson_bounds())} as t from d) group by draw)"""

ORACLES = {
    "assignment_totals": """with g as (select user_id as vid, count(*) filter (where event_type = 'error') as a, count(*) filter (where event_type = 'purchase') as b from events group by 1)
select vid, least(a, b) as n_pairs, true as best from g where a > 0 and b > 0""",
    "fusion_gradient": "select unnest(['score', 'n_events', 'bias']) as feature, true as flat",
    "video_results": """with e as (select rec_id as vid, unnest(time_nodes) as s from records where time_nodes is not null), n as (select vid, count(*) as n from e where len(s) > 0 group by 1)
select vid, n as gt_num, n as pred_num, 5.0 * n as score_sum, n as n_pairs from n""",
    "bootstrap_rate": f"with {_DRAWN} select round((select sum(y) / sum(n) from g), 9) as rate, round(quantile_cont(rate, 0.025), 9) as low, round(quantile_cont(rate, 0.975), 9) as high from r",
    "signed_rank": f"""with {_WINDOWS}, m as (select user_id, avg(score) filter (where idx % 2 = 0) as a, avg(score) filter (where idx % 2 = 1) as b from w group by 1),
d as (select round(a - b, 6) as d from m where a is not null and b is not null and round(a - b, 6) <> 0),
r as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0 as k, count(*) over (partition by abs(d)) as t from d),
s as (select count(*) as n, sum(k) filter (where d > 0) as plus, cast(sum(t * t - 1) as double) as ties from r),
z as (select *, abs(plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48) / sqrt(2.0) as x from s),
e as (select *, 1 / (1 + x / 2) as t from z)
select n, round(plus, 6) as plus, ties, case when n < 10 then 1.0 else round(least(1.0, t * exp(-x * x - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277)))))))))), 6) end as p from e""",
    "evidence_table": f"""with {_WINDOWS}, b as (select cast(user_id as varchar) as vid, idx, score, min(score) over (partition by user_id) as cf from w),
a as (select vid, idx, score - cf as x from b), m as (select vid, median(x) as m from a group by vid), d as (select a.vid, idx, x, x - m as d from a join m on a.vid = m.vid), s as (select vid, greatest(median(abs(d)) * 1.4826, 0.25) as s from d group by vid)
select d.vid, idx, round(x, 6) as lo_abs, round(d / s, 6) as rel_z from d join s on d.vid = s.vid""",
    "two_stage": f"with {_PROBABLE} select user_id as vid, idx, case when row_number() over (partition by user_id order by round(score, 6) desc, idx) <= 3 then round(sqrt(p), 6) else p end as p from p",
    "temperature": f"with {_TEMPERATURE} select gamma, log_loss from l",
    "best_temperature": f"with {_TEMPERATURE} select gamma from l order by log_loss, abs(gamma - 1) limit 1",
    "grounded_events": f"""with {_WINDOWS}, e as (select user_id, idx from w where label = 1), b as (select user_id, idx, case when idx - lag(idx) over (partition by user_id order by idx) <= 2 then 0 else 1 end as n from e),
k as (select *, sum(n) over (partition by user_id order by idx rows unbounded preceding) as g from b) select user_id, min(idx) as first, max(idx) as last from k group by user_id, g""",
    "resolved_events": """with s as (select user_id as vid, event_id as o, event_type as t from events where event_type in ('error', 'signup'))
select vid, case when o % 3 = 0 and o % 7 <> 0 then 'm' || (o % 2) else 'f|box ' || t || '|float' end as event, count(*) as n from s group by 1, 2""",
    "repaired_props": "select event_id, cast(json_extract(props, '$.k') as bigint) as k, 'true' as ok from events",
    "parsed_ratings": "select event_id, case when event_id % 5 = 0 then 0 else cast(json_extract(props, '$.k') as int) end as rating, event_id % 5 = 0 as failed from events",
}
