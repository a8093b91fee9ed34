"""Queries on scored windows: scaling, ranking metrics, thresholds, resampling.

Events stand for scored frames: a user is a video, eight events in a row are a
window, its score is the mean value, and it is positive when it holds an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.operators.metrics import average_precision, best_threshold, confusion_sweep, evaluation_aggregate, f1_threshold, holm, icc_oneway, log_loss, midranks, roc_auc
from strandframe.operators.ranking import arg_max, stratified_limit, top_events, top_k
from strandframe.operators.resample import exact_permutation
from strandframe.operators.robust import centre, collapse_logprobs, log_odds, logit, normalise_logprobs, robust_z, standard_stats
from strandframe.operators.sequence import count_windows
from strandframe.session import cut_lineage
from strandframe.sources.tables import table

CLUSTERS = 12
WEIGHTS = {"score": 0.08, "n_events": -0.05}
BIAS = -1.0


def windows(spark: SparkSession, folder: str) -> DataFrame:
    """user_id, idx, score, label, n_events, start_s, end_s of each window."""
    events = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value")
    numbered = count_windows(events, ["user_id"], ["ts", "event_id"], position=F.unix_micros(F.col("ts").cast("timestamp")))
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return numbered.groupBy("user_id", "idx").agg(F.avg("value").alias("score"), F.max((F.col("event_type") == "error").cast("int")).alias("label"), F.count("*").alias("n_events"), F.min(seconds).alias("start_s"), F.max(seconds).alias("end_s"))


_WINDOWS = """
numbered as (select *, cast((row_number() over (partition by user_id order by ts, event_id) - 1) // 8 as int) as idx from events),
w as (select user_id, idx, avg(value) as score, max(cast(event_type = 'error' as int)) as label, count(*) as n_events,
  min(epoch_us(ts)) / 1e6 as start_s, max(epoch_us(ts)) / 1e6 as end_s from numbered group by user_id, idx)
"""


def window_table(spark, folder):
    return windows(spark, folder).select("user_id", "idx", F.round("score", 6).alias("score"), "label", "n_events", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"))


def window_robust_z(spark, folder):
    return robust_z(windows(spark, folder), ["user_id"], "score", "z").select("user_id", "idx", F.round("z", 6).alias("z"))


_Z = f"""with {_WINDOWS},
med as (select user_id, median(score) as m from w group by user_id),
d as (select w.*, score - m as d from w join med using (user_id)),
s as (select user_id, greatest(median(abs(d)) * 1.4826, 0.25) as s from d group by user_id)
select user_id, idx, round(d / s, 6) as z from d join s using (user_id)"""


def user_auc(spark, folder):
    return roc_auc(windows(spark, folder), ["user_id"], "score", "label").select("user_id", "n_pos", "n_neg", F.round("auc", 6).alias("auc"))


def _auc_sql(group: str, source: str) -> str:
    part = f"partition by {group} " if group else ""
    keys = f"{group}, " if group else ""
    tail = f"group by {group}" if group else ""
    return f"""r as (select {keys}label, rank() over ({part}order by score) + (count(*) over (partition by {keys}score) - 1) / 2.0 as rk from {source}),
a as (select {keys}cast(sum(label) as bigint) as n_pos, cast(sum(1 - label) as bigint) as n_neg, sum(rk) filter (where label = 1) as s from r {tail})
select {keys}n_pos, n_neg, round(case when n_pos > 0 and n_neg > 0 then (s - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) end, 6) as auc from a"""


def pooled_auc(spark, folder):
    return roc_auc(windows(spark, folder), [], "score", "label").select("n_pos", "n_neg", F.round("auc", 6).alias("auc"))


def centred_auc(spark, folder):
    rounded = centre(windows(spark, folder), ["user_id"], "score", "c").withColumn("score", F.round("c", 6))
    return roc_auc(rounded, [], "score", "label").select("n_pos", "n_neg", F.round("auc", 6).alias("auc"))


def event_midranks(spark, folder):
    events = table(spark, folder, "events", "event_type", "value").withColumn("label", (F.col("event_type") == "error").cast("int"))
    return midranks(events, ["event_type"], "value", "label").select("event_type", "value", "n", "midrank")


def user_average_precision(spark, folder):
    return average_precision(windows(spark, folder), ["user_id"], "score", "label", "idx").select("user_id", "n_pos", F.round("ap", 6).alias("ap"))


def _probable(spark, folder):
    scored = windows(spark, folder)
    return scored.withColumn("p", F.round(1 / (1 + F.exp(-(F.col("score") - 25) / 10)), 6))


_PROBABLE = f"{_WINDOWS}, p as (select *, round(1 / (1 + exp(-(score - 25) / 10)), 6) as p from w)"


def mcc_threshold_sweep(spark, folder):
    sweep = confusion_sweep(_probable(spark, folder), "p", "label")
    return sweep.select("t", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "positive_rate", "mcc")])


_SWEEP = f"""{_PROBABLE},
q as (select quantile_cont(p, [{', '.join(str(i / 100) for i in range(1, 100))}]) as q from p),
grid as (select distinct round(unnest(list_concat(q, [{', '.join(str(round(0.05 * i, 2)) for i in range(1, 20))}])), 6) as t from q),
c as (select t, count(*) filter (where p >= t and label = 1) as tp, count(*) filter (where p >= t and label = 0) as fp,
  count(*) filter (where p < t and label = 1) as fn, count(*) filter (where p < t and label = 0) as tn from grid cross join p group by t),
s as (select *, tp / greatest(tp + fp, 1) as precision, tp / greatest(tp + fn, 1) as recall, (tp + fp) / (tp + fp + fn + tn) as positive_rate,
  case when (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 then (cast(tp as double) * tn - cast(fp as double) * fn) / sqrt(cast(tp + fp as double) * (tp + fn) * (tn + fp) * (tn + fn)) else 0 end as mcc from c)
"""


def mcc_best_threshold(spark, folder):
    return best_threshold(confusion_sweep(_probable(spark, folder), "p", "label")).select("t", F.round("mcc", 6).alias("mcc"))


def icc_by_user(spark, folder):
    return icc_oneway(windows(spark, folder), "user_id", "score").select("n_groups", *[F.round(c, 6).alias(c) for c in ("between_var", "within_var", "icc")])


def icc_by_source(spark, folder):
    docs = table(spark, folder, "documents", "source", "n_chars").withColumn("x", F.col("n_chars").cast("double"))
    return icc_oneway(docs.where("source is not null"), "source", "x").select("n_groups", F.round("icc", 6).alias("icc"))


def _icc_sql(source: str, group: str, score: str, columns: str) -> str:
    return f"""g as (select {group} as g, count(*) as n, avg({score}) as m, coalesce(var_samp({score}) * (count(*) - 1), 0) as ss from {source} where {score} is not null and {group} is not null group by 1 having count(*) >= 2),
t as (select count(*) as k, sum(n) as total, sum(n * n) as squares, sum(ss) as ssw, sum(n * m) as nm, sum(n * m * m) as nmm from g),
v as (select k, greatest(0, ((nmm - nm * nm / total) / (k - 1) - ssw / (total - k)) / ((total - squares / total) / (k - 1))) as b, ssw / (total - k) as w from t)
select {columns} from v"""


def standard_features(spark, folder):
    stats = standard_stats(windows(spark, folder).withColumn("n_events", F.col("n_events").cast("double")), ["score", "n_events"])
    return stats.select("feature", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def log_loss_report(spark, folder):
    return log_loss(_probable(spark, folder), ["user_id"], "p", "label").select("user_id", F.round("log_loss", 6).alias("log_loss"))


def logit_scores(spark, folder):
    return _probable(spark, folder).select("user_id", "idx", F.round(logit(F.col("p")), 6).alias("logit"))


def linear_score(spark, folder):
    score = F.lit(BIAS)
    for name, weight in WEIGHTS.items():
        score = score + F.col(name) * F.lit(weight)
    return windows(spark, folder).select("user_id", "idx", F.round(1 / (1 + F.exp(-score)), 6).alias("p"))


def topk_screen(spark, folder):
    kept = top_k(windows(spark, folder).withColumn("score", F.round("score", 6)), ["user_id"], 3, [F.desc("score"), F.col("idx")])
    return kept.select("user_id", "idx", "score")


def screen_recall(spark, folder):
    """Share of positive windows among the three highest of their user."""
    scored = windows(spark, folder).withColumn("score", F.round("score", 6))
    kept = top_k(scored, ["user_id"], 3, [F.desc("score"), F.col("idx")])
    sums = scored.agg(F.sum("label").alias("n")).select("n").withColumn("k", F.lit(1)).join(kept.agg(F.sum("label").alias("hit")).withColumn("k", F.lit(1)), "k")
    return sums.select(F.round(F.col("hit") / F.greatest("n", F.lit(1)), 6).alias("recall"))


def stratified_sample(spark, folder):
    events = table(spark, folder, "events", "event_id", "event_type")
    return stratified_limit(events, "event_type", [F.col("event_id")], 37)


def top_utility_events(spark, folder):
    events = table(spark, folder, "events", "event_id", "user_id", "value")
    return top_events(events, ["user_id"], "value", "event_id", 20.0, 6)


def best_event(spark, folder):
    events = table(spark, folder, "events", "event_id", "event_type", "value")
    return arg_max(events, ["event_type"], "value", "event_id", ["event_id"])


def f1_cut(spark, folder):
    scored = windows(spark, folder).select(F.concat_ws(":", "user_id", "idx").alias("w"), F.round("score", 6).alias("score"), F.round(F.col("label") * F.col("n_events") / 8, 6).alias("u"))
    return f1_threshold(scored, "u", "score", "w", 400).select("threshold", "n_emitted", F.round("f1", 6).alias("f1"))


def _per_user(spark, folder):
    z = F.pmod(F.col("user_id"), F.lit(CLUSTERS)).cast("int").alias("cluster")
    return windows(spark, folder).select("user_id", z, F.when(F.col("idx") % 2 == 0, F.col("score")).otherwise(0.0).alias("even"), F.when(F.col("idx") % 2 == 1, F.col("score")).otherwise(0.0).alias("odd"))


def permutation_exact(spark, folder):
    few = _per_user(spark, folder).select("cluster", F.round("even", 6).alias("even"), F.round("odd", 6).alias("odd"))
    return exact_permutation(few, "cluster", "even", "odd").select("n_groups", F.round("delta", 4).alias("delta"), F.round("p", 6).alias("p"))


def holm_table(spark, folder):
    """Holm's test of p-values derived from the event types' mean values."""
    means = table(spark, folder, "events", "event_type", "value").groupBy("event_type").agg(F.avg("value").alias("m"))
    ps = means.select("event_type", F.round(F.exp(-F.col("m") / 4), 6).alias("p"))
    return holm(ps, "event_type", "p").select("event_type", "p", "rank", F.round("level", 6).alias("level"), "rejected")


def evaluation(spark, folder):
    """Evaluation totals per cluster from per-user results."""
    events = table(spark, folder, "events", "user_id", "event_type", "value")
    per = events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("gt_num"), F.count_if(F.col("event_type") == "purchase").alias("pred_num"))
    pairs = F.least("gt_num", "pred_num")
    rated = per.select(F.pmod("user_id", F.lit(CLUSTERS)).alias("cluster"), "gt_num", "pred_num", (pairs * F.pmod("user_id", F.lit(6))).alias("score_sum"), (pairs * F.pmod("user_id", F.lit(6)) * 0.5).alias("score_iou_sum"), (pairs * 0.5).alias("iou_sum"), pairs.alias("n_pairs"))
    out = evaluation_aggregate(rated, ["cluster"])
    return out.select("cluster", "pred_num", "gt_num", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "precision_iou", "recall_iou", "f1_iou", "mean_iou")])


def base_rates(spark, folder):
    w = windows(spark, folder)
    per = w.groupBy("user_id").agg(F.avg("label").alias("share"), F.sum("label").alias("pos"), F.count("*").alias("n"))
    return per.agg(F.round(F.sum("pos") / F.sum("n"), 6).alias("base_rate"), F.round(F.median("share"), 6).alias("median_share"), F.round(F.avg((F.col("share") > 0.5).cast("double")), 6).alias("majority_share"))


def feature_diagnostics(spark, folder):
    """AUC and average precision of each feature over all windows, its AUC among
    the three highest windows of each user, and whether it is constant."""
    w = windows(spark, folder).select("user_id", "idx", "label", F.round("score", 6).alias("score"), F.col("n_events").cast("double").alias("n_events"), F.round(F.col("end_s") - F.col("start_s"), 3).alias("span"))
    kept = top_k(w, ["user_id"], 3, [F.desc("score"), F.col("idx")]).select("user_id", "idx", F.lit(True).alias("kept"))
    marked = w.join(kept, ["user_id", "idx"], "left").withColumn("key", F.col("user_id") * 100000 + F.col("idx"))
    long = cut_lineage(marked.unpivot(["label", "kept", "key"], ["score", "n_events", "span"], "feature", "score_value").withColumnRenamed("score_value", "score"))
    screened = roc_auc(long.where("kept"), ["feature"], "score", "label").select("feature", F.round("auc", 6).alias("screened_auc"))
    precision = average_precision(long, ["feature"], "score", "label", "key").select("feature", F.round("ap", 6).alias("ap"))
    flat = long.groupBy("feature").agg((F.stddev_pop("score") < 1e-9).alias("constant"))
    return roc_auc(long, ["feature"], "score", "label").join(flat, "feature").join(precision, "feature").join(screened, "feature", "left").select("feature", F.round("auc", 6).alias("auc"), "ap", "screened_auc", "constant")


def signal_report(spark, folder):
    """Pooled, centred and median per-user AUC with the intraclass correlation, each from one pass over the windows."""
    w = windows(spark, folder)
    pooled = roc_auc(w, [], "score", "label").select(F.lit("pooled_auc").alias("measure"), F.round("auc", 6).alias("value"))
    inner = roc_auc(centre(w, ["user_id"], "score", "c").withColumn("score", F.round("c", 6)), [], "score", "label").select(F.lit("centred_auc").alias("measure"), F.round("auc", 6).alias("value"))
    per = roc_auc(w, ["user_id"], "score", "label").agg(F.median("auc").alias("m")).select(F.lit("median_user_auc").alias("measure"), F.round("m", 6).alias("value"))
    icc = icc_oneway(w, "user_id", "score").select(F.lit("icc").alias("measure"), F.round("icc", 6).alias("value"))
    return pooled.unionByName(inner).unionByName(per).unionByName(icc)


def call_accounting(spark, folder):
    """Events of each user by type, whatever the types are."""
    return table(spark, folder, "events", "user_id", "event_type").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def option_logprobs(spark, folder):
    """Event types as options of a user, their shares as log-probabilities scaled to 1."""
    events = table(spark, folder, "events", "user_id", "event_type", "value").where("event_type in ('error', 'view')")
    maps = events.groupBy("user_id", "event_type").agg(F.round(F.ln(F.sum("value")), 6).alias("s")).groupBy("user_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "s")))).alias("m"))
    scaled = maps.select("user_id", normalise_logprobs(F.col("m")).alias("m"))
    return scaled.select("user_id", F.round(F.try_element_at("m", F.lit("error")), 6).alias("error_lp"), F.round(F.try_element_at("m", F.lit("view")), 6).alias("view_lp"), F.round(log_odds(F.col("m"), "error", "view"), 6).alias("log_odds"))


def top_logprobs(spark, folder):
    """The five dearest events of a user as a token list, collapsed to two options."""
    events = table(spark, folder, "events", "event_id", "user_id", "event_type", "value")
    best = top_k(events, ["user_id"], 5, [F.desc("value"), F.col("event_id")])
    lists = best.groupBy("user_id").agg(F.collect_list(F.struct(F.concat(F.lit(" "), F.initcap("event_type")).alias("token"), (-F.col("value") / 10).alias("logprob"))).alias("t"))
    out = lists.select("user_id", collapse_logprobs(F.col("t"), ["error", "view"]).alias("c"))
    return out.select("user_id", F.round("c.error", 6).alias("error_lp"), F.round("c.view", 6).alias("view_lp"), "c.truncated")


QUERIES = {f.__name__: f for f in (window_table, window_robust_z, user_auc, pooled_auc, centred_auc, event_midranks, user_average_precision, mcc_threshold_sweep, mcc_best_threshold, icc_by_user, icc_by_source, standard_features, log_loss_report, logit_scores, linear_score, topk_screen, screen_recall, stratified_sample, top_utility_events, best_event, f1_cut, permutation_exact, holm_table, evaluation, base_rates, feature_diagnostics, signal_report, call_accounting, option_logprobs, top_logprobs)}

_CENTRED = "c as (select label, round(score - median(score) over (partition by user_id), 6) as score from w)"
_FEATURES = """sc as (select *, user_id * 100000 + idx as key, row_number() over (partition by user_id order by round(score, 6) desc, idx) <= 3 as kept from w),
long as (select label, key, kept, 'score' as feature, round(score, 6) as score from sc union all select label, key, kept, 'n_events', n_events from sc
  union all select label, key, kept, 'span', round(end_s - start_s, 3) from sc)"""

ORACLES = {
    "window_table": f"with {_WINDOWS} select user_id, idx, round(score, 6) as score, label, n_events, round(start_s, 3) as start_s, round(end_s, 3) as end_s from w",
    "window_robust_z": _Z,
    "user_auc": f"with {_WINDOWS}, {_auc_sql('user_id', 'w')}",
    "pooled_auc": f"with {_WINDOWS}, {_auc_sql('', 'w')}",
    "centred_auc": f"with {_WINDOWS}, {_CENTRED}, {_auc_sql('', 'c')}",
    "event_midranks": """select event_type, value, count(*) as n, (min(r) + max(r)) / 2.0 as midrank from
(select event_type, value, row_number() over (partition by event_type order by value) as r from events) group by event_type, value""",
    "user_average_precision": f"""with {_WINDOWS}, k as (select user_id, label, row_number() over o as k, sum(label) over (o rows unbounded preceding) as tp from w window o as (partition by user_id order by score desc, idx))
select user_id, cast(sum(label) as bigint) as n_pos, round(avg(tp / k) filter (where label = 1), 6) as ap from k group by user_id""",
    "mcc_threshold_sweep": f"with {_SWEEP} select t, tp, fp, fn, tn, round(precision, 6) as precision, round(recall, 6) as recall, round(positive_rate, 6) as positive_rate, round(mcc, 6) as mcc from s",
    "mcc_best_threshold": f"with {_SWEEP} select t, round(mcc, 6) as mcc from s order by round(s.mcc, 12) desc, t limit 1",
    "icc_by_user": f"with {_WINDOWS}, {_icc_sql('w', 'user_id', 'score', 'k as n_groups, round(b, 6) as between_var, round(w, 6) as within_var, round(b / (b + w), 6) as icc')}",
    "icc_by_source": f"with {_icc_sql('documents', 'source', 'n_chars', 'k as n_groups, round(b / (b + w), 6) as icc')}",
    "standard_features": f"with {_WINDOWS} select 'score' as feature, round(avg(score), 6) as mean, round(stddev_pop(score), 6) as sd from w union all select 'n_events', round(avg(n_events), 6), round(stddev_pop(n_events), 6) from w",
    "log_loss_report": f"with {_PROBABLE} select user_id, round(avg(-(label * ln(greatest(1e-6, least(1 - 1e-6, p))) + (1 - label) * ln(1 - greatest(1e-6, least(1 - 1e-6, p))))), 6) as log_loss from p group by user_id",
    "logit_scores": f"with {_PROBABLE} select user_id, idx, round(ln(p) - ln(1 - p), 6) as logit from p",
    "linear_score": f"with {_WINDOWS} select user_id, idx, round(1 / (1 + exp(-({BIAS} + score * {WEIGHTS['score']} + n_events * {WEIGHTS['n_events']}))), 6) as p from w",
    "topk_screen": f"with {_WINDOWS} select user_id, idx, round(score, 6) as score from w qualify row_number() over (partition by user_id order by round(score, 6) desc, idx) <= 3",
    "screen_recall": f"with {_WINDOWS}, k as (select label, row_number() over (partition by user_id order by round(score, 6) desc, idx) as k from w) select round(sum(label) filter (where k <= 3) / sum(label), 6) as recall from k",
    "stratified_sample": "select event_id, event_type from (select event_id, event_type, row_number() over (partition by event_type order by event_id) as k from events) order by k, event_type limit 37",
    "top_utility_events": "select event_id, user_id, value from events where value >= 20 qualify row_number() over (partition by user_id order by value desc, event_id) <= 6",
    "best_event": "select event_type, event_id, value from events qualify row_number() over (partition by event_type order by value desc, event_id) = 1",
    "f1_cut": f"""with {_WINDOWS}, x as (select user_id || ':' || idx as w, round(score, 6) as score, round(label * n_events / 8, 6) as u from w),
k as (select score, row_number() over o as k, sum(u) over (o rows unbounded preceding) as s from x window o as (order by score desc, w))
select score as threshold, k as n_emitted, round(2 * s / (k + 400), 6) as f1 from k order by round(2 * s / (k + 400), 12) desc, k limit 1""",
    "permutation_exact": f"""with {_WINDOWS}, d as (select user_id % {CLUSTERS} as c, sum(case when idx % 2 = 0 then round(score, 6) else -round(score, 6) end) as d from w group by 1),
o as (select list(d order by c) as ds, sum(d) as s, count(*) as n from d),
v as (select id, s, n, list_sum(list_transform(range(0, n), lambda i: case when (id >> i) & 1 = 1 then -ds[i + 1] else ds[i + 1] end)) as x from o, (select unnest(range(0, (select 1 << count(*) from d))) as id))
select any_value(n) as n_groups, round(any_value(s), 4) as delta, round(avg(cast(abs(x) >= abs(s) - 1e-9 as int)), 6) as p from v""",
    "holm_table": """with p as (select event_type, round(exp(-avg(value) / 4), 6) as p from events group by 1),
r as (select *, row_number() over (order by p, event_type) as rank, count(*) over () as m from p)
select event_type, p, rank, round(0.05 / (m - rank + 1), 6) as level, min(cast(p <= 0.05 / (m - rank + 1) as int)) over (order by rank) = 1 as rejected from r""",
    "evaluation": f"""with u as (select user_id, count(*) filter (where event_type = 'error') as g, count(*) filter (where event_type = 'purchase') as p from events group by 1),
s as (select user_id % {CLUSTERS} as cluster, cast(sum(p) as bigint) as pred_num, cast(sum(g) as bigint) as gt_num, sum(least(g, p) * (user_id % 6)) as s, sum(least(g, p) * (user_id % 6)) * 0.5 as si, sum(least(g, p)) * 0.5 as i, sum(least(g, p)) as n from u group by 1),
m as (select *, coalesce(s / nullif(5 * pred_num, 0), 0) as p, coalesce(s / nullif(5 * gt_num, 0), 0) as r, coalesce(si / nullif(5 * pred_num, 0), 0) as pi, coalesce(si / nullif(5 * gt_num, 0), 0) as ri from s)
select cluster, pred_num, gt_num, round(p, 6) as precision, round(r, 6) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1, round(pi, 6) as precision_iou, round(ri, 6) as recall_iou, round(coalesce(2 * pi * ri / nullif(pi + ri, 0), 0), 6) as f1_iou, round(coalesce(i / nullif(n, 0), 0), 6) as mean_iou from m""",
    "base_rates": f"with {_WINDOWS}, u as (select avg(label) as share, sum(label) as pos, count(*) as n from w group by user_id) select round(sum(pos) / sum(n), 6) as base_rate, round(median(share), 6) as median_share, round(avg(cast(share > 0.5 as int)), 6) as majority_share from u",
    "feature_diagnostics": f"""with {_WINDOWS}, {_FEATURES}, scr as (select * from long where kept),
a as ({_auc_sql('feature', 'long').replace('r as', 'with r as', 1)}), b as ({_auc_sql('feature', 'scr').replace('r as', 'with r as', 1)}),
k as (select feature, label, row_number() over o as k, sum(label) over (o rows unbounded preceding) as tp from long window o as (partition by feature order by score desc, key)),
p as (select feature, round(avg(tp / k) filter (where label = 1), 6) as ap from k group by feature), c as (select feature, stddev_pop(score) < 1e-9 as constant from long group by feature)
select a.feature, a.auc, p.ap, b.auc as screened_auc, c.constant from a join p on p.feature = a.feature join c on c.feature = a.feature left join b on b.feature = a.feature""",
    "signal_report": f"""with {_WINDOWS}, {_CENTRED}, p as ({_auc_sql('', 'w').replace('r as', 'with r as', 1)}), i as ({_auc_sql('', 'c').replace('r as', 'with r as', 1)}), u as ({_auc_sql('user_id', 'w').replace('r as', 'with r as', 1).replace(', 6) as auc', ', 15) as auc')}),
v as ({_icc_sql('w', 'user_id', 'score', 'b / (b + w) as icc').replace('g as', 'with g as', 1)})
select 'pooled_auc' as measure, auc as value from p union all select 'centred_auc', auc from i union all select 'median_user_auc', round(median(auc), 6) from u union all select 'icc', round(icc, 6) from v""",
    "call_accounting": "select user_id, event_type, count(*) as n from events group by user_id, event_type",
    "option_logprobs": """with s as (select user_id, round(ln(sum(value) filter (where event_type = 'error')), 6) as e, round(ln(sum(value) filter (where event_type = 'view')), 6) as v from events where event_type in ('error', 'view') group by 1),
t as (select *, greatest(coalesce(e, v), coalesce(v, e)) + ln(coalesce(exp(e - greatest(coalesce(e, v), coalesce(v, e))), 0) + coalesce(exp(v - greatest(coalesce(e, v), coalesce(v, e))), 0)) as l from s)
select user_id, round(e - l, 6) as error_lp, round(v - l, 6) as view_lp, round(e - v, 6) as log_odds from t""",
    "top_logprobs": """with b as (select user_id, event_type, -value / 10 as lp from events qualify row_number() over (partition by user_id order by value desc, event_id) <= 5),
a as (select user_id, min(lp) as low, ln(sum(exp(lp)) filter (where event_type = 'error')) as e, ln(sum(exp(lp)) filter (where event_type = 'view')) as v from b group by 1)
select user_id, round(coalesce(e, low), 6) as error_lp, round(coalesce(v, low), 6) as view_lp, (e is null or v is null) as truncated from a""",
}
