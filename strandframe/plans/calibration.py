"""Queries on hypotheses: features, spans, matching, diagnosis, calibration, ablation.

Users stand for videos and their windows of eight events for windows of a second;
the errors of a user are one hypothesis, its purchases another.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.functions.keys import key_form
from strandframe.operators.intervals import measure, temporal_iou, union_spans
from strandframe.operators.metrics import evaluation_aggregate, icc_oneway, roc_auc
from strandframe.operators.ordered import exact_medians
from strandframe.operators.sequence import count_windows
from strandframe.plans.evidence import _WINDOWS, CLUSTERS, _auc_sql, _icc_sql, windows
from strandframe.plans.hypotheses import FEATURES, MODES, Calibration, Settings, ablate, apply_calibration, baseline_spans, calibrate, hypothesis_features, hypothesis_series, hypothesis_spans, match_hypotheses, mode_table, paired_auc, presence, run_hypotheses
from strandframe.plans.pipeline import evaluate
from strandframe.session import cut_lineage
from strandframe.sources.tables import table

LEVELS, PENALTIES = [-1.0, -0.5, 0.0, 0.25, 0.5, 1.0, 1.5], [0.0, 0.25, 0.5, 1.0, 2.0, 4.0]
PLAIN = Settings(use_segmentation=False)


class Videos:
    """The tables of a run, from the events; with ``keep`` they are computed once,
    each from those before it, for plans that read them many times."""

    def __init__(self, spark: SparkSession, folder: str, keep: bool = False) -> None:
        kept = cut_lineage if keep else lambda df: df
        events = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value")
        numbered = count_windows(events, ["user_id"], ["ts", "event_id"], position=F.unix_micros(F.col("ts").cast("timestamp")))
        place = F.row_number().over(Window.partitionBy("user_id", "idx").orderBy("ts", "event_id")) - 1
        self.frames = numbered.select(F.col("user_id").alias("vid"), "idx", place.alias("frame"), "event_type")
        self.answers = self.frames.select("vid", F.col("event_type").alias("event"), "idx", "frame", F.lit(1.0).alias("lo"))
        self.seen = kept(presence(self.answers, 0.0, 0.5))
        marks = self.seen.select("vid", "idx", F.col("event").alias("event_type")) if keep else self.frames
        w = kept(windows(spark, folder).select(F.col("user_id").alias("vid"), "idx", F.round("score", 6).alias("score"), "label"))
        self.scores = w
        at = F.col("idx").cast("double")
        self.windows = w.select("vid", "idx", at.alias("start_s"), (at + 1).alias("end_s"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: at + j / 8).alias("frame_times"))
        self.durations = w.groupBy("vid").agg((F.max("idx") + 0.5).alias("duration")).select("vid", F.when(F.col("vid") % 3 == 0, F.col("duration")).alias("duration"))
        self.generic = w.select("vid", "idx", F.round(F.col("score") - 20, 6).alias("lo_abs"), F.round((F.col("score") - 20) / 8 + 1e-9, 6).alias("rel_z"))
        self.games = kept(w.select("vid", F.concat(F.lit("c"), F.col("vid") % CLUSTERS).alias("game")).distinct())
        named = marks.where("event_type in ('error', 'purchase')")
        members = named.groupBy("vid", F.col("event_type").alias("event")).agg(F.sort_array(F.collect_set("idx")).alias("members"))
        rank = F.row_number().over(Window.partitionBy("vid").orderBy(F.desc(F.size("members")), "event"))
        self.hypotheses = kept(members.select("vid", "event", "members", rank.alias("rank"), (F.col("event") == "purchase").alias("forced"), (F.col("vid") % 5 / 10).alias("prior")))
        rows = w.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("idx", "score"))).alias("s"))
        signed = F.when(F.col("event") == "error", F.lit(1.0)).otherwise(F.lit(-1.0))
        self.profiles = kept(self.hypotheses.select("vid", "event").join(rows, "vid").select("vid", "event", F.transform("s", lambda x: F.round((x["score"] - 20) / 5 * signed, 6)).alias("profile")))
        spans = F.struct((at + F.when(F.col("event_type") == "error", 0.25).otherwise(0.0)).alias("start"), (at + F.when(F.col("event_type") == "error", 1.0).otherwise(0.5)).alias("end"))
        bugs = marks.where("event_type in ('error', 'signup')").select("vid", (F.col("event_type") == "signup").cast("int").alias("gt_pos"), "idx", "event_type").distinct()
        self.truth = kept(bugs.groupBy("vid", "gt_pos").agg(F.collect_list(spans).alias("s")).select("vid", "gt_pos", union_spans(F.col("s")).alias("g_spans")))
        rating = F.when((F.col("event") == "error") & (F.col("gt_pos") == 0), 5).when((F.col("event") == "purchase") & (F.col("gt_pos") == 1), 4).otherwise(F.col("vid") % 5)
        self.ratings = kept(self.hypotheses.select("vid", "event").join(self.truth.select("vid", "gt_pos"), "vid").select("vid", "event", "gt_pos", rating.cast("int").alias("rating")))
        self.matches = kept(match_hypotheses(self.truth, self.ratings))
        self.found: dict[Settings, Calibration] = {}

    def rows(self, settings: Settings) -> DataFrame:
        """Hypotheses with their features."""
        return hypothesis_features(self.hypotheses, self.profiles, self.generic, settings)

    def present(self) -> DataFrame:
        """First and last frame of each hypothesis in each window."""
        return self.seen

    def calibrated(self, settings: Settings):
        """A calibration on all videos."""
        return calibrate(self.hypotheses, self.profiles, self.generic, self.windows, self.durations, self.truth, self.matches, self.games, settings, LEVELS, PENALTIES, self.present())

    def calibration_of(self, settings: Settings) -> Calibration:
        """A calibration for the settings; it does not depend on whether a run uses
        the utilities, so such settings share one."""
        key = replace(settings, use_utility=True)
        if key not in self.found:
            self.found[key] = self.calibrated(key)
        return replace(self.found[key], switches=settings.switches())

    def results(self, settings: Settings) -> DataFrame:
        """Calibration, run and evaluation: one row per video."""
        found = self.calibration_of(settings)
        spans = run_hypotheses(self.hypotheses, self.profiles, self.generic, self.windows, self.durations, found.model, apply_calibration(settings, found), self.present())
        predictions = cut_lineage(spans.select("vid", (F.col("event") == "purchase").cast("int").alias("pos"), "spans"))
        named = F.when(F.col("event") == "purchase", 1).otherwise(0).alias("pred_pos")
        ratings = self.ratings.select("vid", "gt_pos", named, "rating").join(predictions.select("vid", F.col("pos").alias("pred_pos")), ["vid", "pred_pos"], "left_semi")
        return evaluate(predictions, self.truth.select("vid", F.col("gt_pos").alias("pos"), F.col("g_spans").alias("spans")), ratings)


def hypothesis_table(spark, folder):
    """The eleven features of each hypothesis, its members as segments."""
    return Videos(spark, folder).rows(PLAIN).select("vid", "event", *[F.round(F.col(f) + 1e-9, 6).alias(f) for f in FEATURES])


def _mode_spans(videos: Videos) -> DataFrame:
    rows = cut_lineage(videos.rows(PLAIN))
    each = [hypothesis_spans(rows, videos.windows, videos.durations, Settings(use_segmentation=False, mode=mode), videos.present()).select(F.lit(mode).alias("mode"), "vid", "event", "spans") for mode in MODES]
    return reduce(DataFrame.unionByName, each)


def span_modes(spark, folder):
    """Number and length of each hypothesis' spans in each mode."""
    return _mode_spans(Videos(spark, folder)).select("mode", "vid", "event", F.size("spans").cast("bigint").alias("n_spans"), F.round(measure(F.col("spans")), 6).alias("covered"))


def mode_iou(spark, folder):
    """Mean overlap of each mode's spans with the bug a hypothesis stands for."""
    videos = Videos(spark, folder)
    pairs = videos.ratings.where("rating >= 4").join(videos.truth, ["vid", "gt_pos"]).where("(event = 'error') = (gt_pos = 0)").select("vid", "event", "g_spans")
    rows = pairs.join(videos.rows(PLAIN), ["vid", "event"])
    out = mode_table(rows, videos.windows, videos.durations, PLAIN, videos.present())
    return out.select("mode", F.round("mean_iou", 6).alias("mean_iou"))


def hypothesis_max(spark, folder):
    """Highest score of each window under the hypotheses of its video, else the generic one."""
    videos = Videos(spark, folder)
    return hypothesis_series(videos.profiles, videos.generic).select("vid", "idx", F.round("hyp_max", 6).alias("hyp_max"))


def hypothesis_matches(spark, folder):
    """Matched pairs of hypotheses and bugs of each video, and the sum of their ratings."""
    videos = Videos(spark, folder)
    return match_hypotheses(videos.truth, videos.ratings).groupBy("vid").agg(F.count("*").alias("n_pairs"), F.sum("rating").alias("total"))


def baseline_report(spark, folder):
    """What each report's spans cover of the first record of its video."""
    records = table(spark, folder, "records", "rec_id", "video_name", "duration").withColumn("vid", key_form(F.col("video_name"))).where("vid is not null")
    durations = records.groupBy("vid").agg(F.min(F.struct("rec_id", "duration"))["duration"].alias("duration"))
    report = table(spark, folder, "report", "report_id", "video_name", "bugs", "time_nodes")
    zipped = report.select("report_id", key_form(F.col("video_name")).alias("vid"), F.posexplode(F.arrays_zip("bugs", "time_nodes")).alias("pos", "z"))
    answers = zipped.select("vid", F.struct("report_id", "pos").alias("pos"), F.col("z.bugs").alias("description"), F.transform("z.time_nodes", lambda s: F.struct(F.get(s, 0).alias("start"), F.get(s, 1).alias("end"))).alias("spans"))
    return baseline_spans(answers, durations).select("pos.report_id", F.col("pos.pos").alias("bug_pos"), F.size("spans").cast("bigint").alias("n_spans"), F.round(measure(F.col("spans")), 6).alias("covered"))


def paired_series(spark, folder):
    """Per-video AUC of the generic score and of the highest hypothesis score."""
    videos = Videos(spark, folder)
    joined = videos.scores.join(hypothesis_series(videos.profiles, videos.generic), ["vid", "idx"]).join(videos.generic, ["vid", "idx"])
    out = paired_auc(cut_lineage(joined), "lo_abs", "hyp_max", "label")
    return out.select("vid", *[F.round(c, 6).alias(c) for c in ("a", "b", "delta")])


def diagnosis(spark, folder):
    """Base rates, signals of the generic score, and the whole-video baseline."""
    videos = Videos(spark, folder)
    scored = cut_lineage(videos.scores.join(videos.generic, ["vid", "idx"]))
    per = scored.groupBy("vid").agg(F.avg("label").alias("share"), F.sum("label").alias("pos"), F.count("*").alias("n"))
    base = per.agg((F.sum("pos") / F.sum("n")).alias("base_rate"), F.avg((F.col("share") > 0.5).cast("double")).alias("majority_share")).unpivot([], ["base_rate", "majority_share"], "measure", "value")
    pooled = roc_auc(scored, [], "lo_abs", "label").select(F.lit("pooled_auc").alias("measure"), F.col("auc").alias("value"))
    inner = exact_medians(roc_auc(scored, ["vid"], "lo_abs", "label"), [], "auc", "value").select(F.lit("median_auc").alias("measure"), "value")
    icc = icc_oneway(scored, "vid", "lo_abs").select(F.lit("icc").alias("measure"), F.col("icc").alias("value"))
    lengths = videos.scores.groupBy("vid").agg((F.max("idx") + 1.0).alias("d")).join(videos.durations, "vid").select("vid", F.array(F.struct(F.lit(0.0).alias("start"), F.coalesce("duration", "d").alias("end"))).alias("w"))
    whole = videos.truth.where("gt_pos = 0").join(lengths, "vid").agg(F.avg(temporal_iou(F.col("g_spans"), F.col("w"))).alias("value")).select(F.lit("whole_span_iou").alias("measure"), "value")
    return reduce(DataFrame.unionByName, [base, pooled, inner, icc, whole]).select("measure", F.round("value", 6).alias("value"))


def calibration(spark, folder):
    """The cells of the segmentation grid with what the calibration chose."""
    found = Videos(spark, folder, keep=True).calibrated(Settings())
    rows = [(x, p, round(m, 6), i == 0, found.mode, round(found.held_out_iou, 6), round(found.threshold, 6), len(found.reasons)) for i, (x, p, m) in enumerate(found.grid)]
    return spark.createDataFrame(rows, "level double, penalty double, mean_iou double, chosen boolean, mode string, held_out_iou double, threshold double, n_reasons int")


def ablation(spark, folder):
    """Evaluation of the run with all parts, without segmentation, and without utilities."""
    videos = Videos(spark, folder, keep=True)
    variants = {"full": Settings(), "no_segmentation": Settings(use_segmentation=False), "no_utility": Settings(use_utility=False)}
    out = evaluation_aggregate(ablate(variants, videos.results), ["method"])
    return out.select("method", "pred_num", "gt_num", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "f1_iou", "mean_iou")])


QUERIES = {f.__name__: f for f in (hypothesis_table, span_modes, mode_iou, hypothesis_max, hypothesis_matches, baseline_report, paired_series, diagnosis, calibration, ablation)}

_HYP = f"""{_WINDOWS},
n8 as (select user_id as vid, cast((row_number() over o - 1) // 8 as int) as idx, cast((row_number() over o - 1) % 8 as int) as frame, event_type from events window o as (partition by user_id order by ts, event_id)),
s as (select user_id as vid, idx, round(score, 6) as score, label from w),
mem as (select distinct vid, event_type as event, idx from n8 where event_type in ('error', 'purchase')),
hs as (select vid, event, count(*) as m from mem group by all),
h as (select *, row_number() over (partition by vid order by m desc, event) as rank from hs),
pr as (select h.vid, h.event, h.m, h.rank, s.idx, round((score - 20) / 5 * case when h.event = 'error' then 1 else -1 end, 6) as x, round(score - 20, 6) as lo_abs, round((score - 20) / 8 + 1e-9, 6) as rel_z, mem.idx is not null as own
  from h join s on s.vid = h.vid left join mem on mem.vid = h.vid and mem.event = h.event and mem.idx = s.idx),
dur as (select vid, case when vid % 3 = 0 then max(idx) + 0.5 else max(idx) + 1.0 end as d from s group by vid)"""

_SPANS = f"""{_HYP},
b as (select *, case when idx - lag(idx) over (partition by vid, event order by idx) = 1 then 0 else 1 end as new from mem),
k as (select *, sum(new) over (partition by vid, event order by idx rows unbounded preceding) as g from b),
r as (select vid, event, min(idx) as f, max(idx) as l from k group by vid, event, g),
pf as (select vid, event_type as event, idx, min(frame) as a, max(frame) as b from n8 group by all),
fr as (select r.*, pa.a as fa, pb.b as fb, xa.x as xa, xb.x as xb from r join pf pa on pa.vid = r.vid and pa.event = r.event and pa.idx = r.f join pf pb on pb.vid = r.vid and pb.event = r.event and pb.idx = r.l
  join pr xa on xa.vid = r.vid and xa.event = r.event and xa.idx = r.f join pr xb on xb.vid = r.vid and xb.event = r.event and xb.idx = r.l),
mv as (select vid, event, f, l, case when xa > 0 then f + fa / 8.0 else f end as a, case when xb > 0 then least(l + 1, l + fb / 8.0 + 0.25) else l + 1 end as b from fr),
raw as (select 'window' as mode, vid, event, cast(f as double) as a, l + 1.0 as b from r union all select 'frame', vid, event, case when b > a then a else f end, case when b > a then b else l + 1 end from mv union all select 'whole', h.vid, event, 0, d from h join dur using (vid)),
sp as (select mode, vid, event, greatest(0, a) as a, least(b, d) as b from raw join dur using (vid) where greatest(0, a) < least(b, d))"""

_TRUTH = """bug as (select distinct vid, cast(event_type = 'signup' as int) as gt_pos, idx from n8 where event_type in ('error', 'signup')),
tr as (select vid, gt_pos, case when gt_pos = 0 then idx + 0.25 else idx end as a, case when gt_pos = 0 then idx + 1.0 else idx + 0.5 end as b from bug)"""

_PAIRED = f"""{_HYP}, hm as (select vid, idx, max(x) as x from pr group by all), se as (select s.vid, s.idx, s.label, round(s.score - 20, 6) as lo, coalesce(hm.x, round(s.score - 20, 6)) as hi from s left join hm using (vid, idx)),
one as (select vid, label, lo as score from se), two as (select vid, label, hi as score from se),
p as ({_auc_sql('vid', 'one').replace('r as', 'with r as', 1).replace(', 6) as auc', ', 15) as auc')}), q as ({_auc_sql('vid', 'two').replace('r as', 'with r as', 1).replace(', 6) as auc', ', 15) as auc')})"""

ORACLES = {
    "hypothesis_table": f"""with {_HYP}, z as (select *, count(*) over (partition by vid, event) as n, row_number() over (partition by vid, event order by x desc) as k from pr)
select vid, event, round(any_value(m) / any_value(n) + 1e-9, 6) as support, round(1 / any_value(rank) + 1e-9, 6) as rank_inv, case when event = 'purchase' then 1.0 else 0.0 end as forced, round(vid % 5 / 10 + 1e-9, 6) as prior, round(max(x) + 1e-9, 6) as prof_max, round(avg(x) filter (where k <= 2) + 1e-9, 6) as prof_top2, round(avg(x) + 1e-9, 6) as prof_mean,
round(coalesce(avg(x) filter (where own) - avg(x) filter (where not own), 0) + 1e-9, 6) as prof_contrast, round(avg(cast(own as int)) + 1e-9, 6) as seg_frac, round(avg(lo_abs) filter (where own) + 1e-9, 6) as gen_lo, round(max(rel_z) filter (where own) + 1e-9, 6) as gen_z from z group by vid, event""",
    "span_modes": f"with {_SPANS}, m as (select mode from (select unnest(['window', 'frame', 'whole']) as mode)), c as (select mode, vid, event, count(*) as n, sum(b - a) as c from sp group by all) select m.mode, h.vid, h.event, coalesce(n, 0) as n_spans, round(coalesce(c, 0), 6) as covered from h cross join m left join c on c.mode = m.mode and c.vid = h.vid and c.event = h.event",
    "mode_iou": f"""with {_SPANS}, {_TRUTH}, pair as (select h.vid, h.event, t.gt_pos from h join (select distinct vid, gt_pos from tr) t on t.vid = h.vid and (h.event = 'error') = (t.gt_pos = 0)), m as (select unnest(['window', 'frame', 'whole']) as mode),
ls as (select mode, vid, event, sum(b - a) as l from sp group by all), lt as (select vid, gt_pos, sum(b - a) as l from tr group by all),
it as (select sp.mode, sp.vid, sp.event, sum(greatest(0, least(sp.b, tr.b) - greatest(sp.a, tr.a))) as c from sp join tr on tr.vid = sp.vid and (sp.event = 'error') = (tr.gt_pos = 0) group by all)
select m.mode, round(avg(case when ls.l is null then 0 else coalesce(it.c, 0) / (ls.l + lt.l - coalesce(it.c, 0)) end), 6) as mean_iou from pair cross join m join lt on lt.vid = pair.vid and lt.gt_pos = pair.gt_pos left join ls on ls.mode = m.mode and ls.vid = pair.vid and ls.event = pair.event left join it on it.mode = m.mode and it.vid = pair.vid and it.event = pair.event group by m.mode""",
    "hypothesis_max": f"with {_HYP}, m as (select vid, idx, max(x) as x from pr group by all) select s.vid, s.idx, round(coalesce(m.x, s.score - 20), 6) as hyp_max from s left join m using (vid, idx)",
    "hypothesis_matches": f"""with {_HYP}, {_TRUTH}, g as (select distinct vid, gt_pos from tr), c as (select h.vid, sum(cast(event = 'error' as int)) as e, sum(cast(event = 'purchase' as int)) as p from h group by 1), d as (select vid, sum(cast(gt_pos = 0 as int)) as a, sum(cast(gt_pos = 1 as int)) as b from g group by 1),
x as (select vid, least(e + p, a + b) as n, e * a * 5 as ea, e * b * (vid % 5) as eb, p * a * (vid % 5) as pa, p * b * 4 as pb from c join d using (vid)) select vid, n as n_pairs, cast(greatest(ea + pb, eb + pa) as double) as total from x""",
    "baseline_report": r"""with k as (select report_id, nullif(regexp_replace(regexp_extract(trim(video_name), '[^/]*$'), '\.mp4$', '', 'i'), '') as vid, bugs, time_nodes from report),
d as (select v as vid, arg_min(coalesce(duration, 0), rec_id) as d from (select rec_id, duration, nullif(regexp_replace(regexp_extract(trim(video_name), '[^/]*$'), '\.mp4$', '', 'i'), '') as v from records) r where v is not null group by 1),
p as (select report_id, vid, unnest(range(0, greatest(coalesce(len(bugs), 0), coalesce(len(time_nodes), 0)))) as pos, bugs, time_nodes from k),
e as (select report_id, vid, pos, bugs[pos + 1] as bug, unnest(time_nodes[pos + 1]) as s from p where pos < coalesce(len(bugs), 0) and pos < coalesce(len(time_nodes), 0)),
c as (select report_id, pos, greatest(0, s[1]) as a, case when d.d > 0 then least(s[2], d.d) else s[2] end as b from e left join d using (vid) where trim(bug) <> ''),
f as (select distinct * from c where a < b), o as (select *, max(b) over (partition by report_id, pos order by a, b rows between unbounded preceding and 1 preceding) as reach from f),
g as (select *, sum(case when reach is null or a > reach then 1 else 0 end) over (partition by report_id, pos order by a, b rows unbounded preceding) as q from o), u as (select report_id, pos, q, min(a) as a, max(b) as b from g group by all)
select report_id, pos as bug_pos, count(*) as n_spans, round(sum(b - a), 6) as covered from u group by report_id, pos""",
    "paired_series": f"with {_PAIRED} select p.vid, round(p.auc, 6) as a, round(q.auc, 6) as b, round(q.auc - p.auc, 6) as delta from p join q on q.vid = p.vid where p.auc is not null and q.auc is not null",
    "diagnosis": f"""with {_PAIRED}, {_TRUTH}, u as (select avg(label) as share, sum(label) as pos, count(*) as n from s group by vid),
po as ({_auc_sql('', 'one').replace('r as', 'with r as', 1).replace(', 6) as auc', ', 15) as auc')}), ic as ({_icc_sql('se', 'vid', 'lo', 'b / (b + w) as icc').replace('g as', 'with g as', 1)}),
wl as (select tr.vid, sum(greatest(0, least(b, d) - a)) as c, sum(b - a) as l, any_value(d) as d from tr join dur using (vid) where gt_pos = 0 group by 1)
select 'base_rate' as measure, round(sum(pos) / sum(n), 6) as value from u union all select 'majority_share', round(avg(cast(share > 0.5 as int)), 6) from u union all select 'pooled_auc', round(auc, 6) from po union all select 'median_auc', round(median(auc), 6) from p
union all select 'icc', round(icc, 6) from ic union all select 'whole_span_iou', round(avg(c / (l + d - c)), 6) from wl""",
}
