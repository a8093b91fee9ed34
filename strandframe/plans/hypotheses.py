"""Hypotheses of a video: features, time spans, matching, calibration, ablation."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.operators.assign import assign_within
from strandframe.operators.guards import require
from strandframe.operators.intervals import SPANS, clip_spans, frame_bounds, once, temporal_iou
from strandframe.operators.metrics import f1_threshold, roc_auc
from strandframe.operators.models import LinearModel, cross_fit, fit_utility, group_folds
from strandframe.operators.resample import DRAWS, MAX_CLUSTERS, cluster_bootstrap_auc, pair_counts, signed_rank_p, signed_rank_statistics
from strandframe.operators.ranking import top_events
from strandframe.operators.sequence import member_runs, segment_members, top_segments
from strandframe.session import cut_lineage

#: The features of a hypothesis and the ways to find its spans.
FEATURES = ("support", "rank_inv", "forced", "prior", "prof_max", "prof_top2", "prof_mean", "prof_contrast", "seg_frac", "gen_lo", "gen_z")
MODES = ("window", "frame", "whole")
VERSION = "1"


@dataclass(frozen=True)
class Settings:
    """Parameters of a run; calibration sets those of the second group."""

    use_segmentation: bool = True
    use_utility: bool = True
    use_frames: bool = True
    most_segments: int = 4
    most_events: int = 6
    frame_step: float = 0.25
    least_rating: int = 3
    folds: int = 5
    seed: int = 0
    least_rows: int = 20

    level: float = 0.0
    penalty: float = 1.0
    mode: str = "window"
    threshold: float = 0.0

    def switches(self) -> dict[str, bool]:
        """The parts that are on."""
        return {k: v for k, v in asdict(self).items() if k.startswith("use_")}


@dataclass(frozen=True)
class Calibration:
    """What a calibration found, with the switches it was made for."""

    model: LinearModel
    level: float
    penalty: float
    mode: str
    threshold: float
    grid: list[tuple[float, float, float]]
    held_out_iou: float
    mode_iou: dict[str, float]
    auc: dict[str, float]
    reasons: list[str]
    switches: dict[str, bool] = field(default_factory=dict)
    version: str = VERSION


def segments_of(profile: Column, members: Column, settings: Settings, level: Column | float | None = None, penalty: Column | float | None = None) -> Column:
    """array<struct<first,last>> of a hypothesis: the best segments of its profile,
    or the runs of its members where segmentation is off."""
    if not settings.use_segmentation:
        return member_runs(members)
    level = settings.level if level is None else level
    inside = segment_members(profile, level, settings.penalty if penalty is None else penalty)
    runs = member_runs(inside)
    return F.when(F.size(runs) > settings.most_segments, top_segments(runs, profile, level if isinstance(level, Column) else float(level), settings.most_segments)).otherwise(runs)


def hypothesis_features(hypotheses: DataFrame, profiles: DataFrame, evidence: DataFrame, settings: Settings) -> DataFrame:
    """(vid, event, rank, members, profile, segs, FEATURES) of each hypothesis.

    ``hypotheses``: vid, event, members (array of window places), rank (from 1),
    forced (boolean), prior; ``profiles``: vid, event, profile (score per window);
    ``evidence``: vid, idx, lo_abs, rel_z.  Contrast is the mean inside less the
    mean outside the segments; what is undefined is 0.
    """
    joined = hypotheses.join(profiles, ["vid", "event"])
    cut = joined.select("*", once(segments_of(F.col("profile"), F.col("members"), settings), "segs"))
    inside = lambda i: F.exists("segs", lambda s: (s["first"] <= i) & (i <= s["last"]))
    marked = cut.select("*", once(F.transform("profile", lambda x, i: F.struct(x.alias("x"), inside(i).alias("own"))), "_m"))

    def mean(values: Column) -> Column:
        return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))

    def of(own: bool) -> Column:
        return F.transform(F.filter("_m", lambda s: s["own"] == F.lit(own)), lambda s: s["x"])

    zero, n = F.lit(0.0), F.size("profile")
    told = marked.select(
        "vid", "event", "rank", "members", "profile", "segs",
        (F.size("members") / F.greatest(n, F.lit(1))).alias("support"), (1 / F.col("rank")).alias("rank_inv"),
        F.coalesce(F.col("forced").cast("double"), zero).alias("forced"), F.coalesce("prior", zero).alias("prior"),
        F.coalesce(F.array_max("profile"), zero).alias("prof_max"),
        F.coalesce(mean(F.slice(F.sort_array("profile", asc=False), 1, 2)), zero).alias("prof_top2"),
        F.coalesce(mean(F.col("profile")), zero).alias("prof_mean"),
        F.coalesce(mean(of(True)) - mean(of(False)), zero).alias("prof_contrast"),
        F.coalesce(F.try_divide(F.size(of(True)), n), zero).alias("seg_frac"),
    )
    own = hypotheses.select("vid", "event", F.explode("members").alias("idx")).join(evidence.select("vid", "idx", "lo_abs", "rel_z"), ["vid", "idx"])
    generic = own.groupBy("vid", "event").agg(F.avg("lo_abs").alias("gen_lo"), F.max("rel_z").alias("gen_z"))
    return told.join(generic, ["vid", "event"], "left").fillna(0.0, ["gen_lo", "gen_z"])


def presence(frames: DataFrame, base: float, margin: float) -> DataFrame:
    """(vid, event, idx, first, last): the first and last frame of a window in which
    the event is present: its log-odds less ``base`` above ``margin``.  ``frames``:
    vid, event, idx, frame, lo; repeated answers for a frame count once."""
    distinct = frames.groupBy("vid", "event", "idx", "frame").agg(F.max("lo").alias("lo"))
    return distinct.where(F.col("lo") - base > margin).groupBy("vid", "event", "idx").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))


def _lengths(windows: DataFrame, durations: DataFrame) -> DataFrame:
    """(vid, duration, bounds) of the videos with windows: the last window's end
    where the duration is null or 0; the bounds are idx, start_s, end_s of each window."""
    ends = windows.groupBy("vid").agg(F.max("end_s").alias("_last"), F.collect_list(F.struct("idx", "start_s", "end_s")).alias("bounds"))
    return ends.join(durations.select("vid", "duration"), "vid", "left").select("vid", F.coalesce(F.when(F.col("duration") > 0, F.col("duration")), F.col("_last"), F.lit(0.0)).alias("duration"), "bounds")


def hypothesis_spans(rows: DataFrame, windows: DataFrame, durations: DataFrame, settings: Settings, present: DataFrame | None = None) -> DataFrame:
    """(vid, event, spans): the time spans of hypotheses in ``settings.mode``.

    ``rows``: vid, event, profile, segs; ``windows``: vid, idx, start_s, end_s,
    frame_times; ``durations``: vid, duration (the last window's end where it is
    null or 0).  ``window``: the segments at window resolution; ``frame``: their
    outer ends moved to the first and last frame where the event is present
    (``present``), where the window scores above the level and the moved ends do not
    cross; ``whole``: the whole video.  All are cut to the duration and merged.
    """
    require(settings.mode in MODES, f"no such mode: {settings.mode}")
    lengths = _lengths(windows, durations)
    whole = F.when(F.col("duration") > 0, F.array(F.struct(F.lit(0.0).alias("start"), F.col("duration").alias("end")))).otherwise(F.array().cast(SPANS))
    if settings.mode == "whole":
        return rows.select("vid", "event").join(lengths, "vid").select("vid", "event", whole.alias("spans"))
    parts = rows.select("vid", "event", "profile", F.explode("segs").alias("s")).select("vid", "event", "profile", "s.first", "s.last")
    a = windows.select("vid", F.col("idx").alias("first"), F.struct("start_s", "end_s", "frame_times").alias("a"))
    b = windows.select("vid", F.col("idx").alias("last"), F.struct("start_s", "end_s", "frame_times").alias("b"))
    timed = parts.join(a, ["vid", "first"]).join(b, ["vid", "last"])
    start, end = F.col("a.start_s"), F.col("b.end_s")
    if settings.mode == "frame" and settings.use_frames and present is not None:
        on = present.select("vid", "event", F.col("idx").alias("first"), F.col("first").alias("_on"))
        off = present.select("vid", "event", F.col("idx").alias("last"), F.col("last").alias("_off"))
        timed = timed.join(on, ["vid", "event", "first"], "left").join(off, ["vid", "event", "last"], "left")
        above = lambda place: F.get("profile", F.col(place)) > settings.level
        first = F.when(above("first") & F.col("_on").isNotNull(), frame_bounds(F.col("a.start_s"), F.col("a.end_s"), F.col("a.frame_times"), F.col("_on"), F.col("_on"), settings.frame_step)["start"])
        last = F.when(above("last") & F.col("_off").isNotNull(), frame_bounds(F.col("b.start_s"), F.col("b.end_s"), F.col("b.frame_times"), F.col("_off"), F.col("_off"), settings.frame_step)["end"])
        moved, kept = F.coalesce(first, start), F.coalesce(last, end)
        start, end = F.when(kept > moved, moved).otherwise(start), F.when(kept > moved, kept).otherwise(end)
    lists = timed.select("vid", "event", start.alias("start"), end.alias("end")).groupBy("vid", "event").agg(F.collect_list(F.struct("start", "end")).alias("s"))
    found = rows.select("vid", "event").join(lists, ["vid", "event"], "left").join(lengths, "vid")
    return found.select("vid", "event", clip_spans(F.coalesce("s", F.array().cast(SPANS)), F.col("duration")).alias("spans"))


def hypothesis_series(profiles: DataFrame, generic: DataFrame) -> DataFrame:
    """(vid, idx, hyp_max): the highest score of a window under any hypothesis, the
    generic one (vid, idx, lo_abs) in videos without hypotheses."""
    scores = profiles.select("vid", F.posexplode("profile").alias("idx", "x")).groupBy("vid", "idx").agg(F.max("x").alias("_x"))
    any_of = profiles.select("vid").distinct().withColumn("_any", F.lit(True))
    joined = generic.join(scores, ["vid", "idx"], "left").join(any_of, "vid", "left")
    return joined.select("vid", "idx", F.when(F.col("_any"), F.col("_x")).otherwise(F.col("lo_abs")).alias("hyp_max"))


def match_hypotheses(truth: DataFrame, ratings: DataFrame | None, spans: DataFrame | None = None) -> DataFrame:
    """(vid, event, gt_pos, rating): one-to-one matches of hypotheses and true bugs
    with the greatest sum of ratings (vid, event, gt_pos, rating).  Without ratings
    the overlap of ``spans`` (vid, event, spans) with those of ``truth`` (vid,
    gt_pos, g_spans) is matched, and any overlap rates 5."""
    if ratings is not None:
        return assign_within(ratings, "vid", "event", "gt_pos", "rating")
    both = spans.join(truth, "vid").select("vid", "event", "gt_pos", temporal_iou(F.col("g_spans"), F.col("spans")).alias("iou"))
    return assign_within(both, "vid", "event", "gt_pos", "iou").select("vid", "event", "gt_pos", F.when(F.col("iou") > 0, 5.0).otherwise(0.0).alias("rating"))


def segmentation_cells(correct: DataFrame, windows: DataFrame, durations: DataFrame, levels: list[float], penalties: list[float], settings: Settings) -> DataFrame:
    """(vid, event, game, level, penalty, iou) of every grid cell for the correctly
    matched hypotheses (vid, event, game, profile, members, g_spans): the cells are
    exploded, so the whole grid is one plan and one pass.  The bounds of a video's
    windows go along with its hypotheses, so no cell is shuffled or joined."""
    grid = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("level"), F.lit(float(p)).alias("penalty")) for x in levels for p in penalties]))
    parts = int(correct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    timed = correct.join(_lengths(windows, durations), "vid").repartition(parts, "vid", "event")  # small in bytes, but a row is many cells
    swept = timed.select("*", grid.alias("c")).select("*", "c.level", "c.penalty").drop("c")
    cut = swept.select("*", once(segments_of(F.col("profile"), F.col("members"), settings, F.col("level"), F.col("penalty")), "segs"))

    def bounded(s: Column) -> Column:
        last = F.filter("bounds", lambda b: b["idx"] == s["last"])
        return F.flatten(F.transform(F.filter("bounds", lambda a: a["idx"] == s["first"]), lambda a: F.transform(last, lambda b: F.struct(a["start_s"].alias("start"), b["end_s"].alias("end")))))

    found = cut.select("*", once(F.flatten(F.transform("segs", bounded)), "_s")).select("*", once(clip_spans(F.col("_s"), F.col("duration")), "spans"))
    return found.select("vid", "event", "game", "level", "penalty", temporal_iou(F.col("g_spans"), F.col("spans")).alias("iou"))


def choose_segmentation(cells: DataFrame, folds: dict[str, int]) -> tuple[list[tuple[float, float, float]], float]:
    """(level, penalty, mean IoU) of the cells, best first (equal ones by level,
    then penalty), and the held-out estimate: each fold of games scored by the cell
    that is best on the other folds.  Sums per cell and game reach the driver."""
    sums = cells.groupBy("level", "penalty", "game").agg(F.sum("iou").alias("s"), F.count("iou").alias("n")).collect()

    def mean_of(rows: list) -> dict[tuple[float, float], float]:
        totals: dict[tuple[float, float], list[float]] = {}
        for r in rows:
            t = totals.setdefault((r["level"], r["penalty"]), [0.0, 0])
            t[0] += r["s"] or 0.0
            t[1] += r["n"]
        return {cell: s / n for cell, (s, n) in totals.items() if n}

    def best(means: dict) -> tuple[float, float]:
        return min(means, key=lambda cell: (-round(means[cell], 12), cell))

    means = mean_of(sums)
    if not means:
        return [], math.nan
    held, n = 0.0, 0
    for fold in sorted(set(folds.values())):
        inner = mean_of([r for r in sums if folds[r["game"]] != fold])
        cell = best(inner) if inner else best(means)
        for r in sums:
            if folds[r["game"]] == fold and (r["level"], r["penalty"]) == cell:
                held, n = held + (r["s"] or 0.0), n + r["n"]
    table = sorted(((x, p, m) for (x, p), m in means.items()), key=lambda c: (-round(c[2], 12), c[0], c[1]))
    return table, held / n if n else math.nan


def mode_table(correct: DataFrame, windows: DataFrame, durations: DataFrame, settings: Settings, present: DataFrame | None = None) -> DataFrame:
    """(mode, mean_iou): mean overlap of the matched hypotheses (vid, event,
    profile, segs, g_spans) with their bug in each mode."""
    out = None
    for mode in MODES:
        spans = hypothesis_spans(correct, windows, durations, replace(settings, mode=mode), present)
        one = spans.join(correct.select("vid", "event", "g_spans"), ["vid", "event"]).agg(F.avg(temporal_iou(F.col("g_spans"), F.col("spans"))).alias("mean_iou")).select(F.lit(mode).alias("mode"), "mean_iou")
        out = one if out is None else out.unionByName(one)
    return out


def choose_mode(means: dict[str, float | None], current: str) -> str:
    """The mode of the highest mean; of equal ones the current, then the first."""
    valid = {m: v for m, v in means.items() if v is not None and not math.isnan(v)}
    return max(valid, key=lambda m: (round(valid[m], 12), m == current, -MODES.index(m))) if valid else current


def degenerate_reasons(auc_low: float | None, mcc: float | None = None, positive_rate: float | None = None, base_rate: float | None = None) -> list[str]:
    """Why a calibrated signal should not be used; a value of None is not checked,
    a NaN bound counts as no evidence."""
    reasons = []
    if auc_low is not None and not auc_low > 0.5:
        reasons.append("the interval of the AUC holds 0.5")
    if mcc is not None and mcc < 0.10:
        reasons.append("the correlation at the threshold is below 0.10")
    if positive_rate is not None and base_rate is not None and not 0.1 * base_rate < positive_rate < 0.98:
        reasons.append("the threshold accepts almost nothing or almost everything")
    return reasons


def calibrate(hypotheses: DataFrame, profiles: DataFrame, evidence: DataFrame, windows: DataFrame, durations: DataFrame, truth: DataFrame, matches: DataFrame, games: DataFrame, settings: Settings, levels: list[float], penalties: list[float], present: DataFrame | None = None, draws: int = DRAWS) -> Calibration:
    """Segmentation, mode, utility model and threshold from matched hypotheses.

    ``truth``: vid, gt_pos, g_spans; ``matches``: vid, event, gt_pos, rating;
    ``games``: vid, game (at least three games).  The target of a hypothesis is
    rating / 5 times the overlap of its spans with its bug, 0 without a match.
    """
    bugs = truth.join(games, "vid")
    names = sorted(r["game"] for r in bugs.select("game").where("game is not null").distinct().limit(MAX_CLUSTERS + 1).collect())
    require(3 <= len(names) <= MAX_CLUSTERS, "calibration needs three games, and at most as many as can be folded")
    rated = matches.join(truth, ["vid", "gt_pos"]).join(games, "vid")
    correct = rated.where(F.col("rating") >= settings.least_rating).select("vid", "event", "game", "g_spans").join(hypotheses.select("vid", "event", "members"), ["vid", "event"]).join(profiles, ["vid", "event"])
    correct = cut_lineage(correct)
    table, held = [], math.nan
    if settings.use_segmentation:
        table, held = choose_segmentation(segmentation_cells(correct, windows, durations, levels, penalties, settings), group_folds(names, settings.folds, settings.seed))
        if table:
            settings = replace(settings, level=table[0][0], penalty=table[0][1])
    rows = cut_lineage(hypothesis_features(hypotheses, profiles, evidence, settings))
    matched = correct.select("vid", "event", "g_spans").join(rows, ["vid", "event"])
    mode_iou = {r["mode"]: r["mean_iou"] for r in mode_table(matched, windows, durations, settings, present).collect()}
    settings = replace(settings, mode=choose_mode(mode_iou, settings.mode))
    spans = hypothesis_spans(rows, windows, durations, settings, present)
    aims = rated.where("rating > 0").join(spans, ["vid", "event"]).select("vid", "event", (F.col("rating") / 5 * temporal_iou(F.col("g_spans"), F.col("spans"))).alias("u"), (F.col("rating") >= settings.least_rating).cast("int").alias("correct"))
    labelled = cut_lineage(rows.join(games, "vid").join(aims, ["vid", "event"], "left").fillna(0.0, ["u"]).fillna(0, ["correct"]))
    require(labelled.count() >= settings.least_rows, f"calibration needs {settings.least_rows} hypotheses")
    features = list(FEATURES)
    oof = cut_lineage(cross_fit(labelled, "game", features, "u", settings.folds, settings.seed).withColumn("key", F.concat_ws(":", "vid", "event")))
    cut = f1_threshold(oof, "u", "oof", "key", truth.count()).collect()
    auc = cluster_bootstrap_auc(pair_counts(oof, "game", "oof", "correct"), draws, settings.seed)
    return Calibration(fit_utility(labelled, features, "u"), settings.level, settings.penalty, settings.mode, cut[0]["threshold"] if cut else math.inf, table, held, mode_iou, auc, degenerate_reasons(auc["low"]), settings.switches())


def apply_calibration(settings: Settings, calibration: Calibration) -> Settings:
    """The settings with what the calibration found; it must be of this version and
    made with the same switches."""
    require(calibration.version == VERSION, "the calibration is of another version")
    differ = {k: v for k, v in calibration.switches.items() if settings.switches().get(k) != v}
    require(not differ, f"the calibration was made with other switches: {differ}")
    return replace(settings, level=calibration.level, penalty=calibration.penalty, mode=calibration.mode, threshold=calibration.threshold)


def run_hypotheses(hypotheses: DataFrame, profiles: DataFrame, evidence: DataFrame, windows: DataFrame, durations: DataFrame, model: LinearModel | None, settings: Settings, present: DataFrame | None = None) -> DataFrame:
    """(vid, event, utility, spans): the hypotheses a run reports: the best
    ``most_events`` of each video by predicted utility (1 where that is off) of at
    least the threshold, equal ones by rank, with their spans; those without a span
    are left out."""
    require(model is not None or not settings.use_utility, "a run with utilities needs a calibrated model")
    rows = hypothesis_features(hypotheses, profiles, evidence, settings)
    scored = cut_lineage(rows.withColumn("utility", model.predict() if settings.use_utility else F.lit(1.0)))
    kept = top_events(scored, ["vid"], "utility", "rank", settings.threshold if settings.use_utility else None, settings.most_events)
    spans = hypothesis_spans(kept, windows, durations, settings, present)
    return kept.select("vid", "event", "utility").join(spans, ["vid", "event"]).where(F.size("spans") > 0)


def baseline_spans(answers: DataFrame, durations: DataFrame) -> DataFrame:
    """(vid, pos, spans): what a single call reported (vid, pos, description,
    spans), cut to the video and merged; without text or span it does not count."""
    cut = answers.join(durations.select("vid", "duration"), "vid", "left").select("vid", "pos", "description", once(clip_spans(F.col("spans"), F.col("duration")), "spans"))
    return cut.where((F.trim("description") != "") & (F.size("spans") > 0)).select("vid", "pos", "spans")


def paired_auc(scores: DataFrame, first: str, second: str, label: str) -> DataFrame:
    """(vid, a, b, delta) of the videos where both series have an AUC: ``second``
    less ``first``, per video."""
    one = roc_auc(scores, ["vid"], first, label).select("vid", F.col("auc").alias("a"))
    other = roc_auc(scores, ["vid"], second, label).select("vid", F.col("auc").alias("b"))
    return one.join(other, "vid").where("a is not null and b is not null").withColumn("delta", F.col("b") - F.col("a"))


def paired_auc_test(pairs: DataFrame) -> dict[str, float]:
    """Mean difference and signed-rank p-value of ``paired_auc``."""
    row = pairs.agg(F.count("*").alias("n"), F.avg("delta").alias("m")).collect()[0]
    return {"n_videos": row["n"], "mean_delta": row["m"], "p": signed_rank_p(*signed_rank_statistics(pairs, "delta"))}


def ablate(variants: dict[str, Settings], run) -> DataFrame:
    """(method, columns of the results): ``run(settings)``, a calibration, run and
    evaluation, for each variant of the settings, put together."""
    out = None
    for name, settings in variants.items():
        one = run(settings).withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
