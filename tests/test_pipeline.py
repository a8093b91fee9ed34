import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators.intervals import temporal_iou
from strandframe.operators.models import LinearModel
from strandframe.plans.hypotheses import FEATURES, Settings, ablate, apply_calibration, baseline_spans, calibrate, choose_mode, choose_segmentation, degenerate_reasons, hypothesis_features, hypothesis_series, hypothesis_spans, match_hypotheses, paired_auc, paired_auc_test, presence, run_hypotheses, segmentation_cells, segments_of
from strandframe.plans.pipeline import compare_methods, evaluate, generic_evidence, method_table, rank_hypotheses, resolve_events, screened_probabilities, signal_summary, verified_profiles

SPANS = "array<struct<start:double,end:double>>"


def fixture(spark):
    """Two videos of 12 s in windows of 2 s; the first has a true span of 4 to 8 s."""
    windows = spark.createDataFrame([(v, i, 2.0 * i, 2.0 * i + 2, [2.0 * i + j / 4 for j in range(8)]) for v in ("a", "b") for i in range(6)], "vid string, idx int, start_s double, end_s double, frame_times array<double>")
    scores = windows.select("vid", "idx", F.when((F.col("vid") == "a") & F.col("idx").isin(2, 3), 3.0).otherwise(-1.0).alias("lo_raw"))
    return windows, scores


def test_run_finds_the_span(spark):
    windows, scores = fixture(spark)
    evidence = generic_evidence(scores, spark.createDataFrame([("a", 0.5)], "vid string, lo_cf double"))
    observations = spark.createDataFrame([("a", 0, 2, "red car", "float"), ("a", 1, 3, "car red", "Float"), ("a", 2, 5, "tree", "flicker")], "vid string, obs_id bigint, idx int, entity string, kind string")
    claims = spark.createDataFrame([("a", 0, "2"), ("a", 1, "2"), ("a", 1, "nine"), ("a", 1, "77")], "vid string, event int, obs string")
    events = resolve_events(observations, claims)
    assert {(r["event"], r["idx"]) for r in events.collect()} == {("m0", 5), ("f|car red|float", 2), ("f|car red|float", 3)}
    ranked = rank_hypotheses(events, evidence, 1)
    assert [r["members"] for r in ranked.collect()] == [[2, 3]]
    verified = verified_profiles(ranked, scores.crossJoin(ranked.select("event")).select("vid", "event", "idx", F.col("lo_raw").alias("lo")), spark.createDataFrame([], "vid string, event string, lo_prior double"))
    hypotheses = ranked.select("vid", "event", "members", "rank", F.lit(False).alias("forced"), F.lit(None).cast("double").alias("prior"))
    settings = Settings(threshold=0.5)
    rows = hypothesis_features(hypotheses, verified, evidence, settings)
    told = rows.collect()[0]
    assert (told["prof_contrast"], told["support"], told["seg_frac"], told["prof_max"], told["prof_top2"], told["prior"]) == (4.0, 2 / 6, 2 / 6, 3.0, 3.0, 0.0)
    assert (told["gen_lo"], told["rank_inv"]) == (2.5, 1.0)
    model = LinearModel(FEATURES, (0.0,) * 11, (1.0,) * 11, (1.0,) * 11, 0.0)
    lengths = spark.createDataFrame([("a", 7.5), ("b", None)], "vid string, duration double")
    out = run_hypotheses(hypotheses, verified, evidence, windows, lengths, model, settings).collect()
    assert [(r["vid"], [(s["start"], s["end"]) for s in r["spans"]]) for r in out] == [("a", [(4.0, 7.5)])]
    assert run_hypotheses(hypotheses, verified, evidence, windows, lengths, model, Settings(threshold=1.1)).collect() == []
    frames = spark.createDataFrame([("a", told["event"], i, f, 1.0 if (i, f) in ((2, 3), (2, 4), (3, 1)) else 0.5) for i in (2, 3) for f in range(8)] * 2, "vid string, event string, idx int, frame int, lo double")
    seen = presence(frames, 0.0, 0.5)
    assert {(r["idx"], r["first"], r["last"]) for r in seen.collect()} == {(2, 3, 4), (3, 1, 1)}
    got = {mode: [(s["start"], s["end"]) for s in hypothesis_spans(rows, windows, lengths, Settings(mode=mode), seen).collect()[0]["spans"]] for mode in ("window", "frame", "whole")}
    assert got == {"window": [(4.0, 7.5)], "frame": [(4.75, 6.5)], "whole": [(0.0, 7.5)]}
    series = {(r["vid"], r["idx"]): r["hyp_max"] for r in hypothesis_series(verified, evidence).collect()}
    assert series["a", 2] == 3.0 and series["b", 2] == -1.0


def test_segmentation_choice(spark):
    windows, _ = fixture(spark)
    profile = [-1.0, -1.0, 3.0, 3.0, -1.0, -1.0]
    correct = spark.createDataFrame([(v, "e", g, profile, [0], [(4.0, 8.0)]) for v, g in (("a", "g1"), ("b", "g2"))], f"vid string, event string, game string, profile array<double>, members array<int>, g_spans {SPANS}")
    cells = segmentation_cells(correct, windows, windows.select("vid", F.lit(None).cast("double").alias("duration")).distinct(), [0.0, 5.0], [1.0, 2.0], Settings())
    table, held = choose_segmentation(cells, {"g1": 0, "g2": 1})
    assert table[0] == (0.0, 1.0, 1.0) and len(table) == 4 and table[-1][2] < 1 and held == 1.0
    assert choose_segmentation(cells.limit(0), {})[0] == []
    assert choose_mode({"window": 0.5, "frame": 0.5, "whole": 0.4}, "frame") == "frame" and choose_mode({"window": None}, "whole") == "whole"


def test_segmentation_cells_are_cut_once(spark):
    """One pass of the segmentation over the cells, with the overlaps of the spans
    that a run of each cell finds; windows lost or given twice included."""
    rng = random.Random(4)
    windows = spark.createDataFrame([(v, i, float(i), i + rng.choice([1.0, 1.5]), [float(i)]) for v in ("a", "b") for i in [*range(12), 3] if (v, i) != ("b", 5)], "vid string, idx int, start_s double, end_s double, frame_times array<double>")
    lengths = spark.createDataFrame([("a", 9.5), ("b", None)], "vid string, duration double")
    correct = spark.createDataFrame([(v, e, "g", [rng.gauss(0, 2) for _ in range(12)], [0], [(2.0, 7.0)]) for v in ("a", "b") for e in ("x", "y")], f"vid string, event string, game string, profile array<double>, members array<int>, g_spans {SPANS}")
    cells = segmentation_cells(correct, windows, lengths, [-1.0, 0.5], [0.0, 1.0], Settings(most_segments=2))
    assert cells._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    got = {(r["vid"], r["event"], r["level"], r["penalty"]): r["iou"] for r in cells.collect()}
    assert len(got) == 16
    for level, penalty in ((-1.0, 0.0), (0.5, 1.0)):
        one = Settings(most_segments=2, level=level, penalty=penalty)
        rows = correct.withColumn("segs", segments_of(F.col("profile"), F.col("members"), one))
        for r in hypothesis_spans(rows, windows, lengths, one).join(correct.select("vid", "event", "g_spans"), ["vid", "event"]).select("vid", "event", temporal_iou(F.col("g_spans"), F.col("spans")).alias("iou")).collect():
            assert got[r["vid"], r["event"], level, penalty] == pytest.approx(r["iou"])


def test_matching_and_baseline(spark):
    truth = spark.createDataFrame([("a", 0, [(0.0, 2.0)]), ("a", 1, [(4.0, 8.0)])], f"vid string, gt_pos int, g_spans {SPANS}")
    spans = spark.createDataFrame([("a", "x", [(5.0, 8.0)]), ("a", "y", [(20.0, 21.0)])], f"vid string, event string, spans {SPANS}")
    got = {(r["event"], r["gt_pos"]): r["rating"] for r in match_hypotheses(truth, None, spans).collect()}
    assert got == {("x", 1): 5.0, ("y", 0): 0.0}
    ratings = spark.createDataFrame([("a", "x", 0, 5), ("a", "x", 1, 4), ("a", "y", 0, 3)], "vid string, event string, gt_pos int, rating int")
    assert {(r["event"], r["gt_pos"]) for r in match_hypotheses(truth, ratings).collect()} == {("x", 1), ("y", 0)}
    answers = spark.createDataFrame([("a", 0, "b", [(-1.0, 3.0), (2.0, 20.0)]), ("a", 1, " ", [(0.0, 1.0)]), ("a", 2, "c", [(30.0, 40.0)]), ("a", 3, None, None)], f"vid string, pos int, description string, spans {SPANS}")
    kept = baseline_spans(answers, spark.createDataFrame([("a", 10.0)], "vid string, duration double")).collect()
    assert [(r["pos"], [(s["start"], s["end"]) for s in r["spans"]]) for r in kept] == [(0, [(0.0, 10.0)])]


def test_paired_series(spark):
    rng = random.Random(1)
    rows = [(f"v{v}", i, int(i % 2), rng.random() + (i % 2) * 0.2, rng.random() + (i % 2) * 2) for v in range(14) for i in range(12)]
    pairs = paired_auc(spark.createDataFrame(rows, "vid string, idx int, y int, a double, b double"), "a", "b", "y")
    test = paired_auc_test(pairs)
    assert test["n_videos"] == 14 and test["mean_delta"] > 0.1 and test["p"] < 0.01


def test_evaluation_and_comparison(spark):
    spans = "vid string, pos int, spans array<struct<start:double,end:double>>"
    truth = spark.createDataFrame([("v1", 0, [(0.0, 4.0)]), ("v1", 1, [(6.0, 8.0)])], spans)
    predictions = spark.createDataFrame([("v1", 0, [(6.0, 8.0)]), ("v1", 1, [(0.0, 2.0)]), ("v2", 0, [(0.0, 1.0)])], spans)
    ratings = spark.createDataFrame([("v1", 0, 1, 5), ("v1", 1, 0, 4), ("v1", 0, 0, 1)], "vid string, gt_pos int, pred_pos int, rating int")
    got = {r["vid"]: r for r in evaluate(predictions, truth, ratings).collect()}
    assert (got["v1"]["score_sum"], got["v1"]["score_iou_sum"], got["v1"]["n_pairs"]) == (9.0, 6.5, 2)
    assert (got["v2"]["gt_num"], got["v2"]["pred_num"]) == (0, 1)
    rows = [(m, f"v{i}", f"g{i % 4}", float(s + i % 3), 2.0, 2.0, 1.0, 1.0, 1) for m, s in (("base", 1), ("new", 4)) for i in range(12)]
    results = spark.createDataFrame(rows, "method string, vid string, game string, score_sum double, pred_num double, gt_num double, score_iou_sum double, iou_sum double, n_pairs int")
    report = compare_methods(results, "method", "game", draws=200)
    assert report[0]["delta"] > 0 and report[0]["p_permutation"] == 0.125
    assert method_table(results, "method").count() == 2


def test_signals(spark):
    scored = spark.createDataFrame([(g, float(i), int(i > 2)) for g in "ab" for i in range(6)], "g string, s double, y int")
    assert signal_summary(scored, "g", "s", "y")["pooled_auc"] == 1.0
    assert len(degenerate_reasons(0.4, 0.05, 0.99, 0.5)) == 3 and degenerate_reasons(0.6, 0.3, 0.5, 0.5) == []
    e = spark.createDataFrame([("v", i, float(x), 0.1, 0.9) for i, x in enumerate((1, 5, 3, 4))], "vid string, idx int, lo_raw double, p1 double, p2 double")
    assert [r["p"] for r in screened_probabilities(e, 2).orderBy("idx").collect()] == [0.1, 0.9, 0.1, 0.9]


def test_calibration(spark):
    """Videos of ten windows; hypothesis x is right where its profile is high, y never."""
    rng = random.Random(6)
    videos, n = [(f"v{i}", f"g{i % 6}", rng.randint(2, 6)) for i in range(30)], 10
    profiles = [(v, e, [(2.0 if e == "x" and at <= i <= at + 1 else -1.0) + rng.gauss(0, 0.2) for i in range(n)]) for v, _, at in videos for e in "xy"]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    hypotheses = frame([(v, e, [at], 1 if e == "x" else 2, False, 0.0) for v, _, at in videos for e in "xy"], "vid string, event string, members array<int>, rank int, forced boolean, prior double")
    tables = {
        "hypotheses": hypotheses, "profiles": frame(profiles, "vid string, event string, profile array<double>"),
        "evidence": frame([(v, i, 0.1 * i, 0.0) for v, _, _ in videos for i in range(n)], "vid string, idx int, lo_abs double, rel_z double"),
        "windows": frame([(v, i, float(i), i + 1.0, [float(i)]) for v, _, _ in videos for i in range(n)], "vid string, idx int, start_s double, end_s double, frame_times array<double>"),
        "durations": frame([(v, float(n)) for v, _, _ in videos], "vid string, duration double"),
    }
    truth = frame([(v, 0, [(float(at), at + 2.0)]) for v, _, at in videos], f"vid string, gt_pos int, g_spans {SPANS}")
    games = frame([(v, g) for v, g, _ in videos], "vid string, game string")
    matches = match_hypotheses(truth, frame([(v, "x", 0, 5) for v, _, _ in videos] + [(v, "y", 0, 1) for v, _, _ in videos], "vid string, event string, gt_pos int, rating int"))
    found = calibrate(**tables, truth=truth, matches=matches, games=games, settings=Settings(), levels=[0.0, 5.0], penalties=[1.0], draws=200)
    assert (found.level, found.mode, found.reasons) == (0.0, "window", []) and found.held_out_iou > 0.9 and found.auc["auc"] == 1.0
    assert 0 < found.threshold < 1 and set(found.model.features) == set(FEATURES)
    settings = apply_calibration(Settings(), found)
    out = run_hypotheses(*tables.values(), found.model, settings).collect()
    assert {(r["vid"], r["event"]) for r in out} == {(v, "x") for v, _, _ in videos}
    with pytest.raises(ValueError, match="other switches"):
        apply_calibration(Settings(use_frames=False), found)
    both = ablate({"a": settings, "b": settings}, lambda s: run_hypotheses(*tables.values(), found.model, s).select("vid"))
    assert both.groupBy("method").count().count() == 2
