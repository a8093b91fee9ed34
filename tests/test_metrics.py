import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.operators.assign import assign_within, best_assignment
from strandframe.operators.metrics import average_precision, best_threshold, confusion_sweep, evaluation_aggregate, f1_threshold, holm, icc_oneway, roc_auc
from strandframe.operators.models import cross_fit, fit_logistic, fit_utilities, fit_utility, group_folds
from strandframe.operators.ranking import arg_max, stratified_limit, top_events, top_k
from strandframe.operators.resample import bootstrap_ci, cluster_bootstrap_auc, exact_permutation, pair_counts, paired_bootstrap, permutation_p, poisson_bootstrap, signed_rank_p, signed_rank_statistics, student_quantile, wilcoxon_p
from strandframe.operators.ordered import exact_medians, exact_quantiles
from strandframe.operators.robust import collapse_logprobs, log_odds, normalise_logprobs, robust_z


def test_auc_against_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), float(rng.randint(0, 9)), rng.randint(0, 1)) for _ in range(200)] + [("a", None, 1), ("a", float("nan"), 0), ("c", 1.0, 1)]
    got = {r["g"]: r["auc"] for r in roc_auc(spark.createDataFrame(rows, "g string, s double, y int"), ["g"], "s", "y").collect()}
    for g in "ab":
        pos, neg = ([s for h, s, y in rows if h == g and y == k and s is not None and s == s] for k in (1, 0))
        assert got[g] == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg))
    assert got["c"] is None
    assert roc_auc(spark.createDataFrame([], "s double, y int"), [], "s", "y").collect()[0]["auc"] is None
    flat = spark.createDataFrame([(1.0, 0), (1.0, 1)], "s double, y int")
    assert roc_auc(flat, [], "s", "y").collect()[0]["auc"] == 0.5


def test_average_precision_and_mcc(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 0), (3, 0.7, 1), (4, 0.1, 0)], "i int, s double, y int")
    assert average_precision(df, [], "s", "y", "i").collect()[0]["ap"] == pytest.approx((1 + 2 / 3) / 2)
    best = best_threshold(confusion_sweep(df, "s", "y")).collect()[0]
    assert 0.1 < best["t"] <= 0.9 and best["mcc"] > 0.5


def test_icc_and_robust_z(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), float(m + e)) for g, m in enumerate(rng.normal(0, 1, 60)) for e in rng.normal(0, 1, 10)]
    assert icc_oneway(spark.createDataFrame(rows, "g int, x double"), "g", "x").collect()[0]["icc"] == pytest.approx(0.5, abs=0.15)
    assert icc_oneway(spark.createDataFrame([(1, 1.0), (1, 2.0)], "g int, x double"), "g", "x").collect()[0]["icc"] is None
    z = robust_z(spark.createDataFrame([("v", x) for x in (0.0, 0.0, 0.0, 0.0, 10.0)], "v string, x double"), ["v"], "x", "z").collect()
    assert sorted(r["z"] for r in z) == [0, 0, 0, 0, 40]


def test_logprobs(spark):
    tokens = [("Yes", -0.2), (" yes", -2.0), ("Maybe", -3.0)]
    df = spark.createDataFrame([(tokens,)], "t array<struct<token:string,logprob:double>>")
    r = df.select(collapse_logprobs(F.col("t"), ["yes", "no"]).alias("c")).collect()[0]["c"]
    assert r["yes"] == pytest.approx(np.logaddexp(-0.2, -2.0)) and r["no"] == -3.0 and r["truncated"]
    m = spark.createDataFrame([({"a": -1.0, "b": -2.0},)], "m map<string,double>").select(normalise_logprobs(F.col("m")).alias("m"))
    got = m.select("m", log_odds(F.col("m"), "a", "b").alias("d")).collect()[0]
    assert sum(np.exp(v) for v in got["m"].values()) == pytest.approx(1) and got["d"] == pytest.approx(1)


def test_f1_threshold_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.random(), round(rng.random(), 1)) for i in range(60)]
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    values = [2 * sum(r[1] for r in order[: k + 1]) / (k + 1 + 25) for k in range(60)]
    got = f1_threshold(spark.createDataFrame(rows, "i int, u double, e double"), "u", "e", "i", 25).collect()[0]
    assert got["f1"] == pytest.approx(max(values)) and got["threshold"] == order[got["n_emitted"] - 1][2]
    assert f1_threshold(spark.createDataFrame([(1, 0.0, 0.5)], "i int, u double, e double"), "u", "e", "i", 25).collect() == []


def test_evaluation_golden(spark):
    rows = [("v1", 2, 2, 9.0, 6.5, 1.5, 2), ("v2", 0, 1, 0.0, 0.0, 0.0, 0), ("v3", 1, 2, 0.0, 0.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "vid string, gt_num int, pred_num int, score_sum double, score_iou_sum double, iou_sum double, n_pairs int")
    r = evaluation_aggregate(df, []).collect()[0]
    assert (r["precision"], r["recall"], r["precision_iou"], r["recall_iou"], r["mean_iou"]) == tuple(map(pytest.approx, (9 / 25, 9 / 15, 6.5 / 25, 6.5 / 15, 2.5 / 3)))


def test_holm_is_step_down(spark):
    got = holm(spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.2), ("d", 0.013)], "n string, p double"), "n", "p").orderBy("rank").collect()
    assert [r["rejected"] for r in got] == [True, True, True, False]


def test_ranking(spark):
    df = spark.createDataFrame([(g, i, float(i % 3)) for g, n in (("A", 6), ("B", 6), ("C", 6)) for i in range(n)], "g string, i int, u double")
    assert [r["g"] for r in stratified_limit(df, "g", [F.col("i")], 5).collect()] == ["A", "B", "C", "A", "B"]
    assert stratified_limit(df, "g", [F.col("i")], 0).count() == 18
    assert sorted(r["i"] for r in top_k(df.where("g = 'A'"), ["g"], 2, [F.desc("u"), F.col("i")]).collect()) == [2, 5]
    assert sorted(r["i"] for r in top_events(df.where("g = 'A'"), ["g"], "u", "i", 1.0, 3).collect()) == [1, 2, 5]
    assert arg_max(df, ["g"], "u", "i", ["i"]).where("g = 'B'").collect()[0]["i"] == 2


def test_assignment_against_brute_force(spark):
    rng = np.random.default_rng(2)
    for _ in range(60):
        n, m = map(int, rng.integers(1, 5, 2))
        s = rng.integers(0, 6, (n, m)).astype(float)
        pairs = best_assignment(s)
        small, large = min(n, m), max(n, m)
        t = s if n <= m else s.T
        assert len({r for r, _ in pairs}) == len({c for _, c in pairs}) == small
        assert sum(s[r, c] for r, c in pairs) == max(sum(t[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(large), small))
    df = spark.createDataFrame([("v", 0, 0, 5), ("v", 0, 1, 4), ("v", 1, 0, 4), (None, 0, 0, 1)], "v string, g int, p int, r int")
    assert sorted((x["g"], x["p"], x["r"]) for x in assign_within(df, "v", "g", "p", "r").collect()) == [(0, 1, 4.0), (1, 0, 4.0)]


def test_groups_are_assigned_in_batches(spark):
    """No pandas call a group; across batches every group has its own best pairs."""
    rng = random.Random(3)
    rows = [(v, f"r{rng.randrange(4)}", c, rng.randrange(6)) for v in range(400) for c in range(rng.randrange(1, 6)) for _ in range(rng.randrange(1, 4))]
    rows += [(0, None, 1, 5), (1, "r0", None, 5), (2, "r9", 9, None), (None, "r0", 0, 5), (999, "r0", 0, None)]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        out = assign_within(spark.createDataFrame(rows, "v bigint, g string, p int, r int"), "v", "g", "p", "r")
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
        got = sorted(map(tuple, out.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = []
    for v in range(400):
        own = [x for x in rows if x[0] == v and None not in x]
        g, p = sorted({x[1] for x in own}), sorted({x[2] for x in own})
        s = np.zeros((len(g), len(p)))
        for _, a, b, r in own:
            s[g.index(a), p.index(b)] = max(s[g.index(a), p.index(b)], r)
        pairs = best_assignment(s)
        assert sum(s[i, j] for i, j in pairs) == max(sum(s[i, j] for i, j in (zip(range(len(g)), q) if len(g) <= len(p) else zip(q, range(len(p))))) for q in itertools.permutations(range(max(s.shape)), min(s.shape)))
        want += [(v, g[i], p[j], s[i, j]) for i, j in pairs]
    assert got == sorted(want)


def test_permutations(spark):
    two = spark.createDataFrame([("a", 1.0, 0.0), ("b", 1.0, 0.0)], "g string, x double, y double")
    assert exact_permutation(two, "g", "x", "y").collect()[0]["p"] >= 0.5
    eight = spark.createDataFrame([(str(i), 1.0, 0.0) for i in range(8)], "g string, x double, y double")
    assert exact_permutation(eight, "g", "x", "y").collect()[0]["p"] == pytest.approx(2**-7)
    assert permutation_p(np.ones(8), 10_000, 0) == pytest.approx(2**-7)
    assert permutation_p(np.ones(30), 1000, 0) == pytest.approx(1 / 1001)


def test_resampling():
    assert [student_quantile(0.975, n) for n in (1, 7, 1000)] == pytest.approx([12.7062, 2.36462, 1.96234], rel=1e-4)
    assert wilcoxon_p(np.arange(1, 6)) == 1.0
    assert wilcoxon_p(np.arange(1, 11)) == pytest.approx(2 / 1024)
    assert 0 < wilcoxon_p(np.array([1.0, -1, 2, 2, -2, 3, 4, 5, -1, 6, 2, 2])) < 0.1
    sums = np.column_stack([np.arange(20.0), np.ones(20)])
    estimate, low, high = bootstrap_ci(sums, lambda s: s[..., 0] / s[..., 1], 500, 1)
    assert low < estimate < high
    assert paired_bootstrap(sums + 1, sums, lambda s: s[..., 0], 200, 1)[1] == pytest.approx(20)
    rng = np.random.default_rng(0)


@pytest.mark.parametrize("parts", [1, 5])
def test_cluster_resamples(spark, parts):
    """Weighted pair counts give the AUC of the rows drawn, whatever the partitions; one cluster holds most rows."""
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = np.random.default_rng(0)
        rows = [(f"c{0 if rng.random() < 0.5 else rng.integers(6)}", float(np.round(y + rng.normal(0, 0.7), 1)), int(y)) for y in rng.integers(0, 2, 400)]
        rows += [("c1", None, 1), (None, 0.5, 1), ("c2", float("nan"), 0), ("c3", 0.1, None)]
        counts = pair_counts(spark.createDataFrame(rows, "g string, s double, y int"), "g", "s", "y")
        usable = [r for r in rows if r[0] and r[1] is not None and r[1] == r[1] and r[2] is not None]
        weights = np.array([[1] * 6, [2, 0, 1, 0, 3, 0]], dtype=float)
        for w, auc in zip(weights, counts.auc(weights)):
            drawn = [r for r in usable for _ in range(int(w[counts.names.index(r[0])]))]
            pos, neg = ([r[1] for r in drawn if r[2] == k] for k in (1, 0))
            assert auc == pytest.approx(np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg]))
        signal = cluster_bootstrap_auc(counts, 200, 0)
        assert signal["low"] > 0.5 and signal["low"] < signal["auc"] < signal["high"]
        assert np.isnan(cluster_bootstrap_auc(pair_counts(spark.createDataFrame([], "g string, s double, y int"), "g", "s", "y"))["auc"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_signed_ranks_and_draws(spark):
    rng = np.random.default_rng(2)
    d = [float(x) for x in np.round(rng.normal(0.3, 1, 60), 1)] + [0.0, float("nan")]
    df = spark.createDataFrame([(x,) for x in d] + [(None,)], "d double")
    assert signed_rank_p(*signed_rank_statistics(df, "d")) == pytest.approx(wilcoxon_p(np.array(d)))
    assert signed_rank_p(*signed_rank_statistics(df.limit(0), "d")) == 1.0
    rows = spark.createDataFrame([(i, float(i)) for i in range(50)] + [(None, 3.0)], "k int, x double")
    drawn = {r["draw"]: r["x"] for r in poisson_bootstrap(rows, "k", ["x"], 300, 1).collect()}
    assert drawn[-1] == sum(range(50)) + 3 and len(drawn) == 301
    values = np.array([v for k, v in drawn.items() if k >= 0])
    assert abs(values.mean() - drawn[-1]) < 40 and abs(values.std() - np.sqrt(sum(i * i for i in range(50)))) < 30


def test_hot_group_quantiles(spark):
    """Medians and running sums of 10^6 rows of which one group holds a third, with ties."""
    df = spark.range(1_000_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), (F.col("id") * 7919 % 1000 / 10).alias("x"))
    want = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.median("x").alias("m")).collect()}
    assert {r["g"]: r["m"] for r in exact_medians(df, ["g"], "x", "m").collect()} == pytest.approx(want)
    q = exact_quantiles(df, [], "x", [0.0, 0.1, 0.9, 1.0]).collect()[0]["q"]
    assert q == pytest.approx(df.agg(F.percentile("x", F.array(*[F.lit(p) for p in (0.0, 0.1, 0.9, 1.0)])).alias("q")).collect()[0]["q"])
    assert exact_medians(df.limit(0), ["g"], "x", "m").collect() == []
    one = spark.createDataFrame([(None, 1.0), (None, 4.0), ("a", None), ("b", float("nan")), ("b", 2.0)], "g string, x double")
    assert {r["g"]: r["m"] for r in exact_medians(one, ["g"], "x", "m").collect()} == {None: 2.5, "b": 2.0}


def test_fractional_logistic(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = 1 / (1 + np.exp(-(0.5 + x @ np.array([1.0, -2.0]))))
    df = spark.createDataFrame([(float(a), float(b), float(t), str(i % 6)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))], "a double, b double, t double, g string")
    weights, bias = fit_logistic(df, ["a", "b"], "t", ridge=1e-6)
    assert [*weights, bias] == pytest.approx([1.0, -2.0, 0.5], abs=1e-3)
    folds = group_folds(list("abcdef"), 3, 0)
    assert sorted(folds.values()) == [0, 0, 1, 1, 2, 2]
    held = cross_fit(df, "g", ["a", "b"], "t", folds=3)
    assert held.where("oof is null").count() == 0 and held.select(F.avg(F.abs(F.col("oof") - F.col("t")))).collect()[0][0] < 0.05
    constant = fit_utility(df.limit(3), ["a", "b"], "t")
    assert constant.features == ()


def test_models_are_fitted_side_by_side(spark):
    """The folds' models share their passes, and each is the one of its own rows."""
    rng = random.Random(8)
    rows = [(k, rng.gauss(k, 1 + k), rng.random() if k < 3 else 0.25) for k in range(4) for _ in range(60)] + [(0, None, 0.5), (1, 0.5, None)]
    df = spark.createDataFrame(rows, "k int, a double, t double").withColumn("b", F.col("a") * F.col("a")).persist()
    found = fit_utilities(df, "k", ["a", "b"], "t")
    for k in range(3):
        x = np.array([(r[1], r[1] ** 2) for r in rows if r[0] == k and r[1] is not None])  # scaled by all rows with features
        own = np.array([(r[1], r[1] ** 2, r[2]) for r in rows if r[0] == k and None not in r])
        z = np.column_stack([(own[:, :2] - x.mean(axis=0)) / x.std(axis=0), np.ones(len(own))])
        beta = np.array([*found[k].weights, found[k].bias])
        gradient = z.T @ (1 / (1 + np.exp(-z @ beta)) - own[:, 2]) + np.array([1.0, 1.0, 0.0]) * beta
        assert np.allclose(found[k].mean, x.mean(axis=0)) and np.allclose(found[k].sd, x.std(axis=0)) and np.abs(gradient).max() < 1e-8
        one = fit_utility(df.where(F.col("k") == k), ["a", "b"], "t")
        assert np.allclose([*one.weights, one.bias], beta)
    assert found[3].features == () and found[3].bias == pytest.approx(np.log(1 / 3))
    spark.sparkContext.setJobGroup("folds", "")
    try:
        cross_fit(df.withColumn("g", F.concat(F.lit("g"), (F.monotonically_increasing_id() % 9).cast("string"))), "g", ["a", "b"], "t", folds=5)
    finally:
        spark.sparkContext.setJobGroup("rest", "")
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("folds")) <= 40
