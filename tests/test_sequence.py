import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators.search import bisect_offset, bisect_onset, gallop, ground_event
from strandframe.operators.sequence import even_sample, extend_over_gaps, hmm_posterior, islands, member_runs, onset_offset, segment_members, top_segments, transitions


def value(spark, expression, data, kind):
    return spark.createDataFrame([(data,)], f"x {kind}").select(expression(F.col("x")).alias("y")).collect()[0]["y"]


@pytest.mark.parametrize(("profile", "penalty", "members"), [([1, -3, 2, 2, -0.5, 1, -4, 0.5], 1e9, [2, 3, 4, 5]), ([1, -3, 2, 2, -0.5, 1, -4, 0.5], 0.0, [0, 2, 3, 5, 7]), ([-3, -1, -2], 1.0, [1]), ([], 1.0, [])])
def test_segments_golden(spark, profile, penalty, members):
    assert value(spark, lambda x: segment_members(x, 0.0, penalty), [float(v) for v in profile], "array<double>") == members


def test_segments_against_all_masks(spark):
    rng = random.Random(5)
    profiles = [[rng.gauss(0, 1.5) for _ in range(rng.randint(1, 7))] for _ in range(25)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(profiles)], "i int, p array<double>")
    for level, penalty in ((-0.5, 0.0), (0.0, 0.8), (0.7, 3.0)):
        got = {r["i"]: r["m"] for r in df.select("i", segment_members(F.col("p"), level, penalty).alias("m")).collect()}

        def score(p, mask, level=level, penalty=penalty):
            starts = sum(1 for k, m in enumerate(mask) if m and not (k and mask[k - 1]))
            return sum(x - level for x, m in zip(p, mask, strict=True) if m) - penalty * (starts - 1)

        for i, p in enumerate(profiles):
            best = max(score(p, mask) for mask in itertools.product([0, 1], repeat=len(p)) if any(mask))
            assert score(p, [int(k in got[i]) for k in range(len(p))]) == pytest.approx(best)


def test_posterior_against_enumeration(spark):
    rng, a, b = random.Random(1), 0.2, 0.35
    x = [rng.gauss(0, 2) for _ in range(6)]
    start, move = [b / (a + b), a / (a + b)], [[1 - a, a], [b, 1 - b]]
    mass = [[0.0, 0.0] for _ in x]
    for path in itertools.product([0, 1], repeat=len(x)):
        p = start[path[0]] * math.prod(move[s][t] for s, t in itertools.pairwise(path)) * math.exp(sum(e for e, s in zip(x, path, strict=True) if s))
        for k, s in enumerate(path):
            mass[k][s] += p
    got = value(spark, lambda c: hmm_posterior(c, a, b), x, "array<double>")
    assert got == pytest.approx([m[1] / sum(m) for m in mass])
    independent = value(spark, lambda c: hmm_posterior(c, 0.3, 0.7), [1.5, -2.0], "array<double>")
    assert independent == pytest.approx([1 / (1 + math.exp(-(e + math.log(0.3 / 0.7)))) for e in (1.5, -2.0)])
    assert value(spark, lambda c: hmm_posterior(c, 0.2, 0.2), [800.0, -800.0], "array<double>") == pytest.approx([1.0, 0.0], abs=1e-6)


def test_runs_gaps_and_samples(spark):
    assert [tuple(r) for r in value(spark, member_runs, [5, 1, 2, 2, 3], "array<int>")] == [(1, 3), (5, 5)]
    rows = spark.createDataFrame([("v", 5), ("v", 6), ("v", 8), ("v", 9), ("v", 9), ("v", None)], "v string, i int")
    assert sorted((r["first"], r["last"]) for r in islands(rows, ["v"], "i").collect()) == [(5, 6), (8, 9)]
    assert [(r["first"], r["last"]) for r in islands(rows, ["v"], "i", gap=1).collect()] == [(5, 9)]
    assert value(spark, lambda c: extend_over_gaps(c, F.lit(6), 1), [5, 6, 8, 9], "array<int>") == 9
    present = [10 <= i <= 20 for i in range(30)]
    assert tuple(value(spark, lambda c: onset_offset(c, F.lit(15)), present, "array<boolean>")) == (10, 20)
    assert value(spark, lambda c: onset_offset(c, F.lit(3)), present, "array<boolean>") is None
    assert spark.range(1).select(even_sample(F.lit(10), 4).alias("s")).collect()[0]["s"] == [0, 3, 6, 9]
    assert spark.range(1).select(even_sample(F.lit(0), 4).alias("s")).collect()[0]["s"] == []
    best = spark.createDataFrame([([1.0, -5.0, 9.0, -5.0, 4.0],)], "p array<double>").select(top_segments(member_runs(F.array(F.lit(0), F.lit(2), F.lit(4))), F.col("p"), 0.0, 2).alias("t")).collect()[0]["t"]
    assert [tuple(r) for r in best] == [(2, 2), (4, 4)]


def test_transitions_golden(spark):
    rows = [("a", i, y) for i, y in enumerate([0, 0, 1, 1, 0])] + [("b", i, y) for i, y in enumerate([0, 1])]
    r = transitions(spark.createDataFrame(rows, "s string, i int, y int"), ["s"], "i", "y", add=0.0).collect()[0]
    assert (r["a"], r["b"]) == (pytest.approx(2 / 3), pytest.approx(1 / 2))


def test_searches():
    calls = []

    def present(i):
        calls.append(i)
        return 10 <= i <= 20

    assert bisect_onset(present, 0, 15) == (10, 0) and bisect_offset(present, 15, 29) == (20, 0)
    assert gallop(present, 15, 1, 29) == 20 and gallop(present, 15, -1, 0) == 10
    marks = {5, 6, 8, 9, 20}
    assert ground_event(marks.__contains__, [6, 20, 12], 30) == [(5, 9), (20, 20)]
