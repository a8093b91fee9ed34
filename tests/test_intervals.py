import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators.intervals import SPANS, clip_spans, covered_label, overlap_lengths, shrink_guarded, temporal_iou, union_as_written, union_spans, whole_seconds
from strandframe.operators.scan import running_sum
from strandframe.operators.skew import follow_join, salted_join
from strandframe.operators.sweep import clean_intervals, cover_periods, overlaps_and_gaps

OWNER = ["owner"]


def spans(df, *columns):
    return df.select(*[F.col(c).cast(SPANS).alias(c) for c in columns])


def one(spark, expression, **values):
    kinds = ", ".join(f"{k} {SPANS}" for k in values)
    df = spark.createDataFrame([tuple(values.values())], kinds)
    return df.select(expression.alias("x")).collect()[0]["x"]


def as_pairs(rows):
    return [(r["start"], r["end"]) for r in rows]


@pytest.mark.parametrize(("raw", "merged"), [([(3, 4), (0, 1), (0.5, 2)], [(0, 2), (3, 4)]), ([(3.0, 4.0), (0.0, 1.0), (2.0, 0.5), (7.0, 7.0), (None, 2.0)], [(0, 2), (3, 4)]), ([(0, 1), (1, 2)], [(0, 2)]), ([], []), (None, [])])
def test_union(spark, raw, merged):
    raw = raw and [tuple(None if v is None else float(v) for v in s) for s in raw]
    assert as_pairs(one(spark, union_spans(F.col("s")), s=raw)) == merged


@pytest.mark.parametrize(("a", "b", "iou"), [([], [], 1), ([(0, 1)], [], 0), ([(0, 4)], [(0, 2)], 0.5), ([(0, 2), (4, 6)], [(1, 5)], 1 / 3), ([(3, 4)], [(3, 3)], 0)])
def test_iou(spark, a, b, iou):
    a, b = ([(float(x), float(y)) for x, y in s] for s in (a, b))
    assert one(spark, temporal_iou(union_as_written(F.col("a")), union_as_written(F.col("b"))), a=a, b=b) == pytest.approx(iou)


def test_clip_floor_and_shrink(spark):
    assert as_pairs(one(spark, clip_spans(F.col("s"), F.lit(5.0)), s=[(-1.0, 2.0), (4.0, 9.0)])) == [(0, 2), (4, 5)]
    assert as_pairs(one(spark, whole_seconds(F.col("s")), s=[(1.9, 2.2)])) == [(1, 2)]
    r = spark.range(1).select(shrink_guarded(F.lit(0.0), F.lit(2.0), F.lit(0.9), F.lit(1.0), 0.5).alias("r")).collect()[0]["r"]
    assert (r["start"], r["end"]) == pytest.approx((0.45, 1.45))


def test_overlap_lengths_and_labels(spark):
    windows = spark.createDataFrame([("v", 1, 0.0, 100.0), ("v", 2, 59.0, 61.0), ("v", 3, 200.0, 201.0), ("v", 4, 5.0, 5.0), (None, 5, 0.0, 1.0)], "k string, w int, w_start double, w_end double")
    cover = spark.createDataFrame([("v", 10.0, 30.0), ("v", 60.0, 130.0)], "k string, s_start double, s_end double")
    got = {r["w"]: r["covered"] for r in overlap_lengths(windows, cover, "k", "w").collect()}
    assert got == {1: pytest.approx(60.0), 2: pytest.approx(1.0)}
    labels = spark.createDataFrame([(0.25, 0.0, 1.0), (0.2, 0.0, 1.0), (None, 0.0, 1.0), (1.0, 2.0, 2.0)], "c double, a double, b double").select(covered_label(F.col("c"), F.col("a"), F.col("b")).alias("y"))
    assert [r["y"] for r in labels.collect()] == [1, 0, 0, 0]


def brute(rows):
    periods, found = {}, set()
    by = {}
    for o, a, b in rows:
        if o is not None and a is not None and b is not None and a != b:
            by.setdefault(o, set()).add((min(a, b), max(a, b)))
    for o, ivs in by.items():
        out = []
        for a, b in sorted(ivs):
            if out and a <= out[-1][1]:
                out[-1][2] |= a < out[-1][1]
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b, False])
        periods[o] = out
        found |= {(o, "merged", a, b) for a, b, laps in out if laps}
        found |= {(o, "gap", p[1], q[0]) for p, q in zip(out, out[1:], strict=False) if q[0] - p[1] <= 50}
    return found


@pytest.mark.parametrize("seed", range(6))
def test_periods_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.randint(0, 900), None if rng.random() < 0.05 else rng.randint(0, 900)) for _ in range(rng.choice([0, 5, 60]))]
    rows = [(o, a, b if b is None or rng.random() < 0.1 else min(a + 30, b)) for o, a, b in rows]
    df = spark.createDataFrame(rows + rows[:3], "owner string, a bigint, b bigint")
    periods = cover_periods(clean_intervals(df, OWNER, F.col("a"), F.col("b")), OWNER, bits=4)
    got = {tuple(r) for r in overlaps_and_gaps(periods, OWNER, 50).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_running_sum(spark, levels):
    rng = random.Random(levels)
    rows = [(g, p, rng.randint(-3, 3)) for g in ("a", None) for p in rng.sample(range(4000), 60)]
    got = running_sum(spark.createDataFrame(rows, "g string, p bigint, v int"), ["g"], "p", "v", "s", bits=4, levels=levels).collect()
    assert {(r["g"], r["p"]): r["s"] for r in got} == {(g, p): sum(v for h, q, v in rows if h == g and q <= p) for g, p, _ in rows}


def test_salted_join_equals_join(spark):
    left = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n")).where("k is null or k <> 'k7'").withColumn("v", F.upper("k"))
    for how, part_rows in (("inner", 100), ("left", 100), ("left", 1 << 20)):
        got = {tuple(r) for r in salted_join(left, right, ["k"], "n", ["id"], how, part_rows=part_rows).select("k", "id", "v").collect()}
        assert got == {tuple(r) for r in left.join(right, "k", how).select("k", "id", "v").collect()}
        assert got == {tuple(r) for r in follow_join(left, right, ["k"], ["id"], how, part_rows=part_rows).select("k", "id", "v").collect()}
