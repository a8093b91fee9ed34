import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandframe.llm.splits import deal_splits, group_records, leads, spanning_forest, split_report


def components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    groups = defaultdict(list)
    for x in parent:
        groups[root(x)].append(x)
    return {x: min(g) for g in groups.values() for x in g}


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_forest(spark, kind, tmp_path):
    rng = random.Random(2)
    edges = {"random": [(f"n{rng.randint(0, 40):02}", f"n{rng.randint(0, 40):02}") for _ in range(35)], "path": [(f"n{i:02}", f"n{i + 1:02}") for i in range(30)], "star": [("hub", f"n{i:02}") for i in range(30)], "none": []}[kind]
    edges = sorted({(min(e), max(e)) for e in edges if e[0] != e[1]})
    forest, labels = spanning_forest(spark.createDataFrame(edges, "node_a string, node_b string"), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/forest").count() == forest.count() and spark.read.parquet(f"{tmp_path}/labels").count() == labels.count()
    tree = [tuple(r) for r in forest.collect()]
    want = components(edges)
    assert {r["node"]: r["lead"] for r in leads(labels).collect()} == want
    assert set(tree) <= set(edges) and components(tree) == want
    assert len(tree) == len(want) - len(set(want.values()))


def test_groups_and_splits(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["g1", "g1", "g2", f"h{rng.randint(0, 60)}", None]), rng.choice([f"v{rng.randint(0, 200)}", f"v{rng.randint(0, 2000)}", None]), "x") for i in range(900)]
    records = spark.createDataFrame(rows, "rec_id bigint, game string, vid string, group string")
    grouped = {r["rec_id"]: r["group"] for r in group_records(records, F.col("game"), F.col("vid")).collect()}
    edges = [(f"r{i}", f"{k}:{v}") for i, g, v, _ in rows for k, v in (("g", g), ("v", v)) if v is not None]
    want = components(edges)
    by = defaultdict(set)
    for i, *_ in rows:
        by[grouped[i]].add(want.get(f"r{i}", f"r{i}"))
    assert len(grouped) == 900 and all(len(s) == 1 for s in by.values()) and len(by) == len({want.get(f"r{i}", f"r{i}") for i, *_ in rows})
    goals = [("train", 0.8), ("dev", 0.1), ("test", 0.1)]
    many = spark.range(20000).select(F.col("id").alias("rec_id"), F.when(F.col("id") < 3000, F.lit("big")).otherwise(F.concat(F.lit("s"), F.floor(F.col("id") / (1 + F.col("id") % 3)))).alias("group"))
    dealt = deal_splits(many, goals)
    assert dealt.count() == 20000 and dealt.groupBy("group").agg(F.countDistinct("split_name").alias("n")).where("n > 1").count() == 0
    report = {r["split_name"]: r["reached_share"] for r in split_report(dealt, spark.createDataFrame(goals, "split_name string, goal_share double")).collect()}
    assert all(abs(report[n] - s) < 0.01 for n, s in goals)


def test_big_groups_and_nothing(spark):
    few = spark.createDataFrame([(i, "a" if i < 6 else f"b{i}") for i in range(10)], "rec_id int, group string")
    counts = Counter(r["split_name"] for r in deal_splits(few, [("train", 0.6), ("dev", 0.4)]).collect())
    assert counts == {"train": 6, "dev": 4}
    large = spark.range(3000).select(F.col("id").alias("rec_id"), F.when(F.col("id") < 1000, F.lit("third")).when(F.col("id") < 2400, F.concat(F.lit("m"), F.floor(F.col("id") / 140))).otherwise(F.concat(F.lit("s"), F.col("id"))).alias("group"))
    counts = Counter(r["split_name"] for r in deal_splits(large, [("train", 0.5), ("dev", 0.3), ("test", 0.2), ("none", 0.0)]).collect())
    assert counts == {"train": 1500, "dev": 900, "test": 600}
    assert deal_splits(few.limit(0), [("train", 1.0)]).collect() == []
    assert deal_splits(few, []).collect() == []
