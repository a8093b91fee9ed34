import json

import pytest
from pyspark.sql import functions as F

from strandframe.functions.text import decode_spans, extract_json, number_grid, parse_rating, strip_fences, token_key, token_set, truthy
from strandframe.operators.joins import debiased_pairs, lookup_two_keys, match_counts
from strandframe.sources.annotations import ground_truth, match_report, read_annotations, read_split
from strandframe.sources.backends import CallbackBackend, score_requests
from strandframe.sources.sinks import fingerprint, with_config, write_json
from strandframe.streaming.windows import count_windows, time_windows


def apply(spark, function, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["y"] for r in df.select("i", function(F.col("t")).alias("y")).orderBy("i").collect()]


def test_json_extraction(spark):
    got = apply(spark, extract_json, '```json\n{"a": 1}\n```', "x {'a': True,} y", "none", 'say {"b": "}{"} end', "[1]", None, "")
    assert [None if g is None else json.loads(g) for g in got] == [{"a": 1}, {"a": True}, None, {"b": "}{"}, None, None, None]


def test_ratings_and_small_parsers(spark):
    got = apply(spark, parse_rating, '{"rating": 4}', '{"rating": "3.9"}', '{"rating": "x"}', "{}", "no", '{"rating": -2.5}')
    assert [(r["rating"], r["failed"]) for r in got] == [(4, False), (3, False), (0, True), (0, False), (0, True), (-2, False)]
    assert apply(spark, truthy, " Yes ", "1", "false", None) == [True, True, False, False]
    assert apply(spark, number_grid, "1, 2.5,x,,") == [[1.0, 2.5]]
    assert apply(spark, token_set, "The red CAR is on the red bridge") == [["bridge", "car", "red"]]
    assert apply(spark, token_key, "car red", "42") == ["car red", "42"]
    assert apply(spark, strip_fences, "a ```x``` b", "```x```") == ["a  b", None]
    assert apply(spark, decode_spans, "[[[1,2]],[]]", "[[1,2]]", "[1,2]", "oops") == [[[[1.0, 2.0]], []], [[[1.0, 2.0]]], [[[1.0, 2.0]]], None]


def test_annotation_files(spark, tmp_path):
    a = [{"video_name": "a_0.mp4", "game_name": "A", "bugs": ["The car floats.", "x"], "time_nodes": [[[8, 4]], []], "no_bugs": False}]
    b = {"data": [{"id": "b_1", "game": "B", "reports": [{"description": "falls", "time_nodes": [[1, 2]]}]}]}
    (tmp_path / "a.json").write_text(json.dumps(a))
    (tmp_path / "b.json").write_text(json.dumps(b))
    rows = {r["vid"]: r for r in read_annotations(spark, str(tmp_path)).collect()}
    assert rows["a_0"]["bugs"] == ["The car floats.", "x"] and [len(e) for e in rows["a_0"]["time_nodes"]] == [1, 0]
    assert rows["b_1"]["game"] == "B" and tuple(rows["b_1"]["time_nodes"][0][0]) == (1.0, 2.0) and not rows["b_1"]["no_bugs"]
    truth = ground_truth(read_annotations(spark, str(tmp_path))).collect()
    assert sorted((r["vid"], r["bug_pos"]) for r in truth) == [("a_0", 0), ("b_1", 0)]


def test_split_files_and_matching(spark, tmp_path):
    (tmp_path / "train.txt").write_text("a_0.mp4\n\nb_1\n")
    (tmp_path / "dev.json").write_text('{"ids": ["c", "d"]}')
    rows = read_split(spark, str(tmp_path)).orderBy("file", "pos").collect()
    assert [(r["file"], r["item"]) for r in rows] == [("dev.json", "c"), ("dev.json", "d"), ("train.txt", "a_0.mp4"), ("train.txt", "b_1")]
    report = spark.createDataFrame([("x/a_0.mp4", 1), ("z", 2), (None, 3)], "video_name string, n int")
    inside, outside, missing = match_report(report, read_split(spark, str(tmp_path)))
    assert [r["n"] for r in inside.collect()] == [1] and sorted(r["n"] for r in outside.collect()) == [2, 3] and missing.count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(float("nan"), [1.0, float("inf")], 1)], "b double, a array<double>, c int")
    write_json(with_config(df, {"k": 2}), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    assert json.loads(text) == {"a": [1.0, None], "c": 1, "config": {"k": 2}}
    assert fingerprint({"a": 1, "b": 2}) == fingerprint({"b": 2, "a": 1}) != fingerprint({"a": 1})


def test_backend_cache(spark):
    requests = spark.createDataFrame([("u", 1), ("u", 1), ("w", 2)], "user string, n int")
    backend = CallbackBackend(lambda row: {"yes": -float(row["n"]), "no": -1.0})
    first = score_requests(requests, ["user", "n"], backend)
    assert sorted((r["user"], r["logprobs"]["yes"], r["cached"]) for r in first.collect()) == [("u", -1.0, False), ("w", -2.0, False)]
    cache = first.where("user = 'u'").select("key", "logprobs")
    assert {r["user"]: r["cached"] for r in score_requests(requests, ["user", "n"], backend, cache).collect()} == {"u": True, "w": False}


def test_lookups(spark):
    items = spark.createDataFrame([(1, "v1"), (2, "n2"), (3, "zz")], "i int, item string")
    rows = spark.createDataFrame([(10, "v1", "n1"), (11, "v2", "n2"), (12, "v2", "v1")], "rec int, v string, n string")
    assert sorted((r["i"], r["rec"]) for r in lookup_two_keys(items, "item", rows, "v", "n", ["rec"]).collect()) == [(1, 10), (2, 11)]
    counts = match_counts(items.withColumnRenamed("item", "k"), rows.select(F.col("n").alias("k")), "k").collect()[0]
    assert tuple(counts) == (2, 1, 1)
    pairs = spark.createDataFrame([("g", "x", "y", 3.5), ("g", "y", "x", -1.5), ("g", "x", "z", 1.0)], "g string, a string, b string, v double")
    got = debiased_pairs(pairs, "g", "a", "b", "v").collect()
    assert [(r["a"], r["b"], r["debiased"]) for r in got] == [("x", "y", 2.5)]


def test_streams(spark, tmp_path):
    rows = spark.range(20).select((F.col("id") % 2).alias("k"), F.timestamp_seconds(F.col("id") * 60 + 86400).alias("ts"), F.col("id").cast("double").alias("v"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def result(df, name, mode):
        query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return spark.sql(f"select * from {name}").collect()

    assert sum(r["n"] for r in result(time_windows(stream, "ts", "k", "v"), "tw", "update")) == 20
    chunks = result(count_windows(stream, "k", "ts", "v", size=4), "cw", "append")
    assert sorted((r["k"], r["idx"], r["total"]) for r in chunks) == [(0, 0, 12.0), (0, 1, 44.0), (1, 0, 16.0), (1, 1, 48.0)]


@pytest.mark.parametrize("name", ["none"])
def test_empty_annotations(spark, tmp_path, name):
    (tmp_path / f"{name}.json").write_text("[]")
    assert read_annotations(spark, str(tmp_path)).collect() == []
