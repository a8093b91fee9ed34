import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.functions.text import event_summary, fill_template, seeded_noise
from strandframe.operators.assign import assign_within, assignment_check, best_assignment, is_best
from strandframe.operators.guards import guard_splits, require, require_rows
from strandframe.operators.ranking import matched_references
from strandframe.operators.search import ground_event
from strandframe.operators.sequence import window_bounds
from strandframe.sources.annotations import list_media, read_ground_truth, resolve_media, split_file
from strandframe.sources.backends import CallbackTexts, GenerationSettings, described, generate_json, rate_pairs
from strandframe.sources.sinks import remembered, write_run

RECORD = "vid string, video_name string, game string, video_path string, bugs array<string>, time_nodes array<array<struct<start:double,end:double>>>"


def test_guards(spark):
    require(True, "x")
    with pytest.raises(ValueError, match="x"):
        require(False, "x")
    assert guard_splits(" train , dev") == ["train", "dev"]
    for names in ("train,test", " , "):
        with pytest.raises(ValueError):
            guard_splits(names)
    df = spark.range(5)
    assert require_rows(df, F.col("id") < 5, "too large").count() == 5
    with pytest.raises(Exception, match="too large"):
        require_rows(df, F.col("id") < 4, "too large").collect()


def test_media(spark, tmp_path):
    for place in ("a.mp4", "racing/b.mp4", "other/d.mp4", "zother/d.mp4", "racing/a.mp4", "deep/er/e.mp4"):
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_bytes(b"x")
    rows = [(v, v, g, p, [], []) for v, g, p in (("a", "racing", None), ("b", "racing", None), ("c", None, f"{tmp_path}/deep/er/e.mp4"), ("d", None, "relative/d.mp4"), ("e", "x", None), ("a", "racing", None))]
    media = list_media(spark, str(tmp_path))
    kept, missing = resolve_media(spark.createDataFrame(rows, RECORD), media, str(tmp_path))
    assert missing == 1
    assert sorted((r["vid"], r["video_path"].removeprefix(str(tmp_path))) for r in kept.collect()) == [("a", "/a.mp4"), ("a", "/a.mp4"), ("b", "/racing/b.mp4"), ("c", "/deep/er/e.mp4"), ("d", "/other/d.mp4")]
    with pytest.raises(ValueError):
        resolve_media(spark.createDataFrame(rows[4:5], RECORD), media, str(tmp_path))
    assert split_file(["x/dev.json", "Train_b.txt", "train_a.json"], "train") == "Train_b.txt"
    with pytest.raises(ValueError):
        split_file(["dev.json"], "test")
    records = spark.createDataFrame([("v", "v", "g", None, ["x", "y"], [[(0.0, 1.0)], []])], RECORD)
    assert [(r["vid"], r["bug"]) for r in read_ground_truth(spark, None, records).collect()] == [("v", "x")]
    (tmp_path / "gt.json").write_text('[{"id": "w", "bugs": ["z"], "time_nodes": [[[1, 2]]]}]')
    assert [(r["vid"], r["bug"]) for r in read_ground_truth(spark, f"{tmp_path}/gt.json", records).collect()] == [("w", "z")]


def test_written_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert remembered(spark, str(tmp_path), {"fps": 2}, build).count() == 3
    assert remembered(spark, str(tmp_path), {"fps": 4}, build).count() == 3 and len(calls) == 2
    path = write_run(spark.createDataFrame([("v", float("nan"))], "vid string, x double"), str(tmp_path), "runs", "one", {"fps": 2})
    row = spark.read.json(path).collect()[0]
    assert row["vid"] == "v" and row["config"]["fps"] == 2


def test_generated_json(spark):
    asked = []
    backend = CallbackTexts(lambda p, attempt: asked.append(p) or ({"good": '{"glitch": "Yes", "description": " a car "}', "late": "no" if attempt == 0 else '```json\n{"glitch": false, "description": "x"}\n```'}.get(p, "nothing")))
    prompts = spark.createDataFrame([("good",), ("good",), ("late",), ("bad",), (None,)], "prompt string")
    got = {r["prompt"]: r["json"] for r in generate_json(prompts, backend).collect()}
    assert set(got) == {"good", "late", "bad"} and got["bad"] is None and "car" in got["good"] and "false" in got["late"]
    told = spark.createDataFrame(list(got.items()), "prompt string, json string").select("prompt", described(F.col("json")).alias("d"), described(F.col("json"), optional=True).alias("o"))
    rows = {r["prompt"]: r for r in told.collect()}
    assert tuple(rows["good"]["d"]) == ("a car", "entity", "other") == tuple(rows["good"]["o"])
    assert rows["late"]["o"] is None and rows["bad"]["d"]["description"].startswith("A visual") and rows["bad"]["o"] is None


def test_rated_pairs(spark):
    backend = CallbackTexts(lambda p, attempt: '{"rating": 4}' if "red" in p else "?", "judge")
    pairs = spark.createDataFrame([("red car", "car"), ("red car", "car"), ("tree", "bush"), (None, "x")], "gt string, pred string")
    first = rate_pairs(pairs, backend, "Compare {gt} with {pred}.", {"model": "m", "temperature": 0.0})
    got = {r["gt"]: (r["rating"], r["failed"], r["cached"]) for r in first.collect()}
    assert got == {"red car": (4, False, False), "tree": (0, True, False)}
    again = rate_pairs(pairs, CallbackTexts(lambda p, attempt: "never", "judge"), "Compare {gt} with {pred}.", {"model": "m", "temperature": 0.0}, first.where("not failed"))
    assert {r["gt"]: (r["rating"], r["cached"]) for r in again.collect()} == {"red car": (4, True), "tree": (0, False)}
    other = rate_pairs(pairs, backend, "Other {gt} {pred}", {"model": "m", "temperature": 0.0}, first)
    assert other.where("cached").count() == 0


def test_texts(spark):
    df = spark.createDataFrame([(["one"], "x"), (["one", "two"], "```a``` sum "), (["one", "two"], "```a```"), ([], "x")], "d array<string>, w string")
    assert [r["s"] for r in df.select(event_summary(F.col("d"), F.col("w")).alias("s")).collect()] == ["one", "sum", "one", None]
    one = spark.range(1).select(fill_template("{a}-{b}{c}", a=F.lit(1), b=F.lit(None).cast("string")).alias("t"), seeded_noise(F.lit("key")).alias("n")).collect()[0]
    assert one["t"] == "1-{c}" and -6 <= one["n"] <= 6
    noise = spark.range(2000).select(seeded_noise(F.col("id").cast("string")).alias("n")).agg(F.avg("n").alias("m"), F.stddev("n").alias("s")).collect()[0]
    assert abs(noise["m"]) < 0.1 and abs(noise["s"] - 1) < 0.1
    assert GenerationSettings().options(5) == {"max_new_tokens": 5, "do_sample": False, "repetition_penalty": 1.0, "temperature": 1.0, "top_p": 1.0, "top_k": 0}
    assert GenerationSettings(0.5, 0.9, 3).options(5)["top_k"] == 3


def test_window_bounds(spark):
    df = spark.createDataFrame([([0.0, 0.5], 10.0), ([9.5, 9.9], 10.0), ([3.0], 2.0), ([], 1.0), ([1.0], None)], "t array<double>, d double")
    got = [r["b"] and tuple(r["b"]) for r in df.select(window_bounds(F.col("t"), F.col("d"), 2.0).alias("b")).collect()]
    assert got == [(0.0, 1.0), (9.5, 10.0), (3.0, 3.0 + 1e-9), None, (1.0, 1.5)]


def test_recurrence():
    marks = set(range(3, 6)) | set(range(20, 25))
    assert ground_event(marks.__contains__, [4], 30) == [(3, 5)]
    assert ground_event(marks.__contains__, [4], 30, recurrence=3) == [(3, 5), (20, 24)]
    assert ground_event(marks.__contains__, [10], 30, recurrence=3) == []


def test_best_assignment_is_told(spark):
    rng = np.random.default_rng(0)
    for shape in ((3, 3), (2, 5), (6, 4), (1, 1)):
        ratings = rng.integers(0, 6, shape).astype(float)
        pairs = best_assignment(ratings)
        assert is_best(ratings, pairs) and not is_best(ratings + 1, pairs[:-1])
    assert not is_best(np.array([[5.0, 1.0], [1.0, 5.0]]), [(0, 1), (1, 0)])
    rows = spark.createDataFrame([("v", i, j, int(r)) for (i, j), r in np.ndenumerate(rng.integers(0, 6, (3, 4)))], "v string, g int, p int, r int")
    assert [r["best"] for r in assignment_check(rows, assign_within(rows, "v", "g", "p", "r"), "v", "g", "p", "r").collect()] == [True]


@pytest.mark.parametrize("tile", [4, 2048])
def test_matched_references(spark, tile):
    """Against brute force, with tiles smaller than a group that holds most rows, and groups with too few alike rows."""
    rng = np.random.default_rng(1)
    rows = [(f"g{0 if i < 40 else i % 3}", i, [float(x) for x in rng.normal(size=4)], float(rng.integers(0, 5))) for i in range(60)]
    rows += [("tiny", 100, [1.0, 0.0, 0.0, 0.0], 1.0), ("tiny", 105, [0.0, 1.0, 0.0, 0.0], 3.0), (None, 106, [1.0] * 4, 0.0), ("tiny", 107, None, 0.0)]
    df = spark.createDataFrame(rows, "g string, i int, v array<float>, low double")
    got = {}
    for r in matched_references(df, "g", "i", "v", "low", 3, 2, tile=tile).collect():
        got.setdefault((r["g"], r["i"]), {})[r["place"]] = r["ref"]
    usable = [r for r in rows if r[0] is not None and r[2] is not None]
    for g, i, v, _ in usable:
        group = [r for r in usable if r[0] == g]
        middle, unit = np.median([r[3] for r in group]), lambda x: np.array(x, dtype=np.float32).astype(float) / np.linalg.norm(np.array(x, dtype=np.float32).astype(float))
        far = [r for r in group if abs(r[1] - i) >= 3]
        alike = sorted((r for r in far if r[3] <= middle), key=lambda r: (-round(float(unit(v) @ unit(r[2])), 12), r[3], r[1]))[:2]
        fill = [r for r in sorted(far, key=lambda r: (r[3], r[1])) if r not in alike][: 2 - len(alike)]
        assert [got.get((g, i), {}).get(k) for k in range(1, len(alike + fill) + 1)] == [r[1] for r in alike + fill]
