import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strandframe.functions.keys import key_form, label_form, source_form
from strandframe.operators.references import orphan_counts, orphan_rows

DAY = dt.datetime(2024, 1, 1)
REFS = "tab_name string, row_id bigint, target string, ref_key string, at timestamp_ntz, extra string"
PARENTS = "target string, ref_key string, born timestamp_ntz, gone timestamp_ntz, extra int"


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def brute(refs, parents):
    def alive(r):
        return any(t == r[2] and k == r[3] and r[4] is not None and b is not None and b <= r[4] and (g is None or g > r[4]) for t, k, b, g, _ in parents)

    return {(r[0], r[1]) for r in refs if r[3] is not None and not alive(r)}


@pytest.mark.parametrize("seed", range(4))
def test_orphans_against_brute_force(spark, seed):
    rng = random.Random(seed)
    keys = ["hot", "hot", "a", "b", "c", None]
    refs = [("t", i, rng.choice("xy"), rng.choice(keys), day(rng.choice([None, *range(12)])), "e") for i in range(rng.choice([0, 80]))]
    parents = [(rng.choice("xy"), rng.choice(keys[2:] if seed == 1 else keys), day(rng.choice([None, *range(10)])), day(rng.choice([None, *range(12)])), 1) for _ in range(rng.choice([0, 25]) if seed else 40)]
    r, p = spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)
    found = orphan_rows(r, p)
    assert {(x["tab_name"], x["row_id"]) for x in found.collect()} == brute(refs, parents)
    counts = orphan_counts(found, r).collect()
    assert sum(c["orphans"] for c in counts) == len(brute(refs, parents))
    assert sum(c["n_refs"] for c in counts) == sum(x[3] is not None for x in refs)


def test_key_forms(spark):
    df = spark.createDataFrame([(" raw/A b/v1.MP4 ",), ("v1",), ("",), (".mp4",), (None,), ("x/",), ("v.mp4.mp4",)], "v string")
    assert [r["k"] for r in df.select(key_form(F.col("v")).alias("k")).collect()] == ["v1", "v1", None, None, None, None, "v.mp4"]
    games = spark.createDataFrame([("Pedal  Kings",), ("Unknown",), ("?!",), (None,)], "v string")
    assert [r["k"] for r in games.select(label_form(F.col("v")).alias("k")).collect()] == ["pedalkings", None, None, None]
    assert spark.createDataFrame([(" Bug-Forum ",)], "v string").select(source_form(F.col("v"))).collect()[0][0] == "bug_forum"
