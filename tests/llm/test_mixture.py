import random
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

from strandframe.llm.mixture import choose_documents, interleave, largest_lag, mix_report, pfair_slots, plan_period, plan_source  # noqa: E402


@pytest.mark.parametrize("blocks", [[1], [3, 1], [5, 5, 5], [1, 2, 30, 7], [0, 4, 1], [97, 13, 1, 50]])
def test_less_than_one_block_of_lag(blocks):
    slots, done, total = pfair_slots(blocks), Counter(), sum(blocks)
    assert len(slots) == total
    for t, (s, k) in enumerate(slots, 1):
        assert k == done[s]
        done[s] += 1
        assert all(abs(n * t / total - done[i]) < 1 for i, n in enumerate(blocks))
    assert [done[i] for i in range(len(blocks))] == blocks


def test_plans():
    assert plan_source("a", 0.5, 1, 30, 100).rest == 0 and plan_source("a", 0.5, 1, 30, 100).passes == 1
    assert (plan_source("a", 0.5, 3, 30, 100).passes, plan_source("a", 0.5, 3, 30, 100).rest) == (1, 20.0)
    assert plan_source("a", 0.5, 3, 0, 100).passes == 0


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies int")


GOALS = "source string, goal_share double, max_repeats int"


def test_shares_and_repeats(spark):
    rng = random.Random(1)
    rows = [(i, "red car floats " * rng.randint(1, 9), rng.choice(["Big-One ", "big_one", "big_one", "small", "other", None]), 9) for i in range(400)] + [(900, None, "small", 9), (901, "", "small", 9)]
    goals = spark.createDataFrame([("big_one", 0.3, 1), ("small", 0.4, 5), ("absent", 0.3, 2)], GOALS)
    used, plans, total = choose_documents(documents(spark, rows), goals)
    report = {r["source"]: r for r in mix_report(used, plans, total).collect()}
    longest = 40
    assert abs(report["big_one"]["used_tokens"] - 0.3 * total) <= longest
    assert abs(report["small"]["used_tokens"] - min(0.4 * total, 5 * report["small"]["supply_tokens"])) <= longest
    assert report["absent"]["used_tokens"] == 0
    assert all(r["most_copies"] <= r["max_repeats"] for r in report.values())
    mix = interleave(used, block_tokens=64).collect()
    assert len({(r["doc_id"], r["copy"]) for r in mix}) == len(mix)
    assert sum(r["n_tokens"] for r in mix) == sum(r["used_tokens"] for r in report.values())
    assert len({r["slot"] for r in mix}) > 10 and not {900, 901} & {r["doc_id"] for r in mix}


@pytest.mark.parametrize("max_slots", [4, 20, 1 << 18])
def test_periods_keep_blocks_short(spark, max_slots):
    """However few slots a period has, no block is longer and every lag is below one block."""
    tokens = {"a": 100_000, "b": 7, "c": 55_555, "d": 0}
    period = plan_period(tokens, 100, max_slots)
    assert "d" not in period.blocks and period.slots <= max(max_slots, 3) + 3
    assert all(tokens[n] / (q * period.runs) <= 100 for n, q in period.blocks.items())
    rng = random.Random(2)
    rows = [(i, "red car floats " * rng.randint(1, 9), rng.choice(["a", "a", "b", "c"]), 9) for i in range(300)]
    used, _, _ = choose_documents(documents(spark, rows), spark.createDataFrame([("a", 0.3, 2), ("b", 0.3, 3), ("c", 0.3, 3), ("a", 0.1, 9)], GOALS))
    lags = largest_lag(used, 50, max_slots).collect()
    assert len(lags) == 3 and all(r["lag"] < 1 and r["block_tokens"] <= 50 for r in lags)
    mix = interleave(used, 50, max_slots).collect()
    assert len({(r["source"], r["block"]) for r in mix}) == len({r["slot"] for r in mix})


def test_nothing_to_mix(spark):
    for rows in ([], [(1, None, "a", 0)], [(1, "text", None, 0)]):
        used, plans, total = choose_documents(documents(spark, rows), spark.createDataFrame([("a", 1.0, 2)], GOALS))
        assert mix_report(used, plans, total).collect()[0]["used_tokens"] == 0
        assert interleave(used).collect() == []
