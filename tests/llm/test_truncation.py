import random
import re

import pytest

from strandframe.llm.truncation import cut_report, cut_texts, longer_copies, tail_endings, word_counts

SCHEMA = "rec_id int, bug_pos int, text string, source string, owner string, reason string"
NOUNS = "car bridge lantern horse turret barrel wagon guard".split()
ENDS = ["floats above the ground", "sinks into the terrain", "flickers between two poses", "loses its texture near the north gate", "blocks the only exit during the boss intro"]


def corpus(rng, n=600):
    rows = []
    for i in range(n):
        text = " ".join(f"The {rng.choice(NOUNS)} {rng.choice(ENDS)}." for _ in range(rng.randint(1, 3)))
        rows.append((i, 0, text if rng.random() < 0.8 else text[:-1], rng.choice(["a", "b", None]), f"v{i}", "x"))
    return rows


def found(spark, rows):
    cut = cut_texts(spark.createDataFrame(rows, SCHEMA), ["rec_id", "bug_pos"])
    return {(r["rec_id"], r["bug_pos"]): r["reason"] for r in cut.collect()}


def test_cut_texts(spark):
    rng = random.Random(1)
    rows = corpus(rng)
    cut = {1000: "The car floats above the gro", 1001: "The horse sinks into the", 1002: "The wagon flick", 1003: "The guard loses its te�", 1004: "The guard loses its tex ([\"", 1005: "The turret floats above the ground,", 1006: "The barrel sinks into the..."}
    whole = {2000: "car gone", 2001: "The car floats above the ground", 2002: "The car sinks into the terrain :(", 2003: "", 2004: "   ", 2005: None, 2006: "The car floats above the ground…", 2007: "The horse sinks into the terrain #tag"}
    rows += [(i, 1, t, "a", None, "x") for i, t in (cut | whole).items()]
    rows += [(3000, 0, "The odd vase stays on the table", "a", "w1", "x"), (3001, 0, "The odd vase stays on the table by the window and hums.", "a", "w1", "x")]
    rows += [(1000, 2, cut[1000], "a", None, "x")]
    got = found(spark, rows)
    assert {(i, 1) for i in cut} | {(1000, 2), (3000, 0)} <= set(got)
    assert not {(i, 1) for i in whole} & set(got) and not [k for k in got if k[0] < 600]
    assert got[(1003, 1)] == "broken" and got[(3000, 0)] == "copy" and got[(1001, 1)] == "phrase"


def test_repeated_notes(spark):
    """Redelivered copies of a cut note do not make it whole; a note that many owners write is whole."""
    rng = random.Random(4)
    rows = corpus(rng) + [(600 + i, 0, f"The {NOUNS[i % 8]} {ENDS[i % 5]} in round {i}. Odd lamp {('flickers', 'gone')[i % 2]} {('twice', 'mad')[i // 2 % 2]} again.", "a", f"w{i}", "x") for i in range(80)]
    one_owner = [(7000 + i, 0, "Odd lamp flick", "a", "q", "x") for i in range(20)]
    many_owners = [(7100 + i, 0, "Odd lamp flicke", "a", f"q{i}", "x") for i in range(20)]
    whole = [(7300 + i, 0, "Odd lamp gone", "a", f"q{i}", "x") for i in range(20)]
    got = found(spark, rows + one_owner + many_owners + whole)
    assert {(r[0], 0) for r in one_owner + many_owners} <= set(got)
    assert not {(r[0], 0) for r in whole} & set(got)


def test_same_half_word(spark):
    """Texts cut in the same half word do not make it a word."""
    rows = corpus(random.Random(5))
    cut = [(8000 + i, 0, f"{start} flick", "a", f"q{i}", "x") for i, start in enumerate(("Some odd vase stands and then a distant roof did", "Nobody saw how much grey paint would", "Shortly before noon my left boot"))]
    assert {(r[0], 0) for r in cut} <= set(found(spark, rows + cut))


def test_field_limit(spark):
    rng = random.Random(2)
    rows = corpus(rng)
    limited = [(5000 + i, 0, (" ".join(f"The {rng.choice(NOUNS)} {rng.choice(ENDS)}." for _ in range(4)))[:70], "form", f"f{i}", "x") for i in range(200)]
    got = found(spark, rows + limited)
    open_ones = [r for r in limited if not r[2].rstrip().endswith(".")]
    assert all((r[0], 0) in got for r in open_ones)
    entries = spark.createDataFrame(rows + limited, SCHEMA)
    report = {r["source"]: r for r in cut_report(entries, cut_texts(entries, ["rec_id", "bug_pos"])).collect()}
    assert report["form"]["n_entries"] == 200 and report["form"]["n_cut"] == len(open_ones) and report[None]["n_cut"] == 0


def goes(body, rest):
    return bool(re.match(r"[^\W_]", rest)) and body[-1].isalpha(), bool(re.match(r"\s*(?:[^\W_])", rest)) and rest.strip()[0].islower()


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_all_longer_copies_count(spark, parts):
    """Every longer copy tells how a text goes on, whatever partition holds it."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        for seed in range(3):
            rng = random.Random(seed)
            texts = {(s, "".join(rng.choices("aB .", k=rng.randint(1, 7))).strip()) for s in ("p", "q") for _ in range(90)}
            texts = sorted((s, t, 1) for s, t in texts if t)
            want = {}
            for s, t, _ in texts:
                ways = [goes(t, u[len(t) :]) for r, u, _ in texts if r == s and u != t and u.startswith(t)]
                if any(map(any, ways)):
                    want[s, t] = (any(w[0] for w in ways), any(w[1] for w in ways))
            got = longer_copies(spark.createDataFrame(texts, "s string, t string, n bigint").repartition(7), "s", "t", "n").collect()
            assert {(r["s"], r["t"]): (r["mid_word"], r["within"]) for r in got} == want and len(got) == len(want)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_nearer_copy_hides_no_other(spark):
    rows = corpus(random.Random(6), 300) + [(9000 + i, 0, t, None, None, "x") for i, t in enumerate(("Odd ca", "Odd ca is.", "Odd cart."))]
    got = found(spark, rows)
    assert got[9000, 0] == "copy" and (9001, 0) not in got and (9002, 0) not in got


@pytest.mark.parametrize("parts", [1, 7])
def test_tail_endings(spark, parts):
    """Uses of a word and of its longer copies in each context, by brute force; a word may have any length."""
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(parts)
        words = ["a", "ab", "abc", "abd", "b", "z" * 60, "z" * 61, "𝒶b"]
        bodies = [" ".join(rng.choices(words, k=rng.randint(1, 5))) + rng.choice([".", "", "; a b"]) for _ in range(150)]
        counts = word_counts(spark.createDataFrame([(t,) for t in bodies], "body string"))
        rows = counts.collect()
        tails = [(*rng.choices([*words, "^"], k=2), rng.choice([*words, "zzz", "q"])) for _ in range(40)]
        tails = sorted({(*t, 1) for t in tails})
        got = {(r["a"], r["b"], r["c"]): r for r in tail_endings(counts, spark.createDataFrame(tails, "a string, b string, c string, n_texts bigint")).collect()}
        assert len(got) == len(tails)
        for a, b, c, _ in tails:
            for level, context in ((3, f"{a} {b}"), (2, b), (1, "")):
                same = [r for r in rows if (r["level"], r["context"]) == (level, context)]
                own = [(r["n_end"], r["n_open"], r["n_on"]) for r in same if r["word"] == c] or [(0, 0, 0)]
                longer = sum(r["n_end"] + r["n_open"] + r["n_on"] for r in same if r["word"] != c and r["word"].startswith(c))
                row = got[a, b, c]
                assert [(*own[0], longer)] == [(row[f"n_end{level}"], row[f"n_open{level}"], row[f"n_on{level}"], row[f"n_longer{level}"])]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_nothing(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, 0, None, None, None, "x")]) == {}
