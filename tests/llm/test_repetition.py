import random
import re

from strandframe.llm.repetition import MIN_WORDS, divergence, language_references, repetition


def brute(texts):
    words = re.findall(r"[^\W\d_]+", "\n".join(t for t in texts or [] if t is not None).lower())
    seen, covered = set(), set()
    for i in range(len(words) - 2):
        run = tuple(words[i : i + 3])
        if run in seen:
            covered |= {i, i + 1, i + 2}
        seen.add(run)
    return len(words), len(covered)


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [" ".join(rng.choices(["a", "B", "c,", "Été", "дом"], k=rng.randint(0, 12))) if rng.random() < 0.9 else None for _ in range(rng.randint(0, 4))], "x") for i in range(120)]
    rows += [(200, None, "x"), (201, ["", " ", "1 2"], "x"), (202, ["red car floats " * 40000], "x"), (202, ["red car floats " * 40000], "x")]
    got = repetition(spark.createDataFrame(rows, "rec_id int, bugs array<string>, n_words string"), "rec_id", "bugs").collect()
    assert len(got) == len(rows)
    want = {i: brute(t) for i, t, _ in rows}
    for r in got:
        assert (r["n_words"], r["n_repeated"]) == want[r["rec_id"]]
        assert r["repeated_share"] == (r["n_repeated"] / r["n_words"] if r["n_words"] else 0)
    assert repetition(spark.createDataFrame([], "rec_id int, bugs array<string>"), "rec_id", "bugs").collect() == []


def test_divergence(spark):
    english = [f"The red car floats above the ground near gate {i} and the wall" for i in range(40)]
    german = [f"Der rote Wagen schwebt über dem Boden am Tor {i} und der Mauer" for i in range(40)]
    documents = spark.createDataFrame([*((t, "en-GB") for t in english), *((t, "DE") for t in german), (None, "en"), ("x", None), ("y", "?")], "text string, lang string")
    references = language_references(documents, "text", "lang")
    assert [r.lang for r in references] == ["de", "en"] and all(sum(r.counts) == sum(len(re.findall(r"[^\W\d_]+", t)) for t in (german, english)[i]) for i, r in enumerate(references))
    rows = [(0, english[:1]), (1, german[:1]), (2, ["zq zq zq zq zq zq zq zq zq zq zq zq zq zq zq zq"]), (3, ["short"]), (4, None), (5, [None, "", "日本語" * 30])]
    schema = "rec_id int, bugs array<string>"
    got = {r["rec_id"]: r for r in divergence(spark.createDataFrame(rows, schema), "rec_id", "bugs", references).collect()}
    assert max(got[0]["word_distance"], got[1]["word_distance"]) < 0.4 < got[2]["word_distance"]
    assert all(0 <= got[i]["class_distance"] <= 1 for i in range(3))
    assert got[3]["n_words"] < MIN_WORDS and got[3]["word_distance"] is None and got[4]["class_distance"] is None and got[5]["n_words"] == 1
    assert divergence(spark.createDataFrame([], schema), "rec_id", "bugs", references).collect() == []
    alone = divergence(spark.createDataFrame(rows, schema), "rec_id", "bugs", language_references(documents.limit(0), "text", "lang"))
    assert all(r["word_distance"] is None for r in alone.collect())
