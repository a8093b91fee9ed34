import random

import numpy as np
import pyarrow as pa
import pytest

from strandframe.llm.abuse import REVIEW, STOP, Row, Scorer, default_model, filled, fit_ordinal, labelled, neighbour_features, plain_word, review_rates, score_documents, training_rows, units_of, word_features


def severities(model, texts):
    return Scorer(model).severities(pa.array(texts, pa.string()))


@pytest.mark.parametrize(("token", "word"), [("1d10t", "idiot"), ("stuppppid", "stupid"), ("b4$t4rd", "bastard"), ("orgiеs", "orgies"), ("l_o_s_e_r_", "loser"), ("s-t-u-p-i-d", "stupid"), ("good", "good"), ("123", "123"), ("!!", "")])
def test_plain_words(token, word):
    assert plain_word(token) == word


def test_units():
    texts = pa.array(["you D i c k h e a d. Tr​ash, “quoted” bit\nzwei - Brücken", None, "", " \t", "a,b;c 1.5"])
    units = units_of(texts)
    words = [units.words[i] for i in units.at]
    assert words == ["you", "dickhead", "trash", "quoted", "bit", "zwei", "brücken", "a", "b;c" if "b;c" in words else "b", *(["c"] if "b;c" not in words else []), "1", "5"]
    assert list(units.text_of_sentence[units.sentence]) == [0] * 7 + [4] * (len(words) - 7)
    assert units.clause[0] == units.clause[1] != units.clause[2] and units.sentence[0] == units.sentence[1] != units.sentence[2] != units.sentence[3]


def test_neighbours_stay_in_their_unit():
    numbers = np.array([word_features(w)[0] for w in ("kitten", "river", "kitten", "river", "the", "of")], dtype=np.uint64)
    split = list(neighbour_features(numbers, np.array([0, 0, 1, 1, 2, 2])))
    found = [sorted(f for at, fs in split for u, f in zip(at, fs) if u == unit) for unit in range(3)]
    assert found[0] == found[1] and len(found[0]) == 3  # pair, neighbours, start
    assert len(found[2]) == 1 and {"the", "of"} <= STOP  # two stop words are only a start


def test_scores_do_not_depend_on_the_batch():
    """A text scores the same alone and among others: the lookup is exact."""
    rng, model = random.Random(0), default_model()
    texts = [" ".join(rng.choices("you are a moron total idiot door kill kiss yourself all foreigners , . bridge 死ね".split(), k=rng.randint(0, 12))) for _ in range(60)]
    together = severities(model, texts)
    assert np.allclose(together, [severities(model, [t])[0] for t in texts])


def test_held_out_sentences():
    """Labelled sentences kept whole from the fit.  With few labels the wording of
    most is new, so the share found is modest; the README gives it."""
    rows, rng = labelled(), np.random.default_rng(0)
    fold = rng.integers(0, 4, len(rows))
    model = fit_ordinal(training_rows([r for r, f in zip(rows, fold) if f]))
    held = [r for r, f in zip(rows, fold) if not f]
    share = {bad: np.mean([(severities(model, filled(s)) >= REVIEW).mean() for s, g, _ in held if (g > 0) == bad]) for bad in (True, False)}
    assert share[True] > 0.4 and share[False] < 0.15 and list(model.cuts) == sorted(model.cuts)


def test_held_out_fillings():
    """Every fourth way to fill a labelled sentence with slots is kept from the fit."""
    slotted = {i for i, (s, _, _) in enumerate(labelled()) if "{" in s}
    rows = [r for r in training_rows(labelled()) if r.sentence in slotted]
    random.Random(0).shuffle(rows)
    held, rest = rows[: len(rows) // 4], rows[len(rows) // 4 :]
    scores = severities(fit_ordinal(rest), [r.text for r in held])
    assert np.mean((scores >= REVIEW) == np.array([r.grade > 0 for r in held])) > 0.9


def test_what_one_sentence_says_is_no_evidence():
    rows = [Row("purple zebra insults", 1, 1.0, 0, True), Row("purple quokka insults", 1, 1.0, 1, True), *(Row(f"calm {w}", 0, 1.0, i, True) for i, w in enumerate("lake hill road tree".split(), 2))]
    model = fit_ordinal(rows)
    zebra, purple = severities(model, ["zebra", "purple"])
    assert zebra == severities(model, ["unknownword"])[0] < purple


def test_grades_are_ordered():
    none, insult, hate, threat = severities(default_model(), ["the car floats above the ground", "you worthless moron", "all foreigners should be locked up", "go kill yourself"])
    assert none < REVIEW <= insult < hate < threat


def test_documents(spark):
    rows = [(1, "Patch notes\nYOU ARE A W0RTHLESS M0R0N and everyone saw it", "Bug-Forum "), (2, "the pig in the barn eats the apple", "bug_forum"), (3, None, None), (4, "", "x"), (5, "ok. " * 50000 + "kill yourself, moron", "x"), (5, " ", "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, source string")
    got = [(r["doc_id"], r["severity"] >= REVIEW) for r in score_documents(df, ["doc_id"]).collect()]
    assert sorted(got) == [(1, True), (2, False), (3, False), (4, False), (5, False), (5, True)]
    rates = {r["source"]: r["review_rate"] for r in review_rates(score_documents(df, ["doc_id", "source"])).collect()}
    assert rates == {"bug_forum": 0.5, None: 0.0, "x": 1 / 3}
    assert score_documents(df.limit(0), ["doc_id"]).collect() == []


def test_frequent_wording_stays_abuse(spark):
    """What a hot source repeats has the score it has alone."""
    schema, text = "doc_id int, text string, source string", "you moron, nobody asked you"
    alone = score_documents(spark.createDataFrame([(0, text, "x")], schema), ["doc_id"]).collect()[0]["severity"]
    rows = [(0, text, "x")] + [(i, f"{text} number {i}", "hot") for i in range(1, 400)] + [(i, text, "hot") for i in range(400, 800)]
    scores = {r["doc_id"]: r["severity"] for r in score_documents(spark.createDataFrame(rows, schema), ["doc_id"]).collect()}
    assert scores[0] == alone >= REVIEW and all(scores[i] == alone for i in range(400, 800))


def test_long_sentences_are_read_whole():
    """Words of a pair in different clauses of a sentence of many clauses still meet."""
    model = default_model()
    joined = severities(model, ["a, b, c, go, kill, yourself, d, e"])[0]
    assert joined > severities(model, ["kill"])[0]
