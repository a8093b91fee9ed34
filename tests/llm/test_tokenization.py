import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from strandframe.llm.pretokenizer import BLOCK, DONE, MOVE, scan_states  # noqa: E402
from strandframe.llm.tokenization import count_tokens, decode_ids, default_rank_file, encode_texts, tokenizer  # noqa: E402

reference = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
reference.encode_special_tokens = True
ALPHABET = list("abst'mdlrve  \n\t019.!?é漢字１½ʼ’　‍") + ["'s", "'ll", "<|endoftext|>", "👩🏽‍🔧", "\r\n"]


def encode(texts):
    ids, counts = tokenizer(default_rank_file()).encode(texts)
    return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=60).map("".join), min_size=1, max_size=6))
def test_same_ids_as_the_library(texts):
    assert encode(texts) == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=4))
def test_round_trip(texts):
    bpe = tokenizer(default_rank_file())
    assert [bpe.decode(ids) for ids in encode(texts)] == texts


def test_long_pieces():
    texts = ["a" * 20000 + " " * 3000 + "b", "ab" * 5000, "x" * 63 + "'s"]
    assert encode(texts) == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_scan_equals_steps():
    symbols = np.array(random.Random(0).choices(range(16), k=5 * BLOCK + 7), dtype=np.uint8)
    state, steps = DONE, []
    for s in symbols:
        steps.append(state)
        state = MOVE[s, state]
    assert scan_states(symbols).tolist() == steps


def test_operators(spark):
    rows = [(1, "The car's  wheel\n", 7), (2, "", 7), (3, None, 7), (4, " ", 7), (4, " ", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = encode_texts(df, "doc_id", "text", offsets=True).orderBy("doc_id").collect()
    assert [r["ids"] for r in got] == [reference.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows]
    assert got[0]["starts"][0] == 0 and len(got[0]["starts"]) == len(got[0]["ids"]) and got[1]["starts"] == []
    back = decode_ids(encode_texts(df, "doc_id", "text"), "doc_id")
    assert sorted(r["text"] for r in back.collect()) == ["", "", " ", " ", "The car's  wheel\n"]
    assert [r["n_tokens"] for r in count_tokens(df, "text", ["doc_id"]).orderBy("doc_id").collect()] == [len(r["ids"]) for r in got]
    assert encode_texts(df.where(F.lit(False)), "doc_id", "text").collect() == []
