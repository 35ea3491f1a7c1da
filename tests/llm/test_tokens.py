import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm.tokens import decode, encoder, load_ranks, pretoken_ends, token_ids, vocabulary_path


@pytest.fixture(scope="module")
def ranks():
    return load_ranks(vocabulary_path())


def test_long_and_odd_texts(spark, ranks):
    rnd = random.Random(1)
    mixed = "".join(rnd.choice(["hello ", "don't", "   ", "\n\n", "x" * 9, "数据", "1234", "…", "é", "'ll ", "\t"]) for _ in range(900))
    texts = ["", None, " ", "<|endoftext|>", "plain", mixed, mixed, "a" * 3000, " " * 2500, "word " * 700, "\n" * 1500 + "x", "日" * 2000, "ab" * 400 + " " * 700 + "cd" * 400]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, piece string, row long")
    out = {r.doc_id: r.ids for r in token_ids(df, "doc_id", "text", vocabulary_path(), chunk=200, overlap=40, margin=8).collect()}
    enc, by_id = encoder(ranks), {v: k for k, v in ranks.items()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        assert out[i] == enc.encode_ordinary(t or ""), i
        assert decode(out[i], by_id) == (t or "")


def test_same_as_the_other_library(ranks):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    for t in ["Hello world's end", "  two  spaces ", "naïve 数据 123", "a\n\nb\t c"]:
        assert encoder(ranks).encode_ordinary(t) == other.encode(t, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 1'sé.\n", max_size=80), st.text(alphabet="ab 1'sé.\n", max_size=80))
def test_a_common_boundary_holds_in_the_whole_text(left, right):
    """From a boundary that both share on, a chunk goes the way of the whole text."""
    whole = pretoken_ends(left + right)
    tail = [len(left) + e for e in pretoken_ends(right)]
    common = sorted(set(whole) & set(tail))
    if common:
        assert [e for e in whole if e >= common[0]] == [e for e in tail if e >= common[0]]


def test_repeated_ids_empty_table_and_bad_parameters(spark):
    df = spark.createDataFrame([(1, "x" * 300), (1, "x" * 300), (None, "y")], "doc_id long, text string")
    assert token_ids(df, "doc_id", "text", vocabulary_path(), 100, 20, 5).count() == 3
    assert token_ids(df.limit(0), "doc_id", "text", vocabulary_path()).count() == 0
    with pytest.raises(ValueError):
        token_ids(df, "doc_id", "text", vocabulary_path(), 10, 20, 5)
