import random

import pytest
from tokenizers import Tokenizer

from textquarry.llm.encoding import TOKENIZERS, encode_texts, encoder, halves, join_tree, segments


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


PIECES = ["a", "the", " in", " ", "\n", "  ", "1", "23", "'s", "-", "ä", "漢字", "ing", "\u200b", "\t ", "<|endoftext|>", "🙂", "\r\n", "é"]


def test_random_texts_in_small_segments(spark, reference):
    random.seed(7)
    rows = [(i, "".join(random.choice(PIECES) for _ in range(random.randint(1, 300)))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: list(r.ids) for r in encode_texts(df, long_text=30, segment_chars=25, run_chars=6).collect()}
    assert got == {i: reference(t) for i, t in rows}


def test_long_unsplit_texts(spark, reference):
    rows = [(1, "a" * 30_000), (2, " " * 30_000), (3, "ab12" * 9_000), (4, "\n" * 25_000 + "x"), (5, "xyz" * 20_000 + " \n\n" + "thing" * 9_000), (6, "é" * 21_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: list(r.ids) for r in encode_texts(df).collect()} == {i: reference(t) for i, t in rows}


def test_nulls_repeats_and_extra_columns(spark, reference):
    rows = [(1, None, "x", 1), (1, "", "x", 1), (2, "<|endoftext|>", "x", 1), (2, "<|endoftext|>", "x", 1), (None, "a b", "x", 1), (9, "z" * 50, "x", 1), (9, "z" * 50, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, key int")
    got = [(r.doc_id, tuple(r.ids)) for r in encode_texts(df, long_text=40, segment_chars=10, run_chars=8).collect()]
    assert sorted(map(str, got)) == sorted(str((i, tuple(reference(t or "")))) for i, t, *_ in rows)


def test_empty_table(spark):
    assert encode_texts(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_join_of_halves_is_the_encoding():
    enc = encoder()
    random.seed(1)
    for _ in range(200):
        run = "".join(random.choice("abcdelmnoprstu") for _ in range(random.randint(20, 400)))
        parts = [list(enc._encode_single_piece(p.encode())) for p in halves(run, 16)]
        assert join_tree(enc, parts) == list(enc._encode_single_piece(run.encode()))


def test_segments_cover_the_text():
    random.seed(3)
    for _ in range(100):
        text = "".join(random.choice(PIECES) for _ in range(200))
        assert "".join(p for _, p in segments(text, 20, 5)) == text
