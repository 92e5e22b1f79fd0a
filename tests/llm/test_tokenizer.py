import random

import pytest
from cairn.llm import tokenizer as T

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(T.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return t


def test_same_ids_as_the_library(library):
    table, rnd = T.vocabulary(T.DEFAULT_VOCABULARY), random.Random(4)
    parts = ["'s", "'ll", "'", "''", " ", "  ", "\n", "\t", "　", "a", "Zürich", "中", "文字", "9", "²", "!", "<|endoftext|>", "_", "😀", "don't", "\r\n", "\x00", "हि", "aaaa", "'S"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["", "ab" * 4000, "a" * 5000, "".join(rnd.choice("abcdefgh") for _ in range(9000))]
    ids, counts = table.encode(texts)
    at = 0
    for text, n, e in zip(texts, counts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids[at : at + n].tolist() == e.ids, text[:80]
        at += n


def test_nulls_repeats_and_other_columns(spark, library):
    rows = [(1, "one two", "x"), (2, None, "y"), (3, "", None), (1, "one two", "x"), (None, "key missing", "z"), (4, "word " * 50_000, "")]
    df = spark.createDataFrame(rows, "key bigint, text string, ids string")
    out = {(r["key"], len(r["ids"])) for r in T.encode_texts(df, "key", "text").collect()}
    assert out == {(1, 2), (2, 0), (3, 0), (None, 2), (4, len(library.encode("word " * 50_000, add_special_tokens=False).ids))}
    assert T.encode_texts(df, "key", "text").count() == 6
    assert T.encode_texts(df.where("false"), "key", "text").count() == 0
    counted = T.count_tokens(df, "text").collect()
    assert sorted(counted[0].asDict()) == ["ids", "key", "n_tokens"] and sum(r["n_tokens"] == 0 for r in counted) == 2
