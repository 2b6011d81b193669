import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigraph.functions.text import kept_words_column, stem_word, tokenize_text, with_stem

STEMS = {
    "running": "run", "cats": "cat", "connected": "connect", "flies": "fli", "happily": "happili", "caresses": "caress", "bus": "bu",
    "agreed": "agre", "agre": "agr", "license": "licens", "licens": "licen", "database": "databas", "databas": "databa", "filing": "file",
    "controlling": "control", "relational": "relat", "nationalization": "nation", "generalization": "gener", "nation": "nation",
    "opinion": "opinion", "adoption": "adopt", "hopeful": "hope", "hope": "hope", "rate": "rate", "allocation": "alloc",
    "memory": "memori", "sky": "sky", "shell": "shell", "is": "is",
}


@pytest.mark.parametrize(("word", "stem"), STEMS.items())
def test_stems(word, stem):
    assert stem_word(word) == stem


def test_columns_stem_like_python(spark):
    words = [r.word for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.explode(kept_words_column(F.col("text"))).alias("word")).distinct().collect()]
    ends = ["ational", "tional", "enci", "izer", "abli", "alli", "entli", "eli", "ousli", "ization", "ator", "alism", "iveness", "fulness", "biliti", "icate", "ative", "ical", "ness", "ement", "ion", "sion", "ous", "ive", "ize", "eed", "ed", "ing", "y", "e", "ll", "sses", "ies", "ss"]
    words += [a + e for a in ("", "b", "tr", "agr", "hop", "conn", "fall", "controll", "siz", "troubl") for e in ends] + list(STEMS)
    words = sorted({w for w in words if w})
    got = {r.word: r.term for r in with_stem(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {w: stem_word(w) for w in words}


def test_tokens():
    assert tokenize_text("the quick brown fox jumps over the lazy dog") == "quick brown fox jump over lazi dog".split()
    assert tokenize_text("State-of-the-art, x_1") == ["state", "art"]
    assert tokenize_text("é a 7") == ["é"]
    assert tokenize_text("") == tokenize_text("the of") == []


def test_words_column_agrees_with_python(spark):
    texts = ["State-of-the-art, x_1", "é a 7 日本 x1", "", None, "Foo_Bar d'état THE Of", "tab\tnew\nline"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", kept_words_column(F.col("t")).alias("w")).collect()
    for r in rows:
        assert [stem_word(w) for w in r.w] == tokenize_text(texts[r.i] or "")


@settings(max_examples=300)
@given(st.text("abcdeilnostuyz", max_size=14))
def test_stemming_never_fails_or_grows_much(word):
    assert len(stem_word(word)) <= len(word) + 1
