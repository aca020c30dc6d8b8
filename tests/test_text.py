import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.functions.stem import measure, shape, stem, stem_word

# Words and the stems that the complete pipeline gives them.
STEMS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor",
    "sing": "sing", "conflated": "conflat", "troubling": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall",
    "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
    "conditional": "condit", "rational": "ration", "valenci": "valenc", "warcraft": "warcraft", "president": "president",
    "dependent": "dependent", "recommend": "recomm", "dividend": "divid", "depend": "depend", "government": "govern", "1980s": "1980",
}


@pytest.mark.parametrize("word,expected", STEMS.items())
def test_stem(word, expected):
    assert stem_word(word) == expected


def test_published_step4():
    assert stem_word("president", "porter") == "presid"
    assert stem_word("recommend", "porter") == "recommend"


@pytest.mark.parametrize("word", ["ion", "ies", "a", "be", "", "y", "yyy", "bbb"])
def test_stem_short_and_odd(word):
    assert isinstance(stem_word(word), str)


@given(st.text("abcdefghijklmnopqrstuvwxyz0123456789", max_size=20))
@settings(max_examples=300, deadline=None)
def test_stem_never_grows(word):
    assert len(stem_word(word)) <= len(word) + 1
    assert len(shape(word)) == len(word) and measure(word) >= 0


def test_stem_column(spark):
    rows = spark.createDataFrame([("motoring",), (None,), ("",)], "w string")
    assert [r.s for r in rows.select(stem(F.col("w")).alias("s")).collect()] == ["motor", None, ""]


def test_normalize(spark):
    cases = {"don't U.S.": ["dont", "u", "s"], "a,b c-d": ["ab", "c", "d"], "<TITLE>Oil prices</TITLE>": ["title", "oil", "prices", "title"], "&lt;XYZ> 1,200": ["ltxyz", "1200"], "a\tb": ["ab"], "a\nb": ["a", "b"], "Kelvin K é": ["kelvin"], "": []}
    rows = spark.createDataFrame([*((k, k) for k in cases), (None, None)], "k string, t string")
    for r in rows.select("k", text.words(F.col("t")).alias("w")).collect():
        assert r.w == (None if r.k is None else cases[r.k])
    for k, expected in cases.items():
        assert text.process_lines(k.split("\n"), frozenset()).split() == [stem_word(w) for w in expected]


def test_process_lines():
    assert text.process_lines(["The oil prices", None, ""], frozenset({"the"})) == "oil price \n\n\n"


def test_is_term(spark):
    rows = spark.createDataFrame([("oil",), ("1980",), ("19x",), ("ab",), (None,)], "t string")
    assert [r.t for r in rows.where(text.is_term(F.col("t"))).collect()] == ["oil", "19x"]
    assert text.is_term_word("oil") and not text.is_term_word("1980") and not text.is_term_word(None)


def test_terms(spark):
    rows = spark.createDataFrame([("Oil 1980 19x, ab abc 123 4567z x",), ("",), (None,), ("12 345",)], "t string")
    for r in rows.select("t", text.terms(F.col("t")).alias("a"), F.filter(text.words(F.col("t")), text.is_term).alias("b")).collect():
        assert r.a == r.b and (r.t is None) == (r.a is None)


def test_stop_filter(spark):
    rows, stop = spark.createDataFrame([("the",), ("oil",), ("oil",)], "word string"), spark.createDataFrame([("the",), ("the",)], "word string")
    assert [r.word for r in text.stop_filter(rows, stop).collect()] == ["oil", "oil"]
