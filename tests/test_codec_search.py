import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import codec, regex, search
from lexmill.timing import Stopwatch, format_time

CODES = {
    1: "11", 2: "011", 3: "0011", 4: "1011", 19: "1001011", 30: "10001011", 50: "001001011", 99: "01001000011", 250: "1010010000011",
    363: "0101000101011", 500: "00000001010011", 721: "100000100100011", 755: "100000000010011", 2000: "00010010000010011",
}


def test_numbers():
    assert codec.fibonacci_numbers(5) == [1, 2, 3, 5, 8]
    assert codec.fibonacci_numbers()[-1] == 20365011074


def test_codes(spark):
    rows = spark.createDataFrame([(v,) for v in [*CODES, 0, -1, codec.LARGEST, codec.LARGEST + 1, None]], "v long")
    got = {r.v: (r.c, r.d) for r in rows.select("v", codec.fibonacci_encode(F.col("v")).alias("c"), codec.fibonacci_decode(codec.fibonacci_encode(F.col("v"))).alias("d")).collect()}
    assert {v: got[v][0] for v in CODES} == CODES
    assert got[0] == got[-1] == got[None] == got[codec.LARGEST + 1] == (None, None)
    assert got[codec.LARGEST][1] == codec.LARGEST


def test_deltas(spark):
    lists = [[1, 20, 50, 100, 101, 200, 450, 813, 1568], [2000, 2500, 3221], [7], [], None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, ids array<long>")
    e = codec.delta_encode(F.col("ids"))
    got = [(r.e, r.d) for r in rows.orderBy("i").select(e.alias("e"), codec.delta_decode(e).alias("d")).collect()]
    assert got[0][0] == [1, 19, 30, 50, 1, 99, 250, 363, 755] and got[1][0] == [2000, 500, 721]
    assert [d for _, d in got] == lists


def test_stream_round_trip(spark):
    lists = [sorted({(i * 7919) % 100_003 + 1 for i in range(n)}) for n in (0, 1, 2, 50, 400)]
    rows = spark.createDataFrame([(x,) for x in lists], "ids array<long>")
    bits = codec.encode_ids(F.col("ids"))
    for r in rows.select("ids", codec.decode_ids(codec.unpack_bits(codec.pack_bits(bits))).alias("back")).collect():
        assert r.ids == r.back


@given(st.lists(st.lists(st.integers(1, 200_000), unique=True, max_size=60).map(sorted), max_size=5))
@settings(max_examples=100, deadline=None)
def test_packed(lists):
    packed = codec._pack(lists)
    assert [codec._unpack(x).tolist() for x in packed] == lists


def test_packed_columns(spark):
    rows = spark.createDataFrame([([1, 20, 50, 813],), ([],), (None,), ([1, 2, 3, 4, 5, 6],)], "ids array<long>")
    one, other = codec.encode_packed(F.col("ids")), codec.pack_bits(codec.encode_ids(F.col("ids")))
    for r in rows.select("ids", one.alias("a"), other.alias("b"), codec.decode_packed(one).alias("back")).collect():
        assert r.back == r.ids and (r.ids is None or r.a == r.b)


def test_bad_code(spark):
    rows = spark.createDataFrame([("10",), ("",), ("0110",), (None,)], "c string")
    assert [r.v for r in rows.select(codec.fibonacci_decode(F.col("c")).alias("v")).collect()] == [None] * 4


@given(st.text("ab", max_size=30), st.text("ab", max_size=4))
@settings(max_examples=200, deadline=None)
def test_places(text, pattern):
    expected = list(range(len(text))) if not pattern else [i for i in range(len(text)) if text.startswith(pattern, i)]
    assert search.places(text, pattern) == expected


def test_search_columns(spark):
    cases = [("aaaa", "aa", [0, 1, 2]), ("abcabc", "abc", [0, 3]), ("a", "abc", []), ("abc", "", [0, 1, 2]), ("a.b\\Ec", "\\E", [3]), ("žaža", "ža", [0, 2]), (None, "a", None), ("a", None, None)]
    rows = spark.createDataFrame([c[:2] for c in cases], "t string, p string")
    got = rows.select(search.find_all(F.col("t"), F.col("p")).alias("f"), search.count_all(F.col("t"), F.col("p")).alias("n")).collect()
    for r, (*_, expected) in zip(got, cases, strict=True):
        assert r.f == expected and r.n == (None if expected is None else len(expected))


def test_approximate(spark):
    cases = [("kitten", "sitting", 3, 3), ("kitten", "sitting", 2, -1), ("abc", "abc", 0, 0), ("ab", "", 2, 2)]
    for a, b, k, expected in cases:
        r = spark.createDataFrame([(a, b)], "a string, b string").select(search.approximate(F.col("a"), F.col("b"), k).alias("d"), search.accepts(F.col("a"), F.col("b"), k).alias("ok")).first()
        assert r.d == expected and r.ok == (expected >= 0)


def test_regex(spark):
    words = spark.createDataFrame([("oil",), ("ga",), ("gasss",), ("oils",), (None,)], "w string")
    assert sorted(r.w for r in words.where(regex.matches(F.col("w"), "oil|gas*")).collect()) == ["ga", "gasss", "oil"]
    for bad in ("", "*a", "a**", "a|", "a(b)", "a.b"):
        with pytest.raises(ValueError):
            regex.parse(bad)


def test_stopwatch():
    w = Stopwatch()
    w[0].start()
    w[0].end_lap()
    w[0].stop()
    assert len(w[0].laps) == 2 and w.seconds() >= 0 and w.seconds(9) == 0 and w.new() == 1 and w[5].average_lap == 0
    assert format_time(3_723_004.5) == "1 hours, 2 minutes, 3 seconds, 4.500000 milliseconds"
