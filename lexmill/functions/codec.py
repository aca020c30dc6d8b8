"""Delta and Fibonacci codes (G1-G6), as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fibonacci_numbers(n: int = 50) -> list[int]:
    """1, 2, 3, 5, 8, ...: the first ``n``."""
    out, a, b = [], 1, 2
    for _ in range(n):
        out.append(a)
        a, b = b, a + b
    return out


LARGEST = fibonacci_numbers(51)[-1] - 1  # the largest value that 50 numbers encode


def delta_encode(ids: Column) -> Column:
    """The first id, then the gaps; an empty array stays empty, null stays null."""
    return F.transform(ids, lambda x, i: x - F.coalesce(F.get(ids, i - 1), F.lit(0)))


def delta_decode(gaps: Column) -> Column:
    """Running sums of the gaps; null for null and for an array that holds one. A fold over arrays would copy what it has at
    every step, so this is an Arrow function, linear in the list."""

    @F.pandas_udf("array<bigint>")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None or any(g is None or g != g for g in x) else np.cumsum(np.asarray(x, np.int64)))

    return run(gaps)


def fibonacci_encode(value: Column) -> Column:
    """Code word of a value from 1 to ``LARGEST``: its Zeckendorf digits, smallest first, and a closing 1. Null for
    others, as they have no code."""
    numbers = F.array(*(F.lit(x).cast("long") for x in reversed(fibonacci_numbers())))
    start = F.struct(value.cast("long").alias("rest"), F.lit("").alias("bits"))

    def step(state: Column, number: Column) -> Column:
        fits = state["rest"] >= number
        bits = F.when(fits, F.concat(F.lit("1"), state["bits"])).when(state["bits"] == "", "").otherwise(F.concat(F.lit("0"), state["bits"]))
        return F.struct(F.when(fits, state["rest"] - number).otherwise(state["rest"]).alias("rest"), bits.alias("bits"))

    code = F.aggregate(numbers, start, step, lambda state: F.concat(state["bits"], F.lit("1")))
    return F.when((value >= 1) & (value <= LARGEST), code)


def fibonacci_decode(code: Column) -> Column:
    """Value of one code word; null for null and for what is no code word."""
    numbers = F.array(*(F.lit(x).cast("long") for x in fibonacci_numbers()))
    places = F.sequence(F.lit(1), F.length(code) - 1)
    total = F.aggregate(places, F.lit(0).cast("long"), lambda s, i: s + F.when(F.substring(code, i, F.lit(1)) == "1", F.element_at(numbers, i)).otherwise(F.lit(0)))
    return F.when(code.rlike("^(0|10)*11$") & (F.length(code) <= 51), total)


def encode_ids(ids: Column) -> Column:
    """Bit string of an ascending id list from 1 on: the code words of its deltas one after the other."""
    return F.array_join(F.transform(delta_encode(ids), fibonacci_encode), "")


def split_codes(bits: Column) -> Column:
    """Code words of a pure stream of them."""
    return F.regexp_extract_all(bits, F.lit("((?:0|10)*11)"), 1)


def decode_ids(bits: Column) -> Column:
    """Ids of such a bit string; null for null."""

    @F.pandas_udf("array<bigint>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else _ids(np.frombuffer(x.encode(), np.uint8) == 49))

    return run(bits)


def pack_bits(bits: Column) -> Column:
    """Bytes of a bit string, first bit highest, zeros at the end."""
    whole = F.rpad(bits, (F.ceil(F.length(bits) / 8) * 8).cast("int"), "0")
    return F.unhex(F.array_join(F.transform(F.regexp_extract_all(whole, F.lit("[01]{4}"), 0), lambda x: F.conv(x, 2, 16)), ""))


def unpack_bits(data: Column) -> Column:
    """Bit string of bytes. Zeros that pad the last byte form no code word."""
    digits = F.regexp_extract_all(F.hex(data), F.lit("[0-9A-F]"), 0)
    return F.array_join(F.transform(digits, lambda x: F.lpad(F.conv(x, 16, 2), 4, "0")), "")


def _pack(lists: list[np.ndarray]) -> list[bytes]:
    """Packed code words of the deltas of many lists: the digits of all values are found number by number."""
    sizes = [len(x) for x in lists]
    ids = np.concatenate([np.asarray(x, np.int64) for x in lists]) if sizes else np.zeros(0, np.int64)
    starts = np.cumsum([0, *sizes])
    rest = np.diff(ids, prepend=0)
    heads = starts[:-1][np.array(sizes, np.int64) > 0]
    rest[heads] = ids[heads]
    if len(rest) and (rest.min() < 1 or rest.max() > LARGEST):
        raise ValueError("ids must ascend from 1 on, in steps that have a code")
    numbers = fibonacci_numbers()
    digits = np.zeros((len(rest), len(numbers) + 1), np.uint8)
    highest = np.zeros(len(rest), np.int64)
    for k in range(len(numbers) - 1, -1, -1):
        fits = rest >= numbers[k]
        digits[fits, k] = 1
        rest[fits] -= numbers[k]
        highest = np.where(fits & (highest == 0), k + 1, highest)
    digits[np.arange(len(rest)), highest] = 1
    kept = np.arange(digits.shape[1])[None] <= highest[:, None]
    bits, ends = digits[kept], np.r_[0, np.cumsum(highest + 1)][starts]
    return [np.packbits(bits[a:b]).tobytes() for a, b in zip(ends, ends[1:], strict=False)]


def _unpack(data: bytes) -> np.ndarray:
    """Ids of packed code words. In a run of ones every second one ends a code word; zeros at the end form none."""
    return _ids(np.unpackbits(np.frombuffer(data, np.uint8)).astype(bool))


def _ids(bits: np.ndarray) -> np.ndarray:
    at = np.arange(len(bits))
    before = np.maximum.accumulate(np.where(bits, -1, at)) if len(bits) else at
    ends = np.flatnonzero(bits & ((at - before) % 2 == 0))
    if not len(ends):
        return np.zeros(0, np.int64)
    numbers = np.array(fibonacci_numbers(), np.int64)
    starts = np.r_[0, ends[:-1] + 1]
    used = np.flatnonzero(bits[: ends[-1] + 1])
    used = used[~np.isin(used, ends)]
    word = np.searchsorted(ends, used)
    values = np.zeros(len(ends), np.int64)
    np.add.at(values, word, numbers[used - starts[word]])
    return np.cumsum(values)


def encode_packed(ids: Column) -> Column:
    """Bytes of an ascending id list, ``pack_bits`` of ``encode_ids``, for long lists: Arrow batches, all digits at once."""

    @F.pandas_udf("binary")
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series(_pack([x if x is not None else np.zeros(0, np.int64) for x in lists]), index=lists.index, dtype=object).where(lists.notna(), None)

    return run(ids)


def decode_packed(codes: Column) -> Column:
    """Ids of those bytes."""

    @F.pandas_udf("array<bigint>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else _unpack(x))

    return run(codes)
