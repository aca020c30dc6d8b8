"""Exact and approximate matching."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def places(text: str, pattern: str) -> list[int]:
    """All 0-based, also overlapping, places; an empty pattern is found at every character."""
    if not pattern:
        return list(range(len(text)))
    out, at = [], text.find(pattern)
    while at >= 0:
        out.append(at)
        at = text.find(pattern, at + 1)
    return out


def find_all(text: Column, pattern: Column) -> Column:
    """``places`` of each row, in characters; null for null. Built-ins give no positions of all matches in time linear
    in the text, so this is an Arrow function; what it reads is narrowed to texts that contain the pattern by callers."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series, patterns: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or p is None else places(t, p) for t, p in zip(texts, patterns, strict=True)], dtype=object)

    return run(text, pattern)


def count_all(text: Column, pattern: Column) -> Column:
    """Number of those places, by a built-in: a look-ahead for the quoted pattern matches at each, overlapping or not."""
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(pattern, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    return F.when(F.length(pattern) == 0, F.length(text)).otherwise(F.regexp_count(text, quoted))


def approximate(pattern: Column, word: Column, errors: int) -> Column:
    """Edit distance of the whole words if it is at most ``errors``, else -1."""
    return F.levenshtein(pattern, word, errors)


def accepts(pattern: Column, word: Column, errors: int) -> Column:
    return approximate(pattern, word, errors) >= 0
