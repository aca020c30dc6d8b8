"""Normalisation, words and terms."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.stem import stem_word

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED = "<>/\\.-"
KEPT = LOWER + "0123456789 "


def normalize(text: Column) -> Column:
    """Lower-case ASCII letters, digits and spaces; ``<>/\\.-`` and line feeds become spaces, all else goes.

    ``translate`` and not ``lower``: Unicode lower-casing would turn other letters into ASCII ones. Null stays null.
    """
    return F.regexp_replace(F.translate(text, UPPER + SPACED + "\n", LOWER + " " * (len(SPACED) + 1)), "[^a-z0-9 ]", "")


def words(text: Column) -> Column:
    """Non-empty words of a raw text, in order."""
    return F.filter(F.split(normalize(text), " "), lambda w: w != "")


def terms(text: Column) -> Column:
    """Words of a raw text that are terms, in order, repeats kept: ``is_term`` of ``words`` in one pass of a pattern."""
    return F.regexp_extract_all(normalize(text), F.lit("(?<![a-z0-9])(?![0-9]+(?: |$))[a-z0-9]{3,}"), 0)


def is_term(term: Column) -> Column:
    """More than two characters and not all digits; null is no term."""
    return F.coalesce((F.length(term) > 2) & ~term.rlike("^[0-9]+$"), F.lit(False))


def is_term_word(term: str | None) -> bool:
    return term is not None and len(term) > 2 and not (term.isascii() and term.isdigit())


_TABLE = bytes(
    ord(chr(b).lower()) if chr(b) in UPPER else 32 if chr(b) in SPACED else b for b in range(256)
)
_DROP = bytes(b for b in range(256) if chr(_TABLE[b]) not in KEPT)


def normalize_line(line: str) -> str:
    """``normalize`` for one line, outside the JVM."""
    return line.encode("ascii", "ignore").translate(_TABLE, _DROP).decode("ascii")


def process_lines(lines: Iterable[str | None], stop: frozenset[str], step4: str = "reference") -> str:
    """Processed text of an article: of each line the stems of its words that are no stop words, each with a
    space after it, and a line feed at the line's end. A null line counts as an empty one."""
    out = []
    for line in lines:
        kept = [stem_word(w, step4) + " " for w in normalize_line(line or "").split(" ") if w and w not in stop]
        out.append("".join(kept) + "\n")
    return "".join(out)


def process_text(lines: Column, stop: frozenset[str], step4: str = "reference") -> Column:
    """Processed text of an array of lines; null for null. ``stop`` is the small fixed stop-word list."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(lambda x: None if x is None else process_lines(x, stop, step4))

    return run(lines)


def processed_words(text: Column) -> Column:
    """Words of a processed text; null for null."""
    return F.filter(F.split(text, "[ \n]"), lambda w: w != "")


def stop_list(stop: DataFrame, most: int = 100_000) -> frozenset[str]:
    """The words of a stop-word table, for functions that run outside the JVM. An error beyond ``most``: such a list is no
    list of stop words, and its words are not dropped silently."""
    words = stop.where("word is not null").select("word").distinct().limit(most + 1).collect()
    if len(words) > most:
        raise ValueError(f"more than {most} stop words")
    return frozenset(r.word for r in words)


def stop_filter(rows: DataFrame, stop: DataFrame, word: str = "word") -> DataFrame:
    """Rows whose word is no stop word. The list is a fixed file of some hundred words; Spark broadcasts it
    when its size statistics are under the broadcast threshold."""
    return rows.join(stop.select(F.col("word").alias(word)).distinct(), word, "left_anti")
