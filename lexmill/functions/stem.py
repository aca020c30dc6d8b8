"""Suffix-stripping stemmer (Porter 1980) with the engine's step-4 deviation.

Works on a word and its consonant/vowel shape: the measure of a stem is the
number of ``vc`` changes in its shape. ``step4="reference"`` removes ``end``
where the published algorithm removes ``ent``; ``step4="porter"`` is the
published rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix rules of the algorithm, in the order in which they are tried.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
)
STEP4_EXTRA = {"reference": "end", "porter": "ent"}


def shape(word: str) -> str:
    """One ``v`` or ``c`` per character; ``y`` is a vowel after a consonant, digits are consonants."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def measure(word: str) -> int:
    return shape(word).count("vc")


def _closes_cvc(word: str) -> bool:
    return shape(word).endswith("cvc") and word[-1] not in "wxy"


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def _plural(word: str) -> str:
    if word.endswith("sses") or word.endswith("ies"):
        return word[:-2]
    return word[:-1] if word.endswith("s") and word[-2:-1] != "s" else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) else word
    for end in ("ed", "ing"):
        if word.endswith(end):
            stem = word[: -len(end)]
            if "v" not in shape(stem):
                return word
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _doubled(stem):
                return stem if stem[-1] in "lsz" else stem[:-1]
            return stem + "e" if measure(stem) == 1 and _closes_cvc(stem) else stem
    return word


def _swap(word: str, rules: tuple[tuple[str, str], ...]) -> str:
    for end, new in rules:
        if word.endswith(end):
            return word[: -len(end)] + new if measure(word[: -len(end)]) else word
    return word


def _residual(word: str, ends: tuple[str, ...]) -> str:
    for end in ends:
        if word.endswith(end):
            stem = word[: -len(end)]
            if end == "ion" and stem[-1:] not in ("s", "t"):
                continue
            return stem if measure(stem) > 1 else word
    return word


def _tidy(word: str) -> str:
    whole = measure(word)
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not _closes_cvc(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and whole > 1 else word


@lru_cache(maxsize=1 << 17)
def stem_word(word: str, step4: str = "reference") -> str:
    """Stem of a normalised word; words of one or two characters stay as they are."""
    if len(word) < 3:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, STEP2), STEP3)
    return _tidy(_residual(word, (*STEP4, STEP4_EXTRA[step4])))


def stem(col: Column, step4: str = "reference") -> Column:
    """Column of stems. Arrow batches; apply it to a distinct vocabulary and join where that is smaller."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for words in batches:
            yield words.map(lambda w: None if w is None else stem_word(w, step4))

    udf: Callable = F.pandas_udf(run, "string")
    return udf(col)
