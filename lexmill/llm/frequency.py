"""Frequency of every distinct value (problem 6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def term_frequencies(rows: DataFrame, term: str = "term", tf: str = "tf") -> DataFrame:
    """``(term, occurrences, records)`` over rows that hold each term of a record once.

    Counts per record come in; Spark sums them by hash within each task before the one shuffle on the term, so a
    term of a third of all rows reaches its reducer as one row per task. Null terms are left out, a null count is 1.
    """
    return (
        rows.select(F.col(term).alias("term"), F.coalesce(F.col(tf), F.lit(1)).alias("_tf"))
        .where("term is not null")
        .groupBy("term")
        .agg(F.sum("_tf").alias("occurrences"), F.count("*").alias("records"))
    )


def mark(records: Column, n: int, rare_at_most: int = 2, common_share: int = 5) -> Column:
    """``rare`` for at most so many records, ``common`` for at least one in ``common_share``, else null. Where a tiny
    collection makes both true it is ``rare``."""
    return F.when(records <= rare_at_most, "rare").when(records * common_share >= n, "common")
