"""How characteristic a term is of its record (problem 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.bags import Bags
from lexmill.llm.frequency import term_frequencies
from lexmill.sources.tables import Scratch, small

#: Terms up to which the statistics of all terms are sent to every executor (about 100 MB).
MOST_TERMS = 1_000_000


def information(model: str, tf: Column, n: int, occurrences: Column, records: Column) -> Column:
    """Information content of ``tf`` occurrences: ``geometric`` is -log2 of their probability under a geometric
    distribution with the collection's mean, ``document`` is tf * log10(N / records)."""
    if model == "geometric":
        mean = occurrences / F.lit(float(n))
        return F.log2(1 + mean) - tf * F.log2(mean / (1 + mean))
    if model == "document":
        return tf * F.log10(F.lit(float(n)) / records)
    raise ValueError(model)


def distinctive_terms(
    bags: Bags, scratch: Scratch, model: str = "geometric", after_effect: str = "laplace", length: str = "h2",
    c: float = 1.0, digits: int = 9, top: int | None = None,
) -> DataFrame:
    """Divergence from randomness: ``(doc_id, term, tf, score)`` for every term of every bag, or the ``top`` of each.

    Score = information content of the frequency x gain. ``length="h2"`` takes tf * log2(1 + c * mean length /
    length) for the frequency, ``"none"`` the plain tf. ``after_effect="laplace"`` has the gain 1 / (frequency + 1),
    ``"none"`` has 1. Scores are rounded to ``digits``; equal ones rank by term in byte order. An empty bag table gives no rows. Statistics are sums over all
    bags; the join on the term sends them to the tasks if their count allows it, else Spark shuffles, splitting hot
    terms (AQE). The top terms are cut per task before the shuffle by record.
    """
    stats = scratch.keep(term_frequencies(bags.rows))
    rows = bags.rows.join(small(stats, MOST_TERMS), "term")
    tf = F.col("tf").cast("double")
    if length == "h2":
        sizes = scratch.keep(bags.rows.groupBy("doc_id").agg(F.sum("tf").alias("size")))
        mean = sizes.agg(F.avg("size")).first()[0] or 1.0
        rows = rows.join(small(sizes, MOST_TERMS), "doc_id")
        tf = tf * F.log2(1 + F.lit(c * mean) / F.col("size"))
    score = information(model, tf, bags.n, F.col("occurrences"), F.col("records"))
    if after_effect == "laplace":
        score = score / (tf + 1)
    scored = rows.select("doc_id", "term", "tf", F.round(score, digits).alias("score"))
    if top is None:
        return scored
    rank = Window.partitionBy("doc_id").orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top).drop("rank")
