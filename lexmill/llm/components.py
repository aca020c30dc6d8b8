"""Connected components of links held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.sources.tables import Scratch


def components(links: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for the ends of ``links (a, b)``; a component is named by its smallest id.

    Alternating star contraction: every node's larger neighbours are linked to its smallest one, then its smaller
    ones, until nothing changes; the number of rounds grows with the logarithm of the longest chain. Each round is
    an aggregation with partial sums and a join on the node, so a node with any number of links is never collected.
    Links stay in tables on the cluster. No links give no rows.
    """
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = _state(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = scratch.keep(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        joined = large.join(low, "u")
        small = scratch.keep(joined.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v"))).where("u <> v").distinct())
        scratch.drop(edges, large)
        edges, before = small, state
        state = _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError("links did not contract")
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """A digest of all links: their number and the sum of their hashes."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
