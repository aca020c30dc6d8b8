"""k-means by largest dot product."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.index import MOST_WORDS
from lexmill.sources.tables import Scratch, small


def seeds(docs: DataFrame, k: int) -> DataFrame:
    """``(doc_id, cluster)``: the k smallest ids, numbered from 0."""
    first = docs.select("doc_id").distinct().orderBy("doc_id").limit(k)
    return first.select("doc_id", (F.row_number().over(Window.orderBy("doc_id")) - 1).alias("cluster"))


def seed_centroids(vectors: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(cluster, term, c)``: the vectors of the seed documents. Their few ids become a filter that reaches the scan."""
    ids = [r.doc_id for r in chosen.select("doc_id").collect()]
    vectors = vectors.where(F.col("doc_id").isin(ids))
    return vectors.join(F.broadcast(chosen), "doc_id").select("cluster", "term", F.col("v").alias("c"))


def assign(vectors: DataFrame, centroids: DataFrame, docs: DataFrame) -> DataFrame:
    """``(doc_id, cluster, sim)``: the cluster of the largest dot product, of equal ones the lowest; 0 for a document that
    meets no centroid. Centroids are k sparse rows over the vocabulary, broadcast if a count allows it."""
    met = vectors.join(small(centroids, MOST_WORDS), "term").groupBy("doc_id", "cluster").agg(F.round(F.sum(F.col("v") * F.col("c")), 12).alias("sim"))
    best = met.groupBy("doc_id").agg(F.max(F.struct("sim", (-F.col("cluster")).alias("c"))).alias("best"))
    return docs.select("doc_id").join(best, "doc_id", "left").select(
        "doc_id", F.coalesce(-F.col("best.c"), F.lit(0)).cast("int").alias("cluster"), F.coalesce("best.sim", F.lit(0.0)).alias("sim")
    )


def centroids(vectors: DataFrame, assigned: DataFrame) -> DataFrame:
    """``(cluster, term, c)``: means over all members, absent terms counting 0."""
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("size"))
    sums = vectors.join(assigned.select("doc_id", "cluster"), "doc_id").groupBy("cluster", "term").agg(F.sum("v").alias("s"))
    return sums.join(F.broadcast(sizes), "cluster").select("cluster", "term", (F.col("s") / F.col("size")).alias("c"))


def quality(vectors: DataFrame, assigned: DataFrame, means: DataFrame, k: int) -> DataFrame:
    """``(quality)``: the mean over k clusters of the members' mean dot product with their centroid, 0 for empty ones."""
    own = vectors.join(assigned.select("doc_id", "cluster"), "doc_id").join(small(means, MOST_WORDS), ["cluster", "term"])
    totals = own.groupBy("cluster").agg(F.sum(F.col("v") * F.col("c")).alias("s"))
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("size"))
    return sizes.join(totals, "cluster", "left").agg((F.coalesce(F.sum(F.coalesce("s", F.lit(0.0)) / F.col("size")), F.lit(0.0)) / k).alias("quality"))


@dataclass
class Clusters:
    assigned: DataFrame
    means: DataFrame
    rounds: int


def k_means(vectors: DataFrame, docs: DataFrame, scratch: Scratch, k: int = 10, most_rounds: int = 1000) -> Clusters:
    """Rounds of assignment and means until no document changes its cluster. An empty cluster keeps its centroid; k
    greater than the number of documents leaves clusters empty. Each round is written to the shared folder, where only the
    last one stays. An error if the assignments come back to an earlier state, which would go on for ever, or if
    ``most_rounds`` are not enough: there is no result that has not settled."""
    means = scratch.keep(seed_centroids(vectors, seeds(docs, k)))
    states: list[tuple] = []
    for turn in range(1, most_rounds + 1):
        assigned = scratch.keep(assign(vectors, means, docs))
        state = _state(assigned)
        if states and state == states[-1]:
            return Clusters(assigned, means, turn)
        if state in states:
            raise RuntimeError(f"assignments of round {turn} repeat those of round {states.index(state) + 1}")
        states.append(state)
        new = centroids(vectors, assigned)
        empty = means.join(assigned.select("cluster").distinct(), "cluster", "left_anti")
        old, means = means, scratch.keep(new.unionByName(empty))
        scratch.drop(old, assigned)
    raise RuntimeError(f"clusters still change after {most_rounds} rounds")


def _state(assigned: DataFrame) -> tuple:
    """A digest of all assignments: their number and the sum of their hashes."""
    row = assigned.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "cluster").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def array_dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays (H8); null if one is null, missing places count 0."""
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def array_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays (H9)."""
    squares = F.zip_with(a, b, lambda x, y: F.pow(F.coalesce(x.cast("double"), F.lit(0.0)) - F.coalesce(y.cast("double"), F.lit(0.0)), F.lit(2.0)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
