"""The term bag of an article id, which several operators share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import is_term
from lexmill.sources.tables import Scratch, small

#: Rows of (doc_id) up to which a list of ids is sent to all executors: 16 MB.
MOST_IDS = 1_000_000


@dataclass
class Bags:
    """``rows`` (doc_id, term, tf), one row per term of an id; ``n`` ids have a bag."""

    rows: DataFrame
    n: int


def _parts(postings: DataFrame, articles: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The valid postings, their ids, and the bags (doc_id, term, tf) of the other articles."""
    valid = postings.where(is_term(F.col("term")) & F.col("doc_id").isNotNull())
    known = scratch.keep(valid.select("doc_id").distinct())
    absent = scratch.keep(articles.select("doc_id").where("doc_id is not null").distinct().join(known, "doc_id", "left_anti"))
    newest = (
        articles.select("doc_id", "processed_words", "ingested_at")
        .where("processed_words is not null")
        .join(small(absent, MOST_IDS), "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.max_by("processed_words", F.coalesce("ingested_at", F.lit("1970-01-01").cast("timestamp"))).alias("words"))
    )
    others = scratch.keep(
        newest.select("doc_id", F.explode("words").alias("term"))
        .where(is_term(F.col("term")))
        .groupBy("doc_id", "term")
        .agg(F.count("*").alias("tf"))
    )
    return valid, known, others


def term_sets(postings: DataFrame, articles: DataFrame, scratch: Scratch) -> DataFrame:
    """``(doc_id, tokens)``: the sorted 64-bit hashes of the terms of each bag, see ``term_bags``. The set of an id is
    collected after its repeats are dropped within each task; it is bounded by the vocabulary."""
    valid, _, others = _parts(postings, articles, scratch)
    token = F.xxhash64("term").alias("token")
    rows = valid.select(F.col("doc_id").cast("long").alias("doc_id"), token).unionByName(others.select(F.col("doc_id").cast("long").alias("doc_id"), token))
    return rows.groupBy("doc_id").agg(F.sort_array(F.collect_set("token")).alias("tokens"))


def term_bags(postings: DataFrame, articles: DataFrame, scratch: Scratch, keep: bool = False) -> Bags:
    """Bag of every id: its terms in ``postings``; if it has none there, the words of its ``processed_words``.

    Repeated postings count once (of differing repeats the largest tf), a null tf is 1; rows with a null id or term
    or a term that fails the term test are left out. Of repeated articles the newest row with words counts. Ids
    without any term have no bag; empty tables give an empty bag. Other columns are ignored. ``keep`` writes the
    rows, for callers that read them more than once.
    """
    valid, known, others = _parts(postings, articles, scratch)
    tf = F.max(F.coalesce(F.col("tf").cast("long"), F.lit(1))).alias("tf")
    rows = valid.groupBy("doc_id", "term").agg(tf).unionByName(others)
    return Bags(scratch.keep(rows) if keep else rows, known.count() + others.select("doc_id").distinct().count())
