"""Inverted index and boolean queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions.stem import stem, stem_word

#: Words up to which a vocabulary with its stems is sent to all executors.
MOST_WORDS = 2_000_000


def exploded(docs: DataFrame, values: Column, name: str) -> DataFrame:
    """``(doc_id, name)``: one row per value of each document. The outer form, as for the inner one Spark would filter by
    the size of the array first and compute the dear expression again for it."""
    rows = docs.select("doc_id", F.explode_outer(values).alias(name))
    return rows.where(F.col(name).isNotNull())


def tokens(docs: DataFrame, stop: DataFrame | None = None, stemmed: bool = False) -> DataFrame:
    """``(doc_id, word)``: one row per word of each text, stop words removed before stemming, empty words left out.
    Null and empty texts give no rows."""
    rows = exploded(docs, T.words(F.col("text")), "word")
    if stop is not None:
        rows = T.stop_filter(rows, stop)
    if stemmed:  # each distinct word is stemmed once
        known = rows.select("word").distinct().withColumn("stem", stem(F.col("word")))
        rows = rows.join(known, "word").select("doc_id", F.col("stem").alias("word"))
    return rows


def term_counts(words: DataFrame) -> DataFrame:
    """``(doc_id, term, tf)``: occurrences of each term of each document; partial sums come before the shuffle."""
    return words.where(T.is_term(F.col("word"))).groupBy("doc_id", F.col("word").alias("term")).agg(F.count("*").alias("tf"))


def postings(docs: DataFrame, stop: DataFrame | None = None, stemmed: bool = False, tf: str = "binary") -> DataFrame:
    """``(doc_id, term, tf)``. ``tf="binary"`` is 1 for every term of a document, ``"count"`` its occurrences.

    The binary form without stop words and stems needs no shuffle: distinct terms are taken within each document.
    """
    if tf == "binary" and stop is None and not stemmed:
        return exploded(docs, F.array_distinct(T.terms(F.col("text"))), "term").withColumn("tf", F.lit(1).cast("long"))
    counts = term_counts(tokens(docs, stop, stemmed))
    return counts if tf == "count" else counts.withColumn("tf", F.lit(1).cast("long"))


def document_frequencies(rows: DataFrame, n: int) -> DataFrame:
    """``(term, df, idf)`` with idf = log10(n / df)."""
    counts = rows.groupBy("term").agg(F.sum("tf").alias("df"))
    return counts.withColumn("idf", F.log10(F.lit(float(n)) / F.col("df")))


def inverted_index(rows: DataFrame) -> DataFrame:
    """``(term, doc_ids)``, ids ascending. The nested form of the index file; a term of very many documents is one
    long row, so queries use the flat postings instead."""
    return rows.groupBy("term").agg(F.sort_array(F.collect_set("doc_id")).alias("doc_ids"))


def keywords(query: str, document_like: bool = False) -> list[str]:
    """Stems of a query's words, split at single spaces, nothing else done to them; with ``document_like`` the text is
    normalised first. Empty words are kept, as they make an AND query empty."""
    if document_like:
        return [stem_word(w) for w in T.normalize_line(query).split(" ") if w]
    return [stem_word(w) if w else w for w in query.split(" ")]


def boolean_and(rows: DataFrame, words: list[str]) -> DataFrame:
    """``(doc_id)`` of the documents that hold all words; none for an empty query or an unknown or empty word."""
    wanted = sorted(set(words))
    if not wanted or "" in wanted:
        return rows.select("doc_id").limit(0)
    hits = rows.where(F.col("term").isin(wanted)).groupBy("doc_id").agg(F.count_distinct("term").alias("n"))
    return hits.where(F.col("n") == len(wanted)).select("doc_id")


def contains_all(ids: Column, other: Column) -> Column:
    """Intersection of two id lists."""
    return F.array_intersect(ids, other)


def query_table(spark: SparkSession, words: list[str]) -> DataFrame:
    """``(term, qw)``: each non-empty keyword with weight 1 / sqrt(number of non-empty keywords), repeats kept."""
    kept = [w for w in words if w]
    return spark.createDataFrame([(w, len(kept) ** -0.5) for w in kept], "term string, qw double")
