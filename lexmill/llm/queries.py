"""Queries of this subpackage: name to a function of the session and the tables' folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import stop_list
from lexmill.llm import distinctive, encode, flow_clusters, frequency, leak, markup, near_dup, neighbors, pii, set_join
from lexmill.llm.bags import Bags, term_bags, term_sets
from lexmill.llm.hashing import fold_copies
from lexmill.sources.tables import Scratch, table


def _bags(spark: SparkSession, d: str, scratch: Scratch, keep: bool = False) -> Bags:
    return term_bags(table(spark, d, "postings"), table(spark, d, "articles"), scratch, keep)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = neighbors.nearest(neighbors.entries(table(spark, d, "term_document_info")), Scratch(spark))
    return found.select("field", F.least("doc_id", "other").alias("doc_a"), F.greatest("doc_id", "other").alias("doc_b")).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark)
    sets, members = fold_copies(term_sets(table(spark, d, "postings"), table(spark, d, "articles"), scratch), scratch)
    return set_join.all_pairs(scratch.keep(set_join.similar_sets(sets, scratch)), members, scratch).select("doc_a", "doc_b")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The three leading terms by tf * log10(N / df): information content of the document model, without length
    normalisation and after-effect."""
    scratch = Scratch(spark)
    bags = _bags(spark, d, scratch, keep=True)
    return distinctive.distinctive_terms(bags, scratch, "document", "none", "none", top=3).select("doc_id", "term")


def p3_divergence(spark: SparkSession, d: str) -> DataFrame:
    """The ten leading terms of each article by divergence from randomness."""
    scratch = Scratch(spark)
    return distinctive.distinctive_terms(_bags(spark, d, scratch, keep=True), scratch, digits=6, top=10).select("doc_id", "term", "score")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = flow_clusters.clusters(table(spark, d, "term_document_info"), table(spark, d, "clusters"), Scratch(spark))
    return found.select("doc_id", "cluster_id")


def p4_described(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical members of each cluster."""
    scratch = Scratch(spark)
    return flow_clusters.describe(scratch.keep(flow_clusters.clusters(table(spark, d, "term_document_info"), table(spark, d, "clusters"), scratch)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = markup.markup(table(spark, d, "articles"), Scratch(spark))
    return found.select("doc_id", F.explode("kinds").alias("structure")).distinct()


def p5_clean(spark: SparkSession, d: str) -> DataFrame:
    """The clean text of each article with foreign markup; headings, lists, code and formulas keep a mark."""
    return markup.markup(table(spark, d, "articles"), Scratch(spark)).select("doc_id", "text").distinct()


def p5_template(spark: SparkSession, d: str) -> DataFrame:
    """The template classes of each file."""
    pages = table(spark, d, "articles").where("text_lines is not null")
    return markup.template_classes(pages, Scratch(spark)).select("path", F.array_join("tokens", " ").alias("tokens"), "pages", "depth")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    bags = _bags(spark, d, Scratch(spark))
    marked = frequency.term_frequencies(bags.rows).withColumn("mark", frequency.mark(F.col("records"), bags.n))
    return marked.where("mark is not null").select("term", "mark")


def p6_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its occurrences, its number of articles and its mark, null for useful terms."""
    bags = _bags(spark, d, Scratch(spark))
    return frequency.term_frequencies(bags.rows).withColumn("mark", frequency.mark(F.col("records"), bags.n))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, sweep=True)
    return near_dup.near_duplicates(near_dup.article_texts(table(spark, d, "articles"), scratch), scratch, stop_list(table(spark, d, "stop_words")))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = leak.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents with leaks, their items and what is left of the text."""
    documents = table(spark, d, "documents")
    found = Scratch(spark).keep(leak.leaks(documents, table(spark, d, "eval_items")))
    return leak.clean(documents, found)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    found = pii.personal_information(table(spark, d, "documents"), table(spark, d, "name_list"))
    return found.select("doc_id", F.explode("kinds").alias("kind")).distinct()


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts that hold personal information, with placeholders in its place."""
    return pii.personal_information(table(spark, d, "documents"), table(spark, d, "name_list")).select("doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p2_found, p3_found, p3_divergence, p4_found, p4_described, p5_found, p5_clean, p5_template, p6_found, p6_frequencies, p7_found, p8_ids, p9_found, p9_clean, p10_found, p10_redacted)
}
