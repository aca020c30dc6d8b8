"""Queries of the engine's own operators: name to a function of the session and the tables' folder.

The corpus is the table ``documents``; all its rows count as documents, those without text as empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import codec, regex, search, text
from lexmill.functions.stem import stem
from lexmill.operators import cluster, index, pairs, vector_model as vsm
from lexmill.sources import index_files, sgml
from lexmill.sources.tables import Scratch, table

AND_QUERY, RANKED_QUERY = "market october", "market october wheat"
PATTERN, APPROXIMATE, ERRORS, REGEX = "ana", "market", 2, "oil|gas*|coffee"
STEMMED_QUERY = "harvested markets"
CLUSTERS = 5


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(_docs(spark, d))


def _model(spark: SparkSession, d: str) -> DataFrame:
    docs, scratch = _docs(spark, d), Scratch(spark)
    rows, n = scratch.keep(index.postings(docs)), docs.count()
    return vsm.vector_model(rows, n, stats=scratch.keep(index.document_frequencies(rows, n)))


def _panels(spark: SparkSession, d: str) -> list[list[str]]:
    """The model packed for all pairs of documents; its tables are dropped once that is written."""
    docs, scratch = _docs(spark, d), Scratch(spark, sweep=True)
    rows, n = scratch.keep(index.postings(docs)), docs.count()
    stats = scratch.keep(index.document_frequencies(rows, n).withColumn("id", F.monotonically_increasing_id()))
    packed = pairs.packed_postings(rows, stats, n, scratch)
    scratch.drop(rows, stats)
    return packed


def _ranked(spark: SparkSession, d: str, words: list[str]) -> DataFrame:
    """The ranked query: term statistics are those of all documents, vectors are made only of the documents with a hit."""
    docs = _docs(spark, d)
    n, query = docs.count(), index.query_table(spark, words)
    stats = Scratch(spark).keep(index.document_frequencies(index.postings(docs), n))
    hits = docs.where(F.arrays_overlap(text.terms(F.col("text")), F.lit([w for w in words if w] or [""])))
    return vsm.ranked(vsm.scores(vsm.vector_model(index.postings(hits), n, stats=stats), query, docs))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Binary term weights over the number of the document's terms, which needs no other document."""
    rows = _docs(spark, d).select("doc_id", F.array_distinct(text.terms(F.col("text"))).alias("terms"))
    flat = rows.select("doc_id", (1 / F.size("terms")).alias("v"), F.explode_outer("terms").alias("term"))
    return flat.where("term is not null").select("doc_id", "term", "v")


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.normalize(F.col("text")).alias("normalized"))


def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    whole = F.coalesce("text", F.lit(""))
    words, terms = text.words(whole), text.terms(whole)
    return _docs(spark, d).select("doc_id", F.size(words).alias("n_words"), F.size(terms).alias("n_terms"))


def stopword_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = index.tokens(_docs(spark, d), table(spark, d, "stop_words"))
    return kept.groupBy("word").agg(F.count("*").alias("n"))


def process_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles normalised line by line, without stop words, stemmed; of repeated ones the newest row with text lines. All
    of them, also those without a stored ``processed_text``, which SQL can't stem."""
    stop = text.stop_list(table(spark, d, "stop_words"))
    newest = F.max(F.struct(F.coalesce("ingested_at", F.lit("1970-01-01").cast("timestamp")), "text_lines"))["text_lines"].alias("text_lines")
    rows = table(spark, d, "articles").where("text_lines is not null").groupBy("doc_id").agg(newest)
    return rows.select("doc_id", text.process_text(F.col("text_lines"), stop).alias("processed"))


def process_articles_stored(spark: SparkSession, d: str) -> DataFrame:
    """Of ``process_articles`` the texts of articles that have a stored one, too: SQL can tell what they should be."""
    stored = table(spark, d, "articles").where("text_lines is not null and processed_text is not null").select("doc_id").distinct()
    return process_articles(spark, d).join(stored, "doc_id", "left_semi")


def processed_words(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "articles").where("processed_text is not null").dropDuplicates(["doc_id"])
    return rows.select("doc_id", F.array_join(text.processed_words(F.col("processed_text")), " ").alias("words"))


def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return index.term_counts(index.tokens(_docs(spark, d)))


def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    nested = index.inverted_index(_postings(spark, d))
    return nested.select("term", index_files.index_line(F.col("term"), F.col("doc_ids")).alias("line"))


def document_frequency_idf(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return index.document_frequencies(index.postings(docs), docs.count()).select("term", "df", F.round("idf", 9).alias("idf"))


def vector_model(spark: SparkSession, d: str) -> DataFrame:
    six = [F.round(c, 9).alias(c) for c in ("weight", "norm_tf", "norm_weight")]
    return _model(spark, d).select("doc_id", "term", *six)


def boolean_and_query(spark: SparkSession, d: str) -> DataFrame:
    return index.boolean_and(_postings(spark, d), AND_QUERY.split(" "))


def ranked_query_top10(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, RANKED_QUERY.split(" "))


def most_similar_document(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(-1).cast("long")
    found = vsm.report(pairs.most_similar(_panels(spark, d), spark, digits=12), _docs(spark, d))
    return found.select("doc_id", *(F.coalesce(c, none).alias(c) if c.endswith("doc") else c for c in found.columns[1:]))


def similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.similarities(_panels(spark, d), spark, tf_digits=12, tfidf_digits=6)


def _first_assignment(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs, scratch = _docs(spark, d), Scratch(spark)
    vectors = scratch.keep(_vectors(spark, d))
    return vectors, cluster.assign(vectors, scratch.keep(cluster.seed_centroids(vectors, cluster.seeds(docs, CLUSTERS))), docs)


def kmeans_assign_iter1(spark: SparkSession, d: str) -> DataFrame:
    return _first_assignment(spark, d)[1].select("doc_id", "cluster")


def kmeans_centroids_iter1(spark: SparkSession, d: str) -> DataFrame:
    return cluster.centroids(*_first_assignment(spark, d)).select("cluster", "term", F.round("c", 9).alias("c"))


def kmeans_quality_iter1(spark: SparkSession, d: str) -> DataFrame:
    vectors, assigned = _first_assignment(spark, d)
    scratch = Scratch(spark)
    kept = scratch.keep(assigned)
    return cluster.quality(vectors, kept, scratch.keep(cluster.centroids(vectors, kept)), CLUSTERS).select(F.round("quality", 9).alias("quality"))


def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    """k-means with ten clusters until nothing changes."""
    scratch = Scratch(spark)
    found = cluster.k_means(scratch.keep(_vectors(spark, d)), _docs(spark, d), scratch)
    return found.assigned.select("doc_id", "cluster")


def delta_encode(spark: SparkSession, d: str) -> DataFrame:
    nested = index.inverted_index(_postings(spark, d))
    return nested.select("term", F.array_join(codec.delta_encode(F.col("doc_ids")).cast("array<string>"), ",").alias("deltas"))


def delta_decode(spark: SparkSession, d: str) -> DataFrame:
    nested = index.inverted_index(_postings(spark, d))
    decoded = codec.delta_decode(codec.delta_encode(F.col("doc_ids")))
    return nested.select("term", F.array_join(decoded.cast("array<string>"), ",").alias("ids"))


def fibonacci_encode(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", codec.fibonacci_encode(F.col("doc_id") + 1).alias("code"))


def fibonacci_decode(spark: SparkSession, d: str) -> DataFrame:
    code = codec.fibonacci_encode(F.col("doc_id") * 1009 + 1)
    return _docs(spark, d).select("doc_id", codec.fibonacci_decode(code).alias("value"))


def compressed_index(spark: SparkSession, d: str) -> DataFrame:
    """The index through its compressed form and back: ids are coded from 1 on."""
    rows = _postings(spark, d).withColumn("doc_id", F.col("doc_id") + 1)
    records = index_files.compressed_records(index.inverted_index(rows))
    decoded = codec.decode_packed(F.col("codes"))
    return records.select("term", "n", F.array_join(decoded.cast("array<string>"), ",").alias("ids"))


def find_all_occurrences(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).where(F.contains("text", F.lit(PATTERN)))
    return rows.select("doc_id", F.array_join(search.find_all(F.col("text"), F.lit(PATTERN)).cast("array<string>"), ",").alias("places"))


def count_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", search.count_all(F.col("text"), F.lit(PATTERN)).alias("n"))


def approximate_match(spark: SparkSession, d: str) -> DataFrame:
    terms = _postings(spark, d).select("term").distinct()
    distance = search.approximate(F.lit(APPROXIMATE), F.col("term"), ERRORS)
    return terms.select("term", (distance >= 0).alias("accepted"), distance.alias("errors"))


def regex_match(spark: SparkSession, d: str) -> DataFrame:
    return _postings(spark, d).select("term").distinct().where(regex.matches(F.col("term"), REGEX))


def embedding_distance(spark: SparkSession, d: str) -> DataFrame:
    """Dot product and distance of each vector and the first one."""
    rows = table(spark, d, "embeddings")
    first = rows.where("vec_id = 0").first()
    a, b = F.col("embedding"), F.lit(list(first.embedding) if first else []).cast("array<double>")
    return rows.select("vec_id", F.round(cluster.array_dot(a, b), 6).alias("dot"), F.round(cluster.array_distance(a, b), 6).alias("distance"))


def sgml_articles(spark: SparkSession, d: str) -> DataFrame:
    found = sgml.articles(sgml.newest_lines(table(spark, d, "sgml_lines")))
    return found.groupBy("path", "article").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


def sgml_text_lines(spark: SparkSession, d: str) -> DataFrame:
    return sgml.text_lines(sgml.newest_lines(table(spark, d, "sgml_lines")))


def sgml_document_ids(spark: SparkSession, d: str) -> DataFrame:
    return sgml.document_ids(sgml.newest_lines(table(spark, d, "sgml_lines")))


def _article_postings(spark: SparkSession, d: str) -> DataFrame:
    """Stemmed postings of the articles: the terms of the newest stored ``processed_words``."""
    newest = F.max_by("processed_words", F.coalesce("ingested_at", F.lit("1970-01-01").cast("timestamp"))).alias("words")
    rows = table(spark, d, "articles").where("processed_words is not null").groupBy("doc_id").agg(newest)
    flat = index.exploded(rows, F.array_distinct("words"), "term")
    return flat.where(text.is_term(F.col("term"))).withColumn("tf", F.lit(1).cast("long"))


def article_boolean_query(spark: SparkSession, d: str) -> DataFrame:
    """Articles that hold all keywords; the query's words are stemmed as those of the articles are."""
    return index.boolean_and(_article_postings(spark, d), index.keywords(STEMMED_QUERY))


def article_ranked_query(spark: SparkSession, d: str) -> DataFrame:
    """The ten best articles for the stemmed keywords."""
    scratch, docs = Scratch(spark), table(spark, d, "articles").where("doc_id is not null").select("doc_id").distinct()
    rows, n = scratch.keep(_article_postings(spark, d)), docs.count()
    query = index.query_table(spark, index.keywords(STEMMED_QUERY))
    hits = rows.join(rows.join(F.broadcast(query.select("term").distinct()), "term", "left_semi").select("doc_id").distinct(), "doc_id", "left_semi")
    stats = scratch.keep(index.document_frequencies(rows, n))
    return vsm.ranked(vsm.scores(vsm.vector_model(hits, n, stats=stats), query, docs))


def text_index_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Postings written as an index file and read again."""
    path = f"{Scratch(spark).root}/index"
    index_files.write_index(index.inverted_index(_postings(spark, d)), path)
    return index_files.read_index(spark, path)


def similarity_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The documents' similarities both ways by the term weights."""
    return pairs.similarities(_panels(spark, d), spark, ordered=False, tf_digits=12, tfidf=False).withColumnRenamed("tf_sim", "sim")


def common_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of two terms' lists: the intersection of their ids."""
    lists = index.inverted_index(_postings(spark, d).where(F.col("term").isin(AND_QUERY.split(" "))))
    ids = lists.agg(*(F.max(F.when(F.col("term") == w, F.col("doc_ids"))).alias(w) for w in AND_QUERY.split(" ")))
    return ids.select(F.explode(index.contains_all(*(F.col(w) for w in AND_QUERY.split(" ")))).alias("doc_id"))


def stem_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return index.tokens(_docs(spark, d)).select("word").distinct().select("word", stem(F.col("word")).alias("stem"))


def stemmed_ranked_query(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    rows = index.postings(docs, table(spark, d, "stop_words"), stemmed=True)
    query = index.query_table(spark, index.keywords("declining wheat markets"))
    return vsm.ranked(vsm.scores(vsm.vector_model(rows, docs.count()), query, docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        normalize_text, tokenize_terms, stopword_filter, process_articles, process_articles_stored, processed_words, term_frequency, inverted_index,
        document_frequency_idf, vector_model, boolean_and_query, ranked_query_top10, most_similar_document, similarity_pairs,
        kmeans_assign_iter1, kmeans_centroids_iter1, kmeans_quality_iter1, kmeans_clusters, delta_encode, delta_decode,
        fibonacci_encode, fibonacci_decode, compressed_index, find_all_occurrences, count_occurrences, approximate_match,
        regex_match, embedding_distance, sgml_articles, sgml_text_lines, sgml_document_ids, stem_vocabulary, stemmed_ranked_query,
        article_boolean_query, article_ranked_query, text_index_round_trip, similarity_matrix, common_documents,
    )
}
