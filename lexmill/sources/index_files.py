"""Index and document files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import codec


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """``(word)``, one per line."""
    return spark.read.text(path).select(F.col("value").alias("word")).where("word <> ''")


def index_line(term: Column, doc_ids: Column) -> Column:
    """``term:1,5,9,``"""
    return F.concat(term, F.lit(":"), F.array_join(F.transform(F.sort_array(doc_ids), lambda x: F.concat(x.cast("string"), F.lit(","))), ""))


def write_index(index: DataFrame, path: str) -> None:
    """Lines in byte order of the terms, in files that follow each other."""
    index.orderBy("term").select(index_line(F.col("term"), F.col("doc_ids")).alias("value")).write.mode("overwrite").text(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, term, tf)``: postings of index lines, each with tf 1; empty parts between commas are skipped."""
    lines = spark.read.text(path).where(F.contains("value", F.lit(":")))
    term = F.substring_index("value", ":", 1)
    ids = F.filter(F.split(F.expr("substr(value, instr(value, ':') + 1)"), ","), lambda x: x != "")
    rows = lines.select(term.alias("term"), F.explode(ids).alias("id"))
    return rows.select(F.col("id").cast("long").alias("doc_id"), "term", F.lit(1).cast("long").alias("tf"))


def compressed_records(index: DataFrame) -> DataFrame:
    """``(term, n, codes)``: the number of ids and the packed Fibonacci codes of their deltas. Ids must be from 1 on."""
    return index.select("term", F.size("doc_ids").alias("n"), codec.encode_packed(F.sort_array("doc_ids")).alias("codes"))


def write_compressed(index: DataFrame, path: str) -> None:
    """One file, as the format asks for: of each term its length, bytes, number of ids and codes (whole bytes), then a
    zero. Rows are streamed through the driver in byte order of the terms; tables use ``compressed_records``."""
    with open(path, "wb") as out:
        for r in compressed_records(index).orderBy("term").toLocalIterator(prefetchPartitions=True):
            name = r.term.encode()
            out.write(struct.pack("<I", len(name)) + name + struct.pack("<II", r.n, len(r.codes)) + bytes(r.codes))
        out.write(struct.pack("<I", 0))


def read_compressed(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, term, tf)`` of files that ``write_compressed`` wrote, one task per file; an empty index gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data, at = content.as_py(), 0
                rows: list[tuple[str, int, bytes]] = []
                while size := struct.unpack_from("<I", data, at)[0]:
                    name = data[at + 4 : at + 4 + size].decode()
                    n, length = struct.unpack_from("<II", data, at + 4 + size)
                    at += 12 + size + length
                    rows.append((name, n, data[at - length : at]))
                names, counts, codes = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int32()), pa.array(codes, pa.binary())], ["term", "n", "codes"])

    records = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "term string, n int, codes binary")
    return records.select(F.explode(codec.decode_packed(F.col("codes"))).alias("doc_id"), "term", F.lit(1).cast("long").alias("tf"))


def write_processed(docs: DataFrame, path: str) -> None:
    """``DocId:<id>`` and the processed text of each document, by id."""
    docs.orderBy("doc_id").select(F.concat(F.lit("DocId:"), F.col("doc_id").cast("string"), F.lit("\n"), F.col("processed_text")).alias("value")).write.mode("overwrite").text(path)


def article_block(lines: Column) -> Column:
    """The filtered lines of an article between its two rulers."""
    return F.concat(F.lit("\n-------- ARTICLE --------\n"), F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), F.lit("------- END OF ARTICLE -----\n"))


def write_article_blocks(articles: DataFrame, path: str) -> None:
    """The blocks of ``articles (doc_id, lines)``, by id, in files that follow each other."""
    block = F.regexp_replace(article_block(F.col("lines")), "\n$", "")  # the sink ends each row with a line feed
    articles.orderBy("doc_id").select(block.alias("value")).write.mode("overwrite").text(path)


def write_similarities(report: DataFrame, path: str) -> None:
    """``Document;TF_MostSimilar;TF_Sim;TF_IDF_MostSimilar;TF_IDF_Sim``, values with six significant digits."""
    six = lambda c: F.format_string("%.6g", F.col(c))
    report.select(
        F.col("doc_id").alias("Document"), F.col("tf_doc").alias("TF_MostSimilar"), six("tf_sim").alias("TF_Sim"),
        F.col("tfidf_doc").alias("TF_IDF_MostSimilar"), six("tfidf_sim").alias("TF_IDF_Sim"),
    ).write.mode("overwrite").csv(path, sep=";", header=True)
