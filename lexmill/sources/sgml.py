"""SGML news files: lines, articles and their text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADER = '<!DOCTYPE lewis SYSTEM "lewis.dtd">'
#: Lines of a file that one task orders at a time; longer files are joined from block summaries.
BLOCK = 100_000


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, line_no, line)`` of text files; a closing line feed makes no line of its own."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", F.posexplode(F.split(F.regexp_replace("value", "\r?\n$", ""), "\r?\n")).alias("line_no", "line"))


def check_header(lines: DataFrame) -> DataFrame:
    """The lines; fails when a file's first line is not the header."""
    bad = (F.col("line_no") == 0) & (F.coalesce(F.col("line"), F.lit("")) != HEADER)
    return lines.withColumn("line", F.when(bad, F.raise_error(F.concat(F.lit("no header in "), F.col("path")))).otherwise(F.col("line")))


def newest_lines(lines: DataFrame) -> DataFrame:
    """One row per (path, line_no): of lines loaded again the latest."""
    return lines.groupBy("path", "line_no").agg(F.max_by("line", F.coalesce("ingested_at", F.lit("1970-01-01").cast("timestamp"))).alias("line"))


def _running(rows: DataFrame, value: Column, name: str, how: str, block: int) -> DataFrame:
    """``rows`` with the running sum or maximum of ``value`` over the lines of a file before and up to each. Blocks of
    lines are ordered by separate tasks; what comes before a block is a running value over the file's few blocks."""
    total = {"sum": F.sum, "max": F.max}[how]
    rows = rows.withColumn("_block", F.floor(F.col("line_no") / block)).withColumn("_v", value)
    inside = Window.partitionBy("path", "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("path", "_block").agg(total("_v").alias("_t")).select("path", "_block", total("_t").over(before).alias("_before"))
    joined = rows.withColumn("_inside", total("_v").over(inside)).join(blocks, ["path", "_block"])
    value = F.coalesce("_inside", F.lit(0)) + F.coalesce("_before", F.lit(0)) if how == "sum" else F.greatest("_inside", "_before")
    return joined.withColumn(name, value).drop("_block", "_v", "_inside", "_before")


def articles(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(path, article, line_no, line)``: the lines of each article, from the last line that begins with ``<REUTERS ``
    to the one that begins with ``</REUTERS>``; ``article`` counts closing lines from 0 within the file. A closing line
    without an opening one ends nothing, an article that is not closed is left out, null lines are empty."""
    line = F.coalesce(F.col("line"), F.lit(""))
    closes = F.when(line.startswith("</REUTERS>"), 1).otherwise(0)
    counted = _running(lines.select("path", "line_no", line.alias("line")), closes, "_closed", "sum", block)
    numbered = counted.withColumn("article", (F.col("_closed") - closes).cast("long")).drop("_closed")
    opens = F.when(F.col("line").startswith("<REUTERS "), F.col("line_no"))
    ends = F.when(F.col("line").startswith("</REUTERS>"), F.col("line_no"))
    spans = numbered.groupBy("path", "article").agg(F.max(opens).alias("_from"), F.max(ends).alias("_to")).where("_from is not null and _to is not null")
    return numbered.join(spans, ["path", "article"]).where("line_no between _from and _to").drop("_from", "_to")


def text_lines(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(path, article, line_no, line)``: the lines inside the text element. A line that begins with ``<TEXT`` turns it on,
    one that contains ``</TEXT>`` off, in this order of tests; both are dropped."""
    rows = articles(lines, block)
    line = F.col("line")
    mark = F.when(line.startswith("<REUTERS "), 0).when(line.startswith("<TEXT"), 1).when(line.contains("</TEXT>"), 0)
    marked = _running(rows, F.when(mark.isNotNull(), F.struct(F.col("line_no").alias("at"), mark.alias("on"))), "_mark", "max", block)
    inside = (F.col("_mark.on") == 1) & (F.col("_mark.at") != F.col("line_no"))
    return marked.where(inside).select("path", "article", "line_no", "line")


def document_ids(lines: DataFrame, order: list[str] | None = None) -> DataFrame:
    """``(path, article, doc_id)``: ids from 1 on over the files in their order, by name unless one is given. A file's
    articles are counted by Spark; only the offsets of files are a running sum, over one row per file."""
    kept = articles(lines).where(F.col("line").startswith("</REUTERS>")).select("path", "article")
    counts = kept.groupBy("path").agg((F.max("article") + 1).alias("n"))
    place = F.array_position(F.lit(order), F.col("path")) if order else F.col("path")
    offsets = counts.select("path", F.coalesce(F.sum("n").over(Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    return kept.join(F.broadcast(offsets), "path").select("path", "article", (F.col("article") + F.col("offset") + 1).alias("doc_id"))
