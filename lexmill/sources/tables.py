"""Reading tables, and tables kept between the steps of one operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share. Only where the session names none (tests,
    local mode) a temporary one, removed at exit."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a shared folder in spark.checkpoint.dir")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="lexmill-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return "file://" + _own


_own: str | None = None


#: Spark then removes the shuffle files of a query when it is over; else they stay until the driver happens to collect its garbage.
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive a lost executor. With ``sweep`` the shuffle files
    that a table was made from go as soon as it is written."""

    def __init__(self, spark: SparkSession, sweep: bool = False):
        self.spark, self.root, self.used, self.sweep = spark, f"{shared_folder(spark)}/lexmill-{uuid.uuid4().hex}", 0, sweep

    def keep(self, rows: DataFrame, partitions: int | None = None, most_rows: int = 0) -> DataFrame:
        """``most_rows``: of a file; 0 sets no bound."""
        self.used += 1
        path = f"{self.root}/{self.used}"
        before = self.spark.conf.get(_SWEEP, None)
        if self.sweep:
            self.spark.conf.set(_SWEEP, "true")
        try:
            (rows.coalesce(partitions) if partitions else rows).write.options(compression="zstd", maxRecordsPerFile=most_rows).parquet(path)
        finally:
            if self.sweep:
                self.spark.conf.unset(_SWEEP) if before is None else self.spark.conf.set(_SWEEP, before)
        kept = self.spark.read.schema(rows.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, *kept: DataFrame) -> None:
        """Delete kept tables that nothing reads any more."""
        for x in kept:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(x._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(rows: DataFrame, most_rows: int) -> DataFrame:
    """``rows`` with a broadcast hint if a count proves it to have at most ``most_rows``; else as it is, for
    Spark to shuffle. Give a kept table: its count comes from the file footers."""
    return F.broadcast(rows) if rows.count() <= most_rows else rows


def spread(rows: DataFrame, key: str) -> DataFrame:
    """A small kept table in as many parts as keep all cores busy, for steps that compute much for each row. A number
    is given, else Spark would join parts by their size."""
    spark = rows.sparkSession
    parts = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, key)


def without_hot_repeats(rows: DataFrame, key: str, most: int = 1_000_000) -> DataFrame:
    """``rows``; if repeats give one key more than ``most`` of them, without repeats, which Spark drops within each task
    before the shuffle. Only worth its second shuffle then, so a count of the key column decides; steps that
    follow drop repeats anyway, and their result is the same."""
    hot = rows.groupBy(key).count().where(F.col("count") > most).limit(1).count()
    return rows.distinct() if hot else rows
