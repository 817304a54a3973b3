"""Written stages in the folder that driver and executors share."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that a task of ranged() sorts, and rows of a file that it reads; a task reads 32 files at most, as Spark counts each as 4 MB more.
ROWS, FILE_ROWS = 200_000, 100_000
#: Whether Spark removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A local session without one gets its own folder; on a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: nothing reads them again, and they would lie there until the driver collects garbage."""
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, was)


def keep(df: DataFrame, name: str, *by: str, most: int = 0) -> DataFrame:
    """Write a stage as Parquet and read it back, optionally in folders by columns and in files of at most so many rows: lineage ends here, and Spark knows its size."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_go(df.sparkSession):
        writer = df.write.option("maxRecordsPerFile", most)
        writer.partitionBy(*by).parquet(path) if by else writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows anew if they come in fewer splits than there are cores, as from one small file; larger tables are left where they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ranged(rows: DataFrame, *order: str) -> DataFrame:
    """rows, dealt over tasks by ranges of about ROWS rows in this order and sorted there; tasks are numbered in the same order.

    They are written first: splits go by packed bytes, and what packs well would come to one task by millions of rows.
    """
    return sorted_ranges(keep(rows, "unsorted", most=FILE_ROWS), *order)


def sorted_ranges(rows: DataFrame, *order: str) -> DataFrame:
    """As ranged(), of rows that are written in files of FILE_ROWS, or a plain projection of such."""
    return rows.repartitionByRange(1 + rows.count() // ROWS, *order).sortWithinPartitions(*order)


def met(rows: DataFrame, values: DataFrame, *by: str) -> DataFrame:
    """rows with the values of their key, where nulls are a key too; values hold each key of rows once."""
    values = values.withColumnsRenamed({c: f"_by_{c}" for c in by})
    return rows.join(values, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by))).drop(*(f"_by_{c}" for c in by))


def numbered(rows: DataFrame, by: str, order: list[str], number: str, total: str = "_total") -> DataFrame:
    """A written stage: rows with their number (long, from 1) in this order among those of their group, and how many these are.

    Rows are ranged over tasks by group and order, numbered there, and lifted by what the tasks before hold, so a group may be of any size.
    """
    parts = keep(ranged(rows, by, *order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")
    held = parts.groupBy(by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(by).orderBy("_part")) - F.col("_n")
    held = keep(held.select(by, "_part", (before + 1 - F.col("_first")).alias("_lift"), F.sum("_n").over(W.partitionBy(by)).alias(total)), "ranges-held")
    return keep(met(parts, held, by, "_part").withColumn(number, F.col("_at") + F.col("_lift")).drop("_part", "_at", "_lift"), "numbered")
