"""Pages of a stored report: rows sorted by ranges, and beside them how many rows each range has.

A page far into a report need not sort the rows before it: the counts tell in which ranges its rows lie, one or two of
them unless a page is larger than a range, and only the files of those are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adtally.operators.paging import ordering, page_of

RANGE = "page_range"


def _order(order: str, descending: bool, tie_break: str) -> list[Column]:
    return [ordering(order, descending), F.col(tie_break).asc_nulls_last()]


def write(rows: DataFrame, folder: str, order: str, descending: bool = False, ranges: int | None = None, tie_break: str = "id") -> None:
    """Store ``rows`` below ``folder`` in the order of ``page_of``, in at most ``ranges`` ranges.

    Without a number there are as many ranges as shuffle partitions. Rows of one value are divided by ``tie_break``, so a value that a third of
    the rows have fills no range alone. What was in the folder before is replaced.
    """
    spark, by = rows.sparkSession, _order(order, descending, tie_break)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, *by).withColumn(RANGE, F.spark_partition_id())
    dealt.sortWithinPartitions(RANGE, *by).write.mode("overwrite").partitionBy(RANGE).parquet(f"{folder}/rows")
    # a partitioned table without rows has no file that tells its columns
    spark.createDataFrame([], dealt.schema).write.mode("overwrite").parquet(f"{folder}/columns")
    _counts(_rows(spark, folder)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/ranges")


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{folder}/columns").schema).parquet(f"{folder}/rows")


def _counts(rows: DataFrame) -> DataFrame:
    """(page_range, before, rows): rows of each range and of all ranges before it; there is a row for each range."""
    counts = rows.groupBy(RANGE).agg(F.count("*").alias("rows"))
    so_far = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(RANGE, F.coalesce(F.sum("rows").over(so_far), F.lit(0)).cast("long").alias("before"), "rows")


def read(
    spark: SparkSession, folder: str, order: str, descending: bool = False, page: int = 1, items: int = 50, tie_break: str = "id"
) -> DataFrame:
    """The page that ``page_of`` gives for the rows, order and direction that ``write`` was given.

    One row is read to the driver: the first and last range of the page, and the rows before them.
    """
    rows = _rows(spark, folder)
    if items <= 0:
        return page_of(rows, order, descending, page, items, tie_break).drop(RANGE)
    first = max(page - 1, 0) * items
    ranges = spark.read.parquet(f"{folder}/ranges").where((F.col("before") < first + items) & (F.col("before") + F.col("rows") > first))
    low, high, before = ranges.agg(F.min(RANGE), F.max(RANGE), F.min("before")).first()
    if low is None:
        return rows.where("false").drop(RANGE)
    near = rows.where(F.col(RANGE).between(low, high)).orderBy(*_order(order, descending, tie_break))
    return near.offset(first - before).limit(items).drop(RANGE)


def count(spark: SparkSession, folder: str) -> DataFrame:
    """``rows``: how many rows are stored, from the counts alone."""
    return spark.read.parquet(f"{folder}/ranges").agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("rows"))
