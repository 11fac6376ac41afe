"""Hourly facts that arrive in batches, late, in any order, and sometimes twice.

A batch is a set of hourly rows under one ``batch_id``. The state keeps the sums of each batch by site and hour, so the batches
that are in it are known, and merging one of them again changes nothing. Batches only ever add rows to the state: one that is a
day late costs what any other costs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adtally.operators.window_sums import COMPARED, MONEY

KEYS = ("batch_id", "site_id", "hour")
STATE = (
    "batch_id string, site_id long, hour timestamp_ntz, "
    + ", ".join(f"{name} {'decimal(28,4)' if name in MONEY else 'long'}" for name in COMPARED)
)


def once(deliveries: DataFrame) -> DataFrame:
    """Rows of the first delivery of each batch.

    ``deliveries`` has batch_id, delivery (a number of the arrival), site_id, hour and the measures. The first deliveries are a frame of one
    row for each batch, added up inside the input tasks; the rows of a large batch are not gathered. Rows without batch_id have no
    identity and are left out.
    """
    first = deliveries.where("batch_id IS NOT NULL").groupBy("batch_id").agg(F.min("delivery").alias("delivery"))
    return deliveries.join(first, ["batch_id", "delivery"], "left_semi")


def batch_sums(rows: DataFrame) -> DataFrame:
    """Sums of the measures by batch, site and hour, the rows of the state."""
    sums = (F.coalesce(F.sum(name), F.lit(0)).cast("decimal(28,4)" if name in MONEY else "long").alias(name) for name in COMPARED)
    return rows.groupBy(*KEYS).agg(*sums)


def new_rows(state: DataFrame, deliveries: DataFrame) -> DataFrame:
    """What ``deliveries`` add to the state: the sums of batches that are not in it."""
    known = state.select("batch_id").distinct()
    return batch_sums(once(deliveries).join(known, "batch_id", "left_anti"))


def merged(state: DataFrame, deliveries: DataFrame) -> DataFrame:
    return state.unionByName(new_rows(state, deliveries).select(*state.columns))


def hour_facts(state: DataFrame) -> DataFrame:
    """The state as hourly facts of the sales report, one row for each site and hour."""
    money = {name: F.sum(name).cast("decimal(18,4)").alias(name) for name in MONEY}
    return state.groupBy("site_id", "hour").agg(*(money.get(name, F.sum(name).alias(name)) for name in COMPARED))


def append(spark: SparkSession, state_folder: str, deliveries: DataFrame) -> None:
    """Add batches to a state stored by day; a run that is repeated after a failure adds nothing twice.

    Rows of a batch are written in one job, and Spark shows its files only when all of them are there.
    """
    new = new_rows(read(spark, state_folder), deliveries)
    new.withColumn("day", F.col("hour").cast("date")).write.mode("append").partitionBy("day").parquet(state_folder)


def read(spark: SparkSession, state_folder: str) -> DataFrame:
    """The stored state; a period's hours are read from its days only. A folder that is not there yet is an empty state."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state_folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{STATE}, day date")
    return spark.read.schema(f"{STATE}, day date").parquet(state_folder)


def follow(spark: SparkSession, deliveries: DataFrame, state_folder: str, checkpoint: str):
    """A stream of deliveries into the stored state. What a restart repeats is in the state by then and counts once."""

    def add(rows: DataFrame, _: int) -> None:
        append(spark, state_folder, rows)

    return deliveries.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
