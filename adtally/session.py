"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning does three jobs here: it picks a broadcast join only after it has
# seen the real size of a side, it splits skewed join partitions, and it merges small
# shuffle partitions. No dimension is broadcast by a hint.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Pages far into a report are sorted by ranges instead of being held in one task.
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark; on a cluster the job gets its session from outside."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("adtally")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # small files are read by all cores
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.files.openCostInBytes", "512k")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where it is unset, as in tests, one of the warehouse."""
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return (spark.conf.get("spark.checkpoint.dir", None) or f"{warehouse}/checkpoints").rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the shared folder, which all executors reach."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
