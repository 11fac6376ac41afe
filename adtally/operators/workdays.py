"""Calendar columns: weekends with exceptions, and the months facts exist for."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_weekend_flag(df: DataFrame, day_column: str, custom_workdays: DataFrame) -> DataFrame:
    """Adds ``is_weekend`` (0 or 1): a listed day decides, else Saturday and Sunday are weekend."""
    listed = custom_workdays.select(F.col("day").alias(day_column), "is_workday")
    sunday, saturday = 1, 7
    by_weekday = F.dayofweek(day_column).isin(sunday, saturday).cast("int")
    flag = F.when(F.col("is_workday").isNotNull(), (~F.col("is_workday")).cast("int"))
    return (
        df.join(listed, day_column, "left")
        .withColumn("is_weekend", flag.otherwise(by_weekday))
        .drop("is_workday")
    )


def available_months(day_facts: DataFrame, day_column: str, as_of: datetime) -> DataFrame:
    """First days of the months that have facts; the month of ``as_of`` if there are none.

    One pass over the day column, which on facts stored by day is in the partition names.
    """
    this_month = F.array(F.struct(F.lit(as_of.date().replace(day=1)).alias("period")))
    months = day_facts.agg(F.collect_set(F.struct(F.trunc(day_column, "MM").alias("period"))).alias("months"))
    listed = F.when(F.size("months") > 0, F.col("months")).otherwise(this_month)
    return months.select(F.explode(listed).alias("month")).select("month.period")
