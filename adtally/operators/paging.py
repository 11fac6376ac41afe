"""Ordering and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordering(column: str, descending: bool) -> Column:
    """Nulls last when ascending and first when descending."""
    key = F.col(column)
    return key.desc_nulls_first() if descending else key.asc_nulls_last()


def page_of(
    df: DataFrame,
    order: str,
    descending: bool = False,
    page: int = 1,
    items: int = 50,
    tie_break: str = "id",
) -> DataFrame:
    """One page of ``df``. Pages before the first show the first; ``items`` <= 0 is no limit.

    A limited page plans as a top-k: every task keeps at most ``page * items`` rows and no
    full sort takes place. Without a limit the sort is range-partitioned.
    """
    ordered = df.orderBy(ordering(order, descending), F.col(tie_break).asc_nulls_last())
    if items <= 0:
        return ordered
    return ordered.offset(max(page - 1, 0) * items).limit(items)


def first_per_group(df: DataFrame, group: str, order: list[Column], items: int) -> DataFrame:
    """The first ``items`` rows of every group, with their ``position``.

    The filter on the position lets Spark cut each group to ``items`` rows inside every
    task before the shuffle, so a group with most of the rows does not fill one task.
    """
    window = Window.partitionBy(group).orderBy(*order)
    numbered = df.withColumn("position", F.row_number().over(window))
    return numbered.where(F.col("position") <= items)


def page_count(rows: Column, items: int) -> Column:
    return F.ceil(rows / F.lit(items)).cast("long")
