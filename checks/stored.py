"""Queries that run jobs while they are built, as they store rows or walk a tree in rounds, and their SQL.

The others, in :mod:`checks.queries`, start no job before their rows are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adtally.operators import managers
from adtally.plans.sell_report import SellReport
from adtally.session import new_folder
from adtally.sources import synthetic
from checks import oracles
from checks.queries import Query, month_report, plain


def _manager_group_deep(spark: SparkSession, root: str) -> DataFrame:
    """Customers below one of them in a tree that is as deep as two thirds of their number."""
    people = synthetic.raw(spark, root, "customer").selectExpr("c_custkey AS id", "c_custkey AS group_id")
    groups = people.selectExpr("group_id", "group_id - IF(group_id % 3 = 0, 1, 2) AS parent_id")
    return managers.managers_of_group(people, groups, 50, deep=True)


def _sell_page_stored(spark: SparkSession, root: str) -> DataFrame:
    """The page of ``sell_page`` from the stored rows of the report."""
    folder = new_folder(spark, "pages")
    month_report(spark, root).store_pages(folder, "profit", True)
    return plain(SellReport.stored_page(spark, folder, 2, 50, True))


def queries() -> dict[str, Query]:
    return {"manager_group_deep": _manager_group_deep, "sell_page_stored": _sell_page_stored}


def oracle_sql() -> dict[str, str]:
    return {
        "manager_group_deep": """WITH RECURSIVE below AS (SELECT 50::BIGINT AS group_id
    UNION ALL SELECT c_custkey FROM below JOIN customer ON c_custkey - CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END = group_id)
SELECT group_id AS manager_id FROM below JOIN customer ON c_custkey = group_id""",
        "sell_page_stored": oracles.oracle_sql()["sell_page"],
    }
