"""Logical tables of the library and how to read them from a lake."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_COUNTERS = "src_shows long, src_clicks long, buy_shows long, buy_clicks long, block_shows long"
_MONEY = (
    "profit decimal(16,4), buyers_expense decimal(16,4), "
    "parent_profit decimal(16,4), agent_profit decimal(16,4)"
)

SCHEMAS = {
    "day_sell": f"site_id long, day date, {_COUNTERS}, block_shows_empty long, {_MONEY}",
    "hour_sell": f"site_id long, hour timestamp_ntz, {_COUNTERS}, {_MONEY}",
    "sites": (
        "id long, name string, url string, seller_id long, country_id int, profit_type string, "
        "min_teaser_rating int, min_ad_price decimal(16,4), buyer_target array<long>"
    ),
    "users": "id long, email string, subsystem_id int, is_exchanger boolean, is_disabled boolean",
    "user_marks": "user_id long, source string, medium string, campaign string, ad string",
    "user_managers": "user_id long, manager_id long",
    "managers": "id long, group_id int",
    "manager_groups": "group_id int, parent_id int",
    "site_categories": "site_id long, category_id string",
    "site_themes": "site_id long, family string, theme_id string, is_filtered boolean",
    "blocked_buyers": "site_id long, buyer_id long",
    "custom_workdays": "day date, is_workday boolean",
    "exchange_daily": (
        "user_id long, date date, src_shows long, src_clicks long, buy_shows long, "
        "buy_clicks long, in_shows long, in_clicks long, debt long, tier_ratio double, "
        "calc_exchange_ratio double"
    ),
    "accounts": (
        "id long, user_type string, email string, subsystem string, site string, src_id string, "
        "country string, webmoney string, crm_status string, source string, campaign string, "
        "medium string, ad string, manager_id long, balance decimal(16,4)"
    ),
    "visits": "visit_id long, ref_id long, cookie_ref_id long",
    "access_log": (
        "remote_addr string, forwarded_for string, is_trusted_proxy boolean, request_uri string"
    ),
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read a logical table stored as parquet under ``root``.

    The schema is declared, so no file is opened to infer it. Facts are expected to be
    partitioned by day, which turns a period into partition pruning.
    """
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def write_day_partitioned(df: DataFrame, path: str, day_column: str) -> None:
    """Store a fact partitioned by day, in few files per day.

    Rows are gathered by day at run time: a day with many rows is split over several tasks
    and small days share one, so neither a hot day nor the number of files gets out of hand.
    """
    by_day = df.hint("rebalance", day_column)
    by_day.write.mode("overwrite").partitionBy(day_column).parquet(path)


@dataclass(frozen=True)
class SellTables:
    """Inputs of the sales report; only those a report really uses have to be given.

    With ``cumulative_sell`` (see :mod:`adtally.operators.cumulative`) a report of whole days reads running totals instead of facts.
    """

    day_sell: DataFrame
    sites: DataFrame
    users: DataFrame
    hour_sell: DataFrame | None = None
    user_marks: DataFrame | None = None
    user_managers: DataFrame | None = None
    site_categories: DataFrame | None = None
    site_themes: DataFrame | None = None
    blocked_buyers: DataFrame | None = None
    cumulative_sell: DataFrame | None = None
