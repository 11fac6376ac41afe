"""Attributes of the reported sites, one row per site of the dimension.

They are put together before they meet the sums: user rows are looked up for these narrow
rows, so the wide rows of sums are joined once, on the key they are partitioned by already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

MARKS = ("source", "medium", "campaign", "ad")


def site_attributes(sites: DataFrame) -> DataFrame:
    return sites.selectExpr(
        "id AS site_id",
        "name AS site_name",
        "url AS site_url",
        "seller_id AS user_id",
        "country_id",
        "profit_type",
        "min_teaser_rating",
        "true AS site_known",
    )


def with_user_attributes(df: DataFrame, users: DataFrame) -> DataFrame:
    """Left join on ``user_id``: an unknown user leaves nulls."""
    attributes = users.selectExpr(
        "id AS user_id", "email", "subsystem_id", "is_exchanger", "is_disabled", "true AS user_known"
    )
    return df.join(attributes, "user_id", "left")

