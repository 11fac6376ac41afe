"""Extra details of the sites on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtally.sources.tables import SellTables

NEWS, USER = "news", "user"


def _theme_figures() -> list[Column]:
    is_news, is_user = F.col("family") == NEWS, F.col("family") == USER
    is_open = ~F.col("is_filtered")
    return [
        F.count_if(is_news & is_open).alias("news_themes_not_filtered"),
        F.count_if(is_news).alias("news_themes_total"),
        F.count_if(is_user & is_open).alias("user_themes_not_filtered"),
        F.count_if(is_user).alias("user_themes_total"),
    ]


def theme_counts(site_themes: DataFrame) -> DataFrame:
    """Themes per site in both families: all of them and those not filtered out."""
    return site_themes.groupBy("site_id").agg(*_theme_figures())


def blocked_buyer_counts(blocked_buyers: DataFrame) -> DataFrame:
    """Different blocked buyers per site; pairs are made distinct before they are counted."""
    return blocked_buyers.groupBy("site_id").agg(
        F.count_distinct("buyer_id").alias("filtered_buyers")
    )


def with_panel(page: DataFrame, tables: SellTables) -> DataFrame:
    """The page with rating, price and buyer targets, theme counts and blocked buyers.

    ``page`` has a row for each site, and only sites of the dimension, as pages of the report do; others would be left
    out. The three relations are put together and meet the page once, which is broadcast if it is as short as pages are. So
    they are narrowed to its sites before anything is counted, and the page is worked out only once.
    """
    details = tables.sites.select(F.col("id").alias("of_site"), "min_teaser_rating", "min_ad_price", "buyer_target")
    themes = tables.site_themes.select(F.col("site_id").alias("of_site"), "family", "is_filtered")
    buyers = tables.blocked_buyers.select(F.col("site_id").alias("of_site"), "buyer_id")
    relations = details.unionByName(themes, allowMissingColumns=True).unionByName(buyers, allowMissingColumns=True)
    shown = page if "site_id" in page.columns else page.withColumn("site_id", F.col("id"))
    names = ["site_id"] + [name for name in shown.columns if name != "site_id"]
    # An empty list of targets counts as no list.
    targets = F.nullif(F.size("buyer_target"), F.lit(0))
    return (
        relations.join(shown, F.col("of_site") == F.col("site_id"))
        .groupBy(*names)
        .agg(
            F.any_value("min_teaser_rating", True).alias("min_teaser_rating"),
            F.any_value("min_ad_price", True).alias("min_ad_price"),
            F.any_value(targets, True).alias("buyer_target"),
            *_theme_figures(),
            F.count_distinct("buyer_id").alias("filtered_buyers"),
        )
    )
