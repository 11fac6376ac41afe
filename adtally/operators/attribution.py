"""Referral attribution of visits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def with_referrer(visits: DataFrame, known: DataFrame, output: str = "referrer_id") -> DataFrame:
    """Adds the referrer of each visit.

    A requested id counts only if it is ``known`` (one ``id`` per row) and gives null
    otherwise, without a look at the cookie. Without a request the cookie's id counts.

    Most visits request none. They have nothing to find, so their key is a text of their own
    that is no id, and they are dealt out evenly. One id that a large part of all visits
    requests makes a large partition of the join, which Spark splits.
    """
    requested = F.when(F.col("ref_id") != 0, F.col("ref_id"))
    key = F.coalesce(requested.cast("string"), F.concat(F.lit("visit "), F.col("visit_id").cast("string")))
    keyed = visits.withColumns({"_requested": requested, "_key": key})
    ids = known.select(F.col("id").cast("string").alias("_key"), F.col("id").alias("_known"))
    joined = keyed.join(ids, "_key", "left")
    referrer = F.when(F.col("_requested").isNotNull(), F.col("_known")).otherwise(F.col("cookie_ref_id"))
    return joined.withColumn(output, referrer).drop("_requested", "_key", "_known")
