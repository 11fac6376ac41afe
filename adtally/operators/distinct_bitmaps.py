"""Different members of a site over any days, from bitmaps that are kept by site and day.

A bitmap covers 32,768 neighbouring ids and has a bit for each of them that occurs, 4 KB. Bitmaps of the days of a window are
merged bit by bit, so nothing is counted twice and no day is read again as facts. Rows are put into bitmaps, and bitmaps of a
site are merged, inside the tasks that read them, so a site with very many rows sends a bitmap from each task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtally.operators.periods import Window
from adtally.operators.window_sums import in_window


def daily_bitmaps(rows: DataFrame, key: str = "site_id", day: str = "day", member: str = "buyer_id") -> DataFrame:
    """(key, day, bucket, bits) from rows of one member each; whole ids of any sign. Rows that lack one of the three are left out."""
    known = rows.select(F.col(key), F.col(day).alias("day"), F.col(member).cast("long").alias("member")).dropna()
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("member")).alias("bits")
    return known.groupBy(key, "day", F.bitmap_bucket_number("member").alias("bucket")).agg(bits)


def with_day(bitmaps: DataFrame, rows: DataFrame, key: str = "site_id", day: str = "day", member: str = "buyer_id") -> DataFrame:
    """Stored bitmaps with more rows merged in, of new days or of old ones; merging rows again changes nothing."""
    both = bitmaps.unionByName(daily_bitmaps(rows, key, day, member))
    return both.groupBy(key, "day", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_in(bitmaps: DataFrame, window: Window, key: str = "site_id", count: str = "members") -> DataFrame:
    """(key, count): the number of different members in the days of the window, for each key that has one."""
    chosen = bitmaps.where(in_window("day", window))
    merged = chosen.groupBy(key, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(key).agg(F.sum(F.bitmap_count("bits")).alias(count))
