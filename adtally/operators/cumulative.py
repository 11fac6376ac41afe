"""Sums of any window from running totals: a window is the difference of two days.

The cumulative table has, for each day, a row for every site seen so far with the totals of all its day rows up to that day. It is
stored by day and appended to: the next day is the day before plus the new facts. A report reads the days at the edges of
its windows, three or four of them, however long the windows are.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from adtally.functions.metrics import stored
from adtally.operators.periods import Period
from adtally.operators.window_sums import COMPARED, MEASURES, MONEY

ROWS = "day_rows"
_BEFORE = timedelta(days=1)


def _summed(facts: DataFrame) -> list[Column]:
    for name in MONEY:
        kind = facts.schema[name].dataType
        if not isinstance(kind, DecimalType) or kind.scale > 4:
            raise ValueError(f"{name} has to be a decimal of at most four places, as sums are subtracted from each other")
    # a number of 1/10000 is exact, and 24 digits before the point are enough for the totals of all time
    money = {name: F.coalesce(F.sum(name), F.lit(0)).cast("decimal(28,4)") for name in MONEY}
    counters = {name: F.coalesce(F.sum(name), F.lit(0)).cast("long") for name in MEASURES if name not in MONEY}
    return [F.count("*").alias(ROWS), *((money | counters)[name].alias(name) for name in MEASURES)]


def running_totals(day_sell: DataFrame, days: Column) -> DataFrame:
    """(site_id, day, day_rows, measures): totals up to each of ``days``, an ascending array such as ``F.sequence(first, last)``.

    The facts are added up by site and day before anything is gathered, so a site has at most one row a day however many
    facts it has.
    """
    by_day = day_sell.where("site_id IS NOT NULL AND day IS NOT NULL").groupBy("site_id", "day").agg(*_summed(day_sell))
    so_far = Window.partitionBy("site_id").orderBy("day")
    names = (ROWS, *MEASURES)
    kinds = {name: by_day.schema[name].dataType for name in names}
    totals = by_day.select(
        "site_id", "day", F.lead("day").over(so_far).alias("next"), *(F.sum(name).over(so_far).cast(kinds[name]).alias(name) for name in names)
    )
    valid = F.filter(days, lambda d: (d >= F.col("day")) & (F.col("next").isNull() | (d < F.col("next"))))
    return totals.select("site_id", F.explode(valid).alias("day"), *names)


def next_day(before: DataFrame, day_sell: DataFrame, day: date) -> DataFrame:
    """The rows of ``day`` from those of the day before it (no rows on the very first day) and the facts of ``day``.

    The facts are narrowed and added up first; the result is the same however often it is worked out.
    """
    new = day_sell.where((F.col("day") == F.lit(day)) & F.col("site_id").isNotNull()).groupBy("site_id").agg(*_summed(day_sell))
    names = (ROWS, *MEASURES)
    last = before.where(F.col("day") == F.lit(day - _BEFORE)).select("site_id", *names)
    both = last.unionByName(new).groupBy("site_id").agg(*(F.sum(name).cast(last.schema[name].dataType).alias(name) for name in names))
    return both.select("site_id", F.lit(day).alias("day"), *names)


def days_of(period: Period, lookback: tuple[date, date] | None = None) -> list[date]:
    """Days whose totals a report of the period needs."""
    edges = [(w.start - _BEFORE, w.end) for w in (period.current, period.previous)]
    if lookback is not None:
        edges.append((lookback[0] - _BEFORE, lookback[1] - _BEFORE))
    return sorted({day for edge in edges for day in edge})


def array_of(days: Iterable[date]) -> Column:
    return F.array(*(F.lit(day) for day in days))


def cumulative_window_sums(cumulative: DataFrame, period: Period, lookback: tuple[date, date] | None = None) -> DataFrame:
    """The columns of ``site_window_sums`` from the cumulative table, for a period of whole days.

    A site that a day does not have yet counts as zero there. Money is exact up to the difference, which is rounded at the site.
    """
    if period.is_today_included:
        raise ValueError("hours of today are not in the cumulative table")
    rows = cumulative.where(F.col("day").isin(days_of(period, lookback)))

    def between(name: str, start: date, end: date) -> str:
        sides = (f"sum({name}) FILTER (WHERE day = DATE '{day}')" for day in (end, start - _BEFORE))
        total = " - ".join(f"coalesce({side}, 0)" for side in sides)
        return stored(f"({total})") if name in MONEY else f"CAST({total} AS BIGINT)"

    spans = {"": (period.current.start, period.current.end), "_prev": (period.previous.start, period.previous.end)}
    sums = [f"{between(name, *spans[''])} AS {name}" for name in MEASURES]
    sums += [f"{between(name, *spans['_prev'])} AS {name}_prev" for name in COMPARED]
    sums += [f"{between(ROWS, *spans[''])} AS current_rows", f"{between(ROWS, *spans['_prev'])} AS previous_rows"]
    if lookback is not None:
        sums.append(f"{between(ROWS, lookback[0], lookback[1] - _BEFORE)} AS lookback_rows")
    per_site = rows.groupBy("site_id").agg(*map(F.expr, sums))
    per_site = per_site.selectExpr("*", *(f"{name} AS {name}_for_delta" for name in COMPARED))
    return per_site.where("current_rows > 0 OR previous_rows > 0").drop("previous_rows")
