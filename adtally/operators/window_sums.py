"""Per-site sums over the current and the previous window from one pass over the facts.

The facts are only filtered and pre-aggregated before the shuffle: nothing is joined to
them. A site that holds a large part of the rows therefore costs one partial row per
input task, and every later join sees at most one row per site.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from adtally.functions.metrics import stored
from adtally.operators.periods import Period, Window

COUNTERS = ("src_shows", "src_clicks", "buy_shows", "buy_clicks", "block_shows")
MONEY = ("profit", "buyers_expense", "parent_profit", "agent_profit")
COMPARED = COUNTERS + MONEY
MEASURES = COUNTERS + ("block_shows_empty",) + MONEY


def in_window(column: str, window: Window) -> str:
    return f"{column} BETWEEN DATE '{window.start}' AND DATE '{window.end}'"


def in_days(column: str, span: tuple[date, date]) -> str:
    return f"({column} >= DATE '{span[0]}' AND {column} < DATE '{span[1]}')"


def in_hours(column: str, span: tuple[datetime, datetime]) -> str:
    start, end = (f"TIMESTAMP_NTZ '{moment}'" for moment in span)
    return f"({column} >= {start} AND {column} < {end})"


def _fits_units(*facts: DataFrame) -> bool:
    """Whether all money columns are decimals that are whole 64-bit numbers of 1/10000."""
    kinds = [table.schema[name].dataType for table in facts for name in MONEY]
    return all(
        isinstance(kind, DecimalType) and kind.scale <= 4 and kind.precision - kind.scale <= 14
        for kind in kinds
    )


@dataclass(frozen=True)
class _Sums:
    """Builds the sums of measures.

    With ``in_units`` money is added up as whole numbers of 1/10000, which is exact, takes
    half the time of adding decimals and halves the shuffled bytes. Other money columns are
    added up as they are and rounded at the site.
    """

    in_units: bool

    def measure(self, name: str) -> str:
        if name in MONEY and self.in_units:
            return f"CAST({name} * 10000 AS BIGINT) AS {name}"
        return name

    def where(self, condition: str, measure: str, name: str) -> str:
        total = f"coalesce(sum({measure}) FILTER (WHERE {condition}), 0)"
        if measure in MONEY:
            total = stored(f"CAST({total} AS DECIMAL(20,0)) * 0.0001" if self.in_units else total)
        return f"{total} AS {name}"


def site_window_sums(
    day_sell: DataFrame,
    period: Period,
    hour_sell: DataFrame | None = None,
    lookback: tuple[date, date] | None = None,
) -> DataFrame:
    """One row per site with day rows in either window.

    Columns: the ten measures of the current window, ``<measure>_for_delta`` and
    ``<measure>_prev`` for the nine compared ones, ``current_rows`` and, if ``lookback`` is
    given, ``lookback_rows`` (day rows inside that span).
    """
    if period.is_today_included and hour_sell is None:
        raise ValueError("a period that includes today needs the hourly facts")

    wanted = in_window("day", Window(period.previous.start, period.current.end))
    if lookback is not None:
        wanted = f"{wanted} OR {in_days('day', lookback)}"
    with_hours = period.is_today_included
    build = _Sums(_fits_units(day_sell, hour_sell) if with_hours else _fits_units(day_sell))
    facts = day_sell.where(wanted).selectExpr("site_id", "day", *map(build.measure, MEASURES))

    is_current = in_window("day", period.current)
    is_previous = in_window("day", period.previous)
    sums = [build.where(is_current, measure, measure) for measure in MEASURES]
    sums += [f"count_if({is_current}) AS current_rows", f"count_if({is_previous}) AS previous_rows"]
    if lookback is not None:
        sums.append(f"count_if({in_days('day', lookback)}) AS lookback_rows")

    if with_hours:
        facts = facts.withColumn("hour", F.expr("CAST(NULL AS TIMESTAMP_NTZ)"))
        facts = facts.unionByName(_completed_hours(hour_sell, period, build))
        per_site = _aggregated(facts, sums + _partial_day_sums(period, build))
        per_site = _add_completed_hours(per_site, lookback is not None)
    else:
        sums += [build.where(is_previous, measure, f"{measure}_prev") for measure in COMPARED]
        base = (f"{measure} AS {measure}_for_delta" for measure in COMPARED)
        per_site = _aggregated(facts, sums).selectExpr("*", *base)

    return per_site.where("current_rows > 0 OR previous_rows > 0").drop("previous_rows")


def _aggregated(facts: DataFrame, sums: list[str]) -> DataFrame:
    return facts.groupBy("site_id").agg(*(F.expr(one) for one in sums))


def _completed_hours(hour_sell: DataFrame, period: Period, build: _Sums) -> DataFrame:
    current = in_hours("hour", period.completed_hours(period.current))
    previous = in_hours("hour", period.completed_hours(period.previous))
    return hour_sell.where(f"{current} OR {previous}").selectExpr(
        "site_id", "CAST(NULL AS DATE) AS day", "hour", *map(build.measure, COMPARED), "0L AS block_shows_empty"
    )


def _partial_day_sums(period: Period, build: _Sums) -> list[str]:
    """Whole days before each window's last day, and the completed hours of that last day."""
    sums = []
    for side, window in (("for_delta", period.current), ("prev", period.previous)):
        whole_days = in_days("day", (window.start, window.end))
        hours = in_hours("hour", period.completed_hours(window))
        for measure in COMPARED:
            sums.append(build.where(whole_days, measure, f"{measure}_{side}"))
            sums.append(build.where(hours, measure, f"{measure}_{side}_hours"))
    return sums


def _add_completed_hours(per_site: DataFrame, has_lookback: bool) -> DataFrame:
    """Hours count only for sites that have a day row in the same window."""
    columns = ["site_id", *MEASURES, "current_rows", "previous_rows"]
    columns += ["lookback_rows"] if has_lookback else []
    for side, rows in (("for_delta", "current_rows"), ("prev", "previous_rows")):
        for measure in COMPARED:
            total = f"{measure}_{side} + IF({rows} > 0, {measure}_{side}_hours, 0)"
            columns.append(f"{stored(total) if measure in MONEY else total} AS {measure}_{side}")
    return per_site.selectExpr(*columns)
