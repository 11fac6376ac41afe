"""Ratio columns of the sales and exchange reports, as SQL expressions.

The builders take and give SQL text: a report has well over a hundred such columns, and one
parsed expression per column keeps building the plan cheap.

Two flavours of the same ratios exist. Report rows store money and ratios with four
decimals, so they are computed in decimal arithmetic and rounded when stored. Totals are
presentation figures over sums and stay double.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Ratio:
    """``factor * numerator / denominator``, 0 when the denominator is 0."""

    name: str
    numerator: str
    denominator: str
    factor: int


# Every ratio a report shows beside its counters. Block clicks are the source's clicks.
RATIOS = (
    Ratio("src_ctr", "src_clicks", "src_shows", 100),
    Ratio("src_click_price", "profit", "src_clicks", 1),
    Ratio("src_cpm", "profit", "src_shows", 1000),
    Ratio("buy_ctr", "buy_clicks", "buy_shows", 100),
    Ratio("buy_click_price", "profit", "buy_clicks", 1),
    Ratio("buy_cpm", "profit", "buy_shows", 1000),
    Ratio("block_ctr", "src_clicks", "block_shows", 100),
    Ratio("block_cpm", "profit", "block_shows", 1000),
)

SYSTEM_SHARE = Ratio("percent_system_profit", "system_profit", "site_raw_profit", 100)


def stored(value: str) -> str:
    """Round half up to the four decimals of a stored money or ratio column."""
    return f"CAST({value} AS DECIMAL(16,4))"


def exact_count(value: str) -> str:
    """A counter in the type the stored ratios are computed in."""
    return f"CAST({value} AS DECIMAL(19,0))"


def exact_ratio(numerator: str, denominator: str, factor: int) -> str:
    """Unrounded decimal ratio of ``stored`` money or ``exact_count`` counters."""
    return f"IF({denominator} != 0, {factor} * {numerator} / {denominator}, 0)"


def double_ratio(numerator: str, denominator: str, factor: int = 1) -> str:
    quotient = f"{factor}D * CAST({numerator} AS DOUBLE) / CAST({denominator} AS DOUBLE)"
    return f"IF({denominator} != 0, {quotient}, 0D)"


def ctr(shows: str, clicks: str) -> str:
    return double_ratio(clicks, shows, 100)


def cpc(clicks: str, profit: str) -> str:
    return double_ratio(profit, clicks)


def cpm(shows: str, profit: str) -> str:
    return double_ratio(profit, shows, 1000)


def system_share(system_profit: str, profit: str) -> str:
    """System profit as a percentage of system profit plus publisher profit."""
    return double_ratio(system_profit, f"({system_profit} + {profit})", 100)


def quotient_change(numerator: str, denominator: str, factor: int) -> str:
    """Quotient of two columns minus the quotient before their deltas, times ``factor``."""
    before = double_ratio(f"({numerator} - delta_{numerator})", f"({denominator} - delta_{denominator})")
    return f"({double_ratio(numerator, denominator)} - {before}) * {factor}D"


def filled_share(shows: str, empty: str) -> str:
    """Percentage of block shows that were not empty, as a double."""
    return f"IF({shows} > 0, CAST(({shows} - {empty}) * 100 AS DOUBLE) / {shows}, 0D)"
