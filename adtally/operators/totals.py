"""Totals of the sales report, and sums of rows whose columns are not known beforehand.

The grand total compares against the delta base, the page total against the shown figures.
The two therefore differ when today is part of the period, and stay separate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, NumericType, StringType

from adtally.functions import metrics
from adtally.functions.metrics import RATIOS
from adtally.operators.window_sums import COUNTERS

_NUMBER = r"^\\s*[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?\\s*$"
_ADDITIVE = ("profit", "system_profit") + COUNTERS


def grand_total(rows: DataFrame) -> DataFrame:
    """One row over all report rows, with ratios of sums. No rows give zeros."""
    summed = ["block_shows_empty"]
    summed += [name for figure in _ADDITIVE for name in (figure, f"delta_{figure}", f"{figure}_for_delta")]
    sums = rows.agg(*(F.expr(f"coalesce(sum({name}), 0) AS {name}") for name in summed))

    columns = [name for figure in _ADDITIVE for name in (figure, f"delta_{figure}")]
    for ratio in RATIOS:
        num, den = ratio.numerator, ratio.denominator
        base = metrics.double_ratio(f"{num}_for_delta", f"{den}_for_delta", ratio.factor)
        before = metrics.double_ratio(
            f"({num}_for_delta - delta_{num})", f"({den}_for_delta - delta_{den})", ratio.factor
        )
        columns.append(f"{metrics.double_ratio(num, den, ratio.factor)} AS {ratio.name}")
        columns.append(f"{base} - {before} AS delta_{ratio.name}")
    columns += [f"{value} AS {name}" for name, value in _shares().items()]
    return sums.selectExpr(*columns)


def page_total(page: DataFrame) -> DataFrame:
    """Column sums of a page with its ratios computed anew.

    ``buy_cpm`` and ``delta_buy_cpm`` keep the sum of the row values, as do the ids and the
    panel columns. An empty page gives zeros.
    """
    changed = _shares()
    for ratio in RATIOS:
        if ratio.name == "buy_cpm":
            continue
        num, den = ratio.numerator, ratio.denominator
        changed[ratio.name] = metrics.double_ratio(num, den, ratio.factor)
        changed[f"delta_{ratio.name}"] = metrics.quotient_change(num, den, ratio.factor)
    sums = sum_by_columns(page)
    return sums.selectExpr(*(f"{changed.get(name, name)} AS {name}" for name in sums.columns))


def _shares() -> dict[str, str]:
    """Shares both totals compute alike from their sums."""
    share = metrics.system_share("system_profit", "profit")
    before = metrics.system_share("(system_profit - delta_system_profit)", "(profit - delta_profit)")
    return {
        "percent_system_profit": share,
        "delta_percent_system_profit": f"{share} - {before}",
        "effective_block_shows_pc": metrics.filled_share("block_shows", "block_shows_empty"),
    }


def numeric_or_zero(value: str, kind: DataType) -> str:
    """The value as a number; booleans, dates, nulls and texts that are no number count as 0."""
    if isinstance(kind, StringType):
        return f"IF({value} RLIKE '{_NUMBER}', try_cast({value} AS DOUBLE), 0D)"
    if isinstance(kind, IntegralType):
        return f"coalesce(CAST({value} AS BIGINT), 0L)"
    if isinstance(kind, NumericType):
        return f"coalesce({value}, CAST(0 AS {kind.simpleString()}))"
    return "0L"


def sum_by_columns(df: DataFrame, *group: str) -> DataFrame:
    """Sum of every column over all rows, or per ``group``; an empty input gives zeros."""
    sums = []
    for field in df.schema.fields:
        if field.name not in group:
            number = numeric_or_zero(f"`{field.name}`", field.dataType)
            sums.append(F.expr(f"coalesce(sum({number}), 0) AS `{field.name}`"))
    return df.groupBy(*group).agg(*sums)


def sum_by_keys(df: DataFrame, entries: str) -> DataFrame:
    """Sums per key of a column of string maps, for rows whose keys differ.

    Each row is spread into its entries and added up in the input task first, so a key that
    occurs in every row costs one partial sum per task.
    """
    pairs = df.select(F.explode(entries).alias("key", "value"))
    return pairs.groupBy("key").agg(F.expr(f"sum({numeric_or_zero('value', StringType())}) AS total"))
