"""Daily exchange statistics of exchanger accounts, with totals and a table for export.

All functions work for any number of users at once: rows are keyed by user and day, totals
by user. One user's report is the same thing after a filter on ``user_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtally.functions import metrics
from adtally.operators.periods import Period, Window
from adtally.operators.totals import sum_by_columns
from adtally.operators.window_sums import in_window

COUNTERS = ("src_shows", "src_clicks", "buy_shows", "buy_clicks", "in_shows", "in_clicks", "debt")
STORED_RATIOS = ("tier_ratio", "calc_exchange_ratio")

# Exported columns in order: name, header, format. Headers are fixed values.
EXPORT = (
    ("date", "Date", "text"),
    ("src_shows", "Source Shows", "int"),
    ("src_clicks", "Source Clicks", "int"),
    ("src_ctr", "Source CTR", "ctrRaw"),
    ("buy_shows", "Advertisers Shows", "int"),
    ("buy_clicks", "Advertisers Clicks", "int"),
    ("buy_ctr", "Advertisers CTR", "ctrRaw"),
    ("tier_ratio", "TP ratio", "float"),
    ("in_shows", "Ads Shows", "int"),
    ("in_clicks", "Ads Clicks", "int"),
    ("in_ctr", "Ads CTR", "ctrRaw"),
    ("debt", "Debt", "int"),
    ("exchange_delta", "Exchange delta", "int"),
    ("calc_exchange_ratio", "Exchange ratio", "float"),
)


def exchangers(users: DataFrame) -> DataFrame:
    """Accounts that have an exchange report; for all others the report is empty."""
    return users.where("is_exchanger").select(F.col("id").alias("user_id"))


def daily_rows(exchange_daily: DataFrame, users: DataFrame, window: Window) -> DataFrame:
    """One row per exchanger and day of the window."""
    rows = exchange_daily.where(in_window("date", window)).join(exchangers(users), "user_id", "left_semi")
    return rows.groupBy("user_id", "date").agg(*_sums(COUNTERS + STORED_RATIOS))


def previous_rows(exchange_daily: DataFrame, users: DataFrame, period: Period) -> DataFrame:
    """Rows of the previous window, with the day of the current window each compares to."""
    rows = daily_rows(exchange_daily, users, period.previous)
    return rows.withColumn("compared_date", F.date_add("date", period.days_count))


def with_row_metrics(rows: DataFrame) -> DataFrame:
    rates = (f"{metrics.ctr(f'{side}_shows', f'{side}_clicks')} AS {side}_ctr" for side in ("src", "buy", "in"))
    return rows.selectExpr("*", *rates, "in_clicks - debt AS exchange_delta")


def screen_total(rows: DataFrame, *group: str) -> DataFrame:
    """Plain sums of every column, ratios included."""
    return sum_by_columns(rows, *group)


def export_total(rows: DataFrame, *group: str) -> DataFrame:
    """Sums with every ratio taken from the sums."""
    sums = rows.groupBy(*group).agg(*_sums(COUNTERS))
    return with_row_metrics(
        sums.selectExpr(
            "*",
            f"{metrics.double_ratio('buy_clicks', 'src_clicks')} AS tier_ratio",
            f"{metrics.double_ratio('debt', 'src_clicks')} AS calc_exchange_ratio",
        )
    )


def export_table(rows: DataFrame, *group: str) -> DataFrame:
    """Formatted text columns of one user, or of every ``group``, with a total row each.

    Days and total come from one pass: every day also counts for the total, whose ratios are
    then taken from its sums. ``row_order`` sorts the total behind the days and is dropped by
    the writer.
    """
    both = rows.selectExpr(
        *group,
        "explode(array(date_format(date, 'yyyy-MM-dd'), 'total')) AS row_order",
        *COUNTERS,
        *STORED_RATIOS,
    )
    summed = both.groupBy(*group, "row_order").agg(*_sums(COUNTERS + STORED_RATIOS))
    is_total = "row_order = 'total'"
    recomputed = {
        "date": f"IF({is_total}, 'Total', date_format(try_cast(row_order AS DATE), 'dd.MM.yyyy'))",
        "tier_ratio": f"IF({is_total}, {metrics.double_ratio('buy_clicks', 'src_clicks')}, tier_ratio)",
        "calc_exchange_ratio": f"IF({is_total}, {metrics.double_ratio('debt', 'src_clicks')}, calc_exchange_ratio)",
    }
    full = with_row_metrics(summed.selectExpr(*group, "row_order", *COUNTERS, *_named(recomputed)))
    shown = {header: _formatted(name, kind) for name, header, kind in EXPORT}
    return full.selectExpr(*group, "row_order", *_named(shown))


def _named(columns: dict[str, str]) -> list[str]:
    return [f"{value} AS `{name}`" for name, value in columns.items()]


def _sums(names: tuple[str, ...]) -> list[Column]:
    return [F.expr(f"coalesce(sum({name}), 0) AS {name}") for name in names]


def _formatted(value: str, kind: str) -> str:
    """Counters as whole numbers, ratios with four decimals, texts as they are."""
    if kind == "int":
        return f"CAST(CAST({value} AS BIGINT) AS STRING)"
    if kind in ("float", "ctrRaw"):
        return f"CAST({metrics.stored(value)} AS STRING)"
    return value
