"""SQL of the sales report in stages: facts, spine, sums per window, report, deltas.

It is written in the staged shape on purpose, while the Spark side is one conditional
aggregate, so that both do not share a mistake. Money and ratios are whole numbers of
1/10000, and ratios are rounded half up by integer division, so nothing depends on floating
point.
"""

from __future__ import annotations

from dataclasses import dataclass

COUNTERS = ("src_shows", "src_clicks", "buy_shows", "buy_clicks", "block_shows")
MONEY = ("profit", "buyers_expense", "parent_profit", "agent_profit")
COMPARED = COUNTERS + MONEY

# name, numerator, denominator, factor; money counts in 1/10000 already.
RATIOS = (
    ("src_ctr", "src_clicks", "src_shows", 100),
    ("src_click_price", "profit", "src_clicks", 1),
    ("src_cpm", "profit", "src_shows", 1000),
    ("buy_ctr", "buy_clicks", "buy_shows", 100),
    ("buy_click_price", "profit", "buy_clicks", 1),
    ("buy_cpm", "profit", "buy_shows", 1000),
    ("block_ctr", "src_clicks", "block_shows", 100),
    ("block_cpm", "profit", "block_shows", 1000),
    ("percent_system_profit", "system_profit", "raw_profit", 100),
)

ORDER_FACTS = """
day_sell AS (
    SELECT o_custkey AS site_id, CAST(o_orderdate AS DATE) AS day,
        100 + o_orderkey % 900 AS src_shows, o_orderkey % 50 AS src_clicks,
        50 + o_orderkey % 450 AS buy_shows, o_orderkey % 20 AS buy_clicks,
        200 + o_orderkey % 300 AS block_shows, o_orderkey % 100 AS block_shows_empty,
        CAST(CAST(o_totalprice AS DECIMAL(16,2)) * 0.60 AS DECIMAL(16,4)) AS profit,
        CAST(CAST(o_totalprice AS DECIMAL(16,2)) AS DECIMAL(16,4)) AS buyers_expense,
        CAST(CAST(o_totalprice AS DECIMAL(16,2)) * 0.05 AS DECIMAL(16,4)) AS parent_profit,
        CAST(CAST(o_totalprice AS DECIMAL(16,2)) * 0.03 AS DECIMAL(16,4)) AS agent_profit
    FROM orders)"""

LINE_FACTS = """
day_sell AS (
    SELECT l_suppkey AS site_id, CAST(l_shipdate AS DATE) AS day,
        CAST(l_quantity AS BIGINT) * 100 AS src_shows,
        CAST(l_quantity AS BIGINT) + l_linenumber AS src_clicks,
        CAST(l_quantity AS BIGINT) * 40 AS buy_shows, CAST(l_quantity AS BIGINT) AS buy_clicks,
        CAST(l_quantity AS BIGINT) * 120 AS block_shows,
        CAST(l_quantity AS BIGINT) * l_linenumber AS block_shows_empty,
        CAST(CAST(l_extendedprice AS DECIMAL(16,2))
            * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(16,4)) AS profit,
        CAST(CAST(l_extendedprice AS DECIMAL(16,2)) AS DECIMAL(16,4)) AS buyers_expense,
        CAST(0 AS DECIMAL(16,4)) AS parent_profit,
        CAST(CAST(l_extendedprice AS DECIMAL(16,2))
            * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(16,4)) AS agent_profit
    FROM lineitem)"""


def _event_facts(name: str, key: str, where: str) -> str:
    return f"""
{name} AS (
    SELECT user_id AS site_id, {key},
        count(*) FILTER (event_type = 'view') AS src_shows,
        count(*) FILTER (event_type = 'click') AS src_clicks,
        count(*) FILTER (event_type = 'signup') AS buy_shows,
        count(*) FILTER (event_type = 'purchase') AS buy_clicks,
        count(*) AS block_shows,
        count(*) FILTER (event_type = 'error') AS block_shows_empty,
        CAST(sum(CAST(CAST(value AS DECIMAL(16,2)) * 0.60 AS DECIMAL(16,4))) AS DECIMAL(16,4)) AS profit,
        CAST(sum(CAST(value AS DECIMAL(16,2))) AS DECIMAL(16,4)) AS buyers_expense,
        CAST(sum(CAST(CAST(value AS DECIMAL(16,2)) * 0.05 AS DECIMAL(16,4))) AS DECIMAL(16,4)) AS parent_profit,
        CAST(sum(CAST(CAST(value AS DECIMAL(16,2)) * 0.03 AS DECIMAL(16,4))) AS DECIMAL(16,4)) AS agent_profit
    FROM events WHERE {where} GROUP BY ALL)"""


EVENT_FACTS = (
    _event_facts("day_sell", "CAST(ts AS DATE) AS day", "value >= 20")
    + ","
    + _event_facts("hour_sell", "date_trunc('hour', ts) AS hour", "true")
)

CUSTOMER_SITES = """
sites AS (
    SELECT c_custkey AS id, c_name AS name,
        'https://c' || c_custkey || '.example.com' AS url, CAST(c_nationkey AS BIGINT) AS seller_id,
        c_custkey % 10 AS country_id, c_mktsegment AS profit_type,
        nullif(c_custkey % 6, 0) AS min_teaser_rating
    FROM customer WHERE c_acctbal >= 0)"""

SUPPLIER_SITES = """
sites AS (
    SELECT s_suppkey AS id, s_name AS name,
        'https://s' || s_suppkey || '.example.com' AS url, CAST(s_nationkey AS BIGINT) AS seller_id,
        s_suppkey % 10 AS country_id, 'fixed' AS profit_type,
        nullif(s_suppkey % 6, 0) AS min_teaser_rating,
        CAST(CAST(s_acctbal AS DECIMAL(16,2)) AS DECIMAL(16,4)) AS min_ad_price,
        nullif(s_suppkey % 4, 0) AS buyer_target
    FROM supplier)"""

USERS = """
users AS (
    SELECT CAST(n_nationkey AS BIGINT) AS id,
        CASE WHEN n_nationkey % 4 = 0 THEN '@pre@' ELSE '' END || lower(n_name) || '@example.com' AS email,
        n_regionkey AS subsystem_id, n_nationkey % 2 = 0 AS is_exchanger,
        n_nationkey % 7 = 0 AS is_disabled
    FROM nation)"""

MARKS = """
user_marks AS (
    SELECT CAST(n_nationkey AS BIGINT) AS user_id, 's' || n_nationkey % 3 AS source,
        'm' || n_nationkey % 4 AS medium, 'c' || n_nationkey % 2 AS campaign,
        'a' || n_nationkey % 6 AS ad
    FROM nation WHERE n_regionkey <> 0)"""


@dataclass(frozen=True)
class Facts:
    tables: str
    start: str
    end: str
    start_prev: str
    end_prev: str
    cutoff_hour: int | None = None


ORDERS = Facts(ORDER_FACTS + "," + CUSTOMER_SITES, "1997-03-01", "1997-03-31", "1997-01-29", "1997-02-28")
LINES = Facts(LINE_FACTS + "," + SUPPLIER_SITES, "1997-03-01", "1997-03-31", "1997-01-29", "1997-02-28")
EVENTS = Facts(EVENT_FACTS + "," + CUSTOMER_SITES, "2024-01-20", "2024-01-20", "2024-01-19", "2024-01-19", 13)
EVENT_DAYS = Facts(EVENT_FACTS + "," + CUSTOMER_SITES, "2024-01-18", "2024-01-20", "2024-01-15", "2024-01-17", 13)


def _whole(name: str) -> str:
    """Money as a whole number of 1/10000, counters as they are."""
    return f"CAST({name} * 10000 AS HUGEINT)" if name in MONEY else f"CAST({name} AS HUGEINT)"


def _scaled(ratio: tuple, side: str) -> tuple[str, str]:
    """Numerator and denominator of a ratio counted in 1/10000."""
    _, numerator, denominator, factor = ratio
    money_over_count = numerator == "profit"
    scale = factor if money_over_count else factor * 10000
    return f"({scale} * {numerator}{side})", f"{denominator}{side}"


def _half_up(numerator: str, denominator: str) -> str:
    rounded = f"((2 * abs({numerator}) + abs({denominator})) // (2 * abs({denominator})))"
    sign = f"(CASE WHEN ({numerator} < 0) <> ({denominator} < 0) THEN -1 ELSE 1 END)"
    return f"(CASE WHEN {denominator} = 0 THEN 0 ELSE {sign} * {rounded} END)"


def _sums(table: str, where: str) -> str:
    sums = ", ".join(f"coalesce(sum({_whole(m)}), 0) AS {m}" for m in COMPARED)
    return f"SELECT f.site_id, {sums} FROM {table} f JOIN spine USING (site_id) WHERE {where} GROUP BY f.site_id"


def _window_tables(facts: Facts, side: str, start: str, end: str) -> str:
    """Sums of a window per site, and the sums its deltas are taken from."""
    days = f"day BETWEEN DATE '{start}' AND DATE '{end}'"
    empty = "SELECT site_id, sum(block_shows_empty) AS block_shows_empty FROM day_sell"
    ctes = f"""
stats{side} AS (SELECT * FROM ({_sums('day_sell', days)}) JOIN
    ({empty} WHERE {days} GROUP BY site_id) USING (site_id))"""
    if facts.cutoff_hour is None:
        base = ", ".join(f"{m} AS {m}_base" for m in COMPARED)
        return ctes + f",\nbase{side} AS (SELECT site_id, {base} FROM stats{side})"
    before = f"day >= DATE '{start}' AND day < DATE '{end}'"
    hours = f"hour >= TIMESTAMP '{end} 00:00:00' AND hour < TIMESTAMP '{end} {facts.cutoff_hour:02d}:00:00'"
    base = ", ".join(f"coalesce(d.{m}, 0) + coalesce(h.{m}, 0) AS {m}_base" for m in COMPARED)
    return ctes + f""",
whole_days{side} AS ({_sums('day_sell', before)}),
full_hours{side} AS ({_sums('hour_sell', hours)}),
base{side} AS (SELECT s.site_id, {base} FROM stats{side} s
    LEFT JOIN whole_days{side} d USING (site_id) LEFT JOIN full_hours{side} h USING (site_id))"""


def report_ctes(facts: Facts, by_publisher: bool = False, where: str = "true", extra: str = "") -> str:
    """``WITH`` list ending in ``report``: whole numbers, one row per site or publisher."""
    key, name = ("user_id", "email") if by_publisher else ("site_id", "site_name")
    scope = (
        f"day BETWEEN DATE '{facts.start}' AND DATE '{facts.end}' "
        f"OR day BETWEEN DATE '{facts.start_prev}' AND DATE '{facts.end_prev}'"
    )
    group = ", ".join(
        [f"sum({m}) AS {m}" for m in COMPARED]
        + ["sum(block_shows_empty) AS block_shows_empty"]
        + [f"sum({m}_base) AS {m}_base" for m in COMPARED]
    )
    group_prev = ", ".join(f"coalesce(sum({m}_base), 0) AS {m}_prev" for m in COMPARED)
    joined = [f"coalesce(cur.{m}, 0) AS {m}" for m in COMPARED + ("block_shows_empty",)]
    joined += [f"coalesce(cur.{m}_base, 0) AS {m}_base" for m in COMPARED]
    joined += [f"coalesce(prev.{m}_prev, 0) AS {m}_prev" for m in COMPARED]
    profits = []
    for side in ("", "_base", "_prev"):
        raw = f"buyers_expense{side} - parent_profit{side} - agent_profit{side}"
        profits += [f"{raw} AS raw_profit{side}", f"{raw} - profit{side} AS system_profit{side}"]
    ratios = []
    for ratio in RATIOS:
        for side in ("", "_base"):
            ratios.append(f"{_half_up(*_scaled(ratio, side))} AS {ratio[0]}{side}")
    deltas = [f"{m}_base - {m}_prev AS delta_{m}" for m in COUNTERS + ("profit", "system_profit")]
    for ratio in RATIOS:
        num, den = _scaled(ratio, "_prev")
        change = _half_up(f"({ratio[0]}_base * {den} - {num})", den)
        deltas.append(f"CASE WHEN {den} = 0 THEN {ratio[0]}_base ELSE {change} END AS delta_{ratio[0]}")
    return f"""WITH {facts.tables},{USERS}{extra},
spine_all AS (
    SELECT DISTINCT site_id, s.name AS site_name, s.url AS site_url, s.seller_id AS user_id, s.country_id,
        s.profit_type, s.min_teaser_rating, u.email, u.subsystem_id, u.is_exchanger, u.is_disabled
    FROM (SELECT site_id FROM day_sell WHERE {scope}) d
    LEFT JOIN sites s ON s.id = d.site_id LEFT JOIN users u ON u.id = s.seller_id),
spine AS (SELECT * FROM spine_all WHERE {where}),
{_window_tables(facts, '', facts.start, facts.end)},
{_window_tables(facts, '_prev', facts.start_prev, facts.end_prev)},
cur AS (SELECT {key} AS id, {name} AS name, {group}
    FROM stats JOIN base USING (site_id) JOIN spine USING (site_id) GROUP BY ALL),
prev AS (SELECT {key} AS id, {group_prev} FROM base_prev RIGHT JOIN spine USING (site_id) GROUP BY 1),
summed AS (SELECT ids.id, cur.name, {', '.join(joined)}
    FROM (SELECT DISTINCT {key} AS id FROM spine WHERE {key} IS NOT NULL) ids
    LEFT JOIN cur USING (id) LEFT JOIN prev USING (id)),
profits AS (SELECT *, {', '.join(profits)} FROM summed),
rated AS (SELECT *, {', '.join(ratios)},
    {_half_up('((block_shows - block_shows_empty) * 100 * 10000)', 'block_shows')} AS effective_block_shows_pc
    FROM profits),
report AS (SELECT *, {', '.join(deltas)} FROM rated)"""


COMPARED_FIGURES = ("profit", "system_profit") + COUNTERS + tuple(r[0] for r in RATIOS)
_COUNTS = set(COUNTERS) | {"block_shows_empty"}


def figure(name: str, source: str = "") -> str:
    """A report column as shown: counters as BIGINT, everything else as DOUBLE."""
    plain = name.removeprefix("delta_").removesuffix("_base")
    if plain in _COUNTS:
        return f"CAST({source}{name} AS BIGINT) AS {name}"
    return f"CAST({source}{name} AS DOUBLE) / 10000 AS {name}"


def all_figures(source: str = "") -> str:
    names = [n for f in COMPARED_FIGURES for n in (f, f"delta_{f}")]
    names += ["block_shows_empty", "effective_block_shows_pc"]
    return ", ".join(figure(n, source) for n in names)


def rows_sql(facts: Facts, by_publisher: bool = False, where: str = "true", extra: str = "") -> str:
    return f"{report_ctes(facts, by_publisher, where, extra)}\nSELECT id, name, {all_figures()} FROM report"


def page_ctes(facts: Facts, by_publisher: bool, order: str, items: int, offset: int) -> str:
    """Adds ``page``: the shown rows as whole numbers. ``order`` is an ORDER BY list."""
    flags = "u.id AS user_id, u.is_disabled, u.is_exchanger"
    if by_publisher:
        shown = f"u.email AS shown_name, {flags} FROM report r JOIN users u ON u.id = r.id"
    else:
        shown = (
            f"s.id AS site_id, s.name AS shown_name, {flags} FROM report r "
            "JOIN sites s ON s.id = r.id JOIN users u ON u.id = s.seller_id"
        )
    limit = f"LIMIT {items} OFFSET {offset}" if items > 0 else ""
    return f"""{report_ctes(facts, by_publisher)},
page AS (SELECT r.*, {shown} ORDER BY {order} {limit})"""


def page_sql(facts: Facts, by_publisher: bool, order: str, items: int, offset: int) -> str:
    site = "" if by_publisher else "site_id, "
    return f"""{page_ctes(facts, by_publisher, order, items, offset)}
SELECT id, {site}shown_name AS name, user_id, CAST(is_disabled AS INTEGER) AS is_disabled,
    CAST(is_exchanger AS INTEGER) AS is_exchanger, {all_figures()} FROM page"""


def _double(num: str, den: str, factor: int, money_num: bool, money_den: bool = False) -> str:
    top = f"(CAST({num} AS DOUBLE) / 10000)" if money_num else f"CAST({num} AS DOUBLE)"
    bottom = f"(CAST({den} AS DOUBLE) / 10000)" if money_den else f"CAST({den} AS DOUBLE)"
    return f"(CASE WHEN {den} <> 0 THEN CAST({factor} AS DOUBLE) * {top} / {bottom} ELSE CAST(0 AS DOUBLE) END)"


_SHARE = {
    "percent_system_profit": _double("system_profit", "(system_profit + profit)", 100, True, True),
}
_SHARE["delta_percent_system_profit"] = _SHARE["percent_system_profit"] + " - " + _double(
    "(system_profit - delta_system_profit)",
    "(system_profit - delta_system_profit + profit - delta_profit)",
    100,
    True,
    True,
)
_FILLED = (
    "CASE WHEN block_shows > 0 THEN CAST((block_shows - block_shows_empty) * 100 AS DOUBLE) "
    "/ CAST(block_shows AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS effective_block_shows_pc"
)


def total_sql(facts: Facts, by_publisher: bool = False, where: str = "true") -> str:
    additive = ("profit", "system_profit") + COUNTERS
    sums = [f"coalesce(sum({n}), 0) AS {n}" for a in additive for n in (a, f"delta_{a}", f"{a}_base")]
    sums.append("coalesce(sum(block_shows_empty), 0) AS block_shows_empty")
    shown = [figure(n) for a in additive for n in (a, f"delta_{a}")]
    for name, num, den, factor in RATIOS[:-1]:
        money = num == "profit"
        base = _double(f"{num}_base", f"{den}_base", factor, money)
        before = _double(f"({num}_base - delta_{num})", f"({den}_base - delta_{den})", factor, money)
        shown += [f"{_double(num, den, factor, money)} AS {name}", f"{base} - {before} AS delta_{name}"]
    shown += [f"{sql} AS {name}" for name, sql in _SHARE.items()]
    shown.append(_FILLED)
    return f"""{report_ctes(facts, by_publisher, where)},
totals AS (SELECT {', '.join(sums)} FROM report)
SELECT {', '.join(shown)} FROM totals"""


def page_total_sql(facts: Facts, by_publisher: bool, order: str, items: int, offset: int) -> str:
    names = [n for f in COMPARED_FIGURES for n in (f, f"delta_{f}")]
    names += ["block_shows_empty", "id", "user_id"] + ([] if by_publisher else ["site_id"])
    sums = [f"coalesce(sum({n}), 0) AS {n}" for n in names]
    shown = [figure(n) for a in ("profit", "system_profit") + COUNTERS for n in (a, f"delta_{a}")]
    shown += [figure("block_shows_empty"), figure("buy_cpm"), figure("delta_buy_cpm")]
    shown += ["CAST(id AS BIGINT) AS id", "CAST(user_id AS BIGINT) AS user_id"]
    shown += [] if by_publisher else ["CAST(site_id AS BIGINT) AS site_id"]
    shown += ["CAST(0 AS DOUBLE) AS name", "0 AS is_disabled", "0 AS is_exchanger"]
    for name, num, den, factor in RATIOS[:-1]:
        if name == "buy_cpm":
            continue
        money = num == "profit"
        before = _double(f"({num} - delta_{num})", f"({den} - delta_{den})", 1, money)
        change = f"({_double(num, den, 1, money)} - {before}) * CAST({factor} AS DOUBLE)"
        shown += [f"{_double(num, den, factor, money)} AS {name}", f"{change} AS delta_{name}"]
    shown += [f"{sql} AS {name}" for name, sql in _SHARE.items()]
    shown.append(_FILLED)
    return f"""{page_ctes(facts, by_publisher, order, items, offset)},
totals AS (SELECT {', '.join(sums)} FROM page)
SELECT {', '.join(shown)} FROM totals"""
