"""SQL for DuckDB that computes each registered query in another way."""

from __future__ import annotations

from checks import sell_sql as sell
from checks.queries import ABBREVIATIONS, CYRILLIC, LATIN
from checks.sell_sql import EVENT_DAYS, EVENTS, LINES, ORDERS, rows_sql

_MARKED = (
    "(CASE WHEN exists(SELECT 1 FROM user_marks m WHERE m.user_id = spine_all.user_id "
    "AND m.source = 's1' AND m.ad = 'a1') THEN true ELSE false END)"
)
_MANAGED = "user_id IN (SELECT user_id FROM user_managers WHERE manager_id IN ({}))"
_USER_MANAGERS = """,
user_managers AS (SELECT CAST(n_nationkey AS BIGINT) AS user_id, n_nationkey % 5 AS manager_id FROM nation)"""
_LOOKBACK = (
    "site_id {} (SELECT site_id FROM day_sell WHERE day >= DATE '1997-01-01' AND day < DATE '1997-03-01')"
)
_CATEGORIES = """,
site_categories AS (
    SELECT DISTINCT l_suppkey AS site_id, p_type AS category_id FROM lineitem JOIN part ON p_partkey = l_partkey)"""
_GROUPS = """
groups AS (SELECT r_regionkey AS group_id, CASE r_regionkey WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 1
    WHEN 4 THEN 3 END AS parent_id FROM region)"""

_THEMES = """
themes AS (
    SELECT l_suppkey AS site_id, 'news' AS family, p_brand AS theme_id, max(l_discount) > 0.05 AS is_filtered
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL
    UNION ALL
    SELECT l_suppkey, 'user', p_type, max(l_discount) > 0.05
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
theme_counts AS (
    SELECT site_id,
        count(*) FILTER (family = 'news' AND NOT is_filtered) AS news_themes_not_filtered,
        count(*) FILTER (family = 'news') AS news_themes_total,
        count(*) FILTER (family = 'user' AND NOT is_filtered) AS user_themes_not_filtered,
        count(*) FILTER (family = 'user') AS user_themes_total
    FROM themes GROUP BY site_id)"""
_BLOCKED = """
blocked AS (
    SELECT l_suppkey AS site_id, count(DISTINCT o_custkey) AS filtered_buyers
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' GROUP BY l_suppkey)"""


def _spine_sql() -> str:
    texts = ("user_id", "country_id", "min_teaser_rating", "subsystem_id")
    flags = ("is_exchanger", "is_disabled")
    shown = [f"CAST({name} AS VARCHAR) AS {name}" for name in texts]
    shown += [f"CAST(CAST({name} AS INTEGER) AS VARCHAR) AS {name}" for name in flags]
    return (
        f"{sell.report_ctes(ORDERS)}\n"
        f"SELECT site_id, site_name, site_url, profit_type, email, {', '.join(shown)} FROM spine"
    )


def _panel_sql() -> str:
    counts = (
        "news_themes_not_filtered",
        "news_themes_total",
        "user_themes_not_filtered",
        "user_themes_total",
        "filtered_buyers",
    )
    shown = ", ".join(f"coalesce({name}, 0) AS {name}" for name in counts)
    page = sell.page_ctes(LINES, False, "profit DESC, r.id", 50, 0)
    return f"""{page},{_THEMES},{_BLOCKED}
SELECT page.id, page.site_id, shown_name AS name, page.user_id, CAST(is_disabled AS INTEGER) AS is_disabled,
    CAST(is_exchanger AS INTEGER) AS is_exchanger, {sell.all_figures()}, {shown},
    CAST(sites.min_teaser_rating AS VARCHAR) AS min_teaser_rating,
    CAST(sites.min_ad_price AS DOUBLE) AS min_ad_price,
    CAST(sites.buyer_target AS VARCHAR) AS buyer_target
FROM page LEFT JOIN sites ON sites.id = page.id LEFT JOIN theme_counts ON theme_counts.site_id = page.id
LEFT JOIN blocked ON blocked.site_id = page.id"""


_WEEKEND = """
WITH custom AS (SELECT * FROM (VALUES (DATE '1997-03-08', true), (DATE '1997-03-10', false),
    (DATE '1998-01-01', false), (DATE '1998-01-03', true)) AS t(day, is_workday)),
days AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(sum(100 + o_orderkey % 900) AS BIGINT) AS src_shows
    FROM orders GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, src_shows,
    CASE WHEN custom.is_workday THEN 0 WHEN NOT custom.is_workday THEN 1
        WHEN dayofweek(day) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend
FROM days LEFT JOIN custom USING (day)"""

_EXCHANGE = """
daily AS (
    SELECT user_id, CAST(ts AS DATE) AS date,
        count(*) FILTER (event_type = 'view') AS src_shows,
        count(*) FILTER (event_type = 'click') AS src_clicks,
        count(*) FILTER (event_type = 'signup') AS buy_shows,
        count(*) FILTER (event_type = 'purchase') AS buy_clicks,
        count(*) AS in_shows,
        count(*) FILTER (event_type IN ('click', 'purchase')) AS in_clicks,
        count(*) FILTER (event_type = 'error') AS debt
    FROM events
    WHERE user_id IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0)
    GROUP BY ALL),
rated AS (
    SELECT *, CASE WHEN src_clicks > 0 THEN CAST(buy_clicks AS DOUBLE) / CAST(src_clicks AS DOUBLE)
            ELSE CAST(0 AS DOUBLE) END AS tier_ratio,
        CASE WHEN src_clicks > 0 THEN CAST(debt AS DOUBLE) / CAST(src_clicks AS DOUBLE)
            ELSE CAST(0 AS DOUBLE) END AS calc_exchange_ratio
    FROM daily)"""
_WEEK = "date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'"
_LAST_WEEK = "date BETWEEN DATE '2024-01-01' AND DATE '2024-01-07'"
_EXCHANGE_COUNTS = ("src_shows", "src_clicks", "buy_shows", "buy_clicks", "in_shows", "in_clicks", "debt")


def _click_rate(side: str) -> str:
    shows, clicks = f"{side}_shows", f"{side}_clicks"
    return (
        f"CASE WHEN {shows} <> 0 THEN CAST(100 AS DOUBLE) * CAST({clicks} AS DOUBLE) / CAST({shows} AS DOUBLE) "
        f"ELSE CAST(0 AS DOUBLE) END"
    )


_EXCHANGE_METRICS = ", ".join(f"{_click_rate(side)} AS {side}_ctr" for side in ("src", "buy", "in"))
_EXCHANGE_METRICS += ", in_clicks - debt AS exchange_delta"
_EXCHANGE_SUMS = ", ".join(f"CAST(sum({name}) AS BIGINT) AS {name}" for name in _EXCHANGE_COUNTS)
_TOTAL_RATIOS = (
    "CASE WHEN src_clicks > 0 THEN CAST(buy_clicks AS DOUBLE) / CAST(src_clicks AS DOUBLE) "
    "ELSE CAST(0 AS DOUBLE) END AS tier_ratio, "
    "CASE WHEN src_clicks > 0 THEN CAST(debt AS DOUBLE) / CAST(src_clicks AS DOUBLE) "
    "ELSE CAST(0 AS DOUBLE) END AS calc_exchange_ratio"
)

_EXCHANGE_TOTAL = f"""
WITH {_EXCHANGE},
sums AS (SELECT user_id, {_EXCHANGE_SUMS} FROM rated WHERE {_WEEK} GROUP BY user_id)
SELECT *, {_TOTAL_RATIOS}, {_EXCHANGE_METRICS} FROM sums"""

_RATIO_SUMS = ", ".join(
    f"round(sum({name}), 6) AS {name}"
    for name in ("src_ctr", "buy_ctr", "in_ctr", "tier_ratio", "calc_exchange_ratio")
)
_EXCHANGE_SCREEN_TOTAL = f"""
WITH {_EXCHANGE},
week AS (SELECT *, {_EXCHANGE_METRICS} FROM rated WHERE {_WEEK})
SELECT user_id, 0 AS date, {_EXCHANGE_SUMS}, {_RATIO_SUMS},
    CAST(sum(exchange_delta) AS BIGINT) AS exchange_delta
FROM week GROUP BY user_id"""


def _four_decimals(numerator: str, denominator: str) -> str:
    """A ratio rounded half up to four decimals, as text, without floating point."""
    scaled = f"(2 * ({numerator}) * 10000 + {denominator}) // (2 * {denominator})"
    digits = f"CASE WHEN {denominator} = 0 THEN 0 ELSE {scaled} END"
    return f"(({digits}) // 10000) || '.' || lpad(CAST(({digits}) % 10000 AS VARCHAR), 4, '0')"


def _export_sql() -> str:
    whole = {
        "Source Shows": "src_shows",
        "Source Clicks": "src_clicks",
        "Advertisers Shows": "buy_shows",
        "Advertisers Clicks": "buy_clicks",
        "Ads Shows": "in_shows",
        "Ads Clicks": "in_clicks",
        "Debt": "debt",
        "Exchange delta": "in_clicks - debt",
    }
    rates = {
        "Source CTR": ("100 * src_clicks", "src_shows"),
        "Advertisers CTR": ("100 * buy_clicks", "buy_shows"),
        "Ads CTR": ("100 * in_clicks", "in_shows"),
        "TP ratio": ("buy_clicks", "src_clicks"),
        "Exchange ratio": ("debt", "src_clicks"),
    }
    shown = [f'CAST({sql} AS VARCHAR) AS "{name}"' for name, sql in whole.items()]
    shown += [f'{_four_decimals(*pair)} AS "{name}"' for name, pair in rates.items()]
    return f"""
WITH {_EXCHANGE},
week AS (SELECT * FROM rated WHERE {_WEEK}),
both_kinds AS (
    SELECT user_id, strftime(date, '%Y-%m-%d') AS row_order, strftime(date, '%d.%m.%Y') AS label,
        {', '.join(_EXCHANGE_COUNTS)} FROM week
    UNION ALL
    SELECT user_id, 'total', 'Total', {_EXCHANGE_SUMS} FROM week GROUP BY user_id)
SELECT user_id, row_order, label AS "Date", {', '.join(shown)} FROM both_kinds"""


def _accounts() -> str:
    def party(table: str, kind: str, first: int, key: str, balance: str, site: str) -> str:
        src = f"CAST({key} AS VARCHAR)" if kind == "seller" else "NULL"
        return f"""
    SELECT {key} + {first} AS id, '{kind}' AS user_type, '{kind}' || {key} || '@example.com' AS email,
        'sub' || {key} % 4 AS subsystem, {site} AS site, {src} AS src_id, 'country' || {key} % 10 AS country,
        'Z' || lpad(CAST({key} AS VARCHAR), 12, '0') AS webmoney, 'status' || {key} % 3 AS crm_status,
        's' || {key} % 3 AS source, 'c' || {key} % 2 AS campaign, 'm' || {key} % 4 AS medium,
        'a' || {key} % 6 AS ad, {key} % 5 AS manager_id, CAST({balance} AS DECIMAL(16,2)) AS balance
    FROM {table}"""

    parties = [
        party("region", "agent", 0, "r_regionkey", "0", "NULL"),
        party("customer", "buyer", 10**12, "c_custkey", "c_acctbal", "NULL"),
        party("supplier", "seller", 2 * 10**12, "s_suppkey", "s_acctbal", "'https://s' || s_suppkey || '.example.com'"),
        party("nation", "exchanger", 3 * 10**12, "n_nationkey", "0", "NULL"),
    ]
    return "\naccounts AS (" + " UNION ALL ".join(parties) + ")"


_FACETS = "count(*) AS accounts, CAST(coalesce(sum(balance), 0) AS DOUBLE) AS balance"


def _listed(column: str, key: str) -> str:
    """The Russian spelling the queries derive, with the same three ways of capitals."""
    lower, upper = CYRILLIC, CYRILLIC.upper()
    return (
        f"CASE {key} % 3 WHEN 0 THEN translate({column}, '{LATIN}{LATIN.upper()}-', '{lower}{upper}/') "
        f"WHEN 1 THEN translate({column}, '{LATIN}{LATIN.upper()}-', '{upper}{upper}/') "
        f"ELSE translate({column}, '{LATIN}-', '{upper}/') END"
    )


_LONG = {"ё": "jo", "ж": "zh", "ч": "ch", "ш": "sh", "щ": "shch", "э": "eh", "ю": "yu", "я": "ya"}


def _latin_sql() -> str:
    """Splits a text into runs of capitals with a long spelling and the parts between them.

    A run is decided by the characters around it; only its last letter looks ahead.
    """
    single = "абвгдезийклмнопрстуфхцъыь"
    spelled = "abvgdezijklmnoprstufhc\"y''"
    latin = f"translate(t, '{single}{single.upper()} ', '{spelled}{spelled.upper()}_')"
    for letter, out in _LONG.items():
        latin = f"replace({latin}, '{letter}', '{out}')"
    long_capitals = "".join(_LONG).upper()

    def in_form(value: str, form) -> str:
        for letter, out in _LONG.items():
            value = f"replace({value}, '{letter.upper()}', '{form(out)}')"
        return value

    before = "regexp_matches(parts[i - 1], '[A-Z]$')"
    after = "regexp_matches(parts[i + 1], '^[A-Z]')"
    last = in_form("right(parts[i], 1)", str.upper)
    rest = in_form("left(parts[i], length(parts[i]) - 1)", str.capitalize)
    return f"""
WITH russian AS (SELECT doc_id, {_listed('text', 'doc_id')} AS t FROM documents),
cut AS (SELECT doc_id,
    regexp_extract_all({latin}, '[{long_capitals}]+|[^{long_capitals}]+') AS parts FROM russian),
spelled AS (SELECT doc_id, list_transform(range(1, len(parts) + 1), lambda i:
    CASE WHEN NOT regexp_matches(parts[i], '^[{long_capitals}]') THEN parts[i]
        WHEN i > 1 AND {before} THEN {in_form('parts[i]', str.upper)}
        WHEN i < len(parts) AND {after} THEN {rest} || {last}
        ELSE {in_form('parts[i]', str.capitalize)} END) AS parts FROM cut)
SELECT doc_id, regexp_replace(array_to_string(parts, ''), '[^a-zA-Z0-9_.]', '', 'g') AS latin FROM spelled"""


def _title_sql() -> str:
    """Works on the words of a text: the derived texts have no hyphens inside words."""
    words = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
    kept = {"кв. м.": "кв. м.", "кв.м.": "кв.м.", "леди ю": "Леди Ю", "мин. от": "мин. от", "СПБ": "СПб", "СПбГУ": "СПбГУ"}
    guarded, restored = "t", "t"
    for phrase, shown in kept.items():
        dotted = phrase.replace(".", "&dote;")
        guarded = f"regexp_replace({guarded}, '(?i){phrase.replace('.', chr(92) + '.')}', '{dotted}', 'g')"
        restored = f"regexp_replace({restored}, '(?i){dotted}', '{shown}', 'g')"
    listed = ", ".join(f"'{word}'" for word in ABBREVIATIONS)
    blanks = "' ' || chr(9) || chr(10) || chr(13) || chr(0)"
    space = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    return f"""
WITH russian AS (SELECT doc_id, {_listed('text', 'doc_id')} AS t FROM documents),
spaced AS (SELECT doc_id, regexp_replace(t, '{space}{space}+', ' ', 'g') AS t FROM russian),
one_mark AS (SELECT doc_id, CASE WHEN instr(t, '!') > 0 THEN
    left(t, instr(t, '!')) || replace(substr(t, instr(t, '!') + 1), '!', '.') ELSE t END AS t FROM spaced),
guarded AS (SELECT doc_id, trim({guarded}, {blanks}) AS t FROM one_mark),
edges AS (SELECT doc_id, CASE WHEN right(t, 2) = '..' THEN t ELSE trim(t, '.') END AS t FROM guarded),
words AS (SELECT doc_id, regexp_extract_all(t, '{words}') AS w FROM edges),
lowered AS (SELECT doc_id, list_transform(w, lambda x:
    CASE WHEN regexp_full_match(x, '[А-ЯЁ]{{2,}}') THEN lower(x) ELSE x END) AS w FROM words),
listed AS (SELECT doc_id, array_to_string(list_transform(w, lambda x:
    CASE WHEN upper(x) IN ({listed}) THEN upper(x) ELSE x END), '') AS t FROM lowered),
first AS (SELECT doc_id, regexp_extract(t, '^["«]?[^\\n]') AS f, t FROM listed),
capital AS (SELECT doc_id, upper(f) || substr(t, length(f) + 1) AS t FROM first)
SELECT doc_id, {restored} AS title FROM capital"""


def _encoded(value: str) -> str:
    return f"replace(replace(url_encode({value}), '%20', '+'), '~', '%7E')"


_UNSAFE = r"[^a-zA-Z0-9\-_.~%?:/#=&@*\[\]{}|!]"

_ENCODE_URLS = f"""
WITH given AS (SELECT page_id, url || 'é*=1' AS u FROM pages),
parts AS (SELECT page_id, regexp_extract(u, '^(https?://[^/?#]*)([^?#]*)(\\??[^#]*)(#?.*)$',
    ['head', 'path', 'query', 'fragment']) AS p FROM given)
SELECT page_id, p.head
    || CASE WHEN regexp_matches(p.path, '{_UNSAFE}') THEN replace({_encoded('p.path')}, '%2F', '/') ELSE p.path END
    || CASE WHEN regexp_matches(p.query, '{_UNSAFE}') THEN '?' || {_encoded('substr(p.query, 2)')} ELSE p.query END
    || p.fragment AS encoded FROM parts"""

_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"
_CLEAN_NUMBERS = f"""
WITH given AS (SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag,
    chr(9) || ' ' || l_orderkey || ' ' || l_suppkey || ',' || l_linenumber || ' ' || l_returnflag AS v FROM lineitem),
compact AS (SELECT *, replace(trim(v, ' ' || chr(9)), ' ', '') AS c FROM given)
SELECT l_orderkey, l_partkey, l_linenumber,
    coalesce(TRY_CAST(regexp_extract(replace(c, ',', '.'), '{_NUMBER}') AS DOUBLE), CAST(0 AS DOUBLE)) AS as_float,
    coalesce(TRY_CAST(regexp_extract(c, '^[+-]?[0-9]+') AS BIGINT), 0) AS as_int,
    CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 0 ELSE 1 END AS as_boolean
FROM compact"""

_CLEAN_URL = r"""
WITH pasted AS (SELECT page_id, trim(CASE page_id % 6 WHEN 0 THEN 'http://' || url WHEN 1 THEN upper(url)
    WHEN 2 THEN regexp_replace(url, '^https?://', ' ') WHEN 3 THEN regexp_replace(url, '^https?', 'ftp')
    WHEN 4 THEN regexp_replace(url, '^(https?://).*', '\1') ELSE url END) AS u FROM pages),
single AS (SELECT page_id, regexp_replace(u, '^(?is)(?:https?://)+(http.*)$', '\1') AS u FROM pasted),
cut AS (SELECT page_id, u, instr(u, '://') AS place, left(u, instr(u, '://') - 1) AS scheme,
    substr(u, instr(u, '://') + 3) AS rest FROM single)
SELECT page_id, CASE WHEN u IN ('', '0') THEN NULL WHEN place = 0 THEN 'http://' || u
    WHEN rest IN ('', '0') THEN NULL WHEN lower(scheme) IN ('http', 'https') THEN lower(scheme) || '://' || rest
    ELSE 'http://' || u END AS cleaned FROM cut"""

_ACCESS_LOG = """
log AS (SELECT event_id, '192.0.2.' || user_id % 250 AS remote,
    CASE WHEN event_id % 300 <= 255 THEN '10.' || user_id % 256 || '.' || event_id % 300 || '.7' END AS address,
    event_id % 7 <> 0 AS is_trusted, event_id % 5 AS shape,
    '/' || event_type || '/' || user_id || '?p=' || props AS uri FROM events)"""
_FIRST_IPV4 = f"""
WITH {_ACCESS_LOG}
SELECT event_id, CASE WHEN is_trusted AND shape <= 1 AND address IS NOT NULL THEN address || '/' || remote
    WHEN is_trusted AND shape = 2 THEN coalesce(address, '8.8.8.8') || '/' || remote
    ELSE remote END AS visitor_ip FROM log"""

_BYTES = """
WITH sized AS (SELECT doc_id, CAST(n_chars * n_chars * doc_id AS DOUBLE) AS size FROM documents),
powered AS (SELECT *, CASE WHEN size > 0 THEN CAST(floor(ln(size) / ln(CAST(1024 AS DOUBLE))) AS INTEGER) END AS p
    FROM sized)
SELECT doc_id, CASE WHEN size = 0 THEN '0' ELSE
    regexp_replace(CAST(round(size / pow(1024, p), 2) AS VARCHAR), '\\.0$', '')
    || ' ' || (['B', 'KB', 'MB', 'GB', 'TB', 'PB', 'EB', 'ZB', 'YB'])[p + 1] END AS shown FROM powered"""

_JSON = r"""
WITH given AS (SELECT page_id, url, html, '&foo;&apos;&copy;&#x110000;&#65;<' || page_id AS marks FROM pages),
marked AS (SELECT page_id, marks, [regexp_replace(regexp_replace(x,
    '&(amp|lt|gt|quot|nbsp|copy|middot|reg|eacute|mdash|ndash|hellip|euro);', chr(1) || '\1;', 'g'),
    '&(#[0-9]{1,6}|#[xX][0-9a-fA-F]{1,5});', chr(1) || '\1;', 'g') for x in [url, html, marks]] AS m FROM given),
escaped AS (SELECT page_id, [replace(replace(replace(replace(replace(replace(x, '&', '&amp;'), chr(1), '&'),
    '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') for x in m] AS e FROM marked)
SELECT CAST(to_json({'page_id': page_id, 'url': e[1], 'html': e[2], 'named': {'k': e[3]}, 'listed': [e[3], '&lt;']}) AS VARCHAR) AS json
FROM escaped"""

_HOSTS = """
WITH names AS (SELECT unnest(['straße', 'bücher', 'été', 'пример']) AS name,
    unnest(['xn--strae-oqa', 'xn--bcher-kva', 'xn--t-9fab', 'xn--e1afmkfd']) AS code, unnest([0, 1, 2, 3]) AS place),
given AS (SELECT page_id, name, code,
    '.example.com' || CASE WHEN page_id % 2 = 0 THEN ':8080' ELSE '' END || '/p' || page_id AS tail
    FROM pages JOIN names ON place = page_id % 4)"""

_REFERRAL = """
WITH visits AS (SELECT event_id AS visit_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id FROM events),
asked AS (SELECT visit_id, CASE WHEN k % 4 = 0 THEN 0 ELSE k END AS ref_id, user_id AS cookie_ref_id FROM visits)
SELECT visit_id, ref_id, cookie_ref_id, CAST(CASE WHEN ref_id = 0 THEN cookie_ref_id
    WHEN ref_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN ref_id END AS VARCHAR) AS referrer_id
FROM asked"""

_SUM_BY_KEYS = """
WITH pairs AS (
    SELECT event_type AS key, CAST(user_id AS DOUBLE) AS value FROM events
    UNION ALL SELECT 'event', event_id + CAST(0.5 AS DOUBLE) FROM events
    UNION ALL SELECT 'props', CAST(0 AS DOUBLE) FROM events)
SELECT key, sum(value) AS total FROM pairs GROUP BY key"""


def oracle_sql() -> dict[str, str]:
    by_id = "profit DESC, r.id"
    return {
        "spine_sites": _spine_sql(),
        "sell_by_site": rows_sql(ORDERS),
        "sell_by_site_lines": rows_sql(LINES),
        "sell_by_publisher": rows_sql(ORDERS, True),
        "sell_page": sell.page_sql(ORDERS, False, by_id, 50, 50),
        "sell_page_by_name": sell.page_sql(ORDERS, False, "r.name DESC NULLS FIRST, r.id", 50, 0),
        "sell_publisher_page": sell.page_sql(ORDERS, True, "src_ctr, r.id", 10, 0),
        "sell_total": sell.total_sql(ORDERS),
        "sell_count": f'{sell.report_ctes(ORDERS)} SELECT count(*) AS "rows" FROM report',
        "sell_page_total": sell.page_total_sql(ORDERS, False, by_id, 50, 50),
        "sum_by_keys": _SUM_BY_KEYS,
        "sum_by_columns": """
SELECT CAST(sum(o_orderkey) AS BIGINT) AS o_orderkey, CAST(sum(o_custkey) AS BIGINT) AS o_custkey,
    CAST(sum(CAST(o_totalprice AS DECIMAL(16,2))) AS DOUBLE) AS o_totalprice, 0 AS o_orderdate,
    CAST(sum(CASE WHEN regexp_full_match(o_orderpriority, '[0-9]+') THEN CAST(left(o_orderpriority, 1) AS DOUBLE) ELSE 0 END) AS DOUBLE) AS o_orderpriority,
    CAST(sum(CASE WHEN o_orderstatus = 'F' THEN o_orderkey ELSE 0 END) AS DOUBLE) AS o_orderstatus, 0 AS is_open
FROM orders""",
        "sell_by_site_cumulative": rows_sql(ORDERS),
        "publisher_status_new_cumulative": rows_sql(ORDERS, where=_LOOKBACK.format("NOT IN")),
        "filter_country_cumulative": rows_sql(ORDERS, where="country_id = 3"),
        "sell_by_site_late_hours": rows_sql(EVENTS),
        "filter_site_indexed": rows_sql(ORDERS, where="site_url LIKE '%c12%'"),
        "filter_user_indexed": rows_sql(ORDERS, where="email ILIKE '%nation\\_1%' ESCAPE '\\'"),
        "distinct_buyers_window": """
SELECT l_suppkey AS site_id, count(DISTINCT l_partkey) AS buyers FROM lineitem
WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1997-03-31' GROUP BY l_suppkey""",
        "search_url_part": "SELECT page_id, url FROM pages WHERE lower(url) LIKE '%ample.org/en%'",
        "sell_by_site_today": rows_sql(EVENTS),
        "sell_publisher_count": f"""{sell.report_ctes(ORDERS, True)}
SELECT count(*) AS rows FROM report""",
        "sell_page_total_today": sell.page_total_sql(EVENTS, False, by_id, 50, 0),
        "sell_by_site_last_days": rows_sql(EVENT_DAYS),
        "sell_by_publisher_today": rows_sql(EVENTS, True),
        "sell_total_today": sell.total_sql(EVENTS),
        "filter_country": rows_sql(ORDERS, where="country_id = 3"),
        "filter_subsystem": rows_sql(ORDERS, where="subsystem_id = 2"),
        "filter_exchanger": rows_sql(ORDERS, where="is_exchanger"),
        "filter_not_exchanger": rows_sql(ORDERS, where="NOT is_exchanger"),
        "filter_user": rows_sql(ORDERS, where="email ILIKE '%nation\\_1%' ESCAPE '\\'"),
        "filter_user_id": rows_sql(ORDERS, where="user_id = 7"),
        "filter_user_exact": rows_sql(ORDERS, where="email = 'nation_11@example.com'"),
        "filter_network": rows_sql(ORDERS, where="email LIKE '@pre@%'"),
        "filter_site": rows_sql(ORDERS, where="site_url LIKE '%c12%'"),
        "filter_marks": rows_sql(ORDERS, where=_MARKED, extra="," + sell.MARKS),
        "filter_profit_type": rows_sql(ORDERS, where="profit_type IN ('BUILDING', 'MACHINERY')"),
        "filter_rating": rows_sql(ORDERS, where="min_teaser_rating IN (1, 4) OR min_teaser_rating IS NULL"),
        "filter_category": rows_sql(
            LINES,
            where="site_id IN (SELECT site_id FROM site_categories WHERE category_id IN ('PROMO', 'SMALL'))",
            extra=_CATEGORIES,
        ),
        "filter_managers": rows_sql(ORDERS, where=_MANAGED.format("0, 3"), extra=_USER_MANAGERS),
        "filter_manager_scoped": rows_sql(ORDERS, where=_MANAGED.format("4"), extra=_USER_MANAGERS),
        "filter_group_empty_keeps_scope": rows_sql(ORDERS, where=_MANAGED.format("3"), extra=_USER_MANAGERS),
        "filter_no_scope": rows_sql(ORDERS),
        "filter_empty_fields": rows_sql(ORDERS),
        "publisher_status_new": rows_sql(ORDERS, where=_LOOKBACK.format("NOT IN")),
        "publisher_status_current": rows_sql(ORDERS, where=_LOOKBACK.format("IN")),
        "manager_group_tree": f"""WITH RECURSIVE {_GROUPS},
below AS (SELECT group_id FROM groups WHERE group_id = 1
    UNION ALL SELECT g.group_id FROM below JOIN groups g ON g.parent_id = below.group_id),{_accounts()}
SELECT manager_id, user_type, count(*) AS accounts FROM accounts
WHERE manager_id IN (SELECT r_regionkey FROM region WHERE r_regionkey IN (SELECT group_id FROM below))
GROUP BY manager_id, user_type""",
        "page_panel": _panel_sql(),
        "theme_counts": f"WITH {_THEMES} SELECT * FROM theme_counts",
        "blocked_buyers": f"WITH {_BLOCKED} SELECT * FROM blocked",
        "weekend_calendar": _WEEKEND,
        "avail_months": "SELECT DISTINCT strftime(date_trunc('month', o_orderdate), '%Y-%m-01') AS period FROM orders",
        "exchange_by_date": f"""WITH {_EXCHANGE}
SELECT * REPLACE (strftime(date, '%Y-%m-%d') AS date), {_EXCHANGE_METRICS} FROM rated WHERE {_WEEK}""",
        "exchange_prev": f"""WITH {_EXCHANGE}
SELECT * REPLACE (strftime(date, '%Y-%m-%d') AS date), strftime(date + 7, '%Y-%m-%d') AS compared_date
FROM rated WHERE {_LAST_WEEK}""",
        "exchange_total": _EXCHANGE_TOTAL,
        "exchange_screen_total": _EXCHANGE_SCREEN_TOTAL,
        "exchange_export": _export_sql(),
        "search_facets": f"""WITH {_accounts()}
SELECT user_type, {_FACETS} FROM accounts WHERE lower(email) LIKE '%r1%' AND campaign = 'c1' GROUP BY user_type""",
        "search_zero_subsystem": f"""WITH {_accounts()}
SELECT user_type, {_FACETS} FROM accounts WHERE lower(email) LIKE '%r1%' GROUP BY user_type""",
        "search_page": f"""WITH {_accounts()}
SELECT id, user_type, email, CAST(balance AS DOUBLE) AS balance,
    row_number() OVER (PARTITION BY user_type ORDER BY email, id) AS position
FROM accounts WHERE country = 'country3' AND source = 's0' QUALIFY position <= 100""",
        "search_type_page": f"""WITH {_accounts()}
SELECT id, email, CAST(balance AS DOUBLE) AS balance FROM accounts
WHERE user_type = 'buyer' AND crm_status = 'status1' AND medium = 'm1'
ORDER BY accounts.balance DESC, id LIMIT 50 OFFSET 50""",
        "search_totals": f"""WITH {_accounts()}
SELECT user_type, {_FACETS}, CAST(ceil(count(*) / 50) AS BIGINT) AS pages FROM accounts
WHERE user_type = 'buyer' AND medium = 'm2' GROUP BY user_type HAVING ceil(count(*) / 50) > 1""",
        "search_page_counts": f"""WITH {_accounts()}
SELECT user_type, {_FACETS}, CAST(ceil(count(*) / 50) AS BIGINT) AS pages FROM accounts
WHERE lower(email) LIKE '%e%' AND country = 'country7' GROUP BY user_type""",
        "search_scope": f"""WITH {_accounts()}
SELECT user_type, {_FACETS} FROM accounts WHERE country = 'country3' AND manager_id IN (3, 4) GROUP BY user_type""",
        "clean_numbers": _CLEAN_NUMBERS,
        "clean_url": _CLEAN_URL,
        "cyr_to_latin": _latin_sql(),
        "bytes_human": _BYTES,
        "first_ipv4": _FIRST_IPV4,
        "script_name": f"WITH {_ACCESS_LOG} SELECT event_id, split_part(uri, '?', 1) AS script FROM log",
        "sanitize_title": _title_sql(),
        "sanitize_title_table": """
SELECT p_partkey, 'X ' || upper(CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN p_type || '-' || p_brand
    ELSE p_type || '.$' || p_brand END) || ' y' AS title FROM part WHERE p_type IS NOT NULL""",
        "sanitize_title_overlapping": """
WITH given AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS w FROM part WHERE p_name IS NOT NULL),
entries AS (SELECT DISTINCT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM given WHERE p_partkey % 3 = 0)),
words AS (SELECT p_partkey, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM given),
around AS (SELECT *, lag(word) OVER p AS before, lead(word) OVER p AS after FROM words WINDOW p AS (PARTITION BY p_partkey ORDER BY i)),
marked AS (SELECT p_partkey, i, word, x.a IS NOT NULL AS opens, y.a IS NOT NULL AS ends FROM around
    LEFT JOIN entries x ON word = x.a AND after = x.b LEFT JOIN entries y ON before = y.a AND word = y.b)
SELECT p_partkey, '0 ' || string_agg(CASE WHEN opens OR ends THEN upper(word) ELSE word END, '-' ORDER BY i) AS title
FROM marked GROUP BY p_partkey""",
        "clear_prefix_suffix": """
WITH given AS (SELECT c_custkey, c_custkey % 4 = 0 AS pre, c_custkey % 3 = 0 AS suf, lower(c_mktsegment) AS name
    FROM customer)
SELECT c_custkey, name || CASE WHEN suf THEN '@suffix' ELSE '@example.com' END AS no_prefix,
    CASE WHEN pre THEN '@pre@' ELSE '' END || name || CASE WHEN suf THEN '' ELSE '@example.com' END AS no_suffix,
    CASE WHEN pre THEN '@pre@' ELSE '' END || name
        || CASE WHEN suf THEN '@suffix' ELSE '@example.com' END AS same FROM given""",
        "traffic_tag": """
SELECT p_partkey, replace(p_name, ' ', '_')
    || CASE WHEN p_size % 3 = 0 THEN '-' || p_partkey ELSE '' END AS main_part FROM part""",
        "smart_encode": f"""
SELECT doc_id, CASE WHEN regexp_matches(text, '{_UNSAFE}') THEN replace({_encoded('text')}, '%2F', '/')
    ELSE text END AS encoded FROM documents""",
        "smart_encode_urls": _ENCODE_URLS,
        "smart_decode": "SELECT doc_id, text AS decoded FROM documents",
        "smart_encode_hosts": f"{_HOSTS} SELECT page_id, 'http://' || code || tail AS encoded FROM given",
        "smart_decode_hosts": f"{_HOSTS} SELECT page_id, 'http://' || name || tail || ' é' AS decoded FROM given",
        "smart_trim": r"""
SELECT doc_id, trim(regexp_replace(text, '[\x00-\x20\x{A0}]+', ' ', 'g')) AS squeezed FROM documents""",
        "referral_attribution": _REFERRAL,
        "json_rows": _JSON,
    }
