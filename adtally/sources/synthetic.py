"""Logical tables derived from the synthetic star schema the tests and benchmark run on.

Money goes through two-decimal decimals and is rounded to four decimals per row, so its sums
are exact and do not depend on the order of the rows.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adtally.functions.metrics import stored
from adtally.sources.tables import SellTables

FIRST_BUYER, FIRST_SELLER, FIRST_EXCHANGER = 10**12, 2 * 10**12, 3 * 10**12


@lru_cache(maxsize=128)
def raw(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table. Its files are looked at for their schema once per session."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def _cents(column: str) -> str:
    return f"CAST({column} AS DECIMAL(16,2))"


def _money(column: str, share: str = "1") -> str:
    return stored(f"{_cents(column)} * {share}")


def day_sell_from_orders(spark: SparkSession, root: str) -> DataFrame:
    return raw(spark, root, "orders").selectExpr(
        "o_custkey AS site_id",
        "CAST(o_orderdate AS DATE) AS day",
        "100 + o_orderkey % 900 AS src_shows",
        "o_orderkey % 50 AS src_clicks",
        "50 + o_orderkey % 450 AS buy_shows",
        "o_orderkey % 20 AS buy_clicks",
        "200 + o_orderkey % 300 AS block_shows",
        "o_orderkey % 100 AS block_shows_empty",
        f"{_money('o_totalprice', '0.60')} AS profit",
        f"{_money('o_totalprice')} AS buyers_expense",
        f"{_money('o_totalprice', '0.05')} AS parent_profit",
        f"{_money('o_totalprice', '0.03')} AS agent_profit",
    )


def day_sell_from_lineitem(spark: SparkSession, root: str) -> DataFrame:
    quantity = "CAST(l_quantity AS BIGINT)"
    return raw(spark, root, "lineitem").selectExpr(
        "l_suppkey AS site_id",
        "CAST(l_shipdate AS DATE) AS day",
        f"{quantity} * 100 AS src_shows",
        f"{quantity} + l_linenumber AS src_clicks",
        f"{quantity} * 40 AS buy_shows",
        f"{quantity} AS buy_clicks",
        f"{quantity} * 120 AS block_shows",
        f"{quantity} * l_linenumber AS block_shows_empty",
        f"{_money('l_extendedprice', '(1 - CAST(l_discount AS DECIMAL(4,2)))')} AS profit",
        f"{_money('l_extendedprice')} AS buyers_expense",
        f"{stored('0')} AS parent_profit",
        f"{_money('l_extendedprice', 'CAST(l_tax AS DECIMAL(4,2))')} AS agent_profit",
    )


def _event_sums(events: DataFrame, when: str) -> DataFrame:
    shares = {"profit": "0.60", "buyers_expense": "1", "parent_profit": "0.05", "agent_profit": "0.03"}
    sums = [
        "count_if(event_type = 'view') AS src_shows",
        "count_if(event_type = 'click') AS src_clicks",
        "count_if(event_type = 'signup') AS buy_shows",
        "count_if(event_type = 'purchase') AS buy_clicks",
        "count(*) AS block_shows",
        "count_if(event_type = 'error') AS block_shows_empty",
    ]
    for name, share in shares.items():
        total = f"sum({_money('value', share)})"
        sums.append(f"{stored(total)} AS {name}")
    keys = (F.expr("user_id AS site_id"), F.expr(when))
    return events.groupBy(*keys).agg(*(F.expr(one) for one in sums))


def hour_sell_from_events(spark: SparkSession, root: str) -> DataFrame:
    hour = "CAST(date_trunc('HOUR', ts) AS TIMESTAMP_NTZ) AS hour"
    return _event_sums(raw(spark, root, "events"), hour).drop("block_shows_empty")


def day_sell_from_events(spark: SparkSession, root: str) -> DataFrame:
    """Events of little value never settle, so some sites have hour rows but no day row."""
    settled = raw(spark, root, "events").where("value >= 20")
    return _event_sums(settled, "CAST(ts AS DATE) AS day")


def _site_columns(key: str, letter: str, nation: str, profit_type: str, price: str) -> list[str]:
    return [
        f"{key} AS id",
        f"concat('https://{letter}', {key}, '.example.com') AS url",
        f"CAST({nation} AS BIGINT) AS seller_id",
        f"CAST({key} % 10 AS INT) AS country_id",
        f"{profit_type} AS profit_type",
        f"CAST(nullif({key} % 6, 0) AS INT) AS min_teaser_rating",
        f"{_money(price)} AS min_ad_price",
        f"slice(array(1L, 2L, 3L), 1, CAST({key} % 4 AS INT)) AS buyer_target",
    ]


def sites_from_customer(spark: SparkSession, root: str) -> DataFrame:
    """Customers in debt have no site any more, so some facts have no site."""
    columns = _site_columns("c_custkey", "c", "c_nationkey", "c_mktsegment", "c_acctbal")
    return raw(spark, root, "customer").where("c_acctbal >= 0").selectExpr("c_name AS name", *columns)


def sites_from_supplier(spark: SparkSession, root: str) -> DataFrame:
    columns = _site_columns("s_suppkey", "s", "s_nationkey", "'fixed'", "s_acctbal")
    return raw(spark, root, "supplier").selectExpr("s_name AS name", *columns)


def users_from_nation(spark: SparkSession, root: str) -> DataFrame:
    return raw(spark, root, "nation").selectExpr(
        "CAST(n_nationkey AS BIGINT) AS id",
        "concat(IF(n_nationkey % 4 = 0, '@pre@', ''), lower(n_name), '@example.com') AS email",
        "n_regionkey AS subsystem_id",
        "n_nationkey % 2 = 0 AS is_exchanger",
        "n_nationkey % 7 = 0 AS is_disabled",
    )


def user_marks_from_nation(spark: SparkSession, root: str) -> DataFrame:
    """Users of the first region have no marks."""
    return (
        raw(spark, root, "nation")
        .where("n_regionkey <> 0")
        .selectExpr(
            "CAST(n_nationkey AS BIGINT) AS user_id",
            "concat('s', n_nationkey % 3) AS source",
            "concat('m', n_nationkey % 4) AS medium",
            "concat('c', n_nationkey % 2) AS campaign",
            "concat('a', n_nationkey % 6) AS ad",
        )
    )


def user_managers_from_nation(spark: SparkSession, root: str) -> DataFrame:
    return raw(spark, root, "nation").selectExpr(
        "CAST(n_nationkey AS BIGINT) AS user_id", "CAST(n_nationkey % 5 AS BIGINT) AS manager_id"
    )


def managers_from_region(spark: SparkSession, root: str) -> DataFrame:
    return raw(spark, root, "region").selectExpr(
        "CAST(r_regionkey AS BIGINT) AS id", "r_regionkey AS group_id"
    )


def manager_groups_from_region(spark: SparkSession, root: str) -> DataFrame:
    parent = "CASE r_regionkey WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 3 END"
    return raw(spark, root, "region").selectExpr("r_regionkey AS group_id", f"{parent} AS parent_id")


def site_categories_from_lineitem(spark: SparkSession, root: str) -> DataFrame:
    lines = raw(spark, root, "lineitem").select("l_suppkey", "l_partkey").distinct()
    parts = raw(spark, root, "part").selectExpr("p_partkey AS l_partkey", "p_type AS category_id")
    return lines.join(parts, "l_partkey").selectExpr("l_suppkey AS site_id", "category_id").distinct()


def site_themes_from_lineitem(spark: SparkSession, root: str) -> DataFrame:
    """Brands as news themes and types as user themes of the supplier that sold them."""
    lines = (
        raw(spark, root, "lineitem")
        .groupBy("l_suppkey", "l_partkey")
        .agg(F.max("l_discount").alias("discount"))
    )
    parts = raw(spark, root, "part").selectExpr(
        "p_partkey AS l_partkey", "explode(map('news', p_brand, 'user', p_type)) AS (family, theme_id)"
    )
    return (
        lines.join(parts, "l_partkey")
        .groupBy(F.col("l_suppkey").alias("site_id"), "family", "theme_id")
        .agg(F.expr("max(discount) > 0.05D AS is_filtered"))
    )


def blocked_buyers_from_returns(spark: SparkSession, root: str) -> DataFrame:
    returned = (
        raw(spark, root, "lineitem")
        .where("l_returnflag = 'R'")
        .selectExpr("l_suppkey AS site_id", "l_orderkey AS o_orderkey")
        .distinct()
    )
    orders = raw(spark, root, "orders").selectExpr("o_orderkey", "o_custkey AS buyer_id")
    return returned.join(orders, "o_orderkey").select("site_id", "buyer_id").distinct()


def exchange_daily_from_events(spark: SparkSession, root: str) -> DataFrame:
    sums = (
        "count_if(event_type = 'view') AS src_shows",
        "count_if(event_type = 'click') AS src_clicks",
        "count_if(event_type = 'signup') AS buy_shows",
        "count_if(event_type = 'purchase') AS buy_clicks",
        "count(*) AS in_shows",
        "count_if(event_type IN ('click', 'purchase')) AS in_clicks",
        "count_if(event_type = 'error') AS debt",
    )
    daily = (
        raw(spark, root, "events")
        .groupBy("user_id", F.expr("CAST(ts AS DATE) AS date"))
        .agg(*(F.expr(one) for one in sums))
    )
    return daily.selectExpr(
        "*",
        "IF(src_clicks > 0, CAST(buy_clicks AS DOUBLE) / src_clicks, 0D) AS tier_ratio",
        "IF(src_clicks > 0, CAST(debt AS DOUBLE) / src_clicks, 0D) AS calc_exchange_ratio",
    )


def accounts_from_parties(spark: SparkSession, root: str) -> DataFrame:
    """Regions as agents, customers as buyers, suppliers as sellers, nations as exchangers."""

    def party(table: str, kind: str, first: int, key: str, balance: str = "0") -> DataFrame:
        is_seller = kind == "seller"
        return raw(spark, root, table).selectExpr(
            f"CAST({key} + {first} AS BIGINT) AS id",
            f"'{kind}' AS user_type",
            f"concat('{kind}', {key}, '@example.com') AS email",
            f"concat('sub', {key} % 4) AS subsystem",
            f"concat('https://s', {key}, '.example.com') AS site" if is_seller else "CAST(NULL AS STRING) AS site",
            f"CAST({key} AS STRING) AS src_id" if is_seller else "CAST(NULL AS STRING) AS src_id",
            f"concat('country', {key} % 10) AS country",
            f"concat('Z', lpad(CAST({key} AS STRING), 12, '0')) AS webmoney",
            f"concat('status', {key} % 3) AS crm_status",
            f"concat('s', {key} % 3) AS source",
            f"concat('c', {key} % 2) AS campaign",
            f"concat('m', {key} % 4) AS medium",
            f"concat('a', {key} % 6) AS ad",
            f"CAST({key} % 5 AS BIGINT) AS manager_id",
            f"{_money(balance)} AS balance",
        )

    agents = party("region", "agent", 0, "r_regionkey")
    buyers = party("customer", "buyer", FIRST_BUYER, "c_custkey", "c_acctbal")
    sellers = party("supplier", "seller", FIRST_SELLER, "s_suppkey", "s_acctbal")
    exchangers = party("nation", "exchanger", FIRST_EXCHANGER, "n_nationkey")
    return agents.unionByName(buyers).unionByName(sellers).unionByName(exchangers)


def visits_from_events(spark: SparkSession, root: str) -> DataFrame:
    asked = raw(spark, root, "events").selectExpr(
        "event_id AS visit_id",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS asked",
        "user_id AS cookie_ref_id",
    )
    return asked.selectExpr("visit_id", "IF(asked % 4 = 0, 0, asked) AS ref_id", "cookie_ref_id")


def known_referrers_from_customer(spark: SparkSession, root: str) -> DataFrame:
    return raw(spark, root, "customer").where("c_acctbal > 0").selectExpr("c_custkey AS id")


def access_log_from_events(spark: SparkSession, root: str) -> DataFrame:
    """Forwarded-for lists of every shape: absent, without an IPv4, and with one further back."""
    address = "concat('10.', user_id % 256, '.', event_id % 300, '.7')"
    return raw(spark, root, "events").selectExpr(
        "event_id",
        "concat('192.0.2.', user_id % 250) AS remote_addr",
        f"""CASE event_id % 5 WHEN 0 THEN {address} WHEN 1 THEN concat('unknown, ', {address})
            WHEN 2 THEN concat('::1 , ', {address}, ',8.8.8.8') WHEN 3 THEN '' END AS forwarded_for""",
        "event_id % 7 <> 0 AS is_trusted_proxy",
        "concat('/', event_type, '/', user_id, '?p=', props) AS request_uri",
    )


def order_tables(spark: SparkSession, root: str) -> SellTables:
    """Sparse sales facts over customers as sites."""
    return SellTables(
        day_sell=day_sell_from_orders(spark, root),
        sites=sites_from_customer(spark, root),
        users=users_from_nation(spark, root),
        user_marks=user_marks_from_nation(spark, root),
        user_managers=user_managers_from_nation(spark, root),
    )


def line_tables(spark: SparkSession, root: str) -> SellTables:
    """Dense sales facts over suppliers as sites, with all relations of the panel."""
    return SellTables(
        day_sell=day_sell_from_lineitem(spark, root),
        sites=sites_from_supplier(spark, root),
        users=users_from_nation(spark, root),
        site_categories=site_categories_from_lineitem(spark, root),
        site_themes=site_themes_from_lineitem(spark, root),
        blocked_buyers=blocked_buyers_from_returns(spark, root),
    )


def event_tables(spark: SparkSession, root: str) -> SellTables:
    """Facts with an hourly grain, for periods that include today."""
    return SellTables(
        day_sell=day_sell_from_events(spark, root),
        hour_sell=hour_sell_from_events(spark, root),
        sites=sites_from_customer(spark, root),
        users=users_from_nation(spark, root),
    )
