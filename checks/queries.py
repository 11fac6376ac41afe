"""Registered queries: every operator run over whole tables of the synthetic schema."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DecimalType

from adtally.functions import numbers, text, urls
from adtally.operators import cumulative, distinct_bitmaps, filters, hour_batches, managers, panel, trigram_index, workdays
from adtally.operators.attribution import with_referrer
from adtally.operators.periods import Period, lookback_before
from adtally.operators.totals import sum_by_columns, sum_by_keys
from adtally.plans import exchange_report
from adtally.plans.account_search import AccountSearch, ManagerScope, merged_filters
from adtally.plans.sell_report import FIGURES, SellReport
from adtally.sources import synthetic
from adtally.sources.export import json_rows

Query = Callable[[SparkSession, str], DataFrame]

MONTH = Period.of("1997-03-01", "1997-03-31", "2024-01-20T13:27:00")
TODAY = Period.of("2024-01-20", "2024-01-20", "2024-01-20T13:27:00")
LAST_DAYS = Period.of("2024-01-18", "2024-01-20", "2024-01-20T13:27:00")
EXCHANGE_WEEK = Period.of("2024-01-08", "2024-01-14", "2024-01-20T13:27:00")

# Made-up abbreviations in the letters of cyrillic(); the real dictionary is the caller's.
ABBREVIATIONS = ("ТЖЭ", "ОФ", "АНД", "ИН", "ДЭ", "ЛА", "ЭЛ", "ЮНД")
# A part of the addresses of pages to be searched for.
URL_PART = "ample.ORG/en"
LATIN = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC = "абчдэфгжийклмнопщрстювшъяз"


def plain(df: DataFrame) -> DataFrame:
    """Decimals as double, booleans as int and dates as text, for comparison across engines."""
    columns = []
    for field in df.schema.fields:
        name = f"`{field.name}`"
        if isinstance(field.dataType, DecimalType):
            columns.append(f"CAST({name} AS DOUBLE) AS {name}")
        elif isinstance(field.dataType, BooleanType):
            columns.append(f"CAST({name} AS INT) AS {name}")
        elif isinstance(field.dataType, DateType):
            columns.append(f"CAST({name} AS STRING) AS {name}")
        else:
            columns.append(name)
    return df.selectExpr(*columns)


def texts(df: DataFrame, *names: str) -> DataFrame:
    """The named columns as text, so that a null number stays a null."""
    return df.withColumns({name: F.col(name).cast("string") for name in names})


def month_report(spark: SparkSession, root: str, by_publisher: bool = False) -> SellReport:
    return SellReport(synthetic.order_tables(spark, root), MONTH, by_publisher)


def line_report(spark: SparkSession, root: str, by_publisher: bool = False) -> SellReport:
    return SellReport(synthetic.line_tables(spark, root), MONTH, by_publisher)


def today_report(
    spark: SparkSession, root: str, by_publisher: bool = False, period: Period = TODAY
) -> SellReport:
    return SellReport(synthetic.event_tables(spark, root), period, by_publisher)


def cumulative_report(spark: SparkSession, root: str) -> SellReport:
    """The month's report from running totals of the days that its windows and its lookback need."""
    tables = synthetic.order_tables(spark, root)
    days = cumulative.days_of(MONTH, lookback_before(MONTH.current.start))
    totals = cumulative.running_totals(tables.day_sell, cumulative.array_of(days))
    return SellReport(replace(tables, cumulative_sell=totals), MONTH)


def late_report(spark: SparkSession, root: str) -> SellReport:
    """Today's report with hours that came in batches, a third of them twice and in another order."""
    tables = synthetic.event_tables(spark, root)
    batch = F.concat_ws("/", F.col("hour").cast("string"), (F.col("site_id") % 3).cast("string"))
    rows = tables.hour_sell.withColumn("batch_id", batch).withColumn("arrived", F.crc32(batch.cast("binary")))
    times = F.when(F.col("arrived") % 3 == 0, F.array(F.col("arrived"), F.col("arrived") + 7)).otherwise(F.array("arrived"))
    deliveries = rows.withColumn("delivery", F.explode(times)).drop("arrived")
    half = F.col("delivery") % 2 == 0
    state = hour_batches.batch_sums(hour_batches.once(deliveries.where(half)))
    state = hour_batches.merged(state, deliveries)
    return SellReport(replace(tables, hour_sell=hour_batches.hour_facts(state)), TODAY)


def report_rows(report: SellReport) -> DataFrame:
    return plain(report.rows().select("id", "name", *FIGURES))


def _spine_sites(spark: SparkSession, root: str) -> DataFrame:
    spine = plain(month_report(spark, root).spine())
    return texts(
        spine, "user_id", "country_id", "min_teaser_rating", "subsystem_id", "is_exchanger", "is_disabled"
    )


def site_index(spark: SparkSession, root: str) -> DataFrame:
    return trigram_index.postings(synthetic.order_tables(spark, root).sites, "id", "url")


def user_index(spark: SparkSession, root: str) -> DataFrame:
    return trigram_index.postings(synthetic.order_tables(spark, root).users, "id", "email")


def _search_url_part(spark: SparkSession, root: str) -> DataFrame:
    """Pages whose address contains a part, by the index of all addresses."""
    pages = synthetic.raw(spark, root, "pages")
    index = trigram_index.postings(pages, "page_id", "url")
    return trigram_index.containing(pages, "page_id", "url", index, URL_PART).select("page_id", "url")


def _distinct_buyers(spark: SparkSession, root: str) -> DataFrame:
    """Different parts of each supplier in the report's month, by bitmaps of each day."""
    lines = synthetic.raw(spark, root, "lineitem")
    rows = lines.select(F.col("l_suppkey").alias("site_id"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_partkey").alias("buyer_id"))
    return distinct_bitmaps.distinct_in(distinct_bitmaps.daily_bitmaps(rows), MONTH.current, count="buyers")


def _sum_by_keys(spark: SparkSession, root: str) -> DataFrame:
    events = synthetic.raw(spark, root, "events")
    entries = F.create_map(
        "event_type",
        F.col("user_id").cast("string"),
        F.lit("event"),
        F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(".5")),
        F.lit("props"),
        "props",
    )
    return sum_by_keys(events.select(entries.alias("entries")), "entries")


def _sum_by_columns(spark: SparkSession, root: str) -> DataFrame:
    """Columns of every kind: numbers, dates, and texts of which only some are numbers."""
    orders = synthetic.raw(spark, root, "orders").selectExpr(
        "o_orderkey",
        "o_custkey",
        "CAST(o_totalprice AS DECIMAL(16,2)) AS o_totalprice",
        "o_orderdate",
        "o_orderpriority",
        "IF(o_orderstatus = 'F', CAST(o_orderkey AS STRING), o_orderstatus) AS o_orderstatus",
        "o_orderstatus = 'O' AS is_open",
    )
    return plain(sum_by_columns(orders))


def _filtered(make: Callable[..., filters.SpineFilter], *values, **options) -> Query:
    return lambda spark, root: report_rows(month_report(spark, root).where(make(*values, **options)))


def _filter_category(spark: SparkSession, root: str) -> DataFrame:
    return report_rows(line_report(spark, root).where(filters.by_category(["PROMO", "SMALL"])))


def _group_managers(spark: SparkSession, root: str, group: int) -> DataFrame:
    return managers.managers_of_group(
        synthetic.managers_from_region(spark, root),
        synthetic.manager_groups_from_region(spark, root),
        group,
    )


def _manager_group_tree(spark: SparkSession, root: str) -> DataFrame:
    accounts = synthetic.accounts_from_parties(spark, root)
    in_group = managers.of_managers(accounts, _group_managers(spark, root, 1))
    return in_group.groupBy("manager_id", "user_type").agg(F.count("*").alias("accounts"))


def _filter_group_empty(spark: SparkSession, root: str) -> DataFrame:
    """A group without managers leaves the previous scope, here that of manager 3."""
    previous = spark.range(1).select(F.lit(3).cast("long").alias("manager_id"))
    scope = managers.scope_or_previous(_group_managers(spark, root, 99), previous)
    return report_rows(month_report(spark, root).where(filters.by_managers(scope)))


def _filter_no_scope(spark: SparkSession, root: str) -> DataFrame:
    """Whoever has no scope of their own and picks an empty group sees everything."""
    scope = managers.scope_or_previous(_group_managers(spark, root, 99), None)
    return report_rows(month_report(spark, root).where(filters.by_managers(scope)))


def _filter_empty_fields(spark: SparkSession, root: str) -> DataFrame:
    empty = [filters.by_user(" "), filters.by_site(""), filters.by_network(""), filters.by_profit_types([])]
    empty += [filters.by_min_teaser_rating([]), filters.by_category([]), filters.by_marks({}), filters.by_managers(None)]
    return report_rows(month_report(spark, root).where(*empty))


def _search_zero_subsystem(spark: SparkSession, root: str) -> DataFrame:
    return plain(_search(filters={"subsystem": "0", "email": "r1"})(spark, root).facets())


def _filter_manager_scoped(spark: SparkSession, root: str) -> DataFrame:
    own = spark.range(1).select(F.lit(1).cast("long").alias("manager_id"))
    scope = managers.narrow_to_manager(4, own, _group_managers(spark, root, 1))
    return report_rows(month_report(spark, root).where(filters.by_managers(scope)))


def _page_panel(spark: SparkSession, root: str) -> DataFrame:
    page = line_report(spark, root).page_with_panel(1, 50, "profit", True)
    return texts(plain(page), "min_teaser_rating", "buyer_target")


def _custom_workdays(spark: SparkSession) -> DataFrame:
    rows = [("1997-03-08", True), ("1997-03-10", False), ("1998-01-01", False), ("1998-01-03", True)]
    return spark.createDataFrame(rows, "day string, is_workday boolean").withColumn(
        "day", F.col("day").cast("date")
    )


def _weekend_calendar(spark: SparkSession, root: str) -> DataFrame:
    days = synthetic.day_sell_from_orders(spark, root).groupBy("day").agg(F.sum("src_shows").alias("src_shows"))
    return plain(workdays.with_weekend_flag(days, "day", _custom_workdays(spark)))


def _avail_months(spark: SparkSession, root: str) -> DataFrame:
    facts = synthetic.day_sell_from_orders(spark, root)
    return plain(workdays.available_months(facts, "day", MONTH.as_of))


def _exchange_inputs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return synthetic.exchange_daily_from_events(spark, root), synthetic.users_from_nation(spark, root)


def _exchange_rows(spark: SparkSession, root: str) -> DataFrame:
    return exchange_report.daily_rows(*_exchange_inputs(spark, root), EXCHANGE_WEEK.current)


def _exchange_by_date(spark: SparkSession, root: str) -> DataFrame:
    return plain(exchange_report.with_row_metrics(_exchange_rows(spark, root)))


def _exchange_prev(spark: SparkSession, root: str) -> DataFrame:
    return plain(exchange_report.previous_rows(*_exchange_inputs(spark, root), EXCHANGE_WEEK))


def _exchange_total(spark: SparkSession, root: str) -> DataFrame:
    return exchange_report.export_total(_exchange_rows(spark, root), "user_id")


def _exchange_screen_total(spark: SparkSession, root: str) -> DataFrame:
    """Ratios are sums of doubles here, so they are compared to six decimals."""
    total = exchange_report.screen_total(exchange_report.with_row_metrics(_exchange_rows(spark, root)), "user_id")
    ratios = ("src_ctr", "buy_ctr", "in_ctr", "tier_ratio", "calc_exchange_ratio")
    return total.withColumns({name: F.round(name, 6) for name in ratios})


def _search(**options) -> Callable[[SparkSession, str], AccountSearch]:
    wanted = options.pop("filters")
    scope = options.pop("scope", ManagerScope("all", own_id=1))
    return lambda spark, root: AccountSearch(
        synthetic.accounts_from_parties(spark, root), wanted, scope, **options
    )


def _search_facets(spark: SparkSession, root: str) -> DataFrame:
    return plain(_search(filters=merged_filters({"email": "R1"}, {"campaign": "c1"}))(spark, root).facets())


def _search_page(spark: SparkSession, root: str) -> DataFrame:
    shown = _search(filters=merged_filters({"country": "country3"}, {"source": "s0"}))(spark, root).page()
    return plain(shown.select("id", "user_type", "email", "balance", F.col("position").cast("long")))


def _search_type_page(spark: SparkSession, root: str) -> DataFrame:
    search = _search(filters={"crm_status": "status1", "medium": "m1"}, user_type="buyer")
    return plain(search(spark, root).page(2, "balance", True).select("id", "email", "balance"))


def _search_totals(spark: SparkSession, root: str) -> DataFrame:
    return plain(_search(filters={"medium": "m2"}, user_type="buyer")(spark, root).totals())


def _search_page_counts(spark: SparkSession, root: str) -> DataFrame:
    return plain(_search(filters={"email": "e", "country": "country7"})(spark, root).page_counts())


def _search_scope(spark: SparkSession, root: str) -> DataFrame:
    scope = ManagerScope("my_group", own_id=2, group=_group_managers(spark, root, 3))
    return plain(_search(filters={"country": "country3"}, scope=scope)(spark, root).facets())


def cyrillic(column: Column, key: Column) -> Column:
    """Latin text in Russian letters: as written, all in capitals, or only the small letters."""
    as_written = F.translate(column, LATIN + LATIN.upper() + "-", CYRILLIC + CYRILLIC.upper() + "/")
    capitals = F.translate(column, LATIN + LATIN.upper() + "-", CYRILLIC.upper() * 2 + "/")
    mixed = F.translate(column, LATIN + "-", CYRILLIC.upper() + "/")
    return F.when(key % 3 == 0, as_written).when(key % 3 == 1, capitals).otherwise(mixed)


def _clean_numbers(spark: SparkSession, root: str) -> DataFrame:
    lines = synthetic.raw(spark, root, "lineitem")
    part = [F.col(name).cast("string") for name in ("l_orderkey", "l_suppkey", "l_linenumber")]
    value = F.concat(F.lit("\t "), part[0], F.lit(" "), part[1], F.lit(","), part[2], F.lit(" "), "l_returnflag")
    return lines.select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        numbers.lenient_float(value).alias("as_float"),
        numbers.lenient_int(value).alias("as_int"),
        numbers.lenient_boolean(F.translate(F.col("l_returnflag"), "NA", "0")).cast("int").alias("as_boolean"),
    )


def pasted_url(url: Column, key: Column) -> Column:
    return (
        F.when(key % 6 == 0, F.concat(F.lit("http://"), url))
        .when(key % 6 == 1, F.upper(url))
        .when(key % 6 == 2, F.regexp_replace(url, "^https?://", " "))
        .when(key % 6 == 3, F.regexp_replace(url, "^https?", "ftp"))
        .when(key % 6 == 4, F.regexp_replace(url, "^(https?://).*", "$1"))
        .otherwise(url)
    )


def _clean_url(spark: SparkSession, root: str) -> DataFrame:
    pages = synthetic.raw(spark, root, "pages")
    return pages.select("page_id", urls.clean_url(pasted_url(F.col("url"), F.col("page_id"))).alias("cleaned"))


def _documents(spark: SparkSession, root: str) -> DataFrame:
    return synthetic.raw(spark, root, "documents")


def _cyr_to_latin(spark: SparkSession, root: str) -> DataFrame:
    documents = _documents(spark, root)
    russian = cyrillic(F.col("text"), F.col("doc_id"))
    return documents.select("doc_id", text.transliterate(russian).alias("latin"))


def _sanitize_title(spark: SparkSession, root: str) -> DataFrame:
    documents = _documents(spark, root)
    russian = cyrillic(F.col("text"), F.col("doc_id"))
    return documents.select("doc_id", text.clean_title(russian, ABBREVIATIONS).alias("title"))


def dictionary(spark: SparkSession, root: str) -> DataFrame:
    """A dictionary of abbreviations made of part types: words, words with a hyphen, and with a dot and a dollar sign."""
    kinds = synthetic.raw(spark, root, "part").select("p_type", "p_brand").distinct()
    plain, joined = F.col("p_type"), F.concat("p_type", F.lit("-"), "p_brand")
    priced = F.concat("p_type", F.lit(".$"), "p_brand")
    return kinds.select(F.explode(F.array(plain, joined, priced)).alias("word"))


def _sanitize_title_table(spark: SparkSession, root: str) -> DataFrame:
    """Titles of parts in small letters, with entries of the dictionary and other words around them."""
    parts = synthetic.raw(spark, root, "part").where("p_type IS NOT NULL")
    entry = (
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_type"))
        .when(F.col("p_partkey") % 3 == 1, F.concat("p_type", F.lit("-"), "p_brand"))
        .otherwise(F.concat("p_type", F.lit(".$"), "p_brand"))
    )
    title = F.concat(F.lit("x"), F.lit(" "), F.lower(entry), F.lit(" y"))
    titles = parts.select("p_partkey", title.alias("given"))
    return text.with_clean_titles(titles, "given", dictionary(spark, root)).select("p_partkey", "title")


def overlapping_dictionary(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of neighbouring words of the names of parts, joined with a hyphen: entries that overlap in a name."""
    words = F.split("p_name", " ")
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat(F.get(words, i), F.lit("-"), F.get(words, i + 1)))
    parts = synthetic.raw(spark, root, "part").where(F.size(words) > 1)
    return parts.where("p_partkey % 3 = 0").select(F.explode(pairs).alias("word"))


def _sanitize_title_overlapping(spark: SparkSession, root: str) -> DataFrame:
    """Names of parts with hyphens between the words, of which neighbouring pairs are entries of the dictionary."""
    parts = synthetic.raw(spark, root, "part").where("p_name IS NOT NULL")
    given = parts.select("p_partkey", F.concat(F.lit("0 "), F.lower(F.replace("p_name", F.lit(" "), F.lit("-")))).alias("given"))
    return text.with_clean_titles(given, "given", overlapping_dictionary(spark, root), parts=2).select("p_partkey", "title")


def _smart_trim(spark: SparkSession, root: str) -> DataFrame:
    documents = _documents(spark, root)
    return documents.select("doc_id", text.squeezed(F.col("text")).alias("squeezed"))


def _bytes_human(spark: SparkSession, root: str) -> DataFrame:
    documents = _documents(spark, root)
    size = F.col("n_chars") * F.col("n_chars") * F.col("doc_id")
    return documents.select("doc_id", numbers.human_bytes(size).alias("shown"))


def _first_ipv4(spark: SparkSession, root: str) -> DataFrame:
    log = synthetic.access_log_from_events(spark, root)
    address = urls.visitor_ip(*(F.col(name) for name in ("remote_addr", "forwarded_for", "is_trusted_proxy")))
    return log.select("event_id", address.alias("visitor_ip"))


def _script_name(spark: SparkSession, root: str) -> DataFrame:
    log = synthetic.access_log_from_events(spark, root)
    return log.select("event_id", urls.script_name(F.col("request_uri")).alias("script"))


def _clear_prefix_suffix(spark: SparkSession, root: str) -> DataFrame:
    customers = synthetic.raw(spark, root, "customer")
    email = F.concat(
        F.when(F.col("c_custkey") % 4 == 0, F.lit("@pre@")).otherwise(F.lit("")),
        F.lower("c_mktsegment"),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("@suffix")).otherwise(F.lit("@example.com")),
    )
    return customers.select(
        "c_custkey",
        text.without_prefix(email, "@pre@").alias("no_prefix"),
        text.without_suffix(email, "@suffix").alias("no_suffix"),
        text.without_suffix(email, "").alias("same"),
    )


def _traffic_tag(spark: SparkSession, root: str) -> DataFrame:
    parts = synthetic.raw(spark, root, "part")
    key = F.col("p_partkey").cast("string")
    tag = F.concat(F.translate("p_name", " ", "_"), F.when(F.col("p_size") % 3 == 0, F.lit("-")).otherwise(F.lit("_")), key)
    return parts.select("p_partkey", text.tag_without_site(tag).alias("main_part"))


def _smart_encode(spark: SparkSession, root: str) -> DataFrame:
    documents = _documents(spark, root)
    return documents.select("doc_id", urls.smart_encode(F.col("text")).alias("encoded"))


def _smart_encode_urls(spark: SparkSession, root: str) -> DataFrame:
    pages = synthetic.raw(spark, root, "pages")
    return pages.select("page_id", urls.smart_encode(F.concat("url", F.lit("é*=1"))).alias("encoded"))


def _smart_decode(spark: SparkSession, root: str) -> DataFrame:
    documents = _documents(spark, root)
    encoded = urls.smart_encode(F.col("text"))
    return documents.select("doc_id", urls.smart_decode(encoded).alias("decoded"))


# Host names of words with a letter that has a form of its own, and their ASCII forms: fixed values.
HOST_NAMES = {"straße": "xn--strae-oqa", "bücher": "xn--bcher-kva", "été": "xn--t-9fab", "пример": "xn--e1afmkfd"}


def _host_pairs(spark: SparkSession, root: str) -> DataFrame:
    """URLs of pages with international hosts, user names and ports, and the same with ASCII hosts."""
    pages = synthetic.raw(spark, root, "pages").where("page_id IS NOT NULL")
    names = F.array(*map(F.lit, HOST_NAMES))
    codes = F.array(*map(F.lit, HOST_NAMES.values()))
    place = F.pmod("page_id", F.lit(len(HOST_NAMES))).cast("int")
    user = F.when(F.col("page_id") % 3 == 0, F.lit("me:secret@")).otherwise(F.lit(""))
    port = F.when(F.col("page_id") % 2 == 0, F.lit(":8080")).otherwise(F.lit(""))
    tail = F.concat(F.lit(".example.com"), port, F.lit("/p"), F.col("page_id").cast("string"))
    return pages.select(
        "page_id",
        F.concat(F.lit("http://"), user, F.get(names, place), tail).alias("named"),
        F.concat(F.lit("http://"), F.get(codes, place), tail, F.lit("%20%C3%A9")).alias("coded"),
    )


def _smart_encode_hosts(spark: SparkSession, root: str) -> DataFrame:
    return _host_pairs(spark, root).select("page_id", urls.smart_encode(F.col("named")).alias("encoded"))


def _smart_decode_hosts(spark: SparkSession, root: str) -> DataFrame:
    return _host_pairs(spark, root).select("page_id", urls.smart_decode(F.col("coded")).alias("decoded"))


def _referral_attribution(spark: SparkSession, root: str) -> DataFrame:
    visits = synthetic.visits_from_events(spark, root)
    credited = with_referrer(visits, synthetic.known_referrers_from_customer(spark, root))
    return texts(credited, "referrer_id").select("visit_id", "ref_id", "cookie_ref_id", "referrer_id")


def _json_rows(spark: SparkSession, root: str) -> DataFrame:
    """Pages with texts that look like entities, in a map and an array too."""
    pages = synthetic.raw(spark, root, "pages").select("page_id", "url", "html")
    marks = F.concat(F.lit("&foo;&apos;&copy;&#x110000;&#65;<"), F.col("page_id").cast("string"))
    return json_rows(
        pages.select("*", F.create_map(F.lit("k"), marks).alias("named"), F.array(marks, F.lit("&lt;")).alias("listed")), escape=True
    )


def queries() -> dict[str, Query]:
    return {
        "spine_sites": _spine_sites,
        "sell_by_site": lambda s, d: report_rows(month_report(s, d)),
        "sell_by_site_lines": lambda s, d: report_rows(line_report(s, d)),
        "sell_by_publisher": lambda s, d: report_rows(month_report(s, d, True)),
        "sell_page": lambda s, d: plain(month_report(s, d).page(2, 50, "profit", True)),
        "sell_page_by_name": lambda s, d: plain(month_report(s, d).page(1, 50, "name", True)),
        "sell_publisher_page": lambda s, d: plain(month_report(s, d, True).page(1, 10, "src_ctr")),
        "sell_total": lambda s, d: plain(month_report(s, d).total()),
        "sell_count": lambda s, d: month_report(s, d).count(),
        "sell_page_total": lambda s, d: plain(SellReport.page_total(month_report(s, d).page(2, 50, "profit", True))),
        "sell_publisher_count": lambda s, d: month_report(s, d, True).count(),
        "sell_page_total_today": lambda s, d: plain(SellReport.page_total(today_report(s, d).page(1, 50, "profit", True))),
        "sum_by_keys": _sum_by_keys,
        "sum_by_columns": _sum_by_columns,
        "sell_by_site_cumulative": lambda s, d: report_rows(cumulative_report(s, d)),
        "publisher_status_new_cumulative": lambda s, d: report_rows(
            cumulative_report(s, d).where(filters.by_publisher_status("new"))
        ),
        "filter_country_cumulative": lambda s, d: report_rows(cumulative_report(s, d).where(filters.by_country(3))),
        "sell_by_site_late_hours": lambda s, d: report_rows(late_report(s, d)),
        "filter_site_indexed": lambda s, d: report_rows(month_report(s, d).where(filters.by_site_indexed("c12", site_index(s, d)))),
        "filter_user_indexed": lambda s, d: report_rows(
            month_report(s, d).where(filters.by_user_indexed("Nation_1", user_index(s, d)))
        ),
        "search_url_part": _search_url_part,
        "distinct_buyers_window": _distinct_buyers,
        "sell_by_site_today": lambda s, d: report_rows(today_report(s, d)),
        "sell_by_site_last_days": lambda s, d: report_rows(today_report(s, d, period=LAST_DAYS)),
        "sell_by_publisher_today": lambda s, d: report_rows(today_report(s, d, True)),
        "sell_total_today": lambda s, d: plain(today_report(s, d).total()),
        "filter_country": _filtered(filters.by_country, 3),
        "filter_subsystem": _filtered(filters.by_subsystem, 2),
        "filter_exchanger": _filtered(filters.by_exchanger, "exchanger"),
        "filter_not_exchanger": _filtered(filters.by_exchanger, "not_exchanger"),
        "filter_user": _filtered(filters.by_user, "Nation_1"),
        "filter_user_id": _filtered(filters.by_user, "7"),
        "filter_user_exact": _filtered(filters.by_user, "nation_11@example.com", exact=True),
        "filter_network": _filtered(filters.by_network, "@pre@"),
        "filter_site": _filtered(filters.by_site, "c12"),
        "filter_marks": _filtered(filters.by_marks, {"source": "s1", "ad": "a1", "unknown": "x"}),
        "filter_profit_type": _filtered(filters.by_profit_types, ["BUILDING", "MACHINERY"]),
        "filter_rating": _filtered(filters.by_min_teaser_rating, [1, 4, None]),
        "filter_category": _filter_category,
        "filter_managers": _filtered(filters.by_managers, [0, 3]),
        "filter_manager_scoped": _filter_manager_scoped,
        "filter_group_empty_keeps_scope": _filter_group_empty,
        "filter_no_scope": _filter_no_scope,
        "filter_empty_fields": _filter_empty_fields,
        "publisher_status_new": _filtered(filters.by_publisher_status, "new"),
        "publisher_status_current": _filtered(filters.by_publisher_status, "current"),
        "manager_group_tree": _manager_group_tree,
        "page_panel": _page_panel,
        "theme_counts": lambda s, d: panel.theme_counts(synthetic.site_themes_from_lineitem(s, d)),
        "blocked_buyers": lambda s, d: panel.blocked_buyer_counts(synthetic.blocked_buyers_from_returns(s, d)),
        "weekend_calendar": _weekend_calendar,
        "avail_months": _avail_months,
        "exchange_by_date": _exchange_by_date,
        "exchange_prev": _exchange_prev,
        "exchange_total": _exchange_total,
        "exchange_screen_total": _exchange_screen_total,
        "exchange_export": lambda s, d: exchange_report.export_table(_exchange_rows(s, d), "user_id"),
        "search_facets": _search_facets,
        "search_page": _search_page,
        "search_type_page": _search_type_page,
        "search_totals": _search_totals,
        "search_page_counts": _search_page_counts,
        "search_scope": _search_scope,
        "search_zero_subsystem": _search_zero_subsystem,
        "clean_numbers": _clean_numbers,
        "clean_url": _clean_url,
        "cyr_to_latin": _cyr_to_latin,
        "bytes_human": _bytes_human,
        "first_ipv4": _first_ipv4,
        "script_name": _script_name,
        "sanitize_title": _sanitize_title,
        "sanitize_title_table": _sanitize_title_table,
        "sanitize_title_overlapping": _sanitize_title_overlapping,
        "clear_prefix_suffix": _clear_prefix_suffix,
        "traffic_tag": _traffic_tag,
        "smart_encode": _smart_encode,
        "smart_encode_urls": _smart_encode_urls,
        "smart_decode": _smart_decode,
        "smart_encode_hosts": _smart_encode_hosts,
        "smart_decode_hosts": _smart_decode_hosts,
        "smart_trim": _smart_trim,
        "referral_attribution": _referral_attribution,
        "json_rows": _json_rows,
    }
