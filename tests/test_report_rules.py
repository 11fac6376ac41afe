"""Rules of the sales report on small hand-made tables."""

from dataclasses import replace
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from adtally.operators import filters
from adtally.operators.periods import Period, Window, lookback_before
from adtally.plans.sell_report import SORTABLE, SellReport
from adtally.sources.tables import SCHEMAS, SellTables

PERIOD = Period.of("2024-03-11", "2024-03-12", "2024-05-01T10:30:00")
TODAY = Period.of("2024-03-11", "2024-03-12", "2024-03-12T10:30:00")


def day(site, on, clicks=1, profit="1", shows=10, expense=None):
    amount = Decimal(profit)
    spent = Decimal(expense) if expense is not None else 2 * amount
    return (site, date.fromisoformat(on), shows, clicks, shows, clicks, shows, 0, amount, spent, Decimal(0), Decimal(0))


def hour(site, at, clicks=1, profit="1", shows=10):
    amount = Decimal(profit)
    return (site, datetime.fromisoformat(at), shows, clicks, shows, clicks, shows, amount, 2 * amount, Decimal(0), Decimal(0))


def site(number, seller, name=None):
    return (number, name or f"site{number}", f"https://s{number}.example", seller, 1, "cpc", None, None, [])


def user(number, is_exchanger=False):
    return (number, f"u{number}@example.com", 1, is_exchanger, False)


def tables(spark, days, hours=(), sites=None, users=None):
    numbers = sorted({row[0] for row in days})
    sites = [site(n, 100) for n in numbers] if sites is None else sites
    users = [user(100), user(200)] if users is None else users
    return SellTables(
        day_sell=spark.createDataFrame(days, SCHEMAS["day_sell"]),
        hour_sell=spark.createDataFrame(list(hours), SCHEMAS["hour_sell"]),
        sites=spark.createDataFrame(sites, SCHEMAS["sites"]),
        users=spark.createDataFrame(users, SCHEMAS["users"]),
    )


def by_id(df):
    return {row.id: row for row in df.collect()}


def test_periods():
    period = Period.of("2024-03-01", "2024-03-31", "2024-03-31T00:10:00")
    assert period.previous == Window(date(2024, 1, 30), date(2024, 2, 29))
    assert (period.days_count, period.is_today_included) == (31, True)
    midnight = datetime(2024, 3, 31)
    assert period.completed_hours(period.current) == (midnight, midnight)
    assert lookback_before(date(2024, 1, 15)) == (date(2023, 11, 1), date(2024, 1, 1))
    with pytest.raises(ValueError):
        Period.of("2024-03-02", "2024-03-01", "2024-03-31T00:10:00")


def test_site_with_only_previous_traffic_appears_with_negative_deltas(spark):
    rows = by_id(SellReport(tables(spark, [day(1, "2024-03-10", clicks=3, profit="5")]), PERIOD).rows())
    assert (rows[1].src_clicks, rows[1].delta_src_clicks) == (0, -3)
    assert (rows[1].profit, rows[1].delta_profit) == (Decimal(0), Decimal(-5))
    assert rows[1].name is None
    assert rows[1].delta_src_ctr == Decimal(-30)


def test_rows_outside_both_windows_make_no_site(spark):
    facts = [day(1, "2024-03-08"), day(2, "2024-03-13"), day(3, "2024-03-09"), day(4, "2024-03-12")]
    assert set(by_id(SellReport(tables(spark, facts), PERIOD).rows())) == {3, 4}


def test_several_rows_and_nulls_of_a_key_add_up(spark):
    facts = [day(1, "2024-03-11", clicks=2), day(1, "2024-03-11", clicks=None), day(1, "2024-03-12", clicks=5)]
    assert by_id(SellReport(tables(spark, facts), PERIOD).rows())[1].src_clicks == 7


def test_today_shows_full_days_but_compares_completed_hours(spark):
    days = [day(1, "2024-03-11", clicks=10), day(1, "2024-03-12", clicks=100), day(1, "2024-03-10", clicks=50)]
    hours = [
        hour(1, "2024-03-12T09:00:00", clicks=4),
        hour(1, "2024-03-12T10:00:00", clicks=9),
        hour(1, "2024-03-11T09:00:00", clicks=9),
        hour(1, "2024-03-10T09:00:00", clicks=3),
        hour(1, "2024-03-10T23:00:00", clicks=9),
        hour(2, "2024-03-12T09:00:00", clicks=9),
    ]
    rows = by_id(SellReport(tables(spark, days, hours), TODAY).rows())
    assert set(rows) == {1}
    assert rows[1].src_clicks == 110
    assert rows[1].src_clicks_for_delta == 14
    assert rows[1].delta_src_clicks == 14 - 3


def test_hours_count_only_for_sites_with_a_day_row_in_that_window(spark):
    days = [day(1, "2024-03-12", clicks=7)]
    hours = [hour(1, "2024-03-12T01:00:00", clicks=4), hour(1, "2024-03-10T01:00:00", clicks=3)]
    rows = by_id(SellReport(tables(spark, days, hours), TODAY).rows())
    assert (rows[1].src_clicks_for_delta, rows[1].delta_src_clicks) == (4, 4)


def test_today_needs_hourly_facts(spark):
    without_hours = replace(tables(spark, [day(1, "2024-03-12")]), hour_sell=None)
    with pytest.raises(ValueError):
        SellReport(without_hours, TODAY).rows()


def test_ratio_delta_subtracts_the_unrounded_previous_ratio(spark):
    facts = [day(1, "2024-03-11", clicks=1, shows=3), day(1, "2024-03-10", clicks=1, shows=7)]
    row = by_id(SellReport(tables(spark, facts), PERIOD).rows())[1]
    assert row.src_ctr == Decimal("33.3333")
    assert row.delta_src_ctr == Decimal("19.0476")  # 33.3333 - 14.285714..., not 33.3333 - 14.2857


def test_zero_denominators_give_zero(spark):
    row = by_id(SellReport(tables(spark, [day(1, "2024-03-11", clicks=0, shows=0, profit="0")]), PERIOD).rows())[1]
    assert (row.src_ctr, row.src_click_price, row.percent_system_profit) == (0, 0, 0)
    assert row.effective_block_shows_pc == 0


def test_unknown_site_is_counted_but_not_shown(spark):
    facts = [day(1, "2024-03-11"), day(2, "2024-03-11"), day(3, "2024-03-11")]
    sites = [site(1, 100), site(3, 999)]
    report = SellReport(tables(spark, facts, sites=sites), PERIOD)
    assert report.count().first()[0] == 3
    assert set(by_id(report.page())) == {1}


def test_publishers_add_up_their_sites_and_leave_out_unknown_ones(spark):
    facts = [day(1, "2024-03-11", 2), day(2, "2024-03-10", 3), day(3, "2024-03-11", 5), day(4, "2024-03-11", 7)]
    sites = [site(1, 100), site(2, 100), site(3, 200)]
    rows = by_id(SellReport(tables(spark, facts, sites=sites), PERIOD, by_publisher=True).rows())
    assert set(rows) == {100, 200}
    assert (rows[100].src_clicks, rows[100].delta_src_clicks) == (2, -1)
    assert rows[100].name == "u100@example.com"


def test_name_order_uses_the_stored_name(spark):
    facts = [day(1, "2024-03-10"), day(2, "2024-03-11"), day(3, "2024-03-11")]
    sites = [site(1, 100, "a"), site(2, 100, "c"), site(3, 100, "b")]
    report = SellReport(tables(spark, facts, sites=sites), PERIOD)
    assert [row.name for row in report.page(order="name").collect()] == ["b", "c", "a"]
    assert [row.name for row in report.page(order="name", descending=True).collect()] == ["a", "c", "b"]


def test_shown_name_may_be_the_url(spark):
    report = SellReport(tables(spark, [day(1, "2024-03-11")]), PERIOD)
    assert report.page(site_label="site_url").first().name == "https://s1.example"


def test_unknown_order_falls_back_to_profit(spark):
    facts = [day(1, "2024-03-11", profit="3"), day(2, "2024-03-11", profit="1"), day(3, "2024-03-11", profit="2")]
    report = SellReport(tables(spark, facts), PERIOD)
    for order in ("buy_cpm", "delta_buy_cpm", "block_shows_empty", "1; drop"):
        assert order not in SORTABLE
        assert [row.id for row in report.page(order=order).collect()] == [2, 3, 1]
    assert len(SORTABLE) == 32


def test_pages_follow_each_other_and_clamp(spark):
    report = SellReport(tables(spark, [day(n, "2024-03-11", profit=str(n % 3)) for n in range(1, 12)]), PERIOD)
    everything = [row.id for row in report.page(items=0).collect()]
    pages = [row.id for page in (1, 2, 3) for row in report.page(page, 4).collect()]
    assert everything == pages
    assert [row.id for row in report.page(-3, 4).collect()] == everything[:4]


def test_grand_total_uses_the_delta_base_and_page_total_the_shown_sums(spark):
    days = [day(1, "2024-03-12", clicks=100, shows=1000), day(1, "2024-03-10", clicks=30, shows=400)]
    hours = [hour(1, "2024-03-12T01:00:00", clicks=5, shows=100), hour(1, "2024-03-10T01:00:00", clicks=2, shows=50)]
    report = SellReport(tables(spark, days, hours), TODAY)
    total, page_total = report.total().first(), report.page_total(report.page()).first()
    assert total.src_ctr == page_total.src_ctr == 10.0
    assert total.delta_src_ctr == pytest.approx(5.0 - 4.0)
    assert page_total.delta_src_ctr == pytest.approx((100 / 1000 - 97 / 950) * 100)


def test_page_total_keeps_sums_it_does_not_recompute(spark):
    facts = [day(1, "2024-03-11", profit="1"), day(2, "2024-03-11", profit="2")]
    page = SellReport(tables(spark, facts), PERIOD).page()
    total = SellReport.page_total(page).first()
    assert total.buy_cpm == sum(row.buy_cpm for row in page.collect())
    assert (total.id, total.site_id, total.user_id) == (3, 3, 200)
    assert (total.name, total.is_disabled) == (0, 0)


def test_empty_report_totals_are_zero(spark):
    report = SellReport(tables(spark, [day(1, "2020-01-01")]), PERIOD)
    for row in (report.total().first(), report.page_total(report.page()).first()):
        assert set(row.asDict().values()) == {0}
    assert report.count().first()[0] == 0


def test_publisher_status_splits_all_sites(spark):
    facts = [day(n, "2024-03-11") for n in (1, 2, 3, 4)]
    facts += [day(1, "2024-01-01"), day(2, "2024-02-29"), day(3, "2023-12-31"), day(5, "2024-02-01")]
    report = SellReport(tables(spark, facts), PERIOD)
    new = set(by_id(report.where(filters.by_publisher_status("new")).rows()))
    current = set(by_id(report.where(filters.by_publisher_status("current")).rows()))
    assert (new, current) == ({3, 4}, {1, 2})


def test_publisher_status_in_a_period_with_today(spark):
    facts = [day(1, "2024-03-12"), day(2, "2024-03-12"), day(2, "2024-02-01")]
    report = SellReport(tables(spark, facts), TODAY).where(filters.by_publisher_status("current"))
    assert set(by_id(report.rows())) == {2}


def test_filters_commute_and_empty_ones_keep_everything(spark):
    facts = [day(n, "2024-03-11") for n in range(1, 7)]
    sites = [site(n, 100 if n % 2 else 200) for n in range(1, 7)]
    users = [user(100, True), user(200, False)]
    report = SellReport(tables(spark, facts, sites=sites, users=users), PERIOD)
    one, two = filters.by_exchanger("exchanger"), filters.by_site("s3")
    assert set(by_id(report.where(one, two).rows())) == set(by_id(report.where(two).where(one).rows())) == {3}
    nothing = (filters.by_exchanger(""), filters.by_managers([]), filters.by_marks({"source": "", "other": "x"}))
    assert len(by_id(report.where(*nothing).rows())) == 6
    for wrong in (filters.by_exchanger, filters.by_publisher_status):
        with pytest.raises(ValueError):
            wrong("sometimes")


def test_marks_of_users_without_marks_are_empty_texts(spark):
    facts = [day(1, "2024-03-11"), day(2, "2024-03-11")]
    given = tables(spark, facts, sites=[site(1, 100), site(2, 200)])
    marks = spark.createDataFrame([(100, "s", "m", None, "a")], SCHEMAS["user_marks"])
    report = SellReport(replace(given, user_marks=marks), PERIOD)
    assert set(by_id(report.where(filters.by_marks({"source": "s", "ad": "a"})).rows())) == {1}
    assert set(by_id(report.where(filters.by_marks({"campaign": "c"})).rows())) == set()


def test_stored_report_gives_the_same_figures(spark):
    report = SellReport(tables(spark, [day(n, "2024-03-11", n) for n in range(1, 5)]), PERIOD)
    once = report.stored()
    assert once.total().collect() == report.total().collect()
    assert once.page().collect() == report.page().collect()
    assert once.where(filters.by_site("2")).count().first()[0] == 1


def test_panel_of_sites_without_details(spark):
    given = replace(
        tables(spark, [day(1, "2024-03-11", profit="2"), day(2, "2024-03-11")]),
        site_themes=spark.createDataFrame(
            [(1, "news", "a", True), (1, "news", "b", False), (1, "user", "a", False), (9, "user", "a", False)],
            SCHEMAS["site_themes"],
        ),
        blocked_buyers=spark.createDataFrame([(1, 5), (1, 5), (1, 6)], SCHEMAS["blocked_buyers"]),
    )
    report = SellReport(given, PERIOD)
    first, second = report.page_with_panel(descending=True).collect()
    names = ("news_themes_not_filtered", "news_themes_total", "user_themes_not_filtered", "user_themes_total", "filtered_buyers")
    assert [first[name] for name in names] == [1, 2, 1, 1, 2]
    assert [second[name] for name in names] == [0, 0, 0, 0, 0]
    assert (first.buyer_target, first.min_teaser_rating) == (None, None)
    by_publisher = replace(report, by_publisher=True).page_with_panel()
    assert "filtered_buyers" not in by_publisher.columns
    assert "sort_key" not in by_publisher.columns


def test_sites_summed_by_publisher_give_the_publisher_report(spark, sf_dir):
    from checks.queries import month_report

    measures = ("profit", "delta_profit", "src_shows", "delta_src_shows", "block_shows_empty")
    by_site = month_report(spark, sf_dir).rows().where("user_id IS NOT NULL")
    summed = by_site.groupBy(F.col("user_id").alias("id")).agg(*(F.sum(m).alias(m) for m in measures))
    publishers = month_report(spark, sf_dir, True).rows().select("id", *measures)
    assert summed.exceptAll(publishers).count() == publishers.exceptAll(summed).count() == 0


def test_finer_money_is_rounded_at_the_site(spark):
    given = tables(spark, [day(1, "2024-03-11"), day(1, "2024-03-12"), day(2, "2024-03-12")])
    finer = given.day_sell.withColumn("profit", F.lit("0.000030").cast("decimal(20,6)"))
    rows = by_id(SellReport(replace(given, day_sell=finer), PERIOD).rows())
    assert (rows[1].profit, rows[2].profit) == (Decimal("0.0001"), Decimal("0.0000"))


def test_largest_money_is_exact(spark):
    amounts = ["999999999999.9999", "-999999999999.9998", "0.0001"]
    facts = [day(1, "2024-03-11", profit=amount, expense="0") for amount in amounts]
    rows = by_id(SellReport(tables(spark, facts), PERIOD).rows())
    assert rows[1].profit == Decimal("0.0002")
    assert rows[1].system_profit == Decimal("-0.0002")
