"""Exchange report, calendar, attribution and sinks."""

import csv
import json
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from adtally.operators import workdays
from adtally.operators.attribution import with_referrer
from adtally.operators.periods import Period
from adtally.operators.totals import sum_by_columns, sum_by_keys
from adtally.plans import exchange_report
from adtally.sources import export
from adtally.sources.tables import SCHEMAS, read_table, write_day_partitioned

PERIOD = Period.of("2024-01-08", "2024-01-09", "2024-02-01T00:00:00")


@pytest.fixture(scope="module")
def exchange(spark):
    def daily(user, on, clicks, buy, tier):
        return (user, date.fromisoformat(on), 100, clicks, 50, buy, 10, 4, 3, tier, 0.5)

    rows = [
        daily(1, "2024-01-08", 4, 2, 0.5),
        daily(1, "2024-01-09", 6, 3, 0.5),
        daily(1, "2024-01-07", 1, 1, 1.0),
        daily(2, "2024-01-08", 5, 5, 1.0),
        daily(3, "2024-01-08", 0, 5, 0.0),
    ]
    users = [(1, "a", 1, True, False), (2, "b", 1, False, False), (3, "c", 1, True, False)]
    return spark.createDataFrame(rows, SCHEMAS["exchange_daily"]), spark.createDataFrame(users, SCHEMAS["users"])


def test_only_exchangers_have_rows(exchange):
    rows = exchange_report.daily_rows(*exchange, PERIOD.current)
    assert {(r.user_id, str(r.date)) for r in rows.collect()} == {(1, "2024-01-08"), (1, "2024-01-09"), (3, "2024-01-08")}


def test_previous_rows_know_the_day_they_compare_to(exchange):
    row = exchange_report.previous_rows(*exchange, PERIOD).first()
    assert (str(row.date), str(row.compared_date)) == ("2024-01-07", "2024-01-09")


def test_both_totals(exchange):
    rows = exchange_report.daily_rows(*exchange, PERIOD.current).where("user_id = 1")
    screen = exchange_report.screen_total(exchange_report.with_row_metrics(rows)).first()
    printed = exchange_report.export_total(rows).first()
    assert (screen.src_clicks, screen.tier_ratio, screen.src_ctr, screen.date) == (10, 1.0, 10.0, 0)
    assert (printed.src_clicks, printed.tier_ratio, printed.src_ctr, printed.exchange_delta) == (10, 0.5, 5.0, 2)
    assert printed.calc_exchange_ratio == 0.6


def test_total_without_source_clicks_and_without_rows(exchange):
    rows = exchange_report.daily_rows(*exchange, PERIOD.current)
    assert exchange_report.export_total(rows.where("user_id = 3")).first().tier_ratio == 0
    nothing = exchange_report.export_total(rows.where("user_id = 99")).first().asDict()
    assert set(nothing.values()) == {0}


def test_export_file_has_headers_days_and_total(exchange, tmp_path):
    rows = exchange_report.daily_rows(*exchange, PERIOD.current)
    export.write_table(exchange_report.export_table(rows, "user_id"), f"{tmp_path}/all", "user_id")
    files = list(Path(f"{tmp_path}/all/user_id=1").glob("*.csv"))
    assert len(files) == 1
    lines = list(csv.DictReader(files[0].open()))
    assert [line["Date"] for line in lines] == ["08.01.2024", "09.01.2024", "Total"]
    assert list(lines[0])[:4] == ["Date", "Source Shows", "Source Clicks", "Source CTR"]
    assert (lines[2]["Source CTR"], lines[2]["TP ratio"], lines[2]["Exchange delta"]) == ("5.0000", "0.5000", "2")

    export.write_table(exchange_report.export_table(rows.where("user_id = 1")), f"{tmp_path}/one")
    text = "".join(file.read_text() for file in sorted(Path(f"{tmp_path}/one").glob("*.csv")))
    assert [line.split(",")[0] for line in text.splitlines() if not line.startswith("Date")] == ["08.01.2024", "09.01.2024", "Total"]


def test_json_rows(spark):
    rows = [(1, "<b>\"x\" &amp; 'y'</b>", "12", True, None, [("a&b",)])]
    df = spark.createDataFrame(rows, "n int, s string, num string, ok boolean, gone string, inner array<struct<t:string>>")
    escaped = json.loads(export.json_rows(df, escape=True).first().json)
    assert escaped == {
        "n": 1, "s": "&lt;b&gt;&quot;x&quot; &amp; &#039;y&#039;&lt;/b&gt;", "num": "12", "ok": True,
        "gone": None, "inner": [{"t": "a&amp;b"}],
    }
    assert json.loads(export.json_rows(df).first().json)["s"] == rows[0][1]


def test_json_files(spark, tmp_path):
    export.write_json_rows(spark.range(3), f"{tmp_path}/json")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/json").collect()) == ['{"id":0}', '{"id":1}', '{"id":2}']


def test_weekend_flag(spark):
    days = ["2024-01-06", "2024-01-13", "2024-01-14", "2024-01-01", "2024-01-08"]
    df = spark.createDataFrame([(date.fromisoformat(d),) for d in days], "day date")
    custom = spark.createDataFrame(
        [(date(2024, 1, 6), True), (date(2024, 1, 1), False)], SCHEMAS["custom_workdays"]
    )
    flags = {str(r.day): r.is_weekend for r in workdays.with_weekend_flag(df, "day", custom).collect()}
    assert flags == dict(zip(days, [0, 1, 1, 1, 0]))


def test_available_months_fall_back_to_this_month(spark):
    now = datetime(2024, 5, 17, 12)
    facts = spark.createDataFrame([(date(2024, 1, 6),), (date(2024, 1, 7),), (date(2023, 12, 1),)], "day date")
    assert sorted(str(r.period) for r in workdays.available_months(facts, "day", now).collect()) == ["2023-12-01", "2024-01-01"]
    assert [str(r.period) for r in workdays.available_months(facts.limit(0), "day", now).collect()] == ["2024-05-01"]


def test_referrers(spark):
    visits = spark.createDataFrame(
        [(1, 5, 7), (2, 99, 7), (3, 0, 7), (4, None, 8), (5, 0, None)], SCHEMAS["visits"]
    )
    known = spark.createDataFrame([(5,), (7,)], "id long")
    got = {r.visit_id: r.referrer_id for r in with_referrer(visits, known).collect()}
    assert got == {1: 5, 2: None, 3: 7, 4: 8, 5: None}


def test_one_hot_referrer_is_spread_and_stays_exact(spark):
    visits = spark.range(30_000).selectExpr(
        "id AS visit_id", "CASE WHEN id % 3 = 0 THEN 1 WHEN id % 3 = 1 THEN 0 ELSE id END AS ref_id", "7L AS cookie_ref_id"
    )
    known = spark.range(1, 20_000)
    credited = with_referrer(visits, known)
    expected = visits.join(known.withColumnRenamed("id", "k"), F.col("ref_id") == F.col("k"), "left").selectExpr(
        "visit_id", "IF(ref_id != 0, k, cookie_ref_id) AS referrer_id"
    )
    got = credited.select("visit_id", "referrer_id")
    assert got.exceptAll(expected).count() == expected.exceptAll(got).count() == 0


def test_sums_of_mixed_columns(spark):
    df = spark.createDataFrame([(1, "x", None, True), (None, " 2.5 ", 1.5, False)], "a int, b string, c double, d boolean")
    assert sum_by_columns(df).first().asDict() == {"a": 1, "b": 2.5, "c": 1.5, "d": 0}
    assert sum_by_columns(df.limit(0)).first().asDict() == {"a": 0, "b": 0, "c": 0, "d": 0}
    entries = spark.createDataFrame([({"a": "1", "b": "x"},), ({"a": "2.5", "c": "1d", "e": "0x1"},)], "e map<string,string>")
    assert {r.key: r.total for r in sum_by_keys(entries, "e").collect()} == {"a": 3.5, "b": 0, "c": 0, "e": 0}


def test_facts_are_read_by_partition(spark, tmp_path):
    from checks.queries import MONTH
    from adtally.operators.window_sums import site_window_sums
    from adtally.sources import synthetic

    facts = synthetic.day_sell_from_orders(spark, "/root/testdata/sf0.001")
    write_day_partitioned(facts.where("year(day) = 1997"), f"{tmp_path}/day_sell", "day")
    stored = read_table(spark, str(tmp_path), "day_sell")
    sums = site_window_sums(stored, MONTH)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    direct = site_window_sums(facts, MONTH)
    assert sums.exceptAll(direct).count() == direct.exceptAll(sums).count() == 0
