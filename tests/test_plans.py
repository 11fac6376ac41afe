"""Shape of the physical plans: scans, shuffles and pushed filters."""

import pytest

from pyspark.sql import functions as F

from adtally.operators import filters
from adtally.operators.attribution import with_referrer
from adtally.operators.window_sums import COUNTERS, MONEY
from adtally.plans.account_search import AccountSearch, ManagerScope
from adtally.plans.sell_report import SellReport
from adtally.sources import synthetic
from adtally.sources.tables import SellTables
from checks.queries import MONTH, line_report, month_report, queries, today_report


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def node_count(df, name):
    return sum(line.lstrip(" :+-").startswith(name) for line in plan(df).splitlines())


def test_totals_scan_the_facts_once_and_shuffle_once_per_site(spark, sf_dir):
    total = month_report(spark, sf_dir).total()
    assert plan(total).count("FileScan") == 1
    assert plan(total).count("Exchange hashpartitioning") == 1
    assert "Join" not in plan(total)


def test_period_reaches_the_scan(spark, sf_dir):
    text = plan(month_report(spark, sf_dir).rows())
    assert "GreaterThanOrEqual(o_orderdate,1997-01-29" in text
    assert "o_orderpriority" not in text


def test_lookback_filter_adds_no_scan(spark, sf_dir):
    total = month_report(spark, sf_dir).where(filters.by_publisher_status("new")).total()
    assert plan(total).count("FileScan") == 1


def test_facts_are_aggregated_before_any_join_unless_filtered(spark, sf_dir):
    for by_publisher in (False, True):
        lines = plan(line_report(spark, sf_dir, by_publisher).rows()).splitlines()
        scan = next(i for i, line in enumerate(lines) if "l_suppkey" in line and "FileScan" in line)
        above = [line.lstrip(" :+-") for line in lines[:scan]]
        below_joins = above[max(i for i, line in enumerate(above) if "Join" in line) + 1 :]
        assert sum(line.startswith("HashAggregate") or "HashAggregate" in line for line in below_joins) >= 2


def test_limited_page_is_a_top_k(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(month_report(spark, sf_dir).page(3, 20))
    assert "rangepartitioning" in plan(month_report(spark, sf_dir).page(items=0))


def test_type_pages_are_cut_before_the_shuffle(spark, sf_dir):
    accounts = synthetic.accounts_from_parties(spark, sf_dir)
    page = AccountSearch(accounts, {"email": "a"}, ManagerScope("all", 1)).page()
    lines = [line for line in plan(page).splitlines() if "WindowGroupLimit" in line or "Exchange" in line]
    assert [("Partial" in line, "Exchange" in line) for line in lines] == [(False, False), (False, True), (True, False)]


def shuffled_sites(spark, n=400):
    """Tables whose site attributes do not follow from the site id; site 7 has half of all facts."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(n))).alias("site_id"))
    zeros = [F.lit(1).cast("long").alias(m) for m in COUNTERS + ("block_shows_empty",)] + [F.lit(1).cast("decimal(16,4)").alias(m) for m in MONEY]
    facts = rows.select("site_id", F.lit("1997-03-11").cast("date").alias("day"), *zeros)
    drawn = F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(20))
    sites = spark.range(n).select(
        "id", F.concat(F.lit("s"), "id").alias("name"), F.lit("u").alias("url"), (drawn + 1).alias("seller_id"), drawn.cast("int").alias("country_id"),
        F.lit("cpc").alias("profit_type"), F.when(drawn > 2, drawn.cast("int")).alias("min_teaser_rating"), F.lit(None).cast("decimal(16,4)").alias("min_ad_price"),
        F.lit(None).cast("array<long>").alias("buyer_target"),
    )
    users = spark.range(1, 21).select("id", F.concat(F.lit("u"), "id").alias("email"), F.lit(1).alias("subsystem_id"), F.lit(True).alias("is_exchanger"), F.lit(False).alias("is_disabled"))
    return SellTables(facts, sites, users)


@pytest.mark.parametrize("threshold", ["10m", "-1"])
@pytest.mark.parametrize("make, value", [(filters.by_country, 3), (filters.by_user, "u4"), (filters.by_user, "5"), (filters.by_min_teaser_rating, [3, None])])
def test_filters_narrow_the_facts_before_they_are_summed(spark, threshold, make, value):
    one, tables = make(value), shuffled_sites(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        report = SellReport(tables, MONTH).where(one)
        text = report.total()._jdf.queryExecution().optimizedPlan().toString()
        lines = text.splitlines()
        sums = max(i for i, line in enumerate(lines) if "Aggregate [site_id" in line)
        joins = [i for i, line in enumerate(lines) if "Join LeftSemi" in line or "Join LeftAnti" in line]
        assert joins and max(joins) > sums
        whole = SellReport(tables, MONTH)
        wanted = {r.site_id for r in whole.spine().where(one.condition).collect()}
        assert {r.id for r in report.rows().collect()} == wanted
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_marks_are_joined_only_for_their_filter(spark, sf_dir):
    report = month_report(spark, sf_dir)
    assert plan(report.rows()).count("nation.parquet") == 1
    assert plan(report.where(filters.by_marks({"source": "s1"})).rows()).count("nation.parquet") == 2


REGISTERED = list(queries())


@pytest.mark.parametrize("name", REGISTERED)
def test_no_cross_joins_and_no_broadcast_beyond_the_threshold(spark, sf_dir, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(queries()[name](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BroadcastExchange" not in text


def test_building_a_query_starts_no_job(spark, sf_dir):
    """The first build of a query may read the schemas of files."""
    tracker = spark.sparkContext.statusTracker()
    for name in REGISTERED:
        queries()[name](spark, sf_dir)
    spark.sparkContext.setJobGroup("second build", "")
    try:
        for name in REGISTERED:
            queries()[name](spark, sf_dir)
            assert not [j for j in tracker.getJobIdsForGroup("second build") if not is_schema_read(tracker, j)], name
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def is_schema_read(tracker, job):
    """A job of one stage that reads the footer of a file, which each ``spark.read.parquet`` starts."""
    stages = tracker.getJobInfo(job).stageIds
    return len(stages) == 1 and (info := tracker.getStageInfo(stages[0])) is not None and info.name.startswith("parquet at")


def test_row_work_on_texts_needs_no_shuffle(spark, sf_dir):
    for name in ("clean_numbers", "cyr_to_latin", "sanitize_title", "smart_trim", "bytes_human", "smart_encode", "smart_decode"):
        assert "Exchange" not in plan(queries()[name](spark, sf_dir)), name


def test_visits_without_a_request_are_dealt_out_evenly(spark):
    rows = spark.range(40_000).select(
        F.col("id").alias("visit_id"), F.when(F.col("id") % 20 == 0, F.col("id") % 300).otherwise(0).alias("ref_id"), F.lit(1).cast("long").alias("cookie_ref_id")
    )
    known = spark.range(1, 200).select("id")
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        joined = with_referrer(rows, known)
        sizes = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 1.3 * sum(sizes) / len(sizes) and len(sizes) == 8
        assert joined.where("ref_id = 0 AND referrer_id = 1").count() == rows.where("ref_id = 0").count()
        assert joined.where("ref_id > 199 AND referrer_id IS NOT NULL").count() == 0
    finally:
        for key in keys:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_today_reads_each_grain_once(spark, sf_dir):
    assert plan(today_report(spark, sf_dir).total()).count("FileScan") == 2


def test_the_page_of_a_panel_is_worked_out_once(spark, sf_dir):
    text = plan(queries()["page_panel"](spark, sf_dir))
    assert text.count("TakeOrderedAndProject") == 1
    assert text.count("FileScan") <= 8


@pytest.mark.parametrize("name", ["filter_manager_scoped", "filter_group_empty_keeps_scope", "search_scope"])
def test_a_scope_walks_its_group_tree_once_for_each_use(spark, sf_dir, name):
    assert plan(queries()[name](spark, sf_dir)).count("FileScan") <= 12
