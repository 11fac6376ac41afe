"""Pages of stored reports are those of the report itself, and read the ranges they lie in."""

import pytest
from pyspark.sql import functions as F

from adtally.operators import paging, stored_pages
from adtally.plans.sell_report import SellReport
from checks import stored
from checks.compare import database, difference
from checks.queries import month_report


def files_read(df):
    scan = df._jdf.queryExecution().sparkPlan().collectLeaves().apply(0)
    return scan.selectedPartitions().totalNumberOfFiles()


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows share a value, some have none, and some values are there twice."""
    value = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 701)
    return spark.range(3000, numPartitions=4).select("id", value.cast("int").alias("value"), (F.col("id") * 2).alias("twice"))


@pytest.mark.parametrize("descending", [False, True])
def test_stored_pages_are_the_pages(spark, rows, tmp_path, descending):
    folder = str(tmp_path / "pages")
    stored_pages.write(rows, folder, "value", descending, ranges=12)
    assert spark.read.parquet(f"{folder}/ranges").count() == 12
    assert stored_pages.count(spark, folder).first().rows == 3000
    for page, items in [(0, 10), (1, 10), (2, 10), (30, 50), (59, 50), (60, 50), (61, 50), (99, 50), (2, 2000), (1, 5000), (1, 0)]:
        found = stored_pages.read(spark, folder, "value", descending, page, items)
        assert found.columns == rows.columns
        assert found.collect() == paging.page_of(rows, "value", descending, page, items).collect()
        if 0 < items <= 50 and page < 61:
            assert files_read(found) <= 2


def test_a_range_holds_part_of_a_frequent_value(spark, rows, tmp_path):
    folder = str(tmp_path / "pages")
    stored_pages.write(rows, folder, "value", ranges=12)
    largest = spark.read.parquet(f"{folder}/ranges").agg(F.max("rows")).first()[0]
    assert largest < 3000 / 12 * 2


def test_empty_reports_have_empty_pages(spark, rows, tmp_path):
    folder = str(tmp_path / "pages")
    stored_pages.write(rows.limit(0), folder, "value")
    assert stored_pages.read(spark, folder, "value").collect() == []
    assert stored_pages.count(spark, folder).first().rows == 0
    stored_pages.write(rows.limit(30), folder, "value")
    assert stored_pages.count(spark, folder).first().rows == 30


def test_pages_of_the_report(spark, sf_dir, tmp_path):
    report, folder = month_report(spark, sf_dir), str(tmp_path / "pages")
    report.store_pages(folder, "src_ctr", True)
    for page in (1, 3, 20):
        assert SellReport.stored_page(spark, folder, page, 50, True).collect() == report.page(page, 50, "src_ctr", True).collect()


def test_every_stored_query_has_sql():
    assert set(stored.queries()) == set(stored.oracle_sql())


@pytest.mark.parametrize("name", list(stored.queries()))
def test_stored_queries_match_sql(spark, sf_dir, name):
    assert difference(spark, database(sf_dir), sf_dir, name) is None


@pytest.mark.parametrize("name", list(stored.queries()))
def test_stored_queries_have_no_cross_joins(spark, sf_dir, name):
    text = stored.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
