"""Running totals, hourly batches and the trigram index: stored forms that give what the plain ones give."""

import random
from dataclasses import replace
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from adtally.operators import cumulative, distinct_bitmaps, hour_batches, trigram_index
from adtally.operators.periods import Period, Window, lookback_before
from adtally.operators.window_sums import COMPARED, MEASURES, MONEY, site_window_sums
from adtally.plans.sell_report import SellReport
from adtally.sources import synthetic
from adtally.sources.tables import SCHEMAS
from checks.queries import MONTH, TODAY


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    return sorted(map(tuple, a.select(columns).collect()), key=repr) == sorted(map(tuple, b.select(columns).collect()), key=repr)


@pytest.fixture(scope="module")
def facts(spark):
    """Day facts of some sites with gaps, a hot site, several rows a day, nulls and values below zero."""
    rng = random.Random(6)

    def row(site, day):
        counters = [rng.choice([None, rng.randrange(-5, 1000)]) for _ in range(6)]
        money = [rng.choice([None, Decimal(rng.randrange(-(10**6), 10**9)).scaleb(-4)]) for _ in range(4)]
        return (site, date(2024, 1, 1) + timedelta(day), *counters, *money)

    rows = [row(1, rng.randrange(120)) for _ in range(900)] + [row(s, rng.randrange(120)) for s in range(2, 40) for _ in range(rng.randrange(8))]
    rows += [row(50, 30), row(51, 119), row(None, 40)]
    return spark.createDataFrame(rows, SCHEMAS["day_sell"])


PERIODS = [("2024-03-01", "2024-03-31"), ("2024-02-10", "2024-02-10"), ("2024-01-01", "2024-04-29"), ("2023-12-01", "2024-01-05"), ("2024-06-01", "2024-06-30")]


@pytest.mark.parametrize("start, end", PERIODS)
def test_windows_from_running_totals(spark, facts, start, end):
    period = Period.of(start, end, "2025-01-01T00:00:00")
    lookback = lookback_before(period.current.start)
    wanted = site_window_sums(facts.where("site_id IS NOT NULL"), period, lookback=lookback)
    every = F.sequence(F.lit(date(2023, 6, 1)), F.lit(date(2024, 7, 31)))
    for days in (every, cumulative.array_of(cumulative.days_of(period, lookback))):
        found = cumulative.cumulative_window_sums(cumulative.running_totals(facts, days), period, lookback)
        assert same(found, wanted)


def test_days_are_appended_one_by_one(spark, facts, tmp_path):
    folder, first = str(tmp_path / "totals"), date(2024, 1, 28)
    start = cumulative.running_totals(facts, cumulative.array_of([first]))
    start.write.partitionBy("day").parquet(folder)
    for n in range(1, 6):
        day = first + timedelta(n)
        stored = spark.read.schema(start.schema).parquet(folder)
        cumulative.next_day(stored, facts, day).write.mode("append").partitionBy("day").parquet(folder)
    last = first + timedelta(5)
    wanted = cumulative.running_totals(facts, F.sequence(F.lit(first), F.lit(last)))
    stored = spark.read.schema(start.schema).parquet(folder)
    assert same(stored, wanted)
    assert cumulative.next_day(stored.limit(0), facts.limit(0), last).count() == 0


def test_a_report_reads_the_edges_of_its_windows(spark, sf_dir, tmp_path):
    tables = synthetic.order_tables(spark, sf_dir)
    every = F.sequence(F.lit(date(1996, 12, 1)), F.lit(date(1997, 4, 30)))
    folder = str(tmp_path / "totals")
    totals = cumulative.running_totals(tables.day_sell, every)
    totals.write.partitionBy("day").parquet(folder)
    stored = spark.read.schema(totals.schema).parquet(folder)
    report = SellReport(replace(tables, cumulative_sell=stored), MONTH)
    assert same(report.rows(), SellReport(tables, MONTH).rows())
    total = report.total()
    assert same(total, SellReport(tables, MONTH).total())
    scans = [line for line in plan(total).splitlines() if "FileScan" in line]
    assert len(scans) == 1 and "orders.parquet" not in scans[0]
    assert [str(day) for day in cumulative.days_of(MONTH)] == ["1997-01-28", "1997-02-28", "1997-03-31"]
    assert "PartitionFilters: [day" in plan(total) and plan(total).count("Exchange hashpartitioning(site_id") == 1


def test_money_that_is_no_decimal_has_no_running_totals(spark, facts):
    with pytest.raises(ValueError):
        cumulative.running_totals(facts.withColumn("profit", F.col("profit").cast("double")), cumulative.array_of([date(2024, 1, 1)]))
    with pytest.raises(ValueError):
        cumulative.cumulative_window_sums(facts, Period.of("2024-01-01", "2024-01-02", "2024-01-02T10:00:00"))


@pytest.fixture(scope="module")
def deliveries(spark):
    rng = random.Random(7)
    rows = []
    for batch in range(30):
        content = []
        for _ in range(rng.randrange(1, 25)):
            hour = datetime(2024, 1, 20, rng.randrange(24)) - timedelta(days=rng.randrange(3))
            money = [Decimal(rng.randrange(10**8)).scaleb(-4) if name in MONEY else rng.choice([None, rng.randrange(50)]) for name in COMPARED]
            content.append((rng.randrange(6), hour, *money))
        for _ in range(1 + batch % 3):
            rows.append((f"b{batch}", rng.randrange(10**6), content))
    rows.append((None, 5, rows[0][2]))
    measures = ", ".join(f"{name} {'decimal(16,4)' if name in MONEY else 'long'}" for name in COMPARED)
    flat = [(batch, delivery, *r) for batch, delivery, content in rows for r in content]
    return spark.createDataFrame(flat, f"batch_id string, delivery long, site_id long, hour timestamp_ntz, {measures}").repartition(4)


def test_batches_in_any_order_and_repeated_count_once(spark, deliveries, tmp_path):
    first = deliveries.where("batch_id IS NOT NULL").groupBy("batch_id").agg(F.min("delivery").alias("delivery"))
    wanted = hour_batches.hour_facts(hour_batches.batch_sums(deliveries.join(first, ["batch_id", "delivery"])))
    for seed in range(2):
        folder = str(tmp_path / f"state{seed}")
        for part in range(4):
            rows = deliveries.where(F.pmod(F.xxhash64(F.lit(seed), "delivery", "batch_id"), F.lit(4)) == part)
            hour_batches.append(spark, folder, rows)
            hour_batches.append(spark, folder, rows)  # a run that was repeated
        state = hour_batches.read(spark, folder)
        assert same(hour_batches.hour_facts(state), wanted)
        assert state.select("batch_id").distinct().count() == 30
    empty = hour_batches.read(spark, str(tmp_path / "none"))
    assert same(hour_batches.merged(empty.drop("day"), deliveries), hour_batches.batch_sums(hour_batches.once(deliveries)))
    assert hour_batches.merged(empty.drop("day"), deliveries.limit(0)).count() == 0


def test_a_stream_of_batches_gives_the_same_state(spark, deliveries, tmp_path):
    folder, state = str(tmp_path / "arrivals"), str(tmp_path / "state")
    numbers = [r[0] for r in deliveries.where("batch_id IS NOT NULL").select("delivery").distinct().orderBy("delivery").collect()]
    for third in range(3):
        deliveries.where(F.col("delivery").isin(numbers[third::3])).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(deliveries.schema).parquet(folder)
        hour_batches.follow(spark, stream, state, str(tmp_path / "checkpoint")).awaitTermination()
    wanted = hour_batches.batch_sums(hour_batches.once(deliveries))
    assert same(hour_batches.hour_facts(hour_batches.read(spark, state)), hour_batches.hour_facts(wanted))


def test_late_hours_give_todays_report(spark, sf_dir, tmp_path):
    tables = synthetic.event_tables(spark, sf_dir)
    rows = tables.hour_sell.withColumn("batch_id", F.col("hour").cast("string"))
    folder = str(tmp_path / "state")
    for turn in (2, 0, 1, 2):  # the last hours first, and once more in the end
        hour_batches.append(spark, folder, rows.where(F.hour("hour") % 3 == turn).withColumn("delivery", F.lit(turn).cast("long")))
    late = replace(tables, hour_sell=hour_batches.hour_facts(hour_batches.read(spark, folder)))
    assert same(SellReport(late, TODAY).rows(), SellReport(tables, TODAY).rows())


@pytest.fixture(scope="module")
def addresses(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abcABC.-é/Ж") for _ in range(rng.randrange(0, 30)))) for i in range(3000)]
    rows += [(4000, None), (None, "abc"), (4001, "ab"), (4002, "a"), (4003, ""), (4004, "İstanbul-abc"), (4005, "aaaaaa"), (4006, "%a_b")]
    return spark.createDataFrame(rows, "id long, url string"), rows


@pytest.mark.parametrize("part", ["abc", "ABCA", "a", "Ab", "", "é/ж", "aaaa", "%a_", "-.", "abcabcabcabc", "b.a.b"])
def test_search_finds_what_contains_finds(spark, addresses, part, tmp_path):
    table, rows = addresses
    folder = str(tmp_path / "index")
    trigram_index.write(trigram_index.postings(table, "id", "url"), folder)
    found = trigram_index.containing(table, "id", "url", spark.read.parquet(folder), part)
    wanted = table.where("id IS NOT NULL").where(F.contains(F.lower("url"), F.lit(part.lower())))
    assert same(found, wanted)


def test_candidates_are_few_and_only_their_postings_are_read(spark, addresses, tmp_path):
    table, _ = addresses
    folder = str(tmp_path / "index")
    trigram_index.write(trigram_index.postings(table, "id", "url"), folder)
    index = spark.read.parquet(folder)
    for part in ("abc", "bcab", "a.-/"):
        found = trigram_index.containing(table, "id", "url", index, part).count()
        assert trigram_index.candidates(index, part).count() <= 3 * found
    assert "PushedFilters: [In(gram" in plan(trigram_index.candidates(index, "abcd"))
    assert "CartesianProduct" not in plan(trigram_index.containing(table, "id", "url", index, "abcd"))


def test_bitmaps_count_what_distinct_counts(spark, tmp_path):
    rng = random.Random(12)
    ids = [rng.choice([0, 1, -1, 32768, 32769, -32768, 10**12, -(10**12), rng.randrange(-(10**5), 10**5)]) for _ in range(4000)]
    rows = [(rng.choice([1, 1, 1, 2, 3]), date(2024, 1, 1) + timedelta(rng.randrange(40)), i) for i in ids] + [(None, date(2024, 1, 2), 5), (4, None, 5), (4, date(2024, 1, 2), None)]
    table = spark.createDataFrame(rows, "site_id long, day date, buyer_id long").repartition(5)
    folder, half = str(tmp_path / "bitmaps"), F.col("day") < F.lit(date(2024, 1, 20))
    first = distinct_bitmaps.daily_bitmaps(table.where(half))
    distinct_bitmaps.with_day(first, table.where(~half | (F.col("buyer_id") % 2 == 0))).write.partitionBy("day").parquet(folder)
    stored = spark.read.schema(first.schema).parquet(folder)
    for start, days in ((1, 1), (5, 20), (1, 40)):
        window = Window(date(2024, 1, start), date(2024, 1, start) + timedelta(days - 1))
        inside = table.where(F.col("day").between(window.start, window.end)).dropna()
        wanted = inside.groupBy("site_id").agg(F.count_distinct("buyer_id").alias("members"))
        assert same(distinct_bitmaps.distinct_in(stored, window), wanted)
        assert same(distinct_bitmaps.distinct_in(distinct_bitmaps.daily_bitmaps(table), window), wanted)
    assert distinct_bitmaps.distinct_in(first.limit(0), window).count() == 0
    text = plan(distinct_bitmaps.distinct_in(stored, window))
    assert text.index("partial_bitmap_or_agg") > text.index("Exchange hashpartitioning(site_id") and "PartitionFilters: [isnotnull(day" in text
