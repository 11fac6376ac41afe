"""Time the registered queries and count what they read and shuffle.

column is the staged SQL of the same query in one DuckDB process on the same machine.
"""

from __future__ import annotations

import statistics
import sys
import time

from adtally.session import local_session
from checks.compare import database
from checks.oracles import oracle_sql
from checks.queries import queries


def _stages(spark) -> list:
    gateway = spark.sparkContext._gateway
    store = spark.sparkContext._jsc.sc().statusStore()
    no_quantiles = gateway.new_array(gateway.jvm.double, 0)
    stages = store.stageList(None, False, False, no_quantiles, None)
    return [stages.apply(index) for index in range(stages.size())]


def main() -> None:
    root = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    runs = int(sys.argv[2]) if len(sys.argv) > 2 else 5
    spark, connection = local_session(8), database(root)
    registered, sql = queries(), oracle_sql()
    print("| query | Spark s | SQL s | rows read | shuffle KB | scans |")
    print("|---|---|---|---|---|---|")
    for name, query in registered.items():
        times = []
        for _ in range(runs + 1):
            before = {stage.stageId() for stage in _stages(spark)}
            start = time.perf_counter()
            df = query(spark, root)
            df.write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        mine = [stage for stage in _stages(spark) if stage.stageId() not in before]
        rows = sum(stage.inputRecords() for stage in mine)
        shuffled = sum(stage.shuffleWriteBytes() for stage in mine) / 1024
        scans = df._jdf.queryExecution().executedPlan().toString().count("FileScan")
        sql_times = []
        for _ in range(runs):
            start = time.perf_counter()
            connection.execute(sql[name]).fetchall()
            sql_times.append(time.perf_counter() - start)
        print(
            f"| {name} | {statistics.median(times[1:]):.2f} | {statistics.median(sql_times):.2f} "
            f"| {rows} | {shuffled:.0f} | {scans} |",
            flush=True,
        )
    spark.stop()


if __name__ == "__main__":
    main()
