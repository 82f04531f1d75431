"""Times the headline queries and prints one line of JSON.

`BENCH_SF_DIR` names the folder of tables, `BENCH_CPUS` the cores and
`BENCH_QUERIES` the queries (all registered ones if it is `all`). Every query
is run three times in full, its rows going nowhere; the middle time counts.

The headline queries read the events alone. They are written once, before the
clock runs, to one file per core: a single file of one row group is read by one
task, and the time would be that task's.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from hackney.plans.registry import queries
from hackney.session import build_session

HEADLINE = [
    "stg_trips",
    "fact_trip",
    "quarantine_trips",
    "reject_summary",
    "dim_datetime",
    "dim_location",
    "trip_route_boroughs",
    "dq_report",
    "kpi_summary",
    "trips_by_borough",
    "fare_by_borough",
    "trips_by_time_of_day",
    "tips_by_payment_type",
    "revenue_by_rate_code",
    "demand_by_day_hour",
    "demand_by_grid",
    "trip_efficiency",
]
RUNS = 3


def in_parts(spark, folder: str, parts: int, place: str) -> str:
    """The folder of the events, written as so many files."""
    spark.read.parquet(f"{folder}/events.parquet").repartition(parts).write.parquet(f"{place}/events.parquet")
    return place


def main() -> None:
    with tempfile.TemporaryDirectory(prefix="hackney-bench-") as place:
        run(place)


def run(place: str) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    registered = queries()
    names = list(registered) if chosen == "all" else chosen.split() or HEADLINE
    settings = {
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": f"{place}/shared",
    }
    spark = build_session(f"local[{cpus}]", "hackney-bench", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    given = in_parts(spark, folder, int(cpus), f"{place}/tables") if set(names) <= set(HEADLINE) else folder
    for name in names:
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            registered[name](spark, given).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    spark.stop()
    result = {
        "metric": "seconds for all headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
