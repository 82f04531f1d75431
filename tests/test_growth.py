"""Marts that grow by new files against full builds over the same trips."""

import shutil

import pytest
from pyspark.sql import functions as F

from hackney.operators import metrics, trips
from hackney.plans import control, daily, growth
from hackney.plans.model import MARTS as MART_TABLES
from hackney.plans.model import Model
from hackney.plans.warehouse import MARTS, QUARANTINE, STAGING, Warehouse
from hackney.schemas import SOURCE_COLUMNS
from hackney.sources.event_trips import trips_from_events
from hackney.streaming.new_files import load_new_files, read_new_trips
from tables import DATA

CLEAN = "try_cast(pickup_datetime as timestamp) is not null and pickup_latitude is not null"


@pytest.fixture
def warehouse(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "tables"))


def put(spark, folder, condition):
    found = trips_from_events(spark, f"{DATA}/sf0.001").filter(condition).select(*SOURCE_COLUMNS)
    found.coalesce(1).write.mode("append").options(header="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(str(folder))


def bag(frame):
    frame = frame.drop("dbt_updated_at", trips.PICKUP_DATE)
    return sorted(map(repr, frame.select(*sorted(frame.columns)).collect()))


def same_as_a_full_build(warehouse, tables=("dim_datetime", "dim_location", "fact_trip")):
    typed = Model(warehouse.spark, read_new_trips(warehouse)).typed.cache()
    model = Model(warehouse.spark, written=typed)
    for name in tables:
        frame = getattr(model, name)
        assert bag(warehouse.read_one(MARTS, name)) == bag(frame), name
    assert bag(warehouse.read_one(QUARANTINE, growth.REJECTED)) == bag(model.quarantine_trips)
    typed.unpersist()


def same_metrics(warehouse):
    model = Model(warehouse.spark, written=Model(warehouse.spark, read_new_trips(warehouse)).typed.cache())
    growth.publish_metrics(warehouse)
    fact, located = model.fact_trip, metrics.located_trips(model.valid_trips)
    wanted = {
        "kpi_summary": metrics.kpi_summary(fact),
        "tips_by_payment_type": metrics.tips_by_payment_type(fact, model.dim_payment_type),
        "demand_by_day_hour": metrics.demand_by_day_hour(fact),
        "fare_by_borough": metrics.fare_by_borough(located),
        "demand_by_grid": metrics.demand_by_grid(located),
        "trip_efficiency": metrics.trip_efficiency(located),
        "trip_route_boroughs": metrics.routes_by_own_boroughs(located),
        "trips_by_borough": metrics.trips_by_own_borough(located),
    }
    for name, frame in wanted.items():
        assert bag(warehouse.read_one(growth.METRICS, name)) == bag(frame), name


BATCHES = ["day(pickup_datetime) % 4 = 0", "day(pickup_datetime) % 4 = 1 or pickup_datetime is null", "day(pickup_datetime) % 4 > 1 or pickup_datetime = 'not-a-date'"]
BATCHES = [condition.replace("day(pickup_datetime)", "coalesce(day(try_cast(pickup_datetime as timestamp)), -100)") for condition in BATCHES]


def test_three_batches_equal_a_full_build(spark, warehouse, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    assert growth.grow(warehouse) == 0
    for condition in BATCHES:
        put(spark, folder, condition)
        load_new_files(warehouse, str(folder))
        assert growth.grow(warehouse) == 1
    assert growth.grow(warehouse) == 0 and growth.new_batches(warehouse) == {}
    same_as_a_full_build(warehouse, MART_TABLES)
    same_metrics(warehouse)
    # A null key is one row of the dimension, though two batches have it.
    assert warehouse.read_one(MARTS, "dim_datetime").filter("datetime_key is null").count() == 1
    # Few files a day, and each day is one folder.
    days = warehouse.parts(MARTS, "fact_trip")
    files = warehouse.read_one(MARTS, "fact_trip").select(F.input_file_name().alias("f"), trips.PICKUP_DATE).distinct()
    assert files.count() == len(days) == files.select(trips.PICKUP_DATE).distinct().count()


def test_only_the_days_of_the_batch_are_written_and_read(spark, warehouse, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(spark, folder, BATCHES[0])
    load_new_files(warehouse, str(folder))
    growth.grow(warehouse)
    before = warehouse.parts(MARTS, "fact_trip")
    cells = warehouse.parts(growth.METRICS, "hourly_cells")
    one_day = sorted(before)[1]
    put(spark, folder, f"left(pickup_datetime, 10) = '{one_day}'")
    load_new_files(warehouse, str(folder))
    # Days that the batch does not touch could not even be read.
    hidden = {day: path for day, path in before.items() if day != one_day}
    for number, path in enumerate(hidden.values()):
        shutil.move(path, tmp_path / f"hidden-{number}")
    assert growth.grow(warehouse) == 1
    for number, path in enumerate(hidden.values()):
        shutil.move(tmp_path / f"hidden-{number}", path)
    after = warehouse.parts(MARTS, "fact_trip")
    assert {day for day in after if after[day] != before.get(day)} == {one_day}
    assert {day for day, path in warehouse.parts(growth.METRICS, "hourly_cells").items() if path != cells.get(day)} == {one_day}
    same_as_a_full_build(warehouse)


def test_a_failed_run_leaves_nothing(spark, warehouse, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    put(spark, folder, f"({BATCHES[0]}) and {CLEAN}")
    load_new_files(warehouse, str(folder))
    growth.grow(warehouse)
    rows = bag(warehouse.read_one(MARTS, "fact_trip"))
    put(spark, folder, f"({BATCHES[1]}) and {CLEAN}")
    load_new_files(warehouse, str(folder))
    with monkeypatch.context() as patch:
        patch.setattr(Warehouse, "point_to_all", lambda *_: (_ for _ in ()).throw(OSError("no log")))
        with pytest.raises(OSError, match="no log"):
            growth.grow(warehouse)
    assert bag(warehouse.read_one(MARTS, "fact_trip")) == rows and len(growth.new_batches(warehouse)) == 1
    assert growth.grow(warehouse) == 1
    same_as_a_full_build(warehouse)


def test_batches_without_a_valid_trip(spark, warehouse, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for condition in ("trip_distance = '0.0'", "trip_distance = '0.0'", f"({BATCHES[0]}) and {CLEAN}"):
        put(spark, folder, condition)
        load_new_files(warehouse, str(folder))
        assert growth.grow(warehouse) == 1
        growth.publish_metrics(warehouse)
        assert warehouse.read_one(growth.METRICS, "kpi_summary").first().total_trips == warehouse.read_one(MARTS, "fact_trip").count()
    same_as_a_full_build(warehouse, ["fact_trip"])


def test_a_full_build_without_a_valid_trip(spark, warehouse):
    none = trips_from_events(spark, f"{DATA}/sf0.001").filter("trip_distance = '0.0'")
    daily.stage_trips(warehouse, none)
    daily.build_marts(warehouse)
    assert warehouse.read_one(MARTS, "fact_trip").count() == 0


def test_many_parts_become_one(spark, warehouse, tmp_path, monkeypatch):
    monkeypatch.setattr(growth, "MOST_PARTS", 2)
    folder = tmp_path / "in"
    folder.mkdir()
    for number, condition in enumerate(BATCHES):
        put(spark, folder, condition)
        load_new_files(warehouse, str(folder))
        growth.grow(warehouse)
        assert len(warehouse.parts(MARTS, "dim_location")) == [1, 2, 1][number]
    same_as_a_full_build(warehouse)


def test_growth_after_a_full_build_starts_anew(spark, warehouse, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(spark, folder, f"({BATCHES[0]}) and {CLEAN}")
    load_new_files(warehouse, str(folder))
    daily.stage_trips(warehouse, read_new_trips(warehouse))
    daily.build_marts(warehouse)
    assert growth.grow(warehouse) == 1
    same_as_a_full_build(warehouse)
    # And a full build after it takes the place of the parts.
    put(spark, folder, f"({BATCHES[1]}) and {CLEAN}")
    daily.main(["--root", warehouse.root, "--source", str(folder), "--new-files", "load"])
    daily.main(["--root", warehouse.root, "--new-files", "marts"])
    model = Model(spark, read_new_trips(warehouse))
    assert bag(warehouse.read_one(MARTS, "fact_trip")) == bag(model.fact_trip)
    assert bag(warehouse.read_one(MARTS, "dim_location")) == bag(model.dim_location)
    daily.publish_metrics(warehouse)
    daily.main(["--root", warehouse.root, "--new-files", "grow"])
    same_as_a_full_build(warehouse)


def test_daily_run_with_new_files_grows(spark, warehouse, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for condition in BATCHES[:2]:
        put(spark, folder, f"({condition}) and {CLEAN}")
        daily.daily_run(warehouse, str(folder), new_files_only=True)
    same_as_a_full_build(warehouse)
    fact = warehouse.read_one(MARTS, "fact_trip")
    shown = spark.table("MARTS.fact_trip")
    assert shown.count() == fact.count() and spark.table("MARTS.dim_location").count() == warehouse.read_one(MARTS, "dim_location").count()
    assert control.read_runs(warehouse).filter("execution_status = 'SUCCESS'").count() == 2


def plan_of(frame):
    frame.count()
    return frame._jdf.queryExecution().executedPlan().toString()


def test_a_filter_on_the_day_leaves_out_the_others(spark, warehouse):
    model = Model(spark, trips_from_events(spark, f"{DATA}/sf0.001").filter(CLEAN))
    warehouse.publish(STAGING, {daily.STAGED_TRIPS: model.typed})
    daily.build_marts(warehouse)
    days = sorted(warehouse.parts(MARTS, "fact_trip"))
    assert len(days) > 3
    warehouse.register()
    for fact in (warehouse.read_one(MARTS, "fact_trip"), spark.table("MARTS.fact_trip")):
        one = fact.filter(F.col(trips.PICKUP_DATE) == F.lit(days[2]).cast("date"))
        assert "PartitionFilters: [isnotnull(pickup_date" in one._jdf.queryExecution().executedPlan().toString().replace("\n", "")
        assert one.count() == model.fact_trip.filter(F.to_date("pickup_datetime") == days[2]).count() > 0
        assert {row.f.split("pickup_date=")[1][:10] for row in one.select(F.input_file_name().alias("f")).distinct().collect()} == {days[2]}


def test_a_large_day_is_cut_into_files_of_bounded_size(spark, warehouse):
    """Twenty tasks each hold rows of three days, one of which is large; the days' files do not grow with the tasks."""
    rows = spark.range(200_000, numPartitions=20).selectExpr(
        "case when id % 10 < 8 then 'a' when id % 10 = 8 then 'b' else 'c' end as day", "md5(cast(id as string)) as text"
    )
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        warehouse.publish_observed(MARTS, {"t": rows}, by={"t": "day"})
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    table = warehouse.read_one(MARTS, "t")
    names = table.select("day", F.input_file_name().alias("f")).distinct()
    files = {row.day: row["count"] for row in names.groupBy("day").count().collect()}
    # Days that fall into one partition are cut together, so a small one can have as many files as the large one.
    assert 2 <= files["a"] <= 6 and max(files.values()) <= files["a"], files
    assert table.count() == 200_000


def test_new_keys_reads_the_key_alone(spark, warehouse):
    model = Model(spark, trips_from_events(spark, f"{DATA}/sf0.001"))
    warehouse.publish(MARTS, {"dim_location": model.dim_location})
    published = warehouse.read_one(MARTS, "dim_location")
    assert growth.new_keys(model.dim_location, published, "location_key").count() == 0
    some = growth.new_keys(model.dim_location, published.filter("borough <> 'Queens'"), "location_key")
    assert some.count() == published.filter("borough = 'Queens'").count() > 0
    plan = growth.new_keys(model.dim_location, published, "location_key")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<location_key:string>" in plan
