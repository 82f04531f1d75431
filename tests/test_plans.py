import json
import shutil
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tables import DATA
from hackney.operators import metrics, quality
from hackney.plans import control, daily
from hackney.plans.warehouse import AUDIT, CONTROL, MARTS, QUARANTINE, RAW, NotPublished, Warehouse, schema_name
from hackney.schemas import AUDIT_SCHEMA, BOOKMARK_SCHEMA, RAW_COLUMNS, RAW_SCHEMA, SOURCE_COLUMNS
from hackney.sources.event_trips import trips_from_events
from hackney.sources.trip_files import WrongColumnCount, WrongHeader
from hackney.streaming.new_files import NEW_TRIPS, load_new_files, read_new_bad_lines, read_new_trips

HEADER = ",".join(f"c{i}" for i in range(19))
GOOD = "1,2016-03-01 10:00:00,2016-03-01 10:12:00,1,2.5,-73.98,40.75,1,N,-73.95,40.78,1,9.0,0.5,0.5,2.05,0.0,0.3,12.35"
SHORT = "2,2016-03-01 11:00:00"
LONG = GOOD + ",surplus"


def write(path, *lines):
    path.write_text("\n".join([HEADER, *lines]) + "\n")
    return str(path)


@pytest.fixture
def warehouse(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "tables"))


def newest_run(warehouse):
    return control.read_runs(warehouse).orderBy(F.col("execution_end").desc()).first()


def test_load_then_skip(warehouse, tmp_path):
    source = write(tmp_path / "trips.csv", *[GOOD] * 5)
    first = daily.load(warehouse, source)
    assert (first.status, first.rows_extracted, first.rows_loaded, first.rows_rejected) == ("SUCCESS", 5, 5, 0)
    raw = warehouse.read_one(RAW, daily.RAW_TRIPS)
    assert raw.columns == RAW_COLUMNS and raw.schema == RAW_SCHEMA
    rows = raw.collect()
    assert len({row.raw_id for row in rows}) == 5
    assert {(row.batch_id, row.pipeline_run_id, row.source_file) for row in rows} == {
        (daily.BATCH_ID, first.run_id, "trips.csv")
    }
    assert raw.collect() == rows
    second = daily.load(warehouse, source)
    assert (second.status, second.rows_loaded) == ("SKIPPED", 0)
    assert warehouse.read_one(RAW, daily.RAW_TRIPS).collect() == rows
    runs = control.read_runs(warehouse)
    assert runs.schema == AUDIT_SCHEMA
    assert [row.execution_status for row in runs.orderBy("execution_end").collect()] == ["SUCCESS", "SKIPPED"]
    bookmark = warehouse.read_log(CONTROL, control.WATERMARKS, BOOKMARK_SCHEMA).first()
    assert (bookmark.source_name, bookmark.last_processed_row, bookmark.total_rows_loaded) == (daily.SOURCE_NAME, 5, 5)
    assert (bookmark.last_processed_file, bookmark.status) == ("trips.csv", "SUCCESS")


def test_bookmark_without_rows(warehouse):
    assert control.read_bookmark(warehouse, "nothing") == control.Bookmark(0, 0)


def test_newest_bookmark_of_the_source_counts(warehouse):
    control.move_bookmark(warehouse, "a", 5, 5, "one.csv")
    control.move_bookmark(warehouse, "a", 9, 9, "two.csv")
    control.move_bookmark(warehouse, "b", 1, 1, "three.csv")
    assert control.read_bookmark(warehouse, "a") == control.Bookmark(9, 9)
    assert control.read_bookmark(warehouse, "a", before_file="two.csv") == control.Bookmark(5, 5)


def test_bad_lines_go_to_quarantine(warehouse, tmp_path):
    run = daily.load(warehouse, write(tmp_path / "trips.csv", GOOD, SHORT, GOOD, LONG))
    assert (run.rows_extracted, run.rows_loaded, run.rows_rejected) == (4, 2, 2)
    assert warehouse.read_one(RAW, daily.RAW_TRIPS).count() == 2
    bad = warehouse.read_one(QUARANTINE, daily.BAD_LINES)
    assert sorted(row.bad_line for row in bad.collect()) == sorted([SHORT, LONG])


def test_bad_lines_can_stop_the_load(warehouse, tmp_path):
    daily.load(warehouse, write(tmp_path / "empty.csv"))
    with pytest.raises(daily.BadLines):
        daily.load(warehouse, write(tmp_path / "trips.csv", GOOD, SHORT), fail_on_bad_lines=True)
    assert warehouse.read_one(RAW, daily.RAW_TRIPS).count() == 0
    run = newest_run(warehouse)
    assert run.execution_status == "FAILED" and "wrong number" in run.failure_reason


def test_wrong_column_count_fails_and_is_logged(warehouse, tmp_path):
    source = tmp_path / "trips.csv"
    source.write_text("a,b\n1,2\n")
    with pytest.raises(WrongColumnCount):
        daily.load(warehouse, str(source))
    run = newest_run(warehouse)
    assert (run.execution_status, run.rows_loaded) == ("FAILED", 0)
    assert "2 columns" in run.failure_reason
    with pytest.raises(NotPublished):
        warehouse.read_one(RAW, daily.RAW_TRIPS)
    assert control.read_bookmark(warehouse, daily.SOURCE_NAME).total_rows_loaded == 0


def many_files(folder, other_header, number=30):
    """Files of a good line each, one of which has other header."""
    folder.mkdir()
    for place in range(number):
        write(folder / f"f{place:02}.csv", GOOD)
    (folder / "f17.csv").write_text("\n".join([other_header, GOOD, GOOD, SHORT]) + "\n")


SWAPPED = HEADER.replace("c9,c10", "c10,c9")


def test_one_file_with_swapped_columns_stops_the_load(warehouse, tmp_path):
    many_files(tmp_path / "in", SWAPPED)
    with pytest.raises(WrongHeader, match="1 files have another header.*f17.csv"):
        daily.load(warehouse, str(tmp_path / "in"))
    assert newest_run(warehouse).execution_status == "FAILED"
    with pytest.raises(NotPublished):
        warehouse.read_one(RAW, daily.RAW_TRIPS)
    write(tmp_path / "in" / "f17.csv", GOOD, GOOD)
    assert daily.load(warehouse, str(tmp_path / "in")).rows_loaded == 31


def test_one_file_with_swapped_columns_is_set_apart_by_the_stream(warehouse, tmp_path):
    many_files(tmp_path / "in", SWAPPED)
    load_new_files(warehouse, str(tmp_path / "in"))
    run = newest_run(warehouse)
    assert (run.execution_status, run.rows_loaded, run.rows_rejected) == ("SUCCESS", 29, 4)
    assert "f17.csv" not in {row.source_file for row in read_new_trips(warehouse).collect()}
    bad = read_new_bad_lines(warehouse).collect()
    assert {row.source_file for row in bad} == {"f17.csv"} and SHORT in {row.bad_line for row in bad}
    # A later batch is held against the first one's header.
    (tmp_path / "in" / "g.csv").write_text("\n".join([SWAPPED, GOOD]) + "\n")
    load_new_files(warehouse, str(tmp_path / "in"))
    assert read_new_trips(warehouse).count() == 29 and read_new_bad_lines(warehouse).count() == 6


def test_headers_may_differ_in_case_and_blanks(warehouse, tmp_path):
    many_files(tmp_path / "in", HEADER.upper().replace(",", " , "), number=18)
    assert daily.load(warehouse, str(tmp_path / "in")).rows_loaded == 19
    load_new_files(warehouse, str(tmp_path / "in"))
    assert read_new_trips(warehouse).count() == 19


def test_missing_cells_and_quotes(warehouse, tmp_path):
    cells = GOOD.split(",")
    cells[0], cells[3], cells[8], cells[11] = "NA", "", '"a ""b"", c"', " "
    daily.load(warehouse, write(tmp_path / "trips.csv", ",".join(cells)))
    row = warehouse.read_one(RAW, daily.RAW_TRIPS).first()
    assert row.vendor_id is None and row.passenger_count is None
    assert row.store_fwd_flag == 'a "b", c' and row.payment_type == " "


def test_failed_audit_does_not_hide_the_run(warehouse, tmp_path, monkeypatch):
    def broken(*_):
        raise OSError("no audit")

    monkeypatch.setattr(control, "log_run", broken)
    assert daily.load(warehouse, write(tmp_path / "trips.csv", GOOD)).status == "SUCCESS"


def as_files(spark, folder, scale="sf0.001", condition="true"):
    trips = trips_from_events(spark, f"{DATA}/{scale}").filter(condition).select(*SOURCE_COLUMNS)
    keep = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    trips.write.mode("append").options(header="true", **keep).csv(str(folder))


CLEAN = """try_cast(pickup_datetime as timestamp) is not null and pickup_latitude is not null"""


def test_daily_run_on_clean_trips(spark, warehouse, tmp_path):
    as_files(spark, tmp_path / "in", condition=CLEAN)
    daily.daily_run(warehouse, str(tmp_path / "in"))
    run = newest_run(warehouse)
    fact = warehouse.read_one(MARTS, "fact_trip")
    rejected = warehouse.read_one(QUARANTINE, "trips")
    assert fact.count() + rejected.count() == run.rows_loaded
    assert warehouse.read_one(AUDIT, daily.QUALITY_REPORT).filter("failures = 0").count() == 19
    kpi = warehouse.read_one(daily.METRICS, "kpi_summary").first()
    assert kpi.total_trips == fact.count()
    # Metrics made of cells are those made of the trips.
    marts = daily.read_marts(warehouse)
    direct = {
        "kpi_summary": metrics.kpi_summary(fact),
        "trips_by_time_of_day": metrics.trips_by_time_of_day(fact),
        "fare_by_time_of_day": metrics.fare_by_time_of_day(fact),
        "tips_by_payment_type": metrics.tips_by_payment_type(fact, marts["dim_payment_type"]),
        "revenue_by_rate_code": metrics.revenue_by_rate_code(fact, marts["dim_rate_code"]),
        "demand_by_day_hour": metrics.demand_by_day_hour(fact),
        "fare_by_borough": metrics.fare_by_borough(metrics.located_trips(daily.full_model(warehouse).valid_trips)),
    }
    for name, frame in direct.items():
        published = warehouse.read_one(daily.METRICS, name)
        assert sorted(map(repr, published.collect())) == sorted(map(repr, frame.collect())), name
    assert spark.table(f"{schema_name(MARTS)}.fact_trip").count() == fact.count()
    assert spark.table("STAGING_stg_trips").count() == run.rows_loaded
    # All stages again: the load is skipped and the same tables come out.
    daily.daily_run(warehouse, str(tmp_path / "in"))
    assert newest_run(warehouse).execution_status == "SKIPPED"
    again = warehouse.read_one(MARTS, "fact_trip").drop("dbt_updated_at")
    assert again.exceptAll(fact.drop("dbt_updated_at")).count() == 0 and again.count() == fact.count()
    assert spark.table(f"{schema_name(MARTS)}.fact_trip").inputFiles() != []
    before, fact_rows = warehouse.current_locations().count(), fact.count()
    assert warehouse.drop_old_versions(keep=1) > 0
    assert warehouse.current_locations().count() == before
    assert warehouse.read_one(MARTS, "fact_trip").count() == fact_rows


def test_raw_texts_are_read_once(spark, warehouse, tmp_path):
    as_files(spark, tmp_path / "in", condition=CLEAN)
    daily.load(warehouse, str(tmp_path / "in"))
    model = daily.stage_trips(warehouse, daily.full_model(warehouse).raw)
    lookups = {"dim_vendor", "dim_rate_code", "dim_payment_type"}
    for name, frame in (model.marts() | {"quarantine": model.quarantine_trips}).items():
        files = frame.inputFiles()
        assert all("/STAGING/stg_trips/" in file for file in files) and bool(files) == (name not in lookups), name
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("] parquet") == (name not in lookups), name
    daily.build_marts(warehouse)
    fact, places = warehouse.read(MARTS, "fact_trip", "dim_location")
    daily.publish_metrics(warehouse)
    joined = {"trips_by_borough": metrics.trips_by_borough, "trip_route_boroughs": metrics.trip_route_boroughs}
    for name, form in joined.items():
        published = warehouse.read_one(daily.METRICS, name)
        assert sorted(map(repr, published.collect())) == sorted(map(repr, form(fact, places).collect())), name


def test_metrics_are_those_of_one_version(spark, warehouse, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.csv", GOOD, GOOD)
    load_new_files(warehouse, str(folder))
    daily.stage_trips(warehouse, read_new_trips(warehouse))
    daily.build_marts(warehouse)
    write(folder / "b.csv", GOOD)
    load_new_files(warehouse, str(folder))
    daily.stage_trips(warehouse, read_new_trips(warehouse))
    warehouse.drop_old_versions(keep=1)
    daily.publish_metrics(warehouse)
    totals = {
        name: warehouse.read_one(daily.METRICS, name).agg(F.sum(column)).first()[0]
        for name, column in {
            "kpi_summary": "total_trips",
            "trips_by_borough": "trips",
            "fare_by_borough": "trips",
            "trips_by_time_of_day": "trips",
            "demand_by_grid": "trips",
            "trip_route_boroughs": "trips",
        }.items()
    }
    assert set(totals.values()) == {2}, totals
    assert warehouse.drop_old_versions(keep=1) == 0


def test_another_session_finds_tables_and_views(spark, warehouse):
    """A session that only knows the root; the views' text says the same as the staged tables."""
    from hackney.plans.model import Model
    from hackney.plans.views import STAGED_VIEWS, open_catalog

    model = Model(spark, trips_from_events(spark, f"{DATA}/sf0.001"))
    warehouse.publish("staging", {daily.STAGED_TRIPS: model.typed})
    daily.build_marts(warehouse)
    other = spark.newSession()
    other.sql("drop database if exists STAGING cascade")
    other.sql("drop database if exists MARTS cascade")
    open_catalog(Warehouse(other, warehouse.root))
    assert other.table("MARTS.fact_trip").count() == model.fact_trip.count()
    assert not any(table.isTemporary for table in other.catalog.listTables("STAGING"))
    for name in STAGED_VIEWS:
        view, frame = other.table(f"STAGING.{name}"), getattr(model, name)
        assert view.dtypes == frame.dtypes, name
        assert Counter(map(tuple, view.collect())) == Counter(map(tuple, frame.collect())), name
    assert other.sql("select count(*) from STAGING.stg_trips where is_zero_distance").first()[0] > 0
    # The views follow the tables: a new version shows once the catalog is opened again.
    warehouse.publish("staging", {daily.STAGED_TRIPS: model.typed.limit(0)})
    open_catalog(Warehouse(other, warehouse.root))
    assert other.table("STAGING.stg_locations").count() == 0 and other.table("STAGING.stg_vendors").count() == 2


def test_failed_check_stops_the_metrics(spark, warehouse, tmp_path):
    as_files(spark, tmp_path / "in")
    with pytest.raises(quality.QualityCheckFailed, match="not_null_dim_datetime_datetime_key: 1"):
        daily.daily_run(warehouse, str(tmp_path / "in"))
    with pytest.raises(NotPublished):
        warehouse.read_one(daily.METRICS, "kpi_summary")


def test_failing_rows_can_be_read_back(spark, warehouse):
    from hackney.plans.model import Model

    trips = trips_from_events(spark, f"{DATA}/sf0.001").filter(CLEAN)
    model = Model(spark, trips)
    warehouse.publish("staging", {daily.STAGED_TRIPS: model.typed})
    daily.build_marts(warehouse)
    daily.check_marts(warehouse)
    assert warehouse.read_one(QUARANTINE, daily.FAILED_CHECKS).count() == 0
    known = daily.checked_while_written(warehouse)
    assert set(known) == set(quality.row_conditions("fact_trip")) and set(known.values()) == {0}
    # Three trips change behind the checks' back; two of them become one key.
    fact = warehouse.read_one(MARTS, "fact_trip")
    bad = sorted(row.raw_id for row in fact.select("raw_id").limit(3).collect())
    broken = fact.withColumn("fare_amount", F.when(F.col("raw_id") == bad[0], -2.5).otherwise(F.col("fare_amount")))
    broken = broken.withColumn("trip_key", F.when(F.col("raw_id").isin(bad[1:]), "same").otherwise(F.col("trip_key")))
    warehouse.publish(MARTS, {"fact_trip": broken})
    assert daily.checked_while_written(warehouse) == {}
    with pytest.raises(quality.QualityCheckFailed, match="not_negative_fact_trip_fare_amount: 1, unique_fact_trip_trip_key: 1"):
        daily.check_marts(warehouse)
    found = {row.check_name: json.loads(row.failing_row) for row in warehouse.read_one(QUARANTINE, daily.FAILED_CHECKS).collect()}
    assert set(found) == {"not_negative_fact_trip_fare_amount", "unique_fact_trip_trip_key"}
    assert found["not_negative_fact_trip_fare_amount"]["raw_id"] == bad[0]
    assert found["not_negative_fact_trip_fare_amount"]["fare_amount"] == -2.5
    assert found["unique_fact_trip_trip_key"] == {"trip_key": "same", "n": 2}
    kinds = warehouse.read_one(AUDIT, daily.RELATIONSHIPS).select("check_name", "failures")
    assert kinds.filter("check_name like '%location%' or check_name like '%datetime%'").agg(F.sum("failures")).first()[0] == 0


def test_checks_read_the_fact_once(spark):
    from hackney.plans.model import Model

    model = Model(spark, trips_from_events(spark, f"{DATA}/sf0.001"))
    fact_checks = [check for check in quality.ALL_CHECKS if check.table == "fact_trip"]
    for frame, scans in ((quality.report(model.marts(), fact_checks), 1), (quality.relationships(model.marts()), 3)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("] parquet") == scans, plan  # the dimensions of times and places are made of the trips, too
    known = dict.fromkeys(quality.row_conditions("fact_trip"), 0)
    rest = quality.report(model.marts(), fact_checks, known)
    assert rest.count() == len(fact_checks)
    assert "fare_amount" not in rest._jdf.queryExecution().optimizedPlan().toString()


def test_failed_write_leaves_the_old_version(spark, warehouse):
    warehouse.publish(MARTS, {"numbers": spark.range(3)})
    with pytest.raises(Exception):
        warehouse.publish(MARTS, {"other": spark.range(2), "numbers": spark.range(5).select(F.raise_error(F.lit("broken")).alias("id"))})
    with pytest.raises(NotPublished):
        warehouse.read_one(MARTS, "other")
    assert warehouse.read_one(MARTS, "numbers").count() == 3
    assert warehouse.publish(MARTS, {"numbers": spark.range(7)}) == {"numbers": 7}
    assert warehouse.read_one(MARTS, "numbers").count() == 7


def files_of(warehouse, layer, *tables):
    folders = [Path(warehouse.folder(layer, table)) for table in tables]
    return sum(1 for folder in folders for _ in folder.rglob("*.parquet"))


def test_logs_are_merged(spark, warehouse, monkeypatch):
    """Reads agree before and after; rows of later appends count; a merge that fails changes nothing."""

    def rows():
        return sorted(control.read_runs(warehouse).collect(), key=repr)

    assert control.merge_logs(warehouse) == 0
    for round_ in range(2):
        for number in range(5):
            control.log_run(warehouse, control.Run(run_id=f"{round_}-{number}", started=control.now()))
            control.move_bookmark(warehouse, "s", number, 10 * round_ + number, f"f{number}")
        before = rows()
        assert len(before) == 5 * (round_ + 1)
        with monkeypatch.context() as patch:
            patch.setattr(Warehouse, "append", lambda *_: (_ for _ in ()).throw(OSError("no list")))
            with pytest.raises(OSError, match="no list"):
                control.merge_logs(warehouse, most=4)
        assert rows() == before
        assert control.merge_logs(warehouse, most=4) == 10
        assert rows() == before and control.merge_logs(warehouse, most=4) == 0
        assert control.read_bookmark(warehouse, "s") == control.Bookmark(4, 10 * round_ + 4)
        assert files_of(warehouse, AUDIT, "pipeline_runs") == 0
    control.log_run(warehouse, control.Run(run_id="later", started=control.now()))
    assert len(rows()) == len({row.pipeline_run_id for row in rows()}) == 11
    tables = {"a": spark.range(2), "b": spark.range(3)}
    for _ in range(4):
        warehouse.publish(MARTS, tables)
    current = sorted(warehouse.current_locations().collect())
    assert warehouse.merge_logs(most=2) == 4
    assert sorted(warehouse.current_locations().collect()) == current
    warehouse.publish(MARTS, {"a": spark.range(9)})
    assert [frame.count() for frame in warehouse.read(MARTS, "a", "b")] == [9, 3]
    assert warehouse.drop_old_versions(keep=1) > 0
    assert [frame.count() for frame in warehouse.read(MARTS, "a", "b")] == [9, 3]


def test_many_appends_leave_few_files(spark, warehouse):
    for start in range(0, 200, 40):
        for number in range(start, start + 40):
            control.move_bookmark(warehouse, "s", number, number, "f")
        warehouse.merge_log(CONTROL, control.WATERMARKS, BOOKMARK_SCHEMA, most=30)
    names = [control.WATERMARKS + end for end in ("", "_merged", "_merges")]
    assert files_of(warehouse, CONTROL, *names) < 15
    assert warehouse.read_log(CONTROL, control.WATERMARKS, BOOKMARK_SCHEMA).count() == 200
    assert control.read_bookmark(warehouse, "s") == control.Bookmark(199, 199)


def test_schema_names():
    assert schema_name("marts") == "MARTS"
    assert schema_name(None) == "PUBLIC"
    assert schema_name(AUDIT) == "AUDIT_LOGS"


def test_new_files_are_loaded_once(spark, warehouse, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.csv", GOOD, GOOD)
    write(folder / "b.csv", GOOD, SHORT)
    load_new_files(warehouse, str(folder), files_per_batch=1)
    assert read_new_trips(warehouse).count() == 3
    load_new_files(warehouse, str(folder))
    assert read_new_trips(warehouse).count() == 3
    write(folder / "c.csv", GOOD)
    load_new_files(warehouse, str(folder))
    trips = read_new_trips(warehouse)
    assert trips.count() == 4 and trips.columns == RAW_COLUMNS
    assert trips.select("raw_id").distinct().count() == 4
    assert {row.source_file for row in trips.collect()} == {"a.csv", "b.csv", "c.csv"}
    assert {row.batch_id[-9:] for row in trips.collect()} == {"-00000000", "-00000001", "-00000002"}
    assert control.read_bookmark(warehouse, "trip_files") == control.Bookmark(4, 4)
    assert [row.bad_line for row in read_new_bad_lines(warehouse).collect()] == [SHORT]
    runs = control.read_runs(warehouse)
    totals = runs.agg(F.sum("rows_extracted"), F.sum("rows_loaded"), F.sum("rows_rejected")).first()
    assert tuple(totals) == (5, 4, 1)


def test_new_checkpoint_loses_no_trip(warehouse, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.csv", GOOD, GOOD)
    load_new_files(warehouse, str(folder))
    shutil.move(warehouse.folder(CONTROL, f"checkpoint_{NEW_TRIPS}"), tmp_path / "old")
    (folder / "a.csv").unlink()
    write(folder / "b.csv", GOOD)
    load_new_files(warehouse, str(folder))
    assert read_new_trips(warehouse).count() == 3


def test_a_batch_without_a_usable_line_is_set_apart_and_the_stream_goes_on(warehouse, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.csv", SHORT, SHORT)
    load_new_files(warehouse, str(folder))
    run = newest_run(warehouse)
    assert (run.execution_status, run.rows_extracted, run.rows_loaded, run.rows_rejected) == (control.FAILED, 2, 0, 2)
    assert "wrong number of cells" in run.failure_reason
    assert read_new_trips(warehouse).count() == 0
    assert [row.bad_line for row in read_new_bad_lines(warehouse).collect()] == [SHORT, SHORT]
    write(folder / "b.csv", GOOD)
    load_new_files(warehouse, str(folder))
    assert newest_run(warehouse).execution_status == control.SUCCESS
    assert read_new_trips(warehouse).count() == 1
    assert read_new_bad_lines(warehouse).count() == 2


def test_no_trips_before_the_first_file(warehouse, tmp_path):
    (tmp_path / "in").mkdir()
    assert read_new_trips(warehouse).collect() == [] and read_new_bad_lines(warehouse).collect() == []
    load_new_files(warehouse, str(tmp_path / "in"))
    assert newest_run(warehouse).execution_status == control.SKIPPED
    trips = read_new_trips(warehouse)
    assert trips.schema == RAW_SCHEMA and trips.count() == 0


@pytest.mark.parametrize("step", ["move_bookmark", "point_to_all"])
def test_an_unrecorded_batch_cannot_be_read(spark, warehouse, tmp_path, monkeypatch, step):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.csv", GOOD)
    load_new_files(warehouse, str(folder))
    write(folder / "b.csv", GOOD, GOOD, SHORT)

    def broken(*_, **__):
        raise OSError(f"no {step}")

    with monkeypatch.context() as patch:
        patch.setattr(*((control, step, broken) if step == "move_bookmark" else (Warehouse, step, broken)))
        with pytest.raises(Exception, match=f"no {step}"):
            load_new_files(warehouse, str(folder))
    run = newest_run(warehouse)
    assert (run.execution_status, run.rows_loaded) == (control.FAILED, 0) and f"no {step}" in run.failure_reason
    assert read_new_trips(warehouse).count() == 1 and read_new_bad_lines(warehouse).count() == 0
    load_new_files(warehouse, str(folder))
    assert newest_run(warehouse).execution_status == control.SUCCESS
    trips = read_new_trips(warehouse)
    assert {row.source_file: row["count"] for row in trips.groupBy("source_file").count().collect()} == {"a.csv": 1, "b.csv": 2}
    assert read_new_bad_lines(warehouse).count() == 1
    assert control.read_bookmark(warehouse, "trip_files") == control.Bookmark(3, 3)
    # Parts are no tables of their own.
    warehouse.register()
    assert warehouse.drop_old_versions() == 0


def test_no_new_file_is_a_skipped_run(warehouse, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.csv", GOOD)
    load_new_files(warehouse, str(folder))
    assert newest_run(warehouse).execution_status == control.SUCCESS
    load_new_files(warehouse, str(folder))
    assert newest_run(warehouse).execution_status == control.SKIPPED


def test_repeated_batch_replaces_its_rows(spark, warehouse, tmp_path):
    from hackney.sources.trip_files import read_trip_files
    from hackney.streaming import new_files

    lines = read_trip_files(spark, write(tmp_path / "a.csv", GOOD, GOOD), "run", "")
    for _ in range(2):
        new_files._load_batch(warehouse, lines, "files-0", "run")
    assert read_new_trips(warehouse).count() == 2
    assert control.read_bookmark(warehouse, "trip_files") == control.Bookmark(2, 2)


def test_stages_from_the_command_line(spark, tmp_path):
    as_files(spark, tmp_path / "in", condition=CLEAN)
    root = str(tmp_path / "tables")
    for stage in ("load", "marts", "checks", "metrics"):
        daily.main(["--root", root, "--source", str(tmp_path / "in"), stage])
    assert Warehouse(spark, root).read_one(daily.METRICS, "trips_by_borough").count() > 0
    for stage in ("staging", "register"):
        daily.main(["--root", root, stage])
    assert spark.table("MARTS.fact_trip").count() > 0
    assert spark.table("STAGING.stg_trips").count() >= spark.table("MARTS.fact_trip").count()


def test_daily_run_with_new_files_only(spark, warehouse, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.csv", GOOD, GOOD)
    daily.daily_run(warehouse, str(folder), new_files_only=True)
    assert warehouse.read_one(MARTS, "fact_trip").count() == 2
    write(folder / "b.csv", GOOD)
    daily.main(["--root", warehouse.root, "--source", str(folder), "--new-files", "load"])
    daily.main(["--root", warehouse.root, "--new-files", "marts"])
    assert warehouse.read_one(MARTS, "fact_trip").count() == 3


def test_given_session_is_left_alone_and_its_zone_does_not_matter(spark, tmp_path):
    from hackney.plans.registry import queries

    folder = f"{DATA}/sf0.001"
    names = ["stg_trips", "dim_datetime", "new_file_trips"]
    expected = {name: Counter(queries()[name](spark, folder).collect()) for name in names}
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    settings = {name: other.conf.get(name) for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions")}
    assert {name: Counter(queries()[name](other, folder).collect()) for name in names} == expected
    assert {name: other.conf.get(name) for name in settings} == settings
    assert other.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) is None
