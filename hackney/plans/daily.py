"""The daily run: load, stage, build the marts, check them, publish the metrics.

Each stage reads what the one before has written, so a failed stage can be
repeated alone: `python -m hackney.plans.daily --root DIR --source CSV marts`.
The raw texts are read once, to write the typed trips; the marts are made of
these, and name the version they are made of, which the metrics use too.
"""

from __future__ import annotations

import argparse
import os
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from hackney.operators import metrics, quality, staging, trips
from hackney.plans import control, growth
from hackney.plans.model import MARTS as MART_TABLES
from hackney.plans.model import STAGING as STAGED_TABLES
from hackney.plans.model import Model
from hackney.plans.views import open_catalog
from hackney.plans.warehouse import AUDIT, MARTS, QUARANTINE, RAW, STAGING, Warehouse, schema_name
from hackney.session import build_session
from hackney.sources.trip_files import (
    WrongHeader,
    bad_lines,
    files_with_another_header,
    good_lines,
    line_counts,
    read_trip_files,
)
from hackney.streaming.new_files import load_new_files, read_new_trips

SOURCE_NAME = "trips_csv"
BATCH_ID = "trips_csv_full"
RAW_TRIPS = "trips_staged"
STAGED_TRIPS = "stg_trips"
SOURCE_TRIPS = "source_trips"
BAD_LINES = "bad_lines"
QUALITY_REPORT = "quality_report"
RELATIONSHIPS = "relationship_report"
ROW_CHECKS = "row_checks"
FAILED_CHECKS = "failed_checks"
METRICS = "metrics"


_ROW_CHECKS_SCHEMA = "check_name string, failures long, location string"


class BadLines(ValueError):
    """The source has lines with a wrong number of cells."""


def load(warehouse: Warehouse, source: str, fail_on_bad_lines: bool = False) -> control.Run:
    """Loads the source in full unless an earlier run has; every run leaves a row in the audit log."""
    run = control.Run(run_id=str(uuid.uuid4()), started=control.now())
    with control.recorded(warehouse, run):
        if control.read_bookmark(warehouse, SOURCE_NAME).total_rows_loaded > 0:
            run.status = control.SKIPPED
        else:
            _load_all(warehouse, source, run, fail_on_bad_lines)
            run.status = control.SUCCESS
    return run


def _load_all(warehouse: Warehouse, source: str, run: control.Run, fail_on_bad_lines: bool) -> None:
    observation = Observation()
    lines = read_trip_files(warehouse.spark, source, run.run_id, BATCH_ID)
    counted = lines.observe(observation, *(count.alias(name) for name, count in line_counts().items()))
    # The files are read once; only a source with bad lines is read again for them.
    version = warehouse.write(RAW, RAW_TRIPS, good_lines(counted))
    counts = observation.get
    run.rows_extracted, run.rows_rejected = counts["extracted"], counts["rejected"]
    # Only where there are not as many headers as files are the files looked at one by one.
    if counts["headers"] != len(lines.inputFiles()) and (others := files_with_another_header(lines)):
        raise WrongHeader(f"{len(others)} files have another header than the first: {', '.join(others[:5])}")
    if run.rows_rejected:
        if fail_on_bad_lines:
            raise BadLines(f"{run.rows_rejected} lines with a wrong number of cells")
        warehouse.publish(QUARANTINE, {BAD_LINES: bad_lines(lines)})
    warehouse.point_to(RAW, {RAW_TRIPS: version})
    run.rows_loaded = run.rows_extracted - run.rows_rejected
    control.move_bookmark(warehouse, SOURCE_NAME, run.rows_loaded, run.rows_loaded, os.path.basename(source))


def full_model(warehouse: Warehouse) -> Model:
    """The tables over the raw trips of the last full load."""
    return Model(warehouse.spark, warehouse.read_one(RAW, RAW_TRIPS))


def new_files_model(warehouse: Warehouse) -> Model:
    """The tables over all trips that were loaded file by file."""
    return Model(warehouse.spark, read_new_trips(warehouse))


def register_staging(model: Model) -> None:
    """Staged tables as views that are worked out when they are read."""
    for name in STAGED_TABLES:
        getattr(model, name).createOrReplaceTempView(f"{schema_name(STAGING)}_{name}")


def stage_trips(warehouse: Warehouse, raw: DataFrame) -> Model:
    """Writes the typed trips and shows the staged tables. Returns the tables over what is written."""
    warehouse.publish(STAGING, {STAGED_TRIPS: staging.typed_trips(raw)})
    model = Model(warehouse.spark, raw, warehouse.read_one(STAGING, STAGED_TRIPS))
    register_staging(model)
    return model


def build_marts(warehouse: Warehouse) -> dict[str, int]:
    """Writes all mart tables and the quarantine anew, from the typed trips. Returns the rows of each."""
    (source,) = warehouse.locations(STAGING, STAGED_TRIPS)
    model = Model(warehouse.spark, written=warehouse.spark.read.parquet(source))
    checked = {"fact_trip": quality.row_conditions("fact_trip")}
    marts = model.marts()
    marts["fact_trip"] = trips.with_pickup_date(marts["fact_trip"])
    by = {"fact_trip": trips.PICKUP_DATE}
    written = warehouse.publish_observed(MARTS, marts, also={SOURCE_TRIPS: source}, wanted=checked, by=by)
    found = [(name, written["fact_trip"][name], written["fact_trip"]["location"]) for name in checked["fact_trip"]]
    warehouse.append(AUDIT, ROW_CHECKS, found, _ROW_CHECKS_SCHEMA)
    rows = {name: counts["rows"] for name, counts in written.items()}
    return rows | warehouse.publish(QUARANTINE, {"trips": model.quarantine_trips})


def read_marts(warehouse: Warehouse) -> dict[str, DataFrame]:
    return dict(zip(MART_TABLES, warehouse.read(MARTS, *MART_TABLES)))


def checked_while_written(warehouse: Warehouse) -> dict[str, int]:
    """Failures of checks on the fact's rows, counted when they were written; none unless one run wrote all of the fact."""
    folders = {os.path.dirname(folder) for folder in warehouse.parts(MARTS, "fact_trip").values()}
    if len(folders) != 1:
        return {}
    found = warehouse.read_log(AUDIT, ROW_CHECKS, _ROW_CHECKS_SCHEMA).filter(F.col("location") == folders.pop())
    return {row.check_name: row.failures for row in found.collect()}


def check_marts(warehouse: Warehouse) -> None:
    """Publishes the report of all checks and the failing rows, and raises if a check failed.

    References without a row in their dimension are reported with them but do
    not stop a run: unknown codes are kept on purpose. Only a failed check has
    its table read again, for the failing rows.
    """
    marts = read_marts(warehouse)
    reports = {QUALITY_REPORT: quality.report(marts, known=checked_while_written(warehouse)), RELATIONSHIPS: quality.relationships(marts)}
    warehouse.publish(AUDIT, reports)
    report = warehouse.read_one(AUDIT, QUALITY_REPORT)
    failed = {row.check_name for row in report.filter("failures > 0").collect()}
    found = quality.failures(marts, [check for check in quality.ALL_CHECKS if check.name in failed])
    warehouse.publish(QUARANTINE, {FAILED_CHECKS: found})
    quality.require_all_passed(report)


def publish_metrics(warehouse: Warehouse) -> None:
    """Publishes all metrics of the published marts and the typed trips that these are made of.

    The trips are read once for each kind of cells; most metrics then read the cells.
    """
    *tables, source = warehouse.read(MARTS, *MART_TABLES, SOURCE_TRIPS)
    marts = dict(zip(MART_TABLES, tables))
    located = metrics.located_trips(trips.valid_trips(source))
    warehouse.publish(METRICS, metrics.daily_cells(marts["fact_trip"], trips.with_pickup_date(located), trips.PICKUP_DATE))
    growth.publish_metrics(warehouse)


def daily_run(warehouse: Warehouse, source: str, new_files_only: bool = False) -> None:
    """All stages in order. A failed check stops the run before the metrics are published.

    With new files only, the marts grow by these files' trips, and the old trips are not read.
    """
    if new_files_only:
        load_new_files(warehouse, source)
        growth.grow(warehouse)
        check_marts(warehouse)
        growth.publish_metrics(warehouse)
    else:
        load(warehouse, source)
        stage_trips(warehouse, full_model(warehouse).raw)
        build_marts(warehouse)
        check_marts(warehouse)
        publish_metrics(warehouse)
    open_catalog(warehouse)
    warehouse.drop_old_versions()
    control.merge_logs(warehouse)
    warehouse.merge_log(AUDIT, ROW_CHECKS, _ROW_CHECKS_SCHEMA)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Daily run of the trip tables")
    parser.add_argument("--root", required=True, help="shared folder of the tables")
    parser.add_argument("--source", help="trip file or folder of trip files, for load and all")
    parser.add_argument("--new-files", action="store_true", help="load only files that no run has loaded yet")
    stages = ["load", "staging", "marts", "grow", "checks", "metrics", "register", "all"]
    parser.add_argument("stage", choices=stages, nargs="?", default="all", help="marts stages the trips as well")
    options = parser.parse_args(arguments)
    if options.stage in ("load", "all") and not options.source:
        parser.error("--source is needed to load")
    warehouse = Warehouse(build_session(), options.root)
    model_of = new_files_model if options.new_files else full_model
    load_from = load_new_files if options.new_files else load
    if options.stage == "load":
        load_from(warehouse, options.source)
    elif options.stage == "staging":
        stage_trips(warehouse, model_of(warehouse).raw)
    elif options.stage == "marts":
        stage_trips(warehouse, model_of(warehouse).raw)
        build_marts(warehouse)
    elif options.stage == "grow":
        growth.grow(warehouse)
    elif options.stage == "checks":
        check_marts(warehouse)
    elif options.stage == "metrics":
        (growth.publish_metrics if options.new_files else publish_metrics)(warehouse)
    elif options.stage == "register":
        open_catalog(warehouse)
    else:
        daily_run(warehouse, options.source, options.new_files)


if __name__ == "__main__":
    main()
