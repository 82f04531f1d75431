"""The registered queries: name to function of a session and a folder of driver tables.

Every query starts from trips made of the whole `events` table. The lookups
have a few fixed rows of their own, so they are registered together with the
trips that use them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hackney.functions.dayparts import is_weekend, time_of_day
from hackney.functions.keys import code_key, datetime_key, location_key, trip_key
from hackney.functions.places import borough, grid_bucket
from hackney.operators import metrics, quality, staging, trips
from hackney.plans.model import Model
from hackney.plans.warehouse import Warehouse
from hackney.schemas import RAW_COLUMNS, SOURCE_COLUMNS
from hackney.session import shared_folder
from hackney.sources.event_trips import trips_from_events
from hackney.sources.trip_files import good_lines, read_trip_files
from hackney.streaming.new_files import load_new_files, read_new_trips

Query = Callable[[SparkSession, str], DataFrame]


def model(spark: SparkSession, folder: str) -> Model:
    return Model(spark, trips_from_events(spark, folder))


def _on_model(build: Callable[[Model], DataFrame]) -> Query:
    """Query on the model; the build time of a row is left out, as it differs from run to run."""
    return lambda spark, folder: build(model(spark, folder)).drop("dbt_updated_at")


def _staged(*columns: str) -> Query:
    return _on_model(lambda m: m.stg_trips.select("raw_id", *columns))


def _computed(columns: Callable[[], dict[str, Column]]) -> Query:
    """Columns worked out from the staged trips; they are made when the query runs, as they need a session."""
    return _on_model(
        lambda m: m.stg_trips.select("raw_id", *(column.alias(name) for name, column in columns().items()))
    )


def _pickup() -> tuple[Column, Column]:
    return F.col("pickup_latitude"), F.col("pickup_longitude")


def _dropoff() -> tuple[Column, Column]:
    return F.col("dropoff_latitude"), F.col("dropoff_longitude")


def _trips_per_code(code: str, lookup: str, lookup_code: str) -> Query:
    """Staged trips per code with the code's name; the few codes are counted before the lookup."""

    def build(m: Model) -> DataFrame:
        counts = m.stg_trips.groupBy(code).agg(F.count(F.lit(1)).alias("trips"))
        return trips.with_lookup(counts, code, getattr(m, lookup), lookup_code)

    return _on_model(build)


def _dimension_with_trips(dimension: str, key: str) -> Query:
    """All rows of a code dimension with the number of fact rows that carry their key."""

    def build(m: Model) -> DataFrame:
        counts = m.fact_trip.groupBy(key).agg(F.count(F.lit(1)).alias("trips"))
        table = getattr(m, dimension)
        return table.join(counts, key, "left").withColumn("trips", F.coalesce("trips", F.lit(0)))

    return _on_model(build)


def _joined(code: str, dimension: str, dimension_code: str, key: str, name: str) -> Query:
    """Valid trips with key and name from a code dimension."""

    def build(m: Model) -> DataFrame:
        joined = trips.with_lookup(m.valid_trips, code, getattr(m, dimension), dimension_code)
        return joined.select("raw_id", code, key, name)

    return _on_model(build)


def _as_trip_files(spark: SparkSession, folder: str) -> str:
    """The trips written as CSV to a new shared folder, as a source of trip files."""
    path = f"{shared_folder(spark)}/trip_files"
    lines = trips_from_events(spark, folder).select(*SOURCE_COLUMNS)
    keep_blanks = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    lines.write.options(header="true", **keep_blanks).csv(path)
    return path


def csv_trips(spark: SparkSession, folder: str) -> DataFrame:
    """The trips after a way through CSV files and the file reader."""
    lines = read_trip_files(spark, _as_trip_files(spark, folder), "run-0", "b-0")
    return good_lines(lines).select("batch_id", "pipeline_run_id", *SOURCE_COLUMNS)


def new_file_trips(spark: SparkSession, folder: str) -> DataFrame:
    """The trips after a way through CSV files and the file stream."""
    warehouse = Warehouse(spark, shared_folder(spark))
    load_new_files(warehouse, _as_trip_files(spark, folder))
    return read_new_trips(warehouse).select(*SOURCE_COLUMNS)


def _quarantine(m: Model) -> DataFrame:
    return m.quarantine_trips.withColumn("reject_reasons", F.array_join("reject_reasons", ","))


def queries() -> dict[str, Query]:
    return {
        # Sources and lookups
        "raw_trips": _on_model(lambda m: m.raw.select(*RAW_COLUMNS)),
        "csv_trips": csv_trips,
        "new_file_trips": new_file_trips,
        "stg_vendors": _trips_per_code("vendor_id", "stg_vendors", "vendor_id"),
        "stg_rate_codes": _trips_per_code("rate_code_id", "stg_rate_codes", "rate_code_id"),
        "stg_payment_types": _trips_per_code("payment_type", "stg_payment_types", "payment_type_id"),
        # Columns of a trip
        "op_try_timestamp": _staged("pickup_datetime", "dropoff_datetime"),
        "op_try_double": _staged(*staging.NUMBERS),
        "op_trim_codes": _staged("vendor_id", "rate_code_id", "payment_type", "store_fwd_flag"),
        "op_trip_duration": _staged("trip_duration_minutes"),
        "op_fare_per_mile": _staged("fare_per_mile"),
        "op_tip_percentage": _staged("tip_percentage"),
        "op_quality_flags": _staged(
            "is_zero_distance", "is_zero_passengers", "has_negative_fare", "has_invalid_timestamps"
        ),
        "op_time_of_day": _computed(lambda: {"time_of_day": time_of_day(F.col("pickup_datetime"))}),
        "op_weekend_flag": _computed(lambda: {"is_weekend": is_weekend(F.col("pickup_datetime"))}),
        "op_grid_bucket": _computed(
            lambda: {"lat_bucket": grid_bucket(_pickup()[0]), "lon_bucket": grid_bucket(_pickup()[1])}
        ),
        "op_borough": _computed(
            lambda: {"pickup_borough": borough(*_pickup()), "dropoff_borough": borough(*_dropoff())}
        ),
        "op_code_keys": _computed(
            lambda: {
                "vendor_key": code_key(F.col("vendor_id")),
                "rate_code_key": code_key(F.col("rate_code_id")),
                "payment_type_key": code_key(F.col("payment_type")),
            }
        ),
        "op_datetime_key": _computed(lambda: {"datetime_key": datetime_key(F.col("pickup_datetime"))}),
        "op_location_key": _computed(
            lambda: {
                "pickup_location_key": location_key(*_pickup()),
                "dropoff_location_key": location_key(*_dropoff()),
            }
        ),
        "op_trip_key": _computed(lambda: {"trip_key": trip_key(F.col("raw_id"))}),
        # Staged tables and their parts
        "stg_trips": _on_model(lambda m: m.stg_trips),
        "stg_datetime": _on_model(lambda m: m.stg_datetime),
        "stg_locations": _on_model(lambda m: m.stg_locations),
        "op_distinct_pickup_times": _on_model(lambda m: staging.distinct_pickup_times(m.typed)),
        "op_union_locations": _on_model(lambda m: staging.distinct_locations(m.typed)),
        # Marts
        "dim_datetime": _on_model(lambda m: m.dim_datetime),
        "dim_location": _on_model(lambda m: m.dim_location),
        "dim_vendor": _dimension_with_trips("dim_vendor", "vendor_key"),
        "dim_rate_code": _dimension_with_trips("dim_rate_code", "rate_code_key"),
        "dim_payment_type": _dimension_with_trips("dim_payment_type", "payment_type_key"),
        "fact_trip": _on_model(lambda m: m.fact_trip),
        "op_valid_trips": _on_model(lambda m: m.valid_trips.select("raw_id", "trip_duration_minutes")),
        "quarantine_trips": _on_model(_quarantine),
        "reject_summary": _on_model(lambda m: trips.reject_summary(m.stg_trips)),
        "op_join_vendor": _joined("vendor_id", "dim_vendor", "vendor_id", "vendor_key", "vendor_name"),
        "op_join_rate_code": _joined(
            "rate_code_id", "dim_rate_code", "rate_code_id", "rate_code_key", "rate_code_name"
        ),
        "op_join_payment_type": _joined(
            "payment_type", "dim_payment_type", "payment_type_id", "payment_type_key", "payment_type_name"
        ),
        "trip_route_boroughs": _on_model(lambda m: metrics.trip_route_boroughs(m.fact_trip, m.dim_location)),
        # Quality
        "dq_unique": _on_model(lambda m: quality.report(m.marts(), quality.UNIQUE)),
        "dq_not_null": _on_model(lambda m: quality.report(m.marts(), quality.NOT_NULL)),
        "dq_no_negative_fares": _on_model(
            lambda m: quality.count_before_and_after(quality.NO_NEGATIVE_FARES, m.stg_trips, m.fact_trip)
        ),
        "dq_dropoff_after_pickup": _on_model(
            lambda m: quality.count_before_and_after(quality.DROPOFF_AFTER_PICKUP, m.stg_trips, m.fact_trip)
        ),
        "dq_report": _on_model(lambda m: quality.report(m.marts())),
        "dq_relationships": _on_model(lambda m: quality.relationships(m.marts())),
        # Metrics
        "kpi_summary": _on_model(lambda m: metrics.kpi_summary(m.fact_trip)),
        "trips_by_borough": _on_model(lambda m: metrics.trips_by_borough(m.fact_trip, m.dim_location)),
        "fare_by_borough": _on_model(lambda m: metrics.fare_by_borough(metrics.located_trips(m.valid_trips))),
        "trips_by_time_of_day": _on_model(lambda m: metrics.trips_by_time_of_day(m.fact_trip)),
        "fare_by_time_of_day": _on_model(lambda m: metrics.fare_by_time_of_day(m.fact_trip)),
        "tips_by_payment_type": _on_model(lambda m: metrics.tips_by_payment_type(m.fact_trip, m.dim_payment_type)),
        "revenue_by_rate_code": _on_model(lambda m: metrics.revenue_by_rate_code(m.fact_trip, m.dim_rate_code)),
        "demand_by_day_hour": _on_model(lambda m: metrics.demand_by_day_hour(m.fact_trip)),
        "demand_by_grid": _on_model(lambda m: metrics.demand_by_grid(metrics.located_trips(m.valid_trips))),
        "trip_efficiency": _on_model(lambda m: metrics.trip_efficiency(metrics.located_trips(m.valid_trips))),
    }
