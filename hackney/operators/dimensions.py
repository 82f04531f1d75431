"""Dimension tables: a staged table with its hashed key and the time it was built."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hackney.functions.keys import code_key, datetime_key, location_key
from hackney.functions.places import borough

_DATETIME_COLUMNS = [
    "pickup_datetime",
    "trip_date",
    "trip_year",
    "trip_quarter",
    "trip_month",
    "trip_month_name",
    "week_of_year",
    "trip_day",
    "day_of_week_number",
    "day_of_week_name",
    "pickup_hour",
    "pickup_minute",
    "time_of_day",
    "is_weekend",
]


def _built_at():
    return F.current_timestamp().alias("dbt_updated_at")


def dim_datetime(datetimes: DataFrame) -> DataFrame:
    key = datetime_key(F.col("pickup_datetime"))
    return datetimes.select(key.alias("datetime_key"), *_DATETIME_COLUMNS, _built_at())


def dim_location(locations: DataFrame) -> DataFrame:
    latitude, longitude = F.col("latitude"), F.col("longitude")
    return locations.select(
        location_key(latitude, longitude).alias("location_key"),
        "latitude",
        "longitude",
        "lat_bucket",
        "lon_bucket",
        borough(latitude, longitude).alias("borough"),
        _built_at(),
    )


def dim_vendor(vendors: DataFrame) -> DataFrame:
    key = code_key(F.col("vendor_id"))
    return vendors.select(key.alias("vendor_key"), "vendor_id", "vendor_name", _built_at())


def dim_rate_code(rate_codes: DataFrame) -> DataFrame:
    key = code_key(F.col("rate_code_id"))
    return rate_codes.select(key.alias("rate_code_key"), "rate_code_id", "rate_code_name", _built_at())


def dim_payment_type(payment_types: DataFrame) -> DataFrame:
    key = code_key(F.col("payment_type_id"))
    return payment_types.select(key.alias("payment_type_key"), "payment_type_id", "payment_type_name", _built_at())
