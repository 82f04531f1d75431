"""Typed and cleaned views of the raw trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hackney.functions.casts import to_double, to_timestamp
from hackney.functions.dayparts import datetime_attributes
from hackney.functions.measures import fare_per_mile, is_true, minutes_between, tip_percentage
from hackney.functions.places import grid_bucket

_LINEAGE = ["raw_id", "batch_id", "pipeline_run_id", "ingestion_timestamp"]
_TIMES = ["pickup_datetime", "dropoff_datetime"]
_CODES = ["vendor_id", "rate_code_id", "payment_type", "store_fwd_flag"]
NUMBERS = [
    "pickup_longitude",
    "pickup_latitude",
    "dropoff_longitude",
    "dropoff_latitude",
    "passenger_count",
    "trip_distance",
    "fare_amount",
    "extra",
    "mta_tax",
    "tip_amount",
    "tolls_amount",
    "improvement_surcharge",
    "total_amount",
]
#: Whether the raw trip gives these texts, readable or not: a typed NULL does not tell.
GIVEN = {
    "has_pickup_datetime": ["pickup_datetime"],
    "has_pickup_place": ["pickup_longitude", "pickup_latitude"],
    "has_dropoff_place": ["dropoff_longitude", "dropoff_latitude"],
}


def _is_given(*texts: str) -> Column:
    given = F.lit(True)
    for text in texts:
        given &= F.col(text).isNotNull()
    return given


def typed_trips(raw: DataFrame) -> DataFrame:
    """One row per raw trip: the staged columns, and `GIVEN`. All other tables follow from these columns.

    Texts are read in the first select and used in the second, so that each is
    read once.
    """
    typed = raw.select(
        *_LINEAGE,
        *(to_timestamp(F.col(name)).alias(name) for name in _TIMES),
        *(F.trim(name).alias(name) for name in _CODES),
        *(to_double(F.col(name)).alias(name) for name in NUMBERS),
        *(_is_given(*texts).alias(name) for name, texts in GIVEN.items()),
    )
    pickup, dropoff = F.col("pickup_datetime"), F.col("dropoff_datetime")
    distance, fare, tip = F.col("trip_distance"), F.col("fare_amount"), F.col("tip_amount")
    return typed.select(
        *_LINEAGE,
        *_TIMES,
        minutes_between(pickup, dropoff).alias("trip_duration_minutes"),
        *_CODES,
        *NUMBERS,
        fare_per_mile(fare, distance).alias("fare_per_mile"),
        tip_percentage(tip, fare).alias("tip_percentage"),
        is_true(distance == 0).alias("is_zero_distance"),
        is_true(F.col("passenger_count") == 0).alias("is_zero_passengers"),
        is_true(fare < 0).alias("has_negative_fare"),
        is_true(dropoff < pickup).alias("has_invalid_timestamps"),
        *GIVEN,
    )


def stg_trips(typed: DataFrame) -> DataFrame:
    """Typed columns, derived measures and quality flags."""
    return typed.drop(*GIVEN)


def distinct_pickup_times(typed: DataFrame) -> DataFrame:
    """Distinct pickup times; an unreadable text gives one row with NULL, a missing one gives none."""
    return typed.filter("has_pickup_datetime").select("pickup_datetime").distinct()


def stg_datetime(typed: DataFrame) -> DataFrame:
    attributes = datetime_attributes(F.col("pickup_datetime"))
    return distinct_pickup_times(typed).select(
        "pickup_datetime", *(column.alias(name) for name, column in attributes.items())
    )


def _end_point(end: str) -> Column:
    """Coordinates of the `pickup` or `dropoff` end of a trip that gives both."""
    pair = F.struct(F.col(f"{end}_longitude").alias("longitude"), F.col(f"{end}_latitude").alias("latitude"))
    return F.when(F.col(f"has_{end}_place"), pair)


def distinct_locations(typed: DataFrame) -> DataFrame:
    """Distinct coordinate pairs of both ends, found with one scan and one shuffle.

    The partial step of the distinct drops the copies within each task, so a
    place that many trips share reaches the shuffle once per task.
    """
    ends = F.array_compact(F.array(_end_point("pickup"), _end_point("dropoff")))
    return typed.select(F.inline(ends)).distinct()


def stg_locations(typed: DataFrame) -> DataFrame:
    """Distinct pairs with their grid buckets, which follow from the pair and need no further distinct."""
    return distinct_locations(typed).select(
        "longitude",
        "latitude",
        grid_bucket(F.col("latitude")).alias("lat_bucket"),
        grid_bucket(F.col("longitude")).alias("lon_bucket"),
    )
