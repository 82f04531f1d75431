"""The fact table, the trips it leaves out and the lookups of a trip's codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hackney.functions.keys import code_key, datetime_key, location_key, trip_key
from hackney.functions.measures import within_duration
from hackney.schemas import LONGEST_MINUTES, SHORTEST_MINUTES


PICKUP_DATE = "pickup_date"


def is_valid() -> Column:
    """Condition on a staged trip to enter the fact table; NULL for a trip without a duration.

    A dropoff before the pickup needs no condition of its own: its duration is
    not above zero. Each column is used once, see `minutes_between`.
    """
    return (
        ~F.col("is_zero_distance")
        & ~F.col("is_zero_passengers")
        & ~F.col("has_negative_fare")
        & within_duration(F.col("trip_duration_minutes"))
    )


def reject_reasons() -> dict[str, Column]:
    """Why a staged trip stays out of the fact table: condition by name. A trip can have several."""
    minutes = F.col("trip_duration_minutes")
    return {
        "zero_distance": F.col("is_zero_distance"),
        "zero_passengers": F.col("is_zero_passengers"),
        "negative_fare": F.col("has_negative_fare"),
        "invalid_timestamps": F.col("has_invalid_timestamps"),
        "missing_duration": minutes.isNull(),
        "duration_too_short": minutes <= SHORTEST_MINUTES,
        "duration_too_long": minutes >= LONGEST_MINUTES,
    }


def valid_trips(staged: DataFrame) -> DataFrame:
    return staged.filter(is_valid())


def fact_trip(staged: DataFrame) -> DataFrame:
    """One row per valid trip. Keys are hashes of the trip's own values, so no join and no shuffle is needed."""
    return valid_trips(staged).select(
        trip_key(F.col("raw_id")).alias("trip_key"),
        datetime_key(F.col("pickup_datetime")).alias("datetime_key"),
        location_key(F.col("pickup_latitude"), F.col("pickup_longitude")).alias("pickup_location_key"),
        location_key(F.col("dropoff_latitude"), F.col("dropoff_longitude")).alias("dropoff_location_key"),
        code_key(F.col("vendor_id")).alias("vendor_key"),
        code_key(F.col("rate_code_id")).alias("rate_code_key"),
        code_key(F.col("payment_type")).alias("payment_type_key"),
        "pickup_datetime",
        "dropoff_datetime",
        "passenger_count",
        "trip_distance",
        "trip_duration_minutes",
        "fare_per_mile",
        "tip_percentage",
        "fare_amount",
        "extra",
        "mta_tax",
        "tip_amount",
        "tolls_amount",
        "improvement_surcharge",
        "total_amount",
        "store_fwd_flag",
        "raw_id",
        "batch_id",
        "ingestion_timestamp",
        F.current_timestamp().alias("dbt_updated_at"),
    )


def with_pickup_date(trips: DataFrame) -> DataFrame:
    """Adds the day by which published trips are laid out."""
    return trips.withColumn(PICKUP_DATE, F.to_date("pickup_datetime"))


def quarantine_trips(staged: DataFrame) -> DataFrame:
    """The trips that are not in the fact table, with the reasons; fact and quarantine make up all trips."""
    reasons = [F.when(condition, F.lit(name)) for name, condition in reject_reasons().items()]
    rejected = staged.filter(~F.coalesce(is_valid(), F.lit(False)))
    return rejected.withColumn("reject_reasons", F.array_compact(F.array(*reasons)))


def reject_summary(staged: DataFrame) -> DataFrame:
    """Number of trips for each reject reason, all rejected and all valid trips, counted in one pass."""
    counts = {name: F.count_if(condition) for name, condition in reject_reasons().items()}
    counts["rejected"] = F.count_if(~F.coalesce(is_valid(), F.lit(False)))
    counts["valid"] = F.count_if(is_valid())
    one_row = staged.agg(*(count.alias(name) for name, count in counts.items()))
    pairs = F.array(*(F.struct(F.lit(name).alias("issue"), F.col(name).alias("trips")) for name in counts))
    return one_row.select(F.inline(pairs))


def with_lookup(trips: DataFrame, code: str, dimension: DataFrame, dimension_code: str) -> DataFrame:
    """Trips with the columns of a code dimension; trips with an unknown code stay, with NULLs.

    The code dimensions have two to six rows, whatever the number of trips, so
    they are broadcast.
    """
    matched = dimension.drop("dbt_updated_at").withColumnRenamed(dimension_code, "_code")
    return trips.join(F.broadcast(matched), F.col(code) == F.col("_code"), "left").drop("_code")
