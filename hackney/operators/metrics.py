"""Demand, revenue and efficiency numbers over the star schema.

Every function groups the trips before it joins: by the key of the dimension
where a join is needed, so that the join sees one row per key, and directly by
the attribute where the trip's own columns give it. The number of groups after
that is small and fixed, except for the grid.

Where many numbers are wanted, the trips are grouped once into cells, and the
functions that take a `source` are given the cells in place of the trips.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hackney.functions.dayparts import day_of_week_number, start_of_hour, time_of_day
from hackney.functions.measures import round_to_cents
from hackney.functions.places import borough_of_trip, grid_bucket, is_located
from hackney.functions.totals import (
    average,
    group_moments,
    group_parts,
    parts_by,
    regroup_moments,
    regroup_parts,
    summed_moments,
    total,
    with_correlations,
)


_CELL_AMOUNTS = [
    "total_amount",
    "trip_distance",
    "trip_duration_minutes",
    "tip_percentage",
    "tip_amount",
    "fare_amount",
]
_PLACE_AMOUNTS = ["total_amount", "fare_amount"]


_HOURLY = ["pickup_datetime", "payment_type_key", "rate_code_key"]
_PLACES = ["borough", "lat_bucket", "lon_bucket"]
_ROUTES = ["pickup_borough", "dropoff_borough"]


def hourly_cells(fact: DataFrame, *more: str) -> DataFrame:
    """The fact grouped by pickup hour, payment type and rate code, for all numbers that need no place; and by further columns."""
    hour = start_of_hour(F.col("pickup_datetime")).alias("pickup_datetime")
    return group_parts(fact, [hour, *_HOURLY[1:], *more], _CELL_AMOUNTS)


def place_cells(located: DataFrame, *more: str) -> DataFrame:
    """Located trips grouped by borough and grid cell, and by further columns."""
    return group_parts(located, [*_PLACES, *more], _PLACE_AMOUNTS)


def daily_cells(fact: DataFrame, located: DataFrame, day: str) -> dict[str, DataFrame]:
    """All that the metrics need of the trips, grouped by day and small beside them."""
    return {
        "hourly_cells": hourly_cells(fact, day),
        "place_cells": place_cells(located, day),
        "route_cells": routes_by_own_boroughs(located, day),
        "efficiency_moments": efficiency_moments(located, day),
    }


def merged_cells(name: str, cells: DataFrame, day: str) -> DataFrame:
    """One row per cell of the cells of several loads."""
    if name == "efficiency_moments":
        return regroup_moments(cells, [day, "borough", *(f"has_{amount}" for amount in _EFFICIENCY_AMOUNTS)], _EFFICIENCY_AMOUNTS)
    keys, amounts = {
        "hourly_cells": (_HOURLY, _CELL_AMOUNTS), "place_cells": (_PLACES, _PLACE_AMOUNTS), "route_cells": (_ROUTES, [])
    }[name]
    return regroup_parts(cells, [day, *keys], amounts)


def from_cells(cells: dict[str, DataFrame], dim_payment_type: DataFrame, dim_rate_code: DataFrame) -> dict[str, DataFrame]:
    """All metrics, from cells of all days."""
    by_hour, by_place = cells["hourly_cells"], cells["place_cells"]
    return {
        "kpi_summary": kpi_summary(by_hour),
        "trips_by_time_of_day": trips_by_time_of_day(by_hour),
        "fare_by_time_of_day": fare_by_time_of_day(by_hour),
        "tips_by_payment_type": tips_by_payment_type(by_hour, dim_payment_type),
        "revenue_by_rate_code": revenue_by_rate_code(by_hour, dim_rate_code),
        "demand_by_day_hour": demand_by_day_hour(by_hour),
        "fare_by_borough": fare_by_borough(by_place),
        "demand_by_grid": demand_by_grid(by_place),
        "trips_by_borough": trips_by_own_borough(by_place),
        "trip_route_boroughs": regroup_parts(cells["route_cells"], _ROUTES, []),
        "trip_efficiency": efficiency(cells["efficiency_moments"]),
    }


def kpi_summary(source: DataFrame) -> DataFrame:
    """One row of headline numbers. The average fare is the mean of the whole amount paid.

    The average tip is given in both readings: the mean of the trips' tip
    percentages, and all tips as a percentage of all fares.
    """
    return parts_by(source, [], _CELL_AMOUNTS).select(
        total("total_amount").alias("total_revenue"),
        F.col("trips").alias("total_trips"),
        average("total_amount").alias("average_fare"),
        average("trip_distance").alias("average_distance"),
        average("trip_duration_minutes").alias("average_duration"),
        average("tip_percentage").alias("average_tip_percentage"),
        (total("tip_amount") / F.nullif(total("fare_amount"), F.lit(0.0)) * 100).alias("tip_percentage_of_fares"),
    )


def with_share(groups: DataFrame) -> DataFrame:
    """Adds each group's percentage of all trips; only for a few groups, as the window is one task."""
    everything = Window.partitionBy(F.lit(0))
    share = F.col("trips") * 100 / F.sum("trips").over(everything)
    return groups.withColumn("share_of_trips", round_to_cents(share))


def location_parts(fact: DataFrame, dim_location: DataFrame, amounts: list[str]) -> DataFrame:
    """Parts per pickup borough by a join of the published tables.

    The fact is grouped by its location key first. That takes the trips of a
    busy place together within each task, and the join reuses the partitioning
    of the group step, so no place is heavy in the join. The dimension grows
    with the data and is not broadcast by hint.
    """
    by_key = group_parts(fact, ["pickup_location_key"], amounts)
    boroughs = dim_location.select(F.col("location_key").alias("pickup_location_key"), "borough")
    return regroup_parts(by_key.join(boroughs, "pickup_location_key", "left"), ["borough"], amounts)


def located_trips(valid: DataFrame) -> DataFrame:
    """Valid trips with pickup borough and grid buckets worked out from their own coordinates.

    Gives what a join to the location dimension gives, since that holds every
    coordinate pair of the trips, but without a join or shuffle.
    """
    latitude, longitude = F.col("pickup_latitude"), F.col("pickup_longitude")
    both = is_located(latitude, longitude)
    return valid.withColumns(
        {
            "borough": borough_of_trip(latitude, longitude),
            "lat_bucket": F.when(both, grid_bucket(latitude)),
            "lon_bucket": F.when(both, grid_bucket(longitude)),
        }
    )


def trips_by_borough(fact: DataFrame, dim_location: DataFrame) -> DataFrame:
    """Trips and share per pickup borough; trips without a location are in a row of their own."""
    return with_share(location_parts(fact, dim_location, []).select("borough", "trips"))


def trips_by_own_borough(source: DataFrame) -> DataFrame:
    """The same from located trips, or cells of them, without a join."""
    return with_share(parts_by(source, ["borough"], []))


def fare_by_borough(source: DataFrame) -> DataFrame:
    return parts_by(source, ["borough"], _PLACE_AMOUNTS).select(
        "borough",
        "trips",
        average("total_amount").alias("average_fare"),
        average("fare_amount").alias("average_fare_amount"),
    )


def trips_by_time_of_day(source: DataFrame) -> DataFrame:
    """The part of the day follows from the fact's pickup time, so the time dimension is not joined."""
    part = time_of_day(F.col("pickup_datetime")).alias("time_of_day")
    return with_share(parts_by(source, [part], []))


def fare_by_time_of_day(source: DataFrame) -> DataFrame:
    part = time_of_day(F.col("pickup_datetime")).alias("time_of_day")
    return parts_by(source, [part], ["total_amount"]).select(
        "time_of_day", "trips", average("total_amount").alias("average_fare")
    )


def _parts_by_code(source: DataFrame, dimension: DataFrame, key: str, name: str, amounts: list[str]) -> DataFrame:
    by_key = parts_by(source, [key], amounts)
    names = F.broadcast(dimension.select(key, name))
    return regroup_parts(by_key.join(names, key, "left"), [name], amounts)


def tips_by_payment_type(source: DataFrame, dim_payment_type: DataFrame) -> DataFrame:
    """Trips and tips per payment type; trips with an unknown code are in a row without a name."""
    amounts = ["tip_amount", "tip_percentage"]
    parts = _parts_by_code(source, dim_payment_type, "payment_type_key", "payment_type_name", amounts)
    return parts.select(
        "payment_type_name",
        "trips",
        total("tip_amount").alias("total_tips"),
        average("tip_amount").alias("average_tip"),
        average("tip_percentage").alias("average_tip_percentage"),
    )


def revenue_by_rate_code(source: DataFrame, dim_rate_code: DataFrame) -> DataFrame:
    """Trips and earnings per rate code; trips with an unknown code are in a row without a name."""
    amounts = ["total_amount", "fare_amount"]
    parts = _parts_by_code(source, dim_rate_code, "rate_code_key", "rate_code_name", amounts)
    return parts.select(
        "rate_code_name",
        "trips",
        total("total_amount").alias("total_revenue"),
        average("total_amount").alias("average_fare"),
        average("fare_amount").alias("average_fare_amount"),
    )


def demand_by_day_hour(source: DataFrame) -> DataFrame:
    pickup = F.col("pickup_datetime")
    by = [
        day_of_week_number(pickup).alias("day_of_week_number"),
        F.dayname(pickup).alias("day_of_week_name"),
        F.hour(pickup).alias("pickup_hour"),
    ]
    return parts_by(source, by, [])


def demand_by_grid(source: DataFrame) -> DataFrame:
    return parts_by(source, ["lat_bucket", "lon_bucket"], [])


_EFFICIENCY_AMOUNTS = ["trip_distance", "trip_duration_minutes", "total_amount"]
_CORRELATIONS = {
    "corr_distance_duration": ("trip_distance", "trip_duration_minutes"),
    "corr_distance_fare": ("trip_distance", "total_amount"),
    "corr_duration_fare": ("trip_duration_minutes", "total_amount"),
}


def efficiency_moments(located: DataFrame, *more: str) -> DataFrame:
    """What means and correlations of distance, duration and fare need, per borough and further columns."""
    return group_moments(located, ["borough", *more], _EFFICIENCY_AMOUNTS)


def efficiency(moments: DataFrame) -> DataFrame:
    """Means of distance, duration and fare and how they move together, per borough and over all trips.

    The row for all trips comes from the boroughs' moments. These do not depend
    on the order of the trips.
    """
    sums = summed_moments(moments, "borough", _EFFICIENCY_AMOUNTS, _CORRELATIONS)
    return with_correlations(sums, list(_CORRELATIONS)).select(
        "borough",
        "is_all_trips",
        "trips",
        *(average(name).alias(f"average_{name}") for name in _EFFICIENCY_AMOUNTS),
        *(round_to_cents(F.col(name)).alias(name) for name in _CORRELATIONS),
    )


def trip_efficiency(located: DataFrame) -> DataFrame:
    """The same from located trips, which are grouped once."""
    return efficiency(efficiency_moments(located))


def routes_by_own_boroughs(located: DataFrame, *more: str) -> DataFrame:
    """Trips from borough to borough by the trips' own coordinates: no join, and a few rows to shuffle."""
    dropoff = borough_of_trip(F.col("dropoff_latitude"), F.col("dropoff_longitude"))
    by = [F.col("borough").alias("pickup_borough"), dropoff.alias("dropoff_borough")]
    return group_parts(located, [*by, *more], [])


def trip_route_boroughs(fact: DataFrame, dim_location: DataFrame) -> DataFrame:
    """Trips from borough to borough: the location dimension joined in both of its roles.

    The dropoff role comes first, on trips grouped by their pair of keys. What
    is left, a pickup key and a dropoff borough, is grouped again and has at
    most a handful of rows per key when it meets the second role, so that a
    place that many trips start from is light there.
    """
    dropoff = dim_location.select(F.col("location_key").alias("dropoff_location_key"), F.col("borough").alias("dropoff_borough"))
    pickup = dim_location.select(F.col("location_key").alias("pickup_location_key"), F.col("borough").alias("pickup_borough"))
    pairs = group_parts(fact, ["pickup_location_key", "dropoff_location_key"], [])
    half = regroup_parts(pairs.join(dropoff, "dropoff_location_key", "left"), ["pickup_location_key", "dropoff_borough"], [])
    return regroup_parts(half.join(pickup, "pickup_location_key", "left"), ["pickup_borough", "dropoff_borough"], [])
