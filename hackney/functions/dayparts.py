"""Calendar and clock attributes of a pickup time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hackney.functions.measures import is_true
from hackney.schemas import DAY_PARTS, OTHER_DAY_PART


def day_of_week_number(timestamp: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(timestamp) - 1


def is_weekend(timestamp: Column) -> Column:
    return is_true(day_of_week_number(timestamp).isin(0, 6))


def time_of_day(timestamp: Column) -> Column:
    """Name of the part of the day; hours in no part, and missing times, are Late Night."""
    hour = F.hour(timestamp)
    name = F
    for part, first, last in DAY_PARTS:
        name = name.when(hour.between(first, last), part)
    return name.otherwise(OTHER_DAY_PART)


def start_of_hour(timestamp: Column) -> Column:
    """The full hour at or before a time; unlike `date_trunc` it stays without a time zone."""
    hours = F.make_dt_interval(hours=F.hour(timestamp))
    return timestamp.cast("date").cast("timestamp_ntz") + hours


def datetime_attributes(timestamp: Column) -> dict[str, Column]:
    """The descriptive columns of a pickup time, by name."""
    return {
        "trip_date": F.to_date(timestamp),
        "trip_year": F.year(timestamp),
        "trip_month": F.month(timestamp),
        "trip_month_name": F.monthname(timestamp),
        "trip_day": F.dayofmonth(timestamp),
        "day_of_week_number": day_of_week_number(timestamp),
        "day_of_week_name": F.dayname(timestamp),
        "week_of_year": F.weekofyear(timestamp),
        "trip_quarter": F.quarter(timestamp),
        "pickup_hour": F.hour(timestamp),
        "pickup_minute": F.minute(timestamp),
        "time_of_day": time_of_day(timestamp),
        "is_weekend": is_weekend(timestamp),
    }
