"""Measures and quality flags of a trip."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hackney.schemas import LONGEST_MINUTES, SHORTEST_MINUTES


def round_half_away(number: Column) -> Column:
    """`number` rounded to a whole number, halves away from zero.

    The same as `round(number, 0)`, which takes each double through a decimal
    text; this form stays with doubles.
    """
    nearest = F.rint(number)
    is_half = F.abs(number - nearest) == 0.5
    return F.when(is_half, number + F.signum(number) * 0.5).otherwise(nearest)


def round_to_cents(number: Column) -> Column:
    """`number` rounded to two decimals on the binary value, so that 2.01 / 2.00 gives 1.0."""
    return round_half_away(number * 100) / 100


def _minute_number(timestamp: Column) -> Column:
    return F.floor(F.unix_timestamp(timestamp) / 60)


def minutes_between(start: Column, end: Column) -> Column:
    """Number of minute boundaries from `start` to `end`: 00:00:59 to 00:01:00 is one minute.

    Each time is used once: a filter on the duration is pushed below the
    projection that reads the texts, which then reads them again for each use.
    """
    return _minute_number(end) - _minute_number(start)


def fare_per_mile(fare: Column, distance: Column) -> Column:
    return F.when(distance > 0, round_to_cents(fare / distance))


def tip_percentage(tip: Column, fare: Column) -> Column:
    return F.when(fare > 0, round_to_cents(tip / fare * 100))


def is_true(condition: Column) -> Column:
    """`condition` with false in place of NULL."""
    return F.coalesce(condition, F.lit(False))


def within_duration(minutes: Column) -> Column:
    """True strictly between the bounds of a valid trip, NULL for a missing duration; one use of `minutes`."""
    middle = (SHORTEST_MINUTES + LONGEST_MINUTES) / 2
    reach = (LONGEST_MINUTES - SHORTEST_MINUTES) / 2
    return F.abs(minutes - F.lit(middle)) < F.lit(reach)
