"""Grid buckets and boroughs of a coordinate pair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hackney.functions.measures import round_to_cents
from hackney.schemas import BOROUGH_BOXES, NO_BOROUGH


def grid_bucket(degrees: Column) -> Column:
    """Coordinate rounded to a hundredth of a degree; -0.0 becomes 0.0."""
    return round_to_cents(degrees) + 0.0


def borough(latitude: Column, longitude: Column) -> Column:
    """Borough of the first box that holds the point; points in no box, and missing ones, are outside."""
    name = F
    for box, south, north, west, east in BOROUGH_BOXES:
        name = name.when(latitude.between(south, north) & longitude.between(west, east), box)
    return name.otherwise(NO_BOROUGH)


def is_located(latitude: Column, longitude: Column) -> Column:
    return latitude.isNotNull() & longitude.isNotNull()


def borough_of_trip(latitude: Column, longitude: Column) -> Column:
    """What a left join of the trip to the location dimension finds: no borough for a trip without a key."""
    return F.when(is_located(latitude, longitude), borough(latitude, longitude))
