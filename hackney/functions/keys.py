"""Hashed keys. Facts and dimensions must both take their keys from here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_key(code: Column) -> Column:
    return F.md5(code)


def datetime_key(timestamp: Column) -> Column:
    return F.md5(timestamp.cast("string"))


def _degrees_text(degrees: Column) -> Column:
    # Adding 0.0 turns -0.0 into 0.0, so that equal coordinates have equal texts.
    return (degrees + 0.0).cast("string")


def location_key(latitude: Column, longitude: Column) -> Column:
    """Key of the pair; NULL where a part is NULL."""
    return F.md5(F.concat(_degrees_text(latitude), F.lit("|"), _degrees_text(longitude)))


def trip_key(raw_id: Column) -> Column:
    return F.md5(raw_id)
