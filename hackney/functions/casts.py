"""Safe casts of text: a value that cannot be read becomes NULL, never an error.

Spark's own `try_cast` reads more than a number or a time of the usual form:
`1.5d`, `0x1p3` and `NaN` are doubles to it and `2016` is the first of January.
The guards below look at the text first. A trip has thirteen numbers, so their
guard uses `translate`, which costs a fraction of a regular expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER_CHARACTERS = "0123456789+-.eE \t\r\n"
_TIME_PATTERN = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}:\d{2}(\.\d+)?)?$"


def to_double(text: Column) -> Column:
    """The number written in `text`, or NULL; one too large for a double is NULL too."""
    only_number_characters = F.translate(text, _NUMBER_CHARACTERS, "") == ""
    number = text.try_cast("double")
    return F.when(only_number_characters & (F.abs(number) < F.lit(float("inf"))), number)


def to_timestamp(text: Column) -> Column:
    """The time without zone written in `text` as year-month-day with or without a time of day, or NULL."""
    return F.when(text.rlike(_TIME_PATTERN), text.try_cast("timestamp_ntz"))
