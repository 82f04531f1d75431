"""The staged views as SQL text, so that a catalog can keep them for any session.

They read the published table of typed trips and are worked out when they are
read. The text says what `operators.staging` says with columns; tests hold the
two against each other.
"""

from __future__ import annotations

from hackney.plans.warehouse import STAGING, Warehouse, schema_name
from hackney.schemas import DAY_PARTS, OTHER_DAY_PART, PAYMENT_TYPES, RATE_CODES, VENDORS

_TYPED = f"{schema_name(STAGING)}.stg_trips"


def _lookup(values: dict[str, str], code: str, name: str) -> str:
    rows = ", ".join(f"('{key}', '{text}')" for key, text in values.items())
    return f"select * from values {rows} as lookup({code}, {name})"


def _time_of_day(timestamp: str) -> str:
    parts = " ".join(f"when hour({timestamp}) between {first} and {last} then '{part}'" for part, first, last in DAY_PARTS)
    return f"case {parts} else '{OTHER_DAY_PART}' end"


def _grid_bucket(degrees: str) -> str:
    hundredths = f"{degrees} * 100"
    is_half = f"abs({hundredths} - rint({hundredths})) = 0.5"
    return f"case when {is_half} then {hundredths} + signum({hundredths}) * 0.5D else rint({hundredths}) end / 100D + 0.0D"


_DATETIME = f"""
select pickup_datetime, to_date(pickup_datetime) as trip_date, year(pickup_datetime) as trip_year,
  month(pickup_datetime) as trip_month, monthname(pickup_datetime) as trip_month_name,
  dayofmonth(pickup_datetime) as trip_day, dayofweek(pickup_datetime) - 1 as day_of_week_number,
  dayname(pickup_datetime) as day_of_week_name, weekofyear(pickup_datetime) as week_of_year,
  quarter(pickup_datetime) as trip_quarter, hour(pickup_datetime) as pickup_hour,
  minute(pickup_datetime) as pickup_minute, {_time_of_day("pickup_datetime")} as time_of_day,
  coalesce(dayofweek(pickup_datetime) in (1, 7), false) as is_weekend
from (select distinct pickup_datetime from {_TYPED} where has_pickup_datetime)
"""

_LOCATIONS = f"""
select longitude, latitude, {_grid_bucket("latitude")} as lat_bucket, {_grid_bucket("longitude")} as lon_bucket
from (
  select distinct place.longitude, place.latitude from (
    select explode(array_compact(array(
      case when has_pickup_place then named_struct('longitude', pickup_longitude, 'latitude', pickup_latitude) end,
      case when has_dropoff_place then named_struct('longitude', dropoff_longitude, 'latitude', dropoff_latitude) end
    ))) as place from {_TYPED}
  )
)
"""

STAGED_VIEWS = {
    "stg_datetime": _DATETIME,
    "stg_locations": _LOCATIONS,
    "stg_vendors": _lookup(VENDORS, "vendor_id", "vendor_name"),
    "stg_rate_codes": _lookup(RATE_CODES, "rate_code_id", "rate_code_name"),
    "stg_payment_types": _lookup(PAYMENT_TYPES, "payment_type_id", "payment_type_name"),
}


def open_catalog(warehouse: Warehouse) -> None:
    """Shows all published tables, and the staged views over them, in the catalog of the warehouse's session.

    The log of versions is all that is needed, so any session can be given the
    tables of any root when it starts.
    """
    warehouse.register()
    if warehouse.names(STAGING, ["stg_trips"]):
        for name, text in STAGED_VIEWS.items():
            warehouse.spark.sql(f"create or replace view {schema_name(STAGING)}.{name} as {text}")
