"""The registered queries as SQL for another engine, to compare results with.

The SQL follows the definitions of the tables, step by step and with plain
functions. It leaves out what Spark needs for scale, such as grouping before a
join, and uses joins where the Spark queries work a value out in place.
"""

from __future__ import annotations

from hackney.operators import quality
from hackney.schemas import (
    BOROUGH_BOXES,
    DAY_PARTS,
    NO_BOROUGH,
    OTHER_DAY_PART,
    PAYMENT_TYPES,
    RATE_CODES,
    RAW_COLUMNS,
    SOURCE_COLUMNS,
    VENDORS,
)

_NUMBERS = [
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


def _decimal(whole: str, scale: int, digits: int) -> str:
    return f"(({whole}) // {scale}) || '.' || lpad(cast(({whole}) % {scale} as varchar), {digits}, '0')"


def _cents(whole: str) -> str:
    return _decimal(whole, 100, 2)


def _degrees(whole: str) -> str:
    return _decimal(whole, 10000, 4)


_FARE = "250 + (event_id * 104729) % 6000"
_TIP = "(event_id * 15485) % 1500"
_TOLLS = "case when event_id % 20 = 0 then 554 else 0 end"

_RAW = f"""
select 'r-' || event_id as raw_id,
       'b-' || (event_id // 1000) as batch_id,
       'run-0' as pipeline_run_id,
       'events.parquet' as source_file,
       timestamp '2024-02-01 00:00:00' as ingestion_timestamp,
       case event_id % 3 when 0 then '1' when 1 then ' 2 ' else '2' end as vendor_id,
       case when event_id % 997 = 0 then 'not-a-date' when event_id % 991 = 0 then null
            else strftime(ts, '%Y-%m-%d %H:%M:%S') end as pickup_datetime,
       case when event_id % 983 = 0 then ''
            else strftime(ts + to_seconds(case event_id % 50 when 0 then -300 when 1 then 5 when 2 then 19200
                          else 60 * (1 + (event_id * 7919) % 90) + (event_id * 31) % 60 end),
                          '%Y-%m-%d %H:%M:%S') end as dropoff_datetime,
       case when event_id % 401 = 0 then '0' else cast(1 + event_id % 5 as varchar) end as passenger_count,
       case when event_id % 171 = 0 then '0.0' when event_id % 977 = 0 then 'abc'
            else {_cents("1 + (event_id * 7919) % 3000")} end as trip_distance,
       '-' || {_degrees("736500 + (event_id * 7919) % 7000")} as pickup_longitude,
       case when event_id % 971 = 0 then null
            else {_degrees("404500 + (event_id * 6421) % 7000")} end as pickup_latitude,
       case when event_id % 7 = 6 then '99' else cast(1 + event_id % 7 as varchar) end as rate_code_id,
       case when event_id % 9 = 0 then 'Y ' else 'N' end as store_fwd_flag,
       '-' || {_degrees("736500 + (event_id * 3571) % 7000")} as dropoff_longitude,
       {_degrees("404500 + (event_id * 2749) % 7000")} as dropoff_latitude,
       cast(1 + event_id % 7 as varchar) as payment_type,
       case when event_id % 143 = 0 then '-' else '' end || {_cents(_FARE)} as fare_amount,
       '0.5' as extra,
       '0.5' as mta_tax,
       {_cents(_TIP)} as tip_amount,
       {_cents(_TOLLS)} as tolls_amount,
       '0.3' as improvement_surcharge,
       {_cents(f"{_FARE} + {_TIP} + {_TOLLS} + 130")} as total_amount
from events
"""


def _lookup(values: dict[str, str], code: str, name: str) -> str:
    rows = ", ".join(f"('{key}', '{text}')" for key, text in values.items())
    return f"select * from (values {rows}) as t({code}, {name})"


def _time_of_day(timestamp: str) -> str:
    parts = " ".join(f"when hour({timestamp}) between {first} and {last} then '{part}'" for part, first, last in DAY_PARTS)
    return f"case {parts} else '{OTHER_DAY_PART}' end"


def _borough(latitude: str, longitude: str) -> str:
    boxes = " ".join(
        f"when {latitude} between {south} and {north} and {longitude} between {west} and {east} then '{name}'"
        for name, south, north, west, east in BOROUGH_BOXES
    )
    return f"case {boxes} else '{NO_BOROUGH}' end"


def _location_key(latitude: str, longitude: str) -> str:
    return f"md5(cast({latitude} as varchar) || '|' || cast({longitude} as varchar))"


_STG_TRIPS = f"""
select raw_id, batch_id, pipeline_run_id, ingestion_timestamp, pickup_datetime, dropoff_datetime,
       date_diff('minute', pickup_datetime, dropoff_datetime) as trip_duration_minutes,
       vendor_id, rate_code_id, payment_type, store_fwd_flag, {", ".join(_NUMBERS)},
       case when trip_distance > 0 then round(fare_amount / trip_distance, 2) end as fare_per_mile,
       case when fare_amount > 0 then round(tip_amount / fare_amount * 100, 2) end as tip_percentage,
       coalesce(trip_distance = 0, false) as is_zero_distance,
       coalesce(passenger_count = 0, false) as is_zero_passengers,
       coalesce(fare_amount < 0, false) as has_negative_fare,
       coalesce(dropoff_datetime < pickup_datetime, false) as has_invalid_timestamps
from (select raw_id, batch_id, pipeline_run_id, ingestion_timestamp,
             try_cast(pickup_datetime as timestamp) as pickup_datetime,
             try_cast(dropoff_datetime as timestamp) as dropoff_datetime,
             trim(vendor_id) as vendor_id, trim(rate_code_id) as rate_code_id,
             trim(payment_type) as payment_type, trim(store_fwd_flag) as store_fwd_flag,
             {", ".join(f"try_cast({name} as double) as {name}" for name in _NUMBERS)}
      from raw_trips)
"""

_STG_DATETIME = f"""
select pickup_datetime,
       cast(pickup_datetime as date) as trip_date,
       cast(year(pickup_datetime) as integer) as trip_year,
       cast(month(pickup_datetime) as integer) as trip_month,
       left(monthname(pickup_datetime), 3) as trip_month_name,
       cast(day(pickup_datetime) as integer) as trip_day,
       cast(dayofweek(pickup_datetime) as integer) as day_of_week_number,
       left(dayname(pickup_datetime), 3) as day_of_week_name,
       cast(weekofyear(pickup_datetime) as integer) as week_of_year,
       cast(quarter(pickup_datetime) as integer) as trip_quarter,
       cast(hour(pickup_datetime) as integer) as pickup_hour,
       cast(minute(pickup_datetime) as integer) as pickup_minute,
       {_time_of_day("pickup_datetime")} as time_of_day,
       coalesce(dayofweek(pickup_datetime) in (0, 6), false) as is_weekend
from (select distinct try_cast(pickup_datetime as timestamp) as pickup_datetime
      from raw_trips where pickup_datetime is not null)
"""

_PAIRS = """
select distinct try_cast({end}_longitude as double) as longitude, try_cast({end}_latitude as double) as latitude
from raw_trips where {end}_longitude is not null and {end}_latitude is not null
"""

_VALID = """
select * from stg_trips
where not is_zero_distance and not is_zero_passengers and not has_negative_fare and not has_invalid_timestamps
  and trip_duration_minutes > 0 and trip_duration_minutes < 300
"""

_FACT = f"""
select md5(raw_id) as trip_key,
       md5(cast(pickup_datetime as varchar)) as datetime_key,
       {_location_key("pickup_latitude", "pickup_longitude")} as pickup_location_key,
       {_location_key("dropoff_latitude", "dropoff_longitude")} as dropoff_location_key,
       md5(vendor_id) as vendor_key, md5(rate_code_id) as rate_code_key, md5(payment_type) as payment_type_key,
       pickup_datetime, dropoff_datetime, passenger_count, trip_distance, trip_duration_minutes, fare_per_mile,
       tip_percentage, fare_amount, extra, mta_tax, tip_amount, tolls_amount, improvement_surcharge, total_amount,
       store_fwd_flag, raw_id, batch_id, ingestion_timestamp
from valid_trips
"""

_TABLES = {
    "raw_trips": _RAW,
    "stg_vendors": _lookup(VENDORS, "vendor_id", "vendor_name"),
    "stg_rate_codes": _lookup(RATE_CODES, "rate_code_id", "rate_code_name"),
    "stg_payment_types": _lookup(PAYMENT_TYPES, "payment_type_id", "payment_type_name"),
    "stg_trips": _STG_TRIPS,
    "stg_datetime": _STG_DATETIME,
    "all_locations": f"{_PAIRS.format(end='pickup')} union {_PAIRS.format(end='dropoff')}",
    "stg_locations": """select distinct longitude, latitude, round(latitude, 2) as lat_bucket,
                               round(longitude, 2) as lon_bucket from all_locations""",
    "dim_datetime": "select md5(cast(pickup_datetime as varchar)) as datetime_key, * from stg_datetime",
    "dim_location": f"""select {_location_key("latitude", "longitude")} as location_key, latitude, longitude,
                               lat_bucket, lon_bucket, {_borough("latitude", "longitude")} as borough
                        from stg_locations""",
    "dim_vendor": "select md5(vendor_id) as vendor_key, * from stg_vendors",
    "dim_rate_code": "select md5(rate_code_id) as rate_code_key, * from stg_rate_codes",
    "dim_payment_type": "select md5(payment_type_id) as payment_type_key, * from stg_payment_types",
    "valid_trips": _VALID,
    "fact_trip": _FACT,
}


def _with_tables(query: str) -> str:
    tables = ",\n".join(f"{name} as ({text})" for name, text in _TABLES.items())
    return f"with {tables}\n{query}"


def _sum(amount: str) -> str:
    return f"cast(sum(cast({amount} as decimal(18, 2))) as double)"


def _average(amount: str) -> str:
    return f"{_sum(amount)} / count({amount})"


def _correlation(x: str, y: str) -> str:
    """Over the trips with both values; missing where one of them does not vary."""
    both = f"filter (where {x} is not null and {y} is not null)"

    def mean(value: str) -> str:
        return f"(cast(sum(cast({value} as decimal(28, 6))) {both} as double) / nullif(count(*) {both}, 0))"

    variance_x, variance_y = (f"({mean(f'{v} * {v}')} - {mean(v)} * {mean(v)})" for v in (x, y))
    varies = f"min({x}) {both} < max({x}) {both} and min({y}) {both} < max({y}) {both}"
    return f"""round(case when {varies} then ({mean(f"{x} * {y}")} - {mean(x)} * {mean(y)})
                  / sqrt({variance_x} * {variance_y}) end, 2)"""


_SHARE = "round(count(*) * 100 / sum(count(*)) over (), 2) as share_of_trips"
_LOCATED = "fact_trip left join dim_location on pickup_location_key = location_key"


def _unique_failures(table: str, key: str) -> str:
    name = quality.Check(table, "unique", key).name
    return f"""select '{name}' as check_name, '{table}' as table_name, count(*) as failures
               from (select {key} from {table} where {key} is not null group by {key} having count(*) > 1)"""


def _failures(check: quality.Check, condition: str) -> str:
    return f"""select '{check.name}' as check_name, '{check.table}' as table_name, count(*) as failures
               from {check.table} where {condition}"""


_UNIQUE = " union all ".join(_unique_failures(check.table, check.column) for check in quality.UNIQUE)
_NOT_NULL = " union all ".join(_failures(check, f"{check.column} is null") for check in quality.NOT_NULL)
_ROW_TESTS = " union all ".join(
    [
        _failures(quality.NO_NEGATIVE_FARES, "fare_amount < 0"),
        _failures(quality.DROPOFF_AFTER_PICKUP, "dropoff_datetime < pickup_datetime"),
    ]
)


def _relationship(column: str, dimension: str) -> str:
    name = quality.Check("fact_trip", "relationship", column).name
    unknown = f"{column} is not null and {column} not in (select {quality.KEYS[dimension]} from {dimension} where {quality.KEYS[dimension]} is not null)"
    return f"""select '{name}' as check_name, 'fact_trip' as table_name, '{dimension}' as dimension,
                      count(*) filter (where {unknown}) as failures,
                      count(distinct {column}) filter (where {unknown}) as failing_keys,
                      count(*) filter (where {column} is null) as rows_without_key from fact_trip"""


_RELATIONSHIPS = " union all ".join(_relationship(column, dimension) for column, dimension in quality.REFERENCES.items())


def _before_and_after(condition: str) -> str:
    return " union all ".join(
        f"""select '{table}' as table_name, count(*) as rows_checked,
                   count(*) filter (where {condition}) as failures from {table}"""
        for table in ("stg_trips", "fact_trip")
    )


def _trips_per_code(lookup: str, code: str, lookup_code: str, name: str) -> str:
    return f"""select t.{code}, count(*) as trips, {name} from stg_trips t left join {lookup} l
               on t.{code} = l.{lookup_code} group by t.{code}, {name}"""


def _dimension_with_trips(dimension: str, key: str) -> str:
    return f"""select d.*, (select count(*) from fact_trip f where f.{key} = d.{key}) as trips from {dimension} d"""


def _joined(code: str, dimension: str, dimension_code: str, key: str, name: str) -> str:
    return f"""select raw_id, t.{code}, {key}, {name} from valid_trips t
               left join {dimension} d on t.{code} = d.{dimension_code}"""


def _staged(columns: str) -> str:
    return f"select raw_id, {columns} from stg_trips"


_REASONS = {
    "zero_distance": "is_zero_distance",
    "zero_passengers": "is_zero_passengers",
    "negative_fare": "has_negative_fare",
    "invalid_timestamps": "has_invalid_timestamps",
    "missing_duration": "trip_duration_minutes is null",
    "duration_too_short": "trip_duration_minutes <= 0",
    "duration_too_long": "trip_duration_minutes >= 300",
}
_QUARANTINE = f"""
select *, concat_ws(',', {", ".join(f"case when {test} then '{name}' end" for name, test in _REASONS.items())})
          as reject_reasons
from stg_trips where raw_id not in (select raw_id from valid_trips)
"""
_REJECTS = " union all ".join(
    [f"select '{name}' as issue, count(*) as trips from stg_trips where {test}" for name, test in _REASONS.items()]
    + [
        "select 'rejected', count(*) from stg_trips where raw_id not in (select raw_id from valid_trips)",
        "select 'valid', count(*) from valid_trips",
    ]
)

# The file readers take an empty cell for a missing one.
_FILE_COLUMNS = ", ".join(f"nullif({name}, '') as {name}" for name in SOURCE_COLUMNS)

_QUERIES = {
    "raw_trips": f"select {', '.join(RAW_COLUMNS)} from raw_trips",
    "csv_trips": f"select 'b-0' as batch_id, 'run-0' as pipeline_run_id, {_FILE_COLUMNS} from raw_trips",
    "new_file_trips": f"select {_FILE_COLUMNS} from raw_trips",
    "stg_vendors": _trips_per_code("stg_vendors", "vendor_id", "vendor_id", "vendor_name"),
    "stg_rate_codes": _trips_per_code("stg_rate_codes", "rate_code_id", "rate_code_id", "rate_code_name"),
    "stg_payment_types": _trips_per_code("stg_payment_types", "payment_type", "payment_type_id", "payment_type_name"),
    "op_try_timestamp": _staged("pickup_datetime, dropoff_datetime"),
    "op_try_double": _staged(", ".join(_NUMBERS)),
    "op_trim_codes": _staged("vendor_id, rate_code_id, payment_type, store_fwd_flag"),
    "op_trip_duration": _staged("trip_duration_minutes"),
    "op_fare_per_mile": _staged("fare_per_mile"),
    "op_tip_percentage": _staged("tip_percentage"),
    "op_quality_flags": _staged("is_zero_distance, is_zero_passengers, has_negative_fare, has_invalid_timestamps"),
    "op_time_of_day": _staged(f"{_time_of_day('pickup_datetime')} as time_of_day"),
    "op_weekend_flag": _staged("coalesce(dayofweek(pickup_datetime) in (0, 6), false) as is_weekend"),
    "op_grid_bucket": _staged("round(pickup_latitude, 2) as lat_bucket, round(pickup_longitude, 2) as lon_bucket"),
    "op_borough": _staged(
        f"{_borough('pickup_latitude', 'pickup_longitude')} as pickup_borough, "
        f"{_borough('dropoff_latitude', 'dropoff_longitude')} as dropoff_borough"
    ),
    "op_code_keys": _staged(
        "md5(vendor_id) as vendor_key, md5(rate_code_id) as rate_code_key, md5(payment_type) as payment_type_key"
    ),
    "op_datetime_key": _staged("md5(cast(pickup_datetime as varchar)) as datetime_key"),
    "op_location_key": _staged(
        f"{_location_key('pickup_latitude', 'pickup_longitude')} as pickup_location_key, "
        f"{_location_key('dropoff_latitude', 'dropoff_longitude')} as dropoff_location_key"
    ),
    "op_trip_key": "select raw_id, md5(raw_id) as trip_key from raw_trips",
    "stg_trips": "select * from stg_trips",
    "stg_datetime": "select * from stg_datetime",
    "stg_locations": "select * from stg_locations",
    "op_distinct_pickup_times": "select pickup_datetime from stg_datetime",
    "op_union_locations": "select * from all_locations",
    "dim_datetime": "select * from dim_datetime",
    "dim_location": "select * from dim_location",
    "dim_vendor": _dimension_with_trips("dim_vendor", "vendor_key"),
    "dim_rate_code": _dimension_with_trips("dim_rate_code", "rate_code_key"),
    "dim_payment_type": _dimension_with_trips("dim_payment_type", "payment_type_key"),
    "fact_trip": "select * from fact_trip",
    "op_valid_trips": "select raw_id, trip_duration_minutes from valid_trips",
    "quarantine_trips": _QUARANTINE,
    "reject_summary": _REJECTS,
    "op_join_vendor": _joined("vendor_id", "dim_vendor", "vendor_id", "vendor_key", "vendor_name"),
    "op_join_rate_code": _joined("rate_code_id", "dim_rate_code", "rate_code_id", "rate_code_key", "rate_code_name"),
    "op_join_payment_type": _joined(
        "payment_type", "dim_payment_type", "payment_type_id", "payment_type_key", "payment_type_name"
    ),
    "trip_route_boroughs": """
        select p.borough as pickup_borough, d.borough as dropoff_borough, count(*) as trips
        from fact_trip f
        left join dim_location p on f.pickup_location_key = p.location_key
        left join dim_location d on f.dropoff_location_key = d.location_key
        group by 1, 2""",
    "dq_unique": _UNIQUE,
    "dq_not_null": _NOT_NULL,
    "dq_no_negative_fares": _before_and_after("fare_amount < 0"),
    "dq_dropoff_after_pickup": _before_and_after("dropoff_datetime < pickup_datetime"),
    "dq_report": f"{_UNIQUE} union all {_NOT_NULL} union all {_ROW_TESTS}",
    "dq_relationships": _RELATIONSHIPS,
    "kpi_summary": f"""
        select {_sum("total_amount")} as total_revenue, count(*) as total_trips,
               {_average("total_amount")} as average_fare, {_average("trip_distance")} as average_distance,
               {_average("trip_duration_minutes")} as average_duration,
               {_average("tip_percentage")} as average_tip_percentage,
               {_sum("tip_amount")} / {_sum("fare_amount")} * 100 as tip_percentage_of_fares
        from fact_trip""",
    "trips_by_borough": f"select borough, count(*) as trips, {_SHARE} from {_LOCATED} group by borough",
    "fare_by_borough": f"""
        select borough, count(*) as trips, {_average("total_amount")} as average_fare,
               {_average("fare_amount")} as average_fare_amount
        from {_LOCATED} group by borough""",
    "trips_by_time_of_day": f"""
        select time_of_day, count(*) as trips, {_SHARE}
        from fact_trip join dim_datetime using (datetime_key) group by time_of_day""",
    "fare_by_time_of_day": f"""
        select time_of_day, count(*) as trips, {_average("total_amount")} as average_fare
        from fact_trip join dim_datetime using (datetime_key) group by time_of_day""",
    "tips_by_payment_type": f"""
        select payment_type_name, count(*) as trips, {_sum("tip_amount")} as total_tips,
               {_average("tip_amount")} as average_tip, {_average("tip_percentage")} as average_tip_percentage
        from fact_trip left join dim_payment_type using (payment_type_key) group by payment_type_name""",
    "revenue_by_rate_code": f"""
        select rate_code_name, count(*) as trips, {_sum("total_amount")} as total_revenue,
               {_average("total_amount")} as average_fare, {_average("fare_amount")} as average_fare_amount
        from fact_trip left join dim_rate_code using (rate_code_key) group by rate_code_name""",
    "demand_by_day_hour": """
        select day_of_week_number, day_of_week_name, pickup_hour, count(*) as trips
        from fact_trip join dim_datetime using (datetime_key) group by 1, 2, 3""",
    "demand_by_grid": f"select lat_bucket, lon_bucket, count(*) as trips from {_LOCATED} group by 1, 2",
    "trip_efficiency": f"""
        select borough, grouping(borough) = 1 as is_all_trips, count(*) as trips,
               {_average("trip_distance")} as average_trip_distance,
               {_average("trip_duration_minutes")} as average_trip_duration_minutes,
               {_average("total_amount")} as average_total_amount,
               {_correlation("trip_distance", "trip_duration_minutes")} as corr_distance_duration,
               {_correlation("trip_distance", "total_amount")} as corr_distance_fare,
               {_correlation("trip_duration_minutes", "total_amount")} as corr_duration_fare
        from {_LOCATED} group by rollup (borough)""",
}


def oracle_sql() -> dict[str, str]:
    return {name: _with_tables(query) for name, query in _QUERIES.items()}
