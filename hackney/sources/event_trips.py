"""Trips made from the `events` table, one per event.

The trips carry planted faults (bad and missing times, unparsable distances,
codes without a lookup row and so on), so that every rule of the engine meets
rows that break it. All values come from the event id and its time by whole
number arithmetic, which any SQL engine can repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hackney.schemas import RAW_COLUMNS

_EVENTS = "event_id bigint, ts timestamp_ntz"

# Offset of the dropoff behind the pickup, in seconds: some trips end before
# they start, some are very short and some are longer than five hours.
_OFFSET = """case event_id % 50
                 when 0 then -300 when 1 then 5 when 2 then 19200
                 else 60 * (1 + (event_id * 7919) % 90) + (event_id * 31) % 60 end"""
_FARE = "250 + (event_id * 104729) % 6000"
_TIP = "(event_id * 15485) % 1500"
_TOLLS = "case when event_id % 20 = 0 then 554 else 0 end"


def _cents(whole: str) -> str:
    return f"concat(({whole}) div 100, '.', lpad(({whole}) % 100, 2, '0'))"


def _degrees(whole: str) -> str:
    return f"concat(({whole}) div 10000, '.', lpad(({whole}) % 10000, 4, '0'))"


def _seconds(timestamp: str) -> str:
    return f"left(cast({timestamp} as string), 19)"


_EXPRESSIONS = {
    "raw_id": "concat('r-', event_id)",
    "batch_id": "concat('b-', event_id div 1000)",
    "pipeline_run_id": "'run-0'",
    "source_file": "'events.parquet'",
    "ingestion_timestamp": "timestamp_ntz'2024-02-01 00:00:00'",
    "vendor_id": "case event_id % 3 when 0 then '1' when 1 then ' 2 ' else '2' end",
    "pickup_datetime": f"""case when event_id % 997 = 0 then 'not-a-date'
                                when event_id % 991 = 0 then null
                                else {_seconds("ts")} end""",
    "dropoff_datetime": f"""case when event_id % 983 = 0 then ''
                                 else {_seconds(f"ts + make_dt_interval(0, 0, 0, {_OFFSET})")} end""",
    "passenger_count": "case when event_id % 401 = 0 then '0' else cast(1 + event_id % 5 as string) end",
    "trip_distance": f"""case when event_id % 171 = 0 then '0.0'
                              when event_id % 977 = 0 then 'abc'
                              else {_cents("1 + (event_id * 7919) % 3000")} end""",
    "pickup_longitude": f"concat('-', {_degrees('736500 + (event_id * 7919) % 7000')})",
    "pickup_latitude": f"""case when event_id % 971 = 0 then null
                                else {_degrees('404500 + (event_id * 6421) % 7000')} end""",
    "rate_code_id": "case when event_id % 7 = 6 then '99' else cast(1 + event_id % 7 as string) end",
    "store_fwd_flag": "case when event_id % 9 = 0 then 'Y ' else 'N' end",
    "dropoff_longitude": f"concat('-', {_degrees('736500 + (event_id * 3571) % 7000')})",
    "dropoff_latitude": _degrees("404500 + (event_id * 2749) % 7000"),
    "payment_type": "cast(1 + event_id % 7 as string)",
    "fare_amount": f"concat(case when event_id % 143 = 0 then '-' else '' end, {_cents(_FARE)})",
    "extra": "'0.5'",
    "mta_tax": "'0.5'",
    "tip_amount": _cents(_TIP),
    "tolls_amount": _cents(_TOLLS),
    "improvement_surcharge": "'0.3'",
    "total_amount": _cents(f"{_FARE} + {_TIP} + {_TOLLS} + 130"),
}


def trips_from_events(spark: SparkSession, folder: str) -> DataFrame:
    """Raw trips of the events in `folder`; only the id and the time are read."""
    events = spark.read.schema(_EVENTS).parquet(f"{folder}/events.parquet")
    return events.select(*(F.expr(_EXPRESSIONS[name]).alias(name) for name in RAW_COLUMNS))
