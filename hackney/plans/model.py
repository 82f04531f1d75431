"""The tables of the model as a graph of DataFrames over one raw table, or over its trips as written typed."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from hackney.operators import dimensions, staging, trips
from hackney.sources import lookups

STAGING = ["stg_trips", "stg_datetime", "stg_locations", "stg_vendors", "stg_rate_codes", "stg_payment_types"]
MARTS = ["dim_datetime", "dim_location", "dim_vendor", "dim_rate_code", "dim_payment_type", "fact_trip"]


@dataclass
class Model:
    """Every table as a lazy DataFrame; nothing runs until one is written or read."""

    spark: SparkSession
    raw: DataFrame | None = None
    written: DataFrame | None = None

    @cached_property
    def typed(self) -> DataFrame:
        return staging.typed_trips(self.raw) if self.written is None else self.written

    @cached_property
    def stg_trips(self) -> DataFrame:
        return staging.stg_trips(self.typed)

    @cached_property
    def stg_datetime(self) -> DataFrame:
        return staging.stg_datetime(self.typed)

    @cached_property
    def stg_locations(self) -> DataFrame:
        return staging.stg_locations(self.typed)

    @cached_property
    def stg_vendors(self) -> DataFrame:
        return lookups.stg_vendors(self.spark)

    @cached_property
    def stg_rate_codes(self) -> DataFrame:
        return lookups.stg_rate_codes(self.spark)

    @cached_property
    def stg_payment_types(self) -> DataFrame:
        return lookups.stg_payment_types(self.spark)

    @cached_property
    def dim_datetime(self) -> DataFrame:
        return dimensions.dim_datetime(self.stg_datetime)

    @cached_property
    def dim_location(self) -> DataFrame:
        return dimensions.dim_location(self.stg_locations)

    @cached_property
    def dim_vendor(self) -> DataFrame:
        return dimensions.dim_vendor(self.stg_vendors)

    @cached_property
    def dim_rate_code(self) -> DataFrame:
        return dimensions.dim_rate_code(self.stg_rate_codes)

    @cached_property
    def dim_payment_type(self) -> DataFrame:
        return dimensions.dim_payment_type(self.stg_payment_types)

    @cached_property
    def valid_trips(self) -> DataFrame:
        return trips.valid_trips(self.stg_trips)

    @cached_property
    def fact_trip(self) -> DataFrame:
        return trips.fact_trip(self.stg_trips)

    @cached_property
    def quarantine_trips(self) -> DataFrame:
        return trips.quarantine_trips(self.stg_trips)

    def marts(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in MARTS}
