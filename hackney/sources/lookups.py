"""Code lookups as small tables of fixed size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hackney.schemas import PAYMENT_TYPES, RATE_CODES, VENDORS


def _lookup(spark: SparkSession, values: dict[str, str], code: str, name: str) -> DataFrame:
    rows = ", ".join(f"('{key}', '{text}')" for key, text in values.items())
    return spark.sql(f"select * from values {rows} as lookup({code}, {name})")


def stg_vendors(spark: SparkSession) -> DataFrame:
    return _lookup(spark, VENDORS, "vendor_id", "vendor_name")


def stg_rate_codes(spark: SparkSession) -> DataFrame:
    return _lookup(spark, RATE_CODES, "rate_code_id", "rate_code_name")


def stg_payment_types(spark: SparkSession) -> DataFrame:
    return _lookup(spark, PAYMENT_TYPES, "payment_type_id", "payment_type_name")
