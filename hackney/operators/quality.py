"""Data quality checks. A check passes when it finds no failing row.

Checks are data: a table, a kind and a column. The report counts the failures
of all checks of a table in one scan of it, with one grouping by its key. The
conditions on single rows can also be counted while the table is written; the
report then takes these counts and groups the keys alone.

`failures` gives the rows that failed, for all checks in one form.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    table: str
    kind: str
    column: str

    @property
    def name(self) -> str:
        return f"{self.kind}_{self.table}_{self.column}"


# The checks on the published tables.
KEYS = {
    "fact_trip": "trip_key",
    "dim_datetime": "datetime_key",
    "dim_location": "location_key",
    "dim_vendor": "vendor_key",
    "dim_rate_code": "rate_code_key",
    "dim_payment_type": "payment_type_key",
}
REQUIRED_FACT_COLUMNS = [
    "trip_key",
    "datetime_key",
    "pickup_location_key",
    "dropoff_location_key",
    "fare_amount",
    "total_amount",
]
UNIQUE = [Check(table, "unique", key) for table, key in KEYS.items()]
NOT_NULL = [Check("fact_trip", "not_null", column) for column in REQUIRED_FACT_COLUMNS] + [
    Check(table, "not_null", key) for table, key in KEYS.items() if table != "fact_trip"
]
NO_NEGATIVE_FARES = Check("fact_trip", "not_negative", "fare_amount")
DROPOFF_AFTER_PICKUP = Check("fact_trip", "not_before_pickup", "dropoff_datetime")
ALL_CHECKS = UNIQUE + NOT_NULL + [NO_NEGATIVE_FARES, DROPOFF_AFTER_PICKUP]
#: Columns of the fact that name a row of a dimension: the dimension by column.
REFERENCES = {
    "datetime_key": "dim_datetime",
    "pickup_location_key": "dim_location",
    "dropoff_location_key": "dim_location",
    "vendor_key": "dim_vendor",
    "rate_code_key": "dim_rate_code",
    "payment_type_key": "dim_payment_type",
}


class QualityCheckFailed(RuntimeError):
    """At least one check found failing rows."""


def _fails(check: Check) -> Column:
    """Condition of a row that fails a check on single rows."""
    column = F.col(check.column)
    if check.kind == "not_null":
        return column.isNull()
    if check.kind == "not_negative":
        return column < 0
    return column < F.col("pickup_datetime")


def _repeated_keys(table: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return table.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def failing_rows(check: Check, table: DataFrame) -> DataFrame:
    """The rows, or for uniqueness the keys, that a check finds."""
    if check.kind == "unique":
        return _repeated_keys(table, check.column)
    return table.filter(_fails(check))


def _as_rows(counts: DataFrame, checks: list[Check]) -> DataFrame:
    """One row per check from one row with a column per check."""
    rows = [
        F.struct(
            F.lit(check.name).alias("check_name"),
            F.lit(check.table).alias("table_name"),
            F.col(check.name).alias("failures"),
        )
        for check in checks
    ]
    return counts.select(F.inline(F.array(*rows)))


def row_conditions(table: str, checks: list[Check] = ALL_CHECKS) -> dict[str, Column]:
    """For each check on single rows of a table, the number of rows that fail it, as an aggregate by name."""
    return {check.name: F.count_if(_fails(check)) for check in checks if check.table == table and check.kind != "unique"}


def _count(checks: list[Check], table: DataFrame) -> DataFrame:
    """Failures of all checks of a table, from one grouping by its key if that must be unique.

    The partial count takes copies of a key together within each task, so a
    key that fills a third of the table does not fill a task of the shuffle.
    """
    conditions = row_conditions(checks[0].table, checks)
    unique = [check for check in checks if check.kind == "unique"]
    if not unique:
        return _as_rows(table.agg(*(failed.alias(name) for name, failed in conditions.items())), checks)
    counts = [failed.alias(name) for name, failed in conditions.items()]
    groups = table.groupBy(unique[0].column).agg(F.count(F.lit(1)).alias("n"), *counts)
    totals = [F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in conditions]
    totals += [F.count_if(F.col(check.column).isNotNull() & (F.col("n") > 1)).alias(check.name) for check in unique]
    return _as_rows(groups.agg(*totals), checks)


def report(tables: dict[str, DataFrame], checks: list[Check] = ALL_CHECKS, known: dict[str, int] | None = None) -> DataFrame:
    """One row per check with the number of its failures; those of `known`, by name, are not counted again."""
    known = known or {}
    parts = []
    for name in dict.fromkeys(check.table for check in checks):
        here = [check for check in checks if check.table == name and check.name not in known]
        parts += [_count(here, tables[name])] if here else []
    counted = [(check.name, check.table, known[check.name]) for check in checks if check.name in known]
    if counted:
        spark = next(iter(tables.values())).sparkSession
        parts.append(spark.createDataFrame(counted, "check_name string, table_name string, failures long"))
    return reduce(DataFrame.union, parts)


def failures(tables: dict[str, DataFrame], checks: list[Check]) -> DataFrame:
    """check_name, table_name and, as JSON, every failing row of the checks, or key with its number of rows for uniqueness."""
    schema = "check_name string, table_name string, failing_row string"
    parts = [next(iter(tables.values())).sparkSession.createDataFrame([], schema)]
    for check in checks:
        names = [F.lit(check.name).alias("check_name"), F.lit(check.table).alias("table_name")]
        found = failing_rows(check, tables[check.table])
        parts.append(found.select(*names, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("failing_row")))
    return reduce(DataFrame.union, parts)


def relationships(tables: dict[str, DataFrame], fact: str = "fact_trip", references: dict[str, str] = REFERENCES) -> DataFrame:
    """One row per column of the fact that refers to a dimension: rows and keys that the dimension does not have, rows without a key.

    The fact is read once and grouped by key first, so a key of very many trips
    is one row when it meets its dimension, and the join uses the partitions of
    the grouping.
    """
    named = [
        F.struct(F.lit(column).alias("column"), F.lit(dimension).alias("dimension"), F.col(column).alias("key"))
        for column, dimension in references.items()
    ]
    rows = [F.count_if(F.col("column") == column).alias(column) for column in references]
    groups = tables[fact].select(F.inline(F.array(*named))).groupBy("dimension", "key").agg(*rows)
    parts = [
        tables[dimension].select(F.lit(dimension).alias("dimension"), F.col(KEYS[dimension]).alias("key"))
        for dimension in dict.fromkeys(references.values())
    ]
    orphans = groups.join(reduce(DataFrame.union, parts), ["dimension", "key"], "left_anti")
    has_key = F.col("key").isNotNull()
    totals = {}
    for column in references:
        totals[f"{column}_failures"] = F.coalesce(F.sum(F.when(has_key, F.col(column))), F.lit(0))
        totals[f"{column}_keys"] = F.count_if(has_key & (F.col(column) > 0))
        totals[f"{column}_missing"] = F.coalesce(F.sum(F.when(~has_key, F.col(column))), F.lit(0))
    one_row = orphans.agg(*(total.alias(name) for name, total in totals.items()))
    lines = [
        F.struct(
            F.lit(Check(fact, "relationship", column).name).alias("check_name"),
            F.lit(fact).alias("table_name"),
            F.lit(dimension).alias("dimension"),
            F.col(f"{column}_failures").alias("failures"),
            F.col(f"{column}_keys").alias("failing_keys"),
            F.col(f"{column}_missing").alias("rows_without_key"),
        )
        for column, dimension in references.items()
    ]
    return one_row.select(F.inline(F.array(*lines)))


def count_before_and_after(check: Check, staged: DataFrame, fact: DataFrame) -> DataFrame:
    """Rows seen and failures of a row check on the staged trips, where faults are expected, and on the fact."""

    def counted(name: str, table: DataFrame) -> DataFrame:
        counts = table.agg(F.count(F.lit(1)).alias("rows_checked"), F.count_if(_fails(check)).alias("failures"))
        return counts.select(F.lit(name).alias("table_name"), "rows_checked", "failures")

    return counted("stg_trips", staged).union(counted("fact_trip", fact))


def require_all_passed(quality_report: DataFrame) -> None:
    """Raises if any check failed. The report has one row per check, so collecting it is safe."""
    failed = quality_report.filter("failures > 0").orderBy("check_name").collect()
    if failed:
        raise QualityCheckFailed(", ".join(f"{row.check_name}: {row.failures}" for row in failed))
