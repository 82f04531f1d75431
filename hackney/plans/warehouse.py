"""Layers of tables in a shared folder.

A full load writes its table into a new folder. Once that has succeeded, a row
in the control layer makes the folder the table's current version, so that a
failed load leaves the old version in place and readers never meet a half
written one. `register` shows the current versions in the session catalog,
where SQL and BI clients find them as `MARTS.fact_trip` and so on.

A table can also consist of parts that become current one by one, such as the
days of the fact or the batches of a load. A part is a table of its own to the
log, named `fact_trip/pickup_date=2016-03-01`, so any number of parts of any
tables take effect together. Readers see the part's value as a column, and Spark
leaves out the parts that a filter on it excludes.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW, STAGING, MARTS, QUARANTINE, CONTROL, AUDIT = "raw", "staging", "marts", "quarantine", "control", "audit_logs"
DEFAULT_LAYER = "public"

_VERSIONS = "table_versions"
_VERSION = "version"
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
#: A part that stands for no value of the rows is one of this column, which readers do not see.
PART = "part"
_DROPPED = "dropped_versions"
_MERGED, _MERGES = "_merged", "_merges"
_DROPPED_SCHEMA = T.StructType([T.StructField("location", T.StringType())])
_WRITES_AT_ONCE = 4
_VERSION_SCHEMA = T.StructType(
    [
        T.StructField("schema_name", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("published_at", T.TimestampType()),
    ]
)


def schema_name(layer: str | None) -> str:
    """Schema of a layer: its name, or the default layer's, in upper case."""
    return (layer or DEFAULT_LAYER).upper()


def part_name(table: str, value: str, column: str = PART) -> str:
    """Name of one part of a table whose parts become current one by one."""
    return f"{table}/{column}={value}"


def _struct(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _table_of(name: str) -> str:
    return name.partition("/")[0]


_MERGE_SCHEMA = T.StructType(
    [
        T.StructField("location", T.StringType()),
        T.StructField("files", T.ArrayType(T.StringType())),
        T.StructField("merged_at", T.TimestampType()),
    ]
)


class NotPublished(LookupError):
    """The table has no current version."""


class Warehouse:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def folder(self, layer: str | None, table: str) -> str:
        return f"{self.root}/{schema_name(layer)}/{table}"

    # Logs: small tables that only grow.

    def append(self, layer: str, table: str, rows: list[tuple], schema: T.StructType | str) -> None:
        one_file = self.spark.createDataFrame(rows, schema).coalesce(1)
        one_file.write.mode("append").parquet(self.folder(layer, table))

    def read_log(self, layer: str, table: str, schema: T.StructType | str) -> DataFrame:
        """The rows of a log; an empty table before the first one.

        Files that a merge has taken up are left out, and the merged rows are read for them.
        """
        schema = _struct(schema)
        merge = self._newest_merge(layer, table)
        rows = self._read_files(self.folder(layer, table), schema)
        if merge is None:
            return self.spark.createDataFrame([], schema) if rows is None else rows
        merged = self.spark.read.schema(schema).parquet(merge.location)
        if rows is None:
            return merged
        later = rows.filter(~F.col("_metadata.file_name").isin(merge.files)) if merge.files else rows
        return merged.unionByName(later.select(*schema.names))

    def _read_files(self, folder: str, schema: T.StructType) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(folder)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _newest_merge(self, layer: str, table: str):
        merges = self._read_files(self.folder(layer, table + _MERGES), _MERGE_SCHEMA)
        return None if merges is None else merges.orderBy(F.desc("merged_at")).first()

    def merge_log(self, layer: str, table: str, schema: T.StructType | str, most: int = 100) -> int:
        """Takes the files of a log up in one if there are more than `most`; deletes them. Returns how many.

        The merged rows count from the moment at which the list of the files that
        they stand for is written, and these files no longer do. Rows that are
        added meanwhile are in no list and stay. A merge that fails before that
        changes nothing; one that fails after it leaves files that are not read.
        """
        schema = _struct(schema)
        before = self._newest_merge(layer, table)
        rows = self._read_files(self.folder(layer, table), schema)
        if rows is None:
            return 0
        paths = {path.rpartition("/")[2]: path for path in rows.inputFiles()}
        known = set(before.files) if before else set()
        files = sorted(set(paths) - known)
        if len(files) <= most:
            return 0
        fresh = self.spark.read.schema(schema).parquet(*(paths[name] for name in files))
        if before:
            fresh = self.spark.read.schema(schema).parquet(before.location).unionByName(fresh)
        location = f"{self.folder(layer, table + _MERGED)}/{_VERSION}={uuid.uuid4().hex}"
        fresh.coalesce(1).write.parquet(location)
        # The next list need not name files that are deleted by then.
        named = [name for name in sorted(paths) if name in known] + files
        self.append(layer, table + _MERGES, [(location, named, datetime.now(timezone.utc))], _MERGE_SCHEMA)
        self._delete([paths[name] for name in named] + ([before.location] if before else []))
        return len(files)

    def _delete(self, locations: list[str]) -> int:
        jvm, configuration = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        deleted = 0
        for location in locations:
            path = jvm.org.apache.hadoop.fs.Path(location)
            deleted += path.getFileSystem(configuration).delete(path, True)
        return deleted

    # Versioned tables.

    def write(
        self, layer: str, table: str, rows: DataFrame, by: str | None = None, counts: dict[str, Column] | None = None, seen: Observation | None = None
    ) -> str:
        """Writes a version that is not current yet, in folders by a column if one is given. Returns its folder.

        Spark gathers the rows of each value of `by` and cuts large ones, so a
        value has few files however many tasks its rows come from. `counts` are
        taken as the rows are written, and left in `seen`.
        """
        location = f"{self.folder(layer, table)}/{_VERSION}={uuid.uuid4().hex}"
        if by is not None:
            rows = rows.hint("rebalance", by)
        if seen is not None:
            rows = rows.observe(seen, *(count.alias(alias) for alias, count in counts.items()))
        writer = rows.write if by is None else rows.write.partitionBy(by)
        writer.parquet(location)
        return location

    def parts_in(self, layer: str, table: str, location: str, by: str) -> dict[tuple[str, str], str]:
        """The parts that a version written by a column holds, by layer and name: one per value, so they are few.

        A version without rows has none, and no file either.
        """
        try:
            values = self.spark.read.parquet(location).select(F.col(by).cast("string")).distinct().collect()
        except AnalysisException as error:
            if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            return {}
        names = [_NO_VALUE if value is None else value for (value,) in values]
        return {(layer, part_name(table, value, by)): f"{location}/{by}={value}" for value in names}

    def publish(self, layer: str, tables: dict[str, DataFrame], also: dict[str, str] | None = None) -> dict[str, int]:
        """Writes new versions of tables and makes them current together, once all are written.

        `also` names folders that are written already and become current with
        them. Returns the rows of each table, counted while they are written.
        """
        return {name: found["rows"] for name, found in self.publish_observed(layer, tables, also).items()}

    def publish_observed(
        self,
        layer: str,
        tables: dict[str, DataFrame],
        also: dict[str, str] | None = None,
        wanted: dict[str, dict[str, Column]] | None = None,
        by: dict[str, str] | None = None,
    ) -> dict[str, dict[str, int | str]]:
        """The same with further counts per table, taken from the rows as they are written.

        `by` gives the column by whose values a table is cut into parts. Returns
        by table `rows`, `location` and the counts of `wanted`. The tables are
        written side by side, so that the last tasks of one do not leave the
        cluster idle.
        """
        by = by or {}

        def write(name: str) -> dict[str, int | str]:
            observation = Observation()
            counts = {"rows": F.count(F.lit(1))} | (wanted or {}).get(name, {})
            location = self.write(layer, name, tables[name], by.get(name), counts, observation)
            return observation.get | {"location": location}

        with ThreadPoolExecutor(_WRITES_AT_ONCE) as pool:
            written = dict(zip(tables, pool.map(write, tables)))
        # What a table consisted of before, whole or in parts, is current no more.
        current = {(layer, name): None for name in self._current(layer) if _table_of(name) in tables}
        for name, found in written.items():
            parts = self.parts_in(layer, name, found["location"], by[name]) if name in by else {}
            # A table without parts is an empty one as a whole, so that it has its columns.
            whole = self.write(layer, name, tables[name].limit(0)) if name in by and not parts else found["location"]
            current |= parts or {(layer, name): whole}
        self.point_to_all(current | {(layer, name): location for name, location in (also or {}).items()})
        return written

    def point_to(self, layer: str, locations: dict[str, str]) -> None:
        """Makes versions current. All rows go into one file, so they take effect at once."""
        self.point_to_all({(layer, table): location for table, location in locations.items()})

    def point_to_all(self, locations: dict[tuple[str, str], str | None]) -> None:
        """The same for tables and parts of several layers, given as (layer, name); one without a folder is current no more."""
        now = datetime.now(timezone.utc)
        rows = [(schema_name(layer), table, location, now) for (layer, table), location in locations.items()]
        self.append(CONTROL, _VERSIONS, rows, _VERSION_SCHEMA)

    def current_locations(self) -> DataFrame:
        versions = self.read_log(CONTROL, _VERSIONS, _VERSION_SCHEMA)
        newest = F.max_by(F.struct("location"), "published_at").alias("newest")
        found = versions.groupBy("schema_name", "table_name").agg(newest)
        return found.select("schema_name", "table_name", "newest.location").filter(F.col("location").isNotNull())

    def _current(self, layer: str) -> dict[str, str]:
        """Folders of all current tables and parts of a layer by name, found with one look at the control layer."""
        found = self.current_locations().filter(F.col("schema_name") == schema_name(layer))
        return {row.table_name: row.location for row in found.collect()}

    def locations(self, layer: str, *tables: str) -> list[str]:
        """Folders of the current versions of tables of one layer that are not in parts."""
        current = self._current(layer)
        missing = [table for table in tables if table not in current]
        if missing:
            raise NotPublished(f"{schema_name(layer)}: {', '.join(missing)}")
        return [current[table] for table in tables]

    def names(self, layer: str, tables: list[str]) -> list[str]:
        """Names under which tables of a layer are current, their parts' included."""
        return [name for name in self._current(layer) if _table_of(name) in tables]

    def all_parts(self, layers: list[str]) -> dict[tuple[str, str], dict[str, str]]:
        """Folders of the parts of all tables of some layers: by layer and table, then by value."""
        found: dict[tuple[str, str], dict[str, str]] = {}
        for layer in layers:
            for name, location in self._current(layer).items():
                table, _, value = name.partition("/")
                if value:
                    found.setdefault((layer, table), {})[value.partition("=")[2]] = location
        return found

    def parts(self, layer: str, table: str) -> dict[str, str]:
        """Folders of the current parts of a table, by value."""
        return self._parts(table, self._current(layer))

    @staticmethod
    def _parts(table: str, current: dict[str, str]) -> dict[str, str]:
        named = {name.partition("=")[2]: location for name, location in current.items() if name.startswith(f"{table}/")}
        return dict(sorted(named.items()))

    def read(self, layer: str, *tables: str) -> list[DataFrame]:
        """Current versions of tables of one layer, whole or in parts; all are those of one moment."""
        current = self._current(layer)
        missing = [table for table in tables if table not in current and not self._parts(table, current)]
        if missing:
            raise NotPublished(f"{schema_name(layer)}: {', '.join(missing)}")
        return [
            self.spark.read.parquet(current[table])
            if table in current
            else self.read_folders(layer, table, list(self._parts(table, current).values()))
            for table in tables
        ]

    def read_one(self, layer: str, table: str) -> DataFrame:
        return self.read(layer, table)[0]

    def read_folders(self, layer: str, table: str, folders: list[str], schema: T.StructType | None = None) -> DataFrame:
        """The given parts of a table as one; in the columns of the schema if one is given, and empty without parts."""
        if not folders:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.option("basePath", self.folder(layer, table))
        if schema is None:
            return reader.parquet(*folders).drop(_VERSION, PART)
        return reader.schema(schema).parquet(*folders).select(*schema.names)

    def read_parts(self, layer: str, table: str, schema: T.StructType) -> DataFrame:
        """All current parts of a table as one, in the columns of the schema; an empty table before the first part."""
        return self.read_folders(layer, table, list(self.parts(layer, table).values()), schema)

    def register(self) -> None:
        """Points the catalog's tables at the current versions. One row per table or part, so the loop is short.

        A table in parts becomes one with as many partitions, each with its own folder.
        """
        tables: dict[tuple[str, str], dict[str, str]] = {}
        for row in self.current_locations().collect():
            tables.setdefault((row.schema_name, _table_of(row.table_name)), {})[row.table_name] = row.location
        for (schema, table), found in tables.items():
            self.spark.sql(f"create database if not exists {schema}")
            if table in found:
                self._register_whole(f"{schema}.{table}", found[table])
            else:
                self._register_parts(schema, table, found)

    def _register_whole(self, name: str, location: str) -> None:
        known = self.spark.catalog.tableExists(name)
        if known and not any(column.isPartition for column in self.spark.catalog.listColumns(name)):
            self.spark.sql(f"alter table {name} set location '{location}'")
            self.spark.catalog.refreshTable(name)
        else:
            self.spark.sql(f"drop table if exists {name}")
            self.spark.catalog.createTable(name, path=location, source="parquet")

    def _register_parts(self, schema: str, table: str, found: dict[str, str]) -> None:
        name = f"{schema}.{table}"
        column = next(iter(found)).partition("/")[2].partition("=")[0]
        folders = {part.partition("=")[2]: location for part, location in found.items()}
        rows = self.spark.read.option("basePath", f"{self.root}/{schema}/{table}").parquet(*folders.values()).drop(_VERSION)
        kinds = {field.name: field.dataType.simpleString() for field in rows.schema}
        # The value of a part that stands for no value of the rows may be in no path.
        columns = ", ".join(f"{field} {kind}" for field, kind in ({column: "string"} | kinds).items())
        self.spark.sql(f"drop table if exists {name}")
        self.spark.sql(
            f"create table {name} ({columns}) using parquet partitioned by ({column}) location '{self.root}/{schema}/{table}'"
        )
        specs = " ".join(f"partition ({column}='{value}') location '{location}'" for value, location in folders.items())
        self.spark.sql(f"alter table {name} add {specs}")

    def merge_logs(self, most: int = 100) -> int:
        """Merges the warehouse's own logs."""
        logs = {_VERSIONS: _VERSION_SCHEMA, _DROPPED: _DROPPED_SCHEMA}
        return sum(self.merge_log(CONTROL, name, schema, most) for name, schema in logs.items())

    def drop_old_versions(self, keep: int = 2) -> int:
        """Deletes the folders of all but the newest versions of each table. Returns how many were deleted.

        Keep at least two, so that a query which has started on the last
        version can end. A folder that two tables share stays while one of them
        needs it. Deleted folders are logged and not looked at again.
        """
        newest_first = Window.partitionBy("schema_name", "table_name").orderBy(F.col("published_at").desc())
        versions = self.read_log(CONTROL, _VERSIONS, _VERSION_SCHEMA)
        aged = versions.withColumn("age", F.row_number().over(newest_first))
        old = aged.groupBy("location").agg(F.min("age").alias("age")).filter((F.col("age") > keep) & F.col("location").isNotNull())
        old = old.join(self.read_log(CONTROL, _DROPPED, _DROPPED_SCHEMA), "location", "left_anti")
        dropped = [row.location for row in old.collect()]
        deleted = self._delete(dropped)
        if dropped:
            self.append(CONTROL, _DROPPED, [(location,) for location in dropped], _DROPPED_SCHEMA)
        return deleted
