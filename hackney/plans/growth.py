"""Marts that grow with the batches of new files, without a look at the old trips.

A run takes the batches that no run has staged yet. It

- types their trips, and keeps them by batch,
- adds their valid trips to the days of the fact that they fall on: these days
  are written anew, with few files each, and all others stay as they are,
- adds the keys that a dimension does not have,
- groups the trips into cells by day and merges them with the cells of these days,
- sets the trips aside that are not valid.

All of it takes effect at once, by one row per part in the log of versions. A run
that fails before that leaves nothing, and the next one does its work. What comes
out equals a full build over all batches.

Dimensions and quarantine get one part per run; after `MOST_PARTS` of them a
table is written anew as one.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hackney.operators import metrics, quality, trips
from hackney.operators.staging import typed_trips
from hackney.operators.trips import PICKUP_DATE
from hackney.plans.model import Model
from hackney.plans.warehouse import MARTS, QUARANTINE, RAW, STAGING, Warehouse, part_name
from hackney.schemas import RAW_SCHEMA
from hackney.streaming.new_files import NEW_TRIPS

STAGED_TRIPS = "stg_trips"
METRICS = "metrics"
REJECTED = "trips"
#: Dimensions that have a row per key of the trips, and those of the lookups, which do not change.
GROWING = ["dim_datetime", "dim_location"]
FIXED = ["dim_vendor", "dim_rate_code", "dim_payment_type"]
CELLS = ["hourly_cells", "place_cells", "route_cells", "efficiency_moments"]
MOST_PARTS = 50
_BATCH = "batch_id"
_WRITES_AT_ONCE = 4


class _Growth:
    """The tables of one run: what is there, and what is written but not current yet."""

    def __init__(self, warehouse: Warehouse):
        self.warehouse = warehouse
        self.run = uuid.uuid4().hex
        self.known = warehouse.all_parts([STAGING, MARTS, QUARANTINE, METRICS])
        self.staged = self.known.get((STAGING, STAGED_TRIPS), {})
        # Marts of a full build do not know which batches they hold, so the first run makes all tables anew.
        if not self.staged:
            self.known = {}
        self.whole = {(layer, name) for layer in (MARTS, METRICS) for name in warehouse.names(layer, ["fact_trip", *CELLS])}
        self.written: dict[tuple[str, str], str | None] = {}

    def parts(self, layer: str, table: str) -> dict[str, str]:
        return self.known.get((layer, table), {})

    def read(self, layer: str, table: str, values: list[str] | None = None) -> DataFrame | None:
        """The current rows of some parts, or of all; none if there is no such part."""
        folders = [folder for value, folder in self.parts(layer, table).items() if values is None or value in values]
        return self.warehouse.read_folders(layer, table, folders) if folders else None

    def replace_days(self, layer: str, table: str, rows: DataFrame) -> None:
        """Writes the days that the rows fall on in place of those there are. A table without a day is an empty one."""
        location = self.warehouse.write(layer, table, rows, by=PICKUP_DATE)
        parts = self.warehouse.parts_in(layer, table, location, PICKUP_DATE)
        if not parts and not self.parts(layer, table):
            parts = {(layer, table): self.warehouse.write(layer, table, rows.limit(0))}
        elif (layer, table) in self.whole:
            parts[layer, table] = None
        self.written |= parts

    def append(self, layer: str, table: str, rows: DataFrame) -> None:
        """Adds a part of this run, or writes the table anew as one where it has many."""
        known = self.parts(layer, table)
        if len(known) >= MOST_PARTS:
            rows = self.read(layer, table).unionByName(rows)
            self.written |= {(layer, part_name(table, value)): None for value in known}
        self.written[layer, part_name(table, self.run)] = self.warehouse.write(layer, table, rows)


def new_batches(warehouse: Warehouse) -> dict[str, str]:
    """Folders of the recorded batches that no run has staged, by batch."""
    staged = warehouse.parts(STAGING, STAGED_TRIPS)
    return {batch: folder for batch, folder in warehouse.parts(RAW, NEW_TRIPS).items() if batch not in staged}


def new_keys(rows: DataFrame, published: DataFrame | None, key: str) -> DataFrame:
    """The rows whose key the published dimension does not have; of that, only the key is read. A missing key is a key, too."""
    if published is None:
        return rows
    known = published.select(F.col(key).alias("_known"))
    return rows.join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti")


def grow(warehouse: Warehouse) -> int:
    """Adds all new batches to the marts and cells. Returns the number of batches."""
    fresh = new_batches(warehouse)
    if not fresh:
        return 0
    growth = _Growth(warehouse)
    raw = warehouse.read_folders(RAW, NEW_TRIPS, list(fresh.values()), RAW_SCHEMA)
    location = warehouse.write(STAGING, STAGED_TRIPS, typed_trips(raw), by=_BATCH)
    growth.written |= warehouse.parts_in(STAGING, STAGED_TRIPS, location, _BATCH)
    model = Model(warehouse.spark, written=warehouse.spark.read.parquet(location))

    fact = trips.with_pickup_date(model.fact_trip)
    located = trips.with_pickup_date(metrics.located_trips(model.valid_trips))
    days = [str(row[0]) for row in fact.select(PICKUP_DATE).distinct().collect()]

    def grow_fact() -> None:
        old = growth.read(MARTS, "fact_trip", days)
        growth.replace_days(MARTS, "fact_trip", fact if old is None else old.unionByName(fact))

    def grow_dimension(name: str) -> None:
        rows = new_keys(getattr(model, name), growth.read(MARTS, name), quality.KEYS[name])
        growth.append(MARTS, name, rows)

    def grow_cells(name: str, cells: DataFrame) -> None:
        old = growth.read(METRICS, name, days)
        growth.replace_days(METRICS, name, cells if old is None else metrics.merged_cells(name, old.unionByName(cells), PICKUP_DATE))

    cells = metrics.daily_cells(fact, located, PICKUP_DATE)
    work = [(grow_fact,), *((grow_dimension, name) for name in GROWING), *((grow_cells, name, cells[name]) for name in CELLS)]
    work += [(growth.append, QUARANTINE, REJECTED, model.quarantine_trips)]
    if not growth.parts(MARTS, FIXED[0]):
        work += [(growth.append, MARTS, name, getattr(model, name)) for name in FIXED]
    with ThreadPoolExecutor(_WRITES_AT_ONCE) as pool:
        for done in [pool.submit(*step) for step in work]:
            done.result()
    if not growth.staged:
        growth.written = _of_full_builds(warehouse) | growth.written
    warehouse.point_to_all(growth.written)
    return len(fresh)


def _of_full_builds(warehouse: Warehouse) -> dict[tuple[str, str], None]:
    """The tables and parts that a full build has left, as no longer current."""
    tables = {
        STAGING: [STAGED_TRIPS],
        MARTS: ["fact_trip", *GROWING, *FIXED],
        QUARANTINE: [REJECTED],
        METRICS: CELLS,
    }
    return {(layer, name): None for layer, names in tables.items() for name in warehouse.names(layer, names)}


def publish_metrics(warehouse: Warehouse) -> dict[str, int]:
    """Publishes all metrics from the cells of all days; no trip is read."""
    cells = dict(zip(CELLS, warehouse.read(METRICS, *CELLS)))
    payment_types, rate_codes = warehouse.read(MARTS, "dim_payment_type", "dim_rate_code")
    return warehouse.publish(METRICS, metrics.from_cells(cells, payment_types, rate_codes))
