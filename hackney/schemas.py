"""Table schemas and the fixed values the engine works with."""

from __future__ import annotations

from pyspark.sql import types as T

# The source file holds 19 columns, known by position and not by header name.
SOURCE_COLUMNS = [
    "vendor_id",
    "pickup_datetime",
    "dropoff_datetime",
    "passenger_count",
    "trip_distance",
    "pickup_longitude",
    "pickup_latitude",
    "rate_code_id",
    "store_fwd_flag",
    "dropoff_longitude",
    "dropoff_latitude",
    "payment_type",
    "fare_amount",
    "extra",
    "mta_tax",
    "tip_amount",
    "tolls_amount",
    "improvement_surcharge",
    "total_amount",
]
LINEAGE_COLUMNS = ["raw_id", "batch_id", "pipeline_run_id", "source_file", "ingestion_timestamp"]
RAW_COLUMNS = LINEAGE_COLUMNS + SOURCE_COLUMNS

SOURCE_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in SOURCE_COLUMNS])
RAW_SCHEMA = T.StructType(
    [
        T.StructField(name, T.TimestampNTZType() if name == "ingestion_timestamp" else T.StringType())
        for name in RAW_COLUMNS
    ]
)

BOOKMARK_SCHEMA = T.StructType(
    [
        T.StructField("source_name", T.StringType()),
        T.StructField("last_processed_row", T.LongType()),
        T.StructField("total_rows_loaded", T.LongType()),
        T.StructField("last_processed_file", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("pipeline_run_id", T.StringType()),
        T.StructField("execution_start", T.TimestampType()),
        T.StructField("execution_end", T.TimestampType()),
        T.StructField("rows_extracted", T.LongType()),
        T.StructField("rows_loaded", T.LongType()),
        T.StructField("rows_rejected", T.LongType()),
        T.StructField("execution_status", T.StringType()),
        T.StructField("failure_reason", T.StringType()),
    ]
)

# Cell texts that stand for a missing value in the source file.
MISSING_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# Code lookups of the taxi data dictionary.
VENDORS = {
    "1": "Creative Mobile Technologies (CMT)",
    "2": "VeriFone Inc.",
}
RATE_CODES = {
    "1": "Standard Rate",
    "2": "JFK Airport",
    "3": "Newark Airport",
    "4": "Nassau or Westchester",
    "5": "Negotiated Fare",
    "6": "Group Ride",
}
PAYMENT_TYPES = {
    "1": "Credit Card",
    "2": "Cash",
    "3": "No Charge",
    "4": "Dispute",
    "5": "Unknown",
    "6": "Voided Trip",
}

# Borough boxes (name, south, north, west, east), bounds included.
# The boxes overlap; the first one that holds a point names its borough.
BOROUGH_BOXES = [
    ("Manhattan", 40.70, 40.88, -74.02, -73.93),
    ("Brooklyn", 40.57, 40.74, -74.04, -73.83),
    ("Queens", 40.68, 40.81, -73.93, -73.70),
    ("Bronx", 40.79, 40.92, -73.95, -73.75),
    ("Staten Island", 40.49, 40.65, -74.26, -74.03),
    ("NYC Metro Area", 40.49, 41.10, -74.30, -73.65),
]
NO_BOROUGH = "Outside NYC"

# First and last hour of each part of the day, both included.
DAY_PARTS = [
    ("Morning Rush", 6, 9),
    ("Midday", 10, 15),
    ("Evening Rush", 16, 19),
    ("Night", 20, 23),
]
OTHER_DAY_PART = "Late Night"

# A valid trip lasts longer than 0 and less than 300 minutes.
SHORTEST_MINUTES = 0
LONGEST_MINUTES = 300
