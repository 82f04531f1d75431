"""Trip files: CSV with a header and 19 columns, every cell read as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hackney.schemas import MISSING_TOKENS, RAW_COLUMNS, RAW_SCHEMA, SOURCE_COLUMNS, SOURCE_SCHEMA

BAD_LINE = "bad_line"
IS_HEADER = "is_header"
FILE_PATH = "file_path"

# Columns are taken by position. Headers are read as lines, so that each file's
# can be compared with the first file's. A quote within quotes is written twice,
# as usual in CSV.
READ_OPTIONS = {
    "header": "false",
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": BAD_LINE,
    "quote": '"',
    "escape": '"',
    # All cells of a line are parsed even when few columns are asked for, since
    # only then is a wrong number of cells noticed.
    "columnPruning": "false",
}
READ_SCHEMA = T.StructType(SOURCE_SCHEMA.fields + [T.StructField(BAD_LINE, T.StringType())])
BAD_LINE_SCHEMA = T.StructType(RAW_SCHEMA.fields + [T.StructField(BAD_LINE, T.StringType())])


class WrongColumnCount(ValueError):
    """The header of the source does not have 19 columns."""


class WrongHeader(ValueError):
    """A file's header is not that of the first file."""


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The cells of the first line of the first file by name. Raises unless there are 19.

    Lines of other files with another number of cells are found by the read
    itself and set apart by `bad_lines`.
    """
    reader = spark.read.options(header="false", quote='"', escape='"')
    first = reader.csv(min(reader.csv(path).inputFiles())).first()
    found = 0 if first is None else len(first)
    if found != len(SOURCE_COLUMNS):
        raise WrongColumnCount(f"{path} has {found} columns, expected {len(SOURCE_COLUMNS)}")
    return list(first)


def _name(cell: Column) -> Column:
    return F.lower(F.trim(F.coalesce(cell, F.lit(""))))


def with_header_mark(lines: DataFrame, header: list[str]) -> DataFrame:
    """Marks lines at the beginning of a file that say the same as the header, case and blanks aside."""
    is_header = F.col("_metadata.file_block_start") == 0
    for column, cell in zip(SOURCE_COLUMNS, header, strict=True):
        is_header &= _name(F.col(column)) == _name(F.lit(cell).cast("string"))
    return lines.select("*", is_header.alias(IS_HEADER), F.col("_metadata.file_path").alias(FILE_PATH), F.col("_metadata.file_name").alias("_file"))


def files_with_another_header(lines: DataFrame) -> list[str]:
    """Paths of the files that do not begin with the header."""
    files = lines.groupBy(FILE_PATH).agg(F.max(IS_HEADER).alias("same")).filter("not same")
    return sorted(row[FILE_PATH] for row in files.collect())


def set_apart(lines: DataFrame, files: list[str]) -> DataFrame:
    """Makes every line of some files a bad one."""
    reason = F.when(F.col(FILE_PATH).isin(files), F.lit("the file has another header"))
    return lines.withColumn(BAD_LINE, F.coalesce(BAD_LINE, reason))


def _present(name: str) -> Column:
    return F.when(~F.col(name).isin(MISSING_TOKENS), F.col(name)).alias(name)


def with_lineage(lines: DataFrame, pipeline_run_id: str, batch_id: str) -> DataFrame:
    """Adds a random id per row, the batch and run, the file the row is from and the time of the load."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return lines.select(
        F.expr("uuid()").alias("raw_id"),
        F.lit(batch_id).alias("batch_id"),
        F.lit(pipeline_run_id).alias("pipeline_run_id"),
        F.col("_file").alias("source_file"),
        now.cast("timestamp_ntz").alias("ingestion_timestamp"),
        *(_present(name) for name in SOURCE_COLUMNS),
        BAD_LINE,
        IS_HEADER,
        FILE_PATH,
    )


def read_trip_files(spark: SparkSession, path: str, pipeline_run_id: str, batch_id: str) -> DataFrame:
    """Every line of the files with lineage; `bad_line` holds the text of a line with a wrong number of cells."""
    header = header_of(spark, path)
    lines = spark.read.schema(READ_SCHEMA).options(**READ_OPTIONS).csv(path)
    return with_lineage(with_header_mark(lines, header), pipeline_run_id, batch_id)


def line_counts() -> dict[str, Column]:
    """Lines that are no header, bad ones among them, and headers, as aggregates."""
    is_line = ~F.col(IS_HEADER)
    return {
        "extracted": F.count_if(is_line),
        "rejected": F.count_if(is_line & F.col(BAD_LINE).isNotNull()),
        "headers": F.count_if(F.col(IS_HEADER)),
    }


def good_lines(lines: DataFrame) -> DataFrame:
    """Raw trips in table order."""
    return lines.filter(F.col(BAD_LINE).isNull() & ~F.col(IS_HEADER)).select(*RAW_COLUMNS)


def bad_lines(lines: DataFrame) -> DataFrame:
    """Lines that are no trip, as they stand in the file and as far as they could be read."""
    return lines.filter(F.col(BAD_LINE).isNotNull() & ~F.col(IS_HEADER)).select(*RAW_COLUMNS, BAD_LINE)
