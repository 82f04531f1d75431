"""Loading of only those files that no earlier run has loaded.

A file stream remembers in its checkpoint which files it has read. Each call
takes what has arrived since the last one in batches and ends.

A batch is written to a folder of its own, then its bookmark and audit row are
written, and last its folders are made current, by one row in the log of
versions. Readers follow that log, so they see the trips of a batch, and its bad
lines, all at once and only when it is recorded. A batch that is repeated after
a failure makes another folder current in place of the first, so no row is
loaded twice. A batch's name has the checkpoint's own id, so a new checkpoint,
which counts its batches from 0 again, takes the place of none.

Every batch leaves a row in the audit log, also one that fails; a call that finds
no new file leaves a skipped one. A batch without a usable line is a failed run
too, but not the stream's end: its lines are set apart and the next batch follows.
The header of the first file is kept with the checkpoint; files with another one
are set apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hackney.plans import control
from hackney.plans.warehouse import CONTROL, QUARANTINE, RAW, Warehouse, part_name
from hackney.schemas import RAW_SCHEMA
from hackney.sources.trip_files import (
    BAD_LINE_SCHEMA,
    READ_OPTIONS,
    READ_SCHEMA,
    bad_lines,
    files_with_another_header,
    good_lines,
    header_of,
    line_counts,
    set_apart,
    with_header_mark,
    with_lineage,
)

SOURCE_NAME = "trip_files"
NEW_TRIPS = "trips_from_files"
NEW_BAD_LINES = "bad_lines_from_files"


def _kept(spark: SparkSession, place: str, make: Callable[[], list[str]]) -> list[str]:
    """Texts that are made once and kept with the checkpoint, in order."""
    schema = "place int, value string"
    try:
        return [row.value for row in spark.read.schema(schema).json(place).orderBy("place").collect()]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        made = make()
        spark.createDataFrame(list(enumerate(made)), schema).coalesce(1).write.json(place)
        return made


def _batch_name(stream: str, number: int) -> str:
    return f"files-{stream}-{number:08d}"


def _load_batch(warehouse: Warehouse, lines: DataFrame, batch_id: str, run_id: str) -> None:
    run = control.Run(run_id=run_id, started=control.now())
    with control.recorded(warehouse, run):
        written = _write_batch(warehouse, lines, batch_id, run)
        before = control.read_bookmark(warehouse, SOURCE_NAME, before_file=batch_id)
        loaded = before.total_rows_loaded + run.rows_loaded
        control.move_bookmark(warehouse, SOURCE_NAME, loaded, loaded, batch_id)
        if run.rows_rejected and not run.rows_loaded:
            run.failure_reason = f"all {run.rows_rejected} lines of batch {batch_id} have a wrong number of cells"
        else:
            run.status = control.SUCCESS
    with control.failure_recorded(warehouse, run):
        warehouse.point_to_all(written)


def _write_batch(warehouse: Warehouse, lines: DataFrame, batch_id: str, run: control.Run) -> dict[tuple[str, str], str]:
    """Writes what a batch holds where no reader looks yet. Returns the folder of each part by layer and name.

    Where there are not as many headers as files, the files are looked at one by
    one, and those with another header are set apart as a whole.
    """
    lines = lines.withColumn("batch_id", F.lit(batch_id))
    trips, rejects = part_name(NEW_TRIPS, batch_id), part_name(NEW_BAD_LINES, batch_id)

    def write_trips(found: DataFrame) -> tuple[str, dict[str, int]]:
        observation = Observation()
        counted = found.observe(observation, *(count.alias(name) for name, count in line_counts().items()))
        return warehouse.write(RAW, trips, good_lines(counted)), observation.get

    folder, counts = write_trips(lines)
    files = warehouse.spark.read.parquet(folder).select("source_file").distinct().count()
    if counts["headers"] != files and (others := files_with_another_header(lines)):
        lines = set_apart(lines, others)
        folder, counts = write_trips(lines)
    run.rows_extracted, run.rows_rejected = counts["extracted"], counts["rejected"]
    run.rows_loaded = run.rows_extracted - run.rows_rejected
    written = {(RAW, trips): folder} if run.rows_loaded else {}
    if run.rows_rejected:
        written[QUARANTINE, rejects] = warehouse.write(QUARANTINE, rejects, bad_lines(lines))
    return written


def load_new_files(warehouse: Warehouse, folder: str, files_per_batch: int = 1000) -> None:
    """Loads the files that have come into `folder` since the last call."""
    spark, run_id = warehouse.spark, str(uuid.uuid4())
    lines = (
        spark.readStream.schema(READ_SCHEMA)
        .options(**READ_OPTIONS)
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(folder)
    )
    checkpoint = warehouse.folder(CONTROL, f"checkpoint_{NEW_TRIPS}")
    stream, seen = _kept(spark, f"{checkpoint}/hackney_stream_id", lambda: [uuid.uuid4().hex[:12]])[0], []
    try:
        header = _kept(spark, f"{checkpoint}/hackney_header", lambda: header_of(spark, folder))
    except AnalysisException as error:  # no file yet
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        control.log_run(warehouse, control.Run(run_id=run_id, started=control.now(), status=control.SKIPPED))
        return

    def load(batch: DataFrame, number: int) -> None:
        seen.append(number)
        _load_batch(warehouse, batch, _batch_name(stream, number), run_id)

    query = (
        with_lineage(with_header_mark(lines, header), run_id, batch_id="")
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not seen:
        control.log_run(warehouse, control.Run(run_id=run_id, started=control.now(), status=control.SKIPPED))


def read_new_trips(warehouse: Warehouse) -> DataFrame:
    """All trips of recorded batches, as a raw table; none before the first."""
    return warehouse.read_parts(RAW, NEW_TRIPS, RAW_SCHEMA)


def read_new_bad_lines(warehouse: Warehouse) -> DataFrame:
    """All lines that recorded batches have set apart."""
    return warehouse.read_parts(QUARANTINE, NEW_BAD_LINES, BAD_LINE_SCHEMA)
