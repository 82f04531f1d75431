"""Load bookmarks and the audit log of runs.

Both are logs: a bookmark is moved by adding a row, and the newest row of a
source counts. Spark's plain tables have no update, and a log keeps the past.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hackney.plans.warehouse import AUDIT, CONTROL, Warehouse
from hackney.schemas import AUDIT_SCHEMA, BOOKMARK_SCHEMA

log = logging.getLogger(__name__)

WATERMARKS = "watermarks"
PIPELINE_RUNS = "pipeline_runs"

FAILED, SKIPPED, SUCCESS = "FAILED", "SKIPPED", "SUCCESS"


@dataclass(frozen=True)
class Bookmark:
    last_processed_row: int = 0
    total_rows_loaded: int = 0


def now() -> datetime:
    return datetime.now(timezone.utc)


def read_bookmark(warehouse: Warehouse, source_name: str, before_file: str | None = None) -> Bookmark:
    """Newest bookmark of a source, (0, 0) without one. Rows of `before_file` are left out if it is given."""
    rows = warehouse.read_log(CONTROL, WATERMARKS, BOOKMARK_SCHEMA).filter(F.col("source_name") == source_name)
    if before_file is not None:
        rows = rows.filter(F.col("last_processed_file") != before_file)
    state = F.struct("last_processed_row", "total_rows_loaded")
    newest = rows.agg(F.max_by(state, "updated_at").alias("state")).first().state
    return Bookmark(*newest) if newest else Bookmark()


def move_bookmark(
    warehouse: Warehouse,
    source_name: str,
    last_processed_row: int,
    total_rows_loaded: int,
    source_file: str,
    status: str = SUCCESS,
) -> None:
    row = (source_name, last_processed_row, total_rows_loaded, source_file, status, now())
    warehouse.append(CONTROL, WATERMARKS, [row], BOOKMARK_SCHEMA)


@dataclass
class Run:
    """One run of a load, as it goes into the audit log."""

    run_id: str
    started: datetime
    rows_extracted: int = 0
    rows_loaded: int = 0
    rows_rejected: int = 0
    status: str = FAILED
    failure_reason: str | None = None


def log_run(warehouse: Warehouse, run: Run) -> None:
    row = (
        run.run_id,
        run.started,
        now(),
        run.rows_extracted,
        run.rows_loaded,
        run.rows_rejected,
        run.status,
        run.failure_reason,
    )
    warehouse.append(AUDIT, PIPELINE_RUNS, [row], AUDIT_SCHEMA)


def _log_quietly(warehouse: Warehouse, run: Run) -> None:
    try:
        log_run(warehouse, run)
    except Exception:
        log.exception("audit log not written, run_id=%s", run.run_id)


@contextmanager
def failure_recorded(warehouse: Warehouse, run: Run) -> Iterator[None]:
    """Leaves a failed row in the audit log if the work raises, and nothing else."""
    try:
        yield
    except Exception as error:
        run.status, run.failure_reason, run.rows_loaded = FAILED, str(error), 0
        _log_quietly(warehouse, run)
        raise


@contextmanager
def recorded(warehouse: Warehouse, run: Run) -> Iterator[None]:
    """Leaves a row in the audit log however the work ends. A log that cannot be written does not hide how it ended."""
    with failure_recorded(warehouse, run):
        yield
    _log_quietly(warehouse, run)


def read_runs(warehouse: Warehouse) -> DataFrame:
    return warehouse.read_log(AUDIT, PIPELINE_RUNS, AUDIT_SCHEMA)


def merge_logs(warehouse: Warehouse, most: int = 100) -> int:
    """Merges the files of bookmarks, audit log and versions where a log has many. Returns how many were taken up."""
    found = warehouse.merge_log(CONTROL, WATERMARKS, BOOKMARK_SCHEMA, most)
    found += warehouse.merge_log(AUDIT, PIPELINE_RUNS, AUDIT_SCHEMA, most)
    return found + warehouse.merge_logs(most)
