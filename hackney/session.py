"""Session settings and the folder that all machines of a cluster share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings of a session that is built here. The results are the same without them.
SETTINGS = {
    # Partitions follow the data at run time: small ones are merged, heavy ones split.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A projection of many parsed columns generates methods the JVM will not
    # compile; beyond its limit of 8000 bytes Spark should cut the code up.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Times are without zone throughout; a fixed zone keeps the load time in UTC.
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str | None = None, name: str = "hackney", **settings: str) -> SparkSession:
    """A session with the engine's settings. On a cluster the launcher gives master, memory and partitions.

    Shuffles start with `spark.sql.adaptive.coalescePartitions.initialPartitionNum`
    partitions, which should be the raw table's size by 128 MB; Spark merges those
    that turn out small and splits heavy ones of a join.
    """
    # Recording the place in the program of every column operation takes longer
    # than building the plan; switch it on to search for the source of an error.
    builder = SparkSession.builder.appName(name).config("spark.python.sql.dataFrameDebugging.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new folder that every executor can reach, under `spark.checkpoint.dir`; it goes when the application ends.

    Without that setting a folder of this machine serves, but only where all
    work runs on this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    folder = os.path.join(base, f"hackney-{uuid.uuid4().hex}")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder
