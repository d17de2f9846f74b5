"""Session settings and lineage cutting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. Shuffle width is left to AQE: the initial number is
# only the finest split, small stages are coalesced and skewed ones are split.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Plans here are wide; recording a Python call site for every column doubles the time to build one.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "tidewatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; keyword settings use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Rows of a batch that goes to Python where rows hold whole texts: with some kilobytes a row a few megabytes.
TEXT_BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lets batches of rows for Python hold no more than TEXT_BATCH_ROWS, if the session allows more.

    A worker holds a batch several times over (as Arrow, as strings, as results), and so does its executor.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_BATCH_ROWS:
        spark.conf.set(name, str(TEXT_BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Where the setting is absent a local temporary folder is used, but only for a
    local master: on a cluster that folder would be lost together with its executor. It goes
    when the driver's Python ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    chosen = tempfile.mkdtemp(prefix="tidewatch-")
    atexit.register(shutil.rmtree, chosen, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", chosen)
    return chosen


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor does not repeat its inputs."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
