"""A store of datapoints for reads of the last minutes: a folder a day, sorted by resource within.

A lookback of 10 or 60 minutes touches the files of one day, or two around midnight, however many days are kept; a
question for one resource skips the row groups of others by their bounds.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import metrics
from tidewatch.sources import files


def write_datapoints(points: DataFrame, path: str, key: str = "resource_id", ts: str = "ts", mode: str = "append") -> None:
    """Adds datapoints. A day is spread over tasks by resource and time, so a busy day or resource is not one file."""
    dated = points.withColumn("date", F.to_date(ts))
    sorted_ = dated.repartitionByRange("date", key, ts).sortWithinPartitions("date", key, ts)
    sorted_.write.mode(mode).partitionBy("date").parquet(path)


def read_window(spark: SparkSession, path: str, as_of: dt.datetime, minutes: int, resource_id=None, key: str = "resource_id", ts: str = "ts") -> DataFrame:
    """Datapoints of ``[as_of - minutes, as_of]``; days outside are pruned by their folder. ``as_of`` is UTC."""
    start = as_of - dt.timedelta(minutes=minutes)
    days = spark.read.parquet(path).where(F.col("date").between(F.lit(start.date()), F.lit(as_of.date())))
    rows = days if resource_id is None else days.where(F.col(key) == resource_id)
    return metrics.lookback(rows, as_of, minutes, ts).drop("date")


def newest(spark: SparkSession, path: str, ts: str = "ts") -> dt.datetime | None:
    """The newest time stored, from the newest day alone."""
    days = [n for n in files.names(spark, path) if n.startswith("date=2") or n.startswith("date=1")]
    return spark.read.parquet(f"{path}/{days[-1]}").agg(F.max(ts)).first()[0] if days else None
