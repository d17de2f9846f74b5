"""Alarm definitions and the threshold join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import columns as C


def parse_alarms(raw: DataFrame) -> DataFrame:
    """Single-metric alarms with a mapped operator; composite ones have no metric and are dropped."""
    dims = F.transform("Dimensions", lambda d: F.struct(d["Name"].alias("name"), d["Value"].alias("value")))
    return raw.filter((F.coalesce("Namespace", F.lit("")) != "") & (F.coalesce("MetricName", F.lit("")) != "")).select(
        F.col("AlarmName").alias("alarm_name"),
        F.col("Namespace").alias("namespace"),
        F.col("MetricName").alias("metric"),
        C.dims_key(dims).alias("dim_key"),
        F.col("Threshold").alias("threshold"),
        F.col("ComparisonOperator").alias("op_raw"),
        C.operator_code(F.col("ComparisonOperator")).alias("op"),
        F.col("StateValue").alias("state"),
        F.col("StateReason").alias("reason"),
        "ord",
    )


def alarm_index(alarms: DataFrame) -> DataFrame:
    """One alarm per (namespace, metric, dimensions): the last listed one wins."""
    last = F.max_by(F.struct("alarm_name", "threshold", "op", "state"), "ord").alias("a")
    return alarms.groupBy("namespace", "metric", "dim_key").agg(last).select(
        "namespace", "metric", "dim_key", "a.alarm_name", "a.threshold", "a.op", "a.state"
    )


def list_alarms(alarms: DataFrame) -> DataFrame:
    return alarms.select(
        F.col("alarm_name").alias("AlarmName"),
        F.col("metric").alias("Metric"),
        F.col("namespace").alias("Namespace"),
        F.col("state").alias("State"),
        F.col("reason").alias("Reason"),
    )


def attach_thresholds(series: DataFrame, index: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Exact threshold of each series; both columns null unless value and operator are known.

    Apply it to binned series. The join carries no hint: the optimizer broadcasts the
    alarm side when its measured size allows and splits skewed series otherwise.
    """
    keys = on or ["namespace", "metric", "dim_key"]
    usable = index.filter(F.col("threshold").isNotNull() & F.col("op").isNotNull()).select(*keys, "threshold", "op")
    return series.join(usable, keys, "left")


def flag_breaches(series: DataFrame) -> DataFrame:
    return series.withColumn("breach", C.breaches(F.col("value"), F.col("op"), F.col("threshold")))
