"""Collector snapshots out of datapoints: latest values, trend maps, and the records per resource type."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators import metrics, thresholds
from tidewatch.schemas import SNAPSHOT_LOOKBACK_MINUTES, TREND_LOOKBACK_MINUTES

ENTITY = ["resource_type", "resource_id"]
SERIES = [*ENTITY, "namespace", "metric", "metric_key", "dim_key", "unit"]


def binned_series(datapoints: DataFrame, catalog: DataFrame, as_of: dt.datetime, minutes: int, tracked: bool) -> DataFrame:
    """Catalogued datapoints of the lookback, one row per series and period."""
    known = metrics.with_catalog(metrics.lookback(datapoints, as_of, minutes), catalog.filter(F.col("tracked") == tracked))
    return metrics.period_statistic(known.withColumn("dim_key", C.dims_key(F.col("dims"))), SERIES)


def root_disks_only(binned: DataFrame, disks: DataFrame, instances: DataFrame) -> DataFrame:
    """Keeps of all disk series the chosen root series of each instance; other metrics pass."""
    chosen = metrics.root_disk_series(disks, instances.select("resource_id")).filter(F.col("disk_dims").isNotNull())
    roots = chosen.select("resource_id", C.dims_key(F.col("disk_dims")).alias("dim_key"))
    disk = binned.filter(F.col("metric_key") == "Disk").join(roots, ["resource_id", "dim_key"], "left_semi")
    return binned.filter(F.col("metric_key") != "Disk").unionByName(disk)


def trends_and_latest(binned: DataFrame, alarm_index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trend map per resource, latest value per resource and metric) from the same binned series."""
    series = thresholds.attach_thresholds(binned, alarm_index)
    payloads = metrics.history_payload(series, [*ENTITY, "metric_key"])
    trends = metrics.metric_map(payloads, ENTITY, "metric_key")
    return trends, metrics.latest_value(binned, [*ENTITY, "metric_key"])


def instance_snapshots(
    instances: DataFrame, datapoints: DataFrame, disks: DataFrame, alarm_index: DataFrame, catalog: DataFrame, as_of: dt.datetime
) -> DataFrame:
    """Instance records with latest values, status label, disk status and trend map.

    ``instances``: resource_id, name, state, private_ip, public_ip; ``disks``: listed disk
    series as (dims, ord).
    """
    points = datapoints.filter(F.col("resource_type") == "EC2")
    binned = root_disks_only(binned_series(points, catalog, as_of, TREND_LOOKBACK_MINUTES, True), disks, instances)
    trends, latest = trends_and_latest(binned, alarm_index)
    found = metrics.instance_snapshot(
        instances,
        latest.drop("resource_type"),
        trends.drop("resource_type"),
        metrics.root_disk_series(disks, instances.select("resource_id")),
    )
    return found.drop("disk_status").withColumnRenamed("trends", "MetricTrends").withColumn("snapshot_ts", C.instant(as_of))


def group_snapshots(
    resources: DataFrame, resource_type: str, datapoints: DataFrame, alarm_index: DataFrame, catalog: DataFrame, as_of: dt.datetime,
    columns: dict[str, str],
) -> DataFrame:
    """Load balancers or scaling groups with their metric columns (zero where nothing was measured) and trend map.

    ``columns`` names the metric key behind each output column. Tracked metrics look back
    over the trend window, the others over the short one.
    """
    points = datapoints.filter(F.col("resource_type") == resource_type)
    tracked = binned_series(points, catalog, as_of, TREND_LOOKBACK_MINUTES, True)
    plain = binned_series(points, catalog, as_of, SNAPSHOT_LOOKBACK_MINUTES, False)
    trends, latest = trends_and_latest(tracked, alarm_index)
    both = latest.unionByName(metrics.latest_value(plain, [*ENTITY, "metric_key"]))
    wide = metrics.snapshot_pivot(both, "resource_id", list(columns.values()), "metric_key")
    named = wide.select("resource_id", *[F.col(key).alias(name) for name, key in columns.items()])
    joined = resources.join(named, "resource_id", "left").join(trends.drop("resource_type"), "resource_id", "left")
    return metrics.zero_fill(joined, list(columns)).withColumnRenamed("trends", "MetricTrends")
