"""Metric windows and projections: lookback, period statistics, payloads, pivots."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.functions.bounded import literal_rows
from tidewatch.schemas import CATALOG_SCHEMA, METRIC_CATALOG, NO_DISK_AGENT, PERIOD_SECONDS

SERIES = ["resource_type", "resource_id", "namespace", "metric", "dim_key", "statistic", "unit"]


def lookback(df: DataFrame, as_of: dt.datetime, minutes: int, ts: str = "ts") -> DataFrame:
    """Rows of ``[as_of - minutes, as_of]``.

    Bounds are literals of the column's own type, so the filter reaches the scan.
    """
    kind = df.schema[ts].dataType
    return df.filter(F.col(ts).between(C.instant(as_of - dt.timedelta(minutes=minutes), kind), C.instant(as_of, kind)))


def period_statistic(
    datapoints: DataFrame,
    keys: list[str],
    period_seconds: int = PERIOD_SECONDS,
    statistic: Column | str = "statistic",
    ts: str = "ts",
) -> DataFrame:
    """One row per series and tumbling period, valued by the series' own statistic.

    Sum, count and maximum are partial aggregates: a hot series shrinks to one row per
    period inside each map task before anything is shuffled.
    """
    how = F.col(statistic) if isinstance(statistic, str) else statistic
    windowed = datapoints.groupBy(*keys, F.window(ts, f"{period_seconds} seconds").alias("w"), how.alias("_how"))
    return windowed.agg(
        F.sum("value").alias("_sum"), F.count("value").alias("samples"), F.max("value").alias("_max")
    ).select(
        *keys,
        F.col("w.start").alias(ts),
        F.when(F.col("_how") == "Sum", F.col("_sum"))
        .when(F.col("_how") == "Maximum", F.col("_max"))
        .otherwise(F.try_divide("_sum", "samples"))
        .alias("value"),
        "samples",
    )


def latest_value(binned: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Newest value of each series, 2 dp. A binned series has unique times, so there are no ties."""
    return binned.groupBy(*keys).agg(C.round2(F.max_by("value", ts)).alias("latest"), F.max(ts).alias("latest_ts"))


def latest_or_zero(series: DataFrame, binned: DataFrame, keys: list[str]) -> DataFrame:
    """Every series of ``series`` with its newest value, zero where the window holds none."""
    return series.join(latest_value(binned, keys).drop("latest_ts"), keys, "left").withColumn(
        "latest", F.coalesce("latest", F.lit(0.0))
    )


def zero_fill(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.coalesce(n, F.lit(0)) for n in names})


def history_payload(series: DataFrame, keys: list[str], unit: str | Column = "unit", ts: str = "ts") -> DataFrame:
    """``payload`` per series: unit, threshold when configured, samples oldest to newest.

    ``series`` is binned and holds ``threshold`` and ``op`` (null when no alarm matches).
    The list is bounded by periods per lookback, whatever the number of datapoints.
    """
    unit_col = F.col(unit) if isinstance(unit, str) else unit
    point = F.struct(F.col(ts).alias("ts"), C.round2(F.col("value")).alias("value"))
    has_threshold = F.col("threshold").isNotNull() & F.col("op").isNotNull()
    grouped = series.groupBy(*keys).agg(
        F.first(unit_col).alias("_u"),
        F.first(F.when(has_threshold, F.struct(F.col("threshold").alias("V"), F.col("op").alias("OP")))).alias("_th"),
        F.array_sort(F.collect_list(point)).alias("_h"),
    )
    return grouped.select(
        *keys,
        F.struct(
            F.col("_u").alias("U"),
            F.col("_th").alias("TH"),
            F.transform(
                "_h", lambda p: F.struct(p["ts"].alias("ts"), C.clock_label(p["ts"]).alias("label"), p["value"].alias("value"))
            ).alias("H"),
        ).alias("payload"),
    )


def metric_map(payloads: DataFrame, keys: list[str], metric: str = "metric") -> DataFrame:
    """``trends``: metric to payload, one entry per metric; metrics without data are absent."""
    entry = F.struct(F.col(metric).alias("key"), F.col("payload").alias("value"))
    return payloads.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("trends"))


def snapshot_pivot(latest: DataFrame, key: str, metrics: list[str], metric: str = "metric") -> DataFrame:
    """One column per metric, from a fixed list so that no extra job discovers the values."""
    return latest.groupBy(key).agg(
        *[F.max(F.when(F.col(metric) == m, F.col("latest"))).alias(m) for m in metrics]
    )


def root_disk_series(series: DataFrame, instances: DataFrame) -> DataFrame:
    """The first listed disk series of each instance that is mounted on ``/``.

    ``series`` holds ``dims`` and ``ord``. The instance id is read out of the
    dimensions, so this is an equi join and not a scan of all series per instance.
    """
    def values(name):
        return F.transform(F.filter("dims", lambda d: d["name"] == name), lambda d: d["value"])

    owned = (
        series.filter(F.exists("dims", lambda d: (d["name"] == "path") & (d["value"] == "/")))
        .select(F.explode(F.array_distinct(values("InstanceId"))).alias("resource_id"), "dims", "ord")
        .groupBy("resource_id")
        .agg(F.min_by("dims", "ord").alias("disk_dims"))
    )
    return instances.join(owned, "resource_id", "left").withColumn(
        "disk_status", F.when(F.col("disk_dims").isNull(), F.lit(NO_DISK_AGENT))
    )


def metric_catalog(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, CATALOG_SCHEMA, METRIC_CATALOG)


def with_catalog(datapoints: DataFrame, catalog: DataFrame) -> DataFrame:
    """Statistic, unit and short name from the catalog. A literal catalog has a known size and is broadcast by it."""
    return datapoints.drop("statistic", "unit").join(catalog, ["resource_type", "namespace", "metric"], "inner")


def name_tag(tags: Column) -> Column:
    """Value of the last ``Name`` tag."""
    named = F.filter(F.coalesce(tags, F.array().cast("array<struct<Key:string,Value:string>>")), lambda t: t["Key"] == "Name")
    return F.coalesce(F.try_element_at(named, F.lit(-1))["Value"], F.lit("No Name"))


def unnest_reservations(described: DataFrame) -> DataFrame:
    """``Reservations[].Instances[]`` to one row per instance with the documented defaults."""
    item = F.col("i")
    return (
        described.select(F.explode("Reservations").alias("r"))
        .select(F.explode("r.Instances").alias("i"))
        .select(
            name_tag(item["Tags"]).alias("name"),
            item["InstanceId"].alias("resource_id"),
            item["State"]["Name"].alias("state"),
            F.coalesce(item["PrivateIpAddress"], F.lit("N/A")).alias("private_ip"),
            F.coalesce(item["PublicIpAddress"], F.lit("N/A")).alias("public_ip"),
        )
    )


def application_only(load_balancers: DataFrame) -> DataFrame:
    return load_balancers.filter(F.col("Type") == "application")


def with_lb_dimensions(target_groups: DataFrame) -> DataFrame:
    """Metric dimensions from the ARNs; a malformed ARN gives null."""
    return target_groups.withColumns(
        {
            "lb_dimension": C.lb_dimension(F.col("lb_arn")),
            "tg_dimension": C.target_group_dimension(F.col("tg_arn")),
        }
    )


def instance_snapshot(
    instances: DataFrame, latest: DataFrame, trends: DataFrame, disks: DataFrame | None = None
) -> DataFrame:
    """Flat instance record: latest values by metric, status label and trend map."""
    metrics = ["CPU", "Memory", "Disk", "NetworkIn", "NetworkOut", "StatusCheck"]
    wide = snapshot_pivot(latest, "resource_id", metrics, metric="metric_key")
    out = instances.join(wide, "resource_id", "left").join(trends, "resource_id", "left")
    out = out.withColumn("StatusCheck", C.status_check_label(F.col("StatusCheck")))
    if disks is None:
        return out
    status = disks.select("resource_id", "disk_status")
    return out.join(status, "resource_id", "left").withColumn(
        "Disk", F.coalesce(F.col("disk_status"), F.col("Disk").cast("string"))
    )
