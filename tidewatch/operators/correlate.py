"""Per-instance correlation over the metrics snapshot: targets, scaling membership, events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.schemas import NOT_REGISTERED, NOT_SCALED


def _matches_or_none(instances: DataFrame, found: DataFrame) -> DataFrame:
    """Every match of each instance, and one row without values for an instance that has none.

    An inner join and an anti join against distinct ids instead of one outer join: the
    adaptive skew join can split either side of the former, so an instance with very many
    matches does not end in one task.
    """
    spine = instances.select("resource_id")
    matched = found.join(spine, "resource_id")
    missing = spine.join(found.select("resource_id").distinct(), "resource_id", "left_anti")
    return matched.withColumn("_hit", F.lit(True)).unionByName(missing.withColumn("_hit", F.lit(False)), allowMissingColumns=True)


def with_targets(instances: DataFrame, targets: DataFrame) -> DataFrame:
    """Every target registration of each instance, or one row that says there is none."""
    found = targets.select("resource_id", F.col("health").alias("target_health"), F.col("reason").alias("target_reason"))
    return _matches_or_none(instances, found).select(
        "resource_id",
        F.when(F.col("_hit"), F.col("target_health")).otherwise(NOT_REGISTERED).alias("target_health"),
        "target_reason",
    )


def with_scaling(instances: DataFrame, members: DataFrame) -> DataFrame:
    found = members.select("resource_id", "lifecycle_state", F.col("health_status").alias("scaling_health"))
    return _matches_or_none(instances, found).select(
        "resource_id",
        F.when(F.col("_hit"), F.col("lifecycle_state")).otherwise(NOT_SCALED).alias("lifecycle_state"),
        "scaling_health",
    )


def with_events(instances: DataFrame, links: DataFrame) -> DataFrame:
    """Every event that names the instance under any type, in long form."""
    return instances.select("resource_id").join(links.select("resource_id", "event_name", "ord"), "resource_id", "inner")


def event_counts(instances: DataFrame, links: DataFrame) -> DataFrame:
    """Events per instance; the count is taken before the join, so a hot instance is one row in it."""
    counted = links.groupBy("resource_id").agg(F.count(F.lit(1)).alias("events_found"))
    return instances.select("resource_id").join(counted, "resource_id", "left").withColumn(
        "events_found", F.coalesce("events_found", F.lit(0))
    )


def correlation_rows(instances: DataFrame, targets: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per instance. Each side is aggregated by instance first, so the joins never multiply."""
    target_side = targets.groupBy("resource_id").agg(
        F.count(F.lit(1)).alias("targets"),
        F.count_if(F.lower("health") == "healthy").alias("healthy_targets"),
    )
    member_side = members.groupBy("resource_id").agg(
        F.count(F.lit(1)).alias("groups"), F.max("lifecycle_state").alias("lifecycle_state")
    )
    event_side = links.groupBy("resource_id").agg(F.count(F.lit(1)).alias("events_found"))
    joined = (
        instances.join(target_side, "resource_id", "left")
        .join(member_side, "resource_id", "left")
        .join(event_side, "resource_id", "left")
    )
    zero = F.lit(0)
    return joined.withColumns(
        {
            "target_text": F.when(F.col("targets").isNull(), NOT_REGISTERED).otherwise(
                F.concat_ws("/", F.col("healthy_targets").cast("string"), F.col("targets").cast("string"))
            ),
            "lifecycle_state": F.when(F.col("groups").isNull(), NOT_SCALED).otherwise(F.col("lifecycle_state")),
            "targets": F.coalesce("targets", zero),
            "healthy_targets": F.coalesce("healthy_targets", zero),
            "groups": F.coalesce("groups", zero),
            "events_found": F.coalesce("events_found", zero),
        }
    )


def correlation_details(instances: DataFrame, targets: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """The three matches of every instance as one long table (section, value, note)."""
    t = with_targets(instances, targets).select(
        "resource_id", F.lit("target").alias("section"), F.col("target_health").alias("value"), F.col("target_reason").alias("note")
    )
    s = with_scaling(instances, members).select(
        "resource_id", F.lit("scaling").alias("section"), F.col("lifecycle_state").alias("value"), F.col("scaling_health").alias("note")
    )
    e = with_events(instances, links).select(
        "resource_id", F.lit("event").alias("section"), F.col("event_name").alias("value"), F.lit(None).cast("string").alias("note")
    )
    return t.unionByName(s).unionByName(e)
