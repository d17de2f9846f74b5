"""Redaction: allow-listed documents per resource type, and their compact text.

Addresses, names, network topology and raw snapshots never leave this stage: every
function lists what it keeps, so a new source field is dropped until someone adds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import render as R
from tidewatch.schemas import COLLECTOR_COUNT, EC2, GENERATED_BY, KEPT_ASG_METRICS, KEPT_INSTANCE_METRICS, KEPT_LB_METRICS, LOAD_BALANCER, SCALING_GROUP

INSTRUCTIONS = (
    "Review one infrastructure resource and answer with one JSON object holding severity, confidence, "
    "root_cause, summary, evidence and recommendations. Each metric holds its unit U, the configured "
    "threshold TH when there is one, and the samples H from oldest to newest.\n"
)


def kept_metrics(trends: Column, names: dict[str, str]) -> Column:
    """Renamed payloads of the allow-listed metrics that are present."""
    entries = F.array(*[F.struct(F.lit(new).alias("key"), F.try_element_at(trends, F.lit(old)).alias("value")) for new, old in names.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def typed_trends(trends: Column) -> Column:
    """Payloads read from JSON (string pairs) in the library's typed form."""
    return F.transform_values(
        trends,
        lambda _, p: F.struct(
            p["U"].alias("U"),
            p["TH"].alias("TH"),
            F.transform(p["H"], lambda h: F.struct(h[0].alias("label"), h[1].try_cast("double").alias("value"))).alias("H"),
        ),
    )


def lb_membership(m: Column) -> Column:
    return F.when(
        m.isNotNull(),
        F.struct(
            m["health"].alias("target_health"), m["reason"].alias("failure_reason"), m["description"].alias("failure_description")
        ),
    )


def asg_membership(m: Column) -> Column:
    return F.when(
        m.isNotNull(),
        F.struct(
            m["health_status"].alias("health_status"),
            m["lifecycle_state"].alias("lifecycle_state"),
            m["instance_type"].alias("instance_type"),
        ),
    )


def first_events(events: DataFrame, keys: list[str], order: list[str], keep_errors: bool = False) -> DataFrame:
    """First event of each name per resource.

    ``keep_errors`` also tells names apart by error code, so that a later failure of an
    earlier seen call is kept.
    """
    unit = [*keys, "event_name"] + (["error_code"] if keep_errors else [])
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    rest = [c for c in ("service", "error_code") if c not in unit]
    return events.groupBy(*unit).agg(
        F.min_by(F.struct(*rest), rank).alias("_f"), F.min(rank).alias("first_seen")
    ).select(*unit, *[F.col(f"_f.{c}").alias(c) for c in rest], "first_seen")


def event_lists(firsts: DataFrame, keys: list[str]) -> DataFrame:
    """Deduplicated events per resource; bounded by the number of distinct call names."""
    item = F.struct("first_seen", "event_name", "service", "error_code")
    return firsts.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_e")).select(
        *keys,
        F.transform("_e", lambda e: F.struct(e["event_name"].alias("event_name"), e["service"].alias("service"), e["error_code"].alias("error_code"))).alias("events"),
    )


def redact_instances(contexts: DataFrame, events: DataFrame, keep_errors: bool = False) -> DataFrame:
    """State, kept payloads, memberships and deduplicated events.

    ``events`` are the rows of ``context.instance_events`` (or the event bridge); they are reduced to one row per call
    name straight away.
    """
    lists = event_lists(first_events(events, ["resource_id"], ["ord"], keep_errors), ["resource_id"])
    i = F.col("instance")
    docs = contexts.filter(F.col("resource_type") == EC2).select(
        F.lit(EC2).alias("resource_type"),
        "resource_id",
        i["snapshot"].isNotNull().alias("has_snapshot"),
        i["snapshot"]["State"].alias("state"),
        kept_metrics(typed_trends(i["snapshot"]["MetricTrends"]), KEPT_INSTANCE_METRICS).alias("metrics"),
        lb_membership(i["lb_membership"]).alias("lb"),
        asg_membership(i["asg_membership"]).alias("asg"),
    )
    return docs.join(lists, "resource_id", "left")


def redact_load_balancers(contexts: DataFrame) -> DataFrame:
    """Metrics and target groups; host counts carry their trend, else the plain number."""
    lb = F.col("load_balancer")

    def group(tg):
        trends = typed_trends(tg["MetricTrends"])
        healthy = F.try_element_at(trends, F.lit("HealthyHostCount"))
        unhealthy = F.try_element_at(trends, F.lit("UnHealthyHostCount"))
        return F.struct(
            tg["target_group_name"].alias("target_group_name"),
            healthy.alias("healthy_hosts_trend"),
            F.when(healthy.isNull(), tg["healthy_hosts"]).alias("healthy_hosts_value"),
            unhealthy.alias("unhealthy_hosts_trend"),
            F.when(unhealthy.isNull(), tg["unhealthy_hosts"]).alias("unhealthy_hosts_value"),
            F.transform(
                tg["targets"], lambda t: F.struct(*[t[n].alias(n) for n in ("instance_id", "health", "reason", "description")])
            ).alias("targets"),
        )

    return contexts.filter(F.col("resource_type") == LOAD_BALANCER).select(
        F.lit(LOAD_BALANCER).alias("resource_type"),
        "resource_id",
        lb["alb_name"].alias("alb_name"),
        lb["state"].alias("state"),
        kept_metrics(typed_trends(lb["MetricTrends"]), KEPT_LB_METRICS).alias("metrics"),
        F.transform(lb["target_groups"], group).alias("target_groups"),
    )


def redact_scaling_groups(contexts: DataFrame) -> DataFrame:
    g = F.col("scaling_group")
    trends = typed_trends(g["MetricTrends"])
    desired = F.try_element_at(trends, F.lit("DesiredCapacity"))
    return contexts.filter(F.col("resource_type") == SCALING_GROUP).select(
        F.lit(SCALING_GROUP).alias("resource_type"),
        "resource_id",
        g["asg_name"].alias("asg_name"),
        g["min_size"].alias("min_size"),
        g["max_size"].alias("max_size"),
        desired.alias("desired_capacity_trend"),
        F.when(desired.isNull(), g["desired_capacity"]).alias("desired_capacity_value"),
        g["health_check_type"].alias("health_check_type"),
        F.transform(
            g["instances"], lambda m: F.struct(*[m[n].alias(n) for n in ("instance_id", "lifecycle_state", "health_status")])
        ).alias("members"),
        F.transform(
            g["scaling_activities"], lambda a: F.struct(a["status"].alias("status"), a["description"].alias("description"))
        ).alias("scaling_activities"),
        kept_metrics(trends, KEPT_ASG_METRICS).alias("metrics"),
    )


def redact(contexts: DataFrame, events: DataFrame, keep_errors: bool = False) -> DataFrame:
    """All types in one table: each branch keeps its own list, absent members are null.

    The type is a constant of each branch, so what follows the union is simplified per branch.
    """
    return (
        redact_instances(contexts, events, keep_errors)
        .unionByName(redact_load_balancers(contexts), allowMissingColumns=True)
        .unionByName(redact_scaling_groups(contexts), allowMissingColumns=True)
    )


def _metric_members(metrics: Column, names: dict[str, str]) -> list[Column]:
    return [R.member(n, R.payload(F.try_element_at(metrics, F.lit(n)))) for n in names]


def document_text(kind: str, generated_by: str = GENERATED_BY, collector_count: int = COLLECTOR_COUNT) -> Column:
    """Compact JSON of one redacted row, by resource type: the stored document with its context redacted.

    Other scripts stand as they are, not as escapes, and large doubles as Java prints them.
    """
    if kind == LOAD_BALANCER:
        def group(tg):
            return R.obj(
                R.member("target_group_name", R.value(tg["target_group_name"])),
                R.member("healthy_hosts", F.coalesce(R.payload(tg["healthy_hosts_trend"]), R.value(tg["healthy_hosts_value"]))),
                R.member("unhealthy_hosts", F.coalesce(R.payload(tg["unhealthy_hosts_trend"]), R.value(tg["unhealthy_hosts_value"]))),
                R.member("targets", F.coalesce(F.to_json(tg["targets"], {"ignoreNullFields": "false"}), F.lit("[]"))),
            )

        body = R.obj(
            R.member("alb_name", R.value(F.col("alb_name"))),
            R.member("state", R.value(F.col("state"))),
            R.member("metrics", R.obj(*_metric_members(F.col("metrics"), KEPT_LB_METRICS))),
            R.member("target_groups", R.lst(F.transform("target_groups", group))),
        )
    elif kind == SCALING_GROUP:
        plain = ["asg_name", "min_size", "max_size"]
        body = R.obj(
            *[R.member(n, R.value(F.col(n))) for n in plain],
            R.member("desired_capacity", F.coalesce(R.payload(F.col("desired_capacity_trend")), R.value(F.col("desired_capacity_value")))),
            R.member("health_check_type", R.value(F.col("health_check_type"))),
            R.member("instances", F.coalesce(F.to_json("members", {"ignoreNullFields": "false"}), F.lit("[]"))),
            R.member("scaling_activities", F.coalesce(F.to_json("scaling_activities", {"ignoreNullFields": "false"}), F.lit("[]"))),
            *_metric_members(F.col("metrics"), KEPT_ASG_METRICS),
        )
    else:
        snapshot = R.obj(R.member("state", R.value(F.col("state"))), *_metric_members(F.col("metrics"), KEPT_INSTANCE_METRICS))
        body = R.obj(
            R.member("resource_type", R.value(F.col("resource_type"))),
            R.member("cloudwatch", F.when(F.col("has_snapshot"), snapshot).otherwise("null")),
            R.member("alb", R.value(F.col("lb"))),
            R.member("autoscaling", R.value(F.col("asg"))),
            R.member("cloudtrail", F.coalesce(F.to_json("events", {"ignoreNullFields": "false"}), F.lit("[]"))),
        )
    return R.obj(
        R.member("instance_id", R.value(F.col("resource_id"))),
        R.member("resource_type", R.value(F.col("resource_type"))),
        R.member("generated_by", R.value(F.lit(generated_by))),
        R.member("collector_count", F.lit(str(collector_count))),
        R.member("context", body),
    )


def render_prompts(redacted: DataFrame, instructions: str = INSTRUCTIONS) -> DataFrame:
    """(resource_type, resource_id, text): the instructions followed by the compact document."""
    text = (
        F.when(F.col("resource_type") == LOAD_BALANCER, document_text(LOAD_BALANCER))
        .when(F.col("resource_type") == SCALING_GROUP, document_text(SCALING_GROUP))
        .otherwise(document_text(EC2))
    )
    return redacted.select("resource_type", "resource_id", F.concat(F.lit(instructions), text).alias("text"))
