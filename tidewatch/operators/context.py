"""Resource contexts: one document per resource out of four snapshot sources.

Instances are keyed by (resource_type, resource_id), so a scaling group and a load
balancer of one name stay apart. Every nested input carries ordinals, because "the last
one wins" is defined by the order of the source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.schemas import COLLECTOR_COUNT, EC2, GENERATED_BY, LOAD_BALANCER, SCALING_GROUP
from tidewatch.session import cut_lineage

KEY = ["resource_type", "resource_id"]


def _present(name: str):
    return F.coalesce(F.col(name), F.lit("")) != ""


def lb_targets(load_balancers: DataFrame) -> DataFrame:
    """Load balancer → target groups → targets, flat, with the three ordinals."""
    groups = load_balancers.select(
        "alb_name", F.col("ord").alias("lb_ord"), F.posexplode("target_groups").alias("tg_ord", "tg")
    )
    targets = groups.select("alb_name", "lb_ord", "tg_ord", "tg", F.posexplode("tg.targets").alias("t_ord", "t"))
    return targets.select(
        "alb_name",
        F.col("tg.target_group_name").alias("target_group"),
        F.col("t.instance_id").alias("resource_id"),
        F.col("t.health").alias("health"),
        F.col("t.reason").alias("reason"),
        F.col("t.description").alias("description"),
        F.col("t.port").alias("port"),
        "lb_ord",
        "tg_ord",
        "t_ord",
    ).filter(_present("resource_id"))


def asg_members(groups: DataFrame) -> DataFrame:
    return groups.select("asg_name", F.col("ord").alias("asg_ord"), F.posexplode("instances").alias("m_ord", "m")).select(
        "asg_name",
        F.col("m.instance_id").alias("resource_id"),
        F.col("m.health_status").alias("health_status"),
        F.col("m.lifecycle_state").alias("lifecycle_state"),
        F.col("m.availability_zone").alias("availability_zone"),
        F.col("m.instance_type").alias("instance_type"),
        "asg_ord",
        "m_ord",
    ).filter(_present("resource_id"))


def last_wins(rows: DataFrame, keys: list[str], order: list[str], fields: list[str], name: str | None = None) -> DataFrame:
    """Fields of the last row per key, flat or as one struct ``name``; combines map-side."""
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), rank).alias("_last"))
    if name:
        return last.select(*keys, F.col("_last").alias(name))
    return last.select(*keys, *[F.col(f"_last.{f}").alias(f) for f in fields])


def spine(*id_columns: tuple[DataFrame, str, str]) -> DataFrame:
    """Distinct (resource_type, resource_id) over ``(rows, id column, type)`` sources.

    Ids are made distinct per type, so the result stays partitioned by the id alone and
    joins on it need no further exchange.
    """
    by_type: dict[str, list[DataFrame]] = {}
    for rows, id_col, kind in id_columns:
        by_type.setdefault(kind, []).append(rows.select(F.col(id_col).alias("resource_id")).filter(_present("resource_id")))
    parts = [
        reduce(DataFrame.union, ids).distinct().select(F.lit(kind).alias("resource_type"), "resource_id") for kind, ids in by_type.items()
    ]
    return reduce(DataFrame.union, parts)


def instance_lb_membership(targets: DataFrame) -> DataFrame:
    fields = ["alb_name", "target_group", "health", "reason", "description", "port"]
    return last_wins(targets, ["resource_id"], ["lb_ord", "tg_ord", "t_ord"], fields, "lb_membership")


def instance_asg_membership(members: DataFrame) -> DataFrame:
    fields = ["asg_name", "health_status", "lifecycle_state", "availability_zone", "instance_type"]
    return last_wins(members, ["resource_id"], ["asg_ord", "m_ord"], fields, "asg_membership")


EVENT_FIELDS = ["event_time", "event_name", "service", "username", "source_ip", "read_only", "error_code"]


def instance_events(links: DataFrame) -> DataFrame:
    """All events of each instance, a row each: (resource_id, ord, event fields).

    ``links`` is the narrowed event bridge with ``ord`` (source order) and ``link_ord``. Events are never gathered
    into a list, so an instance with very many of them is rows like any other; ``in_order`` brings
    them behind their documents, by ``ord``.
    """
    return links.filter(_present("resource_id")).select("resource_id", F.struct("ord", "link_ord").alias("ord"), *EVENT_FIELDS)


def in_order(documents: DataFrame, events: DataFrame) -> DataFrame:
    """Documents with their events: a row an event, in order within each resource, and one row for a document without any.

    A reader takes a document and its events off the stream one after another. Over tables stored by
    ``writers.store_contexts`` the join needs no exchange.
    """
    told = events.withColumn("resource_type", F.lit(EC2)) if "resource_type" not in events.columns else events
    members = [c for c in told.columns if c not in KEY]
    rows = told.select(*KEY, F.struct(*members).alias("event"))
    return documents.join(rows, KEY, "left").sortWithinPartitions(*KEY, "event.ord")


def promote_load_balancers(load_balancers: DataFrame) -> DataFrame:
    """Load balancers as resources of their own; target groups re-projected to the kept members."""
    kept = ["target_group_name", "protocol", "port", "health_check_path", "healthy_hosts", "unhealthy_hosts", "targets", "MetricTrends"]
    fields = ["alb_name", "dns_name", "scheme", "state", "vpc_id", "metrics", "target_groups", "MetricTrends"]
    shaped = load_balancers.filter(_present("alb_name")).withColumn(
        "target_groups", F.transform("target_groups", lambda tg: F.struct(*[tg[k].alias(k) for k in kept]))
    )
    return last_wins(shaped.withColumnRenamed("alb_name", "resource_id").withColumn("alb_name", F.col("resource_id")),
                     ["resource_id"], ["ord"], fields, "load_balancer")


def promote_scaling_groups(groups: DataFrame) -> DataFrame:
    fields = [
        "asg_name", "min_size", "max_size", "desired_capacity", "health_check_type", "availability_zones",
        "metrics", "instances", "scaling_policies", "scaling_activities", "MetricTrends",
    ]
    shaped = groups.filter(_present("asg_name")).withColumn("resource_id", F.col("asg_name"))
    return last_wins(shaped, ["resource_id"], ["ord"], fields, "scaling_group")


def build_contexts(instances: DataFrame, load_balancers: DataFrame, groups: DataFrame, events: DataFrame) -> DataFrame:
    """All contexts as a tagged union, one row per resource: exactly one of the three members is set.

    Inputs are unnested snapshot rows with ``ord``; ``events`` are parsed audit events with ``ord`` and
    ``resources``. An instance document says how many events it has (``n_events``); the events themselves are rows of
    their own (``instance_events``), so documents have one shape however many there are.

    Everything that is known of an instance is put together by one aggregate over all four sources, each read once.
    """
    from tidewatch.operators.extract import event_links

    lb_fields = ["alb_name", "target_group", "health", "reason", "description", "port"]
    asg_fields = ["asg_name", "health_status", "lifecycle_state", "availability_zone", "instance_type"]
    seen = instances.filter(_present("InstanceId"))
    parts = [
        seen.select(F.col("InstanceId").alias("resource_id"), F.col("ord").alias("_s_ord"), F.struct(*[c for c in seen.columns if c != "ord"]).alias("_s")),
        lb_targets(load_balancers).select("resource_id", F.struct("lb_ord", "tg_ord", "t_ord").alias("_t_ord"), F.struct(*lb_fields).alias("_t")),
        asg_members(groups).select("resource_id", F.struct("asg_ord", "m_ord").alias("_m_ord"), F.struct(*asg_fields).alias("_m")),
        event_links(events).filter(_present("resource_id")).select("resource_id", F.lit(1).cast("bigint").alias("_n")),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    # The last one of each source wins; a source that does not name the instance gives null.
    known = rows.groupBy("resource_id").agg(
        F.max_by("_s", "_s_ord").alias("snapshot"),
        F.max_by("_t", "_t_ord").alias("lb_membership"),
        F.max_by("_m", "_m_ord").alias("asg_membership"),
        F.coalesce(F.sum("_n"), F.lit(0).cast("bigint")).alias("n_events"),
    )
    ec2 = known.select(F.lit(EC2).alias("resource_type"), "resource_id", F.struct("snapshot", "lb_membership", "asg_membership", "n_events").alias("instance"))
    lbs = promote_load_balancers(load_balancers).select(F.lit(LOAD_BALANCER).alias("resource_type"), "resource_id", "load_balancer")
    asgs = promote_scaling_groups(groups).select(F.lit(SCALING_GROUP).alias("resource_type"), "resource_id", "scaling_group")
    return ec2.unionByName(lbs, allowMissingColumns=True).unionByName(asgs, allowMissingColumns=True)


def envelope(contexts: DataFrame, generated_by: str = GENERATED_BY, collector_count: int = COLLECTOR_COUNT) -> DataFrame:
    """Stored document shape: identity, origin and the context itself."""
    members = [c for c in ("instance", "load_balancer", "scaling_group") if c in contexts.columns]
    return contexts.select(
        F.col("resource_id").alias("instance_id"),
        "resource_type",
        F.lit(generated_by).alias("generated_by"),
        F.lit(collector_count).alias("collector_count"),
        F.struct(*members).alias("context"),
    )


def stale_entities(stored: DataFrame, current: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Stored keys that no source mentions any more."""
    return stored.join(current, keys or KEY, "left_anti")


def prune_stale(stored: DataFrame, current: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return stored.join(current, keys or KEY, "left_semi")


def only_resource(rows: DataFrame, resource_id: str, id_col: str = "resource_id", must_exist: bool = True) -> DataFrame:
    """Narrow a source to one resource before anything is joined; an unknown id is an error.

    The narrowed rows are few; they are materialised once and both the question and the reader use them.
    """
    narrowed = rows.filter(F.col(id_col) == resource_id)
    if not must_exist:
        return narrowed
    held = cut_lineage(narrowed)
    if held.isEmpty():
        raise ValueError(f"resource {resource_id!r} is not in the collected data")
    return held


def build_context_for(
    resource_id: str, instances: DataFrame, load_balancers: DataFrame, groups: DataFrame, events: DataFrame
) -> DataFrame:
    """Contexts of one id, narrowing all four sources first."""
    owns_target = F.exists("target_groups", lambda tg: F.exists(tg["targets"], lambda t: t["instance_id"] == resource_id))
    owns_member = F.exists("instances", lambda m: m["instance_id"] == resource_id)
    names_it = F.exists("resources", lambda r: r["name"] == resource_id)
    built = build_contexts(
        instances.filter(F.col("InstanceId") == resource_id),
        load_balancers.filter((F.col("alb_name") == resource_id) | F.coalesce(owns_target, F.lit(False))),
        groups.filter((F.col("asg_name") == resource_id) | F.coalesce(owns_member, F.lit(False))),
        events.filter(names_it),
    )
    return only_resource(built, resource_id)
