"""Contexts, correlation, redaction and analysis over the fleet view of the driver's tables."""

import json

from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators import analyze, context, correlate, extract, redact
from tidewatch.plans import adapters as A
from tidewatch.plans.registry import query

CUSTOMER = "'Customer#' || lpad(CAST({} AS VARCHAR), 9, '0')"
C_ORDER, C_SUPP, C_NATION, C_USER = (CUSTOMER.format(k) for k in ("o_custkey", "s_suppkey", "s_nationkey", "user_id"))

FLEET_SQL = f"""targets AS (SELECT {C_ORDER} AS resource_id, 'lb-' || o_orderkey AS alb_name, o_orderpriority AS target_group,
  CASE WHEN o_orderstatus = 'F' THEN 'unhealthy' ELSE 'healthy' END AS health, o_orderpriority AS reason, o_orderkey AS ord FROM orders),
members AS (SELECT s_name AS asg_name, {C_SUPP} AS resource_id, 'InService' AS lifecycle_state, s_nationkey, s_suppkey, 0 AS m_ord FROM supplier
  UNION ALL SELECT s_name, {C_NATION}, ' Standby', s_nationkey, s_suppkey, 1 FROM supplier),
links AS (SELECT {C_USER} AS resource_id, event_type AS event_name, event_id AS ord, CASE WHEN value > 150 THEN 'Throttled' ELSE '' END AS error_code FROM events),
states AS (SELECT c_name AS resource_id, c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN ' Running ' WHEN 'MACHINERY' THEN 'stopped'
  WHEN 'HOUSEHOLD' THEN 'terminated' WHEN 'FURNITURE' THEN 'shutting-down' END AS state, c_acctbal, c_nationkey FROM customer),
spine AS (SELECT resource_id FROM targets UNION SELECT resource_id FROM members UNION SELECT resource_id FROM links UNION SELECT resource_id FROM states),
last_target AS (SELECT * FROM targets QUALIFY row_number() OVER (PARTITION BY resource_id ORDER BY ord DESC) = 1),
last_member AS (SELECT * FROM members QUALIFY row_number() OVER (PARTITION BY resource_id ORDER BY s_suppkey DESC, m_ord DESC) = 1)"""


def instances(spark, sf_dir):
    return A.fleet_instances(spark, sf_dir).withColumn("resource_id", F.col("InstanceId"))


def targets(spark, sf_dir):
    return context.lb_targets(A.fleet_load_balancers(spark, sf_dir))


def members(spark, sf_dir):
    return context.asg_members(A.fleet_groups(spark, sf_dir))


def links(spark, sf_dir, only="EC2 Instance"):
    return extract.event_links(A.fleet_events(spark, sf_dir), only)


# --- contexts ---------------------------------------------------------------------


@query("resource_spine", f"WITH {FLEET_SQL} SELECT 'EC2' AS resource_type, resource_id FROM spine UNION ALL SELECT 'Auto Scaling Group', s_name FROM supplier")
def resource_spine(spark, sf_dir):
    return context.spine(
        (instances(spark, sf_dir), "resource_id", "EC2"),
        (targets(spark, sf_dir), "resource_id", "EC2"),
        (members(spark, sf_dir), "resource_id", "EC2"),
        (links(spark, sf_dir), "resource_id", "EC2"),
        (A.fleet_groups(spark, sf_dir), "asg_name", "Auto Scaling Group"),
    )


@query(
    "snapshot_last",
    """
SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY ALL""",
)
def snapshot_last(spark, sf_dir):
    rows = A.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    return context.last_wins(rows, ["o_custkey"], ["o_orderkey"], ["status", "price"])


@query("target_last_wins", f"WITH {FLEET_SQL} SELECT resource_id, alb_name, target_group, health, reason FROM last_target")
def target_last_wins(spark, sf_dir):
    last = context.instance_lb_membership(targets(spark, sf_dir))
    return last.select("resource_id", *[F.col(f"lb_membership.{n}").alias(n) for n in ("alb_name", "target_group", "health", "reason")])


@query("member_last_wins", f"WITH {FLEET_SQL} SELECT resource_id, asg_name, lifecycle_state, 'zone-' || s_nationkey AS availability_zone FROM last_member")
def member_last_wins(spark, sf_dir):
    last = context.instance_asg_membership(members(spark, sf_dir))
    return last.select("resource_id", *[F.col(f"asg_membership.{n}").alias(n) for n in ("asg_name", "lifecycle_state", "availability_zone")])


@query(
    "events_per_resource",
    f"""WITH {FLEET_SQL} SELECT resource_id, count(*) AS events, arg_min(event_name, ord) AS first_event, arg_max(event_name, ord) AS last_event,
  min(ord) AS first_ord FROM links GROUP BY ALL""",
)
def events_per_resource(spark, sf_dir):
    return context.instance_events(links(spark, sf_dir)).groupBy("resource_id").agg(
        F.count("*").alias("events"), F.min_by("event_name", "ord").alias("first_event"), F.max_by("event_name", "ord").alias("last_event"),
        F.min("ord.ord").alias("first_ord"),
    )


@query(
    "lb_promote",
    """
SELECT 'lb-' || o_orderkey AS alb_name, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN ' Active_Impaired' ELSE 'failed' END AS state,
  o_orderpriority AS target_group, 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS target, o_totalprice AS request_count FROM orders""",
)
def lb_promote(spark, sf_dir):
    lb = F.col("load_balancer")
    promoted = context.promote_load_balancers(A.fleet_load_balancers(spark, sf_dir))
    return promoted.select(
        lb["alb_name"].alias("alb_name"), lb["state"].alias("state"), lb["target_groups"][0]["target_group_name"].alias("target_group"),
        lb["target_groups"][0]["targets"][0]["instance_id"].alias("target"), lb["metrics"]["request_count"].alias("request_count"),
    )


@query("asg_promote", "SELECT s_name AS asg_name, 1 AS min_size, s_nationkey + 1 AS max_size, 2::INTEGER AS members FROM supplier")
def asg_promote(spark, sf_dir):
    g = F.col("scaling_group")
    promoted = context.promote_scaling_groups(A.fleet_groups(spark, sf_dir))
    return promoted.select(g["asg_name"].alias("asg_name"), g["min_size"].alias("min_size"), g["max_size"].alias("max_size"), F.size(g["instances"]).alias("members"))


@query(
    "context_union",
    f"""WITH {FLEET_SQL}, n AS (SELECT resource_id, count(*) AS events FROM links GROUP BY ALL)
SELECT 'EC2' AS resource_type, spine.resource_id AS instance_id, 4::INTEGER AS collector_count, s.state, t.alb_name, m.asg_name, coalesce(n.events, 0) AS events
FROM spine LEFT JOIN states s USING (resource_id) LEFT JOIN last_target t USING (resource_id) LEFT JOIN last_member m USING (resource_id) LEFT JOIN n USING (resource_id)
UNION ALL SELECT 'Load Balancer', 'lb-' || o_orderkey, 4, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN ' Active_Impaired' ELSE 'failed' END, 'lb-' || o_orderkey, NULL, 0 FROM orders
UNION ALL SELECT 'Auto Scaling Group', s_name, 4, NULL, NULL, s_name, 0 FROM supplier""",
)
def context_union(spark, sf_dir):
    docs = context.envelope(A.fleet_contexts(spark, sf_dir))
    c = F.col("context")
    return docs.select(
        "resource_type", "instance_id", "collector_count",
        F.coalesce(c["instance"]["snapshot"]["State"], c["load_balancer"]["state"]).alias("state"),
        F.coalesce(c["instance"]["lb_membership"]["alb_name"], c["load_balancer"]["alb_name"]).alias("alb_name"),
        F.coalesce(c["instance"]["asg_membership"]["asg_name"], c["scaling_group"]["asg_name"]).alias("asg_name"),
        F.coalesce(c["instance"]["n_events"], F.lit(0).cast("bigint")).alias("events"),
    )


@query("stale_anti", f"WITH {FLEET_SQL} SELECT resource_id FROM states WHERE resource_id NOT IN (SELECT resource_id FROM members UNION ALL SELECT resource_id FROM links)")
def stale_anti(spark, sf_dir):
    current = context.spine((members(spark, sf_dir), "resource_id", "EC2"), (links(spark, sf_dir), "resource_id", "EC2"))
    return context.stale_entities(instances(spark, sf_dir).select("resource_id"), current, ["resource_id"])


@query(
    "single_resource",
    f"""WITH {FLEET_SQL} SELECT 'EC2' AS resource_type, s.resource_id, s.state, t.alb_name, m.asg_name, (SELECT count(*) FROM links WHERE resource_id = s.resource_id) AS events
FROM states s LEFT JOIN last_target t USING (resource_id) LEFT JOIN last_member m USING (resource_id) WHERE s.c_custkey = 7""",
)
def single_resource(spark, sf_dir):
    built = context.build_context_for(
        "Customer#000000007", A.fleet_instances(spark, sf_dir), A.fleet_load_balancers(spark, sf_dir), A.fleet_groups(spark, sf_dir), A.fleet_events(spark, sf_dir)
    )
    i = F.col("instance")
    return built.select(
        "resource_type", "resource_id", i["snapshot"]["State"].alias("state"), i["lb_membership"]["alb_name"].alias("alb_name"),
        i["asg_membership"]["asg_name"].alias("asg_name"), i["n_events"].alias("events"),
    )


# --- correlation ------------------------------------------------------------------


@query(
    "correlation_targets",
    f"""WITH {FLEET_SQL} SELECT resource_id, coalesce(health, 'Not registered') AS target_health, reason AS target_reason FROM states LEFT JOIN targets USING (resource_id)""",
)
def correlation_targets(spark, sf_dir):
    return correlate.with_targets(instances(spark, sf_dir), targets(spark, sf_dir))


@query(
    "correlation_scaling",
    f"""WITH {FLEET_SQL} SELECT resource_id, coalesce(lifecycle_state, 'Not in Auto Scaling') AS lifecycle_state, CASE WHEN asg_name IS NOT NULL THEN 'Healthy' END AS scaling_health
FROM states LEFT JOIN members USING (resource_id)""",
)
def correlation_scaling(spark, sf_dir):
    return correlate.with_scaling(instances(spark, sf_dir), members(spark, sf_dir))


@query("correlation_events", f"WITH {FLEET_SQL} SELECT resource_id, 2 * count(ord) AS events_found FROM states LEFT JOIN links USING (resource_id) GROUP BY ALL")
def correlation_events(spark, sf_dir):
    return correlate.event_counts(instances(spark, sf_dir), links(spark, sf_dir, None))


@query(
    "correlation_row",
    f"""WITH {FLEET_SQL}, t AS (SELECT resource_id, count(*) AS targets, count(*) FILTER (health = 'healthy') AS healthy_targets FROM targets GROUP BY ALL),
m AS (SELECT resource_id, count(*) AS groups, max(lifecycle_state) AS lifecycle_state FROM members GROUP BY ALL),
e AS (SELECT resource_id, 2 * count(*) AS events_found FROM links GROUP BY ALL)
SELECT resource_id, c_acctbal AS cpu, coalesce(targets, 0) AS targets, coalesce(healthy_targets, 0) AS healthy_targets,
  CASE WHEN targets IS NULL THEN 'Not registered' ELSE healthy_targets || '/' || targets END AS target_text, coalesce(groups, 0) AS groups,
  coalesce(lifecycle_state, 'Not in Auto Scaling') AS lifecycle_state, coalesce(events_found, 0) AS events_found
FROM states LEFT JOIN t USING (resource_id) LEFT JOIN m USING (resource_id) LEFT JOIN e USING (resource_id)""",
)
def correlation_row(spark, sf_dir):
    spine = instances(spark, sf_dir).select("resource_id", F.col("CPU").alias("cpu"))
    return correlate.correlation_rows(spine, targets(spark, sf_dir), members(spark, sf_dir), links(spark, sf_dir, None))


@query(
    "correlation_details",
    f"""WITH {FLEET_SQL}, d AS (
  SELECT resource_id, 'target' AS section, coalesce(health, 'Not registered') AS value, reason AS note FROM states LEFT JOIN targets USING (resource_id)
  UNION ALL SELECT resource_id, 'scaling', coalesce(lifecycle_state, 'Not in Auto Scaling'), CASE WHEN asg_name IS NOT NULL THEN 'Healthy' END FROM states LEFT JOIN members USING (resource_id)
  UNION ALL SELECT resource_id, 'event', event_name, NULL FROM states JOIN links USING (resource_id))
SELECT resource_id, section, value, note, count(*) AS times FROM d GROUP BY ALL""",
)
def correlation_details(spark, sf_dir):
    rows = correlate.correlation_details(instances(spark, sf_dir), targets(spark, sf_dir), members(spark, sf_dir), links(spark, sf_dir))
    return rows.groupBy("resource_id", "section", "value", "note").agg(F.count(F.lit(1)).alias("times"))


# --- redaction --------------------------------------------------------------------


@query(
    "event_first_wins",
    f"WITH {FLEET_SQL} SELECT resource_id, event_name, arg_min(error_code, ord) AS error_code, 'app' AS service, min(ord) AS first_seen FROM links GROUP BY ALL",
)
def event_first_wins(spark, sf_dir):
    return redact.first_events(links(spark, sf_dir), ["resource_id"], ["ord"])


@query(
    "event_first_wins_errors",
    f"WITH {FLEET_SQL} SELECT resource_id, event_name, error_code, 'app' AS service, min(ord) AS first_seen FROM links GROUP BY ALL",
)
def event_first_wins_errors(spark, sf_dir):
    return redact.first_events(links(spark, sf_dir), ["resource_id"], ["ord"], keep_errors=True)


@query(
    "redacted_instances",
    f"""WITH {FLEET_SQL}, e AS (SELECT resource_id, event_name, min(ord) AS o FROM links GROUP BY ALL),
n AS (SELECT resource_id, string_agg(event_name, ',' ORDER BY o) AS events FROM e GROUP BY ALL)
SELECT resource_id, s.state, CASE WHEN c_acctbal > 0 THEN 'cpu' ELSE '' END AS metrics, t.health AS target_health, t.reason AS failure_reason,
  m.lifecycle_state, n.events
FROM spine LEFT JOIN states s USING (resource_id) LEFT JOIN last_target t USING (resource_id) LEFT JOIN last_member m USING (resource_id) LEFT JOIN n USING (resource_id)""",
)
def redacted_instances(spark, sf_dir):
    docs = redact.redact_instances(A.fleet_contexts(spark, sf_dir), links(spark, sf_dir))
    return docs.select(
        "resource_id", "state", F.array_join(F.map_keys(F.col("metrics")), ",").alias("metrics"),
        F.col("lb.target_health").alias("target_health"), F.col("lb.failure_reason").alias("failure_reason"),
        F.col("asg.lifecycle_state").alias("lifecycle_state"),
        F.array_join(F.transform("events", lambda e: e["event_name"]), ",").alias("events"),
    )


@query(
    "redacted_load_balancers",
    f"""
SELECT 'lb-' || o_orderkey AS alb_name, o_orderpriority AS target_group_name, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE 1.0 END::DOUBLE AS healthy_hosts,
  CASE WHEN o_orderstatus = 'F' THEN 1.0 END::DOUBLE AS unhealthy_hosts, {C_ORDER} AS target, 0::INTEGER AS metrics FROM orders""",
)
def redacted_load_balancers(spark, sf_dir):
    docs = redact.redact_load_balancers(A.fleet_contexts(spark, sf_dir))
    tg = F.col("tg")
    return docs.select("alb_name", F.size(F.map_keys("metrics")).alias("n"), F.explode("target_groups").alias("tg")).select(
        "alb_name", tg["target_group_name"].alias("target_group_name"), tg["healthy_hosts_value"].alias("healthy_hosts"),
        tg["unhealthy_hosts_value"].alias("unhealthy_hosts"), tg["targets"][0]["instance_id"].alias("target"),
        F.greatest(F.col("n"), F.lit(0)).alias("metrics"),
    )


@query(
    "redacted_scaling_groups",
    f"SELECT s_name AS asg_name, s_nationkey + 1 AS max_size, 2 AS desired_capacity, {C_SUPP} AS first_member, s_name AS activity FROM supplier",
)
def redacted_scaling_groups(spark, sf_dir):
    docs = redact.redact_scaling_groups(A.fleet_contexts(spark, sf_dir))
    return docs.select(
        "asg_name", "max_size", F.col("desired_capacity_value").alias("desired_capacity"),
        F.col("members")[0]["instance_id"].alias("first_member"), F.col("scaling_activities")[0]["description"].alias("activity"),
    )


# --- documents with several groups, targets, members and trends: nations as load balancers and scaling groups ---


def _trend(key, value):
    """A metric of a trend map as a source file has it: samples are pairs of texts."""
    return F.create_map(F.lit(key), F.struct(F.lit("Count").alias("U"), F.array(F.array(F.lit("10:00"), F.lit("0.5")), F.array(F.lit("10:05"), value.cast("string"))).alias("H")))


def nation_load_balancers(spark, sf_dir):
    """A load balancer a nation, a target group a market segment, a target a customer; groups of buildings have trends."""
    from tidewatch.schemas import LB_RESOURCE

    healthy = F.col("c_acctbal") >= 0
    target = F.struct(F.col("c_name").alias("instance_id"), F.lit(80).alias("port"), F.when(healthy, "healthy").otherwise("unhealthy").alias("health"), F.col("c_mktsegment").alias("reason"), F.lit("d").alias("description"))
    groups = A.table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(
        F.collect_list(target).alias("targets"), F.count_if(healthy).cast("double").alias("healthy_hosts"), F.count_if(~healthy).cast("double").alias("unhealthy_hosts")
    )
    trend = F.when(F.col("c_mktsegment") == "BUILDING", _trend("HealthyHostCount", F.col("healthy_hosts")))
    group = F.struct(F.col("c_mktsegment").alias("target_group_name"), F.lit("HTTP").alias("protocol"), F.lit(80).alias("port"), F.lit("/").alias("health_check_path"), "healthy_hosts", "unhealthy_hosts", "targets", trend.alias("MetricTrends"))
    lbs = groups.groupBy("c_nationkey").agg(F.collect_list(group).alias("target_groups"), F.sum("healthy_hosts").alias("n"))
    name = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    raw = F.to_json(F.struct(name.alias("alb_name"), F.lit("active").alias("state"), "target_groups", _trend("RequestCount", F.col("n")).alias("MetricTrends")))
    return lbs.select(F.col("c_nationkey").cast("bigint").alias("ord"), F.from_json(raw, LB_RESOURCE).alias("r")).select("ord", "r.*")


@query(
    "redacted_targets",
    """
WITH g AS (SELECT c_nationkey, c_mktsegment, count(*) FILTER (c_acctbal >= 0) AS healthy, count(*) FILTER (c_acctbal < 0) AS unhealthy FROM customer GROUP BY ALL),
n AS (SELECT c_nationkey, count(*) FILTER (c_acctbal >= 0) AS requests FROM customer GROUP BY ALL)
SELECT 'n' || c_nationkey AS alb_name, c_mktsegment AS target_group, c_name AS target, CASE WHEN c_acctbal >= 0 THEN 'healthy' ELSE 'unhealthy' END AS health, c_mktsegment AS reason,
  CASE WHEN c_mktsegment = 'BUILDING' THEN healthy END::DOUBLE AS healthy_trend, CASE WHEN c_mktsegment <> 'BUILDING' THEN healthy END::DOUBLE AS healthy_value, unhealthy::DOUBLE AS unhealthy_value,
  requests::DOUBLE AS requests FROM customer JOIN g USING (c_nationkey, c_mktsegment) JOIN n USING (c_nationkey)""",
)
def redacted_targets(spark, sf_dir):
    """Every target of every group of every load balancer, and counts as trend or as number."""
    from tidewatch.schemas import LOAD_BALANCER

    docs = redact.redact_load_balancers(context.promote_load_balancers(nation_load_balancers(spark, sf_dir)).withColumn("resource_type", F.lit(LOAD_BALANCER)))
    requests = F.element_at(F.try_element_at("metrics", F.lit("request_count"))["H"], -1)["value"]
    groups = docs.select("alb_name", requests.alias("requests"), F.explode("target_groups").alias("g"))
    rows = groups.select("alb_name", "requests", "g.*", F.explode("g.targets").alias("t"))
    return rows.select(
        "alb_name", F.col("target_group_name").alias("target_group"), F.col("t.instance_id").alias("target"), F.col("t.health").alias("health"), F.col("t.reason").alias("reason"),
        F.element_at("healthy_hosts_trend.H", -1)["value"].alias("healthy_trend"), F.col("healthy_hosts_value").alias("healthy_value"), F.col("unhealthy_hosts_value").alias("unhealthy_value"), "requests",
    )


@query(
    "redacted_members",
    """
WITH n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL)
SELECT 'n' || c_nationkey AS asg_name, c_name AS member, CASE WHEN c_acctbal >= 0 THEN 'InService' ELSE 'Standby' END AS lifecycle_state,
  CASE WHEN c_nationkey % 2 = 0 THEN n END::DOUBLE AS desired_trend, CASE WHEN c_nationkey % 2 = 1 THEN n END::INTEGER AS desired_value, 'scaled to ' || n AS activity FROM customer JOIN n USING (c_nationkey)""",
)
def redacted_members(spark, sf_dir):
    """Every member of every scaling group; the desired capacity as trend or as number."""
    from tidewatch.schemas import ASG_RESOURCE, SCALING_GROUP

    member = F.struct(F.col("c_name").alias("instance_id"), F.when(F.col("c_acctbal") >= 0, "InService").otherwise("Standby").alias("lifecycle_state"), F.lit("Healthy").alias("health_status"))
    groups = A.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list(member).alias("instances"), F.count("*").alias("n"))
    activity = F.array(F.struct(F.lit("Successful").alias("status"), F.concat(F.lit("scaled to "), F.col("n").cast("string")).alias("description")))
    trends = F.when(F.col("c_nationkey") % 2 == 0, _trend("DesiredCapacity", F.col("n")))
    raw = F.to_json(F.struct(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("asg_name"), F.lit(1).alias("min_size"), F.col("n").alias("desired_capacity"), "instances", activity.alias("scaling_activities"), trends.alias("MetricTrends")))
    rows = groups.select(F.col("c_nationkey").cast("bigint").alias("ord"), F.from_json(raw, ASG_RESOURCE).alias("r")).select("ord", "r.*")
    docs = redact.redact_scaling_groups(context.promote_scaling_groups(rows).withColumn("resource_type", F.lit(SCALING_GROUP)))
    return docs.select("*", F.explode("members").alias("m")).select(
        "asg_name", F.col("m.instance_id").alias("member"), F.col("m.lifecycle_state").alias("lifecycle_state"), F.element_at("desired_capacity_trend.H", -1)["value"].alias("desired_trend"),
        F.col("desired_capacity_value").alias("desired_value"), F.col("scaling_activities")[0]["description"].alias("activity"),
    )


@query(
    "document_text",
    f"""
SELECT 'Load Balancer' AS resource_type, 'lb-' || o_orderkey AS resource_id, '{{"instance_id":"lb-' || o_orderkey || '","resource_type":"Load Balancer","generated_by":"tidewatch","collector_count":4,"context":{{"alb_name":"lb-' || o_orderkey
  || '","state":"' || CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN ' Active_Impaired' ELSE 'failed' END || '","metrics":{{}},"target_groups":[{{"target_group_name":"' || o_orderpriority
  || '","healthy_hosts":' || CASE WHEN o_orderstatus = 'F' THEN '0.0' ELSE '1.0' END || ',"unhealthy_hosts":' || CASE WHEN o_orderstatus = 'F' THEN '1.0' ELSE 'null' END
  || ',"targets":[{{"instance_id":"' || {C_ORDER} || '","health":"' || CASE WHEN o_orderstatus = 'F' THEN 'unhealthy' ELSE 'healthy' END || '","reason":"' || o_orderpriority
  || '","description":""}}]}}]}}}}' AS text FROM orders
UNION ALL
SELECT 'Auto Scaling Group', s_name, '{{"instance_id":"' || s_name || '","resource_type":"Auto Scaling Group","generated_by":"tidewatch","collector_count":4,"context":{{"asg_name":"' || s_name || '","min_size":1,"max_size":' || (s_nationkey + 1)
  || ',"desired_capacity":2,"health_check_type":"EC2","instances":[{{"instance_id":"' || {C_SUPP} || '","lifecycle_state":"InService","health_status":"Healthy"}},{{"instance_id":"' || {C_NATION}
  || '","lifecycle_state":" Standby","health_status":"Healthy"}}],"scaling_activities":[{{"status":"Successful","description":"' || s_name || '"}}]}}}}' FROM supplier""",
)
def document_text(spark, sf_dir):
    from tidewatch.schemas import EC2

    prompts = redact.render_prompts(redact.redact(A.fleet_contexts(spark, sf_dir), links(spark, sf_dir)), instructions="")
    return prompts.filter(F.col("resource_type") != EC2)


@query(
    "instance_document_text",
    f"""WITH {FLEET_SQL}, e AS (SELECT resource_id, event_name, min(ord) AS o, arg_min(error_code, ord) AS error_code FROM links GROUP BY ALL),
n AS (SELECT resource_id, string_agg('{{"event_name":"' || event_name || '","service":"app","error_code":"' || error_code || '"}}', ',' ORDER BY o) AS events FROM e GROUP BY ALL)
SELECT resource_id, '{{"instance_id":"' || resource_id || '","resource_type":"EC2","generated_by":"tidewatch","collector_count":4,"context":{{"resource_type":"EC2","cloudwatch":' || CASE WHEN s.resource_id IS NULL THEN 'null' ELSE '{{"state":' || coalesce('"' || s.state || '"', 'null')
  || CASE WHEN c_acctbal > 0 THEN ',"cpu":{{"U":"%",' || CASE WHEN c_acctbal > 5000 THEN '"TH":{{"V":80.0,"OP":"GT"}},' ELSE '' END || '"H":[["10:00",1.5],["10:05",' || c_nationkey || '.0]]}}' ELSE '' END
  || '}}' END || ',"alb":' || coalesce('{{"target_health":"' || t.health || '","failure_reason":"' || t.reason || '","failure_description":""}}', 'null')
  || ',"autoscaling":' || coalesce('{{"health_status":"Healthy","lifecycle_state":"' || m.lifecycle_state || '","instance_type":"m5.large"}}', 'null')
  || ',"cloudtrail":[' || coalesce(n.events, '') || ']}}}}' AS text
FROM spine LEFT JOIN states s USING (resource_id) LEFT JOIN last_target t USING (resource_id) LEFT JOIN last_member m USING (resource_id) LEFT JOIN n USING (resource_id)""",
)
def instance_document_text(spark, sf_dir):
    docs = redact.redact_instances(A.fleet_contexts(spark, sf_dir), links(spark, sf_dir))
    return docs.select("resource_id", redact.document_text("EC2").alias("text"))


# --- analysis ---------------------------------------------------------------------

SKIPS_SQL = f"""{FLEET_SQL}, judged AS (
  SELECT 'EC2' AS resource_type, resource_id, coalesce(nullif(lower(trim(state)), ''), 'unknown') AS state, 'Instance' AS label FROM spine LEFT JOIN states USING (resource_id)
  UNION ALL SELECT 'Load Balancer', 'lb-' || o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'active_impaired' ELSE 'failed' END, 'Load Balancer' FROM orders
  UNION ALL SELECT 'Auto Scaling Group', s_name, 'active', 'Auto Scaling Group' FROM supplier),
flagged AS (SELECT *, CASE resource_type WHEN 'EC2' THEN state IN ('running', 'stopped', 'pending', 'stopping') WHEN 'Load Balancer' THEN state IN ('active', 'active_impaired') ELSE true END AS eligible FROM judged)"""


@query("eligibility", f"WITH {SKIPS_SQL} SELECT resource_type, state, eligible, count(*) AS resources FROM flagged GROUP BY ALL")
def eligibility(spark, sf_dir):
    judged = analyze.eligibility(A.fleet_contexts(spark, sf_dir))
    return judged.groupBy("resource_type", F.col("state_text").alias("state"), "eligible").agg(F.count(F.lit(1)).alias("resources"))


@query(
    "eligibility_skips",
    f"WITH {SKIPS_SQL} SELECT resource_type, resource_id, state, label || ' state ''' || state || ''' is not eligible for analysis' AS reason FROM flagged WHERE NOT eligible",
)
def eligibility_skips(spark, sf_dir):
    return analyze.skipped_resources(analyze.eligibility(A.fleet_contexts(spark, sf_dir)))


def _answer(text: str) -> str:
    """Stand-in analyst: refuses failed orders and answers part of the others in plain text."""
    status, price = text.split("|")
    if status == "F":
        raise RuntimeError("no answer")
    if status == "P":
        return f"cost is {price}"
    return json.dumps({"severity": "HIGH", "confidence": 80, "evidence": [price]})


def _outcomes(spark, sf_dir):
    prompts = A.table(spark, sf_dir, "orders").select(
        F.lit("order").alias("resource_type"), F.col("o_orderkey").cast("string").alias("resource_id"),
        F.concat_ws("|", "o_orderstatus", F.floor("o_totalprice").cast("string")).alias("text"),
    )
    return analyze.analyze(prompts, _answer, sleep=lambda seconds: None)


@query(
    "analysis_outcomes",
    """
SELECT CAST(o_orderkey AS VARCHAR) AS resource_id, CASE WHEN o_orderstatus = 'F' THEN 4 ELSE 1 END::INTEGER AS attempts, CASE WHEN o_orderstatus = 'F' THEN 4 ELSE 0 END::INTEGER AS failed_attempts,
  CASE WHEN o_orderstatus = 'F' THEN 'no answer' END AS error, CASE WHEN o_orderstatus = 'O' THEN 'HIGH' END AS severity,
  CASE WHEN o_orderstatus = 'O' THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS evidence,
  CASE WHEN o_orderstatus = 'P' THEN 'cost is ' || CAST(floor(o_totalprice) AS BIGINT) END AS raw_response FROM orders""",
)
def analysis_outcomes(spark, sf_dir):
    reports = analyze.parse_responses(_outcomes(spark, sf_dir))
    return reports.select("resource_id", "attempts", "failed_attempts", "error", "severity", F.array_join("evidence", ",").alias("evidence"), "raw_response")


@query(
    "response_parse",
    """
SELECT event_id, CASE WHEN event_type <> 'error' THEN upper(event_type) END AS severity, CASE WHEN event_type <> 'error' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS confidence,
  CASE WHEN event_type = 'error' THEN '{"severity":"ERROR","confidence":' || CAST(floor(value) AS BIGINT) END AS raw_response FROM events""",
)
def response_parse(spark, sf_dir):
    whole = F.concat(F.lit('{"severity":"'), F.upper("event_type"), F.lit('","confidence":'), F.floor("value").cast("string"))
    rows = A.table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_type") == "error", whole).otherwise(F.concat(whole, F.lit("}"))).alias("response")
    )
    return analyze.parse_responses(rows).select("event_id", "severity", "confidence", "raw_response")


@query(
    "latest_reports",
    """
SELECT o_custkey AS resource_id, max(o_orderkey) AS report_no, arg_max(o_orderpriority, o_orderkey) AS root_cause, arg_max('order ' || o_orderkey, o_orderkey) AS summary
FROM orders GROUP BY ALL""",
)
def latest_reports(spark, sf_dir):
    return A.current_reports(spark, sf_dir).select("resource_id", "report_no", "root_cause", "summary")


COUNTERS_SQL = """counters AS (SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS run, count(*) AS discovered, count(*) FILTER (o_orderstatus <> 'P') AS analyzed, count(*) FILTER (o_orderstatus = 'P') AS skipped,
  count(*) FILTER (o_orderstatus = 'O') AS successful, count(*) FILTER (o_orderstatus = 'F') AS failed, 4 * count(*) FILTER (o_orderstatus = 'F') AS retries,
  count(*) FILTER (o_orderstatus = 'O') AS reports_generated FROM orders GROUP BY ALL)"""


def _counters(spark, sf_dir):
    orders = A.table(spark, sf_dir, "orders").withColumn("run", F.date_format("o_orderdate", "yyyy-MM"))
    status = F.col("o_orderstatus")
    judged = orders.select("run", (status != "P").alias("eligible"))
    outcomes = orders.filter(status != "P").select(
        "run", F.when(status == "F", "no answer").alias("error"), F.when(status == "F", 4).otherwise(0).alias("failed_attempts")
    )
    return analyze.run_counters(judged, outcomes, ["run"])


@query("run_counters", f"WITH {COUNTERS_SQL} SELECT * FROM counters")
def run_counters(spark, sf_dir):
    return _counters(spark, sf_dir)


@query(
    "run_status",
    f"""WITH {COUNTERS_SQL} SELECT run, CASE WHEN failed > 0 AND successful > 0 THEN 'PARTIAL_SUCCESS' WHEN analyzed > 0 AND failed = analyzed THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM counters""",
)
def run_status(spark, sf_dir):
    counters = _counters(spark, sf_dir)
    return counters.select("run", C.run_status(F.col("analyzed"), F.col("successful"), F.col("failed")).alias("status"))


@query(
    "run_records",
    """
SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%d-%m-%Y_%H-%M-%S') AS run_id, strftime(ts + INTERVAL 330 MINUTE, '%d-%m-%Y %H:%M:%S') || ' IST' AS start_time,
  strftime(ts + INTERVAL 400 MINUTE, '%d-%m-%Y %H:%M:%S') || ' IST' AS end_time, 4200.0::DOUBLE AS execution_time_seconds,
  CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM events""",
)
def run_records(spark, sf_dir):
    failed = F.when(F.col("event_type") == "error", 1).otherwise(0)
    rows = A.table(spark, sf_dir, "events").select(
        "event_id", A.utc("ts").alias("start_ts"), (A.utc("ts") + F.make_dt_interval(mins=F.lit(70))).alias("end_ts"),
        F.lit(1).alias("analyzed"), (1 - failed).alias("successful"), failed.alias("failed"),
    )
    return analyze.run_records(rows).select("event_id", "run_id", "start_time", "end_time", "execution_time_seconds", "status")
