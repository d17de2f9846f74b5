"""Dashboard tables over runs, reports and archives made of orders."""

from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators import feed
from tidewatch.plans import adapters as A
from tidewatch.plans.q_context import FLEET_SQL
from tidewatch.plans.q_signals import SCORE_SQL, scored_series
from tidewatch.plans.registry import query

SEVERITY_SQL = """CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '5-LOW' THEN 'low' ELSE 'UNRATED' END"""
RANK_SQL = "CASE {} WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 0 END"

RUNS_SQL = """runs AS (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'COMPLETED_WITH_ERRORS' ELSE 'ABORTED' END AS status,
  o_orderpriority AS type, o_orderdate AS start_ts, o_orderdate + INTERVAL 1 MINUTE * CAST(floor(o_totalprice / 10000) AS INTEGER) AS end_ts, o_totalprice / 100 AS seconds, o_custkey AS discovered,
  CAST(floor(o_totalprice / 1000) AS BIGINT) AS analyzed, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 0 END::BIGINT AS skipped,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE CAST(floor(o_totalprice / 1000) AS BIGINT) END::BIGINT AS failed, o_orderkey FROM orders),
latest AS (SELECT * FROM runs ORDER BY start_ts DESC, run_id DESC LIMIT 1)"""

REPORTS_SQL = f"""reports AS (SELECT o_custkey AS resource_id, o_orderkey AS report_no, upper({SEVERITY_SQL}) AS severity, o_totalprice / 5000 AS confidence,
  'order ' || o_orderkey AS summary, o_orderdate AS detected_at FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)"""

ARCHIVES_SQL = f"""archived AS (SELECT date_trunc('month', o_orderdate) AS archive_ts, o_custkey AS resource_id, {SEVERITY_SQL} AS severity FROM orders
  QUALIFY row_number() OVER (PARTITION BY date_trunc('month', o_orderdate), o_custkey ORDER BY o_orderkey DESC) = 1)"""


def ISO(c):
    return f"strftime({c} + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+05:30'"


def current_reports(spark, sf_dir):
    return A.current_reports(spark, sf_dir).withColumn("severity", F.upper("severity"))


def customer_types(spark, sf_dir):
    """Contexts by customer: type from the market segment, some without a type."""
    kind = (
        F.when(F.col("c_mktsegment") == "BUILDING", "EC2").when(F.col("c_mktsegment") == "MACHINERY", "Load Balancer")
        .when(F.col("c_mktsegment") == "FURNITURE", "").when(F.col("c_mktsegment") == "HOUSEHOLD", "Auto Scaling Group")
    )
    return A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("resource_id"), kind.alias("resource_type"))


TYPES_SQL = """kinds AS (SELECT c_custkey AS resource_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'EC2 Instance' WHEN 'MACHINERY' THEN 'Load Balancer' WHEN 'HOUSEHOLD' THEN 'Auto Scaling Group' END AS type FROM customer)"""


# --- runs -------------------------------------------------------------------------


@query(
    "collector_health",
    """
WITH l AS (SELECT * FROM orders ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) DESC LIMIT 1)
SELECT 'CloudWatch' AS collector, CASE WHEN o_orderstatus = 'F' THEN 'Healthy' ELSE 'Degraded' END AS status FROM l
UNION ALL SELECT 'ALB', CASE WHEN o_orderpriority < '4' THEN 'Healthy' ELSE 'Degraded' END FROM l
UNION ALL SELECT 'AutoScaling', 'Healthy' FROM l UNION ALL SELECT 'CloudTrail', 'Degraded' FROM l""",
)
def collector_health(spark, sf_dir):
    return feed.collector_health(A.runs(spark, sf_dir))


EXECUTION_SQL = f"""SELECT run_id, status, CAST(round_even(seconds, 0) AS BIGINT) AS execution_time, analyzed - failed AS successful, failed, discovered AS resources, analyzed AS resources_analyzed,
  skipped AS resources_skipped, analyzed - failed AS reports_generated, {ISO('start_ts')} AS start_time, {ISO('end_ts')} AS finished_at FROM runs"""


@query("executions_view", f"WITH {RUNS_SQL} {EXECUTION_SQL}")
def executions_view(spark, sf_dir):
    return feed.newest_first(feed.executions(A.runs(spark, sf_dir)), "start_time", "run_id")


@query(
    "latest_execution",
    f"""WITH {RUNS_SQL} SELECT run_id, status, discovered AS resources, analyzed - failed AS successful, failed, CAST(round_even(seconds, 0) AS BIGINT) AS duration_seconds,
  {ISO('start_ts')} AS start_time FROM latest""",
)
def latest_execution(spark, sf_dir):
    return feed.latest_execution(A.runs(spark, sf_dir))


@query(
    "investigation_trend",
    f"WITH {RUNS_SQL} SELECT run_id, strftime(start_ts + INTERVAL 330 MINUTE, '%d %b, %H:%M') AS date, analyzed - failed AS count FROM runs",
)
def investigation_trend(spark, sf_dir):
    return feed.investigation_trend(A.runs(spark, sf_dir)).drop("start_ts")


@query(
    "execution_time_trend",
    f"WITH {RUNS_SQL} SELECT run_id, strftime(start_ts + INTERVAL 330 MINUTE, '%d %b, %H:%M') AS date, seconds AS avg_seconds FROM runs",
)
def execution_time_trend(spark, sf_dir):
    return feed.execution_time_trend(A.runs(spark, sf_dir)).drop("start_ts")


DAILY_SQL = f"""{RUNS_SQL}, daily AS (SELECT CAST(start_ts AS DATE) AS day, count(*) AS runs, CAST(sum(analyzed - failed) AS BIGINT) AS reports, avg(seconds) AS avg_seconds FROM runs GROUP BY ALL)"""


@query("daily_exec", f"WITH {DAILY_SQL} SELECT CAST(day AS VARCHAR) AS day, runs, reports, round(avg_seconds, 9) AS avg_seconds FROM daily")
def daily_exec(spark, sf_dir):
    daily = feed.daily_runs(A.runs(spark, sf_dir))
    return daily.select(F.col("day").cast("string").alias("day"), "runs", "reports", F.round("avg_seconds", 9).alias("avg_seconds"))


@query(
    "kpi_delta",
    f"""WITH {DAILY_SQL} SELECT CAST(day AS VARCHAR) AS day, runs, reports, runs - lag(runs) OVER (ORDER BY day) AS runs_delta, reports - lag(reports) OVER (ORDER BY day) AS reports_delta,
  CASE WHEN lag(day) OVER (ORDER BY day) IS NOT NULL THEN 'from yesterday' END AS delta_label FROM daily""",
)
def kpi_delta(spark, sf_dir):
    deltas = feed.day_over_day(feed.daily_runs(A.runs(spark, sf_dir)), ["runs", "reports"])
    return deltas.withColumn("day", F.col("day").cast("string")).drop("avg_seconds")


@query(
    "collector_stats",
    """
SELECT event_type AS collector, count(*) AS events_processed, count(*) FILTER (value > 100) AS errors, round(avg(value), 6) AS avg_latency_ms FROM events GROUP BY ALL""",
)
def collector_stats(spark, sf_dir):
    calls = A.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("collector"), (F.col("value") > 100).alias("is_error"), F.col("value").alias("latency_ms")
    )
    return feed.collector_statistics(calls).withColumn("avg_latency_ms", F.round("avg_latency_ms", 6))


# --- telemetry --------------------------------------------------------------------


@query(
    "telemetry_dispatch",
    f"""WITH {FLEET_SQL}
SELECT 'EC2' AS resource_type, spine.resource_id, state, c_acctbal AS cpu, NULL::DOUBLE AS http_4xx, NULL::DOUBLE AS http_5xx, NULL::DOUBLE AS healthy_targets, NULL::DOUBLE AS unhealthy_targets,
  NULL::INTEGER AS standby_instances, NULL::DOUBLE AS in_service_instances FROM spine LEFT JOIN states USING (resource_id)
UNION ALL SELECT 'Load Balancer', 'lb-' || o_orderkey, NULL, NULL, CASE WHEN o_orderstatus = 'F' THEN 5.0 ELSE 2.0 END, 1.0, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE 1.0 END,
  CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END, NULL, NULL FROM orders
UNION ALL SELECT 'Auto Scaling Group', s_name, NULL, NULL, NULL, NULL, NULL, NULL, 1, 1.0 FROM supplier""",
)
def telemetry_dispatch(spark, sf_dir):
    rows = feed.telemetry(A.fleet_contexts(spark, sf_dir))
    i, lb, g = F.col("instance_telemetry"), F.col("lb_telemetry"), F.col("asg_telemetry")
    return rows.select(
        "resource_type", "resource_id", i["state"].alias("state"), i["cpu"].alias("cpu"),
        *[lb[n].alias(n) for n in ("http_4xx", "http_5xx", "healthy_targets", "unhealthy_targets")],
        *[g[n].alias(n) for n in ("standby_instances", "in_service_instances")],
    )


@query(
    "lb_rollup",
    """
SELECT r_name AS lb, count(*) FILTER (c_acctbal > 0) AS healthy_targets, count(*) FILTER (c_acctbal <= 0) AS unhealthy_targets
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def lb_rollup(spark, sf_dir):
    """Customers are counted per nation first, so the joins to the fixed nation and region lists move 25 rows."""
    groups = A.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.count_if(F.col("c_acctbal") > 0).alias("healthy_hosts"), F.count_if(F.col("c_acctbal") <= 0).alias("unhealthy_hosts")
    )
    named = groups.join(A.table(spark, sf_dir, "nation"), "n_nationkey").join(
        A.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return feed.lb_rollup(named.withColumnRenamed("r_name", "lb"), "lb")


# --- normalisation ----------------------------------------------------------------


@query(
    "confidence_norm",
    """
SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '4-NOT SPECIFIED' THEN 1.0 ELSE
  CASE WHEN p < 0 THEN 0.0 WHEN p <= 1 THEN p WHEN p <= 100 THEN p / 100 ELSE 1.0 END END AS confidence
FROM (SELECT *, o_totalprice / 2000 - 50 AS p FROM orders)""",
)
def confidence_norm(spark, sf_dir):
    raw = F.when(F.col("o_orderpriority") == "5-LOW", "abc").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "NaN").otherwise(
        (F.col("o_totalprice") / 2000 - 50).cast("string")
    )
    return A.table(spark, sf_dir, "orders").select("o_orderkey", C.unit_confidence(raw).alias("confidence"))


@query("type_labels", f"WITH {TYPES_SQL} SELECT resource_id, type AS label FROM kinds")
def type_labels(spark, sf_dir):
    return customer_types(spark, sf_dir).select("resource_id", C.type_label(F.col("resource_type")).alias("label"))


@query(
    "round_ints",
    """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(round_even(l_quantity / 2, 0) AS BIGINT) END AS whole FROM lineitem""",
)
def round_ints(spark, sf_dir):
    raw = F.when(F.col("l_returnflag") == "R", "n/a").otherwise((F.col("l_quantity") / 2).cast("string"))
    return A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.round_whole(raw).alias("whole"))


# --- reports ----------------------------------------------------------------------


@query("report_enrichment", f"WITH {REPORTS_SQL}, {TYPES_SQL} SELECT r.resource_id, r.severity, k.type AS type_label FROM reports r LEFT JOIN kinds k USING (resource_id)")
def report_enrichment(spark, sf_dir):
    reports = current_reports(spark, sf_dir).select("resource_id", "severity")
    return feed.enrich_reports(reports, customer_types(spark, sf_dir))


@query(
    "asof_run",
    """
SELECT e.event_id, r.event_id AS run_id FROM (SELECT * FROM events WHERE event_type <> 'signup') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') r ON e.ts >= r.ts""",
)
def asof_run(spark, sf_dir):
    events = A.table(spark, sf_dir, "events").select("event_id", "event_type", A.utc("ts").alias("ts"))
    facts = events.filter(F.col("event_type") != "signup").select("event_id", "ts")
    runs = events.filter(F.col("event_type") == "signup").select(F.col("event_id").alias("run_id"), F.col("ts").alias("start_ts"))
    return feed.as_of_join(facts, runs, "ts", "start_ts", "run_id").select("event_id", "run_id")


PREVIOUS_SQL = f"""prev AS (SELECT o_custkey AS resource_id, upper({SEVERITY_SQL}) AS severity FROM orders WHERE o_orderstatus <> 'O'
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)"""


def _previous_state(spark, sf_dir):
    """State of an earlier export: the last report of each customer over orders no longer open."""
    from tidewatch.operators.analyze import latest_reports

    closed = A.table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") != "O").select(
        F.col("o_custkey").alias("resource_id"), F.col("o_orderkey").alias("report_no"), A.severity_of(F.col("o_orderpriority")).alias("severity")
    )
    return feed.state_of(latest_reports(closed, ["resource_id"], ["report_no"]))


@query(
    "severity_state_diff",
    f"""WITH {REPORTS_SQL}, {PREVIOUS_SQL} SELECT r.resource_id, r.severity, p.severity IS NULL AS is_new,
  CASE WHEN {RANK_SQL.format('r.severity')} > {RANK_SQL.format('p.severity')} AND p.severity IS NOT NULL THEN p.severity END AS severity_changed_from
FROM reports r LEFT JOIN prev p USING (resource_id)""",
)
def severity_state_diff(spark, sf_dir):
    reports = current_reports(spark, sf_dir).select("resource_id", "severity")
    return feed.diff_severity(reports, _previous_state(spark, sf_dir))


@query("state_snapshot", f"WITH {REPORTS_SQL} SELECT resource_id, severity FROM reports")
def state_snapshot(spark, sf_dir):
    return feed.state_of(A.current_reports(spark, sf_dir))


@query(
    "report_feed",
    f"""WITH {REPORTS_SQL}, {PREVIOUS_SQL}, {TYPES_SQL}, starts AS (SELECT o_orderdate AS start_ts, max(o_orderkey) AS run_id FROM orders GROUP BY ALL),
linked AS (SELECT r.*, s.run_id FROM reports r ASOF LEFT JOIN starts s ON r.detected_at >= s.start_ts)
SELECT l.resource_id, l.severity, l.summary, strftime(l.detected_at, '%Y-%m-%d %H:%M:%S') AS detected_at, CASE WHEN confidence <= 1 THEN confidence WHEN confidence <= 100 THEN confidence / 100 ELSE 1.0 END AS ai_confidence,
  k.type AS type_label, l.run_id, p.severity IS NULL AS is_new,
  CASE WHEN {RANK_SQL.format('l.severity')} > {RANK_SQL.format('p.severity')} AND p.severity IS NOT NULL THEN p.severity END AS severity_changed_from
FROM linked l LEFT JOIN prev p USING (resource_id) LEFT JOIN kinds k USING (resource_id)""",
)
def report_feed(spark, sf_dir):
    empty = F.array().cast("array<string>")
    reports = A.current_reports(spark, sf_dir).withColumns({"evidence": empty, "recommendations": empty})
    runs = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), A.utc("o_orderdate").alias("start_ts"))
    rows = feed.report_feed(reports, customer_types(spark, sf_dir), runs, _previous_state(spark, sf_dir))
    return rows.select(
        "resource_id", "severity", "summary", A.ts_text("detected_at").alias("detected_at"), "ai_confidence", "type_label", "run_id",
        "is_new", "severity_changed_from",
    )


# --- trends -----------------------------------------------------------------------


@query(
    "severity_trend",
    f"""WITH {ARCHIVES_SQL}, months AS (SELECT DISTINCT date_trunc('month', l_shipdate) AS archive_ts FROM lineitem UNION SELECT archive_ts FROM archived),
c AS (SELECT archive_ts, count(*) FILTER (lower(severity) = 'critical') AS critical, count(*) FILTER (lower(severity) = 'high') AS high,
  count(*) FILTER (lower(severity) = 'medium') AS medium, count(*) FILTER (lower(severity) = 'low') AS low FROM archived GROUP BY ALL)
SELECT strftime(archive_ts, '%Y-%m') AS month, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low
FROM months LEFT JOIN c USING (archive_ts)""",
)
def severity_trend(spark, sf_dir):
    archived = A.archived_reports(spark, sf_dir)
    shipped = A.table(spark, sf_dir, "lineitem").select(F.date_trunc("month", A.utc("l_shipdate")).alias("archive_ts"))
    archives = shipped.distinct().union(archived.select("archive_ts").distinct()).distinct()
    trend = feed.severity_trend(archived, archives)
    return trend.select(F.date_format("archive_ts", "yyyy-MM").alias("month"), *feed.SEVERITIES)


@query(
    "top_affected",
    f"""WITH {ARCHIVES_SQL}, {TYPES_SQL}, c AS (SELECT resource_id, count(*) AS incidents FROM archived GROUP BY ALL ORDER BY incidents DESC, resource_id LIMIT 5)
SELECT resource_id, coalesce(type, '—') AS type, incidents FROM c LEFT JOIN kinds USING (resource_id)""",
)
def top_affected(spark, sf_dir):
    return feed.top_affected(A.archived_reports(spark, sf_dir), customer_types(spark, sf_dir))


@query("distribution", f"WITH {TYPES_SQL} SELECT coalesce(type, 'Unknown') AS type, count(*) AS count FROM kinds GROUP BY ALL")
def distribution(spark, sf_dir):
    return feed.resource_distribution(customer_types(spark, sf_dir))


@query("inventory", f"WITH {TYPES_SQL} SELECT coalesce(type, 'Unknown') AS type, resource_id AS id, resource_id AS label FROM kinds")
def inventory(spark, sf_dir):
    return feed.inventory(customer_types(spark, sf_dir))


# --- KPIs -------------------------------------------------------------------------

TOTALS_SQL = f"""{RUNS_SQL}, {REPORTS_SQL}, t AS (SELECT count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,
  count(*) FILTER (severity IN ('HIGH', 'MEDIUM')) AS warning, count(*) FILTER (severity = 'LOW') AS healthy, count(*) FILTER (severity NOT IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL')) AS odd,
  count(*) AS reported FROM reports)"""


@query(
    "kpis",
    f"""WITH {TOTALS_SQL} SELECT discovered AS total_resources, critical AS critical_issues, high AS high_severity, analyzed - failed AS investigations,
  round((analyzed - failed) / analyzed * 100, 1) AS success_rate FROM latest, t""",
)
def kpis(spark, sf_dir):
    return feed.kpi_row(A.runs(spark, sf_dir), current_reports(spark, sf_dir))


@query("infra_health", f"WITH {TOTALS_SQL} SELECT discovered AS total, healthy, warning, critical, greatest(discovered - reported, 0) + odd AS unknown FROM latest, t")
def infra_health(spark, sf_dir):
    return feed.infrastructure_health(A.runs(spark, sf_dir), current_reports(spark, sf_dir))


@query(
    "recent6",
    f"WITH {REPORTS_SQL} SELECT resource_id, severity, summary FROM reports ORDER BY detected_at DESC, resource_id LIMIT 6",
)
def recent6(spark, sf_dir):
    return feed.recent(current_reports(spark, sf_dir)).select("resource_id", "severity", "summary")


@query(
    "signal_kpis",
    f"""WITH {SCORE_SQL}, w AS (SELECT resource_id, max(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS r FROM scored GROUP BY ALL)
SELECT count(*) FILTER (r = 4) AS critical, count(*) FILTER (r IN (2, 3)) AS warning, count(*) FILTER (r = 1) AS healthy, count(*) AS resources FROM w""",
)
def signal_kpis(spark, sf_dir):
    """Health counts straight from the rule severities."""
    from tidewatch.operators.signals import resource_severity

    worst = resource_severity(scored_series(spark, sf_dir))
    return worst.agg(
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.count_if(F.col("severity").isin("HIGH", "MEDIUM")).alias("warning"),
        F.count_if(F.col("severity") == "LOW").alias("healthy"),
        F.count(F.lit(1)).alias("resources"),
    )


# --- tree -------------------------------------------------------------------------


@query(
    "tree_flat",
    f"""WITH m AS (SELECT r_name AS lb, n_name AS tg, c_name AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 4 WHEN 'MACHINERY' THEN 3 WHEN 'HOUSEHOLD' THEN 2 WHEN 'FURNITURE' THEN 1 ELSE 0 END AS r
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT lb, tg, max(r) AS r, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT 0::INTEGER AS level, lb AS node_id, 'Load Balancer' AS node_type, NULL AS parent_id, max(r) AS r, count(*) AS child_count FROM g GROUP BY lb
  UNION ALL SELECT 1, tg, 'Target Group', lb, r, n FROM g UNION ALL SELECT 2, id, 'EC2 Instance', tg, r, 0 FROM m)
SELECT level, node_id, node_type, parent_id, CASE r WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' ELSE 'UNKNOWN' END AS status, child_count FROM f""",
)
def tree_flat(spark, sf_dir):
    segment = F.col("c_mktsegment")
    severity = (
        F.when(segment == "BUILDING", "CRITICAL").when(segment == "MACHINERY", "HIGH").when(segment == "HOUSEHOLD", "MEDIUM").when(segment == "FURNITURE", "LOW")
    )
    members = (
        A.table(spark, sf_dir, "customer")
        .join(A.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(A.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("r_name").alias("lb"), F.col("n_name").alias("target_group"), F.col("c_name").alias("instance_id"), severity.alias("severity"))
    )
    return feed.resource_tree(members)


@query(
    "feed_analytics",
    f"""WITH {RUNS_SQL}, {ARCHIVES_SQL}, {TYPES_SQL}, months AS (SELECT DISTINCT archive_ts FROM archived)
SELECT 'incident_trend' AS section, run_id AS item, CAST(NULL AS BIGINT) AS count FROM runs
UNION ALL SELECT 'execution_time_trend', run_id, NULL FROM runs
UNION ALL SELECT 'severity_trend', strftime(archive_ts, '%Y-%m-%d'), NULL FROM months
UNION ALL SELECT 'resource_distribution', coalesce(type, 'Unknown'), count(*) FROM kinds GROUP BY ALL""",
)
def feed_analytics(spark, sf_dir):
    """The four trends published as one table and read back by its contract."""
    from tidewatch.session import scratch_path
    from tidewatch.sources import readers, writers

    runs = A.runs(spark, sf_dir).withColumn("reports_generated", F.lit(0).cast("bigint"))
    archived = A.archived_reports(spark, sf_dir)
    trend = feed.severity_trend(archived, archived.select("archive_ts").distinct())
    parts = (feed.investigation_trend(runs), trend, feed.resource_distribution(customer_types(spark, sf_dir)), feed.execution_time_trend(runs))
    base = scratch_path(spark, "analytics")
    writers.publish({"analytics": feed.analytics(*parts)}, base, 1)
    rows = readers.read_feed_table(spark, writers.published_path(base, 1, "analytics"), "analytics")
    item = F.when(F.col("section") == "severity_trend", F.date_format("at", "yyyy-MM-dd")).otherwise(F.coalesce("run_id", "type"))
    count = F.when(F.col("section") == "resource_distribution", F.col("count"))
    return rows.select("section", item.alias("item"), count.alias("count"))


@query(
    "distribution_order",
    f"WITH {TYPES_SQL}, n AS (SELECT coalesce(type, 'Unknown') AS type, count(*) AS count FROM kinds GROUP BY ALL) SELECT type, count, row_number() OVER (ORDER BY count DESC, type)::INTEGER AS position FROM n",
)
def distribution_order(spark, sf_dir):
    """The types as a chart lists them; there are as many rows as types."""
    rows = feed.resource_distribution(customer_types(spark, sf_dir)).collect()
    return spark.createDataFrame([(r["type"], r["count"], i + 1) for i, r in enumerate(rows)], "type string, count long, position int")


def _label(c):
    return f"strftime({c} + INTERVAL 330 MINUTE, '%d %b, %H:%M')"


@query(
    "feed_export",
    f"""WITH {TOTALS_SQL}, {ARCHIVES_SQL},
s AS (SELECT archive_ts, count(*) FILTER (lower(severity) = 'critical') AS critical, count(*) FILTER (lower(severity) = 'high') AS high,
  count(*) FILTER (lower(severity) = 'medium') AS medium, count(*) FILTER (lower(severity) = 'low') AS low FROM archived GROUP BY ALL),
top AS (SELECT resource_id, count(*) AS incidents FROM archived GROUP BY ALL ORDER BY incidents DESC, resource_id LIMIT 5),
recent AS (SELECT resource_id, summary FROM reports ORDER BY detected_at DESC, resource_id LIMIT 6)
SELECT 'summary' AS part, unnest(['total_resources', 'critical_issues', 'high_severity', 'investigations', 'success_rate']) AS item,
  unnest([discovered, critical, high, analyzed - failed, round((analyzed - failed) / analyzed * 100, 1)])::DOUBLE AS value, CAST(NULL AS VARCHAR) AS label FROM latest, t
UNION ALL SELECT 'health', unnest(['total', 'healthy', 'warning', 'critical', 'unknown']), unnest([discovered, healthy, warning, critical, greatest(discovered - reported, 0) + odd])::DOUBLE, NULL FROM latest, t
UNION ALL SELECT 'latest', run_id, seconds_int::DOUBLE, status FROM (SELECT run_id, status, round_even(seconds, 0)::BIGINT AS seconds_int FROM latest)
UNION ALL SELECT 'incident_trend', run_id, (analyzed - failed)::DOUBLE, {_label('start_ts')} FROM runs
UNION ALL SELECT 'execution_time_trend', run_id, seconds, {_label('start_ts')} FROM runs
UNION ALL SELECT 'severity_trend ' || unnest(['critical', 'high', 'medium', 'low']), strftime(archive_ts, '%Y-%m'), unnest([critical, high, medium, low])::DOUBLE, {_label('archive_ts')} FROM s
UNION ALL SELECT 'top', CAST(resource_id AS VARCHAR), incidents::DOUBLE, '—' FROM top
UNION ALL SELECT 'recent', CAST(resource_id AS VARCHAR), NULL, summary FROM recent
UNION ALL SELECT 'reports', severity, count(*)::DOUBLE, NULL FROM reports GROUP BY severity
UNION ALL SELECT 'state', severity, count(*)::DOUBLE, NULL FROM reports GROUP BY severity""",
)
def feed_export(spark, sf_dir):
    """The whole export published as one version and read back: every table with its values, dates and labels."""
    from tidewatch.plans import investigation
    from tidewatch.session import scratch_path
    from tidewatch.sources import writers

    base = scratch_path(spark, "export")
    named = lambda df: df.withColumn("resource_id", F.col("resource_id").cast("string"))
    reports = named(A.current_reports(spark, sf_dir)).withColumns(
        {"recommendations": F.array().cast("array<string>"), "evidence": F.array().cast("array<string>"), "raw_response": F.lit(None).cast("string")}
    )
    investigation.export_feed(
        base, 1, runs=A.runs(spark, sf_dir), reports=reports, contexts=A.fleet_contexts(spark, sf_dir), archived=named(A.archived_reports(spark, sf_dir)).select("archive_ts", "resource_id", "severity")
    )
    of = lambda name: writers.read_published(spark, base, name)
    none, text, number = F.lit(None).cast("string"), lambda c: F.col(c).cast("string"), lambda c: F.col(c).cast("double")

    def rows(df, part, item, value, label=none):
        return df.select((F.lit(part) if isinstance(part, str) else part).alias("part"), item.alias("item"), value.alias("value"), label.alias("label"))

    health, trends = of("infrastructure_health"), of("analytics")
    parts = [
        rows(of("summary"), "summary", F.col("kpi"), F.col("value")),
        rows(health.select(F.inline(F.array(*[F.struct(F.lit(c).alias("k"), number(c).alias("v")) for c in health.columns]))), "health", F.col("k"), F.col("v")),
        rows(of("latest_execution"), "latest", F.col("run_id"), number("duration_seconds"), F.col("status")),
        rows(trends.where("section = 'incident_trend'"), "incident_trend", F.col("run_id"), number("count"), F.col("date")),
        rows(trends.where("section = 'execution_time_trend'"), "execution_time_trend", F.col("run_id"), F.col("avg_seconds"), F.col("date")),
        rows(
            trends.where("section = 'severity_trend'").select("at", "date", F.inline(F.array(*[F.struct(F.lit(s).alias("s"), number(s).alias("n")) for s in feed.SEVERITIES]))),
            F.concat(F.lit("severity_trend "), "s"), F.date_format("at", "yyyy-MM"), F.col("n"), F.col("date"),
        ),
        rows(of("top_affected"), "top", F.col("resource_id"), number("incidents"), F.col("type")),
        rows(of("recent"), "recent", F.col("resource_id"), F.lit(None).cast("double"), F.col("summary")),
        rows(of("reports").groupBy("severity").count(), "reports", F.col("severity"), number("count")),
        rows(of("state").groupBy("severity").count(), "state", F.col("severity"), number("count")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
