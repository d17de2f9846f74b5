"""Metric windows, alarms and thresholds over the driver's tables."""

from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators import metrics, thresholds
from tidewatch.plans import adapters as A
from tidewatch.plans.registry import query
from tidewatch.schemas import METRIC_CATALOG, SNAPSHOT_LOOKBACK_MINUTES, TREND_LOOKBACK_MINUTES
from tidewatch.session import scratch_path
from tidewatch.sources import datapoints

STATS_SQL = "stats(metric, statistic, unit) AS (VALUES " + ", ".join(str(r) for r in A.STATISTIC_ROWS) + ")"
THRESHOLDS_SQL = (
    "th AS (SELECT metric, op, threshold::DOUBLE AS threshold FROM (VALUES "
    + ", ".join(str(r) for r in A.THRESHOLD_ROWS) + ") v(metric, op, threshold))"
)
BREACH_SQL = """coalesce(CASE op WHEN 'GT' THEN value > threshold WHEN 'GTE' THEN value >= threshold
  WHEN 'LT' THEN value < threshold WHEN 'LTE' THEN value <= threshold END, false)"""
BINS_SQL = """bins AS (SELECT user_id AS resource_id, event_type AS metric, time_bucket(INTERVAL 5 MINUTE, ts) AS ts,
  sum(value) AS value, count(*) AS samples FROM events GROUP BY ALL)"""


def with_statistic(spark, points):
    return points.join(A.statistics_table(spark), "metric")


@query(
    "metric_5m_stats",
    f"""
WITH {STATS_SQL}
SELECT metric, unit, strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS bin,
  round(CASE any_value(statistic) WHEN 'Sum' THEN sum(value) WHEN 'Maximum' THEN max(value) ELSE avg(value) END, 6) AS value,
  count(*) AS samples
FROM events JOIN stats ON event_type = metric GROUP BY metric, unit, bin""",
)
def metric_5m_stats(spark, sf_dir):
    points = with_statistic(spark, A.datapoints(spark, sf_dir))
    binned = metrics.period_statistic(points, ["metric", "unit"])
    return binned.select("metric", "unit", A.ts_text("ts").alias("bin"), F.round("value", 6).alias("value"), "samples")


@query(
    "catalog_join",
    f"""
WITH {STATS_SQL}
SELECT metric, statistic, unit, count(*) AS points FROM events JOIN stats ON event_type = metric GROUP BY ALL""",
)
def catalog_join(spark, sf_dir):
    catalog = A.statistics_table(spark).withColumns({"resource_type": F.lit("user"), "namespace": F.lit("app")})
    points = A.datapoints(spark, sf_dir).withColumns(
        {"resource_type": F.lit("user"), "namespace": F.lit("app"), "statistic": F.lit(""), "unit": F.lit("")}
    )
    return metrics.with_catalog(points, catalog).groupBy("metric", "statistic", "unit").agg(F.count(F.lit(1)).alias("points"))


CATALOG_SQL = "catalog(resource_type, metric_key, namespace, metric, statistic, unit, tracked) AS (VALUES " + ", ".join(
    "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in METRIC_CATALOG
) + ")"


@query(
    "catalog_rows",
    f"""
WITH {CATALOG_SQL}, c AS (SELECT *, row_number() OVER () - 1 AS i FROM catalog)
SELECT resource_type, metric_key, statistic, unit, tracked, count(*) AS points, round(CASE statistic WHEN 'Sum' THEN sum(value) WHEN 'Maximum' THEN max(value) ELSE avg(value) END, 4) AS value
FROM events JOIN c ON event_id % {len(METRIC_CATALOG) + 1} = i GROUP BY resource_type, metric_key, statistic, unit, tracked""",
)
def catalog_rows(spark, sf_dir):
    """Datapoints dealt over all metrics of the catalog, and some of a metric that it does not know."""
    known = [F.struct(F.lit(r[0]).alias("resource_type"), F.lit(r[2]).alias("namespace"), F.lit(r[3]).alias("metric")) for r in METRIC_CATALOG]
    unknown = F.struct(F.lit("EC2").alias("resource_type"), F.lit("AWS/EC2").alias("namespace"), F.lit("NotTracked").alias("metric"))
    at = F.element_at(F.array(*known, unknown), (F.col("event_id") % (len(known) + 1) + 1).cast("int"))
    points = A.datapoints(spark, sf_dir).select(at.alias("m"), "value", F.lit("").alias("statistic"), F.lit("").alias("unit")).select("m.*", "value", "statistic", "unit")
    joined = metrics.with_catalog(points, metrics.metric_catalog(spark))
    value = F.when(F.col("statistic") == "Sum", F.sum("value")).when(F.col("statistic") == "Maximum", F.max("value")).otherwise(F.avg("value"))
    return joined.groupBy("resource_type", "metric_key", "statistic", "unit", "tracked").agg(F.count("*").alias("points"), F.round(value, 4).alias("value"))


@query(
    "history_window",
    f"""
WITH {THRESHOLDS_SQL}, w AS (SELECT * FROM events WHERE ts BETWEEN (SELECT max(ts) FROM events) - INTERVAL {TREND_LOOKBACK_MINUTES} MINUTE AND (SELECT max(ts) FROM events)),
b AS (SELECT user_id AS resource_id, event_type AS metric, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, CAST(round(sum(value), 2) AS DECIMAL(18, 2)) AS value FROM w GROUP BY ALL)
SELECT resource_id, metric, any_value(op) AS op, count(*) AS points, string_agg(strftime(ts + INTERVAL 330 MINUTE, '%H:%M') || '=' || CAST(value AS VARCHAR), ' ' ORDER BY ts) AS history
FROM b LEFT JOIN th USING (metric) GROUP BY resource_id, metric""",
)
def history_window(spark, sf_dir):
    """The payloads of the lookback out of the store by day: a list holds the periods of an hour, whatever is stored."""
    path, keys = scratch_path(spark, "datapoints"), ["resource_id", "metric"]
    datapoints.write_datapoints(A.datapoints(spark, sf_dir), path)
    window = datapoints.read_window(spark, path, datapoints.newest(spark, path), TREND_LOOKBACK_MINUTES)
    binned = metrics.period_statistic(window, keys, statistic=F.lit("Sum"))
    series = thresholds.attach_thresholds(binned, A.thresholds_table(spark), ["metric"]).withColumn("unit", F.lit("Count"))
    point = F.transform("payload.H", lambda p: F.concat_ws("=", p["label"], p["value"].cast("decimal(18,2)").cast("string")))
    return metrics.history_payload(series, keys).select(
        *keys, F.col("payload.TH.OP").alias("op"), F.size("payload.H").cast("bigint").alias("points"), F.array_join(point, " ").alias("history")
    )


@query(
    "lookback_trend",
    f"""
SELECT event_id, user_id AS resource_id, event_type AS metric, value FROM events
WHERE ts BETWEEN (SELECT max(ts) FROM events) - INTERVAL {TREND_LOOKBACK_MINUTES} MINUTE AND (SELECT max(ts) FROM events)""",
)
def lookback_trend(spark, sf_dir):
    """The last hour out of a store by day: of all its days one or two are read, also to find the newest time."""
    path = scratch_path(spark, "datapoints")
    datapoints.write_datapoints(A.datapoints(spark, sf_dir), path)
    window = datapoints.read_window(spark, path, datapoints.newest(spark, path), TREND_LOOKBACK_MINUTES)
    return window.select("event_id", "resource_id", "metric", "value")


@query(
    "latest_or_zero",
    f"""
WITH s AS (SELECT DISTINCT user_id AS resource_id, event_type AS metric FROM events),
b AS (SELECT user_id AS resource_id, event_type AS metric, time_bucket(INTERVAL 5 MINUTE, ts) AS bin, round(sum(value), 2) AS v
  FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL {SNAPSHOT_LOOKBACK_MINUTES} MINUTE GROUP BY ALL)
SELECT s.resource_id, s.metric, coalesce(arg_max(v, bin), 0.0) AS latest
FROM s LEFT JOIN b USING (resource_id, metric) GROUP BY ALL""",
)
def latest_or_zero(spark, sf_dir):
    keys = ["resource_id", "metric"]
    series = A.datapoints(spark, sf_dir).select(*keys).distinct()
    recent = metrics.lookback(A.table(spark, sf_dir, "events"), A.as_of(spark, sf_dir), SNAPSHOT_LOOKBACK_MINUTES)
    points = recent.select(F.col("user_id").alias("resource_id"), F.col("event_type").alias("metric"), A.utc("ts").alias("ts"), "value")
    return metrics.latest_or_zero(series, metrics.period_statistic(points, keys, statistic=F.lit("Sum")), keys)


@query(
    "latest_value",
    f"""
WITH {BINS_SQL}
SELECT resource_id, metric, round(arg_max(value, ts), 2) AS latest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest_ts
FROM bins GROUP BY ALL""",
)
def latest_value(spark, sf_dir):
    keys = ["resource_id", "metric"]
    binned = metrics.period_statistic(A.datapoints(spark, sf_dir), keys, statistic=F.lit("Sum"))
    return metrics.latest_value(binned, keys).withColumn("latest_ts", A.ts_text("latest_ts"))


def _payloads(spark, sf_dir):
    keys = ["resource_id", "metric"]
    points = with_statistic(spark, A.datapoints(spark, sf_dir)).drop("statistic")
    binned = metrics.period_statistic(points, [*keys, "unit"], 3600, F.lit("Sum"))
    series = thresholds.attach_thresholds(binned, A.thresholds_table(spark), ["metric"])
    return metrics.history_payload(series, keys)


HOURLY_SQL = """hourly AS (SELECT user_id AS resource_id, event_type AS metric, date_trunc('hour', ts) AS ts,
  CAST(round(sum(value), 2) AS DECIMAL(18, 2)) AS value FROM events GROUP BY ALL)"""


@query(
    "metric_history",
    f"""
WITH {HOURLY_SQL}
SELECT resource_id, metric, count(*) AS points,
  string_agg(strftime(ts + INTERVAL 330 MINUTE, '%H:%M') || '=' || CAST(value AS VARCHAR), ' ' ORDER BY ts) AS history
FROM hourly GROUP BY ALL""",
)
def metric_history(spark, sf_dir):
    point = F.transform("payload.H", lambda p: F.concat_ws("=", p["label"], p["value"].cast("decimal(18,2)").cast("string")))
    return _payloads(spark, sf_dir).select(
        "resource_id", "metric", F.size("payload.H").cast("bigint").alias("points"), F.array_join(point, " ").alias("history")
    )


@query(
    "metric_payload_map",
    f"""
WITH {STATS_SQL}, {THRESHOLDS_SQL}, {HOURLY_SQL},
p AS (SELECT resource_id, metric, any_value(unit) AS unit, any_value(op) AS op, count(*) AS n
  FROM hourly JOIN stats USING (metric) LEFT JOIN th USING (metric) GROUP BY ALL)
SELECT resource_id, string_agg(metric || ':' || unit || ':' || op || ':' || n, ',' ORDER BY metric) AS trends FROM p GROUP BY ALL""",
)
def metric_payload_map(spark, sf_dir):
    trends = metrics.metric_map(_payloads(spark, sf_dir), ["resource_id"])
    text = F.transform(
        F.array_sort(F.map_entries("trends")),
        lambda e: F.concat_ws(":", e["key"], e["value"]["U"], e["value"]["TH"]["OP"], F.size(e["value"]["H"]).cast("string")),
    )
    return trends.select("resource_id", F.array_join(text, ",").alias("trends"))


@query(
    "snapshot_pivot",
    f"""
WITH {BINS_SQL}, l AS (SELECT resource_id, metric, round(arg_max(value, ts), 2) AS v FROM bins GROUP BY ALL)
SELECT resource_id, max(CASE metric WHEN 'click' THEN v END) AS click, max(CASE metric WHEN 'error' THEN v END) AS error,
  max(CASE metric WHEN 'purchase' THEN v END) AS purchase, max(CASE metric WHEN 'signup' THEN v END) AS signup, max(CASE metric WHEN 'view' THEN v END) AS view FROM l GROUP BY ALL""",
)
def snapshot_pivot(spark, sf_dir):
    keys = ["resource_id", "metric"]
    binned = metrics.period_statistic(A.datapoints(spark, sf_dir), keys, statistic=F.lit("Sum"))
    return metrics.snapshot_pivot(metrics.latest_value(binned, keys), "resource_id", ["click", "error", "purchase", "signup", "view"])


@query(
    "status_labels",
    """
SELECT o_orderkey, CASE WHEN v IS NULL THEN 'UNKNOWN' WHEN v = 0 THEN 'PASS' ELSE 'FAILED' END AS status_check
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS v FROM orders)""",
)
def status_labels(spark, sf_dir):
    latest = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1)
    return A.table(spark, sf_dir, "orders").select("o_orderkey", C.status_check_label(latest).alias("status_check"))


@query(
    "zero_fill",
    """
SELECT o_orderkey, coalesce(CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 END, 0) AS requests FROM orders""",
)
def zero_fill(spark, sf_dir):
    some = F.when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderstatus") == "O", 1)
    return metrics.zero_fill(A.table(spark, sf_dir, "orders").select("o_orderkey", some.alias("requests")), ["requests"])


@query(
    "root_disk_series",
    """
WITH inst AS (SELECT DISTINCT p_brand AS resource_id FROM part UNION ALL SELECT r_name FROM region),
f AS (SELECT p_brand AS resource_id, arg_min(p_name, p_partkey) AS device FROM part WHERE p_type = 'SMALL' GROUP BY ALL)
SELECT resource_id, device, CASE WHEN device IS NULL THEN 'CWAgent Not Installed' END AS disk_status
FROM inst LEFT JOIN f USING (resource_id)""",
)
def root_disk_series(spark, sf_dir):
    def dim(name, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    part = A.table(spark, sf_dir, "part")
    series = part.select(
        F.array(
            dim("InstanceId", F.col("p_brand")),
            dim("device", F.col("p_name")),
            dim("path", F.when(F.col("p_type") == "SMALL", "/").otherwise("/data")),
        ).alias("dims"),
        F.col("p_partkey").alias("ord"),
    )
    instances = part.select(F.col("p_brand").alias("resource_id")).distinct().union(A.table(spark, sf_dir, "region").select("r_name"))
    found = metrics.root_disk_series(series, instances)
    device = F.filter("disk_dims", lambda d: d["name"] == "device")[0]["value"]
    return found.select("resource_id", device.alias("device"), "disk_status")


@query(
    "name_tags",
    """
SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN c_name WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'No Name' END AS name
FROM customer""",
)
def name_tags(spark, sf_dir):
    def tag(key, value):
        return F.struct(key.alias("Key"), F.col(value).alias("Value"))

    balance = F.col("c_acctbal")
    tags = F.array(
        tag(F.lit("Segment"), "c_mktsegment"),
        tag(F.when(balance > 0, "Name").otherwise("Other"), "c_mktsegment"),
        tag(F.when(balance > 5000, "Name").otherwise("Tier"), "c_name"),
    )
    return A.table(spark, sf_dir, "customer").select("c_custkey", metrics.name_tag(tags).alias("name"))


@query(
    "reservation_unnest",
    """
SELECT 'o' || o_orderkey AS resource_id, o_orderpriority AS name, o_orderstatus AS state, 'N/A' AS private_ip, o_orderpriority AS public_ip FROM orders
UNION ALL
SELECT 'c' || o_custkey, 'No Name', o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'N/A' END, 'N/A' FROM orders""",
)
def reservation_unnest(spark, sf_dir):
    none = F.lit(None).cast("string")
    priority, status = F.col("o_orderpriority"), F.struct(F.col("o_orderstatus").alias("Name"))
    tags = F.array(F.struct(F.lit("Name").alias("Key"), priority.alias("Value")))

    def instance(id_, state, private, public, tag_list):
        return F.struct(
            id_.alias("InstanceId"), state.alias("State"), private.alias("PrivateIpAddress"),
            public.alias("PublicIpAddress"), tag_list.alias("Tags"),
        )

    first = instance(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), status, none, priority, tags)
    second = instance(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")), status,
        F.when(F.col("o_orderstatus") == "F", priority), none, F.filter(tags, lambda t: F.lit(False)),
    )
    described = A.table(spark, sf_dir, "orders").select(
        F.array(F.struct(F.array(first).alias("Instances")), F.struct(F.array(second).alias("Instances"))).alias("Reservations")
    )
    return metrics.unnest_reservations(described)


@query("application_only", "SELECT p_partkey, p_name FROM part WHERE p_type = 'STANDARD'")
def application_only(spark, sf_dir):
    part = A.table(spark, sf_dir, "part").withColumn("Type", F.when(F.col("p_type") == "STANDARD", "application").otherwise("network"))
    return metrics.application_only(part).select("p_partkey", "p_name")


@query(
    "arn_dimensions",
    """
SELECT page_id, CASE WHEN url LIKE 'https%' THEN split_part(url, '//', 2) END AS lb_dimension,
  CASE WHEN url LIKE 'http:%' THEN 'targetgroup/' || split_part(url, '//', 2) END AS tg_dimension FROM pages""",
)
def arn_dimensions(spark, sf_dir):
    pages = A.table(spark, sf_dir, "pages").select(
        "page_id",
        F.replace("url", F.lit("https://"), F.lit("arn:x:loadbalancer/")).alias("lb_arn"),
        F.replace("url", F.lit("http://"), F.lit("arn:x:targetgroup/")).alias("tg_arn"),
    )
    return metrics.with_lb_dimensions(pages).select("page_id", "lb_dimension", "tg_dimension")


ALARMS_SQL = """alarms AS (SELECT p_name AS alarm_name, p_brand AS namespace, p_type AS metric, p_type || '|' || split_part(p_name, ' ', 1) AS dims,
  CASE WHEN p_retailprice <= 1050 THEN p_retailprice END AS threshold,
  CASE WHEN p_size < 10 THEN 'GT' WHEN p_size < 20 THEN 'GTE' WHEN p_size < 30 THEN 'LT' WHEN p_size < 40 THEN 'LTE' END AS op,
  CASE WHEN p_size < 5 THEN 'ALARM' ELSE 'OK' END AS state, p_partkey AS ord
  FROM part WHERE p_type <> 'PROMO' AND p_size <= 45)"""


def _dims_text():
    by_name = F.map_from_entries("dim_key")
    return F.concat_ws("|", by_name["tier"], by_name["color"]).alias("dims")


@query("alarm_parse", f"WITH {ALARMS_SQL} SELECT ord, alarm_name, namespace, metric, dims, threshold, op FROM alarms")
def alarm_parse(spark, sf_dir):
    parsed = thresholds.parse_alarms(A.raw_alarms(spark, sf_dir))
    return parsed.select("ord", "alarm_name", "namespace", "metric", _dims_text(), "threshold", "op")


@query(
    "alarm_list",
    f"""WITH {ALARMS_SQL} SELECT alarm_name AS "AlarmName", metric AS "Metric", namespace AS "Namespace", state AS "State", namespace AS "Reason" FROM alarms""",
)
def alarm_list(spark, sf_dir):
    return thresholds.list_alarms(thresholds.parse_alarms(A.raw_alarms(spark, sf_dir)))


LAST_ALARM_SQL = f"""{ALARMS_SQL},
last AS (SELECT * FROM alarms QUALIFY row_number() OVER (PARTITION BY namespace, metric, dims ORDER BY ord DESC) = 1)"""


@query("alarm_last_wins", f"WITH {LAST_ALARM_SQL} SELECT namespace, metric, dims, alarm_name, threshold, op FROM last")
def alarm_last_wins(spark, sf_dir):
    index = thresholds.alarm_index(thresholds.parse_alarms(A.raw_alarms(spark, sf_dir)))
    return index.select("namespace", "metric", _dims_text(), "alarm_name", "threshold", "op")


@query(
    "threshold_lookup",
    f"""
WITH {LAST_ALARM_SQL}, s AS (SELECT p_partkey, p_brand AS namespace, p_type AS metric, p_type || '|' || split_part(p_name, ' ', 1) AS dims, p_retailprice AS value FROM part),
j AS (SELECT p_partkey, value, last.threshold, last.op FROM s LEFT JOIN last ON s.namespace = last.namespace AND s.metric = last.metric AND s.dims = last.dims
  AND last.threshold IS NOT NULL AND last.op IS NOT NULL)
SELECT p_partkey, threshold, op, {BREACH_SQL} AS breach FROM j""",
)
def threshold_lookup(spark, sf_dir):
    index = thresholds.alarm_index(thresholds.parse_alarms(A.raw_alarms(spark, sf_dir)))

    def dim(name, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    dims = F.array(dim("color", F.split("p_name", " ")[0]), dim("tier", F.col("p_type")))
    series = A.table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_brand").alias("namespace"), F.col("p_type").alias("metric"),
        C.dims_key(dims).alias("dim_key"), F.col("p_retailprice").alias("value"),
    )
    return thresholds.flag_breaches(thresholds.attach_thresholds(series, index)).select("p_partkey", "threshold", "op", "breach")


@query(
    "threshold_breach",
    f"""
WITH {THRESHOLDS_SQL}, j AS (SELECT user_id, event_type AS metric, value, op, threshold FROM events LEFT JOIN th ON event_type = metric)
SELECT user_id AS resource_id, metric, count(*) AS points, count(*) FILTER ({BREACH_SQL}) AS breaches FROM j GROUP BY ALL""",
)
def threshold_breach(spark, sf_dir):
    joined = thresholds.attach_thresholds(A.datapoints(spark, sf_dir), A.thresholds_table(spark), ["metric"])
    return thresholds.flag_breaches(joined).groupBy("resource_id", "metric").agg(
        F.count(F.lit(1)).alias("points"), F.count_if("breach").alias("breaches")
    )
