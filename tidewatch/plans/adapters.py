"""The driver's tables in the shape of the domain tables.

Every adapter reads whole tables. Nested sources are built row by row, so preparing them
needs no grouping.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.bounded import literal_rows
from tidewatch.operators import metrics, thresholds
from tidewatch.schemas import PAYLOAD_JSON

# Alarm thresholds of the five event types, for daily sums.
THRESHOLD_ROWS = [
    ("click", "GT", 60.0),
    ("error", "GTE", 45.0),
    ("purchase", "GT", 90.0),
    ("signup", "LT", 20.0),
    ("view", "LTE", 15.0),
]
# Statistic and unit of the five event types.
STATISTIC_ROWS = [
    ("click", "Sum", "Count"),
    ("error", "Maximum", "Count"),
    ("purchase", "Sum", "Count"),
    ("signup", "Average", "Seconds"),
    ("view", "Average", "Seconds"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc(name: str) -> Column:
    return F.col(name).cast("timestamp")


def ts_text(col: Column | str) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def customer_name(key: Column) -> Column:
    return F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0"))


def thresholds_table(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, "metric string, op string, threshold double", THRESHOLD_ROWS)


def statistics_table(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, "metric string, statistic string, unit string", STATISTIC_ROWS)


def datapoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("resource_id"), F.col("event_type").alias("metric"), utc("ts").alias("ts"), "value", "event_id"
    )


def as_of(spark: SparkSession, sf_dir: str) -> dt.datetime:
    """Newest event time, from a scan of that column; a job is given this value."""
    return table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(resource_id, metric, ts = day, value = daily sum, op, threshold)."""
    keys = ["resource_id", "metric"]
    binned = metrics.period_statistic(datapoints(spark, sf_dir), keys, 86400, F.lit("Sum"))
    rounded = binned.withColumn("value", F.round("value", 2))
    return thresholds.attach_thresholds(rounded, thresholds_table(spark), ["metric"])


def raw_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarm definitions out of ``part``: some without a namespace or metric, some with a band operator."""
    def pair(name, value):
        return F.struct(F.lit(name).alias("Name"), value.alias("Value"))

    color = F.split("p_name", " ")[0]
    tier, shade = pair("tier", F.col("p_type")), pair("color", color)
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_name").alias("AlarmName"),
        F.when(F.col("p_type") != "PROMO", F.col("p_brand")).alias("Namespace"),
        F.when(size <= 45, F.col("p_type")).alias("MetricName"),
        F.when(size < 10, "GreaterThanThreshold")
        .when(size < 20, "GreaterThanOrEqualToThreshold")
        .when(size < 30, "LessThanThreshold")
        .when(size < 40, "LessThanOrEqualToThreshold")
        .otherwise("LessThanLowerOrGreaterThanUpperThreshold")
        .alias("ComparisonOperator"),
        F.when(F.col("p_retailprice") <= 1050, F.col("p_retailprice")).alias("Threshold"),
        F.when(size < 25, F.array(tier, shade)).otherwise(F.array(shade, tier, shade)).alias("Dimensions"),
        F.when(size < 5, "ALARM").otherwise("OK").alias("StateValue"),
        F.col("p_brand").alias("StateReason"),
        F.col("p_partkey").alias("ord"),
    )


# --- fleet: customers are instances, orders load balancers, suppliers scaling groups, events audit events


def fleet_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    sample = F.array(F.array(F.lit("10:00"), F.lit("1.5")), F.array(F.lit("10:05"), F.col("c_nationkey").cast("string")))
    cpu = F.struct(
        F.lit("%").alias("U"),
        F.when(balance > 5000, F.struct(F.lit(80.0).alias("V"), F.lit("GT").alias("OP"))).alias("TH"),
        sample.alias("H"),
    ).cast(PAYLOAD_JSON)
    return table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("Name"),
        F.col("c_name").alias("InstanceId"),
        F.when(F.col("c_mktsegment") == "BUILDING", " Running ")
        .when(F.col("c_mktsegment") == "MACHINERY", "stopped")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "terminated")
        .when(F.col("c_mktsegment") == "FURNITURE", "shutting-down")
        .alias("State"),
        F.concat(F.lit("10.0.0."), F.col("c_nationkey").cast("string")).alias("PrivateIP"),
        F.lit("N/A").alias("PublicIP"),
        balance.alias("CPU"),
        F.lit(None).cast("double").alias("Memory"),
        F.lit("CWAgent Not Installed").alias("Disk"),
        balance.alias("NetworkIn"),
        balance.alias("NetworkOut"),
        F.lit("PASS").alias("StatusCheck"),
        F.when(balance > 0, F.create_map(F.lit("CPU"), cpu)).alias("MetricTrends"),
        F.col("c_custkey").alias("ord"),
    )


def fleet_load_balancers(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    target = F.struct(
        customer_name(F.col("o_custkey")).alias("instance_id"),
        F.lit(80).alias("port"),
        F.when(F.col("o_orderstatus") == "F", "unhealthy").otherwise("healthy").alias("health"),
        F.col("o_orderpriority").alias("reason"),
        F.lit("").alias("description"),
    )
    group = F.struct(
        F.col("o_orderpriority").alias("target_group_name"),
        F.lit("HTTP").alias("protocol"),
        F.lit(80).alias("port"),
        F.lit("/").alias("health_check_path"),
        F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(1.0).alias("healthy_hosts"),
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(F.lit(None).cast("double")).alias("unhealthy_hosts"),
        F.array(target).alias("targets"),
        F.lit(None).cast(f"map<string,{PAYLOAD_JSON}>").alias("MetricTrends"),
    )
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("lb-"), F.col("o_orderkey").cast("string")).alias("alb_name"),
        F.lit("internal.example").alias("dns_name"),
        F.lit("internal").alias("scheme"),
        F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "P", " Active_Impaired").otherwise("failed").alias("state"),
        F.lit("vpc").alias("vpc_id"),
        F.struct(
            price.alias("request_count"),
            F.lit(0.0).alias("processed_bytes"),
            F.lit(0.25).alias("response_time"),
            F.when(F.col("o_orderstatus") == "F", 3.0).alias("elb_4xx"),
            F.lit(1.0).alias("elb_5xx"),
            F.lit(2.0).alias("target_4xx"),
            F.lit(None).cast("double").alias("target_5xx"),
        ).alias("metrics"),
        F.array(group).alias("target_groups"),
        F.lit(None).cast(f"map<string,{PAYLOAD_JSON}>").alias("MetricTrends"),
        F.col("o_orderkey").alias("ord"),
    )


def fleet_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    def member(key, state):
        return F.struct(
            customer_name(key).alias("instance_id"),
            F.lit(state).alias("lifecycle_state"),
            F.lit("Healthy").alias("health_status"),
            F.concat(F.lit("zone-"), F.col("s_nationkey").cast("string")).alias("availability_zone"),
            F.lit("m5.large").alias("instance_type"),
        )

    return table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("asg_name"),
        F.lit(1).alias("min_size"),
        (F.col("s_nationkey") + 1).alias("max_size"),
        F.lit(2).alias("desired_capacity"),
        F.lit("EC2").alias("health_check_type"),
        F.array(F.lit("zone-a")).alias("availability_zones"),
        F.struct(
            F.lit(2.0).alias("desired_capacity"),
            F.lit(1.0).alias("in_service"),
            F.lit(0.0).alias("pending"),
            F.lit(0.0).alias("terminating"),
            F.lit(2.0).alias("total_instances"),
        ).alias("metrics"),
        F.array(member(F.col("s_suppkey"), "InService"), member(F.col("s_nationkey"), " Standby")).alias("instances"),
        F.array().cast("array<struct<policy_name:string,policy_type:string>>").alias("scaling_policies"),
        F.array(
            F.struct(F.lit("Successful").alias("status"), F.col("s_name").alias("description"), F.lit("2024-01-01").alias("start_time"))
        ).alias("scaling_activities"),
        F.lit(None).cast(f"map<string,{PAYLOAD_JSON}>").alias("MetricTrends"),
        F.col("s_suppkey").alias("ord"),
    )


def fleet_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = customer_name(F.col("user_id"))
    return table(spark, sf_dir, "events").select(
        ts_text("ts").alias("event_time"),
        F.col("event_type").alias("event_name"),
        F.lit("app").alias("service"),
        name.alias("username"),
        F.lit("N/A").alias("source_ip"),
        F.lit(False).alias("read_only"),
        F.when(F.col("value") > 150, "Throttled").otherwise("").alias("error_code"),
        F.array(
            F.struct(F.lit("EC2 Instance").alias("type"), name.alias("name")),
            F.struct(F.col("event_type").alias("type"), name.alias("name")),
        ).alias("resources"),
        F.col("event_id").alias("ord"),
    )


def fleet_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.operators.context import build_contexts

    return build_contexts(
        fleet_instances(spark, sf_dir), fleet_load_balancers(spark, sf_dir), fleet_groups(spark, sf_dir), fleet_events(spark, sf_dir)
    )


# --- runs, reports and archives out of orders


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    analyzed = F.floor(F.col("o_totalprice") / 1000)
    failed = F.when(status == "F", F.lit(0)).when(status == "P", F.lit(1)).otherwise(analyzed)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.when(status == "F", "SUCCESS").when(status == "P", "partial_success").otherwise("ABORTED").alias("status"),
        F.col("o_orderpriority").alias("type"),
        utc("o_orderdate").alias("start_ts"),
        (utc("o_orderdate") + F.make_dt_interval(mins=F.floor(F.col("o_totalprice") / 10000).cast("int"))).alias("end_ts"),
        (F.col("o_totalprice") / 100).alias("execution_time_seconds"),
        F.col("o_custkey").alias("instances_discovered"),
        analyzed.alias("instances_analyzed"),
        F.when(status == "P", F.lit(2)).cast("bigint").alias("resources_skipped"),
        (analyzed - failed).alias("successful"),
        failed.alias("failed"),
        (analyzed - failed).alias("reports_generated"),
        F.create_map(
            F.lit("cloudwatch"), F.when(status == "F", "success").otherwise("FAILED"),
            F.lit("alb"), F.when(F.col("o_orderpriority") < "4", "SUCCESS").otherwise(F.lit(None)),
            F.lit("autoscaling"), F.lit("SUCCESS"),
        ).alias("collectors"),
    )


def severity_of(priority: Column) -> Column:
    return (
        F.when(priority == "1-URGENT", "CRITICAL").when(priority == "2-HIGH", "HIGH").when(priority == "3-MEDIUM", "MEDIUM")
        .when(priority == "5-LOW", "low").otherwise("UNRATED")
    )


def report_history(spark: SparkSession, sf_dir: str, *also: str) -> DataFrame:
    """One report per order, with its columns ``also``; ``resource_id`` is the customer."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("resource_id"),
        F.col("o_orderkey").alias("report_no"),
        severity_of(F.col("o_orderpriority")).alias("severity"),
        (F.col("o_totalprice") / 5000).cast("string").alias("confidence"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("summary"),
        F.col("o_orderpriority").alias("root_cause"),
        utc("o_orderdate").alias("detected_at"),
        *also,
    )


def current_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.operators.analyze import latest_reports

    return latest_reports(report_history(spark, sf_dir), ["resource_id"], ["report_no"])


def archived_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month as the archive; of several orders of a customer in a month the last one."""
    from tidewatch.operators.analyze import latest_reports

    monthly = report_history(spark, sf_dir).withColumn("archive_ts", F.date_trunc("month", "detected_at"))
    return latest_reports(monthly, ["archive_ts", "resource_id"], ["report_no"])
