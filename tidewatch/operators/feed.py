"""Dashboard tables: telemetry, enrichment, as-of linkage, trends, KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import bounded
from tidewatch.functions import columns as C
from tidewatch.schemas import COLLECTOR_LABELS, EC2, LOAD_BALANCER, SCALING_GROUP

SEVERITIES = ["critical", "high", "medium", "low"]


# --- runs -------------------------------------------------------------------------


def latest_run(runs: DataFrame) -> DataFrame:
    """The last run by start, as at most one row; runs without a start come before all others."""
    return bounded.newest(runs, [F.col("start_ts").desc_nulls_last(), F.col("run_id").desc()], 1)


def collector_health(runs: DataFrame) -> DataFrame:
    """Four collectors of the latest run; anything but SUCCESS is degraded."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(label).alias("collector"),
                F.when(F.upper(F.try_element_at("collectors", F.lit(key))) == "SUCCESS", "Healthy").otherwise("Degraded").alias("status"),
            )
            for key, label in COLLECTOR_LABELS.items()
        ]
    )
    return latest_run(runs).select(F.inline(pairs))


def executions(runs: DataFrame) -> DataFrame:
    """Execution rows; order with :func:`newest_first` where a listing is wanted."""
    zero = F.lit(0).cast("bigint")
    out = {
        "successful": "successful", "failed": "failed", "resources": "instances_discovered",
        "resources_analyzed": "instances_analyzed", "resources_skipped": "resources_skipped",
        "reports_generated": "reports_generated",
    }
    return runs.select(
        "run_id",
        C.run_status_label(F.col("status")).alias("status"),
        C.round_whole(F.col("execution_time_seconds")).alias("execution_time"),
        *[F.coalesce(F.col(src).cast("bigint"), zero).alias(name) for name, src in out.items()],
        C.iso_display(F.col("start_ts")).alias("start_time"),
        C.iso_display(F.col("end_ts")).alias("finished_at"),
    )


def newest_first(df: DataFrame, by: str, tie: str) -> DataFrame:
    """Global order. The tie-breaker also lets the range exchange split rows of one time."""
    return df.orderBy(F.col(by).desc_nulls_last(), tie)


# --- telemetry --------------------------------------------------------------------


def instance_telemetry(snapshot: Column) -> Column:
    names = {
        "state": "State", "cpu": "CPU", "memory": "Memory", "disk": "Disk",
        "network_in": "NetworkIn", "network_out": "NetworkOut", "status_check": "StatusCheck",
    }
    return F.when(snapshot.isNotNull(), F.struct(*[snapshot[src].alias(name) for name, src in names.items()]))


def _sum_of(items: Column, field: str) -> Column:
    return F.aggregate(
        F.coalesce(F.transform(items, lambda x: F.coalesce(x[field].cast("double"), F.lit(0.0))), F.array().cast("array<double>")),
        F.lit(0.0), lambda total, x: total + x,
    )


def lb_telemetry(lb: Column) -> Column:
    m = lb["metrics"]

    def both(a, b):
        return F.coalesce(m[a], F.lit(0.0)) + F.coalesce(m[b], F.lit(0.0))

    return F.when(
        lb.isNotNull(),
        F.struct(
            m["request_count"].alias("request_count"),
            m["response_time"].alias("target_response_time"),
            both("elb_4xx", "target_4xx").alias("http_4xx"),
            both("elb_5xx", "target_5xx").alias("http_5xx"),
            _sum_of(lb["target_groups"], "healthy_hosts").alias("healthy_targets"),
            _sum_of(lb["target_groups"], "unhealthy_hosts").alias("unhealthy_targets"),
        ),
    )


def asg_telemetry(group: Column) -> Column:
    m = group["metrics"]
    standby = F.filter(group["instances"], lambda i: F.lower(F.trim(i["lifecycle_state"])) == "standby")
    return F.when(
        group.isNotNull(),
        F.struct(
            m["desired_capacity"].alias("desired_capacity"),
            m["in_service"].alias("in_service_instances"),
            m["pending"].alias("pending_instances"),
            F.greatest(F.size(standby), F.lit(0)).alias("standby_instances"),
            group["scaling_activities"].alias("scaling_activities"),
        ),
    )


def telemetry(contexts: DataFrame) -> DataFrame:
    """Telemetry by type; at most one of the three members is set."""
    return contexts.select(
        "resource_type",
        "resource_id",
        F.when(F.col("resource_type") == EC2, instance_telemetry(F.col("instance.snapshot"))).alias("instance_telemetry"),
        F.when(F.col("resource_type") == LOAD_BALANCER, lb_telemetry(F.col("load_balancer"))).alias("lb_telemetry"),
        F.when(F.col("resource_type") == SCALING_GROUP, asg_telemetry(F.col("scaling_group"))).alias("asg_telemetry"),
    )


def lb_rollup(target_groups: DataFrame, key: str) -> DataFrame:
    """Host counts per load balancer from one row per target group."""
    return target_groups.groupBy(key).agg(
        F.sum(F.coalesce("healthy_hosts", F.lit(0))).alias("healthy_targets"),
        F.sum(F.coalesce("unhealthy_hosts", F.lit(0))).alias("unhealthy_targets"),
    )


# --- reports ----------------------------------------------------------------------


def as_of_join(
    facts: DataFrame, runs: DataFrame, ts: str, start: str, value: str, bucket_seconds: int = 3600
) -> DataFrame:
    """``value`` of the last run that started at or before each fact; null before the first run.

    Runs are cut at bucket borders into half-open intervals, each within one bucket; a carried
    interval stands for the run still current when a bucket begins. Only buckets that hold a run or
    a fact are made, so a gap between two runs costs nothing, however long. Facts then meet the
    intervals in an equi join on the bucket with a range residual. Runs without a start are
    ignored; of several runs with one start the greatest value counts.

    The only global window runs over one row per bucket, which the calendar bounds. The join carries
    no hint: a small interval table is broadcast by its measured size, and otherwise a hot
    bucket of facts is split by the adaptive skew join.
    """
    def bucket_of(c):
        return F.floor(F.unix_seconds(c) / bucket_seconds)

    starts = (
        runs.filter(F.col(start).isNotNull())
        .groupBy(F.col(start).alias("_start"))
        .agg(F.max(value).alias("_value"))
        .withColumn("_bucket", bucket_of("_start"))
    )
    per_bucket = starts.groupBy("_bucket").agg(F.max_by("_value", "_start").alias("_value"))
    asked = facts.select(bucket_of(F.col(ts)).alias("_bucket")).where(F.col("_bucket").isNotNull()).distinct()
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = per_bucket.unionByName(asked, allowMissingColumns=True).groupBy("_bucket").agg(F.max("_value").alias("_value"))
    carried = (
        buckets.withColumn("_value", F.last("_value", ignorenulls=True).over(before))
        .where(F.col("_value").isNotNull())
        .select("_bucket", F.timestamp_seconds(F.col("_bucket") * bucket_seconds).alias("_start"), "_value", F.lit(0).alias("_own"))
    )
    pieces = starts.select("_bucket", "_start", "_value", F.lit(1).alias("_own")).unionByName(carried)
    intervals = pieces.withColumn(
        "_end", F.lead("_start").over(Window.partitionBy("_bucket").orderBy("_start", "_own"))
    ).filter(F.col("_end").isNull() | (F.col("_end") > F.col("_start"))).drop("_own")
    left = facts.withColumn("_bucket", bucket_of(F.col(ts))).alias("f")
    right = intervals.withColumnRenamed("_bucket", "_rb")
    hit = (
        (F.col("f._bucket") == F.col("_rb"))
        & (F.col(f"f.{ts}") >= F.col("_start"))
        & (F.col("_end").isNull() | (F.col(f"f.{ts}") < F.col("_end")))
    )
    return left.join(right, hit, "left").select(*[F.col(f"f.{c}") for c in facts.columns], F.col("_value").alias(value))


def diff_severity(current: DataFrame, previous: DataFrame, keys: list[str] = ["resource_id"]) -> DataFrame:
    """``is_new`` and ``severity_changed_from``; only a rise in rank is flagged, unknown words rank 0."""
    prev = previous.select(*keys, F.col("severity").alias("_prev"))
    worse = C.severity_rank(F.col("severity")) > C.severity_rank(F.col("_prev"))
    return current.join(prev, keys, "left").select(
        *[F.col(c) for c in current.columns],
        F.col("_prev").isNull().alias("is_new"),
        F.when(F.col("_prev").isNotNull() & worse, F.col("_prev")).alias("severity_changed_from"),
    )


def state_of(reports: DataFrame, keys: list[str] = ["resource_id"]) -> DataFrame:
    """The severity snapshot that the next diff compares against."""
    return reports.select(*keys, C.or_else(F.upper("severity"), "UNKNOWN").alias("severity"))


def report_columns(raw: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    return raw.withColumns(
        {
            "severity": C.or_else(F.upper("severity"), "UNKNOWN"),
            "summary": F.coalesce("summary", F.lit("")),
            "root_cause": F.coalesce("root_cause", F.lit("")),
            "evidence": F.coalesce("evidence", empty),
            "recommendations": F.coalesce("recommendations", empty),
            "ai_confidence": C.unit_confidence(F.col("confidence")),
        }
    )


def enrich_reports(reports: DataFrame, contexts: DataFrame, keys: list[str] = ["resource_id"]) -> DataFrame:
    """Type label and telemetry of the resource, null where no context is known.

    ``contexts`` holds one row per key with ``resource_type``. Ids are unique per type only,
    so reports that know their type are joined on both.
    """
    extra = [c for c in contexts.columns if c not in ("resource_id", "resource_type")]
    side = contexts.select(*keys, C.type_label(F.col("resource_type")).alias("type_label"), *extra)
    if "resource_type" not in keys:
        # An id that two types share has two contexts; a report without a type takes the first by label.
        members = [c for c in side.columns if c not in keys]
        first = side.groupBy(*keys).agg(F.min_by(F.struct(*members), "type_label").alias("_first"))
        side = first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in members])
    return reports.drop("type_label").join(side, keys, "left")


def report_feed(
    reports: DataFrame, contexts: DataFrame, runs: DataFrame, previous: DataFrame, keys: list[str] = ["resource_id"]
) -> DataFrame:
    """All reports with confidence, telemetry, run link and change flags."""
    shaped = report_columns(reports)
    enriched = enrich_reports(shaped, contexts, keys)
    linked = as_of_join(enriched, runs, "detected_at", "start_ts", "run_id")
    return diff_severity(linked, previous, keys)


def contract_reports(rows: DataFrame) -> DataFrame:
    """Rows of ``report_feed`` in the columns of the published table.

    ``telemetry`` has the members of all types; those of other types are null, and so is all of it for a
    resource without a context. As JSON, which leaves nulls out, it is the object of the contract.
    """
    from tidewatch.schemas import FEED_TABLES, struct_of

    want = struct_of(FEED_TABLES["reports"])
    by_type = ("instance_telemetry", "lb_telemetry", "asg_telemetry")
    member = {f.name: F.col(c)[f.name] for c in by_type for f in rows.schema[c].dataType}
    shape = {f.name: f.dataType for f in want["telemetry"].dataType}
    telemetry = F.struct(*[member[n].cast(kind).alias(n) for n, kind in shape.items()])
    known = F.col(by_type[0]).isNotNull() | F.col(by_type[1]).isNotNull() | F.col(by_type[2]).isNotNull()
    named = rows.withColumns(
        {"report_id": F.col("resource_id"), "instance_id": F.col("resource_id"), "resource_type": F.col("type_label"), "telemetry": F.when(known, telemetry)}
    )
    return named.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in want])


def analytics(incidents: DataFrame, severities: DataFrame, distribution: DataFrame, times: DataFrame) -> DataFrame:
    """One table of the four trends. ``section`` names the trend; ``at`` (then ``run_id``) orders its points.

    The distribution is ordered by its count. Rows stay unordered here, as there is one per run.
    """
    at = F.col("start_ts").alias("at")
    parts = [
        incidents.select(F.lit("incident_trend").alias("section"), at, "run_id", "date", "count"),
        severities.select(
            F.lit("severity_trend").alias("section"), F.col("archive_ts").alias("at"), C.trend_label(F.col("archive_ts")).alias("date"), *SEVERITIES
        ),
        distribution.select(F.lit("resource_distribution").alias("section"), "type", "count"),
        times.select(F.lit("execution_time_trend").alias("section"), at, "run_id", "date", "avg_seconds"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


# --- trends -----------------------------------------------------------------------


def severity_counts(prefix: str = "") -> list[Column]:
    return [F.count_if(F.lower("severity") == s).alias(f"{prefix}{s}") for s in SEVERITIES]


def severity_trend(archived: DataFrame, archives: DataFrame, key: str = "archive_ts") -> DataFrame:
    """Counts of the four severities per archive; an archive without reports stays with zeros."""
    counts = archived.groupBy(key).agg(*severity_counts())
    return archives.select(key).join(counts, key, "left").select(
        key, *[F.coalesce(s, F.lit(0)).alias(s) for s in SEVERITIES]
    )


def top_affected(archived: DataFrame, contexts: DataFrame, k: int = 5, min_severity: str | None = None) -> DataFrame:
    """Resources in most archives. Counted and cut to ``k`` before the type lookup, which then joins ``k`` rows."""
    rows = archived
    if min_severity:
        floor = C.severity_rank(F.lit(min_severity))
        rows = rows.filter(C.severity_rank(F.col("severity")) >= floor)
    ranked = bounded.newest(
        rows.groupBy("resource_id").agg(F.count(F.lit(1)).alias("incidents")),
        [F.col("incidents").desc(), F.col("resource_id")],
        k,
    )
    kinds = contexts.select("resource_id", C.type_label(F.col("resource_type")).alias("type"))
    # ``ranked`` has at most k rows, and so has what is left of the contexts: an id that types share shows them all.
    few = kinds.join(F.broadcast(ranked.select("resource_id")), "resource_id", "left_semi")
    few = few.groupBy("resource_id").agg(F.array_join(F.array_sort(F.collect_set("type")), ", ").alias("type"))
    return ranked.join(F.broadcast(few), "resource_id", "left").select(
        "resource_id", F.coalesce(F.nullif("type", F.lit("")), F.lit(C.DASH)).alias("type"), "incidents"
    )


def resource_distribution(contexts: DataFrame) -> DataFrame:
    """Resources of each type, the most frequent first; types of one count by name."""
    label = F.coalesce(C.type_label(F.col("resource_type")), F.lit("Unknown"))
    return contexts.groupBy(label.alias("type")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "type")


def inventory(contexts: DataFrame) -> DataFrame:
    """(type, id, label) rows sorted by type and id.

    One row per resource, not one list per type: a type may hold most of the fleet. The
    global sort is a range exchange, so that type still spreads over many tasks.
    """
    label = F.coalesce(C.type_label(F.col("resource_type")), F.lit("Unknown"))
    return contexts.select(label.alias("type"), F.col("resource_id").alias("id"), F.col("resource_id").alias("label")).orderBy("type", "id")


def run_trend(runs: DataFrame, value: str, name: str, default=0) -> DataFrame:
    """One point per run, labelled in the display zone, or by run id where the start is unknown."""
    return runs.select(
        "run_id",
        "start_ts",
        F.coalesce(C.trend_label(F.col("start_ts")), F.col("run_id")).alias("date"),
        F.coalesce(F.col(value), F.lit(default)).alias(name),
    ).orderBy(F.col("start_ts").asc_nulls_first(), "run_id")


def investigation_trend(runs: DataFrame) -> DataFrame:
    return run_trend(runs, "reports_generated", "count")


def execution_time_trend(runs: DataFrame) -> DataFrame:
    return run_trend(runs, "execution_time_seconds", "avg_seconds", 0.0)


# --- KPIs -------------------------------------------------------------------------


def _report_totals(reports: DataFrame) -> DataFrame:
    severity = F.col("severity")
    return reports.agg(
        F.count_if(severity == "CRITICAL").alias("critical"),
        F.count_if(severity == "HIGH").alias("high"),
        F.count_if(severity.isin("HIGH", "MEDIUM")).alias("warning"),
        F.count_if(severity == "LOW").alias("healthy"),
        F.count_if(C.severity_rank(severity) == 0).alias("unrecognized"),
        F.count(F.lit(1)).alias("reported"),
    )


def _with_latest_run(runs: DataFrame, totals: DataFrame) -> DataFrame:
    """Both one-row inputs side by side, by adding them up instead of joining; no row without a run."""
    names = ["instances_discovered", "instances_analyzed", "successful", "reports_generated"]
    run = latest_run(runs).select(*[F.coalesce(F.col(n).cast("bigint"), F.lit(0)).alias(n) for n in names], F.lit(1).alias("_runs"))
    both = totals.unionByName(run, allowMissingColumns=True)
    columns = [*totals.columns, *names, "_runs"]
    return both.agg(*[F.max(c).alias(c) for c in columns]).filter(F.col("_runs") == 1)


def kpi_row(runs: DataFrame, reports: DataFrame) -> DataFrame:
    """Totals of the latest run and the current reports; success rate in percent at 1 dp."""
    rate = F.round(F.try_divide(F.col("successful"), F.col("instances_analyzed")) * 100, 1)
    return _with_latest_run(runs, _report_totals(reports)).select(
        F.col("instances_discovered").alias("total_resources"),
        F.col("critical").alias("critical_issues"),
        F.col("high").alias("high_severity"),
        F.col("reports_generated").alias("investigations"),
        rate.alias("success_rate"),
    )


def infrastructure_health(runs: DataFrame, reports: DataFrame) -> DataFrame:
    """``reports`` holds one row per resource, so the rows count the reported resources."""
    unreported = F.greatest(F.col("instances_discovered") - F.col("reported"), F.lit(0))
    return _with_latest_run(runs, _report_totals(reports)).select(
        F.col("instances_discovered").alias("total"),
        "healthy",
        "warning",
        "critical",
        (unreported + F.col("unrecognized")).alias("unknown"),
    )


def latest_execution(runs: DataFrame) -> DataFrame:
    return executions(latest_run(runs)).select(
        "run_id", "status", "resources", "successful", "failed", F.col("execution_time").alias("duration_seconds"), "start_time"
    )


def recent(reports: DataFrame, n: int = 6, ts: str = "detected_at", tie: str = "resource_id") -> DataFrame:
    return bounded.newest(reports, [F.col(ts).desc_nulls_last(), F.col(tie)], n)


def daily_runs(runs: DataFrame) -> DataFrame:
    """Runs, reports and mean seconds per day."""
    return runs.filter(F.col("start_ts").isNotNull()).groupBy(F.to_date("start_ts").alias("day")).agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("reports_generated").alias("reports"),
        F.avg("execution_time_seconds").alias("avg_seconds"),
    )


def day_over_day(daily: DataFrame, values: list[str], day: str = "day") -> DataFrame:
    """Change against the previous listed day, with its label; null on the first day.

    Input is one row per calendar day, so the ordered window is bounded by the calendar.
    """
    w = Window.orderBy(day)
    return daily.withColumns({f"{v}_delta": F.col(v) - F.lag(v).over(w) for v in values}).withColumn(
        "delta_label", F.when(F.lag(day).over(w).isNotNull(), "from yesterday")
    )


def collector_statistics(calls: DataFrame) -> DataFrame:
    """Events, errors and mean latency per collector over a call log (collector, is_error, latency_ms)."""
    return calls.groupBy("collector").agg(
        F.count(F.lit(1)).alias("events_processed"),
        F.count_if("is_error").alias("errors"),
        F.avg("latency_ms").alias("avg_latency_ms"),
    )


# --- resource tree ----------------------------------------------------------------

TREE = "level int, node_id string, node_type string, parent_id string, status string, child_count bigint"


def resource_tree(members: DataFrame) -> DataFrame:
    """Flat tree (level, node, parent, status, children) from (lb, target_group, instance_id, severity).

    Levels are rolled up bottom-up with map-side combine; a parent takes the worst child
    status. Children stay rows with a parent id, so a node with very many of them is
    never one value.
    """
    rank = C.severity_rank(F.col("severity"))
    word = C.lookup(F.col("_rank"), {4: "CRITICAL", 3: "HIGH", 2: "MEDIUM", 1: "LOW"}, F.lit("UNKNOWN"))
    groups = members.groupBy("lb", "target_group").agg(F.max(rank).alias("_rank"), F.count(F.lit(1)).alias("child_count"))
    roots = groups.groupBy("lb").agg(F.max("_rank").alias("_rank"), F.count(F.lit(1)).alias("child_count"))
    none = F.lit(None).cast("string")
    top = roots.select(F.lit(0).alias("level"), F.col("lb").alias("node_id"), F.lit(LOAD_BALANCER).alias("node_type"),
                       none.alias("parent_id"), word.alias("status"), "child_count")
    middle = groups.select(F.lit(1).alias("level"), F.col("target_group").alias("node_id"), F.lit("Target Group").alias("node_type"),
                           F.col("lb").alias("parent_id"), word.alias("status"), "child_count")
    leaves = members.withColumn("_rank", rank).select(
        F.lit(2).alias("level"), F.col("instance_id").alias("node_id"), F.lit("EC2 Instance").alias("node_type"),
        F.col("target_group").alias("parent_id"), word.alias("status"), F.lit(0).cast("bigint").alias("child_count"))
    return top.unionByName(middle).unionByName(leaves)


def tree_in_order(members: DataFrame) -> DataFrame:
    """The tree for a viewer that walks it: every node before its children, siblings by id.

    A viewer keeps the open nodes of the levels above and needs no list of children, so a node may have any number.
    """
    lb = F.struct("lb")
    group, leaf = F.struct("lb", "target_group"), F.struct("lb", "target_group", "instance_id")
    tree = resource_tree(members)
    parents = members.select(group.alias("g")).distinct()
    paths = (
        members.select(lb.alias("p")).distinct().select(F.lit(0).alias("level"), F.col("p.lb").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("string").alias("c"))
        .union(parents.select(F.lit(1), "g.lb", "g.target_group", F.lit(None).cast("string")))
        .union(members.select(leaf.alias("l")).select(F.lit(2), "l.lb", "l.target_group", "l.instance_id"))
    )
    return _walked(tree, paths)


def _walked(tree: DataFrame, paths: DataFrame) -> DataFrame:
    node = F.when(F.col("level") == 0, F.col("a")).when(F.col("level") == 1, F.col("b")).otherwise(F.col("c"))
    parent = F.when(F.col("level") == 1, F.col("a")).when(F.col("level") == 2, F.col("b"))
    known = paths.select("level", node.alias("node_id"), parent.alias("parent_id"), "a", "b", "c")
    on = (known["level"] == tree["level"]) & known["node_id"].eqNullSafe(tree["node_id"]) & known["parent_id"].eqNullSafe(tree["parent_id"])
    rows = known.join(tree, on).select(*[tree[c] for c in tree.columns], "a", "b", "c")
    return rows.orderBy(F.asc_nulls_first("a"), F.asc_nulls_first("b"), F.asc_nulls_first("c")).drop("a", "b", "c")
