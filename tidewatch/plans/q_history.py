"""History, report lookups, display columns, retention and deletion over orders."""

from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators import feed, history, retention
from tidewatch.plans import adapters as A
from tidewatch.plans.q_feed import ARCHIVES_SQL, REPORTS_SQL, RUNS_SQL, SEVERITY_SQL, TYPES_SQL, current_reports, customer_types
from tidewatch.plans.registry import query
from tidewatch.schemas import RUN_PHASES


def typed_executions(spark, sf_dir):
    """Execution columns that the list filters read, without the join to the other ones."""
    return A.runs(spark, sf_dir).select("run_id", "type", C.run_status_label(F.col("status")).alias("status"), C.iso_display(F.col("start_ts")).alias("start_time"))


@query("executions_listing", f"WITH {RUNS_SQL} SELECT run_id, type, status FROM runs")
def executions_listing(spark, sf_dir):
    return history.list_executions(typed_executions(spark, sf_dir)).select("run_id", "type", "status")


@query("execution_lookup", f"WITH {RUNS_SQL} SELECT run_id, type, status FROM runs WHERE run_id = '42'")
def execution_lookup(spark, sf_dir):
    return history.get_execution(typed_executions(spark, sf_dir), "42").select("run_id", "type", "status")


@query("history_search", f"WITH {RUNS_SQL} SELECT run_id, type, status FROM runs WHERE contains(lower(run_id), 'high') OR contains(lower(type), 'high')")
def history_search(spark, sf_dir):
    return history.search(typed_executions(spark, sf_dir), " High ").select("run_id", "type", "status")


@query("history_filters", f"WITH {RUNS_SQL} SELECT run_id FROM runs WHERE status = 'COMPLETED' AND type = '1-URGENT'")
def history_filters(spark, sf_dir):
    rows = history.filter_status(typed_executions(spark, sf_dir), "completed")
    return history.filter_type(history.filter_status(rows, "All"), "1-URGENT").select("run_id")


@query("type_facets", "SELECT DISTINCT o_orderpriority AS type FROM orders")
def type_facets(spark, sf_dir):
    return history.facets(typed_executions(spark, sf_dir), "type")


@query("reports_of_runs", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def reports_of_runs(spark, sf_dir):
    lines = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), "l_linenumber")
    urgent = A.table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("run_id"))
    return history.reports_of_runs(lines, urgent).withColumnRenamed("run_id", "l_orderkey")


@query(
    "report_lookup",
    """
SELECT CAST(o_orderkey AS VARCHAR) AS report_id, CAST(o_custkey AS VARCHAR) AS instance_id FROM orders WHERE o_orderkey = 77 OR o_custkey = 77
ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 1""",
)
def report_lookup(spark, sf_dir):
    reports = A.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("report_id"), F.col("o_custkey").cast("string").alias("instance_id"), A.utc("o_orderdate").alias("detected_at")
    )
    return history.get_report(reports, "77").select("report_id", "instance_id")


@query(
    "severity_order",
    f"""WITH {REPORTS_SQL} SELECT resource_id, severity, CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 0 END AS rank FROM reports""",
)
def severity_order(spark, sf_dir):
    rows = history.by_severity(current_reports(spark, sf_dir), "resource_id")
    return rows.select("resource_id", "severity", C.severity_rank(F.col("severity")).alias("rank"))


@query(
    "run_overview",
    """
WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CASE WHEN o_orderstatus = 'F' THEN coalesce(n, 0) ELSE CAST(floor(o_totalprice / 1000) AS BIGINT) END AS resources_analyzed,
  CASE WHEN o_orderstatus = 'F' THEN coalesce(n, 0) ELSE 1 END AS reports_generated, CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 0 END::BIGINT AS resources_skipped
FROM orders LEFT JOIN n ON l_orderkey = o_orderkey""",
)
def run_overview(spark, sf_dir):
    runs = A.runs(spark, sf_dir)
    partial = F.col("status") != "SUCCESS"
    stored = runs.select(
        "run_id", F.when(partial, F.col("instances_analyzed")).alias("resources_analyzed"),
        F.when(partial, F.lit(1)).cast("bigint").alias("reports_generated"), "resources_skipped",
    )
    reports = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("run_id"))
    return history.run_overview(stored, reports)


@query("latest6", f"WITH {RUNS_SQL} SELECT run_id, status FROM runs ORDER BY start_ts DESC, run_id DESC LIMIT 6")
def latest6(spark, sf_dir):
    return history.latest_executions(typed_executions(spark, sf_dir)).select("run_id", "status")


@query(
    "inventory_picker",
    f"""WITH {TYPES_SQL} SELECT coalesce(type, 'Unknown') AS type, c_name AS id, CASE WHEN c_acctbal > 0 THEN c_mktsegment || ' (' || c_name || ')' ELSE c_name END AS display
FROM customer JOIN kinds ON resource_id = c_custkey""",
)
def inventory_picker(spark, sf_dir):
    kinds = customer_types(spark, sf_dir).withColumn("type", F.coalesce(C.type_label(F.col("resource_type")), F.lit("Unknown")))
    customers = A.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("resource_id"), F.col("c_name").alias("id"),
        F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise(F.lit(None)).alias("label"),
    )
    return history.resources_for_type(customers.join(kinds, "resource_id")).select("type", "id", "display")


@query("collector_predicate", "SELECT c_custkey, c_mktsegment = 'BUILDING' AS healthy FROM customer")
def collector_predicate(spark, sf_dir):
    status = F.when(F.col("c_mktsegment") == "BUILDING", " HEALTHY ").when(F.col("c_mktsegment") == "MACHINERY", "Degraded")
    return history.healthy_collectors(A.table(spark, sf_dir, "customer").select("c_custkey", status.alias("status"))).select("c_custkey", "healthy")


@query(
    "display_columns",
    """
WITH e AS (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderstatus, CAST(round_even(o_totalprice / 100, 0) AS BIGINT) AS s, o_orderdate,
  (SELECT max(epoch(o_orderdate)) FROM orders) - epoch(o_orderdate) AS age, o_totalprice AS v FROM orders)
SELECT run_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s // 60 % 60) || 'm' END AS duration_text,
  strftime(o_orderdate, '%b %d, %Y %I:%M %p') AS started_text,
  CASE WHEN age < 60 THEN 'just now' WHEN age < 30 * 86400 THEN CAST(floor(age / 86400) AS BIGINT) || 'd ago' ELSE strftime(o_orderdate, '%b %d, %Y') END AS age_text,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'warning' ELSE 'neutral' END AS status_kind FROM e""",
)
def display_columns(spark, sf_dir):
    newest = A.table(spark, sf_dir, "orders").agg(F.max("o_orderdate")).first()[0]
    runs = A.runs(spark, sf_dir)
    rows = runs.select(
        "run_id", C.run_status_label(F.col("status")).alias("status"), C.round_whole(F.col("execution_time_seconds")).alias("execution_time"),
        F.col("instances_discovered").alias("resources"), "start_ts",
    )
    return history.history_view(rows, newest).select("run_id", "duration_text", "started_text", "age_text", "status_kind")


@query(
    "number_texts",
    """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN '—' ELSE format('{:,}', CAST(l_quantity * 1000 AS BIGINT)) END AS quantity FROM lineitem""",
)
def number_texts(spark, sf_dir):
    raw = F.when(F.col("l_returnflag") == "R", "none").otherwise((F.col("l_quantity") * 1000).cast("string"))
    return A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.number_text(raw).alias("quantity"))


@query(
    "report_cards",
    """
SELECT doc_id, CASE WHEN length(text) <= 160 THEN text ELSE rtrim(substr(text, 1, 159)) || '…' END AS summary_text,
  CASE source WHEN 'src0' THEN 'critical' ELSE 'neutral' END AS severity_kind FROM documents""",
)
def report_cards(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("summary"), F.when(F.col("source") == "src0", "Critical").otherwise(F.col("source")).alias("severity")
    )
    return history.report_cards(docs).select("doc_id", "summary_text", "severity_kind")


_KEYS = list(RUN_PHASES)


@query(
    "run_progress",
    f"""
WITH last AS (SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn, count(*) AS n FROM conversations GROUP BY ALL),
p AS (SELECT *, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS pos, least(turn * 20, 100) AS pct FROM last)
SELECT CAST(conv_id AS VARCHAR) AS run_id, CASE pos WHEN 0 THEN 'Collecting Metrics' WHEN 1 THEN 'Building Context' ELSE 'Running AI Analysis' END AS phase_label, 'RUNNING' AS status,
  CAST(pct AS INTEGER) AS percent, 3600::BIGINT AS elapsed_seconds, CASE WHEN pct > 0 THEN CAST(floor(3600 * (100 - pct) / pct) AS BIGINT) END AS remaining_seconds,
  CASE pos WHEN 0 THEN 'active,pending,pending,pending,pending' WHEN 1 THEN 'done,active,pending,pending,pending' ELSE 'done,done,active,pending,pending' END AS states FROM p""",
)
def run_progress(spark, sf_dir):
    import datetime as dt

    began = dt.datetime(2024, 1, 1)
    turns = A.table(spark, sf_dir, "conversations")
    run_id = F.col("conv_id").cast("string").alias("run_id")
    phase = F.when(F.col("role") == "system", _KEYS[0]).when(F.col("role") == "user", _KEYS[1]).otherwise(_KEYS[2])
    events = turns.select(
        run_id, phase.alias("phase"), (F.col("turn") * 20).alias("percent"), F.lit(None).cast("string").alias("current_resource"),
        (C.instant(began) + F.make_dt_interval(secs=F.col("turn").cast("decimal(18,6)"))).alias("ts"),
    )
    started = turns.select(run_id).distinct().withColumn("started_at", C.instant(began))
    out = history.run_progress(events, started, began + dt.timedelta(hours=1))
    states = F.array_join(F.transform("phases", lambda p: p["state"]), ",")
    return out.select("run_id", "phase_label", "status", "percent", "elapsed_seconds", "remaining_seconds", states.alias("states"))


# --- retention --------------------------------------------------------------------


@query(
    "keep_newest_archives",
    f"WITH {ARCHIVES_SQL}, n AS (SELECT DISTINCT archive_ts FROM archived ORDER BY archive_ts DESC LIMIT 5) SELECT resource_id, strftime(archive_ts, '%Y-%m') AS month FROM archived WHERE archive_ts IN (SELECT archive_ts FROM n)",
)
def keep_newest_archives(spark, sf_dir):
    return retention.keep_newest_archives(A.archived_reports(spark, sf_dir)).select("resource_id", F.date_format("archive_ts", "yyyy-MM").alias("month"))


@query(
    "expired_archives",
    f"WITH {ARCHIVES_SQL}, n AS (SELECT DISTINCT archive_ts FROM archived ORDER BY archive_ts DESC LIMIT 5) SELECT resource_id, strftime(archive_ts, '%Y-%m') AS month FROM archived WHERE archive_ts NOT IN (SELECT archive_ts FROM n)",
)
def expired_archives(spark, sf_dir):
    return retention.expired_archives(A.archived_reports(spark, sf_dir)).select("resource_id", F.date_format("archive_ts", "yyyy-MM").alias("month"))


@query("keep_newest_prompts", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5")
def keep_newest_prompts(spark, sf_dir):
    return retention.keep_newest_prompts(A.table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id").select("event_id")


RUN_ID_SQL = "strftime(ts + INTERVAL 330 MINUTE, '%d-%m-%Y_%H-%M-%S')"


@query(
    "run_id_check",
    f"""
SELECT event_id, regexp_matches(CASE event_type WHEN 'view' THEN strftime(ts, '%Y%m%d_%H%M%S') ELSE {RUN_ID_SQL} END, '^\\d{{2}}-\\d{{2}}-\\d{{4}}_\\d{{2}}-\\d{{2}}-\\d{{2}}$') AS valid,
  epoch_ms(CASE event_type WHEN 'view' THEN date_trunc('second', ts - INTERVAL 330 MINUTE) ELSE date_trunc('second', ts) END) // 1000 AS start_seconds FROM events""",
)
def run_id_check(spark, sf_dir):
    """Both run-id layouts; the compact one is written here without the zone shift, so it parses to an earlier instant."""
    text = F.when(F.col("event_type") == "view", F.date_format("ts", "yyyyMMdd_HHmmss")).otherwise(C.run_id_of(A.utc("ts")))
    rows = A.table(spark, sf_dir, "events").select("event_id", text.alias("run_id"))
    return rows.select("event_id", C.is_run_id(F.col("run_id")).alias("valid"), F.unix_seconds(C.parse_run_id(F.col("run_id"))).alias("start_seconds"))


def _run_ids(df):
    return df.select(C.run_id_of(A.utc("ts")).alias("run_id"), "user_id", "event_type", "value")


DELETE_SQL = f"""ids AS (SELECT {RUN_ID_SQL} AS run_id, user_id, event_type, value FROM events),
stored AS (SELECT * FROM ids WHERE event_type IN ('click', 'view')), kept AS (SELECT * FROM ids WHERE event_type = 'purchase'),
asked AS (SELECT DISTINCT CASE WHEN event_type = 'signup' THEN 'bad ' || run_id ELSE run_id END AS run_id FROM ids WHERE event_type <> 'click'),
outcome AS (SELECT run_id, CASE WHEN run_id IN (SELECT run_id FROM stored UNION ALL SELECT run_id FROM kept) THEN 'deleted' ELSE 'not_found' END AS outcome FROM asked)"""


def _delete_inputs(spark, sf_dir):
    ids = _run_ids(A.table(spark, sf_dir, "events"))
    kind = F.col("event_type")
    runs = ids.filter(kind.isin("click", "view"))
    archived = ids.filter(kind == "purchase")
    bad = F.when(kind == "signup", F.concat(F.lit("bad "), F.col("run_id"))).otherwise(F.col("run_id"))
    return ids.filter(kind != "click").select(bad.alias("run_id")), runs, archived


@query("delete_runs", f"WITH {DELETE_SQL} SELECT run_id, outcome FROM outcome")
def delete_runs(spark, sf_dir):
    return retention.deletion_result(*_delete_inputs(spark, sf_dir))


@query("surviving_runs", f"WITH {DELETE_SQL} SELECT run_id, user_id FROM stored WHERE run_id NOT IN (SELECT run_id FROM outcome WHERE outcome = 'deleted')")
def surviving_runs(spark, sf_dir):
    asked, runs, archived = _delete_inputs(spark, sf_dir)
    deleted = retention.deletion_result(asked, runs, archived).filter(F.col("outcome") == "deleted")
    return retention.surviving_runs(runs, deleted).select("run_id", "user_id")


@query(
    "content_match_delete",
    f"""WITH
last AS (SELECT o_custkey AS resource_id, {SEVERITY_SQL} AS severity, nullif(o_orderstatus, 'P') AS note FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
old AS (SELECT o_custkey AS resource_id, {SEVERITY_SQL} AS severity, nullif(o_orderstatus, 'P') AS note FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW'))
SELECT resource_id, severity, note FROM last c WHERE EXISTS (SELECT 1 FROM old a WHERE a.resource_id = c.resource_id AND a.severity IS NOT DISTINCT FROM c.severity AND a.note IS NOT DISTINCT FROM c.note)""",
)
def content_match_delete(spark, sf_dir):
    from tidewatch.operators.analyze import latest_reports

    rows = A.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("resource_id"), F.col("o_orderkey").alias("report_no"), A.severity_of(F.col("o_orderpriority")).alias("severity"),
        F.nullif("o_orderstatus", F.lit("P")).alias("note"), F.col("o_orderpriority").alias("run_id"),
    )
    current = latest_reports(rows, ["resource_id"], ["report_no"]).select("resource_id", "severity", "note")
    deleted = rows.filter(F.col("run_id").isin("1-URGENT", "5-LOW")).select("run_id").distinct()
    return retention.reports_to_delete(current, rows, deleted, "resource_id", ["severity", "note"])


@query(
    "delete_guard",
    """
SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS run_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P'))""",
)
def delete_guard(spark, sf_dir):
    """Requested runs that may not be deleted because they are queued or running."""
    requested = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("run_id"))
    status = A.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.when(F.col("o_orderstatus") == "O", "QUEUED").when(F.col("o_orderstatus") == "P", "RUNNING").otherwise("COMPLETED").alias("status"),
    )
    return retention.active_requests(requested, status)
