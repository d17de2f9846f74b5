"""Sources, sinks and streaming jobs: whole tables go through files in the shared folder and come back."""

from pyspark.sql import functions as F

from tidewatch.plans import adapters as A
from tidewatch.plans.q_context import C_ORDER
from tidewatch.plans.q_metrics import BREACH_SQL, THRESHOLDS_SQL
from tidewatch.plans.registry import query
from tidewatch.session import cut_lineage, scratch_path
from tidewatch.sources import readers, writers
from tidewatch.streaming import jobs

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


# --- sources and sinks ------------------------------------------------------------


@query("snapshot_roundtrip", "SELECT c_name AS instance_id, c_acctbal AS cpu, 'PASS' AS status_check, CASE WHEN c_acctbal > 0 THEN '%' END AS unit FROM customer")
def snapshot_roundtrip(spark, sf_dir):
    """Instances written as JSON envelopes, read back by schema and unnested."""
    base = scratch_path(spark, "snapshot")
    rows = A.fleet_instances(spark, sf_dir).drop("ord")
    envelopes = rows.select(F.lit("cloudwatch").alias("collector"), F.lit("2024-01-31T00:00:00Z").alias("timestamp"), F.array(F.struct(*rows.columns)).alias("resources"))
    writers.write_snapshot(envelopes, f"{base}/cloudwatch.json")
    back = readers.read_snapshot(spark, base, "cloudwatch", layout="lines")
    cpu = F.try_element_at("MetricTrends", F.lit("CPU"))
    return back.select(F.col("InstanceId").alias("instance_id"), F.col("CPU").alias("cpu"), F.col("StatusCheck").alias("status_check"), cpu["U"].alias("unit"))


@query("run_history_scan", "SELECT CAST(o_orderkey AS VARCHAR) AS run_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS started, o_custkey AS instances_discovered FROM orders")
def run_history_scan(spark, sf_dir):
    """Run summaries as JSON lines; the start comes from the clock text, as these run ids hold no time."""
    from tidewatch.functions.columns import clock_text_of

    path = scratch_path(spark, "runs")
    runs = A.runs(spark, sf_dir).withColumn("start_time", clock_text_of(F.col("start_ts"))).drop("start_ts", "end_ts")
    writers.write_snapshot(runs, path)
    return readers.read_runs(spark, path, layout="lines").select("run_id", A.ts_text("start_ts").alias("started"), "instances_discovered")


@query("entity_scan", "SELECT s_name AS summary, 'HIGH' AS severity, TRUE AS keyed, TRUE AS timed FROM supplier")
def entity_scan(spark, sf_dir):
    """A file per supplier, keyed by its stem and timed by the file."""
    path = scratch_path(spark, "entities")
    rows = A.table(spark, sf_dir, "supplier").select(F.lit("HIGH").alias("severity"), F.col("s_name").alias("summary"))
    # Small tables come as one task; and the second way of committing lets each task move its files, not the driver all.
    dealt = rows.repartition(spark.sparkContext.defaultParallelism)
    dealt.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", "2").json(path)
    found = readers.read_reports(spark, path)
    keyed = (F.col("resource_id") != "") & ~F.col("resource_id").contains(".json")
    return found.select("summary", "severity", keyed.alias("keyed"), F.col("detected_at").isNotNull().alias("timed"))


@query(
    "archive_scan",
    "SELECT '2024-01-0' || o_orderpriority[1] || ' 04:30:00' AS archived, o_orderkey AS k, CASE WHEN o_orderstatus <> 'P' THEN 'HIGH' END AS severity FROM orders",
)
def archive_scan(spark, sf_dir):
    """A run folder per priority, and a folder that is no run; unrated reports stay with a null severity."""
    base = scratch_path(spark, "archives")
    orders = A.table(spark, sf_dir, "orders")
    rated = F.when(F.col("o_orderstatus") != "P", "high")
    reports = orders.select(F.substring("o_orderpriority", 1, 1).alias("day"), rated.alias("severity"), F.col("o_orderkey").cast("string").alias("summary"))
    for day in "12345":
        reports.where(F.col("day") == day).drop("day").write.json(f"{base}/0{day}-01-2024_10-00-00/reports")
    reports.drop("day").limit(1).write.json(f"{base}/notes/reports")
    found = readers.read_archives(spark, base)
    return found.select(A.ts_text("archive_ts").alias("archived"), F.col("summary").cast("bigint").alias("k"), "severity")


@query("feed_defaults", "SELECT o_orderpriority AS type, count(*) AS n, 0 AS labels, 0 AS absent FROM orders GROUP BY ALL")
def feed_defaults(spark, sf_dir):
    """A published table without one column, and one that was never published."""
    path = scratch_path(spark, "resources")
    A.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("type"), F.col("o_orderkey").cast("string").alias("id")).write.parquet(path)
    absent = readers.read_feed_table(spark, f"{path}-none", "resources").select("type", "id", "label", F.lit(1).alias("gone"))
    found = readers.read_feed_table(spark, path, "resources").withColumn("gone", F.lit(0)).unionByName(absent)
    return found.groupBy("type").agg(F.count("*").alias("n"), F.count("label").cast("int").alias("labels"), F.sum("gone").cast("int").alias("absent"))


@query("context_table", f"SELECT 'lb-' || o_orderkey AS instance_id, 'Load Balancer' AS resource_type, {C_ORDER} AS target FROM orders")
def context_table(spark, sf_dir):
    """Documents stored in a table partitioned by type and read back with partition pruning."""
    from tidewatch.operators import context

    path = scratch_path(spark, "contexts")
    writers.write_contexts(context.envelope(A.fleet_contexts(spark, sf_dir)), path)
    lb = F.col("context.load_balancer")
    stored = spark.read.parquet(path).filter(F.col("resource_type") == "Load Balancer")
    return stored.select("instance_id", "resource_type", lb["target_groups"][0]["targets"][0]["instance_id"].alias("target"))


@query("publish_roundtrip", "SELECT o_orderpriority AS type, count(*) AS runs FROM orders GROUP BY ALL")
def publish_roundtrip(spark, sf_dir):
    """Two versions are published; readers get the second one."""
    base = scratch_path(spark, "feed")
    orders = A.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("type")).agg(F.count(F.lit(1)).alias("runs"))
    writers.publish({"types": orders.withColumn("runs", F.lit(0).cast("bigint"))}, base, 1)
    writers.publish({"types": orders}, base, 2)
    return writers.read_published(spark, base, "types")


@query("archive_partitions", "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'first' ELSE 'second' END AS run_id FROM orders")
def archive_partitions(spark, sf_dir):
    """Two runs archived under their ids, the first of them twice."""
    path = scratch_path(spark, "archive")
    orders = A.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    first = orders.filter(F.col("o_orderstatus") == "F").drop("o_orderstatus")
    writers.archive_run(first, path, "first")
    writers.archive_run(orders.filter(F.col("o_orderstatus") != "F").drop("o_orderstatus"), path, "second")
    writers.archive_run(first, path, "first")
    return spark.read.parquet(path)


@query("log_scan", "SELECT event_type AS logger, count(*) AS lines FROM events GROUP BY ALL")
def log_scan(spark, sf_dir):
    from tidewatch.operators import extract
    from tidewatch.plans.q_extract import _log_lines

    path = scratch_path(spark, "logs")
    lines = _log_lines(spark, sf_dir).select(F.col("value").alias("log"), F.lit("stdout").alias("stream"))
    lines.write.json(path)
    return extract.parse_log_lines(readers.read_log_lines(spark, path)).groupBy("logger").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "analysis_ledger",
    """
SELECT CAST(o_orderkey AS VARCHAR) AS resource_id, CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 'first ' || o_orderkey ELSE 'second ' || o_orderkey END AS response,
  CASE WHEN o_orderstatus = 'F' THEN 2 WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END::INTEGER AS attempts, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END::INTEGER AS failed_attempts,
  CASE WHEN o_orderstatus = 'F' THEN 'no answer' END AS error FROM orders""",
)
def analysis_ledger(spark, sf_dir):
    """Two runs over one ledger: the second does not call what the first has answered."""
    from tidewatch.operators import ledger

    def answering(word):
        def answer(text):
            if text.startswith("F"):
                raise RuntimeError("no answer")
            return f"{word} {text[2:]}"

        return answer

    path = scratch_path(spark, "ledger")
    orders = A.table(spark, sf_dir, "orders")
    prompts = orders.select(
        F.lit("order").alias("resource_type"), F.col("o_orderkey").cast("string").alias("resource_id"), F.concat_ws("|", "o_orderstatus", F.col("o_orderkey").cast("string")).alias("text"), "o_orderpriority"
    )
    options = dict(max_attempts=2, parallel_calls=8, task_calls=2_000, sleep=lambda seconds: None)
    ledger.answer(prompts.where("o_orderpriority = '1-URGENT'"), answering("first"), path, **options)
    return ledger.answer(prompts, answering("second"), path, **options).select("resource_id", "response", "attempts", "failed_attempts", "error")


@query(
    "run_store_roundtrip",
    """
WITH r AS (SELECT CASE o_orderstatus WHEN 'F' THEN '05-01-2024_10-30-00' ELSE '06-01-2024_10-30-00' END AS run_id, * FROM orders),
c AS (SELECT run_id, o_custkey, arg_max(o_orderpriority, o_orderkey) AS p FROM r GROUP BY ALL),
cur AS (SELECT o_custkey, max(run_id) AS run_id FROM c GROUP BY ALL)
SELECT run_id, 'SUCCESS' AS status, count(*) AS reports_generated, count(*) AS archived, count(*) FILTER (p = '2-HIGH') AS high, 30.5::DOUBLE AS seconds,
  (SELECT count(*) FROM cur WHERE cur.run_id = c.run_id) AS current FROM c GROUP BY run_id""",
)
def run_store_roundtrip(spark, sf_dir):
    """Two runs are stored one after another and found again as history, archives and current reports."""
    import datetime as dt

    from tidewatch.functions import columns as C
    from tidewatch.operators import analyze
    from tidewatch.plans import run_store

    base = scratch_path(spark, "store")
    history = A.report_history(spark, sf_dir, "o_orderstatus")
    for day, of in ((5, F.col("o_orderstatus") == "F"), (6, F.col("o_orderstatus") != "F")):
        at = dt.datetime(2024, 1, day, 5, tzinfo=dt.timezone.utc)
        rows = analyze.latest_reports(history.where(of).drop("o_orderstatus"), ["resource_id"], ["report_no"])
        # Read by the counters, the archive and the table: made once.
        reports = cut_lineage(rows.select(
            F.lit("EC2").alias("resource_type"), F.col("resource_id").cast("string").alias("resource_id"), F.lit(f"run of day {day}").alias("summary"), "severity", "confidence", "root_cause",
            F.array().cast("array<string>").alias("evidence"), F.array().cast("array<string>").alias("recommendations"), F.lit(None).cast("string").alias("raw_response"), C.instant(at).alias("detected_at"),
        ))
        outcomes = reports.select("resource_type", "resource_id", F.lit(None).cast("string").alias("error"), F.lit(0).alias("failed_attempts"))
        timed = analyze.run_counters(reports.select(F.lit(True).alias("eligible")), outcomes).withColumns({"start_ts": C.instant(at), "end_ts": C.instant(at + dt.timedelta(seconds=30.5))})
        run_store.store_run(base, {"run": analyze.run_records(timed), "reports": reports})
    held = run_store.history(spark, base)
    archived = held["archived"].groupBy("run_id").agg(F.count("*").alias("archived"), F.count_if(F.col("severity") == "HIGH").alias("high"))
    current = held["reports"].groupBy(F.when(F.col("summary") == "run of day 5", "05-01-2024_10-30-00").otherwise("06-01-2024_10-30-00").alias("run_id")).agg(F.count("*").alias("current"))
    runs = held["runs"].select("run_id", "status", "reports_generated", F.col("execution_time_seconds").alias("seconds"))
    return runs.join(archived, "run_id", "left").join(current, "run_id", "left").withColumn("current", F.coalesce("current", F.lit(0).cast("long")))


@query(
    "keyed_upserts",
    """
SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 3 THEN 'third' WHEN c_nationkey < 12 THEN 'second' ELSE 'first' END AS batch, c_acctbal AS balance FROM customer WHERE c_nationkey >= 12 OR c_custkey % 3 <> 0 OR c_custkey % 10 = 3
UNION ALL SELECT -s_suppkey, 'third', s_acctbal FROM supplier""",
)
def keyed_upserts(spark, sf_dir):
    """Three batches and a deletion into one table by key."""
    path = scratch_path(spark, "keyed")
    customers = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), "c_nationkey")
    named = lambda rows, word: rows.select("id", F.lit(word).alias("batch"), "balance")
    writers.upsert(named(customers, "first"), path, ["id"])
    low = customers.where("c_nationkey < 12")
    writers.upsert(named(low, "second"), path, ["id"])
    writers.remove_keys(low.where("id % 3 = 0").select("id"), path, ["id"])
    fresh = A.table(spark, sf_dir, "supplier").select((-F.col("s_suppkey")).alias("id"), F.col("s_acctbal").alias("balance"))
    writers.upsert(named(customers.where("id % 10 = 3").select("id", "balance").union(fresh), "third"), path, ["id"])
    return writers.read_keyed(spark, path)


@query(
    "stored_lookup",
    """
SELECT CAST(o_orderkey AS VARCHAR) AS report_id, CAST(o_custkey AS VARCHAR) AS instance_id FROM orders WHERE o_orderkey = 77 OR o_custkey = 77
ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 1""",
)
def stored_lookup(spark, sf_dir):
    """A report looked up in a table with Bloom filters on both of its ids."""
    from tidewatch.operators import history
    from tidewatch.sources import lookups

    path = scratch_path(spark, "reports")
    reports = A.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("report_id"), F.col("o_custkey").cast("string").alias("instance_id"), A.utc("o_orderdate").alias("detected_at")
    )
    lookups.write_for_lookup(reports, path, ["report_id", "instance_id"])
    return history.get_report(spark.read.parquet(path), "77").select("report_id", "instance_id")


# --- streams ----------------------------------------------------------------------


def event_stream(spark, sf_dir):
    """The events table as a file stream with domain names."""
    raw = jobs.ingest(spark, f"{sf_dir}/events.parquet*", EVENTS, ts="ts")
    return raw.select("event_id", F.col("user_id").alias("resource_id"), F.col("event_type").alias("metric"), "ts", "value")


@query("stream_ingest", "SELECT event_id, user_id AS resource_id, event_type AS metric, value FROM events")
def stream_ingest(spark, sf_dir):
    out = scratch_path(spark, "ingest")
    jobs.run_once(event_stream(spark, sf_dir).drop("ts"), out, scratch_path(spark, "ckpt"))
    return spark.read.parquet(out)


@query(
    "stream_tumbling",
    """
SELECT event_type AS metric, strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS bin, round(sum(value), 6) AS sum_value, round(avg(value), 6) AS avg_value, max(value) AS max_value,
  count(*) AS samples FROM events WHERE time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL""",
)
def stream_tumbling(spark, sf_dir):
    """Windows that the watermark has closed; the newest wait for later rows."""
    out = scratch_path(spark, "tumbling")
    jobs.run_once(jobs.tumbling_statistic(event_stream(spark, sf_dir), ["metric"]), out, scratch_path(spark, "ckpt"))
    return spark.read.parquet(out).select(
        "metric", A.ts_text("ts").alias("bin"), F.round("sum_value", 6).alias("sum_value"), F.round("avg_value", 6).alias("avg_value"), "max_value", "samples"
    )


@query(
    "stream_sliding",
    """
WITH w AS (SELECT event_type AS metric, value, time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE * k AS start FROM events, range(12) t(k))
SELECT metric, strftime(start, '%Y-%m-%d %H:%M:%S') AS bin, round(sum(value), 6) AS sum_value, count(*) AS samples FROM w
WHERE start + INTERVAL 60 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL""",
)
def stream_sliding(spark, sf_dir):
    out = scratch_path(spark, "sliding")
    jobs.run_once(jobs.sliding_statistic(event_stream(spark, sf_dir), ["metric"]), out, scratch_path(spark, "ckpt"))
    return spark.read.parquet(out).select("metric", A.ts_text("ts").alias("bin"), F.round("sum_value", 6).alias("sum_value"), "samples")


@query(
    "stream_alerts",
    f"""
WITH {THRESHOLDS_SQL}, j AS (SELECT event_id, event_type AS metric, value, op, threshold FROM events JOIN th ON event_type = metric)
SELECT event_id, metric, value, op, threshold FROM j WHERE {BREACH_SQL}""",
)
def stream_alerts(spark, sf_dir):
    out = scratch_path(spark, "alerts")
    alerts = jobs.breach_alerts(event_stream(spark, sf_dir), A.thresholds_table(spark), ["metric"])
    jobs.run_once(alerts.select("event_id", "metric", "value", "op", "threshold"), out, scratch_path(spark, "ckpt"))
    return spark.read.parquet(out)


@query("stream_dedup", "SELECT event_id, event_type AS metric FROM events")
def stream_dedup(spark, sf_dir):
    """Every event arrives twice, as from two overlapping polls."""
    out = scratch_path(spark, "dedup")
    stream = event_stream(spark, sf_dir)
    jobs.run_once(jobs.dedup_events(stream.union(event_stream(spark, sf_dir))).select("event_id", "metric"), out, scratch_path(spark, "ckpt"))
    return spark.read.parquet(out)


@query(
    "stream_severity_changes",
    """
WITH s AS (SELECT CAST(user_id AS VARCHAR) AS resource_id, ts,
  CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'HIGH' WHEN 'click' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS r FROM events),
l AS (SELECT *, lag(severity) OVER w AS prev, lag(r) OVER w AS rp FROM s WINDOW w AS (PARTITION BY resource_id ORDER BY ts, r, severity))
SELECT resource_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, severity, prev IS NULL AS is_new, CASE WHEN r > rp THEN prev END AS severity_changed_from
FROM l WHERE prev IS NULL OR r > rp""",
)
def stream_severity_changes(spark, sf_dir):
    """Every change of every resource in event time."""
    metric = F.col("metric")
    severity = F.when(metric == "error", "CRITICAL").when(metric == "purchase", "HIGH").when(metric == "click", "MEDIUM").otherwise("LOW")
    reports = event_stream(spark, sf_dir).select(F.col("resource_id").cast("string").alias("resource_id"), severity.alias("severity"), F.col("ts").alias("detected_at"))
    out, checkpoint = scratch_path(spark, "severity"), scratch_path(spark, "ckpt")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    jobs.run_once(jobs.severity_changes(reports), out, checkpoint)
    # The newest reports still wait for the watermark.
    every = spark.read.parquet(out).unionByName(jobs.waiting_changes(spark, checkpoint))
    return every.select("resource_id", A.ts_text("detected_at").alias("at"), "severity", "is_new", "severity_changed_from")


@query(
    "stream_progress",
    """
SELECT user_id AS run_id, arg_max(event_type, ts) AS phase, CAST(arg_max(least(CAST(round_even(value, 0) AS BIGINT), 100), ts) AS INTEGER) AS percent FROM events GROUP BY ALL""",
)
def stream_progress(spark, sf_dir):
    out = scratch_path(spark, "progress")
    phases = event_stream(spark, sf_dir).select(F.col("resource_id").alias("run_id"), F.col("metric").alias("phase"), F.col("value").alias("percent"), "ts")
    jobs.run_batches(phases, jobs.keep_progress(out), scratch_path(spark, "ckpt"))
    return jobs.run_progress(spark, out).select("run_id", "phase", "percent")
