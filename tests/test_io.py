import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

import factory
from factory import A
from tidewatch.operators import context, history, metrics, redact
from tidewatch.plans import investigation
from tidewatch.schemas import EC2, LOAD_BALANCER
from tidewatch.sources import readers, writers
from tidewatch.streaming import jobs

FIXED = dt.datetime(2024, 1, 5, 5, 0, tzinfo=dt.timezone.utc)


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else json.dumps(text))
    return path


def test_missing_broken_and_partial_snapshots(spark, tmp_path):
    put(tmp_path / "alb.json", '{"collector": "alb", "resources": [')
    put(tmp_path / "autoscaling.json", {"collector": "autoscaling"})
    factory.write_raw(tmp_path, {"cloudtrail": factory.envelopes()["cloudtrail"]})
    for name in ("cloudwatch", "alb", "autoscaling"):
        rows = readers.read_snapshot(spark, str(tmp_path), name)
        assert rows.count() == 0 and "snapshot_ts" in rows.columns
    assert readers.read_snapshot(spark, str(tmp_path), "cloudtrail").count() == 3
    status = {r["collector"]: r["status"] for r in readers.collector_status(spark, str(tmp_path)).collect()}
    assert status == {"cloudwatch": "FAILED", "alb": "FAILED", "autoscaling": "FAILED", "cloudtrail": "SUCCESS"}


def test_snapshot_freshness(spark, tmp_path):
    rows = readers.read_snapshot(spark, factory.write_raw(tmp_path), "alb")
    assert readers.fresh_only(rows, dt.datetime(2024, 1, 1, 10, 9), 10).count() == 2
    assert readers.fresh_only(rows, dt.datetime(2024, 1, 1, 10, 11), 10).count() == 0


def test_entity_files(spark, tmp_path):
    put(tmp_path / "i-1.json", {"severity": "high", "confidence": 80})
    put(tmp_path / "name with space.json", {"raw_response": "text"})
    put(tmp_path / "bad.json", "{")
    stamp = dt.datetime(2024, 1, 1, 12, 0).timestamp()
    os.utime(tmp_path / "i-1.json", (stamp, stamp))
    got = {r["resource_id"]: r for r in readers.read_reports(spark, str(tmp_path)).collect()}
    assert set(got) == {"i-1", "name with space"}
    assert (got["i-1"]["severity"], got["i-1"]["confidence"]) == ("high", "80")
    assert got["i-1"]["detected_at"].timestamp() == stamp
    assert readers.read_reports(spark, str(tmp_path / "none")).count() == 0


def test_run_history_order(spark, tmp_path):
    put(tmp_path / "a.json", {"run_id": "02-02-2024_00-00-00", "status": "SUCCESS"})
    put(tmp_path / "b.json", {"run_id": "20240131_000000"})
    put(tmp_path / "30-01-2024_10-00-00.json", {"status": "FAILED"})
    put(tmp_path / "c.json", {"run_id": "manual", "start_time": "01-02-2024 10:00:00 IST", "end_time": "01-02-2024 10:00:30 IST"})
    put(tmp_path / "d.json", {"run_id": "broken", "start_time": "soon"})
    rows = readers.oldest_first(readers.read_runs(spark, str(tmp_path))).collect()
    assert [r["run_id"] for r in rows] == ["broken", "30-01-2024_10-00-00", "20240131_000000", "manual", "02-02-2024_00-00-00"]
    assert (rows[3]["end_ts"] - rows[3]["start_ts"]).total_seconds() == 30


def test_files_of_many_documents(spark, tmp_path):
    docs = [{"run_id": f"r{i}", "status": "SUCCESS"} for i in range(7)]
    put(tmp_path / "lines.json", "\n".join(map(json.dumps, docs[:3])) + "\n")
    put(tmp_path / "pretty.json", "\n".join(json.dumps(d, indent=2) for d in docs[3:5]))
    put(tmp_path / "array.json", json.dumps(docs[5:], indent=1))
    put(tmp_path / "mixed.json", '{"run_id": "good"}\n{"run_id": \n{"run_id": "last"}')
    put(tmp_path / "empty.json", "")
    rows = readers.read_runs(spark, str(tmp_path))
    assert rows.count() == 9 and {r["run_id"] for r in rows.collect()} == {*(f"r{i}" for i in range(7)), "good", "last"}
    (tmp_path / "l").mkdir()
    put(tmp_path / "l" / "x.json", "\n".join(map(json.dumps, docs)))
    assert readers.read_runs(spark, str(tmp_path / "l"), layout="lines").count() == 7
    put(tmp_path / "s" / "alb.json", "\n".join(json.dumps({"collector": "alb", "resources": [{"LoadBalancerName": str(i)}]}) for i in range(5)))
    for layout in ("auto", "lines"):
        assert readers.read_snapshot(spark, str(tmp_path / "s"), "alb", layout).count() == 5


def test_archives(spark, tmp_path):
    put(tmp_path / "31-01-2024_10-00-00" / "reports" / "a.json", {"severity": "low", "summary": "s"})
    put(tmp_path / "31-01-2024_10-00-00" / "reports" / "b.json", {"raw_response": "x"})
    put(tmp_path / "notes" / "reports" / "c.json", {"severity": "LOW"})
    put(tmp_path / "01-02-2024_10-00-00" / "raw" / "x.json", {})
    rows = readers.read_archives(spark, str(tmp_path))
    assert {(r["run_id"], r["resource_id"], r["severity"]) for r in rows.collect()} == {("31-01-2024_10-00-00", "a", "LOW"), ("31-01-2024_10-00-00", "b", None)}
    assert {(r["resource_id"], r["severity"]) for r in readers.archive_severities(rows).collect()} == {("a", "LOW"), ("b", None)}


def test_stored_contexts_read_like_built_ones(spark, tmp_path):
    put(tmp_path / f"{A}.json", {"instance_id": A, "resource_type": "EC2", "context": {
        "resource_type": "EC2", "cloudwatch": factory.instance(A, "running", {"CPU": factory.payload([1, 2])}), "alb": None, "autoscaling": None,
        "cloudtrail": [{"event_name": "Start", "service": "s", "error_code": ""}, {"event_name": "Start", "service": "t", "error_code": ""}]}})
    lb = factory.load_balancer("web", "active", [("tg", [factory.target(A)])])
    put(tmp_path / "web.json", {"instance_id": "web", "resource_type": "Load Balancer", "context": lb})
    stored = readers.read_contexts(spark, str(tmp_path))
    docs = {r["resource_id"]: json.loads(r["text"]) for r in redact.render_prompts(redact.redact(stored, readers.read_context_events(spark, str(tmp_path))), "").collect()}
    assert docs[A]["context"]["cloudtrail"] == [{"event_name": "Start", "service": "s", "error_code": ""}]
    assert docs[A]["context"]["cloudwatch"]["cpu"]["H"][1] == ["10:05", 2.0] and docs[A]["context"]["alb"] is None
    assert docs["web"]["context"]["target_groups"][0]["targets"][0]["instance_id"] == A
    from tidewatch.operators import feed

    telemetry = {r["resource_id"]: r for r in feed.telemetry(stored).collect()}
    assert telemetry[A]["instance_telemetry"]["cpu"] == 1.5 and telemetry["web"]["lb_telemetry"]["healthy_targets"] == 1.0


def test_feed_table_defaults(spark, tmp_path):
    empty = readers.read_feed_table(spark, str(tmp_path / "none"), "executions")
    assert empty.count() == 0 and "finished_at" in empty.columns
    spark.createDataFrame([("r",)], "run_id string").write.parquet(str(tmp_path / "some"))
    assert readers.read_feed_table(spark, str(tmp_path / "some"), "executions").collect()[0]["status"] is None
    assert not readers.exists(spark, str(tmp_path / "none")) and readers.exists(spark, str(tmp_path / "some"))


def test_snapshot_sink_writes_text_times(spark, tmp_path):
    writers.write_snapshot(spark.createDataFrame([(dt.datetime(2024, 1, 1), 1)], "t timestamp, n int"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).collect()[0]["t"] == "2024-01-01 00:00:00"


def test_publish_switches_whole_versions(spark, tmp_path):
    base = str(tmp_path / "feed")
    assert writers.published_version(spark, base) is None
    assert writers.read_published(spark, base, "t", "n int").count() == 0
    with pytest.raises(ValueError):
        writers.read_published(spark, base, "t")
    writers.publish({"t": spark.range(2)}, base, 1)
    held = writers.read_published(spark, base, "t")
    writers.publish({"t": spark.range(5)}, base, 2)
    assert held.count() == 2 and writers.read_published(spark, base, "t").count() == 5
    # A version that was written but never pointed at stays invisible.
    spark.range(9).write.parquet(f"{base}/versions/v=3/t")
    assert writers.read_published(spark, base, "t").count() == 5


def test_archiving_a_run_again_replaces_it_only(spark, tmp_path):
    path = str(tmp_path / "arch")
    writers.archive_run(spark.range(3), path, "r1")
    writers.archive_run(spark.range(4), path, "r2")
    writers.archive_run(spark.range(2), path, "r1")
    assert {r["run_id"]: r["count"] for r in spark.read.parquet(path).groupBy("run_id").count().collect()} == {"r1": 2, "r2": 4}


def test_logs(spark, tmp_path):
    put(tmp_path / "x.log", '{"log":"2024-01-01 10:00:00,000 | INFO | A | hi\\n","stream":"stdout"}\n2024-01-01 10:00:01,000 | INFO | A | plain\n')
    lines = [r["value"] for r in readers.read_log_lines(spark, str(tmp_path)).collect()]
    assert lines == ["2024-01-01 10:00:00,000 | INFO | A | hi", "2024-01-01 10:00:01,000 | INFO | A | plain"]


# --- whole runs -----------------------------------------------------------------------


def analyst():
    """A local function, which travels to the workers by value."""

    def answer(text):
        if '"resource_type":"Load Balancer"' in text:
            return "no json"
        return json.dumps({"severity": "high", "confidence": 90, "summary": "s", "evidence": ["e"]})

    return answer


def test_run_and_feed(spark, tmp_path):
    raw = factory.write_raw(tmp_path / "raw")
    ticks = iter([FIXED, FIXED + dt.timedelta(seconds=24.8)])
    out = investigation.investigate(spark, raw, analyst(), clock=lambda: next(ticks), parallel_calls=2)
    run = out["run"].collect()[0]
    assert run["run_id"] == "05-01-2024_10-30-00" and run["execution_time_seconds"] == 24.8
    assert (run["instances_discovered"], run["instances_analyzed"], run["resources_skipped"], run["status"]) == (7, 3, 4, "SUCCESS")
    assert run["collectors"]["alb"] == "SUCCESS"
    assert out["skipped"].count() == 4
    reports = {r["resource_type"]: r for r in out["reports"].collect()}
    assert reports[LOAD_BALANCER]["raw_response"] == "no json" and reports[EC2]["severity"] == "high"
    base = str(tmp_path / "feed")
    runs = out["run"]
    archived = out["reports"].select(F.lit(FIXED).alias("archive_ts"), "resource_id", F.upper("severity").alias("severity"))
    inputs = dict(runs=runs, reports=out["reports"], contexts=out["contexts"], archived=archived)
    investigation.export_feed(base, 1, **inputs)
    path = writers.published_path(base, 1, "reports")
    first = {(r["resource_type"], r["report_id"]): r for r in readers.read_feed_table(spark, path, "reports").collect()}
    assert history.get_report(readers.read_feed_table(spark, path, "reports"), A).count() == 1
    sections = {r["section"] for r in readers.read_feed_table(spark, writers.published_path(base, 1, "analytics"), "analytics").collect()}
    assert sections == {"incident_trend", "severity_trend", "resource_distribution", "execution_time_trend"}
    # A load balancer and a scaling group share their name, and stay apart.
    assert len(first) == 3 and all(r["is_new"] for r in first.values())
    one = first[("EC2 Instance", A)]
    assert one["ai_confidence"] == 0.9 and one["run_id"] == run["run_id"] and one["instance_id"] == A
    assert one["telemetry"]["state"] == " Running " and one["telemetry"]["request_count"] is None
    kpis = {r["kpi"]: r["value"] for r in writers.read_published(spark, base, "summary").collect()}
    assert kpis == {"total_resources": 7.0, "critical_issues": 0.0, "high_severity": 2.0, "investigations": 3.0, "success_rate": 100.0}
    health = writers.read_published(spark, base, "infrastructure_health").collect()[0]
    assert (health["warning"], health["unknown"]) == (2, 4 + 1)
    investigation.export_feed(base, 2, **inputs)
    assert not any(r["is_new"] for r in writers.read_published(spark, base, "reports").collect())


def test_single_resource_run_ignores_eligibility(spark, tmp_path):
    raw = factory.write_raw(tmp_path / "raw")
    out = investigation.investigate(spark, raw, analyst(), resource_id="broken", clock=lambda: FIXED)
    assert out["reports"].collect()[0]["raw_response"] == "no json"
    assert out["run"].collect()[0]["instances_analyzed"] == 1


def test_run_by_rule(spark, tmp_path):
    raw = factory.write_raw(tmp_path / "raw")
    scored = spark.createDataFrame([(A, "CRITICAL", 15.0, 3, 0)], "resource_id string, severity string, breach_minutes double, longest_breach long, anomalies long")
    out = investigation.investigate(spark, raw, severities=scored, clock=lambda: FIXED)
    got = {(r["resource_type"], r["resource_id"]): r["severity"] for r in out["reports"].collect()}
    assert got == {(EC2, A): "CRITICAL", (LOAD_BALANCER, "shared"): "LOW", ("Auto Scaling Group", "shared"): "LOW"}
    assert out["run"].collect()[0]["successful"] == 3
    with pytest.raises(ValueError):
        investigation.investigate(spark, raw)


# --- streams --------------------------------------------------------------------------

POINTS = "resource_id string, ts timestamp, value double"


def feed_files(spark, folder, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame([(r, dt.datetime(2024, 1, 1, 10, 0) + dt.timedelta(minutes=m), float(v)) for r, m, v in rows], POINTS).coalesce(1).write.parquet(f"{folder}/b{i}")
        for f in os.listdir(f"{folder}/b{i}"):
            os.utime(f"{folder}/b{i}/{f}", (1_700_000_000 + i * 100,) * 2)


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", m, m) for m in range(0, 40, 3)] + [("b", m, 2 * m) for m in range(0, 40, 7)]
    feed_files(spark, tmp_path / "in", rows[:8], rows[8:])
    stream = jobs.ingest(spark, f"{tmp_path}/in/*", POINTS, max_files=1)
    jobs.run_once(jobs.tumbling_statistic(stream, ["resource_id"]), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = {(r["resource_id"], r["ts"]): r["sum_value"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = metrics.period_statistic(spark.read.parquet(f"{tmp_path}/in/*"), ["resource_id"], statistic=F.lit("Sum"))
    closed = {(r["resource_id"], r["ts"]): r["value"] for r in batch.collect() if r["ts"].minute + 5 <= 29}  # the newest row is of minute 39
    assert got == closed


def test_late_rows_are_dropped_in_append_mode(spark, tmp_path):
    feed_files(spark, tmp_path / "in", [("a", 0, 1), ("a", 60, 1)], [("a", 61, 0)], [("a", 1, 100), ("a", 90, 1)], [("a", 200, 1)])
    stream = jobs.ingest(spark, f"{tmp_path}/in/*", POINTS, max_files=1)
    jobs.run_once(jobs.tumbling_statistic(stream, ["resource_id"]), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = {r["ts"].minute + 60 * (r["ts"].hour - 10): r["sum_value"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got[0] == 1.0 and got[60] == 1.0 and got[90] == 1.0


def test_dedup_over_polls(spark, tmp_path):
    schema = "event_id string, ts timestamp"
    t = dt.datetime(2024, 1, 1, 10)
    for i, ids in enumerate((["x", "y"], ["y", "z"])):
        spark.createDataFrame([(e, t) for e in ids], schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
    stream = jobs.ingest(spark, f"{tmp_path}/in/*", schema, max_files=1)
    jobs.run_once(jobs.dedup_events(stream), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["x", "y", "z"]


@pytest.mark.parametrize("max_files", [1, 2, 1000])
def test_severity_changes_do_not_depend_on_batches(spark, tmp_path, max_files):
    schema = "resource_id string, severity string, detected_at timestamp"
    t = dt.datetime(2024, 1, 1, 10)
    batches = [
        [("a", "LOW", 0), ("b", "HIGH", 0)], [("a", "CRITICAL", 5)], [("a", "MEDIUM", 2), ("b", "LOW", 1), ("c", "LOW", 6)], [("a", "HIGH", 6), ("b", "HIGH", 3)],
        [("a", "CRITICAL", 60), ("c", "LOW", 58)], [("a", "LOW", 61), ("c", "MEDIUM", 59)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame([(r, s, t + dt.timedelta(minutes=m)) for r, s, m in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
        for f in os.listdir(f"{tmp_path}/in/b{i}"):
            os.utime(f"{tmp_path}/in/b{i}/{f}", (1_700_000_000 + i * 100,) * 2)
    stream = jobs.ingest(spark, f"{tmp_path}/in/*", schema, max_files=max_files)
    jobs.run_once(jobs.severity_changes(stream), f"{tmp_path}/out", f"{tmp_path}/ck")
    every = spark.read.parquet(f"{tmp_path}/out").unionByName(jobs.waiting_changes(spark, f"{tmp_path}/ck"))
    got = sorted((r["resource_id"], (r["detected_at"] - t).seconds // 60, r["severity"], r["is_new"], r["severity_changed_from"]) for r in every.collect())
    assert got == [
        ("a", 0, "LOW", True, None), ("a", 2, "MEDIUM", False, "LOW"), ("a", 5, "CRITICAL", False, "MEDIUM"), ("a", 60, "CRITICAL", False, "HIGH"),
        ("b", 0, "HIGH", True, None), ("b", 3, "HIGH", False, "LOW"), ("c", 6, "LOW", True, None), ("c", 59, "MEDIUM", False, "LOW"),
    ]


def test_alerts_and_progress(spark, tmp_path):
    feed_files(spark, tmp_path / "in", [("a", 0, 1), ("a", 1, 99)])
    stream = jobs.ingest(spark, f"{tmp_path}/in/*", POINTS)
    index = spark.createDataFrame([("a", "GT", 50.0)], "resource_id string, op string, threshold double")
    jobs.run_once(jobs.breach_alerts(stream, index, ["resource_id"]), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert [r["value"] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [99.0]


def test_a_folder_of_entities_is_listed_once(spark, tmp_path):
    for i in range(40):
        put(tmp_path / f"i-{i}.json", {"severity": "LOW"})
    (tmp_path / "deeper" / tmp_path.name).mkdir(parents=True)
    put(tmp_path / "deeper" / tmp_path.name / "i-40.json", {"severity": "LOW"})
    (tmp_path / "run_id=1").mkdir()
    put(tmp_path / "run_id=1" / "i-41.json", {"severity": "LOW"})
    (tmp_path / "many.json").mkdir()
    put(tmp_path / "many.json" / "part-0", {"severity": "HIGH"})
    put(tmp_path / "i-42.txt", {"severity": "LOW"})
    put(tmp_path / "_i-43.json", {"severity": "LOW"})
    spark.sparkContext.setJobGroup("listing", "listing")
    found = readers.read_reports(spark, f"{tmp_path}/")
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # A pattern of files is a task for each of them.
    assert max(info.numTasks for s in stages if (info := tracker.getStageInfo(s))) < 40
    rows = {r["resource_id"]: r["severity"] for r in found.collect()}
    assert rows == {**{f"i-{i}": "LOW" for i in range(40)}, "part-0": "HIGH"}
