import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators import feed, history, retention

UTC = dt.timezone.utc
RUNS = (
    "run_id string, status string, start_ts timestamp, end_ts timestamp, execution_time_seconds double, instances_discovered long, "
    "instances_analyzed long, resources_skipped long, successful long, failed long, reports_generated long, collectors map<string,string>"
)


def at(day, hour=0, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


def run(id_, start, status="SUCCESS", seconds=10.5, counts=(10, 8, 1, 8, 0, 8), collectors=None):
    return (id_, status, start, start, seconds, *counts, collectors or {"cloudwatch": "success", "alb": "FAILED"})


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).collect()[0]["v"]


# --- columns --------------------------------------------------------------------------


@pytest.mark.parametrize(
    "raw, want",
    [(None, None), ("abc", None), ("NaN", 1.0), ("-1", 0.0), ("0", 0.0), ("0.5", 0.5), ("1", 1.0), ("1.5", 0.015), ("100", 1.0), ("250", 1.0)],
)
def test_confidence(spark, raw, want):
    assert value(spark, C.unit_confidence(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw, want", [("0.5", 0), ("1.5", 2), ("2.5", 2), ("-0.5", 0), ("x", None), ("NaN", None), (None, None), ("24.8", 25)])
def test_round_whole(spark, raw, want):
    assert value(spark, C.round_whole(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("seconds, want", [("59", "59s"), ("60", "1m 0s"), ("3599", "59m 59s"), ("3600", "1h 0m"), ("x", "—"), ("7384", "2h 3m")])
def test_duration_text(spark, seconds, want):
    assert value(spark, C.duration_text(F.lit(seconds))) == want


@pytest.mark.parametrize("raw, want", [("1234567", "1,234,567"), ("1234.56", "1,234.6"), ("-5", "-5"), ("abc", "—"), (None, "—")])
def test_number_text(spark, raw, want):
    assert value(spark, C.number_text(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(
    "seconds, want", [(-5, "just now"), (59, "just now"), (59.5, "just now"), (60, "1 min ago"), (3600, "1 hr ago"), (86400, "1d ago"), (29 * 86400, "29d ago"), (31 * 86400, "Dec 01, 2023")],
)
def test_age_text(spark, seconds, want):
    now = at(1)
    assert value(spark, C.age_text(F.lit(now - dt.timedelta(seconds=seconds)), F.lit(now))) == want


def test_short_text(spark):
    assert value(spark, C.short_text(F.lit("x" * 160))) == "x" * 160
    assert value(spark, C.short_text(F.lit("x" * 158 + " yz"))) == "x" * 158 + "…"
    assert value(spark, C.short_text(F.lit(None).cast("string"))) == "No summary available."


@pytest.mark.parametrize(
    "text, want", [("05-01-2024_10-30-00", at(5, 5)), ("20240105_103000", at(5, 5)), ("5-1-2024_1-2-3", dt.datetime(2024, 1, 4, 19, 32, 3)), ("bad", None), (None, None)],
)
def test_parse_run_id(spark, text, want):
    assert value(spark, C.parse_run_id(F.lit(text).cast("string"))) == want


def test_clock_text_round_trip(spark):
    assert value(spark, C.parse_clock_text(C.clock_text_of(F.lit(at(5, 5))))) == at(5, 5)
    assert value(spark, C.parse_clock_text(F.lit("nonsense IST"))) is None
    assert value(spark, C.iso_display(F.lit(at(5, 5)))) == "2024-01-05T10:30:00+05:30"
    assert value(spark, C.iso_display(F.lit(at(5, 5).replace(microsecond=1200)))) == "2024-01-05T10:30:00.001200+05:30"


def test_arn_suffixes(spark):
    assert value(spark, C.lb_dimension(F.lit("arn:aws:x:loadbalancer/app/prod/50dc"))) == "app/prod/50dc"
    assert value(spark, C.lb_dimension(F.lit("arn:aws:x"))) is None
    assert value(spark, C.target_group_dimension(F.lit("arn:targetgroup/web/6d0e"))) == "targetgroup/web/6d0e"


# --- as-of ----------------------------------------------------------------------------


@pytest.mark.parametrize("bucket_seconds", [60, 3600, 86400])
def test_as_of_join_matches_bisect(spark, bucket_seconds):
    rng = random.Random(bucket_seconds)
    base = at(1)
    starts = sorted({base + dt.timedelta(seconds=rng.randrange(0, 5 * 86400, 30)) for _ in range(40)})
    starts += [at(2), at(3, 1)]
    starts = sorted(set(starts))
    runs = [(f"r{i:03d}", s) for i, s in enumerate(starts)]
    facts = [(i, base - dt.timedelta(hours=3) + dt.timedelta(seconds=rng.randrange(7 * 86400))) for i in range(300)]
    facts += [(1000 + i, s) for i, s in enumerate(starts)] + [(2000 + i, s - dt.timedelta(microseconds=1)) for i, s in enumerate(starts)]
    fdf = spark.createDataFrame(facts, "id int, ts timestamp")
    rdf = spark.createDataFrame([*runs, ("none", None)], "run_id string, start_ts timestamp")
    got = {r["id"]: r["run_id"] for r in feed.as_of_join(fdf, rdf, "ts", "start_ts", "run_id", bucket_seconds).collect()}
    want = {}
    for i, ts in facts:
        k = bisect.bisect_right(starts, ts)
        want[i] = runs[k - 1][0] if k else None
    assert got == want


def test_as_of_join_same_start_and_no_runs(spark):
    facts = spark.createDataFrame([(1, at(2))], "id int, ts timestamp")
    schema = "run_id string, start_ts timestamp"
    both = spark.createDataFrame([("a", at(1)), ("b", at(1))], schema)
    assert feed.as_of_join(facts, both, "ts", "start_ts", "run_id").collect()[0]["run_id"] == "b"
    assert feed.as_of_join(facts, spark.createDataFrame([], schema), "ts", "start_ts", "run_id").collect()[0]["run_id"] is None


def test_as_of_join_over_a_long_gap(spark):
    facts = spark.createDataFrame([(1, at(2)), (2, dt.datetime(8999, 1, 1)), (3, dt.datetime(9000, 6, 1)), (4, None)], "id int, ts timestamp")
    runs = spark.createDataFrame([("near", at(1)), ("far", dt.datetime(9000, 1, 1))], "run_id string, start_ts timestamp")
    got = {r["id"]: r["run_id"] for r in feed.as_of_join(facts, runs, "ts", "start_ts", "run_id").collect()}
    assert got == {1: "near", 2: "near", 3: "far", 4: None}


def test_as_of_join_plan(spark, sf_dir):
    from tidewatch.plans.queries import QUERIES

    plan = QUERIES["asof_run"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


# --- feed -----------------------------------------------------------------------------


def test_diff_and_state(spark):
    now = [("a", "HIGH"), ("b", "HIGH"), ("c", "LOW"), ("d", "CRITICAL"), ("e", "ODD"), ("f", "LOW")]
    before = [("b", "HIGH"), ("c", "HIGH"), ("d", "MEDIUM"), ("e", "LOW"), ("f", "ODD")]
    schema = "resource_id string, severity string"
    got = {r["resource_id"]: (r["is_new"], r["severity_changed_from"]) for r in feed.diff_severity(spark.createDataFrame(now, schema), spark.createDataFrame(before, schema)).collect()}
    assert got == {"a": (True, None), "b": (False, None), "c": (False, None), "d": (False, "MEDIUM"), "e": (False, None), "f": (False, "ODD")}
    state = feed.state_of(spark.createDataFrame([("a", None), ("b", "low"), ("c", "")], schema))
    assert {r["resource_id"]: r["severity"] for r in state.collect()} == {"a": "UNKNOWN", "b": "LOW", "c": "UNKNOWN"}


def test_collectors_and_latest_run(spark):
    runs = spark.createDataFrame([run("old", at(1)), run("new", at(2)), run("bad", None)], RUNS)
    got = {r["collector"]: r["status"] for r in feed.collector_health(runs).collect()}
    assert got == {"CloudWatch": "Healthy", "ALB": "Degraded", "AutoScaling": "Degraded", "CloudTrail": "Degraded"}
    assert feed.latest_execution(runs).collect()[0]["run_id"] == "new"
    assert feed.collector_health(runs.limit(0)).count() == 0


def test_executions_pass_unknown_status_through(spark):
    runs = spark.createDataFrame([run("a", at(1), "partial_success", 2.5), run("b", at(2), "Odd"), run("c", None, None, None, (None,) * 6)], RUNS)
    rows = feed.newest_first(feed.executions(runs), "start_time", "run_id").collect()
    assert [(r["run_id"], r["status"], r["execution_time"]) for r in rows] == [("b", "Odd", 10), ("a", "COMPLETED_WITH_ERRORS", 2), ("c", None, None)]
    assert rows[2]["successful"] == 0 and rows[2]["start_time"] is None
    assert history.list_executions(feed.executions(runs)).collect()[0]["run_id"] == "c"  # a run id sorts as text where no time is known


def test_kpis(spark):
    reports = spark.createDataFrame([("a", "CRITICAL"), ("b", "HIGH"), ("c", "MEDIUM"), ("d", "LOW"), ("e", "UNKNOWN")], "resource_id string, severity string")
    runs = spark.createDataFrame([run("r", at(1), counts=(10, 3, 0, 2, 1, 2))], RUNS)
    k = feed.kpi_row(runs, reports).collect()[0]
    assert (k["total_resources"], k["critical_issues"], k["high_severity"], k["investigations"], k["success_rate"]) == (10, 1, 1, 2, 66.7)
    h = feed.infrastructure_health(runs, reports).collect()[0]
    assert (h["total"], h["healthy"], h["warning"], h["critical"], h["unknown"]) == (10, 1, 2, 1, 6)
    none = spark.createDataFrame([run("r", at(1), counts=(0, 0, 0, 0, 0, 0))], RUNS)
    assert feed.kpi_row(none, reports).collect()[0]["success_rate"] is None
    assert feed.kpi_row(runs.limit(0), reports).count() == 0
    plan = feed.kpi_row(runs, reports)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_trend_keeps_empty_archives(spark):
    archived = spark.createDataFrame([(at(1), "a", "HIGH"), (at(1), "b", "odd"), (at(1), "c", "low")], "archive_ts timestamp, resource_id string, severity string")
    archives = spark.createDataFrame([(at(1),), (at(2),)], "archive_ts timestamp")
    got = {r["archive_ts"]: (r["critical"], r["high"], r["medium"], r["low"]) for r in feed.severity_trend(archived, archives).collect()}
    assert got == {at(1): (0, 1, 0, 1), at(2): (0, 0, 0, 0)}


def test_top_affected(spark):
    rows = [(at(d), f"r{k}", "LOW" if k % 2 else "HIGH") for d in range(1, 8) for k in range(d)]
    archived = spark.createDataFrame(rows, "archive_ts timestamp, resource_id string, severity string")
    contexts = spark.createDataFrame([("r0", "EC2"), ("r1", "Load Balancer")], "resource_id string, resource_type string")
    got = sorted((-r["incidents"], r["resource_id"], r["type"]) for r in feed.top_affected(archived, contexts, 3).collect())
    assert got == [(-7, "r0", "EC2 Instance"), (-6, "r1", "Load Balancer"), (-5, "r2", "—")]
    high = {r["resource_id"] for r in feed.top_affected(archived, contexts, 9, "HIGH").collect()}
    assert high == {"r0", "r2", "r4", "r6"}


def test_telemetry_of_groups(spark):
    from tidewatch.schemas import ASG_RESOURCE, LB_RESOURCE

    asg = spark.createDataFrame([(1,)], "x int").select(
        F.from_json(F.lit('{"instances":[{"lifecycle_state":" STANDBY "},{"lifecycle_state":null},{"lifecycle_state":"InService"}],"metrics":{"pending":1}}'), ASG_RESOURCE).alias("g"),
        F.from_json(F.lit('{"target_groups":[{"healthy_hosts":2},{"unhealthy_hosts":3}],"metrics":{"elb_4xx":1,"target_4xx":2}}'), LB_RESOURCE).alias("lb"),
    )
    row = asg.select(feed.asg_telemetry(F.col("g")).alias("g"), feed.lb_telemetry(F.col("lb")).alias("lb")).collect()[0]
    assert (row["g"]["standby_instances"], row["g"]["pending_instances"]) == (1, 1.0)
    assert (row["lb"]["healthy_targets"], row["lb"]["unhealthy_targets"], row["lb"]["http_4xx"], row["lb"]["http_5xx"]) == (2.0, 3.0, 3.0, 0.0)


def test_tree_takes_the_worst_child(spark):
    members = spark.createDataFrame(
        [("lb", "t1", "i1", "LOW"), ("lb", "t1", "i2", "HIGH"), ("lb", "t2", "i3", None)], "lb string, target_group string, instance_id string, severity string"
    )
    got = {r["node_id"]: (r["level"], r["parent_id"], r["status"], r["child_count"]) for r in feed.resource_tree(members).collect()}
    assert got["lb"] == (0, None, "HIGH", 2) and got["t1"] == (1, "lb", "HIGH", 2) and got["t2"] == (1, "lb", "UNKNOWN", 1)
    more = members.union(spark.createDataFrame([("a-lb", "t9", "i0", "LOW"), ("lb", "t1", "a0", "LOW")], members.schema))
    walked = [(r["level"], r["node_id"], r["status"]) for r in feed.tree_in_order(more).collect()]
    assert [n for _, n, _ in walked] == ["a-lb", "t9", "i0", "lb", "t1", "a0", "i1", "i2", "t2", "i3"]
    assert walked[3] == (0, "lb", "HIGH") and walked[-1] == (2, "i3", "UNKNOWN")


def test_day_over_day(spark):
    runs = spark.createDataFrame([run("a", at(1)), run("b", at(2)), run("c", at(2, 5))], RUNS)
    rows = feed.day_over_day(feed.daily_runs(runs), ["runs"]).orderBy("day").collect()
    assert [(r["runs"], r["runs_delta"], r["delta_label"]) for r in rows] == [(1, None, None), (2, 1, "from yesterday")]


# --- history --------------------------------------------------------------------------


def test_search_and_filters(spark):
    ex = spark.createDataFrame([("Run-A", "Full", "COMPLETED"), ("run-b", None, "FAILED")], "run_id string, type string, status string")
    ids = lambda df: sorted(r["run_id"] for r in df.collect())
    assert ids(history.search(ex, "  ")) == ["Run-A", "run-b"] and ids(history.search(ex, " FULL ")) == ["Run-A"]
    assert ids(history.search(ex, "RUN-B")) == ["run-b"]
    assert ids(history.filter_status(ex, "All")) == ["Run-A", "run-b"] and ids(history.filter_status(ex, "failed")) == ["run-b"]
    assert [r["type"] for r in history.facets(ex, "type").collect()] == ["Full"]


def test_report_lookup_prefers_the_first_listed(spark):
    reports = spark.createDataFrame([("x", "i1", at(1)), ("i1", "y", at(2))], "report_id string, instance_id string, detected_at timestamp")
    assert history.get_report(reports, "i1").collect()[0]["report_id"] == "i1"
    assert history.get_report(reports, "none").count() == 0


def test_progress(spark):
    events = spark.createDataFrame(
        [("r", "COLLECTING_METRICS", 10, None, at(1, 0, 1)), ("r", "RUNNING_AI_ANALYSIS", 120, "i-1", at(1, 0, 2))],
        "run_id string, phase string, percent int, current_resource string, ts timestamp",
    )
    started = spark.createDataFrame([("r", at(1)), ("q", at(1))], "run_id string, started_at timestamp")
    got = {r["run_id"]: r for r in history.run_progress(events, started, at(1, 1)).collect()}
    assert (got["r"]["status"], got["r"]["percent"], got["r"]["elapsed_seconds"], got["r"]["remaining_seconds"]) == ("RUNNING", 100, 3600, 0)
    assert [p["state"] for p in got["r"]["phases"]] == ["done", "done", "active", "pending", "pending"]
    assert (got["q"]["status"], got["q"]["phase_label"], got["q"]["remaining_seconds"]) == ("QUEUED", "Queued", None)


def test_progress_of_ended_runs(spark):
    rows = []
    for run_id, end in (("ok", "COMPLETED"), ("bad", "FAILED")):
        rows += [(run_id, "BUILDING_CONTEXT", 15, "i-1", at(1, 0, 1)), (run_id, "RUNNING_AI_ANALYSIS", 45, None, at(1, 0, 2)), (run_id, end, None, None, at(1, 0, 3))]
    events = spark.createDataFrame(rows, "run_id string, phase string, percent int, current_resource string, ts timestamp")
    started = spark.createDataFrame([("ok", at(1)), ("bad", at(1))], "run_id string, started_at timestamp")
    got = {r["run_id"]: r for r in history.run_progress(events, started, at(1, 1)).collect()}
    ok, bad = got["ok"], got["bad"]
    assert (ok["status"], ok["phase_label"], ok["percent"], ok["remaining_seconds"]) == ("COMPLETED", "Completed", 100, None)
    assert {p["state"] for p in ok["phases"]} == {"done"} and ok["current_resource"] == "i-1"
    assert (bad["status"], bad["phase_label"], bad["percent"]) == ("FAILED", "Failed", 45)
    assert [p["state"] for p in bad["phases"]] == ["done", "done", "active", "pending", "pending"]


def test_picker_text(spark):
    rows = [("EC2", "i-b", None), ("EC2", "i-c", "Alpha"), ("EC2", "", "x"), ("EC2", "i-a", "i-a")]
    got = history.resources_for_type(spark.createDataFrame(rows, "type string, id string, label string"), "EC2").collect()
    assert [r["display"] for r in got] == ["Alpha (i-c)", "i-a", "i-b"]


# --- retention ------------------------------------------------------------------------


def test_archives_are_kept_by_time_not_by_text(spark):
    stamps = [dt.datetime(2024, 1, 31), dt.datetime(2024, 2, 1), dt.datetime(2024, 2, 2)]
    archived = spark.createDataFrame([(s, i) for s in stamps for i in range(3)], "archive_ts timestamp, n int")
    kept = {r["archive_ts"] for r in retention.keep_newest_archives(archived, n=2).collect()}
    assert kept == set(stamps[1:])
    assert retention.expired_archives(archived, n=2).count() == 3


def test_delete_requests(spark):
    ids = "run_id string"
    good, archived_only, unknown = "01-01-2024_00-00-00", "02-01-2024_00-00-00", "03-01-2024_00-00-00"
    asked = spark.createDataFrame([(good,), (archived_only,), (unknown,), ("../etc",), (good,)], ids)
    runs = spark.createDataFrame([(good,), ("../etc",), ("09-01-2024_00-00-00",)], ids)
    fields = "run_id string, resource_id string, severity string, note string"
    archived = spark.createDataFrame([(good, "a", "LOW", None), (good, "b", "LOW", "x"), (archived_only, "a", "LOW", None), ("kept", "c", "LOW", "x")], fields)
    current = spark.createDataFrame([("a", "LOW", None), ("b", "HIGH", "x"), ("c", "LOW", "x")], "resource_id string, severity string, note string")
    out = retention.delete_runs(asked, runs, archived, current, "resource_id", ["severity", "note"])
    assert {r["run_id"]: r["outcome"] for r in out["outcome"].collect()} == {good: "deleted", archived_only: "deleted", unknown: "not_found", "../etc": "not_found"}
    assert {r["resource_id"] for r in out["reports"].collect()} == {"b", "c"}
    assert [r["resource_id"] for r in out["deleted_reports"].collect()] == ["a"]
    assert out["runs"].count() == 2 and out["archived"].count() == 1


def test_delete_guard(spark):
    status = spark.createDataFrame([("a", "RUNNING"), ("b", "COMPLETED")], "run_id string, status string")
    wanted = lambda *x: spark.createDataFrame([(i,) for i in x], "run_id string")
    with pytest.raises(ValueError, match="a"):
        retention.check_deletable(wanted("a", "b"), status)
    with pytest.raises(ValueError, match="empty"):
        retention.check_deletable(wanted(), status)
    many = [f"run-{i:03d}" for i in range(30)]
    with pytest.raises(ValueError, match=r"\(20 of 30\)"):
        retention.check_deletable(wanted(*many), spark.createDataFrame([(m, "RUNNING") for m in many], "run_id string, status string"))
    assert retention.check_deletable(wanted("b"), status).count() == 1
