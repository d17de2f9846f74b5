import json

import pytest
from pyspark.sql import functions as F

import factory
from factory import A, B, C
from tidewatch.operators import analyze, context, correlate, extract, redact
from tidewatch.plans import investigation
from tidewatch.sources import writers
from tidewatch.schemas import EC2, LOAD_BALANCER, RAW_AUDIT_EVENT, SCALING_GROUP


@pytest.fixture(scope="module")
def snapshots(spark, tmp_path_factory):
    return investigation.load_snapshots(spark, factory.write_raw(tmp_path_factory.mktemp("raw")))


@pytest.fixture(scope="module")
def contexts(snapshots):
    return investigation.contexts_of(snapshots).cache()


def by_key(df):
    return {(r["resource_type"], r["resource_id"]): r for r in df.collect()}


def test_spine_and_types(contexts):
    want = {(EC2, A), (EC2, B), (EC2, C), (EC2, "10.1.1.1"), (LOAD_BALANCER, "shared"), (LOAD_BALANCER, "broken"), (SCALING_GROUP, "shared")}
    assert set(by_key(contexts)) == want


def test_last_one_wins_everywhere(contexts):
    row = by_key(contexts)[(EC2, A)]["instance"]
    assert row["snapshot"]["State"] == " Running "
    assert (row["lb_membership"]["target_group"], row["lb_membership"]["health"]) == ("tg2", "unhealthy")
    assert row["asg_membership"]["asg_name"] == "shared"
    assert row["n_events"] == 3


def test_instance_known_from_events_only(contexts):
    row = by_key(contexts)[(EC2, C)]["instance"]
    assert row["snapshot"] is None and row["lb_membership"] is None
    assert row["n_events"] == 1


def audit_events(spark, names):
    """An event for each of the names, in order."""
    rows = spark.createDataFrame([(i, [("EC2 Instance", n)]) for i, n in enumerate(names)], "ord long, resources array<struct<type:string,name:string>>")
    for f in context.EVENT_FIELDS:
        rows = rows.withColumn(f, F.lit(False) if f == "read_only" else F.col("ord").cast("string"))
    return rows


def test_documents_have_one_shape_for_few_and_many_events(spark, snapshots):
    parts = [snapshots[n] for n in ("instances", "load_balancers", "groups")]
    few, many = (context.build_contexts(*parts, audit_events(spark, ["hot"] * n + ["cold"])) for n in (10, 20_000))
    assert few.schema == many.schema and few.count() == many.count()
    got = {r["resource_id"]: r["instance"]["n_events"] for r in many.where("instance.n_events > 0").collect()}
    assert got == {"hot": 20_000, "cold": 1}


def test_each_source_is_read_once(spark, snapshots):
    plan = investigation.contexts_of(snapshots)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("resources") and "Join" not in plan
    events = audit_events(spark, ["a"])
    built = context.build_contexts(*[snapshots[n] for n in ("instances", "load_balancers", "groups")], events)
    assert built._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_stored_contexts_are_merged_without_an_exchange(spark, snapshots, contexts, tmp_path):
    names = ["10.1.1.1"] * 300 + [A, B] * 20
    events = context.instance_events(extract.event_links(audit_events(spark, names).orderBy(F.desc("ord"))))
    path = str(tmp_path / "store")
    writers.store_contexts(contexts, events, path, "kept", buckets=4)
    for round_ in range(2):
        documents, told = writers.open_contexts(spark, path, "kept", buckets=4)
        merged = context.in_order(documents, told)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = merged._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "Exchange" not in plan
        rows = merged.collect()
        assert len(rows) == 300 + 40 + contexts.where(~F.col("resource_id").isin("10.1.1.1", A, B)).count()
        of = {}
        for r in rows:
            if r["event"]:
                of.setdefault(r["resource_id"], []).append(int(r["event"]["event_name"]))
        assert of == {n: [i for i, x in enumerate(names) if x == n] for n in set(names)}
        # A later session enters the stored files into its catalog anew.
        for what in ("documents", "events"):
            spark.sql(f"DROP TABLE kept_{what}")


def test_stale_and_prune(spark):
    stored = spark.createDataFrame([(EC2, "x"), (EC2, "y"), (LOAD_BALANCER, "y")], "resource_type string, resource_id string")
    current = spark.createDataFrame([(EC2, "y")], stored.schema)
    assert {tuple(r) for r in context.stale_entities(stored, current).collect()} == {(EC2, "x"), (LOAD_BALANCER, "y")}
    assert {tuple(r) for r in context.prune_stale(stored, current).collect()} == {(EC2, "y")}


def test_single_resource_equals_its_row_of_the_full_build(snapshots, contexts):
    for id_ in (A, B, C, "broken"):
        one = investigation.contexts_of(snapshots, id_).collect()
        full = [r for r in contexts.collect() if r["resource_id"] == id_]
        assert sorted(map(repr, one)) == sorted(map(repr, full))
    with pytest.raises(ValueError):
        investigation.contexts_of(snapshots, "i-none")


def test_envelope(contexts):
    row = context.envelope(contexts).filter(F.col("instance_id") == "broken").collect()[0]
    assert (row["collector_count"], row["resource_type"], row["context"]["load_balancer"]["state"]) == (4, LOAD_BALANCER, "failed")


def test_correlation(snapshots):
    spine = snapshots["instances"].select(F.col("InstanceId").alias("resource_id")).filter("resource_id <> ''").distinct()
    targets, members = context.lb_targets(snapshots["load_balancers"]), context.asg_members(snapshots["groups"])
    links = extract.event_links(snapshots["events"], None)
    row = correlate.correlation_rows(spine, targets, members, links).collect()[0]
    assert (row["target_text"], row["lifecycle_state"], row["events_found"]) == ("1/2", "InService", 3)
    assert {r["target_health"] for r in correlate.with_targets(spine, targets).collect()} == {"healthy", "unhealthy"}
    nobody = spine.select(F.lit("i-x").alias("resource_id"))
    assert correlate.with_targets(nobody, targets).collect()[0]["target_health"] == correlate.NOT_REGISTERED
    assert correlate.with_scaling(nobody, members).collect()[0]["lifecycle_state"] == correlate.NOT_SCALED
    assert correlate.event_counts(nobody, links).collect()[0]["events_found"] == 0
    assert correlate.correlation_details(spine, targets, members, links).count() == 2 + 1 + 3


# --- redaction ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def events(snapshots):
    return investigation.events_of(snapshots).cache()


def documents(contexts, events):
    rows = redact.render_prompts(redact.redact(contexts, events), instructions="").collect()
    return {(r["resource_type"], r["resource_id"]): json.loads(r["text"]) for r in rows}


def test_instance_document(contexts, events):
    doc = documents(contexts, events)[(EC2, A)]
    body = doc["context"]
    assert body["cloudwatch"] == {
        "state": " Running ",
        "cpu": {"U": "%", "TH": {"V": 80.0, "OP": "GT"}, "H": [["10:00", 10.0], ["10:05", 95.5]]},
        "disk": {"U": "%", "H": [["10:00", 1.0]]},
    }
    assert body["alb"] == {"target_health": "unhealthy", "failure_reason": "r", "failure_description": "d"}
    assert body["autoscaling"] == {"health_status": "Healthy", "lifecycle_state": "InService", "instance_type": "m5"}
    assert body["cloudtrail"] == [
        {"event_name": "Start", "service": "svc", "error_code": ""}, {"event_name": "Stop", "service": "svc", "error_code": ""},
    ]


def test_events_from_the_bridge_give_the_same_documents(snapshots, contexts, events):
    bridge = extract.event_links(snapshots["events"])
    with_bridge = redact.render_prompts(redact.redact(contexts, bridge)).collect()
    assert sorted(map(repr, with_bridge)) == sorted(map(repr, redact.render_prompts(redact.redact(contexts, events)).collect()))


def test_keep_errors_option(contexts, events):
    assert documents(contexts, events)[(EC2, C)]["context"]["cloudwatch"] is None
    docs = {r["resource_id"]: r for r in redact.redact_instances(contexts, events, keep_errors=True).collect()}
    assert [(e["event_name"], e["error_code"]) for e in docs[A]["events"]] == [("Start", ""), ("Start", "Denied"), ("Stop", "")]


def test_load_balancer_document(contexts, events):
    body = documents(contexts, events)[(LOAD_BALANCER, "shared")]["context"]
    assert list(body["metrics"]) == ["request_count"]
    first, second = body["target_groups"]
    assert first["healthy_hosts"]["H"] == [["10:00", 1.0]] and second["healthy_hosts"] == 1.0 and first["unhealthy_hosts"] == 0.0
    assert [t["instance_id"] for t in first["targets"]] == [A, "10.1.1.1"] and "port" not in first["targets"][0]


def test_scaling_group_document(contexts, events):
    body = documents(contexts, events)[(SCALING_GROUP, "shared")]["context"]
    assert body["desired_capacity"] == 2 and body["scaling_activities"] == [{"status": "Successful", "description": "went up"}]
    assert [m["instance_id"] for m in body["instances"]] == [A, B]


def test_no_topology_leaves(contexts, events):
    text = json.dumps(list(documents(contexts, events).values()))
    assert not any(secret in text for secret in ("secret.example", "vpc-", "10.0.0.1", "name of", "availability_zone", "1.2.3.4"))


# --- extraction -----------------------------------------------------------------------


def raw_event(spark, payload, name="N", user=None):
    return spark.createDataFrame([("id", "2024-01-01", name, user, payload)], RAW_AUDIT_EVENT)


def test_defaults_apply_to_absent_fields_only(spark):
    row = extract.parse_audit_events(raw_event(spark, '{"eventSource":null,"awsRegion":"eu","readOnly":true}')).collect()[0]
    assert (row["service"], row["region"], row["source_ip"], row["read_only"], row["error_code"], row["username"]) == (None, "eu", "N/A", True, "", "N/A")


def walk(value):
    """Recursive leaf walk in document order."""
    if isinstance(value, dict):
        return [x for v in value.values() for x in walk(v)]
    if isinstance(value, list):
        return [x for v in value for x in walk(v)]
    return [value] if isinstance(value, str) else []


def test_string_leaves_match_a_recursive_walk(spark):
    doc = {"a": "x \"quoted\" : y", "i-0123456789": ["z", {"k": "tab\tend\\", "n": 1.5, "e": "é"}], "last": {"deep": [["w:", ""]]}, "u": "line\nbreak"}
    for text in (json.dumps(doc), json.dumps(doc, indent=2), json.dumps(doc, ensure_ascii=False, separators=(",", " : "))):
        got = spark.createDataFrame([(text,)], "t string").select(extract.string_leaves(F.col("t"))).collect()[0][0]
        assert got == walk(doc)


def test_string_leaves_of_any_length(spark):
    doc = {"a": 'x"' * 100_000, "b\\": "\\" * 50_001, "c": "y" * 1_000_000 + "\\", "d": "\\\""}
    got = spark.createDataFrame([(json.dumps(doc),)], "t string").select(extract.string_leaves(F.col("t"))).collect()[0][0]
    assert got == list(doc.values())


def test_entities_first_seen_order_and_boundaries(spark):
    doc = {"one": "eni-0123456789abc i-0123456789", "two": ["i-0123456789", "arn:aws:iam::1:role/x y"], "i-ffffffff": 1}
    df = raw_event(spark, json.dumps(doc))
    names = lambda bounded: [(r["type"], r["name"]) for r in extract.parse_audit_events(df, bounded=bounded).collect()[0]["resources"]]
    assert names(False) == [
        ("EC2 Instance", "i-0123456789abc"), ("EC2 Instance", "i-0123456789"), ("Network Interface", "eni-0123456789abc"), ("IAM", "arn:aws:iam::1:role/x"),
    ]
    assert names(True) == [("EC2 Instance", "i-0123456789"), ("Network Interface", "eni-0123456789abc"), ("IAM", "arn:aws:iam::1:role/x")]


def test_log_lines(spark):
    lines = [
        "2024-01-01 10:00:00,123 | INFO | Analyzer | Analyzing i-1 (Attempt 1/4)",
        "2024-01-01 10:00:01,123 | ERROR | Analyzer | Attempt 1/4 failed for i-1",
        "2024-01-01 10:00:02,000 | INFO | Analyzer | Skipping i-2: Instance state 'x' is not eligible for analysis",
        "Traceback | not a log line",
    ]
    parsed = extract.parse_log_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert parsed.filter("level is null").count() == 1
    got = {r["resource_id"]: (r["attempts"], r["failures"], r["skips"]) for r in extract.attempts_from_log(parsed).collect()}
    assert got == {"i-1": (1, 1, 0), "i-2": (0, 0, 1)}
    assert extract.log_levels(parsed.filter("logger is not null")).collect()[0]["errors"] == 1


# --- analysis -------------------------------------------------------------------------


def test_eligibility(contexts):
    judged = by_key(analyze.eligibility(contexts))
    got = {k: (r["state_text"], r["eligible"]) for k, r in judged.items()}
    assert got[(EC2, A)] == ("running", True)
    assert got[(EC2, C)] == ("unknown", False)
    assert got[(LOAD_BALANCER, "broken")] == ("failed", False)
    assert got[(LOAD_BALANCER, "shared")] == ("active", True)
    assert got[(SCALING_GROUP, "shared")] == ("active", True)
    reasons = {r["resource_id"]: r["reason"] for r in analyze.skipped_resources(analyze.eligibility(contexts)).collect()}
    assert reasons["broken"] == "Load Balancer state 'failed' is not eligible for analysis"


def test_retries_and_counters(spark, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()

    def flaky(text):
        seen = marks / text
        tries = int(seen.read_text()) if seen.exists() else 0
        seen.write_text(str(tries + 1))
        if text == "never" or (text == "third" and tries < 2):
            raise RuntimeError(f"no {text}")
        return '{"severity": "LOW"}'

    delays = tmp_path / "delays"
    prompts = spark.createDataFrame([("EC2", t, t) for t in ("ok", "third", "never")], "resource_type string, resource_id string, text string")

    def note(seconds):
        with open(delays, "a") as f:
            f.write(f"{seconds} ")

    out = analyze.analyze(prompts.coalesce(1), flaky, sleep=note).cache()
    got = {r["resource_id"]: (r["attempts"], r["failed_attempts"], r["error"]) for r in out.collect()}
    assert got == {"ok": (1, 0, None), "third": (3, 2, None), "never": (4, 4, "no never")}
    assert delays.read_text().split() == ["5", "10", "5", "10", "20"]
    judged = prompts.withColumn("eligible", F.lit(True))
    c = analyze.run_counters(judged, out).collect()[0]
    assert (c["discovered"], c["analyzed"], c["successful"], c["failed"], c["retries"], c["reports_generated"]) == (3, 3, 2, 1, 6, 2)


@pytest.mark.parametrize("analyzed, ok, failed, want", [(0, 0, 0, "SUCCESS"), (2, 0, 2, "FAILED"), (2, 1, 1, "PARTIAL_SUCCESS"), (2, 2, 0, "SUCCESS")])
def test_run_status(spark, analyzed, ok, failed, want):
    from tidewatch.functions.columns import run_status

    assert spark.range(1).select(run_status(F.lit(analyzed), F.lit(ok), F.lit(failed))).collect()[0][0] == want


def test_parse_responses(spark):
    texts = ['{"severity":"HIGH","confidence":80,"evidence":["a"]}', "plain", '{"severity":', '["x"]', '{"raw_response":"r"}']
    rows = analyze.parse_responses(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, response string")).orderBy("n").collect()
    assert (rows[0]["severity"], rows[0]["confidence"], rows[0]["evidence"], rows[0]["raw_response"]) == ("HIGH", "80", ["a"], None)
    assert [r["raw_response"] for r in rows[1:]] == ["plain", '{"severity":', '["x"]', "r"]


def test_rule_reports(spark):
    scored = spark.createDataFrame([("a", "HIGH", 10.0, 2, 1)], "resource_id string, severity string, breach_minutes double, longest_breach long, anomalies long")
    row = analyze.rule_reports(scored).collect()[0]
    assert row["severity"] == "HIGH" and "10.0 min" in row["summary"]
