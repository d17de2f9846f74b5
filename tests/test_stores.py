"""Stored datapoints and lookup tables: what a read touches, and what runs leave behind."""

import datetime as dt
import os

import factory
import pytest
from factory import A
from pyspark.sql import functions as F

from tidewatch.operators import history, ledger
from tidewatch.plans import investigation, run_store
from tidewatch.schemas import LOAD_BALANCER
from tidewatch.sources import datapoints, lookups, readers, writers
from tidewatch.streaming import jobs


def scan_of(df):
    """The scan of a plan without exchanges, after it has run."""
    rows = df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    value = lambda name: leaf.metrics().apply(name).value()
    return rows, leaf.toString(), value


def test_a_lookback_reads_the_files_of_one_day(spark, tmp_path):
    path, start = str(tmp_path / "points"), dt.datetime(2024, 1, 1)
    points = spark.range(30 * 24 * 12).select(
        (F.col("id") % 7).alias("resource_id"), (F.lit(start) + F.make_dt_interval(mins=(F.col("id") * 5).cast("int"))).cast("timestamp").alias("ts"), F.col("id").cast("double").alias("value")
    )
    datapoints.write_datapoints(points, path)
    as_of = datapoints.newest(spark, path)
    assert as_of == dt.datetime(2024, 1, 30, 23, 55)
    rows, plan, value = scan_of(datapoints.read_window(spark, path, as_of, 60))
    assert len(rows) == 13 and "PartitionFilters: [isnotnull(date" in plan
    per_day = len([f for f in os.listdir(f"{path}/date=2024-01-30") if f.endswith(".parquet")])
    assert value("numFiles") == per_day and value("numPartitions") == 1
    midnight, _, value = scan_of(datapoints.read_window(spark, path, dt.datetime(2024, 1, 10, 0, 20), 60, resource_id=3))
    assert value("numPartitions") == 2 and {r.resource_id for r in midnight} == {3} and len(midnight) in (1, 2)


def test_lookups_skip_row_groups(spark, tmp_path):
    rows = spark.range(40_000).select(F.lpad("id", 8, "0").alias("run_id"), F.sha1(F.col("id").cast("string")).alias("report_id"), F.sha1(F.concat(F.lit("x"), "id")).alias("summary"))
    stored, plain = str(tmp_path / "stored"), str(tmp_path / "plain")
    lookups.write_for_lookup(rows, stored, ["run_id", "report_id"], row_group_bytes=200_000, values=5_000)
    rows.orderBy(F.rand(1)).write.option("parquet.block.size", "200000").parquet(plain)
    wanted = rows.where("run_id = '00031234'").first()
    for key in ("run_id", "report_id"):
        found, _, value = scan_of(spark.read.parquet(stored).where(F.col(key) == wanted[key]))
        read = value("numOutputRows")
        assert len(found) == 1 and read <= 0.25 * 40_000, key
        _, _, value = scan_of(spark.read.parquet(plain).where(F.col(key) == wanted[key]))
        assert value("numOutputRows") > 2 * read
    either = spark.read.parquet(stored).where((F.col("run_id") == "nobody") | (F.col("report_id") == wanted.report_id))
    found, _, value = scan_of(either)
    assert len(found) == 1 and value("numOutputRows") <= 0.25 * 40_000
    assert history.reports_of_run(spark.read.parquet(stored), wanted.run_id).count() == 1


def test_many_small_entities_are_few_tasks(spark, tmp_path, monkeypatch):
    folder = tmp_path / "entities"
    os.mkdir(folder)
    for i in range(2_500):
        (folder / f"e{i}.json").write_text('{"severity":"LOW","summary":"%d"}' % i)
    monkeypatch.setattr(readers, "TASK_FILES", 1_000)
    found = readers.read_reports(spark, str(folder))
    assert found.rdd.getNumPartitions() <= 3
    assert found.count() == 2_500 and found.select("resource_id").distinct().count() == 2_500


def test_exact_leaves_equal_those_of_the_text(spark):
    import json
    import random

    from tidewatch.operators import extract

    rng = random.Random(4)

    def value(depth):
        kind = rng.randrange(6 if depth < 5 else 3)
        if kind < 3:
            return rng.choice(["x", 'q"u\\o', "ü:", "", "a\nb", 1, None, True])
        if kind == 3:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        return {rng.choice("abcde") + str(j): value(depth + 1) for j in range(rng.randrange(4))}

    rows = [(i, json.dumps(value(0), ensure_ascii=bool(i % 2))) for i in range(150)]
    df = spark.createDataFrame([*rows, (900, None), (901, "no json"), (None, '"x"')], "id int, t string")
    exact = {}
    for r in extract.string_leaves_exact(df, "id", "t").collect():
        exact.setdefault(r.id, []).append(r.value)
    text = {r.id: r.l for r in df.where("id < 900").select("id", extract.string_leaves(F.col("t")).alias("l")).collect()}
    assert {i: sorted(v) for i, v in exact.items()} == {i: sorted(v) for i, v in text.items() if v}
    deep = spark.createDataFrame([(1, "[" * 60 + '"x"' + "]" * 60)], "id int, t string")
    assert extract.string_leaves_exact(deep, "id", "t").first().path == "$" + "[0]" * 60
    with pytest.raises(Exception):
        extract.string_leaves_exact(deep, "id", "t", depth=20).collect()


def analyst(word):
    def answer(text):
        return '{"severity":"%s","summary":"s"}' % word

    return answer


FIRST, SECOND = (dt.datetime(2024, 1, d, 5, 0, tzinfo=dt.timezone.utc) for d in (5, 6))


def test_runs_are_stored_found_and_deleted(spark, tmp_path):
    raw, base = factory.write_raw(tmp_path / "raw"), str(tmp_path / "store")
    calls = f"{tmp_path}/ledger"
    ids = []
    for when, word in ((FIRST, "high"), (SECOND, "low")):
        out = investigation.investigate(spark, raw, analyst(word), clock=lambda when=when: when, instructions=word, ledger_path=calls)
        ids.append(run_store.store_run(base, out, buckets=4))
    held = run_store.history(spark, base)
    runs = {r.run_id: r for r in held["runs"].collect()}
    assert list(runs) == ids or set(runs) == set(ids)
    assert runs[ids[0]].reports_generated == 3 and runs[ids[0]].archive_created and runs[ids[0]].collectors["alb"] == "SUCCESS"
    severities = sorted((r.run_id, r.resource_id, r.severity) for r in readers.read_archives(spark, f"{base}/archive", layout="lines").collect())
    assert len(severities) == 6 and {s for i, _, s in severities if i == ids[0]} == {"HIGH"}
    assert {r.severity for r in held["reports"].collect()} == {"low"} and held["reports"].count() == 3
    # Storing a run again replaces it.
    run_store.store_run(base, out, buckets=4)
    assert run_store.history(spark, base)["archived"].count() == 6

    asked = spark.createDataFrame([(ids[0],), ("01-01-2020_00-00-00",)], "run_id string")
    none = spark.createDataFrame([], "run_id string, status string")
    outcome = run_store.delete_stored(spark, base, asked, none, buckets=4)
    assert {tuple(r) for r in outcome.collect()} == {(ids[0], "deleted"), ("01-01-2020_00-00-00", "not_found")}
    held = run_store.history(spark, base)
    assert [r.run_id for r in held["runs"].collect()] == [ids[1]] and held["archived"].count() == 3 and held["reports"].count() == 3
    contexts = spark.read.parquet(f"{base}/contexts/{ids[1]}/documents")
    run_store.rebuild_feed(spark, base, f"{tmp_path}/feed", 1, contexts)
    assert {r.run_id for r in writers.read_published(spark, f"{tmp_path}/feed", "reports").collect()} <= {ids[1]}
    # The copies of the second run equal the current reports, so these go with it.
    run_store.delete_stored(spark, base, spark.createDataFrame([(ids[1],)], "run_id string"), none, buckets=4)
    assert run_store.history(spark, base)["reports"].count() == 0
    with pytest.raises(ValueError):
        run_store.delete_stored(spark, base, asked, spark.createDataFrame([(ids[0], "RUNNING")], "run_id string, status string"))


def test_stale_sources_are_left_out_and_failed(spark, tmp_path):
    raw = factory.write_raw(tmp_path / "raw")
    old = dt.datetime(2020, 1, 1).timestamp()
    for f in os.listdir(raw):
        os.utime(f"{raw}/{f}", (old, old))
    now = dt.datetime.now(dt.timezone.utc)
    fresh = investigation.load_snapshots(spark, raw, now, 30)
    assert fresh["events"].count() == 0 and investigation.load_snapshots(spark, raw)["events"].count() > 0
    status = {r.collector: r.status for r in readers.collector_status(spark, raw, now, 30).collect()}
    assert status["cloudtrail"] == "FAILED"


def test_severity_by_type_and_id(spark, tmp_path):
    raw = factory.write_raw(tmp_path / "raw")
    scored = spark.createDataFrame(
        [(LOAD_BALANCER, "shared", "CRITICAL", 1.0, 1, 0)], "resource_type string, resource_id string, severity string, breach_minutes double, longest_breach long, anomalies long"
    )
    out = investigation.investigate(spark, raw, severities=scored, clock=lambda: FIRST)
    got = {(r.resource_type, r.resource_id): r.severity for r in out["reports"].collect()}
    assert got[LOAD_BALANCER, "shared"] == "CRITICAL" and got["Auto Scaling Group", "shared"] == "LOW" and got["EC2", A] == "LOW"


# --- streams --------------------------------------------------------------------------


def report_files(spark, folder, batches, first=0):
    t = dt.datetime(2024, 1, 1, 10)
    for i, rows in enumerate(batches, first):
        spark.createDataFrame([(r, s, t + dt.timedelta(minutes=m)) for r, s, m in rows], "resource_id string, severity string, detected_at timestamp").coalesce(1).write.parquet(f"{folder}/b{i}")
        for f in os.listdir(f"{folder}/b{i}"):
            os.utime(f"{folder}/b{i}/{f}", (1_700_000_000 + i * 100,) * 2)


def test_severity_changes_go_on_after_a_restart(spark, tmp_path):
    schema = "resource_id string, severity string, detected_at timestamp"
    batches = [[("a", "LOW", 0)], [("a", "HIGH", 20), ("b", "LOW", 21)], [("a", "CRITICAL", 40), ("a", "MEDIUM", 39), ("c", "LOW", 2)], [("b", "HIGH", 60), ("a", "HIGH", 80)]]
    run = lambda: jobs.run_once(jobs.severity_changes(jobs.ingest(spark, f"{tmp_path}/in/*", schema, max_files=1)), f"{tmp_path}/out", f"{tmp_path}/ck")
    report_files(spark, tmp_path / "in", batches[:2])
    run()
    before = spark.read.parquet(f"{tmp_path}/out").count()
    report_files(spark, tmp_path / "in", batches[2:], first=2)
    run()
    every = spark.read.parquet(f"{tmp_path}/out").unionByName(jobs.waiting_changes(spark, f"{tmp_path}/ck"))
    got = sorted((r.resource_id, r.detected_at.hour * 60 + r.detected_at.minute - 600, r.severity, r.severity_changed_from) for r in every.collect())
    # c came 38 minutes late and was dropped.
    assert got == [("a", 0, "LOW", None), ("a", 20, "HIGH", "LOW"), ("a", 40, "CRITICAL", "MEDIUM"), ("b", 21, "LOW", None), ("b", 60, "HIGH", "LOW")]
    assert 0 < before < 5


def test_a_resource_is_forgotten_after_a_while(spark, tmp_path):
    day = 24 * 60
    report_files(spark, tmp_path / "in", [[("a", "HIGH", 0), ("b", "LOW", 0)], [("b", "LOW", 3 * day)], [("b", "LOW", 4 * day)], [("a", "LOW", 9 * day), ("b", "LOW", 9 * day)], [("b", "LOW", 10 * day)]])
    schema = "resource_id string, severity string, detected_at timestamp"
    stream = jobs.ingest(spark, f"{tmp_path}/in/*", schema, max_files=1)
    jobs.run_once(jobs.severity_changes(stream, forget_days=2), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = sorted((r.resource_id, r.detected_at.day, r.is_new) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got[:2] == [("a", 1, True), ("a", 10, True)]


def test_raw_rows_enter_one_pane_each(spark, tmp_path):
    spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 1.0)], "resource_id string, ts timestamp, value double").write.parquet(f"{tmp_path}/in")
    stream = jobs.ingest(spark, f"{tmp_path}/in", "resource_id string, ts timestamp, value double")
    plan = jobs.sliding_statistic(stream, ["resource_id"])._jdf.queryExecution().analyzed().toString()
    copies = [i for i, line in enumerate(plan.splitlines()) if "Expand" in line]
    panes = max(i for i, line in enumerate(plan.splitlines()) if "Aggregate" in line)
    assert copies and max(copies) < panes


def test_progress_files_stay_bounded(spark, tmp_path):
    path, t = str(tmp_path / "progress"), dt.datetime(2024, 1, 1, 10)
    keep = jobs.keep_progress(path, buckets=2)
    for i in range(50):
        rows = [(f"r{j}", f"phase {i}", float(i), t + dt.timedelta(minutes=i)) for j in range(i % 5, i % 5 + 2)]
        keep(spark.createDataFrame(rows, "run_id string, phase string, percent double, ts timestamp"), i)
    keep(spark.createDataFrame(rows, "run_id string, phase string, percent double, ts timestamp"), 49)
    got = {r.run_id: r.phase for r in jobs.run_progress(spark, path).collect()}
    assert got == {"r0": "phase 45", "r1": "phase 46", "r2": "phase 47", "r3": "phase 48", "r4": "phase 49", "r5": "phase 49"}
    assert len([f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]) <= 4
    assert ledger.read_ledger(spark, f"{path}-none").count() == 0
