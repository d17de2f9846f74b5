import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import metrics, signals, thresholds
from tidewatch.schemas import METRIC_CATALOG, RAW_ALARM

T0 = dt.datetime(2024, 1, 1, 18, 0)


def points(spark, rows):
    """rows: (resource, metric, minutes after T0, value)"""
    data = [(r, m, T0 + dt.timedelta(minutes=k), float(v)) for r, m, k, v in rows]
    return spark.createDataFrame(data, "resource_id string, metric string, ts timestamp, value double")


def series(spark, values, op="GT", threshold=10.0, name="a"):
    df = points(spark, [(name, "cpu", 5 * i, v) for i, v in enumerate(values)])
    return df.withColumns({"op": F.lit(op), "threshold": F.lit(threshold)})


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_lookback_keeps_both_ends(spark):
    df = points(spark, [("a", "cpu", k, 1) for k in (-61, -60, 0, 1)])
    assert metrics.lookback(df, T0, 60).count() == 2


def test_lookback_filter_reaches_the_scan(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    plan = metrics.lookback(events, dt.datetime(2024, 1, 2), 60)._jdf.queryExecution().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThanOrEqual(ts" in pushed


@pytest.mark.parametrize("how, expected", [("Sum", 6.0), ("Maximum", 3.0), ("Average", 2.0)])
def test_period_statistic(spark, how, expected):
    df = points(spark, [("a", "cpu", 0, 1), ("a", "cpu", 1, 2), ("a", "cpu", 4, 3), ("a", "cpu", 5, 9)])
    rows = metrics.period_statistic(df, ["resource_id"], statistic=F.lit(how)).orderBy("ts").collect()
    assert [r["value"] for r in rows] == [expected, 9.0]
    assert [r["ts"] for r in rows] == [T0, T0 + dt.timedelta(minutes=5)]


def test_latest_and_zero_fill(spark):
    df = points(spark, [("a", "cpu", 0, 5), ("a", "cpu", 5, 1.239)])
    wanted = spark.createDataFrame([("a", "cpu"), ("b", "cpu")], "resource_id string, metric string")
    got = {r["resource_id"]: r["latest"] for r in metrics.latest_or_zero(wanted, df, ["resource_id", "metric"]).collect()}
    assert got == {"a": 1.24, "b": 0.0}


def test_history_is_ordered_and_crosses_midnight(spark):
    # 18:25 UTC is 23:55 in the display zone.
    df = points(spark, [("a", "cpu", 35, 3.456), ("a", "cpu", 25, 1), ("a", "cpu", 30, 2)])
    df = df.withColumns({"op": F.lit(None).cast("string"), "threshold": F.lit(80.0), "unit": F.lit("%")})
    payload = one(metrics.history_payload(df, ["resource_id", "metric"]))["payload"]
    assert [(p["label"], p["value"]) for p in payload["H"]] == [("23:55", 1.0), ("00:00", 2.0), ("00:05", 3.46)]
    assert payload["TH"] is None and payload["U"] == "%"


def test_empty_series_gives_no_payload(spark):
    df = points(spark, []).withColumns({"op": F.lit("GT"), "threshold": F.lit(1.0), "unit": F.lit("%")})
    payloads = metrics.history_payload(df, ["resource_id", "metric"])
    assert metrics.metric_map(payloads, ["resource_id"]).count() == 0


def test_catalog_counts(spark):
    tracked = [r for r in METRIC_CATALOG if r[6]]
    assert len(tracked) == 15 and len(METRIC_CATALOG) == 20
    assert metrics.metric_catalog(spark).count() == 20


def alarm(name, ns, metric, op, threshold, dims, ord_):
    return (name, ns, metric, op, threshold, [(n, v) for n, v in dims], "OK", "", ord_)


def test_alarms(spark):
    d1, d2 = [("x", "1"), ("y", "2")], [("y", "2"), ("x", "1"), ("y", "2")]
    raw = spark.createDataFrame(
        [
            alarm("first", "ns", "m", "GreaterThanThreshold", 1.0, d1, 1),
            alarm("second", "ns", "m", "LessThanThreshold", 2.0, d2, 2),
            alarm("composite", None, None, None, None, [], 3),
            alarm("band", "ns", "n", "LessThanLowerOrGreaterThanUpperThreshold", None, d1, 4),
            alarm("bare", "ns", "k", "GreaterThanThreshold", None, d1, 5),
        ],
        RAW_ALARM,
    )
    index = thresholds.alarm_index(thresholds.parse_alarms(raw))
    assert {r["alarm_name"] for r in index.collect()} == {"second", "band", "bare"}
    dims = "array<struct<name:string,value:string>>"
    probe = spark.createDataFrame([("ns", m, [("x", "1"), ("y", "2")], 1.5) for m in ("m", "n", "k", "z")], f"namespace string, metric string, dim_key {dims}, value double")
    got = {r["metric"]: (r["threshold"], r["op"], r["breach"]) for r in thresholds.flag_breaches(thresholds.attach_thresholds(probe, index)).collect()}
    assert got == {"m": (2.0, "LT", True), "n": (None, None, False), "k": (None, None, False), "z": (None, None, False)}


# --- findings, checked against plain loops --------------------------------------------

SHAPES = [
    [1, 2, 3, 4, 5],
    [20, 1, 20, 1, 20],
    [1, 11, 12, 13, 1, 1, 11],
    [5, 5, 5],
    [11],
    [1, 30, 1, 1, 30, 30, 30, 2],
]


def runs_of(flags):
    out = []
    for f in flags:
        if out and out[-1][0] == f:
            out[-1][1] += 1
        else:
            out.append([f, 1])
    return out


@pytest.mark.parametrize("values", SHAPES)
def test_breach_findings(spark, values):
    s = series(spark, values)
    flags = [v > 10 for v in values]
    runs = runs_of(flags)
    longest = max([n for f, n in runs if f], default=0)
    assert one(signals.longest_breach(s))["longest_breach"] == longest
    assert one(signals.crossings(s))["crossings"] == sum(1 for a, b in zip(flags, flags[1:]) if not a and b)
    assert one(signals.recovered_spikes(s))["recovered_spikes"] == sum(1 for f, n in runs[:-1] if f and n <= 2)
    assert one(signals.breach_time(s))["breach_minutes"] == 5.0 * sum(flags)
    total = one(signals.series_signals(s))
    assert (total["n"], total["latest"], total["breaches"], total["longest_breach"], total["latest_breach"]) == (
        len(values), values[-1], sum(flags), longest, flags[-1],
    )
    severity = one(signals.rule_severity(signals.series_signals(s)))["severity"]
    want = "CRITICAL" if longest >= 3 and flags[-1] else "HIGH" if flags[-1] else "MEDIUM" if any(flags) or total["anomalies"] else "LOW"
    assert severity == want


@pytest.mark.parametrize("values", SHAPES)
def test_shape_findings(spark, values):
    s = series(spark, values)
    diffs = [b - a for a, b in zip(values, values[1:])]
    turns = sum(1 for a, b in zip(diffs, diffs[1:]) if a * b < 0)
    got = one(signals.oscillation(s))
    assert got["turns"] == turns
    assert got["oscillation"] == (turns / (len(values) - 2) if len(values) > 2 else None)
    signs = runs_of([(d > 0) - (d < 0) for d in diffs])
    mono = one(signals.monotone_runs(s))
    for sign, name in ((1, "rising_run"), (-1, "falling_run")):
        best = max([n + 1 for f, n in signs if f == sign], default=0)
        assert mono[name] == (best if best >= 3 else 0)


def test_trend_direction(spark):
    assert one(signals.trend(series(spark, [1, 2, 3, 4])))["direction"] == "rising"
    assert one(signals.trend(series(spark, [4, 3, 2, 1])))["direction"] == "falling"
    assert one(signals.trend(series(spark, [100, 100.1, 100])))["direction"] == "flat"
    assert one(signals.trend(series(spark, [7])))["direction"] == "flat"


def test_half_compare_and_recovery(spark):
    got = one(signals.half_compare(series(spark, [20, 20, 1, 1])))
    assert (got["first_half"], got["second_half"], got["recovered"]) == (20.0, 1.0, True)


def test_anomaly(spark):
    found = signals.anomalies(series(spark, [1] * 30 + [100]))
    assert [r["value"] for r in found.collect()] == [100.0]


def test_co_movement_matches_pairwise_join(spark):
    rows = [("a", m, 5 * i, (i * k) % 7) for i in range(12) for k, m in ((1, "x"), (3, "y"), (5, "z")) if (i + k) % 5]
    df = points(spark, rows)
    got = {(r["metric_a"], r["metric_b"]): (r["n"], round(r["corr"], 9)) for r in signals.co_movement(df, ["z", "x", "y"]).collect()}
    a, b = df.alias("a"), df.alias("b")
    pairs = a.join(b, (F.col("a.ts") == F.col("b.ts")) & (F.col("a.metric") < F.col("b.metric")))
    want = pairs.groupBy(F.col("a.metric").alias("p"), F.col("b.metric").alias("q")).agg(F.count("*").alias("n"), F.corr("a.value", "b.value").alias("c"))
    assert got == {(r["p"], r["q"]): (r["n"], round(r["c"], 9)) for r in want.collect() if r["n"] >= 3}


def test_co_movement_with_a_constant_metric_is_null(spark):
    values = {"x": [0.1] * 4, "y": [1, 2, 3, 5], "z": [2, 4, 6, 10], "w": [3e-200, 1e-200, 2e-200, 0]}
    rows = [("a", m, 5 * i, float(v)) for m, own in values.items() for i, v in enumerate(own)]
    got = {(r["metric_a"], r["metric_b"]): (r["n"], r["corr"]) for r in signals.co_movement(points(spark, rows), list(values)).collect()}
    assert round(got.pop(("y", "z"))[1], 9) == 1.0
    assert len(got) == 5 and set(got.values()) == {(4, None)}


def test_co_movement_has_no_join(spark):
    plan = signals.co_movement(points(spark, [("a", "x", 0, 1)]), ["x", "y"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_align_events_edges(spark):
    changes = spark.createDataFrame([("a", "cpu", T0, 1.0)], "resource_id string, metric string, change_ts timestamp, delta double")
    at = [T0 + dt.timedelta(seconds=s) for s in (-601, -600, -1, 0, 599, 600, 601)]
    events = spark.createDataFrame([("a", t) for t in at] + [("b", T0)], "resource_id string, event_ts timestamp")
    got = sorted(r["gap_seconds"] for r in signals.align_events(changes, events).collect())
    assert got == [-600.0, -1.0, 0.0, 599.0, 600.0]


def test_islands(spark):
    s = series(spark, [1, 11, 12, 1])
    got = sorted((r["first_ts"], r["flag"], r["length"]) for r in signals.islands(s, F.col("value") > 10, signals.SERIES).collect())
    assert [(f, n) for _, f, n in got] == [(False, 1), (True, 2), (False, 1)]


def test_one_shuffle_for_all_findings(spark, sf_dir):
    from tidewatch.plans import adapters as A

    scored = signals.rule_severity(signals.series_signals(A.daily_series(spark, sf_dir)))
    scored.collect()
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    executed = scored._jdf.queryExecution().executedPlan().toString()
    final = executed.split("Initial Plan")[0]
    # One exchange bins the datapoints, one gathers a series; the alarm join moves no series.
    assert final.count("Exchange hashpartitioning") == 2, final
    assert plan
