"""Findings over daily series of (user, event type)."""

from pyspark.sql import functions as F

from tidewatch.operators import signals
from tidewatch.plans import adapters as A
from tidewatch.plans.q_metrics import BREACH_SQL, THRESHOLDS_SQL
from tidewatch.plans.registry import query

DAY = 86400

SERIES_SQL = f"""{THRESHOLDS_SQL}, s AS (SELECT user_id AS resource_id, event_type AS metric, date_trunc('day', ts) AS ts,
  round(sum(value), 2) AS value FROM events GROUP BY ALL),
f AS (SELECT s.*, op, threshold, {BREACH_SQL} AS breach FROM s LEFT JOIN th USING (metric))"""

W = "PARTITION BY resource_id, metric ORDER BY ts"

RUNS_SQL = f"""{SERIES_SQL},
c AS (SELECT *, CASE WHEN lag(breach) OVER ({W}) IS NOT DISTINCT FROM breach THEN 0 ELSE 1 END AS started FROM f),
r AS (SELECT *, sum(started) OVER ({W}) AS run FROM c),
g AS (SELECT resource_id, metric, run, breach, count(*) AS len, max(ts) AS last_ts FROM r GROUP BY ALL)"""


@query(
    "series_summary",
    f"""WITH {SERIES_SQL} SELECT resource_id, metric, count(*) AS n, arg_max(value, ts) AS latest, min(value) AS minimum, max(value) AS maximum,
  round(avg(value), 9) AS average FROM f GROUP BY ALL""",
)
def series_summary(spark, sf_dir):
    return signals.window_summary(A.daily_series(spark, sf_dir)).withColumn("average", F.round("average", 9))


@query(
    "trend_slope",
    f"""
WITH {SERIES_SQL}, x AS (SELECT *, (epoch(ts) - epoch(min(ts) OVER (PARTITION BY resource_id, metric))) / 60.0 AS m FROM f),
t AS (SELECT resource_id, metric, regr_slope(value, m) AS slope, max(m) AS span, avg(value) AS a FROM x GROUP BY ALL)
SELECT resource_id, metric, round(slope, 12) AS slope, CASE WHEN coalesce(abs(slope) * span > 0.1 * abs(a), false)
  THEN CASE WHEN slope > 0 THEN 'rising' ELSE 'falling' END ELSE 'flat' END AS direction FROM t""",
)
def trend_slope(spark, sf_dir):
    return signals.trend(A.daily_series(spark, sf_dir)).select("resource_id", "metric", F.round("slope", 12).alias("slope"), "direction")


@query(
    "breach_minutes",
    f"""WITH {SERIES_SQL} SELECT resource_id, metric, count(*) FILTER (breach) AS breaches, count(*) FILTER (breach) * 1440.0::DOUBLE AS breach_minutes
FROM f GROUP BY ALL""",
)
def breach_minutes(spark, sf_dir):
    return signals.breach_time(A.daily_series(spark, sf_dir), period_seconds=DAY)


@query(
    "crossings",
    f"""WITH {SERIES_SQL}, p AS (SELECT *, lag(breach) OVER ({W}) AS before FROM f)
SELECT resource_id, metric, count(*) FILTER (breach AND before = false) AS crossings FROM p GROUP BY ALL""",
)
def crossings(spark, sf_dir):
    return signals.crossings(A.daily_series(spark, sf_dir))


@query(
    "breach_islands",
    f"""WITH {SERIES_SQL}, i AS (SELECT *, row_number() OVER ({W}) - row_number() OVER (PARTITION BY resource_id, metric, breach ORDER BY ts) AS isle FROM f)
SELECT resource_id, metric, breach AS flag, count(*) AS length, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts
FROM i GROUP BY resource_id, metric, breach, isle""",
)
def breach_islands(spark, sf_dir):
    series = signals._flagged(A.daily_series(spark, sf_dir))
    found = signals.islands(series, F.col("breach"), signals.SERIES)
    return found.drop("_isle").withColumns({"first_ts": A.ts_text("first_ts"), "last_ts": A.ts_text("last_ts")})


@query(
    "longest_breach",
    f"""WITH {RUNS_SQL} SELECT resource_id, metric, coalesce(max(len) FILTER (breach), 0) AS longest_breach,
  coalesce(max(len) FILTER (breach), 0) >= 3 AS persistent FROM g GROUP BY ALL""",
)
def longest_breach(spark, sf_dir):
    return signals.longest_breach(A.daily_series(spark, sf_dir))


@query(
    "recovered_spike",
    f"""WITH {RUNS_SQL}, l AS (SELECT *, max(run) OVER (PARTITION BY resource_id, metric) AS last_run FROM g)
SELECT resource_id, metric, count(*) FILTER (breach AND len <= 2 AND run < last_run) AS recovered_spikes FROM l GROUP BY ALL""",
)
def recovered_spike(spark, sf_dir):
    return signals.recovered_spikes(A.daily_series(spark, sf_dir))


@query(
    "oscillation",
    f"""WITH {SERIES_SQL}, d AS (SELECT *, value - lag(value) OVER ({W}) AS d FROM f), t AS (SELECT *, d * lag(d) OVER ({W}) < 0 AS turn FROM d)
SELECT resource_id, metric, count(*) FILTER (turn) AS turns, CASE WHEN count(*) > 2 THEN count(*) FILTER (turn) / (count(*) - 2) END AS oscillation
FROM t GROUP BY ALL""",
)
def oscillation(spark, sf_dir):
    return signals.oscillation(A.daily_series(spark, sf_dir))


@query("instability", f"WITH {SERIES_SQL} SELECT resource_id, metric, round(stddev_pop(value) / avg(value), 9) AS instability FROM f GROUP BY ALL")
def instability(spark, sf_dir):
    return signals.instability(A.daily_series(spark, sf_dir)).withColumn("instability", F.round("instability", 9))


@query(
    "monotone_run",
    f"""WITH {SERIES_SQL}, d AS (SELECT *, coalesce(sign(value - lag(value) OVER ({W})), 0) AS sg FROM f),
c AS (SELECT *, CASE WHEN lag(sg) OVER ({W}) IS NOT DISTINCT FROM sg THEN 0 ELSE 1 END AS started FROM d),
r AS (SELECT *, sum(started) OVER ({W}) AS run FROM c),
g AS (SELECT resource_id, metric, run, sg, count(*) + 1 AS len FROM r GROUP BY ALL)
SELECT resource_id, metric, coalesce(max(len) FILTER (sg = 1 AND len >= 3), 0) AS rising_run,
  coalesce(max(len) FILTER (sg = -1 AND len >= 3), 0) AS falling_run FROM g GROUP BY ALL""",
)
def monotone_run(spark, sf_dir):
    return signals.monotone_runs(A.daily_series(spark, sf_dir))


@query(
    "half_compare",
    f"""WITH {SERIES_SQL}, h AS (SELECT *, ntile(2) OVER ({W}) AS half FROM f)
SELECT resource_id, metric, round(avg(value) FILTER (half = 1), 9) AS first_half, round(avg(value) FILTER (half = 2), 9) AS second_half,
  bool_or(breach) AND NOT arg_max(breach, ts) AS recovered FROM h GROUP BY ALL""",
)
def half_compare(spark, sf_dir):
    return signals.half_compare(A.daily_series(spark, sf_dir)).withColumns(
        {"first_half": F.round("first_half", 9), "second_half": F.round("second_half", 9)}
    )


@query(
    "anomalies",
    f"""WITH {SERIES_SQL}, a AS (SELECT *, avg(value) OVER (PARTITION BY resource_id, metric) AS m, stddev_pop(value) OVER (PARTITION BY resource_id, metric) AS sd FROM f)
SELECT resource_id, metric, strftime(ts, '%Y-%m-%d %H:%M:%S') AS day, value FROM a WHERE abs(value - m) > 3 * sd""",
)
def anomalies(spark, sf_dir):
    return signals.anomalies(A.daily_series(spark, sf_dir)).select("resource_id", "metric", A.ts_text("ts").alias("day"), "value")


@query(
    "metric_corr",
    f"""WITH {SERIES_SQL}
SELECT a.resource_id, a.metric AS metric_a, b.metric AS metric_b, count(*) AS n, round(corr(a.value, b.value), 6) AS corr
FROM s a JOIN s b ON a.resource_id = b.resource_id AND a.ts = b.ts AND a.metric < b.metric GROUP BY ALL HAVING count(*) >= 3""",
)
def metric_corr(spark, sf_dir):
    names = sorted(m for m, _, _ in A.THRESHOLD_ROWS)
    found = signals.co_movement(A.daily_series(spark, sf_dir), names)
    # The correlation with a constant series is NaN in SQL.
    return found.withColumn("corr", F.coalesce(F.round("corr", 6), F.lit(float("nan"))))


@query(
    "change_event_join",
    f"""WITH {SERIES_SQL}, h AS (SELECT user_id AS resource_id, event_type AS metric, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, round(sum(value), 2) AS value
  FROM events GROUP BY ALL),
d AS (SELECT *, value - lag(value) OVER ({W}) AS delta FROM h), c AS (SELECT * FROM d WHERE abs(delta) > 0.5 * abs(value - delta))
SELECT c.resource_id, c.metric, strftime(c.ts, '%Y-%m-%d %H:%M:%S') AS change_ts, round(delta, 2) AS delta, e.event_id
FROM c JOIN events e ON e.user_id = c.resource_id AND e.ts BETWEEN c.ts - INTERVAL 600 SECOND AND c.ts + INTERVAL 600 SECOND""",
)
def change_event_join(spark, sf_dir):
    from tidewatch.operators import metrics

    points = A.datapoints(spark, sf_dir)
    binned = metrics.period_statistic(points, signals.SERIES, statistic=F.lit("Sum")).withColumn("value", F.round("value", 2))
    audit = points.select("resource_id", "event_id", F.col("ts").alias("event_ts"))
    found = signals.align_events(signals.sharp_changes(binned), audit)
    return found.select("resource_id", "metric", A.ts_text("change_ts").alias("change_ts"), F.round("delta", 2).alias("delta"), "event_id")


SCORE_SQL = f"""{RUNS_SQL},
odd AS (SELECT resource_id, metric, count(*) AS n, count(*) FILTER (breach) AS breaches, arg_max(breach, ts) AS latest_breach, arg_max(value, ts) AS latest,
  count(*) FILTER (abs(value - m) > 3 * sd) AS anomalies FROM (SELECT *, avg(value) OVER (PARTITION BY resource_id, metric) AS m,
  stddev_pop(value) OVER (PARTITION BY resource_id, metric) AS sd FROM f) GROUP BY ALL),
lb AS (SELECT resource_id, metric, coalesce(max(len) FILTER (breach), 0) AS longest_breach FROM g GROUP BY ALL),
scored AS (SELECT *, breaches * 1440.0::DOUBLE AS breach_minutes, CASE WHEN longest_breach >= 3 AND latest_breach THEN 'CRITICAL' WHEN latest_breach THEN 'HIGH'
  WHEN breaches > 0 OR anomalies > 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM odd JOIN lb USING (resource_id, metric))"""


def scored_series(spark, sf_dir):
    return signals.rule_severity(signals.series_signals(A.daily_series(spark, sf_dir), period_seconds=DAY))


@query(
    "rule_severity",
    f"""WITH {SCORE_SQL} SELECT resource_id, metric, n, latest, breaches, breach_minutes, longest_breach, latest_breach, anomalies, severity FROM scored""",
)
def rule_severity(spark, sf_dir):
    return scored_series(spark, sf_dir).drop("crossings")


@query(
    "resource_severity",
    f"""WITH {SCORE_SQL}, w AS (SELECT resource_id, max(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS r,
  count(*) AS metrics, sum(breach_minutes) AS breach_minutes, max(longest_breach) AS longest_breach, CAST(sum(anomalies) AS BIGINT) AS anomalies FROM scored GROUP BY ALL)
SELECT resource_id, CASE r WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity, metrics, breach_minutes, longest_breach, anomalies FROM w""",
)
def resource_severity(spark, sf_dir):
    return signals.resource_severity(scored_series(spark, sf_dir))
