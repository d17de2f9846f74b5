"""Findings over binned series: breaches, islands, trends, anomalies, co-movement.

Input is the output of the period statistic joined to thresholds: unique ``ts`` per
series, ``value``, ``op`` and ``threshold``. A series is therefore bounded by the number
of periods in the range, whatever number of datapoints it came from, which is what makes
the per-series windows below safe for a hot resource. All windows use the same keys, so
one exchange serves every finding of :func:`series_signals`.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.schemas import PERIOD_SECONDS

SERIES = ["resource_id", "metric"]
PERSISTENT_BINS = 3
SPIKE_BINS = 2


def _ordered(keys):
    return Window.partitionBy(*keys).orderBy("ts")


def _whole(keys):
    return Window.partitionBy(*keys)


def window_summary(series: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    return series.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.max_by("value", "ts").alias("latest"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
        F.avg("value").alias("average"),
    )


def trend(series: DataFrame, keys: list[str] = SERIES, share: float = 0.1) -> DataFrame:
    """Least-squares slope per minute; rising or falling if it moves more than ``share`` of the mean over the span."""
    # Minutes count from the first period, which keeps the products small and the slope exact.
    timed = series.withColumn("_x", (F.unix_seconds("ts") - F.unix_seconds(F.min("ts").over(_whole(keys)))) / 60.0)
    fitted = timed.groupBy(*keys).agg(
        F.regr_slope("value", "_x").alias("slope"),
        F.max("_x").alias("span_minutes"),
        F.avg("value").alias("_avg"),
    )
    moved = F.abs(F.col("slope")) * F.col("span_minutes") > share * F.abs(F.col("_avg"))
    return fitted.select(
        *keys,
        "slope",
        "span_minutes",
        F.when(~F.coalesce(moved, F.lit(False)), "flat").when(F.col("slope") > 0, "rising").otherwise("falling").alias("direction"),
    )


def breach_time(series: DataFrame, keys: list[str] = SERIES, period_seconds: int = PERIOD_SECONDS) -> DataFrame:
    hits = F.count_if(C.breaches(F.col("value"), F.col("op"), F.col("threshold")))
    return series.groupBy(*keys).agg(hits.alias("breaches")).withColumn(
        "breach_minutes", F.col("breaches") * F.lit(period_seconds / 60.0)
    )


def _flagged(series: DataFrame) -> DataFrame:
    return series.withColumn("breach", C.breaches(F.col("value"), F.col("op"), F.col("threshold")))


def crossings(series: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Changes from clear to breach; a series that starts in breach has not crossed."""
    before = F.lag("breach").over(_ordered(keys))
    marked = _flagged(series).withColumn("_cross", F.col("breach") & (before == F.lit(False)))
    return marked.groupBy(*keys).agg(F.count_if("_cross").alias("crossings"))


def islands(series: DataFrame, flag: Column, keys: list[str]) -> DataFrame:
    """Runs of equal ``flag`` as (keys, flag, length, first_ts, last_ts)."""
    w = _ordered(keys)
    tagged = series.withColumn("_flag", flag)
    numbered = tagged.withColumn("_n", F.row_number().over(w)).withColumn(
        "_isle", F.col("_n") - F.row_number().over(Window.partitionBy(*keys, "_flag").orderBy("ts"))
    )
    return numbered.groupBy(*keys, F.col("_flag").alias("flag"), "_isle").agg(
        F.count(F.lit(1)).alias("length"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def _runs(series: DataFrame, flag: Column, keys: list[str]) -> DataFrame:
    """Running length of the current ``flag`` run at every sample, from one sort of the series."""
    w = _ordered(keys)
    tagged = series.withColumn("_flag", flag)
    changed = tagged.withColumn("_start", F.when(F.lag("_flag").over(w).eqNullSafe(F.col("_flag")), 0).otherwise(1))
    return changed.withColumn("_run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def longest_breach(series: DataFrame, keys: list[str] = SERIES, at_least: int = PERSISTENT_BINS) -> DataFrame:
    """Longest run of consecutive periods in breach."""
    runs = _runs(_flagged(series), F.col("breach"), keys).groupBy(*keys, "_run", "_flag").agg(F.count(F.lit(1)).alias("_len"))
    longest = runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_flag"), F.col("_len"))), F.lit(0)).alias("longest_breach"))
    return longest.withColumn("persistent", F.col("longest_breach") >= at_least)


def recovered_spikes(series: DataFrame, keys: list[str] = SERIES, at_most: int = SPIKE_BINS) -> DataFrame:
    """Breach runs of at most ``at_most`` periods that a clear period follows."""
    marked = _runs(_flagged(series), F.col("breach"), keys)
    runs = marked.groupBy(*keys, "_run", "_flag").agg(F.count(F.lit(1)).alias("_len"), F.max("ts").alias("_end"))
    last = F.max("_run").over(_whole(keys))
    hit = runs.withColumn("_spike", F.col("_flag") & (F.col("_len") <= at_most) & (F.col("_run") < last))
    return hit.groupBy(*keys).agg(F.count_if("_spike").alias("recovered_spikes"))


def oscillation(series: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Sign changes of the first difference per possible change; null below three samples."""
    w = _ordered(keys)
    step = series.withColumn("_d", F.col("value") - F.lag("value").over(w))
    turned = step.withColumn("_turn", F.col("_d") * F.lag("_d").over(w) < 0)
    return turned.groupBy(*keys).agg(
        F.count_if("_turn").alias("turns"), F.count(F.lit(1)).alias("_n")
    ).select(*keys, "turns", F.try_divide(F.col("turns"), F.when(F.col("_n") > 2, F.col("_n") - 2)).alias("oscillation"))


def instability(series: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    return series.groupBy(*keys).agg(F.try_divide(F.stddev_pop("value"), F.avg("value")).alias("instability"))


def monotone_runs(series: DataFrame, keys: list[str] = SERIES, at_least: int = 3) -> DataFrame:
    """Longest strictly rising and falling runs in samples; kept from ``at_least`` samples on, else 0."""
    sign = F.signum(F.col("value") - F.lag("value").over(_ordered(keys)))
    signed = series.withColumn("_sign", F.coalesce(sign, F.lit(0.0)))
    runs = _runs(signed, F.col("_sign"), keys).groupBy(*keys, "_run", "_flag").agg((F.count(F.lit(1)) + 1).alias("_len"))

    def best(direction):
        longest = F.max(F.when((F.col("_flag") == direction) & (F.col("_len") >= at_least), F.col("_len")))
        return F.coalesce(longest, F.lit(0))

    return runs.groupBy(*keys).agg(best(1.0).alias("rising_run"), best(-1.0).alias("falling_run"))


def half_compare(series: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Mean of both halves, and recovery: some breach, but the last period clear."""
    halves = _flagged(series).withColumn("_half", F.ntile(2).over(_ordered(keys)))
    out = halves.groupBy(*keys).agg(
        F.avg(F.when(F.col("_half") == 1, F.col("value"))).alias("first_half"),
        F.avg(F.when(F.col("_half") == 2, F.col("value"))).alias("second_half"),
        F.bool_or("breach").alias("_any"),
        F.max_by("breach", "ts").alias("_last"),
    )
    return out.select(
        *keys, "first_half", "second_half", (F.col("_any") & ~F.col("_last")).alias("recovered")
    )


def anomalies(series: DataFrame, keys: list[str] = SERIES, sigmas: float = 3.0) -> DataFrame:
    """Samples further than ``sigmas`` deviations from the mean of their own series."""
    w = _whole(keys)
    scored = series.withColumns({"_avg": F.avg("value").over(w), "_std": F.stddev_pop("value").over(w)})
    return scored.filter(F.abs(F.col("value") - F.col("_avg")) > sigmas * F.col("_std")).drop("_avg", "_std")


def co_movement(series: DataFrame, metrics: list[str], key: str = "resource_id", at_least: int = 3) -> DataFrame:
    """Correlation of every pair of a fixed metric list over equal periods.

    Metrics become columns of one row per (resource, period) and all pairs are plain
    aggregates of that row. No self join, and no pair rows before the aggregation.
    A pair of which one metric stays the same has a null (``corr`` itself divides by zero there).
    """
    column = {m: f"m{i}" for i, m in enumerate(metrics)}
    wide = series.filter(F.col("metric").isin(metrics)).groupBy(key, "ts").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(c) for m, c in column.items()]
    )
    pairs = list(combinations(sorted(metrics), 2))
    aggs = []
    for i, (a, b) in enumerate(pairs):
        ca, cb = F.col(column[a]), F.col(column[b])
        both = ca.isNotNull() & cb.isNotNull()
        spread = F.stddev_pop(F.when(both, ca)) * F.stddev_pop(F.when(both, cb))
        aggs += [F.try_divide(F.covar_pop(ca, cb), spread).alias(f"r{i}"), F.count_if(both).alias(f"n{i}")]
    packed = F.array(
        *[
            F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return (
        wide.groupBy(key)
        .agg(*aggs)
        .select(key, F.inline(packed))
        .filter(F.col("n") >= at_least)
        .select(key, "metric_a", "metric_b", F.when(~F.isnan("r"), F.col("r")).alias("corr"), "n")
    )


def sharp_changes(series: DataFrame, keys: list[str] = SERIES, share: float = 0.5) -> DataFrame:
    """Periods whose value moved by more than ``share`` of the one before."""
    moved = series.withColumn("delta", F.col("value") - F.lag("value").over(_ordered(keys)))
    return moved.filter(F.abs("delta") > share * F.abs(F.col("value") - F.col("delta"))).select(
        *keys, F.col("ts").alias("change_ts"), "delta"
    )


def align_events(
    changes: DataFrame, events: DataFrame, on: str = "resource_id", within_seconds: int = 600
) -> DataFrame:
    """Changes and events of one resource at most ``within_seconds`` apart.

    Time is cut into slots of that width and each change looks into three of them, so
    the join is an equi join on (resource, slot) with a small residual. The change side
    is the bounded one (periods); the event side is never copied, and a hot resource
    spreads over its slots.
    """
    slot = F.floor(F.unix_seconds("change_ts") / within_seconds)
    probes = changes.withColumn("_slot", F.explode(F.array(slot - 1, slot, slot + 1)))
    located = events.withColumn("_slot", F.floor(F.unix_seconds("event_ts") / within_seconds))
    gap = F.unix_micros("event_ts") - F.unix_micros("change_ts")
    return (
        probes.join(located, [on, "_slot"], "inner")
        .filter(F.abs(gap) <= within_seconds * 1_000_000)
        .drop("_slot")
        .withColumn("gap_seconds", gap / 1_000_000.0)
    )


def series_signals(series: DataFrame, keys: list[str] = SERIES, period_seconds: int = PERIOD_SECONDS) -> DataFrame:
    """All scoring inputs of a series in one pass: one exchange, then aggregates on the same keys."""
    w, whole = _ordered(keys), _whole(keys)
    flagged = _flagged(series)
    scored = flagged.withColumns({"_avg": F.avg("value").over(whole), "_std": F.stddev_pop("value").over(whole)})
    runs = _runs(scored, F.col("breach"), keys).withColumn("_before", F.lag("breach").over(w))
    odd = F.abs(F.col("value") - F.col("_avg")) > 3.0 * F.col("_std")
    per_run = runs.groupBy(*keys, "_run", "_flag").agg(
        F.count(F.lit(1)).alias("_len"),
        F.count_if(odd).alias("_odd"),
        F.count_if(F.col("breach") & (F.col("_before") == F.lit(False))).alias("_cross"),
        F.max("ts").alias("_end"),
        F.max_by("value", "ts").alias("_value"),
    )
    return per_run.groupBy(*keys).agg(
        F.sum("_len").alias("n"),
        F.max_by("_value", "_end").alias("latest"),
        F.coalesce(F.sum(F.when(F.col("_flag"), F.col("_len"))), F.lit(0)).alias("breaches"),
        F.sum("_cross").alias("crossings"),
        F.coalesce(F.max(F.when(F.col("_flag"), F.col("_len"))), F.lit(0)).alias("longest_breach"),
        F.max_by("_flag", "_end").alias("latest_breach"),
        F.sum("_odd").alias("anomalies"),
    ).withColumn("breach_minutes", F.col("breaches") * F.lit(period_seconds / 60.0))


def rule_severity(signals: DataFrame, at_least: int = PERSISTENT_BINS) -> DataFrame:
    persistent = F.col("longest_breach") >= at_least
    return signals.withColumn(
        "severity",
        F.when(persistent & F.col("latest_breach"), "CRITICAL")
        .when(F.col("latest_breach"), "HIGH")
        .when((F.col("breaches") > 0) | (F.col("anomalies") > 0), "MEDIUM")
        .otherwise("LOW"),
    )


def resource_severity(scored: DataFrame, key: str = "resource_id") -> DataFrame:
    """Worst severity over the metrics of a resource, with its totals."""
    worst = F.max(C.severity_rank(F.col("severity")))
    return scored.groupBy(key).agg(
        worst.alias("_rank"),
        F.count(F.lit(1)).alias("metrics"),
        F.sum("breach_minutes").alias("breach_minutes"),
        F.max("longest_breach").alias("longest_breach"),
        F.sum("anomalies").alias("anomalies"),
    ).select(
        key,
        F.when(F.col("_rank") == 4, "CRITICAL").when(F.col("_rank") == 3, "HIGH").when(F.col("_rank") == 2, "MEDIUM").otherwise("LOW").alias("severity"),
        "metrics", "breach_minutes", "longest_breach", "anomalies",
    )
