"""Whole jobs: build contexts from snapshots, analyse, record the run, publish the feed."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators import analyze, context, extract, feed, ledger, redact
from tidewatch.session import cut_lineage
from tidewatch.sources import readers, writers

SOURCES = {"cloudwatch": "instances", "alb": "load_balancers", "autoscaling": "groups", "cloudtrail": "events"}


def load_snapshots(spark: SparkSession, raw: str, as_of: dt.datetime | None = None, fresh_minutes: int | None = None) -> dict[str, DataFrame]:
    """The four collector outputs under ``raw``; a missing or broken one is empty.

    With ``fresh_minutes`` so is what an earlier run has left behind: older than that at ``as_of``.
    """
    out = {}
    for source, name in SOURCES.items():
        rows = readers.read_snapshot(spark, raw, source)
        out[name] = (readers.fresh_only(rows, as_of, fresh_minutes) if fresh_minutes is not None else rows).drop("snapshot_ts")
    return out


def events_of(snapshots: dict[str, DataFrame], resource_id: str | None = None) -> DataFrame:
    """The events of all instances, or of one, as rows."""
    events = snapshots["events"]
    if resource_id:
        events = events.filter(F.exists("resources", lambda r: r["name"] == resource_id))
    rows = context.instance_events(extract.event_links(events))
    return rows.filter(F.col("resource_id") == resource_id) if resource_id else rows


def contexts_of(snapshots: dict[str, DataFrame], resource_id: str | None = None) -> DataFrame:
    parts = [snapshots[n] for n in ("instances", "load_balancers", "groups", "events")]
    return context.build_context_for(resource_id, *parts) if resource_id else context.build_contexts(*parts)


def investigate(
    spark: SparkSession,
    raw: str,
    analyze_fn: Callable[[str], str] | None = None,
    severities: DataFrame | None = None,
    resource_id: str | None = None,
    clock: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc),
    instructions: str = redact.INSTRUCTIONS,
    fresh_minutes: int | None = None,
    ledger_path: str | None = None,
    **call_options,
) -> dict[str, DataFrame]:
    """One run over all resources, or over one of any state.

    ``analyze_fn`` answers a document with text. Without it the rule score decides:
    ``severities`` holds it per resource id, and a resource without a score is LOW.

    Contexts and outcomes are checkpointed: both feed several results, and the analysis
    must not be called again when an executor is lost later on. With ``ledger_path`` calls go through a ledger
    (``operators.ledger``), so that answers outlive the job too. With ``fresh_minutes`` a source that is
    older is left out and counts as failed.
    """
    started = clock()
    snapshots = load_snapshots(spark, raw, started, fresh_minutes)
    contexts, events = cut_lineage(contexts_of(snapshots, resource_id)), events_of(snapshots, resource_id)
    judged = analyze.eligibility(contexts)
    if resource_id:
        judged = judged.withColumn("eligible", F.lit(True))
    wanted = judged.filter("eligible").select("resource_type", "resource_id")
    if analyze_fn is None:
        outcomes, reports = _by_rule(wanted, severities)
        ended = clock()
    else:
        documents = redact.redact(contexts, events).join(wanted, ["resource_type", "resource_id"], "left_semi")
        prompts = redact.render_prompts(documents, instructions)
        called = ledger.answer(prompts, analyze_fn, ledger_path, **call_options) if ledger_path else analyze.analyze(prompts, analyze_fn, **call_options)
        outcomes = cut_lineage(called)
        ended = clock()
        reports = analyze.parse_responses(outcomes.filter(F.col("error").isNull()))
    reports = reports.withColumn("detected_at", C.instant(ended))
    timed = analyze.run_counters(judged, outcomes).withColumns({"start_ts": C.instant(started), "end_ts": C.instant(ended)})
    # One row per source, so the health map is small enough to be a literal of the run record.
    health = [F.lit(v) for row in readers.collector_status(spark, raw, started, fresh_minutes).collect() for v in (row["collector"], row["status"])]
    run = analyze.run_records(timed).withColumn("collectors", F.create_map(*health))
    return {
        "contexts": contexts,
        "events": events,
        "skipped": analyze.skipped_resources(judged),
        "outcomes": outcomes,
        "reports": reports,
        "run": run.withColumnsRenamed({"discovered": "instances_discovered", "analyzed": "instances_analyzed", "skipped": "resources_skipped"}),
    }


def _by_rule(wanted: DataFrame, severities: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    if severities is None:
        raise ValueError("give an analysis function or rule severities")
    keys = [k for k in ("resource_type", "resource_id") if k in severities.columns]
    scored = wanted.join(severities, keys, "left").withColumns(
        {
            "severity": F.coalesce("severity", F.lit("LOW")),
            **{n: F.coalesce(n, F.lit(0)) for n in ("breach_minutes", "longest_breach", "anomalies")},
        }
    )
    outcomes = wanted.select(
        "*", F.lit(1).alias("attempts"), F.lit(0).alias("failed_attempts"), F.lit(None).cast("string").alias("error")
    )
    return outcomes, analyze.rule_reports(scored)


def kpi_table(kpis: DataFrame, deltas: dict[str, float] | None = None) -> DataFrame:
    """KPI row as (kpi, value, delta, delta_label)."""
    known = deltas or {}
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("kpi"),
                F.col(name).cast("double").alias("value"),
                F.lit(known.get(name)).cast("double").alias("delta"),
                F.lit("from yesterday" if name in known else None).cast("string").alias("delta_label"),
            )
            for name in kpis.columns
        ]
    )
    return kpis.select(F.inline(rows))


def feed_tables(runs: DataFrame, reports: DataFrame, contexts: DataFrame, archived: DataFrame, previous: DataFrame) -> dict[str, DataFrame]:
    """All dashboard tables.

    ``reports``: current report per resource with ``detected_at``; ``contexts``: context
    rows as built; ``archived``: (archive_ts, resource_id, severity); ``previous``: the
    published ``state``.
    """
    typed = contexts.select("resource_id", "resource_type")
    keys = [k for k in ("resource_type", "resource_id") if k in reports.columns and k in previous.columns]
    all_reports = feed.report_feed(reports, feed.telemetry(contexts), runs, previous, keys).withColumn("detected_at", C.iso_display(F.col("detected_at")))
    current = feed.report_columns(reports)
    archives = archived.select("archive_ts").distinct()
    scored = archived.filter(F.col("severity").isNotNull())
    trend, shares = feed.severity_trend(scored, archives), feed.resource_distribution(typed)
    incidents, times = feed.investigation_trend(runs), feed.execution_time_trend(runs)
    return {
        "summary": kpi_table(feed.kpi_row(runs, current)),
        "infrastructure_health": feed.infrastructure_health(runs, current),
        "latest_execution": feed.latest_execution(runs),
        "collectors": feed.collector_health(runs),
        "executions": feed.newest_first(feed.executions(runs), "start_time", "run_id"),
        "reports": feed.newest_first(feed.contract_reports(all_reports), "detected_at", "report_id"),
        "recent": feed.recent(all_reports),
        "severity_trend": trend,
        "top_affected": feed.top_affected(scored, typed),
        "resource_distribution": shares,
        "resources": feed.inventory(typed),
        "investigation_trend": incidents,
        "execution_time_trend": times,
        "analytics": feed.analytics(incidents, trend, shares, times),
        "daily_runs": feed.daily_runs(runs),
        "state": feed.state_of(reports, keys),
    }


def export_feed(base: str, version: int, **inputs: DataFrame) -> dict[str, DataFrame]:
    """Builds and publishes the feed as one version; ``previous`` defaults to the published state."""
    spark = inputs["runs"].sparkSession
    if "previous" not in inputs:
        keys = [f"{k} string" for k in ("resource_type", "resource_id") if k in inputs["reports"].columns]
        inputs["previous"] = writers.read_published(spark, base, "state", ", ".join([*keys, "severity string"]))
    tables = feed_tables(**inputs)
    writers.publish(tables, base, version)
    return tables
