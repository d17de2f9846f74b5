"""Run history, report queries and display columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import bounded
from tidewatch.functions import columns as C
from tidewatch.schemas import RUN_PHASES


def list_executions(executions: DataFrame) -> DataFrame:
    order = F.coalesce(F.nullif("start_time", F.lit("")), F.col("run_id"), F.lit(""))
    return executions.orderBy(order.desc(), "run_id")


def get_execution(executions: DataFrame, run_id: str) -> DataFrame:
    return executions.filter(F.col("run_id") == run_id)


def search(executions: DataFrame, query: str | None) -> DataFrame:
    """Case-insensitive text in run id or type; an empty query passes everything."""
    needle = (query or "").strip().lower()
    if not needle:
        return executions
    hits = [F.lower(c).contains(needle) for c in ("run_id", "type") if c in executions.columns]
    match = hits[0]
    for h in hits[1:]:
        match = match | F.coalesce(h, F.lit(False))
    return executions.filter(match)


def filter_status(executions: DataFrame, status: str | None) -> DataFrame:
    if not status or status == "All":
        return executions
    return executions.filter(F.lower("status") == status.lower())


def filter_type(executions: DataFrame, kind: str | None) -> DataFrame:
    if not kind or kind == "All":
        return executions
    return executions.filter(F.col("type") == kind)


def facets(executions: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty values in order; combined map-side before the exchange."""
    return executions.filter(F.coalesce(column, F.lit("")) != "").select(column).distinct().orderBy(column)


def reports_of_run(reports: DataFrame, run_id: str) -> DataFrame:
    return reports.filter(F.col("run_id") == run_id)


def reports_of_runs(reports: DataFrame, runs: DataFrame) -> DataFrame:
    return reports.join(runs.select("run_id"), "run_id", "left_semi")


def get_report(reports: DataFrame, wanted: str, order: str = "detected_at") -> DataFrame:
    """The first listed report whose report id or instance id is ``wanted``."""
    hit = (F.col("report_id") == wanted) | (F.col("instance_id") == wanted)
    return bounded.newest(reports.filter(hit), [F.col(order).desc_nulls_last(), F.col("report_id")], 1)


def by_severity(reports: DataFrame, tie: str) -> DataFrame:
    return reports.orderBy(C.severity_rank(F.upper("severity")).desc(), tie)


def run_overview(executions: DataFrame, reports: DataFrame) -> DataFrame:
    """Execution rows whose report counts fall back to the reports found for the run."""
    found = reports.groupBy("run_id").agg(F.count(F.lit(1)).alias("_found"))
    count = F.coalesce("_found", F.lit(0))
    return executions.join(found, "run_id", "left").withColumns(
        {
            "resources_analyzed": F.coalesce("resources_analyzed", count),
            "reports_generated": F.coalesce("reports_generated", count),
            "resources_skipped": F.coalesce("resources_skipped", F.lit(0)),
        }
    ).drop("_found")


def latest_executions(executions: DataFrame, n: int = 6) -> DataFrame:
    return bounded.newest(executions, [F.col("start_time").desc_nulls_last(), F.col("run_id").desc()], n)


def resources_for_type(inventory: DataFrame, kind: str | None = None) -> DataFrame:
    """Inventory entries with an id and their picker text, ordered as a picker shows them."""
    rows = inventory.filter(F.coalesce("id", F.lit("")) != "")
    if kind is not None:
        rows = rows.filter(F.col("type") == kind)
    plain = F.coalesce("label", F.lit("")).isin("") | (F.col("label") == F.col("id"))
    text = F.when(plain, F.col("id")).otherwise(F.format_string("%s (%s)", F.col("label"), F.col("id")))
    shown = rows.withColumn("display", text)
    return shown.orderBy("type", F.lower("display"), "display", "id")


def healthy_collectors(health: DataFrame) -> DataFrame:
    return health.withColumn("healthy", C.is_healthy(F.col("status")))


def history_view(executions: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Executions with their display columns; ``start_ts`` is the instant behind ``start_time``."""
    now = C.instant(as_of)
    return executions.withColumns(
        {
            "duration_text": C.duration_text(F.col("execution_time")),
            "resources_text": C.number_text(F.col("resources")),
            "started_text": C.datetime_text(F.col("start_ts")),
            "age_text": C.age_text(F.col("start_ts"), now),
            "status_kind": C.status_kind(F.col("status")),
        }
    )


def report_cards(reports: DataFrame) -> DataFrame:
    return reports.withColumns(
        {
            "severity_kind": C.severity_kind(F.col("severity")),
            "summary_text": C.short_text(F.col("summary")),
        }
    )


def run_progress(events: DataFrame, started: DataFrame, as_of: dt.datetime) -> DataFrame:
    """State of each run at ``as_of`` from its newest phase event.

    ``events`` are (run_id, phase, percent, current_resource, ts); an ended run has an event
    whose phase is COMPLETED or FAILED. Events are reduced map-side to one row per run.
    """
    is_end = F.col("phase").isin("COMPLETED", "FAILED")
    order = F.struct("ts", "percent")
    latest = events.groupBy("run_id").agg(
        F.max_by(F.when(~is_end, F.struct("phase", "percent")), F.when(~is_end, order)).alias("e"),
        F.max_by(F.when(is_end, F.col("phase")), F.when(is_end, F.col("ts"))).alias("ended"),
        F.max_by("current_resource", F.when(F.col("current_resource").isNotNull(), order)).alias("current_resource"),
    ).select("run_id", "e.*", "ended", "current_resource")
    return progress_columns(started.join(latest, "run_id", "left"), as_of)


def progress_columns(rows: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Status, phase list and time estimate. Phases before the current one are done, later ones pending."""
    order = {key: i for i, key in enumerate(RUN_PHASES)}
    completed = F.coalesce(F.col("ended") == "COMPLETED", F.lit(False))

    def state(i):
        return (
            F.when(completed, "done")
            .when(F.col("_at").isNull() | (F.lit(i) > F.col("_at")), "pending")
            .when(F.lit(i) == F.col("_at"), "active")
            .otherwise("done")
        )

    phases = F.array(
        *[F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), state(i).alias("state")) for i, (key, label) in enumerate(RUN_PHASES.items())]
    )
    running = (F.col("status") == "RUNNING") & (F.col("percent") > 0)
    return (
        rows.withColumn("_at", C.lookup(F.col("phase"), order))
        .withColumns(
            {
                "percent": F.when(completed, 100).otherwise(C.clamp_percent(F.col("percent"))),
                "elapsed_seconds": F.greatest(F.lit(0), F.floor(C.seconds_between(F.col("started_at"), C.instant(as_of)))),
                "status": F.coalesce("ended", F.when(F.col("_at").isNull(), "QUEUED").otherwise("RUNNING")),
                "phase_label": F.coalesce(F.initcap("ended"), C.lookup(F.col("phase"), RUN_PHASES), F.lit("Queued")),
                "phases": phases,
            }
        )
        .withColumn(
            "remaining_seconds",
            F.when(running, F.floor(F.col("elapsed_seconds") * (100 - F.col("percent")) / F.col("percent"))),
        )
        .drop("_at", "ended")
    )
