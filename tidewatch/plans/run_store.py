"""Finished runs as stored tables: written by one job, read back as history, deleted by another.

Under ``base``: ``archive/<run>/reports`` (JSON lines) and ``summary/<run>.json`` for the history,
``reports`` (the current report of each resource, by key), ``skipped`` by run, and ``contexts/<run>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import retention
from tidewatch.plans import investigation
from tidewatch.schemas import REPORT
from tidewatch.session import cut_lineage
from tidewatch.sources import files, readers, writers

KEY = ["resource_type", "resource_id"]
REPORT_FIELDS = ["severity", "confidence", "root_cause", "summary", "evidence", "recommendations", "raw_response"]


def store_run(base: str, result: dict[str, DataFrame], buckets: int = writers.BUCKETS) -> str:
    """Stores what ``investigate`` returned and gives its run id.

    The summary comes last: a run without one is not in the history, and storing it again replaces what is there.
    """
    run = cut_lineage(result["run"])
    run_id = run.select("run_id").first()["run_id"]
    reports = result["reports"]
    reports.select(*KEY, *REPORT_FIELDS).write.mode("overwrite").json(f"{base}/archive/{run_id}/reports")
    if "contexts" in result:
        result["contexts"].write.mode("overwrite").parquet(f"{base}/contexts/{run_id}/documents")
        result["events"].write.mode("overwrite").parquet(f"{base}/contexts/{run_id}/events")
    if "skipped" in result:
        writers.archive_run(result["skipped"], f"{base}/skipped", run_id)
    writers.upsert(reports.select(*KEY, *REPORT_FIELDS, "detected_at"), f"{base}/reports", KEY, buckets)
    summary = run.drop("start_ts", "end_ts").withColumn("archive_created", F.lit(True))
    writers.write_snapshot(summary, f"{base}/summary/{run_id}.json")
    return run_id


def history(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """(runs, archived, reports) as stored."""
    return {
        "runs": readers.read_runs(spark, f"{base}/summary", layout="lines"),
        "archived": readers.read_archives(spark, f"{base}/archive", layout="lines"),
        "reports": writers.read_keyed(spark, f"{base}/reports", f"{', '.join(f'{k} string' for k in KEY)}, {REPORT}, detected_at timestamp"),
    }


def delete_stored(spark: SparkSession, base: str, requested: DataFrame, status: DataFrame, buckets: int = writers.BUCKETS) -> DataFrame:
    """Deletes runs with their archives, and current reports that equal an archived copy; returns (run_id, outcome).

    Running and queued runs and an empty request are refused. Current reports go first, while the copies are still
    there; the folders follow run by run, so a job that was interrupted can be repeated.
    """
    retention.check_deletable(requested, status)
    held = history(spark, base)
    found = retention.delete_runs(
        requested, held["runs"], held["archived"].withColumn("key", F.struct(*KEY)),
        held["reports"].withColumns({"key": F.struct(*KEY), "severity": F.upper("severity")}), "key", REPORT_FIELDS,
    )
    # A request names the runs that a person picked.
    outcome = found["outcome"].collect()
    writers.remove_keys(found["deleted_reports"].select(*KEY), f"{base}/reports", KEY, buckets)
    for row in outcome:
        if row["outcome"] == "deleted":
            for path in (f"archive/{row['run_id']}", f"contexts/{row['run_id']}", f"skipped/run_id={row['run_id']}", f"summary/{row['run_id']}.json"):
                files.remove(spark, f"{base}/{path}")
    return spark.createDataFrame([tuple(r) for r in outcome], "run_id string, outcome string")


def rebuild_feed(spark: SparkSession, base: str, feed_base: str, version: int, contexts: DataFrame) -> dict[str, DataFrame]:
    """Publishes the feed of what is stored, as after a deletion."""
    held = history(spark, base)
    archived = readers.archive_severities(held["archived"])
    return investigation.export_feed(feed_base, version, runs=held["runs"], reports=held["reports"], contexts=contexts, archived=archived)
