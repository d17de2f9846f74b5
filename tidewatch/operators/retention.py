"""Keep-newest retention and content-matched deletion of runs.

Stored tables are immutable files, so a delete is a split into survivors and deleted
rows; the caller publishes the survivors as the next version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import bounded
from tidewatch.functions import columns as C
from tidewatch.schemas import KEEP_ARCHIVES, KEEP_PROMPTS


# Ids that a refusal names in its message.
MESSAGE_IDS = 20


def keep_newest_archives(archived: DataFrame, key: str = "archive_ts", n: int = KEEP_ARCHIVES) -> DataFrame:
    """Rows of the ``n`` newest archives by time. The key list has at most ``n`` rows, so it is broadcast."""
    newest = bounded.newest(archived.select(key).distinct(), [F.col(key).desc_nulls_last()], n)
    return archived.join(F.broadcast(newest), key, "left_semi")


def expired_archives(archived: DataFrame, key: str = "archive_ts", n: int = KEEP_ARCHIVES) -> DataFrame:
    newest = bounded.newest(archived.select(key).distinct(), [F.col(key).desc_nulls_last()], n)
    return archived.join(F.broadcast(newest), key, "left_anti")


def keep_newest_prompts(prompts: DataFrame, ts: str, tie: str, n: int = KEEP_PROMPTS) -> DataFrame:
    return bounded.newest(prompts, [F.col(ts).desc_nulls_last(), F.col(tie).desc()], n)


def deletion_result(requested: DataFrame, runs: DataFrame, archived: DataFrame) -> DataFrame:
    """(run_id, outcome) per distinct request: ``deleted`` if a run or an archive has that valid id."""
    known = runs.select("run_id").union(archived.select("run_id")).distinct().withColumn("_known", F.lit(True))
    hit = C.is_run_id(F.col("run_id")) & F.coalesce("_known", F.lit(False))
    return requested.select("run_id").distinct().join(known, "run_id", "left").select(
        "run_id", F.when(hit, "deleted").otherwise("not_found").alias("outcome")
    )


def surviving_runs(runs: DataFrame, deleted: DataFrame) -> DataFrame:
    return runs.join(deleted.select("run_id"), "run_id", "left_anti")


def reports_to_delete(current: DataFrame, archived: DataFrame, deleted: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Current reports that still equal the copy archived with a deleted run.

    Equality is null-safe over all ``fields``. The comparison is a semi join on the key
    and the content, so several deleted runs with a copy of one report match it once, and
    equal copies are merged map-side before they are moved.
    """
    copies = archived.join(deleted.select("run_id"), "run_id", "left_semi").select(key, *fields).distinct()
    same = F.col(f"c.{key}") == F.col(f"a.{key}")
    for f in fields:
        same = same & F.col(f"c.{f}").eqNullSafe(F.col(f"a.{f}"))
    return current.alias("c").join(copies.alias("a"), same, "left_semi")


def surviving_reports(current: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    return current.join(doomed.select(key), key, "left_anti")


def check_deletable(requested: DataFrame, status: DataFrame) -> DataFrame:
    """Refuses an empty request and one that names a queued or running run.

    The message has the first ids and says how many there are; ``active_requests`` is the whole table.
    """
    if requested.isEmpty():
        raise ValueError("run_ids must not be empty")
    active = active_requests(requested, status)
    first = [r["run_id"] for r in active.orderBy("run_id").limit(MESSAGE_IDS).collect()]
    if first:
        n = active.count() if len(first) == MESSAGE_IDS else len(first)
        more = f" ({len(first)} of {n})" if n > len(first) else ""
        raise ValueError(f"cannot delete running investigation(s): {', '.join(first)}{more}")
    return requested


def active_requests(requested: DataFrame, status: DataFrame) -> DataFrame:
    active = status.filter(F.col("status").isin("QUEUED", "RUNNING"))
    return requested.select("run_id").distinct().join(active, "run_id", "left_semi")


def delete_runs(
    requested: DataFrame, runs: DataFrame, archived: DataFrame, current: DataFrame, key: str, fields: list[str]
) -> dict[str, DataFrame]:
    """All results of one delete request, ready to publish."""
    outcome = deletion_result(requested, runs, archived)
    deleted = outcome.filter(F.col("outcome") == "deleted")
    doomed = reports_to_delete(current, archived, deleted, key, fields)
    return {
        "outcome": outcome,
        "runs": surviving_runs(runs, deleted),
        "archived": surviving_runs(archived, deleted),
        "reports": surviving_reports(current, doomed, key),
        "deleted_reports": doomed,
    }
