"""Structured Streaming forms of ingest, binning, alerts, dedup, change state and progress."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidewatch.functions import columns as C
from tidewatch.operators import thresholds
from tidewatch.schemas import PERIOD_SECONDS, SEVERITY_RANKS
from tidewatch.sources import writers

LATENESS = "10 minutes"
# The state store that keyed state needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest(
    spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int = 1000, ts: str | None = None
) -> DataFrame:
    """File stream with a declared schema. ``ts`` becomes a zoned timestamp, as watermarks need one."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(path)
    return stream.withColumn(ts, F.col(ts).cast("timestamp")) if ts else stream


def tail_logs(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def _statistic(windowed, keys: list[str]) -> DataFrame:
    return windowed.agg(
        F.sum("value").alias("sum_value"), F.count("value").alias("samples"), F.max("value").alias("max_value")
    ).select(
        *keys,
        F.col("w.start").alias("ts"),
        F.col("w.end").alias("end_ts"),
        "sum_value",
        "max_value",
        F.try_divide("sum_value", "samples").alias("avg_value"),
        "samples",
    )


def tumbling_statistic(stream: DataFrame, keys: list[str], period_seconds: int = PERIOD_SECONDS, lateness: str = LATENESS) -> DataFrame:
    """Period statistics; rows later than ``lateness`` behind the newest time seen are dropped."""
    timed = stream.withWatermark("ts", lateness)
    return _statistic(timed.groupBy(*keys, F.window("ts", f"{period_seconds} seconds").alias("w")), keys)


def sliding_statistic(
    stream: DataFrame, keys: list[str], length: str = "60 minutes", slide: str = "5 minutes", lateness: str = LATENESS
) -> DataFrame:
    """Statistics of overlapping windows, out of panes of one slide that each row enters once.

    Panes are aggregated first, and the windows add up panes: what is copied into all windows that hold it is a pane of a
    series, not its rows. ``length`` is a multiple of ``slide``.
    """
    timed = stream.withWatermark("ts", lateness)
    pane = timed.groupBy(*keys, F.window("ts", slide).alias("p")).agg(
        F.sum("value").alias("s"), F.count("value").alias("n"), F.max("value").alias("m")
    )
    windows = pane.groupBy(*keys, F.window(F.window_time("p"), length, slide).alias("w"))
    return windows.agg(F.sum("s").alias("sum_value"), F.sum("n").alias("samples"), F.max("m").alias("max_value")).select(
        *keys, F.col("w.start").alias("ts"), F.col("w.end").alias("end_ts"), "sum_value", "max_value",
        F.try_divide("sum_value", "samples").alias("avg_value"), "samples",
    )


def breach_alerts(stream: DataFrame, index: DataFrame, on: list[str]) -> DataFrame:
    """Samples in breach of the static alarm table; the static side is planned by its size."""
    joined = thresholds.flag_breaches(thresholds.attach_thresholds(stream, index, on))
    return joined.filter(F.col("breach"))


def dedup_events(stream: DataFrame, key: str = "event_id", ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """One row per event over overlapping polls; state is kept only as long as the watermark asks."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


CHANGES = "resource_id string, detected_at timestamp, severity string, is_new boolean, severity_changed_from string"
_WAITING = "detected_at timestamp, severity string"


def event_time_changes(reports: DataFrame, state: DataFrame) -> DataFrame:
    """Reports that are a resource's first or worse than the one before them in event time.

    Before the first report at hand stands the resource's row in ``state``. Reports of one time
    are ordered by severity. The window reads the reports of a resource as a stream.
    """
    rank = C.severity_rank(F.col("severity"))
    order = Window.partitionBy("resource_id").orderBy("detected_at", rank, "severity")
    known = state.select("resource_id", F.col("severity").alias("_known"))
    rows = reports.withColumn("_before", F.lag("severity").over(order)).join(known, "resource_id", "left")
    before = F.coalesce("_before", "_known")
    worse = before.isNotNull() & (rank > C.severity_rank(before))
    return rows.where(before.isNull() | worse).select(
        "resource_id", "detected_at", "severity", before.isNull().alias("is_new"), F.when(worse, before).alias("severity_changed_from")
    )


def _rank(severity: str | None) -> int:
    return SEVERITY_RANKS.get((severity or "").upper(), 0)


class _Changes(StatefulProcessor):
    """Per resource: the reports that wait for the watermark, and the newest one that it has passed.

    One timer stands at the earliest waiting report; when it fires, all that the watermark has passed is compared in
    order. A second one forgets the resource when nothing has come for long enough.
    """

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.last = handle.getValueState("last", _WAITING)

    def handleInputRows(self, key, rows, timerValues):
        earliest = None
        for part in rows:
            part = part[part["detected_at"].notna()]
            if len(part):
                self.waiting.appendList([(t.to_pydatetime(), s) for t, s in zip(part["detected_at"], part["severity"])])
                first = part["detected_at"].min()
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self.handle.registerTimer(_millis(earliest))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        rows = [(r[0], r[1]) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in rows if _millis(r[0]) <= passed), key=lambda r: (r[0], _rank(r[1]), r[1] or ""))
        later = [r for r in rows if _millis(r[0]) > passed]
        before = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for at, severity in due:
            if before is not None and _millis(at) - _millis(before[0]) > self.forget_ms:
                before = None
            worse = before is not None and _rank(severity) > _rank(before[1])
            if before is None or worse:
                out.append((key[0], at, severity, before is None, before[1] if worse else None))
            before = (at, severity)
        if due:
            self.last.update(before)
            self.handle.registerTimer(_millis(before[0]) + self.forget_ms)
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(_millis(r[0]) for r in later))
        elif rows:
            self.waiting.clear()
        if not due and before is not None and _millis(before[0]) + self.forget_ms < passed:
            self.last.clear()
        if out:
            yield pd.DataFrame(out, columns=["resource_id", "detected_at", "severity", "is_new", "severity_changed_from"]).astype(
                {"detected_at": "datetime64[us]", "severity_changed_from": object}
            )

    def close(self) -> None:
        pass


def _millis(t) -> int:
    """Milliseconds since 1970; a time without a zone is UTC."""
    return int(pd.Timestamp(t).as_unit("ns").value // 1_000_000)


def severity_changes(stream: DataFrame, lateness: str = LATENESS, forget_days: int = 90) -> DataFrame:
    """Severity changes of a stream (resource_id, severity, detected_at) in event time, whatever its batches hold.

    Reports wait until the watermark, ``lateness`` behind the newest time seen, has passed them, so they are
    compared in the order of ``detected_at``; one that comes later still is dropped. State is keyed: a batch reads and writes
    that of the resources it holds or whose timer fires. A resource of which nothing has come for ``forget_days`` is
    new again. Needs the RocksDB state store.
    """
    timed = stream.select("resource_id", "detected_at", "severity").withWatermark("detected_at", lateness)
    return timed.groupBy("resource_id").transformWithStateInPandas(
        statefulProcessor=_Changes(forget_days * 86_400_000), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime"
    )


def waiting_changes(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The changes among the reports that still wait in the state of a stream that has ended."""
    def state(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)

    waiting = state("waiting").select("key.resource_id", F.col("list_element.detected_at").alias("detected_at"), F.col("list_element.severity").alias("severity"))
    last = state("last").select("key.resource_id", "value.severity")
    return event_time_changes(waiting, last)


def newest_phase(rows: DataFrame) -> DataFrame:
    """Newest phase per run."""
    latest = rows.groupBy("run_id").agg(F.max_by(F.struct("phase", "percent"), F.struct("ts", "percent")).alias("e"), F.max("ts").alias("ts"))
    return latest.select("run_id", "e.phase", "e.percent", "ts")


def run_progress(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, phase, percent, ts) as of the batches that ``keep_progress`` has written."""
    rows = writers.read_keyed(spark, path)
    return rows.withColumn("percent", C.clamp_percent(F.col("percent"))).select("run_id", "phase", "percent", "ts")


def keep_progress(path: str, buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the newest phase of each run in a table by run, of which a batch rewrites the buckets it touches.

    A repeated batch changes nothing, and the number of files stays bounded however many batches there are.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        writers.upsert(newest_phase(batch), path, ["run_id"], buckets, merge=newest_phase)

    return write


def run_batches(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Processes everything available with ``handler`` and stops."""
    stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_once(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Processes everything available into a file sink and stops."""
    query = (
        stream.writeStream.outputMode(mode).format(fmt).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
