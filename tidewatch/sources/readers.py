"""Readers of JSON snapshots, entity files, run history, archives and logs.

Paths may be local, ``s3a://`` or any other scheme Spark knows. A missing path is an
empty table with the declared schema, and a broken file contributes no row: a fleet-wide
job must not fail on one source.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.schemas import (
    ASG_METRICS,
    ASG_RESOURCE,
    AUDIT_RESOURCE,
    CONTEXT,
    EC2,
    FEED_TABLES,
    INSTANCE_RESOURCE,
    LB_METRICS,
    LB_RESOURCE,
    LOAD_BALANCER,
    REPORT,
    RUN,
    SCALING_GROUP,
    struct_of,
)
from tidewatch.sources import files

RESOURCE_TYPES = {
    "cloudwatch": INSTANCE_RESOURCE,
    "alb": LB_RESOURCE,
    "autoscaling": ASG_RESOURCE,
    "cloudtrail": AUDIT_RESOURCE,
}
_BROKEN = "_broken"
_EVENT_NAMES = ["event_time", "event_name", "service", "username", "source_ip", "read_only", "error_code"]


def _empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], struct_of(ddl))


# Bytes and files of one task that reads small files whole.
TASK_BYTES = 128 << 20
TASK_FILES = 5_000


def _packed(raw: DataFrame, listing: DataFrame) -> DataFrame:
    """``raw`` in no more tasks than its files need by size and number, going by their listing alone.

    Left to itself Spark counts each file as some megabytes, so a folder of very many small entities would be
    very many tasks of a few files.
    """
    held = listing.agg(F.count("*").alias("n"), F.sum("length").alias("bytes")).first()
    return raw.coalesce(max(1, -(-(held["bytes"] or 0) // TASK_BYTES), -(-held["n"] // TASK_FILES)))


def _matched(depth: int) -> Column:
    """Whether a file is ``*.json`` in a folder of that depth, or lies in a folder of that name there.

    The folder is read and its files are filtered: a pattern of files would have Spark list each match on its own, once a read.
    """
    inside = F.regexp_replace("_metadata.file_path", "^[^:/]+:(//[^/]*)?", "")
    parts = F.split(inside, "/")
    return ((F.size(parts) == depth + 2) & inside.endswith(".json")) | ((F.size(parts) == depth + 3) & F.element_at(parts, -2).endswith(".json"))


def _text(spark: SparkSession, path: str, whole: bool) -> DataFrame | None:
    """Lines or whole files with ``_file`` (name), ``_path`` and ``_modified``; None if the path is missing."""
    folder, _, name = path.rpartition("/")
    listed = whole and name == "*.json" and "{" not in folder
    try:
        if listed:
            found = spark.read.option("recursiveFileLookup", "true")
            ours = _matched(files.depth(spark, folder))
            raw = _packed(found.text(folder, wholetext=True).where(ours), found.format("binaryFile").load(folder).where(ours))
        else:
            raw = spark.read.text(path, wholetext=whole)
            if whole and "*" in path:
                raw = _packed(raw, spark.read.format("binaryFile").load(path))
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None
    m = "_metadata"
    return raw.select(
        "value", F.col(f"{m}.file_name").alias("_file"), F.col(f"{m}.file_path").alias("_path"), F.col(f"{m}.file_modification_time").alias("_modified")
    )


def _parsed(value: Column, ddl: str) -> Column:
    """The documents of a text that is one document, several after one another, or an array of them.

    A raw line break cannot stand inside a JSON string, so a closing and an opening brace around one
    are two documents. A text with a broken document gives those of its lines that are whole.
    """
    kind = f"array<struct<{_BROKEN}:string," + struct_of(ddl).simpleString()[len("struct<") :] + ">"
    options = {"columnNameOfCorruptRecord": _BROKEN}
    inner = F.regexp_replace(F.trim(value), r"\}[ \t\r]*\n\s*\{", "},{")
    parse = lambda text: F.from_json(text, kind, options)
    together = parse(F.when(inner.startswith("["), inner).otherwise(F.concat(F.lit("["), inner, F.lit("]"))))
    alone = F.flatten(F.transform(F.split(value, "\n"), lambda line: F.coalesce(parse(F.concat(F.lit("["), line, F.lit("]"))), F.array().cast(kind))))
    whole = together.isNotNull() & ~F.exists(F.coalesce(together, F.array().cast(kind)), lambda d: d[_BROKEN].isNotNull())
    return F.when(whole, together).otherwise(alone)


def read_json(spark: SparkSession, path: str, ddl: str, layout: str = "auto", with_file: bool = False) -> DataFrame:
    """JSON documents by schema; unreadable documents are dropped, a missing path gives no rows.

    ``layout`` ``auto`` reads each file as a whole and takes one document, several documents (as in JSON
    Lines) or an array. ``lines`` takes a document per line and splits large files over tasks: use
    it for whatever grows with the fleet. ``with_file`` adds ``_file`` (name), ``_path`` and
    ``_modified`` of the source file.
    """
    if layout not in ("auto", "lines"):
        raise ValueError(f"unknown layout {layout}")
    raw = _text(spark, path, layout == "auto")
    file_ddl = ", _file string, _path string, _modified timestamp" if with_file else ""
    if raw is None:
        return _empty(spark, ddl + file_ddl)
    docs = raw.where(F.trim("value") != "").select(F.explode(_parsed(F.col("value"), ddl)).alias("_d"), "_file", "_path", "_modified")
    whole = docs.where(F.col(f"_d.{_BROKEN}").isNull() & F.col("_d").isNotNull())
    return whole.select(*[F.col(f"_d.{n}").alias(n) for n in struct_of(ddl).names], *(["_file", "_path", "_modified"] if with_file else []))


def read_envelope(spark: SparkSession, path: str, resource: str, layout: str = "auto") -> DataFrame:
    """(collector, timestamp, resources) of one source file or a folder of them.

    A large fleet should come as a folder of files with an envelope per line (``layout="lines"``),
    since an envelope is one row.
    """
    return read_json(spark, path, f"collector string, timestamp string, resources array<{resource}>", layout, with_file=True)


def unnest(envelopes: DataFrame) -> DataFrame:
    """One row per resource with ``ord``, the position over all files in time and name order."""
    at = F.coalesce(F.try_to_timestamp("timestamp"), F.col("_modified"))
    rows = envelopes.select(at.alias("_at"), "_file", F.posexplode("resources").alias("_pos", "r"))
    return rows.select(
        F.struct("_at", "_file", "_pos").alias("ord"), F.col("_at").alias("snapshot_ts"), "r.*"
    )


def read_snapshot(spark: SparkSession, base: str, collector: str, layout: str = "auto") -> DataFrame:
    """Unnested resources of one collector under ``base``: ``<collector>.json``, a file or a folder."""
    return unnest(read_envelope(spark, f"{base.rstrip('/')}/{collector}.json", RESOURCE_TYPES[collector], layout))


def fresh_only(snapshot: DataFrame, as_of, minutes: int) -> DataFrame:
    """Drops resources of a snapshot that was left behind by an earlier run."""
    return snapshot.filter(F.col("snapshot_ts") >= C.instant(as_of) - F.make_dt_interval(mins=F.lit(minutes)))


def collector_status(spark: SparkSession, base: str, as_of=None, fresh_minutes: int | None = None) -> DataFrame:
    """SUCCESS for a source that gave an envelope with a resource list, FAILED otherwise.

    With ``fresh_minutes`` an envelope that is older at ``as_of`` does not count.
    """
    parts = None
    for name, resource in RESOURCE_TYPES.items():
        found = read_envelope(spark, f"{base.rstrip('/')}/{name}.json", resource)
        if fresh_minutes is not None:
            found = fresh_only(found.withColumn("snapshot_ts", F.coalesce(F.try_to_timestamp("timestamp"), F.col("_modified"))), as_of, fresh_minutes)
        good = found.agg(F.count_if(F.col("resources").isNotNull()).alias("n"))
        row = good.select(F.lit(name).alias("collector"), F.when(F.col("n") > 0, "SUCCESS").otherwise("FAILED").alias("status"))
        parts = row if parts is None else parts.unionByName(row)
    return parts


def _stem(name) :
    return F.regexp_replace(name, r"\.[^.]*$", "")


_KEYED = ", resource_type string, resource_id string"


def read_entities(spark: SparkSession, folder: str, ddl: str, key: str = "resource_id", layout: str = "auto") -> DataFrame:
    """One document per file, keyed by the file stem, with ``detected_at`` from the file time.

    With ``layout="lines"`` files hold many documents, a line each, with the key as one of their members.
    """
    if layout == "lines":
        keyed = read_json(spark, f"{folder.rstrip('/')}/*.json", f"{ddl}, {key} string", layout, with_file=True)
        return keyed.select(key, *[c for c in keyed.columns if c != key and not c.startswith("_")], F.col("_modified").alias("detected_at"))
    docs = read_json(spark, f"{folder.rstrip('/')}/*.json", ddl, with_file=True)
    return docs.select(
        _stem(F.url_decode("_file")).alias(key), *[c for c in docs.columns if not c.startswith("_")], F.col("_modified").alias("detected_at")
    )


def read_reports(spark: SparkSession, folder: str, layout: str = "auto") -> DataFrame:
    return read_entities(spark, folder, REPORT, layout=layout)


def read_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Stored context documents in the shape that the context builder makes."""
    docs = read_entities(spark, folder, CONTEXT)
    c = F.col("context")
    kind = F.coalesce("resource_type", F.lit(EC2))
    n_events = F.greatest(F.coalesce(F.size(c["cloudtrail"]), F.lit(0)), F.lit(0)).cast("bigint")
    instance = F.struct(
        c["cloudwatch"].alias("snapshot"), c["alb"].alias("lb_membership"), c["autoscaling"].alias("asg_membership"), n_events.alias("n_events")
    )

    def metrics(ddl):
        return F.struct(*[F.try_element_at(c["metrics"], F.lit(f.name)).alias(f.name) for f in struct_of(f"m {ddl}")["m"].dataType])

    def member(names, metric_ddl):
        return F.struct(*[metrics(metric_ddl).alias(n) if n == "metrics" else c[n].alias(n) for n in names])

    lb = ["alb_name", "dns_name", "scheme", "state", "vpc_id", "metrics", "target_groups", "MetricTrends"]
    asg = ["asg_name", "min_size", "max_size", "desired_capacity", "health_check_type", "metrics", "instances", "scaling_activities", "MetricTrends"]
    return docs.select(
        kind.alias("resource_type"),
        "resource_id",
        F.when(kind == EC2, instance).alias("instance"),
        F.when(kind == LOAD_BALANCER, member(lb, LB_METRICS)).alias("load_balancer"),
        F.when(kind == SCALING_GROUP, member(asg, ASG_METRICS)).alias("scaling_group"),
    )


def read_context_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events of stored context documents, a row each, as ``context.instance_events`` makes them."""
    docs = read_entities(spark, folder, CONTEXT).where(F.coalesce("resource_type", F.lit(EC2)) == EC2)
    rows = docs.select("resource_id", F.posexplode("context.cloudtrail").alias("at", "e"))
    order = F.struct(F.col("at").cast("bigint").alias("ord"), F.lit(None).cast("bigint").alias("link_ord"))
    return rows.select("resource_id", order.alias("ord"), *[F.col(f"e.{n}").alias(n) for n in _EVENT_NAMES])


def read_runs(spark: SparkSession, folder: str, layout: str = "auto") -> DataFrame:
    """Run summaries with their times, in no order; ``oldest_first`` orders them for display."""
    docs = read_json(spark, f"{folder.rstrip('/')}/*.json", RUN, layout, with_file=True)
    run_id = C.or_else(F.col("run_id"), _stem(F.url_decode("_file")))
    named = docs.withColumn("run_id", run_id).drop("_file", "_path", "_modified")
    return with_run_times(named)


def oldest_first(runs: DataFrame) -> DataFrame:
    """A run whose start does not parse comes before all others."""
    return runs.orderBy(F.col("start_ts").asc_nulls_first(), "run_id")


def with_run_times(runs: DataFrame) -> DataFrame:
    return runs.withColumns(
        {
            "start_ts": F.coalesce(C.parse_run_id(F.col("run_id")), C.parse_clock_text(F.col("start_time"))),
            "end_ts": C.parse_clock_text(F.col("end_time")),
        }
    )


def read_archives(spark: SparkSession, folder: str, layout: str = "auto") -> DataFrame:
    """(archive_ts, run_id, resource_id, report fields) of ``<folder>/<run>/reports/*.json``.

    Folders whose name is no run id are left out. With ``layout="lines"`` a file holds many reports, a line each, with
    ``resource_type`` and ``resource_id`` in them, as ``run_store.store_run`` writes them.
    """
    lines = layout == "lines"
    docs = read_json(spark, f"{folder.rstrip('/')}/*/reports/*.json", REPORT + (_KEYED if lines else ""), layout, with_file=True)
    run = F.url_decode(F.element_at(F.split("_path", "/"), -3))
    shaped = docs.select(
        C.parse_run_id(run).alias("archive_ts"),
        run.alias("run_id"),
        (F.col("resource_id") if lines else _stem(F.url_decode("_file"))).alias("resource_id"),
        F.upper("severity").alias("severity"),
        *[c for c in docs.columns if c not in ("severity", "resource_id", "_file", "_path", "_modified")],
    )
    return shaped.filter(F.col("archive_ts").isNotNull())


def archive_severities(archived: DataFrame) -> DataFrame:
    """(archive_ts, resource_id, severity); an unrated report has a null severity and still shows its archive."""
    return archived.select("archive_ts", "resource_id", F.nullif("severity", F.lit("")).alias("severity"))


def read_feed_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A published table in its contract schema; absent tables and absent columns come back empty."""
    want = struct_of(FEED_TABLES[name])
    try:
        found = spark.read.parquet(path)
    except AnalysisException as missing:
        if not any(code in str(missing) for code in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
            raise
        return spark.createDataFrame([], want)
    return spark.createDataFrame([], want).unionByName(found, allowMissingColumns=True).select(*want.names)


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path).limit(1)
        return True
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return False
        raise


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain text logs, or of JSON container logs whose ``log`` member is the line."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    inner = F.get_json_object("value", "$.log")
    return lines.select(F.regexp_replace(F.coalesce(inner, F.col("value")), r"\s+$", "").alias("value"), "file")
