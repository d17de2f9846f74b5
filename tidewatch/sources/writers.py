"""Sinks: snapshots, keyed document tables, versioned publication and the run archive."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.schemas import EC2
from tidewatch.session import cut_lineage
from tidewatch.sources import files

# Hash buckets of a table that is written by key.
BUCKETS = 64


def as_json_values(df: DataFrame) -> DataFrame:
    """Times become text; everything else has a JSON form already."""
    timed = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return df.select(*[F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, timed) else F.col(f.name) for f in df.schema])


def write_snapshot(df: DataFrame, path: str) -> None:
    as_json_values(df).write.mode("overwrite").json(path)


def write_contexts(envelopes: DataFrame, path: str) -> None:
    """Document table keyed by (resource_type, instance_id); a file holds many resources."""
    envelopes.write.mode("overwrite").partitionBy("resource_type").parquet(path)


def archive_run(df: DataFrame, path: str, run_id: str) -> None:
    """Adds a run's rows under its id; archiving one run again replaces that run only."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "run_id"
    ).parquet(path)


def upsert(rows: DataFrame, base: str, keys: list[str], buckets: int = BUCKETS, merge=None, keep: int = 2) -> None:
    """Writes rows by key into a table of hash buckets; a row replaces the stored one of its key.

    Only the buckets that hold one of the keys are read and written anew, into a folder of their own; then a manifest that
    names the folder of every bucket is committed as the next version, so readers see all of a batch or nothing of
    it, a broken job loses nothing, and of two writers at a time one is refused. ``rows`` has one row a key, else it is
    refused; with ``merge`` it may have more, and ``merge(stored rows of the buckets with the new ones)`` says what
    stays. ``buckets`` stays the same for the life of a table. Folders that the newest ``keep`` versions do not name are removed.
    """
    spark = rows.sparkSession
    fresh = cut_lineage(rows.withColumn("bucket", _bucket(keys, buckets)))
    # At most one row a bucket.
    by_key = fresh.groupBy("bucket", *keys).agg(F.count("*").alias("n"))
    size = by_key.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()
    if merge is None and any(r["n"] != r["k"] for r in size):
        raise ValueError(f"several rows of one {', '.join(keys)}")
    if not size:
        return
    version, manifest = _manifest(spark, base)
    touched = [r["bucket"] for r in size]
    stored = _bucket_rows(spark, base, {b: f for b, f in manifest.items() if b in touched}, rows.schema).withColumn("bucket", _bucket(keys, buckets))
    if merge is None:
        same = [stored[k].eqNullSafe(fresh[k]) for k in keys]
        whole = stored.join(fresh.select("bucket", *keys), [*same, stored["bucket"] == fresh["bucket"]], "left_anti").unionByName(fresh)
    else:
        whole = merge(stored.drop("bucket").unionByName(fresh.drop("bucket"))).withColumn("bucket", _bucket(keys, buckets))
    _commit_buckets(spark, base, version, manifest, whole, touched, keep)


def remove_keys(gone: DataFrame, base: str, keys: list[str], buckets: int = BUCKETS, keep: int = 2) -> None:
    """Removes the rows of these keys from a table written by ``upsert``; other buckets are not touched."""
    spark = gone.sparkSession
    doomed = cut_lineage(gone.select(*keys).distinct().withColumn("bucket", _bucket(keys, buckets)))
    version, manifest = _manifest(spark, base)
    touched = [r["bucket"] for r in doomed.select("bucket").distinct().collect() if r["bucket"] in manifest]
    if not touched:
        return
    stored = _bucket_rows(spark, base, {b: manifest[b] for b in touched}, None).withColumn("bucket", _bucket(keys, buckets))
    same = [stored[k].eqNullSafe(doomed[k]) for k in keys]
    _commit_buckets(spark, base, version, manifest, stored.join(doomed, [*same, stored["bucket"] == doomed["bucket"]], "left_anti"), touched, keep)


def read_keyed(spark: SparkSession, base: str, schema=None) -> DataFrame:
    """The current rows of a table written by ``upsert``; empty with ``schema`` before the first write."""
    _, manifest = _manifest(spark, base)
    if not manifest and schema is None:
        raise ValueError(f"nothing is stored under {base}")
    return _bucket_rows(spark, base, manifest, schema)


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, base: str) -> tuple[int, dict[int, str]]:
    """The newest version and the folder of each bucket."""
    newest = _committed(spark, base, 1)
    return (newest[0][0], {int(b): f for b, f in json.loads(newest[0][1]).items()}) if newest else (0, {})


def _bucket_rows(spark: SparkSession, base: str, folders: dict[int, str], schema) -> DataFrame:
    paths = [f"{base}/data/{folder}/bucket={b}" for b, folder in sorted(folders.items())]
    if not paths:
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(*paths)


def _commit_buckets(spark: SparkSession, base: str, version: int, manifest: dict[int, str], rows: DataFrame, touched: list[int], keep: int) -> None:
    folder = uuid.uuid4().hex
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{base}/data/{folder}")
    full = {int(name.partition("=")[2]) for name in files.names(spark, f"{base}/data/{folder}") if name.startswith("bucket=")}
    left = {b: f for b, f in manifest.items() if b not in touched} | {b: folder for b in full}
    if not files.create_new(spark, _marker(base, version + 1), json.dumps(left)):
        files.remove(spark, f"{base}/data/{folder}")
        raise ValueError(f"another job has written to {base} meanwhile")
    # A folder that no version has ever named may belong to a writer at work; those of versions that go are removed.
    kept = _committed(spark, base, max(1, keep))
    named = {f for _, text in kept for f in json.loads(text).values()}
    for name in files.names(spark, f"{base}/commits"):
        if name.isdigit() and int(name) < kept[-1][0]:
            for old in set(json.loads(files.read_text(spark, f"{base}/commits/{name}") or "{}").values()) - named:
                files.remove(spark, f"{base}/data/{old}")
            files.remove(spark, f"{base}/commits/{name}")


CONTEXT_KEY = ["resource_type", "resource_id"]


def store_contexts(documents: DataFrame, events: DataFrame, path: str, name: str, buckets: int = BUCKETS) -> None:
    """Documents and their events as two tables that are bucketed alike by resource, under ``path``.

    They are named ``<name>_documents`` and ``<name>_events`` in the session's catalog. Joining them by resource, as
    ``context.in_order`` does, moves no row; the events of a resource lie together in order.
    """
    told = events if "resource_type" in events.columns else events.withColumn("resource_type", F.lit(EC2))
    for rows, what, order in ((documents, "documents", CONTEXT_KEY), (told, "events", [*CONTEXT_KEY, "ord"])):
        dealt = rows.repartition(buckets, *CONTEXT_KEY).sortWithinPartitions(*order)
        dealt.write.mode("overwrite").bucketBy(buckets, *CONTEXT_KEY).sortBy(*CONTEXT_KEY).option("path", f"{path}/{what}").saveAsTable(f"{name}_{what}")


def open_contexts(spark: SparkSession, path: str, name: str, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """The stored documents and events, entered into the catalog if this session does not know them yet."""
    for what in ("documents", "events"):
        if not spark.catalog.tableExists(f"{name}_{what}"):
            ddl = spark.read.parquet(f"{path}/{what}")._jdf.schema().toDDL()
            keys = ", ".join(CONTEXT_KEY)
            spark.sql(f"CREATE TABLE {name}_{what} ({ddl}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{path}/{what}'")
    return spark.table(f"{name}_documents"), spark.table(f"{name}_events")


def upsert_contexts(envelopes: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Documents into a table keyed by type and id."""
    upsert(envelopes, path, ["resource_type", "instance_id"], buckets)


def publish(tables: dict[str, DataFrame], base: str, version: int, keep: int | None = None) -> None:
    """Writes all tables into a folder of their own, then claims ``version`` for it by creating its commit marker.

    The marker can be created once, so of several writers of one version one wins and the others are
    refused; their files are removed and nobody has seen them. Readers follow the newest marker and see either
    all old tables or all new ones. A version that is not above the published one is refused. With ``keep`` older
    versions than the newest so many are removed afterwards.
    """
    if not tables:
        raise ValueError("nothing to publish")
    spark = next(iter(tables.values())).sparkSession
    held = published_version(spark, base)
    if held is not None and version <= held:
        raise ValueError(f"version {version} is not above the published version {held}")
    folder = f"v={version}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{base}/versions/{folder}/{name}")
    if not files.create_new(spark, _marker(base, version), folder):
        files.remove(spark, f"{base}/versions/{folder}")
        raise ValueError(f"version {version} has been published by another job")
    if keep is not None:
        remove_old_versions(spark, base, keep)


def _marker(base: str, version: int) -> str:
    return f"{base}/commits/{version:019d}"


def _committed(spark: SparkSession, base: str, newest: int | None = None) -> list[tuple[int, str]]:
    """(version, folder) of the committed versions, newest first; a marker that is empty still is not committed yet."""
    out = []
    for name in reversed(files.names(spark, f"{base}/commits")):
        if name.isdigit() and (folder := files.read_text(spark, f"{base}/commits/{name}")):
            out.append((int(name), folder))
            if newest is not None and len(out) == newest:
                break
    return out


def published_version(spark: SparkSession, base: str) -> int | None:
    found = _committed(spark, base, 1)
    return found[0][0] if found else None


def published_path(base: str, version: int, name: str, spark: SparkSession | None = None) -> str:
    folder = files.read_text(spark or SparkSession.active(), _marker(base, version))
    if not folder:
        raise ValueError(f"version {version} is not published under {base}")
    return f"{base}/versions/{folder}/{name}"


def remove_old_versions(spark: SparkSession, base: str, keep: int) -> list[int]:
    """Removes all committed versions but the newest ``keep`` (one at least), and what refused or broken writers left of them.

    Returns the removed versions. A reader that still holds an old one needs a ``keep`` that outlasts it.
    """
    kept = _committed(spark, base, max(1, keep))
    if not kept:
        return []
    oldest, folders = kept[-1][0], {f for _, f in kept}
    for folder in files.names(spark, f"{base}/versions"):
        if folder not in folders and int(folder.partition("=")[2].partition("-")[0]) <= oldest:
            files.remove(spark, f"{base}/versions/{folder}")
    gone = [int(n) for n in files.names(spark, f"{base}/commits") if n.isdigit() and int(n) < oldest]
    for version in gone:
        files.remove(spark, _marker(base, version))
    return gone


def read_published(spark: SparkSession, base: str, name: str, schema: str | None = None) -> DataFrame:
    """The current version of a published table; empty with ``schema`` before the first publication."""
    version = published_version(spark, base)
    if version is None:
        if schema is None:
            raise ValueError(f"nothing is published under {base}")
        return spark.createDataFrame([], schema)
    return spark.read.parquet(published_path(base, version, name, spark))
