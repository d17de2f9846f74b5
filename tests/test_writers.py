"""Publication by compare-and-set, removal of old versions, and tables written by key."""

import os

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import files, writers


def test_two_publishers_of_one_version(spark, tmp_path, monkeypatch):
    """The second writes its files while the first commits; it is refused and leaves nothing behind."""
    base = str(tmp_path)
    writers.publish({"t": spark.range(1)}, base, 1)
    create, once = files.create_new, []

    def interleaved(spark, path, text):
        if not once:
            once.append(1)
            writers.publish({"t": spark.range(7)}, base, 2)
        return create(spark, path, text)

    monkeypatch.setattr(files, "create_new", interleaved)
    with pytest.raises(ValueError, match="another job"):
        writers.publish({"t": spark.range(3)}, base, 2)
    assert writers.published_version(spark, base) == 2 and writers.read_published(spark, base, "t").count() == 7
    assert len(files.names(spark, f"{base}/versions")) == 2


def test_an_empty_marker_is_not_committed(spark, tmp_path):
    base = str(tmp_path)
    writers.publish({"t": spark.range(4)}, base, 3)
    files.create_new(spark, writers._marker(base, 4), "")
    assert writers.published_version(spark, base) == 3
    with pytest.raises(ValueError):
        writers.published_path(base, 4, "t")
    writers.publish({"t": spark.range(5)}, base, 5)
    assert writers.read_published(spark, base, "t").count() == 5


def test_old_versions_go_and_the_newest_never(spark, tmp_path):
    base = str(tmp_path)
    assert writers.remove_old_versions(spark, base, 2) == []
    for v in (1, 2, 5, 9):
        writers.publish({"t": spark.range(v)}, base, v, keep=2)
    assert [int(n) for n in files.names(spark, f"{base}/commits")] == [5, 9]
    assert sorted(n.split("-")[0] for n in files.names(spark, f"{base}/versions")) == ["v=5", "v=9"]
    # What a writer left behind that died before its commit goes with the versions around it; a newer one may be at work.
    spark.range(1).write.parquet(f"{base}/versions/v=6-dead/t")
    spark.range(1).write.parquet(f"{base}/versions/v=10-atwork/t")
    assert writers.remove_old_versions(spark, base, 0) == [5]
    assert sorted(n.split("-")[0] for n in files.names(spark, f"{base}/versions")) == ["v=10", "v=9"]
    assert writers.read_published(spark, base, "t").count() == 9


def held(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upserts_touch_only_the_buckets_of_their_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda pairs: spark.createDataFrame(pairs, "kind string, id string, v int")
    writers.upsert(rows([("a", str(i), i) for i in range(200)] + [("a", None, -1)]), path, ["kind", "id"], 16)
    before = held(path)
    writers.upsert(rows([("a", "7", 700), ("b", "7", 7)]), path, ["kind", "id"], 16)
    after = held(path)
    assert before <= after and 1 <= len(after - before) <= 2
    writers.upsert(rows([]), path, ["kind", "id"], 16)
    writers.upsert(rows([("a", None, -2)]), path, ["kind", "id"], 16)
    got = {(r.kind, r.id): r.v for r in writers.read_keyed(spark, path).collect()}
    assert got == {**{("a", str(i)): i for i in range(200)}, ("a", "7"): 700, ("b", "7"): 7, ("a", None): -2}
    with pytest.raises(ValueError):
        writers.upsert(rows([("a", "1", 1), ("a", "1", 2)]), path, ["kind", "id"], 16)


def test_removed_keys_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    assert writers.read_keyed(spark, path, "id long, v long").count() == 0
    writers.upsert(spark.range(30).withColumn("v", F.col("id") * 2), path, ["id"], 8)
    writers.remove_keys(spark.range(3), path, ["id"], 8)
    assert {r.id for r in writers.read_keyed(spark, path).collect()} == set(range(3, 30))
    writers.remove_keys(spark.range(100), path, ["id"], 8)
    with pytest.raises(ValueError):
        writers.read_keyed(spark, path)


def test_a_writer_that_was_overtaken_is_refused(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    writers.upsert(spark.range(8), path, ["id"], 4)
    create, once = files.create_new, []

    def interleaved(spark, at, text):
        if not once:
            once.append(1)
            writers.upsert(spark.range(8, 10), path, ["id"], 4)
        return create(spark, at, text)

    monkeypatch.setattr(files, "create_new", interleaved)
    with pytest.raises(ValueError, match="another job"):
        writers.upsert(spark.range(10, 12), path, ["id"], 4)
    assert sorted(r.id for r in writers.read_keyed(spark, path).collect()) == list(range(10))


def test_files_stay_bounded_over_many_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(12):
        writers.upsert(spark.range(i, i + 20).withColumn("v", F.lit(i)), path, ["id"], 4)
    rows = {r.id: r.v for r in writers.read_keyed(spark, path).collect()}
    assert rows == {**{i: i for i in range(11)}, **{i: 11 for i in range(11, 31)}}
    assert len(held(path)) <= 2 * 4 and len(files.names(spark, f"{path}/commits")) == 2


def test_an_upsert_stores_its_batch_once_beside_the_table(spark, tmp_path, monkeypatch):
    stored, cut = [], writers.cut_lineage
    monkeypatch.setattr(writers, "cut_lineage", lambda df: stored.append(1) or cut(df))
    base = str(tmp_path / "keyed")
    writers.upsert(spark.createDataFrame([(1, None, "a"), (2, "x", "b")], "k long, l string, v string"), base, ["k", "l"], 4)
    writers.upsert(spark.createDataFrame([(1, None, "c"), (1, "", "d")], "k long, l string, v string"), base, ["k", "l"], 4)
    assert len(stored) == 2
    assert sorted(r["v"] for r in writers.read_keyed(spark, base).collect()) == ["b", "c", "d"]
    writers.remove_keys(spark.createDataFrame([(2, "x")], "k long, l string"), base, ["k", "l"], 4)
    assert sorted(r["v"] for r in writers.read_keyed(spark, base).collect()) == ["c", "d"]
