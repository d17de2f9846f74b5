"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are dealt into blocks. A block holds its vectors and, for each dimension, the list of its rows by value. A
query walks all lists of a block side by side, each from the end that its weight favours; what it meets for the first time
is scored whole, and the values at the present depth bound the score of all rows not met yet. As soon as that
bound cannot reach the query's k-th best score so far (from this and earlier blocks of the task), the block is done; a block whose
best values cannot reach it is not walked at all. The k best of each task are merged by a window.

Blocks are written once, with their lists, to the shared folder. Queries pass over them in batches of bounded size,
which are broadcast; each batch is answered by a bounded number of tasks, so that what the
tasks return stays in proportion to the queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.session import scratch_path

# Vectors of a block; queries of a batch (about: whole blocks are dealt to batches by a hash); batches of one job.
BLOCK_ROWS = 4096
BATCH_QUERIES = 16_384
JOB_BATCHES = 16
# Tasks that answer a batch: each returns k rows a query.
BATCH_TASKS = 64
# Depth of the first walk into the lists; each further one goes twice as deep.
FIRST_DEPTH = 16
LAST_ID = np.iinfo(np.int64).max

_BLOCK_TYPE = "_block long, _n int, _kind string, _vectors binary, _lists binary, _ids binary, _no_id binary, _queries binary, _n_queries long"
_FOUND_TYPE = "_block long, _at int, query_id long, vec_id long, score long"


def whole_components(vectors: pa.ListArray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * component) of the rows without null or non-finite components, and which rows those are.

    Shorter vectors are filled up with zeros, which add nothing to an inner product.
    """
    present = vectors.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(present, vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    fine = present & (np.bincount(row[~np.isfinite(flat)], minlength=len(sizes)) == 0)
    own = fine[row]
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    number = np.cumsum(fine) - 1
    out = np.zeros((int(fine.sum()), int(sizes[fine].max(initial=0))))
    out[number[row[own]], at[own]] = np.floor(scale * flat[own])
    if np.abs(out).max(initial=0) >= 2.0**62:
        raise ValueError("a vector's components are beyond whole numbers of 64 bits")
    return out.astype(np.int64), np.flatnonzero(fine)


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest type that holds them."""
    most = int(np.abs(values).max(initial=0))
    return values.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


def _blocks(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    part, n_blocks, held = TaskContext.get().partitionId(), 0, []

    def close(rows: pa.Table) -> pa.RecordBatch:
        vectors, fine = whole_components(rows.column("_vector").combine_chunks(), scale)
        ids = rows.column("_id").combine_chunks().take(pa.array(fine))
        asks = np.flatnonzero(rows.column("_asks").combine_chunks().take(pa.array(fine)).to_numpy(zero_copy_only=False)).astype(np.int32)
        narrow = _narrow(vectors)
        lists = np.argsort(narrow, axis=0, kind="stable").T.astype(np.uint16 if len(fine) <= 1 << 16 else np.uint32)
        return pa.record_batch({
            "_block": pa.array([(part << 32) | n_blocks]), "_n": pa.array([len(fine)], pa.int32()), "_kind": pa.array([f"{narrow.dtype.str},{lists.dtype.str}"]),
            "_vectors": pa.array([narrow.tobytes()], pa.binary()), "_lists": pa.array([np.ascontiguousarray(lists).tobytes()], pa.binary()),
            "_ids": pa.array([ids.fill_null(LAST_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()),
            "_no_id": pa.array([ids.is_null().to_numpy(zero_copy_only=False).tobytes()], pa.binary()),
            "_queries": pa.array([asks.tobytes()], pa.binary()), "_n_queries": pa.array([len(asks)]),
        })

    for batch in batches:
        held.append(batch)
        rows = pa.Table.from_batches(held)
        while rows.num_rows >= BLOCK_ROWS:
            yield close(rows.slice(0, BLOCK_ROWS))
            rows, n_blocks = rows.slice(BLOCK_ROWS), n_blocks + 1
        held = rows.combine_chunks().to_batches()
    if held and held[0].num_rows:
        yield close(pa.Table.from_batches(held))


@dataclass
class Block:
    number: int
    vectors: np.ndarray
    lists: np.ndarray
    ids: np.ndarray
    no_id: np.ndarray
    queries: np.ndarray

    @classmethod
    def read(cls, row: dict) -> Block:
        n, (kind, list_kind) = row["_n"], row["_kind"].split(",")
        vectors = np.frombuffer(row["_vectors"], kind).reshape(n, -1) if n else np.zeros((0, 0), np.int8)
        lists = np.frombuffer(row["_lists"], list_kind).reshape(vectors.shape[1], n)
        return cls(row["_block"], vectors, lists, np.frombuffer(row["_ids"], "<i8"), np.frombuffer(row["_no_id"], bool), np.frombuffer(row["_queries"], np.int32))


@dataclass
class Queries:
    """A batch: where each query stands, its id and its vector."""

    block: np.ndarray
    at: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray


class Best:
    """The k best rows of each query of a batch so far: by score, then id, rows without an id last."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))] * n
        self.last = np.full(n, -np.inf)

    def offer(self, i: int, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        """A row that ties with the last may still come before it."""
        fit = score >= self.last[i]
        if not fit.any():
            return
        rows = [np.concatenate(pair) for pair in zip(self.rows[i], (score[fit].astype(np.int64), ids[fit], no_id[fit]))]
        order = np.lexsort((rows[1], rows[2], -rows[0]))[: self.k]
        self.rows[i] = tuple(x[order] for x in rows)
        if len(order) == self.k:
            self.last[i] = self.rows[i][0][-1]


def walk(block: Block, queries: Queries, best: Best) -> int:
    """Offers the rows of one block to all queries; returns how many rows were scored."""
    n = len(block.ids)
    if not n or not best.k:
        return 0
    d = max(block.vectors.shape[1], queries.vectors.shape[1])
    most = int(np.abs(block.vectors.astype(np.int64)).max(initial=0)) * int(np.abs(queries.vectors).max(initial=0)) * max(1, d)
    if most >= 1 << 63:
        raise ValueError("inner products are beyond 64 bits")
    # Whole numbers below these bounds are added without rounding.
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    fill = lambda a: np.pad(a, ((0, 0), (0, d - a.shape[1]))).astype(kind)
    vectors, asked = fill(block.vectors), fill(queries.vectors)
    lists = np.pad(block.lists, ((0, d - len(block.lists)), (0, 0))).astype(np.int64)
    depths = [0]
    while depths[-1] < n:
        depths.append(min(n, max(FIRST_DEPTH, 2 * depths[-1])))
    # The most that a row below each depth can score: its values are at best those that come next in the lists.
    up, down = np.maximum(asked, 0), np.minimum(asked, 0)
    column = np.arange(d)
    bounds = [up @ vectors[lists[:, n - 1 - e], column] + down @ vectors[lists[:, e], column] for e in depths if e < n]
    falling = lists[:, ::-1]
    scored = 0
    for i in np.flatnonzero(bounds[0] >= best.last):
        q = asked[i]
        high, low = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        met = np.zeros(n, bool)
        if queries.block[i] == block.number:
            met[queries.at[i]] = True
        if not len(high) + len(low):
            # All scores are zero: no list says anything.
            rows = np.flatnonzero(~met)
            scored += len(rows)
            best.offer(i, np.zeros(len(rows), np.int64), block.ids[rows], block.no_id[rows])
            continue
        for level in range(1, len(depths)):
            lo, hi = depths[level - 1], depths[level]
            new = np.zeros(n, bool)
            new[falling[high, lo:hi].ravel()] = True
            new[lists[low, lo:hi].ravel()] = True
            new &= ~met
            rows = np.flatnonzero(new)
            if len(rows):
                met |= new
                scored += len(rows)
                best.offer(i, vectors[rows] @ q, block.ids[rows], block.no_id[rows])
            if hi == n or bounds[level][i] < best.last[i] or met.all():
                break
    return scored


def _collected(blocks: DataFrame) -> Queries:
    """One batch of queries on the driver: about BATCH_QUERIES vectors."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block.read(row)
                own = b.vectors[b.queries]
                yield pa.record_batch({"_block": pa.array([b.number] * len(own), pa.int64()), "_at": pa.array(b.queries), "_id": pa.array(b.ids[b.queries]), "_vector": pa.array(list(own.astype(np.int64)), pa.list_(pa.int64()))})

    rows = blocks.mapInArrow(task, "_block long, _at int, _id long, _vector array<long>").toArrow()
    width = max(rows.column("_vector").combine_chunks().value_lengths().to_pylist(), default=0)
    vectors = np.zeros((rows.num_rows, width), np.int64)
    for i, v in enumerate(rows.column("_vector").to_pylist()):
        vectors[i, : len(v)] = v
    return Queries(rows.column("_block").to_numpy(), rows.column("_at").to_numpy(), rows.column("_id").to_numpy(), vectors)


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``is_query`` holds its k highest inner products.

    Components are taken as floor(scale * x), so scores are whole numbers and exact. Candidates are all rows but the query's own,
    which is told by its place, not by its id: another row of the same id is a candidate. Ties go to the smaller id,
    rows without an id come last among equals. Fewer candidates than k give all. Ids are whole numbers; a row
    without one, or for which ``is_query`` is null, asks nothing. Vectors that are null or hold a null or
    non-finite component take no part, as query or candidate; an empty one scores zero with all; shorter ones are filled up with zeros. Scores
    beyond 64 bits raise. Other columns of ``vectors`` are not carried. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector).alias("_vector"), F.coalesce(is_query & F.col(id_col).isNotNull(), F.lit(False)).alias("_asks"))
    path, out = scratch_path(spark, "lists"), scratch_path(spark, "nearest")
    source.mapInArrow(lambda batches: _blocks(batches, scale), _BLOCK_TYPE).write.parquet(path)
    stored = spark.read.parquet(path)
    n_queries = stored.agg(F.sum("_n_queries")).first()[0] or 0
    n_batches = -(-n_queries // BATCH_QUERIES)
    asking = stored.where("_n_queries > 0")

    def answered(batch: int) -> DataFrame:
        shared = spark.sparkContext.broadcast(_collected(asking.where(F.pmod(F.xxhash64("_block"), F.lit(n_batches)) == batch)))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries = shared.value
            best = Best(len(queries.ids), k)
            for rows in batches:
                for i in range(rows.num_rows):
                    walk(Block.read(rows.slice(i, 1).to_pylist()[0]), queries, best)
            for lo in range(0, len(queries.ids), 2000):
                part = best.rows[lo : lo + 2000]
                of = np.repeat(np.arange(lo, lo + len(part)), [len(r[0]) for r in part])
                score, ids, no_id = (np.concatenate(x) for x in zip(*part))
                yield pa.record_batch({
                    "_block": pa.array(queries.block[of]), "_at": pa.array(queries.at[of]), "query_id": pa.array(queries.ids[of]),
                    "vec_id": pa.array(ids, mask=no_id), "score": pa.array(score),
                })

        return stored.coalesce(BATCH_TASKS).mapInArrow(task, _FOUND_TYPE)

    spark.createDataFrame([], _FOUND_TYPE).write.parquet(out)
    for lo in range(0, n_batches, JOB_BATCHES):
        reduce(DataFrame.unionAll, map(answered, range(lo, min(lo + JOB_BATCHES, n_batches)))).write.mode("append").parquet(out)
    order = Window.partitionBy("_block", "_at").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return spark.read.parquet(out).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
