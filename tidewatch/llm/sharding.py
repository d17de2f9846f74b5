"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows get numbers by their order, the permutation shuffles the numbers, and shard and slot follow by
division. Given the number of rows and a seed, anybody can compute where a row went and which row is
at a place, without the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.llm.common import free_name
from tidewatch.session import cut_lineage

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed 64-bit mixer (multiply and shift), used as the round function."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, half: int, seed: int, backwards: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for r in range(ROUNDS)[:: -1 if backwards else 1]:
        key = (seed * 0x1000193 + r * 0x9E3779B1 + 1) & ((1 << 64) - 1)
        if backwards:
            left, right = right ^ (_mix(left, key) & mask), left
        else:
            left, right = right, left ^ (_mix(right, key) & mask)
    return (left << shift) | right


def permute(x: np.ndarray, n: int, seed: int = 0, backwards: bool = False) -> np.ndarray:
    """A permutation of 0 to n-1 (or its inverse) applied to ``x``.

    The network permutes a power of four below 4 n; numbers that leave the range walk on along their
    cycle until they return, which they must since the cycle holds their start.
    """
    half = _half_bits(n)
    out = _network(np.asarray(x, dtype=np.uint64), half, seed, backwards)
    while (outside := out >= np.uint64(n)).any():
        out[outside] = _network(out[outside], half, seed, backwards)
    return out.astype(np.int64)


def place(row_number: int, n_rows: int, n_shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = int(permute(np.array([row_number]), n_rows, seed)[0])
    return p % n_shards, p // n_shards


def row_at(shard: int, slot: int, n_rows: int, n_shards: int, seed: int = 0) -> int:
    """The row number at a shard's slot."""
    return int(permute(np.array([slot * n_shards + shard]), n_rows, seed, backwards=True)[0])


def number_rows(rows: DataFrame, by: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """``rows`` with their global number from 0 in the order of ``by``, and how many there are.

    Rows are range-partitioned, numbered within their partition and moved up by the counts of the
    partitions before; one count per partition goes through the driver. Rows that tie are dealt out
    over partitions and get their numbers in any order, so ``by`` should tell unlike rows apart.
    """
    deal, part, start, own = (free_name(rows, n) for n in ("_deal", "_part", "_start", "_own"))
    dealt = rows.withColumn(deal, F.monotonically_increasing_id() % 1009)
    sorted_rows = dealt.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by], F.col(deal)).withColumn(part, F.spark_partition_id())
    # Range bounds are sampled anew by each job; written once, counts and numbers see the same partitions.
    held = cut_lineage(sorted_rows)
    counts = {r[part]: r["count"] for r in held.groupBy(part).count().collect()}
    first, total = {}, 0
    for p in sorted(counts):
        first[p], total = total, total + counts[p]
    starts = F.broadcast(rows.sparkSession.createDataFrame(list(first.items()) or [(0, 0)], f"`{part}` int, `{start}` long"))
    order = Window.partitionBy(part).orderBy(*[F.col(c).asc_nulls_first() for c in by], F.col(deal))
    numbered = held.withColumn(own, F.row_number().over(order).cast("long")).join(starts, part)
    return numbered.select(*rows.columns, (F.col(start) + F.col(own) - 1).alias(name)), total


def shard_rows(rows: DataFrame, by: list[str], n_shards: int = 16, seed: int = 0) -> DataFrame:
    """``rows`` with row_number, shard and slot (all from 0; columns of these names are replaced).

    Shard sizes differ by one row at most and slots have no gaps, whatever the keys, so repeated and
    null keys cannot overfill a shard. Carry only what is needed: all columns of ``rows`` are sorted.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    plain = rows.select(*[c for c in rows.columns if c.lower() not in ("row_number", "shard", "slot")])
    numbered, total = number_rows(plain, by)

    @F.pandas_udf("long")
    def shuffled(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), max(total, 1), seed))

    p = free_name(numbered, "_place")
    out = numbered.withColumn(p, shuffled("row_number"))
    return out.select(*numbered.columns, (F.col(p) % n_shards).cast("int").alias("shard"), F.floor(F.col(p) / n_shards).cast("long").alias("slot"))
