"""Column names, text normalisation and size-checked joins shared by the operators of this folder."""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.session import cut_lineage

# The word patterns of the operators' contracts.
SPACES = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Rows up to which a counted table may be broadcast. Each such table has rows of a few dozen bytes.
BROADCAST_ROWS = 200_000

# Bits of a bitmap for each value it holds, and its least and greatest size: 64 MB, whatever the data.
BITMAP_SHARE = 16
BITMAP_BITS = (1 << 15, 1 << 29)
# Bits of one row of Spark's bitmap aggregate.
_BITMAP_ROW = 1 << 15


@dataclass(frozen=True)
class Bitmap:
    """Says of 64-bit hashes whether they may be among its values; a value that is among them is never denied."""

    bits: np.ndarray

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & (8 * len(self.bits) - 1)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bitmap(values: DataFrame, column: str) -> Broadcast[Bitmap]:
    """A broadcast bitmap of the 64-bit hashes in ``column``, of at most 64 MB.

    It gets sixteen bits a value up to that size; beyond, it denies fewer of the others and stays right. ``values`` is materialised.
    """
    held = cut_lineage(values.select(column))
    least, most = BITMAP_BITS
    size = min(most, max(least, 1 << (BITMAP_SHARE * held.count()).bit_length()))
    place = F.col(column).bitwiseAND(F.lit(size - 1))
    # The aggregate numbers its positions within rows of 32,768 bits from the value's absolute place.
    rows = held.select(F.shiftright(place, 15).alias("row"), place.bitwiseAND(F.lit(_BITMAP_ROW - 1)).alias("bit"))
    found = rows.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    bits = np.zeros(size // 8, np.uint8)
    for r in found:
        bits[r["row"] * (_BITMAP_ROW // 8) :][: _BITMAP_ROW // 8] = np.frombuffer(r["bits"], np.uint8)
    return values.sparkSession.sparkContext.broadcast(Bitmap(bits))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A to Z alone, whatever the locale and the other scripts say."""
    return F.translate(text, UPPER, UPPER.lower())


def words_of(text: Column, gaps: str = SPACES) -> Column:
    """The words between ``gaps``; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gaps), "")


def text_tie(text: Column) -> Column:
    """A number that tells apart rows of one id; with the id it names a document. Never null."""
    return F.xxhash64(text)


def release_memory() -> None:
    """Gives what a Python worker no longer uses back to its machine: workers live on for the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are few; else without, for a shuffled join.

    ``df`` should be cheap or already materialised, since counting runs it.
    """
    return F.broadcast(df) if df.count() <= limit else df
