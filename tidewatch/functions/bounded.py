"""Small literal tables and global top-n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schemas import struct_of


def literal_rows(spark: SparkSession, ddl: str, rows: list[tuple]) -> DataFrame:
    """A small literal table as a plan of constants, whose size the optimizer knows."""
    fields = struct_of(ddl).fields
    items = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*items)))


def newest(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Global top-``n`` by partial heaps per task; no single-partition window."""
    return df.orderBy(*order).limit(n)
