"""Tables stored for point lookups: sorted by one key, with Bloom filters on all of them.

A lookup by the first key reads the row groups whose bounds hold it; one by another key those whose Bloom filter does. Both
come with the files, so any reader profits and there is no index to keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_for_lookup(df: DataFrame, path: str, keys: list[str], row_group_bytes: int | None = None, values: int | None = None) -> None:
    """Writes ``df`` spread and sorted by the first key. ``values`` is the expected number of distinct ones in a row group."""
    out = df.repartitionByRange(keys[0]).sortWithinPartitions(*keys).write.mode("overwrite")
    for key in keys:
        out = out.option(f"parquet.bloom.filter.enabled#{key}", "true")
        if values:
            out = out.option(f"parquet.bloom.filter.expected.ndv#{key}", str(values))
    if row_group_bytes:
        out = out.option("parquet.block.size", str(row_group_bytes))
    out.parquet(path)
