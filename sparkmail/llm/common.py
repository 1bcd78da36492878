"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmail.session import staging_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write rows to the shared folder and read them again: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = staging_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(key: str | Column, modulus: int = 4) -> Column:
    """crc32 of a key as text, modulo; null for a null key."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % modulus


def held_out(key: str) -> Column:
    """True for rows that models never learn from. A row without a key is not held out, but not learned from either."""
    return F.coalesce(remainder(key) == 2, F.lit(False))


def smallest_hashes(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most n rows, those whose keys have the smallest hashes; about 4 n rows are left to be ordered, so that what
    tasks send to the driver does not grow with their number. Smaller tables are taken whole, as far as n reaches."""
    share = min(1.0, 4 * n / max(1, df.count()))
    rank = F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    rest = [c for c in df.columns if c not in keys]
    return df.where(rank <= int(share * (1 << 40))).orderBy(rank, *keys, *rest).limit(n)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts and the offsets of its rows; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch whose texts have about `size` bytes together, at least one row each."""
    ends = np.cumsum(np.diff(texts_of(batch.column(column))[1]))
    start = 0
    while start < len(batch):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
