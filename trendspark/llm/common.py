"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def remainder(column: str, n: int) -> Column:
    """crc32 of a key as text, modulo ``n``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [value or b"" for value in column.cast(pa.large_binary()).to_pylist()]


def give_back() -> None:
    """Return freed memory to the system: a worker lives on and idles while other stages run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def batches_by_size(
    batches: Iterator[pa.RecordBatch], column: str, limit: int
) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of ``column``; a longer row is a slice of its own."""
    return _sliced(batches, column, limit, pc.binary_length)


def batches_by_length(
    batches: Iterator[pa.RecordBatch], column: str, limit: int
) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` elements of an array ``column``; a longer row is a slice of its own."""
    return _sliced(batches, column, limit, pc.list_value_length)


def _sliced(
    batches: Iterator[pa.RecordBatch], column: str, limit: int, measure: Callable[[pa.Array], pa.Array]
) -> Iterator[pa.RecordBatch]:
    give_back()
    for batch in batches:
        sizes = pc.fill_null(measure(batch.column(column)), 0).to_pylist()
        start = total = 0
        for row, size in enumerate(sizes):
            if row > start and total + size > limit:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)
        del batch
        give_back()


def total_bytes(df: DataFrame, column: str) -> int:
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def parts_for(spark: SparkSession, size: int, target: int) -> int:
    """Parts of about ``target`` bytes, at least one per shuffle partition."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // target))
