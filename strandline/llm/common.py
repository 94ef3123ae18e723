"""Helpers shared by the operators of this subpackage, with those for the shared folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.storage import materialise, shared_path as scratch

__all__ = ["HOT", "WORD", "binary", "give_back", "join_hot", "materialise", "remove", "scratch", "table", "trimmed", "worker_cache"]

#: ASCII white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot with more than one row in so many, and there are fewer such keys.
HOT = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def join_hot(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined to table(key, n, ...) by key, where n of rows have the key. Hot keys, fewer than HOT, are broadcast, so that their rows stay where they are."""
    total = table.agg(F.sum(n)).first()[0] or 0
    hot = table.where(F.col(n) * HOT > total)
    if not hot.take(1):
        return rows.join(table, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.where(F.col(n) * HOT <= total), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def binary(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


_HELD: dict = {}


def worker_cache(key: tuple, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: one thing, so that operators that share a worker don't add up."""
    if key not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Returns to the system the freed memory that Arrow and the C library hold on to."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # not every C library has it
        trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, which gives back at a task's end what the task has freed: a worker idles on beside later stages, those without Python too."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
