"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockweave.operators.staging import discard, shared_root, staged

__all__ = ["GAP", "WORD", "discard", "let", "returning_memory", "shared_root", "slices", "staged", "table", "words_of"]

#: Java pattern of one word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """Evaluate value once and bind it for body; a plain reference inside a lambda would be evaluated for each element."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


Batches = Iterator[pa.RecordBatch]


def slices(batches: Batches, rows: int = 256, size: int = 1 << 21) -> Batches:
    """Batches in parts of about so many rows and bytes at most, so that few of their values are Python objects at once."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = min(rows, b.num_rows - at)
            while n > 1 and b.slice(at, n).nbytes > size:
                n //= 2
            yield b.slice(at, n)
            at += n


def returning_memory(f: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """f for mapInArrow. Python workers stay for the tasks that follow, so what one has freed is given back to the system
    at its end."""

    @wraps(f)
    def run(batches: Batches) -> Batches:
        try:
            yield from f(batches)
        finally:
            import ctypes

            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run
