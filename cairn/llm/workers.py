"""Memory of Python workers: bounded Arrow batches, and nothing kept after a task.

An executor runs a worker for each of its cores, next to a JVM that may fill its heap,
and workers are used again by later stages.  So the stages here read batches of a few
megabytes, and give back what allocators hold when a task ends.
"""

from __future__ import annotations

import ctypes
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows and bytes of a batch (a longer row is one by itself).
MOST_ROWS, MOST_BYTES = 2000, 4 << 20

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


_lock = threading.Lock()
_inside: dict[int, tuple[int, dict[str, str]]] = {}


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = MOST_ROWS, size: int = MOST_BYTES) -> Iterator[None]:
    """Jobs started inside send workers at most so much at a time; after the last of a
    session's threads has left, the session's own bounds come back."""
    with _lock:
        depth, before = _inside.get(id(spark), (0, {}))
        if not depth:
            before = {k: spark.conf.get(k) for k in (ROWS, BYTES)}
            own = int(before[ROWS])
            spark.conf.set(ROWS, str(min(rows, own) if own > 0 else rows))
            spark.conf.set(BYTES, str(size))
        _inside[id(spark)] = depth + 1, before
    try:
        yield
    finally:
        with _lock:
            depth, before = _inside.pop(id(spark))
            if depth > 1:
                _inside[id(spark)] = depth - 1, before
            else:
                for k, v in before.items():
                    spark.conf.set(k, v)


def give_back() -> None:
    """Return free memory of the allocators to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def tidy(run: Run) -> Run:
    """``run``, giving memory back when the task ends, fails or is cut short."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied
