"""Small memory for functions over Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache, wraps

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows that a function is given at once.
ROWS = 1000

Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def few_rows(spark: SparkSession) -> None:
    """Has the session hand over ROWS rows at a time, since a batch of long texts stands in both processes; a number that the user has set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ROWS))


@cache
def trim() -> Callable[[int], int]:
    """What gives the C library's free memory back, where there is such a thing."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def lean(step: Step) -> Step:
    """The step over slices of few rows; after each batch the worker, which later tasks reuse, gives back what it has freed."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                yield batch.slice(i, ROWS)
            del batch
            pa.default_memory_pool().release_unused()
            trim()(0)

    @wraps(step)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(slices(batches))
        pa.default_memory_pool().release_unused()
        trim()(0)

    return run
