"""What runs in Python workers: bounded slices of batches in, memory given back at the end."""

from __future__ import annotations

import ctypes
import gc
from functools import wraps

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of a batch that a function sees at once; one longer row comes alone.
SLICE_BYTES = 4 << 20
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of texts, not numbers: a tenth of the default rows unless the session has its own setting."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def give_back() -> None:
    """Freed memory goes back to the system: idle workers stay alive beside those of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # other C libraries have no such call
        pass


def sliced(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, int(batch.num_rows * SLICE_BYTES / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def over_batches(f):
    """For mapInArrow: f gets small slices."""

    @wraps(f)
    def run(batches):
        try:
            yield from f(sliced(batches))
        finally:
            give_back()

    return run


def over_groups(f):
    """For applyInArrow, alone or on a cogroup."""

    def run(*tables):
        try:
            return f(*tables)
        finally:
            del tables
            give_back()

    if f.__code__.co_argcount == 2:
        return lambda a, b: run(a, b)
    return lambda a: run(a)
