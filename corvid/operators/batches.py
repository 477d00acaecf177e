"""Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

BATCH_BYTES = 4 << 20
SLICE = 1 << 19  # bytes of text that a worker takes apart at a time
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def bounded_batches(spark: SparkSession) -> None:
    """Has Spark cut the batches that Python workers get by bytes too, as rows
    alone let a batch of long texts grow without bound. Holds for the session,
    unless it has a setting of its own."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, BATCH_BYTES)


def runs(cost: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs [first, end) of rows that cost `most` together, one row at least."""
    total, a = np.cumsum(cost), 0
    while a < len(total):
        before = int(total[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(total, before + most, "right")))
        yield a, b
        a = b


def by_bytes(batch: pa.RecordBatch, text: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of so many bytes of text, never cutting one."""
    size = pc.fill_null(pc.cast(pc.binary_length(batch.column(text)), pa.int64()), 0).to_numpy(zero_copy_only=False)
    for a, b in runs(size + 64, most):
        yield batch.slice(a, b - a)


def where_true(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As np.nonzero of a matrix in C order, several times faster where few are true."""
    return np.divmod(np.flatnonzero(m), max(1, m.shape[1]))


def give_back() -> None:
    """Returns freed memory to the system: workers outlive their task."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
