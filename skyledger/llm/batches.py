"""Bounded slices of Arrow record batches for the map-only tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 20
BATCH_BYTES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Have Spark pass batches of some BATCH_BYTES to Python, for the rest of the session.

    By default a batch ends at 10,000 rows or 64 MB, and a task holds several of them off the heap and in its worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving back at the end of a task what its worker holds without use; workers serve many tasks."""
    def done(batches):
        yield from run(batches)
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
            pool.release_unused()

    return done


def row_slices(batches: Iterable[pa.RecordBatch], column: str = "__in", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about `limit` bytes of `column`, or one row that is longer by itself."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type) or pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type)):
            yield batch
            continue
        wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
        offsets = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32, count=col.offset + len(col) + 1)[col.offset:].astype(np.int64)
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
