"""Arrow batches of texts as arrays, for operators that count inside a block before they shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes that Spark hands to Python at once; they bound a worker's memory.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session: rows of text differ much in length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in blocks of about ``size`` bytes."""
    held, total = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            total += batch.nbytes
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column; a null is empty."""
    x = column.cast(pa.large_binary()).fill_null(b"")
    if not len(x):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
    data = x.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets
