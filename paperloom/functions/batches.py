"""What a Python worker holds at once: small Arrow batches, and memory given back."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes of one Arrow batch. Texts can be long, so a batch holds few of them.
BATCH_ROWS, MOST_BYTES = 256, 1 << 24


def small_batches(spark: SparkSession | None = None, rows: int = BATCH_ROWS) -> None:
    """Bounds what a Python worker holds at once: rows of long texts. Without it a batch has up to 10 000 of them."""
    spark = spark or SparkSession.active()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(MOST_BYTES))


def release() -> None:
    """Workers live on between tasks; what their allocators keep would count against their executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
