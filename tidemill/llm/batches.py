"""Arrow batches cut by bytes of text, so that very long texts don't fill a Python worker."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.types import StructType


def cut(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows of about max_bytes of column at most (one row may be longer)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(size, (size[at - 1] if at else 0) + max_bytes, "right"))
            end = min(max(end, at + 1), at + max_rows)
            yield batch.slice(at, end - at)
            at = end


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def releasing(run: Callable, *caches) -> Callable:
    """run, after which the worker, which Spark keeps for other tasks, drops these caches and returns its free memory."""

    def wrapped(batches):
        yield from run(batches)
        for c in caches:
            c.cache_clear()
        trim()

    return wrapped


def trim() -> None:
    """Return free memory to the system, after something large was loaded or dropped."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def with_fields(schema: StructType, ddl: str) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])
