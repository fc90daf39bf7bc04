"""Arrow batch plumbing for the operators that run Python on the executors.

Rows: batches and slices may be empty; a slice holds whole rows, one at least, however long its strings are.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textlode.session import ship

#: Bytes of variable-length input that one output batch is made from.
CHUNK_BYTES = 2_000_000
#: Bytes of one Arrow batch between the JVM and Python; both sides hold whole batches, once a running task.
BATCH_BYTES = 4 << 20


def free_name(taken: list[str], name: str) -> str:
    """`name`, or a longer one that no column has (names are compared without case, as Spark does)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, whatever the length of the texts, and make this package importable."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship(spark)


def trim() -> None:
    """Give memory that this task no longer needs back to the system: workers wait for the next task, beside the JVM."""
    pa.default_memory_pool().release_unused()
    library = ctypes.CDLL(None)
    if hasattr(library, "malloc_trim"):
        library.malloc_trim(0)


def chunks(batch: pa.RecordBatch, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of `batch` with about `limit` bytes of strings each; a row is never split."""
    total = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    groups = np.cumsum(total) // limit
    start = 0
    for end in [*(np.flatnonzero(np.diff(groups)) + 1), batch.num_rows]:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], ddl: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """mapInArrow with small slices. `make` runs once a task and returns the function from a slice to a list of columns."""
    small_batches(df.sparkSession)
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = None
        for batch in batches:
            function = function or make()
            for part in chunks(batch, limit):
                columns = function(part)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
        trim()

    return df.mapInArrow(run, schema)


def list_array(parts: list[np.ndarray], kind: np.dtype) -> pa.Array:
    """An Arrow list column from one numpy array a row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind, copy=False)))
