"""Whole queries: text columns to phoneme columns, for each language."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType


def widened(df: DataFrame, **columns: str) -> StructType:
    """The schema of df with more columns."""
    more = StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in columns.items()))
    return StructType([*(StructField(f.name, f.dataType) for f in df.schema.fields), *more.fields])


#: Rows, and about how many bytes of them, that a kernel holds as Python objects at once, whatever a batch holds.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut into short ones (a long row stays whole), so that what a kernel makes of them stays small too."""
    for b in batches:
        rows = max(1, min(SLICE_ROWS, SLICE_BYTES * b.num_rows // max(1, b.nbytes)))
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
