"""What the operators of this subpackage share: reading tables, shared scratch space, batches of text."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one step of a Python kernel takes at once; bounds a worker's memory whatever a batch holds.
STEP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session; only where that is unset and all
    runs on one machine, as in tests, a local one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "phonolake-checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, codec: str = "zstd", write: Callable | None = None) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage ends there, so a lost executor costs the
    lost tasks only."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/phonolake-{uuid.uuid4().hex}"
    schema = df.schema
    (write(df.write) if write else df.write).option("compression", codec).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._phonolake_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a materialised table that nothing reads any more."""
    path = getattr(df, "_phonolake_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `most` bytes of the column text (one long row stays whole)."""
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index(text))
        sizes = [0 if v is None else v for v in pa.compute.binary_length(sizes).to_pylist()]
        begin = have = 0
        for i, n in enumerate(sizes):
            if have and have + n > most:
                yield batch.slice(begin, i - begin)
                begin, have = i, 0
            have += n + 64
        if begin < len(sizes):
            yield batch.slice(begin, len(sizes) - begin)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
