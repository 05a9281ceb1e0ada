"""Streaming forms. Every row-wise plan works on a stream without state; what needs state is counting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import mining


def texts(spark: SparkSession, path: str, schema: str, most_files: int = 16) -> DataFrame:
    """A stream of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def word_counts(stream: DataFrame, text: str, at: str, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Counts of words in each window of time; state goes once the watermark has passed."""
    words = stream.withWatermark(at, late).select(at, F.explode(T.word_tokens(F.lower(text))).alias("word"))
    return words.groupBy(F.window(at, every), "word").agg(F.count("*").alias("n"))


def bigram_counts(stream: DataFrame, text: str, at: str, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    pairs = stream.withWatermark(at, late).select(at, T.word_tokens(F.lower(text)).alias("_t")).select(at, F.explode(mining.bigrams(F.col("_t"))).alias("b"))
    return pairs.groupBy(F.window(at, every), "b.w1", "b.w2").agg(F.count("*").alias("n"))


def finish(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None):
    """Runs a stream over what is there and stops: a table in memory, for tests and small results."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return query
