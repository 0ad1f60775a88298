"""Streams of rows into a collection: exactly once a batch, restartable from a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 1, format: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", files_per_trigger).load(path)


def insert(stream: DataFrame, path: str, checkpoint: str, step: Callable[[DataFrame], DataFrame] = lambda df: df, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch goes through ``step`` and is written under its own number; a batch that is run again replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def inserted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts a window and key; state of windows that can't change any more is dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
