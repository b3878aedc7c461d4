"""Incremental work: streams of arriving rows against state, and changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.operators.stats import manifest_changes
from vellum.sources.payloads import file_hashes


def first_arrivals(stream: DataFrame, key: str, time: str, within: str = "30 days") -> DataFrame:
    """Rows of a stream whose key was not met within the watermark; the state is dropped behind it."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, size: str, by: str, late: str = "10 minutes") -> DataFrame:
    """(start, by, n) of tumbling windows; rows later than `late` are left out. An extension."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), by).count().select(F.col("window.start").alias("start"), by, F.col("count").alias("n"))


def ingest_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, by_date: str = "date") -> StreamingQuery:
    """Files as they arrive, each date's rows written once: a repeated batch overwrites its own dates."""
    rows = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, _: int) -> None:
        batch.dropDuplicates().write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by_date).parquet(sink)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(path, change) against the manifest (path, hash) of the last run."""
    return manifest_changes(manifest, file_hashes(spark, folder).select("path", "hash"))
