"""Event-time windows and exact deduplication over streams; the same functions work on batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def late(events: DataFrame, time: str, delay: str) -> DataFrame:
    if not events.isStreaming:
        return events
    if dict(events.dtypes)[time] == "timestamp_ntz":  # watermarks need an instant
        events = events.withColumn(time, F.col(time).cast("timestamp"))
    return events.withWatermark(time, delay)


def tumbling(events: DataFrame, width: str, by: list[str], time: str = "ts", delay: str = "1 hour", value: str = "value") -> DataFrame:
    """start, the keys, n and total of each window."""
    found = late(events, time, delay).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return found.select(F.col("w.start").alias("start"), *by, "n", "total")


def sliding(events: DataFrame, width: str, step: str, by: list[str], time: str = "ts", delay: str = "1 hour") -> DataFrame:
    found = late(events, time, delay).groupBy(F.window(time, width, step).alias("w"), *by).agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, gap: str, by: list[str], time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """start, end and n of runs of events with gaps shorter than `gap`."""
    found = late(events, time, delay).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def first_seen(urls: DataFrame, key: str = "url") -> DataFrame:
    """Each key once, exactly: keyed state in a stream, no approximate filter."""
    return urls.dropDuplicates([key])


def first_seen_within(urls: DataFrame, key: str, time: str, horizon: str) -> DataFrame:
    """The same with state that forgets keys after the horizon: it may let an old key pass again, never drops a new one."""
    return urls.withWatermark(time, horizon).dropDuplicatesWithinWatermark([key])


def publish(stream: DataFrame, path: str, checkpoint: str, keys: list[str]):
    """Appends each micro-batch once: a batch writes the folder of its number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
