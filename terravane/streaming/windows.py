"""Event-time windows over streams of events."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events and value by day and type; a day closes when the watermark has passed it."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    sums = stamped.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return sums.select(F.col("w.start").cast("date").alias("day"), "event_type", "n", "total")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Takes what is there, writes it as Parquet, and returns; a later call goes on from there."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def in_arrivals(spark: SparkSession, arrivals: Sequence[DataFrame], windowed: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """What a stream has written after each arrival was put beside those before it.

    Every arrival is written as files, and a new run of the stream takes them up from the
    checkpoint of the last, as after a restart: its state, its watermark and the files it has seen
    are those of the folder.  Rows of windows that the watermark has closed are dropped, and
    windows that it has not closed are not written.
    """
    source, out, checkpoint = (f"{folder}/{name}" for name in ("source", "out", "checkpoint"))
    for arrival in arrivals:
        arrival.write.mode("append").parquet(source)
        stream = spark.readStream.schema(arrival.schema).parquet(source)
        run_available(windowed(stream), out, checkpoint)
    return spark.read.parquet(out)
