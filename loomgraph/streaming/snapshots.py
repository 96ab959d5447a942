"""Extension: snapshots and running statistics of an event stream, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Per tumbling snapshot and type: events and their value; a snapshot closes once the watermark passes its end."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(
        F.unix_timestamp("w.start").alias("start"), "event_type", "n", "value"
    )


def running_means(events: DataFrame) -> DataFrame:
    """(user_id, n, mean) after each batch: the pooled mean of a stream, its state three numbers a user."""

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n += len(f)
            total += float(f["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "mean": [total / n]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, mean double", "n long, total double", "update", "NoTimeout")


def drain(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream to the end of what its source holds now and gives the table it made."""
    spark = stream.sparkSession
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
