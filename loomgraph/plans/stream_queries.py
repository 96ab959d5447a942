"""Extension queries over the event stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomgraph.plans.registry import query
from loomgraph.sources.fixture import load
from loomgraph.streaming.snapshots import drain, running_means, snapshot_counts


def stream(spark, sf_dir):
    """The event table as a stream of its file."""
    schema = load(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")


@query("SELECT CAST(floor(epoch(date_trunc('day', ts))) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 3) AS value FROM events GROUP BY 1, 2")
def stream_snapshots(spark, sf_dir):
    """G11 (streaming): tumbling snapshots of one day; complete mode keeps the open ones."""
    out = drain(snapshot_counts(stream(spark, sf_dir)), f"s{uuid.uuid4().hex}", "complete")
    return out.select("start", "event_type", "n", F.round("value", 3).alias("value"))


@query("SELECT user_id, count(*) AS n, round(avg(value), 3) AS mean FROM events GROUP BY 1")
def stream_running_means(spark, sf_dir):
    """Pooled statistics kept as state; the last update of each user."""
    out = drain(running_means(stream(spark, sf_dir).select("user_id", "value")), f"s{uuid.uuid4().hex}", "update")
    last = out.groupBy("user_id").agg(F.max_by("mean", "n").alias("mean"), F.max("n").alias("n"))
    return last.select("user_id", "n", F.round("mean", 3).alias("mean"))
