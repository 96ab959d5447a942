"""Times of nodes: index, snapshots, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import NONE, TemporalGraph, union


def temporal_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (node, ts) over node times and both ends of edges, untimed ones left out; frames with global ids."""
    found = union(
        [
            nodes.select(F.col("id").alias("node"), F.col("timestamp_from").alias("ts")),
            edges.select(F.col("src").alias("node"), F.col("timestamp_from").alias("ts")),
            edges.select(F.col("dst").alias("node"), F.col("timestamp_from").alias("ts")),
        ]
    )
    return found.where(F.col("ts") != NONE).distinct()


def graph_times(g: TemporalGraph) -> DataFrame:
    """Every time of the graph, untimed ones included, as (ts)."""
    return g.all_nodes("timestamp_from").select(F.col("timestamp_from").alias("ts")).unionByName(g.all_edges("timestamp_from").select(F.col("timestamp_from").alias("ts")))


def first_time(nodes: DataFrame, index: DataFrame) -> DataFrame:
    low = index.groupBy(F.col("node").alias("id")).agg(F.min("ts").alias("first_ts"))
    return nodes.join(low, "id", "left").withColumn("first_ts", F.coalesce("first_ts", F.lit(NONE).cast("long")))


def snapshots(times: DataFrame, n: int) -> list[tuple[int, int]]:
    """Equal-width [start, end] over the timed range; fewer if the range is shorter than n. Raises where nothing is timed."""
    lo, hi = times.where(F.col("ts") != NONE).agg(F.min("ts"), F.max("ts")).first()
    if lo is None:
        raise ValueError("no timed nodes or edges")
    hi += 1
    n = max(1, min(n, hi - lo))
    width = (hi - lo) / n
    return [(int((lo + i * width) // 1), -int(-(lo + (i + 1) * width) // 1)) for i in range(n)]


def snapshot_of(ts: Column, bounds: list[tuple[int, int]]) -> Column:
    """1 + the number of boundaries (-1, then the starts) below ts: untimed nodes get 1, ts equal to a start the snapshot before."""
    below = F.filter(F.array(*[F.lit(b).cast("long") for b in (NONE, *(s for s, _ in bounds))]), lambda b: b < ts)
    return (F.size(below) + 1).cast("long")


def window_of(bounds: dict[int, list[tuple[int, int]]]) -> tuple[int, int]:
    """The window of the largest snapshot set: from 0 to the width of its first snapshot."""
    start, end = bounds[max(bounds)][0]
    return 0, end - start


def window_partners(left: DataFrame, right: DataFrame, window: tuple[int, int]) -> DataFrame:
    """Pairs (node, ts, partner, partner_ts) with partner_ts in [ts + w0, ts + w1): a range join by buckets of the window's width.

    A time falls in one bucket on the right and in two at most on the left, so the join is an equi-join with a residual.
    """
    w0, w1 = window
    width = max(1, w1 - w0)
    r = right.select(F.col("node").alias("partner"), F.col("ts").alias("partner_ts"), F.floor(F.col("ts") / width).alias("__b"))
    low, high = F.floor((F.col("ts") + w0) / width), F.floor((F.col("ts") + w1 - 1) / width)
    spread = left.select("node", "ts", F.explode(F.array_distinct(F.array(low, high))).alias("__b"))
    joined = spread.join(r, "__b").where((F.col("partner_ts") >= F.col("ts") + w0) & (F.col("partner_ts") < F.col("ts") + w1))
    return joined.drop("__b")


def successors(edges: DataFrame, within: int) -> DataFrame:
    """Pairs of edges that a walk may take one after the other: the second starts where the first ends, at its time or at most `within` later.

    Untimed edges may always be taken. Buckets of `within` on (node, time) keep hubs from meeting all their edges.
    """
    width = max(1, within)
    a = edges.select("event_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("timestamp_from").alias("t1"))
    b = edges.select(F.col("event_id").alias("next_id"), F.col("src").alias("b"), F.col("dst").alias("c"), F.col("timestamp_from").alias("t2"), F.floor(F.col("timestamp_from") / width).alias("__k"))
    low = F.floor(F.col("t1") / width)
    spread = a.withColumn("__k", F.explode(F.array(low, low + 1)))
    timed = spread.join(b, ["b", "__k"]).where("t2 >= t1 and t2 <= t1 + " + str(within) + " and next_id <> event_id").drop("__k")
    return timed


def infer_times(nodes: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(node, ts): an untimed node gets the smallest time of its edges, else of neighbours' edges, up to `hops` away."""
    known = edges.where(F.col("timestamp_from") != NONE)
    low = known.select(F.col("src").alias("node"), "timestamp_from").unionByName(known.select(F.col("dst").alias("node"), "timestamp_from"))
    now = low.groupBy("node").agg(F.min("timestamp_from").alias("ts"))
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other")))
    for _ in range(hops - 1):
        near = both.join(now.select(F.col("node").alias("other"), "ts"), "other").groupBy("node").agg(F.min("ts").alias("near"))
        now = now.join(near, "node", "full").select("node", F.coalesce("ts", "near").alias("ts"))
    own = nodes.select(F.col("id").alias("node"), F.col("timestamp_from").alias("own")).join(now, "node", "left")
    return own.select("node", F.when(F.col("own") != NONE, F.col("own")).otherwise(F.coalesce("ts", F.lit(NONE).cast("long"))).alias("ts"))
