"""Communities by label propagation and by Louvain moves, in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.hashing import bucket
from loomgraph.operators.metrics import symmetric
from loomgraph.operators.storage import cut


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 5, cut_every: int = 3) -> DataFrame:
    """(id, label): each round a node takes the commonest label of its neighbours, ties to the smallest; starts from its id.

    The count of (node, label) is a partial aggregation, so hubs do not gather their neighbours in one task.
    """
    e = cut(symmetric(edges.where("src <> dst")))
    now = nodes.select("id", F.col("id").alias("label"))
    for k in range(rounds):
        votes = e.join(now.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), F.col("label").alias("vote")).agg(F.count("*").alias("n"))
        best = votes.groupBy("id").agg(F.min_by("vote", F.struct(-F.col("n"), F.col("vote"))).alias("vote"))
        now = now.join(best, "id", "left").select("id", F.coalesce("vote", "label").alias("label"))
        if k % cut_every == cut_every - 1:
            now = cut(now)
    return now


def weighted(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges both ways with weight 1, loops left out."""
    return symmetric(edges.where("src <> dst")).withColumn("w", F.lit(1.0))


def local_moves(edges: DataFrame, rounds: int, cut_every: int = 1) -> DataFrame:
    """(id, label): every round half of the nodes (by md5, so neighbours do not swap for ever) move to the community of largest modularity gain.

    edges: src, dst, w, each both ways (a loop once, with twice its weight). A community is named by the node it
    started from; ties go to the smallest name, and a node moves only for a real gain. The links of a node to a
    community are partial sums, so neither a hub nor a large community gathers its edges in one task.
    """
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    two_m = float(edges.agg(F.sum("w")).first()[0] or 1.0)
    now = cut(degree.withColumn("label", F.col("id")))
    for r in range(rounds):
        total = now.groupBy("label").agg(F.sum("k").alias("tot"))
        links = edges.where("src <> dst").join(now.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.sum("w").alias("inside"))
        own = now.select("id", "label").withColumn("inside", F.lit(0.0))  # staying is always a choice
        choice = links.unionByName(own).groupBy("id", "label").agg(F.sum("inside").alias("inside"))
        known = choice.join(now.select("id", "k", F.col("label").alias("was")), "id").join(total, "label")
        gain = F.round(F.col("inside") - F.col("k") * (F.col("tot") - F.when(F.col("label") == F.col("was"), F.col("k")).otherwise(0.0)) / two_m, 9)
        best = known.withColumn("gain", gain).groupBy("id").agg(
            F.min_by("label", F.struct(-F.col("gain"), F.col("label"))).alias("best"), F.max("gain").alias("most"), F.max(F.when(F.col("label") == F.col("was"), F.col("gain"))).alias("stay")
        )
        moves = (bucket(2, "id", F.lit(r)) == 0) & (F.col("most") > F.col("stay"))
        now = now.join(best, "id").select("id", "k", F.when(moves, F.col("best")).otherwise(F.col("label")).alias("label"))
        if r % cut_every == cut_every - 1:
            now = cut(now)
    return now.select("id", "label")


def contract(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges between communities, weights summed; what lies inside one becomes its loop."""
    a = labels.select(F.col("id").alias("src"), F.col("label").alias("a"))
    b = labels.select(F.col("id").alias("dst"), F.col("label").alias("b"))
    return edges.join(a, "src").join(b, "dst").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))


def louvain(nodes: DataFrame, edges: DataFrame, rounds: int = 6, levels: int = 4) -> DataFrame:
    """(id, label) of every node: local moves, then the communities as nodes of a smaller graph, until none merge; nodes without edges stay alone."""
    now = cut(weighted(edges))
    found = None
    before = -1
    for _ in range(levels):
        moved = cut(local_moves(now, rounds))
        found = moved if found is None else cut(found.withColumnRenamed("label", "id2").join(moved.withColumnRenamed("id", "id2"), "id2").select("id", "label"))
        size = moved.select("label").distinct().count()
        if size == before or size == moved.count():
            break
        before = size
        now = cut(contract(now, moved))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
