"""The graph preprocessing pipeline and the evaluation of embeddings, as plain functions over frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import TemporalGraph, union
from loomgraph.operators import embeddings as E
from loomgraph.operators import metrics as M
from loomgraph.operators import temporal as T
from loomgraph.operators import transforms as X


@dataclass(frozen=True)
class Prepared:
    graph: TemporalGraph
    ranges: dict[str, tuple[int, int]]
    snapshots: list[tuple[int, int]]
    window: tuple[int, int]


def prepare(g: TemporalGraph, n_snapshots: int = 5, val: float = 0.1, test: float = 0.1, p: float = 0.95) -> Prepared:
    """Node split, edge split, reverse relations, normalised times, snapshots: in this order, so reverse edges keep the masks of theirs."""
    g = X.ensure_times(g)
    nodes = {t: X.split_masks(n, ["id"], val, test) for t, n in g.nodes.items()}
    g = g.with_nodes(nodes).map_edges(lambda _, e: X.split_masks(e, ["src", "dst", "timestamp_from"], val, test, "lp_"))
    g = X.to_undirected(g)
    bounds = T.graph_times(g)
    cut = X.time_bounds(bounds, p)
    if cut:
        even = lambda df: df.withColumn("timestamp_from", X.normalize_times(F.col("timestamp_from"), cut))
        g = TemporalGraph({t: even(n) for t, n in g.nodes.items()}, {k: even(e) for k, e in g.edges.items()})
    snaps = T.snapshots(T.graph_times(g), n_snapshots) if cut else []
    return Prepared(g, X.offsets(g.counts()), snaps, T.window_of({n_snapshots: snaps}) if snaps else (0, 1))


def snapshot_labels(prepared: Prepared) -> DataFrame:
    """(id, type, label) by global id."""
    n, e = X.to_homogeneous(prepared.graph, prepared.ranges)
    first = T.first_time(n, T.temporal_index(n, e))
    return first.select("id", "type", T.snapshot_of(F.col("first_ts"), prepared.snapshots).alias("label"))


def evaluate(edges: DataFrame, vectors: DataFrame, clusters: DataFrame, labels: DataFrame | None = None, pairs: DataFrame | None = None, most: int = 5000, prefix: str = "eval/test") -> DataFrame:
    """One (metric, value) frame: communities, clustering of at most `most` points, agreement with labels, link prediction.

    vectors: id, z. clusters: id, z as a number. labels: id, label. pairs: src, dst, label.
    """
    k = (clusters.agg(F.max("z")).first()[0] or 0) + 1
    frames = {f"{prefix}/ce": M.modularity(edges, clusters), f"{prefix}/cc": M.conductance(edges, clusters, int(k))}
    points = vectors.select("id", F.col("z").alias("embedding")).join(clusters.select("id", F.col("z").alias("label")), "id")
    few = X.subsample(points, most, "id").select(F.col("id").alias("vec_id"), "label", "embedding")
    frames |= {f"{prefix}/cl": M.davies_bouldin(few), f"{prefix}/cs": M.silhouette(few)}
    if labels is not None:
        both = clusters.join(labels, "id")
        frames |= {f"{prefix}/la": M.nmi_ari(both, "label", "z"), f"{prefix}/lu": M.purity(both, "label", "z")}
    if pairs is not None:
        frames |= {f"{prefix}/lp": E.link_prediction(pairs, vectors)}
    return M.tidy(**frames)


def combine_outputs(*frames: DataFrame) -> DataFrame:
    """(id, z): the mean of several outputs for a node, element by element."""
    return union(frames).groupBy("id").agg(M.vector_mean(F.col("z")).alias("z"))


@dataclass
class BurnIn:
    """Stops once a value has not got better for `patience` rounds."""

    patience: int = 3
    tol: float = 1e-4
    best: float = float("-inf")
    waited: int = 0

    def done(self, value: float) -> bool:
        if value > self.best + self.tol:
            self.best, self.waited = value, 0
        else:
            self.waited += 1
        return self.waited >= self.patience
