"""Layers and losses of the graph models, as expressions over frames; weights are small matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.hashing import bucket
from loomgraph.functions.vectors import Combine, dot, l2
from loomgraph.graph import EdgeType, union
from loomgraph.operators.embeddings import mean_of_neighbours
from loomgraph.operators.metrics import vector_mean

Matrix = list[list[float]]


def matvec(weight: Matrix, z: Column) -> Column:
    return F.array(*[dot(z, F.array(*map(F.lit, row))) for row in weight])


def leaky(z: Column, slope: float = 0.01) -> Column:
    return F.transform(z, lambda x: F.when(x > 0, x).otherwise(slope * x))


def seeded_matrix(rows: int, columns: int, seed: int) -> Matrix:
    """Uniform weights in the usual Xavier range."""
    top = float(np.sqrt(6.0 / (rows + columns)))
    return np.random.default_rng(seed).uniform(-top, top, (rows, columns)).tolist()


def sage_layer(relations: dict[EdgeType, DataFrame], x: dict[str, DataFrame], own: Matrix, other: Matrix, slope: float = 0.01) -> dict[str, DataFrame]:
    """(id, z) by type: for each relation own * z + other * mean of the in-neighbours, summed over a type's relations, then leaky-relu.

    A node without neighbours in a relation takes a zero mean; a type without relations is left out.
    """
    out = {}
    for t in {d for _, _, d in relations}:
        parts = []
        for (s, _, d), e in relations.items():
            if d == t:
                near = mean_of_neighbours(e, x[s])
                both = x[t].select("id", "z").join(near.withColumnRenamed("z", "m"), "id", "left")
                m = F.coalesce("m", F.array_repeat(F.lit(0.0), len(other[0])))
                parts.append(both.select("id", Combine.ADD.of(matvec(own, F.col("z")), matvec(other, m)).alias("z")))
        times = float(len(parts))  # every node is in each part: the mean times their number is the sum
        summed = union(parts).groupBy("id").agg(vector_mean(F.col("z")).alias("z"))
        out[t] = summed.select("id", leaky(F.transform("z", lambda v: v * times), slope).alias("z"))
    return out


def hgt_layer(relations: dict[EdgeType, DataFrame], x: dict[str, DataFrame], key: dict[str, Matrix], query: dict[str, Matrix], value: dict[str, Matrix], heads: int, prior: dict[EdgeType, float] | None = None, gate: Matrix | None = None) -> dict[str, DataFrame]:
    """(id, z) by type: attention with matrices for each node type and a prior for each relation, softmax over all in-edges of a node and head.

    With a gate (rows over message and own vector, one a place) the output is u * own + (1 - u) * message. Nodes without in-edges keep their vector.
    """
    out = {}
    for t in {d for _, _, d in relations}:
        scored = []
        for rel, e in relations.items():
            s, _, d = rel
            if d != t:
                continue
            a = x[s].select(F.col("id").alias("src"), matvec(key[s], F.col("z")).alias("k"), matvec(value[s], F.col("z")).alias("v"))
            b = x[d].select(F.col("id").alias("dst"), matvec(query[d], F.col("z")).alias("q"))
            width = len(key[s]) // heads
            part = lambda c, h, n=width: F.slice(c, h * n + 1, n)
            scale = (prior or {}).get(rel, 1.0) / float(np.sqrt(width))
            each = F.array(*[F.struct(F.lit(h).alias("h"), (dot(part(F.col("q"), h), part(F.col("k"), h)) * scale).alias("s"), part(F.col("v"), h).alias("v")) for h in range(heads)])
            scored.append(e.select("src", "dst").distinct().join(a, "src").join(b, "dst").select("dst", F.explode(each).alias("a")).select("dst", "a.*"))
        all_ = union(scored)
        top = all_.groupBy("dst", "h").agg(F.max("s").alias("top"))
        mean = all_.join(top, ["dst", "h"]).groupBy("dst", "h").agg(vector_mean(F.col("v"), F.exp(F.col("s") - F.col("top"))).alias("m"))
        message = mean.groupBy(F.col("dst").alias("id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("h", "m"))), lambda r: r["m"])).alias("m"))  # a row a head
        both = x[t].select("id", "z").join(message, "id", "left")
        new = F.col("m")
        if gate:
            u = F.transform(matvec(gate, F.concat("m", "z")), lambda g: 1 / (1 + F.exp(-g)))
            new = F.zip_with(F.zip_with(u, F.col("z"), lambda g, own: g * own), F.zip_with(u, F.col("m"), lambda g, m: (1 - g) * m), lambda p, q: p + q)
        out[t] = both.select("id", F.coalesce(F.when(F.col("m").isNotNull(), new), F.transform("z", lambda v: v.cast("double"))).alias("z"))
    return out


def hybrid_input(nodes: DataFrame, weight: Matrix, embedding: DataFrame, dropout: float = 0.0, seed: int = 0) -> DataFrame:
    """(id, z): a linear map of a node's features x where it has any, else its row of the embedding table; dropout zeroes places by md5 and scales the rest."""
    both = nodes.select("id", "x").join(embedding.select("id", F.col("z").alias("e")), "id", "left")
    z = F.coalesce(F.when(F.col("x").isNotNull(), matvec(weight, F.col("x"))), F.col("e"), F.array_repeat(F.lit(0.0), len(weight)))
    if dropout:
        keep = F.array(*[bucket(1 << 20, "id", F.lit(j), F.lit(seed)) >= int(dropout * (1 << 20)) for j in range(len(weight))])
        z = F.zip_with(z, keep, lambda v, k: F.when(k, v / (1 - dropout)).otherwise(0.0))
    return both.select("id", z.alias("z"))


def gelu(x: Column) -> Column:
    return 0.5 * x * (1 + F.tanh(float(np.sqrt(2 / np.pi)) * (x + 0.044715 * x * x * x)))


def head(z: Column, layers: list[Matrix]) -> Column:
    """A feed-forward head: each layer applies gelu and then its matrix."""
    for w in layers:
        z = matvec(w, F.transform(z, gelu))
    return z


def anneal(start: float, end: float, step: int, steps: int) -> float:
    """The cluster weight after so many of `steps` steps: from start to end on a logarithmic line."""
    return start * (end / start) ** (step / max(1, steps))


def cluster_loss(vectors: DataFrame, centres: list[list[float]], gamma: float) -> DataFrame:
    """One row: gamma times the mean distance of vectors to their nearest centre (one expression: the centres are few)."""
    near = F.array_min(F.array(*[l2(F.col("z"), F.array(*map(F.lit, c))) for c in centres]))
    return vectors.agg((gamma * F.avg(near)).alias("cluster_loss"))


def smoothness_loss(edges: DataFrame, vectors: DataFrame, weight: str = "weight") -> DataFrame:
    """One row: mean over weighted edges (a, b) of weight times the distance of their ends' vectors."""
    a = vectors.select(F.col("id").alias("a"), F.col("z").alias("za"))
    b = vectors.select(F.col("id").alias("b"), F.col("z").alias("zb"))
    return edges.join(a, "a").join(b, "b").agg(F.avg(F.col(weight) * l2(F.col("za"), F.col("zb"))).alias("smoothness_loss"))


def community_objective(points: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: minus the mean log density of points (z, v) under the diagonal Gaussian of their community; stats: z, mean, var."""
    both = points.join(stats.select("z", "mean", "var"), "z")
    each = F.aggregate(F.zip_with(F.zip_with("v", "mean", lambda x, m: (x - m) * (x - m)), "var", lambda g, s: g / s + F.log(s)), F.lit(0.0), lambda acc, x: acc + x)
    return both.agg(F.avg(0.5 * (each + F.size("v") * float(np.log(2 * np.pi)))).alias("community_objective"))


def context_path_loss(scores: DataFrame, weights: dict[int, float], summed: DataFrame | None = None) -> DataFrame:
    """One row: for each path length k the mean of -log sigmoid(score) (label 1) or -log sigmoid(-score) (label 0), weighted and summed; scores: k, score, label; summed: k, loss, n of pairs whose losses are added up already."""
    sign = F.when(F.col("label") == 1, -F.col("score")).otherwise(F.col("score"))
    per = scores.groupBy("k").agg(F.sum(F.log1p(F.exp(sign))).alias("loss"), F.count("score").alias("n"))
    if summed is not None:
        per = per.unionByName(summed.where("n > 0")).groupBy("k").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"))
    per = per.select("k", (F.col("loss") / F.col("n")).alias("loss"))
    pairs = [F.lit(x) for kv in weights.items() for x in kv]
    return per.agg(F.sum(F.coalesce(F.create_map(*pairs)[F.col("k")], F.lit(0.0)) * F.col("loss")).alias("context_path_loss"))
