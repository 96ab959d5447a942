"""Walks and neighbourhood samples whose choices depend on keys alone (md5 numbers), so any engine repeats them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.hashing import bucket, md5_number
from loomgraph.operators.blocks import least_pairs
from loomgraph.operators.storage import cut


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, nbr, pos, deg): distinct neighbours in order, numbered from 0."""
    e = edges.select(F.col("src").alias("node"), F.col("dst").alias("nbr")).distinct()
    w = Window.partitionBy("node").orderBy("nbr")
    return e.withColumn("pos", (F.row_number().over(w) - 1).cast("long")).withColumn("deg", F.count("*").over(Window.partitionBy("node")))


def starts(nodes: DataFrame, walks: int) -> DataFrame:
    """(walk_id, walk): `walks` walks from each node, walk_id = node * walks + number."""
    n = F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("w")
    return nodes.select("id", n).select((F.col("id") * walks + F.col("w")).alias("walk_id"), F.array("id").alias("walk"))


def walk(nodes: DataFrame, edges: DataFrame, steps: int, walks: int = 1, restart: float = 0.0) -> DataFrame:
    """(walk_id, walk): first-order uniform walks; a dead end stays where it is; with restart a step may return to the start.

    One equi-join a step on (node, place): the pick is a number before the join, so no fan-out meets a hub.
    """
    adj = cut(adjacency(edges))
    degree = adj.where("pos = 0").select(F.col("node").alias("at"), "deg")
    now = starts(nodes, walks)
    for step in range(1, steps + 1):
        at = now.withColumn("at", F.element_at("walk", -1)).join(degree, "at", "left")
        at = at.withColumn("pos", F.when(F.col("deg").isNotNull(), F.pmod(md5_number("walk_id", F.lit(step)), F.coalesce("deg", F.lit(1)))))
        picked = at.join(adj.select(F.col("node").alias("at"), "pos", "nbr"), ["at", "pos"], "left")
        nxt = F.coalesce("nbr", "at")
        if restart:
            nxt = F.when(bucket(1 << 20, "walk_id", F.lit(-step)) < int(restart * (1 << 20)), F.col("walk")[0]).otherwise(nxt)
        now = picked.select("walk_id", F.concat("walk", F.array(nxt)).alias("walk"))
    return now


def transition_weights(edges: DataFrame, p: float = 1.0, q: float = 0.5) -> DataFrame:
    """(prev, cur, next, weight) of second-order walks: 1 / p back, 1 to a neighbour of prev, 1 / q elsewhere."""
    e = edges.select("src", "dst").distinct()
    first = e.select(F.col("src").alias("prev"), F.col("dst").alias("cur"))
    second = e.select(F.col("src").alias("cur"), F.col("dst").alias("next"))
    near = e.select(F.col("src").alias("prev"), F.col("dst").alias("next"), F.lit(True).alias("near"))
    weight = F.when(F.col("next") == F.col("prev"), 1 / p).when(F.col("near"), 1.0).otherwise(1 / q)
    return first.join(second, "cur").join(near, ["prev", "next"], "left").select("prev", "cur", "next", weight.alias("weight"))


def pick(candidates: DataFrame, key: str, item: str, weight: Column, *salt: Column) -> DataFrame:
    """One weighted item for each key: the smallest -log(u) / weight over items, u from md5 of key, item and salt.

    The exponential race needs one aggregation with partial results, no sort and no running sum.
    """
    u = (md5_number(key, item, *salt) + 1) / F.lit(float((1 << 32) + 1))
    race = -F.log(u) / weight
    return candidates.where(weight > 0).groupBy(key).agg(F.min_by(item, F.struct(race, F.col(item))).alias(item))


def node2vec_walk(nodes: DataFrame, edges: DataFrame, steps: int, walks: int = 1, p: float = 1.0, q: float = 0.5) -> DataFrame:
    """(walk_id, walk): second-order walks by the exponential race over the candidates' weights."""
    e = cut(edges.select("src", "dst").distinct())
    out = F.struct(F.col("src").alias("cur"), F.col("dst").alias("next"))
    hop = e.select(out.alias("s")).select("s.*")
    near = e.select(F.col("src").alias("prev"), F.col("dst").alias("next"), F.lit(True).alias("near"))
    now = starts(nodes, walks)
    for step in range(1, steps + 1):
        at = now.select("walk_id", F.element_at("walk", -1).alias("cur"), F.when(F.size("walk") > 1, F.element_at("walk", -2)).alias("prev"))
        cand = at.join(hop, "cur").join(near, ["prev", "next"], "left")
        weight = F.when(F.col("prev").isNull(), 1.0).when(F.col("next") == F.col("prev"), 1 / p).when(F.col("near"), 1.0).otherwise(1 / q)
        chosen = pick(cand, "walk_id", "next", weight, F.lit(step))
        now = now.join(chosen, "walk_id", "left").select("walk_id", F.concat("walk", F.array(F.coalesce("next", F.element_at("walk", -1)))).alias("walk"))
    return now


def temporal_walk(seeds: DataFrame, edges: DataFrame, steps: int, within: int, bias: str = "uniform", forward: bool = True) -> DataFrame:
    """(walk_id, walk, times): walks whose next edge lies in [t, t + within) of the last time (before it when not forward).

    seeds: walk_id, node, ts (-1: any time). Untimed edges are always allowed. bias: uniform, linear or exponential
    preference for near times. A walk that finds no edge goes on from its root.
    """
    e = cut(edges.select(F.col("src").alias("at"), F.col("dst").alias("next"), F.col("timestamp_from").alias("et")))
    now = seeds.select("walk_id", F.array("node").alias("walk"), F.array("ts").alias("times"))
    for step in range(1, steps + 1):
        at = now.select("walk_id", F.element_at("walk", -1).alias("at"), F.element_at("times", -1).alias("t"))
        gap = (F.col("et") - F.col("t")) if forward else (F.col("t") - F.col("et"))
        cand = at.join(e, "at").where((F.col("et") == -1) | (F.col("t") == -1) | ((gap >= 0) & (gap < within)))
        share = F.when((F.col("et") == -1) | (F.col("t") == -1), 1.0)
        weight = {"uniform": F.lit(1.0), "linear": share.otherwise(1.0 - gap / (within + 1.0)), "exponential": share.otherwise(F.exp(-gap / F.lit(float(within))))}[bias]
        item = F.struct("next", "et")
        chosen = pick(cand.withColumn("item", item).withColumn("w", weight), "walk_id", "item", F.col("w"), F.lit(step))
        now = now.join(chosen, "walk_id", "left").select(
            "walk_id",
            F.concat("walk", F.array(F.coalesce("item.next", F.col("walk")[0]))).alias("walk"),
            F.concat("times", F.array(F.coalesce(F.when(F.col("item.et") == -1, F.element_at("times", -1)).otherwise(F.col("item.et")), F.col("times")[0]))).alias("times"),
        )
    return now


def contexts(walks: DataFrame, size: int) -> DataFrame:
    """(walk_id, pos, ctx): every stretch of `size` nodes of each walk."""
    at = F.sequence(F.lit(0), F.size("walk") - size)
    return walks.where(F.size("walk") >= size).select("walk_id", F.explode(F.transform(at, lambda j: F.struct(j.alias("pos"), F.slice("walk", j + 1, size).alias("ctx")))).alias("c")).select("walk_id", "c.pos", "c.ctx")


def end_pairs(walks: DataFrame, k: int) -> DataFrame:
    """(src, dst): first and last node of each context of k + 1 nodes."""
    return contexts(walks, k + 1).select(F.col("ctx")[0].alias("src"), F.element_at("ctx", -1).alias("dst"))


def skipgram_pairs(walks: DataFrame, window: int) -> DataFrame:
    """(centre, context) for all places at most `window` apart in a walk."""
    at = walks.select("walk_id", "walk", F.posexplode("walk").alias("i", "centre"))
    near = F.filter(F.sequence(F.greatest(F.col("i") - window, F.lit(0)), F.least(F.col("i") + window, F.size("walk") - 1)), lambda j: j != F.col("i"))
    return at.select("centre", F.explode(F.transform(near, lambda j: F.col("walk")[j])).alias("context"))


def negative_walks(walks: DataFrame, nodes: int, size: int) -> DataFrame:
    """(walk_id, ctx): each walk's head followed by size - 1 nodes drawn uniformly from 0..nodes-1."""
    rest = F.transform(F.sequence(F.lit(1), F.lit(size - 1)), lambda j: F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.col("walk_id").cast("string"), j.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(nodes)))
    return walks.select("walk_id", F.concat(F.array(F.col("walk")[0]), rest).alias("ctx"))


def neighbor_sample(seeds: DataFrame, edges: DataFrame, fanout: list[int]) -> DataFrame:
    """(hop, src, dst): for each hop at most fanout[hop] in-edges of each node reached, those of smallest md5 number."""
    e = edges.select("src", "dst").distinct()
    w = Window.partitionBy("dst").orderBy(md5_number("src", "dst"), "src")
    # the bound stands at the window, so each task keeps that many rows of a node before the shuffle, of a hub as well
    ranked = cut(e.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max(fanout, default=0)))
    frontier = seeds.select(F.col("id").alias("dst")).distinct()
    out = None
    for hop, k in enumerate(fanout):
        got = ranked.where(F.col("rn") <= k).join(frontier, "dst", "left_semi").select(F.lit(hop).alias("hop"), "src", "dst")
        out = got if out is None else out.unionByName(got)
        frontier = got.select(F.col("src").alias("dst")).distinct()
    return out


def budget_sample(candidates: DataFrame, budget: int) -> DataFrame:
    """(type, id): of each type the `budget` nodes that win the exponential race by their number of sampled neighbours."""
    n = candidates.groupBy("type", "id").agg(F.count("*").alias("n"))
    u = (md5_number("type", "id") + 1) / F.lit(float((1 << 32) + 1))
    w = Window.partitionBy("type").orderBy(-F.log(u) / F.col("n"), "id")
    return n.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= budget).select("type", "id")


def reach(edges: DataFrame, hops: int) -> DataFrame:
    """Distinct (src, dst) joined by a walk of exactly `hops` edges; distinct after each join keeps repeats from multiplying."""
    e = edges.select("src", "dst").distinct()
    now = e
    for _ in range(hops - 1):
        now = now.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
    return now


def metapath(*steps: DataFrame) -> DataFrame:
    """Distinct (src, dst) along typed relations, in order."""
    now = steps[0].select("src", "dst").distinct()
    for e in steps[1:]:
        now = now.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst").distinct(), "mid").select("src", "dst").distinct()
    return now


def negative_pairs(edges: DataFrame, src_nodes: int, dst_nodes: int, most: int = 5000) -> DataFrame:
    """(src, dst, label): at most `most` distinct edges, label 1, and for each the first of four keyed pairs that is no edge, label 0."""
    e = edges.select("src", "dst").distinct()
    pos = e.withColumn("h", md5_number("src", "dst")).orderBy("h", "src", "dst").limit(most).drop("h")
    return _with_negatives(pos, src_nodes, dst_nodes, lambda drawn: drawn.join(e, ["src", "dst"], "left_anti"))


def _with_negatives(pos: DataFrame, src_nodes: int, dst_nodes: int, free) -> DataFrame:
    """pos with label 1 and, label 0, for each the first of four keyed pairs that `free` leaves of them."""
    tries = pos.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.explode(F.array(*map(F.lit, range(4)))).alias("t"))
    cand = free(tries.select("a", "b", "t", bucket(src_nodes, "a", "b", "t", F.lit("s")).alias("src"), bucket(dst_nodes, "a", "b", "t", F.lit("d")).alias("dst")))
    neg = cand.groupBy("a", "b").agg(F.min_by(F.struct("src", "dst"), "t").alias("p")).select("p.src", "p.dst")
    return pos.withColumn("label", F.lit(1)).unionByName(neg.withColumn("label", F.lit(0)))


def near_pairs(edges: DataFrame, src_nodes: int, dst_nodes: int, most: int = 5000) -> DataFrame:
    """negative_pairs of the pairs within two hops (within_hops), which are all looked at but never written: a drawn pair is tested by its own two hops."""
    e = edges.select("src", "dst").distinct()

    def free(drawn: DataFrame) -> DataFrame:
        asked = cut(drawn)
        some = asked.select("src", "dst").where("src <> dst").distinct()
        two = some.join(e.select("src", F.col("dst").alias("mid")), "src").join(e.select(F.col("src").alias("mid"), "dst"), ["mid", "dst"]).select("src", "dst")
        taken = two.unionByName(some.join(e, ["src", "dst"])).distinct()
        return asked.join(taken, ["src", "dst"], "left_anti")

    return _with_negatives(cut(least_pairs(e, most)), src_nodes, dst_nodes, free)


def noise_table(frequencies: DataFrame, power: float = 0.75) -> DataFrame:
    """(id, p): unigram noise probabilities, n ** power over their sum."""
    f = frequencies.select("id", F.pow(F.col("n").cast("double"), F.lit(power)).alias("w"))
    return f.crossJoin(f.agg(F.sum("w").alias("s"))).select("id", (F.col("w") / F.col("s")).alias("p"))  # one row on the right


def keep_probability(frequencies: DataFrame, sample: float = 1e-3) -> DataFrame:
    """(id, keep): chance that an occurrence survives the downsampling of frequent nodes."""
    total = frequencies.agg(F.sum("n").cast("double").alias("s"))
    share = F.col("n") / (sample * F.col("s"))
    return frequencies.crossJoin(total).select("id", F.least(F.lit(1.0), (F.sqrt(share) + 1) / share).alias("keep"))


def hybrid_sample(walks: DataFrame, edges: DataFrame, fanout: list[int]) -> DataFrame:
    """(hop, src, dst): the neighbourhoods of all nodes that the walks visit, so that a walk's loss meets embeddings of sampled neighbours."""
    seeds = walks.select(F.explode("walk").alias("id")).distinct()
    return neighbor_sample(seeds, edges, fanout)


def within_hops(edges: DataFrame, hops: int) -> DataFrame:
    """Distinct (src, dst), src <> dst, joined by a walk of at most `hops` edges."""
    now = edges.select("src", "dst").distinct()
    found = now
    for _ in range(hops - 1):
        now = now.select("src", F.col("dst").alias("mid")).join(edges.select(F.col("src").alias("mid"), "dst").distinct(), "mid").select("src", "dst").distinct()
        found = found.unionByName(now)
    return found.where("src <> dst").distinct()


def batches(df: DataFrame, size: int, *keys: str, seed: int = 0, shuffle: bool = True) -> DataFrame:
    """df with place and batch: batches of `size` rows in the order of keys, or in an order shuffled by md5 of them. Chained loaders are the union of such frames."""
    from loomgraph.operators.relational import dense_ids

    order = df.withColumn("__h", md5_number(*keys, F.lit(seed)) if shuffle else F.lit(0).cast("long"))
    placed = dense_ids(order, "__h", *keys, name="place").drop("__h")
    return placed.withColumn("batch", F.expr(f"place div {int(size)}"))


def walk_weights(walks: DataFrame, weights: DataFrame) -> DataFrame:
    """(walk_id, pos, weight) of each step of each walk; weights: a < b, weight; steps without one weigh 0."""
    pairs = walks.select("walk_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("walk") - 1), lambda j: F.struct(j.alias("pos"), F.get("walk", j - 1).alias("x"), F.get("walk", j).alias("y")))).alias("s")).select("walk_id", "s.*")
    ends = pairs.select("walk_id", "pos", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return ends.join(weights, ["a", "b"], "left").select("walk_id", "pos", F.coalesce("weight", F.lit(0.0)).alias("weight"))
