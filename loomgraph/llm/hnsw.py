"""Nearest neighbours: a hierarchical navigable small-world graph for each shard.

Equal vectors are one node. Shards have a bounded number of nodes; a task builds
a shard's graph as flat neighbour arrays (a row of slots for each node and
layer) and searches it for a block of queries, and the shards' results are
merged by distance. Nodes are inserted and queries searched in batches that walk
the graph in step, so that a step is a few array operations for all of them.
Distances that are returned are computed in double precision on the original
vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import parts, table, written


@dataclass(frozen=True)
class Params:
    """shard bounds a graph's nodes on average and block the queries that a task searches it for; links, build and search are the graph's usual settings."""

    k: int = 10
    shard: int = 8192
    block: int = 16_384
    links: int = 16
    build: int = 64
    search: int = 192
    batch: int = 256
    step: int = 4
    queries_every: int = 100
    seed: int = 7


class Graph:
    """near[l][i]: the neighbours of node i on layer l, -1 where a slot is free. Layer 0 has twice the slots."""

    def __init__(self, vectors: np.ndarray, p: Params, stored: tuple[bytes, bytes, int] | None = None):
        with np.errstate(over="ignore"):  # what single precision cannot hold is far from everything, and the true distance is computed at the end
            self.x = np.nan_to_num(np.ascontiguousarray(vectors, np.float32), posinf=1e18, neginf=-1e18)
        self.half = np.einsum("ij,ij->i", self.x, self.x)
        self.p = p
        n = len(vectors)
        if stored:
            self._load(*stored)
            return
        rng = np.random.default_rng(p.seed)
        self.layer = np.minimum((-np.log(rng.random(n) + 1e-300) / np.log(p.links)).astype(int), 8)
        top = int(self.layer.max(initial=0))
        self.near = [np.full((n, p.links * 2 if k == 0 else p.links), -1, np.int32) for k in range(top + 1)]
        self.entry = 0
        done = min(1, n)
        while done < n:
            size = min(p.batch, max(1, done // 4), n - done)
            self._insert(np.arange(done, done + size))
            done += size

    def stored(self) -> tuple[bytes, bytes, int]:
        """The layers of the nodes, the neighbour arrays one after the other, and the entry: all that the vectors do not say."""
        return self.layer.astype("<i4").tobytes(), b"".join(x.astype("<i4").tobytes() for x in self.near), self.entry

    def _load(self, layer: bytes, near: bytes, entry: int) -> None:
        self.layer, self.entry = np.frombuffer(layer, "<i4"), entry
        n, links = len(self.layer), self.p.links
        flat = np.frombuffer(near, "<i4")
        self.near, at = [], 0
        while at < len(flat):
            wide = links if at else links * 2
            self.near.append(flat[at : at + n * wide].reshape(n, wide))
            at += n * wide

    def _far(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of each row of q to its row of ids; infinite for -1."""
        d = self.half[ids] - 2.0 * np.einsum("abd,ad->ab", self.x[ids], q) + np.einsum("ad,ad->a", q, q)[:, None]
        return np.where(ids < 0, np.float32(np.inf), np.maximum(d, 0))

    def _walk(self, q: np.ndarray, entry: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(distances, nodes) of the `width` nearest nodes that each row of q finds from its entries on a layer, nearest first."""
        near, rows, step = self.near[layer], len(q), min(self.p.step, width)
        ids = np.full((rows, width), -1, np.int64)
        ids[:, : entry.shape[1]] = entry[:, :width]
        d = self._far(q, ids)
        open_ = ids >= 0
        seen = np.zeros((rows, len(self.x) + 1), bool)  # the last column takes what -1 marks
        np.put_along_axis(seen, ids, True, 1)
        live = np.arange(rows)
        while True:
            ahead = np.where(open_[live], d[live], np.inf)
            pick = np.argpartition(ahead, step - 1, 1)[:, :step] if step < width else np.argsort(ahead, 1)
            far = np.take_along_axis(ahead, pick, 1)
            on = np.isfinite(far).any(1)
            if not on.all():
                live, pick, far = live[on], pick[on], far[on]
            if not len(live):
                break
            some = np.isfinite(far)
            took = open_[live]
            np.put_along_axis(took, pick, False, 1)
            open_[live] = took
            at = np.where(some, np.take_along_axis(ids[live], pick, 1), -1)
            new = np.where(at[:, :, None] < 0, -1, near[at]).reshape(len(live), -1).astype(np.int64)
            new[seen[live[:, None], new]] = -1
            # a node that two of the picked ones share counts once
            new.sort(1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new = np.sort(new, 1)[:, -max(1, int((new >= 0).sum(1).max(initial=1))) :]
            seen[live[:, None], new] = True
            both_d = np.concatenate([d[live], self._far(q[live], new)], 1)
            both_i = np.concatenate([ids[live], new], 1)
            both_o = np.concatenate([open_[live], new >= 0], 1)
            keep = np.argpartition(both_d, width - 1, 1)[:, :width]
            d[live], ids[live], open_[live] = (np.take_along_axis(x, keep, 1) for x in (both_d, both_i, both_o))
        order = np.argsort(d, 1, kind="stable")
        return np.take_along_axis(d, order, 1), np.take_along_axis(ids, order, 1)

    def _choose(self, d: np.ndarray, ids: np.ndarray, limit: int) -> np.ndarray:
        """Of each row's candidates (nearest first, -1 behind): those nearer to the node than to each other, then the nearest of the rest; -1 where none is left."""
        x = self.x[ids]
        between = self.half[ids][:, :, None] + self.half[ids][:, None, :] - 2.0 * np.matmul(x, x.transpose(0, 2, 1))
        blocked = ids < 0
        chosen = np.zeros(ids.shape, bool)
        count = np.zeros(len(ids), np.int64)
        for k in range(ids.shape[1]):
            take = ~blocked[:, k] & (count < limit)
            chosen[:, k] = take
            count += take
            blocked |= take[:, None] & (between[:, k] < d)
        rest = ~chosen & (ids >= 0)
        chosen |= rest & (np.cumsum(rest, 1) <= (limit - count)[:, None])
        first = np.argsort(~chosen, 1, kind="stable")[:, :limit]
        return np.where(np.take_along_axis(chosen, first, 1), np.take_along_axis(ids, first, 1), -1)

    def _insert(self, new: np.ndarray) -> None:
        q, own = self.x[new], self.layer[new]
        at = np.full((len(new), 1), self.entry)
        # the batch does not see itself in the graph: its own near ones are candidates beside what the walk finds
        inner = self.half[new][:, None] + self.half[new][None, :] - 2.0 * (q @ q.T)
        np.fill_diagonal(inner, np.inf)
        top = int(self.layer[self.entry])
        for layer in range(max(top, int(own.max())), -1, -1):
            deep = own >= layer
            if layer <= top:
                d, ids = self._walk(q, at, layer, self.p.build if deep.any() else 1)
                at = ids
            else:
                d, ids = np.full((len(new), 1), np.inf, np.float32), np.full((len(new), 1), -1)
            if not deep.any():
                at = at[:, :1]
                continue
            mine = np.where(deep[None, :], inner[deep], np.inf)
            some = np.argsort(mine, 1)[:, : self.p.links]
            inner_d = np.take_along_axis(mine, some, 1)
            all_d = np.concatenate([d[deep], inner_d], 1)
            all_i = np.concatenate([ids[deep], np.where(np.isfinite(inner_d), new[some], -1)], 1)
            order = np.argsort(all_d, 1, kind="stable")
            links = self._choose(np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1), self.p.links)
            self._link(np.repeat(new[deep], links.shape[1]), links.ravel(), layer)
        best = int(new[np.argmax(own)])
        if self.layer[best] > self.layer[self.entry]:
            self.entry = best

    def _link(self, a: np.ndarray, b: np.ndarray, layer: int) -> None:
        """Edges both ways; a node with more than its slots keeps the best spread ones."""
        a, b = a[b >= 0], b[b >= 0]
        if not len(a):
            return
        n, near = len(self.x), self.near[layer]
        room = near.shape[1]
        edges = np.unique(np.concatenate([a * n + b, b * n + a]))
        src, dst = edges // n, edges % n
        nodes, first, count = np.unique(src, return_index=True, return_counts=True)
        place = np.arange(len(src)) - np.repeat(first, count)
        held = (near[nodes] >= 0).sum(1)
        fits = held + count <= room
        ok = np.repeat(fits, count)
        near[src[ok], np.repeat(held, count)[ok] + place[ok]] = dst[ok]
        over = np.flatnonzero(~fits)
        for k in range(0, len(over), 1024):
            mine = over[k : k + 1024]
            wide = np.full((len(mine), room + int(count[mine].max())), -1, np.int64)
            wide[:, :room] = near[nodes[mine]]
            row = np.repeat(np.arange(len(mine)), count[mine])
            edge = np.concatenate([np.arange(first[m], first[m] + count[m]) for m in mine])
            wide[row, held[mine][row] + place[edge]] = dst[edge]
            d = self._far(self.x[nodes[mine]], wide)
            order = np.argsort(d, 1, kind="stable")[:, : room * 2]
            near[nodes[mine]] = self._choose(np.take_along_axis(d, order, 1), np.take_along_axis(wide, order, 1), room)

    def search(self, q: np.ndarray, width: int) -> np.ndarray:
        """For each row of q the nodes found, nearest first, -1 behind them."""
        q = q.astype(np.float32)
        out = np.empty((len(q), width), np.int64)
        for k in range(0, len(q), self.p.batch):
            some = q[k : k + self.p.batch]
            at = np.full((len(some), 1), self.entry)
            for layer in range(int(self.layer[self.entry]), 0, -1):
                at = self._walk(some, at, layer, 1)[1]
            out[k : k + self.p.batch] = self._walk(some, at, 0, width)[1]
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part: no null, zero or empty vector, no null or non-finite component."""
    e = F.col("embedding")
    ok = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & e.isNotNull()).where(ok).select(F.col("vec_id").cast("long"), e.cast("array<double>").alias("embedding"))


def _classes(k: int):
    """A task's different vectors, each with its k smallest ids."""
    schema = pa.schema([("embedding", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            held: dict[tuple, list[int]] = {}
            for i, v in zip(ids, batch.column(1).to_pylist()):
                held.setdefault(tuple(x + 0.0 for x in v), []).append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(v) for v in held], schema.types[0]), pa.array([sorted(set(x))[:k] for x in held.values()], schema.types[1])], schema=schema
            )

    return run


SHARD = "size int, shard int, vectors binary, ids array<array<long>>, layers binary, near binary, entry int"


def _builder(p: Params):
    """A shard's rows -> one row: its vectors, their ids and the graph over them as flat arrays."""

    def run(shard: pa.Table) -> pa.Table:
        ids = shard.column("ids").to_pylist()
        order = sorted(range(len(ids)), key=lambda k: ids[k][0])  # the graph does not depend on how rows arrive
        size = shard.column("size")[0].as_py()
        x = np.array(shard.column("embedding").combine_chunks().values, np.float64).reshape(-1, size)[order]
        layers, near, entry = Graph(x, p).stored()
        return pa.table(
            {
                "size": pa.array([size], pa.int32()),
                "shard": pa.array([shard.column("shard")[0].as_py()], pa.int32()),
                "vectors": pa.array([x.astype("<f8").tobytes()], pa.binary()),
                "ids": pa.array([[ids[k] for k in order]], pa.list_(pa.list_(pa.int64()))),
                "layers": pa.array([layers], pa.binary()),
                "near": pa.array([near], pa.binary()),
                "entry": pa.array([entry], pa.int32()),
            }
        )

    return run


def _searcher(p: Params):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(shard: pa.Table, queries: pa.Table) -> pa.Table:
        if not shard.num_rows or not queries.num_rows:
            return schema.empty_table()
        size, vectors, ids, layers, near, entry = (shard.column(c)[0].as_py() for c in ("size", "vectors", "ids", "layers", "near", "entry"))
        x = np.frombuffer(vectors, "<f8").reshape(-1, size)
        graph = Graph(x, p, (layers, near, entry))
        q = np.array(queries.column("embedding").combine_chunks().values, np.float64).reshape(-1, size)
        out: list[tuple[int, int, float]] = []
        for own, v, found in zip(queries.column("vec_id").to_pylist(), q, graph.search(q, max(p.search, p.k + 1))):
            found = found[found >= 0]
            d = np.sqrt(((x[found] - v) ** 2).sum(1))
            rows = sorted((e, i) for e, j in zip(d.tolist(), found.tolist()) for i in ids[j] if i != own)[: p.k]
            out += [(own, i, e) for e, i in rows]
        cols = zip(*out) if out else ((), (), ())
        return pa.table([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, p: Params = Params()) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k nearest rows of vectors, itself left out, nearest first.

    Rows with a null id, a null, empty or zero vector, or a null or non-finite
    component take no part. Vectors are searched among those of their own
    length. Equal vectors count each, ties go to the smaller vec_id, a repeated
    id counts once (of different vectors under one query id the smallest one
    asks); an empty table gives no rows; other columns are ignored.
    """
    distinct = usable(vectors).mapInArrow(_classes(p.k + 1), "embedding array<double>, ids array<long>").groupBy("embedding").agg(F.collect_list("ids").alias("ids"))
    # a vector's lists come one from each batch of rows, k + 1 ids each
    classes = written(distinct.select("embedding", F.size("embedding").alias("size"), F.slice(F.array_distinct(F.sort_array(F.flatten("ids"))), 1, p.k + 1).alias("ids")))
    # a length of vectors has as many shards as its nodes need
    shards = classes.groupBy("size").agg(F.ceil(F.count("*") / F.lit(p.shard)).cast("int").alias("shards"))
    dealt = classes.join(shards, "size").withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.col("shards")).cast("int"))
    # a number of partitions of our own, so that a shard is a task: Spark would put shards together by their bytes
    tasks = max(parts(vectors.sparkSession), int(shards.agg(F.sum("shards")).first()[0] or 0))
    graphs = written(dealt.repartition(tasks, "size", "shard").groupBy("size", "shard").applyInArrow(_builder(p), SHARD))
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = max(1, -(-asked.count() // p.block))
    asked = asked.withColumns({"size": F.size("embedding"), "block": F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")})
    sent = asked.join(shards, "size").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    each = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["size", "shard", "block"]
    each, sent = each.repartition(tasks * blocks, *key), sent.repartition(tasks * blocks, *key)
    found = each.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(_searcher(p), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    # an id with several vectors may be found more than once: its nearest one counts
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of embeddings for each one whose vec_id is divisible by 100; edge rows as in nearest()."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    p = Params()
    return nearest(vectors, vectors.where(F.col("vec_id") % p.queries_every == 0), p)
