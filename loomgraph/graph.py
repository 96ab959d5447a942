"""The typed graph: ordered node and edge frames, read from and written to one table a type."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EdgeType = tuple[str, str, str]
#: Marks a missing time or node.
NONE = -1


@dataclass(frozen=True)
class TemporalGraph:
    """nodes: type -> (id, timestamp_from, ...); edges: (source, relation, target) -> (src, dst, timestamp_from, weight, ...).

    The order of types is part of the graph: it gives the offsets of global ids.
    """

    nodes: dict[str, DataFrame]
    edges: dict[EdgeType, DataFrame]

    def with_edges(self, edges: dict[EdgeType, DataFrame]) -> TemporalGraph:
        return replace(self, edges=edges)

    def with_nodes(self, nodes: dict[str, DataFrame]) -> TemporalGraph:
        return replace(self, nodes=nodes)

    def map_edges(self, f) -> TemporalGraph:
        return self.with_edges({k: f(k, e) for k, e in self.edges.items()})

    def all_edges(self, *columns: str) -> DataFrame:
        """Every edge with its relation and end types, one frame."""
        return union(
            e.select(F.lit(r).alias("rel"), F.lit(s).alias("src_type"), F.lit(d).alias("dst_type"), *columns) for (s, r, d), e in self.edges.items()
        )

    def all_nodes(self, *columns: str) -> DataFrame:
        return union(n.select(F.lit(t).alias("type"), *columns) for t, n in self.nodes.items())

    def counts(self) -> list[tuple[str, int]]:
        """(type, nodes) in order: one small row for each type."""
        found = {r["type"]: r["n"] for r in self.all_nodes("id").groupBy("type").agg(F.count("*").alias("n")).collect()}
        return [(t, found.get(t, 0)) for t in self.nodes]


def union(frames: Iterable[DataFrame]) -> DataFrame:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    if out is None:
        raise ValueError("no frames")
    return out


def edge_name(kind: EdgeType) -> str:
    return "edge__" + "_".join(kind)


def write_graph(graph: TemporalGraph, path: str) -> None:
    for t, n in graph.nodes.items():
        n.write.mode("overwrite").parquet(f"{path}/node__{t}")
    for kind, e in graph.edges.items():
        e.write.mode("overwrite").parquet(f"{path}/{edge_name(kind)}")


def read_graph(spark: SparkSession, path: str, names: Iterable[str] | None = None) -> TemporalGraph:
    """names: the tables in order; else what the folder lists, by name. Features (`feat_*`) become the array x."""
    if names is None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        names = sorted(s.getPath().getName() for s in fs.listStatus(where))
    nodes, edges = {}, {}
    for name in names:
        kind, _, rest = name.partition("__")
        df = spark.read.parquet(f"{path}/{name}")
        if kind == "node":
            nodes[rest] = node_columns(df)
        elif kind == "edge":
            s, *r, d = rest.split("_")
            edges[s, "_".join(r), d] = edge_columns(df)
    return TemporalGraph(nodes, edges)


def times(df: DataFrame) -> DataFrame:
    """timestamp_from and timestamp_to as whole seconds, -1 where missing; a column `timestamp` counts as timestamp_from."""
    kinds = dict(df.dtypes)
    if "timestamp" in kinds and "timestamp_from" not in kinds:
        df = df.withColumnRenamed("timestamp", "timestamp_from")
        kinds = dict(df.dtypes)
    for c in ("timestamp_from", "timestamp_to"):
        if c in kinds:
            seconds = F.unix_timestamp(F.col(c).cast("timestamp")) if "timestamp" in kinds[c] or kinds[c] == "date" else F.col(c).cast("long")
            df = df.withColumn(c, F.coalesce(seconds, F.lit(NONE).cast("long")))
    if "timestamp_from" in df.columns and "timestamp_to" not in df.columns:
        df = df.withColumn("timestamp_to", F.col("timestamp_from"))
    return df


def node_columns(df: DataFrame) -> DataFrame:
    feats = [c for c in df.columns if c.startswith("feat_")]
    if feats:
        df = df.withColumn("x", F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in feats])).drop(*feats)
    return times(df.withColumn("id", F.col("id").cast("long")))


def edge_columns(df: DataFrame) -> DataFrame:
    return times(df.withColumns({"src": F.col("src").cast("long"), "dst": F.col("dst").cast("long")}))


def validate(graph: TemporalGraph) -> list[str]:
    """What is wrong with the graph: ids that are not dense from zero, ends out of range. Two jobs, small results."""
    wrong = []
    size = {}
    for r in graph.all_nodes("id").groupBy("type").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).collect():
        size[r["type"]] = r["n"]
        if r["lo"] != 0 or r["hi"] != r["n"] - 1:
            wrong.append(f"{r['type']}: ids are not 0..{r['n'] - 1}")
    if graph.edges:
        ends = graph.all_edges("src", "dst").groupBy("rel", "src_type", "dst_type").agg(F.min(F.least("src", "dst")).alias("lo"), F.max("src").alias("s"), F.max("dst").alias("d"))
        for r in ends.collect():
            if r["lo"] < 0 or r["s"] >= size.get(r["src_type"], 0) or r["d"] >= size.get(r["dst_type"], 0):
                wrong.append(f"{r['rel']}: an end is out of range")
    return wrong
