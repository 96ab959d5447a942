"""Graph transforms: each takes a graph or its frames and gives new ones, lazily."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.hashing import md5_number
from loomgraph.graph import NONE, EdgeType, TemporalGraph, union
from loomgraph.operators.relational import dense_ids, quantiles

#: What edges that are merged may do with an attribute.
REDUCE = {"add": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "mul": F.product}


def reversed_edges(e: DataFrame) -> DataFrame:
    return e.withColumns({"src": F.col("dst"), "dst": F.col("src")})


def coalesce_edges(e: DataFrame, reduce: dict[str, str]) -> DataFrame:
    """One edge for each (src, dst), its attributes reduced as named."""
    return e.groupBy("src", "dst").agg(*[REDUCE[how](c).alias(c) for c, how in reduce.items()])


def to_undirected(g: TemporalGraph, merge: bool = True, reduce: dict[str, str] | None = None) -> TemporalGraph:
    """Edges between types, or all without merge, get a relation rev_<rel>; edges within a type get their reverse beside them."""
    out: dict[EdgeType, DataFrame] = {}
    for (s, r, d), e in g.edges.items():
        if s == d and merge:
            both = e.unionByName(reversed_edges(e))
            out[s, r, d] = coalesce_edges(both, reduce) if reduce else both
        else:
            out[s, r, d] = coalesce_edges(e, reduce) if reduce else e
            back = reversed_edges(e)
            out[d, f"rev_{r}", s] = coalesce_edges(back, reduce) if reduce else back
    return g.with_edges(out)


def sort_edges(e: DataFrame) -> DataFrame:
    return e.orderBy("src", "dst")


def ensure_times(g: TemporalGraph) -> TemporalGraph:
    none = F.lit(NONE).cast("long")

    def timed(df: DataFrame) -> DataFrame:
        return df if "timestamp_from" in df.columns else df.withColumn("timestamp_from", none)

    return TemporalGraph({t: timed(n) for t, n in g.nodes.items()}, {k: timed(e) for k, e in g.edges.items()})


def offsets(counts: list[tuple[str, int]]) -> dict[str, tuple[int, int]]:
    """Half-open ranges of global ids by type, in order."""
    out, lo = {}, 0
    for t, n in counts:
        out[t] = (lo, lo + n)
        lo += n
    return out


def to_homogeneous(g: TemporalGraph, ranges: dict[str, tuple[int, int]], node_attrs=("timestamp_from",), edge_attrs=("timestamp_from", "weight")) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with global ids and the attributes that every type has. A type's range is a literal in its own branch: no join is needed."""
    node_attrs = [c for c in node_attrs if all(c in n.columns for n in g.nodes.values())]
    edge_attrs = [c for c in edge_attrs if all(c in e.columns for e in g.edges.values())]
    nodes = union(n.select((F.col("id") + ranges[t][0]).alias("id"), F.lit(t).alias("type"), *node_attrs) for t, n in g.nodes.items())
    edges = union(
        e.select((F.col("src") + ranges[s][0]).alias("src"), (F.col("dst") + ranges[d][0]).alias("dst"), F.lit(r).alias("rel"), *edge_attrs)
        for (s, r, d), e in g.edges.items()
    )
    return nodes, edges


def homogenify(g: TemporalGraph, ranges: dict[str, tuple[int, int]], feature: str = "x") -> TemporalGraph:
    """One node type '0' and one relation '0'; features are padded with zeros to the widest."""
    widths = [n.select(F.max(F.size(feature))).first()[0] or 0 for n in g.nodes.values() if feature in n.columns]
    wide = max(widths, default=0)

    def padded(n: DataFrame) -> DataFrame:
        if not wide:
            return n
        x = F.coalesce(F.col(feature), F.array().cast("array<float>")) if feature in n.columns else F.array().cast("array<float>")
        return n.withColumn(feature, F.concat(x, F.array_repeat(F.lit(0.0).cast("float"), F.lit(wide) - F.size(x))))

    attrs = ("timestamp_from", feature) if wide else ("timestamp_from",)
    nodes, edges = to_homogeneous(g.with_nodes({t: padded(n) for t, n in g.nodes.items()}), ranges, attrs)
    return TemporalGraph({"0": nodes.drop("type")}, {("0", "0", "0"): edges.drop("rel")})


def type_of(ids: DataFrame, ranges: dict[str, tuple[int, int]], column: str = "gid") -> DataFrame:
    """Global ids with their type and local id. There are few types, so a chain of ranges serves as the range join."""
    kind: Column = F.lit(None).cast("string")
    low: Column = F.lit(None).cast("long")
    for t, (lo, hi) in ranges.items():
        inside = (F.col(column) >= lo) & (F.col(column) < hi)
        kind, low = F.when(inside, t).otherwise(kind), F.when(inside, lo).otherwise(low)
    return ids.withColumns({"type": kind, "id": (F.col(column) - low).cast("long")})


def split_masks(df: DataFrame, keys: list[str], val: float = 0.1, test: float = 0.1, prefix: str = "") -> DataFrame:
    """Disjoint train, val and test masks by the md5 number of keys: the share of each is as asked in expectation.

    A threshold on the number needs neither a sort nor a count, so the split is a projection at any size.
    """
    u = md5_number(*keys) / F.lit(float(1 << 32))
    test_, val_ = u < test, (u >= test) & (u < test + val)
    return df.withColumns({f"{prefix}test_mask": test_, f"{prefix}val_mask": val_, f"{prefix}train_mask": ~(test_ | val_)})


def edge_split_graphs(e: DataFrame, prefix: str = "lp_") -> dict[str, DataFrame]:
    """Message edges of each phase: training and validation pass messages on training edges, testing on both."""
    train, val = F.col(f"{prefix}train_mask"), F.col(f"{prefix}val_mask")
    return {"train": e.where(train), "val": e.where(train), "test": e.where(train | val)}


def phase_pairs(e: DataFrame, prefix: str = "lp_") -> DataFrame:
    """(phase, src, dst): the positive pairs that each phase learns from or is scored on."""
    phase = F.when(F.col(f"{prefix}train_mask"), "train").when(F.col(f"{prefix}val_mask"), "val").otherwise("test")
    return e.select(phase.alias("phase"), "src", "dst")


def with_labels(vectors: DataFrame, labels: DataFrame, missing: int = -1) -> DataFrame:
    """vectors (id, z) with their label, `missing` where there is none."""
    return vectors.join(labels.select("id", "label"), "id", "left").withColumn("label", F.coalesce("label", F.lit(missing)))


def edge_masks_of_nodes(e: DataFrame, src_nodes: DataFrame, dst_nodes: DataFrame, mask: str) -> DataFrame:
    """An edge is in a mask if one of its ends is."""
    s, d = src_nodes.select(F.col("id").alias("src"), F.col(mask).alias("__s")), dst_nodes.select(F.col("id").alias("dst"), F.col(mask).alias("__d"))
    return e.join(s, "src").join(d, "dst").withColumn(mask, F.col("__s") | F.col("__d")).drop("__s", "__d")


def inductive_nodes(n: DataFrame) -> DataFrame:
    """(phase, id, new_id): cumulative node sets train, val, test, renumbered with training nodes first.

    A node's place in the order of (set, id) is its number in every phase it is in, so one numbering serves all three.
    """
    rank = F.when(F.col("train_mask"), 0).when(F.col("val_mask"), 1).otherwise(2)
    placed = dense_ids(n.select("id", rank.alias("rank")), "rank", "id", name="new_id")
    phases = F.slice(F.array(*map(F.lit, ("train", "val", "test"))), F.col("rank") + 1, F.lit(3))
    return placed.select(F.explode(phases).alias("phase"), "id", "new_id")


def induced_edges(e: DataFrame, src: DataFrame, dst: DataFrame) -> DataFrame:
    """Edges of each phase both of whose ends are in it, with new ids; src and dst as inductive_nodes gives them."""
    a = src.select("phase", F.col("id").alias("src"), F.col("new_id").alias("new_src"))
    b = dst.select("phase", F.col("id").alias("dst"), F.col("new_id").alias("new_dst"))
    return e.join(a, "src").join(b, ["phase", "dst"])


def time_bounds(times: DataFrame, p: float = 0.95, column: str = "ts") -> tuple[int, int] | None:
    """The pooled quantiles that cut off (1 - p) / 2 on either side, truncated to whole numbers."""
    cut = (1 - p) / 2
    q = quantiles(times.where(F.col(column) != NONE), column, [cut, 1 - cut])
    return (int(q[0]), int(q[1])) if q else None


def normalize_times(c: Column, bounds: tuple[int, int]) -> Column:
    lo, hi = bounds
    return F.when(c == NONE, c).otherwise(F.least(F.greatest(c, F.lit(lo)), F.lit(hi)) - lo).cast("long")


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree) for every node, 0 where nothing points at it."""
    found = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def top_mask(df: DataFrame, column: str, ratio: float) -> DataFrame:
    """mask: column reaches the value that the given share of rows reaches; ties go over the share."""
    at = quantiles(df, column, [1 - ratio])
    return df.withColumn("mask", F.col(column) >= F.lit(at[0] if at else None))


def subsample(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most `most` rows, those with the smallest md5 number of keys: a distributed top-k."""
    return df.withColumn("__h", md5_number(*keys)).orderBy("__h", *keys).limit(most).drop("__h")


def subsample_by(df: DataFrame, group: str, most: int, *keys: str) -> DataFrame:
    """About `most` rows in all, shared among groups by their sizes; rows are numbered over all groups at once, so a large group is no task of its own."""
    placed = dense_ids(df.withColumn("__h", md5_number(*keys)), group, "__h", *keys, name="__at")
    sizes = placed.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    total = placed.count()
    keep = F.when(F.lit(total) <= most, F.col("__n")).otherwise(F.floor(F.col("__n") / F.lit(float(max(total, 1))) * most))
    joined = placed.join(sizes, F.col(group).eqNullSafe(F.col("__g")))
    return joined.where(F.col("__at") - F.col("__first") < keep).select(*df.columns)


def keep_columns(df: DataFrame, white: list[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c in set(white)])
