"""Measures of clusterings, communities and predictions, as small frames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.vectors import Metric, l2

EPS = 1e-4


def symmetric(edges: DataFrame) -> DataFrame:
    """Distinct edges with their reverses."""
    e = edges.select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def modularity(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: Newman-Girvan modularity of clusters (id, z) over distinct undirected edges; ends without cluster are left out."""
    e = symmetric(edges)
    z = clusters.select(F.col("id").alias("src"), F.col("z").alias("zs"))
    both = e.join(z, "src").join(z.select(F.col("src").alias("dst"), F.col("zs").alias("zd")), "dst")
    # every edge is there both ways, so a cluster's degree is twice the edges that start in it
    per = both.groupBy("zs").agg(F.sum(F.when(F.col("zs") == F.col("zd"), F.when(F.col("src") == F.col("dst"), 2).otherwise(1)).otherwise(0)).alias("inc"), (2 * F.count("*")).alias("deg"))
    total = per.agg((F.sum("deg") / 2).alias("m"))
    m = F.col("m").cast("double")
    return per.crossJoin(total).agg(F.sum(F.col("inc") / m - (F.col("deg") / (2 * m)) ** 2).alias("modularity"))  # a row a cluster with one row


def conductance(edges: DataFrame, clusters: DataFrame, k: int) -> DataFrame:
    """One row: mean over clusters 0..k-1 of out / (2 in + out + EPS); directed, repeated edges count, out at the source."""
    z = clusters.select(F.col("id").alias("src"), F.col("z").alias("zs"))
    both = edges.select("src", "dst").join(z, "src").join(z.select(F.col("src").alias("dst"), F.col("zs").alias("zd")), "dst")
    per = both.groupBy(F.col("zs").alias("z")).agg(F.sum((F.col("zs") == F.col("zd")).cast("long")).alias("inner"), F.sum((F.col("zs") != F.col("zd")).cast("long")).alias("outer"))
    all_ = edges.sparkSession.range(k).select(F.col("id").alias("z")).join(per, "z", "left").fillna(0, ["inner", "outer"])
    return all_.agg(F.avg(F.col("outer") / (2 * F.col("inner") + F.col("outer") + EPS)).alias("conductance"))


def contingency(df: DataFrame, true: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(true).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").cast("double").alias("n"))


def nmi_ari(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """One row (nmi, ari): mutual information over the mean of the entropies, and the adjusted Rand index. Sums over the table of counts."""
    c = contingency(df, true, predicted)
    rows, cols = c.groupBy("t").agg(F.sum("n").alias("a")), c.groupBy("p").agg(F.sum("n").alias("b"))
    n = c.agg(F.sum("n").alias("total"))
    half = lambda x: F.col(x) * (F.col(x) - 1) / 2
    joint = c.join(rows, "t").join(cols, "p").crossJoin(n).agg(
        F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("a") * F.col("b")))).alias("mi"), F.sum(half("n")).alias("both"), F.max("total").alias("total")
    )
    ent = lambda f, x, e, h: f.crossJoin(n).agg((-F.sum(F.col(x) / F.col("total") * F.log(F.col(x) / F.col("total")))).alias(e), F.sum(half(x)).alias(h))
    all_ = joint.crossJoin(ent(rows, "a", "ht", "ra")).crossJoin(ent(cols, "b", "hp", "rb"))
    expected = F.col("ra") * F.col("rb") / (F.col("total") * (F.col("total") - 1) / 2)
    top = (F.col("ra") + F.col("rb")) / 2
    mean = (F.col("ht") + F.col("hp")) / 2
    nmi = F.when(mean == 0, 1.0).otherwise(F.col("mi") / mean)
    ari = F.when(top == expected, 1.0).otherwise((F.col("both") - expected) / (top - expected))
    return all_.select(nmi.alias("nmi"), ari.alias("ari"))


def purity(df: DataFrame, true: str, predicted: str) -> DataFrame:
    c = contingency(df, true, predicted)
    return c.groupBy("p").agg(F.max("n").alias("top"), F.sum("n").alias("n")).agg((F.sum("top") / F.sum("n")).alias("purity"))


def vector_mean(vector: Column, weight: Column | None = None) -> Column:
    """An aggregate: the (weighted) element-wise mean of an array column, as an array. Partial on the map side, a vector a group and task."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = array_to_vector(vector.cast("array<double>"))
    return vector_to_array(Summarizer.mean(v) if weight is None else Summarizer.mean(v, weight))


def means(df: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, mean, n): element-wise means of vectors."""
    return df.groupBy(label).agg(vector_mean(F.col(vector)).alias("mean"), F.count("*").alias("n"))


def davies_bouldin(df: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """One row: mean over clusters of the worst (s_i + s_j) / d_ij; a zero distance of means counts as infinite. The second join is over clusters."""
    centre = means(df, label, vector)
    spread = df.join(centre, label).groupBy(label).agg(F.avg(l2(F.col(vector), F.col("mean"))).alias("s"))
    c = centre.join(spread, label).select(label, "mean", "s")
    other = c.select(F.col(label).alias("other"), F.col("mean").alias("mean2"), F.col("s").alias("s2"))
    pairs = c.join(other, F.col(label) != F.col("other"))
    d = l2(F.col("mean"), F.col("mean2"))
    worst = pairs.groupBy(label).agg(F.max(F.when(d > 0, (F.col("s") + F.col("s2")) / d).otherwise(0.0)).alias("r"))
    return worst.agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("davies_bouldin"))


def _far(metric: Metric):
    """Of a block of points and a block of others: each point's summed distance to every label, and how many."""
    schema = pa.schema([("i", pa.int64()), ("li", pa.int64()), ("lj", pa.int64()), ("d", pa.float64()), ("n", pa.int64())])

    def run(points: pa.Table, others: pa.Table) -> pa.Table:
        if not points.num_rows or not others.num_rows:
            return schema.empty_table()
        ids, labels, x = (points.column(c).to_pylist() for c in ("i", "l", "v"))
        jds, ls, y = (others.column(c).to_pylist() for c in ("j", "lo", "w"))
        x, y, jds, ls = np.array(x, float), np.array(y, float), np.array(jds), np.array(ls)
        rows = []
        for i, label, v in zip(ids, labels, x):
            gap = y - v
            if metric is Metric.L1:
                d = np.abs(gap).sum(1)
            elif metric is Metric.L2:
                d = np.sqrt((gap * gap).sum(1))
            else:
                dots = y @ v
                d = 1 - dots / (np.sqrt((y * y).sum(1)) * np.sqrt((v * v).sum())) if metric is Metric.COSINE else -dots
            away = jds != i
            for lj in np.unique(ls[away]).tolist():
                some = away & (ls == lj)
                rows.append((i, label, lj, float(d[some].sum()), int(some.sum())))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 5, schema.types)], schema=schema)

    return run


def silhouette(df: DataFrame, id_: str = "vec_id", label: str = "label", vector: str = "embedding", metric: Metric = Metric.L2, block: int = 2000) -> DataFrame:
    """One row: mean silhouette of all points, 0 with fewer than two labels; ids and labels are whole numbers.

    Every pair of points counts, so the work is quadratic (callers subsample large tables first): blocks of points
    meet blocks of points, and a meeting gives sums by point and label, never pairs.
    """
    rows = df.select(F.col(id_).cast("long").alias("i"), F.col(label).cast("long").alias("l"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-rows.count() // block))
    own, all_ = F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = rows.withColumns({"__a": own, "__b": all_})
    b = rows.withColumns({"__d": own, "__c": all_}).select(F.col("__c"), F.col("__d"), F.col("i").alias("j"), F.col("l").alias("lo"), F.col("v").alias("w"))
    met = a.groupBy("__a", "__b").cogroup(b.groupBy("__c", "__d")).applyInArrow(_far(metric), "i long, li long, lj long, d double, n long")
    per = met.groupBy("i", "li", "lj").agg((F.sum("d") / F.sum("n")).alias("d"))
    s = per.groupBy("i").agg(F.max(F.when(F.col("li") == F.col("lj"), F.col("d"))).alias("a"), F.min(F.when(F.col("li") != F.col("lj"), F.col("d"))).alias("b"))
    top = F.greatest("a", "b")
    value = F.when(F.col("a").isNull() | F.col("b").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top)
    return s.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("silhouette"))


def overlap(edges: DataFrame) -> DataFrame:
    """(a, b, common, jaccard, min_norm) of the ends' neighbour sets, for each distinct undirected edge a < b.

    Common neighbours come from paths a - n - b closed by the edge: the edge is joined to the smaller-degree
    end's neighbours first, so a hub is not expanded for each of its edges.
    """
    e = symmetric(edges.where("src <> dst"))
    deg = e.groupBy("src").agg(F.count("*").alias("deg"))
    ends = e.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    ends = ends.join(deg.select(F.col("src").alias("a"), F.col("deg").alias("da")), "a").join(deg.select(F.col("src").alias("b"), F.col("deg").alias("db")), "b")
    small, large = F.when(F.col("da") <= F.col("db"), F.col("a")).otherwise(F.col("b")), F.when(F.col("da") <= F.col("db"), F.col("b")).otherwise(F.col("a"))
    paths = ends.select("a", "b", small.alias("s"), large.alias("l")).join(e.select(F.col("src").alias("s"), F.col("dst").alias("n")), "s")
    closed = paths.join(e.select(F.col("src").alias("l"), F.col("dst").alias("n")), ["l", "n"], "left_semi").groupBy("a", "b").agg(F.count("*").alias("common"))
    full = ends.join(closed, ["a", "b"], "left").withColumn("common", F.coalesce("common", F.lit(0).cast("long")))
    return full.select("a", "b", "common", (F.col("common") / (F.col("da") + F.col("db") - F.col("common"))).alias("jaccard"), (F.col("common") / F.least("da", "db")).alias("min_norm"))


def hinge_loss(pairs: DataFrame, positive: str, negative: str, margin: float = 0.1) -> DataFrame:
    """One row: mean of relu(margin + negative - positive) over matched pairs of similarities."""
    return pairs.agg(F.avg(F.greatest(F.lit(0.0), F.lit(margin) + F.col(negative) - F.col(positive))).alias("hinge_loss"))


def skipgram_loss(pairs: DataFrame, positive: str, negative: str) -> DataFrame:
    """One row: mean of -log sigmoid(positive) - log sigmoid(-negative)."""
    return pairs.agg(F.avg(F.log1p(F.exp(-F.col(positive))) + F.log1p(F.exp(F.col(negative)))).alias("skipgram_loss"))


def isometric_loss(df: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """One row: mean distance of points to the mean of their cluster."""
    return df.join(means(df, label, vector), label).agg(F.avg(l2(F.col(vector), F.col("mean"))).alias("isometric_loss"))


def classification(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """One row (accuracy, f1_micro, f1_macro) from a table of true and predicted classes."""
    c = contingency(df, true, predicted)
    t = c.groupBy(F.col("t").alias("k")).agg(F.sum("n").alias("support"))
    p = c.groupBy(F.col("p").alias("k")).agg(F.sum("n").alias("said"))
    hit = c.where("t = p").select(F.col("t").alias("k"), F.col("n").alias("hit"))
    per = t.join(p, "k", "full").join(hit, "k", "left").fillna(0.0)
    f1 = 2 * F.col("hit") / (F.col("support") + F.col("said"))
    return per.agg((F.sum("hit") / F.sum("support")).alias("accuracy"), (2 * F.sum("hit") / (F.sum("support") + F.sum("said"))).alias("f1_micro"), F.avg(f1).alias("f1_macro"))


def link_features(pairs: DataFrame, vectors: DataFrame, metric: Metric = Metric.COSINE) -> DataFrame:
    """pairs (src, dst, label) with the distance of their ends' vectors (id, z)."""
    a = vectors.select(F.col("id").alias("src"), F.col("z").alias("za"))
    b = vectors.select(F.col("id").alias("dst"), F.col("z").alias("zb"))
    return pairs.join(a, "src").join(b, "dst").withColumn("feature", metric.distance(F.col("za"), F.col("zb"))).drop("za", "zb")


def tidy(**frames: DataFrame) -> DataFrame:
    """One (metric, value) frame of one-row frames; the key before a name is its prefix."""
    from loomgraph.graph import union

    return union(f.select(F.lit(f"{prefix}/{c}".lstrip("/")).alias("metric"), F.col(c).cast("double").alias("value")) for prefix, f in frames.items() for c in f.columns)


