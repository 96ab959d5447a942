"""Embeddings of nodes from walks, neighbourhood aggregates, and their evaluation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.hashing import md5_number
from loomgraph.functions.vectors import Metric, dot
from loomgraph.operators.metrics import classification, link_features, vector_mean


def seeded_vectors(nodes: DataFrame, dim: int, seed: int = 0) -> DataFrame:
    """(id, z): numbers in [-0.5, 0.5) / dim that depend on id, place and seed alone."""
    z = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: (F.conv(F.substring(F.md5(F.concat_ws("|", F.col("id").cast("string"), j.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / (1 << 32) - 0.5) / dim)
    return nodes.select("id", z.alias("z"))


def word2vec(walks: DataFrame, dim: int = 32, window: int = 5, seed: int = 1, rounds: int = 1, partitions: int = 1) -> DataFrame:
    """(id, z) by skip-gram over walks, with Spark's own trainer."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    said = walks.select(F.transform("walk", lambda x: x.cast("string")).alias("walk"))
    model = Word2Vec(vectorSize=dim, windowSize=window, seed=seed, maxIter=rounds, numPartitions=partitions, minCount=0, inputCol="walk", outputCol="o").fit(said)
    return model.getVectors().select(F.col("word").cast("long").alias("id"), vector_to_array("vector").alias("z"))


def mean_of_neighbours(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, z): the mean of the vectors of each node's in-neighbours; vectors are summed in the map tasks, so a hub sends one a task."""
    return edges.select("src", F.col("dst").alias("id")).join(vectors.select(F.col("id").alias("src"), "z"), "src").groupBy("id").agg(vector_mean(F.col("z")).alias("z"))


def encoded(df: DataFrame, text: str, encoder, name: str = "z") -> DataFrame:
    """df with a vector of each text from any encoder: a function of a list of texts to as many vectors, called a batch at a time; a null text has a null vector."""

    @F.pandas_udf("array<double>")
    def run(texts):
        import pandas as pd

        some = [t for t in texts if t is not None]
        found = iter(encoder(some) if some else [])
        return pd.Series([None if t is None else [float(x) for x in next(found)] for t in texts], dtype=object)

    return df.withColumn(name, run(F.col(text)))


def linear(z: Column, weight: list[list[float]], slope: float = 0.2) -> Column:
    """leaky-relu(W z) for a small weight matrix."""
    rows = [dot(z, F.array(*map(F.lit, w))) for w in weight]
    return F.transform(F.array(*rows), lambda x: F.when(x > 0, x).otherwise(slope * x))


def attention(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, z): neighbours' vectors weighted by the softmax, over each destination, of the leaky-relu of dot products."""
    a = vectors.select(F.col("id").alias("src"), F.col("z").alias("zs"))
    b = vectors.select(F.col("id").alias("dst"), F.col("z").alias("zd"))
    s = edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").withColumn("s", dot(F.col("zs"), F.col("zd")))
    s = s.withColumn("s", F.when(F.col("s") > 0, F.col("s")).otherwise(0.2 * F.col("s")))
    top = s.groupBy("dst").agg(F.max("s").alias("top"))
    e = s.join(top, "dst").withColumn("e", F.exp(F.col("s") - F.col("top")))
    return e.groupBy(F.col("dst").alias("id")).agg(vector_mean(F.col("zs"), F.col("e")).alias("z"))


def context_score(pairs: DataFrame, vectors: DataFrame, context: list[float]) -> DataFrame:
    """pairs with score: the sum of (p_s c)(p_d c) over places, c a weight of each place."""
    a = vectors.select(F.col("id").alias("src"), F.col("z").alias("za"))
    b = vectors.select(F.col("id").alias("dst"), F.col("z").alias("zb"))
    c = F.array(*map(F.lit, context))
    scaled = lambda v: F.zip_with(v, c, lambda x, w: x * w)
    return pairs.join(a, "src").join(b, "dst").withColumn("score", dot(scaled(F.col("za")), scaled(F.col("zb")))).drop("za", "zb")


def _logistic(train: DataFrame, test: DataFrame, columns: list[str], label: str) -> DataFrame:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    v = VectorAssembler(inputCols=columns, outputCol="__f")
    scaler = StandardScaler(inputCol="__f", outputCol="__s", withMean=True).fit(v.transform(train))
    ready = lambda df: scaler.transform(v.transform(df))
    model = LogisticRegression(featuresCol="__s", labelCol=label, predictionCol="predicted").fit(ready(train))
    return model.transform(ready(test)).select(label, F.col("predicted").cast("int").alias("predicted"))


def link_prediction(pairs: DataFrame, vectors: DataFrame, metric: Metric = Metric.L2, held_out: bool = False) -> DataFrame:
    """One row (accuracy, f1_micro, f1_macro) of a logistic regression on the pairs' distance, scored on its own pairs or on a fifth held out."""
    f = link_features(pairs, vectors, metric).withColumn("label", F.col("label").cast("int"))
    part = F.pmod(md5_number("src", "dst"), F.lit(5)) == 0
    return classification(_logistic(f.where(~part) if held_out else f, f.where(part) if held_out else f, ["feature"], "label"), "label", "predicted")


def node_classification(df: DataFrame, vector: str = "embedding", label: str = "label", held_out: bool = True, key: str = "vec_id") -> DataFrame:
    """One row of a logistic regression on standardised vectors."""
    dim = df.select(F.max(F.size(vector))).first()[0]
    wide = df.select(key, F.col(label).cast("int").alias(label), *[F.col(vector)[i].cast("double").alias(f"f{i}") for i in range(dim)])
    part = F.pmod(md5_number(key), F.lit(5)) == 0
    return classification(_logistic(wide.where(~part) if held_out else wide, wide.where(part) if held_out else wide, [f"f{i}" for i in range(dim)], label), label, "predicted")


def _nearest_rows(k: int):
    """Of a block of asked rows and a block of labelled ones: each asked row's k nearest (distances to nine places, ties to the smaller id)."""
    schema = pa.schema([("i", pa.int64()), ("d", pa.float64()), ("j", pa.int64()), ("label", pa.int64())])

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows or not known.num_rows:
            return schema.empty_table()
        j, label = np.array(known.column("j").to_pylist()), np.array(known.column("label").to_pylist())
        y = np.array(known.column("w").to_pylist(), float)
        rows = []
        for i, v in zip(asked.column("i").to_pylist(), np.array(asked.column("v").to_pylist(), float)):
            d = np.round(np.sqrt(((y - v) ** 2).sum(1)), 9)
            rows += [(i, float(d[x]), int(j[x]), int(label[x])) for x in np.lexsort((j, d))[:k]]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def nearest_labels(asked: DataFrame, known: DataFrame, k: int = 5, vector: str = "embedding", key: str = "vec_id", label: str = "label", block: int = 2000) -> DataFrame:
    """(key, predicted): the commonest label (ties: the smallest) of each asked row's k nearest labelled rows. Blocks of either side meet; a block gives k rows a query."""
    n, m = (max(1, -(-df.count() // block)) for df in (asked, known))
    a = asked.select(F.col(key).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"))
    a = a.withColumns({"__a": F.pmod(F.xxhash64("i"), F.lit(n)).cast("int"), "__b": F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})
    b = known.select(F.col(key).cast("long").alias("j"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("w"))
    b = b.withColumns({"__d": F.pmod(F.xxhash64("j"), F.lit(m)).cast("int"), "__c": F.explode(F.sequence(F.lit(0), F.lit(n - 1)))})
    met = a.groupBy("__a", "__b").cogroup(b.groupBy("__c", "__d")).applyInArrow(_nearest_rows(k), "i long, d double, j long, label long")
    near = met.withColumn("rn", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("rn") <= k)
    votes = near.groupBy("i", "label").agg(F.count("*").alias("n"))
    return votes.groupBy(F.col("i").alias(key)).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("predicted"))


def svm_classification(df: DataFrame, vector: str = "embedding", label: str = "label", key: str = "vec_id") -> DataFrame:
    """One row of scores of linear support vector machines, one against the rest, on a fifth held out."""
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.functions import array_to_vector

    data = df.select(F.col(label).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"), (F.pmod(md5_number(key), F.lit(5)) == 0).alias("part"))
    model = OneVsRest(classifier=LinearSVC(maxIter=20)).fit(data.where(~F.col("part")))
    said = model.transform(data.where("part")).select(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))
    return classification(said, "label", "predicted")


def edge_features(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs with f, the vectors of both ends one after the other."""
    a = vectors.select(F.col("id").alias("src"), F.col("z").alias("za"))
    b = vectors.select(F.col("id").alias("dst"), F.col("z").alias("zb"))
    return pairs.join(a, "src").join(b, "dst").withColumn("f", F.concat("za", "zb")).drop("za", "zb")


def repeated_kmeans(df: DataFrame, k: int, times: int = 10, vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row: agreement of k-means with the labels, the mean over so many seeds."""
    from loomgraph.graph import union
    from loomgraph.operators.clustering import kmeans
    from loomgraph.operators.metrics import nmi_ari, purity

    runs = [kmeans(df, k, vector, seed=s) for s in range(1, times + 1)]
    rows = union(nmi_ari(r, label, "z").crossJoin(purity(r, label, "z")) for r in runs)  # a row by a row
    return rows.agg(*[F.avg(c).alias(c) for c in ("nmi", "ari", "purity")])
