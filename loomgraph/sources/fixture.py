"""The star-schema tables as a typed temporal graph, and as a user interaction graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.graph import NONE, TemporalGraph

#: Fixed value: the order of node types, which gives the offsets of global ids.
NODE_TYPES = ("Customer", "Order", "Part", "Supplier", "Nation", "Region")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(c: str):
    """Whole seconds since 1970, rounded down."""
    return F.unix_timestamp(F.col(c).cast("timestamp"))


def canonical(spark: SparkSession, sf_dir: str) -> TemporalGraph:
    t = {n: load(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "part", "supplier", "nation", "region")}
    none = F.lit(NONE).cast("long")

    def node(df, key, ts=none):
        return df.select(F.col(key).cast("long").alias("id"), ts.alias("timestamp_from"))

    def edge(df, src, dst, ts=none, weight=None):
        w = F.lit(1.0) if weight is None else F.col(weight)
        return df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), ts.alias("timestamp_from"), w.alias("weight"))

    ship = seconds("l_shipdate")
    nodes = {
        "Customer": node(t["customer"], "c_custkey"),
        "Order": node(t["orders"], "o_orderkey", seconds("o_orderdate")),
        "Part": node(t["part"], "p_partkey"),
        "Supplier": node(t["supplier"], "s_suppkey"),
        "Nation": node(t["nation"], "n_nationkey"),
        "Region": node(t["region"], "r_regionkey"),
    }
    edges = {
        ("Customer", "PLACED", "Order"): edge(t["orders"], "o_custkey", "o_orderkey", seconds("o_orderdate"), "o_totalprice"),
        ("Order", "CONTAINS", "Part"): edge(t["lineitem"], "l_orderkey", "l_partkey", ship, "l_quantity"),
        ("Order", "SUPPLIEDBY", "Supplier"): edge(t["lineitem"], "l_orderkey", "l_suppkey", ship, "l_quantity"),
        ("Customer", "LIVESIN", "Nation"): edge(t["customer"], "c_custkey", "c_nationkey"),
        ("Supplier", "LIVESIN", "Nation"): edge(t["supplier"], "s_suppkey", "s_nationkey"),
        ("Nation", "ISIN", "Region"): edge(t["nation"], "n_nationkey", "n_regionkey"),
    }
    return TemporalGraph(nodes, edges)


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (event_id, src, dst, timestamp_from, weight) from each event's user to the next event's user.

    The next event is found inside equal slices of time and the first of the slice after, so no task sorts all
    events: slices of an hour, and for the last event of a slice the first event of the next slice that has any.
    """
    e = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    e = e.withColumn("slice", F.date_trunc("hour", "ts"))
    w = Window.partitionBy("slice").orderBy("ts", "event_id")
    inside = e.withColumn("next", F.lead("user_id").over(w))
    firsts = e.groupBy("slice").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"))
    order = Window.partitionBy(F.date_trunc("year", "slice")).orderBy("slice")
    ahead = firsts.withColumn("next_first", F.lead("first").over(order)).withColumn("year", F.date_trunc("year", "slice"))
    years = ahead.groupBy("year").agg(F.min_by("first", "slice").alias("year_first"))
    chain = years.withColumn("after", F.lead("year_first").over(Window.partitionBy(F.lit(0)).orderBy("year")))  # a row a year
    ahead = ahead.join(chain.select("year", "after"), "year").select("slice", F.coalesce("next_first", "after").alias("over"))
    joined = inside.join(ahead, "slice")
    dst = F.coalesce("next", "over")
    return joined.where(dst.isNotNull()).select("event_id", F.col("user_id").alias("src"), dst.alias("dst"), seconds("ts").alias("timestamp_from"), F.col("value").alias("weight"))
