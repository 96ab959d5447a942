"""Queries that write a table in a raw format to the shared folder and read it back through the engine's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomgraph.operators.storage import shared_dir
from loomgraph.plans.registry import query
from loomgraph.sources import formats as X
from loomgraph.sources.fixture import canonical, load


def folder(spark) -> str:
    return f"{shared_dir(spark)}/raw-{uuid.uuid4().hex}"


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_delimited(spark, sf_dir):
    """Three tabs between fields."""
    path = folder(spark)
    load(spark, sf_dir, "nation").select(F.concat_ws("\t\t\t", "n_nationkey", "n_name", "n_regionkey")).write.text(path)
    return X.delimited(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT c_custkey, c_name || ', \"the\" ' || c_mktsegment AS title FROM customer")
def scan_csv_quoted(spark, sf_dir):
    """Quotes, commas and a header."""
    path = folder(spark)
    c = load(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(', "the" '), "c_mktsegment").alias("title"))
    c.write.csv(path, header=True, quote='"', escape='"')
    return X.csv(spark, path, "c_custkey long, title string")


@query("SELECT n_nationkey, n_nationkey % 3 = 0 AS train, n_nationkey % 3 = 1 AS valid FROM nation")
def scan_provenance(spark, sf_dir):
    """The part of the split from the file's path."""
    path = folder(spark)
    n = load(spark, sf_dir, "nation").select("n_nationkey")
    for k, name in enumerate(("train", "valid", "test")):
        n.where(f"n_nationkey % 3 = {k}").write.parquet(f"{path}/{name}")
    raw = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return X.with_source(raw, {"train": "/train/", "valid": "/valid/"})


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def scan_json_nested(spark, sf_dir):
    """S4, F8."""
    path = folder(spark)
    load(spark, sf_dir, "events").select(F.struct(F.col("user_id").cast("string").alias("id_str")).alias("user"), F.array("event_type").alias("tags")).write.json(path)
    return X.json(spark, path, "user struct<id_str: string>, tags array<string>").select(F.col("user.id_str").cast("long").alias("user_id"), F.explode("tags")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS key, n_name AS value FROM nation")
def scan_text_dir(spark, sf_dir):
    """One folder a key, the key in the path."""
    path = folder(spark)
    load(spark, sf_dir, "nation").select("n_regionkey", F.col("n_name").alias("value")).write.partitionBy("n_regionkey").text(path)
    return X.keyed_lines(spark, f"{path}/*", r"n_regionkey=(\d+)/")


@query("SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS title FROM region")
def scan_xml(spark, sf_dir):
    """Rows by tag."""
    path = folder(spark)
    load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("title")).write.format("xml").option("rowTag", "page").option("rootTag", "pages").save(path)
    return X.xml(spark, path, "page", "id long, title string")


@query("SELECT 1 AS episode, 'mentions' AS kind, a.n_name AS src_name, b.n_name AS dst_name, CAST(a.n_regionkey AS DOUBLE) AS weight FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 1) % (SELECT count(*) FROM nation)")
def scan_linked_json(spark, sf_dir):
    """Links that name nodes by their place in the list."""
    path = folder(spark)
    n = load(spark, sf_dir, "nation")
    size = n.count()
    one = n.agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("all")).select(
        F.transform("all", lambda x: F.struct(x["n_name"].alias("name"))).alias("nodes"),
        F.transform("all", lambda x, i: F.struct(i.alias("source"), ((i + 1) % size).alias("target"), x["n_regionkey"].alias("value"))).alias("links"),
    )
    one.write.json(f"{path}/episode-1-mentions")
    return X.linked_json(spark, f"{path}/*")


@query("SELECT o_custkey AS src, o_orderkey AS dst FROM orders")
def scan_adjacency_list(spark, sf_dir):
    """S28."""
    path = folder(spark)
    a = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("d"))
    a.select(F.concat_ws(" ", F.col("o_custkey").cast("string"), "d")).union(spark.createDataFrame([("# note 1 2",)], "v string")).write.text(path)
    return X.adjacency_list(spark, path)


@query("SELECT o_custkey AS node, min(o_orderkey % 7) AS label FROM orders GROUP BY 1")
def scan_labels(spark, sf_dir):
    """S32."""
    path = folder(spark)
    load(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey") % 7).write.csv(path, sep="\t")
    return X.labels(spark, path)


@query("SELECT vec_id AS id, len(embedding) AS d, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS s FROM embeddings")
def embeddings_roundtrip(spark, sf_dir):
    """Vectors as text and back."""
    path = folder(spark)
    e = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("z"))
    X.write_embeddings(e, path)
    back = X.read_embeddings(spark, path)
    return back.select("id", F.size("z").cast("long").alias("d"), F.round(F.aggregate("z", F.lit(0.0), lambda a, x: a + x), 4).alias("s"))


@query("SELECT 'Customer_PLACED_Order' AS name, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders UNION ALL SELECT 'Nation_ISIN_Region', count(*), CAST(sum(n_regionkey) AS BIGINT) FROM nation")
def graph_roundtrip(spark, sf_dir):
    """A graph written as typed tables and read back."""
    from loomgraph.graph import TemporalGraph, read_graph, write_graph

    g = canonical(spark, sf_dir)
    keep = {k: e for k, e in g.edges.items() if k[1] in ("PLACED", "ISIN")}
    path = folder(spark)
    write_graph(TemporalGraph({t: g.nodes[t] for t in ("Customer", "Order", "Nation", "Region")}, keep), path)
    back = read_graph(spark, path)
    return back.all_edges("dst").groupBy(F.concat_ws("_", "src_type", "rel", "dst_type").alias("name")).agg(F.count("*").alias("n"), F.sum("dst").alias("s"))


@query("SELECT 'CONTAINS' AS rel, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS s FROM lineitem UNION ALL SELECT 'rev_CONTAINS', count(*), CAST(sum(l_partkey) AS BIGINT) FROM lineitem")
def matrix_relations(spark, sf_dir):
    """A bipartite matrix's cells as a relation and its transpose."""
    from loomgraph.graph import union

    cells = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"))
    rows = X.matrix_edges(cells, "CONTAINS", "Order", "Part")
    return union(e.select(F.lit(r).alias("rel"), "src") for (_, r, _), e in rows.items()).groupBy("rel").agg(F.count("*").alias("n"), F.sum("src").alias("s"))
