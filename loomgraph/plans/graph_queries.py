"""Queries over the canonical graph: scans, transforms, times, measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.hashing import md5_number
from loomgraph.graph import union
from loomgraph.operators import metrics as M
from loomgraph.operators import temporal as T
from loomgraph.operators import transforms as X
from loomgraph.operators.relational import dense_ids
from loomgraph.plans.registry import EDGES_SQL, REGIONS_SQL, USERS_SQL, H, query
from loomgraph.sources.fixture import canonical, interactions, load, seconds


def homogeneous(spark: SparkSession, sf_dir: str):
    g = canonical(spark, sf_dir)
    ranges = X.offsets(g.counts())
    return g, ranges, *X.to_homogeneous(g, ranges)


def regions(spark: SparkSession, sf_dir: str, ranges) -> DataFrame:
    """(id, z): the region of each node that has one, by global id."""
    n = load(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("z"))
    c = load(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = {
        "Region": load(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_regionkey").cast("long").alias("z")),
        "Nation": n.select(F.col("n_nationkey").cast("long").alias("id"), "z"),
        "Supplier": load(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), "z"),
        "Customer": c.select(F.col("c_custkey").alias("id"), "z"),
        "Order": load(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), "z"),
    }
    return union(r.select((F.col("id") + ranges[t][0]).alias("id"), "z") for t, r in rows.items())


@query(f"WITH {EDGES_SQL} SELECT type, count(*) AS n, min(id) AS lo, max(id) AS hi, count(*) = max(id) - min(id) + 1 AS dense FROM nodes GROUP BY 1")
def graph_node_counts(spark, sf_dir):
    """Nodes of each type."""
    n = canonical(spark, sf_dir).all_nodes("id").groupBy("type").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    return n.withColumn("dense", F.col("n") == F.col("hi") - F.col("lo") + 1)


@query(f"WITH {EDGES_SQL} SELECT rel, st AS src_type, dt AS dst_type, count(*) AS n, max(src) AS max_src, max(dst) AS max_dst, min(ts) AS min_ts, round(sum(w), 2) AS weight FROM edges GROUP BY 1, 2, 3")
def graph_edge_counts(spark, sf_dir):
    """Edges of each relation."""
    e = canonical(spark, sf_dir).all_edges("src", "dst", "timestamp_from", "weight")
    return e.groupBy("rel", "src_type", "dst_type").agg(
        F.count("*").alias("n"), F.max("src").alias("max_src"), F.max("dst").alias("max_dst"), F.min("timestamp_from").alias("min_ts"), F.round(F.sum("weight"), 2).alias("weight")
    )


@query(f"WITH {EDGES_SQL} SELECT rel || '|' || flag AS rel, count(*) AS n, count(DISTINCT dst) AS targets FROM (SELECT 'CONTAINS' AS rel, l_returnflag AS flag, l_partkey AS dst FROM lineitem) GROUP BY 1")
def relations_by_type(spark, sf_dir):
    """One edge table as many relations, kept as a column."""
    li = load(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("CONTAINS|"), "l_returnflag").alias("rel"), F.col("l_partkey").alias("dst")).groupBy("rel").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("targets"))


@query(
    "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN -1 ELSE CAST(floor(epoch(o_orderdate)) AS BIGINT) END AS timestamp_from, "
    "CASE WHEN o_orderstatus = 'P' THEN -1 ELSE CAST(floor(epoch(o_orderdate)) AS BIGINT) END AS timestamp_to FROM orders"
)
def timestamp_coercion(spark, sf_dir):
    """Missing times become -1, the end defaults to the start."""
    from loomgraph.graph import times

    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("timestamp")).alias("timestamp_from"))
    return times(o)


@query(
    "SELECT p_partkey AS id, CAST(p_size > 25 AS INT) || ',' || CAST(p_retailprice > 1000 AS INT) || ',0' AS x FROM part"
)
def node_feature_vector(spark, sf_dir):
    """feat_ columns become one vector, nulls 0."""
    from loomgraph.graph import node_columns

    p = load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_size") > 25).alias("feat_large"), (F.col("p_retailprice") > 1000).alias("feat_dear"), F.lit(None).cast("boolean").alias("feat_none")
    )
    return node_columns(p).select("id", F.array_join(F.transform("x", lambda v: v.cast("int").cast("string")), ",").alias("x"))


@query(
    """SELECT c_custkey AS id, coalesce(list_min(cids), 0) AS y, len(cids) AS n FROM (
    SELECT c_custkey, list(DISTINCT CAST(hash % 14 AS BIGINT)) FILTER (hash IS NOT NULL) AS cids FROM customer LEFT JOIN (SELECT o_custkey, """
    + H.format("CAST(o_orderkey AS VARCHAR)")
    + """ AS hash FROM orders) ON c_custkey = o_custkey GROUP BY 1) WHERE cids IS NOT NULL"""
)
def community_labels(spark, sf_dir):
    """Community ids of a node as an array, the smallest as its label."""
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.pmod(md5_number("o_orderkey"), F.lit(14)).alias("cid"))
    c = o.groupBy("id").agg(F.array_sort(F.collect_set("cid")).alias("cids"))
    return c.select("id", F.coalesce(F.array_min("cids"), F.lit(0)).alias("y"), F.size("cids").cast("long").alias("n"))


@query(f"WITH {EDGES_SQL} SELECT type, min(gid) AS lo, max(gid) AS hi, count(*) AS n FROM gnodes GROUP BY 1")
def homogeneous_nodes(spark, sf_dir):
    """Nodes by global id."""
    _, _, nodes, _ = homogeneous(spark, sf_dir)
    return nodes.groupBy("type").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"))


@query(f"WITH {EDGES_SQL} SELECT rel, src, dst, ts, count(*) AS n FROM gedges GROUP BY ALL")
def homogeneous_edges(spark, sf_dir):
    """Edges by global ids."""
    _, _, _, e = homogeneous(spark, sf_dir)
    return e.groupBy("rel", "src", "dst", F.col("timestamp_from").alias("ts")).agg(F.count("*").alias("n"))


@query(f"WITH {EDGES_SQL} SELECT gid, type, gid - lo AS id FROM gnodes JOIN offs USING (type)")
def hetero_mapping_roundtrip(spark, sf_dir):
    """Global ids back to type and local id."""
    _, ranges, nodes, _ = homogeneous(spark, sf_dir)
    return X.type_of(nodes.select(F.col("id").alias("gid")), ranges).select("gid", "type", "id")


@query(
    f"WITH {EDGES_SQL} SELECT rel, count(*) AS n, CAST(sum(src) AS BIGINT) AS src_sum, CAST(sum(dst) AS BIGINT) AS dst_sum FROM (SELECT rel, src, dst FROM edges UNION ALL SELECT 'rev_' || rel, dst, src FROM edges) GROUP BY 1"
)
def to_undirected_rev(spark, sf_dir):
    """G1: a reverse relation beside each one between types."""
    g = X.to_undirected(canonical(spark, sf_dir))
    return g.all_edges("src", "dst").groupBy("rel").agg(F.count("*").alias("n"), F.sum("src").alias("src_sum"), F.sum("dst").alias("dst_sum"))


@query(f"WITH {USERS_SQL} SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM ue UNION ALL SELECT dst, src FROM ue) GROUP BY 1, 2")
def to_undirected_same_type(spark, sf_dir):
    """Reverse edges within a type, distinct."""
    e = interactions(spark, sf_dir)
    return e.select("src", "dst").unionByName(X.reversed_edges(e.select("src", "dst"))).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(
    "SELECT l_orderkey AS src, l_suppkey AS dst, round(sum(l_quantity), 4) AS add_w, round(avg(l_discount), 4) AS mean_d, min(l_tax) AS min_t, max(l_extendedprice) AS max_p, round(product(1 + l_discount), 6) AS mul_d FROM lineitem GROUP BY 1, 2"
)
def coalesce_multi_edges(spark, sf_dir):
    """One edge for each pair of ends, attributes reduced."""
    li = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("add_w"), F.col("l_discount").alias("mean_d"), F.col("l_tax").alias("min_t"), F.col("l_extendedprice").alias("max_p"), (1 + F.col("l_discount")).alias("mul_d")
    )
    out = X.coalesce_edges(li, {"add_w": "add", "mean_d": "mean", "min_t": "min", "max_p": "max", "mul_d": "mul"})
    return out.select("src", "dst", F.round("add_w", 4).alias("add_w"), F.round("mean_d", 4).alias("mean_d"), "min_t", "max_p", F.round("mul_d", 6).alias("mul_d"))


@query("SELECT l_orderkey AS src, l_partkey AS dst, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_linenumber) - 1 AS place FROM lineitem")
def sort_edges(spark, sf_dir):
    """All edges in (src, dst) order, each with its place in it."""
    li = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), "l_linenumber")
    return dense_ids(li, "src", "dst", "l_linenumber", name="place")


@query(f"WITH {EDGES_SQL} SELECT rel, st, count(*) AS n FROM edges WHERE ts = -1 GROUP BY 1, 2")
def untimed_edges(spark, sf_dir):
    """Edges without a time carry -1."""
    g = X.ensure_times(canonical(spark, sf_dir))
    return g.all_edges("timestamp_from").where("timestamp_from = -1").groupBy("rel", F.col("src_type").alias("st")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, count(l_partkey) AS degree FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def in_degree(spark, sf_dir):
    """Edges that point at each node."""
    g = canonical(spark, sf_dir)
    return X.in_degree(g.nodes["Part"], g.edges["Order", "CONTAINS", "Part"])


@query(f"WITH {EDGES_SQL}, e AS (SELECT src, dst FROM gedges UNION SELECT dst, src FROM gedges) SELECT src AS id, count(*) AS degree FROM e GROUP BY 1")
def undirected_degree(spark, sf_dir):
    """Edges at either end."""
    _, _, _, e = homogeneous(spark, sf_dir)
    return M.symmetric(e).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


_U = H.format("CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_partkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)") + " / 4294967296.0"


@query(
    f"SELECT l_linestatus AS status, count(*) FILTER (u < 0.1) AS test, count(*) FILTER (u >= 0.1 AND u < 0.2) AS val, count(*) FILTER (u >= 0.2) AS train FROM (SELECT l_linestatus, {_U} AS u FROM lineitem) GROUP BY 1"
)
def edge_split_masks(spark, sf_dir):
    """Sizes of the masks of an edge split."""
    li = load(spark, sf_dir, "lineitem")
    m = X.split_masks(li, ["l_orderkey", "l_partkey", "l_linenumber"], prefix="lp_")
    n = lambda c: F.sum(F.col(c).cast("long"))
    return m.groupBy(F.col("l_linestatus").alias("status")).agg(n("lp_test_mask").alias("test"), n("lp_val_mask").alias("val"), n("lp_train_mask").alias("train"))


@query(
    f"""WITH s AS (SELECT l_orderkey AS src, {_U} AS u FROM lineitem)
    SELECT 'train' AS phase, count(*) AS n, CAST(sum(src) AS BIGINT) AS s FROM s WHERE u >= 0.2 UNION ALL SELECT 'val', count(*), CAST(sum(src) AS BIGINT) FROM s WHERE u >= 0.2
    UNION ALL SELECT 'test', count(*), CAST(sum(src) AS BIGINT) FROM s WHERE u >= 0.1"""
)
def eval_edge_split_counts(spark, sf_dir):
    """Message edges of each phase."""
    li = load(spark, sf_dir, "lineitem").withColumn("src", F.col("l_orderkey"))
    m = X.split_masks(li, ["l_orderkey", "l_partkey", "l_linenumber"], prefix="lp_")
    return union(e.select(F.lit(p).alias("phase"), "src").groupBy("phase").agg(F.count("*").alias("n"), F.sum("src").alias("s")) for p, e in X.edge_split_graphs(m).items())


_UN = "({} / 4294967296.0)".format(H.format("CAST({} AS VARCHAR)"))
_NODES_SQL = f"""
c AS (SELECT c_custkey AS id, {_UN.format("c_custkey")} AS u FROM customer),
o AS (SELECT o_orderkey AS id, o_custkey AS c, {_UN.format("o_orderkey")} AS u FROM orders)
"""


@query(f"WITH {_NODES_SQL} SELECT count(*) AS n, count(*) FILTER (o.u < 0.1 OR c.u < 0.1) AS test, count(*) FILTER (o.u >= 0.2 OR c.u >= 0.2) AS train FROM o JOIN c ON o.c = c.id")
def node_split_edge_masks(spark, sf_dir):
    """An edge is in a mask if either end is."""
    g = canonical(spark, sf_dir)
    c, o = (X.split_masks(g.nodes[t], ["id"]) for t in ("Customer", "Order"))
    e = g.edges["Customer", "PLACED", "Order"]
    e = X.edge_masks_of_nodes(X.edge_masks_of_nodes(e, c, o, "test_mask"), c, o, "train_mask")
    n = lambda x: F.sum(F.col(x).cast("long"))
    return e.agg(F.count("*").alias("n"), n("test_mask").alias("test"), n("train_mask").alias("train"))


@query(
    f"""WITH {_NODES_SQL}, r AS (SELECT id, CASE WHEN u >= 0.2 THEN 0 WHEN u >= 0.1 THEN 1 ELSE 2 END AS k FROM c),
    ph AS (SELECT 'train' AS phase, * FROM r WHERE k <= 0 UNION ALL SELECT 'val', * FROM r WHERE k <= 1 UNION ALL SELECT 'test', * FROM r)
    SELECT phase, id, row_number() OVER (PARTITION BY phase ORDER BY k, id) - 1 AS new_id FROM ph"""
)
def inductive_node_split(spark, sf_dir):
    """Cumulative node sets, renumbered with training nodes first."""
    g = canonical(spark, sf_dir)
    return X.inductive_nodes(X.split_masks(g.nodes["Customer"], ["id"]))


@query(
    f"""WITH {_NODES_SQL}, k AS (SELECT 'train' AS phase, 0.2 AS low UNION ALL SELECT 'val', 0.1 UNION ALL SELECT 'test', 0.0)
    SELECT phase, count(*) AS n, CAST(sum(o.id) AS BIGINT) AS s FROM o JOIN c ON o.c = c.id, k WHERE o.u >= low AND c.u >= low GROUP BY 1"""
)
def inductive_edges(spark, sf_dir):
    """Edges with both ends in the phase."""
    g = canonical(spark, sf_dir)
    c, o = (X.inductive_nodes(X.split_masks(g.nodes[t], ["id"])) for t in ("Customer", "Order"))
    e = X.induced_edges(g.edges["Customer", "PLACED", "Order"], c, o)
    return e.groupBy("phase").agg(F.count("*").alias("n"), F.sum("dst").alias("s"))


@query(
    f"""WITH {EDGES_SQL}, t AS (SELECT ts FROM nodes UNION ALL SELECT ts FROM edges), q AS (SELECT CAST(trunc(quantile_cont(ts, 0.025)) AS BIGINT) AS lo, CAST(trunc(quantile_cont(ts, 0.975)) AS BIGINT) AS hi FROM t WHERE ts <> -1)
    SELECT id, CASE WHEN ts = -1 THEN -1 ELSE least(greatest(ts, lo), hi) - lo END AS ts FROM nodes, q WHERE type = 'Order'"""
)
def normalize_timestamps(spark, sf_dir):
    """Times cut at the pooled quantiles and shifted to zero."""
    g = canonical(spark, sf_dir)
    bounds = X.time_bounds(T.graph_times(g))
    return g.nodes["Order"].select("id", X.normalize_times(F.col("timestamp_from"), bounds).alias("ts"))


@query(f"WITH {EDGES_SQL}, t AS (SELECT gid AS node, ts FROM gnodes UNION SELECT src, ts FROM gedges UNION SELECT dst, ts FROM gedges) SELECT node, ts FROM t WHERE ts <> -1")
def temporal_node_index(spark, sf_dir):
    """Distinct times of every node."""
    _, _, n, e = homogeneous(spark, sf_dir)
    return T.temporal_index(n, e)


@query(
    f"""WITH {EDGES_SQL}, t AS (SELECT gid AS node, ts FROM gnodes UNION ALL SELECT src, ts FROM gedges UNION ALL SELECT dst, ts FROM gedges)
    SELECT gid AS id, type, coalesce(min(t.ts), -1) AS first_ts FROM gnodes LEFT JOIN (SELECT * FROM t WHERE ts <> -1) t ON t.node = gid GROUP BY 1, 2"""
)
def node_first_timestamp(spark, sf_dir):
    """The first time of every node."""
    _, _, n, e = homogeneous(spark, sf_dir)
    return T.first_time(n, T.temporal_index(n, e)).select("id", "type", "first_ts")


_SNAP_SQL = f"""{EDGES_SQL}, b AS (SELECT min(ts) AS lo, max(ts) + 1 AS hi FROM (SELECT ts FROM nodes UNION ALL SELECT ts FROM edges) WHERE ts <> -1),
snaps AS (SELECT CAST(i AS INT) AS i, CAST(floor(lo + i * ((hi - lo) / 5.0)) AS BIGINT) AS s, CAST(ceil(lo + (i + 1) * ((hi - lo) / 5.0)) AS BIGINT) AS e FROM b, range(5) r(i))"""


@query(f"WITH {_SNAP_SQL} SELECT i, s, e FROM snaps")
def define_snapshots(spark, sf_dir):
    """Five snapshots of equal width."""
    bounds = T.snapshots(T.graph_times(canonical(spark, sf_dir)), 5)
    return spark.createDataFrame([(i, s, e) for i, (s, e) in enumerate(bounds)], "i int, s long, e long")


@query(f"WITH {_SNAP_SQL} SELECT 0 AS w0, e - s AS w1 FROM snaps WHERE i = 0")
def infer_window(spark, sf_dir):
    """The window that the snapshots imply."""
    t = T.graph_times(canonical(spark, sf_dir))
    w0, w1 = T.window_of({n: T.snapshots(t, n) for n in (3, 5)})
    return spark.createDataFrame([(w0, w1)], "w0 int, w1 long")


@query(
    f"""WITH {_SNAP_SQL}, t AS (SELECT src AS node, ts FROM gedges UNION ALL SELECT dst, ts FROM gedges UNION ALL SELECT gid, ts FROM gnodes),
    f AS (SELECT gid, type, coalesce(min(t.ts), -1) AS ts FROM gnodes LEFT JOIN (SELECT * FROM t WHERE ts <> -1) t ON t.node = gid GROUP BY 1, 2),
    l AS (SELECT type, 1 + CAST(-1 < f.ts AS INT) + (SELECT count(*) FROM snaps WHERE s < f.ts) AS label FROM f)
    SELECT type, CAST(label AS BIGINT) AS label, count(*) AS n FROM l GROUP BY 1, 2"""
)
def snapshot_label_histogram(spark, sf_dir):
    """Nodes by type and snapshot label."""
    g, _, n, e = homogeneous(spark, sf_dir)
    bounds = T.snapshots(T.graph_times(g), 5)
    f = T.first_time(n, T.temporal_index(n, e))
    return f.groupBy("type", T.snapshot_of(F.col("first_ts"), bounds).alias("label")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {USERS_SQL}, t AS (SELECT DISTINCT src AS node, ts FROM ue) SELECT a.node, a.ts, count(*) AS partners FROM t a JOIN t b ON b.ts >= a.ts AND b.ts < a.ts + 600 AND b.node <> a.node GROUP BY 1, 2"""
)
def window_partner_counts(spark, sf_dir):
    """Nodes active in a window from each time."""
    t = interactions(spark, sf_dir).select(F.col("src").alias("node"), F.col("timestamp_from").alias("ts")).distinct()
    return T.window_partners(t, t, (0, 600)).where("node <> partner").groupBy("node", "ts").agg(F.count("*").alias("partners"))


@query(f"WITH {USERS_SQL} SELECT src AS node, count(DISTINCT ts) AS times, min(ts) AS first, max(ts) AS last FROM ue GROUP BY 1")
def node_to_timestamps(spark, sf_dir):
    """Times of each node."""
    e = interactions(spark, sf_dir)
    return e.groupBy(F.col("src").alias("node")).agg(F.countDistinct("timestamp_from").alias("times"), F.min("timestamp_from").alias("first"), F.max("timestamp_from").alias("last"))


@query(f"WITH {USERS_SQL} SELECT a.event_id, count(*) AS n FROM ue a JOIN ue b ON b.src = a.dst AND b.ts >= a.ts AND b.ts <= a.ts + 21600 AND b.event_id <> a.event_id GROUP BY 1")
def temporal_successors(spark, sf_dir):
    """Edges that a walk may take after each one."""
    return T.successors(interactions(spark, sf_dir), 21600).groupBy("event_id").agg(F.count("*").alias("n"))


@query(f"WITH {USERS_SQL} SELECT a.src, b.dst, count(*) AS n FROM ue a JOIN ue b ON b.src = a.dst AND b.ts >= a.ts AND b.ts <= a.ts + 3600 AND b.event_id <> a.event_id GROUP BY 1, 2")
def temporal_two_hop(spark, sf_dir):
    """Two steps in time."""
    s = T.successors(interactions(spark, sf_dir), 3600)
    return s.groupBy(F.col("a").alias("src"), F.col("c").alias("dst")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {EDGES_SQL}, d AS (SELECT src AS node, ts FROM gedges WHERE ts <> -1 UNION ALL SELECT dst, ts FROM gedges WHERE ts <> -1), h1 AS (SELECT node, min(ts) AS ts FROM d GROUP BY 1),
    nb AS (SELECT src AS node, dst AS other FROM gedges UNION ALL SELECT dst, src FROM gedges), h2 AS (SELECT nb.node, min(h1.ts) AS ts FROM nb JOIN h1 ON h1.node = nb.other GROUP BY 1)
    SELECT gid AS node, CASE WHEN g.ts <> -1 THEN g.ts ELSE coalesce(h1.ts, h2.ts, -1) END AS ts FROM gnodes g LEFT JOIN h1 ON h1.node = gid LEFT JOIN h2 ON h2.node = gid"""
)
def infer_missing_ts(spark, sf_dir):
    """Times of untimed nodes from their edges."""
    _, _, n, e = homogeneous(spark, sf_dir)
    return T.infer_times(n, e)


_MOD_SQL = f"""{EDGES_SQL}, {REGIONS_SQL}, e AS (SELECT src, dst FROM gedges UNION SELECT dst, src FROM gedges),
zz AS (SELECT src, dst, a.z AS zs, b.z AS zd FROM e JOIN z a ON a.gid = src JOIN z b ON b.gid = dst),
per AS (SELECT zs, CAST(sum(CASE WHEN zs = zd THEN CASE WHEN src = dst THEN 2 ELSE 1 END ELSE 0 END) AS DOUBLE) AS inc, CAST(2 * count(*) AS DOUBLE) AS deg FROM zz GROUP BY 1)"""


@query(f"WITH {_MOD_SQL} SELECT round(sum(inc / m - (deg / (2 * m)) ** 2), 6) AS modularity FROM per, (SELECT sum(deg) / 2 AS m FROM per)")
def modularity(spark, sf_dir):
    """Of the region partition."""
    _, ranges, _, e = homogeneous(spark, sf_dir)
    return M.modularity(e, regions(spark, sf_dir, ranges)).select(F.round("modularity", 6).alias("modularity"))


@query(
    f"""WITH {EDGES_SQL}, {REGIONS_SQL}, zz AS (SELECT a.z AS zs, b.z AS zd FROM gedges JOIN z a ON a.gid = src JOIN z b ON b.gid = dst),
    per AS (SELECT zs, count(*) FILTER (zs = zd) AS i, count(*) FILTER (zs <> zd) AS o FROM zz GROUP BY 1)
    SELECT round(avg(coalesce(o, 0) / (2 * coalesce(i, 0) + coalesce(o, 0) + 1e-4)), 6) AS conductance FROM range(5) r(k) LEFT JOIN per ON zs = k"""
)
def conductance(spark, sf_dir):
    """Of the region partition."""
    _, ranges, _, e = homogeneous(spark, sf_dir)
    return M.conductance(e, regions(spark, sf_dir, ranges), 5).select(F.round("conductance", 6).alias("conductance"))


@query(
    f"""WITH {_SNAP_SQL}, {REGIONS_SQL}, placed AS (SELECT e.src, e.dst, 1 + (SELECT count(*) FROM snaps WHERE s < e.ts) + CAST(-1 < e.ts AS INT) AS label FROM gedges e WHERE ts <> -1)
    SELECT CAST(label AS BIGINT) AS label, count(*) AS edges, count(DISTINCT src) AS sources, count(*) FILTER (a.z = b.z) AS inner_edges FROM placed LEFT JOIN z a ON a.gid = src LEFT JOIN z b ON b.gid = dst GROUP BY 1"""
)
def snapshot_communities(spark, sf_dir):
    """The flagship (G11, G12, E1): snapshots of the graph with their edges, sources and edges inside one region."""
    g, ranges, _, e = homogeneous(spark, sf_dir)
    bounds = T.snapshots(T.graph_times(g), 5)
    z = regions(spark, sf_dir, ranges)
    timed = e.where("timestamp_from <> -1").withColumn("label", T.snapshot_of(F.col("timestamp_from"), bounds))
    both = timed.join(z.select(F.col("id").alias("src"), F.col("z").alias("zs")), "src", "left").join(z.select(F.col("id").alias("dst"), F.col("z").alias("zd")), "dst", "left")
    return both.groupBy("label").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.sum(F.when(F.col("zs") == F.col("zd"), 1).otherwise(0)).cast("long").alias("inner_edges"))


@query("SELECT src AS a, dst AS b, count(*) AS n FROM (SELECT o_custkey AS src, c_nationkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1, 2")
def endpoint_gather(spark, sf_dir):
    """An attribute of an end brought to the edge."""
    g = canonical(spark, sf_dir)
    home = g.edges["Customer", "LIVESIN", "Nation"].select("src", F.col("dst").cast("int").alias("b"))
    return g.edges["Customer", "PLACED", "Order"].select("src").join(home, "src").groupBy(F.col("src").alias("a"), "b").agg(F.count("*").alias("n"))


@query(
    f"WITH {EDGES_SQL}, d AS (SELECT p_partkey AS id, count(l_partkey) AS degree FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1), q AS (SELECT quantile_cont(degree, 0.9) AS q FROM d) SELECT id, degree >= q AS mask FROM d, q"
)
def embed_mask(spark, sf_dir):
    """Nodes whose degree reaches the top tenth's."""
    return X.top_mask(in_degree(spark, sf_dir), "degree", 0.1).select("id", "mask")


@query("SELECT o_orderkey AS id FROM orders ORDER BY " + H.format("CAST(o_orderkey AS VARCHAR)") + ", o_orderkey LIMIT 500")
def subsample_nodes(spark, sf_dir):
    """At most so many rows, by hash order (a sampling operator)."""
    return X.subsample(canonical(spark, sf_dir).nodes["Order"].select("id"), 500, "id")


@query(
    "SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY "
    + H.format("CAST(vec_id AS VARCHAR)")
    + ", vec_id) AS rn, count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS t FROM embeddings) WHERE rn <= CASE WHEN t <= 100 THEN n ELSE floor(n / CAST(t AS DOUBLE) * 100) END"
)
def subsample_stratified(spark, sf_dir):
    """Shares of a sample by group."""
    e = load(spark, sf_dir, "embeddings").select("label", "vec_id")
    return X.subsample_by(e, "label", 100, "vec_id")


@query(f"WITH {EDGES_SQL} SELECT src, dst, min(ts) AS ts FROM gedges GROUP BY 1, 2")
def export_edges(spark, sf_dir):
    """The deduplicated edge list of an export."""
    _, _, _, e = homogeneous(spark, sf_dir)
    return e.groupBy("src", "dst").agg(F.min("timestamp_from").alias("ts"))


@query(f"WITH {EDGES_SQL} SELECT type, sum(CASE WHEN type = 'Order' THEN ts ELSE -1 END) AS s FROM (SELECT type, CAST(ts AS BIGINT) AS ts FROM nodes) GROUP BY 1")
def extract_attribute(spark, sf_dir):
    """An attribute of every type, -1 where a type lacks it."""
    g = canonical(spark, sf_dir)
    rows = union((n if t == "Order" else n.drop("timestamp_from").withColumn("timestamp_from", F.lit(-1).cast("long"))).select(F.lit(t).alias("type"), "timestamp_from") for t, n in g.nodes.items())
    return rows.groupBy("type").agg(F.sum("timestamp_from").cast("decimal(38,0)").alias("s"))


@query("SELECT CAST(floor(epoch(o_orderdate)) AS BIGINT) AS s, count(*) AS n FROM orders GROUP BY 1")
def epoch_seconds(spark, sf_dir):
    """F7."""
    return load(spark, sf_dir, "orders").groupBy(seconds("o_orderdate").alias("s")).agg(F.count("*").alias("n"))
