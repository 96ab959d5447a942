"""Queries of models: layers, losses, training, communities, evaluators, external results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loomgraph.functions.vectors import Combine
from loomgraph.operators import clustering as C
from loomgraph.operators import communities as L
from loomgraph.operators import embeddings as E
from loomgraph.operators import metrics as M
from loomgraph.operators import models as D
from loomgraph.operators import sampling as S
from loomgraph.operators import training as G
from loomgraph.operators import transforms as X2
from loomgraph.operators.blocks import two_step_loss, with_vectors
from loomgraph.operators.relational import dense_ids
from loomgraph.operators.storage import cut
from loomgraph.operators.temporal import window_partners
from loomgraph.plans.registry import EDGES_SQL, USERS_SQL, H, query
from loomgraph.plans.sampling_queries import _ADJ, _MEANS, _NEAR, _OVERLAP, _RANK, _STEP, _V, _negatives, users
from loomgraph.plans.source_queries import folder
from loomgraph.sources import formats as X
from loomgraph.sources.fixture import canonical, load

_SYM = f"{USERS_SQL}, e AS (SELECT src, dst, CAST(1 AS DOUBLE) AS w FROM ue WHERE src <> dst UNION SELECT dst, src, CAST(1 AS DOUBLE) FROM ue WHERE src <> dst)"
_MOVES = f"{_SYM}, k AS (SELECT src AS id, sum(w) AS k FROM e GROUP BY 1), m AS (SELECT sum(w) AS m FROM e), n0 AS (SELECT id, k, id AS label FROM k), " + ", ".join(
    f"t{i} AS (SELECT label, sum(k) AS tot FROM n{i - 1} GROUP BY 1), "
    f"c{i} AS (SELECT id, label, sum(w) AS inside FROM (SELECT e.src AS id, n.label, e.w FROM e JOIN n{i - 1} n ON n.id = e.dst UNION ALL SELECT id, label, 0 FROM n{i - 1}) GROUP BY 1, 2), "
    f"g{i} AS (SELECT c.id, n.k, n.label AS was, c.label, round(inside - n.k * (tot - CASE WHEN c.label = n.label THEN n.k ELSE 0 END) / m, 9) AS gain FROM c{i} c JOIN n{i - 1} n USING (id) JOIN t{i} t ON t.label = c.label, m), "
    f"b{i} AS (SELECT id, k, was, label, gain, max(gain) FILTER (label = was) OVER (PARTITION BY id) AS stay, row_number() OVER (PARTITION BY id ORDER BY gain DESC, label) AS rn FROM g{i}), "
    f"n{i} AS (SELECT id, k, CASE WHEN {H.format(f'CAST(id AS VARCHAR) || chr(124) || {chr(39)}{i - 1}{chr(39)}')} % 2 = 0 AND gain > stay THEN label ELSE was END AS label FROM b{i} WHERE rn = 1)"
    for i in (1, 2, 3)
)


@query(f"WITH {_MOVES} SELECT id, label FROM n3")
def louvain_moves(spark, sf_dir):
    """Three rounds of modularity moves."""
    _, e = users(spark, sf_dir)
    return L.local_moves(L.weighted(e), 3)


@query()
def louvain_labels(spark, sf_dir):
    """Louvain communities over all levels."""
    n, e = users(spark, sf_dir)
    return L.louvain(n, e)


_TWO = ([[0.5, -0.25, 0.125, 1.0], [0.25, 0.75, -0.5, 0.0]], [[1.0, 0.5, 0.0, -0.5], [-0.25, 0.125, 0.5, 0.25]])


def _small(spark, sf_dir, width: int = 4):
    """(id, z): the first places of the vectors, as input features of that width."""
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, width), lambda x: x.cast("double")).alias("z"))


def _row(weight, v: str) -> str:
    return " + ".join(f"({w}) * {v}[{j + 1}]" for j, w in enumerate(weight))


@query(
    f"""WITH {USERS_SQL}, v AS (SELECT vec_id AS id, {_V} AS v FROM embeddings), near AS (SELECT dst AS id, {", ".join(f"avg(v[{j}]) AS m{j}" for j in range(1, 5))} FROM ue JOIN v ON v.id = src GROUP BY 1),
    h AS (SELECT id, {", ".join("(" + _row(_TWO[0][i], "v") + ") + " + " + ".join(f"({w}) * coalesce(m{j + 1}, 0)" for j, w in enumerate(_TWO[1][i])) + f" AS h{i}" for i in range(2))} FROM v LEFT JOIN near USING (id))
    SELECT id, {", ".join(f"round(CASE WHEN h{i} > 0 THEN h{i} ELSE 0.01 * h{i} END, 6) AS z{i}" for i in range(2))} FROM h"""
)
def sage_layer(spark, sf_dir):
    """One layer over the interaction graph."""
    _, e = users(spark, sf_dir)
    out = D.sage_layer({("u", "to", "u"): e}, {"u": _small(spark, sf_dir)}, *map(list, _TWO))["u"]
    return out.select("id", *[F.round(F.col("z")[i], 6).alias(f"z{i}") for i in range(2)])


@query()
def hgt_layer(spark, sf_dir):
    """M6: typed attention with two heads and a gate over all relations of orders, customers and suppliers."""
    g = canonical(spark, sf_dir)
    types = ("Customer", "Order", "Supplier")
    x = {t: E.seeded_vectors(g.nodes[t], 4, seed) for seed, t in enumerate(types)}
    rel = {k: g.edges[k] for k in (("Customer", "PLACED", "Order"), ("Order", "SUPPLIEDBY", "Supplier"))}
    w = lambda s: {t: D.seeded_matrix(4, 4, s + i) for i, t in enumerate(types)}
    out = D.hgt_layer(rel, x, w(10), w(20), w(30), 2, gate=D.seeded_matrix(4, 8, 40))
    return out["Order"].select(F.lit("Order").alias("type"), "id", F.round(F.col("z")[0], 6).alias("first")).unionByName(out["Supplier"].select(F.lit("Supplier").alias("type"), "id", F.round(F.col("z")[0], 6).alias("first")))


@query(
    f"""WITH v AS (SELECT vec_id AS id, {_V} AS v FROM embeddings), c AS (SELECT c_custkey AS id, v FROM customer LEFT JOIN v ON v.id = c_custkey AND c_custkey % 2 = 0)
    SELECT id, {", ".join(f"round(CASE WHEN v IS NOT NULL THEN {_row(_TWO[0][i], 'v')} ELSE ({H.format(f'CAST(id AS VARCHAR) || chr(124) || {chr(39)}{i}|0{chr(39)}')} / CAST(4294967296 AS DOUBLE) - CAST(0.5 AS DOUBLE)) / 2 END, 6) AS z{i}" for i in range(2))} FROM c"""
)
def hybrid_input(spark, sf_dir):
    """M7: features through a linear map, an embedding table for customers without."""
    n = canonical(spark, sf_dir).nodes["Customer"].select("id")
    x = _small(spark, sf_dir).where("id % 2 = 0").select("id", F.col("z").alias("x"))
    out = D.hybrid_input(n.join(x, "id", "left"), list(_TWO[0]), E.seeded_vectors(n, 2))
    return out.select("id", *[F.round(F.col("z")[i], 6).alias(f"z{i}") for i in range(2)])


def _gelu(x: str) -> str:
    return f"(0.5 * {x} * (1 + (2 / (1 + exp(-2 * (sqrt(2 / pi()) * ({x} + 0.044715 * {x} * {x} * {x})))) - 1)))"


@query(f"SELECT vec_id, {', '.join('round(' + ' + '.join(f'({w}) * ' + _gelu(f'CAST(embedding[{j + 1}] AS DOUBLE)') for j, w in enumerate(_TWO[0][i])) + f', 6) AS y{i}' for i in range(2))} FROM embeddings")
def feed_forward_head(spark, sf_dir):
    """M8: gelu, then a matrix."""
    z = D.head(F.col("z"), [list(_TWO[0])])
    return _small(spark, sf_dir).select(F.col("id").alias("vec_id"), z.alias("y")).select("vec_id", *[F.round(F.col("y")[i], 6).alias(f"y{i}") for i in range(2)])


def _interaction_training(spark, sf_dir):
    # written once, since each reading of the interactions sorts all events by time
    e = cut(users(spark, sf_dir)[1].select("src", "dst", "timestamp_from"))
    n = cut(e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct())
    x = E.seeded_vectors(n, 8)
    f = cut(G.hop_features(e, x, 2))
    size = int(n.agg(F.max("id")).first()[0]) + 1
    return n, e, f, size


@query()
def graphsage_embed(spark, sf_dir):
    """M10, M12 (topological): a feature model trained on walk contexts."""
    n, e, f, size = _interaction_training(spark, sf_dir)
    rows = cut(G.triples(S.end_pairs(S.walk(n, e, 4), 2), f, size))
    fitted = G.fit(rows, G.Train(dim=4, epochs=5))
    return G.embed(f, fitted).select("id", F.size("z").alias("dim"))


@query()
def combi_embed(spark, sf_dir):
    """M12 (temporal), M13: shared features, a head on walk contexts and one on partners in time, concatenated."""
    n, e, f, size = _interaction_training(spark, sf_dir)
    topo = G.fit_pairs(S.end_pairs(S.walk(n, e, 4), 2), f, size, G.Train(dim=4, epochs=3))
    t = e.select(F.col("src").alias("node"), F.col("timestamp_from").alias("ts"))
    tempo = G.fit_near(t, (0, 600), f, size, G.Train(dim=4, epochs=3, objective="hinge"))
    out = G.combined(f, topo, tempo, Combine.CONCAT)
    return out.select("id", F.size("z").alias("dim"), *[F.round(F.col("z")[i], 6).alias(f"z{i}") for i in range(8)])


@query()
def end_to_end_communities(spark, sf_dir):
    """Training and clustering in turn, the cluster loss on."""
    n, e, f, size = _interaction_training(spark, sf_dir)
    rows = cut(G.triples(S.end_pairs(S.walk(n, e, 4), 2), f, size))

    def cluster(z):
        model = C.fit_dpmm(z, "z", C.Params(clusters=3, rounds=4))
        means = F.array(*[F.array(*map(F.lit, m)) for m in model.mean.tolist()])
        return C.assign(z.withColumnRenamed("z", "v"), model, "v").select("id", F.col("z").alias("c"), means[F.col("z")].alias("centre"))

    _, out = G.end_to_end(f, rows, G.Train(dim=3, epochs=3, cluster_weight=0.1), cluster)
    return out.select("id", "c")


@query(f"WITH {_MEANS}, c AS (SELECT label AS k, list(m ORDER BY i) AS c FROM m GROUP BY 1), d AS (SELECT vec_id, min(list_distance(v, c)) AS d FROM v, c GROUP BY 1) SELECT round(0.5 * avg(d), 6) AS cluster_loss FROM d")
def cluster_loss(spark, sf_dir):
    """The pull to the nearest centre."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    centres = [r["mean"] for r in M.means(e).orderBy("label").collect()]
    return D.cluster_loss(e.select(F.col("embedding").alias("z")), centres, 0.5).select(F.round("cluster_loss", 6).alias("cluster_loss"))


@query(f"WITH {USERS_SQL}, {_OVERLAP}, v AS (SELECT vec_id AS id, {_V} AS v FROM embeddings) SELECT round(avg(w * list_distance(x.v, y.v)), 6) AS smoothness_loss FROM ov JOIN v x ON x.id = a JOIN v y ON y.id = b")
def smoothness_loss(spark, sf_dir):
    """The smoothness term over overlap weights."""
    _, e = users(spark, sf_dir)
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("z"))
    return D.smoothness_loss(M.overlap(e).select("a", "b", F.col("jaccard").alias("weight")), v).select(F.round("smoothness_loss", 6).alias("smoothness_loss"))


@query(f"WITH {_MEANS}, p AS (SELECT vec_id, sum((x - m) ** 2 / var + ln(var) + ln(2 * pi())) / 2 AS l FROM f JOIN m USING (label, i) GROUP BY 1) SELECT round(avg(l), 5) AS community_objective FROM p")
def community_objective(spark, sf_dir):
    """Minus the mean log density under the communities' diagonal Gaussians."""
    e = load(spark, sf_dir, "embeddings").select(F.col("label").alias("z"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    s = e.groupBy("z").agg(M.vector_mean(F.col("v")).alias("mean"), M.vector_mean(F.transform("v", lambda x: x * x)).alias("square"))
    s = s.withColumn("var", F.zip_with("square", "mean", lambda q, m: q - m * m))
    return D.community_objective(e, s).select(F.round("community_objective", 5).alias("community_objective"))


@query(
    f"""WITH {USERS_SQL}, v AS (SELECT vec_id AS id, {_V} AS v FROM embeddings), e AS (SELECT DISTINCT src, dst FROM ue), two AS (SELECT DISTINCT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src),
    p AS (SELECT 1 AS k, src, dst, 1 AS label FROM e UNION ALL SELECT 2, src, dst, 1 FROM two UNION ALL SELECT 1, dst, src // 2, 0 FROM e),
    s AS (SELECT k, label, list_dot_product(a.v, b.v) AS s FROM p JOIN v a ON a.id = src JOIN v b ON b.id = dst), l AS (SELECT k, avg(ln(1 + exp(CASE WHEN label = 1 THEN -s ELSE s END))) AS l FROM s GROUP BY 1)
    SELECT round(sum(CASE WHEN k = 1 THEN 0.7 ELSE 0.3 END * l), 6) AS context_path_loss FROM l"""
)
def context_path_loss(spark, sf_dir):
    """Losses of context paths of one and two steps, weighted by length."""
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("z"))
    # written once, since each reading of the interactions sorts all events by time; an edge with no vector at an end is in no pair that has a score
    e = cut(with_vectors(users(spark, sf_dir)[1].select("src", "dst"), v).distinct())
    one = e.where("last")  # dst is an end of both pairs of an edge
    pairs = one.select(F.lit(1).alias("k"), "src", "dst", F.lit(1).alias("label"))
    pairs = pairs.unionByName(one.select(F.lit(1).alias("k"), F.col("dst").alias("src"), F.expr("src div 2").alias("dst"), F.lit(0).alias("label")))
    scored = E.context_score(pairs, v, [1.0] * 64)
    two = two_step_loss(e, v).select(F.lit(2).alias("k"), "loss", "n")
    return D.context_path_loss(scored, {1: 0.7, 2: 0.3}, two).select(F.round("context_path_loss", 6).alias("context_path_loss"))


_WALK1 = f"{_ADJ}, w0 AS (SELECT id AS walk_id, id AS cur, CAST(id AS VARCHAR) AS path FROM un), " + ", ".join(_STEP.format(i - 1, i) for i in (1, 2))


@query(
    f"WITH {_WALK1}, {_RANK}, s AS (SELECT DISTINCT CAST(unnest(string_split(path, ',')) AS BIGINT) AS id FROM w2), h0 AS (SELECT 0 AS hop, src, dst FROM r WHERE rn <= 2 AND dst IN (SELECT id FROM s)), "
    "h1 AS (SELECT 1 AS hop, src, dst FROM r WHERE rn <= 1 AND dst IN (SELECT src FROM h0)) SELECT * FROM h0 UNION ALL SELECT * FROM h1"
)
def hybrid_sample(spark, sf_dir):
    """The neighbourhoods of the nodes on walks."""
    n, e = users(spark, sf_dir)
    return S.hybrid_sample(S.walk(n, e, 2), e, [2, 1])


@query(
    f"""WITH {USERS_SQL}, t AS (SELECT DISTINCT src AS node, ts FROM ue), s AS (SELECT node, min(ts) AS ts FROM t GROUP BY 1), p AS (SELECT a.node, b.node AS partner, b.ts AS pts FROM s a JOIN t b ON b.ts >= a.ts AND b.ts < a.ts + 3600 AND b.node <> a.node),
    c AS (SELECT node, partner, row_number() OVER (PARTITION BY node ORDER BY -ln(({H.format("CAST(node AS VARCHAR) || chr(124) || chr(123) || CAST(partner AS VARCHAR) || chr(44) || chr(32) || CAST(pts AS VARCHAR) || chr(125)")} + 1) / CAST(4294967297 AS DOUBLE)), partner, pts) AS rn FROM p)
    SELECT s.node, coalesce(partner, s.node) AS partner FROM s LEFT JOIN c ON c.node = s.node AND rn = 1"""
)
def temporal_partners(spark, sf_dir):
    """A partner in the window of each node's first time, the node itself where there is none."""
    _, e = users(spark, sf_dir)
    t = e.select(F.col("src").alias("node"), F.col("timestamp_from").alias("ts")).distinct()
    seeds = t.groupBy("node").agg(F.min("ts").alias("ts"))
    pairs = window_partners(seeds, t, (0, 3600)).where("node <> partner")
    chosen = S.pick(pairs.withColumn("item", F.struct("partner", "partner_ts")), "node", "item", F.lit(1.0))
    return seeds.join(chosen, "node", "left").select("node", F.coalesce("item.partner", "node").alias("partner"))


@query(
    f"WITH e AS (SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey), b AS (SELECT src, dst + 1000000 AS dst FROM e UNION SELECT dst + 1000000, src FROM e), "
    "k AS (SELECT src, dst FROM b UNION SELECT x.src, y.dst FROM b x JOIN b y ON x.dst = y.src WHERE x.src <> y.dst), "
    f"{_negatives('k', 'k', '(SELECT count(*) FROM customer)', '(SELECT count(*) FROM customer)')} SELECT src, dst, 1 AS label FROM pos UNION ALL SELECT src, dst, 0 FROM ok WHERE rn = 1"
)
def khop_dataset(spark, sf_dir):
    """Pairs within two hops between customers and suppliers (the operator's sample of 5000) and drawn pairs that are not."""
    li, o = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    e = o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").cast("long").alias("src"), (F.col("l_suppkey") + 1000000).cast("long").alias("dst")).distinct()
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    size = load(spark, sf_dir, "customer").count()
    return S.near_pairs(both, size, size)


@query(f"SELECT o_orderkey, CAST((row_number() OVER (ORDER BY {H.format('CAST(o_orderkey AS VARCHAR) || chr(124) || chr(48)')}, o_orderkey) - 1) // 128 AS BIGINT) AS batch FROM orders")
def shuffled_batches(spark, sf_dir):
    """All orders in shuffled batches of 128."""
    return S.batches(load(spark, sf_dir, "orders").select("o_orderkey"), 128, "o_orderkey").select("o_orderkey", "batch")


@query("WITH n AS (SELECT 0 AS t, c_custkey AS id FROM customer UNION ALL SELECT 1, o_orderkey FROM orders) SELECT t, id, row_number() OVER (ORDER BY t, id) - 1 AS place FROM n")
def prediction_order(spark, sf_dir):
    """I8: the place of every node in the order of predictions, types one after the other."""
    c = load(spark, sf_dir, "customer").select(F.lit(0).alias("t"), F.col("c_custkey").alias("id"))
    o = load(spark, sf_dir, "orders").select(F.lit(1).alias("t"), F.col("o_orderkey").alias("id"))
    return dense_ids(c.unionByName(o), "t", "id", name="place")


_HELD = f"{H.format('CAST(vec_id AS VARCHAR)')} % 5 = 0"


@query(
    f"""WITH v AS (SELECT vec_id, label, {_V} AS v, {_HELD} AS held FROM embeddings), p AS (SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.v, b.v), 9), b.vec_id) AS rn FROM v a JOIN v b ON a.held AND NOT b.held),
    c AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, label) AS rn FROM p WHERE rn <= 5 GROUP BY 1, 2) SELECT vec_id, CAST(label AS BIGINT) AS predicted FROM c WHERE rn = 1"""
)
def nearest_labels(spark, sf_dir):
    """Nearest-neighbour classes of the held-out fifth."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    held = F.pmod(F.conv(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 8), 16, 10).cast("long"), F.lit(5)) == 0
    return E.nearest_labels(e.where(held), e.where(~held))


@query()
def svm_classification(spark, sf_dir):
    """E10."""
    return M.tidy(svm=E.svm_classification(load(spark, sf_dir, "embeddings")))


@query()
def repeated_kmeans(spark, sf_dir):
    """Agreement of k-means with the labels over seeds."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return M.tidy(kmeans=E.repeated_kmeans(e, 5, 3))


@query(f"SELECT CAST({H.format('CAST(vec_id AS VARCHAR) || chr(124) || chr(49)')} % 4 AS INT) AS z, count(*) AS n FROM embeddings GROUP BY 1")
def random_assignment(spark, sf_dir):
    """The random start."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return C.initial_assignment(e, 4, "random").groupBy("z").agg(F.count("*").alias("n"))


@query()
def kmeans_1d_start(spark, sf_dir):
    """Centres on the main axis, mapped back, and the assignment to them."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return C.initial_assignment(e, 4, "kmeans1d").select("vec_id", "z")


@query()
def mixture_density(spark, sf_dir):
    """Densities of all vectors under the best of two fits from a k-means start."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = C.fit_best(e, "embedding", C.Params(clusters=3, rounds=4), 2, mutate=False)
    return C.assign(e, model).select("vec_id", "z", F.round(F.array_max("r"), 6).alias("responsibility"))


@query(f"WITH {_NEAR}, {USERS_SQL.strip()}, z AS (SELECT vec_id AS id, k AS z FROM near WHERE rn = 1), s AS (SELECT src, dst FROM ue UNION SELECT dst, src FROM ue), b AS (SELECT src, dst, a.z AS zs, b.z AS zd FROM s JOIN z a ON a.id = src JOIN z b ON b.id = dst), "
    "p AS (SELECT zs, sum(CASE WHEN zs = zd THEN CASE WHEN src = dst THEN 2 ELSE 1 END ELSE 0 END) AS inc, 2 * count(*) AS deg FROM b GROUP BY 1), half AS (SELECT CAST(sum(deg) / 2 AS DOUBLE) AS h FROM p) SELECT round(sum(inc / h - (deg / (2 * h)) ** 2), 6) AS modularity FROM p, half"
)
def nearest_centre_modularity(spark, sf_dir):
    """Modularity of the assignment of nodes to their vectors' nearest centres."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    centres = [r["mean"] for r in M.means(e).orderBy("label").collect()]
    z = C.nearest(e, centres).select(F.col("vec_id").alias("id"), "z")
    return M.modularity(users(spark, sf_dir)[1], z).select(F.round("modularity", 6).alias("modularity"))


@query(f"SELECT vec_id AS id, label AS z, round(list_sum({_V}), 4) AS mass FROM embeddings")
def external_results(spark, sf_dir):
    """Embeddings and assignments of another system, from NumPy files."""
    rows = load(spark, sf_dir, "embeddings").orderBy("vec_id").select("vec_id", "label", "embedding").collect()  # the fixture of a foreign result: it is made in one process
    at = folder(spark)
    X.write_npy(spark, f"{at}/embeddings.npy", np.array([r["embedding"] for r in rows], np.float64))
    X.write_npy(spark, f"{at}/assignments.npy", np.array([r["label"] for r in rows], np.int64))
    ids = spark.createDataFrame([(i, r["vec_id"]) for i, r in enumerate(rows)], "place long, vec_id long")
    z, a, _ = X.external_results(spark, at)
    both = z.join(a.withColumnRenamed("z", "c"), "id").join(ids, F.col("id") == F.col("place"))
    return both.select(F.col("vec_id").alias("id"), F.col("c").cast("int").alias("z"), F.round(F.aggregate("z", F.lit(0.0), lambda s, x: s + x), 4).alias("mass"))


@query(f"SELECT vec_id AS id, round(list_sum(list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE))), 4) AS mass FROM embeddings")
def matrix_dump(spark, sf_dir):
    """A matrix written as CSV and read again."""
    at = folder(spark)
    X.write_matrix(_small(spark, sf_dir), at)
    return X.read_matrix(spark, at).select("id", F.round(F.aggregate("z", F.lit(0.0), lambda s, x: s + x), 4).alias("mass"))


@query(f"SELECT vec_id, round(v[1] / greatest(sqrt(list_dot_product(v, v)), 1e-8), 6) AS first, round(list_sum(v) * list_sum(v), 4) AS mass FROM (SELECT vec_id, {_V} AS v FROM embeddings)")
def numeric_helpers(spark, sf_dir):
    """F16: vectors over their length, and outer products."""
    from loomgraph.functions.vectors import normalised, outer, total

    z = F.col("embedding")
    e = load(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(normalised(z)[0], 6).alias("first"), F.round(total(outer(z, z)), 4).alias("mass"))


@query("SELECT n_nationkey AS id, CAST(length(n_name) AS DOUBLE) AS chars, CAST(length(n_name) - length(replace(n_name, 'A', '')) AS DOUBLE) AS a FROM nation")
def text_encoder(spark, sf_dir):
    """Vectors of names from an encoder that is passed in."""
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), "n_name")
    return E.encoded(n, "n_name", lambda texts: [(len(t), t.count("A")) for t in texts]).select("id", F.col("z")[0].alias("chars"), F.col("z")[1].alias("a"))


@query()
def embedding_plane(spark, sf_dir):
    """All vectors on two principal components."""
    e = load(spark, sf_dir, "embeddings")
    return C.plane(e, label="label").select("vec_id", "label", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query()
def training_log(spark, sf_dir):
    """The log of a training run, saved and read again."""
    n, e, f, size = _interaction_training(spark, sf_dir)
    fitted = G.fit(cut(G.triples(S.end_pairs(S.walk(n, e, 2), 1), f, size)), G.Train(dim=2, epochs=3))
    at = folder(spark)
    G.save(spark, at, fitted)
    return G.log(spark, G.load(spark, at)).select("epoch", F.round("loss", 6).alias("loss"), "rate")


@query(
    f"WITH {EDGES_SQL}, p AS (SELECT src, dst, {H.format('CAST(src AS VARCHAR) || chr(124) || CAST(dst AS VARCHAR) || chr(124) || CAST(ts AS VARCHAR)')} / CAST(4294967296 AS DOUBLE) AS u FROM edges WHERE rel = 'PLACED') "
    "SELECT CASE WHEN u < 0.1 THEN 'test' WHEN u < 0.2 THEN 'val' ELSE 'train' END AS phase, src, dst FROM p"
)
def phase_pairs(spark, sf_dir):
    """Link prediction pairs of each phase."""
    e = X2.split_masks(canonical(spark, sf_dir).edges["Customer", "PLACED", "Order"], ["src", "dst", "timestamp_from"], prefix="lp_")
    return X2.phase_pairs(e)


@query("SELECT e.vec_id AS id, CAST(coalesce(s.n_regionkey, -1) AS INT) AS label FROM embeddings e LEFT JOIN nation s ON e.vec_id = s.n_nationkey")
def labelled_vectors(spark, sf_dir):
    """Vectors with the labels of the nodes that have one."""
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("z"))
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").cast("int").alias("label"))
    return X2.with_labels(v, n).select("id", "label")


@query(f"WITH {USERS_SQL}, n AS (SELECT src AS id FROM ue UNION SELECT dst FROM ue), e AS (SELECT src, dst FROM ue WHERE src <> dst UNION SELECT dst, src FROM ue WHERE src <> dst) SELECT id, count(e.dst) AS degree FROM n LEFT JOIN e ON e.src = id GROUP BY 1")
def citation_graph(spark, sf_dir):
    """Frames as a graph of one type (the interactions stand in for a benchmark's citations)."""
    n, e = users(spark, sf_dir)
    g = X.citation_graph(n, e)
    d = X2.in_degree(g.nodes["Paper"], g.edges["Paper", "CITES", "Paper"])
    return d.select("id", "degree")


@query(f"WITH {_MEANS}, s AS (SELECT label, any_value(n) AS n, max(m) FILTER (i = 1) AS m FROM m GROUP BY 1) SELECT label, CAST(1 + n AS DOUBLE) AS kappa, CAST(66 + n AS DOUBLE) AS nu, round(n * m / (1 + n), 6) AS first FROM s")
def wishart_posterior(spark, sf_dir):
    """The normal-Wishart posterior of the labels' clusters; a row a cluster."""
    e = load(spark, sf_dir, "embeddings")
    rows = M.means(e).orderBy("label").collect()
    mean = np.array([r["mean"] for r in rows], float)
    d = mean.shape[1]
    stats = C.Stats(np.array([float(r["n"]) for r in rows]), mean, np.repeat(np.eye(d)[None], len(rows), 0))
    kappa, nu, mu, _ = C.WishartPrior(np.zeros(d), 1.0, 66.0, np.eye(d)).posterior(stats)
    return spark.createDataFrame([(r["label"], float(k), float(v), round(float(m[0]), 6)) for r, k, v, m in zip(rows, kappa, nu, mu)], "label int, kappa double, nu double, first double")


@query(f"WITH {USERS_SQL}, v AS (SELECT vec_id AS id, {_V} AS v FROM embeddings) SELECT event_id, len(list_concat(a.v, b.v)) AS width, round(list_sum(a.v) + list_sum(b.v), 4) AS mass FROM ue JOIN v a ON a.id = src JOIN v b ON b.id = dst")
def edge_features(spark, sf_dir):
    """Both ends' vectors as an edge's features."""
    _, e = users(spark, sf_dir)
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("z"))
    f = E.edge_features(e.select("event_id", "src", "dst"), v)
    return f.select("event_id", F.size("f").cast("long").alias("width"), F.round(F.aggregate("f", F.lit(0.0), lambda s, x: s + x), 4).alias("mass"))
