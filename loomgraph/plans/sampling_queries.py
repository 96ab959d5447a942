"""Queries of walks, samples, vectors, clusterings and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.vectors import Combine, Metric, cosine, dot, l1, l2
from loomgraph.operators import clustering as C
from loomgraph.operators import embeddings as E
from loomgraph.operators import metrics as M
from loomgraph.operators import sampling as S
from loomgraph.operators.blocks import reach_counts
from loomgraph.operators.communities import label_propagation
from loomgraph.operators.storage import cut
from loomgraph.operators.temporal import successors
from loomgraph.plans.registry import EDGES_SQL, USERS_SQL, H, query
from loomgraph.sources.fixture import canonical, interactions, load


def users(spark, sf_dir):
    e = interactions(spark, sf_dir)
    nodes = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    return nodes, e


_ADJ = f"{USERS_SQL}, adj AS (SELECT src AS node, dst AS nbr, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS pos, count(*) OVER (PARTITION BY src) AS deg FROM (SELECT DISTINCT src, dst FROM ue)), un AS (SELECT src AS id FROM ue UNION SELECT dst FROM ue)"
_STEP = "w{1} AS (SELECT walk_id, coalesce(nbr, cur) AS cur, path || ',' || coalesce(nbr, cur) AS path FROM w{0} LEFT JOIN adj ON node = cur AND pos = " + H.format("CAST(walk_id AS VARCHAR) || '|{1}'") + " % deg)"
_WALKS = f"{_ADJ}, w0 AS (SELECT id * 2 + k AS walk_id, id AS cur, CAST(id AS VARCHAR) AS path FROM un, range(2) r(k)), " + ", ".join(_STEP.format(i - 1, i) for i in range(1, 5))


@query(f"WITH {_WALKS} SELECT walk_id, path FROM w4")
def hash_walks(spark, sf_dir):
    """Two uniform walks of four steps from every user."""
    n, e = users(spark, sf_dir)
    return S.walk(n, e, 4, 2).select("walk_id", F.array_join(F.transform("walk", lambda x: x.cast("string")), ",").alias("path"))


@query(f"WITH {_WALKS}, l AS (SELECT walk_id, string_split(path, ',') AS p FROM w4) SELECT walk_id, CAST(j AS INT) AS pos, array_to_string(list_slice(p, j + 1, j + 3), ',') AS ctx FROM l, range(3) r(j)")
def walk_contexts(spark, sf_dir):
    """W4."""
    n, e = users(spark, sf_dir)
    c = S.contexts(S.walk(n, e, 4, 2), 3)
    return c.select("walk_id", "pos", F.array_join(F.transform("ctx", lambda x: x.cast("string")), ",").alias("ctx"))


@query(f"WITH {_WALKS}, l AS (SELECT string_split(path, ',') AS p FROM w4) SELECT CAST(p[j + 1] AS BIGINT) AS src, CAST(p[j + 3] AS BIGINT) AS dst, count(*) AS n FROM l, range(3) r(j) GROUP BY 1, 2")
def context_end_pairs(spark, sf_dir):
    """W13."""
    n, e = users(spark, sf_dir)
    return S.end_pairs(S.walk(n, e, 4, 2), 2).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(
    f"WITH {_WALKS}, l AS (SELECT string_split(path, ',') AS p FROM w4) SELECT CAST(p[i + 1] AS BIGINT) AS centre, CAST(p[j + 1] AS BIGINT) AS context, count(*) AS n FROM l, range(5) a(i), range(5) b(j) WHERE i <> j AND abs(i - j) <= 2 GROUP BY 1, 2"
)
def skipgram_pairs(spark, sf_dir):
    """W14."""
    n, e = users(spark, sf_dir)
    return S.skipgram_pairs(S.walk(n, e, 4, 2), 2).groupBy("centre", "context").agg(F.count("*").alias("n"))


@query(f"WITH {_WALKS}, l AS (SELECT unnest(string_split(path, ',')) AS x FROM w4), f AS (SELECT CAST(x AS BIGINT) AS id, count(*) AS n FROM l GROUP BY 1) SELECT id, n, round(n ** 0.75 / (SELECT sum(n ** 0.75) FROM f), 9) AS p FROM f")
def noise_table(spark, sf_dir):
    """Frequencies in the walks and the noise distribution from them."""
    n, e = users(spark, sf_dir)
    f = S.walk(n, e, 4, 2).select(F.explode("walk").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return f.join(S.noise_table(f), "id").select("id", "n", F.round("p", 9).alias("p"))


@query(
    f"WITH {_ADJ}, f AS (SELECT node AS id, deg AS n FROM adj WHERE pos = 0), t AS (SELECT sum(n) * 0.01 AS s FROM f) SELECT id, round(least(1.0, (sqrt(n / s) + 1) / (n / s)), 9) AS keep FROM f, t"
)
def keep_probabilities(spark, sf_dir):
    """Downsampling of frequent nodes."""
    _, e = users(spark, sf_dir)
    f = S.adjacency(e).where("pos = 0").select(F.col("node").alias("id"), F.col("deg").alias("n"))
    return S.keep_probability(f, 0.01).select("id", F.round("keep", 9).alias("keep"))


@query(
    f"WITH {_WALKS} SELECT walk_id, string_split(path, ',')[1] || ',' || "
    + " || ',' || ".join(H.format(f"CAST(walk_id AS VARCHAR) || '|{j}'") + " % 100" for j in (1, 2))
    + " AS ctx FROM w4"
)
def negative_walks(spark, sf_dir):
    """W5."""
    n, e = users(spark, sf_dir)
    w = S.negative_walks(S.walk(n, e, 4, 2), 100, 3)
    return w.select("walk_id", F.array_join(F.transform("ctx", lambda x: x.cast("string")), ",").alias("ctx"))


@query(
    f"""WITH {USERS_SQL}, e AS (SELECT DISTINCT src, dst FROM ue), t AS (SELECT a.src AS prev, a.dst AS cur, b.dst AS next FROM e a JOIN e b ON a.dst = b.src)
    SELECT prev, cur, round(sum(CASE WHEN next = prev THEN 2.0 WHEN (prev, next) IN (SELECT (src, dst) FROM e) THEN 1.0 ELSE 4.0 END), 6) AS total, count(*) AS n FROM t GROUP BY 1, 2"""
)
def node2vec_weights(spark, sf_dir):
    """The transition weights of second-order walks, summed for each step before."""
    _, e = users(spark, sf_dir)
    return S.transition_weights(e, 0.5, 0.25).groupBy("prev", "cur").agg(F.round(F.sum("weight"), 6).alias("total"), F.count("*").alias("n"))


_N2V = (
    f"{USERS_SQL}, e AS (SELECT DISTINCT src, dst FROM ue), w0 AS (SELECT src AS walk_id, src AS cur, CAST(NULL AS BIGINT) AS prev, CAST(src AS VARCHAR) AS path FROM (SELECT src FROM ue UNION SELECT dst FROM ue)), "
    + ", ".join(
        f"c{i} AS (SELECT walk_id, e.dst AS nxt, CASE WHEN prev IS NULL OR e.dst = prev OR b.src IS NOT NULL THEN 1.0 ELSE 2.0 END AS w FROM w{i - 1} JOIN e ON e.src = cur LEFT JOIN e b ON b.src = prev AND b.dst = e.dst), "
        f"p{i} AS (SELECT walk_id, nxt FROM (SELECT walk_id, nxt, row_number() OVER (PARTITION BY walk_id ORDER BY -ln(({H.format(f'CAST(walk_id AS VARCHAR) || chr(124) || CAST(nxt AS VARCHAR) || chr(124) || {chr(39)}{i}{chr(39)}')} + 1) / CAST(4294967297 AS DOUBLE)) / w, nxt) AS rn FROM c{i}) WHERE rn = 1), "
        f"w{i} AS (SELECT walk_id, coalesce(nxt, cur) AS cur, cur AS prev, path || ',' || coalesce(nxt, cur) AS path FROM w{i - 1} LEFT JOIN p{i} USING (walk_id))"
        for i in (1, 2, 3)
    )
)


@query(f"WITH {_N2V} SELECT walk_id, path FROM w3")
def node2vec_walks(spark, sf_dir):
    """Second-order walks of three steps; the weighted choice is an arg-min over md5 numbers."""
    n, e = users(spark, sf_dir)
    return S.node2vec_walk(n, e, 3).select("walk_id", F.array_join(F.transform("walk", lambda x: x.cast("string")), ",").alias("path"))


_TW = (
    f"{USERS_SQL}, w0 AS (SELECT src AS walk_id, src AS cur, min(ts) AS t, src AS root, min(ts) AS t0, CAST(src AS VARCHAR) AS walk, CAST(min(ts) AS VARCHAR) AS times FROM ue GROUP BY src), "
    + ", ".join(
        f"c{i} AS (SELECT walk_id, u.dst AS nxt, u.ts AS et, CASE WHEN u.ts = -1 OR t = -1 THEN 1.0 ELSE 1 - (u.ts - t) / CAST(21601 AS DOUBLE) END AS w FROM w{i - 1} JOIN ue u ON u.src = cur WHERE u.ts = -1 OR t = -1 OR (u.ts >= t AND u.ts < t + 21600)), "
        f"p{i} AS (SELECT walk_id, nxt, et FROM (SELECT *, row_number() OVER (PARTITION BY walk_id ORDER BY -ln(({H.format(f'CAST(walk_id AS VARCHAR) || chr(124) || chr(123) || CAST(nxt AS VARCHAR) || chr(44) || chr(32) || CAST(et AS VARCHAR) || chr(125) || chr(124) || {chr(39)}{i}{chr(39)}')} + 1) / CAST(4294967297 AS DOUBLE)) / w, nxt, et) AS rn FROM c{i}) WHERE rn = 1), "
        f"w{i} AS (SELECT walk_id, coalesce(nxt, root) AS cur, coalesce(CASE WHEN et = -1 THEN t ELSE et END, t0) AS t, root, t0, walk || ',' || coalesce(nxt, root) AS walk, times || ',' || coalesce(CASE WHEN et = -1 THEN t ELSE et END, t0) AS times FROM w{i - 1} LEFT JOIN p{i} USING (walk_id))"
        for i in (1, 2, 3, 4)
    )
)


@query(f"WITH {_TW} SELECT walk_id, walk, times FROM w4")
def temporal_walks(spark, sf_dir):
    """Walks forward in time, each step within six hours."""
    _, e = users(spark, sf_dir)
    seeds = e.groupBy(F.col("src").alias("node")).agg(F.min("timestamp_from").alias("ts")).withColumn("walk_id", F.col("node"))
    w = S.temporal_walk(seeds, e, 4, 21600, "linear")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return w.select("walk_id", text("walk"), text("times"))


_PARTNER = (
    f"{USERS_SQL}, t AS (SELECT DISTINCT src AS node, ts FROM ue), s0 AS (SELECT node, min(ts) AS ts FROM t GROUP BY 1), p AS (SELECT a.node, b.node AS partner, b.ts AS pts FROM s0 a JOIN t b ON b.ts >= a.ts AND b.ts < a.ts + 3600 AND b.node <> a.node), "
    f"pc AS (SELECT node, partner, pts, row_number() OVER (PARTITION BY node ORDER BY -ln(({H.format('CAST(node AS VARCHAR) || chr(124) || chr(123) || CAST(partner AS VARCHAR) || chr(44) || chr(32) || CAST(pts AS VARCHAR) || chr(125)')} + 1) / CAST(4294967297 AS DOUBLE)), partner, pts) AS rn FROM p), "
    "st AS (SELECT s0.node AS walk_id, coalesce(partner, s0.node) AS node, coalesce(pts, s0.ts) AS ts FROM s0 LEFT JOIN pc ON pc.node = s0.node AND rn = 1)"
)
_BALL = (
    f"{_PARTNER}, w0 AS (SELECT walk_id, node AS cur, ts AS t, node AS root, ts AS t0, walk_id || ',' || node AS walk FROM st), "
    + ", ".join(
        f"c{i} AS (SELECT walk_id, u.dst AS nxt, u.ts AS et FROM w{i - 1} JOIN ue u ON u.src = cur WHERE u.ts = -1 OR t = -1 OR (u.ts >= t AND u.ts < t + 21600)), "
        f"p{i} AS (SELECT walk_id, nxt, et FROM (SELECT *, row_number() OVER (PARTITION BY walk_id ORDER BY -ln(({H.format(f'CAST(walk_id AS VARCHAR) || chr(124) || chr(123) || CAST(nxt AS VARCHAR) || chr(44) || chr(32) || CAST(et AS VARCHAR) || chr(125) || chr(124) || {chr(39)}{i}{chr(39)}')} + 1) / CAST(4294967297 AS DOUBLE)), nxt, et) AS rn FROM c{i}) WHERE rn = 1), "
        f"w{i} AS (SELECT walk_id, coalesce(nxt, root) AS cur, coalesce(CASE WHEN et = -1 THEN t ELSE et END, t0) AS t, root, t0, walk || ',' || coalesce(nxt, root) AS walk FROM w{i - 1} LEFT JOIN p{i} USING (walk_id))"
        for i in (1, 2, 3)
    )
)


@query(f"WITH {_BALL}, l AS (SELECT walk_id, string_split(walk, ',') AS p FROM w3) SELECT walk_id, CAST(j AS INT) AS pos, array_to_string(list_slice(p, j + 1, j + 3), ',') AS ctx FROM l, range(3) r(j)")
def ballroom_contexts(spark, sf_dir):
    """From each user to a partner active in its window, a temporal walk from there, and its contexts."""
    from loomgraph.operators.temporal import window_partners

    _, e = users(spark, sf_dir)
    t = e.select(F.col("src").alias("node"), F.col("timestamp_from").alias("ts")).distinct()
    seeds = t.groupBy("node").agg(F.min("ts").alias("ts"))
    pairs = window_partners(seeds, t, (0, 3600)).where("node <> partner")
    chosen = S.pick(pairs.withColumn("item", F.struct("partner", "partner_ts")), "node", "item", F.lit(1.0))
    start = seeds.join(chosen, "node", "left").select(F.col("node").alias("walk_id"), F.coalesce("item.partner", "node").alias("node"), F.coalesce("item.partner_ts", "ts").alias("ts"))
    w = S.temporal_walk(start, e, 3, 21600).select("walk_id", F.concat(F.array("walk_id"), "walk").alias("walk"))
    return S.contexts(w, 3).select("walk_id", "pos", F.array_join(F.transform("ctx", lambda x: x.cast("string")), ",").alias("ctx"))


_RANK = f"r AS (SELECT src, dst, row_number() OVER (PARTITION BY dst ORDER BY {H.format('CAST(src AS VARCHAR) || chr(124) || CAST(dst AS VARCHAR)')}, src) AS rn FROM (SELECT DISTINCT src, dst FROM ue))"


@query(
    f"""WITH {USERS_SQL}, {_RANK}, s AS (SELECT DISTINCT src AS id FROM ue), h0 AS (SELECT 0 AS hop, src, dst FROM r WHERE rn <= 3 AND dst IN (SELECT id FROM s)),
    h1 AS (SELECT 1 AS hop, src, dst FROM r WHERE rn <= 2 AND dst IN (SELECT src FROM h0)) SELECT * FROM h0 UNION ALL SELECT * FROM h1"""
)
def neighbor_sample(spark, sf_dir):
    """Fan-outs 3 and 2 around all users with edges."""
    _, e = users(spark, sf_dir)
    seeds = e.select(F.col("src").alias("id")).distinct()
    return S.neighbor_sample(seeds, e, [3, 2])


@query(
    f"WITH {EDGES_SQL}, c AS (SELECT dt AS type, dst AS id, count(*) AS n FROM edges GROUP BY 1, 2), r AS (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY -ln(({H.format('type || chr(124) || CAST(id AS VARCHAR)')} + 1) / CAST(4294967297 AS DOUBLE)) / n, id) AS rn FROM c) SELECT type, id FROM r WHERE rn <= 20"
)
def hgt_sample(spark, sf_dir):
    """A budget of nodes for each type, by sampled degree."""
    g = canonical(spark, sf_dir)
    rows = g.all_edges("src", "dst").select(F.col("dst_type").alias("type"), F.col("dst").alias("id"))
    return S.budget_sample(rows, 20)


@query("SELECT DISTINCT a.o_custkey AS src, n2.n_regionkey AS dst FROM orders a JOIN customer ON a.o_custkey = c_custkey JOIN nation n2 ON c_nationkey = n2.n_nationkey")
def metapath_pairs(spark, sf_dir):
    """Customers to regions along PLACED's inverse, LIVESIN and ISIN."""
    g = canonical(spark, sf_dir)
    placed = g.edges["Customer", "PLACED", "Order"].select("src", F.col("src").alias("dst"))
    return S.metapath(placed, g.edges["Customer", "LIVESIN", "Nation"], g.edges["Nation", "ISIN", "Region"]).select("src", F.col("dst").cast("int").alias("dst"))


@query(f"WITH {USERS_SQL}, e AS (SELECT DISTINCT src, dst FROM ue), two AS (SELECT DISTINCT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src) SELECT src, count(*) AS reached FROM (SELECT DISTINCT two.src, e.dst FROM two JOIN e ON two.dst = e.src) GROUP BY 1")
def khop_pairs(spark, sf_dir):
    """Nodes at the end of walks of three edges."""
    _, e = users(spark, sf_dir)
    return reach_counts(e, 3)


@query(
    f"""WITH {USERS_SQL}, e AS (SELECT src, dst FROM ue WHERE src <> dst UNION SELECT dst, src FROM ue WHERE src <> dst), d AS (SELECT src, count(*) AS deg FROM e GROUP BY 1),
    c AS (SELECT x.src AS a, x.dst AS b, count(y.src) AS common FROM e x LEFT JOIN e p ON p.src = x.src LEFT JOIN e y ON y.src = x.dst AND y.dst = p.dst WHERE x.src < x.dst GROUP BY 1, 2)
    SELECT a, b, common, round(common / (da.deg + db.deg - common), 9) AS jaccard, round(common / least(da.deg, db.deg), 9) AS min_norm FROM c JOIN d da ON da.src = a JOIN d db ON db.src = b"""
)
def edge_overlap_weights(spark, sf_dir):
    """J16."""
    _, e = users(spark, sf_dir)
    return M.overlap(e).select("a", "b", "common", F.round("jaccard", 9).alias("jaccard"), F.round("min_norm", 9).alias("min_norm"))


_OVERLAP = (
    "oe AS (SELECT src, dst FROM ue WHERE src <> dst UNION SELECT dst, src FROM ue WHERE src <> dst), od AS (SELECT src, count(*) AS deg FROM oe GROUP BY 1), "
    "oc AS (SELECT x.src AS a, x.dst AS b, count(y.src) AS common FROM oe x LEFT JOIN oe p ON p.src = x.src LEFT JOIN oe y ON y.src = x.dst AND y.dst = p.dst WHERE x.src < x.dst GROUP BY 1, 2), "
    "ov AS (SELECT a, b, common / CAST(da.deg + db.deg - common AS DOUBLE) AS w FROM oc JOIN od da ON da.src = a JOIN od db ON db.src = b)"
)
_WALK1 = f"{_ADJ}, w0 AS (SELECT id AS walk_id, id AS cur, CAST(id AS VARCHAR) AS path FROM un), " + ", ".join(_STEP.format(i - 1, i) for i in range(1, 5))


@query(
    f"""WITH {_WALK1}, {_OVERLAP}, l AS (SELECT walk_id, string_split(path, ',') AS p FROM w4), s AS (SELECT walk_id, CAST(j AS INT) AS pos, CAST(p[j] AS BIGINT) AS x, CAST(p[j + 1] AS BIGINT) AS y FROM l, range(1, 5) r(j))
    SELECT walk_id, pos, round(coalesce(w, 0.0), 9) AS weight FROM s LEFT JOIN ov ON a = least(x, y) AND b = greatest(x, y)"""
)
def walk_weights(spark, sf_dir):
    """The overlap of the ends of each step."""
    n, e = users(spark, sf_dir)
    o = M.overlap(e).select("a", "b", F.col("jaccard").alias("weight"))
    return S.walk_weights(S.walk(n, e, 4), o).select("walk_id", "pos", F.round("weight", 9).alias("weight"))


def _negatives(edges: str, taken: str, src_nodes: str, dst_nodes: str) -> str:
    """SQL for the operator's sample: edges and the pairs to keep off as names of (src, dst), node counts as expressions."""
    draw = lambda n, side: H.format(f"CAST(a AS VARCHAR) || '|' || CAST(b AS VARCHAR) || '|' || CAST(t AS VARCHAR) || '|{side}'") + f" % {n}"
    return (
        f"pos AS (SELECT src, dst FROM {edges} ORDER BY {H.format('CAST(src AS VARCHAR) || chr(124) || CAST(dst AS VARCHAR)')}, src, dst LIMIT 5000), "
        f"tr AS (SELECT src AS a, dst AS b, t FROM pos, range(4) r(t)), cd AS (SELECT a, b, t, {draw(src_nodes, 's')} AS src, {draw(dst_nodes, 'd')} AS dst FROM tr), "
        f"ok AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY t) AS rn FROM cd WHERE NOT EXISTS (SELECT 1 FROM {taken} x WHERE x.src = cd.src AND x.dst = cd.dst))"
    )


@query(
    f"WITH e AS (SELECT DISTINCT l_orderkey AS src, l_suppkey AS dst FROM lineitem), {_negatives('e', 'e', '(SELECT count(*) FROM orders)', '(SELECT count(*) FROM supplier)')} SELECT src, dst, 1 AS label FROM pos UNION ALL SELECT src, dst, 0 FROM ok WHERE rn = 1"
)
def negative_pairs(spark, sf_dir):
    """The sample of 5000 edges that the operator takes, and a pair that is no edge for each."""
    g = canonical(spark, sf_dir)
    size = dict(g.counts())
    return S.negative_pairs(g.edges["Order", "SUPPLIEDBY", "Supplier"], size["Order"], size["Supplier"])


_V = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_PAIR = f"WITH v AS (SELECT vec_id, {_V} AS v FROM embeddings), p AS (SELECT a.vec_id, a.v AS a, b.v AS b FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)"


@query(
    f"{_PAIR} SELECT vec_id, round(list_dot_product(a, b), 6) AS dot, round(list_cosine_similarity(a, b), 6) AS cos, round(list_distance(a, b), 6) AS l2, round(list_sum(list_transform(list_zip(a, b), lambda x: abs(x[1] - x[2]))), 6) AS l1 FROM p"
)
def vector_metrics(spark, sf_dir):
    """F14, F15."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    a, b = F.col("a"), F.col("b")
    return p.select("vec_id", F.round(dot(a, b), 6).alias("dot"), F.round(cosine(a, b), 6).alias("cos"), F.round(l2(a, b), 6).alias("l2"), F.round(l1(a, b), 6).alias("l1"))


@query(
    f"{_PAIR} SELECT vec_id, round(list_sum(list_transform(list_zip(a, b), lambda x: x[1] + x[2])), 5) AS add, round(list_sum(list_transform(list_zip(a, b), lambda x: x[1] * x[2])), 5) AS mult, len(list_concat(a, b)) AS concat FROM p"
)
def combine_embeddings(spark, sf_dir):
    """F18, M13."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    total = lambda c: F.aggregate(c.of(F.col("a"), F.col("b")), F.lit(0.0), lambda s, x: s + x)
    return p.select("vec_id", F.round(total(Combine.ADD), 5).alias("add"), F.round(total(Combine.MULT), 5).alias("mult"), F.size(Combine.CONCAT.of(F.col("a"), F.col("b"))).cast("long").alias("concat"))


_MEANS = f"v AS (SELECT vec_id, label, {_V} AS v FROM embeddings), f AS (SELECT vec_id, label, i, v[i] AS x FROM v, range(1, 65) r(i)), m AS (SELECT label, i, avg(x) AS m, count(*) AS n, avg(x * x) - avg(x) * avg(x) AS var FROM f GROUP BY 1, 2)"


@query(f"WITH {_MEANS} SELECT label, CAST(i - 1 AS INT) AS i, round(m, 6) AS mean, round(var, 6) AS var, n FROM m")
def gaussian_stats(spark, sf_dir):
    """Counts, means and variances of clusters."""
    f = load(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    return f.groupBy("label", "i").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.avg(F.col("x") * F.col("x")) - F.avg("x") * F.avg("x"), 6).alias("var"), F.count("*").alias("n"))


_NEAR = f"{_MEANS}, c AS (SELECT label AS k, list(m ORDER BY i) AS c FROM m GROUP BY 1), near AS (SELECT vec_id, label, k, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_distance(v, c), 9), k) AS rn FROM v, c)"


@query(f"WITH {_NEAR} SELECT vec_id, k AS z FROM near WHERE rn = 1")
def nearest_mean_assign(spark, sf_dir):
    """Each vector's nearest of the labels' means."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    centres = [r["mean"] for r in M.means(e).orderBy("label").collect()]
    return C.nearest(e, centres).select("vec_id", "z")


@query(
    f"""WITH {_MEANS}, s AS (SELECT vec_id AS k, v AS c FROM v WHERE vec_id < 3), a1 AS (SELECT vec_id, arg_min(k, (round(list_distance(v, c), 9), k)) AS z FROM v, s GROUP BY 1),
    m1 AS (SELECT z, i, avg(x) AS m FROM f JOIN a1 USING (vec_id) GROUP BY 1, 2), c1 AS (SELECT z AS k, list(m ORDER BY i) AS c FROM m1 GROUP BY 1), a2 AS (SELECT vec_id, arg_min(k, (round(list_distance(v, c), 9), k)) AS z FROM v, c1 GROUP BY 1)
    SELECT vec_id, CAST(z AS INT) AS z FROM a2"""
)
def lloyd_fixed_init(spark, sf_dir):
    """One round of k-means from three given vectors, then the assignment."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    start = [list(r["embedding"]) for r in e.where("vec_id < 3").orderBy("vec_id").collect()]
    return C.nearest(e, C.lloyd(e, start, 1)).select("vec_id", "z")


@query(f"WITH {_NEAR}, d AS (SELECT label AS t, k AS p FROM near WHERE rn = 1), ct AS (SELECT t, p, CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY 1, 2), a AS (SELECT t, sum(n) AS a FROM ct GROUP BY 1), b AS (SELECT p, sum(n) AS b FROM ct GROUP BY 1), n AS (SELECT sum(n) AS s FROM ct), "
    "mi AS (SELECT sum(ct.n / s * ln(ct.n * s / (a * b))) AS mi, sum(ct.n * (ct.n - 1) / 2) AS tog FROM ct JOIN a USING (t) JOIN b USING (p), n), "
    "ha AS (SELECT -sum(a / s * ln(a / s)) AS h, sum(a * (a - 1) / 2) AS r FROM a, n), hb AS (SELECT -sum(b / s * ln(b / s)) AS h, sum(b * (b - 1) / 2) AS r FROM b, n) "
    "SELECT round(mi / ((ha.h + hb.h) / 2), 6) AS nmi, round((tog - ha.r * hb.r / (s * (s - 1) / 2)) / ((ha.r + hb.r) / 2 - ha.r * hb.r / (s * (s - 1) / 2)), 6) AS ari FROM mi, ha, hb, n"
)
def nmi_ari(spark, sf_dir):
    """E3."""
    d = load(spark, sf_dir, "embeddings").join(nearest_mean_assign(spark, sf_dir), "vec_id")
    return M.nmi_ari(d, "label", "z").select(F.round("nmi", 6).alias("nmi"), F.round("ari", 6).alias("ari"))


@query(f"WITH {_NEAR} SELECT round(sum(m) / sum(n), 6) AS purity FROM (SELECT k, max(n) AS m, sum(n) AS n FROM (SELECT k, label, CAST(count(*) AS DOUBLE) AS n FROM near WHERE rn = 1 GROUP BY 1, 2) GROUP BY 1)")
def purity(spark, sf_dir):
    """E4."""
    d = load(spark, sf_dir, "embeddings").join(nearest_mean_assign(spark, sf_dir), "vec_id")
    return M.purity(d, "label", "z").select(F.round("purity", 6).alias("purity"))


@query(
    f"""WITH {_MEANS}, c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1), s AS (SELECT v.label, any_value(c) AS c, avg(list_distance(v, c)) AS s FROM v JOIN c USING (label) GROUP BY 1)
    SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT a.label, max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM s a JOIN s b ON a.label <> b.label GROUP BY 1)"""
)
def davies_bouldin(spark, sf_dir):
    """E6."""
    return M.davies_bouldin(load(spark, sf_dir, "embeddings")).select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


@query(
    f"""WITH v AS (SELECT vec_id, label, {_V} AS v FROM embeddings), p AS (SELECT a.vec_id AS i, a.label AS li, b.label AS lj, avg(list_distance(a.v, b.v)) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
    o AS (SELECT i, max(d) FILTER (li = lj) AS a, min(d) FILTER (li <> lj) AS b FROM p GROUP BY 1) SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM o"""
)
def silhouette(spark, sf_dir):
    """E5: over all vectors."""
    return M.silhouette(load(spark, sf_dir, "embeddings")).select(F.round("silhouette", 6).alias("silhouette"))


@query(f"WITH {_MEANS}, c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1) SELECT round(avg(list_distance(v, c)), 6) AS isometric_loss FROM v JOIN c USING (label)")
def isometric_loss(spark, sf_dir):
    """M4."""
    return M.isometric_loss(load(spark, sf_dir, "embeddings")).select(F.round("isometric_loss", 6).alias("isometric_loss"))


_PN = f"WITH v AS (SELECT vec_id, {_V} AS v FROM embeddings), n AS (SELECT count(*) AS n FROM v), p AS (SELECT list_dot_product(a.v, b.v) AS pos, list_dot_product(a.v, c.v) AS neg FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 JOIN v c ON c.vec_id = a.vec_id // 2)"


def _scored_pairs(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id").withColumn("half", F.expr("vec_id div 2"))
    p = p.join(e.select(F.col("vec_id").alias("half"), F.col("a").alias("c")), "half")
    return p.select(dot(F.col("a"), F.col("b")).alias("pos"), dot(F.col("a"), F.col("c")).alias("neg"))


@query(f"{_PN} SELECT round(avg(greatest(0.0, 0.1 + neg - pos)), 6) AS hinge_loss FROM p")
def hinge_loss(spark, sf_dir):
    """M3."""
    return M.hinge_loss(_scored_pairs(spark, sf_dir), "pos", "neg").select(F.round("hinge_loss", 6).alias("hinge_loss"))


@query(f"{_PN} SELECT round(avg(ln(1 + exp(-pos)) + ln(1 + exp(neg))), 6) AS skipgram_loss FROM p")
def skipgram_loss(spark, sf_dir):
    """M2."""
    return M.skipgram_loss(_scored_pairs(spark, sf_dir), "pos", "neg").select(F.round("skipgram_loss", 6).alias("skipgram_loss"))


@query("WITH c AS (SELECT label AS k, count(*) AS n FROM embeddings GROUP BY 1) SELECT k, CAST(1 + n AS DOUBLE) AS a, CAST(0.5 + coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS DOUBLE) AS b FROM c")
def dirichlet_posterior(spark, sf_dir):
    """Stick-breaking posterior of cluster sizes; a row a cluster."""
    rows = load(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()
    import numpy as np

    a, b = C.DirichletPrior(0.5).posterior(np.array([float(r["n"]) for r in rows]))
    return spark.createDataFrame([(r["label"], float(x), float(y)) for r, x, y in zip(rows, a, b)], "k int, a double, b double")


@query(f"WITH {_NEAR}, d AS (SELECT label AS t, k AS p FROM near WHERE rn = 1), k AS (SELECT x.k, coalesce(s, 0) AS s, coalesce(q, 0) AS q, coalesce(h, 0) AS h FROM (SELECT t AS k FROM d UNION SELECT p FROM d) x LEFT JOIN (SELECT t, count(*) AS s FROM d GROUP BY 1) ON t = x.k LEFT JOIN (SELECT p, count(*) AS q, count(*) FILTER (t = p) AS h FROM d GROUP BY 1) ON p = x.k) SELECT round(sum(h) / sum(s), 6) AS accuracy, round(2 * sum(h) / (sum(s) + sum(q)), 6) AS f1_micro, round(avg(2 * h / (s + q)), 6) AS f1_macro FROM k")
def classification_scores(spark, sf_dir):
    """Scores of predicted classes."""
    d = load(spark, sf_dir, "embeddings").join(nearest_mean_assign(spark, sf_dir), "vec_id")
    m = M.classification(d, "label", "z")
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


_SAGE = f"WITH {USERS_SQL}, v AS (SELECT vec_id AS id, {_V} AS v FROM embeddings), f AS (SELECT id, i, v[i] AS x FROM v, range(1, 65) r(i))"


@query(f"{_SAGE} SELECT dst AS id, CAST(i - 1 AS INT) AS i, round(avg(x), 6) AS m FROM ue JOIN f ON f.id = src GROUP BY 1, 2")
def sage_mean_aggregate(spark, sf_dir):
    """M5: the mean of in-neighbours' vectors."""
    _, e = users(spark, sf_dir)
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("z"))
    out = E.mean_of_neighbours(e, v)
    return out.select("id", F.posexplode("z").alias("i", "m")).select("id", "i", F.round("m", 6).alias("m"))


@query(f"WITH {USERS_SQL}, v AS (SELECT vec_id AS id, {_V} AS v FROM embeddings) SELECT event_id, round(list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2] * 0.25)), 6) AS score FROM ue JOIN v a ON a.id = src JOIN v b ON b.id = dst")
def context_pair_score(spark, sf_dir):
    """M24."""
    _, e = users(spark, sf_dir)
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("z"))
    return E.context_score(e.select("event_id", "src", "dst"), v, [0.5] * 64).select("event_id", F.round("score", 6).alias("score"))


@query(f"WITH {USERS_SQL}, v AS (SELECT vec_id AS id, {_V} AS v FROM embeddings) SELECT event_id, round(-list_cosine_similarity(a.v, b.v), 6) AS feature FROM ue JOIN v a ON a.id = src JOIN v b ON b.id = dst")
def link_features(spark, sf_dir):
    """The distance that link prediction learns from."""
    _, e = users(spark, sf_dir)
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("z"))
    return M.link_features(e.select("event_id", "src", "dst"), v).select("event_id", F.round("feature", 6).alias("feature"))


@query(
    f"""WITH {USERS_SQL}, v AS (SELECT vec_id AS id, {_V} AS v FROM embeddings), s AS (SELECT src, dst, a.v[1] AS x, list_dot_product(a.v, b.v) AS d FROM (SELECT DISTINCT src, dst FROM ue) JOIN v a ON a.id = src JOIN v b ON b.id = dst),
    l AS (SELECT dst, x, CASE WHEN d > 0 THEN d ELSE 0.2 * d END AS s FROM s) SELECT dst AS id, round(sum(exp(s) * x) / sum(exp(s)), 6) AS first FROM l GROUP BY 1"""
)
def attention_aggregate(spark, sf_dir):
    """Attention over each destination, without heads."""
    _, e = users(spark, sf_dir)
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("z"))
    return E.attention(e, v).select("id", F.round(F.col("z")[0], 6).alias("first"))


_LP = f"{USERS_SQL}, e AS (SELECT src, dst FROM ue WHERE src <> dst UNION SELECT dst, src FROM ue WHERE src <> dst), l0 AS (SELECT src AS id, src AS label FROM (SELECT src FROM ue UNION SELECT dst FROM ue)), " + ", ".join(
    f"v{i} AS (SELECT id, label FROM (SELECT e.src AS id, l.label, row_number() OVER (PARTITION BY e.src ORDER BY count(*) DESC, l.label) AS rn FROM e JOIN l{i - 1} l ON l.id = e.dst GROUP BY 1, 2) WHERE rn = 1), "
    f"l{i} AS (SELECT l.id, coalesce(v.label, l.label) AS label FROM l{i - 1} l LEFT JOIN v{i} v USING (id))"
    for i in (1, 2, 3, 4)
)


@query(f"WITH {_LP} SELECT id, label FROM l4")
def label_propagation_communities(spark, sf_dir):
    """G16 (the cheap stand-in beside Louvain): four rounds of label propagation."""
    n, e = users(spark, sf_dir)
    return label_propagation(n, e, 4)


@query()
def node2vec_embed(spark, sf_dir):
    """Skip-gram over walks."""
    n, e = users(spark, sf_dir)
    return E.word2vec(S.walk(n, e, 8, 2), 16).select("id", F.size("z").alias("dim"))


@query()
def link_prediction_eval(spark, sf_dir):
    """In-sample and held-out scores of link prediction."""
    n, e = users(spark, sf_dir)
    size = n.agg(F.max("id")).first()[0] + 1
    pairs = cut(S.negative_pairs(e, size, size))
    v = E.seeded_vectors(n, 16)
    return M.tidy(lp_insample=E.link_prediction(pairs, v, Metric.L2), lp_held_out=E.link_prediction(pairs, v, Metric.L2, True))


@query()
def node_classification_eval(spark, sf_dir):
    """E8, E10."""
    return M.tidy(cf=E.node_classification(load(spark, sf_dir, "embeddings")))


@query()
def kmeans_assign(spark, sf_dir):
    """C1, C18."""
    return C.kmeans(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 10).select("vec_id", "z")


@query()
def kmeans_1d_assign(spark, sf_dir):
    """C2, C19."""
    return C.kmeans_1d(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 4).select("vec_id", "z")


@query()
def gmm_assign(spark, sf_dir):
    """C17: over the whole vectors."""
    return C.gaussian_mixture(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 5).select("vec_id", "z")


@query()
def dpmm_assign(spark, sf_dir):
    """A Dirichlet-process mixture with splits and merges over all vectors."""
    points = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return C.assign(points, C.fit_dpmm(points), "embedding").select("vec_id", "z")


@query()
def synthetic_mixture(spark, sf_dir):
    """S26."""
    return C.synthetic_gmm(spark, 10_000).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.col("embedding")[0]), 3).alias("x"))


@query(f"WITH {USERS_SQL} SELECT count(*) AS n FROM ue a JOIN ue b ON b.src = a.dst AND b.ts >= a.ts AND b.ts <= a.ts + 3600 AND b.event_id <> a.event_id")
def successor_count(spark, sf_dir):
    """How many steps a temporal walk may take in all."""
    return successors(interactions(spark, sf_dir), 3600).agg(F.count("*").alias("n"))


@query(f"WITH {_MEANS}, c AS (SELECT label AS k, list(m ORDER BY i) AS c FROM m GROUP BY 1) SELECT k, other, rn FROM (SELECT a.k, b.k AS other, row_number() OVER (PARTITION BY a.k ORDER BY round(list_distance(a.c, b.c), 9), b.k) AS rn FROM c a JOIN c b ON a.k <> b.k) WHERE rn <= 3")
def mean_neighbours(spark, sf_dir):
    """The three nearest other means of each mean; a row a cluster on either side."""
    from pyspark.sql import Window

    m = M.means(load(spark, sf_dir, "embeddings")).select(F.col("label").alias("k"), "mean")
    pairs = m.join(m.select(F.col("k").alias("other"), F.col("mean").alias("mean2")), F.col("k") != F.col("other"))
    w = Window.partitionBy("k").orderBy(F.round(l2(F.col("mean"), F.col("mean2")), 9), "other")
    return pairs.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("k", "other", F.col("rn").cast("long").alias("rn"))


@query(f"WITH {_MEANS} SELECT CAST(i - 1 AS INT) AS i, round(sum(n * m) / sum(n), 6) AS mean, round(sum(n * (var + m * m)) / sum(n) - (sum(n * m) / sum(n)) ** 2, 6) AS var FROM m GROUP BY 1")
def gaussian_merge(spark, sf_dir):
    """All clusters merged into one by matching moments."""
    g = load(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    s = g.groupBy("label", "i").agg(F.count("*").alias("n"), F.avg("x").alias("m"), (F.avg(F.col("x") * F.col("x")) - F.avg("x") * F.avg("x")).alias("var"))
    mean = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    var = F.sum(F.col("n") * (F.col("var") + F.col("m") * F.col("m"))) / F.sum("n") - mean * mean
    return s.groupBy("i").agg(F.round(mean, 6).alias("mean"), F.round(var, 6).alias("var"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS z FROM embeddings")
def hard_assignment(spark, sf_dir):
    """The place of the largest responsibility."""
    return load(spark, sf_dir, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("z"))


@query(f"SELECT vec_id, round(1 / (1 + exp(-list_sum(list_transform({_V}, lambda x: 0.125 * x)))), 6) AS p FROM embeddings")
def attention_head(spark, sf_dir):
    """The sigmoid of a linear head."""
    z = F.col("embedding")
    s = F.aggregate(z, F.lit(0.0), lambda a, x: a + 0.125 * x.cast("double"))
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(1 / (1 + F.exp(-s)), 6).alias("p"))


@query(f"{_PN} SELECT round(avg(1 - 1 / (1 + exp(-pos))), 6) AS positive_error, round(avg(-1 / (1 + exp(-neg))), 6) AS negative_error FROM p")
def sgd_errors(spark, sf_dir):
    """The error terms that skip-gram updates are scaled by."""
    p = _scored_pairs(spark, sf_dir)
    sig = lambda c: 1 / (1 + F.exp(-F.col(c)))
    return p.agg(F.round(F.avg(1 - sig("pos")), 6).alias("positive_error"), F.round(F.avg(-sig("neg")), 6).alias("negative_error"))


@query(f"SELECT c_custkey AS id, round(CASE WHEN c_custkey % 10 = 0 THEN 0.0 ELSE ({H.format('CAST(c_custkey AS VARCHAR) || chr(124) || chr(48) || chr(124) || chr(48)')} / CAST(4294967296 AS DOUBLE) - CAST(0.5 AS DOUBLE)) / 8 END, 6) AS first FROM customer")
def seeded_node_vectors(spark, sf_dir):
    """M1: seeded vectors of all customers, the masked ones zero."""
    n = canonical(spark, sf_dir).nodes["Customer"]
    z = E.seeded_vectors(n, 8)
    return z.select("id", F.when(F.col("id") % 10 == 0, F.array_repeat(F.lit(0.0), 8)).otherwise(F.col("z")).alias("z")).select("id", F.round(F.col("z")[0], 6).alias("first"))
