"""Hand-computed graphs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions.special import digamma, mvlgamma
from loomgraph.functions.text import jaro_winkler_one, mail_columns, parse_list, safe_col, stem_word, strip_accents, strip_wiki, template_args
from loomgraph.functions.vectors import Metric
from loomgraph.graph import TemporalGraph, read_graph, validate, write_graph
from loomgraph.operators import clustering as C
from loomgraph.operators import metrics as M
from loomgraph.operators import relational as R
from loomgraph.operators import sampling as S
from loomgraph.operators import temporal as T
from loomgraph.operators import transforms as X
from loomgraph.plans import QUERIES


def edges(spark, pairs, times=None):
    rows = [(a, b, t) for (a, b), t in zip(pairs, times or [-1] * len(pairs))]
    return spark.createDataFrame(rows, "src long, dst long, timestamp_from long")


def nodes(spark, n):
    return spark.createDataFrame([(i, -1) for i in range(n)], "id long, timestamp_from long")


def z(spark, labels):
    return spark.createDataFrame(list(enumerate(labels)), "id long, z long")


def test_modularity_and_conductance(spark):
    e = edges(spark, [(0, 1), (1, 2), (2, 0), (2, 3)])
    got = M.modularity(e, z(spark, [0, 0, 0, 1])).first()[0]
    assert got == pytest.approx(6 / 8 - (14 / 16) ** 2 - (2 / 16) ** 2)
    c = M.conductance(e, z(spark, [0, 0, 0, 1]), 2).first()[0]
    assert c == pytest.approx((1 / (2 * 3 + 1 + 1e-4)) / 2)


def test_self_loop_counts_twice(spark):
    got = M.modularity(edges(spark, [(0, 0), (0, 1)]), z(spark, [0, 1])).first()[0]
    assert got == pytest.approx(2 / 3 - (4 / 6) ** 2 - (2 / 6) ** 2)


def test_multi_edges_merge(spark):
    e = edges(spark, [(0, 1)] * 3, [1, 2, 3])
    for how, want in (("add", 6), ("mean", 2), ("min", 1), ("max", 3), ("mul", 6)):
        assert X.coalesce_edges(e, {"timestamp_from": how}).first()["timestamp_from"] == want


def test_bipartite_gets_reverse_relation(spark):
    g = TemporalGraph({"A": nodes(spark, 2), "B": nodes(spark, 3)}, {("A", "to", "B"): edges(spark, [(0, 2), (1, 0)])})
    u = X.to_undirected(g)
    assert list(u.edges) == [("A", "to", "B"), ("B", "rev_to", "A")]
    assert sorted((r.src, r.dst) for r in u.edges["B", "rev_to", "A"].collect()) == [(0, 1), (2, 0)]
    assert X.offsets(g.counts()) == {"A": (0, 2), "B": (2, 5)}
    h = X.homogenify(g, X.offsets(g.counts()))
    assert sorted(r.dst for r in h.edges["0", "0", "0"].collect()) == [2, 4]


def test_validate_and_roundtrip(spark, tmp_path):
    g = TemporalGraph({"A": nodes(spark, 2)}, {("A", "to", "A"): edges(spark, [(0, 1)])})
    assert validate(g) == []
    assert validate(g.with_edges({("A", "to", "A"): edges(spark, [(0, 7)])})) == ["to: an end is out of range"]
    write_graph(g, str(tmp_path))
    assert read_graph(spark, str(tmp_path)).counts() == [("A", 2)]


def test_snapshots(spark):
    t = spark.createDataFrame([(x,) for x in (-1, 0, 5, 10)], "ts long")
    b = T.snapshots(t, 2)
    assert b == [(0, 6), (5, 11)]
    got = {r.ts: r.l for r in t.select("ts", T.snapshot_of(F.col("ts"), b).alias("l")).collect()}
    assert got == {-1: 1, 0: 2, 5: 3, 10: 4}  # a time equal to a start counts with the snapshot before it
    assert len(T.snapshots(spark.createDataFrame([(3,), (4,)], "ts long"), 5)) == 2
    with pytest.raises(ValueError):
        T.snapshots(spark.createDataFrame([(-1,)], "ts long"), 5)


def test_window_partners_edges_of_the_window(spark):
    left = spark.createDataFrame([(1, 10)], "node long, ts long")
    right = spark.createDataFrame([(2, 9), (3, 10), (4, 14), (5, 15)], "node long, ts long")
    assert sorted(r.partner for r in T.window_partners(left, right, (0, 5)).collect()) == [3, 4]
    assert sorted(r.partner for r in T.window_partners(left, right, (-1, 5)).collect()) == [2, 3, 4]


def test_splits_are_disjoint(spark):
    m = X.split_masks(spark.range(5000), ["id"])
    n = {c: m.where(c).count() for c in ("train_mask", "val_mask", "test_mask")}
    assert sum(n.values()) == 5000 and m.where("train_mask and test_mask or val_mask and test_mask").count() == 0
    assert 400 < n["val_mask"] < 600 and 400 < n["test_mask"] < 600


def test_dense_ids_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(13)
    got = R.dense_ids(df, "k")
    assert got.where("id <> k").count() == 0


def test_walks_follow_edges(spark):
    e = edges(spark, [(0, 1), (1, 2), (2, 0), (1, 3)])
    have = {(0, 1), (1, 2), (2, 0), (1, 3)}
    for w in (S.walk(nodes(spark, 4), e, 5, 2), S.node2vec_walk(nodes(spark, 4), e, 5)):
        for r in w.collect():
            assert len(r.walk) == 6
            assert all(p in have or p == (3, 3) for p in zip(r.walk, r.walk[1:]))


def test_temporal_walks_do_not_go_back(spark):
    e = edges(spark, [(0, 1), (1, 2), (2, 3), (2, 0)], [1, 2, 3, 1])
    seeds = spark.createDataFrame([(0, 0, 0)], "walk_id long, node long, ts long")
    w = S.temporal_walk(seeds, e, 3, 10).first()
    assert w.walk == [0, 1, 2, 3] and w.times == [0, 1, 2, 3]


def test_contexts(spark):
    w = spark.createDataFrame([(0, [1, 2, 3, 4])], "walk_id long, walk array<long>")
    assert [r.ctx for r in S.contexts(w, 3).orderBy("pos").collect()] == [[1, 2, 3], [2, 3, 4]]
    assert sorted((r.src, r.dst) for r in S.end_pairs(w, 2).collect()) == [(1, 3), (2, 4)]


def test_clustering_measures_of_extremes(spark):
    same = spark.createDataFrame([(0, 1), (0, 1), (1, 0)], "t int, p int")
    r = M.nmi_ari(same, "t", "p").first()
    assert (r.nmi, r.ari) == (pytest.approx(1), pytest.approx(1))
    one = spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 0, [0.0, 1.0])], "vec_id long, label int, embedding array<double>")
    assert M.davies_bouldin(one).first()[0] == 0.0 and M.silhouette(one).first()[0] == 0.0


def test_metric_compat(spark):
    df = spark.createDataFrame([([3.0, 0.0], [0.0, 4.0])], "a array<double>, b array<double>")
    d = lambda m, **k: df.select(m.distance(F.col("a"), F.col("b"), **k)).first()[0]
    assert d(Metric.L2) == 5 and d(Metric.L1) == 7 and d(Metric.DOTP) == 0 and d(Metric.DOTP, compat=True) == 5


def test_text_functions(spark):
    assert safe_col("feat_a b, c") == "feat_a_b_c"
    assert jaro_winkler_one("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert (stem_word("running"), stem_word("cities"), stem_word("glass")) == ("runn", "city", "glass")
    df = spark.createDataFrame([("['a', 'b']", "é", "[[A|b]] {{x|{{y}}}} '''c'''"), ("__import__('os')", "ñ", None)], "a string, b string, c string")
    got = df.select(parse_list("a"), strip_accents("b"), strip_wiki("c")).collect()
    assert [tuple(r) for r in got] == [(["a", "b"], "e", "b c"), (None, "n", None)]
    t = spark.createDataFrame([("{{Infobox | name = Luke | side=light | name = other }}",)], "t string")
    assert t.select(template_args(F.col("t"))).first()[0] == {"name": "Luke", "side": "light"}
    m = spark.createDataFrame([("From: a@x\nTo: b@x,\n c@x\nSubject: hi\n\nbody\n----- Original Message -----\nold",)], "m string")
    r = m.select(*[c.alias(k) for k, c in mail_columns(F.col("m")).items()]).first()
    assert (r["from"], r["to"], r["cc"], r["content"], r["if_forwarded"]) == ("a@x", "b@x, c@x", "", "body", True)


def test_special_functions():
    assert digamma([1.0, 5.5]) == pytest.approx([-0.5772156649, 1.6110931486], abs=1e-9)
    assert mvlgamma([3.0], 2)[0] == pytest.approx(0.5 * math.log(math.pi) + math.lgamma(3) + math.lgamma(2.5))


def test_mixture_finds_separate_clusters(spark):
    points = C.synthetic_gmm(spark, 600, k=4, seed=5)
    m = C.fit_dpmm(points, p=C.Params(rounds=16))
    assert m.bound[-1] >= m.bound[0]
    got = C.assign(points, m)
    r = np.array(got.select("r").first()[0])
    assert r.sum() == pytest.approx(1)
    assert M.purity(got, "z", "label").first()[0] > 0.9 or M.nmi_ari(got, "label", "z").first()[0] > 0.6


def test_dirichlet_posterior():
    a, b = C.DirichletPrior(0.5).posterior(np.array([3.0, 2.0, 1.0]))
    assert a.tolist() == [4, 3, 2] and b.tolist() == [3.5, 1.5, 0.5]


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    from loomgraph.sources.fixture import load

    df = load(spark, sf_dir, "lineitem").where("l_quantity > 10").select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,10.0)" in plan and "l_tax" not in plan


@pytest.mark.parametrize("name", ["gmm_assign", "dpmm_assign"])
def test_mixture_queries_use_whole_vectors_of_the_table(spark, tmp_path, name):
    rng = np.random.default_rng(0)
    label = np.arange(600) % 2
    v = rng.normal(size=(600, 16))
    v[:, 8:] += 12 * label[:, None]  # the first eight components say nothing
    rows = [(i + 7000, [float(x) for x in v[i]]) for i in range(600)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id - 7000: r.z for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert set(got) == set(range(600))
    most = sum(max(sum(got[i] == z and label[i] == y for i in got) for y in (0, 1)) for z in set(got.values()))
    assert most >= 0.98 * 600 and len(set(got.values())) > 1
