"""Models, layers, training and communities against brute force on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.graph import TemporalGraph
from loomgraph.operators import clustering as C
from loomgraph.operators import communities as L
from loomgraph.operators import embeddings as E
from loomgraph.operators import models as D
from loomgraph.operators import relational as R
from loomgraph.operators import sampling as S
from loomgraph.operators import training as G
from loomgraph.operators import transforms as X
from loomgraph.sources import formats as FM


def blocks(k=3, size=12, seed=0):
    """Edges of k dense groups with a few between them."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(k * size):
        for j in range(i):
            if rng.random() < (0.7 if i // size == j // size else 0.02):
                out.append((i, j))
    return out


def test_louvain_finds_planted_groups(spark):
    edges = blocks()
    e = spark.createDataFrame(edges, "src long, dst long")
    n = spark.createDataFrame([(i,) for i in range(37)], "id long")
    got = {r.id: r.label for r in L.louvain(n, e).collect()}
    assert len(got) == 37 and got[36] == 36
    assert len({got[i] for i in range(36)}) == 3 and all(len({got[g * 12 + i] for i in range(12)}) == 1 for g in range(3))


def test_local_moves_raise_modularity(spark):
    edges = sorted({tuple(sorted(e)) for e in blocks(4, 10, 3)})
    e = spark.createDataFrame(edges, "src long, dst long")
    both = L.weighted(e)
    m = len(edges)
    k = np.zeros(40)
    for a, b in edges:
        k[a] += 1
        k[b] += 1

    def modularity(z):
        inside = sum(z[a] == z[b] for a, b in edges) / m
        return inside - sum((sum(k[i] for i in z if z[i] == c) / (2 * m)) ** 2 for c in set(z.values()))

    before = modularity({i: i for i in range(40)})
    for rounds in (1, 3):
        z = {r.id: r.label for r in L.local_moves(both, rounds).collect()}
        after = modularity(z)
        assert after > before
        before = after


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    s, p, n = rng.normal(size=(3, 7, 5))
    w = rng.normal(size=(3, 5))
    for objective in ("skipgram", "hinge"):
        how = G.Train(objective=objective)
        _, g = G.loss_and_gradient(w, s, p, n, how)
        for i in range(3):
            for j in range(5):
                step = np.zeros_like(w)
                step[i, j] = 1e-6
                slope = (G.loss_and_gradient(w + step, s, p, n, how)[0] - G.loss_and_gradient(w - step, s, p, n, how)[0]) / 2e-6
                assert slope == pytest.approx(g[i, j], rel=1e-4, abs=1e-5)


def test_training_pulls_groups_together(spark):
    edges = [(a, b) for a, b in blocks(2, 15, 5)]
    e = spark.createDataFrame(edges + [(b, a) for a, b in edges], "src long, dst long")
    n = spark.createDataFrame([(i,) for i in range(30)], "id long")
    f = G.hop_features(e, E.seeded_vectors(n, 8).select("id", F.transform("z", lambda x: x * 8).alias("z")), 2)
    rows = G.triples(e, f, 30).persist()
    fitted = G.fit(rows, G.Train(dim=4, epochs=40, rate=0.1))
    assert fitted.best < fitted.history[0]["loss"] * 0.95 and all(h["seconds"] >= 0 for h in fitted.history)
    z = {r.id: np.array(r.z) for r in G.embed(f, fitted).collect()}
    near = np.mean([z[a] @ z[b] for a, b in edges if a // 15 == b // 15])
    far = np.mean([z[a] @ z[b] for a in range(15) for b in range(15, 30)])
    assert near > far


def test_rate_falls_and_training_stops(spark):
    flat = spark.createDataFrame([([0.0, 0.0], [0.0, 0.0], [0.0, 0.0])], "s array<double>, p array<double>, n array<double>")
    h = G.fit(flat, G.Train(epochs=30, stop=8, patience=3)).history
    assert len(h) == 9 and h[-1]["rate"] < h[0]["rate"] / 4


def test_end_to_end_keeps_every_node(spark):
    edges = blocks(2, 10, 8)
    e = spark.createDataFrame(edges + [(b, a) for a, b in edges], "src long, dst long")
    n = spark.createDataFrame([(i,) for i in range(20)], "id long")
    f = G.hop_features(e, E.seeded_vectors(n, 4), 1)
    cluster = lambda z: z.select("id", (F.col("id") % 2).cast("int").alias("c"), F.array_repeat(F.lit(0.1), 3).alias("centre"))
    model, out = G.end_to_end(f, G.triples(e, f, 20).persist(), G.Train(dim=3, epochs=2, cluster_weight=0.5), cluster)
    assert out.count() == 20 and len(model.history) == 4


def brute_hgt(rel, x, key, query, value, heads, gate):
    out = {}
    for t in {d for _, _, d in rel}:
        for i, z in x[t].items():
            scores = []
            for (s, _, d), edges in rel.items():
                if d == t:
                    for a, b in sorted(set(edges)):
                        if b == i:
                            k, q, v = (np.array(m) @ u for m, u in ((key[s], x[s][a]), (query[t], z), (value[s], x[s][a])))
                            n = len(k) // heads
                            scores.append([(q[h * n : h * n + n] @ k[h * n : h * n + n] / np.sqrt(n), v[h * n : h * n + n]) for h in range(heads)])
            if not scores:
                out[t, i] = z
                continue
            parts = []
            for h in range(heads):
                w = np.exp([r[h][0] for r in scores])
                parts.append(sum(a * r[h][1] for a, r in zip(w, scores)) / w.sum())
            m = np.concatenate(parts)
            u = 1 / (1 + np.exp(-(np.array(gate) @ np.concatenate([m, z]))))
            out[t, i] = u * z + (1 - u) * m
    return out


def test_hgt_layer(spark):
    rng = np.random.default_rng(2)
    x = {"A": {i: rng.normal(size=4) for i in range(6)}, "B": {i: rng.normal(size=4) for i in range(5)}}
    rel = {("A", "to", "B"): [(int(a), int(b)) for a, b in rng.integers(0, 4, (12, 2))], ("B", "to", "B"): [(0, 1), (2, 1), (4, 3)]}
    w = [{t: D.seeded_matrix(4, 4, 5 * k + j) for j, t in enumerate("AB")} for k in range(3)]
    gate = D.seeded_matrix(4, 8, 99)
    frames = {t: spark.createDataFrame([(i, z.tolist()) for i, z in v.items()], "id long, z array<double>") for t, v in x.items()}
    edges = {k: spark.createDataFrame(v, "src long, dst long") for k, v in rel.items()}
    got = {("B", r.id): np.array(r.z) for r in D.hgt_layer(edges, frames, *w, 2, gate=gate)["B"].collect()}
    want = brute_hgt(rel, x, *w, 2, gate)
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_sage_layer_sums_relations(spark):
    x = {"A": spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "id long, z array<double>"), "B": spark.createDataFrame([(0, [1.0, -1.0]), (1, [0.0, -4.0])], "id long, z array<double>")}
    one = spark.createDataFrame([(0, 0), (1, 0)], "src long, dst long")
    two = spark.createDataFrame([(1, 0)], "src long, dst long")
    eye = [[1.0, 0.0], [0.0, 1.0]]
    got = {r.id: r.z for r in D.sage_layer({("A", "r", "B"): one, ("B", "s", "B"): two}, x, eye, eye)["B"].collect()}
    assert np.allclose(got[0], [2 * 1 + 2 + 0, 0.01 * (2 * -1 + 3 - 4)]) and np.allclose(got[1], [0.0, 0.01 * -8.0])


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    for x in (rng.integers(0, 50, 500).tolist(), [7], [1, 2], rng.normal(size=333).tolist()):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(5)
        shares = [0.0, 0.025, 0.5, 0.9, 0.975, 1.0]
        assert R.quantiles(df, "v", shares) == pytest.approx(np.quantile(x, shares).tolist())
    assert R.quantiles(df.limit(0), "v", [0.5]) is None


def test_inductive_nodes_number_each_phase(spark):
    n = X.split_masks(spark.createDataFrame([(i,) for i in range(100)], "id long"), ["id"])
    kind = {r.id: 0 if r.train_mask else 1 if r.val_mask else 2 for r in n.collect()}
    got = {(r.phase, r.id): r.new_id for r in X.inductive_nodes(n).collect()}
    for k, phase in enumerate(("train", "val", "test")):
        order = sorted((t, i) for i, t in kind.items() if t <= k)
        assert {i: v for (p, i), v in got.items() if p == phase} == {i: j for j, (_, i) in enumerate(order)}


def test_names_that_contain_each_other(spark):
    a = ["ab", "Steel Rod", "x", "none", "rod", ""]
    b = ["a steel rod of iron", "AB", "od", "xylophone", "zz"]
    left, right = (spark.createDataFrame([(v,) for v in vs], f"{c} string") for vs, c in ((a, "l"), (b, "r")))
    got = {(r.l, r.r) for r in R.containing(left, right, "l", "r").collect()}
    assert got == {(x, y) for x in a for y in b if x and (x.lower() in y.lower() or y.lower() in x.lower())}


def test_fuzzy_match_by_blocks(spark):
    from loomgraph.functions.text import jaro_winkler_one

    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcde"), 6))
    a, b = sorted({word() for _ in range(30)}), sorted({word() for _ in range(40)})
    left, right = (spark.createDataFrame([(v,) for v in vs], f"{c} string") for vs, c in ((a, "l"), (b, "r")))
    got = {r.l: r.r for r in R.fuzzy_match(left, right, "l", "r", block=7).collect()}
    for x in a:
        near = [y for y in b if x in y or y in x] or b
        assert got[x] == min(near, key=lambda y: (-jaro_winkler_one(x, y), y))


def test_silhouette_by_blocks(spark):
    from loomgraph.functions.vectors import Metric
    from loomgraph.operators.metrics import silhouette

    rng = np.random.default_rng(5)
    x, label = rng.normal(size=(60, 3)), rng.integers(0, 3, 60)
    df = spark.createDataFrame([(i, int(z), v.tolist()) for i, (z, v) in enumerate(zip(label, x))], "vec_id long, label int, embedding array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(60):
        own = [d[i, j] for j in range(60) if j != i and label[j] == label[i]]
        other = [np.mean([d[i, j] for j in range(60) if label[j] == c]) for c in set(label) - {label[i]}]
        a, b = np.mean(own), min(other)
        s.append((b - a) / max(a, b))
    for block in (1000, 13):
        assert silhouette(df, block=block).first()[0] == pytest.approx(np.mean(s))
    assert silhouette(df.withColumn("label", F.lit(1))).first()[0] == 0.0
    assert -1 <= silhouette(df, metric=Metric.COSINE).first()[0] <= 1


def test_nearest_labels_by_blocks(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(i % 3), (rng.normal(size=4) + 3 * np.eye(4)[i % 3]).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    a, b = df.where("vec_id < 20"), df.where("vec_id >= 20")
    got = {r.vec_id: r.predicted for r in E.nearest_labels(a, b, 5, block=9).collect()}
    assert got == {r.vec_id: r.predicted for r in E.nearest_labels(a, b, 5).collect()} and sum(got[i] == i % 3 for i in range(20)) >= 18


def test_kmeans_1d_centres_come_back_to_the_space(spark):
    axis = np.array([3.0, 4.0]) / 5
    rows = [(i, (np.array([10.0, -2.0]) + axis * (20 * (i % 2) + (i % 5) * 0.1)).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(C.kmeans_1d_centres(df, 2))
    want = sorted([np.mean([v for i, v in rows if i % 2 == k], axis=0).tolist() for k in (0, 1)])
    assert np.allclose(got, want)
    z = {r.vec_id: r.z for r in C.initial_assignment(df, 2, "kmeans1d").collect()}
    assert len({z[i] for i in range(0, 60, 2)}) == 1 and z[0] != z[1]
    with pytest.raises(ValueError):
        C.initial_assignment(df, 2, "guess")


def test_mixture_starts_and_bounds(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(80, 2)), rng.normal(size=(80, 2)) + 8])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    seen = []
    start = C.initial_assignment(df, 2, "kmeans")
    model = C.fit_dpmm(df, p=C.Params(rounds=4), mutate=False, start_from=start, on_round=lambda k, m, b: seen.append((k, b)))
    assert len(seen) >= 2 and seen[-1][1] >= seen[0][1] - 1e-9
    z = np.array([r.z for r in C.assign(df, model).orderBy("vec_id").collect()])
    assert len(set(z[:80])) == len(set(z[80:])) == 1 and z[0] != z[-1]
    prior = C.WishartPrior(x.mean(0), 1.0, 4.0, np.eye(2))
    whole = C.Stats(np.array([160.0]), x.mean(0)[None], np.cov(x.T, bias=True)[None])
    halves = C.Stats(np.array([80.0, 80.0]), np.array([x[:80].mean(0), x[80:].mean(0)]), np.array([np.cov(x[:80].T, bias=True), np.cov(x[80:].T, bias=True)]))
    assert C.lower_bound(prior, C.DirichletPrior(1.0), halves) > C.lower_bound(prior, C.DirichletPrior(1.0), whole)


def test_log_density_equals_the_formula():
    rng = np.random.default_rng(8)
    x, mean = rng.normal(size=(9, 3)), rng.normal(size=(2, 3))
    cov = np.array([a @ a.T + np.eye(3) for a in rng.normal(size=(2, 3, 3))])
    got = C.log_density(x, mean, cov)
    for k in range(2):
        gap = x - mean[k]
        want = -0.5 * ((gap @ np.linalg.inv(cov[k])) * gap).sum(1) - 0.5 * np.linalg.slogdet(2 * np.pi * cov[k])[1]
        assert np.allclose(got[:, k], want)


def test_marginal_is_the_chain_of_predictions():
    """The marginal of points is the product of each one's predictive density: the sum over orders must agree."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6, 2))
    prior = C.WishartPrior(np.zeros(2), 1.5, 5.0, np.eye(2) * 2)
    stats = lambda v: C.Stats(np.array([float(len(v))]), v.mean(0)[None], np.cov(v.T, bias=True).reshape(1, 2, 2) if len(v) > 1 else np.zeros((1, 2, 2)))
    total = prior.marginal(stats(x))[0]
    for order in ([0, 1, 2, 3, 4, 5], [5, 3, 1, 0, 2, 4]):
        at, chain = np.array(order), 0.0
        for k in range(1, 7):
            chain += prior.marginal(stats(x[at[:k]]))[0] - (prior.marginal(stats(x[at[: k - 1]]))[0] if k > 1 else 0.0)
        assert chain == pytest.approx(total)


def test_batches_are_full_and_shuffled(spark):
    df = spark.createDataFrame([(i,) for i in range(100)], "id long").repartition(4)
    rows = S.batches(df, 30, "id").collect()
    assert sorted(r.place for r in rows) == list(range(100)) and sorted(sum(r.batch == b for r in rows) for b in range(4)) == [10, 30, 30, 30]
    assert [r.id for r in sorted(rows, key=lambda r: r.place)] != sorted(r.id for r in rows)
    assert [r.id for r in S.batches(df, 30, "id", shuffle=False).orderBy("place").collect()] == list(range(100))


def test_annealing_and_dropout(spark):
    assert D.anneal(0.1, 0.001, 0, 10) == 0.1 and D.anneal(0.1, 0.001, 10, 10) == pytest.approx(0.001) and D.anneal(0.1, 0.001, 5, 10) == pytest.approx(0.01)
    n = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(400)], "id long, x array<double>")
    z = D.hybrid_input(n, [[1.0, 0.0], [0.0, 1.0]], E.seeded_vectors(n.select("id"), 2), dropout=0.25).select(F.explode("z").alias("v")).groupBy("v").count().collect()
    share = {round(r.v, 3): r["count"] / 800 for r in z}
    assert set(share) == {0.0, round(1 / 0.75, 3)} and 0.18 < share[0.0] < 0.32


def test_graphml_and_config(spark, tmp_path):
    import xml.etree.ElementTree as ET

    n = spark.createDataFrame([(i,) for i in range(3)], "id long")
    e = spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long")
    assert FM.write_graphml(TemporalGraph({"A": n}, {("A", "to", "A"): e}), str(tmp_path / "g"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "g"), wholetext=True).collect())
    root = ET.fromstring(text)
    assert len(root.findall(".//{*}node")) == 3 and len(root.findall(".//{*}edge")) == 2
    FM.write_config(spark, str(tmp_path / "c"), rate=0.1, name="x", layers=[1, 2])
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "c")).collect()) == ["layers: [1, 2]", 'name: "x"', "rate: 0.1"]
    FM.write_npy(spark, str(tmp_path / "r" / "embeddings.npy"), np.arange(6.0).reshape(3, 2))
    z, a, m = FM.external_results(spark, str(tmp_path / "r"))
    assert sorted((r.id, r.z) for r in z.collect()) == [(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, 5.0])] and a is None and m is None
    with pytest.raises(ValueError):
        FM.external_results(spark, str(tmp_path / "c"))


def test_saved_models_come_back(spark, tmp_path):
    fitted = G.Fitted([[0.5, -1.0]], [{"epoch": 1, "loss": 2.0, "rate": 0.1, "seconds": 0.01}])
    G.save(spark, str(tmp_path / "m"), fitted)
    assert G.load(spark, str(tmp_path / "m")) == fitted and G.log(spark, fitted).count() == 1


def test_encoders_see_no_null(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "id long, t string")
    got = {r.id: r.z for r in E.encoded(df, "t", lambda texts: [(len(t),) for t in texts]).collect()}
    assert got == {1: [2.0], 2: None, 3: [0.0]}


def test_plane_keeps_the_widest_directions(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(200, 5)) * np.array([9, 5, 0.1, 0.1, 0.1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = np.array([(r.x, r.y) for r in C.plane(df).orderBy("vec_id").collect()])
    assert abs(np.corrcoef(got[:, 0], x[:, 0])[0, 1]) > 0.99 and abs(np.corrcoef(got[:, 1], x[:, 1])[0, 1]) > 0.99


def test_mixture_splits_uneven_clusters(spark):
    """A small far group beside a large one: a cut through the mean would divide the large one."""
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=(400, 2)), rng.normal(size=(40, 2)) * 0.3 + np.array([9.0, 0])])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    model = C.fit_dpmm(df, p=C.Params(clusters=1, rounds=12))
    z = np.array([r.z for r in C.assign(df, model).orderBy("vec_id").collect()])
    assert len(set(z[400:])) == 1 and (z[:400] == z[400]).mean() < 0.02
