"""Pairs worked on in blocks, against all pairs, and md5 numbers without text against hashlib."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions.hashing import PairNumbers, md5_numbers
from loomgraph.operators import blocks, sampling


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(6)
    e = {(int(a), int(b)) for a, b in zip(rng.integers(-3, 60, 260), rng.integers(-3, 90, 260))} | {(1 << 40, 5), (7, 1 << 40)}
    return e, spark.createDataFrame([*e, *list(e)[:9]], "src long, dst long")


def two(e):
    out = {}
    for a, b in e:
        out.setdefault(a, set()).add(b)
    return {(a, c) for a, b in e for c in out.get(b, ())}


def no_pairs(*_):
    raise AssertionError("pairs are made rows")


def test_khop_pairs_counts_without_pairs(spark, graph, monkeypatch):  # F3
    from loomgraph.plans import QUERIES

    e, frame = graph
    far = {(a, d) for a, c in two(e) for c2, d in e if c == c2}
    want = {}
    for a, _ in far:
        want[a] = want.get(a, 0) + 1
    monkeypatch.setattr(blocks, "BITS_BYTES", 64)
    assert {r.src: r.reached for r in blocks.reach_counts(frame, 3).collect()} == want
    assert blocks.reach_counts(frame.limit(0), 3).count() == 0
    monkeypatch.setattr(sampling, "reach", no_pairs)
    QUERIES["khop_pairs"](spark, "/root/testdata/sf0.001")


def test_context_path_loss_without_pairs(spark, graph, monkeypatch):  # F4
    from loomgraph.plans import QUERIES

    e, frame = graph
    z = {k: np.array([k / 50, 1.0 - k / 90]) for k in range(0, 50, 2)}
    want = [np.log1p(np.exp(-z[a] @ z[b])) for a, b in two(e) if a in z and b in z]
    got = blocks.two_step_loss(frame, spark.createDataFrame([(k, x.tolist()) for k, x in z.items()], "id long, z array<double>")).first()
    assert got.n == len(want) > 50 and got.loss == pytest.approx(sum(want))
    monkeypatch.setattr(sampling, "reach", no_pairs)
    QUERIES["context_path_loss"](spark, "/root/testdata/sf0.001")


def test_context_path_loss_deals_what_has_vectors(spark, graph, monkeypatch):  # F4
    from loomgraph.plans import QUERIES, model_queries

    e, frame = graph
    dealt, read = [], []
    deal, loss = blocks._dealt, blocks.two_step_loss
    monkeypatch.setattr(blocks, "_dealt", lambda rows, n: deal(dealt.append(rows) or rows, n))
    ids = set(range(0, 30, 3))
    blocks.two_step_loss(frame, spark.createDataFrame([(k, [1.0]) for k in ids], "id long, z array<double>")).collect()
    rows = dealt[0].collect()
    assert {(r.node, x) for r in rows if r.side == 0 for x in r.ends} == {(a, b) for a, b in e if a in ids}
    assert {(r.node, x) for r in rows if r.side == 1 for x in r.ends} == {(a, b) for a, b in e if a in ids or b in ids}
    # the interactions are worked out once: what is read again and again was written
    monkeypatch.setattr(model_queries, "two_step_loss", lambda edges, v: loss(read.append(edges) or edges, v))
    QUERIES["context_path_loss"](spark, "/root/testdata/sf0.001").collect()
    assert "Window" not in read[0]._jdf.queryExecution().executedPlan().toString()


def test_khop_dataset_without_pairs(spark, graph, monkeypatch):  # F2
    from loomgraph.plans import QUERIES

    _, frame = graph
    for most in (40, 5000):
        want = sampling.negative_pairs(sampling.within_hops(frame, 2), 50, 80, most)
        assert sorted(map(tuple, sampling.near_pairs(frame, 50, 80, most).collect())) == sorted(map(tuple, want.collect()))
    monkeypatch.setattr(sampling, "within_hops", no_pairs)
    QUERIES["khop_dataset"](spark, "/root/testdata/sf0.001")


def test_combi_embed_without_features_a_pair(spark, graph, monkeypatch):  # F1
    from loomgraph.operators import training
    from loomgraph.plans import QUERIES

    _, frame = graph
    rng = np.random.default_rng(1)
    f = spark.createDataFrame([(k, rng.normal(size=3).tolist()) for k in range(-1, 60, 2)], "id long, f array<double>")
    for objective in ("skipgram", "hinge"):
        how = training.Train(dim=2, epochs=3, objective=objective)
        want = training.fit(training.triples(frame, f, 60), how)
        got = training.fit_pairs(frame, f, 60, how)
        assert np.allclose(got.weight, want.weight) and np.allclose([h["loss"] for h in got.history], [h["loss"] for h in want.history])
    monkeypatch.setattr(training, "HELD_BYTES", 0)
    assert training.fit_pairs(frame, f, 60, how).weight == want.weight
    monkeypatch.undo()
    monkeypatch.setattr(training, "triples", no_pairs)
    assert QUERIES["combi_embed"](spark, "/root/testdata/sf0.001").count() > 0


def test_combi_embed_without_pairs_in_time(spark, monkeypatch):  # F1
    from loomgraph.operators import training
    from loomgraph.operators.temporal import window_partners
    from loomgraph.plans import QUERIES

    rng = np.random.default_rng(2)
    rows = [(int(a), int(b)) for a, b in zip(rng.integers(-3, 70, 400), rng.integers(-9000, 9000, 400))] + [(5, None), (None, 3), (5, 1 << 40), (9, (1 << 40) + 20)]
    t = spark.createDataFrame([*rows, *rows[:9]], "node long, ts long")
    vectors = {k: rng.normal(size=3) for k in range(-1, 65) if k % 7}
    for window in ((0, 60), (-500, 100), (10, 10)):
        near = window_partners(t, t, window).where("node <> partner").select(F.col("node").alias("src"), F.col("partner").alias("dst")).distinct()
        for size, objective in ((0.01, "hinge"), (1.0, "hinge"), (1.0, "skipgram")):  # all within the margin, some, none has one
            f = spark.createDataFrame([(k, (size * x).tolist()) for k, x in vectors.items()], "id long, f array<double>")
            how = training.Train(dim=2, epochs=3, objective=objective)
            if window == (10, 10):
                with pytest.raises(ValueError):
                    training.fit_near(t, window, f, 60, how)
                continue
            want = training.fit(training.triples(near, f, 60), how)
            monkeypatch.setattr(training, "window_partners", no_pairs)
            for together in (1 << 15, 50):
                monkeypatch.setattr(training, "TOGETHER", together)
                got = training.fit_near(t, window, f, 60, how)
                assert np.allclose(got.weight, want.weight) and np.allclose([h["loss"] for h in got.history], [h["loss"] for h in want.history])
            monkeypatch.undo()
            if size == 0.01:
                monkeypatch.setattr(training, "HELD_BYTES", 0)
                assert np.allclose(training.fit_near(t, window, f, 60, how).weight, want.weight)
                monkeypatch.undo()
    for module in ("loomgraph.operators.training", "loomgraph.plans.model_queries"):
        monkeypatch.setattr(f"{module}.window_partners", no_pairs)
    assert QUERIES["combi_embed"](spark, "/root/testdata/sf0.001").count() > 0


def test_combi_embed_gives_what_its_heads_learn(spark, monkeypatch):  # F2
    from loomgraph.operators import training
    from loomgraph.plans import QUERIES

    weights, descended = [], training._descended

    def seen(step, w, how):
        fitted = descended(step, w, how)
        weights.append((w, np.array(fitted.weight)))
        return fitted

    monkeypatch.setattr(training, "_descended", seen)
    made, combined = [], training.combined
    monkeypatch.setattr(training, "combined", lambda f, *rest: made.append(f) or combined(f, *rest))
    got = {r.id: [r[f"z{i}"] for i in range(r.dim)] for r in QUERIES["combi_embed"](spark, "/root/testdata/sf0.001").collect()}
    f = {r.id: np.array(r.f) for r in made[0].collect()}
    assert len(weights) == 2 and all(np.abs(after - before).max() > 0.01 for before, after in weights)
    assert got.keys() == f.keys() and all(np.allclose(z, np.concatenate([after @ f[k] for _, after in weights]), atol=1e-6) for k, z in got.items())


def test_least_loss_counts_however_little_it_is_less():  # training for small steps had no effect
    from loomgraph.operators import training

    target = np.full((1, 2), 0.03)
    fitted = training._descended(lambda w: (1e-7 * float(((w - target) ** 2).sum()), 2e-7 * (w - target)), np.zeros((1, 2)), training.Train(epochs=3))
    losses = [h["loss"] for h in fitted.history]
    assert losses == sorted(losses, reverse=True) and losses[0] - losses[-1] < 1e-6
    assert 1e-7 * float(((np.array(fitted.weight) - target) ** 2).sum()) == losses[-1] < losses[0]


def test_md5_numbers():
    rng = np.random.default_rng(0)
    a = np.concatenate([rng.integers(0, 10**7, 300), rng.integers(0, 20, 300), [0, 9, 10, -5, 10**18]])
    b = np.concatenate([rng.integers(0, 2000, 600), [0, 99, 100, 7, 1 << 62]])
    plain = lambda *k: int(hashlib.md5("|".join(map(str, k)).encode()).hexdigest()[:8], 16)
    assert md5_numbers(a, b, stretch=100).tolist() == [plain(x, y) for x, y in zip(a, b)]
    assert md5_numbers(a, b, tail="neg").tolist() == [plain(x, y, "neg") for x, y in zip(a, b)]


def test_pair_numbers_are_laid_out_once_an_end():  # F2
    rng = np.random.default_rng(4)
    ends = np.unique(np.concatenate([10 ** rng.integers(0, 19, 200) + rng.integers(0, 9, 200), [0, 9, 10, 99, 1 << 62]]))
    src = np.unique(np.concatenate([10 ** rng.integers(0, 19, 60), [0, 7, 12345, 1 << 62]]))
    row, place = rng.integers(0, len(src), 5000), rng.integers(0, len(ends), 5000)
    want = md5_numbers(src[row], ends[place])
    numbers = PairNumbers(ends)
    assert np.array_equal(numbers.of(src, row, place, stretch=64), want) and len(numbers.words) == len({len(str(x)) for x in src.tolist()})
    assert np.array_equal(PairNumbers(ends - 5).of(src, row, place), md5_numbers(src[row], ends[place] - 5))
    for e in (ends, ends - 5):  # F1 of combi_embed: a tail
        assert np.array_equal(PairNumbers(e, "neg").of(src, row, place, stretch=64), md5_numbers(src[row], e[place], tail="neg"))


def test_khop_pairs_deals_a_list_once_a_block(spark, monkeypatch):  # F3
    made = []
    monkeypatch.setattr(blocks, "cut", lambda df: made.append(df.cache()) or made[-1])
    frame = spark.createDataFrame([(a, b) for a in range(20) for b in range(40)], "src long, dst long")
    assert {r.src: r.reached for r in blocks.reach_counts(frame, 1).collect()} == dict.fromkeys(range(20), 40)
    assert made[0].count() == 20
