"""Behaviour that was repaired on purpose, each on a hand-made case."""

import pytest
from pyspark.sql import functions as F

from loomgraph.graph import TemporalGraph, times
from loomgraph.operators import relational as R
from loomgraph.operators import sampling as S
from loomgraph.operators import temporal as T
from loomgraph.operators import transforms as X
from loomgraph.plans.pipeline import BurnIn, combine_outputs, prepare
from loomgraph.sources import formats


def test_a_column_timestamp_counts_as_start(spark):
    df = spark.createDataFrame([(1, 2, 7), (1, 3, None)], "src long, dst long, timestamp long")
    assert [(r.timestamp_from, r.timestamp_to) for r in times(df).orderBy("dst").collect()] == [(7, 7), (-1, -1)]


def test_large_epochs_keep_their_seconds(spark):
    lo = 1_700_000_001
    t = spark.createDataFrame([(lo,), (lo + 9,)], "ts long")
    assert T.snapshots(t, 2) == [(lo, lo + 5), (lo + 5, lo + 10)]


def test_first_row_by_key_is_the_same_in_any_partitioning(spark):
    df = spark.createDataFrame([(k % 5, k) for k in range(100)], "k long, v long")
    want = sorted(tuple(r) for r in R.first_by(df, ["k"], F.asc("v")).collect())
    assert sorted(tuple(r) for r in R.first_by(df.repartition(7), ["k"], F.asc("v")).collect()) == want == [(k, k) for k in range(5)]


def test_reach_keeps_the_last_node(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src long, dst long")
    assert sorted((r.src, r.dst) for r in S.reach(e, 2).collect()) == [(0, 2), (1, 3)]


def test_nodes_without_times_have_no_partners(spark):
    left = spark.createDataFrame([(9, 1), (10, 50)], "node long, ts long")
    right = spark.createDataFrame([(1, 1)], "node long, ts long")
    assert [(r.node, r.partner) for r in T.window_partners(left, right, (0, 2)).collect()] == [(9, 1)]


def test_validation_passes_messages_on_training_edges_only(spark):
    e = X.split_masks(spark.createDataFrame([(i, i + 1, 0) for i in range(400)], "src long, dst long, timestamp_from long"), ["src"], prefix="lp_")
    g = X.edge_split_graphs(e)
    n = {k: f.count() for k, f in g.items()}
    assert n["train"] == n["val"] < n["test"] < 400


def test_reverse_edges_keep_masks_and_times(spark):
    n = spark.createDataFrame([(i, 10 * i) for i in range(30)], "id long, timestamp_from long")
    e = spark.createDataFrame([(i, (i * 7) % 30, i) for i in range(30)], "src long, dst long, timestamp_from long")
    p = prepare(TemporalGraph({"A": n, "B": n}, {("A", "to", "B"): e}), 3).graph
    a, b = p.edges["A", "to", "B"], p.edges["B", "rev_to", "A"]
    key = lambda df, s, d: sorted((r[s], r[d], r.timestamp_from, r.lp_train_mask, r.lp_val_mask) for r in df.collect())
    assert key(a, "src", "dst") == key(b, "dst", "src")


def test_untimed_stays_untimed_when_times_are_normalised(spark):
    df = spark.createDataFrame([(-1,), (5,), (10,), (100,)], "t long")
    assert [r[0] for r in df.select(X.normalize_times(F.col("t"), (8, 50))).collect()] == [-1, 0, 2, 42]


def test_ties_may_exceed_the_top_share(spark):
    df = spark.createDataFrame([(i, 1) for i in range(10)], "id long, degree long")
    assert X.top_mask(df, "degree", 0.1).where("mask").count() == 10


def test_rare_labels_keep_few_categories(spark):
    df = spark.createDataFrame([(0, ["a", "b"]), (1, ["a"])], "k long, l array<string>")
    assert {r.k: r.l for r in R.rare_labels(df, "k", "l", 0.9).collect()} == {0: ["a", "b"], 1: ["a"]}
    assert {r.k: r.l for r in R.rare_labels(df, "k", "l", 0.5, least_categories=1).collect()} == {0: ["Rare", "a"], 1: ["a"]}


def test_whole_files_and_size_guard(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "m1").write_text("From: a\n\nx\ny")
    got = formats.whole_files(spark, str(tmp_path / "in")).collect()
    assert len(got) == 1 and got[0].message == "From: a\n\nx\ny" and got[0].file.endswith("/deep/m1")
    n = spark.range(3)
    e = spark.createDataFrame([(0, 1)], "src long, dst long")
    assert formats.write_drawing(TemporalGraph({"A": n}, {("A", "to", "A"): e}), str(tmp_path / "out"))
    assert not formats.write_drawing(TemporalGraph({"A": spark.range(30_000)}, {("A", "to", "A"): e}), str(tmp_path / "big"))
    formats.append_run(spark.createDataFrame([("loss", 1.0)], "metric string, value double"), str(tmp_path / "runs"))
    formats.append_run(spark.createDataFrame([("loss", 0.5)], "metric string, value double"), str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2


def test_outputs_are_averaged_and_training_stops(spark):
    a = spark.createDataFrame([(0, [1.0, 2.0])], "id long, z array<double>")
    b = spark.createDataFrame([(0, [3.0, 4.0])], "id long, z array<double>")
    assert combine_outputs(a, b).first().z == [2.0, 3.0]
    stop = BurnIn(patience=2)
    assert [stop.done(v) for v in (1.0, 2.0, 2.0, 2.0)] == [False, False, False, True]


def test_negative_pairs_are_no_edges(spark):
    e = spark.createDataFrame([(i, i % 5) for i in range(50)], "src long, dst long")
    got = S.negative_pairs(e, 50, 5, 40)
    pos = {(i, i % 5) for i in range(50)}
    rows = got.collect()
    assert all(((r.src, r.dst) in pos) == (r.label == 1) for r in rows) and sum(r.label for r in rows) == 40


def test_unknown_metric_raises():
    from loomgraph.functions.vectors import Metric

    with pytest.raises(ValueError):
        Metric("HAMMING")
