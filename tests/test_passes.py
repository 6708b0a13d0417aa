"""Blocks of rows, passes over them, and what a fit reads a pass."""

import os
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gradus.models import classifiers as CL
from gradus.models import joint, kernel, network, passes


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(3000, 6)) @ np.diag([1, 1, 1, 1, 100, 0.01])
    X[:, 3] = X[:, 2] + 0.05 * X[:, 3]  # nearly dependent columns
    y = np.digitize(X[:, 0] + 2 * X[:, 2] + rng.normal(size=3000), [-1.5, 0.5, 2.0])
    rows = [(int(c), [float(v) for v in r]) for c, r in zip(y, X)]
    df = spark.createDataFrame(rows, "label int, x array<double>").repartition(5)
    return df.select("label", array_to_vector("x").alias("features")).cache()


def test_blocks_hold_the_rows_of_one_value(spark):
    df = spark.range(5000).select((F.col("id") % 3 - 1).cast("int").alias("part"), "id",
                                  F.array(F.col("id").cast("double")).alias("x"))
    blocks = passes.packed(df, by="part")
    assert blocks.rdd.getNumPartitions() >= 1 and blocks.count() < 100
    for v in (-1, 0, 1, 7):
        def ids(batches):
            out = np.zeros(2)
            for b in batches:
                assert set(b.column("part").to_pylist()) == {v} and b.num_rows <= passes.BLOCK
                assert (passes.matrix(b.column("x"))[:, 0] == b.column("id").to_numpy()).all()
                out += b.num_rows, b.column("id").to_numpy().sum()
            return out
        own = [i for i in range(5000) if i % 3 - 1 == v]
        assert passes.summed(blocks.where(F.col("part") == v), 2, ids).tolist() == [len(own), sum(own)]


def test_short_and_long_vectors_and_columns(spark):
    rows = passes.packed(spark.range(100).repartition(7))
    for size in (10, passes.SHORT + 10):
        got = passes.summed(rows, size, lambda bs, n=size: sum((np.arange(n) * float(b.num_rows) for b in bs), np.zeros(n)))
        assert (got == np.arange(size) * 100.0).all()
    X = np.arange(12).reshape(4, 3) * 0.5
    assert (passes.matrix(passes.list_column(X).slice(1)) == X[1:]).all()


def test_a_step_of_the_network_reads_its_share_only(made, monkeypatch):
    read, real = [], passes.summed
    def spy(rows, size, sums):
        if "block" in rows.columns:
            read.append(int(real(rows, 1, lambda bs: np.array([sum(b.num_rows for b in bs)], float))[0]))
        return real(rows, size, sums)
    monkeypatch.setattr(network, "summed", spy)
    network.fit(made, 4, [4], max_iter=1)
    steps = read[1:1 + network.SHARES]
    assert len(steps) == network.SHARES and max(steps[1:]) < 3000 / 4 and sum(steps) == 3000


def test_folds_take_few_passes(made):
    folds = made.withColumn("fold", F.pmod(F.xxhash64("features"), F.lit(3)).cast("int"))
    got = joint.logistic_by_folds(folds, 3, 4, max_iter=1000)
    assert got["passes"] <= 20
    # a plain fit of one fold's model is no better
    one = CL.fit_logistic(folds.where("fold <> 0"), 4, 1000).arrays
    rows = folds.where("fold <> 0").collect()
    X, y = np.array([r["features"].toArray() for r in rows]), np.array([r["label"] for r in rows])
    w = (len(y) / (4 * np.bincount(y, minlength=4)))[y]
    def loss(coef, start):
        z = X @ coef.T + start
        z -= np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) + z.max(axis=1, keepdims=True)
        return -(w * z[np.arange(len(y)), y]).sum() + 0.5 * (coef ** 2).sum()
    assert loss(got["coefficients"][0], got["intercepts"][0]) <= loss(one["coefficients"], one["intercepts"]) * (1 + 1e-6)


def test_landmarks_move_no_other_rows(made, monkeypatch):
    """Landmarks are the distinct rows of smallest hash, as a sort of all rows gives them."""
    x = made.select(kernel.vector_to_array("features").alias("x"))
    h = F.xxhash64("x", F.lit(42))
    want = [r["x"] for r in x.select(h.alias("h"), "x").distinct().orderBy("h").limit(20).collect()]
    assert kernel.fit(made, 4, 20, 2)["landmarks"].tolist() == want


def test_forest_tasks_are_bounded(made):
    one = made.coalesce(1)
    assert CL.in_parts(one, 500).rdd.getNumPartitions() == 6 and CL.in_parts(one, 5000).rdd.getNumPartitions() == 1
    sizes = CL.in_parts(one, 500).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) <= 600 and sum(r["count"] for r in sizes) == 3000


def test_stream_input_is_written_by_all_tasks(spark, monkeypatch):
    from gradus.plans import jobs, q_models as Q
    seen = {}
    monkeypatch.setattr(Q.TR, "cached_training", lambda *a, **k: SimpleNamespace(models={}, prepared=SimpleNamespace(feature_model=None)))
    monkeypatch.setattr(jobs, "publish", lambda *a: None)
    monkeypatch.setattr(Q, "_scenarios", lambda s, sf: s.range(0, 900, 1, 9))
    monkeypatch.setattr(Q.SS, "follow_versions", lambda stream, root, *a: seen.update(root=root) or SimpleNamespace(awaitTermination=lambda: None))
    monkeypatch.setattr(Q.SS, "scored", lambda s, out: s.range(1).select(F.lit(0).alias("batch"), F.lit("").alias("version")))
    Q.q_score_stream(spark, "")
    inbox = os.path.join(os.path.dirname(seen["root"]), "inbox").removeprefix("file:")
    assert len([f for f in os.listdir(inbox) if f.startswith("part-")]) == 9


def test_a_forest_counts_its_classes_before_it_deals_rows_out(made, monkeypatch):
    dealt, plain = [], CL.in_parts
    monkeypatch.setattr(CL, "in_parts", lambda d, *a: dealt.append(plain(d, 500)) or dealt[-1])
    CL.fit_random_forest(made, 4, True, 2, 2)
    assert len(dealt) == 1 and "weight" in dealt[0].columns and dealt[0].count() == 3000


def test_blocks_are_read_a_few_at_a_time(spark):
    import pyarrow.parquet as pq
    from gradus.models import passes
    from gradus.session import BATCH_BYTES, small_batches
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        rows = spark.range(0, 50 * passes.BLOCK, 1, 1).selectExpr("id % 2 y", "array(double(id), 1D) x")
        blocks = passes.packed(rows)
        assert spark.conf.get(key) == f"{BATCH_BYTES}b"
        one = passes._grouped(blocks.coalesce(1))
        for df in (blocks, one):
            groups = [g for f in df.inputFiles() for m in [pq.read_metadata(f.removeprefix("file:"))]
                      for g in (m.row_group(i).num_rows for i in range(m.num_row_groups))]
            assert sum(groups) == blocks.count() and max(groups) <= passes.GROUP
        assert len(groups) > 1
        assert passes.summed(one, 1, lambda batches: np.array([sum(b.num_rows for b in batches)], float))[0] == 50 * passes.BLOCK
        spark.conf.set(key, "4k")
        small_batches(rows)
        assert spark.conf.get(key) == "4k"
    finally:
        spark.conf.set(key, before)


def test_vectors_are_the_same_collected_and_added_by_spark(spark, monkeypatch):
    rows = passes.packed(spark.range(1000).repartition(5))
    size = passes.SHORT + 7
    add = lambda batches: sum((np.bincount(b.column("id").to_numpy() % size, minlength=size) for b in batches), np.zeros(size))
    def jobs(df):
        plans, real = [], type(df).toArrow
        monkeypatch.setattr(type(df), "toArrow", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or real(self))
        got = passes.summed(df, size, add)
        monkeypatch.setattr(type(df), "toArrow", real)
        return got, plans
    one, (plan,) = jobs(rows)
    assert "Exchange" not in plan  # one stage for all that the driver can add
    monkeypatch.setattr(passes, "COLLECTED", size)
    two, (plan,) = jobs(rows)
    assert "Exchange" in plan
    assert (one == two).all() and one.sum() == 1000
    assert passes.summed(rows.where("false"), size, add).sum() == 0


def test_forest_tasks_hold_fewer_rows_of_more_trees():
    assert CL.forest_rows(1) == CL.forest_rows(20) == CL.FOREST_ROWS
    size = lambda trees: CL.forest_rows(trees) * (220 + 4 * trees)
    assert size(500) <= size(20)
