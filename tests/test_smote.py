"""Nearest neighbours by cells: exact, bounded groups, fewer comparisons than all pairs."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from gradus.operators import smote as SM


def _points(spark, groups):
    rows = [(c, 10 * i + c, [float(v) for v in x]) for c, X in groups.items() for i, x in enumerate(X)]
    return spark.createDataFrame(rows, "cls int, rid long, x array<double>").repartition(5)


def _check(spark, groups, k, block):
    nn, ranked = SM.knn_within_class(_points(spark, groups), k, block)
    x = {(r["cls"], r["rank"]): np.array(r["x"]) for r in ranked.collect()}
    found = nn.collect()
    assert len(found) == len(x) == sum(map(len, groups.values()))
    for r in found:
        X = np.array([x[r["cls"], i + 1] for i in range(len(groups[r["cls"]]))])
        d = np.sqrt(((X - X[r["rank"] - 1]) ** 2).sum(axis=1))
        assert r["rank"] not in r["nn"] and len(set(r["nn"])) == min(k, len(X) - 1)
        want = np.sort(np.delete(d, r["rank"] - 1))[:k]
        assert np.allclose(np.sort(d[np.array(r["nn"], int) - 1]), want, rtol=0, atol=1e-9)
    return {c: sum(r["seen"] for r in found if r["cls"] == c) for c in groups}


def test_neighbours_of_equal_lumped_and_scattered_rows(spark):
    rng = np.random.default_rng(1)
    lumps = np.repeat(rng.normal(size=(7, 3)), 60, axis=0)
    mixed = np.concatenate([np.zeros((300, 3)), rng.integers(0, 2, (200, 3)), rng.normal(size=(90, 3)) * 1000 + 1e6])
    _check(spark, {0: lumps, 1: mixed, 2: rng.normal(size=(4, 3)), 3: np.ones((150, 3))}, 5, 32)


def test_comparisons_grow_slower_than_pairs(spark):
    rng = np.random.default_rng(2)
    seen = _check(spark, {0: rng.uniform(size=(400, 2)), 1: rng.uniform(size=(1600, 2))}, 5, 40)
    assert seen[1] / seen[0] < 8  # all pairs: 16
    assert seen[1] < 0.2 * 1600 ** 2


def test_cells_stay_small_and_cover_all_rows(spark):
    rng = np.random.default_rng(3)
    X = np.concatenate([rng.normal(size=(3000, 4)), np.zeros((3000, 4))])
    rows = spark.createDataFrame([(0, i + 1, [float(v) for v in x]) for i, x in enumerate(X)], "cls int, rank long, x array<double>")
    cells, passes = SM._cells(rows, 50, 7)
    sizes = [r["count"] for r in cells.groupBy("cls", "cell").count().collect()]
    assert sum(sizes) == 6000 and max(sizes) <= 50 and passes >= 2


def test_visitors_of_a_cell_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(SM, "VISITORS", 8)
    rng = np.random.default_rng(4)
    _check(spark, {0: rng.normal(size=(200, 3))}, 3, 16)


def test_cuts_separate_the_sample():
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"cls": 0, "cell": 1, "n": 1000, "x": list(rng.integers(0, 3, (500, 2)).astype(float))})
    tree = SM._subtree(pdf, 100).iloc[0]
    assert not tree["alike"] and set(tree["dims"]) <= {-1, 0, 1}
    assert SM._subtree(pdf.assign(x=[np.zeros(2)] * 500), 100).iloc[0]["alike"]


def test_draws_do_not_depend_on_partitions(spark):
    from pyspark.ml.functions import array_to_vector
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, float(i % 9 == 0), [float(v) for v in rng.normal(size=3)]) for i in range(400)],
                               "id long, label double, x array<double>").withColumn("features", array_to_vector("x"))
    runs = [sorted(map(str, SM.smote(df.repartition(n), id_col="id", block=16).where("synthetic").select("label", "features").collect()))
            for n in (1, 6)]
    assert runs[0] == runs[1] and len(runs[0]) == 355 - 45
    assert df.where(F.col("label") == 1).count() == 45


def test_visits_are_the_boxes_inside_the_ball():
    rng = np.random.default_rng(7)
    X, centre = rng.normal(size=(150, 3)), rng.normal(size=(1100, 3))
    lo, hi, r2 = centre - 0.1, centre + 0.1, np.append(np.zeros(1), rng.uniform(0, 0.5, 149))
    rows = pa.table({"cls": pa.array([1] * 150, pa.int32()), "own": [3] * 150, "rank": range(150), "x": X.tolist(), "r2": r2})
    boxes = pa.table({"cls": pa.array([1] * 1100, pa.int32()), "own": [3] * 1100, "box": range(1100), "lo": lo.tolist(), "hi": hi.tolist()})
    got = SM._touched(rows, boxes)
    apart = np.maximum(np.maximum(lo[None] - X[:, None], X[:, None] - hi[None]), 0)
    want = {(i, j) for i, j in zip(*np.nonzero((apart ** 2).sum(axis=2) < r2[:, None]))}
    assert set(zip(got["rank"].to_pylist(), got["cell"].to_pylist())) == want and len(want) == got.num_rows > 0
    assert SM._touched(rows, boxes.slice(0, 0)).num_rows == 0


def test_a_visit_finds_what_all_distances_name():
    rng = np.random.default_rng(8)
    X = np.round(rng.normal(size=(90, 4)), 1) + 1e6  # far from 0: a matrix product alone would lose digits
    Q, r2 = np.concatenate([X[:20], X[:20] + 0.1]), rng.uniform(0, 2, 40)
    cell = pa.table({"rank": range(90), "x": X.tolist()})
    found = SM._visit(pa.table({"cls": pa.array([2] * 40, pa.int32()), "rank": range(100, 140), "x": Q.tolist(), "r2": r2}), cell, 5)
    d = np.sqrt(((Q[:, None] - X[None]) ** 2).sum(axis=2))
    for row, near, most in zip(d, found["near"].to_pylist(), r2):
        want = np.sort(row[row ** 2 < most])[:5]
        assert np.allclose([n["d"] for n in near], want, rtol=0, atol=1e-9)
        assert all(row[n["rank"]] == n["d"] for n in near)
