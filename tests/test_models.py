"""Models: ordinal derivatives and fit, SMOTE neighbours and counts, stream = batch."""

import os

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from gradus.models import ordinal as OL
from gradus.operators.smote import knn_within_class, smote
from gradus.plans import training as TR
from gradus.plans.fixtures import incidents


def test_ordinal_gradient_and_hessian_match_finite_differences():
    rng = np.random.default_rng(0)
    X = rng.normal(size=(200, 3))
    y = rng.integers(0, 4, size=200)
    beta, theta = rng.normal(size=3) * 0.3, np.array([0.5, 1.2, 2.0])
    f, g, H = OL.nll_grad_hess(X, y, beta, theta)
    p0 = np.concatenate([beta, theta])
    eps = 1e-6
    for i in range(len(p0)):
        e = np.zeros_like(p0)
        e[i] = eps
        fp, gp, _ = OL.nll_grad_hess(X, y, (p0 + e)[:3], (p0 + e)[3:])
        fm, gm, _ = OL.nll_grad_hess(X, y, (p0 - e)[:3], (p0 - e)[3:])
        assert g[i] == pytest.approx((fp - fm) / (2 * eps), rel=1e-5, abs=1e-6)
        assert H[:, i] == pytest.approx((gp - gm) / (2 * eps), rel=1e-4, abs=1e-5)


@pytest.fixture(scope="module")
def prepared(spark, sf_small):
    return TR.prepare(spark, incidents(spark, sf_small))


def test_ordinal_fit_lowers_loss_and_probabilities_sum_to_one(spark, prepared):
    model = OL.OrdinalLogit(max_iter=30).fit(prepared.train)
    data = prepared.train.select(vector_to_array("features").alias("x"), "label").collect()
    X = np.array([r["x"] for r in data])
    y = np.array([int(r["label"]) for r in data])
    start = OL.nll_only(X, y, np.zeros(X.shape[1]), np.array([1.0, 2.0, 3.0]))
    assert model.loss <= start
    assert model.thresholds[0] > 0 and np.all(np.diff(model.thresholds) > 0)
    pred = model.transform(prepared.test).select("p0", "p1", "p2", "p3").collect()
    for r in pred:
        assert sum(r) == pytest.approx(1.0)


def test_knn_is_exact(spark, prepared):
    pts = prepared.train.where("label > 0").select(F.col("label").cast("int").alias("cls"),
                                                   F.col("incident_id").alias("rid"),
                                                   vector_to_array("features").alias("x"))
    nn, ranked = knn_within_class(pts, 5, block=8)
    rows = {(r["cls"], r["rank"]): np.array(r["x"]) for r in ranked.collect()}
    for r in nn.collect():
        x = rows[(r["cls"], r["rank"])]
        others = [v for key, v in rows.items() if key[0] == r["cls"] and key != (r["cls"], r["rank"])]
        want = np.sort([np.linalg.norm(v - x) for v in others])[:5]
        got = np.sort([np.linalg.norm(rows[(r["cls"], j)] - x) for j in r["nn"]])
        assert got == pytest.approx(want)


def test_smote_balances_and_stays_in_class_hull(spark, prepared):
    out = smote(prepared.train, id_col="incident_id")
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert len(set(counts.values())) == 1
    arr = out.select("label", "synthetic", vector_to_array("features").alias("x"))
    bounds = {}
    for r in arr.where(~F.col("synthetic")).collect():
        x = np.array(r["x"])
        lo, hi = bounds.get(r["label"], (x, x))
        bounds[r["label"]] = (np.minimum(lo, x), np.maximum(hi, x))
    for r in arr.where(F.col("synthetic")).collect():
        lo, hi = bounds[r["label"]]
        x = np.array(r["x"])
        assert np.all(x >= lo - 1e-9) and np.all(x <= hi + 1e-9)


def test_stream_equals_batch(spark, prepared, tmp_path):
    from gradus.models.classifiers import fit_random_forest
    from gradus.operators.features import scenario_encode
    from gradus.sources.incidents import scenario_choices
    from gradus.sources.models import save_model
    from gradus.streaming.scoring import score_stream, score_stream_once
    from gradus.plans.training import score_corrected
    rf = fit_random_forest(prepared.train, 4, True, 5, 5)
    scen = scenario_encode(scenario_choices(incidents(spark, "/root/testdata/sf0.001")))
    save_model(rf, prepared.feature_model, str(tmp_path / "m"))
    scen.repartition(3).write.parquet(str(tmp_path / "in"))
    streamed = score_stream_once(spark, str(tmp_path / "in"), str(tmp_path / "m"), str(tmp_path / "out"),
                                 str(tmp_path / "ck"))
    batch = score_corrected(scen, rf, prepared.feature_model, "x")
    cols = ["incident_id", "p0", "p1", "p2", "p3", "risk_index", "predicted_class"]
    assert sorted(map(tuple, streamed.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))
    assert os.path.exists(str(tmp_path / "ck"))
    assert score_stream is not None


def test_ordinal_fit_takes_one_pass_a_step_over_packed_rows(spark, monkeypatch):
    rng = np.random.default_rng(9)
    X = rng.normal(size=(600, 3))
    y = np.digitize(X @ [1.0, -0.5, 0.0] + rng.logistic(size=600), [0.5, 1.5, 2.5])
    rows = spark.createDataFrame([(int(v), [float(c) for c in x]) for v, x in zip(y, X)], "label int, x array<double>")
    passes, plain = [], OL.summed
    monkeypatch.setattr(OL, "summed", lambda data, size, sums: passes.append((data.columns, size)) or plain(data, size, sums))
    model = OL.OrdinalLogit(ftol=1e-12).fit(rows.select("label", array_to_vector("x").alias("features")).repartition(3))
    _, g, H = OL.nll_grad_hess(X, y, model.coef, model.thresholds)
    assert np.abs(np.linalg.solve(H, g)).max() < 1e-4
    assert all(columns == ["block"] for columns, _ in passes)
    assert sum(size == 1 + 6 + 36 for _, size in passes) <= model.n_iter + 1 + sum(size == 9 for _, size in passes)


def test_ordinal_fit_counts_rows_it_cannot_use(spark):
    rows = spark.createDataFrame([(0, [1.0]), (None, [1.0]), (1, [float("nan")]), (2, [0.5])], "label int, x array<double>")
    with pytest.raises(ValueError, match="2 training rows"):
        OL.OrdinalLogit().fit(rows.select("label", array_to_vector("x").alias("features")))
