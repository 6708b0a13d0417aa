"""Boosting, network, kernel machine and joint fits against plain versions; saving; streams."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from gradus.models import boosting, joint, kernel, network
from gradus.models import classifiers as CL
from gradus.models.importance import permutation_importance, permuted
from gradus.models.ordinal import OrdinalClassifier, OrdinalLogitModel
from gradus.plans import jobs
from gradus.plans import training as TR
from gradus.plans.fixtures import incidents
from gradus.sources.models import load_model, save_model


def _made(n=600, seed=0):
    rng = np.random.default_rng(seed)
    X = np.stack([rng.integers(0, 2, n), rng.integers(0, 5, n), (rng.normal(size=n) * 4).round() / 4, rng.normal(size=n) * 40], axis=1).astype(float)
    y = ((X[:, 0] + X[:, 1] / 2 + (X[:, 2] > 0.3) + (X[:, 3] > 10) + rng.normal(size=n) * 0.3) // 1.3).clip(0, 3).astype(int)
    return X, y


@pytest.fixture(scope="module")
def made(spark):
    X, y = _made()
    df = spark.createDataFrame([(i, int(c), [float(v) for v in x]) for i, (x, c) in enumerate(zip(X, y))], "incident_id long, label int, x array<double>")
    return df.withColumn("features", array_to_vector("x")).drop("x").repartition(3).checkpoint()


def _proba(fitted, df):
    rows = fitted.predict(df).select("incident_id", "p0", "p1", "p2", "p3").orderBy("incident_id").collect()
    return np.array([r[1:] for r in rows])


# ---------------------------------------------------------------- boosting
def _plain_boosting(X, y, rounds, depth, step, k=4):
    """All values are tried as cuts; residuals, gains and leaves as defined."""
    def grow(idx, r, left):
        best = (boosting.LEAST, None, None)
        for j in range(X.shape[1]) if left and len(idx) > 1 else ():
            values = np.unique(X[:, j])
            for cut in (values[1:] + values[:-1]) / 2:
                a, b = r[idx][X[idx, j] <= cut], r[idx][X[idx, j] > cut]
                if len(a) and len(b):
                    gain = len(a) * len(b) / len(idx) * (a.mean() - b.mean()) ** 2
                    if gain > best[0] + 1e-9:
                        best = (gain, j, cut)
        if best[1] is None:
            w = (np.abs(r[idx]) * (1 - np.abs(r[idx]))).sum()
            return (k - 1) / k * r[idx].sum() / w if w > 1e-150 else 0.0
        side = X[idx, best[1]] <= best[2]
        return best[1], best[2], grow(idx[side], r, left - 1), grow(idx[~side], r, left - 1)

    def value(tree, x):
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    S = np.repeat(np.log(np.bincount(y, minlength=k) / len(y))[None, :], len(y), axis=0)
    for _ in range(rounds):
        P = boosting.softmax(S)
        trees = [grow(np.arange(len(y)), (y == c) - P[:, c], depth) for c in range(k)]
        S = S + step * np.array([[value(t, x) for t in trees] for x in X])
    return boosting.softmax(S)


def test_histogram_cuts_are_those_of_a_full_search(spark, made):
    X, y = _made()
    low = made.withColumn("x", vector_to_array("features")).withColumn("features", array_to_vector(F.slice("x", 1, 3))).drop("x")
    got = _proba(CL.fit_gbt(low, 4, rounds=3, depth=3, subsample=1.0), low)
    assert np.allclose(got, _plain_boosting(X[:, :3], y, 3, 3, 0.1), atol=1e-6)


def test_boosting_lowers_the_loss_and_does_not_see_partitions(made):
    a = boosting.fit(made, 4, rounds=12, depth=4)
    b = boosting.fit(made.repartition(7), 4, rounds=12, depth=4)
    assert np.all(np.diff(a["losses"]) < 0)
    assert np.allclose(a["losses"], b["losses"]) and np.array_equal(a["dim"], b["dim"])
    assert boosting.importances(a, 4).sum() == pytest.approx(1.0)


# ----------------------------------------------------------------- network
def test_network_gradient_matches_finite_differences():
    rng = np.random.default_rng(1)
    sizes = [5, 7, 6, 4]
    X, y, w = rng.normal(size=(40, 5)), rng.integers(0, 4, 40), network.first_weights(sizes, 3)
    g, _ = network.gradient(w, sizes, X, y)
    for i in rng.choice(len(w), 40, replace=False):
        e = np.zeros_like(w)
        e[i] = 1e-6
        want = (network.gradient(w + e, sizes, X, y)[1] - network.gradient(w - e, sizes, X, y)[1]) / 2e-6
        assert g[i] == pytest.approx(want, rel=1e-4, abs=1e-6)
    assert not np.any(network.penalty(w, sizes)[-4:])  # intercepts are not penalised


def test_network_stops_on_the_held_out_share(made):
    m = network.fit(made, 4, [16, 8], max_iter=200, rate=0.02)
    assert len(m["held_out"]) < 200  # it stopped early
    best = m["held_out"].argmax()
    assert len(m["held_out"]) - 1 - best <= 2 * network.PATIENCE and m["losses"][0] > m["losses"][-1]
    X, y = _made()
    p = _proba(CL.FittedClassifier("mlp", 4, arrays=m), made)
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == y).mean() > 0.75


# ---------------------------------------------------------- kernel machine
def test_kernel_machine(made):
    X, y = _made()
    scaled = made.withColumn("x", vector_to_array("features")).withColumn(
        "features", array_to_vector(F.transform("x", lambda v, i: v / F.when(i == 3, 40.0).otherwise(1.0)))).drop("x").checkpoint()
    m = kernel.fit(scaled, 4, components=150, max_iter=60)
    assert m["kernel_error"][0] < 0.05
    few = kernel.landmark_map(X[:10], 0.01)
    assert kernel.kernel_error(X[:10], X[:10], few, 0.01) < 1e-4  # exact on the landmarks themselves
    p = _proba(CL.FittedClassifier("svm", 4, arrays=m), scaled)
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == y).mean() > 0.75


def test_margins_for_the_calibration_come_from_unseen_folds():
    import pyarrow as pa
    X, y = _made(60)
    fold = np.arange(60) % 3
    batch = pa.RecordBatch.from_arrays([pa.array(list(X), pa.list_(pa.float64())), pa.array(y, pa.int32()), pa.array(fold, pa.int32())],
                                       names=["x", "y", "fold"])
    out = kernel._hinge(iter([batch]), np.zeros((16, 60)), np.zeros(16), X, 0.1, np.ones(4), 4)
    rows = [(fold != f).sum() for f in range(3) for _ in range(4)] + [60] * 4
    assert np.allclose(out[:16], rows)  # at zero weights every used row costs 1
    G = out[16:16 + 16 * 60].reshape(16, 60)
    for f in range(3):
        own = np.where(fold != f)[0]
        want = -2 * (np.where(y[own] == 1, 1.0, -1.0)[:, None] * kernel.rbf(X[own], X, 0.1)).sum(axis=0)
        assert np.allclose(G[f * 4 + 1], want)


# -------------------------------------------------------------- joint fits
def test_folds_fitted_together_equal_separate_fits(made):
    folds = made.withColumn("fold", F.pmod(F.xxhash64("incident_id"), F.lit(3)).cast("int")).checkpoint()
    three, two = (joint.logistic_by_folds(folds.where(F.col("fold") < n), n, max_iter=300) for n in (3, 2))
    assert three["passes"] < 3 * two["passes"]
    for f in range(3):
        alone = CL.fit_logistic(folds.where(F.col("fold") != f), 4, 1000)
        own = folds.where(F.col("fold") == f)
        pred = alone.predict(own)
        acc = pred.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
        mine = CL.FittedClassifier("lr", 4, arrays={"coefficients": three["coefficients"][f], "intercepts": three["intercepts"][f]})
        assert np.allclose(_proba(mine, own), _proba(alone, own), atol=5e-3)
        assert three["accuracy"][f] == pytest.approx(acc, abs=0.02)


def test_minimise_finds_the_minima_of_all_problems():
    A = [np.diag([1.0, 100.0]), np.diag([3.0, 0.1])]
    to = np.array([[1.0, -2.0], [5.0, 4.0]])

    def evaluate(W):
        r = W - to
        return np.array([0.5 * x @ a @ x for x, a in zip(r, A)]), np.stack([a @ x for x, a in zip(r, A)])

    W, f, passes = joint.minimise(evaluate, np.zeros((2, 2)), 100, 1e-9)
    assert np.allclose(W, to, atol=1e-5) and passes < 60


# -------------------------------------------------------------- importance
def test_permutations_are_bijections_and_values_stay():
    for n in (1, 2, 3, 64, 1001):
        assert sorted(permuted(np.arange(n), n, 11)) == list(range(n))
    a, b = permuted(np.arange(1001), 1001, 1), permuted(np.arange(1001), 1001, 2)
    assert (a == b).mean() < 0.02 and abs(np.corrcoef(np.arange(1001), a)[0, 1]) < 0.1


def test_permutation_importance_of_a_known_model(spark, made):
    """Label = x0: only x0 matters, and its drop is the share of rows that meet another value."""
    df = made.withColumn("label", vector_to_array("features")[0].cast("int"))
    coef = np.zeros((4, 4))
    coef[1, 0] = 10.0
    model = CL.FittedClassifier("lr", 4, arrays={"coefficients": coef, "intercepts": np.array([5.0, 0, -99, -99])})
    got = {r[0]: r[1:] for r in permutation_importance(model, df, list("abcd"), 10, chunk=3).collect()}
    p = df.agg(F.avg("label")).first()[0]
    assert got["a"][0] == pytest.approx(2 * p * (1 - p), abs=0.03) and got["a"][1] > 0
    assert all(got[c] == (0.0, 0.0) for c in "bcd")


# ---------------------------------------------------------- saving, streams
@pytest.fixture(scope="module")
def prepared(spark, sf_small):
    return TR.prepare(spark, incidents(spark, sf_small))


def test_every_kind_of_model_reloads(spark, made, prepared, tmp_path):
    models = {"rf": CL.fit_random_forest(made, 4, True, 3, 3), "lr": CL.fit_logistic(made, 4, 20), "gbt": CL.fit_gbt(made, 4, 2, 2),
              "mlp": CL.fit_mlp(made, 4, [5], 2), "svm": CL.fit_svm(made, 4, 20, 5),
              "olr": OrdinalClassifier(OrdinalLogitModel(np.array([0.1, -0.2, 0.3, 0.0]), np.array([0.5, 1.0, 2.0]), list("abcd"), list("wxyz")))}
    for kind, model in models.items():
        path = str(tmp_path / kind)
        save_model(model, prepared.feature_model, path)
        again, features = load_model(spark, path)
        assert again.kind == kind and features.feature_names == prepared.feature_model.feature_names
        assert np.array_equal(_proba(model, made), _proba(again, made))


def test_a_stream_follows_the_published_version(spark, prepared, sf_small, tmp_path):
    from gradus.operators.features import scenario_encode
    from gradus.sources.incidents import scenario_choices
    from gradus.streaming.scoring import follow_versions, scored
    root, inbox, out = (str(tmp_path / x) for x in ("root", "in", "out"))
    scen = scenario_encode(scenario_choices(incidents(spark, sf_small))).limit(30)
    forests = [CL.fit_random_forest(prepared.train, 4, True, n, 2, seed=n) for n in (1, 3)]
    schema, versions = scen.schema, []

    def run():
        follow_versions(spark.readStream.schema(schema).parquet(inbox), root, out, str(tmp_path / "ck")).awaitTermination()

    scen.write.parquet(inbox)
    with pytest.raises(Exception, match="no version is published"):
        run()
    for forest in forests:
        version, folder = jobs.new_version(root)
        jobs.publish(spark, root, version, folder, {"RF": forest}, prepared.feature_model)
        half, folder = jobs.new_version(root)  # written, but never pointed to
        save_model(forests[0], prepared.feature_model, f"{folder}/models/RF")
        versions.append(version)
        run()
        scen.write.mode("append").parquet(inbox)
    run()
    got = {(r["batch"], r["version"]): r["count"] for r in scored(spark, out).groupBy("batch", "version").count().collect()}
    assert got == {(0, versions[0]): 30, (1, versions[1]): 30, (2, versions[1]): 30}
    # each batch has its own version's scores
    for batch, forest in ((0, forests[0]), (1, forests[1])):
        want = TR.score_corrected(scen, forest, prepared.feature_model, "x").select("incident_id", "p0").collect()
        assert sorted(map(tuple, scored(spark, out).where(F.col("batch") == batch).select("incident_id", "p0").collect())) == sorted(map(tuple, want))


def test_fits_run_side_by_side_and_keep_their_order():
    import threading
    from gradus.plans.training import FITS, _together
    met = threading.Barrier(2, timeout=20)  # one at a time, the first fit would wait in vain
    assert _together([lambda: met.wait() * 0 + 1, lambda: met.wait() * 0 + 2]) == [1, 2] and FITS > 1
    with pytest.raises(ZeroDivisionError):
        _together([lambda: 1 // 0, lambda: 1])
