"""Statistics: cross-checks with MLlib and with direct definitions."""

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import functions as F

from gradus import config as C
from gradus.functions.distributions import chi2_sf, erfc
from gradus.operators import stats as ST
from gradus.plans.fixtures import incidents


def test_chi2_tail_known_values(spark):
    import math
    known = [(3.841458820694124, 1, 0.05), (16.918977604620448, 9, 0.05), (0.0, 3, 1.0), (-1e-18, 4, 1.0),
             (9.487729036781154, 4, 0.05), (27.877164871256568, 9, 0.001), (7.879438576622417, 1, 0.005),
             (0.003932140000019522, 1, 0.95), (2000.0, 2000, 0.4957950), (1000.0, 999, 0.4851574)]
    rows = spark.createDataFrame([(float(x), k, p) for x, k, p in known] + [(5.0, 0, None), (None, 3, None), (float("nan"), 3, None)],
                                 "x double, k int, p double").select("*", chi2_sf(F.col("x"), F.col("k")).alias("got")).collect()
    for r in rows:
        assert (r["got"] is None) == (r["p"] is None)
        assert r["p"] is None or r["got"] == pytest.approx(r["p"], rel=1e-6 if r["k"] < 100 else 2e-3)
    # recurrence Q(k + 2) = Q(k) + (x/2)^(k/2) exp(-x/2) / Gamma(k/2 + 1), and erfc itself
    grid = spark.createDataFrame([(x / 7, k) for x in range(1, 700, 13) for k in range(1, 12)], "x double, k int").select(
        "x", "k", chi2_sf(F.col("x"), F.col("k")).alias("a"), chi2_sf(F.col("x"), F.col("k") + 2).alias("b"),
        erfc(F.sqrt(F.col("x") / 2)).alias("e")).collect()
    for r in grid:
        step = math.exp(r["k"] / 2 * math.log(r["x"] / 2) - r["x"] / 2 - math.lgamma(r["k"] / 2 + 1))
        assert r["b"] == pytest.approx(r["a"] + step, rel=1e-9)
        assert r["e"] == pytest.approx(math.erfc(math.sqrt(r["x"] / 2)), rel=1e-9)


def test_p_values_need_no_python_worker(spark, sf_small):
    from gradus.plans.fixtures import incidents
    out = ST.chi_square(incidents(spark, sf_small), ["weather"], "severity")
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_yates_on_two_by_two(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 5
    df = spark.createDataFrame(rows, "v string, s string")
    r = ST.chi_square(df, ["v"], "s").first()
    assert r["df"] == 1
    # with Yates' correction (without it the statistic is 18.7262)
    assert r["Chi2"] == pytest.approx(16.578482142857, rel=1e-9)


def test_chi_square_matches_mllib_when_dof_above_one(spark, sf_small):
    inc = incidents(spark, sf_small)
    ours = {r["Variable"]: r for r in ST.chi_square(inc, ["weather", "crash_with"], "severity").collect()}
    for col in ["weather", "crash_with"]:
        clean = inc.where(F.col(col).isNotNull())
        vals = sorted(r[0] for r in clean.select(col).distinct().collect())
        labs = C.SEVERITY_LABELS
        rows = [(float(vals.index(r[col])), float(labs.index(r["severity"]))) for r in clean.collect()]
        data = spark.createDataFrame([(Vectors.dense([a]), b) for a, b in rows], ["f", "label"])
        ref = ChiSquareTest.test(data, "f", "label").first()
        assert ours[col]["Chi2"] == pytest.approx(ref.statistics[0], rel=1e-6)
        assert ours[col]["df"] == ref.degreesOfFreedom[0]


def test_bayes_equals_direct_share(spark, sf_small):
    inc = incidents(spark, sf_small)
    bt = ST.bayes_table(inc, C.RISK_CONDITIONS[:1], "severity", C.SEVERITY_LABELS).collect()
    night = inc.where(F.col("incident_time") == "Night")
    n = night.count()
    for r in bt:
        direct = night.where(F.col("severity") == r["severity"]).count() / n
        assert r["p_sev_given_cond"] == pytest.approx(direct)


def test_wilson_contains_share(spark, sf_small):
    for r in ST.wilson_interval(incidents(spark, sf_small), "severity", C.SEVERITY_LABELS).collect():
        assert 0.0 <= r["lower"] <= r["p"] <= r["upper"] <= 1.0


def test_any_character_in_names(spark):
    """Apostrophes and dots in labels, levels and conditions."""
    rows = [("St. John's", "it's", float(i % 7), i) for i in range(20)] + [("b", "so.so", float(i % 5), 20 + i) for i in range(30)]
    df = spark.createDataFrame(rows, "place string, label string, x double, id int")
    labels = ["it's", "so.so"]
    assert {r["label"]: r["p"] for r in ST.marginal_prob(df, "label", labels).collect()} == {"it's": 0.4, "so.so": 0.6}
    assert ST.wilson_interval(df, "label", labels).count() == 2
    assert ST.bayes_table(df, [("place", "St. John's", "it's there")], "label", labels).count() == 2
    assert ST.chi_square(df, ["place"], "label").count() == 1
    from gradus.operators import features as FE
    enc, names = FE.one_hot(df, ["place"], drop_first=False)
    got = FE.assemble(enc, names).select("id", "features").collect()
    assert sorted((r["id"] < 20, list(r["features"].toArray())) for r in got) == [(False, [0.0, 1.0])] * 30 + [(True, [1.0, 0.0])] * 20
