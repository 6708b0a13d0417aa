"""Correction cases of FIXTURES.md §5 and probability invariants."""

import re

import pytest
from pyspark.sql import functions as F

from gradus.operators import scoring as SC

CASES = [
    # p in, speed, limit, night, wet, dark, bad, airbag -> p0..p3, risk
    ((0.8, 0.1, 0.06, 0.04), 20, 35, (0, 0, 0, 0, 0), (0.800000, 0.100000, 0.060000, 0.040000, 0.340000)),
    ((0.8, 0.1, 0.06, 0.04), 70, 35, (0, 0, 0, 0, 0), (0.613333, 0.165333, 0.134667, 0.086667, 0.694667)),
    ((0.8, 0.1, 0.06, 0.04), 75, 15, (0, 0, 0, 0, 0), (0.240000, 0.296000, 0.284000, 0.180000, 1.404000)),
    ((0.8, 0.1, 0.06, 0.04), 70, 0, (0, 0, 0, 0, 0), (0.613333, 0.165333, 0.134667, 0.086667, 0.694667)),
    ((0.8, 0.1, 0.06, 0.04), 140, 140, (0, 0, 0, 0, 0), (0.381411, 0.069221, 0.217279, 0.332089, 1.500046)),
    ((0.8, 0.1, 0.06, 0.04), 250, 65, (0, 0, 0, 0, 0), (0.040308, 0.142974, 0.402497, 0.414221, 2.190631)),
    ((0.8, 0.1, 0.06, 0.04), 20, 35, (1, 1, 1, 0, 0), (0.600000, 0.160000, 0.140000, 0.100000, 0.740000)),
    ((0.8, 0.1, 0.06, 0.04), 20, 35, (1, 1, 1, 1, 1), (0.320000, 0.244000, 0.252000, 0.184000, 1.300000)),
    ((0.8, 0.1, 0.06, 0.04), 20, 35, (0, 0, 0, 0, 1), (0.550000, 0.225000, 0.147500, 0.077500, 0.752500)),
    ((0.5, 0.2, 0.2, 0.1), 20, 35, (0, 0, 0, 0, 1), (0.500000, 0.200000, 0.200000, 0.100000, 0.900000)),
    ((0.8, 0.1, 0.06, 0.04), 200, 50, (1, 1, 1, 1, 1), (0.014400, 0.154480, 0.415840, 0.415280, 2.232000)),
    ((0.0, 0.0, 0.0, 0.0), 20, 35, (0, 0, 0, 0, 0), (0.0, 0.0, 0.0, 0.0, 0.0)),
]

SCHEMA = ("p0 double, p1 double, p2 double, p3 double, precrashSpeed double, speedLimit double, "
          "isNight int, isWet int, isDark int, isBadWeather int, airbag int")


def _frame(spark):
    rows = [(*p, float(s), float(lim), *flags) for p, s, lim, flags, _ in CASES]
    return spark.createDataFrame(rows, SCHEMA)


def test_correction_cases(spark):
    out = SC.with_risk(SC.apply_corrections(_frame(spark))).collect()
    for row, (_, _, _, _, want) in zip(out, CASES):
        got = (row["p0"], row["p1"], row["p2"], row["p3"], row["risk_index"])
        assert got == pytest.approx(want, abs=5e-7)


def test_invariants(spark):
    out = SC.with_risk(SC.apply_corrections(_frame(spark))).collect()
    for row, (p_in, *_) in zip(out, CASES):
        ps = [row[f"p{k}"] for k in range(4)]
        assert all(0.0 <= p <= 1.0 for p in ps)
        if sum(p_in) > 0:
            assert sum(ps) == pytest.approx(1.0)
            assert row["p0"] <= p_in[0] + 1e-12
        assert 0.0 <= row["risk_index"] <= 3.0


def test_finalize_rounds_to_four(spark):
    out = SC.finalize_scores(SC.apply_corrections(_frame(spark)), "m").collect()
    assert out[1]["p0"] == 0.6133 and out[1]["risk_index"] == 0.6947
    assert out[1]["predicted_class"] == "POD"


def test_risk_band(spark):
    df = spark.createDataFrame([(0.1,), (0.3,), (0.99,), (1.0,)], "risk_index double")
    assert [r["risk_band"] for r in SC.risk_band(df).collect()] == ["low", "medium", "medium", "high"]
    cells = SC.risk_band(spark.createDataFrame([(0.1,), (0.2,), (0.5,), (0.6,)], "p double"), "p",
                         [(0.1, "low"), (0.5, "medium")], "high", "band", strict_above=True)
    assert [r["band"] for r in cells.collect()] == ["low", "medium", "medium", "high"]
    assert F is not None


def test_generated_methods_are_small_enough_to_be_compiled(spark, capsys):
    """HotSpot interprets methods above 8,000 bytes: the chain stays below, or its session falls back."""
    limit, adaptive = "spark.sql.codegen.hugeMethodLimit", "spark.sql.adaptive.enabled"
    before = {k: spark.conf.get(k) for k in (limit, adaptive)}
    try:
        spark.conf.set(adaptive, "false")
        spark.conf.set(limit, "65535")
        chain = SC.finalize_scores(SC.apply_corrections(_frame(spark).repartition(2)), "m")
        assert int(spark.conf.get(limit)) == 8000
        capsys.readouterr()
        chain.explain("codegen")
        sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
        assert sizes and max(sizes) < 8000
        spark.conf.set(limit, "4000")
        SC.apply_corrections(_frame(spark))
        assert spark.conf.get(limit) == "4000"  # a lower one of the user's stays
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
