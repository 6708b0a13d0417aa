"""Null and bad-value rules on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from gradus import config as C
from gradus.operators import features as FE
from gradus.operators.ranking import exact_medians, exact_percentiles


def test_encode_ordinal_unmapped_is_null(spark):
    df = spark.createDataFrame([("POD",), ("Serious",), ("bogus",), (None,)], "s string")
    got = [r["label"] for r in FE.encode_ordinal(df, "s", C.SEVERITY_LABELS).collect()]
    assert got == [0, 3, None, None]


def test_coerce_numeric_rules(spark):
    df = spark.createDataFrame([(" 35 ",), ("Unknown",), ("NaN",), ("40mph",), (None,), ("0",)], "v string")
    got = [r["v"] for r in FE.coerce_numeric(df, ["v"]).collect()]
    assert got == [35.0, None, None, None, None, 0.0]


def test_median_is_exact(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,), (None,)], "v double")
    assert FE.fit_medians(df, ["v"])["v"] == 3.0
    assert exact_percentiles(df, "v", [0.5], names=["m"]).first()["m"] == 3.0
    two = df.withColumn("no.thing", F.lit(None).cast("double"))
    assert exact_medians(two, ["v", "no.thing"]) == {"v": 3.0, "no.thing": None}


def test_impute_median_fills_nulls(spark):
    df = spark.createDataFrame([("10",), ("Unknown",), ("30",), ("20",)], "v string")
    out = FE.impute_median(FE.coerce_numeric(df, ["v"]), ["v"])
    assert [r["v"] for r in out.collect()] == [10.0, 20.0, 30.0, 20.0]


def test_flags_null_rules(spark):
    df = spark.createDataFrame([("Dark/Lighted", None, "Night"), (None, "Clear", None), ("Daylight", "Unknown", "Day"),
                                ("dark", "Rain", "Night")], "lighting string, weather string, t string")
    out = FE.flag_contains(df, "dark", "lighting", "Dark")
    out = FE.flag_not_in(out, "bad", "weather", C.GOOD_WEATHER_VALUES)
    out = FE.flag_equals(out, "night", "t", "Night")
    rows = [(r["dark"], r["bad"], r["night"]) for r in out.collect()]
    assert rows == [(1, 1, 1), (0, 0, 0), (0, 0, 0), (0, 1, 1)]


def test_safe_ratio_zero_and_missing(spark):
    df = spark.createDataFrame([(50.0, 25.0), (50.0, 0.0), (50.0, None)], "a double, b double")
    assert [r["r"] for r in FE.safe_ratio(df, "r", "a", "b").collect()] == [2.0, 0.0, 0.0]


def test_date_parts_defaults(spark):
    df = spark.createDataFrame([("2021-03-04",), ("not a date",), (None,), ("06/15/2022",)], "d string")
    rows = [(r["y"], r["m"]) for r in FE.date_parts(df, "d", "y", "m").collect()]
    assert rows == [(2021, 3), (2023, 6), (2023, 6), (2022, 6)]


def test_below_median_null_is_zero(spark):
    df = spark.createDataFrame([("2010",), ("2015",), ("2020",), (None,), ("old",)], "y string")
    assert [r["o"] for r in FE.flag_below_median(df, "o", "y").collect()] == [1, 0, 0, 0, 0]


def test_one_hot_sorted_drop_first_null_zero(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "c string")
    out, names = FE.one_hot(df, ["c"])
    assert names == ["c_b", "c_c"]
    rows = [(r["c_b"], r["c_c"]) for r in out.collect()]
    assert rows == [(1, 0), (0, 0), (0, 1), (0, 0)]


def test_standardize_population_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    params = FE.fit_standardize(df, ["x"])
    assert params["x"][0] == 2.5
    assert params["x"][1] == pytest.approx(1.118033988749895)
    const = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert FE.fit_standardize(const, ["x"])["x"][1] == 1.0


def test_scenario_encode_defaults(spark):
    df = spark.createDataFrame(
        [("0", "abc", "", True, False, "highway", "dark/lighted", None, True)],
        "speed_limit_text string, precrash_text string, mileage_text string, night_checked boolean, "
        "wet_checked boolean, roadway_choice string, lighting_choice string, weather_choice string, "
        "airbag_checked boolean")
    r = FE.scenario_encode(df).first()
    assert (r["speedLimit"], r["precrashSpeed"], r["mileage"]) == (35.0, 10.0, 500.0)
    assert (r["isNight"], r["isWet"], r["isHighway"], r["isDark"], r["isBadWeather"], r["airbag"]) == (1, 0, 1, 1, 1, 1)


def test_validate_flags_rejects_non_binary(spark):
    df = spark.createDataFrame([(2, 0, 0, 0, 0, 0)], "isNight int, isWet int, isHighway int, isDark int, "
                                                     "isBadWeather int, airbag int")
    with pytest.raises(Exception):
        FE.validate_flags(df).collect()
    assert F is not None
