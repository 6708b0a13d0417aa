"""Queries: sources, profile, cleaning and feature projections."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from .. import config as C
from ..functions import columns as X
from ..operators import features as FE
from ..operators import profile as PR
from ..sources.incidents import scenario_choices
from .fixtures import incidents
from .oracle import CLEAN, INCIDENTS, with_
from .registry import query, rounded

ID = "incident_id"


@query("src_incidents", with_(INCIDENTS, "SELECT * FROM i"))
def q_src_incidents(spark, sf):
    return rounded(incidents(spark, sf))


@query("profile_shape", with_(INCIDENTS, "SELECT COUNT(*) AS n_rows, CAST(15 AS BIGINT) AS n_cols FROM i"))
def q_profile_shape(spark, sf):
    return PR.profile_shape(incidents(spark, sf))


@query("profile_dtypes", with_(INCIDENTS, """
SELECT column_name AS column,
  CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string'
       WHEN 'DOUBLE' THEN 'double' WHEN 'INTEGER' THEN 'int'
       WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS dtype
FROM (DESCRIBE SELECT * FROM i)"""))
def q_profile_dtypes(spark, sf):
    return PR.profile_dtypes(incidents(spark, sf, own_schema=True))


_SAMPLE_COLS = ["incident_id", "reported_at", "incident_date", "incident_time", "roadway_type",
                "roadway_surface", "lighting", "weather", "crash_with", "air_bag",
                "posted_speed_limit", "precrash_speed", "mileage", "model_year", "severity"]


@query("profile_sample", with_(INCIDENTS, "SELECT " + ", ".join(
    f"COALESCE(CAST({c} AS VARCHAR), 'N/A') AS {c}" for c in _SAMPLE_COLS)
    + " FROM i ORDER BY i.incident_id LIMIT 20"))
def q_profile_sample(spark, sf):
    return PR.profile_sample(incidents(spark, sf), n=20, order_by=ID)


@query("encode_ordinal", with_(INCIDENTS, """
SELECT incident_id, severity,
  CASE severity WHEN 'POD' THEN 0 WHEN 'Minor' THEN 1 WHEN 'Moderate' THEN 2
       WHEN 'Serious' THEN 3 END AS label
FROM i"""))
def q_encode_ordinal(spark, sf):
    return FE.encode_ordinal(incidents(spark, sf), "severity", C.SEVERITY_LABELS).select(ID, "severity", "label")


@query("coerce_numeric", with_(INCIDENTS, """
SELECT incident_id,
  ROUND(TRY_CAST(posted_speed_limit AS DOUBLE), 6) AS posted_speed_limit,
  ROUND(TRY_CAST(precrash_speed AS DOUBLE), 6) AS precrash_speed,
  ROUND(TRY_CAST(model_year AS DOUBLE), 6) AS model_year
FROM i"""))
def q_coerce_numeric(spark, sf):
    cols = [C.SPEED_LIMIT, C.PRECRASH, "model_year"]
    return rounded(FE.coerce_numeric(incidents(spark, sf), cols).select(ID, *cols))


@query("impute_median", with_(CLEAN, """
SELECT incident_id, ROUND(lim, 6) AS posted_speed_limit, ROUND(pre, 6) AS precrash_speed FROM c"""))
def q_impute_median(spark, sf):
    cols = [C.SPEED_LIMIT, C.PRECRASH]
    df = FE.coerce_numeric(incidents(spark, sf), cols)
    return rounded(FE.impute_median(df, cols).select(ID, *cols))


@query("flag_equals", with_(CLEAN, """
SELECT incident_id, is_night, is_wet, is_highway, airbag_deployed FROM c"""))
def q_flag_equals(spark, sf):
    df = incidents(spark, sf)
    for out, c, v in [("is_night", "incident_time", C.NIGHT_VALUE), ("is_wet", "roadway_surface", C.WET_VALUE),
                      ("is_highway", "roadway_type", C.HIGHWAY_VALUE), ("airbag_deployed", "air_bag", C.AIRBAG_VALUE)]:
        df = FE.flag_equals(df, out, c, v)
    return df.select(ID, "is_night", "is_wet", "is_highway", "airbag_deployed")


@query("flag_contains", with_(CLEAN, "SELECT incident_id, lighting, is_dark FROM c"))
def q_flag_contains(spark, sf):
    return FE.flag_contains(incidents(spark, sf), "is_dark", "lighting", C.DARK_SUBSTRING).select(
        ID, "lighting", "is_dark")


@query("flag_not_in", with_(CLEAN, "SELECT incident_id, weather, is_bad_weather FROM c"))
def q_flag_not_in(spark, sf):
    return FE.flag_not_in(incidents(spark, sf), "is_bad_weather", "weather", C.GOOD_WEATHER_VALUES).select(
        ID, "weather", "is_bad_weather")


@query("safe_ratio", with_(CLEAN + ",\nr AS (SELECT incident_id, COALESCE(pre / NULLIF(lim, 0), 0) AS speed_ratio FROM c)",
                           "SELECT incident_id, ROUND(speed_ratio, 6) AS speed_ratio FROM r"))
def q_safe_ratio(spark, sf):
    cleaned, _, _ = FE.clean_incidents(incidents(spark, sf))
    return rounded(FE.safe_ratio(cleaned, "speed_ratio", C.PRECRASH, C.SPEED_LIMIT).select(ID, "speed_ratio"))


@query("date_parts", with_(CLEAN, "SELECT incident_id, incident_date, incident_year, incident_month FROM c"))
def q_date_parts(spark, sf):
    return FE.date_parts(incidents(spark, sf), "incident_date").select(
        ID, "incident_date", "incident_year", "incident_month")


@query("flag_below_median", with_(CLEAN, "SELECT incident_id, model_year, is_old_vehicle FROM c"))
def q_flag_below_median(spark, sf):
    return FE.flag_below_median(incidents(spark, sf), "is_old_vehicle", "model_year").select(
        ID, "model_year", "is_old_vehicle")


@query("interaction", with_(CLEAN, "SELECT incident_id, ROUND(pre * is_night, 6) AS speed_night FROM c"))
def q_interaction(spark, sf):
    cleaned, _, _ = FE.clean_incidents(incidents(spark, sf))
    return rounded(FE.interaction(cleaned, "speed_night", C.PRECRASH, "is_night").select(ID, "speed_night"))


def _dummy_sql(col, values):
    return [f"CAST(COALESCE({col} = '{v}', false) AS INTEGER) AS \"{col}_{v}\"" for v in values]


# The oracle names the levels the fixture data holds; the Spark operator
# fits them from the data (sorted distinct values, first dropped).
_ONE_HOT_LEVELS = {
    "roadway_type": ["Intersection", "Parking Lot", "Street"],
    "weather": ["Cloudy/Fog", "Snow/rain", "Unknown"],
    "lighting": ["Dark/Not Lighted", "Daylight", "Dawn/Dusk"],
    "crash_with": ["Cyclist", "Fixed Object", "Pedestrian"],
}


@query("one_hot", with_(INCIDENTS, "SELECT incident_id, " + ", ".join(
    s for c, vs in _ONE_HOT_LEVELS.items() for s in _dummy_sql(c, vs)) + " FROM i"))
def q_one_hot(spark, sf):
    df, names = FE.one_hot(incidents(spark, sf), C.ONE_HOT_COLUMNS)
    return df.select(ID, *[F.col(f"`{n}`") for n in names])


_STD_SQL = CLEAN + """,
f2 AS (SELECT c.*, COALESCE(pre / NULLIF(lim, 0), 0) AS speed_ratio, pre * is_night AS speed_night FROM c),
st AS (SELECT avg(lim) AS m1, stddev_pop(lim) AS s1, avg(mileage) AS m2, stddev_pop(mileage) AS s2,
              avg(pre) AS m3, stddev_pop(pre) AS s3, avg(speed_ratio) AS m4, stddev_pop(speed_ratio) AS s4,
              avg(speed_night) AS m5, stddev_pop(speed_night) AS s5 FROM f2)"""


@query("standardize", with_(_STD_SQL, """
SELECT incident_id,
  ROUND((lim - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END, 6) AS posted_speed_limit,
  ROUND((mileage - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END, 6) AS mileage,
  ROUND((pre - m3) / CASE WHEN s3 = 0 THEN 1 ELSE s3 END, 6) AS precrash_speed,
  ROUND((speed_ratio - m4) / CASE WHEN s4 = 0 THEN 1 ELSE s4 END, 6) AS speed_ratio,
  ROUND((speed_night - m5) / CASE WHEN s5 = 0 THEN 1 ELSE s5 END, 6) AS speed_night
FROM f2, st"""))
def q_standardize(spark, sf):
    cleaned, _, _ = FE.clean_incidents(incidents(spark, sf))
    params = FE.fit_standardize(cleaned, C.NUMERIC_FEATURES)
    return rounded(FE.standardize(cleaned, params).select(ID, *C.NUMERIC_FEATURES))


_SCEN_SQL = INCIDENTS + """,
sc AS (
  SELECT incident_id,
    COALESCE(NULLIF(TRY_CAST(posted_speed_limit AS DOUBLE), 0), 35e0) AS "speedLimit",
    COALESCE(NULLIF(TRY_CAST(precrash_speed AS DOUBLE), 0), 10e0) AS "precrashSpeed",
    COALESCE(NULLIF(TRY_CAST(CAST(mileage AS VARCHAR) AS DOUBLE), 0), 500e0) AS mileage,
    CAST(COALESCE(incident_time = 'Night', false) AS INTEGER) AS "isNight",
    CAST(COALESCE(roadway_surface = 'Wet', false) AS INTEGER) AS "isWet",
    CAST(COALESCE(lower(roadway_type) = 'highway', false) AS INTEGER) AS "isHighway",
    CAST(COALESCE(starts_with(lower(lighting), 'dark'), false) AS INTEGER) AS "isDark",
    1 - CAST(COALESCE(lower(weather) = 'clear', false) AS INTEGER) AS "isBadWeather",
    CAST(COALESCE(air_bag = 'Yes', false) AS INTEGER) AS airbag
  FROM i
)"""


@query("scenario_encode", with_(_SCEN_SQL, """
SELECT incident_id, ROUND("speedLimit", 6) AS "speedLimit", ROUND("precrashSpeed", 6) AS "precrashSpeed",
  ROUND(mileage, 6) AS mileage, "isNight", "isWet", "isHighway", "isDark", "isBadWeather", airbag FROM sc"""))
def q_scenario_encode(spark, sf):
    return rounded(FE.scenario_encode(scenario_choices(incidents(spark, sf))))


_SCEN_FEAT_SQL = _STD_SQL + "," + _SCEN_SQL.split(INCIDENTS + ",", 1)[1]


@query("scenario_features", with_(_SCEN_FEAT_SQL, """
SELECT incident_id,
  ROUND(("speedLimit" - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END, 6) AS posted_speed_limit,
  ROUND((mileage - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END, 6) AS mileage,
  ROUND(("precrashSpeed" - m3) / CASE WHEN s3 = 0 THEN 1 ELSE s3 END, 6) AS precrash_speed,
  ROUND((CASE WHEN "speedLimit" > 0 THEN "precrashSpeed" / "speedLimit" ELSE 0 END - m4)
        / CASE WHEN s4 = 0 THEN 1 ELSE s4 END, 6) AS speed_ratio,
  ROUND(("precrashSpeed" * "isNight" - m5) / CASE WHEN s5 = 0 THEN 1 ELSE s5 END, 6) AS speed_night,
  CAST("isNight" AS DOUBLE) AS is_night, CAST("isWet" AS DOUBLE) AS is_wet,
  CAST("isHighway" AS DOUBLE) AS is_highway, CAST("isDark" AS DOUBLE) AS is_dark,
  CAST("isBadWeather" AS DOUBLE) AS is_bad_weather, CAST(airbag AS DOUBLE) AS airbag_deployed,
  2024e0 AS incident_year, 6e0 AS incident_month, 0e0 AS is_old_vehicle
FROM sc, st"""))
def q_scenario_features(spark, sf):
    inc = incidents(spark, sf)
    _, model = FE.fit_features(inc)
    scen = FE.scenario_encode(scenario_choices(inc))
    out = FE.scenario_features(scen, model, assemble_vector=False)
    keep = C.NUMERIC_FEATURES + C.ENGINEERED_FEATURES
    return rounded(out.select(ID, *keep))


_VECTOR_SQL = with_(_STD_SQL, """
SELECT incident_id, label,
  ROUND((lim - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END, 6) AS posted_speed_limit,
  ROUND((mileage - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END, 6) AS mileage,
  ROUND((pre - m3) / CASE WHEN s3 = 0 THEN 1 ELSE s3 END, 6) AS precrash_speed,
  ROUND((speed_ratio - m4) / CASE WHEN s4 = 0 THEN 1 ELSE s4 END, 6) AS speed_ratio,
  ROUND((speed_night - m5) / CASE WHEN s5 = 0 THEN 1 ELSE s5 END, 6) AS speed_night,
  """ + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in C.ENGINEERED_FEATURES) + ", "
                    + ", ".join(d.replace(" AS \"", "::DOUBLE AS \"") for c, vs in _ONE_HOT_LEVELS.items()
                                for d in _dummy_sql(c, vs)) + " FROM f2, st")


@query("assemble_features", _VECTOR_SQL)
def q_assemble_features(spark, sf):
    """The assembled vector, taken apart again by position."""
    feats, model = FE.fit_features(incidents(spark, sf))
    x = vector_to_array("features")
    return rounded(feats.select(ID, "label", *[x[i].alias(n) for i, n in enumerate(model.feature_names)]))
