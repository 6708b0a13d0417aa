"""ANSI-SQL fragments for the DuckDB oracle.

The oracle recomputes every checked query from the base tables with plain
SQL, independently of the Spark operators.  ``INCIDENTS`` is the incident view
of FIXTURES.md §2, ``CLEAN`` the cleaning rules, ``SCORED`` the deterministic
scorer of FIXTURES.md §4.  Every double is rounded to 6 digits on both sides.
"""

INCIDENTS = """
base AS (
  SELECT o.*, c.c_mktsegment, c.c_acctbal, n.n_regionkey,
    o.o_totalprice / 500000
      + CASE WHEN o.o_orderstatus = 'F' THEN 0.15 ELSE 0 END
      + CASE WHEN o.o_orderpriority = '1-URGENT' THEN 0.15 ELSE 0 END
      + ((o.o_orderkey * 7919) % 1000) / 4000.0 AS latent
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
),
i AS (
SELECT o_orderkey AS incident_id,
  o_orderdate AS reported_at,
  CASE WHEN o_orderkey % 50 = 0 THEN 'not a date'
       ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS incident_date,
  CASE o_orderstatus WHEN 'F' THEN 'Night' WHEN 'O' THEN 'Day'
       ELSE 'Dawn' END AS incident_time,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Highway'
       WHEN 'BUILDING' THEN 'Intersection'
       WHEN 'FURNITURE' THEN 'Parking Lot' ELSE 'Street' END AS roadway_type,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL
       WHEN o_orderpriority = '1-URGENT' THEN 'Wet'
       ELSE 'Dry' END AS roadway_surface,
  CASE n_regionkey WHEN 0 THEN 'Daylight' WHEN 1 THEN 'Dark/Lighted'
       WHEN 2 THEN 'Dark/Not Lighted' WHEN 3 THEN 'Dawn/Dusk'
       ELSE NULL END AS lighting,
  CASE o_custkey % 5 WHEN 0 THEN 'Clear' WHEN 1 THEN 'Cloudy/Fog'
       WHEN 2 THEN 'Snow/rain' WHEN 3 THEN 'Unknown'
       ELSE NULL END AS weather,
  CASE o_custkey % 4 WHEN 0 THEN 'Car' WHEN 1 THEN 'Pedestrian'
       WHEN 2 THEN 'Cyclist' ELSE 'Fixed Object' END AS crash_with,
  CASE WHEN o_totalprice > 420000 AND o_orderkey % 3 <> 0 THEN 'Yes'
       WHEN o_orderkey % 37 = 0 THEN 'Unknown' ELSE 'No' END AS air_bag,
  CASE WHEN o_orderkey % 23 = 0 THEN 'Unknown'
       WHEN o_orderkey % 97 = 0 THEN '0'
       ELSE CAST(25 + 5 * (o_custkey % 9) AS STRING) END AS posted_speed_limit,
  CASE WHEN o_orderkey % 19 = 0 THEN 'Unknown'
       ELSE CAST(CAST(FLOOR(o_totalprice / 5000) AS INT) AS STRING) END AS precrash_speed,
  c_acctbal * 10 + 10000 AS mileage,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL
       ELSE CAST(2010 + o_custkey % 14 AS STRING) END AS model_year,
  CASE WHEN latent >= 1.33 THEN 'Serious' WHEN latent >= 1.22 THEN 'Moderate'
       WHEN latent >= 1.12 THEN 'Minor' ELSE 'POD' END AS severity
FROM base
)"""

# Cleaning rules: label code, coerced + median-imputed speeds, flags, dates.
CLEAN = INCIDENTS + """,
c0 AS (
  SELECT i.*,
    TRY_CAST(posted_speed_limit AS DOUBLE) AS lim_raw,
    TRY_CAST(precrash_speed AS DOUBLE) AS pre_raw,
    TRY_CAST(model_year AS DOUBLE) AS my_raw
  FROM i
),
med AS (
  SELECT median(lim_raw) AS m_lim, median(pre_raw) AS m_pre, median(my_raw) AS m_my FROM c0
),
c AS (
  SELECT c0.*,
    CASE severity WHEN 'POD' THEN 0 WHEN 'Minor' THEN 1 WHEN 'Moderate' THEN 2
         WHEN 'Serious' THEN 3 END AS label,
    COALESCE(lim_raw, m_lim) AS lim,
    COALESCE(pre_raw, m_pre) AS pre,
    CAST(COALESCE(incident_time = 'Night', false) AS INTEGER) AS is_night,
    CAST(COALESCE(roadway_surface = 'Wet', false) AS INTEGER) AS is_wet,
    CAST(COALESCE(roadway_type = 'Highway', false) AS INTEGER) AS is_highway,
    CAST(COALESCE(contains(lighting, 'Dark'), false) AS INTEGER) AS is_dark,
    1 - CAST(COALESCE(weather IN ('Clear', 'Unknown'), false) AS INTEGER) AS is_bad_weather,
    CAST(COALESCE(air_bag = 'Yes', false) AS INTEGER) AS airbag_deployed,
    CAST(COALESCE(year(TRY_CAST(incident_date AS DATE)), 2023) AS INTEGER) AS incident_year,
    CAST(COALESCE(month(TRY_CAST(incident_date AS DATE)), 6) AS INTEGER) AS incident_month,
    CAST(COALESCE(my_raw < m_my, false) AS INTEGER) AS is_old_vehicle
  FROM c0, med
),
f AS (
  SELECT c.*,
    COALESCE(pre / NULLIF(lim, 0), 0) AS speed_ratio,
    pre * is_night AS speed_night
  FROM c
)"""

# Deterministic scorer (FIXTURES.md §4) plus a second fixed scorer, both over
# the incident view; ``pred`` holds both as models with predicted class.
SCORED = INCIDENTS + """,
v AS (
  SELECT incident_id,
    CASE severity WHEN 'POD' THEN 0 WHEN 'Minor' THEN 1 WHEN 'Moderate' THEN 2 ELSE 3 END AS label,
    COALESCE(TRY_CAST(precrash_speed AS DOUBLE), 50) AS s,
    CASE WHEN incident_time = 'Night' THEN 0.3e0 ELSE 0e0 END AS night
  FROM i
),
w AS (
  SELECT incident_id, label, 1e0 AS w0, s / 80 AS w1,
    GREATEST(s - 70, 0e0) / 20 AS w2,
    GREATEST(s - 80, 0e0) / 10 + night AS w3
  FROM v
),
scr AS (
  SELECT 'speed' AS model, incident_id, label,
    ROUND(w0 / (w0 + w1 + w2 + w3), 6) AS p0,
    ROUND(w1 / (w0 + w1 + w2 + w3), 6) AS p1,
    ROUND(w2 / (w0 + w1 + w2 + w3), 6) AS p2,
    ROUND(w3 / (w0 + w1 + w2 + w3), 6) AS p3
  FROM w
  UNION ALL
  SELECT 'night' AS model, incident_id, label,
    ROUND(3e0 / (3e0 + w1 + 2 * w3), 6) AS p0,
    ROUND(w1 / (3e0 + w1 + 2 * w3), 6) AS p1,
    0e0 AS p2,
    ROUND(2 * w3 / (3e0 + w1 + 2 * w3), 6) AS p3
  FROM w
),
pred AS (
  SELECT scr.*,
    CASE GREATEST(p0, p1, p2, p3) WHEN p0 THEN 0 WHEN p1 THEN 1 WHEN p2 THEN 2 ELSE 3 END AS prediction
  FROM scr
)"""


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"
