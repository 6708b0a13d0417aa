"""Queries: categorical statistics and distribution summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import features as FE
from ..operators import stats as ST
from .fixtures import incidents
from .oracle import CLEAN, INCIDENTS, with_
from .registry import query, rounded

L = C.SEVERITY_LABELS
SEV = "severity"


@query("value_counts", with_(INCIDENTS, """
SELECT severity, COUNT(*) AS n FROM i WHERE severity IS NOT NULL GROUP BY severity"""))
def q_value_counts(spark, sf):
    return ST.value_counts(incidents(spark, sf), SEV)


@query("value_counts_labels", with_(INCIDENTS + """,
lab AS (SELECT * FROM (VALUES ('POD'), ('Minor'), ('Moderate'), ('Serious')) t(severity))""",
    """SELECT lab.severity, CAST(COUNT(i.severity) AS BIGINT) AS n
FROM lab LEFT JOIN i ON i.severity = lab.severity GROUP BY lab.severity"""))
def q_value_counts_labels(spark, sf):
    return ST.value_counts(incidents(spark, sf), SEV, labels=L)


@query("marginal_prob", with_(INCIDENTS, """
SELECT s.severity, ROUND(COALESCE(cnt, 0) / (SELECT COUNT(*) FROM i), 6) AS p
FROM (VALUES ('POD'), ('Minor'), ('Moderate'), ('Serious')) s(severity)
LEFT JOIN (SELECT severity, COUNT(*) AS cnt FROM i GROUP BY severity) g ON g.severity = s.severity"""))
def q_marginal_prob(spark, sf):
    return rounded(ST.marginal_prob(incidents(spark, sf), SEV, L))


def _pivot_sql(a, share=False):
    if share:
        cols = ", ".join(f"ROUND(ROUND(AVG(CASE WHEN severity = '{x}' THEN 1e0 ELSE 0e0 END), 4), 6) AS \"{x}\""
                         for x in L)
    else:
        cols = ", ".join(f"CAST(COUNT(*) FILTER (WHERE severity = '{x}') AS BIGINT) AS \"{x}\"" for x in L)
    return with_(INCIDENTS, f"SELECT {a}, {cols} FROM i WHERE {a} IS NOT NULL AND severity IS NOT NULL GROUP BY {a}")


@query("crosstab_counts", _pivot_sql("weather"))
def q_crosstab_counts(spark, sf):
    return ST.crosstab_counts(incidents(spark, sf), "weather", SEV, L)


@query("crosstab_share", _pivot_sql("lighting", share=True))
def q_crosstab_share(spark, sf):
    return rounded(ST.crosstab_share(incidents(spark, sf), "lighting", SEV, L, digits=4))


@query("wilson_interval", with_(INCIDENTS + """,
cnt AS (
  SELECT s.severity, CAST(COALESCE(g.k, 0) AS BIGINT) AS k, (SELECT COUNT(*) FROM i) AS n
  FROM (VALUES ('POD'), ('Minor'), ('Moderate'), ('Serious')) s(severity)
  LEFT JOIN (SELECT severity, COUNT(*) AS k FROM i GROUP BY severity) g ON g.severity = s.severity
),
calc AS (
  SELECT severity, k, k / n AS p,
    (k / n + 1.96 * 1.96 / (2e0 * n)) / (1 + 1.96 * 1.96 / n) AS centre,
    1.96 * sqrt((k / n) * (1 - k / n) / n + 1.96 * 1.96 / (4e0 * n * n)) / (1 + 1.96 * 1.96 / n) AS half
  FROM cnt
)""", """
SELECT severity, k AS n, ROUND(p, 6) AS p, ROUND(GREATEST(0e0, centre - half), 6) AS lower,
  ROUND(LEAST(1e0, centre + half), 6) AS upper FROM calc"""))
def q_wilson_interval(spark, sf):
    return rounded(ST.wilson_interval(incidents(spark, sf), SEV, L))


def _chi_sql():
    cols = C.CHI_SQUARE_COLUMNS
    unions = "\n  UNION ALL ".join(
        f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS value, severity FROM i" for c in cols)
    return INCIDENTS + f""",
long AS (
  SELECT * FROM ({unions}) u WHERE value IS NOT NULL AND severity IS NOT NULL
),
cells AS (SELECT variable, value, severity, COUNT(*) AS o FROM long GROUP BY ALL),
rws AS (SELECT variable, value, SUM(o) AS r FROM cells GROUP BY ALL),
cls AS (SELECT variable, severity, SUM(o) AS c FROM cells GROUP BY ALL),
tot AS (SELECT variable, SUM(r) AS n, COUNT(*) AS nr FROM rws GROUP BY ALL),
nc AS (SELECT variable, COUNT(*) AS nc FROM cls GROUP BY ALL),
grid AS (
  SELECT rws.variable, rws.r, cls.c, COALESCE(cells.o, 0) AS o, tot.n,
    (tot.nr - 1) * (nc.nc - 1) AS dof
  FROM rws JOIN cls ON rws.variable = cls.variable
  LEFT JOIN cells ON cells.variable = rws.variable AND cells.value = rws.value
                 AND cells.severity = cls.severity
  JOIN tot ON tot.variable = rws.variable JOIN nc ON nc.variable = rws.variable
),
chi AS (
  SELECT variable, dof,
    SUM(POWER(CASE WHEN dof = 1 THEN abs(o - r * c / n) - LEAST(0.5, abs(o - r * c / n))
                   ELSE abs(o - r * c / n) END, 2) / (r * c / n)) AS chi2
  FROM grid GROUP BY variable, dof
)"""


@query("chi_square", with_(_chi_sql(), """
SELECT variable AS "Variable", ROUND(chi2, 6) AS "Chi2", CAST(dof AS INTEGER) AS df FROM chi"""))
def q_chi_square(spark, sf):
    return rounded(ST.chi_square(incidents(spark, sf), C.CHI_SQUARE_COLUMNS, SEV, with_p=False))


# Oracle side: 1 minus the lower tail's series, exp(-h) h^(a + n) / Gamma(a + n + 1).
_TAIL = """GREATEST(0e0, 1e0 - list_sum(list_transform(range(2000),
  lambda n: exp(-chi2 / 2 + (dof / 2 + n) * ln(chi2 / 2) - lgamma(dof / 2 + n + 1)))))"""


@query("chi_square_test", with_(_chi_sql() + f""",
tail AS (SELECT variable, chi2, dof, CASE WHEN dof <= 0 THEN NULL WHEN chi2 <= 0 THEN 1e0 ELSE {_TAIL} END AS p FROM chi)""", """
SELECT variable AS "Variable", ROUND(chi2, 6) AS "Chi2", CAST(dof AS INTEGER) AS df, ROUND(p, 6) AS p_value,
  CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS "Significance"
FROM tail"""))
def q_chi_square_test(spark, sf):
    """Statistic, dof, p-value and stars."""
    return rounded(ST.chi_square(incidents(spark, sf), C.CHI_SQUARE_COLUMNS, SEV, with_p=True))


# Oracle side: p < alpha  <=>  statistic > upper-tail critical value.
# Chi-square critical values (published table) for dof 1..10 at
# alpha = 0.05, 0.01, 0.001.
_CRIT = """crit AS (SELECT * FROM (VALUES
  (1, 3.841, 6.635, 10.828), (2, 5.991, 9.210, 13.816), (3, 7.815, 11.345, 16.266),
  (4, 9.488, 13.277, 18.467), (5, 11.070, 15.086, 20.515), (6, 12.592, 16.812, 22.458),
  (7, 14.067, 18.475, 24.322), (8, 15.507, 20.090, 26.124), (9, 16.919, 21.666, 27.877),
  (10, 18.307, 23.209, 29.588)) t(dof, c05, c01, c001)),
sig AS (
  SELECT variable, CASE WHEN chi2 > c001 THEN '***' WHEN chi2 > c01 THEN '**' WHEN chi2 > c05 THEN '*'
                        ELSE 'ns' END AS significance
  FROM chi JOIN crit ON chi.dof = crit.dof
)"""


@query("significance", with_(_chi_sql() + ",\n" + _CRIT,
                             'SELECT variable AS "Variable", significance AS "Significance" FROM sig'))
def q_significance(spark, sf):
    """Significance stars of every chi-square test (p-value from the UDF)."""
    chi = ST.chi_square(incidents(spark, sf), C.CHI_SQUARE_COLUMNS, SEV, with_p=True)
    return ST.significance(chi).select("Variable", "Significance")


@query("significance_count", with_(_chi_sql() + ",\n" + _CRIT, """
SELECT CAST(COUNT(*) FILTER (WHERE significance <> 'ns') AS BIGINT) AS n_significant,
  CAST(COUNT(*) AS BIGINT) AS n_tests FROM sig"""))
def q_significance_count(spark, sf):
    """Number of tests significant at 5 %."""
    chi = ST.chi_square(incidents(spark, sf), C.CHI_SQUARE_COLUMNS, SEV, with_p=True)
    return ST.count_significant(chi)


def _bayes_sql():
    rows = []
    for col, val, name in C.RISK_CONDITIONS:
        for x in L:
            rows.append(f"""
  SELECT '{name}' AS condition, '{x}' AS severity,
    COUNT(*) FILTER (WHERE COALESCE({col} = '{val}', false)) AS nc,
    COUNT(*) FILTER (WHERE severity = '{x}') AS ns,
    COUNT(*) FILTER (WHERE COALESCE({col} = '{val}', false) AND severity = '{x}') AS ncs,
    COUNT(*) AS n FROM i""")
    return INCIDENTS + ",\nb AS (" + "\n  UNION ALL".join(rows) + "\n)"


@query("bayes_table", with_(_bayes_sql(), """
SELECT condition, severity,
  ROUND(CASE WHEN ns = 0 THEN 0 ELSE ncs / ns END, 6) AS p_cond_given_sev,
  ROUND(ns / n, 6) AS p_sev, ROUND(nc / n, 6) AS p_cond,
  ROUND((CASE WHEN ns = 0 THEN 0 ELSE ncs / ns END) * (ns / n) / (nc / n), 6) AS p_sev_given_cond
FROM b WHERE nc > 0"""))
def q_bayes_table(spark, sf):
    return rounded(ST.bayes_table(incidents(spark, sf), C.RISK_CONDITIONS, SEV, L))


@query("histogram_by", with_(CLEAN + """,
rng AS (
  SELECT severity,
    CASE WHEN MIN(lim) = MAX(lim) THEN MIN(lim) - 0.5 ELSE MIN(lim) END AS lo,
    CASE WHEN MIN(lim) = MAX(lim) THEN MAX(lim) + 0.5 ELSE MAX(lim) END AS hi
  FROM c GROUP BY severity
),
h AS (
  SELECT c.severity, LEAST(CAST(FLOOR((lim - lo) * 12 / (hi - lo)) AS INTEGER), 11) AS bin, lo, hi
  FROM c JOIN rng ON c.severity = rng.severity
)""", """
SELECT severity, bin, ROUND(lo + bin * (hi - lo) / 12, 6) AS bin_lo,
  ROUND(lo + (bin + 1) * (hi - lo) / 12, 6) AS bin_hi, COUNT(*) AS n
FROM h GROUP BY severity, bin, lo, hi"""))
def q_histogram_by(spark, sf):
    cleaned, _, _ = FE.clean_incidents(incidents(spark, sf))
    return rounded(ST.histogram_by(cleaned, C.SPEED_LIMIT, SEV))


@query("box_stats", with_(CLEAN + """,
q AS (
  SELECT severity, quantile_cont(pre, 0.25) AS q1, quantile_cont(pre, 0.5) AS median,
    quantile_cont(pre, 0.75) AS q3 FROM c GROUP BY severity
)""", """
SELECT c.severity, ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3,
  ROUND(MIN(pre) FILTER (WHERE pre >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_lo,
  ROUND(MAX(pre) FILTER (WHERE pre <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_hi,
  COUNT(*) FILTER (WHERE pre < q1 - 1.5 * (q3 - q1) OR pre > q3 + 1.5 * (q3 - q1)) AS n_outliers,
  COUNT(*) AS n
FROM c JOIN q ON c.severity = q.severity GROUP BY c.severity, q1, median, q3"""))
def q_box_stats(spark, sf):
    cleaned, _, _ = FE.clean_incidents(incidents(spark, sf))
    return rounded(ST.box_stats(cleaned, C.PRECRASH, SEV))


@query("dataset_kpis", with_(INCIDENTS, """
SELECT COUNT(*) AS total_samples,
  CAST(14 + GREATEST(COUNT(DISTINCT roadway_type) - 1, 0) + GREATEST(COUNT(DISTINCT weather) - 1, 0)
     + GREATEST(COUNT(DISTINCT lighting) - 1, 0) + GREATEST(COUNT(DISTINCT crash_with) - 1, 0) AS BIGINT)
     AS features_count,
  CAST((COUNT(*) FILTER (WHERE severity = 'POD') > 0)::INT + (COUNT(*) FILTER (WHERE severity = 'Minor') > 0)::INT
     + (COUNT(*) FILTER (WHERE severity = 'Moderate') > 0)::INT
     + (COUNT(*) FILTER (WHERE severity = 'Serious') > 0)::INT AS BIGINT) AS n_classes,
  ROUND(GREATEST(COUNT(*) FILTER (WHERE severity = 'POD'), COUNT(*) FILTER (WHERE severity = 'Minor'),
     COUNT(*) FILTER (WHERE severity = 'Moderate'), COUNT(*) FILTER (WHERE severity = 'Serious'))
     / COUNT(*), 6) AS majority_share,
  ROUND(100e0 * COUNT(*) FILTER (WHERE severity = 'POD') / COUNT(*), 6) AS "pct_POD",
  ROUND(100e0 * COUNT(*) FILTER (WHERE severity = 'Minor') / COUNT(*), 6) AS "pct_Minor",
  ROUND(100e0 * COUNT(*) FILTER (WHERE severity = 'Moderate') / COUNT(*), 6) AS "pct_Moderate",
  ROUND(100e0 * COUNT(*) FILTER (WHERE severity = 'Serious') / COUNT(*), 6) AS "pct_Serious"
FROM i"""))
def q_dataset_kpis(spark, sf):
    n_base = len(C.NUMERIC_FEATURES) + len(C.ENGINEERED_FEATURES)
    return rounded(ST.dataset_kpis(incidents(spark, sf), SEV, L, C.ONE_HOT_COLUMNS, n_base))
