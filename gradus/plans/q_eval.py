"""Queries: evaluation, ranking reports and scoring corrections.

Evaluation runs over the two fixed scorers of ``fixtures.scored`` so that
every metric has an exact oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import columns as X
from ..operators import evaluate as EV
from ..operators import features as FE
from ..operators import scoring as SC
from ..operators import stats as ST
from .fixtures import incidents, scored, scored_scenarios
from .oracle import CLEAN, INCIDENTS, SCORED, with_
from .q_features import _SCEN_SQL
from .registry import query, rounded

L = C.SEVERITY_LABELS
K = len(L)
_NAMES = "['POD', 'Minor', 'Moderate', 'Serious']"

_CLS = SCORED + """,
cls AS (SELECT * FROM (VALUES (0, 'POD'), (1, 'Minor'), (2, 'Moderate'), (3, 'Serious')) t(c, name)),
st AS (
  SELECT model, c, name,
    COUNT(*) FILTER (WHERE label = c AND prediction = c) AS tp,
    COUNT(*) FILTER (WHERE prediction = c) AS npred,
    COUNT(*) FILTER (WHERE label = c) AS sup,
    COUNT(*) AS tot,
    COUNT(*) FILTER (WHERE label = prediction) AS correct
  FROM pred, cls GROUP BY model, c, name
),
pr AS (SELECT *, CASE WHEN npred > 0 THEN tp / npred ELSE 0 END AS prec,
                 CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS rec FROM st),
f AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f1 FROM pr),
wf AS (SELECT model, SUM(f1 * sup) / SUM(sup) AS f1 FROM f GROUP BY model),
acc AS (SELECT model, AVG(CASE WHEN label = prediction THEN 1e0 ELSE 0e0 END) AS accuracy FROM pred GROUP BY model),
br AS (SELECT model, AVG(POWER(p0 - (label = 0)::DOUBLE, 2) + POWER(p1 - (label = 1)::DOUBLE, 2)
                       + POWER(p2 - (label = 2)::DOUBLE, 2) + POWER(p3 - (label = 3)::DOUBLE, 2)) / 4 AS brier
       FROM pred GROUP BY model)"""


@query("accuracy", with_(_CLS, "SELECT model, ROUND(accuracy, 6) AS accuracy FROM acc"))
def q_accuracy(spark, sf):
    return rounded(EV.accuracy(scored(spark, sf)))


@query("weighted_f1", with_(_CLS, "SELECT model, ROUND(f1, 6) AS f1 FROM wf"))
def q_weighted_f1(spark, sf):
    return rounded(EV.weighted_f1(scored(spark, sf), L))


@query("class_report", with_(_CLS, """
SELECT model, name AS class, ROUND(prec, 6) AS precision, ROUND(rec, 6) AS recall, ROUND(f1, 6) AS f1,
  CAST(sup AS BIGINT) AS support FROM f
UNION ALL
SELECT model, 'accuracy', NULL, NULL, ROUND(MAX(correct) / MAX(tot), 6), CAST(MAX(tot) AS BIGINT) FROM f GROUP BY model
UNION ALL
SELECT model, 'macro avg', ROUND(AVG(prec), 6), ROUND(AVG(rec), 6), ROUND(AVG(f1), 6), CAST(SUM(sup) AS BIGINT)
FROM f GROUP BY model
UNION ALL
SELECT model, 'weighted avg', ROUND(SUM(prec * sup) / SUM(sup), 6), ROUND(SUM(rec * sup) / SUM(sup), 6),
  ROUND(SUM(f1 * sup) / SUM(sup), 6), CAST(SUM(sup) AS BIGINT) FROM f GROUP BY model"""))
def q_class_report(spark, sf):
    return rounded(EV.class_report(scored(spark, sf), L))


@query("confusion_matrix", with_(SCORED + """,
cls AS (SELECT * FROM (VALUES (0, 'POD'), (1, 'Minor'), (2, 'Moderate'), (3, 'Serious')) t(c, name)),
m AS (SELECT DISTINCT model FROM pred),
cells AS (
  SELECT m.model, a.name AS actual, p.name AS predicted,
    (SELECT COUNT(*) FROM pred WHERE pred.model = m.model AND label = a.c AND prediction = p.c) AS n
  FROM m, cls a, cls p
)""", """
SELECT model, actual, predicted, CAST(n AS BIGINT) AS n,
  ROUND(CASE WHEN MAX(n) OVER (PARTITION BY model) > 0 THEN n / MAX(n) OVER (PARTITION BY model) ELSE 0 END, 6)
    AS intensity
FROM cells"""))
def q_confusion_matrix(spark, sf):
    return rounded(EV.confusion_matrix(scored(spark, sf), L))


@query("brier_ovr", with_(_CLS, "SELECT model, ROUND(brier, 6) AS brier FROM br"))
def q_brier_ovr(spark, sf):
    return rounded(EV.brier_ovr(scored(spark, sf), K))


_ROC = SCORED + """,
lng AS (
  SELECT model, label, 0 AS class, p0 AS score FROM pred UNION ALL
  SELECT model, label, 1, p1 FROM pred UNION ALL
  SELECT model, label, 2, p2 FROM pred UNION ALL
  SELECT model, label, 3, p3 FROM pred
),
sc2 AS (
  SELECT model, class, score, COUNT(*) FILTER (WHERE label = class) AS pos,
    COUNT(*) FILTER (WHERE label <> class) AS neg
  FROM lng GROUP BY model, class, score
),
r AS (
  SELECT *,
    SUM(pos) OVER w AS cum_pos, SUM(neg) OVER w AS cum_neg, ROW_NUMBER() OVER w AS rn,
    LEAD(pos) OVER w AS npos, LEAD(neg) OVER w AS nneg,
    COUNT(*) OVER (PARTITION BY model, class) AS m,
    SUM(pos) OVER (PARTITION BY model, class) AS tp_all,
    SUM(neg) OVER (PARTITION BY model, class) AS tn_all
  FROM sc2
  WINDOW w AS (PARTITION BY model, class ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
pts AS (
  SELECT model, class, cum_pos, cum_neg, score, tp_all, tn_all FROM r
  WHERE rn = 1 OR rn = m OR npos IS NULL OR npos <> pos OR nneg <> neg
  UNION ALL
  SELECT DISTINCT model, class, 0, 0, 'inf'::DOUBLE, tp_all, tn_all FROM r
),
roc AS (
  SELECT model, (""" + _NAMES + """)[class + 1] AS class,
    CAST(ROW_NUMBER() OVER (PARTITION BY model, class ORDER BY score DESC) - 1 AS INTEGER) AS seq,
    ROUND(CASE WHEN tn_all > 0 THEN cum_neg / tn_all END, 6) AS fpr,
    ROUND(CASE WHEN tp_all > 0 THEN cum_pos / tp_all END, 6) AS tpr
  FROM pts
)"""


@query("roc_curve", with_(_ROC, "SELECT * FROM roc"))
def q_roc_curve(spark, sf):
    return rounded(EV.roc_curve(scored(spark, sf), K, L))


@query("roc_thin", with_(_ROC, """
SELECT roc.* FROM roc JOIN (SELECT model, class, COUNT(*) AS n FROM roc GROUP BY model, class) c
  ON c.model = roc.model AND c.class = roc.class
WHERE seq % GREATEST(1, n // 50) = 0"""))
def q_roc_thin(spark, sf):
    return rounded(EV.roc_thin(EV.roc_curve(scored(spark, sf), K, L), C.ROC_MAX_POINTS))


@query("auc", with_(_ROC + """,
a AS (
  SELECT model, class, pos, neg,
    SUM(neg) OVER (PARTITION BY model, class ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - neg
      AS below
  FROM sc2
)""", """
SELECT model, (""" + _NAMES + """)[class + 1] AS class,
  ROUND(CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0
        THEN SUM(pos * (below + neg / 2.0)) / (SUM(pos) * SUM(neg)) END, 6) AS auc
FROM a GROUP BY model, class"""))
def q_auc(spark, sf):
    return rounded(EV.auc(scored(spark, sf), K, L))


@query("leaderboard", with_(_CLS + """,
mt AS (SELECT acc.model, accuracy, wf.f1, brier FROM acc JOIN wf ON acc.model = wf.model
       JOIN br ON br.model = acc.model)""", """
SELECT model, ROUND(accuracy, 6) AS accuracy, ROUND(f1, 6) AS f1, ROUND(brier, 6) AS brier,
  ROUND(1 - brier, 6) AS one_minus_brier,
  accuracy = MAX(accuracy) OVER () AS best_accuracy, f1 = MAX(f1) OVER () AS best_f1,
  brier = MIN(brier) OVER () AS best_brier
FROM mt"""))
def q_leaderboard(spark, sf):
    return rounded(EV.leaderboard(EV.model_metrics(scored(spark, sf), L)))


@query("full_proba", with_(SCORED, """
SELECT incident_id, p0, p1, 0e0 AS p2, p3 FROM pred WHERE model = 'night'"""))
def q_full_proba(spark, sf):
    night = scored(spark, sf).where(F.col("model") == "night")
    own = night.select("incident_id", F.array("p0", "p1", "p3").alias("proba"))
    return rounded(EV.full_proba(own, "proba", [0, 1, 3], K).select("incident_id", "p0", "p1", "p2", "p3"))


@query("risk_index", with_(SCORED, "SELECT model, incident_id, ROUND(p1 + 2 * p2 + 3 * p3, 6) AS risk_index FROM pred"))
def q_risk_index(spark, sf):
    return rounded(scored(spark, sf).select("model", "incident_id", X.risk_index(SC.P).alias("risk_index")))


@query("predicted_class", with_(SCORED, f"""
SELECT model, incident_id, ({_NAMES})[prediction + 1] AS predicted_class FROM pred"""))
def q_predicted_class(spark, sf):
    return scored(spark, sf).select("model", "incident_id",
                                    X.predicted_label(X.proba_array(SC.P), L).alias("predicted_class"))


@query("risk_band", with_(SCORED, """
SELECT model, incident_id, ROUND(p1 + 2 * p2 + 3 * p3, 6) AS risk_index,
  CASE WHEN p1 + 2 * p2 + 3 * p3 < 0.3 THEN 'low' WHEN p1 + 2 * p2 + 3 * p3 < 1 THEN 'medium' ELSE 'high' END
    AS risk_band
FROM pred"""))
def q_risk_band(spark, sf):
    df = scored(spark, sf).select("model", "incident_id", X.risk_index(SC.P).alias("risk_index"))
    return rounded(SC.risk_band(df))


# ------------------------------------------------------------ ranked reports
_SLOPE_FEATURES = ["is_night", "is_wet", "is_highway", "is_dark", "is_bad_weather", "airbag_deployed",
                   "is_old_vehicle", "speed_ratio"]


def _slopes(spark, sf) -> DataFrame:
    """Least-squares slope of the label code on each feature (one aggregation)."""
    cleaned, _, _ = FE.clean_incidents(incidents(spark, sf))
    row = cleaned.agg(*[(F.covar_pop(c, F.col("label").cast("double")) / F.var_pop(c)).alias(c)
                        for c in _SLOPE_FEATURES])
    parts = ", ".join(f"'{c}', `{c}`" for c in _SLOPE_FEATURES)
    return row.selectExpr(f"stack({len(_SLOPE_FEATURES)}, {parts}) as (Feature, Coefficient)")


_SLOPES_SQL = CLEAN + """,
f2 AS (SELECT c.*, COALESCE(pre / NULLIF(lim, 0), 0) AS speed_ratio FROM c),
sl AS (""" + "\n  UNION ALL ".join(
    f"SELECT '{c}' AS \"Feature\", covar_pop({c}, label) / var_pop({c}) AS \"Coefficient\" FROM f2"
    for c in _SLOPE_FEATURES) + ")"


@query("coef_ranking", with_(_SLOPES_SQL, """
SELECT "Feature", ROUND("Coefficient", 6) AS "Coefficient" FROM sl
ORDER BY abs("Coefficient") DESC, "Feature" LIMIT 10"""))
def q_coef_ranking(spark, sf):
    from ..models.ordinal import coef_ranking
    return rounded(coef_ranking(_slopes(spark, sf), k=10))


@query("odds_ratio", with_(_SLOPES_SQL, """
SELECT "Feature", ROUND("Coefficient", 6) AS "Coefficient", ROUND(exp("Coefficient"), 6) AS "Odds_Ratio",
  CASE WHEN exp("Coefficient") > 1 THEN printf('↑ %.2fx higher severity', exp("Coefficient"))
       WHEN exp("Coefficient") < 1 AND exp("Coefficient") > 0
         THEN printf('↓ %.2fx lower severity', 1 / exp("Coefficient"))
       ELSE 'No effect' END AS "Interpretation"
FROM sl ORDER BY abs(ln(exp("Coefficient"))) DESC, "Feature" LIMIT 15"""))
def q_odds_ratio(spark, sf):
    from ..models.ordinal import odds_ratio
    return rounded(odds_ratio(_slopes(spark, sf), k=15))


@query("top_k_report", with_(_CLS.split(",\ncls AS", 1)[0] + "," + """
b AS (""" + "\n UNION ALL".join(
    f"""
  SELECT '{name}' AS condition, '{x}' AS severity,
    COUNT(*) FILTER (WHERE COALESCE({col} = '{val}', false)) AS nc,
    COUNT(*) FILTER (WHERE severity = '{x}') AS ns,
    COUNT(*) FILTER (WHERE COALESCE({col} = '{val}', false) AND severity = '{x}') AS ncs,
    COUNT(*) AS n FROM i""" for col, val, name in C.RISK_CONDITIONS for x in L) + """
),
bt AS (SELECT condition, severity,
  (CASE WHEN ns = 0 THEN 0 ELSE ncs / ns END) * (ns / n) / (nc / n) AS p FROM b WHERE nc > 0)""", """
SELECT condition, severity, ROUND(p, 6) AS p_sev_given_cond FROM bt
ORDER BY p DESC, condition, severity LIMIT 10"""))
def q_top_k_report(spark, sf):
    bt = ST.bayes_table(incidents(spark, sf), C.RISK_CONDITIONS, "severity", L)
    top = EV.top_k(bt, "p_sev_given_cond", 10, desc=True, tie_break=["condition", "severity"])
    return rounded(top.select("condition", "severity", "p_sev_given_cond"))


# ------------------------------------------------------------- corrections
_CORR_COLS = ['incident_id', '"speedLimit"', '"precrashSpeed"', '"isNight"', '"isWet"', '"isDark"',
              '"isBadWeather"', 'airbag']
_SCEN_PART = _SCEN_SQL.split(INCIDENTS + ",", 1)[1]
_CORR_BASE = SCORED + "," + _SCEN_PART + """,
s0 AS (
  SELECT """ + ", ".join("sc." + c for c in _CORR_COLS) + """, pred.p0, pred.p1, pred.p2, pred.p3,
    sc."precrashSpeed" / CASE WHEN sc."speedLimit" > 0 THEN sc."speedLimit" ELSE 35 END AS r
  FROM sc JOIN pred ON pred.incident_id = sc.incident_id AND pred.model = 'speed'
)"""


def _stage(src: str, dst: str, cond: str, take: dict, give: dict) -> str:
    """SQL stage: where cond, p -= take[p], p += give[p] (all on the input values)."""
    sets = []
    for p in ["p0", "p1", "p2", "p3"]:
        e = p
        if p in take:
            e += f" - ({take[p]})"
        if p in give:
            e += f" + ({give[p]})"
        sets.append(f"CASE WHEN COALESCE({cond}, false) THEN {e} ELSE {p} END AS {p}")
    keep = ", ".join(_CORR_COLS + ["r"])
    return f"{dst} AS (SELECT {keep}, {', '.join(sets)} FROM {src})"


_OVER = "p0 * LEAST((r - 1) / 3, 1) * 0.7"
_EXT_E = "POWER(LEAST(1, (\"precrashSpeed\" - 80) / 120), 0.7)"
_EXT_S = f"(p0 * {_EXT_E} * 0.85)"
_EXT_M = f"(p1 * {_EXT_E} * 0.5)"
_HAZ = "(\"isNight\" + \"isWet\" + \"isDark\" + \"isBadWeather\" + CAST(r > 1.5 AS INTEGER) + airbag)"
_COMP = f"p0 * LEAST(({_HAZ} - 2) / 4.0, 0.6)"
_AIR = "(p0 - 0.3) * 0.5"


def _s_over(src, dst):
    return _stage(src, dst, "r > 1", {"p0": _OVER}, {"p1": f"{_OVER} * 0.35", "p2": f"{_OVER} * 0.40",
                                                     "p3": f"{_OVER} * 0.25"})


def _s_ext(src, dst):
    return _stage(src, dst, "\"precrashSpeed\" > 80", {"p0": _EXT_S, "p1": _EXT_M},
                  {"p2": f"({_EXT_S} + {_EXT_M}) * 0.35", "p3": f"({_EXT_S} + {_EXT_M}) * 0.65"})


def _s_comp(src, dst):
    return _stage(src, dst, f"{_HAZ} >= 3", {"p0": _COMP}, {"p1": f"{_COMP} * 0.3", "p2": f"{_COMP} * 0.4",
                                                           "p3": f"{_COMP} * 0.3"})


def _s_air(src, dst):
    return _stage(src, dst, "airbag <> 0 AND p0 > 0.5", {"p0": _AIR},
                  {"p1": f"{_AIR} * 0.5", "p2": f"{_AIR} * 0.35", "p3": f"{_AIR} * 0.15"})


def _s_norm(src, dst):
    keep = ", ".join(_CORR_COLS + ["r"])
    clip = {p: f"LEAST(GREATEST({p}, 0), 1)" for p in ["p0", "p1", "p2", "p3"]}
    tot = " + ".join(clip.values())
    sets = ", ".join(f"CASE WHEN {tot} > 0 THEN {c} / ({tot}) ELSE {c} END AS {p}" for p, c in clip.items())
    return f"{dst} AS (SELECT {keep}, {sets} FROM {src})"


_OUT = "SELECT incident_id, ROUND(p0, 6) AS p0, ROUND(p1, 6) AS p1, ROUND(p2, 6) AS p2, ROUND(p3, 6) AS p3 FROM "


def _corr_query(stage_fn):
    def run(spark, sf):
        return rounded(stage_fn(scored_scenarios(spark, sf)).select("incident_id", *SC.P))
    return run


for _key, _fn, _sql in [("correct_overspeed", SC.correct_overspeed, _s_over),
                        ("correct_extreme_speed", SC.correct_extreme_speed, _s_ext),
                        ("correct_compound", SC.correct_compound, _s_comp),
                        ("correct_airbag", SC.correct_airbag, _s_air),
                        ("normalize_proba", SC.normalize_proba, _s_norm)]:
    query(_key, with_(_CORR_BASE + ",\n" + _sql("s0", "s1"), _OUT + "s1"))(_corr_query(_fn))


@query("correction_chain", with_(_CORR_BASE + ",\n" + ",\n".join(
    [_s_over("s0", "s1"), _s_ext("s1", "s2"), _s_comp("s2", "s3"), _s_air("s3", "s4"), _s_norm("s4", "s5")]),
    f"""SELECT incident_id, ROUND(p0, 4) AS p0, ROUND(p1, 4) AS p1, ROUND(p2, 4) AS p2, ROUND(p3, 4) AS p3,
  ROUND(p1 + 2 * p2 + 3 * p3, 4) AS risk_index,
  ({_NAMES})[CASE GREATEST(p0, p1, p2, p3) WHEN p0 THEN 1 WHEN p1 THEN 2 WHEN p2 THEN 3 ELSE 4 END]
    AS predicted_class
FROM s5"""))
def q_correction_chain(spark, sf):
    out = SC.finalize_scores(SC.apply_corrections(scored_scenarios(spark, sf)), "fixed scorer")
    return out.select("incident_id", *SC.P, "risk_index", "predicted_class")
