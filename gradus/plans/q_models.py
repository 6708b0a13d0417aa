"""Queries: sampling, model fitting, explanation, scoring, sinks and jobs
(SURVEY §2.1, §2.3, §2.5-2.7).

Splits and folds are oracle-checked with a modular ordering key (the oracle
cannot compute xxhash64); model fits are checked rows-only (tests check
their invariants).  ``fit_svm_rbf`` and ``job_retrain`` fit at the application's sizes
(``FULL``), the others at the reduced ``QUICK`` sizes.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from .. import config as C
from ..models import classifiers as CL
from ..models.importance import permutation_importance
from ..models.ordinal import OrdinalLogitModel
from ..operators import features as FE
from ..operators import sampling as SA
from ..operators.smote import smote
from ..session import scratch_path, stored
from ..sources import models as MS
from ..sources import reports as RS
from ..sources.incidents import scenario_choices
from ..streaming import scoring as SS
from . import training as TR
from .fixtures import incidents
from .oracle import CLEAN, with_
from .registry import query, rounded

L = C.SEVERITY_LABELS
ID = C.ID_COL


def _modular_order():
    return (F.col(ID) * 7919) % 1009


_LAB = CLEAN + """,
lab AS (SELECT incident_id, label FROM c WHERE label IS NOT NULL)"""

_SPLIT = _LAB + """,
cnt AS (SELECT label, COUNT(*) AS nc FROM lab GROUP BY label),
tot AS (SELECT SUM(nc) AS n, CAST(CEIL(0.2e0 * SUM(nc)) AS BIGINT) AS n_test FROM cnt),
alloc AS (SELECT label, nc, n, n_test, nc * (n - n_test) / n AS cont, FLOOR(nc * (n - n_test) / n) AS fl
          FROM cnt, tot),
need AS (SELECT MAX(n) - MAX(n_test) - SUM(fl) AS need FROM alloc),
rnk AS (SELECT alloc.*, ROW_NUMBER() OVER (ORDER BY cont - fl DESC, label) AS rr FROM alloc),
quota AS (SELECT label, nc - (fl + CASE WHEN rr <= need THEN 1 ELSE 0 END) AS t FROM rnk, need),
hs AS (SELECT lab.*, ROW_NUMBER() OVER (PARTITION BY label ORDER BY (incident_id * 7919) % 1009, incident_id) AS rk
       FROM lab),
split AS (SELECT hs.incident_id, hs.label, hs.rk <= quota.t AS is_test FROM hs JOIN quota ON hs.label = quota.label)"""


def _labelled(spark, sf):
    return FE.encode_ordinal(incidents(spark, sf), "severity", L).where(F.col("label").isNotNull()).select(ID, "label")


@query("split_stratified", with_(_SPLIT, "SELECT incident_id, label, is_test FROM split"))
def q_split_stratified(spark, sf):
    return SA.split_stratified(_labelled(spark, sf), "label", order=_modular_order()).select(ID, "label", "is_test")


@query("kfold", with_(_LAB + """,
nn AS (SELECT COUNT(*) AS n FROM lab),
r AS (SELECT incident_id, ROW_NUMBER() OVER (ORDER BY (incident_id * 7919) % 1009, incident_id) - 1 AS r FROM lab)""",
    """SELECT incident_id, CAST(CASE WHEN r < (n % 5) * (n // 5 + 1) THEN r // (n // 5 + 1)
     ELSE (n % 5) + (r - (n % 5) * (n // 5 + 1)) // (n // 5) END AS INTEGER) AS fold FROM r, nn"""))
def q_kfold(spark, sf):
    return SA.kfold(_labelled(spark, sf), 5, order=_modular_order()).select(ID, "fold")


@query("class_weights", with_(_LAB + """,
cnt AS (SELECT label, COUNT(*) AS nc FROM lab GROUP BY label),
tot AS (SELECT SUM(nc) AS n, COUNT(*) AS k FROM cnt)""", """
SELECT lab.incident_id, lab.label, ROUND(n / (k * nc), 6) AS weight
FROM lab JOIN cnt ON lab.label = cnt.label, tot"""))
def q_class_weights(spark, sf):
    return rounded(SA.class_weights(_labelled(spark, sf), "label").select(ID, "label", "weight"))


@query("class_counts", with_(_SPLIT + """,
tr AS (SELECT label, COUNT(*) AS b FROM split WHERE NOT is_test GROUP BY label),
names AS (SELECT * FROM (VALUES (0, 'POD'), (1, 'Minor'), (2, 'Moderate'), (3, 'Serious')) t(code, name))""", """
SELECT names.name AS label, CAST(COALESCE(tr.b, 0) AS BIGINT) AS before,
  CAST((SELECT MAX(b) FROM tr) AS BIGINT) AS after
FROM names LEFT JOIN tr ON tr.label = names.code"""))
def q_class_counts(spark, sf):
    feats, _ = FE.fit_features(incidents(spark, sf))
    labelled = feats.where(F.col("label").isNotNull())
    split = stored(SA.split_stratified(labelled, "label", order=_modular_order()), "split")
    train = split.where(~F.col("is_test"))
    return SA.class_counts(train, smote(train, id_col=ID), L)


@query("smote")
def q_smote(spark, sf):
    """Resampled training rows: label, synthetic flag, feature values."""
    return TR.cached_resampled(spark, sf).select("label", "synthetic", vector_to_array("features").alias("x"))


# ------------------------------------------------------------------ models
_BETA = [0.8, 0.5, 0.3, 1.2]
_THETA = [2.0, 3.0, 4.0]
_OLR_X = ["speed_ratio", "is_night", "is_wet", "airbag_deployed"]
_ETA_SQL = "0e0 + " + " + ".join(f"{c} * {b}" for c, b in zip(_OLR_X, _BETA))
_CUM = [f"1e0 / (1e0 + exp(({_ETA_SQL}) - {t}))" for t in _THETA]


@query("ordinal_proba", with_(CLEAN + """,
f2 AS (SELECT c.*, COALESCE(pre / NULLIF(lim, 0), 0) AS speed_ratio FROM c),
cp AS (SELECT incident_id, """ + ", ".join(f"{e} AS f{i}" for i, e in enumerate(_CUM)) + """ FROM f2),
rp AS (SELECT incident_id, GREATEST(f0, 0e0) AS r0, GREATEST(f1 - f0, 0e0) AS r1, GREATEST(f2 - f1, 0e0) AS r2,
              GREATEST(1e0 - f2, 0e0) AS r3 FROM cp),
pp AS (SELECT incident_id, r0 / (0e0 + r0 + r1 + r2 + r3) AS p0, r1 / (0e0 + r0 + r1 + r2 + r3) AS p1,
              r2 / (0e0 + r0 + r1 + r2 + r3) AS p2, r3 / (0e0 + r0 + r1 + r2 + r3) AS p3 FROM rp)""", """
SELECT incident_id, ROUND(p0, 6) AS p0, ROUND(p1, 6) AS p1, ROUND(p2, 6) AS p2, ROUND(p3, 6) AS p3,
  CASE GREATEST(p0, p1, p2, p3) WHEN p0 THEN 0 WHEN p1 THEN 1 WHEN p2 THEN 2 ELSE 3 END AS prediction
FROM pp"""))
def q_ordinal_proba(spark, sf):
    """A fixed-parameter proportional-odds model applied to incident features."""
    cleaned, _, _ = FE.clean_incidents(incidents(spark, sf))
    vec = VectorAssembler(inputCols=_OLR_X, outputCol="features").transform(
        cleaned.withColumns({c: F.col(c).cast("double") for c in _OLR_X}))
    model = OrdinalLogitModel(np.array(_BETA), np.array(_THETA), _OLR_X, L)
    return rounded(model.transform(vec).select(ID, "p0", "p1", "p2", "p3", "prediction"))


@query("fit_ordinal_logit")
def q_fit_ordinal_logit(spark, sf):
    """Fitted coefficients and thresholds (rows: Feature, Coefficient)."""
    tr = TR.cached_training(spark, sf, TR.QUICK, which=("OLR",))
    m = tr.ordinal
    rows = [(n, float(c)) for n, c in zip(m.feature_names, m.coef)]
    rows += [(f"threshold_{j}", float(t)) for j, t in enumerate(m.thresholds)]
    return spark.createDataFrame(rows, "Feature string, Coefficient double")


def _model_predictions(key, sizes=TR.QUICK):
    def run(spark, sf):
        tr = TR.cached_training(spark, sf, sizes, which=(key,))
        return tr.predictions
    run.__doc__ = f"Test-row predictions of the {key} model."
    return run


for _q, _m in [("fit_random_forest", "RF"), ("fit_rf_smote", "RF_SMOTE"), ("fit_ordinal_smote", "OLR_SMOTE"),
               ("fit_gbt", "GBM"), ("fit_mlp", "MLP")]:
    query(_q)(_model_predictions(_m))
query("fit_svm_rbf")(_model_predictions("SVM", TR.FULL))


@query("fit_logistic")
def q_fit_logistic(spark, sf):
    """Multinomial logistic baseline, test-row predictions."""
    prep = TR.cached_prepared(spark, sf)
    m = CL.fit_logistic(prep.train, len(L), TR.QUICK.lr_iter)
    return m.predict(prep.test).select(F.lit("LR").alias("model"), ID, "label", "p0", "p1", "p2", "p3",
                                       "prediction")


@query("cross_validate")
def q_cross_validate(spark, sf):
    prep = TR.cached_prepared(spark, sf)
    return TR.cross_validation_report(spark, prep, TR.QUICK)


@query("feature_importance")
def q_feature_importance(spark, sf):
    tr = TR.cached_training(spark, sf, TR.QUICK, which=("RF",))
    return CL.feature_importance(spark, tr.models["RF"], tr.prepared.feature_model.feature_names)


@query("permutation_importance")
def q_permutation_importance(spark, sf):
    tr = TR.cached_training(spark, sf, TR.QUICK, which=("RF",))
    return permutation_importance(tr.models["RF"], tr.prepared.test, tr.prepared.feature_model.feature_names,
                                  TR.QUICK.perm_repeats)


# ----------------------------------------------------------------- scoring
def _scenarios(spark, sf):
    return FE.scenario_encode(scenario_choices(incidents(spark, sf)))


@query("score_batch")
def q_score_batch(spark, sf):
    """Forest probabilities + risk index for scenario rows derived from every incident."""
    tr = TR.cached_training(spark, sf, TR.QUICK, which=("RF",))
    return TR.score_batch(_scenarios(spark, sf), tr.models["RF"], tr.prepared.feature_model)


@query("preset_scenarios")
def q_preset_scenarios(spark, sf):
    tr = TR.cached_training(spark, sf, TR.QUICK, which=("RF",))
    return TR.preset_scenarios(spark, tr.models["RF"], tr.prepared.feature_model)


@query("score_corrected")
def q_score_corrected(spark, sf):
    tr = TR.cached_training(spark, sf, TR.QUICK, which=("RF",))
    return TR.score_corrected(_scenarios(spark, sf), tr.models["RF"], tr.prepared.feature_model,
                              "Random Forest + Domain Corrections")


@query("score_stream")
def q_score_stream(spark, sf):
    """Scenario rows written as Parquet files, scored by a streaming query that
    follows the published version of the forest; returns the stream's output."""
    from . import jobs
    tr = TR.cached_training(spark, sf, TR.QUICK, which=("RF",))
    base = scratch_path(spark, "score-stream")
    root, inbox, out = (os.path.join(base, x) for x in ("published", "inbox", "out"))
    jobs.publish(spark, root, *jobs.new_version(root), tr.models, tr.prepared.feature_model)
    _scenarios(spark, sf).write.mode("overwrite").parquet(inbox)
    stream = spark.readStream.schema(spark.read.parquet(inbox).schema).parquet(inbox)
    SS.follow_versions(stream, root, out, os.path.join(base, "ckpt")).awaitTermination()
    return SS.scored(spark, out).drop("batch", "version")


# -------------------------------------------------------- sinks and jobs
@query("sink_reports")
def q_sink_reports(spark, sf):
    """Writes every report table and returns the written index."""
    tr = TR.cached_training(spark, sf, TR.QUICK)
    reps = TR.build_reports(spark, incidents(spark, sf), tr, TR.QUICK)
    return RS.write_reports(spark, reps, scratch_path(spark, "reports"))


@query("sink_model")
def q_sink_model(spark, sf):
    """Save all seven models + feature parameters; returns what each says of itself."""
    tr = TR.cached_training(spark, sf, TR.QUICK)
    path, rows = scratch_path(spark, "model"), []
    for name, model in tr.models.items():
        MS.save_model(model, tr.prepared.feature_model, os.path.join(path, name))
        info = MS.model_info(spark, os.path.join(path, name))
        rows.append((name, info["kind"], info["k"], info["format"], len(info["features"]["feature_names"])))
    return spark.createDataFrame(rows, "model string, kind string, classes int, format int, n_features int")


@query("src_model")
def q_src_model(spark, sf):
    """Reload every saved model and score the test rows with it."""
    tr = TR.cached_training(spark, sf, TR.QUICK)
    path, out = scratch_path(spark, "model"), None
    for name, model in tr.models.items():
        MS.save_model(model, tr.prepared.feature_model, os.path.join(path, name))
        again, _ = MS.load_model(spark, os.path.join(path, name))
        got = again.predict(tr.prepared.test).select(F.lit(name).alias("model"), ID, "label", "p0", "p1", "p2", "p3", "prediction")
        out = got if out is None else out.unionByName(got)
    return out


@query("job_retrain")
def q_job_retrain(spark, sf):
    """Refit and republish to a fresh version; returns the published index."""
    from . import jobs
    root = scratch_path(spark, "published")
    return jobs.retrain(spark, incidents(spark, sf), root, TR.FULL, on_missing="drop")
