"""The training job: features → split → resample → fits → evaluation reports.

Mirrors the analysed application's training run as Spark jobs.  Feature
rows are checkpointed once (lineage cut to the shared checkpoint folder) and
reused by every fit; all evaluation reports come from ONE stacked
predictions table ``(model, id, label, p0..p3, prediction)`` grouped by
model.  Model sizes are parameters: ``FULL`` are the application's sizes,
``QUICK`` the reduced sizes used by the bench and by all registered queries but
``fit_svm_rbf`` and ``job_retrain``.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import columns as X
from ..models import classifiers as CL
from ..models import joint
from ..models.importance import permutation_importance
from ..models.ordinal import OrdinalClassifier, OrdinalLogit, OrdinalLogitModel, coef_ranking, odds_ratio
from ..operators import evaluate as EV
from ..operators import features as FE
from ..operators import sampling as SA
from ..operators import scoring as SC
from ..operators import stats as ST
from ..operators.smote import smote
from ..session import ensure_checkpoint_dir, stored


@dataclass(frozen=True)
class Sizes:
    rf_trees: int
    rf_depth: int
    gbt_rounds: int
    gbt_depth: int
    mlp_hidden: tuple
    mlp_iter: int
    ordinal_iter: int
    lr_iter: int
    svm_components: int
    svm_iter: int
    perm_repeats: int
    cv_folds: int = C.CV_FOLDS


FULL = Sizes(C.RF_TREES, C.RF_DEPTH, C.GBT_ROUNDS, C.GBT_DEPTH, tuple(C.MLP_HIDDEN), C.MLP_MAX_ITER,
             C.ORDINAL_MAX_ITER, C.LR_MAX_ITER, 300, 100, C.PERMUTATION_REPEATS)
#: the ordinal and the logistic fit run to the application's limits; the others are cut
QUICK = Sizes(20, 10, 5, 5, (16, 8), 30, C.ORDINAL_MAX_ITER, C.LR_MAX_ITER, 60, 30, 2)


#: side by side
FITS = 4


@dataclass
class Prepared:
    features: DataFrame          # id, label, feature columns, features vector
    feature_model: FE.FeatureModel
    split: DataFrame             # features + is_test (checkpointed)
    train: DataFrame
    test: DataFrame


@dataclass
class Trained:
    prepared: Prepared
    models: dict = field(default_factory=dict)
    resampled: DataFrame | None = None
    predictions: DataFrame | None = None
    ordinal: OrdinalLogitModel | None = None


_CACHE: dict = {}


def prepare(spark: SparkSession, incidents: DataFrame, task: C.TaskConfig = C.DEFAULT_TASK,
            test_fraction: float = C.SPLIT_TEST_FRACTION, seed: int = C.SEED,
            on_missing: str = "fail") -> Prepared:
    """Features and split.  Rows with an unknown label or without a mileage cannot be
    trained on: an error that names their counts, or (``on_missing="drop"``) left out."""
    if on_missing not in ("fail", "drop"):
        raise ValueError("on_missing is 'fail' or 'drop'")
    ensure_checkpoint_dir(spark)
    known = F.col(task.label_col).isin(task.labels)
    number = {c: X.to_double(c) for c in task.numeric if c in incidents.columns and c not in (C.SPEED_LIMIT, C.PRECRASH)}
    whole = reduce(lambda a, b: a & b, [v.isNotNull() for v in number.values()], F.coalesce(known, F.lit(False)))
    if on_missing == "drop":
        incidents = incidents.where(whole)
    else:
        lost = incidents.agg(F.count_if(~F.coalesce(known, F.lit(False))).alias(task.label_col),
                             *[F.count_if(v.isNull()).alias(c) for c, v in number.items()]).first().asDict()
        if any(lost.values()):
            raise ValueError(f"rows that cannot be trained on: {lost}")
    # the fit passes (medians, levels, scaler, class counts) all read the
    # input; keep it materialised (memory + disk, recomputable) until the
    # split is checkpointed
    src = incidents.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        feats, fmodel = FE.fit_features(src, task)
        labelled = feats.where(F.col("label").isNotNull())
        split = stored(SA.split_stratified(labelled, "label", test_fraction, seed, task.id_col), "split")
    finally:
        src.unpersist()
    train = split.where(~F.col("is_test")).drop("is_test")
    test = split.where(F.col("is_test")).drop("is_test")
    return Prepared(feats, fmodel, split, train, test)


def _tag(pred: DataFrame, name: str, id_col: str) -> DataFrame:
    return pred.select(F.lit(name).alias("model"), id_col, F.col("label").cast("int").alias("label"),
                       "p0", "p1", "p2", "p3", "prediction")


def _together(fits: list) -> list:
    """The results of ``fits``, run side by side, the longest (the last) first.

    A fit is a chain of short passes, and between them cores are idle that others can use;
    tasks, and so what executors hold, are as many as with one fit.
    """
    with ThreadPoolExecutor(max_workers=FITS) as pool:
        done = [pool.submit(fit) for fit in reversed(fits)]
        try:
            return [f.result() for f in reversed(done)]
        finally:
            for f in done:
                f.cancel()  # after an error


def resample(prep: Prepared, task: C.TaskConfig = C.DEFAULT_TASK) -> DataFrame:
    """SMOTE on the training part (stored: it feeds several fits)."""
    return stored(smote(prep.train, "label", "features", seed=C.SEED, id_col=task.id_col), "resampled")


def train_all(spark: SparkSession, incidents: DataFrame | None, sizes: Sizes = FULL,
              task: C.TaskConfig = C.DEFAULT_TASK, which: tuple | None = None,
              prep: Prepared | None = None, resampled: DataFrame | None = None,
              on_missing: str = "fail") -> Trained:
    """Fit the seven models of the application and predict the test rows.

    ``prep`` / ``resampled`` reuse an earlier split / SMOTE output.
    """
    prep = prep or prepare(spark, incidents, task, on_missing=on_missing)
    k, idc = task.k, task.id_col
    out = Trained(prep)
    want = set(which or ("OLR", "RF", "OLR_SMOTE", "RF_SMOTE", "GBM", "MLP", "SVM"))
    train = prep.train
    needs_smote = want & {"OLR_SMOTE", "RF_SMOTE", "GBM", "MLP", "SVM"}
    if needs_smote:
        out.resampled = resampled if resampled is not None else resample(prep, task)
    sm = out.resampled
    names, ordinal = prep.feature_model.feature_names, OrdinalLogit(task.labels, max_iter=sizes.ordinal_iter)
    fits = {
        "OLR": lambda: OrdinalClassifier(ordinal.fit(train, names)),
        "RF": lambda: CL.fit_random_forest(train, k, True, sizes.rf_trees, sizes.rf_depth),
        "OLR_SMOTE": lambda: OrdinalClassifier(ordinal.fit(sm, names)),
        "RF_SMOTE": lambda: CL.fit_random_forest(sm, k, False, sizes.rf_trees, sizes.rf_depth),
        "GBM": lambda: CL.fit_gbt(sm, k, sizes.gbt_rounds, sizes.gbt_depth),
        "MLP": lambda: CL.fit_mlp(sm, k, list(sizes.mlp_hidden), sizes.mlp_iter),
        "SVM": lambda: CL.fit_svm(sm, k, sizes.svm_components, sizes.svm_iter),
    }
    own = [name for name in fits if name in want]
    out.models = dict(zip(own, _together([fits[name] for name in own])))
    if "OLR" in out.models:
        out.ordinal = out.models["OLR"].model
    preds = [_tag(m.predict(prep.test), name, idc) for name, m in out.models.items()]
    out.predictions = stored(reduce(DataFrame.unionByName, preds), "predictions")
    return out


def cached_prepared(spark: SparkSession, sf_dir: str) -> Prepared:
    """Feature fit + split once per (session, input folder) within a process."""
    from .fixtures import incidents
    key = ("prep", id(spark), sf_dir)
    if key not in _CACHE:
        _CACHE[key] = prepare(spark, incidents(spark, sf_dir), on_missing="drop")
    return _CACHE[key]


def cached_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ("smote", id(spark), sf_dir)
    if key not in _CACHE:
        _CACHE[key] = resample(cached_prepared(spark, sf_dir))
    return _CACHE[key]


def cached_training(spark: SparkSession, sf_dir: str, sizes: Sizes = QUICK, which: tuple | None = None) -> Trained:
    """Train once per (session, input folder, sizes, models) within a process;
    the split and the SMOTE output are shared by all model sets."""
    key = (id(spark), sf_dir, sizes, which)
    if key not in _CACHE:
        want = set(which or ("OLR", "RF", "OLR_SMOTE", "RF_SMOTE", "GBM", "MLP", "SVM"))
        needs = want & {"OLR_SMOTE", "RF_SMOTE", "GBM", "MLP", "SVM"}
        _CACHE[key] = train_all(spark, None, sizes, which=which, prep=cached_prepared(spark, sf_dir),
                                resampled=cached_resampled(spark, sf_dir) if needs else None)
    return _CACHE[key]


# ------------------------------------------------------------------ reports
def build_reports(spark: SparkSession, incidents: DataFrame, trained: Trained, sizes: Sizes = FULL,
                  task: C.TaskConfig = C.DEFAULT_TASK) -> dict[str, DataFrame]:
    """Every report table of the application's results document."""
    L, k, idc = task.labels, task.k, task.id_col
    prep = trained.prepared
    names = prep.feature_model.feature_names
    pred = trained.predictions
    rep: dict[str, DataFrame] = {}
    rep["severity_distribution"] = ST.value_counts(incidents, task.label_col, L).withColumnRenamed(
        task.label_col, "label")
    n_base = len(task.numeric) + len(task.engineered)
    rep["dataset"] = ST.dataset_kpis(incidents, task.label_col, L, task.one_hot, n_base)
    tags = {"OLR": "original", "RF": "original", "OLR_SMOTE": "smote", "RF_SMOTE": "smote", "GBM": "smote",
            "MLP": "smote", "SVM": "smote"}
    tag = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])
    metrics = EV.model_metrics(pred, L).withColumn("training_data", F.element_at(tag, F.col("model")))
    rep["models"] = EV.leaderboard(metrics)
    rep["confusion_matrix"] = EV.confusion_matrix(pred, L)
    rep["class_report"] = EV.class_report(pred, L)
    imps = []
    for name, m in trained.models.items():
        fi = CL.feature_importance(spark, m, names) if isinstance(m, CL.FittedClassifier) else None
        if fi is not None:
            imps.append(fi.select(F.lit(name).alias("model"), "feature", "importance"))
    if imps:
        rep["feature_importances"] = reduce(DataFrame.unionByName, imps)
    roc_pred = pred.where(F.col("model") != "OLR_SMOTE")
    roc = EV.roc_curve(roc_pred, k, L)
    rep["roc_curves"] = EV.roc_thin(roc, C.ROC_MAX_POINTS)
    rep["auc"] = EV.auc(roc_pred, k, L)
    rep["chi_square"] = ST.chi_square(incidents, C.CHI_SQUARE_COLUMNS, task.label_col)
    rep["bayes_analysis"] = ST.bayes_table(incidents, C.RISK_CONDITIONS, task.label_col, L)
    if trained.ordinal is not None:
        coefs = trained.ordinal.coefficients(spark)
        rep["olr_coefficients"] = coefs
        rep["odds_ratios"] = odds_ratio(coefs, 15)
        rep["olr_top_coefficients"] = coef_ranking(coefs, 10)
    if trained.resampled is not None:
        rep["smote"] = SA.class_counts(prep.train, trained.resampled, L)
    scaler = prep.feature_model.scaler
    rep["scaler_params"] = spark.createDataFrame(
        [(c, float(m), float(s)) for c, (m, s) in scaler.items()], "feature string, mean double, scale double")
    if "RF" in trained.models:
        rep["scenarios"] = preset_scenarios(spark, trained.models["RF"], prep.feature_model, L)
        rep["permutation_importance"] = permutation_importance(
            trained.models["RF"], prep.test, names, sizes.perm_repeats, C.SEED, idc).limit(15)
    return rep


def cross_validation_report(spark: SparkSession, prep: Prepared, sizes: Sizes, k: int = 4) -> DataFrame:
    """5-fold accuracy of the weighted forest and the logistic baseline on all rows."""
    folds = stored(SA.kfold(prep.features.where(F.col("label").isNotNull()), sizes.cv_folds), "folds")
    rf = CL.cross_validate(lambda d: CL.fit_random_forest(d, k, True, sizes.rf_trees, sizes.rf_depth),
                           folds.select("label", "features", "fold"), k_folds=sizes.cv_folds)
    # the logistic models of all folds share their passes
    lr = joint.logistic_by_folds(folds, sizes.cv_folds, k, max_iter=sizes.lr_iter)["accuracy"]
    return spark.createDataFrame([("RF", rf["mean"], rf["std"]), ("LR", float(lr.mean()), float(lr.std()))],
                                 "model string, mean double, std double")


def preset_scenarios(spark: SparkSession, model, fmodel: FE.FeatureModel, labels=C.SEVERITY_LABELS) -> DataFrame:
    """Score the four named scenarios (no corrections), rounded to 4."""
    rows = [(n, float(a), float(b), float(c), d, e, f, g, h, i) for n, a, b, c, d, e, f, g, h, i in C.PRESET_SCENARIOS]
    scen = spark.createDataFrame(rows, "name string, speedLimit double, precrashSpeed double, mileage double, "
                                       "isNight int, isWet int, isHighway int, isDark int, isBadWeather int, airbag int")
    scored = score_batch(scen, model, fmodel)
    return scored.select("name", SC.probability_map(labels).alias("probabilities"),
                         X.round_to(F.col("risk_index"), 4).alias("risk_index"))


def score_batch(scenarios: DataFrame, model, fmodel: FE.FeatureModel) -> DataFrame:
    """Scenario rows → model probabilities (fixed label positions) + risk index."""
    feats = FE.scenario_features(scenarios, fmodel)
    pred = model.predict(feats).drop(*fmodel.feature_names, "features")
    return pred.withColumn("risk_index", X.risk_index(SC.P))


def score_corrected(scenarios: DataFrame, model, fmodel: FE.FeatureModel, model_tag: str) -> DataFrame:
    """Scenario rows → probabilities + domain corrections + risk index + class."""
    feats = FE.scenario_features(scenarios, fmodel)
    pred = model.predict(feats).drop(*fmodel.feature_names, "features", "prediction")
    return SC.finalize_scores(SC.apply_corrections(pred), model_tag)
