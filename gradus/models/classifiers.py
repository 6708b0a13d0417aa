"""Classifiers behind one prediction contract.

Every fitted model turns a frame with a ``features`` vector into
``p0..p{k-1}`` (fixed label positions) and ``prediction`` (first maximum),
so all evaluation operators work on any model.  The forest and the logistic
baseline are MLlib's; boosting (multinomial), network (ReLU, L2, early
stopping) and kernel machine are fitted here by passes that sum NumPy
gradients (``passes``, ``joint``), since MLlib has none with these parts.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..operators.sampling import class_weights
from . import boosting, kernel, network


def _with_probs(df: DataFrame, arr, k: int) -> DataFrame:
    """p_j = arr[j] when the model knows class j, else 0 (full_proba)."""
    cols = {f"p{j}": F.coalesce(F.try_element_at(arr, F.lit(j + 1)), F.lit(0.0)).cast("double") for j in range(k)}
    out = df.withColumns(cols)
    parr = F.array(*[F.col(f"p{j}") for j in range(k)])
    return out.withColumn("prediction", (F.array_position(parr, F.array_max(parr)) - 1).cast("int"))


def _linear(arrays: dict):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def proba(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        return pd.Series(list(boosting.softmax(np.stack(x.to_numpy()) @ arrays["coefficients"].T + arrays["intercepts"])))
    return proba


#: probabilities from the arrays of a model, by its kind
ARRAY_KINDS = {"gbt": boosting.probabilities, "mlp": network.probabilities, "svm": kernel.probabilities, "lr": _linear}


@dataclass
class FittedClassifier:
    """A fitted model with the common ``predict`` contract: arrays, or an MLlib forest."""

    kind: str
    k: int
    model: object = None
    arrays: dict = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c not in ("rawPrediction", "probability", "prediction")]
        base = df.select(*keep)
        if self.kind == "rf":
            out = self.model.transform(base)
            out = _with_probs(out.drop("prediction"), vector_to_array(F.col("probability")), self.k)
            return out.drop("rawPrediction", "probability")
        if self.kind not in ARRAY_KINDS:
            raise ValueError(self.kind)
        out = base.withColumn("_proba", ARRAY_KINDS[self.kind](self.arrays)(vector_to_array(F.col("features"))))
        return _with_probs(out, F.col("_proba"), self.k).drop("_proba")

    def feature_importances(self) -> np.ndarray | None:
        if self.kind == "rf":
            return self.model.featureImportances.toArray()
        if self.kind == "gbt":
            return boosting.importances(self.arrays, len(self.arrays["edge_ends"]))
        return None


# ------------------------------------------------------------------ forest
#: a forest's task holds its rows unpacked, so a whole Parquet split can be much
FOREST_ROWS = 250_000


def forest_rows(trees: int) -> int:
    """Rows of a task: a row is kept with a count for each tree, so 20 trees have ``FOREST_ROWS``."""
    return FOREST_ROWS * (220 + 4 * 20) // (220 + 4 * max(trees, 20))


def in_parts(df: DataFrame, rows: int = FOREST_ROWS) -> DataFrame:
    """``df`` dealt out evenly if its parts hold more than ``rows`` rows on average."""
    need = -(-df.count() // rows)
    return df.repartition(need) if need > df.rdd.getNumPartitions() else df


def fit_random_forest(train: DataFrame, k: int = 4, weighted: bool = True, num_trees: int = C.RF_TREES,
                      max_depth: int = C.RF_DEPTH, seed: int = C.SEED) -> FittedClassifier:
    """Random forest; ``weighted`` uses balanced class weights."""
    train = train.select("label", "features")
    # weights first: their count of classes would deal the rows out once more
    data = in_parts(class_weights(train, "label") if weighted else train, forest_rows(num_trees))
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=num_trees, maxDepth=max_depth,
                                featureSubsetStrategy="sqrt", seed=seed, impurity="gini")
    if weighted:
        rf.setWeightCol("weight")
    return FittedClassifier("rf", k, rf.fit(data.withColumn("label", F.col("label").cast("double"))))


# ---------------------------------------------------------------- logistic
def fit_logistic(train: DataFrame, k: int = 4, max_iter: int = C.LR_MAX_ITER, weighted: bool = True,
                 c: float = 1.0) -> FittedClassifier:
    """Multinomial logistic regression with balanced weights and L2 (C = 1).

    MLlib minimises the weighted mean loss, so the penalty 1/(2C)·|β|² on the
    summed loss becomes regParam = 1 / (C · Σw).
    """
    data = class_weights(train, "label") if weighted else train.withColumn("weight", F.lit(1.0))
    total_w = data.agg(F.sum("weight")).first()[0]
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", family="multinomial",
                            maxIter=max_iter, regParam=1.0 / (c * total_w), elasticNetParam=0.0,
                            standardization=False)
    fitted = lr.fit(data.withColumn("label", F.col("label").cast("double")))
    coef, start = np.zeros((k, fitted.numFeatures)), np.full(k, -1e30)  # a class that training lacks gets probability 0
    found = min(k, fitted.numClasses)
    coef[:found], start[:found] = fitted.coefficientMatrix.toArray()[:found], fitted.interceptVector.toArray()[:found]
    return FittedClassifier("lr", k, arrays={"coefficients": coef, "intercepts": np.maximum(start, -1e30)})


# ------------------------------------------------------- own estimators
def fit_gbt(train: DataFrame, k: int = 4, rounds: int = C.GBT_ROUNDS, depth: int = C.GBT_DEPTH,
            step: float = C.GBT_STEP, subsample: float = C.GBT_SUBSAMPLE, seed: int = C.SEED) -> FittedClassifier:
    """Multinomial boosting; a class absent from training gets a probability near 0."""
    return FittedClassifier("gbt", k, arrays=boosting.fit(train, k, rounds, depth, step, subsample, seed))


def fit_mlp(train: DataFrame, k: int = 4, hidden: list[int] = C.MLP_HIDDEN, max_iter: int = C.MLP_MAX_ITER,
            seed: int = C.SEED) -> FittedClassifier:
    """Feed-forward network: ReLU, L2, early stopping on a held-out share."""
    return FittedClassifier("mlp", k, arrays=network.fit(train, k, hidden, max_iter, seed=seed))


def fit_svm(train: DataFrame, k: int = 4, components: int = 300, max_iter: int = 100, seed: int = C.SEED) -> FittedClassifier:
    """RBF machine on landmark features (gamma by the 'scale' rule), calibrated out of fold."""
    return FittedClassifier("svm", k, arrays=kernel.fit(train, k, components, max_iter, seed=seed))


# ------------------------------------------------------------ validation
def cross_validate(fit_fn, df: DataFrame, fold_col: str = "fold", k_folds: int = C.CV_FOLDS,
                   parallelism: int = 2) -> dict:
    """Accuracy per fold (train on the other folds), mean and population std."""
    data = df.persist()

    def one(f):
        model = fit_fn(data.where(F.col(fold_col) != f))
        pred = model.predict(data.where(F.col(fold_col) == f))
        return pred.agg(F.avg((F.col("label").cast("int") == F.col("prediction")).cast("double"))).first()[0]

    try:
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            scores = list(pool.map(one, range(k_folds)))
    finally:
        data.unpersist()
    arr = np.array(scores, dtype=float)
    return {"scores": scores, "mean": float(arr.mean()), "std": float(arr.std())}


def feature_importance(spark, fitted: FittedClassifier, names: list[str]) -> DataFrame | None:
    imp = fitted.feature_importances()
    if imp is None:
        return None
    rows = [(n, float(v)) for n, v in zip(names, imp)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), F.col("feature"))
