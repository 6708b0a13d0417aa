"""Proportional-odds (cumulative logit) model.

    P(Y <= k | x) = sigmoid(theta_k - x·beta),  k = 0..K-2,  no intercept,
    0 < theta_0 < theta_1 < ... (the thresholds are kept positive and
    increasing, as a cumulative sum of exponentials would keep them),
    per-row likelihood floored at 1e-9.

MLlib has no ordinal model, so this is a custom estimator.  The fit is a
damped Newton method on (beta, theta) where the negative log-likelihood is
convex: every iteration is ONE distributed pass over the training rows, packed
as blocks (``passes``) — a task computes loss, gradient and Hessian with NumPy
(analytic derivatives) at the full step.  Only where that step is refused does a
second pass take the loss at a ladder of shorter ones.  Only (d+K-1)² numbers
a task reach the driver, never rows.
Newton converges in tens of passes where a first-order method needs
hundreds, which is what matters when a pass reads the whole table.
Prediction is a pure column expression (no Python at scoring time).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from .passes import matrix, packed, summed

_STEPS = [1.0, 0.5, 0.25, 0.125, 0.0625, 0.03125, 0.015625, 0.0078125, 0.00390625, 0.001953125]


def _sigmoid(z):
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def _row_terms(X, y, beta, theta, floor, K):
    """Per-row probability and the pieces of its derivatives."""
    eta = X @ beta
    n = len(y)
    big = 1e300
    th_ext = np.concatenate(([-big], theta, [big]))
    a = th_ext[y + 1] - eta          # upper argument (inf for top class)
    b = th_ext[y] - eta              # lower argument (-inf for class 0)
    Fa = np.where(y == K - 1, 1.0, _sigmoid(a))
    Fb = np.where(y == 0, 0.0, _sigmoid(b))
    prob = Fa - Fb
    return eta, a, b, Fa, Fb, prob, n


def nll_only(X, y, beta, theta, floor=C.ORDINAL_PROB_FLOOR, K=4):
    *_, prob, _ = _row_terms(X, y, beta, theta, floor, K)
    return float(-np.sum(np.log(np.maximum(prob, floor))))


def nll_grad_hess(X, y, beta, theta, floor=C.ORDINAL_PROB_FLOOR, K=4):
    """Loss, gradient and Hessian in (beta, theta) for one block of rows."""
    eta, a, b, Fa, Fb, prob, n = _row_terms(X, y, beta, theta, floor, K)
    d = X.shape[1]
    m = d + K - 1
    active = prob > floor
    loss = float(-np.sum(np.log(np.maximum(prob, floor))))
    P = np.where(active, prob, 1.0)
    has_a = (y < K - 1) & active
    has_b = (y > 0) & active
    fa = np.where(has_a, Fa * (1 - Fa), 0.0)
    fb = np.where(has_b, Fb * (1 - Fb), 0.0)
    # dl/da, dl/db of l = log(Fa - Fb)
    la = fa / P
    lb = -fb / P
    # second derivatives
    laa = np.where(has_a, fa * (1 - 2 * Fa) / P - la * la, 0.0)
    lbb = np.where(has_b, -fb * (1 - 2 * Fb) / P - lb * lb, 0.0)
    lab = np.where(has_a & has_b, fa * fb / (P * P), 0.0)
    # a = theta_y - x·beta ; b = theta_{y-1} - x·beta
    # gradient of l:  beta part: -(la + lb) x ; theta_y: la ; theta_{y-1}: lb
    top, low = np.zeros((n, K - 1)), np.zeros((n, K - 1))  # which threshold a, b hold: one of each row, or none
    at = np.arange(n)
    top[at[has_a], y[has_a]] = 1.0
    low[at[has_b], y[has_b] - 1] = 1.0
    g = np.concatenate([-(X.T @ (la + lb)), la @ top + lb @ low])
    # Hessian of l: u_a = e_{theta_y} - x, u_b = e_{theta_{y-1}} - x
    H = np.zeros((m, m))
    s = laa + lbb + 2 * lab
    H[:d, :d] = (X * s[:, None]).T @ X
    # cross terms beta-theta: d2l/dbeta dtheta_y = -(laa + lab) x ; theta_{y-1}: -(lbb + lab) x
    H[:d, d:] = -(X.T @ (top * (laa + lab)[:, None] + low * (lbb + lab)[:, None]))
    H[d:, :d] = H[:d, d:].T
    cross = (top * lab[:, None]).T @ low
    H[d:, d:] = np.diag(laa @ top + lbb @ low) + cross + cross.T
    return loss, -g, -H


def predict_proba_np(X, beta, theta):
    eta = X @ beta
    cum = np.column_stack([np.zeros(len(eta))] + [_sigmoid(t - eta) for t in theta] + [np.ones(len(eta))])
    p = np.maximum(np.diff(cum, axis=1), 0.0)
    return p / p.sum(axis=1, keepdims=True)


@dataclass
class OrdinalLogitModel:
    coef: np.ndarray
    thresholds: np.ndarray
    feature_names: list
    labels: list
    n_iter: int = 0
    loss: float = float("nan")
    features_col: str = "features"

    def _eta(self, arr: Column) -> Column:
        expr = F.lit(0.0)
        for j, b in enumerate(self.coef):
            if b != 0.0:
                expr = expr + arr[j] * F.lit(float(b))
        return expr

    def probability_columns(self, eta: Column) -> list[Column]:
        """p_k = max(F(theta_k - eta) - F(theta_{k-1} - eta), 0), row-normalised."""
        cum = [F.lit(0.0)] + [F.lit(1.0) / (F.lit(1.0) + F.exp(eta - F.lit(float(t)))) for t in self.thresholds] \
            + [F.lit(1.0)]
        raw = [F.greatest(cum[k + 1] - cum[k], F.lit(0.0)) for k in range(len(self.labels))]
        return raw

    def transform(self, df: DataFrame, prefix: str = "p") -> DataFrame:
        """Adds p0..p{K-1} and ``prediction`` (first maximum) as column expressions."""
        arr = vector_to_array(F.col(self.features_col)) if self.features_col in df.columns else None
        tmp = df.withColumn("_eta", self._eta(arr))
        raw = self.probability_columns(F.col("_eta"))
        tmp = tmp.withColumns({f"_r{k}": r for k, r in enumerate(raw)})
        tot = sum((F.col(f"_r{k}") for k in range(len(raw))), F.lit(0.0))
        tmp = tmp.withColumns({f"{prefix}{k}": F.col(f"_r{k}") / tot for k in range(len(raw))})
        arrp = F.array(*[F.col(f"{prefix}{k}") for k in range(len(raw))])
        tmp = tmp.withColumn("prediction", (F.array_position(arrp, F.array_max(arrp)) - 1).cast("int"))
        return tmp.drop("_eta", *[f"_r{k}" for k in range(len(raw))])

    def coefficients(self, spark) -> DataFrame:
        rows = [(n, float(c)) for n, c in zip(self.feature_names, self.coef)]
        return spark.createDataFrame(rows, "Feature string, Coefficient double")


class OrdinalClassifier:
    """Gives the ordinal model the common ``predict`` contract."""

    kind = "olr"

    def __init__(self, model: OrdinalLogitModel):
        self.model, self.k = model, len(model.labels)

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)

    def feature_importances(self):
        return None


class OrdinalLogit:
    """Estimator: ``OrdinalLogit(labels).fit(df)`` on a ``features`` vector and int ``label``."""

    def __init__(self, labels: list[str] = C.SEVERITY_LABELS, max_iter: int = C.ORDINAL_MAX_ITER,
                 ftol: float = C.ORDINAL_FTOL, floor: float = C.ORDINAL_PROB_FLOOR,
                 features_col: str = "features", label_col: str = "label"):
        self.labels, self.max_iter, self.ftol, self.floor = labels, max_iter, ftol, floor
        self.features_col, self.label_col = features_col, label_col

    def _pass(self, data: DataFrame, beta, theta):
        """One distributed pass: loss, gradient and Hessian at (beta, theta)."""
        K, floor = len(self.labels), self.floor
        m = len(beta) + K - 1

        def sums(batches):
            acc = np.zeros(1 + m + m * m)
            for b in batches:
                loss, g, H = nll_grad_hess(matrix(b.column("x")), b.column("y").to_numpy().astype(np.int64), beta, theta, floor, K)
                acc += np.concatenate(([loss], g, H.ravel()))
            return acc

        got = summed(data, 1 + m + m * m, sums)
        return float(got[0]), got[1:m + 1], got[m + 1:].reshape(m, m)

    def _shorter(self, data: DataFrame, beta, theta, direction):
        """One distributed pass: the loss at every shorter step of the ladder."""
        K, floor, d = len(self.labels), self.floor, len(beta)
        points = [np.concatenate([beta, theta]) + st * direction for st in _STEPS[1:]]

        def sums(batches):
            acc = np.zeros(len(points))
            for b in batches:
                X, y = matrix(b.column("x")), b.column("y").to_numpy().astype(np.int64)
                acc += [nll_only(X, y, p[:d], p[d:], floor, K) for p in points]
            return acc

        return summed(data, len(points), sums).tolist()

    def fit(self, df: DataFrame, feature_names: list[str] | None = None) -> OrdinalLogitModel:
        K = len(self.labels)
        data = df.select(vector_to_array(F.col(self.features_col)).alias("x"),
                         F.col(self.label_col).cast("int").alias("y"))
        first = data.first()
        if first is None:
            raise ValueError("no training rows")
        d = len(first["x"])
        data = packed(data)
        bad = int(summed(data, 1, _missing)[0])
        if bad:
            raise ValueError(f"{bad} training rows have a missing label or feature")
        beta = np.zeros(d)
        theta = np.cumsum(np.ones(K - 1))
        f, g, H = self._pass(data, beta, theta)
        it = 0
        lam = 1e-8
        for it in range(1, self.max_iter + 1):
            scale = 1.0 / np.sqrt(np.maximum(np.abs(np.diag(H)), 1e-12))
            Hs = H * scale[:, None] * scale[None, :]
            try:
                z = np.linalg.solve(Hs + lam * np.eye(len(g)), -g * scale)
            except np.linalg.LinAlgError:
                lam = max(lam * 10, 1e-6)
                continue
            direction = z * scale
            # keep thresholds positive and increasing along the whole ladder
            th_dir = direction[d:]
            alpha_max = 1.0
            while alpha_max > 1e-12 and not _feasible(theta + alpha_max * th_dir):
                alpha_max *= 0.5
            direction = direction * alpha_max
            loss, g_new, H_new = self._pass(data, beta + direction[:d], theta + direction[d:])
            slope = float(g @ direction)
            fits = lambda st, lv: np.isfinite(lv) and lv <= f + 1e-4 * st * slope
            if fits(1.0, loss):
                accepted = (1.0, loss)
            else:
                ladder = zip(_STEPS[1:], self._shorter(data, beta, theta, direction))
                accepted = next(((st, lv) for st, lv in ladder if fits(st, lv)), None)
            if accepted is None:
                lam = max(lam * 10, 1e-6)
                if lam > 1e6:
                    break
                continue
            st, f_new = accepted
            beta = beta + st * direction[:d]
            theta = theta + st * direction[d:]
            if st == 1.0:
                g, H = g_new, H_new
            else:
                _, g, H = self._pass(data, beta, theta)
            lam = max(lam / 10, 1e-10)
            rel = (f - f_new) / max(abs(f), abs(f_new), 1.0)
            f = f_new
            if rel <= self.ftol:
                break
        names = feature_names or [f"x{j}" for j in range(d)]
        return OrdinalLogitModel(beta, theta, names, list(self.labels), it, f, self.features_col)


def _missing(batches) -> np.ndarray:
    """Rows without a label or with a feature that is null or no number."""
    lost = 0
    for b in batches:
        x, y = b.column("x"), b.column("y")
        no_x = x.is_null().to_numpy(zero_copy_only=False)
        if no_x.any():
            x = x.filter(x.is_valid())
        wrong = no_x | y.is_null().to_numpy(zero_copy_only=False)
        wrong[~no_x] |= np.isnan(matrix(x)).any(axis=1)
        lost += wrong.sum()
    return np.array([lost], float)


def _feasible(theta: np.ndarray) -> bool:
    return bool(theta[0] > 0 and np.all(np.diff(theta) > 0))


# ------------------------------------------------------------ coefficient reports
def coef_ranking(coefs: DataFrame, k: int | None = 10) -> DataFrame:
    """Coefficients ordered by absolute value (name tie-break); top ``k``."""
    out = coefs.orderBy(F.abs("Coefficient").desc(), F.col("Feature").asc())
    return out.limit(k) if k else out


def odds_ratio(coefs: DataFrame, k: int | None = 15) -> DataFrame:
    """exp(beta) with a text reading, ordered by |log OR| (top ``k``)."""
    orr = F.exp(F.col("Coefficient"))
    text = (F.when(orr > 1, F.format_string(C.ODDS_UP.replace("{:.2f}", "%.2f"), orr))
            .when((orr < 1) & (orr > 0), F.format_string(C.ODDS_DOWN.replace("{:.2f}", "%.2f"), F.lit(1.0) / orr))
            .otherwise(F.lit(C.ODDS_NONE)))
    out = (coefs.select("Feature", "Coefficient", orr.alias("Odds_Ratio"), text.alias("Interpretation"))
           .orderBy(F.abs(F.log(F.col("Odds_Ratio"))).desc(), F.col("Feature").asc()))
    return out.limit(k) if k else out


def count_increasing(odds: DataFrame) -> DataFrame:
    return odds.agg(F.count_if(F.col("Odds_Ratio") > 1).alias("n_increase"))



