"""Robust regression: trimmed squares, S and MM estimators, and outlier maps.

Starts come from a bounded hashed sample; survivors are refined on all rows by
order statistics and weighted Gram matrices, all candidates in one job.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulwark.functions.kernels import MAD_NORMAL, Rho, Tukey, mahalanobis
from bulwark.functions.special import chi2_ppf, norm_ppf
from bulwark.operators.scatter import FastMCD
from bulwark.plans.frames import numeric
from bulwark.plans.moments import TrimmedSums, gram_from, gram_terms, grams_of, hashed_sample, medians, medians_of, order_statistics, weighted_gram, weighted_gram_and

SAMPLE_ROWS = 1500

# Coefficients of the small-sample corrections (Pison, Van Aelst and Willems, 2002): fixed values.
# By number of variables: {0, 1: (a, b) at 0.5 and at 0.875}; from two on, pairs (coefficient, power, q).
_RAW = {
    0: ((0.262024211897096, 0.604756680630497), (-0.351584646688712, 1.01646567502486)),
    1: ((0.630869217886906, 0.650789250442946), (0.565065391014791, 1.03044199012509)),
    "many": (((-0.746945886714663, 0.56264937192689, 3), (-0.535478048924724, 0.543323462033445, 5)), ((-0.458580153984614, 1.12236071104403, 3), (-0.267178168108996, 1.1022478781154, 5))),
}
_REWEIGHTED = {
    0: ((1.11098143415027, 1.5182890270453), (-0.66046776772861, 0.88939595831888)),
    1: ((1.58609654199605, 1.46340162526468), (0.391653958727332, 1.03167487483316)),
    "many": (((-0.773365715932083, 2.02013996406346, 3), (-0.337571678986723, 2.02037467454833, 5)), ((-0.474174840843602, 1.39681715704956, 3), (-0.276640353112907, 1.42543242287677, 5))),
}


def _correction(table: dict, p: int, n: int, alpha: float) -> float:
    if not 0.5 <= alpha <= 1:
        raise ValueError(f"alpha must be between 0.5 and 1, not {alpha}")
    ends = []
    for k in (0, 1):
        if p <= 1:
            a, b = table[p][k]
        else:
            # a - b log(q p^2) = log(-c / p^d) at both q
            (c1, d1, q1), (c2, d2, q2) = table["many"][k]
            y1, y2 = math.log(-c1 / p**d1), math.log(-c2 / p**d2)
            b = (y1 - y2) / (math.log(q2 * p**2) - math.log(q1 * p**2))
            a = y1 + b * math.log(q1 * p**2)
        ends.append(1 - math.exp(a) / n**b)
    half, most = ends
    at = half + (most - half) * (alpha - 0.5) / 0.375 if alpha <= 0.875 else most + (1 - most) * (alpha - 0.875) / 0.125
    return 1 / (math.sqrt(at) if p == 0 else at)


def correction_factor(p: int, n: int, alpha: float) -> float:
    """Small-sample factor of the raw trimmed scale."""
    return _correction(_RAW, p, n, alpha)


def correction_factor_reweighted(p: int, n: int, alpha: float) -> float:
    return _correction(_REWEIGHTED, p, n, alpha)


@dataclass(frozen=True)
class RegressionModel:
    features: tuple[str, ...]
    label: str
    coefficients: np.ndarray
    intercept: float
    scale: float
    details: dict = field(default_factory=dict)

    def predict(self) -> Column:
        return sum((F.col(c).cast("double") * float(b) for c, b in zip(self.features, self.coefficients, strict=True)), F.lit(float(self.intercept)))

    def residual(self) -> Column:
        return F.col(self.label).cast("double") - self.predict()

    def outlier_map(self, df: DataFrame, id_column: str, robust_scaling: bool = True, robust_distance: bool = True, vertical: float = 2.5, leverage_quantile: float = 0.975) -> DataFrame:
        """(id, residual, standardised, distance, kind): regular, vertical outlier, good leverage or bad leverage."""
        rows = numeric(df, [*self.features, self.label], [id_column]).dropna()
        r = self.residual()
        held = rows.select(*self.features, self.label).persist()  # several jobs read it
        try:
            if robust_scaling:
                n = held.count()
                m = medians(held, [r], n)[0]
                s = medians(held, [F.abs(r - float(m))], n)[0] / MAD_NORMAL
            else:
                s = held.agg(F.stddev_pop(r)).first()[0]
            model = FastMCD().fit(held, self.features)
        finally:
            held.unpersist()
        at = (model.location, model.covariance) if robust_distance else (model.classical_location, model.classical_covariance)
        d = mahalanobis([F.col(c) for c in self.features], *at)
        return classify(rows.select(id_column, r.alias("residual"), (r / float(s)).alias("standardised"), d.alias("distance")), vertical, math.sqrt(chi2_ppf(leverage_quantile, len(self.features))))


def classify(df: DataFrame, vertical: float, leverage: float) -> DataFrame:
    off, far = F.abs(F.col("standardised")) > vertical, F.col("distance") > leverage
    return df.withColumn("kind", F.when(off & far, "bad leverage").when(off, "vertical outlier").when(far, "good leverage").otherwise("regular"))


def _solve(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(gram, rhs, rcond=None)[0]


def _distinct(found: list[tuple[float, np.ndarray]]) -> list[np.ndarray]:
    """Coefficients in the order of their loss, without those that another start has reached too."""
    out: list[np.ndarray] = []
    for _, beta in sorted(found, key=lambda f: f[0]):
        if not any(np.allclose(beta, b, rtol=1e-5, atol=1e-8) for b in out):
            out.append(beta)
    return out


class _Base:
    fit_intercept = True

    def _frame(self, df: DataFrame, features: Sequence[str], label: str, sampled: bool = True) -> tuple[DataFrame, int, list[Column], Column, np.ndarray | None]:
        rows = numeric(df, [*features, label]).dropna().persist()
        n = rows.count()
        if n <= len(features) + 1:
            raise ValueError(f"{n} complete rows are too few for {len(features)} features")
        x = [F.col(c) for c in features] + ([F.lit(1.0)] if self.fit_intercept else [])
        sample = hashed_sample(rows, [*features, label], SAMPLE_ROWS) if sampled else None
        return rows, n, x, F.col(label), sample

    def _model(self, beta: np.ndarray, features: Sequence[str], label: str, scale: float, details: dict) -> RegressionModel:
        b, a = (beta[:-1], float(beta[-1])) if self.fit_intercept else (beta, 0.0)
        return RegressionModel(tuple(features), label, b, a, float(scale), details)


def _residual(x: list[Column], y: Column, beta: np.ndarray) -> Column:
    return y - sum((c * float(b) for c, b in zip(x, beta, strict=True)), F.lit(0.0))


def _residuals(v: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Residuals (rows x K) of K coefficient vectors, the label in the last column; the same for a row in whatever block it comes."""
    columns = np.ascontiguousarray(v.T)
    return np.array([columns[-1] - sum((c * b for c, b in zip([*columns[:-1], 1.0], row, strict=False)), 0.0) for row in beta]).T


def _matrix(sample: np.ndarray, intercept: bool) -> tuple[np.ndarray, np.ndarray]:
    x = sample[:, :-1]
    return (np.column_stack([x, np.ones(len(x))]) if intercept else x), sample[:, -1]


@dataclass(frozen=True)
class FastLTS(_Base):
    """Least squares over the h smallest squared residuals.

    The reweighting step measures residuals by their plain standard deviation;
    ``robust_reweighting`` takes the trimmed scale instead, which outliers can't
    inflate.
    """

    alpha: float = 0.5
    n_initial_subsets: int = 500
    n_initial_c_steps: int = 2
    n_best_models: int = 10
    reweighting: bool = True
    tolerance: float = 1e-15
    random_state: int = 42
    most_steps: int = 50
    robust_reweighting: bool = False

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> RegressionModel:
        rows, n, x, y, sample = self._frame(df, features, label)
        try:
            p = len(features)
            h = max(int(self.alpha * n), int((n + p + 1) / 2))
            live = self._starts(sample, h / n)
            losses = [math.inf] * len(live)
            names = [*features, label]
            sums = TrimmedSums(rows, names, gram_terms(self.fit_intercept), h, n)
            for step in range(1, self.most_steps + 1):
                beta = np.array(live)
                got = sums.step(lambda v: _residuals(v, beta) ** 2)  # noqa: B023
                grams, new = [gram_from(row, len(x)) for row in got], got[:, -1] / got[:, 0]
                order = np.argsort(new)
                best, loss = live[order[0]], float(new[order[0]])
                if all(abs(a - b) <= max(self.tolerance, 1e-12 * abs(b)) for a, b in zip(losses, new, strict=True)):
                    break
                keep = order[: max(1, len(order) // 2)] if step > 1 else order
                live, losses = [_solve(*grams[i]) for i in keep], [float(new[i]) for i in keep]
                sums.keep(keep)
            scale = correction_factor(p, n, h / n) * math.sqrt(loss)
            details = {"h": h, "raw_coefficients": best.copy(), "raw_scale": scale, "n_steps": step}
            if self.reweighting:
                r = _residual(x, y, best)
                std = scale if self.robust_reweighting else rows.agg(F.stddev_pop(r)).first()[0]
                near = F.abs(r) <= norm_ppf(0.9875) * (std or 1.0)
                ((gram, rhs),) = weighted_gram(rows, x, y, [F.when(near, 1.0).otherwise(0.0)])
                best = _solve(gram, rhs)
                again = _residual(x, y, best) ** 2
                (cut,) = order_statistics(rows, [again], h, n)
                loss = rows.agg(F.avg(F.when(again <= float(cut), again))).first()[0]
                scale = correction_factor_reweighted(p, n, h / n) * math.sqrt(loss)
            return self._model(best, features, label, scale, details)
        finally:
            rows.unpersist()

    def _starts(self, sample: np.ndarray, share: float) -> list[np.ndarray]:
        x, y = _matrix(sample, self.fit_intercept)
        h = max(x.shape[1] + 1, int(round(share * len(x))))
        rng = np.random.default_rng(self.random_state)
        found = []
        for _ in range(self.n_initial_subsets):
            pick = rng.choice(len(x), x.shape[1], replace=False)
            for _ in range(self.n_initial_c_steps + 1):
                beta = np.linalg.lstsq(x[pick], y[pick], rcond=None)[0]
                r2 = (y - x @ beta) ** 2
                pick = np.argpartition(r2, h - 1)[:h]
            found.append((float(r2[pick].mean()), beta))
        settled = []
        for loss, beta in sorted(found, key=lambda f: f[0])[: self.n_best_models]:
            for _ in range(self.most_steps):
                pick = np.argpartition((y - x @ beta) ** 2, h - 1)[:h]
                beta = np.linalg.lstsq(x[pick], y[pick], rcond=None)[0]
                new = float(np.sort((y - x @ beta) ** 2)[:h].mean())
                if loss - new <= 1e-12 * abs(loss):
                    break
                loss = new
            settled.append((new, beta))
        return _distinct(settled)


def _m_scale(r: np.ndarray, rho: Rho, b: float, s: float, steps: int, tolerance: float = 1e-10) -> float:
    for _ in range(steps):
        new = s * math.sqrt(float(rho.rho_np(r / s).mean()) / b) if s > 0 else 0.0
        if s == 0 or abs(new / s - 1) <= tolerance:
            return new
        s = new
    return s


@dataclass(frozen=True)
class SRegression(_Base):
    """Smallest M-scale of the residuals; b defaults to half of rho's maximum, which gives a 50 % breakdown."""

    rho: Rho = field(default_factory=lambda: Tukey(1.547))
    n_initial_subsets: int = 500
    n_initial_i_steps: int = 2
    n_best_subsets: int = 5
    max_scale_iterations: int = 50
    b: float | None = None
    fit_intercept: bool = True
    relative_tolerance: float = 1e-6
    random_state: int = 101
    most_steps: int = 50

    def _level(self) -> float:
        return self.b if self.b is not None else 0.5 * float(self.rho.rho_np(np.array([1e9]))[0])

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> RegressionModel:
        rows, n, x, y, sample = self._frame(df, features, label)
        try:
            live = self._starts(sample)
            names, beta = [*features, label], np.array(live)
            scales = [float(v) for v in medians_of(rows, names, lambda v: np.abs(_residuals(v, beta)), np.full(len(live), n)) / MAD_NORMAL]
            for step in range(1, self.most_steps + 1):
                # one job: Gram matrices at the scale so far, and the fixed-point step of that scale
                beta, unit = np.array(live), np.maximum(scales, 1e-300)

                def weighed(v: np.ndarray, beta: np.ndarray = beta, unit: np.ndarray = unit) -> tuple[np.ndarray, np.ndarray]:
                    r = _residuals(v, beta) / unit
                    return self.rho.weight_np(r), self.rho.rho_np(r)

                grams, sums = grams_of(rows, names, self.fit_intercept, weighed)
                means = sums / n
                new = [_solve(*g) for g in grams]
                after = [s * math.sqrt(float(m) / self._level()) for s, m in zip(scales, means, strict=True)]
                order = np.argsort(after)
                best = order[0]
                near = np.linalg.norm(new[best] - live[best]) <= self.relative_tolerance * max(self.relative_tolerance, np.linalg.norm(live[best]))
                done = near and abs(after[best] - scales[best]) <= 1e-6 * scales[best]
                keep = order[: max(1, len(order) // 2)] if step > 2 else order
                live, scales = [new[i] for i in keep], [after[i] for i in keep]
                if done:
                    break
            r = _residual(x, y, live[0])
            (scale,) = self._scales(rows, [r], [scales[0]], self.max_scale_iterations)
            return self._model(live[0], features, label, scale, {"n_steps": step})
        finally:
            rows.unpersist()

    def _scales(self, rows: DataFrame, r: list[Column], start: list[float], steps: int) -> list[float]:
        s = [float(v) for v in start]
        for _ in range(steps):
            row = rows.agg(*[F.avg(self.rho.rho(v / float(max(k, 1e-300)))).alias(f"r{i}") for i, (v, k) in enumerate(zip(r, s, strict=True))]).first()
            new = [k * math.sqrt(float(m) / self._level()) for k, m in zip(s, row, strict=True)]
            same = all(abs(a - k) <= 1e-10 * max(k, 1e-300) for a, k in zip(new, s, strict=True))
            s = new
            if same:
                break
        return s

    def _starts(self, sample: np.ndarray) -> list[np.ndarray]:
        x, y = _matrix(sample, self.fit_intercept)
        rng = np.random.default_rng(self.random_state)
        found = []
        for _ in range(self.n_initial_subsets):
            pick = rng.choice(len(x), x.shape[1], replace=False)
            if np.linalg.matrix_rank(x[pick]) < x.shape[1]:
                continue
            beta = np.linalg.solve(x[pick], y[pick])
            for _ in range(self.n_initial_i_steps):
                r = y - x @ beta
                s = _m_scale(r, self.rho, self._level(), float(np.median(np.abs(r)) / MAD_NORMAL), 2)
                w = self.rho.weight_np(r / max(s, 1e-300))
                beta = _solve(x.T @ (x * w[:, None]), x.T @ (w * y))
            r = y - x @ beta
            found.append((_m_scale(r, self.rho, self._level(), float(np.median(np.abs(r)) / MAD_NORMAL), 10), beta))
        settled = []
        for s, beta in sorted(found, key=lambda f: f[0])[: self.n_best_subsets]:
            for _ in range(200):
                r = y - x @ beta
                s = _m_scale(r, self.rho, self._level(), s, 5)
                w = self.rho.weight_np(r / max(s, 1e-300))
                new = _solve(x.T @ (x * w[:, None]), x.T @ (w * y))
                moved, beta = np.linalg.norm(new - beta), new
                if moved <= 1e-9 * max(1.0, np.linalg.norm(beta)):
                    break
            settled.append((s, beta))
        return _distinct(settled)


@dataclass(frozen=True)
class MMRegression(_Base):
    """Reweighted least squares at the fixed scale of an S-estimate; the intercept is weighted too."""

    initial_estimator: SRegression = field(default_factory=SRegression)
    rho: Rho = field(default_factory=lambda: Tukey(3.44))
    max_iterations: int = 500
    epsilon: float = 1e-7

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> RegressionModel:
        start = self.initial_estimator.fit(df, features, label)
        rows, n, x, y, _ = self._frame(df, features, label, sampled=False)
        try:
            beta = np.append(start.coefficients, start.intercept)
            old, s = None, max(start.scale, 1e-300)
            for it in range(1, self.max_iterations + 1):
                r = _residual(x, y, beta)
                # how far the last step moved comes out of the same job as the next one
                gap = [F.max(F.abs(_residual(x, y, old) - r))] if old is not None else []
                ((gram, rhs),), moved = weighted_gram_and(rows, x, y, [self.rho.weight(r / s)], gap)
                if moved and moved[0] < self.epsilon * max(1.0, start.scale):
                    break
                old, beta = beta, _solve(gram, rhs)
            return self._model(beta, features, label, start.scale, {"n_iter": it})
        finally:
            rows.unpersist()


def trimmed_steps(rows: DataFrame, features: Sequence[str], label: str, beta: np.ndarray, h: int, steps: int) -> np.ndarray:
    """Coefficients (intercept last) after so many concentration steps from a given start."""
    n, x, y = rows.count(), [*(F.col(c) for c in features), F.lit(1.0)], F.col(label)
    for _ in range(steps):
        r2 = _residual(x, y, beta) ** 2
        (cut,) = order_statistics(rows, [r2], h, n)
        ((gram, rhs),) = weighted_gram(rows, x, y, [F.when(r2 <= float(cut), 1.0).otherwise(0.0)])
        beta = _solve(gram, rhs)
    return beta


def reweighted_steps(rows: DataFrame, features: Sequence[str], label: str, beta: np.ndarray, scale: float, rho: Rho, steps: int) -> np.ndarray:
    """Coefficients (intercept last) after so many reweighted least-squares steps at a fixed scale."""
    x, y = [*(F.col(c) for c in features), F.lit(1.0)], F.col(label)
    for _ in range(steps):
        ((gram, rhs),) = weighted_gram(rows, x, y, [rho.weight(_residual(x, y, beta) / float(scale))])
        beta = _solve(gram, rhs)
    return beta


def least_squares(rows: DataFrame, features: Sequence[str], label: str) -> np.ndarray:
    x = [*(F.col(c) for c in features), F.lit(1.0)]
    ((gram, rhs),) = weighted_gram(rows, x, F.col(label), [F.lit(1.0)])
    return _solve(gram, rhs)
