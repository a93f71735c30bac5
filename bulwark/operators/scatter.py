"""Robust location and scatter of several columns.

Searches start on a bounded hashed sample (all rows where there are few); the
candidates that survive are refined on all rows, K of them per job: one job for
K exact order statistics, one for K sets of moments.  Only p x p matrices reach
the driver, and a fitted model scores rows as a projection.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bulwark.functions.kernels import covariance_to_correlation, mahalanobis, quadratic_form
from bulwark.functions.special import chi2_ppf, gamma_cdf, norm_ppf
from bulwark.operators.preprocessing import wrapping_transformation
from bulwark.operators.univariate import MedianMad, Qn, RobustScale, kth_pair_difference, qn_factor
from bulwark.plans.frames import numeric, pair_long
from bulwark.plans.moments import TrimmedSums, hashed_sample, medians, moment_terms, moments_from, order_statistics, subset_moments
from bulwark.plans.ship import ship

SAMPLE_ROWS = 1500
PARTITION_ROWS = 300


@dataclass(frozen=True)
class ScatterModel:
    columns: tuple[str, ...]
    location: np.ndarray
    covariance: np.ndarray
    classical_location: np.ndarray
    classical_covariance: np.ndarray
    details: dict = field(default_factory=dict)

    @property
    def precision(self) -> np.ndarray:
        return np.linalg.pinv(self.covariance, hermitian=True)

    @property
    def correlation(self) -> np.ndarray:
        return covariance_to_correlation(self.covariance)

    def distance(self):
        return mahalanobis([F.col(c).cast("double") for c in self.columns], self.location, self.covariance)

    def distance_distance(self, df: DataFrame, id_column: str, quantile: float = 0.975) -> DataFrame:
        """(id, classical_d, robust_d, threshold, is_outlier)."""
        cut = float(np.sqrt(chi2_ppf(quantile, len(self.columns))))
        classical = mahalanobis([F.col(c).cast("double") for c in self.columns], self.classical_location, self.classical_covariance)
        return df.select(id_column, classical.alias("classical_d"), self.distance().alias("robust_d"), F.lit(cut).alias("threshold")).withColumn("is_outlier", F.col("robust_d") > cut)

    def to_df(self, spark) -> DataFrame:
        """(row, col, location, covariance), one row per matrix cell."""
        rows = [(a, b, float(self.location[i]), float(self.covariance[i, j])) for i, a in enumerate(self.columns) for j, b in enumerate(self.columns)]
        return spark.createDataFrame(rows, "row string, col string, location double, covariance double")


class RobustCovariance(ABC):
    """``fit`` refuses missing and infinite values; subclasses estimate from clean rows."""

    nans_allowed = False

    def fit(self, df: DataFrame, columns: Sequence[str]) -> ScatterModel:
        rows = numeric(df, columns).persist()
        try:
            bad, n = rows.agg(F.sum(F.when(sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)) > 0, 1).otherwise(0)), F.count(F.lit(1))).first()
            if bad and not self.nans_allowed:
                raise ValueError(f"{bad} rows have missing or infinite values")
            if not n:
                raise ValueError("no rows")
            ((_, mean, cov),) = subset_moments(rows, columns, [None], np.array(rows.agg(*[F.avg(c) for c in columns]).first(), dtype=float))
            location, covariance, details = self.estimate(rows, list(columns), n)
            return ScatterModel(tuple(columns), location, covariance, mean, cov, details)
        finally:
            rows.unpersist()

    @abstractmethod
    def estimate(self, rows: DataFrame, columns: list[str], n: int) -> tuple[np.ndarray, np.ndarray, dict]: ...


@dataclass(frozen=True)
class WrappingCovariance(RobustCovariance):
    """Classical covariance of wrapped columns, around the plain mean."""

    b: float = 1.5
    c: float = 4.0
    q1: float = 1.540793
    q2: float = 0.8622731

    def estimate(self, rows: DataFrame, columns: list[str], n: int):
        wrapped = wrapping_transformation(rows, columns, self.b, self.c, self.q1, self.q2)
        mean = np.array(rows.agg(*[F.avg(c) for c in columns]).first(), dtype=float)
        ((_, _, cov),) = subset_moments(wrapped, columns, [None], mean)
        return mean, cov, {}


def _tau_b(x: np.ndarray, y: np.ndarray) -> float:
    """Kendall's tau-b in O(n log n): discordant pairs by merging, ties by counting."""
    n = len(x)
    if n < 2:
        return float("nan")
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    rank = np.searchsorted(np.unique(y), y)
    pairs = lambda c: int((c * (c - 1) // 2).sum())
    tx, ty = pairs(np.unique(x, return_counts=True)[1]), pairs(np.unique(y, return_counts=True)[1])
    both = pairs(np.unique(np.stack([x, y]), axis=1, return_counts=True)[1])
    swaps, width, a = 0, 1, rank.copy()
    while width < n:
        for k in range(0, n - width, 2 * width):
            left, right = a[k : k + width], a[k + width : k + 2 * width]
            swaps += int((len(left) - np.searchsorted(left, right, side="right")).sum())
            a[k : k + 2 * width] = np.sort(a[k : k + 2 * width], kind="stable")
        width *= 2
    total = n * (n - 1) // 2
    same = total - tx - ty + both - 2 * swaps
    return same / np.sqrt(float(total - tx) * float(total - ty))


def kendall_pairs(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(f1, f2, tau) of all column pairs; one task per pair."""

    def per_pair(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, _tau_b(pdf["x"].to_numpy(), pdf["y"].to_numpy())]], columns=["f1", "f2", "tau"])

    ship(rows.sparkSession)
    return pair_long(rows, columns).groupBy("f1", "f2").applyInPandas(per_pair, "f1 string, f2 string, tau double")


@dataclass(frozen=True)
class KendallTau(RobustCovariance):
    """tau-b times the Qn scales; location by median."""

    def estimate(self, rows: DataFrame, columns: list[str], n: int):
        p = len(columns)
        tau = np.eye(p)
        for r in kendall_pairs(rows, columns).collect():
            i, j = columns.index(r["f1"]), columns.index(r["f2"])
            tau[i, j] = tau[j, i] = r["tau"]
        found = {r["feature"]: r for r in Qn().agg(rows, columns).collect()}
        scale = np.array([found[c]["scale"] for c in columns])
        return np.array([found[c]["location"] for c in columns]), tau * np.outer(scale, scale), {"correlation": tau}


@dataclass(frozen=True)
class OGK(RobustCovariance):
    """Orthogonalised pairwise scatter: per iteration one job for the scales of columns, one for those of their sums and differences."""

    estimator: RobustScale = field(default_factory=MedianMad)
    n_iterations: int = 2
    reweighting: bool = False
    reweighting_beta: float = 0.9

    def _scales(self, rows: DataFrame, names: list[str]) -> dict:
        return {r["feature"]: r for r in self.estimator.agg(rows, names).collect()}

    def estimate(self, rows: DataFrame, columns: list[str], n: int):
        p = len(columns)
        names = [f"z{i}" for i in range(p)]
        z = rows.select(*columns, *[F.col(c).alias(f"z{i}") for i, c in enumerate(columns)])
        back = np.eye(p)
        for _ in range(self.n_iterations):
            found = self._scales(z, names)
            s = np.array([found[c]["scale"] for c in names])
            pairs = [(i, j) for i in range(p) for j in range(i)]
            sums = z.select(*[(F.col(names[i]) / float(s[i]) + F.col(names[j]) / float(s[j])).alias(f"s{i}_{j}") for i, j in pairs], *[(F.col(names[i]) / float(s[i]) - F.col(names[j]) / float(s[j])).alias(f"d{i}_{j}") for i, j in pairs])
            got = self._scales(sums, sums.columns)
            u = np.eye(p)
            for i, j in pairs:
                a, b = got[f"s{i}_{j}"]["scale"] ** 2, got[f"d{i}_{j}"]["scale"] ** 2
                u[i, j] = u[j, i] = (a - b) / (a + b) if a + b > 0 else 0.0
            values, vectors = np.linalg.eigh(u)
            e = vectors[:, np.argsort(-values)]
            z = z.select(*columns, *[sum((F.col(names[i]) * float(e[i, k] / s[i]) for i in range(p)), F.lit(0.0)).alias(f"z{k}") for k in range(p)])
            back = back @ np.diag(s) @ e
        found = self._scales(z, names)
        scale, centre = (np.array([found[c][k] for c in names]) for k in ("scale", "location"))
        location, cov = back @ centre, back @ np.diag(scale**2) @ back.T
        if self.reweighting:
            d2 = quadratic_form([F.col(c) for c in columns], location, np.linalg.pinv(cov, hermitian=True))
            cut = chi2_ppf(self.reweighting_beta, p) / chi2_ppf(0.5, p) * medians(rows, [d2], n)[0]
            ((_, location, cov),) = subset_moments(rows, columns, [d2 < float(cut)], location)
        return location, cov, {}


# -- minimum covariance determinant -------------------------------------------


def mcd_h(n: int, p: int, alpha: float | int | None) -> int:
    least = int((n + p + 1) / 2)
    if alpha is None:
        return least
    if isinstance(alpha, int) and alpha > 1:
        if n / 2 <= alpha <= n:
            return max(alpha, least)
    elif 0.5 <= alpha <= 1:
        return max(int(alpha * n), least)
    raise ValueError(f"alpha must be an integer in [n/2, n] or a float in [0.5, 1], not {alpha}")


def _d2(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    d = x - mean
    return np.einsum("ij,jk,ik->i", d, np.linalg.pinv(cov, hermitian=True), d)


def _distances(x: np.ndarray, shapes: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Squared distances (rows x K) from K centres by K inverse covariances; the same for a row in whatever block it comes."""
    out = np.zeros((len(shapes), len(x)))
    columns = np.ascontiguousarray(x.T)
    for at, (mean, inverse) in zip(out, shapes, strict=True):
        d = [c - m for c, m in zip(columns, mean, strict=True)]
        for i, row in enumerate(inverse):
            at += d[i] * (row[i] * d[i] + sum((2 * row[j] * d[j] for j in range(i)), 0.0))
    return out.T


def c_step(x: np.ndarray, mean: np.ndarray, cov: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray, float]:
    keep = np.argpartition(_d2(x, mean, cov), h - 1)[:h]
    cov = np.cov(x[keep], rowvar=False).reshape(x.shape[1], x.shape[1])
    return x[keep].mean(axis=0), cov, float(np.linalg.det(cov))


def _random_start(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Moments of p + 1 random rows, with more rows while they lie in a plane."""
    n, p = x.shape
    order = rng.permutation(n)
    for k in range(p + 1, n + 1):
        cov = np.cov(x[order[:k]], rowvar=False).reshape(p, p)
        if np.linalg.matrix_rank(cov) == p:
            break
    return x[order[:k]].mean(axis=0), cov


@dataclass(frozen=True)
class _Mcd(RobustCovariance):
    alpha: float | int | None = None
    tolerance: float = 1e-8
    correct_covariance: bool = True
    reweighting: bool = True
    most_steps: int = 100

    def starts(self, sample: np.ndarray, share: float) -> list[tuple[np.ndarray, np.ndarray]]:
        raise NotImplementedError

    def estimate(self, rows: DataFrame, columns: list[str], n: int):
        p = len(columns)
        h = mcd_h(n, p, self.alpha)
        sample = hashed_sample(rows, columns, SAMPLE_ROWS)
        centre = np.median(sample, axis=0)
        if h == n:
            ((_, mean, cov),) = subset_moments(rows, columns, [None], centre)
            return mean, cov, {"h": h, "raw_location": mean, "raw_covariance": cov}
        found = self.starts(sample, h / n)
        mean, cov, steps = self._settle_np(sample, found, h) if len(sample) == n else self._settle(rows, columns, n, h, found, centre)
        raw = cov
        x = [F.col(c) for c in columns]
        if self.correct_covariance:
            middle = medians(rows, [quadratic_form(x, mean, np.linalg.pinv(cov, hermitian=True))], n)[0]
            raw = cov * (middle / chi2_ppf(0.5, p))
        details = {"h": h, "raw_location": mean, "raw_covariance": raw, "n_steps": steps, "determinant": float(np.linalg.det(cov))}
        if self.reweighting:
            near = quadratic_form(x, mean, np.linalg.pinv(raw, hermitian=True)) < chi2_ppf(0.975, p)
            ((kept, mean, cov),) = subset_moments(rows, columns, [near], centre)
            factor = 0.975 / gamma_cdf(chi2_ppf(0.975, p) / 2, p / 2 + 1)
            details["n_kept"] = int(kept)
            return mean, cov * factor, details
        return mean, raw, details

    def _settle_np(self, x: np.ndarray, found: list, h: int):
        best = None
        for mean, cov in found:
            old, steps = np.inf, 0
            for _ in range(self.most_steps):
                mean, cov, det = c_step(x, mean, cov, h)
                steps += 1
                if old - det <= self.tolerance * max(abs(old), 1e-300) or det == 0:
                    break
                old = det
            if best is None or det < best[0]:
                best = (det, mean, cov, steps)
        return best[1], best[2], best[3]

    def _settle(self, rows: DataFrame, columns: list[str], n: int, h: int, found: list, centre: np.ndarray):
        """C-steps of all candidates at once on all rows: mostly one pass a step."""
        live, dets, sums = list(found), [np.inf] * len(found), TrimmedSums(rows, columns, moment_terms(centre), h, n)
        for step in range(1, self.most_steps + 1):
            shapes = [(m, np.linalg.pinv(c, hermitian=True)) for m, c in live]
            moved = [moments_from(row, centre) for row in sums.step(lambda x: _distances(x, shapes))]  # noqa: B023
            new = [float(np.linalg.det(c)) for _, _, c in moved]
            live = [(m, c) for _, m, c in moved]
            settled = all(o - v <= self.tolerance * max(abs(v), 1e-300) for o, v in zip(dets, new, strict=True))
            order = np.argsort(new)
            keep = order if settled else order[: max(1, len(order) // 2)] if step >= 2 else order
            live, dets = [live[i] for i in keep], [new[i] for i in keep]
            sums.keep(keep)
            if settled:
                break
        return live[0][0], live[0][1], step


@dataclass(frozen=True)
class FastMCD(_Mcd):
    """Random starts of p + 1 rows on partitions of a sample, the best pooled, then refined on all rows."""

    n_initial_subsets: int = 500
    n_initial_c_steps: int = 2
    n_best_subsets: int = 10
    n_partitions: int | None = None
    random_seed: int = 0

    def starts(self, sample: np.ndarray, share: float) -> list[tuple[np.ndarray, np.ndarray]]:
        rng = np.random.default_rng(self.random_seed)
        parts = self.n_partitions or (max(1, min(5, len(sample) // PARTITION_ROWS)) if len(sample) > 600 else 1)
        pool = []
        for part in np.array_split(rng.permutation(len(sample)), parts):
            x, h = sample[part], max(sample.shape[1] + 1, int(round(share * len(part))))
            found = []
            for _ in range(max(1, self.n_initial_subsets // parts)):
                mean, cov = _random_start(x, rng)
                for _ in range(self.n_initial_c_steps):
                    mean, cov, det = c_step(x, mean, cov, h)
                found.append((det, mean, cov))
            pool += sorted(found, key=lambda f: f[0])[: self.n_best_subsets]
        h = max(sample.shape[1] + 1, int(round(share * len(sample))))
        refined = []
        for _, mean, cov in pool:
            for _ in range(self.n_initial_c_steps):
                mean, cov, det = c_step(sample, mean, cov, h)
            refined.append((det, mean, cov))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for det, mean, cov in sorted(refined, key=lambda f: f[0])[: self.n_best_subsets]:
            for _ in range(self.most_steps):
                old = det
                mean, cov, det = c_step(sample, mean, cov, h)
                if old - det <= self.tolerance * abs(old):
                    break
            if not any(np.allclose(cov, c, rtol=1e-6) and np.allclose(mean, m, rtol=1e-6) for m, c in out):  # reached by another start too
                out.append((mean, cov))
        return out


def _qn_np(x: np.ndarray) -> float:
    x = np.sort(x)
    n = len(x)
    h = n // 2 + 1
    return 2.219144 * qn_factor(n) * kth_pair_difference(x, h * (h - 1) // 2)


def _ranks(x: np.ndarray) -> np.ndarray:
    values, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[inverse]


@dataclass(frozen=True)
class DetMCD(_Mcd):
    """Six deterministic starts (on the sample), no random numbers."""

    def starts(self, sample: np.ndarray, share: float) -> list[tuple[np.ndarray, np.ndarray]]:
        n, p = sample.shape
        scale = np.array([_qn_np(c) for c in sample.T])
        z = (sample - np.median(sample, axis=0)) / np.where(scale > 0, scale, 1.0)
        ranks = np.column_stack([_ranks(c) for c in z.T])
        scores = np.vectorize(norm_ppf)((ranks - 1 / 3) / (n + 1 / 3))
        length = np.linalg.norm(z, axis=1)
        signs = z / np.where(length > 0, length, 1.0)[:, None]
        half = -(-n // 2)
        matrices = [np.corrcoef(np.tanh(z), rowvar=False), np.corrcoef(ranks, rowvar=False), np.corrcoef(scores, rowvar=False), signs.T @ signs / n, np.cov(z[np.argsort(length, kind="stable")[:half]], rowvar=False), self._ogk(z)]
        out = []
        for s in matrices:
            e = np.linalg.eigh(np.atleast_2d(s))[1]
            spread = np.array([_qn_np(c) for c in (z @ e).T]) ** 2
            spread = np.where(spread > 0, spread, 1e-12)
            root, inverse = e @ np.diag(np.sqrt(spread)) @ e.T, e @ np.diag(1 / np.sqrt(spread)) @ e.T
            mean, cov = root @ np.median(z @ inverse, axis=0), e @ np.diag(spread) @ e.T
            mean, cov, _ = c_step(z, mean, cov, half)
            out.append((mean * scale + np.median(sample, axis=0), cov * np.outer(scale, scale)))
        return out

    @staticmethod
    def _ogk(z: np.ndarray) -> np.ndarray:
        p = z.shape[1]
        s = np.array([_qn_np(c) for c in z.T])
        y = z / np.where(s > 0, s, 1.0)
        u = np.eye(p)
        for i in range(p):
            for j in range(i):
                a, b = _qn_np(y[:, i] + y[:, j]) ** 2, _qn_np(y[:, i] - y[:, j]) ** 2
                u[i, j] = u[j, i] = (a - b) / (a + b) if a + b else 0.0
        return np.diag(s) @ u @ np.diag(s)


def c_steps(rows: DataFrame, columns: Sequence[str], location: np.ndarray, cov: np.ndarray, h: int, steps: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(location, covariance, determinant) after so many concentration steps on all rows, from a given start."""
    n = rows.count()
    det = float(np.linalg.det(cov))
    for _ in range(steps):
        d = quadratic_form([F.col(c) for c in columns], location, np.linalg.pinv(cov, hermitian=True))
        (cut,) = order_statistics(rows, [d], h, n)
        ((_, location, cov),) = subset_moments(rows, columns, [d <= float(cut)], np.asarray(location))
        det = float(np.linalg.det(cov))
    return location, cov, det
