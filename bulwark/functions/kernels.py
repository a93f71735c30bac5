"""Scalar kernels as columns; all stay inside generated code.

``Rho`` is the extension point: a loss with its derivative, as columns and (for
the small matrices on the driver) as array functions.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MAD_NORMAL = 0.6744897501960817


class Rho(ABC):
    @abstractmethod
    def rho(self, x: Column) -> Column: ...

    @abstractmethod
    def psi(self, x: Column) -> Column: ...

    @abstractmethod
    def rho_np(self, x: np.ndarray) -> np.ndarray: ...

    @abstractmethod
    def psi_np(self, x: np.ndarray) -> np.ndarray: ...

    def weight(self, x: Column) -> Column:
        """psi(x) / x, and its limit 1 near zero."""
        return F.when(F.abs(x) <= 1e-5, 1.0).otherwise(self.psi(x) / x)

    def weight_np(self, x: np.ndarray) -> np.ndarray:
        near = np.abs(x) <= 1e-5
        return np.where(near, 1.0, self.psi_np(x) / np.where(near, 1.0, x))


@dataclass(frozen=True)
class Tukey(Rho):
    """Bisquare, not scaled to a maximum of one (it is c^2 / 6)."""

    c: float

    def rho(self, x: Column) -> Column:
        c = self.c
        return F.when(F.abs(x) <= c, x * x / 2 - F.pow(x, F.lit(4.0)) / (2 * c**2) + F.pow(x, F.lit(6.0)) / (6 * c**4)).otherwise(c**2 / 6)

    def psi(self, x: Column) -> Column:
        inner = 1 - (x / self.c) * (x / self.c)
        return F.when(F.abs(x) <= self.c, x * inner * inner).otherwise(0.0)

    def rho_np(self, x: np.ndarray) -> np.ndarray:
        return np.where(np.abs(x) <= self.c, x**2 / 2 - x**4 / (2 * self.c**2) + x**6 / (6 * self.c**4), self.c**2 / 6)

    def psi_np(self, x: np.ndarray) -> np.ndarray:
        return np.where(np.abs(x) <= self.c, x * (1 - (x / self.c) ** 2) ** 2, 0.0)


@dataclass(frozen=True)
class Huber(Rho):
    b: float

    def rho(self, x: Column) -> Column:
        return F.when(F.abs(x) <= self.b, x * x / 2).otherwise(self.b * F.abs(x) - self.b**2 / 2)

    def psi(self, x: Column) -> Column:
        return F.greatest(F.lit(-self.b), F.least(F.lit(self.b), x))

    def rho_np(self, x: np.ndarray) -> np.ndarray:
        return np.where(np.abs(x) <= self.b, x**2 / 2, self.b * np.abs(x) - self.b**2 / 2)

    def psi_np(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x, -self.b, self.b)


def tau_weight(u: Column, c1: float = 4.5) -> Column:
    inner = 1 - (u / c1) * (u / c1)
    return F.when(F.abs(u) <= c1, inner * inner).otherwise(0.0)


def tau_rho(u: Column, c2: float = 3.0) -> Column:
    return F.least(u * u, F.lit(c2 * c2))


# Constants of the hyperbolic-tangent estimator and of wrapping: fixed values.
TANH = {"a": 0.7532528, "b": 0.8430849, "k": 4.1517212, "low": 1.5, "high": 4.0}
WRAP = {"b": 1.5, "c": 4.0, "q1": 1.540793, "q2": 0.8622731}


def tanh_weight(v: Column) -> Column:
    a, b, k, low, high = (TANH[n] for n in ("a", "b", "k", "low", "high"))
    y = F.abs(v)
    middle = math.sqrt(a * (k - 1)) * F.tanh(0.5 * math.sqrt((k - 1) * b**2 / a) * (high - y)) / y
    return F.when(y < low, 1.0).when(y > high, 0.0).otherwise(middle)


def wrap_psi(z: Column, b: float = 1.5, c: float = 4.0, q1: float = 1.540793, q2: float = 0.8622731) -> Column:
    return F.when(F.abs(z) < b, z).when(F.abs(z) <= c, q1 * F.tanh(q2 * (c - F.abs(z))) * F.signum(z)).otherwise(0.0)


def wrap_psi_np(z: np.ndarray, b: float = 1.5, c: float = 4.0, q1: float = 1.540793, q2: float = 0.8622731) -> np.ndarray:
    return np.where(np.abs(z) < b, z, np.where(np.abs(z) <= c, q1 * np.tanh(q2 * (c - np.abs(z))) * np.sign(z), 0.0))


def box_cox(x: Column, lam: float) -> Column:
    """Null where x is not positive."""
    return F.when(x > 0, F.log(x) if lam == 0 else (F.pow(x, F.lit(float(lam))) - 1) / lam)


def box_cox_inverse(y: Column, lam: float) -> Column:
    return F.exp(y) if lam == 0 else F.pow(y * lam + 1, F.lit(1 / lam))


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if lam == 0 else (F.pow(1 + x, F.lit(float(lam))) - 1) / lam
    down = -F.log1p(-x) if lam == 2 else -(F.pow(1 - x, F.lit(2.0 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def yeo_johnson_inverse(y: Column, lam: float) -> Column:
    up = F.expm1(y) if lam == 0 else F.pow(y * lam + 1, F.lit(1 / lam)) - 1
    down = -F.expm1(-y) if lam == 2 else 1 - F.pow(1 - y * (2 - lam), F.lit(1 / (2 - lam)))
    return F.when(y >= 0, up).otherwise(down)


def rectified_box_cox(x: Column, lam: float, turn: float) -> Column:
    """Box-Cox, continued by its tangent beyond the turning point: above it for lambda < 1, below it for lambda > 1."""
    at = math.log(turn) if lam == 0 else (turn**lam - 1) / lam
    line = at + (x - turn) * turn ** (lam - 1)
    if lam == 1:
        return box_cox(x, lam)
    return F.when((x > turn) if lam < 1 else (x < turn), line).otherwise(box_cox(x, lam))


def _yj(x: float, lam: float) -> float:
    if x >= 0:
        return math.log1p(x) if lam == 0 else ((1 + x) ** lam - 1) / lam
    return -math.log1p(-x) if lam == 2 else -((1 - x) ** (2 - lam) - 1) / (2 - lam)


def rectified_yeo_johnson(x: Column, lam: float, turn: float) -> Column:
    if lam == 1:
        return yeo_johnson(x, lam)
    slope = (1 + abs(turn)) ** ((lam - 1) if lam < 1 else (1 - lam))
    line = _yj(turn, lam) + (x - turn) * slope
    return F.when((x > turn) if lam < 1 else (x < turn), line).otherwise(yeo_johnson(x, lam))


def quadratic_form(columns: Sequence[Column], centre: np.ndarray, inverse: np.ndarray) -> Column:
    """(x - centre)' inverse (x - centre), half of the symmetric terms doubled."""
    d = [c - float(m) for c, m in zip(columns, centre, strict=True)]
    terms = [d[i] * d[j] * float(inverse[i, j] * (1 if i == j else 2)) for i in range(len(d)) for j in range(i, len(d))]
    return sum(terms[1:], terms[0])


def mahalanobis(columns: Sequence[Column], centre: np.ndarray, cov: np.ndarray) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), quadratic_form(columns, np.asarray(centre), np.linalg.inv(cov))))


def covariance_to_correlation(cov: np.ndarray) -> np.ndarray:
    s = np.sqrt(np.diag(cov))
    return cov / np.outer(s, s)


def truncated_covariance(cov: np.ndarray, least: float) -> np.ndarray:
    """The matrix with its eigenvalues raised to ``least`` at the least."""
    values, vectors = np.linalg.eigh(cov)
    return vectors @ np.diag(np.maximum(values, least)) @ vectors.T


def inverse_submatrix(cov: np.ndarray, inverse: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Inverse of cov[keep, keep]; from the inverse of the whole by a Schur complement if little is left out."""
    keep = np.asarray(keep, dtype=bool)
    if 2 * keep.sum() <= len(keep):
        return np.linalg.inv(cov[np.ix_(keep, keep)])
    if keep.all():
        return inverse
    drop = ~keep
    mixed = inverse[np.ix_(keep, drop)]
    return inverse[np.ix_(keep, keep)] - mixed @ np.linalg.solve(inverse[np.ix_(drop, drop)], mixed.T)


SQL_FUNCTIONS = {
    "huber_psi": ("x double, b double", "greatest(-b, least(b, x))"),
    "huber_rho": ("x double, b double", "case when abs(x) <= b then x * x / 2 else b * abs(x) - b * b / 2 end"),
    "tukey_psi": ("x double, c double", "case when abs(x) <= c then x * power(1 - power(x / c, 2), 2) else 0 end"),
    "tukey_rho": ("x double, c double", "case when abs(x) <= c then power(x, 2) / 2 - power(x, 4) / (2 * power(c, 2)) + power(x, 6) / (6 * power(c, 4)) else c * c / 6 end"),
    "wrap_psi": ("z double", "case when abs(z) < 1.5 then z when abs(z) <= 4 then 1.540793 * tanh(0.8622731 * (4 - abs(z))) * signum(z) else 0 end"),
}


def register_sql(spark: SparkSession) -> None:
    """Make the kernels temporary SQL functions; the optimiser inlines them."""
    for name, (arguments, body) in SQL_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({arguments}) returns double return {body}")
