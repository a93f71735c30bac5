"""Cleaning, scaling, wrapping and power transforms of columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bulwark.functions.kernels import (
    MAD_NORMAL,
    box_cox,
    box_cox_inverse,
    wrap_psi,
    yeo_johnson,
    yeo_johnson_inverse,
)
from bulwark.functions.special import chi2_ppf, norm_ppf
from bulwark.operators.univariate import MedianMad, RobustScale, UnivariateMcd
from bulwark.plans.frames import finite

# -- cleaning ----------------------------------------------------------------


@dataclass(frozen=True)
class CleanerModel:
    """What a cleaner drops: columns by reason, and the rows by their share of missing values."""

    kept: tuple[str, ...]
    dropped: dict[str, tuple[str, ...]]
    max_missing_frac_rows: float
    row_count: int
    columns_first: bool

    def transform(self, df: DataFrame) -> DataFrame:
        """Kept columns as doubles, without the rows that miss too much."""
        out = df.select(*[finite(F.col(c)).alias(c) for c in self.kept])
        return out.where(self.row_is_kept(self._judged())) if self.kept else out

    def _judged(self) -> tuple[str, ...]:
        return self.kept

    def row_is_kept(self, columns: Sequence[str]) -> Column:
        missing = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
        return missing / float(len(columns)) < self.max_missing_frac_rows

    def report(self, spark) -> DataFrame:
        rows = [(reason, c) for reason, columns in self.dropped.items() for c in columns]
        return spark.createDataFrame(rows, "reason string, column string")


@dataclass(frozen=True)
class DataCleaner:
    """Finds columns that robust methods can't use, from one pass of counts and two of medians.

    Dropped in this order: not numeric; at most ``min_unique_values`` distinct
    values; the row numbers 0 .. n-1; a median absolute deviation of at most
    ``min_abs_scale``; a share of missing values of ``max_missing_frac_cols`` or
    more.  Rows go that miss ``max_missing_frac_rows`` or more of what is left;
    with many more columns than rows, columns are judged on all rows first.
    """

    max_missing_frac_cols: float = 0.5
    max_missing_frac_rows: float = 0.5
    min_unique_values: int = 3
    min_abs_scale: float = 1e-12
    clean_na_first: str = "automatic"
    min_n_rows: int = 3

    def fit(self, df: DataFrame) -> CleanerModel:
        kinds = {f.name: f.dataType for f in df.schema}
        numbers = [c for c, k in kinds.items() if isinstance(k, T.NumericType)]
        dropped: dict[str, tuple[str, ...]] = {"non_numeric": tuple(c for c in kinds if c not in numbers)}
        aggs = [F.count(F.lit(1)).alias("n")]
        for c in numbers:
            x = finite(F.col(c))
            raw = F.col(c).cast("double")
            aggs += [F.count_distinct(F.when(~F.isnan(raw), raw)).alias(f"{c}\x01d"), F.sum(x.isNull().cast("long")).alias(f"{c}\x01m"), F.median(x).alias(f"{c}\x01q"), F.min(x).alias(f"{c}\x01a"), F.max(x).alias(f"{c}\x01z"), F.sum((x != F.floor(x)).cast("long")).alias(f"{c}\x01f")]
        row = df.agg(*aggs).first()
        n = row["n"]
        if n < self.min_n_rows:
            raise ValueError(f"{n} rows; at least {self.min_n_rows} are needed")
        left = list(numbers)

        def drop(reason: str, gone: Callable[[str], bool]) -> None:
            dropped[reason] = tuple(c for c in left if gone(c))
            left[:] = [c for c in left if c not in dropped[reason]]

        drop("discrete", lambda c: row[f"{c}\x01d"] <= self.min_unique_values)
        drop("row_numbers", lambda c: row[f"{c}\x01m"] == 0 and row[f"{c}\x01d"] == n and row[f"{c}\x01a"] == 0 and row[f"{c}\x01z"] == n - 1 and not row[f"{c}\x01f"])
        if left:
            mads = df.agg(*[F.median(F.abs(finite(F.col(c)) - (row[f"{c}\x01q"] or 0.0))).alias(c) for c in left]).first()
            drop("small_scale", lambda c: mads[c] is None or mads[c] <= self.min_abs_scale)
        columns_first = self.clean_na_first == "columns" or (self.clean_na_first == "automatic" and len(left) >= 5 * n)
        if columns_first or not left:
            drop("missing", lambda c: row[f"{c}\x01m"] / n >= self.max_missing_frac_cols)
        else:
            probe = CleanerModel(tuple(left), {}, self.max_missing_frac_rows, n, False)
            rows = df.select(*[finite(F.col(c)).alias(c) for c in left]).where(probe.row_is_kept(left))
            counts = rows.agg(F.count(F.lit(1)).alias("n\x01"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in left]).first()
            drop("missing", lambda c: (counts[c] or 0) / max(counts["n\x01"], 1) >= self.max_missing_frac_cols)
        return CleanerModel(tuple(left), dropped, self.max_missing_frac_rows, n, columns_first)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


# -- scaling -----------------------------------------------------------------


@dataclass(frozen=True)
class ScalerModel:
    location: dict[str, float]
    scale: dict[str, float]

    def _map(self, df: DataFrame, f: Callable[[Column, float, float], Column]) -> DataFrame:
        return df.withColumns({c: f(F.col(c).cast("double"), self.location[c], self.scale[c]) for c in self.location})

    def transform(self, df: DataFrame) -> DataFrame:
        return self._map(df, lambda x, m, s: (x - m) / s)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return self._map(df, lambda x, m, s: x * s + m)


@dataclass(frozen=True)
class RobustScaler:
    scale_estimator: RobustScale = field(default_factory=UnivariateMcd)
    with_centering: bool = True
    with_scaling: bool = True

    def fit(self, df: DataFrame, columns: Sequence[str]) -> ScalerModel:
        found = {r["feature"]: r for r in self.scale_estimator.agg(df, columns).collect()}  # one row per column
        location = {c: found[c]["location"] if self.with_centering else 0.0 for c in columns}
        scale = {c: found[c]["scale"] if self.with_scaling else 1.0 for c in columns}
        return ScalerModel(location, {c: s if s else 1.0 for c, s in scale.items()})


# -- wrapping ----------------------------------------------------------------


def wrapping_transformation(df: DataFrame, columns: Sequence[str], b: float = 1.5, c: float = 4.0, q1: float = 1.540793, q2: float = 0.8622731, rescale: bool = True, estimator: RobustScale | None = None) -> DataFrame:
    """The columns with outlying values pulled in; ``rescale`` keeps each column's robust location and scale.

    Location and scale default to the median and the plain median absolute
    deviation; a scale of zero counts as one while standardising.
    """
    found = {r["feature"]: r for r in (estimator or MedianMad()).agg(df, columns).collect()}
    clean = df.withColumns({x: finite(F.col(x)) for x in columns})
    wrapped = {}
    for x in columns:
        m, s = found[x]["location"], found[x]["scale"]
        wrapped[x] = wrap_psi((F.col(x) - m) / (s or 1.0), b, c, q1, q2)
    if not rescale:
        return clean.withColumns({x: y * found[x]["scale"] + found[x]["location"] for x, y in wrapped.items()})
    # y * s / std(y) + location - mean(y) * s / std(y)
    stats = clean.agg(*[F.avg(y).alias(f"{x}\x01m") for x, y in wrapped.items()], *[F.stddev_pop(y).alias(f"{x}\x01s") for x, y in wrapped.items()]).first()
    out = {}
    for x, y in wrapped.items():
        ratio = found[x]["scale"] / (stats[f"{x}\x01s"] or 1.0)
        out[x] = y * ratio + (found[x]["location"] - stats[f"{x}\x01m"] * ratio)
    return clean.withColumns(out)


# -- power transforms --------------------------------------------------------


def _bc(x: np.ndarray, lam: float) -> np.ndarray:
    return np.log(x) if lam == 0 else (x**lam - 1) / lam


def _yj(x: np.ndarray, lam: float) -> np.ndarray:
    out = np.empty_like(x)
    up = x >= 0
    out[up] = np.log1p(x[up]) if lam == 0 else ((1 + x[up]) ** lam - 1) / lam
    out[~up] = -np.log1p(-x[~up]) if lam == 2 else -((1 - x[~up]) ** (2 - lam) - 1) / (2 - lam)
    return out


def _inverse(y: float, lam: float, kind: str) -> float:
    if kind == "boxcox":
        return float(np.exp(y)) if lam == 0 else float((y * lam + 1) ** (1 / lam))
    if y >= 0:
        return float(np.expm1(y)) if lam == 0 else float((y * lam + 1) ** (1 / lam) - 1)
    return float(-np.expm1(-y)) if lam == 2 else float(1 - (1 - y * (2 - lam)) ** (1 / (2 - lam)))


def _rectified(x: np.ndarray, lam: float, kind: str) -> np.ndarray:
    """Transform of sorted x, linear beyond a turning point near the quartile on the stretched side."""
    plain = _bc if kind == "boxcox" else _yj
    if lam == 1:
        return x - 1 if kind == "boxcox" else x.copy()
    n, quarter = len(x), -(-len(x) // 4)
    at = plain(x[[n - quarter if lam < 1 else quarter - 1]], lam)[0] * 1.5
    if kind == "boxcox":
        if lam:
            at = min(at, -1 / lam - 1e-5) if lam < 0 else max(at, -1 / lam + 1e-5)
    elif lam < 0:
        at = min(at, -1 / lam - 1e-5)
    elif lam > 2:
        at = max(at, 1 / (2 - lam) + 1e-5)
    turn = min(max(_inverse(at, lam, kind), x[0]), x[-1])
    slope = turn ** (lam - 1) if kind == "boxcox" else (1 + abs(turn)) ** ((lam - 1) if lam < 1 else (1 - lam))
    line = plain(np.array([turn]), lam)[0] + (x - turn) * slope
    beyond = x > turn if lam < 1 else x < turn
    out = np.where(beyond, 0.0, 0.0)
    out[~beyond] = plain(x[~beyond], lam)
    out[beyond] = line[beyond]
    return out


def _huber_standardised(x: np.ndarray) -> np.ndarray:
    m = np.median(x)
    s = np.median(np.abs(x - m)) / MAD_NORMAL or 1.0
    r = (x - m) / s
    w = np.where(np.abs(r) <= 1e-5, 1.0, np.clip(r, -1.5, 1.5) / np.where(r == 0, 1.0, r))
    return (x - (w * x).sum() / w.sum()) / (s * np.sqrt((np.clip(r, -1.5, 1.5) ** 2).mean() / 0.7784655))


def _bounded_minimum(f: Callable[[float], float], low: float, high: float, grid: int = 60, steps: int = 60) -> float:
    """Coarse grid, then golden-section search around its best point."""
    xs = np.linspace(low, high, grid + 1)
    k = int(np.argmin([f(x) for x in xs]))
    a, b = xs[max(k - 1, 0)], xs[min(k + 1, grid)]
    g = (np.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    for _ in range(steps):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
        if b - a < 1e-9:
            break
    return float((a + b) / 2)


@dataclass(frozen=True)
class PowerModel:
    column: str
    kind: str
    lam: float
    shift: float
    factor: float
    mean: float
    std: float
    standardize: bool
    normality: float

    def transform(self, x: Column) -> Column:
        """Null for values outside the domain."""
        x = (x - self.shift) / self.factor if self.standardize else x
        y = box_cox(x, self.lam) if self.kind == "boxcox" else yeo_johnson(x, self.lam)
        return (y - self.mean) / self.std if self.standardize else y

    def inverse(self, z: Column) -> Column:
        y = z * self.std + self.mean if self.standardize else z
        if self.lam and self.kind == "boxcox":
            edge = -1 / self.lam
            y = F.when(y * self.lam <= -1, 0.95 * edge).otherwise(y)
        elif self.kind == "yeojohnson":
            if self.lam < 0:
                y = F.when(y >= -1 / self.lam, -0.95 / self.lam).otherwise(y)
            elif self.lam > 2:
                y = F.when(y <= 1 / (2 - self.lam), 0.95 / (2 - self.lam)).otherwise(y)
        x = box_cox_inverse(y, self.lam) if self.kind == "boxcox" else yeo_johnson_inverse(y, self.lam)
        return x * self.factor + self.shift if self.standardize else x


#: Sorted values that the search for lambda works on; more rows are stood for by as many quantiles.
POWER_POINTS = 20_000


@dataclass(frozen=True)
class RobustPowerTransformer:
    """Box-Cox or Yeo-Johnson with a lambda that the tails can't pull.

    The driver searches on the sorted column if it has at most POWER_POINTS
    values, else on that many of its quantiles, the ends exact (bounded whatever the input).
    """

    method: str = "yeojohnson"
    standardize: bool = True
    lambda_range: tuple[float, float] = (-4.0, 6.0)
    quantile: float = 0.99
    nsteps: int = 2

    def sorted_values(self, df: DataFrame, column: str) -> np.ndarray:
        x = df.select(finite(F.col(column)).alias("x")).where("x is not null")
        n = x.count()
        if n <= POWER_POINTS:
            return np.sort(x.toPandas()["x"].to_numpy())
        probs = [(i + 0.5) / POWER_POINTS for i in range(POWER_POINTS)]
        inner, least, most = x.agg(F.percentile_approx("x", probs, 10 * POWER_POINTS), F.min("x"), F.max("x")).first()
        # the ends are exact: they decide whether all values are positive
        return np.array([least, *inner[1:-1], most])

    def fit(self, df: DataFrame, column: str) -> PowerModel:
        x = self.sorted_values(df, column)
        if self.method != "auto":
            return self.fit_sorted(x, column, self.method)
        found = [self.fit_sorted(x, column, "yeojohnson")]
        if x[0] > 0:
            found.append(self.fit_sorted(x, column, "boxcox"))
        return min(found, key=lambda m: m.normality)

    def fit_sorted(self, x: np.ndarray, column: str, kind: str) -> PowerModel:
        if kind == "boxcox" and x[0] <= 0:
            raise ValueError(f"{column} has values that are not positive")
        shift, factor = 0.0, 1.0
        if self.standardize:
            m = float(np.median(x))
            if kind == "boxcox":
                factor = m
            else:
                shift, factor = m, float(np.median(np.abs(x - m)) / MAD_NORMAL) or 1.0
        x = (x - shift) / factor
        n = len(x)
        scores = np.array([norm_ppf((i + 1 - 1 / 3) / (n + 1 / 3)) for i in range(n)])
        plain = _bc if kind == "boxcox" else _yj

        def distance(lam: float) -> float:
            d = _huber_standardised(_rectified(x, lam, kind)) - scores
            c = 0.5
            return float(np.where(np.abs(d) <= c, d**2 / 2 - d**4 / (2 * c**2) + d**6 / (6 * c**4), c**2 / 6).sum())

        low, high = self.lambda_range
        with np.errstate(all="ignore"):
            for _ in range(4):
                lam = _bounded_minimum(lambda v: (r if np.isfinite(r := distance(v)) else np.inf), low, high)
                if low + 1e-6 < lam < high - 1e-6:
                    break
                low, high = low - 4, high + 4
            jacobian = np.log(x) if kind == "boxcox" else np.sign(x) * np.log1p(np.abs(x))
            z = _huber_standardised(_rectified(x, lam, kind))
            cutoff = np.sqrt(chi2_ppf(self.quantile, 1))
            keep = np.abs(z) <= cutoff
            for _ in range(self.nsteps):
                kept, slope = x[keep], float(jacobian[keep].sum())

                def likelihood(v: float, kept: np.ndarray = kept, slope: float = slope) -> float:
                    value = len(kept) / 2 * np.log(plain(kept, v).var()) - (v - 1) * slope
                    return value if np.isfinite(value) else np.inf

                lam = _bounded_minimum(likelihood, low, high)
                y = plain(x, lam)
                mean, std = float(y[keep].mean()), float(y[keep].std())
                z = (y - mean) / std
                keep = np.abs(z) <= cutoff
        y = plain(x, lam)
        mean, std = float(y[keep].mean()), float(y[keep].std())
        return PowerModel(column, kind, lam, shift, factor, mean, std, self.standardize, distance(lam) / n)
