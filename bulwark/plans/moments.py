"""Means, covariances and Gram matrices in one aggregation, for many subsets at once."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bulwark.plans.ship import ship

#: Rows drawn to place the first edges of a search for order statistics; they never decide a result.
BRACKET_ROWS = 20_000
#: Edges of one interval in one pass of counting, and of all intervals together.
EDGES, ALL_EDGES = 160, 20_000
#: At most so many values inside the last intervals are sent to the driver; more are counted in finer intervals first.
GATHERED = 200_000
#: At most about so many rows between the two values of a trimmed step go to the driver.
STEP_ROWS = 80_000
#: Aggregates in one job; more would make methods too large to compile.
MOST_AGGREGATES = 400


def _run(df: DataFrame, aggregates: list[Column]) -> list:
    out: list = []
    for k in range(0, len(aggregates), MOST_AGGREGATES):
        out += list(df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggregates[k : k + MOST_AGGREGATES])]).first())
    return out


def _bits(v: float) -> int:
    """Whole numbers in the order of the doubles."""
    i = int(np.array(v + 0.0).view(np.int64))
    return i if i >= 0 else -(2**63) - i - 1


def doubles_between(a: float, z: float, most: int) -> np.ndarray:
    """At most so many doubles inside (a, z), evenly spaced over the doubles there are; with infinite ends, those too."""
    low, high = _bits(a) + (a != -np.inf), _bits(z) - (z != np.inf)
    at = sorted({low + (high - low) * k // (most - 1) for k in range(most)}) if high >= low else []
    return np.array([i if i >= 0 else -(2**63) - i - 1 for i in at], dtype=np.int64).view(float)


def _thin(edges: np.ndarray, most: int) -> np.ndarray:
    edges = np.unique(edges[np.isfinite(edges)])
    return edges if len(edges) <= most else edges[np.linspace(0, len(edges) - 1, most).round().astype(int)]


def _within(v: np.ndarray, a: float, z: float) -> np.ndarray:
    """Which values lie strictly between; infinite ends belong to their interval."""
    return ((v > a) if a > -np.inf else (v >= a)) & ((v < z) if z < np.inf else (v <= z))


def _bin_counts(v: np.ndarray, a: float, z: float, edges: np.ndarray) -> np.ndarray:
    """Counts below the first edge, at it, between it and the second, and so on up to the last edge."""
    inside = v[(v >= edges[0]) & (v <= edges[-1])]
    out = np.bincount(np.searchsorted(edges, inside, "left") + np.searchsorted(edges, inside, "right"), minlength=2 * len(edges))
    out[0] = np.count_nonzero((v < edges[0]) & ((v > a) if a > -np.inf else True))
    return out


def counted_ranks(df: DataFrame, names: Sequence[str], of: Callable[[np.ndarray], np.ndarray], ranks: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Exact order statistics of the K values that ``of`` makes of each row: ``ranks`` is K x R (from 1), so is the result; NaN values are missing.

    ``edges`` are K first guesses.  Each pass over the rows counts how many values
    lie at and between the edges of the intervals in question, which
    leaves one narrower interval, or one value, for each rank.  When few values are left in
    all of them they are gathered.  Guesses cost or save passes, they don't
    change results; intervals shrink to single doubles in a bounded number of passes whatever the size.
    """
    names, out = list(names), np.full(np.shape(ranks), np.nan)
    live = {(k, -np.inf, np.inf): (0, None, [r for r in range(out.shape[1]) if ranks[k][r] > 0]) for k in range(len(out))}
    live = {key: v for key, v in live.items() if v[2]}
    first = True
    while live and (first or sum(math.inf if size is None else size for _, size, _ in live.values()) > GATHERED):
        most = max(16, min(EDGES, ALL_EDGES // len(live)))
        cuts = []
        for k, a, z in live:
            e = _thin(np.asarray(edges[k], dtype=float), most) if first else np.empty(0)
            cuts.append((k, a, z, e if len(e) else doubles_between(a, z, most)))

        def count(x: np.ndarray, cuts: list = cuts) -> np.ndarray:
            v = np.ascontiguousarray(of(x).T)
            return np.concatenate([_bin_counts(v[k], a, z, e) for k, a, z, e in cuts])

        got, at, narrower = block_sums(df, names, count), 0, {}
        for (k, a, z, e), (below, _, wanted) in zip(cuts, live.values(), strict=True):
            counts = got[at : at + 2 * len(e)].round().astype(np.int64)
            upto, at = below + np.cumsum(counts), at + 2 * len(e)
            for r in wanted:
                j = int(np.searchsorted(upto, ranks[k][r]))
                if j % 2:
                    out[k, r] = e[j // 2]
                elif j == len(upto) and e[-1] == np.inf:
                    continue  # fewer values than the rank
                else:
                    key = (k, float(e[j // 2 - 1]) if j else a, float(e[j // 2]) if j < len(upto) else z)
                    size = int(counts[j]) if j < len(upto) else None
                    narrower.setdefault(key, (int(upto[j - 1]) if j else below, size, []))[2].append(r)
        live, first = narrower, False
    if not live:
        return out
    wanted = list(live)
    ship(df.sparkSession)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = of(_matrix(batch, names))
            found = [v[_within(v[:, k], a, z), k] for k, a, z in wanted]
            which = np.repeat(np.arange(len(found), dtype=np.int32), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(np.concatenate(found))], names=["at", "v"])

    inside = df.select(*names).mapInArrow(gather, "at int, v double").toArrow()
    which, value = inside["at"].to_numpy(), inside["v"].to_numpy()
    for i, (k, a, z) in enumerate(wanted):
        below, _, asked = live[(k, a, z)]
        values = np.sort(value[which == i])
        for r in asked:
            if ranks[k][r] - below <= len(values):
                out[k, r] = values[ranks[k][r] - below - 1]
    return out


def _guesses(guess: np.ndarray, ranks: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """First edges from a sample of the values: its order statistics around each rank, by four standard errors."""
    out = []
    for v, r, n in zip(guess.T, ranks, counts, strict=True):
        v = np.sort(v[~np.isnan(v)])
        if not len(v) or not n:
            out.append(np.empty(0))
            continue
        at = np.array([min(r), max(r)]) / n * len(v)
        slack = 4 * np.sqrt(at * (1 - at / len(v)).clip(0)) + 2
        out.append(v[max(0, int(at[0] - slack[0])) : int(at[1] + slack[1]) + 1])
    return out


def bracket_rows(df: DataFrame, names: Sequence[str], n: int) -> np.ndarray:
    """About BRACKET_ROWS of the n rows, to place first edges with."""
    got = df.select(*names).sample(min(1.0, BRACKET_ROWS / max(n, 1)), 0).toArrow()
    return np.column_stack([got[c].to_numpy().astype(float) for c in names])


def ranks_of(df: DataFrame, names: Sequence[str], of: Callable[[np.ndarray], np.ndarray], rank: int, n: int, rows: np.ndarray | None = None) -> np.ndarray:
    """The ``rank``-th smallest (from 1) of each of the values that ``of`` makes of the n rows; ``rows``: see bracket_rows."""
    guess = of(bracket_rows(df, names, n) if rows is None else rows)
    ranks = np.full((guess.shape[1], 1), rank)
    return counted_ranks(df, names, of, ranks, _guesses(guess, ranks, np.full(len(ranks), n)))[:, 0]


def counts_of(df: DataFrame, names: Sequence[str], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """How many known values ``of`` makes of the rows, by value."""
    return block_sums(df, names, lambda x: (~np.isnan(of(x))).sum(axis=0)).round().astype(np.int64)


def medians_of(df: DataFrame, names: Sequence[str], of: Callable[[np.ndarray], np.ndarray], counts: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """Median of each of the values that ``of`` makes of the rows, NaN left out; ``counts`` are those of known values."""
    guess = of(bracket_rows(df, names, int(max(counts, default=0))) if rows is None else rows)
    ranks = np.array([[(n + 1) // 2, n // 2 + 1] if n else [0, 0] for n in counts], dtype=np.int64).reshape(len(counts), 2)
    return counted_ranks(df, names, of, ranks, _guesses(guess, ranks, counts)).mean(axis=1)


def _ranked(df: DataFrame, values: Sequence[Column], ranks: Sequence[int], n: int) -> list[list[float]]:
    """For each value column, its order statistics of the given neighbouring ranks (from 1) over n rows without nulls.

    The same way at every size: quantiles of a few sampled rows give the first edges, see counted_ranks.
    """
    slack = 4 * math.sqrt(0.25 / min(n, BRACKET_ROWS))
    probs = np.linspace(max(0.0, (min(ranks) - 1) / n - slack), min(1.0, max(ranks) / n + slack), EDGES).tolist()
    edges = _run(df.sample(min(1.0, BRACKET_ROWS / n), 0), [F.percentile(v, probs) for v in values])
    names = [f"v{i}" for i in range(len(values))]
    frame = df.select(*[v.cast("double").alias(c) for v, c in zip(values, names, strict=True)])
    return counted_ranks(frame, names, lambda x: x, np.tile(list(ranks), (len(values), 1)), [e or [] for e in edges]).tolist()


def order_statistics(df: DataFrame, values: Sequence[Column], rank: int, n: int) -> list[float]:
    """The ``rank``-th smallest (from 1) of each value column over all n rows."""
    return [v[0] for v in _ranked(df, values, [rank], n)]


def medians(df: DataFrame, values: Sequence[Column], n: int) -> np.ndarray:
    """Median of each value column over n rows without nulls (mean of the two middle values for even n)."""
    if n == 0:
        return np.full(len(values), np.nan)
    return np.array([np.mean(v) for v in _ranked(df, values, sorted({(n + 1) // 2, n // 2 + 1}), n)], dtype=float)


def subset_moments(df: DataFrame, columns: Sequence[str], masks: Sequence[Column | None], centre: np.ndarray, weights: Sequence[Column | None] | None = None, ddof: int = 1) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(weight, mean, covariance) of the rows under each mask.

    Values are centred first (cancellation), and a mask is a filter inside the
    sums, so all subsets share one scan.
    """
    p = len(columns)
    x = [F.col(c) - float(m) for c, m in zip(columns, centre, strict=True)]
    weights = weights or [None] * len(masks)
    aggregates: list[Column] = []
    for mask, weight in zip(masks, weights, strict=True):
        w = weight if weight is not None else F.lit(1.0)
        under = (lambda v, mask=mask, w=w: F.sum(F.when(mask, v * w)) if mask is not None else F.sum(v * w))
        aggregates += [under(F.lit(1.0))] + [under(v) for v in x] + [under(x[i] * x[j]) for i in range(p) for j in range(i, p)]
    got = np.array([v or 0.0 for v in _run(df, aggregates)], dtype=float).reshape(len(masks), -1)
    out = []
    for row in got:
        n, s = row[0], row[1 : p + 1]
        second = np.zeros((p, p))
        second[np.triu_indices(p)] = row[p + 1 :]
        second = second + np.triu(second, 1).T
        mean = s / max(n, 1e-300)
        out.append((n, mean + centre, (second - n * np.outer(mean, mean)) / max(n - ddof, 1e-300)))
    return out


def _matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names])


def grams_of(df: DataFrame, columns: Sequence[str], intercept: bool, of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """((X'WX, X'Wy) for each of K weights, sums of K values); ``of`` makes both (rows x K) of a block, the label is the last column."""
    terms, p = gram_terms(intercept), len(columns) - 1 + intercept

    def total(x: np.ndarray) -> np.ndarray:
        w, values = of(x)
        return np.column_stack([w.T @ terms(x), values.sum(axis=0)]).ravel()

    got = block_sums(df, columns, total).reshape(-1, 2 + p * (p + 1) // 2 + p)
    return [gram_from(row, p) for row in got], got[:, -1]


class TrimmedSums:
    """Sums of ``terms`` (rows x q, the first a one) and of the value over the h rows of least value, step after step with moving values.

    A pass sums what lies up to a low value and at a high one and sends the rows
    between to the driver; where the h-th value is among them, the step is done. The two
    come from the sampled rows, near where the last cut fell among them. Where they
    miss, or too many rows would lie between, exact ranks are counted first.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str], terms: Callable[[np.ndarray], np.ndarray], h: int, n: int) -> None:
        self.df, self.columns, self.terms, self.h, self.n = df, list(columns), terms, h, n
        self.some = bracket_rows(df, columns, n)
        self.at = self.reach = None

    def keep(self, which: Sequence[int]) -> None:
        """Candidates that go on, in their new order."""
        self.at, self.reach = self.at[list(which)], self.reach[list(which)]

    def step(self, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """K x (q + 1): sums of the terms, then of the value, for each of the K values that ``of`` makes of a row."""
        guess = np.sort(of(self.some), axis=0)
        found = self._near(of, guess) if self.at is not None else None
        if found is None:
            cuts, terms = ranks_of(self.df, self.columns, of, self.h, self.n, self.some), self.terms

            def total(x: np.ndarray) -> np.ndarray:
                v = of(x)
                under = v <= cuts
                return np.column_stack([under.T.astype(float) @ terms(x), np.where(under, v, 0.0).sum(axis=0)]).ravel()

            found = cuts, block_sums(self.df, self.columns, total).reshape(len(cuts), -1)
        at = np.array([np.searchsorted(g, c) for g, c in zip(guess.T, found[0], strict=True)])
        self.reach = np.full(len(at), 20) if self.at is None else 3 + 2 * np.abs(at - self.at)
        self.at = at
        return found[1]

    def _near(self, of: Callable[[np.ndarray], np.ndarray], guess: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        m, k = guess.shape
        if (2 * self.reach + 1).sum() * self.n / max(m, 1) > STEP_ROWS:
            return None
        low, high = (guess[np.clip(self.at + d, 0, m - 1), range(k)] for d in (-self.reach, self.reach))
        names, terms, width = self.columns, self.terms, len(self.columns) + 2
        ship(self.df.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, rows = 0.0, []
            for batch in batches:
                x = _matrix(batch, names)
                v = of(x)
                masks = np.hstack([v <= low, (v == high) & (high > low)])
                total = total + np.column_stack([masks.T.astype(float) @ terms(x), np.where(masks, np.hstack([v, v]), 0.0).sum(axis=0), np.hstack([v < low, v < low]).sum(axis=0)])
                row, which = np.nonzero((v > low) & (v < high))
                rows.append(np.column_stack([which, v[row, which], x[row]]))
            found = [np.concatenate([[-1.0], total.ravel()])] if rows else []
            found += [r for block in rows for r in block]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64()))], names=["r"])

        sums, inside = 0.0, [np.empty((0, width))]
        for r in self.df.select(*names).mapInArrow(run, "r array<double>").toArrow()["r"].to_numpy():
            if r[0] == -1:
                sums = sums + r[1:].reshape(2 * k, -1)
            else:
                inside.append(r[None])
        between, cuts, out = np.concatenate(inside), np.empty(k), []
        for i in range(k):
            upto, last, mine = sums[i, :-1], sums[k + i, :-1], between[between[:, 0] == i]
            mine = mine[np.argsort(mine[:, 1], kind="stable")]
            r = self.h - int(upto[0])
            if self.h <= sums[i, -1] or r > len(mine) + last[0]:
                return None
            cuts[i] = low[i] if r <= 0 else mine[r - 1, 1] if r <= len(mine) else high[i]
            taken = mine[mine[:, 1] <= cuts[i]]
            row = upto + np.append(terms(taken[:, 2:]).sum(axis=0), taken[:, 1].sum())
            out.append(row + last if cuts[i] == high[i] and high[i] > low[i] else row)
        return cuts, np.array(out)


def moment_terms(centre: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """One, the centred values, their products."""
    i, j = np.triu_indices(len(centre))

    def terms(x: np.ndarray) -> np.ndarray:
        d = x - centre
        return np.column_stack([np.ones(len(d)), d, d[:, i] * d[:, j]])

    return terms


def moments_from(row: np.ndarray, centre: np.ndarray, ddof: int = 1) -> tuple[float, np.ndarray, np.ndarray]:
    """(weight, mean, covariance) from sums of those terms."""
    p, n = len(centre), row[0]
    i, j = np.triu_indices(p)
    second = np.zeros((p, p))
    second[i, j] = second[j, i] = row[p + 1 : p + 1 + len(i)]
    mean = row[1 : p + 1] / max(n, 1e-300)
    return n, mean + centre, (second - n * np.outer(mean, mean)) / max(n - ddof, 1e-300)


def gram_terms(intercept: bool) -> Callable[[np.ndarray], np.ndarray]:
    """One, the products of regressors, their products with the label (the last column)."""

    def terms(x: np.ndarray) -> np.ndarray:
        a = np.column_stack([x[:, :-1], np.ones(len(x))]) if intercept else x[:, :-1]
        i, j = np.triu_indices(a.shape[1])
        return np.column_stack([np.ones(len(x)), a[:, i] * a[:, j], a * x[:, -1:]])

    return terms


def gram_from(row: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """(X'X, X'y) from sums of those terms."""
    i, j = np.triu_indices(p)
    gram = np.zeros((p, p))
    gram[i, j] = gram[j, i] = row[1 : 1 + len(i)]
    return gram, row[1 + len(i) : 1 + len(i) + p]


def block_sums(df: DataFrame, columns: Sequence[str], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of the vector that ``of`` makes of a block of them; for many columns, where p x p aggregates grow too large to compile.

    Every task adds its blocks up and sends one vector; those are added by place.
    ``of`` gets an empty block too, so an empty table gives the sum of nothing.
    """
    names = list(columns)
    ship(df.sparkSession)
    nothing = np.asarray(of(np.empty((0, len(names)))), dtype=float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = nothing.copy()
        for batch in batches:
            total += of(_matrix(batch, names))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "v"])

    got = df.select(*names).mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = nothing.copy()
    out[got["at"].to_numpy()] = got["v"].to_numpy()
    return out


def weighted_gram_and(df: DataFrame, x: Sequence[Column], y: Column, weights: Sequence[Column], more: Sequence[Column]) -> tuple[list[tuple[np.ndarray, np.ndarray]], list]:
    """(X'WX, X'Wy) for each weight column, and further aggregates, in one scan."""
    p = len(x)
    aggregates = [F.sum(w * t) for w in weights for t in [x[i] * x[j] for i in range(p) for j in range(i, p)] + [v * y for v in x]]
    found = _run(df, [*aggregates, *more])
    got = np.array([v or 0.0 for v in found[: len(aggregates)]], dtype=float).reshape(len(weights), -1)
    out = []
    for row in got:
        gram = np.zeros((p, p))
        gram[np.triu_indices(p)] = row[: p * (p + 1) // 2]
        out.append((gram + np.triu(gram, 1).T, row[p * (p + 1) // 2 :]))
    return out, found[len(aggregates) :]


def weighted_gram(df: DataFrame, x: Sequence[Column], y: Column, weights: Sequence[Column]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(X'WX, X'Wy) for each weight column, in one scan; put a literal one into ``x`` for an intercept."""
    return weighted_gram_and(df, x, y, weights, [])[0]


def hashed_sample(df: DataFrame, columns: Sequence[str], most: int, seed: int = 0) -> np.ndarray:
    """At most ``most`` rows, each row with the same chance, equal rows too: the same rows whatever the partitioning.

    Equal rows are counted first.  Every row stands for a uniform number, and the
    ``most`` smallest are taken; the smallest of ``c`` equal rows are drawn in
    rising order from a seed made of their values, so a large group costs no
    more than its rows in the sample.
    """
    columns = list(columns)
    equal = df.groupBy(*columns).agg(F.count("*").alias("_n")).persist()
    try:
        n = int(equal.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0])
        if n <= most:
            return df.select(*columns).orderBy(F.xxhash64(F.lit(seed), *columns), *columns).toPandas().to_numpy(dtype=float)
        # above the most-th smallest of n uniform numbers but for a chance below 1e-15; then the next round takes all of them
        for limit in (min(1.0, (most + 10 * math.sqrt(most) + 50) / n), 1.0):

            def run(batches: Iterator[pa.RecordBatch], limit: float = limit) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    which, at = _smallest(batch.column("_h").to_numpy(), batch.column("_n").to_numpy(), limit, most)
                    kept = batch.take(pa.array(which))
                    yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in columns), pa.array(at)], names=[*columns, "_u"])

            ship(df.sparkSession)
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema)
            drawn = equal.select(*columns, "_n", F.xxhash64(F.lit(seed), *columns).alias("_h")).mapInArrow(run, schema + ", _u double")
            got = drawn.orderBy("_u", *columns).limit(most).toPandas()
            if len(got) == most:
                break
        return got[columns].to_numpy(dtype=float)
    finally:
        equal.unpersist()


def _smallest(seeds: np.ndarray, counts: np.ndarray, limit: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(group, number): for each group of ``counts`` uniform numbers, its smallest ones up to ``limit``, ``most`` of them at most."""
    first = (seeds.view(np.uint64) >> np.uint64(11)).astype(float) / 2**53
    first = -np.expm1(np.log1p(-first) / counts)
    group, number = [], []
    for g in np.flatnonzero(first <= limit):
        rng, at, k = np.random.default_rng(int(seeds[g]) & (2**64 - 1)), float(first[g]), 1
        while at <= limit:
            group.append(g)
            number.append(at)
            if k == min(counts[g], most):
                break
            # the next of the numbers left, uniform above this one
            at += (1 - at) * -math.expm1(math.log1p(-rng.random()) / (int(counts[g]) - k))
            k += 1
    return np.array(group, dtype=np.int64), np.array(number, dtype=float)
