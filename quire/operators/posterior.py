"""Posteriors of confusion counts as expressions over grids; pairwise ranks and affine maps by numpy.

Inputs are aggregates whose size is that of a vocabulary or of a design (classes squared, pairs of types, distinct covariate rows), however large the corpus is.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIAGONAL_WEIGHT = 0.7


def baseline(counts: np.ndarray) -> np.ndarray:
    """Prior mean of P(pred | true): mostly the diagonal, the rest as predictions are overall (never quite 0)."""
    marginal = np.maximum(counts.sum(0) / max(counts.sum(), 1), 1e-6)
    return DIAGONAL_WEIGHT * np.eye(len(counts)) + (1 - DIAGONAL_WEIGHT) * (marginal / marginal.sum())


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def kappa_grid(counts: np.ndarray, base: np.ndarray, n: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Concentrations and their posterior weights: log kappa is normal around log 4 (sd 0.75), rows are Dirichlet-multinomial."""
    grid = np.exp(np.linspace(math.log(4) - 5 * 0.75, math.log(4) + 5 * 0.75, n))
    rows = counts.sum(1)
    log = np.array([
        -0.5 * ((math.log(k) - math.log(4)) / 0.75) ** 2
        + sum(math.lgamma(k * b.sum()) - math.lgamma(k * b.sum() + r) for b, r in zip(base, rows))
        + float((_log_gamma(k * base + counts) - _log_gamma(k * base)).sum()) for k in grid])
    w = np.exp(log - log.max())
    return grid, w / w.sum()


def posterior_mean(counts: np.ndarray) -> np.ndarray:
    """E P(pred | true)."""
    counts = np.asarray(counts, float)
    base = baseline(counts)
    grid, w = kappa_grid(counts, base)
    return sum(p * (k * base + counts) / (k * base + counts).sum(1, keepdims=True) for k, p in zip(grid, w))


def posterior_draws(counts: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """n draws of P(pred | true)."""
    counts = np.asarray(counts, float)
    base, rng = baseline(counts), np.random.default_rng(seed)
    grid, w = kappa_grid(counts, base)
    out = np.empty((n, *counts.shape))
    for i, k in enumerate(rng.choice(grid, n, p=w)):
        g = rng.gamma(k * base + counts)
        out[i] = g / g.sum(1, keepdims=True)
    return out


def to_rows(draws: np.ndarray, labels: list[str]) -> list[tuple[int, str, str, float]]:
    """(draw, true, pred, p) for createDataFrame."""
    return [(d, t, p, float(draws[d, i, j])) for d in range(len(draws)) for i, t in enumerate(labels) for j, p in enumerate(labels)]


def bradley_terry(wins: dict[tuple[int, int], tuple[int, int]], n: int, reference: int = 0, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(theta, covariance of the free ones): P(i comes before j) = 1 / (1 + exp(theta_i - theta_j)); the reference is 0. Newton's method."""
    met = np.array([(i, j, a, a + b) for (i, j), (a, b) in wins.items()], float).reshape(-1, 4)
    met = met[met[:, 3] > 0]
    own = np.delete(np.eye(n), reference, axis=1)  # an indicator of each item but the reference
    x = own[met[:, 1].astype(int)] - own[met[:, 0].astype(int)]
    first, total = met[:, 2], met[:, 3]
    beta = np.zeros(n - 1)
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-x @ beta))
        info = x.T @ (x * (total * mu * (1 - mu))[:, None]) + 1e-10 * np.eye(n - 1)
        step = np.linalg.solve(info, x.T @ (first - total * mu))
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-10:
            break
    return own @ beta, np.linalg.inv(info)


def affine(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 2 x 3 matrix that maps source points to target points best in squares; at least three points that aren't in line."""
    source, target = np.asarray(source, float), np.asarray(target, float)
    if len(source) < 3:
        raise ValueError("an affine map needs three anchors")
    a = np.hstack([source, np.ones((len(source), 1))])
    found, _, rank, _ = np.linalg.lstsq(a, target, rcond=None)
    if rank < 3:
        raise ValueError("the anchors are in line")
    return found.T


def similarity(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 2 x 3 matrix of the turn, scale and shift that maps source points to target points best in squares; at least two distinct points."""
    s, t = (np.asarray(p, float) @ [1, 1j] for p in (source, target))
    off = s - s.mean()
    if len(s) < 2 or not np.abs(off).max() > 0:
        raise ValueError("a similarity needs two distinct anchors")
    a = (off.conj() @ t) / (off.conj() @ off).real
    b = t.mean() - a * s.mean()
    return np.array([[a.real, -a.imag, b.real], [a.imag, a.real, b.imag]])


def consensus(source: np.ndarray, target: np.ndarray, within: float = 3.0) -> np.ndarray:
    """The similarity that most anchors agree on: of those through two anchors, the one with most anchors ``within`` this distance (then with the least sum of theirs), fitted anew to these.

    Three anchors are the least. With only three, an outlier can't be told, so all of them count. All pairs are tried, as a template has few anchors.
    """
    source, target = np.asarray(source, float), np.asarray(target, float)
    if len(source) < 3:
        raise ValueError("a page needs three anchors")
    if len(source) == 3:
        return similarity(source, target)
    best = None
    for i in range(len(source)):
        for j in range(i):
            if (source[i] == source[j]).all():
                continue
            m = similarity(source[[j, i]], target[[j, i]])
            far = np.hypot(*(source @ m[:, :2].T + m[:, 2] - target).T)
            near = far <= within
            key = (int(near.sum()), -float(far[near].sum()))
            if best is None or key > best[0]:
                best = key, near
    if best is None:
        raise ValueError("all anchors lie on one point")
    return similarity(source[best[1]], target[best[1]])


def projected(matrix: np.ndarray, box: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    """The upright box around a projected box (x, y, width, height)."""
    x, y, w, h = box
    corners = np.array([[x, y, 1], [x + w, y, 1], [x, y + h, 1], [x + w, y + h, 1]]) @ np.asarray(matrix).T
    low, high = corners.min(0), corners.max(0)
    return float(low[0]), float(low[1]), float(high[0] - low[0]), float(high[1] - low[1])


# -- the same as DataFrames -------------------------------------------------------------------------------------------


def log_gamma(x: Column) -> Column:
    """Of positive numbers: raised by eight steps, then Stirling's series."""
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return series - sum((F.log(x + i) for i in range(1, 8)), F.log(x))


def baseline_prior(dense: DataFrame) -> DataFrame:
    """true, pred, n, p: the prior mean of P(pred | true), of dense counts (true, pred, n): mostly the diagonal, the rest as predictions are overall (never quite 0)."""
    share = dense.groupBy("pred").agg(F.sum("n").alias("s"))
    total = share.agg(F.greatest(F.sum("s"), F.lit(1)).alias("t"))
    share = share.crossJoin(total).select("pred", F.greatest(F.col("s") / F.col("t"), F.lit(1e-6)).alias("m"))
    share = share.crossJoin(share.agg(F.sum("m").alias("of"))).select("pred", (F.col("m") / F.col("of")).alias("m"))
    diagonal = F.when(F.col("true") == F.col("pred"), DIAGONAL_WEIGHT).otherwise(0.0)
    return dense.join(share, "pred").select("true", "pred", "n", (diagonal + (1 - DIAGONAL_WEIGHT) * F.col("m")).alias("p"))


def confusion_posterior(dense: DataFrame, n: int = 400) -> DataFrame:
    """true, pred, p: the posterior mean of P(pred | true) over a grid of concentrations, of dense counts; each grid point is a row for each cell."""
    width = 10 * 0.75 / (n - 1)
    grid = dense.sparkSession.range(n).select(F.col("id").alias("i"), F.exp(F.lit(math.log(4) - 5 * 0.75) + F.col("id") * width).alias("k"))
    cells = baseline_prior(dense).crossJoin(F.broadcast(grid)).withColumn("a", F.col("k") * F.col("p"))  # a vocabulary squared, times the grid
    rows = cells.groupBy("i", "k", "true").agg(F.sum("a").alias("sa"), F.sum("n").alias("r"), F.sum(log_gamma(F.col("a") + F.col("n")) - log_gamma(F.col("a"))).alias("own"))
    rows = rows.withColumn("ll", F.col("own") + log_gamma(F.col("sa")) - log_gamma(F.col("sa") + F.col("r")))
    log = rows.groupBy("i", "k").agg((F.sum("ll") - 0.5 * ((F.log("k") - math.log(4)) / 0.75) ** 2).alias("l"))
    top = log.agg(F.max("l").alias("top"))
    weight = log.crossJoin(F.broadcast(top)).select("i", F.exp(F.col("l") - F.col("top")).alias("w"))
    met = cells.join(rows.select("i", "true", "sa", "r"), ["i", "true"]).join(weight, "i")
    p = F.col("w") * (F.col("a") + F.col("n")) / (F.col("sa") + F.col("r"))
    return met.groupBy("true", "pred").agg((F.sum(p) / F.sum("w")).alias("p"))


def before_pairs(ranks: DataFrame) -> DataFrame:
    """type_a, type_b, p: how likely each type comes before each other one, of ranks (type, theta: a vocabulary)."""
    a = ranks.select(F.col("type").alias("type_a"), F.col("theta").alias("_a"))
    b = ranks.select(F.col("type").alias("type_b"), F.col("theta").alias("_b"))
    return a.join(F.broadcast(b), F.col("type_a") != F.col("type_b")).select("type_a", "type_b", (1 / (1 + F.exp(F.col("_a") - F.col("_b")))).alias("p"))
