"""Least value of a costly function on a box: a Gaussian process and expected improvement, seeded."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np

SCALES = (0.1, 0.2, 0.4, 0.8, 1.6)  # length scales tried, as shares of the box's sides
JITTER = 1e-6
CANDIDATES = 512
SERIAL = 64


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between the rows of a and of b, by the root of 5."""
    square = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        square += (a[:, None, k] - b[None, :, k]) ** 2
    return np.sqrt(5 * square)


def matern(r: np.ndarray, scale: float) -> np.ndarray:
    """Matern covariance of smoothness 5/2 at distances r."""
    r = r / scale
    return (1 + r + r * r / 3) * np.exp(-r)


class Process:
    """Values seen at points of the unit box, standardised; the length scale is the likeliest of SCALES."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.x, self.mean, self.spread = x, y.mean(), y.std() or 1.0
        z = (y - self.mean) / self.spread
        best, r = -math.inf, distances(x, x)
        for scale in SCALES:
            root = np.linalg.cholesky(matern(r, scale) + JITTER * np.eye(len(x)))
            half = np.linalg.solve(root, z)
            likelihood = -0.5 * float(half @ half) - float(np.log(np.diag(root)).sum())
            if likelihood > best:
                best, self.scale, self.root, self.half = likelihood, scale, root, half

    def at(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and standard deviation at points."""
        # blocks of SERIAL points, and a sum instead of a product: for more a linear algebra library starts threads in every task, which then wait for one another
        cov, root = matern(distances(self.x, points), self.scale), np.linalg.inv(self.root)
        part = np.concatenate([root @ cov[:, a : a + SERIAL] for a in range(0, len(points), SERIAL)], axis=1)
        deviation = np.sqrt(np.maximum(1 + JITTER - (part * part).sum(axis=0), 0))
        return self.mean + self.spread * np.einsum("i,ij->j", self.half, part), self.spread * deviation


def expected_improvement(mean: np.ndarray, deviation: np.ndarray, least: float) -> np.ndarray:
    """How far below the least value seen a normal value is expected to fall."""
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.where(deviation > 0, (least - mean) / deviation, 0.0)
    below = 0.5 * (1 + np.array(list(map(math.erf, (z / math.sqrt(2)).tolist()))))
    gain = (least - mean) * below + deviation * np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    return np.where(deviation > 0, gain, np.maximum(least - mean, 0))


def minimize(value: Callable[[np.ndarray], float], low: Sequence[float], high: Sequence[float], calls: int = 40, start: int = 10, seed: int = 0) -> tuple[np.ndarray, float]:
    """The best of `calls` points and its value: first a Latin square of `start` points, then each where most improvement is expected.

    Candidates are uniform in the box and normal about the best point seen. The same
    seed and function give the same points in whatever process; of equal values the least point is taken, by its first coordinate first. A box without extent
    in a dimension stays there; values must be finite."""
    if calls < 1:
        raise ValueError("at least one call is needed")
    rng = np.random.default_rng(seed)
    lo, hi = np.asarray(low, float), np.asarray(high, float)
    start = max(1, min(start, calls))
    x = (np.stack([rng.permutation(start) for _ in lo], axis=1) + rng.random((start, len(lo)))) / start
    y = np.array([value(lo + (hi - lo) * u) for u in x])
    while len(y) < calls:
        near = x[y.argmin()] + 0.05 * rng.standard_normal((CANDIDATES // 4, len(lo)))
        tried = np.vstack([rng.random((CANDIDATES, len(lo))), np.clip(near, 0, 1)])
        u = tried[expected_improvement(*Process(x, y).at(tried), float(y.min())).argmax()]
        x, y = np.vstack([x, u]), np.append(y, value(lo + (hi - lo) * u))
    least = min(x[y == y.min()].tolist())
    return lo + (hi - lo) * np.array(least), float(y.min())
