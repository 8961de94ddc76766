"""Distances as columns, and the scores that clusters are judged by."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(x1, y1, x2, y2) -> Column:
    dx, dy = F.col(x1) - F.col(x2), F.col(y1) - F.col(y2)
    return dx * dx + dy * dy


def lowbit(c: int) -> int:
    return c & -c


def binomial(n: int, k: int) -> int:
    return math.comb(n, k) if 0 <= k <= n else 0


def frechet_expression(xs1: str, ys1: str, xs2: str, ys2: str) -> str:
    """SQL for the squared discrete Fréchet distance of two packed curves: a fold over the first curve that carries one row of the coupling table."""
    d = f"(p.x - {xs2}[j]) * (p.x - {xs2}[j]) + (p.y - {ys2}[j]) * (p.y - {ys2}[j])"
    cell = f"greatest({d}, CASE WHEN row IS NULL AND j = 0 THEN 0D WHEN row IS NULL THEN element_at(a, -1) WHEN j = 0 THEN row[0] ELSE least(row[j], row[j - 1], element_at(a, -1)) END)"
    fold = f"aggregate(sequence(0, size({xs2}) - 1), cast(array() AS array<double>), (a, j) -> concat(a, array({cell})))"
    return f"element_at(aggregate(arrays_zip({xs1}, {ys1}), cast(null AS array<double>), (row, q) -> transform(array(named_struct('x', q.{xs1}, 'y', q.{ys1})), p -> {fold})[0]), -1)"


def frechet(a: np.ndarray, b: np.ndarray) -> float:
    """Squared discrete Fréchet distance, one diagonal of the table at a time; three diagonals are held."""
    n, m = len(a), len(b)
    before = last = np.full(n + 1, np.inf)  # by point of a, one place on
    for s in range(n + m - 1):
        i = np.arange(max(0, s - m + 1), min(n - 1, s) + 1)
        d = ((a[i] - b[s - i]) ** 2).sum(1)
        new = np.full(n + 1, np.inf)
        new[i + 1] = d if s == 0 else np.maximum(d, np.minimum(np.minimum(last[i + 1], last[i]), before[i]))
        before, last = last, new
    return float(last[n])


def frechet_many(a: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """:func:`frechet` of a curve and each of others, those of like length side by side."""
    out, sizes, n = np.zeros(len(others)), np.array([len(b) for b in others], np.int64), len(a)
    order = np.argsort(sizes, kind="stable")
    each = max(1, 200_000 // max(1, n))
    for at in (order[k : k + each] for k in range(0, len(order), each)):
        m = int(sizes[at[-1]])
        b = np.zeros((len(at), m, 2))
        for k, i in enumerate(at.tolist()):
            b[k, : sizes[i]] = others[i]
        before = last = np.full((len(at), n + 1), np.inf)
        for s in range(n + m - 1):
            i = np.arange(max(0, s - m + 1), min(n - 1, s) + 1)
            d = (a[i, 0] - b[:, s - i, 0]) ** 2 + (a[i, 1] - b[:, s - i, 1]) ** 2
            new = np.full((len(at), n + 1), np.inf)
            new[:, i + 1] = d if s == 0 else np.maximum(d, np.minimum(np.minimum(last[:, i + 1], last[:, i]), before[:, i]))
            before, last = last, new
            done = sizes[at] == s - n + 2
            out[at[done]] = new[done, n]
    return out


def coverage_per_cost(covered: np.ndarray, cost: float) -> float:
    """Largest g with sum(max(0, covered - g * cost)) > g; -1 without a cost."""
    if cost == 0:
        return -1.0
    # the sum over the k largest is k * cost * g below their sum, so g is their sum by 1 + k * cost for the best k
    most = np.sort(covered)[::-1]
    return float(max(0.0, (np.cumsum(most) / (1 + np.arange(1, len(most) + 1) * cost)).max(initial=0.0)))


def gamma(covered: np.ndarray, distances: np.ndarray, total: int, c1: float, c2: float) -> float:
    """Largest g with sum(max(0, covered / total - g * c2 * distance)) >= g * c1."""
    return _largest(lambda g: np.maximum(0, covered / total - g * c2 * distances).sum() >= g * c1)


def _largest(holds) -> float:
    low, high = 0.0, 1.0
    for _ in range(60):
        if not holds(high):
            break
        low, high = high, 2 * high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low
