"""Leading eigenvectors of a symmetric matrix (used by operator 13).

Householder reflections make the matrix tridiagonal; counts of negative terms in
its Sturm sequence bracket the leading eigenvalues by bisection; inverse iteration
finds a vector for each, kept orthogonal to earlier ones of its cluster; the
reflections are then undone.
"""

from __future__ import annotations

import numpy as np

_EPS = float(np.finfo(float).eps)
#: Eigenvalues nearer than this part of the norm form a cluster.
CLUSTER = 1e-3
ITERATIONS = 8


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the reflectors: entry k acts on the rows after k."""
    a = np.array(matrix, float)
    n, reflectors = len(a), []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length > 0:
            v[0] += np.copysign(length, v[0])
            v /= np.linalg.norm(v)
            block = a[k + 1 :, k + 1 :]
            p = block @ v
            w = p - (v @ p) * v
            block -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        reflectors.append(v)
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy(), reflectors


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues are less than each value: negative terms of the Sturm sequence."""
    tiny = _EPS * (np.abs(off).max(initial=0) + np.abs(diagonal).max(initial=0)) + np.finfo(float).tiny
    q = diagonal[0] - at
    found = (q < 0).astype(int)
    for d, e2 in zip(diagonal[1:], off * off):
        q = d - at - e2 / np.where(np.abs(q) < tiny, -tiny, q)
        found += q < 0
    return found


def leading_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling, bisected until halves don't differ."""
    n = len(diagonal)
    reach = np.append(np.abs(off), 0) + np.append(0, np.abs(off))
    low, high = np.full(count, (diagonal - reach).min()), np.full(count, (diagonal + reach).max())
    high += _EPS * np.abs(high) + np.finfo(float).tiny
    want = n - np.arange(count)  # so many eigenvalues are at most the j-th largest
    for _ in range(200):
        middle = low + (high - low) / 2
        if ((middle == low) | (middle == high)).all():
            break
        enough = below(diagonal, off, middle) >= want
        low, high = np.where(enough, low, middle), np.where(enough, middle, high)
    return low + (high - low) / 2


def _factors(diagonal: np.ndarray, off: np.ndarray, value: float, tiny: float) -> list[tuple[float, float, float, float, bool]]:
    """Elimination with row swaps of the shifted matrix: (pivot, next, next but one, factor, swapped) of each row."""
    n, rows = len(diagonal), []
    a, b = diagonal[0] - value, off[0] if n > 1 else 0.0
    for k in range(n - 1):
        low, mid, right = off[k], diagonal[k + 1] - value, off[k + 1] if k + 2 < n else 0.0
        if abs(low) > abs(a):
            factor = a / low
            rows.append((low, mid, right, factor, True))
            a, b = b - factor * mid, -factor * right
        else:
            a = a if abs(a) > tiny else tiny
            factor = low / a
            rows.append((a, b, 0.0, factor, False))
            a, b = mid - factor * b, right
    rows.append((a if abs(a) > tiny else tiny, 0.0, 0.0, 0.0, False))
    return rows


def _solve(rows: list[tuple[float, float, float, float, bool]], right: np.ndarray) -> np.ndarray:
    y = right.tolist()
    for k, (_, _, _, factor, swapped) in enumerate(rows[:-1]):
        if swapped:
            y[k], y[k + 1] = y[k + 1], y[k]
        y[k + 1] -= factor * y[k]
    y += [0.0, 0.0]
    for k in range(len(rows) - 1, -1, -1):
        pivot, one, two, _, _ = rows[k]
        y[k] = (y[k] - one * y[k + 1] - two * y[k + 2]) / pivot
    return np.array(y[:-2])


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and unit eigenvectors as columns."""
    scale = np.abs(matrix).max(initial=0) or 1.0
    diagonal, off, reflectors = tridiagonal(matrix / scale)
    n = len(diagonal)
    norm = np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0) or 1.0
    tiny = _EPS * norm
    values = leading_values(diagonal, off, count)
    vectors = np.zeros((n, count))
    rng = np.random.default_rng(1)
    for j, value in enumerate(values):
        near = vectors[:, [i for i in range(j) if values[i] - value <= CLUSTER * norm]]
        # equal eigenvalues get shifts of their own
        rows = _factors(diagonal, off, value - near.shape[1] * 2 * tiny, tiny)
        y = rng.uniform(-1, 1, n)
        for _ in range(ITERATIONS):
            for _ in range(2):
                y -= near @ (near.T @ y)
            y = _solve(rows, y / np.linalg.norm(y))
            y /= np.linalg.norm(y)
        for _ in range(2):
            y -= near @ (near.T @ y)
            y /= np.linalg.norm(y)
        vectors[:, j] = y
    for k in range(n - 3, -1, -1):
        v = reflectors[k]
        vectors[k + 1 :] -= 2 * np.outer(v, v @ vectors[k + 1 :])
    vectors /= np.linalg.norm(vectors, axis=0)
    return np.einsum("ij,ik,kj->j", vectors, matrix, vectors), vectors
