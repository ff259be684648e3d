"""Eigenvectors of a symmetric matrix: float32 ones, corrected by matrix multiplications in higher precision (Ogita and Aishima)."""

from __future__ import annotations

import numpy as np


def _step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One correction: the new vectors, the eigenvalues, and the gap below which eigenvalues can't be told apart yet."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ a @ x
    r, s = (r + r.T) / 2, (s + s.T) / 2
    e = np.diag(s) / (1 - np.diag(r))
    size = np.abs(a).sum(1).max()
    gap = 2 * (np.linalg.norm((s - np.diag(e)).astype(np.float64)) + float(size) * np.linalg.norm(r.astype(np.float64)))
    gap = max(gap, 1000 * len(a) * float(np.finfo(a.dtype).eps) * float(size))  # nearer values differ by rounding only
    apart = e[None, :] - e[:, None]
    close = np.abs(apart) <= gap
    correction = np.where(close, r / 2, (s + e[None, :] * r) / np.where(close, 1, apart))
    return x + x @ correction, e, gap


def _clusters(e: np.ndarray, gap: float) -> list[np.ndarray]:
    """Runs of two or more neighbours, in falling order, whose distance is ``gap`` or less."""
    order = np.argsort(-e, kind="stable")
    cut = np.flatnonzero(-np.diff(e[order]) > gap) + 1
    return [c for c in np.split(order, cut) if len(c) > 1]


def refined_eigen(a: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues from the largest down, unit eigenvectors as columns) of the symmetric ``a``, to double precision.

    float32 vectors are corrected until the correction is below double precision. Eigenvalues too close to tell
    apart form clusters: the corrections make their space exact, and within it the small matrix of the cluster, shifted by
    its mean value, is solved in double precision, which turns the vectors; then corrections go on. Within
    exactly equal eigenvalues any basis of their space is right.
    """
    d = len(a)
    size = float(np.abs(a).max()) if d else 0.0
    if not size:
        return np.zeros(d), np.eye(d)
    high = (a / size).astype(np.longdouble)
    high = (high + high.T) / 2
    x = np.linalg.eigh(high.astype(np.float32))[1].astype(np.longdouble)
    small = np.finfo(np.float64).eps / 4
    turned, last = False, np.inf
    for _ in range(rounds):
        new, e, gap = _step(high, x)
        moved = float(np.abs(new - x).max())
        x = new
        if turned:
            if moved < small or moved >= last / 4:  # the rest is rounding
                break
            last = moved
            continue
        if moved > 1e-3:
            continue
        turned = moved < 1e-9  # the clusters' spaces are exact from here on, and corrections alone go on
        for c in _clusters(e, max(gap, 1e-6)):
            # orthonormal within the cluster, then the shifted sub-problem
            y = x[:, c]
            y = y @ (1.5 * np.eye(len(c), dtype=y.dtype) - 0.5 * (y.T @ y))
            t = y.T @ (high @ y - e[c].mean() * y)
            t = ((t + t.T) / 2).astype(np.float64)
            if np.abs(t - np.diag(np.diag(t))).max() > 0:
                x[:, c] = y @ np.linalg.eigh(t)[1].astype(np.longdouble)
    x = x / np.sqrt((x * x).sum(0))
    e = (x * (high @ x)).sum(0)
    order = np.argsort(-e, kind="stable")
    return (e[order] * size).astype(np.float64), x[:, order].astype(np.float64)
