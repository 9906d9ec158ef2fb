"""Exact inner products of integer rows, whatever their size."""

from __future__ import annotations

import numpy as np

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _longest(rows: np.ndarray) -> float:
    x = rows.astype(np.float64)
    top = np.abs(x).max(initial=0.0)
    return float(top * np.sqrt(((x / top) ** 2).sum(axis=1).max(initial=0.0))) if top else 0.0


def fits_double(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether all products of rows, and all their partial sums, are whole numbers that a double holds."""
    return _longest(a) * _longest(b) < 2.0 ** 52


def fits_long(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether all products of rows, and all their partial sums, are longs."""
    return _longest(a) * _longest(b) < 2.0 ** 62


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All products of the rows of ``a`` and ``b`` (long): as doubles or longs where these are exact, else Python integers.

    By Cauchy and Schwarz no partial sum exceeds the product of the two lengths.
    """
    most = _longest(a) * _longest(b)
    if most < 2.0 ** 52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2.0 ** 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return a.astype(object) @ b.astype(object).T


def clamped(score: int | float) -> int:
    """A product as a long; beyond its limits, the limit."""
    return max(LEAST, min(MOST, int(score)))
