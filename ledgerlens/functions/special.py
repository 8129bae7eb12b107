"""Special functions over NumPy arrays, used inside Arrow batches where Spark SQL has no counterpart."""

from __future__ import annotations

import numpy as np

# Coefficients of the Stirling series of the log-gamma function.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
_HALF_LOG_TWO_PI = 0.5 * np.log(2 * np.pi)


def log_gamma(x):
    """ln Γ(x) for x > 0: shifted above 10 by the recurrence, then Stirling's series."""
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(10):
        small = y < 10.0
        shift = np.where(small, shift + np.log(np.where(small, y, 1.0)), shift)
        y = np.where(small, y + 1.0, y)
    inverse = 1.0 / y
    square = inverse * inverse
    series = np.zeros_like(y)
    for c in reversed(_STIRLING):
        series = series * square + c
    return (y - 0.5) * np.log(y) - y + _HALF_LOG_TWO_PI + series * inverse - shift


def hypergeometric_2f1(a, b, c, z, tolerance=1e-13, limit=5_000_000):
    """Gauss series of 2F1 for 0 <= z < 1, summed until what is left of it is negligible; raises if it never is."""
    a, b, c, z = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, c, z)))
    if ((z < 0) | (z >= 1)).any():
        raise ValueError("the series needs 0 <= z < 1")
    total = np.ones(z.shape)
    live = np.arange(z.size)
    a, b, c, z, flat = a.ravel(), b.ravel(), c.ravel(), z.ravel(), total.ravel()
    term = np.ones(len(live))
    for j in range(limit):
        term = term * (a[live] + j) * (b[live] + j) / ((c[live] + j) * (j + 1)) * z[live]
        flat[live] += term
        # What is left is at most a geometric series of the current ratio once the ratio falls towards z.
        ratio = np.abs((a[live] + j + 1) * (b[live] + j + 1) / ((c[live] + j + 1) * (j + 2)) * z[live])
        rest = np.abs(term) * np.maximum(ratio, z[live]) / np.maximum(1 - np.maximum(ratio, z[live]), 1e-300)
        open_ = (ratio >= 1) | (rest > tolerance * np.abs(flat[live]))
        if not open_.all():
            live, term = live[open_], term[open_]
        if not len(live):
            return flat.reshape(total.shape)
    raise ArithmeticError(f"2F1 did not converge within {limit} terms")
