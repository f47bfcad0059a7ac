"""Small dense algebra for filters and controllers: Riccati equations, discretisation, horizons."""

from __future__ import annotations

import math

import numpy as np


def riccati(a: np.ndarray, b: np.ndarray, q: np.ndarray, r: np.ndarray, steps: int = 100, tolerance: float = 1e-15) -> np.ndarray:
    """The stabilising solution of X = A'XA - A'XB (R + B'XB)^-1 B'XA + Q, by structure-preserving doubling."""
    a, q = np.array(a, float), np.array(q, float)
    g, h, one = b @ np.linalg.solve(np.atleast_2d(r), b.T), q, np.eye(len(q))
    for _ in range(steps):
        w = np.linalg.solve(one + g @ h, np.hstack((a, g)))
        wa, wg = w[:, : len(a)], w[:, len(a) :]
        g, h, a, last = g + a @ wg @ a.T, h + a.T @ h @ wa, a @ wa, h
        g, h = (g + g.T) / 2, (h + h.T) / 2
        if np.abs(h - last).max() <= tolerance * max(1.0, np.abs(h).max()):
            break
    return h


def regulator(a, b, q, r) -> np.ndarray:
    """Gain K of u = -K x."""
    p = riccati(a, b, q, r)
    return np.linalg.solve(r + b.T @ p @ b, b.T @ p @ a)


def observer(a, c, q, r) -> np.ndarray:
    """Steady gain of a Kalman filter on the prediction error."""
    p = riccati(a.T, c.T, q, r)
    return np.linalg.solve((c @ p @ c.T + r).T, (p @ c.T).T).T


def discretised(a: np.ndarray, b: np.ndarray, dt: float) -> tuple[np.ndarray, np.ndarray]:
    """Bilinear transform."""
    left = np.eye(len(a)) - 0.5 * dt * a
    return np.linalg.solve(left, np.eye(len(a)) + 0.5 * dt * a), np.linalg.solve(left, dt * b)


def with_integrator(a: np.ndarray, b: np.ndarray, outputs: int) -> tuple[np.ndarray, np.ndarray]:
    """The system with running sums of its first ``outputs`` states as more states."""
    n = len(a)
    pick = np.eye(n)[:outputs]
    return np.block([[a, np.zeros((n, outputs))], [pick, np.eye(outputs)]]), np.vstack((b, np.zeros((outputs, b.shape[1]))))


def horizon(a: np.ndarray, b: np.ndarray, predict: int, control: int) -> tuple[np.ndarray, np.ndarray]:
    """(free, forced): stacked states = free x + forced inputs."""
    powers = [np.linalg.matrix_power(a, k) for k in range(predict + 1)]
    forced = [[powers[i - j] @ b if i >= j else np.zeros_like(b) for j in range(control)] for i in range(predict)]
    return np.vstack(powers[1:]), np.block(forced)


def poles(a: np.ndarray, b: np.ndarray | None = None, k: np.ndarray | None = None) -> np.ndarray:
    """Eigenvalues of the open loop, or closed by u = -k x."""
    return np.linalg.eigvals(a if k is None else a - b @ k)


def time_constants(a: np.ndarray) -> tuple[float, float]:
    """Smallest and largest time constant, 1 / |real part| of the poles; poles with a real part of 0 have none."""
    real = np.abs(np.linalg.eigvals(np.asarray(a, float)).real)
    tau = 1 / real[real > 1e-10]
    return (float(tau.min()), float(tau.max())) if len(tau) else (math.inf, 0.0)


def chi2_quantile(p: float, freedom: int) -> float:
    """By bisection on the regularised incomplete gamma function."""
    def cdf(x: float) -> float:
        s, z = freedom / 2, x / 2
        if z <= 0:
            return 0.0
        term = total = 1 / s
        n = s
        while term > total * 1e-16:
            n += 1
            term *= z / n
            total += term
        return total * math.exp(-z + s * math.log(z) - math.lgamma(s))

    low, high = 0.0, max(10.0, 10.0 * freedom)
    while cdf(high) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2
