"""Krylov methods over stacks of small symmetric systems, all rows of a batch at once.

``a``: (n, d, d), ``b`` and ``x``: (n, d). Each starts from x where that is nearer than zero and takes at most ``iterations`` steps;
systems whose residual is below ``tolerance`` of b rest.
"""

import numpy as np

RESTART = 30


def times(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.einsum("nij,nj->ni", a, x)


def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("nj,nj->n", x, y)


def _ratio(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x / y, 0 where a system has come to rest."""
    return np.divide(x, y, out=np.zeros_like(x), where=np.abs(y) > 1e-300)


def started(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x, or zero where that is nearer, and what is left of b."""
    r = b - times(a, x)
    cold = (dot(b, b) < dot(r, r))[:, None]
    return np.where(cold, 0.0, x), np.where(cold, b, r)


def _scale(a: np.ndarray, kind: str | None) -> np.ndarray:
    """The inverse of what systems are scaled by: their diagonal, or nothing."""
    return 1 / np.einsum("nii->ni", a) if kind == "diagonal" else np.ones(a.shape[:2])


def cg(a: np.ndarray, b: np.ndarray, x: np.ndarray, iterations: int, tolerance: float, scale: str | None = "diagonal") -> np.ndarray:
    m, (x, r) = _scale(a, scale), started(a, b, x)
    z = m * r
    p, rz, least = z, dot(r, z), tolerance**2 * dot(b, b)
    for _ in range(iterations):
        on = dot(r, r) > least
        if not on.any():
            break
        ap = times(a, p)
        step = np.where(on, _ratio(rz, dot(p, ap)), 0.0)[:, None]
        x, r = x + step * p, r - step * ap
        z = m * r
        new = dot(r, z)
        p, rz = z + _ratio(new, rz)[:, None] * p, new
    return x


def bicgstab(a: np.ndarray, b: np.ndarray, x: np.ndarray, iterations: int, tolerance: float, scale: str | None = "diagonal") -> np.ndarray:
    m, (x, r) = _scale(a, scale), started(a, b, x)
    shadow, p, v = r, np.zeros_like(r), np.zeros_like(r)
    rho = alpha = omega = np.ones(len(b))
    least = tolerance**2 * dot(b, b)
    for _ in range(iterations):
        on = dot(r, r) > least
        if not on.any():
            break
        new = dot(shadow, r)
        p = r + (_ratio(new, rho) * _ratio(alpha, omega))[:, None] * (p - omega[:, None] * v)
        y = m * p
        v, rho = times(a, y), new
        alpha = np.where(on, _ratio(rho, dot(shadow, v)), 0.0)
        s = r - alpha[:, None] * v
        z = m * s
        t = times(a, z)
        omega = np.where(on, _ratio(dot(t, s), dot(t, t)), 0.0)
        x = x + alpha[:, None] * y + omega[:, None] * z
        r = s - omega[:, None] * t
    return x


def _least_residual(a: np.ndarray, b: np.ndarray, x: np.ndarray, r: np.ndarray, steps: int, m: np.ndarray, symmetric: bool) -> np.ndarray:
    """x moved to the least residual over ``steps`` powers of the scaled systems; symmetric ones need only the last two directions (Lanczos)."""
    r = m * r
    size = np.sqrt(dot(r, r))
    basis, h = [_ratio(r, np.broadcast_to(size[:, None], r.shape))], np.zeros((len(b), steps + 1, steps))
    for k in range(steps):
        w = m * times(a, basis[k])
        for j in range(max(0, k - 1) if symmetric else 0, k + 1):
            h[:, j, k] = dot(w, basis[j])
            w = w - h[:, j, k, None] * basis[j]
        h[:, k + 1, k] = np.sqrt(dot(w, w))
        alive = h[:, k + 1, k] > 1e-13 * np.abs(h[:, k, k])
        h[~alive, k + 1, k] = 0.0
        basis.append(np.where(alive[:, None], _ratio(w, np.broadcast_to(h[:, k + 1, k, None], w.shape)), 0.0))
    y = np.einsum("nij,nj->ni", np.linalg.pinv(h), size[:, None] * np.eye(1, steps + 1))
    return x + np.einsum("nk,nkd->nd", y, np.stack(basis[:steps], 1))


def gmres(a: np.ndarray, b: np.ndarray, x: np.ndarray, iterations: int, tolerance: float, scale: str | None = "diagonal", symmetric: bool = False) -> np.ndarray:
    """Least residuals by Arnoldi's directions, which start again after RESTART."""
    m, (x, r) = _scale(a, scale), started(a, b, x)
    least, left = tolerance**2 * dot(b, b), iterations
    while left > 0:
        on = np.flatnonzero(dot(r, r) > least)
        if not len(on):
            break
        steps = min(left, RESTART, b.shape[1])
        x[on] = _least_residual(a[on], b[on], x[on], r[on], steps, m[on], symmetric)
        r, left = b - times(a, x), left - steps
    return x


def minres(a: np.ndarray, b: np.ndarray, x: np.ndarray, iterations: int, tolerance: float) -> np.ndarray:
    return gmres(a, b, x, iterations, tolerance, None, True)
