import numpy as np
import pytest

from millrace.models import krylov


def systems(seed=0, n=7, d=9):
    rng = np.random.default_rng(seed)
    y = rng.normal(size=(n, 12, d)) * rng.uniform(0.3, 2, size=d)
    return np.einsum("nki,nkj->nij", y, y) + 0.3 * np.eye(d), rng.normal(size=(n, d)), rng.normal(size=(n, d)) * 0.1


def krylov_space(op, r, k):
    vs = [r]
    for _ in range(k - 1):
        vs.append(op @ vs[-1])
    return np.linalg.qr(np.stack(vs, 1))[0]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_least_residual_and_least_error(k):
    """CG has the least error in the norm of A, GMRES and MINRES the least (scaled) residual, over the same directions."""
    a, b, x0 = systems()
    got = {"cg": krylov.cg(a, b, x0, k, 0.0), "plain": krylov.cg(a, b, x0, k, 0.0, None), "gmres": krylov.gmres(a, b, x0, k, 0.0), "minres": krylov.minres(a, b, x0, k, 0.0)}
    for n in range(len(b)):
        start = x0[n] if b[n] @ b[n] >= np.sum((b[n] - a[n] @ x0[n]) ** 2) else np.zeros_like(b[n])
        m, r = np.diag(1 / np.diag(a[n])), b[n] - a[n] @ start
        scaled, plain = krylov_space(m @ a[n], m @ r, k), krylov_space(a[n], r, k)
        for name, v in (("cg", scaled), ("plain", plain)):
            want = start + v @ np.linalg.solve(v.T @ a[n] @ v, v.T @ r)
            assert np.allclose(got[name][n], want, atol=1e-8), name
        want = start + scaled @ np.linalg.lstsq(m @ a[n] @ scaled, m @ r, rcond=None)[0]
        assert np.allclose(got["gmres"][n], want, atol=1e-8)
        want = start + plain @ np.linalg.lstsq(a[n] @ plain, r, rcond=None)[0]
        assert np.allclose(got["minres"][n], want, atol=1e-8)


def textbook_bicgstab(a, b, x, k):
    if b @ b < np.sum((b - a @ x) ** 2):
        x = np.zeros_like(x)
    r = b - a @ x
    hat, rho, alpha, omega, v, p, m = r.copy(), 1.0, 1.0, 1.0, 0 * r, 0 * r, 1 / np.diag(a)
    for _ in range(k):
        new = hat @ r
        p = r + new / rho * alpha / omega * (p - omega * v)
        v = a @ (m * p)
        rho, alpha = new, new / (hat @ v)
        s = r - alpha * v
        t = a @ (m * s)
        omega = (t @ s) / (t @ t)
        x = x + alpha * m * p + omega * m * s
        r = s - omega * t
    return x


@pytest.mark.parametrize("k", [1, 2, 3])
def test_bicgstab(k):
    a, b, x0 = systems(1)
    got = krylov.bicgstab(a, b, x0, k, 0.0)
    assert all(np.allclose(got[n], textbook_bicgstab(a[n], b[n], x0[n], k)) for n in range(len(b)))


@pytest.mark.parametrize("method", [krylov.cg, krylov.bicgstab, krylov.gmres, krylov.minres])
def test_all_come_to_rest(method, monkeypatch):
    monkeypatch.setattr(krylov, "RESTART", 5)
    a, b, x0 = systems(2)
    b[0] = 0.0
    a[1] = np.eye(9)
    x = method(a, b, x0, 400, 1e-12)
    assert np.allclose(x, np.linalg.solve(a, b[..., None])[..., 0], atol=1e-7)
    assert np.allclose(method(a, b, x, 50, 1e-6), x)
