"""Numerical helpers against systems whose answers are known."""

import numpy as np
import pytest

from undula.functions import dense


def rotation(angle, size=0.95):
    return size * np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])


def series(operator, n, noise=0.0, seed=0):
    rng, x = np.random.default_rng(seed), np.zeros((len(operator), n))
    x[:, 0] = rng.standard_normal(len(operator))
    for t in range(1, n):
        x[:, t] = operator @ x[:, t - 1] + noise * rng.standard_normal(len(operator))
    return x


def test_modes_of_a_rotation():
    a = np.zeros((4, 4))
    a[:2, :2], a[2:, 2:] = rotation(0.5), rotation(0.3, 0.9)
    x = series(a, 40)
    y, z = x[:, :-1], x[:, 1:]
    operator, _ = dense.forward_backward(z @ y.T, y @ y.T, y @ z.T, z @ z.T)
    vectors, values = dense.modes(operator, 0.1, 1.0)
    assert np.allclose(np.abs(values), [0.95, 0.95, 0.9, 0.9], atol=1e-6)
    assert np.allclose(np.angle(values), [0.5, -0.5, 0.3, -0.3], atol=1e-6)
    assert np.allclose(np.linalg.norm(vectors, axis=0), 1)


def test_refit_equals_the_long_sums():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((6, 300))
    y, z = x[:, :-1], x[:, 1:]
    u = rng.standard_normal((6, 2)) + 1j * rng.standard_normal((6, 2))
    u = np.column_stack([u[:, 0], u[:, 0].conj()])
    v = np.linalg.pinv(u)
    r = np.eye(6) - u @ v
    parts = [r @ y] + [np.outer(u[:, k], v[k] @ y) for k in range(2)]
    z_long = np.array([[np.sum(p.conj() * q) for q in parts] for p in parts])
    w_long = np.array([np.sum(p.conj() * z) for p in parts])
    assert np.allclose(dense.refit(u, y @ y.T, z @ y.T), np.linalg.solve(z_long, w_long))


def test_spline_is_exact_on_cubics():
    t = np.arange(1, 12) * 0.72
    at = np.arange(1, 5) * 1.5
    f = lambda s: 2 - s + 0.5 * s**2 - 0.1 * s**3
    assert np.allclose(dense.spline_matrix(t, at) @ f(t), f(at))


def test_band_pass_keeps_and_removes():
    t = np.arange(1200) * 0.72
    kept, gone = np.sin(2 * np.pi * 0.05 * t), np.sin(2 * np.pi * 0.3 * t)
    out = dense.band_pass((kept + gone + 3)[None], 1 / 0.72, 0.01, 0.1)[0]
    assert np.abs(out - kept)[100:-100].max() < 0.05


def test_lasso_shrinks_to_zero():
    x = np.random.default_rng(0).standard_normal((500, 3))
    y = x @ [2.0, 0.0, -1.0]
    g, c = x.T @ x / 500, x.T @ y / 500
    assert np.allclose(dense.lasso(g, c, 0.0), [2, 0, -1], atol=1e-6)
    b = dense.lasso(g, c, 0.5)
    assert b[1] == 0 and 0 < b[0] < 2


def test_communities_of_two_blocks():
    w = np.kron(np.eye(2), np.ones((4, 4))) + 0.05
    found = dense.leading_communities(w)
    assert len(set(found[:4])) == len(set(found[4:])) == 1 and found[0] != found[4]


@pytest.mark.parametrize("step", [0.024, 0.1])
def test_response_sums_to_one(step):
    assert dense.hrf(step).sum() == pytest.approx(1)


def test_tails_of_distributions():
    assert dense.student_p(2, 10) == pytest.approx(2 * (1 - 0.9633059826), abs=1e-8)
    assert dense.fisher_p(3, 2, 10) == pytest.approx(1 - 0.9046325684, abs=1e-8)


def test_contrasts_equal_the_long_formulas():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(50), rng.standard_normal((50, 2))])
    y = x @ [1.0, 0.5, 0.0] + rng.standard_normal(50)
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    s2, c = ((y - x @ b) ** 2).sum() / 47, np.array([0, 1.0, 0])
    m = (x.T @ x, x.T @ y, y @ y, 50)
    t, p, df = dense.contrast_t(*m, c)
    assert df == 47 and t == pytest.approx(b[1] / np.sqrt(s2 * np.linalg.inv(x.T @ x)[1, 1]))
    f, pf, df1, df2 = dense.contrast_f(*m, c[:, None])
    assert (df1, df2) == (1, 47) and f == pytest.approx(t * t) and pf == pytest.approx(p)


def ring_of_cliques(n, size):
    w = np.zeros((n * size, n * size))
    for c in range(n):
        w[c * size : (c + 1) * size, c * size : (c + 1) * size] = 1
        w[c * size, ((c + 1) % n) * size + 1] = w[((c + 1) % n) * size + 1, c * size] = 1
    np.fill_diagonal(w, 0)
    return w


def test_communities_of_known_graphs():
    rng = np.random.default_rng(0)
    w = ring_of_cliques(6, 5)
    found = dense.leading_communities(w)
    assert len(set(found)) >= 3 and all(len(set(found[5 * c : 5 * c + 5])) == 1 for c in range(6))
    two = (rng.random((30, 30)) < np.where(np.equal.outer(np.arange(30) < 15, np.arange(30) < 15), 0.7, 0.1)).astype(float)
    two = np.triu(two, 1) + np.triu(two, 1).T
    halves = dense.leading_communities(two)
    assert len(set(halves[:15])) == len(set(halves[15:])) == 1 and halves[0] != halves[-1]
    for seed in range(10):
        r = np.random.default_rng(seed)
        noise = np.triu((r.random((40, 40)) < 0.15) * r.random((40, 40)), 1)
        noise = noise + noise.T
        assert dense.modularity(noise, dense.leading_communities(noise)) >= dense.modularity(noise, dense.leading_communities(noise, tune=False)) - 1e-12
    assert (dense.leading_communities(np.zeros((3, 3))) == 1).all()
