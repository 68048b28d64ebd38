"""Small dense solves: what the driver and single tasks do with second moments.

Sizes are the number of channels or modes, never the number of samples.
"""

from __future__ import annotations

import numpy as np


def forward_backward(xy: np.ndarray, yy: np.ndarray, yx: np.ndarray, xx: np.ndarray) -> tuple[np.ndarray, float]:
    """The one-step operator Re((Af Ab^-1)^(1/2)), and the share of the root that was imaginary."""
    forward, backward = xy @ np.linalg.pinv(yy), yx @ np.linalg.pinv(xx)
    values, vectors = np.linalg.eig(forward @ np.linalg.pinv(backward))
    root = vectors @ np.diag(np.sqrt(values.astype(complex))) @ np.linalg.pinv(vectors)
    return root.real, float(np.linalg.norm(root.imag) / max(np.linalg.norm(root.real), 1e-300))


#: Eigenvalues below this share of the largest are rounding noise, of random phase.
NOISE_SHARE = 1e-10


def is_noise(values: np.ndarray) -> np.ndarray:
    """Which eigenvalues are zero but for rounding.

    The operator is the real part of a matrix root. Where the matrix has a negative real
    eigenvalue, the root's is imaginary, and its real part leaves a zero: it is computed
    as some 1e-14 of random phase, which would come and go with the order of sums.
    """
    return np.abs(values) <= NOISE_SHARE * np.abs(values).max(initial=0)


def modes(operator: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, values) with low <= |phase| <= high, by modulus then phase, both descending; noise is left out.

    Moduli are compared to 12 digits, so that a mode stands before its conjugate.
    Vectors have length 1 and a real, positive largest entry.
    """
    values, vectors = np.linalg.eig(operator)
    phase = np.angle(values)
    kept = np.flatnonzero((np.abs(phase) >= low) & (np.abs(phase) <= high) & ~is_noise(values))
    order = kept[np.lexsort((-phase[kept], -np.round(np.abs(values[kept]), 12)))]
    out = vectors[:, order]
    if out.size:
        top = out[np.abs(out).argmax(0), np.arange(out.shape[1])]
        out = out / np.linalg.norm(out, axis=0) * np.conj(top / np.abs(top))
    return out, values[order]


def refit(u: np.ndarray, yy: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Coefficients d of Re(d0 R + U diag(d1..) V), V = pinv(U), R = I - U V, that fit x to y best, from second moments."""
    v = np.linalg.pinv(u)
    r = np.eye(len(yy)) - u @ v
    k = u.shape[1]
    z, w = np.zeros((k + 1, k + 1), complex), np.zeros(k + 1, complex)
    z[0, 0] = np.trace(r @ yy @ r.conj().T)
    z[1:, 1:] = (u.conj().T @ u) * np.conj(v @ yy @ v.conj().T)
    w[0] = np.sum(np.conj(r) * xy)
    w[1:] = np.einsum("ik,ij,kj->k", u.conj(), xy, v.conj())
    return np.linalg.pinv(z) @ w


def spline_matrix(t: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The matrix that takes samples at t to the not-a-knot cubic spline through them at `at`."""
    n, h = len(t), np.diff(t)
    a, b = np.zeros((n, n)), np.zeros((n, n))
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i, i - 1 : i + 2] = 6 / h[i - 1], -6 / h[i - 1] - 6 / h[i], 6 / h[i]
    a[0, :3], a[-1, -3:] = (h[1], -(h[0] + h[1]), h[0]), (h[-1], -(h[-2] + h[-1]), h[-2])
    bend = np.linalg.solve(a, b)
    i = np.clip(np.searchsorted(t, at, "right") - 1, 0, n - 2)
    s, w, rows = at - t[i], h[i], np.arange(len(at))
    out = np.zeros((len(at), n))
    out[rows, i] += 1 - s / w
    out[rows, i + 1] += s / w
    return out + ((s**3 / (6 * w) - s * w / 6) + 0)[:, None] * bend[i + 1] + (-(s**3) / (6 * w) + s**2 / 2 - s * w / 3)[:, None] * bend[i]


def spline(step: float, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The not-a-knot cubic spline through y at step, 2 step, ..., evaluated at `at`; four samples or more.

    On an even grid the end conditions give the second derivatives next to the ends at
    once, and those between follow from one pass down and one up.
    """
    n = len(y)
    bend = np.zeros(n)
    d = (y[2:] - 2 * y[1:-1] + y[:-2]) / (step * step)
    bend[1], bend[n - 2] = d[0], d[-1]
    if n > 4:
        right = 6 * d[1:-1]
        right[0] -= bend[1]
        right[-1] -= bend[n - 2]
        c, g = np.empty(len(right)), np.empty(len(right))
        c[0], g[0] = 1 / 4, right[0] / 4
        for i in range(1, len(right)):
            c[i] = 1 / (4 - c[i - 1])
            g[i] = (right[i] - g[i - 1]) * c[i]
        for i in range(len(right) - 2, -1, -1):
            g[i] -= c[i] * g[i + 1]
        bend[2 : n - 2] = g
    bend[0], bend[-1] = 2 * bend[1] - bend[2], 2 * bend[n - 2] - bend[n - 3]
    i = np.clip(np.floor(at / step - 1).astype(int), 0, n - 2)
    u = at - step * (i + 1)
    slope = (y[i + 1] - y[i]) / step - step * (2 * bend[i] + bend[i + 1]) / 6
    return y[i] + u * (slope + u * (bend[i] / 2 + u * (bend[i + 1] - bend[i]) / (6 * step)))


def band_pass(x: np.ndarray, rate: float, low: float, high: float) -> np.ndarray:
    """Rows without what lies outside low..high Hz: zero phase, in the Fourier domain, mirrored at both ends, raised-cosine edges."""
    n = x.shape[-1]
    wide = np.concatenate([x[..., ::-1], x, x[..., ::-1]], axis=-1)
    f = np.fft.rfftfreq(wide.shape[-1], 1 / rate)
    edge = max(low, rate / wide.shape[-1]) * 0.25
    up = np.clip((f - (low - edge)) / (2 * edge), 0, 1) if low > 0 else np.ones_like(f)
    down = np.clip(((high + edge) - f) / (2 * edge), 0, 1) if high < rate / 2 else np.ones_like(f)
    gain = (0.5 - 0.5 * np.cos(np.pi * up)) * (0.5 - 0.5 * np.cos(np.pi * down))
    return np.fft.irfft(np.fft.rfft(wide, axis=-1) * gain, n=wide.shape[-1], axis=-1)[..., n : 2 * n]


def hrf(step: float, seconds: float = 32.0) -> np.ndarray:
    """Double-gamma response: shapes 6 and 16, undershoot 1/6, normalised to sum 1."""
    from math import gamma

    t = np.arange(0, seconds + step / 2, step)
    out = t**5 * np.exp(-t) / gamma(6) - t**15 * np.exp(-t) / gamma(16) / 6
    return out / out.sum()


def lasso_rows(gram: np.ndarray, moments: np.ndarray, weight: float, start: np.ndarray | None = None, rounds: int = 20_000) -> np.ndarray:
    """Coordinate descent for 1/2 b'Gb - b'c + weight |b| for every row c of moments at once, G and c being means of products.

    start: where to begin, such as the solution for a larger weight. Raises where `rounds`
    are not enough.
    """
    b = np.zeros_like(moments) if start is None else start.copy()
    used = np.flatnonzero(np.diag(gram) > 0)
    for _ in range(rounds):
        moved = 0.0
        for j in used:
            c = moments[:, j] - b @ gram[:, j] + gram[j, j] * b[:, j]
            new = np.sign(c) * np.maximum(np.abs(c) - weight, 0) / gram[j, j]
            moved = max(moved, np.abs(new - b[:, j]).max(initial=0))
            b[:, j] = new
        if moved <= 1e-10 * max(1.0, np.abs(b).max(initial=0)):
            return b
    raise RuntimeError(f"the weights still move by {moved} after {rounds} rounds")


def lasso(gram: np.ndarray, moment: np.ndarray, weight: float) -> np.ndarray:
    """lasso_rows of one row."""
    return lasso_rows(gram, moment[None], weight)[0]


def assignment(cost: np.ndarray) -> np.ndarray:
    """For each row of a square matrix its column, each column once, at the least total cost: shortest augmenting paths."""
    n = len(cost)
    u, v, row_of = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, -1)
    for i in range(n):
        row_of[n], at = i, n
        least, before, seen = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while row_of[at] >= 0:
            seen[at] = True
            r = row_of[at]
            open_ = ~seen[:n]
            slack = cost[r] - u[r] - v[:n]
            closer = open_ & (slack < least)
            least[closer], before[closer] = slack[closer], at
            nxt = int(np.where(open_, least, np.inf).argmin())
            step = least[nxt]
            u[row_of[seen]] += step
            v[seen] -= step
            least[open_] -= step
            at = nxt
        while at != n:
            row_of[at] = row_of[before[at]]
            at = before[at]
        row_of[n] = -1
    out = np.empty(n, int)
    out[row_of[:n]] = np.arange(n)
    return out


def matched_modes(folds: dict[int, np.ndarray], first: np.ndarray) -> dict[int, np.ndarray]:
    """For each fold the places of its modes in the order of `first`: clusters of magnitudes that each fold hits once.

    folds and first: channels by modes, as many in each. Centres begin as the magnitudes
    of `first`, every fold is dealt to them at the least squared distance, and centres
    become the means of what they were dealt, until that no longer changes.
    """
    size = {f: np.abs(v) for f, v in folds.items()}
    centres, own = np.abs(first), np.abs(first)
    places: dict[int, np.ndarray] = {}
    for _ in range(100):
        new = {f: assignment(((centres[:, :, None] - v[:, None, :]) ** 2).sum(0)) for f, v in size.items()}
        if places and all((new[f] == places[f]).all() for f in new):
            break
        places = new
        centres = np.mean([own, *(v[:, places[f]] for f, v in size.items())], 0)
    return places


def modularity(weights: np.ndarray, communities: np.ndarray) -> float:
    k, total = weights.sum(1), weights.sum()
    same = communities[:, None] == communities[None]
    return float(((weights - np.outer(k, k) / total) * same).sum() / total) if total else 0.0


def tuned_split(inner: np.ndarray, s: np.ndarray) -> np.ndarray:
    """A split (1 or -1 for each node) after every node has changed sides once, the best next one first, and the best of all splits on the way."""
    s, best, open_ = s.copy(), s.copy(), np.ones(len(s), bool)
    own, toward = np.diag(inner), inner @ s
    gained = most = 0.0
    while open_.any():
        gain = np.where(open_, -4 * s * (toward - own * s), -np.inf)
        i = int(gain.argmax())
        gained += gain[i]
        s[i] = -s[i]
        toward = toward + 2 * s[i] * inner[:, i]
        open_[i] = False
        if gained > most + 1e-10:
            most, best = gained, s.copy()
    return best


def leading_communities(weights: np.ndarray, tune: bool = True) -> np.ndarray:
    """Community numbers from 1 by Newman's leading eigenvector, splitting while modularity grows; tune: each split is tuned node by node."""
    k, total = weights.sum(1), weights.sum()
    if total == 0:
        return np.ones(len(weights), int)
    b, out, waiting, number = weights - np.outer(k, k) / total, np.zeros(len(weights), int), [np.arange(len(weights))], 0
    while waiting:
        part = waiting.pop()
        inner = b[np.ix_(part, part)]
        inner = inner - np.diag(inner.sum(1))
        inner = (inner + inner.T) / 2
        values, vectors = np.linalg.eigh(inner)
        s = np.where(vectors[:, -1] >= 0, 1.0, -1.0)
        splits = len(part) > 1 and values[-1] > 1e-10
        if splits and tune:
            s = tuned_split(inner, s)
        side = s > 0
        if splits and s @ inner @ s > 1e-10 and 0 < side.sum() < len(part):
            waiting += [part[~side], part[side]]
        else:
            number += 1
            out[part] = number
    return out


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    h = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or 1e-300)
            c = 1 + term / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h


def student_p(t: float, df: float) -> float:
    """Two-sided p of a t value."""
    return float(beta_share(df / (df + t * t), df / 2, 0.5))


def fisher_p(f: float, df1: float, df2: float) -> float:
    """Upper-tail p of an F value."""
    return float(beta_share(df2 / (df2 + df1 * f), df2 / 2, df1 / 2)) if f > 0 else 1.0


def contrast_t(xx: np.ndarray, xy: np.ndarray, yy: float, n: int, c: np.ndarray, d: float = 0.0) -> tuple[float, float, int]:
    """(t, p, df) of c'b = d in a linear model, from its second moments."""
    inverse = np.linalg.pinv(xx)
    b, df = inverse @ xy, n - int(np.linalg.matrix_rank(xx))
    t = (c @ b - d) / np.sqrt(max(yy - b @ xy, 0) / df * (c @ inverse @ c))
    return float(t), student_p(t, df), df


def contrast_f(xx: np.ndarray, xy: np.ndarray, yy: float, n: int, c: np.ndarray) -> tuple[float, float, int, int]:
    """(F, p, df1, df2) of C'b = 0: the model against the one reduced to X (I - C C+), from second moments."""
    keep = np.eye(len(xx)) - c @ np.linalg.pinv(c)
    rss = lambda m: yy - (m.T @ xy) @ np.linalg.pinv(m.T @ xx @ m) @ (m.T @ xy)
    p, p2 = int(np.linalg.matrix_rank(xx)), int(np.linalg.matrix_rank(keep.T @ xx @ keep))
    f = ((rss(keep) - rss(np.eye(len(xx)))) / (p - p2)) / (rss(np.eye(len(xx))) / (n - p))
    return float(f), fisher_p(f, p - p2, n - p), p - p2, n - p


def signed_rank_p(n: int, w: float, z: float | None) -> float | None:
    """Two-sided p of a signed-rank sum: exact for up to 15 ranks without ties, else of z."""
    from math import erfc, sqrt

    if n == 0:
        return 1.0
    if z is None or z != z:
        return None
    centre = n * (n + 1) / 4
    untied = z == 0 or abs((w - centre) / z - sqrt(n * (n + 1) * (2 * n + 1) / 24)) < 1e-9
    if n > 15 or not untied or w != int(w):
        return erfc(abs(z) / sqrt(2))
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for r in range(1, n + 1):
        ways[r:] += ways[:-r].copy()
    return float(min(1.0, 2 * ways[: int(min(w, 2 * centre - w)) + 1].sum() / 2**n))
