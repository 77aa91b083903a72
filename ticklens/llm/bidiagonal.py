"""Singular values and right singular vectors of a small triangular factor, by qd transforms.

Householder reflections bring R to upper bidiagonal form B. The differential quotient-difference
transform with shifts (dqds; Fernando and Parlett, 1994) finds the eigenvalues of B'B from the
squares of its entries without subtractions, so small ones keep their relative accuracy. Twisted
factorisations of B'B - s I (Dhillon and Parlett, 2004), from the differential forms as well, give
each vector by one multiplication per entry; vectors of eigenvalues that nearly coincide are made
orthogonal by inverse iteration with the same factorisation.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
#: eigenvalues closer than this, relative to the larger, are treated as a cluster
CLUSTER = 1e-6


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, v): diagonal and superdiagonal of B = U' R V and the orthogonal V."""
    m = np.array(r, dtype=np.float64)
    d = m.shape[1]
    v = np.eye(d)

    def reflector(x):
        w = x.copy()
        size = np.sqrt((x * x).sum())
        if size == 0:
            return None
        w[0] += size if x[0] >= 0 else -size
        return w / np.sqrt((w * w).sum())

    for k in range(d):
        w = reflector(m[k:, k])
        if w is not None:
            m[k:, k:] -= 2 * np.outer(w, w @ m[k:, k:])
        if k < d - 2:
            w = reflector(m[k, k + 1:])
            if w is not None:
                m[k:, k + 1:] -= 2 * np.outer(m[k:, k + 1:] @ w, w)
                v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ w, w)
    return np.diagonal(m).copy(), np.diagonal(m, 1).copy(), v


def _transformed(q: list[float], e: list[float], shift: float):
    """One dqds step: (q, e, where the first negative or undefined pivot is, its value, least pivot)."""
    new_q, new_e = [], []
    d = q[0] - shift
    least = d
    for i in range(len(e)):
        if not d >= 0:
            return None, None, i, d, least
        total = d + e[i]
        ratio = q[i + 1] / total if total > 0 else 0.0
        new_q.append(total)
        new_e.append(e[i] * ratio)
        d = d * ratio - shift if total > 0 else q[i + 1] - shift
        least = min(least, d)
    if not d >= 0:
        return None, None, len(e), d, least
    return new_q + [d], new_e, -1, d, least


def _two(q: list[float], e: list[float]) -> tuple[float, float]:
    """Eigenvalues of B'B for a 2 x 2 block, larger first."""
    total = q[0] + q[1] + e[0]
    if total == 0:
        return 0.0, 0.0
    root = np.sqrt((q[0] - q[1] + e[0]) ** 2 + 4 * q[1] * e[0])
    large = (total + root) / 2
    return large, q[0] * (q[1] / large)


def dqds(q, e) -> np.ndarray:
    """Eigenvalues of B'B, falling, from the squared diagonal ``q`` and superdiagonal ``e`` of B."""
    found: list[float] = []
    waiting = [(0.0, [float(x) for x in q], [float(x) for x in e])]
    while waiting:
        base, q, e = waiting.pop()
        least = 0.0
        while q:
            n = len(q)
            if n == 1:
                found.append(base + q[0])
                break
            if n == 2:
                found += [base + x for x in _two(q, e)]
                break
            small = next((i for i in range(n - 1) if e[i] <= EPS * EPS * (base + q[i]) or e[i] <= EPS * EPS * q[i + 1]), None)
            if small is not None:
                waiting.append((base, q[:small + 1], e[:small]))
                q, e = q[small + 1:], e[small + 1:]
                least = 0.0
                continue
            if q[0] < q[-1]:           # the smallest belongs at the end: B' of the reversed order
                q, e = _flipped(q, e)
            shift = min(least, _two(q[-2:], e[-1:])[1]) if least > 0 else 0.0
            while True:
                new_q, new_e, at, value, least_now = _transformed(q, e, shift)
                if new_q is not None:
                    break
                better = shift + value if at == n - 1 and value > -shift else shift / 4
                shift = better if 0 < better < shift and better > EPS * shift else 0.0
            q, e, base, least = new_q, new_e, base + shift, max(least_now, 0.0)
    return np.sort(np.array(found))[::-1]


def _flipped(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """qd numbers of the block in reversed order, which has the same eigenvalues."""
    return q[::-1], e[::-1]


class Twisted:
    """Twisted factorisation of B'B - s I, with the twist where its pivot is smallest."""

    def __init__(self, a: np.ndarray, b: np.ndarray, s: float):
        n, tiny = len(a), np.finfo(np.float64).tiny ** 0.5
        a = np.where(np.abs(a) < tiny, tiny, a)
        square, low = a * a, np.append(b / a[:-1], 0.0) if n > 1 else np.zeros(1)
        down, up = np.empty(n), np.empty(n)               # pivots from the top and from the bottom
        self.down_l, self.up_l = np.zeros(n), np.zeros(n)
        from_top, from_end = np.empty(n), np.empty(n)
        x = -s
        for i in range(n):
            from_top[i] = x
            down[i] = x + square[i] or -tiny
            if i < n - 1:
                self.down_l[i] = square[i] * low[i] / down[i]
                x = self.down_l[i] * low[i] * x - s
        x = square[n - 1] - s
        for i in range(n - 1, -1, -1):
            from_end[i] = x
            if i:
                x = x or -tiny                            # moved off zero, so that x / up stays defined
                up[i] = square[i - 1] * low[i - 1] ** 2 + x or -tiny
                ratio = square[i - 1] / up[i]
                self.up_l[i - 1] = low[i - 1] * ratio
                x = x * ratio - s
        gamma = from_top + from_end + s
        self.twist = int(np.abs(gamma).argmin())
        self.pivots = np.concatenate((down[:self.twist], gamma[self.twist:self.twist + 1], up[self.twist + 1:]))
        floor = EPS * EPS * max(np.abs(square).max(), tiny)
        self.pivots = np.where(np.abs(self.pivots) < floor, floor, self.pivots)

    def back(self, z: np.ndarray) -> np.ndarray:
        """Solution of N' y = z for the twisted factor N."""
        y = z.copy()
        for i in range(self.twist - 1, -1, -1):
            y[i] -= self.down_l[i] * y[i + 1]
        for i in range(self.twist, len(y) - 1):
            y[i + 1] -= self.up_l[i] * y[i]
        return y

    def vector(self) -> np.ndarray:
        z = np.zeros(len(self.pivots))
        z[self.twist] = 1
        y = self.back(z)
        return y / np.sqrt((y * y).sum())

    def solved(self, x: np.ndarray) -> np.ndarray:
        """Solution of (B'B - s I) y = x."""
        y = x.copy()
        for i in range(self.twist):
            y[i + 1] -= self.down_l[i] * y[i]
        for i in range(len(y) - 1, self.twist, -1):
            y[i - 1] -= self.up_l[i - 1] * y[i]
        return self.back(y / self.pivots)


def right_singular(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(all squared singular values, falling; the first ``count`` right singular vectors as columns)."""
    scale = np.abs(r).max() if r.size else 0.0
    d = r.shape[1]
    if scale == 0:
        return np.zeros(d), np.eye(d)[:, :count]
    a, b, v = bidiagonal(r / scale)
    values = dqds(a * a, b * b)
    random = np.random.default_rng(d)
    chosen: list[np.ndarray] = []
    for k in range(min(count, d)):
        near = [j for j in range(k) if values[j] - values[k] <= max(CLUSTER * values[j], d * EPS * EPS * values[0])]
        factor = Twisted(a, b, values[k])
        z = factor.vector()
        for _ in range(4 if near else 0):
            for j in near:
                z = z - (chosen[j] @ z) * chosen[j]
            size = np.sqrt((z * z).sum())
            z = factor.solved(z / size if size > 0.1 else random.standard_normal(d))
            for j in near:
                z = z - (chosen[j] @ z) * chosen[j]
            z = z / np.sqrt((z * z).sum())
        chosen.append(z)
    vectors = v @ np.stack(chosen, axis=1) if chosen else np.zeros((d, 0))
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values * scale * scale, vectors * np.where(sign == 0, 1, sign)
