"""Singular values and right singular vectors of a small square matrix by bidiagonal qd iteration.

Householder reflections from both sides make the matrix upper bidiagonal; the dqds iteration finds the squares of its singular values to
high relative accuracy; the twisted factorization of the shifted tridiagonal B'B with the smallest twist element gives each vector.
All of it works on one matrix of dimensions x dimensions and no data rows.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
TINY = np.finfo(float).tiny
CLUSTER = 1e-7  # relative gap below which vectors are made orthogonal to each other explicitly


def reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(v, tau, alpha): (I - tau v v') x = alpha e1."""
    norm = float(np.linalg.norm(x))
    v = x.astype(float).copy()
    if norm == 0.0:
        return v, 0.0, 0.0
    alpha = -norm if v[0] >= 0 else norm
    v[0] -= alpha
    return v, 2.0 / float(v @ v), alpha


def bidiagonalize(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, float]]]:
    """Diagonal, superdiagonal and the right reflectors (first column, v, tau) of an upper bidiagonal form."""
    a = np.array(matrix, float)
    n = len(a)
    diagonal, above, right = np.zeros(n), np.zeros(max(0, n - 1)), []
    for k in range(n):
        v, tau, diagonal[k] = reflector(a[k:, k])
        if tau:
            a[k:, k + 1 :] -= np.outer(tau * v, v @ a[k:, k + 1 :])
        if k < n - 1:
            v, tau, above[k] = reflector(a[k, k + 1 :])
            if tau:
                a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k + 1 :] @ v, tau * v)
            right.append((k + 1, v, tau))
    return diagonal, above, right


def turn_back(vectors: np.ndarray, right: list[tuple[int, np.ndarray, float]]) -> np.ndarray:
    """Right singular vectors of the bidiagonal form (as columns) to those of the matrix."""
    out = vectors.copy()
    for first, v, tau in reversed(right):
        if tau:
            out[first:] -= np.outer(tau * v, v @ out[first:])
    return out


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Squared singular values of an upper bidiagonal with squares q on and e above the diagonal, descending."""
    found: list[float] = []
    work = [(list(q), list(e), 0.0)]
    while work:
        q, e, moved = work.pop()
        rounds = 0
        while len(q) > 1:
            n = len(q)
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= EPS * EPS * (moved + min(q[i], q[i + 1])) or e[i] <= TINY), None)
            if cut is not None:
                rounds = 0
                if cut < n - 2:  # two problems without a link
                    work.append((q[: cut + 1], e[:cut], moved))
                    q, e = q[cut + 1 :], e[cut + 1 :]
                else:
                    found.append(moved + q.pop())
                    e.pop()
                continue
            if q[0] * 1.5 < q[-1]:  # small values go to the end, where they converge
                q.reverse()
                e.reverse()
            shift = _shift(q, e) if rounds % 8 else 0.0
            step = None
            for _ in range(4):
                step, last = _transform(q, e, shift)
                if step is not None or shift == 0.0:
                    break
                shift = max(0.0, shift + last) if last is not None else shift / 4
            if step is None:
                shift = 0.0
                step, _ = _transform(q, e, 0.0)
            q, e = step
            moved += shift
            rounds += 1
            if rounds > 200 * n:
                raise ArithmeticError("the qd iteration did not converge")
        found += [moved + x for x in q]
    return sorted(found, reverse=True)


def _shift(q: list[float], e: list[float]) -> float:
    """The smaller eigenvalue of the trailing 2 x 2 part, a little reduced: it bounds the smallest value from above."""
    a, b, c = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
    half, spread = (a + b) / 2, (a - b) / 2
    top = half + np.hypot(spread, np.sqrt(c))
    low = (a * b - c) / top if top > 0 else 0.0
    return max(0.0, 0.98 * min(float(low), q[-1]))


def _transform(q: list[float], e: list[float], shift: float) -> tuple[tuple[list[float], list[float]] | None, float | None]:
    """One differential qd step. None if the shift was too large; then the last element says by how much if only that failed."""
    n = len(q)
    out_q, out_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    for i in range(n - 1):
        if d < 0.0:
            return None, None
        out_q[i] = max(d + e[i], TINY)
        ratio = q[i + 1] / out_q[i]
        out_e[i] = e[i] * ratio
        d = d * ratio - shift
    if d < 0.0:
        return None, d
    out_q[-1] = d
    return (out_q, out_e), d


def twisted_vector(diagonal: np.ndarray, above: np.ndarray, value: float, turns: int = 3) -> tuple[np.ndarray, float]:
    """The unit vector of B'B for an eigenvalue close to ``value``, and the eigenvalue refined by the Rayleigh correction."""
    n = len(diagonal)
    d = np.maximum(diagonal**2, TINY)
    low = above / np.where(diagonal[:-1] == 0, np.sqrt(TINY), diagonal[:-1])  # B'B = L D L'
    z = np.zeros(n)
    for _ in range(turns):
        s, plus, down = np.zeros(n), np.zeros(n), np.zeros(max(0, n - 1))
        s[0] = -value
        for i in range(n):
            plus[i] = s[i] + d[i] or EPS * TINY**0.5
            if i < n - 1:
                down[i] = d[i] * low[i] / plus[i]
                s[i + 1] = down[i] * low[i] * s[i] - value
        p, up = np.zeros(n), np.zeros(max(0, n - 1))
        p[-1] = d[-1] - value
        for i in range(n - 2, -1, -1):
            minus = d[i] * low[i] ** 2 + p[i + 1] or EPS * TINY**0.5
            ratio = d[i] / minus
            up[i] = low[i] * ratio
            p[i] = p[i + 1] * ratio - value
        twist = s + p + value
        twist[~np.isfinite(twist)] = np.inf
        r = int(np.argmin(np.abs(twist)))
        z[:] = 0.0
        z[r] = 1.0
        for i in range(r - 1, -1, -1):
            z[i] = -down[i] * z[i + 1]
        for i in range(r, n - 1):
            z[i + 1] = -up[i] * z[i]
        size = float(z @ z)
        move = twist[r] / size
        if not np.isfinite(move) or abs(move) <= EPS * abs(value):
            break
        value = max(value + move, 0.0)
    return z / np.linalg.norm(z), value


def _apart(z: np.ndarray, near: list[np.ndarray], block: np.ndarray, value: float, seed: int) -> np.ndarray:
    """A vector of a tight cluster, orthogonal to the ones before: by inverse iteration where the twisted one fell together with them."""
    basis = np.stack(near, axis=1)

    def rest(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - basis @ (basis.T @ v)
        return v

    own = rest(z)
    if np.linalg.norm(own) < 0.5:
        own = rest(np.random.default_rng(seed).standard_normal(len(z)))
        shifted = block - value * (1 + 4 * EPS) * np.eye(len(block)) + TINY * np.eye(len(block))
        for _ in range(4):
            own = rest(np.linalg.solve(shifted, own / np.linalg.norm(own)))
    return own / np.linalg.norm(own)


def right_vectors(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest squared singular values of a square matrix, descending, and their unit right vectors as columns.

    Values that are zero to working precision are left out. The largest entry of each vector is positive.
    """
    scale = float(np.abs(matrix).max()) if matrix.size else 0.0
    if scale == 0.0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    diagonal, above, right = bidiagonalize(matrix / scale)
    n = len(diagonal)
    size = float(max(np.abs(diagonal).max(), np.abs(above).max(initial=0.0)))
    edges = [0, *(i + 1 for i in range(n - 1) if abs(above[i]) <= EPS * size), n]
    pairs: list[tuple[float, np.ndarray]] = []
    for a, b in zip(edges[:-1], edges[1:]):  # blocks without a link have their own values and vectors
        d, u = diagonal[a:b], above[a : b - 1]
        values = dqds((d**2).tolist(), (u**2).tolist())[:most]
        form = np.diag(d) + np.diag(u, 1)
        block, before = form.T @ form, []
        for k, value in enumerate(values):
            if value <= (n * EPS * size) ** 2:
                break
            z, value = twisted_vector(d, u, value)
            near = [w for v, w in before if abs(v - value) <= CLUSTER * v]
            z = _apart(z, near, block, value, k) if near else z
            before.append((value, z))
            whole = np.zeros(n)
            whole[a:b] = z
            pairs.append((value, whole))
    pairs.sort(key=lambda x: -x[0])
    pairs = pairs[:most]
    if not pairs:
        return np.zeros(0), np.zeros((n, 0))
    vectors = turn_back(np.stack([z for _, z in pairs], axis=1), right)
    vectors /= np.linalg.norm(vectors, axis=0)
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return np.array([v for v, _ in pairs]) * scale**2, vectors
