"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

``factor`` is the LDL' factorisation with Bunch-Kaufman pivots. By Sylvester's law the positive pivots of ``A - sI`` are as
many as eigenvalues of ``A`` above ``s``. Bisection over these counts isolates each of the leading eigenvalues in an interval
of its own; Rayleigh quotient iteration, started by inverse iteration inside the interval, then converges cubically, and a
quotient that leaves its interval makes the interval halve first. Values closer than rounding can tell form one interval,
whose vectors are made orthogonal. At the end counts on both sides of each value certify that it is the k-th.
"""

from __future__ import annotations

import numpy as np

ALPHA = (1 + 17 ** 0.5) / 8
EPS = np.finfo(float).eps
#: A residual of so many times the rounding level may end the iteration once it stands still.
NEAR = 64


def factor(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``lower, diag, off, order`` with ``a[order][:, order] = lower @ D @ lower.T``; D has ``diag`` and 2x2 blocks (``off``)."""
    a = np.array(a, float)
    n = len(a)
    lower, diag, off, order = np.eye(n), np.zeros(n), np.zeros(n), np.arange(n)
    k = 0
    while k < n:
        size, take = 1, k
        if k < n - 1:
            below = np.abs(a[k + 1:, k])
            r = k + 1 + int(below.argmax())
            most = below[r - k - 1]
            if abs(a[k, k]) < ALPHA * most:
                row = np.abs(a[r, k:])
                row[r - k] = 0
                if abs(a[k, k]) * row.max() < ALPHA * most * most:
                    size, take = (1, r) if abs(a[r, r]) >= ALPHA * row.max() else (2, r)
        at = k + size - 1
        if take != at:
            a[[take, at]] = a[[at, take]]
            a[:, [take, at]] = a[:, [at, take]]
            lower[[take, at], :k] = lower[[at, take], :k]
            order[[take, at]] = order[[at, take]]
        block, rest = a[k:k + size, k:k + size], a[k + size:, k:k + size]
        diag[k:k + size] = block.diagonal()
        if size == 2:
            off[k] = block[1, 0]
        if rest.any():
            part = np.linalg.solve(block, rest.T).T
            lower[k + size:, k:k + size] = part
            a[k + size:, k + size:] -= part @ rest.T
        k += size
    return lower, diag, off, order


def above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of ``a`` are larger than ``shift``."""
    _, diag, off, _ = factor(a - shift * np.eye(len(a)))
    count, k = 0, 0
    while k < len(diag):
        if off[k]:
            count += int((np.linalg.eigvalsh([[diag[k], off[k]], [off[k], diag[k + 1]]]) > 0).sum())
            k += 2
        else:
            count += int(diag[k] > 0)
            k += 1
    return count


def isolate(a: np.ndarray, k: int, width: float) -> list[tuple[float, float, int]]:
    """Disjoint intervals, falling, with the number of eigenvalues in each; together they hold at least the ``k`` largest."""
    radius = np.abs(a).sum(axis=1).max() + width
    todo, done, have = [(-radius, radius, len(a), 0)], [], 0  # low, high, above low, above high
    while todo and have < k:
        low, high, n_low, n_high = todo.pop()
        if n_low == n_high:
            continue
        if n_low - n_high == 1 or high - low <= width:
            done.append((low, high, n_low - n_high))
            have += n_low - n_high
            continue
        mid = (low + high) / 2
        n_mid = above(a, mid)
        todo += [(low, mid, n_low, n_mid), (mid, high, n_mid, n_high)]  # the upper half comes first
    return done


def _solved(a: np.ndarray, shift: float, v: np.ndarray, tiny: float) -> np.ndarray:
    try:
        return np.linalg.solve(a - shift * np.eye(len(a)), v)
    except np.linalg.LinAlgError:
        return np.linalg.solve(a - (shift + tiny) * np.eye(len(a)), v)


def _unit(v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for u in others:
            v = v - (u @ v) * u
        v = v / np.linalg.norm(v)
    return v


def _pair(a: np.ndarray, low: float, high: float, found: list[np.ndarray], alone: bool, tiny: float, rng) -> tuple[float, np.ndarray]:
    while True:
        v = _unit(rng.standard_normal(len(a)), found)
        for _ in range(3):
            v = _unit(_solved(a, (low + high) / 2, v, tiny), found)
        value, left = v @ a @ v, np.inf
        for _ in range(20):
            if not low - tiny <= value <= high + tiny:
                break
            gap = np.linalg.norm(a @ v - value * v)
            if gap <= tiny / 4 or gap >= left / 2 and gap <= NEAR * tiny:
                return value, v
            left = gap
            v = _unit(_solved(a, value, v, tiny), found)
            value = v @ a @ v
        if high - low <= tiny:
            return value, v
        mid = (low + high) / 2
        low, high = (mid, high) if alone and above(a, mid) > above(a, high) else (low, mid) if alone else (low, high)


def leading(a: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The up to ``k`` largest eigenvalues, falling, and their unit vectors as columns; certified by counts."""
    k, rng = min(k, len(a)), np.random.default_rng(seed)
    scale = np.abs(a).sum(axis=1).max() if len(a) else 0.0
    if not scale:
        return np.zeros(0), np.zeros((len(a), 0))
    tiny = 8 * EPS * len(a) * scale
    values, vectors = [], []
    for low, high, many in isolate(a, k, tiny):
        for _ in range(many):
            value, v = _pair(a, low, high, vectors, many == 1, tiny, rng)
            values.append(value)
            vectors.append(v)
    order = np.argsort(-np.array(values), kind="stable")[:k]
    values, vectors = np.array(values)[order], np.array(vectors)[order].T
    for at, value in enumerate(values):
        slack = 4 * tiny + np.linalg.norm(a @ vectors[:, at] - value * vectors[:, at])
        if slack > 4 * NEAR * tiny:
            raise ArithmeticError(f"eigenvalue {at + 1} has not converged")
        if above(a, value + slack) > at or above(a, value - slack) <= at:
            raise ArithmeticError(f"counts do not certify eigenvalue {at + 1}")
    return values, vectors
