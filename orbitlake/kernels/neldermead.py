"""Simplex search (Nelder and Mead 1965) for many functions of a few variables at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimise_all(f: Callable[[np.ndarray, np.ndarray], np.ndarray], x0, step=None, xtol: float = 1e-4, ftol: float = 1e-10, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best points (n, d), their values, and whether each simplex shrank to the tolerances within the rounds.

    f(rows, points) gives the values of the functions `rows` at one point each. step is the first simplex's edge by variable;
    without it, a twentieth of each variable. A round is one evaluation of all simplexes that still move, and one of those
    that need a second point; those that have shrunk take no part.
    """
    x0 = np.asarray(x0, float)
    n, d = x0.shape
    edge = np.where(x0 != 0, x0 * 0.05, 0.00025) if step is None else np.broadcast_to(np.asarray(step, float), x0.shape)
    p = np.repeat(x0[:, None, :], d + 1, 1)
    for k in range(d):
        p[:, k + 1, k] += edge[:, k]
    every = np.arange(n)
    v = np.stack([f(every, p[:, k]) for k in range(d + 1)], 1) if n else np.zeros((0, d + 1))
    done = np.zeros(n, bool)
    for _ in range(rounds):
        order = np.argsort(v, 1, kind="stable")
        p, v = np.take_along_axis(p, order[:, :, None], 1), np.take_along_axis(v, order, 1)
        done |= (np.abs(p[:, 1:] - p[:, :1]).max((1, 2), initial=0) <= xtol) & (np.abs(v[:, 1:] - v[:, :1]).max(1, initial=0) <= ftol)
        go = np.flatnonzero(~done)
        if not len(go):
            break
        middle, worst = p[go, :-1].mean(1), p[go, -1]
        at = lambda t: middle + t[:, None] * (worst - middle)  # noqa: B023, E731
        first = f(go, at(np.full(len(go), -1.0)))
        far, good = first < v[go, 0], first < v[go, -2]
        # further out, as it is, or inwards on the better side
        t = np.where(far, -2.0, np.where(good, -1.0, np.where(first < v[go, -1], -0.5, 0.5)))
        again = np.flatnonzero(far | ~good)
        second = np.full(len(go), np.inf)
        second[again] = f(go[again], at(t)[again]) if len(again) else 0
        inward = ~far & ~good
        shrink = inward & ~(second < np.minimum(first, v[go, -1]))
        use = (far & (second < first)) | (inward & ~shrink)
        new, value = np.where(use[:, None], at(t), at(np.full(len(go), -1.0))), np.where(use, second, first)
        k = go[~shrink]
        p[k, -1], v[k, -1] = new[~shrink], value[~shrink]
        k = go[shrink]
        if len(k):
            p[k, 1:] = p[k, :1] + 0.5 * (p[k, 1:] - p[k, :1])
            for j in range(1, d + 1):
                v[k, j] = f(k, p[k, j])
    best = np.argmin(v, 1) if n else every
    return p[every, best], v[every, best], done


def minimise(f: Callable[[np.ndarray], float], x0, xtol: float = 1e-4, ftol: float = 1e-10, rounds: int = 200) -> tuple[np.ndarray, float, bool]:
    """The same for one function of a point."""
    x, v, ok = minimise_all(lambda _, p: np.array([f(q) for q in p]), [x0], None, xtol, ftol, rounds)
    return x[0], float(v[0]), bool(ok[0])
