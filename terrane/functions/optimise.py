"""Nelder-Mead minimisation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def nelder_mead(f: Callable[[np.ndarray], float] | None, start: np.ndarray, scale: np.ndarray | None = None, max_evaluations: int = 300, tolerance: float = 1.5e-8, together: Callable[[np.ndarray], list[float]] | None = None) -> tuple[np.ndarray, float, int, bool]:
    """The best point, its value, the number of evaluations, and whether the values' spread fell below the tolerance.

    The first simplex steps a tenth of the largest scaled coordinate along each axis. together, in place of f, takes
    several points (as rows) at once: all that a step may ask for, of which those that it uses count as evaluations.
    """
    scale = np.ones(len(start)) if scale is None else np.where(scale == 0, 1.0, scale)
    n = len(start)
    x0 = start / scale
    step = 0.1 * max(np.abs(x0).max(), 1e-3)
    points = np.vstack([x0, x0 + step * np.eye(n)])
    calls = 0

    def every(x: np.ndarray) -> np.ndarray:
        nonlocal calls
        calls += len(x)
        v = np.array(together(x * scale) if together else [f(p * scale) for p in x], float)
        return np.where(np.isfinite(v), v, np.inf)

    values = every(points)
    done = False
    while calls < max_evaluations:
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if values[-1] - values[0] <= tolerance * (abs(values[0]) + tolerance):
            done = True
            break
        middle = points[:-1].mean(0)
        away = middle - points[-1]
        tries = middle + np.outer([1, 2, 0.5, -0.5], away)
        known = every(tries) if together else None
        calls -= len(tries) if together else 0

        def at(k: int) -> float:
            nonlocal calls
            if known is None:
                return every(tries[k : k + 1])[0]
            calls += 1
            return known[k]

        v = at(0)
        if v < values[0]:
            w = at(1)
            points[-1], values[-1] = (tries[1], w) if w < v else (tries[0], v)
        elif v < values[-2]:
            points[-1], values[-1] = tries[0], v
        else:
            near = 2 if v < values[-1] else 3
            w = at(near)
            if w < min(v, values[-1]):
                points[-1], values[-1] = tries[near], w
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = every(points[1:])
    best = int(np.argmin(values))
    return points[best] * scale, float(values[best]), calls, done
