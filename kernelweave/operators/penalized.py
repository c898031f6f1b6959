"""Penalised quadratic problems of a few hundred or thousand unknowns, on the driver."""

from __future__ import annotations

import numpy as np


def _solved(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """h x = g, the least solution where h is singular."""
    scale = np.sqrt(np.where(h.diagonal() > 0, h.diagonal(), 1.0))
    return np.linalg.lstsq(h / np.outer(scale, scale), g / scale, rcond=1e-12)[0] / scale


def _polished(h: np.ndarray, g: np.ndarray, start: np.ndarray, b: np.ndarray, l1: np.ndarray, l2: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray | None:
    """The exact solution with b's signs and bounds, if it has them and no other unknown wants to move."""
    on = (b != 0) & (b > low) & (b < high)
    if not on.any():
        return None
    away = np.where(on, 0.0, b - start)
    rhs = g[on] - (h[np.ix_(on, ~on)] @ away[~on]) + h[np.ix_(on, on)] @ start[on] - l1[on] * np.sign(b[on])
    new = b.copy()
    new[on] = _solved(h[np.ix_(on, on)] + np.diag(l2[on]), rhs)
    if (np.sign(new[on]) != np.sign(b[on])).any() or (new < low).any() or (new > high).any():
        return None
    slope = g - h @ (new - start) - l2 * new
    size = 1e-10 * max(np.abs(g).max(), l1.max(), 1e-300)
    still = np.where(new == 0, np.abs(slope) <= l1 + size, True)
    still &= np.where((new == high) & (high > 0), slope >= l1 - size, True) & np.where((new == low) & (low < 0), slope <= size - l1, True)
    return new if still.all() else None


def quadratic(h: np.ndarray, g: np.ndarray, start: np.ndarray, l1: np.ndarray, l2: np.ndarray, k: int = 1, grouped: bool = False, low: np.ndarray | None = None, high: np.ndarray | None = None, sweeps: int = 5000) -> np.ndarray:
    """The b with least (b - start)' h (b - start) / 2 - g' (b - start) + sum of l2 b^2 / 2 + l1 |b|.

    Unknowns come in runs of k that share penalties and bounds; grouped takes the length of a run instead of its sizes.
    Coordinate (or run) descent finds what is not 0; without runs a linear system then gives the solution exactly.
    """
    d = len(start)
    low, high = (np.full(d // k, -np.inf) if low is None else low), (np.full(d // k, np.inf) if high is None else high)
    one, two, low, high = (np.repeat(x, k) for x in (l1, l2, low, high))
    if not l1.any() and np.isneginf(low).all() and np.isposinf(high).all():
        return start + _solved(h + np.diag(two), g - two * start)
    b, diag = start.copy(), h.diagonal().copy()
    r = g.copy()
    blocks = [np.arange(j * k, j * k + k) for j in range(d // k)] if grouped else None
    top = [max(np.linalg.eigvalsh(h[np.ix_(i, i)]).max(), 0.0) for i in blocks] if grouped else None
    full, scale = True, max(float(np.abs(g * (np.abs(b).max() + 1e-3)).max(initial=0.0)), 1e-300)
    for sweep in range(sweeps):
        worst = 0.0
        if grouped:
            for j, i in enumerate(blocks):
                if top[j] <= 0 or not full and not b[i].any():
                    continue
                z = top[j] * b[i] + r[i]
                size = np.sqrt(z @ z)
                new = z * (max(0.0, 1 - l1[j] / size) / (top[j] + l2[j])) if size > 0 else np.zeros(k)
                new = np.clip(new, low[i], high[i])
                step = new - b[i]
                if step.any():
                    r -= h[:, i] @ step
                    b[i] = new
                    worst = max(worst, top[j] * float(step @ step))
        else:
            for j in range(d) if full else np.flatnonzero(b).tolist():
                if diag[j] <= 0:
                    continue
                z = r[j] + diag[j] * b[j]
                new = (z - one[j] if z > one[j] else z + one[j] if z < -one[j] else 0.0) / (diag[j] + two[j])
                new = min(max(new, low[j]), high[j])
                step = new - b[j]
                if step:
                    r -= h[:, j] * step
                    b[j] = new
                    worst = max(worst, diag[j] * step * step)
            if sweep % 4 == 3 or worst < 1e-12 * scale:
                exact = _polished(h, g, start, b, one, two, low, high)
                if exact is not None:
                    return exact
        if worst <= 1e-20 * scale:
            if full:
                break
            full = True
        else:
            full = sweep % 10 == 9
    return b


def centred(b: np.ndarray, l1: np.ndarray, l2: np.ndarray, alpha: float, lam: float) -> np.ndarray:
    """Coefficients of classes (1 + columns x classes) shifted, each column by one number, to the least penalty; without penalty, to mean 0."""
    out = b.copy()
    out[0] -= out[0].mean()
    lasso, ridge = lam * alpha * l1, lam * (1 - alpha) * l2
    for j in np.flatnonzero(b[1:].any(1)):
        x = b[j + 1]
        if lasso[j] <= 0:
            out[j + 1] = x - x.mean()
        elif ridge[j] <= 0:
            out[j + 1] = x - np.median(x)
        else:
            lo, hi = x.min(), x.max()
            for _ in range(100):
                c = (lo + hi) / 2
                lo, hi = (c, hi) if ridge[j] * (c - x).sum() + lasso[j] * np.sign(c - x).sum() < 0 else (lo, c)
            # at a kink the shift is that coefficient itself, which becomes 0
            near = x[np.abs(x - (lo + hi) / 2).argmin()]
            shift = near if abs(near - (lo + hi) / 2) <= 1e-9 * max(1.0, abs(near)) else (lo + hi) / 2
            out[j + 1] = x - shift
    return out
