"""Binomial likelihood with its logit-normal row effects integrated out, tabulated per cell.

A row adds log of the integral of invlogit(e + s z)^k (1 - invlogit(e + s z))^(n - k) N(z) over z; the rows of a cell share e and s, so that a
cell's sum is a smooth function of two numbers. It is computed by quadrature and, where it is asked for often, fitted by
Chebyshev polynomials on patches of e and log(1 + s^2 / c), c = 4 / the cell's greatest n: that function's singularities lie at s^2 <= -c.
"""

from __future__ import annotations

import numpy as np

#: Trapezoid rules after z = mode + width sinh(t), whose tails reach far enough for one-sided rows (k = 0): (sinh t, log weight). Against a
#: step of 0.01 a row's error stays below 1e-9 for s <= 1, 2e-7 for s <= 2 and 2e-5 for s = 6 (n to 200,000, e from -9 to 1.3).
FINE, COARSE = ((np.sinh(t), np.log(h * np.cosh(t) / np.sqrt(2 * np.pi))) for t, h in (np.linspace(-r, r, m, retstep=True) for r, m in ((3.15, 43), (3.0, 25))))
COARSE_TO = 0.3  # for s up to this, where the singularities at e + s z = i pi lie far off
#: Polynomials per direction of a patch of width 1 x 1; a patch costs DEGREE**2 sums over a cell's rows and is fitted at that many visits.
DEGREE = 12
ORDERS = np.arange(DEGREE)
NODES = np.cos(np.pi * (ORDERS + 0.5) / DEGREE)
FIT = np.cos(np.outer(ORDERS, np.pi * (ORDERS + 0.5) / DEGREE)) * np.where(ORDERS == 0, 1, 2)[:, None] / DEGREE
BOTH = np.hstack([np.eye(DEGREE), np.column_stack([np.pad(np.polynomial.chebyshev.chebder(row), (0, DEGREE))[:DEGREE] for row in np.eye(DEGREE)])])  # polynomials to themselves and their derivatives
VISITS = DEGREE**2
#: Most patches and visit counts held (about 1 kB each); beyond that they are fitted again.
MAX_PATCHES = 200_000


def log_integrals(k, n, e, s, slopes: bool = True):
    """Per row: log of the integral and its derivatives by e and s (or the first alone)."""
    x, log_w = COARSE if s.max(initial=0) <= COARSE_TO else FINE
    seen = (k + 0.5) / (n + 1)
    info = n * seen * (1 - seen)
    z = s * info * (np.log(seen / (1 - seen)) - e) / (1 + s**2 * info)
    for _ in range(200):  # Newton's steps, of at most 1 on the logit's scale, to a twentieth of the integrand's width
        p = 1 / (1 + np.exp(-(e + s * z)))
        bend = 1 + s**2 * n * p * (1 - p)
        step = (s * (k - n * p) - z) / bend
        z = z + step / np.maximum(1, np.abs(s * step))
        if not (np.abs(step) * np.sqrt(bend) > 0.05).any():
            break
    z = z + x[:, None] / np.sqrt(bend)
    eta = s * z
    eta += e
    tail = np.exp(-np.abs(eta))
    h = np.log1p(tail)
    h += np.maximum(eta, 0)
    h *= -n
    h += k * eta
    h -= 0.5 * z * z
    h += log_w[:, None]
    top = h.max(axis=0)
    h -= top
    w = np.exp(h, out=h)
    total = w.sum(axis=0)
    value = top + np.log(total / np.sqrt(bend))
    if not slopes:
        return (value,)
    r = w * (k - n * np.where(eta > 0, 1, tail) / (1 + tail))
    return value, r.sum(axis=0) / total, (r * z).sum(axis=0) / total


class Marginal:
    """``(e, s)`` of all cells -> per cell the sum over its rows and its derivatives by e and s."""

    def __init__(self, cell, k, n, weight, cells: int):
        order = np.argsort(cell, kind="stable")
        self.cell, self.k, self.n, self.weight = (np.asarray(x)[order] for x in (cell, k, n, weight))
        self.ends = np.searchsorted(self.cell, np.arange(cells + 1))
        most, hits, all_ = np.ones(cells), np.bincount(self.cell, self.weight * self.k, cells), np.bincount(self.cell, self.weight * self.n, cells)
        np.maximum.at(most, self.cell, self.n)
        self.c = 4 / most
        self.middle = np.log((hits + 0.5) / (all_ - hits + 0.5)) - 0.5  # the cell's own logit lies in the middle of a patch
        self.at = np.full((2, cells), np.nan)
        self.coef, self.fitted = np.zeros((cells, DEGREE, DEGREE)), np.zeros(cells, bool)
        self.patches: dict = {}
        self.visits: dict = {}

    def exact(self, cells, e, s, slopes: bool = True):
        """By quadrature, for some cells."""
        rows = np.concatenate([np.arange(self.ends[c], self.ends[c + 1]) for c in cells])
        at = np.repeat(np.arange(len(cells)), [self.ends[c + 1] - self.ends[c] for c in cells])
        found = [np.zeros(len(cells)) for _ in range(3 if slopes else 1)]
        for a in range(0, len(rows), 256):  # what fits the processor's cache
            i, j = rows[a : a + 256], at[a : a + 256]
            for sums, x in zip(found, log_integrals(self.k[i], self.n[i], e[j], s[j], slopes)):
                sums += np.bincount(j, self.weight[i] * x, len(cells))
        return found

    def _patch(self, cell: int, i: float, j: float):
        key = (cell, i, j)
        if key in self.patches:
            return self.patches[key]
        if len(self.visits) > MAX_PATCHES:
            self.visits, self.patches = {}, {}
        self.visits[key] = self.visits.get(key, 0) + 1
        if self.visits[key] < VISITS:
            return None
        e = self.middle[cell] + i + (NODES + 1) / 2
        s = np.sqrt(self.c[cell] * np.expm1(j + (NODES + 1) / 2))
        f = np.column_stack([self.exact([cell] * DEGREE, e, np.full(DEGREE, b), False)[0] for b in s])
        self.patches[key] = FIT @ f @ FIT.T
        return self.patches[key]

    def __call__(self, e, s):
        s2 = s * s
        uv = np.stack((e - self.middle, np.log1p(s2 / self.c)))
        if not np.isfinite(uv).all():
            return [np.full(len(e), np.nan) for _ in range(3)]
        at = np.floor(uv)
        for c in np.flatnonzero((at != self.at).any(axis=0) | ~self.fitted):
            patch = self._patch(int(c), *at[:, c])
            self.fitted[c] = patch is not None
            if patch is not None:
                self.coef[c] = patch
        self.at = at
        basis = np.cos(np.arccos(2 * (uv - at) - 1).reshape(-1, 1) * ORDERS) @ BOTH
        by_u, by_v = basis.reshape(2, -1, 2, DEGREE)
        both = by_u @ (self.coef @ by_v.transpose(0, 2, 1))  # per cell [value or slope by u, value or slope by v]
        f, fe, fs = both[:, 0, 0], 2 * both[:, 1, 0], 4 * both[:, 0, 1] * s / (s2 + self.c)
        if not self.fitted.all():
            rest = np.flatnonzero(~self.fitted)
            f[rest], fe[rest], fs[rest] = self.exact(rest, e[rest], s[rest])
        return f, fe, fs
