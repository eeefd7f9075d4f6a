"""Hierarchical logit-normal binomial model, sampled by the no-U-turn sampler: one task per chain.

mu_global ~ N(-2, 2), sigma_global ~ HN(1), mu_group ~ N(mu_global, sigma_global); or, with independent groups,
mu_group ~ N(-2, 2) and mu_global their mean. Per group tau ~ HN(1) for countries and sigma ~ HN(1) for sources.
Optional time effects: delta_time ~ N(0, HN(0.5)) shared by all, gamma ~ N(0, HN(0.5)) per group and time.
k ~ Binomial(n, invlogit(alpha_country + delta_time + gamma + sigma z)). No result shows the z of a source (and period): they are
integrated out (``marginal``), so that a step costs by countries and periods, not by sources. The input is a table of sufficient
statistics, one row per source (and period); equal rows of a country and period are pooled, which every chain holds, and their
number is checked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.marginal import Marginal
from tidemark.session import cut_lineage

#: Most different rows of sufficient statistics a chain may hold (about 100 bytes each).
MAX_ROWS = 2_000_000
TIME_SCALE = 0.5


def prepared(columns: list[str]) -> bool:
    """Whether a table holds sufficient statistics (not articles): it has k, n, group and country."""
    return {"k", "n", "group", "country"} <= set(columns)


# The four runs, by input and options.
RUNS = [
    {"outcome": "k_hecc_cc", "group": "region", "time": "yearly", "group_time": False, "global_time": True, "independent": False},
    {"outcome": "k_hecc_cc", "group": "climate_zone", "time": "monthly", "group_time": True, "global_time": False, "independent": False},
    {"outcome": "k_hecc_cc", "group": "hdi_category", "time": None, "group_time": True, "global_time": True, "independent": True},
    {"outcome": "k_health_cc", "group": "region", "time": "yearly", "group_time": False, "global_time": True, "independent": False},
]


def run_matrix(spark) -> DataFrame:
    return spark.createDataFrame([tuple(r.values()) for r in RUNS], "outcome string, group string, time string, group_time boolean, global_time boolean, independent boolean")


def _index(values):
    levels = sorted(set(values))
    at = {v: i for i, v in enumerate(levels)}
    return levels, np.array([at[v] for v in values], int)


def _pinned(country, k, n, weight, group) -> np.ndarray:
    """Countries known far better (a tenth of the variance) than the countries of their group differ.

    They are sampled centred, as their logit itself: the same posterior, without the narrow ridge between a country, its group and tau.
    """
    C = len(group)
    total = lambda x: np.bincount(country, weight * x, C)
    p = (total(k) + 0.5) / (total(n) + 1)
    info, logit = np.maximum(total(n) * p * (1 - p), 1e-9), np.log(p / (1 - p))
    error = np.maximum(total((k - n * p[country]) ** 2) / info**2, 1 / info)
    size = np.bincount(group)
    between = np.bincount(group, (logit - (np.bincount(group, logit) / np.maximum(size, 1))[group]) ** 2) / np.maximum(size - 1, 1)
    return (error < 0.1 * between[group]) & (size[group] > 2) & (total(np.ones(len(k))) > 4)


class Model:
    """Log posterior over unconstrained, standardised parameters; scales are sampled as logarithms with their Jacobian.

    A row stands for as many sources as its weight (1 each where none is given). Rows of a country and period form a cell.
    """

    def __init__(self, country, group, k, n, time=None, global_time: bool = True, group_time: bool = True, independent: bool = False, weight=None):
        self.countries, c = _index(country)
        self.groups, g = _index(group)
        k, n = np.asarray(k, float), np.asarray(n, float)
        self.g_of_c = np.zeros(len(self.countries), int)
        for ci, gi in zip(c[::-1], g[::-1]):
            self.g_of_c[ci] = gi  # the group of a country's first row
        self.independent = independent
        self.times, t = _index(time) if time is not None else ([], np.zeros(len(c), int))
        G, C, T = len(self.groups), len(self.countries), len(self.times)
        cells, cell = np.unique(c * max(T, 1) + t, return_inverse=True)
        self.c, self.t = np.divmod(cells, max(T, 1))
        self.g = self.g_of_c[self.c]
        weight = np.ones(len(k)) if weight is None else np.asarray(weight, float)
        self.rows = Marginal(cell, k, n, weight, len(cells))
        self.centred = np.zeros(C, bool) if T else _pinned(c, k, n, weight, self.g_of_c)
        sizes = {"mu0": 0 if independent else 1, "ls0": 0 if independent else 1, "zg": G, "ltau": G, "lsig": G, "zc": C}
        if T and global_time:
            sizes |= {"ldt": 1, "zt": T}
        if T and group_time:
            sizes |= {"lgt": 1, "zgt": G * T}
            self.gt = self.g * T + self.t
        at = np.cumsum([0, *sizes.values()])
        self.slot = {k: slice(a, b) for k, a, b in zip(sizes, at, at[1:])}
        self.size = int(at[-1])

    def forward(self, q, p=None):
        """(mu_global, mu of groups, alpha of countries, time effect, group time effects [group, time])."""
        p = p or {k: q[s] for k, s in self.slot.items()}
        mu_g = -2 + 2 * p["zg"] if self.independent else p["mu0"] + np.exp(p["ls0"]) * p["zg"]
        alpha = np.where(self.centred, p["zc"], mu_g[self.g_of_c] + np.exp(p["ltau"])[self.g_of_c] * p["zc"])
        delta = np.exp(p["ldt"]) * p["zt"] if "zt" in p else None
        gamma = np.exp(p["lgt"]) * p["zgt"] if "zgt" in p else None
        return (mu_g.mean() if self.independent else p["mu0"][0]), mu_g, alpha, delta, gamma

    def log_density(self, q):
        """Log posterior and its gradient."""
        p = {k: q[s] for k, s in self.slot.items()}
        G, C, T = len(self.groups), len(self.countries), len(self.times)
        _, mu_g, alpha, delta, gamma = self.forward(q, p)
        tau, sig = np.exp(p["ltau"]), np.exp(p["lsig"])
        tau_c = tau[self.g_of_c]
        eta = alpha[self.c]
        if delta is not None:
            eta = eta + delta[self.t]
        if gamma is not None:
            eta = eta + gamma[self.gt]
        each, r, by_sig = self.rows(eta, sig[self.g])
        lp = float(each.sum())
        rc = np.bincount(self.c, r, C)
        z = np.where(self.centred, (alpha - mu_g[self.g_of_c]) / tau_c, p["zc"])  # standardised
        rg = np.bincount(self.g_of_c, np.where(self.centred, z / tau_c, rc), G)
        grad = np.empty(self.size)

        def normal(name, pull):
            nonlocal lp
            lp -= 0.5 * float(p[name] @ p[name])
            grad[self.slot[name]] = pull - p[name]

        def half_normal(name, scale, width, pull):
            nonlocal lp
            lp += float(p[name].sum() - 0.5 * (scale @ scale) / width**2)
            grad[self.slot[name]] = scale * pull + 1 - scale**2 / width**2

        if self.independent:
            normal("zg", 2 * rg)
        else:
            s0 = np.exp(p["ls0"])
            lp -= float(((p["mu0"] + 2) ** 2).sum()) / 8
            grad[self.slot["mu0"]] = rg.sum() - (p["mu0"] + 2) / 4
            half_normal("ls0", s0, 1.0, rg @ p["zg"])
            normal("zg", s0 * rg)
        half_normal("ltau", tau, 1.0, np.bincount(self.g_of_c, np.where(self.centred, (z * z - 1) / tau_c, rc * z), G))
        lp -= 0.5 * float(z @ z) + float(np.log(tau_c[self.centred]).sum())
        grad[self.slot["zc"]] = np.where(self.centred, rc - z / tau_c, tau_c * rc - z)
        half_normal("lsig", sig, 1.0, np.bincount(self.g, by_sig, G))
        for scale, z, at, n in (("ldt", "zt", self.t, T), ("lgt", "zgt", getattr(self, "gt", None), G * T)):
            if z in p:
                w, by = np.exp(p[scale]), np.bincount(at, r, n)
                half_normal(scale, w, TIME_SCALE, by @ p[z])
                normal(z, w * by)
        return lp, grad


class _Tree:
    """Part of a trajectory: its two ends, a state drawn from it by weight, and whether it may be extended."""

    __slots__ = ("left", "right", "state", "weight", "ok", "accept", "n", "diverged")

    def __init__(self, left, right, state, weight, ok, accept, n, diverged):
        self.left, self.right, self.state, self.weight, self.ok, self.accept, self.n, self.diverged = left, right, state, weight, ok, accept, n, diverged


def _straight(left, right) -> bool:
    """Whether the ends still move apart."""
    d = right[0] - left[0]
    return d @ left[1] > 0 and d @ right[1] > 0


def _grow(model, end, way, depth, eps, metric, h0, rng) -> _Tree:
    """A subtree of 2**depth steps from ``end`` = (position, momentum, gradient, log density)."""
    if depth == 0:
        q, p, g, _ = end
        p = p + 0.5 * way * eps * g
        q = q + way * eps * metric * p
        lp, g = model.log_density(q)
        p = p + 0.5 * way * eps * g
        now = (q, p, g, lp)
        gain = lp - 0.5 * float(metric @ p**2) - h0
        gain = gain if np.isfinite(gain) else -np.inf
        return _Tree(now, now, now, gain, gain > -1000, float(np.exp(min(0.0, gain))), 1, gain <= -1000)
    a = _grow(model, end, way, depth - 1, eps, metric, h0, rng)
    if not a.ok:
        return a
    b = _grow(model, a.right if way > 0 else a.left, way, depth - 1, eps, metric, h0, rng)
    left, right = (a.left, b.right) if way > 0 else (b.left, a.right)
    weight = np.logaddexp(a.weight, b.weight)
    state = b.state if b.ok and np.log(rng.random()) < b.weight - weight else a.state
    return _Tree(left, right, state, weight, b.ok and _straight(left, right), a.accept + b.accept, a.n + b.n, b.diverged)


def chain(model: Model, draws: int, tune: int, seed: int, target: float = 0.9, max_depth: int = 10):
    """(draws [draws, parameters], whether each draw's trajectory diverged): diagonal metric, dual-averaged step size."""
    rng = np.random.default_rng(seed)
    q = rng.normal(0, 0.1, model.size)
    if not model.independent:
        q[0] = -2
    lp, g = model.log_density(q)
    metric, log_eps, centre, h_bar, log_bar, since = np.ones(model.size), np.log(0.05), np.log(0.5), 0.0, np.log(0.05), 0
    out, diverged, seen = [], [], []
    windows = {tune // 4, tune // 2, 3 * tune // 4}  # the metric is estimated again at these steps
    for t in range(tune + draws):
        eps = float(np.exp(log_eps if t < tune else log_bar))
        p = rng.normal(size=model.size) / np.sqrt(metric)
        h0 = lp - 0.5 * float(metric @ p**2)
        now = (q, p, g, lp)
        tree = _Tree(now, now, now, 0.0, True, 0.0, 0, False)
        for depth in range(max_depth):
            way = 1 if rng.random() < 0.5 else -1
            new = _grow(model, tree.right if way > 0 else tree.left, way, depth, eps, metric, h0, rng)
            tree.accept, tree.n, tree.diverged = tree.accept + new.accept, tree.n + new.n, new.diverged
            if not new.ok:
                break
            if np.log(rng.random()) < new.weight - tree.weight:
                tree.state = new.state
            tree.weight = np.logaddexp(tree.weight, new.weight)
            tree.left, tree.right = (tree.left, new.right) if way > 0 else (new.left, tree.right)
            if not _straight(tree.left, tree.right):
                break
        q, _, g, lp = tree.state
        if t >= tune:
            out.append(q)
            diverged.append(tree.diverged)
            continue
        since += 1
        h_bar += (target - tree.accept / tree.n - h_bar) / (since + 10)
        log_eps = centre - np.sqrt(since) / 0.05 * h_bar
        w = since**-0.75
        log_bar = w * log_eps + (1 - w) * log_bar
        seen.append(q)
        if t in windows and len(seen) > 10:
            n = len(seen)
            metric = np.var(seen, axis=0) * n / (n + 5) + 1e-3 * 5 / (n + 5)
            centre, h_bar, log_eps, since, seen = log_bar + np.log(10), 0.0, log_bar, 0, []
    return np.array(out), np.array(diverged, bool)


def _logistic(x):
    return 1 / (1 + np.exp(-x))


def derived(m: Model, q: np.ndarray) -> list[tuple[str, str, float]]:
    """(param, level, value) of one draw; a group and period read ``group|period``."""
    mu, mu_g, alpha, delta, gamma = m.forward(q)
    out = [("prevalence_global", "all", float(_logistic(mu)))]
    out += [("prevalence_group", v, float(x)) for v, x in zip(m.groups, _logistic(mu_g))]
    out += [("prevalence_country", v, float(x)) for v, x in zip(m.countries, _logistic(alpha))]
    if delta is not None:
        out += [("prevalence_time", v, float(x)) for v, x in zip(m.times, _logistic(mu + delta))]
    if delta is not None or gamma is not None:
        both = mu_g[:, None] + (0 if delta is None else delta[None, :]) + (0 if gamma is None else gamma.reshape(len(m.groups), -1))
        out += [("prevalence_group_time", f"{g}|{t}", float(x)) for g, row in zip(m.groups, _logistic(both)) for t, x in zip(m.times, row)]
    return out


def hierarchical_prevalence(stats: DataFrame, chains: int = 4, draws: int = 500, tune: int = 500, seed: int = 42, global_time: bool = True, group_time: bool = True,
                            independent: bool = False, target: float = 0.9, max_rows: int = MAX_ROWS) -> DataFrame:
    """(param, level, chain, draw, value): prevalence of the whole, of groups, countries and periods, and ``diverging`` (0 or 1).

    ``stats`` has columns country, group, k, n and, for time effects, time_period; an empty table gives no draws.
    More than ``max_rows`` different rows are an error. Samples when it is built, once for all who read the draws.
    """
    spark = stats.sparkSession
    if not prepared(stats.columns):
        raise ValueError("stats must have the columns country, group, k and n")
    time = ["time_period"] if "time_period" in stats.columns else []
    pooled = stats.select("country", "group", *time, "k", "n").where("n > 0").groupBy("country", "group", *time, "k", "n").agg(F.count(F.lit(1)).alias("weight"))
    rows = pooled.limit(max_rows + 1).orderBy("country", "group", *time, "k", "n").toPandas()  # bounded by max_rows
    if len(rows) > max_rows:
        raise ValueError(f"{pooled.count()} different rows of sufficient statistics, {max_rows} at most: pool them first")
    held = spark.sparkContext.broadcast(rows)

    def one(batches):
        rows = held.value
        for c in (int(c) for pdf in batches for c in pdf["chain"]):
            if rows.empty:
                return
            m = Model(rows["country"], rows["group"], rows["k"], rows["n"], rows["time_period"] if time else None, global_time, group_time, independent, rows["weight"])
            qs, bad = chain(m, draws, tune, seed + c, target)
            got = [(p, v, c, t, x) for t, q in enumerate(qs) for p, v, x in derived(m, q)] + [("diverging", "all", c, t, float(b)) for t, b in enumerate(bad)]
            yield pd.DataFrame(got, columns=["param", "level", "chain", "draw", "value"])

    ids = spark.range(0, chains, 1, chains).select(F.col("id").cast("int").alias("chain"))  # a partition for each chain, without a shuffle
    return cut_lineage(ids.mapInPandas(one, "param string, level string, chain int, draw int, value double"))
