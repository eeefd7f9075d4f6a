"""Posterior draws in long form (param, chain, draw, value): summaries, contrasts and convergence diagnostics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sampling import bucketed_rank


def inverse_logit(c):
    return 1 / (1 + F.exp(-c))


def summary(draws: DataFrame, keys: list[str], scale: float = 1.0, digits: int = 6) -> DataFrame:
    """Median, median absolute deviation and the 2.5 and 97.5 percentiles (linear interpolation) per key."""
    x = draws.select(*keys, (F.col("value") * scale).alias("value"))
    q = x.groupBy(*keys).agg(F.percentile("value", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"), F.count("value").alias("n"))
    mad = x.join(q, keys).groupBy(*keys).agg(F.percentile(F.abs(F.col("value") - F.col("q")[1]), 0.5).alias("mad"))
    r = lambda c: F.round(c, digits)
    return q.join(mad, keys).select(*keys, "n", r(F.col("q")[1]).alias("median"), r(F.col("mad")).alias("mad"), r(F.col("q")[0]).alias("eti_low"), r(F.col("q")[2]).alias("eti_high"))


def percent_summary(draws: DataFrame, keys: list[str]) -> DataFrame:
    """Median and 95 % interval in percent with one decimal, halves to even; rounding comes last."""
    one = summary(draws, keys, 100.0, digits=12)
    return one.select(*keys, "n", *[F.bround(c, 1).alias(c) for c in ("median", "eti_low", "eti_high")])


def extremes(summary_: DataFrame, level: str, n: int = 5) -> DataFrame:
    """(side, level, median): the n highest and the n lowest levels by median, ties by the level's name."""
    top, low = (summary_.orderBy(o, level).limit(n).select(F.lit(k).alias("side"), level, "median") for k, o in (("top", F.desc("median")), ("bottom", F.asc("median"))))
    return top.unionByName(low)


def output_name(kind: str, category: str, group: str, time: str | None = None) -> str:
    """Name of a result file, such as ``prevalence_group_health_region_yearly``."""
    return "_".join([kind, category, group, *([time] if time else [])])


def contrast(draws: DataFrame, level: str, a: str, b: str, keys: list[str]) -> DataFrame:
    """Draws of ``a`` minus draws of ``b``, pair by pair of chain and draw, then summarised."""
    on = [*keys, "chain", "draw"]
    one = draws.where(F.col(level).isin(a, b)).groupBy(*on).agg(F.sum(F.when(F.col(level) == a, F.col("value"))).alias("x"), F.sum(F.when(F.col(level) == b, F.col("value"))).alias("y"))
    return summary(one.where("x is not null and y is not null").withColumn("value", F.col("x") - F.col("y")), keys)


def average_over(draws: DataFrame, level: str, levels: list, keys: list[str]) -> DataFrame:
    """Draw-level average over some levels (a season, a calendar month of all years), then summarised."""
    one = draws.where(F.col(level).isin(levels)).groupBy(*keys, "chain", "draw").agg(F.avg("value").alias("value"))
    return summary(one, keys)


def hdi(draws: DataFrame, keys: list[str], mass: float = 0.95, digits: int = 6, buckets: int = 256) -> DataFrame:
    """Mean, standard deviation and the narrowest interval that holds ``mass`` of the draws; of equal ones the lowest.

    Draws are ranked in ``buckets`` ranges of values between the least and the greatest of a key, and each is joined with the draw
    so many ranks higher; nulls and NaN are left out.
    """
    x = draws.where("value is not null and not isnan(value)")
    n = x.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev("value").alias("sd"), F.min("value").alias("__lo"), F.max("value").alias("__hi"))
    at = F.coalesce(F.floor((F.col("value") - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)) * buckets), F.lit(0))
    x = bucketed_rank(x.join(n, keys), keys, at, ["value", "chain", "draw"]).withColumn("__k", F.floor(F.col("n") * mass).cast("int"))
    ends = x.select(*keys, (F.col("__rank") - F.col("__k")).alias("__rank"), F.col("value").alias("high"))
    both = x.select(*keys, "__rank", F.col("value").alias("low"), "n", "mean", "sd").join(ends, [*keys, "__rank"])
    best = both.groupBy(*keys).agg(F.min_by(F.struct("low", "high", "n", "mean", "sd"), F.struct(F.col("high") - F.col("low"), "low")).alias("b"))
    r = lambda c: F.round(c, digits)
    return best.select(*keys, r("b.mean").alias("mean"), r("b.sd").alias("sd"), r("b.low").alias("hdi_low"), r("b.high").alias("hdi_high"))


# ---- rank-normalised split R-hat and effective sample sizes (published definitions)


def _normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse normal distribution function."""
    from statistics import NormalDist

    nd = NormalDist()
    return np.array([nd.inv_cdf(float(x)) for x in p]) if len(p) else p


def _split(x: np.ndarray) -> np.ndarray:
    h = x.shape[1] // 2
    return np.vstack([x[:, :h], x[:, -h:]])


def _ranks(x: np.ndarray) -> np.ndarray:
    flat = x.ravel()
    u, inv, n = np.unique(flat, return_inverse=True, return_counts=True)
    mid = np.cumsum(n) - (n - 1) / 2
    return _normal_quantile((mid[inv] - 0.375) / (flat.size + 0.25)).reshape(x.shape)


def _rhat(x: np.ndarray) -> float:
    n = x.shape[1]
    within = x.var(axis=1, ddof=1).mean()
    between = n * x.mean(axis=1).var(ddof=1)
    return float(np.sqrt(((n - 1) / n * within + between / n) / within)) if within > 0 else 1.0


def _ess(x: np.ndarray) -> float:
    """Effective size from the initial monotone sequence of autocorrelation pairs over all (split) chains."""
    m, n = x.shape
    c = x - x.mean(axis=1, keepdims=True)
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(c, size, axis=1)
    acov = np.fft.irfft(f * np.conj(f), size, axis=1)[:, :n] / n
    var = acov[:, 0] * n / (n - 1)
    w = var.mean()
    plus = w * (n - 1) / n + (x.mean(axis=1).var(ddof=1) if m > 1 else 0.0)
    if plus <= 0:
        return float(m * n)
    rho = 1 - (w - acov.mean(axis=0) * n / (n - 1)) / plus
    rho[0] = 1.0
    pairs = rho[: n - n % 2].reshape(-1, 2).sum(axis=1)
    stop = np.flatnonzero(pairs <= 0)
    pairs = np.minimum.accumulate(pairs[: stop[0]] if len(stop) else pairs)
    tau = max(-1 + 2 * pairs.sum(), 1 / np.log10(m * n))
    return float(min(m * n / tau, m * n * np.log10(m * n)))


def diagnose(x: np.ndarray) -> dict[str, float]:
    """Of draws [chains, draws]."""
    s = _split(x)
    fold = np.abs(s - np.median(s))
    lo, hi = np.quantile(x, [0.05, 0.95])
    med = np.median(x)
    ess_median = _ess((s <= med).astype(float))
    a = np.sort(x.ravel())
    # standard error of the median from the quantiles of the Beta distribution, normal approximation
    p = 0.5 + np.array([-1, 1]) * 0.5 / np.sqrt(max(ess_median, 1) + 3)
    k = np.clip((p * len(a)).astype(int), 0, len(a) - 1)
    return {
        "r_hat": max(_rhat(_ranks(s)), _rhat(_ranks(fold))), "ess_bulk": _ess(_ranks(s)), "ess_median": ess_median,
        "ess_tail": min(_ess((s <= lo).astype(float)), _ess((s <= hi).astype(float))), "mcse_median": float((a[k[1]] - a[k[0]]) / 2),
    }


def diagnostics(draws: DataFrame, keys: list[str]) -> DataFrame:
    """R-hat, effective sizes and the error of the median per key. A key's draws (chains x draws, a few thousand numbers) form one group."""
    types = dict(draws.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="chain", columns="draw", values="value", aggfunc="first").to_numpy()
        wide = wide[:, ~np.isnan(wide).any(axis=0)]
        head = {k: [pdf[k].iloc[0]] for k in keys}
        if wide.shape[1] < 4:
            return pd.DataFrame(head | {c: [None] for c in ("r_hat", "ess_bulk", "ess_median", "ess_tail", "mcse_median")})
        return pd.DataFrame(head | {k: [v] for k, v in diagnose(wide).items()})

    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", r_hat double, ess_bulk double, ess_median double, ess_tail double, mcse_median double"
    return draws.groupBy(*keys).applyInPandas(one, schema)


def worst(diag: DataFrame, draws: DataFrame | None = None) -> DataFrame:
    """Greatest R-hat, least effective sizes and, from the sampler's draws, the number of divergent transitions."""
    out = diag.agg(F.max("r_hat").alias("max_r_hat"), F.min("ess_bulk").alias("min_ess_bulk"), F.min("ess_tail").alias("min_ess_tail"))
    if draws is None:
        return out
    return out.join(F.broadcast(draws.where("param = 'diverging'").agg(F.coalesce(F.sum("value"), F.lit(0.0)).cast("long").alias("n_divergences"))))  # one row each
