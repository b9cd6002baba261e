"""Bias correction that fits or simulates per series, in grouped Arrow batches.

A series is one group; its training and target values meet in one cogrouped frame. Random steps draw
from a generator seeded by the seed and the series key, so results don't depend on partitioning.
Missing values are skipped; a series without observed or modelled values gives null.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from isobar.functions.dist import family, interp_ties, quantile
from isobar.operators.native import fresh

SQRT_EPS = float(np.sqrt(np.finfo(float).eps))


def adjust_frequency(o: np.ndarray, p: np.ndarray, threshold: float, rng) -> tuple[int, float, np.ndarray]:
    """Match the model's dry share to the observed one: (dry values, wet threshold, adjusted p in order of p).

    Where the model is too dry, the values between its dry number and its values below the threshold
    become small rain: gamma draws fitted to the observed values that follow the observed dry ones, up to
    the same share of the series (more than six distinct values), or their mean.
    """
    n_dry_o = int((o < threshold).sum())
    n_dry = int(np.ceil(len(p) * n_dry_o / len(o)))
    order = np.argsort(p, kind="stable")
    s = p[order].copy()
    around = s[max(n_dry - 1, 0) : n_dry + 1]
    wet_from = float(around.max()) if len(around) else np.nan
    below = int((s < threshold).sum())
    if n_dry < below:
        band = np.sort(o)[n_dry_o : int(np.ceil(len(o) * below / len(p)))]
        if len(np.unique(band)) > 6 and (fit := family("gamma").fit(band)) is not None:
            s[n_dry:below] = rng.gamma(fit[0], 1 / fit[1], below - n_dry)
        elif len(band):
            s[n_dry:below] = band.mean()
        s = np.sort(s)
    s[:n_dry] = 0.0
    out = np.empty_like(s)
    out[order] = s
    return n_dry, wet_from, out


def eqm(o, p, s, threshold, rng, n_quantiles=None, extrapolation="none"):
    """Empirical quantile mapping of wet values after the frequency step."""
    n_dry, wet_from, p = adjust_frequency(o, p, threshold, rng)
    wo, wp = o[o > threshold], p[p > wet_from]
    if not len(wp) or not len(wo):
        return s
    n = n_quantiles or len(p)
    tau = np.linspace(1 / n, 1 - 1 / n, n)
    qo, qp = quantile(wo, tau), quantile(wp, tau)
    out = np.zeros_like(s)
    floor = wp.min()
    big = s > floor
    out[big] = interp_ties(s[big], qp, qo)
    if extrapolation == "constant":
        high, low = big & (s > qp[-1]), big & (s < qp[0])
        out[high], out[low] = s[high] + (qo[-1] - qp[-1]), s[low] + (qo[0] - qp[0])
    small = (s > wet_from) & (s <= floor)
    if small.any():
        share = np.searchsorted(np.sort(s[s > wet_from]), s[small], "right") / max(1, (s > wet_from).sum())
        out[small] = quantile(out[big], share, 4) if big.any() else 0.0
    out[np.isnan(s)] = np.nan
    return out


def pqm(o, p, s, threshold, rng, family_name="normal", precipitation=False):
    """Map through fitted distributions; unchanged where there is no fit."""
    f = family(family_name)
    out = np.zeros_like(s) if precipitation else s.copy()
    wet_s = ~np.isnan(s)
    if precipitation:
        _, wet_from, p = adjust_frequency(o, p, threshold, rng)
        o, p = o[o > threshold], p[p > 0]
        wet_s = s > wet_from
        if not len(o):
            return s
    fo, fp = f.fit(o), f.fit(p)
    if fo is None or fp is None:
        return s
    out[wet_s] = f.ppf(f.cdf(s[wet_s], *fp), *fo)
    out[np.isnan(s)] = np.nan
    return out


def _tail(o, p, s, at_o, at_p):
    """Map values over a threshold through generalised Pareto fits of the excesses."""
    g = family("gpd")
    fo, fp = g.fit(o[o > at_o] - at_o), g.fit(p[p > at_p] - at_p)
    if fo is None or fp is None:
        return np.full(len(s), np.nan)
    q = g.cdf(s - at_p, *fp)
    return np.where(q >= 1, o.max(), np.where(q <= 0, at_o, g.ppf(np.clip(q, 0, 1 - 1e-12), *fo) + at_o))


def gpqm(o, p, s, threshold, rng, theta=(0.95, 0.05), precipitation=False):
    """Body by normal (gamma for precipitation) maps, tails by generalised Pareto maps."""
    out = np.full(len(s), np.nan)
    ok = ~np.isnan(s)
    if not precipitation:
        hi_o, lo_o, hi_p, lo_p = quantile(o, theta[0]), quantile(o, theta[1]), quantile(p, theta[0]), quantile(p, theta[1])
        n = family("normal")
        fo, fp = n.fit(o), n.fit(p)
        if fo is None or fp is None:
            return out
        body, up, down = ok & (s <= hi_p) & (s >= lo_p), ok & (s > hi_p), ok & (s < lo_p)
        out[body] = n.ppf(n.cdf(s[body], *fp), *fo)
        out[up] = _tail(o, p, s[up], hi_o, hi_p)
        out[down] = -_tail(-o, -p, -s[down], -lo_o, -lo_p)
        return out
    _, wet_from, p = adjust_frequency(o, p, threshold, rng)
    wo, wp, wet = o[o > threshold], p[p > 0], ok & (s > wet_from)
    out[ok] = 0.0
    if len(wo) < 4 or len(wp) < 4:
        return out
    hi_o, hi_p = quantile(wo, theta[0]), quantile(wp, theta[0])
    gam, gpd = family("gamma"), family("gpd")
    fo, fp = gam.fit(wo[wo <= hi_o]), gam.fit(wp[wp <= hi_p])
    body, up = wet & (s <= hi_p), wet & (s > hi_p)
    if fo is None or fp is None:
        out[wet] = np.nan
    else:
        out[body] = gam.ppf(gam.cdf(s[body], *fp), *fo)
    go, gp = gpd.fit(wo[wo > hi_o]), gpd.fit(wp[wp > hi_p])  # location 0, as the method is defined
    if go is None or gp is None:
        out[up] = np.nan
    else:
        q = gpd.cdf(s[up], *gp)
        out[up] = np.where(q >= 1, wo.max(), gpd.ppf(np.clip(q, 0, 1 - 1e-12), *go))
    return np.where(out > 1e3, np.nan, out)


def ptr(o, p, s):
    """Power transformation: the exponent that gives the modelled values the observed variation."""

    def cv(x):
        return x.std(ddof=1) / x.mean() if len(x) > 1 and x.mean() else np.nan

    goal = cv(o)

    def gap(b):
        return cv(np.abs(p) ** b) - goal

    lo, hi = 0.0, 1.0
    with np.errstate(all="ignore"):
        a, c = gap(lo), gap(hi)
        for _ in range(40):
            if not np.isfinite([a, c]).all() or a * c <= 0:
                break
            hi *= 1.5
            c = gap(hi)
        if not np.isfinite([a, c]).all() or a * c > 0:
            return np.full(len(s), np.nan)
        for _ in range(100):
            mid = (lo + hi) / 2
            m = gap(mid)
            if a * m <= 0:
                hi = mid
            else:
                lo, a = mid, m
        b = (lo + hi) / 2
        p, s = np.maximum(p, 0), np.maximum(s, 0)
        return s**b * (o.mean() / (p**b).mean())


def _fill_zero(x, threshold, rng):
    return np.where(x < threshold, rng.uniform(SQRT_EPS, threshold, len(x)), x)


def dqm(o, p, s, threshold, rng, n_quantiles=None, detrend=True, precipitation=False):
    """Detrended quantile mapping; precipitation is multiplicative with dry values made small and random."""
    if precipitation:
        o, p, s = (_fill_zero(x, threshold, rng) for x in (o, p, s))
    mo, mp = o.mean(), p.mean()
    x = s / mp * mo if precipitation else s - mp + mo
    ok = ~np.isnan(x)
    trend = np.full(len(x), mo)
    if detrend and ok.sum() > 1:
        i = np.arange(1, ok.sum() + 1)
        b, a = np.polyfit(i, x[ok], 1)
        trend[ok] = a + b * i
    n = n_quantiles or max(len(o), len(p))
    tau = np.concatenate(([0.0], np.arange(1, n + 1) / (n + 1), [1.0]))
    if precipitation:
        qo, qp, z = quantile(o / mo, tau), quantile(p / mp, tau), x / trend
    else:
        qo, qp, z = quantile(o - mo, tau), quantile(p - mp, tau), x - trend
    y = interp_ties(z, qp, qo)
    low, high = z < qp[0], z > qp[-1]
    if precipitation:
        y[low] = (qo[0] / qp[0] * z)[low] if o.min() >= SQRT_EPS else qo[0]
        y[high] = (qo[-1] / qp[-1] * z)[high]
        y = y * trend
        return np.where(y < SQRT_EPS, 0.0, y)
    y[low], y[high] = (z + qo[0] - qp[0])[low], (z + qo[-1] - qp[-1])[high]
    return y + trend


def qdm(o, p, s, threshold, rng, n_quantiles=None, jitter=0.01, precipitation=False):
    """Quantile delta mapping with jitter."""

    def shake(x):
        gaps = np.diff(np.unique(np.round(x[~np.isnan(x)], 6)))
        return x + rng.uniform(-1, 1, len(x)) * jitter * (gaps.min() if len(gaps) else 1.0) / 5

    if jitter:
        o, p, s = shake(o), shake(p), shake(s)
    if precipitation:
        o, p, s = (_fill_zero(x, threshold, rng) for x in (o, p, s))
    n = max(len(o), len(p), len(s))
    tau = np.linspace(1 / (n + 1), n / (n + 1), n_quantiles or n)
    qo, qp, qs = (quantile(x, tau, 6) for x in (o, p, s))
    at = interp_ties(s, qs, tau)
    base, model = np.interp(at, tau, qo), np.interp(at, tau, qp)
    if not precipitation:
        return base + (s - model)
    y = base * s / model
    return np.where(y < threshold, 0.0, y)


def _run(method, o, p, s, precipitation, threshold, rng, options):
    if method == "ptr":
        return ptr(o, p, s)
    if method == "eqm":
        return eqm(o, p, s, threshold, rng, options.get("n_quantiles"), options.get("extrapolation", "none"))
    if method == "pqm":
        return pqm(o, p, s, threshold, rng, options.get("family", "normal"), precipitation)
    if method == "gpqm":
        return gpqm(o, p, s, threshold, rng, options.get("theta", (0.95, 0.05)), precipitation)
    if method == "dqm":
        return dqm(o, p, s, threshold, rng, options.get("n_quantiles"), options.get("detrend", True), precipitation)
    return qdm(o, p, s, threshold, rng, options.get("n_quantiles"), options.get("jitter", 0.01), precipitation)


def correct(train: DataFrame, sim: DataFrame, keys: list[str], method: str, precipitation: bool = False, threshold: float = 1.0, seed: int = 1, **options) -> DataFrame:
    """Apply a kernel per series: sim's rows with ``corrected``."""
    if method == "ptr" and not precipitation:
        raise ValueError("power transformation is for precipitation")

    def group(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("t", kind="stable").reset_index(drop=True)
        o, p, s = (x.to_numpy(dtype=float) for x in (a["o"], a["p"], b["s"]))
        o, p = o[~np.isnan(o)], p[~np.isnan(p)]
        out = np.full(len(s), np.nan)
        if len(o) and len(p) and len(s):
            rng = np.random.default_rng([seed, zlib.crc32(repr(tuple(key)).encode())])
            with np.errstate(all="ignore"):
                out = _run(method, o, p, s, precipitation, threshold, rng, options)
        b["corrected"] = pd.array(np.where(np.isfinite(out), out, np.nan), dtype="float64")
        b["corrected"] = b["corrected"].astype(object).where(np.isfinite(out), None)
        return b

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sim.schema) + ", corrected double"
    return fresh(train).groupBy(*keys).cogroup(fresh(sim).groupBy(*keys)).applyInPandas(group, schema)
