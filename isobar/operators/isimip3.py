"""Trend-preserving quantile mapping per calendar month, non-parametric and parametric."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.functions.dist import betainc, family, kolmogorov, quantile
from isobar.functions.quantile import average_ties, interpolate, literal
from isobar.operators.native import fresh


@dataclass(frozen=True)
class Preset:
    """Bounds with thresholds, family, trend kind and switches of a variable."""

    lower: tuple[float, float] | None = None
    upper: tuple[float, float] | None = None
    family: str | None = "normal"
    trend: str = "additive"
    detrend: bool = False
    adjust_p: bool = True
    half_window: int = 0


# Settings per variable.
PRESETS = {
    "hurs": Preset((0, 0.01), (100, 99.99), "beta", "bounded"),
    "pr": Preset((0, 0.1), None, "gamma", "mixed"),
    "prsnratio": Preset((0, 0.0001), (1, 0.9999), "beta", "bounded"),
    "psl": Preset(None, None, "normal", "additive", True),
    "rlds": Preset(None, None, "normal", "additive", True),
    "rsds": Preset((0, 0.0001), (1, 0.9999), "beta", "bounded", half_window=15),
    "sfcWind": Preset((0, 0.01), None, "weibull", "mixed"),
    "tas": Preset(None, None, "normal", "additive", True, False),
    "tasrange": Preset((0, 0.01), None, "rice", "mixed"),
    "tasskew": Preset((0, 0.0001), (1, 0.9999), "beta", "bounded"),
}


def transfer_change_column(obs: Column, hist: Column, fut: Column, lower: float = 0.0, upper: float = 1.0) -> Column:
    """Bounded transfer of a simulated change onto an observed value, as an expression."""
    up = F.when(hist >= upper, upper).otherwise(upper - (upper - obs) * F.try_divide(upper - fut, upper - hist))
    down = F.when(hist <= lower, lower).otherwise(lower + (obs - lower) * F.try_divide(fut - lower, hist - lower))
    both = (obs < hist) & (fut >= hist) | (obs > hist) & (fut <= hist) | (obs == hist)
    value = F.when((obs < hist) & (fut < hist), down).when((obs > hist) & (fut > hist), up).when(both, obs + fut - hist)
    return F.least(F.lit(upper), F.greatest(F.lit(lower), value))


def transfer_change(o, h, f, lower=0.0, upper=1.0) -> np.ndarray:
    """The same, in numpy."""
    o, h, f = np.broadcast_arrays(*(np.asarray(x, float) for x in (o, h, f)))
    with np.errstate(all="ignore"):
        up = np.where(h >= upper, upper, upper - (upper - o) * (upper - f) / (upper - h))
        down = np.where(h <= lower, lower, lower + (o - lower) * (f - lower) / (h - lower))
    value = np.where((o < h) & (f < h), down, np.where((o > h) & (f > h), up, o + f - h))
    return np.clip(value, lower, upper)


def map_constant(x, q_sim, q_obs) -> np.ndarray:
    """Interpolate quantile pairs; beyond the ends keep the end's offset."""
    y = np.interp(x, q_sim, q_obs)
    return np.where(x > q_sim[-1], x + q_obs[-1] - q_sim[-1], np.where(x < q_sim[0], x + q_obs[0] - q_sim[0], y))


def map_by_rank(x, y) -> np.ndarray:
    """Give x the distribution of y by average rank."""
    if len(x) == 0 or len(np.unique(y)) < 2:
        return x
    order = np.sort(x)
    rank = (np.searchsorted(order, x, "left") + np.searchsorted(order, x, "right") - 1) / 2
    return np.interp(rank / len(x), np.linspace(0, 1, len(y)), np.sort(y))


def map_trend(o, h, f, kind="additive", n=50, max_change=100.0, max_adjust=9.0, onto_obs=False, lower=None, upper=None) -> np.ndarray:
    """Quantile map that keeps the simulated change; ``onto_obs`` puts the change on the observations.

    Each value's share among its own quantiles gives the observed, historical and future quantile whose
    change is transferred. The mixed kind is multiplicative where the simulation is not below the
    observation, and passes over to additive as it falls to a ``max_adjust``-th of it.
    """
    k = min(n + 1, len(o), len(h), len(f))
    if k < 2:
        return o.copy() if onto_obs else f.copy()
    share = np.linspace(0, 1, k)
    qo, qh, qf = quantile(o, share), quantile(h, share), quantile(f, share)
    p = np.interp(o, qo, share) if onto_obs else np.interp(f, qf, share)
    vo, vh, vf = (np.interp(p, share, q) for q in (qo, qh, qf))
    add = vo + vf - vh
    if kind == "bounded":
        return transfer_change(vo, vh, vf, lower, upper)
    if kind == "additive":
        return add
    with np.errstate(all="ignore"):
        change = np.where(vh == 0, 1.0, vf / np.where(vh == 0, 1, vh))
    mult = vo * np.clip(change, 1 / max_change, max_change)
    if kind == "multiplicative":
        return mult
    weight = (vh >= vo).astype(float)
    part = (vh < vo) & (vo < max_adjust * vh)
    weight[part] = 0.5 * (1 + np.cos((vo[part] / vh[part] - 1) * np.pi / (max_adjust - 1)))
    return weight * mult + (1 - weight) * add


def trend_map(train: DataFrame, sim: DataFrame, keys: list[str], kind: str = "additive", n: int = 50, max_change: float = 100.0, max_adjust: float = 9.0) -> DataFrame:
    """map_trend of every series' target values, as expressions: sim's rows with ``corrected``."""
    share = literal([i / n for i in range(n + 1)])
    q = train.groupBy(*keys).agg(F.percentile("o", share).alias("qo"), F.percentile("p", share).alias("qh")).join(sim.groupBy(*keys).agg(F.percentile("s", share).alias("qf")), keys)
    q = q.withColumn("at", average_ties(F.col("qf"), share))
    at = sim.join(q, keys).withColumn("share", interpolate(F.col("s"), F.col("qf"), F.col("at")))
    vo, vh, vf = (interpolate(F.col("share"), share, F.col(c)) for c in ("qo", "qh", "qf"))
    rows = at.select(*sim.columns, vo.alias("vo"), vh.alias("vh"), vf.alias("vf"))
    o, h, f = F.col("vo"), F.col("vh"), F.col("vf")
    add, mult = o + f - h, o * F.greatest(F.lit(1 / max_change), F.least(F.lit(max_change), F.when(h == 0, 1.0).otherwise(F.try_divide(f, h))))
    part = 0.5 * (1 + F.cos((F.try_divide(o, h) - 1) * (np.pi / (max_adjust - 1))))
    weight = F.when(h >= o, 1.0).when(o < max_adjust * h, part).otherwise(0.0)
    value = {"additive": add, "multiplicative": mult, "mixed": weight * mult + (1 - weight) * add}[kind]
    return rows.select(*sim.columns, value.alias("corrected"))


def odds_transfer(x, y, z) -> np.ndarray:
    """Probabilities x moved by the odds ratio of z to y, kept within a decade of x's odds, in z's order."""
    at = np.linspace(0, 1, len(z))
    x, y = (np.interp(at, np.linspace(0, 1, len(v)), np.sort(v)) for v in (x, y))
    s = np.sort(z)
    with np.errstate(all="ignore"):
        odds = x / (1 - x)
        moved = np.clip(odds * (s / (1 - s)) / (y / (1 - y)), odds / 10, odds * 10)
    p = moved / (1 + moved)
    return p[np.argsort(np.argsort(z, kind="stable"), kind="stable")]


def trend_of(x, years):
    """Deviation of each year's fitted annual mean from the middle, if the slope is significant at 5 %."""
    u, inverse = np.unique(years, return_inverse=True)
    if len(u) < 3:
        return np.zeros(len(x))
    m = np.bincount(inverse, x) / np.bincount(inverse)
    b, a = np.polyfit(u - u.mean(), m, 1)
    left = ((m - a - b * (u - u.mean())) ** 2).sum()
    dof = len(u) - 2
    t2 = b * b * ((u - u.mean()) ** 2).sum() / (left / dof) if left > 0 else np.inf
    p = float(betainc(dof / 2, 0.5, dof / (dof + t2))) if np.isfinite(t2) else 0.0
    return (b * (u - u.mean()))[inverse] if p < 0.05 else np.zeros(len(x))


def censor(x, preset: Preset, rng, power=1.0):
    """Spread values beyond a threshold over (bound, threshold), keeping ranks (ties at random)."""
    x = x.copy()
    for pair, low in ((preset.lower, True), (preset.upper, False)):
        if pair is None:
            continue
        bound, thr = pair
        at = np.nonzero(x < thr if low else x > thr)[0]
        if len(at):
            draws = np.sort(bound + rng.uniform(0, 1, len(at)) ** power * (thr - bound))
            x[at[np.lexsort((rng.uniform(size=len(at)), x[at]))]] = draws
    return x


def uncensor(x, preset: Preset):
    """Set values beyond a threshold to its bound."""
    if preset.lower:
        x = np.where(x < preset.lower[1], preset.lower[0], x)
    if preset.upper:
        x = np.where(x > preset.upper[1], preset.upper[0], x)
    return x


def fill_invalid(x, rng, fallback=np.nan):
    """Missing values drawn from the valid quantiles, ordered like their neighbours' interpolation."""
    bad = ~np.isfinite(x)
    if not bad.any():
        return x
    x = x.copy()
    if bad.all():
        x[:] = fallback
        return x
    draws = np.sort(quantile(x[~bad], rng.uniform(size=bad.sum())))
    near = np.interp(np.nonzero(bad)[0], np.nonzero(~bad)[0], x[~bad])
    x[np.nonzero(bad)[0][np.argsort(near, kind="stable")]] = draws
    return x


def upper_climatology(x, doy, half: int) -> np.ndarray:
    """Upper bound of each value's day of year (1 to 366): grid.circular_mean_max of one series."""
    top, ok = np.full(366, -np.inf), np.isfinite(x)
    np.maximum.at(top, doy[ok] - 1, x[ok])
    near = (np.arange(366)[:, None] + np.arange(-half, half + 1)) % 366
    ran = top[near].max(axis=1)[near]
    n = np.isfinite(ran).sum(axis=1)
    mean = np.where(np.isfinite(ran), ran, 0.0).sum(axis=1) / np.maximum(n, 1)
    return np.where(n > 0, mean, np.nan)[doy - 1]


def _share(x, bound) -> np.ndarray:
    """x / bound; 0 where the bound is 0."""
    return np.divide(x, bound, out=np.where(np.isfinite(x), 0.0, np.nan), where=bound != 0)


def _leap_doy(t) -> np.ndarray:
    """Day of year as in a leap year, the same calendar day every year."""
    return (t.dayofyear + ((t.month > 2) & ~t.is_leap_year)).to_numpy()


def _fit(x, preset: Preset):
    """Fit of values on the open range, as (family, params, shift, scale); None if it is poor."""
    f = family(preset.family)
    shift = preset.lower[1] if preset.lower else 0.0
    scale = preset.upper[1] - shift if preset.lower and preset.upper else 1.0
    z = (x - shift) / scale
    if preset.family == "beta":
        z = np.clip(z, 1e-9, 1 - 1e-9)
    params = f.fit(z)
    if params is None or not np.isfinite(params).all() or kolmogorov(z, f, params) > 0.5:
        return None
    return f, params, shift, scale


def map_parametric(o, h, f, preset: Preset, n=50, p_eps=1e-10) -> np.ndarray:
    """Distribution-based map of f, with the threshold frequencies and the change carried over."""
    low, high = preset.lower, preset.upper
    inside = lambda x: (x > low[1] if low else True) & (x < high[1] if high else True) & np.ones(len(x), bool)
    lb, ub = (low[0] if low else None), (high[0] if high else None)
    t = map_trend(o, h, f, preset.trend, n, onto_obs=True, lower=lb, upper=ub)
    out = f.copy()
    io, ih, if_, it = inside(o), inside(h), inside(f), inside(t)
    if low or high:
        def share(x, cond):
            return float(cond(x).mean())

        sides = []
        if low:
            below = lambda x: x <= low[1]
            sides.append(("low", float(transfer_change(share(o, below), share(h, below), share(f, below)))))
        if high:
            over = lambda x: x >= high[1]
            sides.append(("high", float(transfer_change(share(o, over), share(h, over), share(f, over)))))
        total = sum(v for _, v in sides)
        sides = [(k, v / total if total > 1 else v) for k, v in sides]
        keep = np.ones(len(f), bool)
        for k, v in sides:
            cut = quantile(f, v if k == "low" else 1 - v)
            beyond = (f <= cut) if k == "low" else (f >= cut)
            beyond &= v > 0
            out[beyond] = low[0] if k == "low" else high[0]
            keep &= ~beyond
    else:
        keep = np.ones(len(f), bool)
    source, target = f[keep], t[it]
    if not len(source):
        return out
    if len(target) < 2:
        return out
    body = f[if_]
    source = map_by_rank(source, body) if (low or high) and len(body) > 1 else source
    ff, ft = _fit(body if len(body) > 1 else source, preset), _fit(target, preset)
    if ff is None or ft is None:
        q = np.linspace(0, 1, min(n + 1, len(source), len(target)))
        out[keep] = map_constant(source, quantile(source, q), quantile(target, q))
        return out
    fam, par, shift, scale = ff
    p = np.clip(fam.cdf((source - shift) / scale, *par), p_eps, 1 - p_eps)
    if preset.adjust_p:
        fo, fh = (_fit(x[m], preset) if m.sum() > 1 else None for x, m in ((o, io), (h, ih)))
        if fo is not None and fh is not None:
            po, ph = (np.clip(g[0].cdf((x - g[2]) / g[3], *g[1]), p_eps, 1 - p_eps) for g, x in ((fo, o[io]), (fh, h[ih])))
            p = np.clip(odds_transfer(po, ph, p), p_eps, 1 - p_eps)
    out[keep] = ft[0].ppf(p, *ft[1]) * ft[3] + ft[2]
    return out


def adjust_month(o, h, f, years_o, years_h, years_f, preset: Preset, rng, n=50, fallback=np.nan) -> np.ndarray:
    """All steps for one calendar month of one series."""
    o, h, f = (fill_invalid(x, rng, fallback) for x in (o, h, f))
    trends = [np.zeros(len(x)) for x in (o, h, f)]
    if preset.detrend:
        trends = [trend_of(x, y) for x, y in ((o, years_o), (h, years_h), (f, years_f))]
    o, h, f = (x - d for x, d in zip((o, h, f), trends, strict=True))
    o, h, f = (censor(x, preset, rng) for x in (o, h, f))
    if preset.family is None:
        lb, ub = (preset.lower[0] if preset.lower else None), (preset.upper[0] if preset.upper else None)
        target = map_trend(o, h, f, preset.trend, n, onto_obs=True, lower=lb, upper=ub)
        q = np.linspace(0, 1, min(n + 1, len(f), len(target)))
        out = map_constant(f, quantile(f, q), quantile(target, q))
    else:
        out = map_parametric(o, h, f, preset, n)
    out = uncensor(out, preset) + trends[2]
    if not np.isfinite(out).all():
        raise ValueError("the correction gave infinite or missing values")
    return out


def correct(train: DataFrame, sim: DataFrame, keys: list[str], preset: Preset | str = "tas", n_quantiles: int = 50, seed: int = 1) -> DataFrame:
    """Apply the monthly correction to every series; missing inputs are filled by sampling.

    A month with no valid value on one side gives null. With a half window the values are corrected as
    shares of their upper-bound climatology, and multiplied by the simulation's own afterwards.
    """
    preset = PRESETS[preset] if isinstance(preset, str) else preset
    for pair, good in ((preset.lower, lambda b, t: b < t), (preset.upper, lambda b, t: t < b)):
        if pair and not good(*pair):
            raise ValueError("a threshold lies inside its bound")
    allowed = {"normal": (False, False), "weibull": (True, False), "gamma": (True, False), "rice": (True, False), "beta": (True, True)}
    if preset.family in allowed and allowed[preset.family] != (preset.lower is not None, preset.upper is not None):
        raise ValueError(f"bounds don't suit {preset.family}")

    def group(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("t", kind="stable").reset_index(drop=True)
        out = np.full(len(b), np.nan)
        if len(a) and len(b):
            a = a.sort_values("t", kind="stable")
            ta, tb = pd.to_datetime(a["t"]).dt, pd.to_datetime(b["t"]).dt
            o, h, f = a["o"].to_numpy(dtype=float), a["p"].to_numpy(dtype=float), b["s"].to_numpy(dtype=float)
            if preset.half_window:
                da, db = _leap_doy(ta), _leap_doy(tb)
                bound = upper_climatology(f, db, preset.half_window)
                o, h, f = _share(o, upper_climatology(o, da, preset.half_window)), _share(h, upper_climatology(h, da, preset.half_window)), _share(f, bound)
            for m in range(1, 13):
                x, y = (ta.month == m).to_numpy(), (tb.month == m).to_numpy()
                if y.any() and np.isfinite(o[x]).any() and np.isfinite(h[x]).any() and np.isfinite(f[y]).any():
                    rng = np.random.default_rng([seed, m, zlib.crc32(repr(tuple(key)).encode())])
                    out[y] = adjust_month(o[x], h[x], f[y], ta.year.to_numpy()[x], ta.year.to_numpy()[x], tb.year.to_numpy()[y], preset, rng, n_quantiles)
            if preset.half_window:
                out *= bound
        b["corrected"] = pd.Series(out).where(np.isfinite(out), None).astype(object)
        return b

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sim.schema) + ", corrected double"
    return fresh(train).groupBy(*keys).cogroup(fresh(sim).groupBy(*keys)).applyInPandas(group, schema)


def rotation(n: int, rng) -> np.ndarray:
    """A random orthogonal matrix, uniformly distributed."""
    q, r = np.linalg.qr(rng.normal(size=(n, n)))
    return q * np.sign(np.diag(r))


def rotation_with_axis(v, transpose: bool = False) -> np.ndarray:
    """An orthogonal matrix whose first row (or column) is along v."""
    v = np.asarray(v, float)
    q, r = np.linalg.qr(np.column_stack((v, np.eye(len(v))[:, : len(v) - 1] + 1e-12 * np.arange(len(v))[:, None])))
    q = q * np.sign(np.diag(r))
    return q if transpose else q.T


def adjust_copula(o, h, f, rotations, n: int = 50, margins=None):
    """Multivariate ranks: rotate, map each axis with its trend, rotate back, and reorder the margins (f's own by default)."""
    from statistics import NormalDist

    inv = np.vectorize(NormalDist().inv_cdf)

    def scores(x):
        r = np.argsort(np.argsort(x, axis=0, kind="stable"), axis=0, kind="stable")
        return inv((r + 0.5) / len(x))

    zo, zh, zf = scores(o), scores(h), scores(f)
    for m in rotations:
        ro, rh, rf = zo @ m, zh @ m, zf @ m
        for j in range(ro.shape[1]):
            p = np.linspace(0, 1, min(n + 1, len(ro), len(rh)))
            qh, qo = quantile(rh[:, j], p), quantile(ro[:, j], p)
            new_f = map_trend(ro[:, j], rh[:, j], rf[:, j], "additive", n)
            rh[:, j], rf[:, j] = map_constant(rh[:, j], qh, qo), new_f
        zh, zf = rh @ m.T, rf @ m.T
    ranks = np.argsort(np.argsort(zf, axis=0, kind="stable"), axis=0, kind="stable")
    return np.take_along_axis(np.sort(f if margins is None else margins, axis=0), ranks, axis=0)


def correct_copula(train: DataFrame, sim: DataFrame, keys: list[str], rotations: int = 20, n_quantiles: int = 50, seed: int = 1) -> DataFrame:
    """Correct the dependence between variables, per calendar month and location.

    ``train`` has keys, t, var, o and p, ``sim`` keys, t, var, s and ``corrected``, the margins of another
    correction. Only the order of each margin changes: every month keeps each variable's values. Days on
    which a variable is missing take no part and keep their values, as do months with fewer than two days
    on a side and locations without training rows. All locations and months share the rotations, drawn by the seed.
    """

    def paired(x: pd.DataFrame, names: list, columns: tuple[str, str]) -> list[pd.DataFrame]:
        both = x.pivot_table(index="t", columns="var", values=list(columns), aggfunc="first").replace([np.inf, -np.inf], np.nan)
        wanted = [(c, v) for c in columns for v in names]
        both = both.reindex(columns=pd.MultiIndex.from_tuples(wanted)).dropna().sort_index()
        return [both[c] for c in columns]

    def group(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = sorted(b["var"].dropna().unique())
        if not len(a) or len(names) < 2:
            return b
        b = b.reset_index(drop=True)
        (o, h), (f, margin) = paired(a, names, ("o", "p")), paired(b, names, ("s", "corrected"))
        month = lambda x: pd.to_datetime(pd.Series(x.index)).dt.month.to_numpy()
        axes = [rotation(len(names), rng) for rng in [np.random.default_rng(seed)] for _ in range(rotations)]
        new = {}
        for m in range(1, 13):
            x, y = month(o) == m, month(f) == m
            if x.sum() < 2 or y.sum() < 2:
                continue
            out = adjust_copula(o[x].to_numpy(), h[x].to_numpy(), f[y].to_numpy(), axes, n_quantiles, margin[y].to_numpy())
            new |= {(t, v): float(out[r, c]) for r, t in enumerate(f.index[y]) for c, v in enumerate(names)}
        b["corrected"] = [new.get((t, v), c) for t, v, c in zip(b["t"], b["var"], b["corrected"], strict=True)]
        return b

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sim.schema)
    return fresh(train).groupBy(*keys).cogroup(fresh(sim).groupBy(*keys)).applyInPandas(group, schema)
