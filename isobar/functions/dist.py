"""Distributions in numpy: cdf, ppf and maximum-likelihood fits (no external solver).

Regularised incomplete gamma and beta functions come from their series and continued fractions;
quantiles from bracketed bisection; fits without a closed form from a simplex search.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erf = np.vectorize(math.erf, otypes=[float])


def gammainc(a, x) -> np.ndarray:
    """Regularised lower incomplete gamma P(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.where(x <= 0, 0.0, np.where(np.isinf(x), 1.0, np.nan))
    ok = (x > 0) & np.isfinite(x) & (a > 0)
    aa, xx = a[ok], x[ok]
    front = np.exp(aa * np.log(xx) - xx - _lgamma(aa)) if len(aa) else aa
    series = xx < aa + 1
    res = np.empty_like(xx)
    if series.any():
        s, y = aa[series], xx[series]
        term = total = 1 / s
        for n in range(1, 1000):
            term = term * y / (s + n)
            total = total + term
            if (np.abs(term) < np.abs(total) * 1e-16).all():
                break
        res[series] = total * front[series]
    if (~series).any():
        s, y = aa[~series], xx[~series]
        b = y + 1 - s
        c, d = np.full_like(y, 1e300), 1 / b
        h = d
        for i in range(1, 1000):
            an = -i * (i - s)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            step = d * c
            h = h * step
            if (np.abs(step - 1) < 1e-15).all():
                break
        res[~series] = 1 - front[~series] * h
    out[ok] = res
    return out


def betainc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.nan))
    ok = (x > 0) & (x < 1)
    if not ok.any():
        return out
    p, q, y = a[ok], b[ok], x[ok]
    swap = y > (p + 1) / (p + q + 2)
    p, q, y = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, 1 - y, y)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    c, d = np.ones_like(y), 1 / _away(1 - (p + q) * y / (p + 1))
    h = d
    for m in range(1, 1000):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / _away(1 + num * d)
            c = _away(1 + num / c)
            h = h * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    value = front * h
    out[ok] = np.where(swap, 1 - value, value)
    return out


def _away(v: np.ndarray) -> np.ndarray:
    return np.where(np.abs(v) < 1e-300, 1e-300, v)


def minimise(f: Callable[[np.ndarray], float], x0, scale: float = 0.2, rounds: int = 600) -> np.ndarray:
    """Downhill simplex search."""
    x0 = np.asarray(x0, float)
    pts = [x0] + [x0 + np.where(np.arange(len(x0)) == i, scale * (abs(x0[i]) + 0.5), 0) for i in range(len(x0))]
    vals = [f(p) for p in pts]
    for _ in range(rounds):
        order = np.argsort(vals)
        pts, vals = [pts[i] for i in order], [vals[i] for i in order]
        if abs(vals[-1] - vals[0]) < 1e-10 * (abs(vals[0]) + 1e-10):
            break
        mid = np.mean(pts[:-1], axis=0)
        flip = mid + (mid - pts[-1])
        v = f(flip)
        if v < vals[0]:
            far = mid + 2 * (mid - pts[-1])
            w = f(far)
            pts[-1], vals[-1] = (far, w) if w < v else (flip, v)
        elif v < vals[-2]:
            pts[-1], vals[-1] = flip, v
        else:
            near = mid + 0.5 * ((flip if v < vals[-1] else pts[-1]) - mid)
            w = f(near)
            if w < min(v, vals[-1]):
                pts[-1], vals[-1] = near, w
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                vals = [vals[0]] + [f(p) for p in pts[1:]]
    return pts[int(np.argmin(vals))]


@dataclass(frozen=True)
class Family:
    """A named family: log density, cdf, start values, and how free parameters are held in range."""

    name: str
    logpdf: Callable
    cdf: Callable
    start: Callable
    positive: tuple[bool, ...]
    low: float = -math.inf
    high: float = math.inf
    discrete: bool = False
    closed: Callable | None = None

    def fit(self, x: np.ndarray) -> tuple[float, ...] | None:
        """Maximum-likelihood parameters, or None where there is no fit."""
        x = np.asarray(x, float)
        x = x[np.isfinite(x)]
        if len(x) < 2 or len(np.unique(x)) < 2 or x.min() < self.low or x.max() > self.high:
            return None
        if self.closed is not None:
            return tuple(float(v) for v in self.closed(x))
        held = np.array(self.positive)

        def unpack(p):
            return np.where(held, np.exp(np.clip(p, -50, 50)), p)

        def loss(p):
            with np.errstate(all="ignore"):
                v = -np.sum(self.logpdf(x, *unpack(p)))
            return v if np.isfinite(v) else 1e300

        start = np.asarray(self.start(x), float)
        best = minimise(loss, np.where(held, np.log(np.maximum(start, 1e-8)), start))
        return tuple(float(v) for v in unpack(best)) if loss(best) < 1e299 else None

    def _search(self, p, lo, hi, params) -> np.ndarray:
        """Where the distribution function reaches p between lo and hi: Newton where it stays inside, else halving."""
        x, live = (lo + hi) / 2, np.arange(len(p))
        for _ in range(120):
            if not len(live):
                break
            at, low, high = x[live], lo[live], hi[live]
            gap = self.cdf(at, *params) - p[live]
            low, high = np.where(gap < 0, at, low), np.where(gap < 0, high, at)
            new = (low + high) / 2
            if not self.discrete:
                with np.errstate(all="ignore"):
                    step = at - gap / np.exp(self.logpdf(at, *params))
                inside = (step > low) & (step < high)
                new = np.where(inside, step, new)
            lo[live], hi[live] = low, high
            settled = (np.abs(new - at) <= 1e-14 * np.abs(at)) | (high - low <= 1e-15 * (np.abs(low) + np.abs(high))) | (gap == 0)
            x[live] = np.where(gap == 0, at, new)
            live = live[~settled]
        return np.ceil(hi - 1e-9) if self.discrete else x

    def ppf(self, p, *params) -> np.ndarray:
        """Quantiles by bracketed Newton steps (the least integer reaching p for discrete families)."""
        p = np.asarray(p, float)
        lo, hi = np.full(p.shape, max(self.low, -1.0)), np.full(p.shape, min(self.high, 1.0))
        for _ in range(1100):
            bad = (self.cdf(hi, *params) < p) & (p < 1) & (hi < self.high)
            if not bad.any():
                break
            hi = np.where(bad, np.minimum(hi * 2 + 1, self.high), hi)
        for _ in range(1100):
            bad = (self.cdf(lo, *params) > p) & (p > 0) & (lo > self.low)
            if not bad.any():
                break
            lo = np.where(bad, np.maximum(lo * 2 - 1, self.low), lo)
        out = self._search(p.ravel(), lo.ravel(), hi.ravel(), params).reshape(p.shape)
        out = np.where(p <= 0, self.low, np.where(p >= 1, self.high, out))
        return np.where(np.isnan(p), np.nan, out)


def _moments(x):
    return x.mean(), max(x.var(), 1e-12)


def _gamma_start(x):
    m, v = _moments(x)
    return m * m / v, m / v


def digamma(x: float) -> float:
    """Derivative of the log gamma function, by recurrence and asymptotic series."""
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))


def _gamma_fit(x):
    """Shape by Newton steps on log shape - digamma(shape) = log mean - mean log; then the rate."""
    x = np.maximum(x, 1e-300)
    s = max(math.log(x.mean()) - np.log(x).mean(), 1e-12)
    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(30):
        h = 1e-5 * k
        g = math.log(k) - digamma(k) - s
        slope = (math.log(k + h) - digamma(k + h) - math.log(k - h) + digamma(k - h)) / (2 * h)
        new = max(k - g / slope, k / 10)
        if abs(new - k) < 1e-12 * k:
            break
        k = new
    return k, k / x.mean()


def _beta_start(x):
    m, v = _moments(x)
    k = max(m * (1 - m) / v - 1, 0.1)
    return m * k, (1 - m) * k


def _lbeta(a, b):
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def _rice_cdf(x, nu, s):
    """Series over Poisson weights of central chi-squared terms."""
    x = np.maximum(np.asarray(x, float), 0) / s
    lam = (nu / s) ** 2 / 2
    top = int(lam + 12 * math.sqrt(lam + 1) + 30)
    k = np.arange(max(0, int(lam - 12 * math.sqrt(lam + 1))), top)
    w = np.exp(-lam + k * math.log(lam) - _lgamma(k + 1.0)) if lam > 0 else (k == 0).astype(float)
    return np.sum(w[:, None] * gammainc((k + 1.0)[:, None], (x.ravel() ** 2 / 2)[None, :]), axis=0).reshape(x.shape)


def _rice_logpdf(x, nu, s):
    z = x * nu / s**2
    return np.log(np.maximum(x, 1e-300) / s**2) - (x - nu) ** 2 / (2 * s**2) + np.log(np.i0(np.minimum(z, 500)) * np.exp(-np.minimum(z, 500))) - 0.5 * np.log(np.maximum(z, 500) / 500)


_HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)
FAMILIES: dict[str, Family] = {
    f.name: f
    for f in (
        Family("normal", lambda x, m, s: -((x - m) ** 2) / (2 * s * s) - np.log(s) - _HALF_LOG_2PI, lambda x, m, s: 0.5 * (1 + _erf((np.asarray(x, float) - m) / (s * math.sqrt(2)))), _moments, (False, True), closed=lambda x: (x.mean(), x.std())),
        Family("lognormal", lambda x, m, s: -((np.log(x) - m) ** 2) / (2 * s * s) - np.log(s * x) - _HALF_LOG_2PI, lambda x, m, s: 0.5 * (1 + _erf((np.log(np.maximum(x, 1e-300)) - m) / (s * math.sqrt(2)))), _moments, (False, True), low=0.0, closed=lambda x: (np.log(np.maximum(x, 1e-300)).mean(), np.log(np.maximum(x, 1e-300)).std())),
        Family("exponential", lambda x, r: np.log(r) - r * x, lambda x, r: -np.expm1(-r * np.maximum(x, 0)), lambda x: (1 / x.mean(),), (True,), low=0.0, closed=lambda x: (1 / x.mean(),)),
        Family("gamma", lambda x, a, r: a * np.log(r) - math.lgamma(a) + (a - 1) * np.log(x) - r * x, lambda x, a, r: gammainc(a, r * np.asarray(x, float)), _gamma_start, (True, True), low=0.0, closed=_gamma_fit),
        Family("weibull", lambda x, k, s: np.log(k / s) + (k - 1) * np.log(x / s) - (x / s) ** k, lambda x, k, s: -np.expm1(-((np.maximum(x, 0) / s) ** k)), lambda x: (1.2, x.mean()), (True, True), low=0.0),
        Family("logistic", lambda x, m, s: -(x - m) / s - np.log(s) - 2 * np.log1p(np.exp(-np.clip((x - m) / s, -700, 700))), lambda x, m, s: 1 / (1 + np.exp(-np.clip((np.asarray(x, float) - m) / s, -700, 700))), lambda x: (x.mean(), max(x.std(), 1e-9) * math.sqrt(3) / math.pi), (False, True)),
        Family("cauchy", lambda x, m, s: -np.log(math.pi * s * (1 + ((x - m) / s) ** 2)), lambda x, m, s: 0.5 + np.arctan((np.asarray(x, float) - m) / s) / math.pi, lambda x: (np.median(x), max(np.subtract(*np.percentile(x, [75, 25])) / 2, 1e-9)), (False, True)),
        Family("beta", lambda x, a, b: (a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - _lbeta(a, b), lambda x, a, b: betainc(a, b, x), _beta_start, (True, True), low=0.0, high=1.0),
        Family("chi-squared", lambda x, d: (d / 2 - 1) * np.log(x) - x / 2 - d / 2 * math.log(2) - math.lgamma(d / 2), lambda x, d: gammainc(d / 2, np.asarray(x, float) / 2), lambda x: (x.mean(),), (True,), low=0.0),
        Family("f", lambda x, a, b: a / 2 * np.log(a / b) + (a / 2 - 1) * np.log(x) - (a + b) / 2 * np.log1p(a * x / b) - _lbeta(a / 2, b / 2), lambda x, a, b: betainc(a / 2, b / 2, a * np.maximum(x, 0) / (a * np.maximum(x, 0) + b)), lambda x: (2.0, 5.0), (True, True), low=0.0),
        Family("t", lambda x, m, s, d: math.lgamma((d + 1) / 2) - math.lgamma(d / 2) - 0.5 * np.log(d * math.pi) - np.log(s) - (d + 1) / 2 * np.log1p(((x - m) / s) ** 2 / d), lambda x, m, s, d: _t_cdf((np.asarray(x, float) - m) / s, d), lambda x: (x.mean(), max(x.std(), 1e-9), 10.0), (False, True, True)),
        Family("poisson", lambda x, r: x * np.log(r) - r - _lgamma(x + 1), lambda x, r: np.where(np.asarray(x, float) < 0, 0.0, 1 - gammainc(np.floor(np.maximum(x, 0)) + 1, r)), lambda x: (x.mean(),), (True,), low=0.0, discrete=True, closed=lambda x: (x.mean(),)),
        Family("geometric", lambda x, p: np.log(p) + x * np.log1p(-p), lambda x, p: np.where(np.asarray(x, float) < 0, 0.0, 1 - (1 - p) ** (np.floor(x) + 1)), lambda x: (1 / (1 + x.mean()),), (True,), low=0.0, discrete=True, closed=lambda x: (1 / (1 + x.mean()),)),
        Family("negative binomial", lambda x, n, m: _lgamma(x + n) - math.lgamma(n) - _lgamma(x + 1) + n * np.log(n / (n + m)) + x * np.log(m / (n + m)), lambda x, n, m: np.where(np.asarray(x, float) < 0, 0.0, betainc(n, np.floor(np.maximum(x, 0)) + 1, n / (n + m))), lambda x: (1.0, x.mean()), (True, True), low=0.0, discrete=True),
        Family("rice", _rice_logpdf, _rice_cdf, lambda x: (max(x.mean(), 1e-6), max(x.std(), 1e-6)), (True, True), low=0.0),
        Family("gpd", lambda x, k, s: -np.log(s) - (1 + 1 / k) * np.log1p(k * x / s) if abs(k) > 1e-9 else -np.log(s) - x / s, lambda x, k, s: 1 - np.maximum(1 + k * np.maximum(x, 0) / s, 0) ** (-1 / k) if abs(k) > 1e-9 else -np.expm1(-np.maximum(x, 0) / s), lambda x: (0.1, x.mean()), (False, True), low=0.0),
    )
}
# Other names of the same families.
ALIASES = {"log-normal": "lognormal", "Poisson": "poisson", "norm": "normal", "weibull_min": "weibull"}


def _t_cdf(z, d):
    tail = 0.5 * betainc(d / 2, 0.5, d / (d + z * z))
    return np.where(z > 0, 1 - tail, tail)


def family(name: str) -> Family:
    """A family by name."""
    try:
        return FAMILIES[ALIASES.get(name, name)]
    except KeyError:
        raise ValueError(f"no family named {name}; there are {', '.join(FAMILIES)}") from None


def kolmogorov(x: np.ndarray, f: Family, params) -> float:
    """Largest gap between the empirical and the fitted distribution function."""
    x = np.sort(x)
    c, n = f.cdf(x, *params), len(x)
    return float(max((np.arange(1, n + 1) / n - c).max(), (c - np.arange(n) / n).max()))


def quantile(x: np.ndarray, p, kind: int = 7) -> np.ndarray:
    """Sample quantiles (types 4, 6, 7) of the non-missing values."""
    v = np.sort(x[~np.isnan(x)])
    n, p = len(v), np.asarray(p, float)
    if n == 0:
        return np.full(p.shape, np.nan)
    h = np.clip({7: (n - 1) * p, 6: (n + 1) * p - 1, 4: n * p - 1}[kind], 0, n - 1)
    lo = np.floor(h).astype(int)
    return v[lo] + (h - lo) * (v[np.minimum(lo + 1, n - 1)] - v[lo])


def interp_ties(x, xs, ys) -> np.ndarray:
    """Linear interpolation with the ys of equal xs averaged; end values outside."""
    u, inverse = np.unique(xs, return_inverse=True)
    return np.interp(x, u, np.bincount(inverse, ys) / np.bincount(inverse))
