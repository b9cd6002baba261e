"""Linear models per site: one closed form in SQL, the rest fitted per group in Arrow batches.

Training rows have keys, y and an array ``x``. A fit gives a row per site (coef with the intercept first,
dispersion, aic); prediction joins that table, so a site without a model predicts null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.functions.dist import family as distribution

MODEL = "family string, link string, coef array<double>, dispersion double, aic double"

# Link, inverse link, slope of the mean, and variance function by name.
LINKS = {
    "identity": (lambda m: m, lambda e: e, lambda e: np.ones_like(e)),
    "log": (np.log, lambda e: np.exp(np.clip(e, -30, 30)), lambda e: np.exp(np.clip(e, -30, 30))),
    "logit": (lambda m: np.log(m / (1 - m)), lambda e: 1 / (1 + np.exp(-np.clip(e, -30, 30))), lambda e: (s := 1 / (1 + np.exp(-np.clip(e, -30, 30)))) * (1 - s)),
    "inverse": (lambda m: 1 / m, lambda e: 1 / e, lambda e: -1 / e**2),
    "1/mu^2": (lambda m: 1 / m**2, lambda e: 1 / np.sqrt(np.maximum(e, 1e-12)), lambda e: -0.5 * np.maximum(e, 1e-12) ** -1.5),
}
VARIANCES = {"gaussian": lambda m: np.ones_like(m), "binomial": lambda m: m * (1 - m), "poisson": lambda m: m, "gamma": lambda m: m**2, "inverse.gaussian": lambda m: m**3}
DEFAULT_LINK = {"gaussian": "identity", "binomial": "logit", "poisson": "log", "gamma": "inverse", "inverse.gaussian": "1/mu^2"}


def condition(y: str, op: str | None, threshold: float | None):
    """Training-row predicate: GT, GE, LT, LE against a threshold; without one, y is not null."""
    c = F.col(y)
    if threshold is None and op is None:
        return c.isNotNull()
    ops = {"GT": c > threshold, "GE": c >= threshold, "LT": c < threshold, "LE": c <= threshold}
    if (op or "GE") not in ops:
        raise ValueError("condition is GT, GE, LT or LE")
    return F.coalesce(ops[op or "GE"], F.lit(False))


def irls(x: np.ndarray, y: np.ndarray, family: str, link: str, rounds: int = 50) -> tuple[np.ndarray, float, float]:
    """(coef, dispersion, aic) by iteratively reweighted least squares; x has no intercept column."""
    name = family.removeprefix("quasi") or family
    g, inv, slope = LINKS[link]
    var = VARIANCES.get(name, VARIANCES["gaussian"])
    d = np.column_stack((np.ones(len(y)), x))
    mu = {"binomial": (y + 0.5) / 2, "poisson": y + 0.1}.get(name, np.where(y > 0, y, y.mean()) if link in ("log", "inverse", "1/mu^2") else y)
    eta, beta = g(mu), np.zeros(d.shape[1])
    for _ in range(rounds):
        mu, m = inv(eta), slope(eta)
        w = m**2 / np.maximum(var(mu), 1e-12)
        z = eta + (y - mu) / np.where(m == 0, 1e-12, m)
        a = d.T @ (d * w[:, None])
        new = np.linalg.lstsq(a, d.T @ (w * z), rcond=None)[0]
        if not np.isfinite(new).all():
            raise ValueError("the fit diverged")
        done = np.abs(new - beta).max() <= 1e-10 * (1 + np.abs(beta).max())
        beta, eta = new, d @ new
        if done:
            break
    mu, n, k = inv(eta), len(y), d.shape[1]
    phi = 1.0 if name in ("binomial", "poisson") and family == name else float(((y - mu) ** 2 / np.maximum(var(mu), 1e-12)).sum() / max(1, n - k))
    if name == "binomial":
        loglik = np.sum(np.log(np.clip(np.where(y > 0.5, mu, 1 - mu), 1e-12, 1)))
    else:
        loglik = -0.5 * n * np.log(max(((y - mu) ** 2).mean(), 1e-300)) if name == "gaussian" else -0.5 * np.sum(np.log(2 * np.pi * phi * np.maximum(var(mu), 1e-300)) + (y - mu) ** 2 / (phi * np.maximum(var(mu), 1e-300)))
    return beta, phi, float(2 * k - 2 * loglik)


def stepwise(x, y, family, link, direction="forward", steps=1000):
    """Greedy choice of predictors by AIC: forward from none, backward from all, both from none."""
    chosen = set(range(x.shape[1])) if direction == "backward" else set()
    best = irls(x[:, sorted(chosen)], y, family, link)
    for _ in range(steps):
        moves = [chosen - {j} for j in chosen if direction != "forward"] + [chosen | {j} for j in range(x.shape[1]) if j not in chosen and direction != "backward"]
        tried = [(irls(x[:, sorted(m)], y, family, link), m) for m in moves]
        if not tried or min(t[0][2] for t in tried) >= best[2]:
            break
        best, chosen = min(tried, key=lambda t: t[0][2])
    coef = np.zeros(x.shape[1] + 1)
    coef[0] = best[0][0]
    coef[[j + 1 for j in sorted(chosen)]] = best[0][1:]
    return coef, best[1], best[2]


def elastic_net(x, y, alpha, lam, rounds=300):
    """Coordinate descent for squared loss on centred, unscaled predictors."""
    mx, my, n = x.mean(axis=0), y.mean(), len(y)
    z, r, beta = x - mx, y - my, np.zeros(x.shape[1])
    size = (z * z).sum(axis=0) / n
    for _ in range(rounds):
        before = beta.copy()
        for j in range(len(beta)):
            if size[j] == 0:
                continue
            c = z[:, j] @ r / n + size[j] * beta[j]
            new = np.sign(c) * max(abs(c) - lam * alpha, 0) / (size[j] + lam * (1 - alpha))
            r += z[:, j] * (beta[j] - new)
            beta[j] = new
        if np.abs(beta - before).max() < 1e-8:
            break
    return np.append(my - mx @ beta, beta)


def penalised(x, y, kind="L1", folds=10, grid=30):
    """Lasso (L1), ridge (L2) at the largest penalty within one standard error, or L1L2 at the best of both."""
    alphas = {"L1": [1.0], "L2": [0.0]}.get(kind, [i / 10 for i in range(11)])
    fold = np.arange(len(y)) % folds
    best = None
    for a in alphas:
        top = np.abs((x - x.mean(axis=0)).T @ (y - y.mean())).max() / len(y) / max(a, 1e-3)
        errors = []
        lams = top * np.logspace(0, -4, grid)
        for lam in lams:
            e = [((y[fold == f] - np.column_stack((np.ones((fold == f).sum()), x[fold == f])) @ elastic_net(x[fold != f], y[fold != f], a, lam)) ** 2).mean() for f in range(folds)]
            errors.append((np.mean(e), np.std(e, ddof=1) / np.sqrt(folds)))
        i = int(np.argmin([e for e, _ in errors]))
        if kind in ("L1", "L2"):
            i = next(j for j, (e, _) in enumerate(errors) if e <= errors[i][0] + errors[i][1])
        if best is None or errors[i][0] < best[0]:
            best = (errors[i][0], a, lams[i])
    coef = elastic_net(x, y, best[1], best[2])
    left = y - np.column_stack((np.ones(len(y)), x)) @ coef
    return coef, float((left**2).sum() / max(1, len(y) - (coef != 0).sum())), float("nan")


def group_lasso(x: np.ndarray, y: np.ndarray, lam: float, rounds: int = 500) -> np.ndarray:
    """Several responses at once: a predictor's coefficients enter or leave together (proximal gradient)."""
    mx, my, n = x.mean(axis=0), y.mean(axis=0), len(x)
    z, r = x - mx, y - my
    step = n / max(np.linalg.norm(z, 2) ** 2, 1e-12)
    b = np.zeros((x.shape[1], y.shape[1]))
    for _ in range(rounds):
        new = b - step * z.T @ (z @ b - r) / n
        size = np.linalg.norm(new, axis=1, keepdims=True)
        new = new * np.maximum(1 - step * lam / np.maximum(size, 1e-300), 0)
        done = np.abs(new - b).max() < 1e-9
        b = new
        if done:
            break
    return np.vstack((my - mx @ b, b))


def fit_group_lasso(rows: DataFrame, keys: list[str], folds: int = 10, grid: int = 20) -> DataFrame:
    """(keys, site, coef): one fit over all sites of ``y`` (an array), at the cross-validated penalty."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = np.array(pdf["x"].tolist(), float), np.array(pdf["y"].tolist(), float)
        good = np.isfinite(x).all(axis=1) & np.isfinite(y).all(axis=1)
        x, y = x[good], y[good]
        fold = np.arange(len(x)) % folds
        top = np.linalg.norm((x - x.mean(axis=0)).T @ (y - y.mean(axis=0)), axis=1).max() / len(x)
        best = (np.inf, top)
        for lam in top * np.logspace(0, -4, grid):
            e = 0.0
            for f in range(folds):
                c = group_lasso(x[fold != f], y[fold != f], lam)
                e += ((y[fold == f] - c[0] - x[fold == f] @ c[1:]) ** 2).sum()
            best = min(best, (e, lam))
        c = group_lasso(x, y, best[1])
        return pd.DataFrame({k: [pdf[k].iloc[0]] * y.shape[1] for k in keys} | {"site": range(y.shape[1]), "coef": c.T.tolist()})

    types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, "y", "x").groupBy(*keys).applyInPandas(one, f"{types}, site int, coef array<double>")


def fit(rows: DataFrame, keys: list[str], family: str = "gaussian", link: str | None = None, fitting: str | None = None, op: str | None = None, threshold: float | None = None, steps: int = 1000, direction: str = "forward") -> DataFrame:
    """A model per key: plain, ``stepwise``, ``L1``, ``L2`` or ``L1L2``; a failed fit has a null coef."""
    base = family.removeprefix("quasi") or family
    link = link or DEFAULT_LINK.get(base, "identity")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = np.array(pdf["x"].tolist(), float), pdf["y"].to_numpy(dtype=float)
        good = np.isfinite(x).all(axis=1) & np.isfinite(y)
        coef, phi, aic = None, np.nan, np.nan
        try:
            if good.sum() > x.shape[1]:
                x, y = x[good], y[good]
                with np.errstate(all="ignore"):
                    if fitting == "stepwise":
                        coef, phi, aic = stepwise(x, y, family, link, direction, steps)
                    elif fitting in ("L1", "L2", "L1L2"):
                        coef, phi, aic = penalised(x, y, fitting)
                    else:
                        coef, phi, aic = irls(x, y, family, link)
        except (np.linalg.LinAlgError, ValueError):
            coef = None
        head = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame(head | {"family": family, "link": link, "coef": [None if coef is None else coef.tolist()], "dispersion": phi, "aic": aic})

    types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.filter(condition("y", op, threshold)).select(*keys, "y", "x").groupBy(*keys).applyInPandas(one, f"{types}, {MODEL}")


def predict(rows: DataFrame, models: DataFrame, keys: list[str], simulate: bool = False, seed: int = 1) -> DataFrame:
    """rows (keys, x) with ``prediction`` = mean response; ``simulate`` draws binomial or gamma values.

    A draw depends on the seed and the row alone (its keys, ``t`` where there is one, and x).
    """
    m = models.select(*keys, "family", "link", "coef", "dispersion")
    eta = F.get("coef", F.lit(0)) + F.aggregate(F.zip_with("x", F.slice("coef", 2, F.greatest(F.size("coef") - 1, F.lit(0))), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    mean = F.when(F.col("link") == "log", F.exp(eta)).when(F.col("link") == "logit", 1 / (1 + F.exp(-eta))).when(F.col("link") == "inverse", F.try_divide(F.lit(1.0), eta)).when(F.col("link") == "1/mu^2", 1 / F.sqrt(eta)).otherwise(eta)
    out = rows.join(m, keys, "left").withColumn("prediction", F.when(F.col("coef").isNotNull(), mean))
    if simulate:
        named = [*keys, *(["t"] if "t" in rows.columns else []), "x"]
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *named), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        inverse = distribution("gamma").ppf

        @F.pandas_udf("double")
        def gamma(u: pd.Series, mu: pd.Series, phi: pd.Series) -> pd.Series:
            u, mu, phi = (x.to_numpy(dtype=float) for x in (u, mu, phi))
            out = np.full(len(u), np.nan)
            for shape in np.unique(1 / phi[phi > 0]):  # one dispersion per model
                at = np.flatnonzero(np.isfinite(mu) & (phi > 0) & (1 / np.where(phi > 0, phi, 1) == shape))
                out[at] = inverse(u[at], shape, shape) * mu[at]
            return pd.Series(out)

        mu = F.col("prediction")
        drawn = F.when(F.col("family") == "binomial", (u < mu).cast("double")).when(F.col("family") == "gamma", F.coalesce(F.nanvl(gamma(u, mu, F.col("dispersion")), mu), mu)).otherwise(mu)
        out = out.withColumn("prediction", F.when(mu.isNotNull(), drawn))
    return out.drop("family", "link", "coef", "dispersion")


def fit_spread(rows: DataFrame, keys: list[str], family: str = "gaussian", link: str | None = None, op: str | None = None, threshold: float | None = None, rounds: int = 50) -> DataFrame:
    """``fit`` for models with many rows each: a round sums X'WX over partitions, and no model's rows meet.

    Models are few (a global one, or one per region): their coefficients travel with each round. The
    likelihood takes one more pass.
    """
    base = family.removeprefix("quasi") or family
    link = link or DEFAULT_LINK.get(base, "identity")
    g, inv, slope = LINKS[link]
    var = VARIANCES.get(base, VARIANCES["gaussian"])
    spark = rows.sparkSession
    used = rows.filter(condition("y", op, threshold) & ~F.isnan("y") & ~F.exists("x", lambda v: v.isNull() | F.isnan(v))).select(*keys, F.col("y").cast("double").alias("y"), "x")
    types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def sums(betas: dict | None, means: dict | None) -> dict:
        sent = spark.sparkContext.broadcast((betas, means))

        def run(batches):
            total: dict = {}
            for pdf in batches:
                for key, part in pdf.groupby(keys, dropna=False):
                    y, d = part["y"].to_numpy(float), np.column_stack((np.ones(len(part)), np.array(part["x"].tolist(), float)))
                    betas, means = sent.value
                    with np.errstate(all="ignore"):
                        if betas is None:
                            mean = (means or {}).get(key, 0.0)
                            mu = {"binomial": (y + 0.5) / 2, "poisson": y + 0.1}.get(base, np.where(y > 0, y, mean) if link in ("log", "inverse", "1/mu^2") else y)
                            eta = g(mu) if means is not None else np.zeros(len(y))
                        elif key not in betas:
                            continue
                        else:
                            eta = d @ betas[key]
                        mu, m = inv(eta), slope(eta)
                        v = np.maximum(var(mu), 1e-12)
                        w = m**2 / v
                        z = eta + (y - mu) / np.where(m == 0, 1e-12, m)
                        say = np.log(np.clip(np.where(y > 0.5, mu, 1 - mu), 1e-12, 1)).sum() if base == "binomial" else -0.5 * np.log(np.maximum(v, 1e-300)).sum()
                    flat = np.concatenate(((d.T @ (d * w[:, None])).ravel(), d.T @ (w * z), [len(y), y.sum(), ((y - mu) ** 2 / v).sum(), ((y - mu) ** 2).sum(), say]))
                    total[key] = total.get(key, 0.0) + flat
            if total:
                yield pd.DataFrame([dict(zip(keys, k, strict=True)) | {"flat": v.tolist()} for k, v in total.items()])

        got = used.mapInPandas(run, f"{types}, flat array<double>")
        width = F.max(F.size("flat")).alias("n")
        size = got.agg(width).first()["n"]
        cells = [F.sum(F.get("flat", F.lit(i))).alias(f"s{i}") for i in range(size or 0)]
        return {tuple(r[k] for k in keys): np.array([r[f"s{i}"] for i in range(size)]) for r in got.groupBy(*keys).agg(*cells).collect()} if size else {}

    def parts(flat):
        k = int(round((np.sqrt(4 * (len(flat) - 5) + 1) - 1) / 2))
        return flat[: k * k].reshape(k, k), flat[k * k : k * k + k], flat[k * k + k :]

    means = {k: float(f[-4] / f[-5]) for k, f in sums(None, None).items()} if link in ("log", "inverse", "1/mu^2") else {}
    betas: dict = {}
    found, broken = sums(None, means), set()
    for _ in range(rounds):
        new = {k: np.linalg.lstsq(a, b, rcond=None)[0] for k, f in found.items() for a, b, _ in [parts(f)] if np.isfinite(f).all()}
        broken |= found.keys() - new.keys()
        done = all(k in betas and np.abs(new[k] - betas[k]).max() <= 1e-10 * (1 + np.abs(betas[k]).max()) for k in new)
        betas = new
        found = sums(betas, None)
        if done or link == "identity" and base not in ("binomial", "poisson", "gamma", "inverse.gaussian"):
            break
    out = []
    for k, f in found.items():
        _, b, (n, _, chi, left, say) = parts(f)
        d = len(b)
        if n <= d - 1:
            continue
        phi = 1.0 if family in ("binomial", "poisson") else chi / max(1, n - d)
        loglik = say if base == "binomial" else -0.5 * n * np.log(max(left / n, 1e-300)) if base == "gaussian" else say - 0.5 * n * np.log(2 * np.pi * phi) - 0.5 * chi / phi
        out.append((*k, family, link, betas[k].tolist(), float(phi), float(2 * d - 2 * loglik)))
    out += [(*k, family, link, None, None, None) for k in broken]
    return spark.createDataFrame(out, f"{types}, {MODEL}")


def simple_line(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Least squares of y on one predictor x1, natively: slope and intercept per key."""
    return rows.groupBy(*keys).agg(F.regr_slope("y", "x1").alias("slope"), F.regr_intercept("y", "x1").alias("intercept"))


def neural(rows: DataFrame, keys: list[str], hidden: int = 10, epochs: int = 500, rate: float = 0.001, momentum: float = 0.5, batch: int = 100, output: str = "linear", seed: int = 1, visible_dropout: float = 0.0, hidden_dropout: float = 0.0) -> DataFrame:
    """A one-hidden-layer network per key; y may be an array (all sites in one fit). Weights as flat array.

    Dropouts are the shares of predictors and hidden units left out of each training row; the rest count
    for more in turn, so that predictions need no scaling.
    """
    if not (0 <= visible_dropout < 1 and 0 <= hidden_dropout < 1):
        raise ValueError("dropouts lie in [0, 1)")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["x"].tolist(), float)
        y = np.array([v if isinstance(v, (list, np.ndarray)) else [v] for v in pdf["y"]], float)
        good = np.isfinite(x).all(axis=1) & np.isfinite(y).all(axis=1)
        x, y = x[good], y[good]
        rng = np.random.default_rng(seed)
        w = [rng.normal(0, 0.5, (x.shape[1] + 1, hidden)), rng.normal(0, 0.5, (hidden + 1, y.shape[1]))]
        v = [np.zeros_like(a) for a in w]
        keep = lambda z, share: z * (rng.random(z.shape) >= share) / (1 - share) if share else z
        for _ in range(epochs if len(x) else 0):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                a = np.column_stack((keep(x[order[i : i + batch]], visible_dropout), np.ones(len(order[i : i + batch]))))
                h = 1 / (1 + np.exp(-np.clip(a @ w[0], -30, 30)))
                on = keep(np.ones_like(h), hidden_dropout)
                b = np.column_stack((h * on, np.ones(len(h))))
                o = b @ w[1]
                o = 1 / (1 + np.exp(-np.clip(o, -30, 30))) if output == "sigm" else o
                g = o - y[order[i : i + batch]]
                g = g * o * (1 - o) if output == "sigm" else g
                back = (g @ w[1][:-1].T) * on * h * (1 - h)
                for k, grad in enumerate((a.T @ back / len(a), b.T @ g / len(b))):
                    v[k] = momentum * v[k] - rate * grad
                    w[k] = w[k] + v[k]
        return pd.DataFrame({k: [pdf[k].iloc[0]] for k in keys} | {"shape": [[x.shape[1], hidden, y.shape[1]]], "weights": [np.concatenate([a.ravel() for a in w]).tolist()], "output": output})

    types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInPandas(one, f"{types}, shape array<int>, weights array<double>, output string")


def neural_predict(rows: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, x) with ``prediction`` as array of outputs."""
    def run(batches):
        for pdf in batches:
            out = []
            for x, shape, flat, kind in zip(pdf["x"], pdf["shape"], pdf["weights"], pdf["output"], strict=True):
                if shape is None:
                    out.append(None)
                    continue
                d, h, k = shape
                a, b = np.split(np.asarray(flat, float), [(d + 1) * h])
                z = np.append(1 / (1 + np.exp(-np.clip(np.append(x, 1.0) @ a.reshape(d + 1, h), -30, 30))), 1.0) @ b.reshape(h + 1, k)
                out.append((1 / (1 + np.exp(-z)) if kind == "sigm" else z).tolist())
            pdf["prediction"] = out
            yield pdf.drop(columns=["shape", "weights", "output"])

    joined = rows.join(models, keys, "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", prediction array<double>"
    return joined.select(*rows.columns, "shape", "weights", "output").mapInPandas(run, schema)
