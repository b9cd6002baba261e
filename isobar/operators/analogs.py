"""Analog search: the days whose predictors are nearest, and what was observed on them."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Targets and training days of a block.
TARGETS, DAYS = 1024, 4096


def nearest_days(train: DataFrame, target: DataFrame, n: int, window: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """The n nearest training days of every target day: (keys, target, day, dist, rank).

    train has day and x, target has target and x (and keys, for a search per location). Days within
    ``window`` days of the target are left out. Ties go to the smaller day. The targets meet all training
    days in blocks of bounded size: each block of days gives its n best of each target of a block, and
    only those are ranked again. Days and targets without predictors, or with a missing one, take no part.
    """
    whole = lambda df: df.filter(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    train, target = whole(train).select(*keys, "day", "x"), whole(target).select(*keys, "target", "x")
    most = lambda df: (df.groupBy(*keys).count() if keys else df.select(F.count("*").alias("count"))).agg(F.max("count").alias("n")).first()["n"] or 0
    nt, nd = -(-most(target) // TARGETS) or 1, -(-most(train) // DAYS) or 1
    dealt = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    days = train.select(*keys, "day", "x", dealt("day", nd).alias("db"), every(nt).alias("tb"))
    asked = target.select(*keys, "target", "x", every(nd).alias("db"), dealt("target", nt).alias("tb"))
    names = [*keys, "target", "day", "dist"]
    kinds = ", ".join(f"`{c}` {(target if c in target.columns else train).schema[c].dataType.simpleString()}" for c in names[:-1]) + ", dist double"

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in names})
        a = a.sort_values("day", kind="stable")
        x, y = np.array(a["x"].tolist(), np.float64), np.array(b["x"].tolist(), np.float64)
        square = np.zeros((len(y), len(x)))
        for j in range(x.shape[1]):  # term by term, so that equal sums stay equal
            square += (y[:, j, None] - x[None, :, j]) ** 2
        dist = np.sqrt(square)
        if window is not None:
            day, to = (c.to_numpy().astype("datetime64[D]").astype(np.int64) for c in (a["day"], b["target"]))
            dist[np.abs(day[None, :] - to[:, None]) <= window] = np.inf
        best = np.argsort(dist, axis=1, kind="stable")[:, :n]
        row, col = np.repeat(np.arange(len(y)), best.shape[1]), best.ravel()
        found = np.isfinite(dist[row, col])
        row, col = row[found], col[found]
        out = {c: b[c].to_numpy()[row] for c in (*keys, "target")} | {"day": a["day"].to_numpy()[col], "dist": dist[row, col]}
        return pd.DataFrame(out)

    block = [*keys, "db", "tb"]
    flat = days.groupBy(*block).cogroup(asked.groupBy(*block)).applyInPandas(search, kinds)
    order = Window.partitionBy(*keys, "target").orderBy("dist", "day")
    return flat.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def selector(name: str) -> Column:
    """Aggregate over value and dist: mean, wmean, max, min, median, or prcXX."""
    v = F.col("value")
    if name == "wmean":  # an exact match outweighs everything
        w = 1 / F.greatest(F.col("dist"), F.lit(1e-12))
        return F.try_divide(F.sum(w * v), F.sum(F.when(v.isNotNull(), w)))
    if m := re.fullmatch(r"prc(\d+)", name):
        return F.percentile("value", int(m[1]) / 100)
    if name not in ("mean", "max", "min", "median"):
        raise ValueError("mean, wmean, max, min, median or prcXX")
    return {"mean": F.avg, "max": F.max, "min": F.min, "median": F.median}[name](v)


def predict(train: DataFrame, target: DataFrame, values: DataFrame, n: int = 4, fun: str = "mean", window: int | None = 7, pool: int = 0, n_random: int | None = None, seed: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per target (and site of ``values``): the selected value over its analogs.

    values has day, site and value. With ``pool`` the next days in order stand in for analogs without a
    value; with ``n_random`` that many of the analogs are drawn by a keyed hash.
    """
    days = nearest_days(train, target, n + pool, window, keys)
    rows = days.join(values, "day")
    if pool:
        order = Window.partitionBy(*keys, "target", "site").orderBy(F.col("value").isNull(), "rank")
        rows = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n)
    if n_random:
        order = Window.partitionBy(*keys, "target", "site").orderBy(F.xxhash64(F.lit(seed), "target", "day"))
        rows = rows.withColumn("q", F.row_number().over(order)).filter(F.col("q") <= n_random)
    f = selector(fun) if n > 1 else F.first("value")
    return rows.groupBy(*keys, "target", "site").agg(f.alias("value"))
