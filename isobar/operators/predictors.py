"""Predictor sets: raw, standardised, principal components, local neighbours, random features."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import PCA, PCAModel, StandardScaler, StandardScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.operators import grid as _grid


def wide(grid: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(t, x): a day's predictors as an array in the order of ``names`` (var_loc, sorted by default)."""
    named = grid.withColumn("name", F.concat_ws("_", "var", F.col("loc_id").cast("string")))
    names = names or sorted(r["name"] for r in named.select("name").distinct().collect())  # a name per predictor
    table = named.groupBy("t").pivot("name", names).agg(F.first("value"))
    return table.select("t", F.array(*[F.col(f"`{n}`") for n in names]).alias("x"))


@dataclass
class Components:
    """Standardised principal components, kept for new data; signs make the largest loading positive."""

    scaler: StandardScalerModel
    pca: PCAModel
    k: int
    signs: list[float] = field(default_factory=list)

    @classmethod
    def fit(cls, rows: DataFrame, n: int | None = None, explained: float | None = None) -> Components:
        """Fit on (t, x) rows; keep n components or as few as explain the share."""
        v = rows.filter(~F.exists("x", lambda a: a.isNull())).select("t", array_to_vector("x").alias("x"))
        size = v.first()["x"].size
        scaler = StandardScaler(withMean=True, withStd=True, inputCol="x", outputCol="z").fit(v)
        pca = PCA(k=n or size, inputCol="z", outputCol="pc").fit(scaler.transform(v))
        share = np.cumsum(pca.explainedVariance.toArray())
        k = n or int(np.searchsorted(share, (explained or 1.0) - 1e-12) + 1)
        load = pca.pc.toArray()
        return cls(scaler, pca, min(k, load.shape[1]), [float(np.sign(c[np.abs(c).argmax()]) or 1.0) for c in load.T])

    def transform(self, rows: DataFrame) -> DataFrame:
        """(t, x) with x replaced by the components."""
        v = rows.filter(~F.exists("x", lambda a: a.isNull())).withColumn("x", array_to_vector("x"))
        out = self.pca.transform(self.scaler.transform(v)).withColumn("pc", vector_to_array("pc"))
        return out.withColumn("x", F.transform(F.slice("pc", 1, self.k), lambda a, i: a * F.get(F.array(*map(F.lit, self.signs)), i))).drop("z", "pc")


@dataclass
class PredictorSet:
    """Components per variable, of several variables combined, or both, kept to check and project new data."""

    names: list[str]
    parts: list[tuple[list[int], Components]]
    places: DataFrame

    @classmethod
    def fit(cls, rows: DataFrame, combine: list[str] | None = None, combined_only: bool = True, n: int | None = None, explained: float | None = None) -> PredictorSet:
        """Fit on long rows (t, var, loc_id, value; lat and lon if known).

        Without ``combine`` every variable has its own components. With it, those of the named variables
        together are the predictors, after those of the other variables unless ``combined_only``.
        """
        pairs = sorted((r["var"], r["loc_id"]) for r in rows.select("var", "loc_id").distinct().collect())  # a row per predictor
        variables = sorted({v for v, _ in pairs})
        if combine and not set(combine) <= set(variables):
            raise ValueError(f"unknown variables: {sorted(set(combine) - set(variables))}")
        sets = [] if combine and combined_only else [[v] for v in variables if v not in (combine or [])]
        sets += [combine] if combine else []
        names = [f"{v}_{loc}" for v, loc in pairs]
        table = wide(rows, names).cache()  # read by each part's fit; a row per date
        at = [[i for i, (v, _) in enumerate(pairs) if v in s] for s in sets]
        parts = [(i, Components.fit(table.withColumn("x", _pick("x", i)), n and min(n, len(i)), explained)) for i in at]
        table.unpersist()
        columns = [c for c in ("var", "loc_id", "lat", "lon") if c in rows.columns]
        return cls(names, parts, rows.select(*columns).distinct())

    def transform(self, rows: DataFrame) -> DataFrame:
        """(t, x) of long rows; raises if a variable is missing or locations differ. Variables not fitted are left out.

        A day with a missing value has no row.
        """
        known = self.places.select("var").distinct()
        used = rows.join(F.broadcast(known), "var", "left_semi")  # a row per variable
        try:
            _grid.require_same(self.places, used, "var")
        except ValueError:
            raise ValueError("the new data lack variables of the predictors") from None
        _grid.require_same_coordinates(self.places, used)
        out = wide(used, self.names).withColumnRenamed("x", "all")
        for k, (i, c) in enumerate(self.parts):
            out = c.transform(out.withColumn("x", _pick("all", i))).withColumnRenamed("x", f"part{k}")
        return out.select("t", F.concat(*[f"part{k}" for k in range(len(self.parts))]).alias("x"))


def _pick(column: str, positions: list[int]):
    return F.array(*[F.get(column, F.lit(i)) for i in positions])


def mixed(global_x: DataFrame, local_x: DataFrame) -> DataFrame:
    """(loc_id, t, x): the day's global predictors followed by the site's own."""
    own = local_x.select("loc_id", "t", F.col("x").alias("own"))
    return own.join(global_x, "t").select("loc_id", "t", F.concat("x", "own").alias("x"))


def extend(rows: DataFrame, units: int, seed: int = 1, size: int | None = None) -> DataFrame:
    """Random sigmoid features of x (weights drawn once on the driver, reused for new data by the seed)."""
    size = size or len(rows.first()["x"])
    rng, r = np.random.default_rng(seed), 2 / np.sqrt(size + 1)
    w = np.vstack((rng.uniform(-r, r, (size, units)), rng.uniform(-2, 2, (1, units))))
    unit = [F.array(*[F.lit(float(a)) for a in w[:, j]]) for j in range(units)]
    ones = F.concat("x", F.array(F.lit(1.0)))
    return rows.withColumn("x", F.array(*[1 / (1 + F.exp(-F.aggregate(F.zip_with(ones, u, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))) for u in unit]))
