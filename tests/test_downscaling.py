"""Predictor sets, guards, folds, site modes, chunks and the dependence between variables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.operators import glm, grid, isimip3, predictors
from isobar.plans import downscale

DAYS = [dt.date(2000, 1, 1) + dt.timedelta(5 * i) for i in range(292)]


def _fields(spark, rng, lat=40.0):
    rows = [(d, v, loc, lat, float(loc), float(rng.normal() + loc)) for d in DAYS for v in ("psl", "tas", "hus") for loc in (1, 2)]
    return spark.createDataFrame(rows, "t date, var string, loc_id int, lat double, lon double, value double")


def test_predictor_set_by_variable_combined_and_both(spark):
    rows = _fields(spark, np.random.default_rng(1))
    single = predictors.PredictorSet.fit(rows, n=1)
    both = predictors.PredictorSet.fit(rows, combine=["tas", "psl"], combined_only=False)
    only = predictors.PredictorSet.fit(rows, combine=["tas", "psl"], n=3)
    size = lambda s: s.transform(rows).select(F.size("x").alias("n")).distinct().collect()
    assert [r["n"] for s in (single, both, only) for r in size(s)] == [3, 6, 3]
    got = {r["t"]: r["x"] for r in single.transform(rows).collect()}
    table = rows.filter("var = 'hus'").toPandas().pivot(index="t", columns="loc_id", values="value").loc[DAYS].to_numpy()
    z = (table - table.mean(axis=0)) / table.std(axis=0, ddof=1)
    v = np.linalg.eigh(z.T @ z)[1][:, -1]
    mine = np.array([got[d][0] for d in DAYS])
    assert np.abs(mine) == pytest.approx(np.abs(z @ v), abs=1e-9)


def test_new_data_must_have_the_variables_and_places(spark):
    rows = _fields(spark, np.random.default_rng(2))
    fitted = predictors.PredictorSet.fit(rows, n=1)
    extra = rows.unionByName(rows.filter("var = 'tas'").withColumn("var", F.lit("other")))
    assert fitted.transform(extra).count() == len(DAYS)
    with pytest.raises(ValueError, match="variables"):
        fitted.transform(rows.filter("var <> 'tas'"))
    with pytest.raises(ValueError, match="coordinates"):
        fitted.transform(rows.withColumn("lat", F.col("lat") + 0.01))
    assert fitted.transform(rows.withColumn("lat", F.col("lat") + 0.0001)).count() == len(DAYS)
    with pytest.raises(ValueError, match="loc_id"):
        fitted.transform(rows.filter("loc_id = 1"))
    with pytest.raises(ValueError, match="unknown"):
        predictors.PredictorSet.fit(rows, combine=["zg"])


def test_random_folds_and_fractions(spark):
    rows = spark.createDataFrame([(d,) for d in DAYS] * 2, "t date")
    folds = {r["t"]: r["fold"] for r in grid.random_folds(rows, 3).collect()}
    assert len(folds) == len(DAYS) and sorted(np.bincount(list(folds.values()))[1:]) == [97, 97, 98]
    assert folds == {r["t"]: r["fold"] for r in grid.random_folds(rows.repartition(7), 3).collect()}
    assert folds != {r["t"]: r["fold"] for r in grid.random_folds(rows, 3, seed=2).collect()}
    split = {r["t"]: r["train"] for r in grid.fraction_split(rows, 0.75).collect()}
    assert [split[d] for d in DAYS] == [True] * 219 + [False] * 73
    mixed = [r["train"] for r in grid.fraction_split(rows, 0.75, chronological=False).orderBy("t").collect()]
    assert sum(mixed) == 219 and mixed != sorted(mixed, reverse=True)
    with pytest.raises(ValueError):
        grid.fraction_split(rows, 1.5)


def _linear(spark, rng, sites=(1, 2)):
    x = rng.normal(size=(len(DAYS), 2))
    xs = spark.createDataFrame([(d, a.tolist()) for d, a in zip(DAYS, x, strict=True)], "t date, x array<double>")
    ys = [(s, 40.0 + s, d, float(s + a @ [2.0, -1.0])) for s in sites for d, a in zip(DAYS, x, strict=True)]
    return xs, spark.createDataFrame(ys, "loc_id int, lat double, t date, y double"), x


@pytest.mark.parametrize("kind", ["random", "kfold", "loocv"])
def test_cross_validation_recovers_a_linear_model(spark, kind):
    x, y, _ = _linear(spark, np.random.default_rng(3))
    out = downscale.downscale(y.drop("lat"), x, cross_val=kind, folds=3).join(y, ["loc_id", "t"])
    r = out.agg(F.count("*").alias("n"), F.max(F.abs(F.col("prediction") - F.col("y"))).alias("e")).first()
    assert r["n"] == 2 * len(DAYS) and r["e"] < 1e-8


@pytest.mark.parametrize("method", ["glm", "lm"])
def test_a_predictand_of_zeros_and_ones_gives_prob_and_bin(spark, method):
    x, y, _ = _linear(spark, np.random.default_rng(4))
    noisy = y.drop("lat").withColumn("y", (F.col("y") + F.pmod(F.crc32(F.col("t").cast("string")), F.lit(100)) / 50 > 2).cast("double"))
    out = downscale.downscale(noisy, x, method=method, cross_val="kfold", folds=2).join(noisy, ["loc_id", "t"]).toPandas()
    assert set(out.columns) == {"loc_id", "t", "prob", "bin", "y"} and set(out["bin"]) == {0, 1}
    assert (out["bin"] == out["y"]).mean() > 0.8
    for _, g in out.groupby("loc_id"):
        assert abs(g["bin"].mean() - g["y"].mean()) < 0.08
    drawn = downscale.downscale(noisy, x, method="glm", cross_val="kfold", folds=2, simulate=True).toPandas()
    assert (drawn["prob"] == drawn["bin"]).all()


def test_mixed_predictors_and_complete_days(spark):
    rng = np.random.default_rng(5)
    x, y, values = _linear(spark, rng)
    local = {(s, d): float(rng.normal()) for s in (1, 2) for d in DAYS}
    own = spark.createDataFrame([(s, d, [v]) for (s, d), v in local.items()], "loc_id int, t date, x array<double>")
    z = y.drop("lat").join(own.select("loc_id", "t", F.col("x")[0].alias("v")), ["loc_id", "t"]).withColumn("y", F.col("y") + F.col("loc_id") * F.col("v")).drop("v")
    both = predictors.mixed(x, own)
    assert both.filter(F.size("x") == 3).count() == 2 * len(DAYS)
    out = downscale.train_predict(z, both, both, "lm").join(z, ["loc_id", "t"])
    assert out.agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 1e-8
    with pytest.raises(ValueError):
        downscale.train_predict(z, both, both, "analogs")
    gap = z.withColumn("y", F.when((F.col("t") == DAYS[3]) & (F.col("loc_id") == 1), None).otherwise(F.col("y"))).filter((F.col("t") != DAYS[7]) | (F.col("loc_id") == 2))
    assert {r["t"] for r in downscale.complete_days(gap).collect()} == set(DAYS) - {DAYS[3], DAYS[7]}
    multi = downscale.train_predict(gap, both, both, "lm", site="multi").join(z, ["loc_id", "t"])
    assert multi.agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 1e-8


def test_chunks_go_on_where_they_stopped(spark, tmp_path):
    x, y, _ = _linear(spark, np.random.default_rng(6))
    path = str(tmp_path / "chunks")
    whole = downscale.downscale(y.drop("lat"), x)
    got = downscale.downscale_chunks(y, x, {"now": x, "later": x.limit(5)}, path, "lm")
    assert got.count() == 2 * (len(DAYS) + 5) and {r["lat"] for r in got.select("lat").distinct().collect()} == {41.0, 42.0}
    near = got.filter("dataset = 'now'").join(whole.withColumnRenamed("prediction", "p"), ["loc_id", "t"])
    assert near.agg(F.max(F.abs(F.col("prediction") - F.col("p")))).first()[0] < 1e-8
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "chunks" / "lat=41.0").iterdir()}
    (tmp_path / "chunks" / "lat=42.0" / "_SUCCESS").unlink()
    again = downscale.downscale_chunks(y, x, {"now": x, "later": x.limit(5)}, path, "lm")
    assert again.count() == 2 * (len(DAYS) + 5)
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "chunks" / "lat=41.0").iterdir()}
    with pytest.raises(ValueError):
        downscale.downscale_chunks(y, x, {}, path, "lm")


def test_copula_changes_dependence_and_keeps_margins(spark):
    rng = np.random.default_rng(7)
    days = [dt.date(2001, 1, 1) + dt.timedelta(i) for i in range(31)] + [dt.date(y, 1, d) for y in range(2002, 2012) for d in range(1, 32)]
    n = len(days)
    o = rng.multivariate_normal([0, 0], [[1, 0.8], [0.8, 1]], n)
    p, s = rng.normal(size=(n, 2)), rng.normal(size=(n, 2))
    margin = 3 * s + 10
    margin[4, 0] = np.nan
    train = spark.createDataFrame([(1, d, v, float(a[i]), float(b[i])) for d, a, b in zip(days, o, p, strict=True) for i, v in enumerate(("pr", "tas"))], "loc_id int, t date, var string, o double, p double")
    rows = [(k, d, v, float(a[i]), None if np.isnan(c[i]) else float(c[i])) for k in (1, 2) for d, a, c in zip(days, s, margin, strict=True) for i, v in enumerate(("pr", "tas"))]
    sim = spark.createDataFrame(rows, "loc_id int, t date, var string, s double, corrected double")
    out = isimip3.correct_copula(train, sim, ["loc_id"]).toPandas()
    assert len(out) == 4 * n
    one = out[out["loc_id"] == 1].pivot(index="t", columns="var", values="corrected").loc[days].to_numpy()
    assert np.sort(one, axis=0) == pytest.approx(np.sort(margin, axis=0), nan_ok=True)
    assert np.isnan(one[4, 0]) and one[4, 1] == pytest.approx(margin[4, 1])
    ok = np.isfinite(one).all(axis=1)
    assert np.corrcoef(one[ok].T)[0, 1] > 0.6 and abs(np.corrcoef(margin[ok].T)[0, 1]) < 0.2
    two = out[out["loc_id"] == 2].pivot(index="t", columns="var", values="corrected").loc[days].to_numpy()
    assert two == pytest.approx(margin, nan_ok=True)


@pytest.mark.parametrize("n", [1, 3])
def test_closest_cells_equal_brute_force(spark, n):
    rng = np.random.default_rng(8)
    cells = np.vstack((rng.integers(0, 12, (80, 2)), rng.normal(60, 0.01, (40, 2)))).astype(float)
    points = np.vstack((rng.integers(-3, 16, (60, 2)), rng.normal(60, 0.02, (10, 2)), [[-500.0, 900.0]])).astype(float)
    table = lambda x: spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(999, None, 1.0)], "loc_id int, lat double, lon double")
    d = ((points[:, None] - cells[None]) ** 2).sum(axis=2)
    want = {(i, int(c)) for i, row in enumerate(d) for c in np.lexsort((np.arange(len(cells)), row))[:n]}
    assert {(r["loc_id"], r["cell_id"]) for r in grid.neighbours(table(points), table(cells), n).collect()} == want
    if n == 1:
        assert {tuple(r) for r in grid.nearest(table(points), table(cells)).select("loc_id", "cell_id").collect()} == want
    few = grid.neighbours(table(points[:4]), table(cells[:2]), 3).collect()
    assert len(few) == 8
    assert grid.nearest(table(points), table(cells).limit(0)).isEmpty() and grid.nearest(table(points).limit(0), table(cells)).isEmpty()


def test_network_with_dropouts_learns_and_its_weights_differ(spark):
    rng = np.random.default_rng(9)
    x = rng.uniform(-1, 1, (400, 4))
    y = x.sum(axis=1)
    rows = spark.createDataFrame([(0, a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "site int, x array<double>, y double")
    fit = lambda **o: glm.neural(rows, ["site"], epochs=150, rate=0.05, **o)
    plain, dropped = fit(), fit(visible_dropout=0.1, hidden_dropout=0.2)
    out = glm.neural_predict(rows, dropped, ["site"]).select("y", F.col("prediction")[0].alias("p")).toPandas()
    assert out.corr().loc["y", "p"] > 0.95
    assert plain.first()["weights"] != dropped.first()["weights"] and dropped.first()["weights"] == dropped.first()["weights"]
    with pytest.raises(ValueError):
        fit(hidden_dropout=1.0)
