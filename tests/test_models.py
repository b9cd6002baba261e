"""Distributions, linear models, analogs, monthly methods, sources and streams."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar import registry
from isobar.functions import dist
from isobar.operators import analogs, glm, grid, isimip3, predictors
from isobar.sources import grids
from isobar.streaming import apply


def test_incomplete_functions():
    x = np.array([0.1, 1.0, 5.0, 40.0])
    assert dist.gammainc(1.0, x) == pytest.approx(-np.expm1(-x))
    assert dist.betainc(1.0, 1.0, np.array([0.2, 0.9])) == pytest.approx([0.2, 0.9])
    assert float(dist.gammainc(2.5, 3.0)) + math.exp(-3) >= 0.5


@pytest.mark.parametrize("name", sorted(dist.FAMILIES))
def test_quantiles_invert_distribution_functions(name):
    f = dist.family(name)
    params = {"normal": (1, 2), "lognormal": (0, 0.5), "exponential": (2,), "gamma": (2, 1), "weibull": (1.5, 2), "logistic": (0, 1), "cauchy": (0, 1), "beta": (2, 3), "chi-squared": (4,), "f": (4, 9), "t": (0, 1, 5), "poisson": (4,), "geometric": (0.3,), "negative binomial": (3, 4), "rice": (2, 1), "gpd": (0.1, 1)}[name]
    p = np.array([0.05, 0.5, 0.95])
    q = f.ppf(p, *params)
    if f.discrete:
        assert (f.cdf(q, *params) >= p - 1e-9).all() and (f.cdf(q - 1, *params) < p).all()
    else:
        assert f.cdf(q, *params) == pytest.approx(p, abs=1e-8)


def test_fits_recover_parameters():
    rng = np.random.default_rng(1)
    assert dist.family("gamma").fit(rng.gamma(3, 2, 4000)) == pytest.approx((3, 0.5), rel=0.1)
    assert dist.family("weibull").fit(2 * rng.weibull(1.5, 4000)) == pytest.approx((1.5, 2), rel=0.1)
    assert dist.family("beta").fit(rng.beta(2, 5, 4000)) == pytest.approx((2, 5), rel=0.1)
    assert dist.family("normal").fit(np.array([1.0])) is None


def test_glm_matches_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    y = 1 + x @ np.array([2.0, -1.0])
    rows = spark.createDataFrame([(0, [float(v) for v in a], float(b)) for a, b in zip(x, y, strict=True)], "site int, x array<double>, y double")
    m = glm.fit(rows, ["site"]).first()
    assert m["coef"] == pytest.approx([1.0, 2.0, -1.0])
    pred = glm.predict(rows, glm.fit(rows, ["site"]), ["site"]).collect()
    assert max(abs(r["prediction"] - r["y"]) for r in pred) < 1e-8
    none = glm.predict(rows.withColumn("site", F.lit(9)), glm.fit(rows, ["site"]), ["site"])
    assert none.filter("prediction is not null").count() == 0
    assert glm.fit(rows, ["site"], fitting="stepwise").first()["coef"] == pytest.approx([1.0, 2.0, -1.0])


def test_group_lasso_drops_a_predictor_for_all_responses():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3))
    y = np.column_stack((2 * x[:, 0], -x[:, 0] + x[:, 1]))
    c = glm.group_lasso(x, y, 1e-6)
    assert c[1:] == pytest.approx(np.array([[2, -1], [0, 1], [0, 0]]), abs=1e-3)
    assert (glm.group_lasso(x, y, 0.5)[3] == 0).all()


def test_analogs_leave_out_the_window(spark):
    days = [dt.date(2000, 1, 1) + dt.timedelta(i) for i in range(20)]
    train = spark.createDataFrame([(d, [float(i)]) for i, d in enumerate(days)], "day date, x array<double>")
    target = spark.createDataFrame([(days[10], [10.0])], "target date, x array<double>")
    got = analogs.nearest_days(train, target, 2, 3).orderBy("rank").collect()
    assert [r["day"] for r in got] == [days[6], days[14]]


def test_windowed_analogs_search_all_days(spark, tmp_path):
    rng = np.random.default_rng(7)
    days = [dt.date(1996, 3, 1) + dt.timedelta(3 * i) for i in range(600)]  # 1996 to 2001
    x, y, t = rng.uniform(size=(600, 3)), rng.uniform(1, 9, 600), np.array([d.toordinal() for d in days])
    lines = [(d, *map(float, v), float(w)) for d, v, w in zip(days, x, y, strict=True)]
    spark.createDataFrame(lines, "l_shipdate date, l_quantity double, l_discount double, l_tax double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = {}
    for i, d in enumerate(days):
        dist = np.where(np.abs(t - t[i]) <= 7, np.inf, ((x - x[i]) ** 2).sum(axis=1))
        want[d] = y[np.argsort(dist)[:4]].mean()
    got = {r["target"]: r["value"] for r in registry.queries()["analogs_window"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-3)


def test_analogs_in_small_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(analogs, "TARGETS", 7)
    monkeypatch.setattr(analogs, "DAYS", 11)
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (60, 2)).astype(float)  # many ties
    rows = [(i % 2, i, v.tolist()) for i, v in enumerate(x)] + [(0, 900, None), (1, 901, [None, 1.0])]
    train = spark.createDataFrame(rows, "site int, day long, x array<double>")
    target = train.withColumnRenamed("day", "target")
    got = {(r["target"], r["rank"]): (r["day"], r["dist"]) for r in analogs.nearest_days(train, target, 3, None, ("site",)).collect()}
    assert len(got) == 180
    for i in range(60):
        near = sorted((math.sqrt(((x[i] - x[j]) ** 2).sum()), j) for j in range(60) if j % 2 == i % 2)[:3]
        assert [got[i, k] for k in (1, 2, 3)] == [(j, d) for d, j in near]


def test_mixed_map_is_multiplicative_unless_the_simulation_is_far_below():
    one = lambda o, h, f: float(isimip3.map_trend(np.full(5, o), np.full(5, h), np.full(5, f), "mixed")[0])
    assert one(1.0, 20.0, 40.0) == pytest.approx(2.0)  # times the change of two
    assert one(20.0, 1.0, 2.0) == pytest.approx(21.0)  # plus the change of one
    w = 0.5 * (1 + math.cos((3.0 - 1) * math.pi / 8))
    assert one(3.0, 1.0, 2.0) == pytest.approx(w * 6.0 + (1 - w) * 4.0)


@pytest.mark.parametrize("kind", ["additive", "multiplicative", "mixed"])
def test_trend_map_equals_the_kernel(spark, kind):
    rng = np.random.default_rng(6)
    days = [dt.date(2000, 1, 1) + dt.timedelta(i) for i in range(300)]
    o, h, f = rng.gamma(2, 1, 300), rng.gamma(2, 1.5, 300), rng.gamma(2, 3, 300)
    train = spark.createDataFrame([(1, d, float(a), float(b)) for d, a, b in zip(days, o, h, strict=True)], "loc_id int, t date, o double, p double")
    sim = spark.createDataFrame([(1, d, float(c)) for d, c in zip(days, f, strict=True)], "loc_id int, t date, s double")
    got = {r["t"]: r["corrected"] for r in isimip3.trend_map(train, sim, ["loc_id"], kind, 20).collect()}
    assert [got[d] for d in days] == pytest.approx(isimip3.map_trend(o, h, f, kind, 20).tolist())


def test_values_at_a_threshold_are_not_censored():
    preset = isimip3.Preset((0, 0.1), (1, 0.9))
    x = np.array([0.0, 0.1, 0.5, 0.9, 1.0])
    y = isimip3.censor(x, preset, np.random.default_rng(1))
    assert y[1:4].tolist() == [0.1, 0.5, 0.9] and 0 < y[0] < 0.1 and 0.9 < y[4] < 1
    assert isimip3.uncensor(y, preset).tolist() == x.tolist()


@pytest.mark.parametrize("family,link", [("gaussian", "identity"), ("binomial", "logit"), ("gamma", "log"), ("poisson", "log")])
def test_models_fitted_by_sums_equal_those_fitted_in_one_place(spark, family, link):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 2))
    mean = np.exp(0.3 + x @ [0.5, -0.2])
    y = {"gaussian": mean + rng.normal(size=500), "binomial": (rng.uniform(size=500) < mean / (1 + mean)).astype(float), "gamma": rng.gamma(3, mean / 3), "poisson": rng.poisson(mean).astype(float)}[family]
    rows = [(i % 2, float(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(0, None, [1.0, 1.0]), (1, 2.0, [None, 1.0])]
    df = spark.createDataFrame(rows, "site int, y double, x array<double>").repartition(4)
    a, b = ({r["site"]: r for r in f(df, ["site"], family, link).collect()} for f in (glm.fit_spread, glm.fit))
    for k in (0, 1):
        assert a[k]["coef"] == pytest.approx(b[k]["coef"], abs=1e-7)
        assert (a[k]["dispersion"], a[k]["aic"]) == (pytest.approx(b[k]["dispersion"], rel=1e-6), pytest.approx(b[k]["aic"], rel=1e-6))


def test_simulated_draws_depend_on_the_row_alone(spark):
    rng = np.random.default_rng(9)
    rows = [(i % 3, i, rng.normal(size=2).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "site int, t int, x array<double>")
    models = spark.createDataFrame([(0, "gamma", "log", [1.0, 0.2, 0.1], 0.5, 0.0), (1, "binomial", "logit", [0.5, 1.0, 0.0], 1.0, 0.0), (2, "gamma", "log", None, None, None)], "site int, " + glm.MODEL)
    draw = lambda d: {r["t"]: r["prediction"] for r in glm.predict(d, models, ["site"], simulate=True).collect()}
    a, b = draw(df.repartition(1)), draw(df.repartition(7))
    assert a == b
    means = {r["t"]: r["prediction"] for r in glm.predict(df, models, ["site"]).collect()}
    gamma = np.array([a[t] / means[t] for t in range(0, 600, 3)])
    assert len(set(gamma)) == 200 and gamma.mean() == pytest.approx(1, abs=0.15) and gamma.var() == pytest.approx(0.5, abs=0.2)
    assert {a[t] for t in range(1, 600, 3)} == {0.0, 1.0} and {a[t] for t in range(2, 600, 3)} == {None}


def test_change_transfer_stays_in_bounds():
    assert float(isimip3.transfer_change(0.2, 0.4, 0.2)) == pytest.approx(0.1)
    assert float(isimip3.transfer_change(0.5, 0.5, 0.7)) == pytest.approx(0.7)
    assert float(isimip3.transfer_change(0.9, 0.5, 1.0)) == 1.0


def test_isimip3_bounds_and_finiteness(spark):
    rng = np.random.default_rng(4)
    days = [dt.date(2000, 1, 1) + dt.timedelta(i) for i in range(800)]
    v = np.maximum(rng.gamma(1, 3, (3, 800)) - 1, 0)
    train = spark.createDataFrame([(1, d, float(a), float(b)) for d, a, b in zip(days, v[0], v[1], strict=True)], "loc_id int, t date, o double, p double")
    sim = spark.createDataFrame([(1, d, float(c)) for d, c in zip(days, v[2], strict=True)], "loc_id int, t date, s double")
    out = isimip3.correct(train, sim, ["loc_id"], "pr").agg(F.min("corrected").alias("lo"), F.count("corrected").alias("n")).first()
    assert out["lo"] >= 0 and out["n"] == 800


def test_isimip3_radiation_is_scaled_by_its_climatology(spark):
    rng = np.random.default_rng(8)
    days = [dt.date(2000, 1, 1) + dt.timedelta(i) for i in range(4 * 365 + 1)]
    doy = np.array([dt.date(2000, d.month, d.day).timetuple().tm_yday for d in days])
    bound = 200 - 120 * np.cos(2 * np.pi * doy / 366)
    o, p, s = (bound * rng.beta(a, 2, len(days)) for a in (4, 2, 2))
    o[5] = p[9] = s[11] = np.nan
    rows = spark.createDataFrame([(1, int(k), float(v)) for k, v in zip(doy, s, strict=True) if v == v], "loc_id int, doy int, value double")
    top = {r["doy"]: r["climatology"] for r in grid.circular_mean_max(rows, ["loc_id"], 15).collect()}
    assert isimip3.upper_climatology(s, doy, 15) == pytest.approx(np.array([top[k] for k in doy]))
    train = spark.createDataFrame([(1, d, float(a), float(b)) for d, a, b in zip(days, o, p, strict=True)], "loc_id int, t date, o double, p double")
    sim = spark.createDataFrame([(1, d, float(v)) for d, v in zip(days, s, strict=True)], "loc_id int, t date, s double")
    got = {r["t"]: r["corrected"] for r in isimip3.correct(train, sim, ["loc_id"], "rsds").collect()}
    out = np.array([got[d] for d in days])
    assert len(np.unique(out.round(6))) > 1000 and (out >= 0).all() and (out <= [top[k] + 1e-9 for k in doy]).all()
    shares = lambda x: np.nanmean(x / isimip3.upper_climatology(x, doy, 15))
    assert np.mean(out / [top[k] for k in doy]) == pytest.approx(shares(o), rel=0.05)
    ok = np.isfinite(s)
    assert np.corrcoef(out[ok] / bound[ok], s[ok] / bound[ok])[0, 1] > 0.95


def test_rotations_are_orthogonal():
    m = isimip3.rotation(4, np.random.default_rng(0))
    assert m @ m.T == pytest.approx(np.eye(4))
    r = isimip3.rotation_with_axis([1.0, 1.0, 1.0])
    assert r @ r.T == pytest.approx(np.eye(3), abs=1e-6) and abs(r[0, 0]) == pytest.approx(1 / math.sqrt(3))


def test_components_explain_variance(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=300)
    rows = spark.createDataFrame([(i, [float(u), float(2 * u + 0.01 * w)]) for i, (u, w) in enumerate(zip(a, rng.normal(size=300), strict=True))], "t int, x array<double>")
    c = predictors.Components.fit(rows, explained=0.9)
    assert c.k == 1 and len(c.transform(rows).first()["x"]) == 1


def test_grid_round_trip_and_pruning(spark, tmp_path):
    df = spark.createDataFrame([("tas", 1, 40.0, 2.0, dt.datetime(2000, 1, 1), float("nan")), ("tas", 2, 41.0, 2.0, dt.datetime(2001, 1, 1), 1.0)], "var string, loc_id long, lat double, lon double, time_start timestamp_ntz, value double")
    g = grids.as_grid(df)
    assert g.filter("value is null").count() == 1
    grids.write_grid(g, str(tmp_path / "g"))
    got = grids.read_grid(spark, str(tmp_path / "g"), ["tas"], years=[2001], lat=(40.5, 42))
    assert [r["loc_id"] for r in got.collect()] == [2]
    with pytest.raises(ValueError):
        grids.as_grid(df, kind="rotated")


def test_stream_equals_batch(spark, tmp_path):
    train = spark.createDataFrame([(1, float(i), float(2 * i)) for i in range(50)], "loc_id int, o double, p double")
    table = apply.quantile_table(train, ["loc_id"], 10)
    spark.createDataFrame([(1, 10.0), (1, 200.0), (2, 1.0)], "loc_id int, s double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("loc_id int, s double").parquet(str(tmp_path / "in"))
    q = apply.correct_stream(stream, table, ["loc_id"]).writeStream.format("memory").queryName("corrected_stream").start()
    q.processAllAvailable()
    q.stop()
    batch = apply.correct_stream(spark.read.parquet(str(tmp_path / "in")), table, ["loc_id"])
    key = lambda r: (r["loc_id"], r["s"])
    assert sorted(map(tuple, spark.table("corrected_stream").collect()), key=str) == sorted(map(tuple, batch.collect()), key=str) and key
