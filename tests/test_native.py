"""Closed-form corrections on hand-made series, and their invariants."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.operators import grid, kernels, native
from isobar.plans import api

D = dt.date


def series(spark, o, p, s):
    days = [D(2000, 1, 1) + dt.timedelta(i) for i in range(max(len(o), len(s)))]
    train = spark.createDataFrame([(1, days[i], o[i], p[i]) for i in range(len(o))], "loc_id int, t date, o double, p double")
    sim = spark.createDataFrame([(1, days[i], s[i]) for i in range(len(s))], "loc_id int, t date, s double")
    return train, sim, ["loc_id"]


def values(df):
    return [r["corrected"] for r in df.orderBy("t").collect()]


def test_scaling_mva_delta(spark):
    a = series(spark, [1.0, 3.0], [2.0, 6.0], [10.0])
    assert values(native.scaling(*a)) == [8.0]
    assert values(native.scaling(*a, kind="multiplicative")) == [5.0]
    assert values(native.mva(*series(spark, [0.0, 2.0], [0.0, 4.0], [4.0]))) == [2.0]
    assert values(native.delta(*series(spark, [1.0, 2.0], [0.0, 2.0], [4.0, 6.0]))) == [5.0, 6.0]


def test_nulls_and_zero_means(spark):
    assert values(native.scaling(*series(spark, [None, None], [1.0, 2.0], [3.0]))) == [None]
    assert values(native.mva(*series(spark, [1.0], [1.0], [3.0]))) == [None]
    assert values(native.scaling(*series(spark, [1.0, 3.0], [-1.0, 1.0], [3.0]), kind="multiplicative")) == [None]


def test_eqm_ties_and_extrapolation(spark):
    from isobar.functions.quantile import average_ties, interpolate, literal

    df = spark.range(1).select(average_ties(literal([1, 1, 2]), literal([5, 7, 9])).alias("y"))
    assert df.first()["y"] == [6.0, 6.0, 9.0]
    y = spark.range(1).select(*[interpolate(F.lit(x), literal([1, 1, 2]), literal([6, 6, 9]), how).alias(n) for n, x, how in (("at", 1.0, "clamp"), ("mid", 1.5, "clamp"), ("low", 0.0, "clamp"), ("off", 0.0, "offset"), ("high", 5.0, "offset"))]).first()
    assert (y["at"], y["mid"], y["low"], y["off"], y["high"]) == (6.0, 7.5, 6.0, 5.0, 12.0)


def test_quantile_types(spark):
    from isobar.functions.quantile import literal, quantiles

    got = spark.range(1).select(*[quantiles(literal([1, 2, 3, 4]), literal([0.1]), k)[0].alias(f"q{k}") for k in (7, 6, 4)]).first()
    assert got["q7"] == pytest.approx(1.3) and got["q6"] == 1.0 and got["q4"] == 1.0


def test_precipitation_flags(spark):
    a = series(spark, [0.0, 2.0], [0.0, 4.0], [4.0])
    with pytest.raises(ValueError):
        native.loci(*a, precipitation=False)
    with pytest.raises(ValueError):
        native.variance(*a, precipitation=True)
    with pytest.raises(ValueError):
        kernels.correct(*a, method="ptr")


def test_frequency_adjustment():
    n, wet_from, p = kernels.adjust_frequency(np.array([0, 0, 5.0, 9]), np.array([0, 1.0, 2, 3]), 1.0, np.random.default_rng(0))
    assert (n, wet_from, p.tolist()) == (2, 2.0, [0.0, 0.0, 2.0, 3.0])


def test_small_rain_is_drawn_from_the_values_after_the_observed_dry_ones():
    o = np.array([0, 0, 1.5, 2.5, 3.5, 9, 10, 11])
    p = np.array([0, 0.1, 0.2, 0.3])  # one of four stays dry; the rest take the observed third to eighth, six values: their mean
    n, _, got = kernels.adjust_frequency(o, p, 1.0, np.random.default_rng(0))
    assert n == 1 and got.tolist() == pytest.approx([0.0, *[np.mean([1.5, 2.5, 3.5, 9, 10, 11])] * 3])
    p = np.array([0, 0.1, 5, 6])  # only the second: up to the observed fourth
    assert kernels.adjust_frequency(o, p, 1.0, np.random.default_rng(0))[2].tolist() == pytest.approx([0.0, 2.0, 5.0, 6.0])
    o = np.concatenate((np.zeros(50), np.arange(1.5, 51.5)))
    got = kernels.adjust_frequency(o, np.zeros(40), 1.0, np.random.default_rng(0))[2]
    assert (got == 0).sum() == 20 and len(set(got[got > 0])) == 20


def test_lower_tail_of_rain_goes_on_in_proportion():
    rng = np.random.default_rng(0)
    o, p = np.concatenate((np.zeros(2000), rng.gamma(2, 3, 500))), np.concatenate((np.zeros(2000), rng.gamma(2, 4, 500)))
    s = np.concatenate((np.zeros(2000), rng.gamma(2, 4, 500)))
    seeds = [np.random.default_rng(5) for _ in range(2)]
    out = kernels.dqm(o, p, s, 1.0, seeds[0], 20, False, True)
    fo, fp, fs = (kernels._fill_zero(x, 1.0, seeds[1]) for x in (o, p, s))
    x = fs / fp.mean()
    low = x < (fp / fp.mean()).min()
    assert low.any() and out[low] == pytest.approx((fo.min() / fp.min() * fs)[low], rel=1e-9)


def test_mean_and_deviation_are_matched(spark):
    rng = np.random.default_rng(1)
    o, p = rng.normal(5, 2, 200).tolist(), rng.normal(9, 4, 200).tolist()
    train, _, keys = series(spark, o, p, p)
    sim = train.select("loc_id", "t", F.col("p").alias("s"))
    out = values(native.mva(train, sim, keys))
    assert np.mean(out) == pytest.approx(np.mean(o)) and np.std(out, ddof=1) == pytest.approx(np.std(o, ddof=1))
    mapped = values(native.eqm(train, sim, keys, 20))
    assert np.all(np.diff(np.array(mapped)[np.argsort(p)]) >= -1e-9)


def test_every_method_through_the_entry_point(spark):
    rng = np.random.default_rng(2)
    days = [D(2000, 1, 1) + dt.timedelta(i) for i in range(900)]
    rain = np.maximum(rng.gamma(1, 4, 900) - 2, 0)
    make = lambda v: spark.createDataFrame([(1, d, float(x)) for d, x in zip(days, v, strict=True)], "loc_id int, t date, value double")
    obs, pred = make(rain), make(np.maximum(rng.gamma(1, 6, 900) - 2, 0))
    for method in api.METHODS:
        options = {"isimip3": {"preset": "pr"}, "pqm": {"family": "gamma"}}.get(method, {})
        wet = method != "variance"
        out = api.bias_correct(obs, pred, method=method, precipitation=wet, **options)
        got = out.agg(F.count("corrected").alias("n"), F.avg("corrected").alias("m")).first()
        assert got["n"] == 900, method
        assert abs(got["m"] - rain.mean()) < 2.0, method
    with pytest.raises(ValueError):
        api.bias_correct(obs, pred, method="no such")


def test_folds(spark):
    rows = spark.createDataFrame([(1, D(y, 6, 1), 1.0) for y in range(2000, 2006)], "loc_id int, t date, value double")
    got = {r["year"]: r["fold"] for r in grid.year_folds(rows, 3, F.year("t")).collect()}
    assert got == {2000: 1, 2001: 1, 2002: 2, 2003: 2, 2004: 3, 2005: 3}
    with pytest.raises(ValueError):
        grid.year_folds(rows, [[2000], [2000]], F.year("t"))
    with pytest.raises(ValueError):
        grid.year_folds(rows, [[1990]], F.year("t"))
    folds = grid.year_folds(rows, 3, F.year("t"))
    assert grid.expand_folds(rows, folds, F.year("t")).count() == 6 * 2


@pytest.mark.parametrize("method", ["scaling", "delta"])
def test_windows_within_folds(spark, method):
    rng = np.random.default_rng(3)
    days = [D(y, 1, 1) + dt.timedelta(i) for y in (2001, 2002, 2003, 2005) for i in range(365)]
    year, doy = np.array([d.year for d in days]), np.array([d.timetuple().tm_yday for d in days])
    o = 10 * np.sin(doy / 58) + rng.normal(size=len(days))
    p = 3 * np.cos(doy / 58) + rng.normal(size=len(days)) + year % 7
    make = lambda v: spark.createDataFrame([(1, d, float(x)) for d, x in zip(days, v, strict=True)], "loc_id int, t date, value double")
    block = (doy - 1) // 15
    gap = np.abs(doy[None, :] - (np.arange(25) * 15 + (np.minimum(15, 365 - np.arange(25) * 15) + 1) / 2)[:, None])
    near = np.minimum(gap, 365 - gap) <= 15
    want = {}
    for i, d in enumerate(days):
        cal, own = near[block[i]] & (year != year[i]), (block == block[i]) & (year == year[i])
        want[d] = p[i] - p[cal].mean() + o[cal].mean() if method == "scaling" else o[i] + p[own].mean() - p[cal].mean()
    for options in ({"cross_val": "loo"}, {"cross_val": "kfold", "folds": 4}):
        out = api.bias_correct(make(o), make(p), method=method, window=(30, 15), **options).collect()
        assert len(out) == len(days) and {r["t"]: r["corrected"] for r in out} == pytest.approx(want, abs=1e-8)


def test_season_year_and_circular_mean(spark):
    df = spark.createDataFrame([(D(2000, 12, 15),)], "t date")
    assert df.select(grid.season_year([12, 1, 2]).alias("y")).first()["y"] == 2001
    rows = spark.createDataFrame([(1, d, v) for d, v in ((1, 1.0), (2, 2.0), (3, 3.0))], "loc_id int, doy int, value double")
    got = grid.circular_mean_max(rows, ["loc_id"], 1, 3).collect()
    assert sorted(r["climatology"] for r in got) == [3.0, 3.0, 3.0]


def test_empty_tables(spark):
    train, sim, keys = series(spark, [1.0], [1.0], [1.0])
    none = train.limit(0)
    assert values(native.scaling(none, sim, keys)) == [None]
    assert native.eqm(train, sim.limit(0), keys, 5).count() == 0
    assert grid.fill_dates(none, keys).count() == 0
