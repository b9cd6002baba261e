"""Bias correction as one call: alignment, folds, windows, members and method in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.operators import grid, isimip1, kernels, native
from isobar.operators import isimip3 as _isimip3

#: Methods of bias_correct; those of ``kernels`` fit per series in Arrow batches.
METHODS = ("delta", "scaling", "eqm", "pqm", "gpqm", "mva", "loci", "ptr", "variance", "dqm", "qdm", "isimip3")


def method_for(method: str, precipitation: bool = False, **options) -> Callable[[DataFrame, DataFrame, list[str]], DataFrame]:
    """The function (train, sim, keys) -> corrected rows of a method with its options."""
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}")
    thr = options.pop("wet_threshold", 1.0)
    if method == "delta":
        return native.delta
    if method == "scaling":
        return lambda a, b, k: native.scaling(a, b, k, options.get("scaling_type", "additive"))
    if method == "mva":
        return native.mva
    if method == "variance":
        return lambda a, b, k: native.variance(a, b, k, precipitation)
    if method == "loci":
        return lambda a, b, k: native.loci(a, b, k, precipitation, thr)
    if method == "isimip3":
        return lambda a, b, k: _isimip3.correct(a, b, k, **options)
    if method == "eqm" and not precipitation:
        return lambda a, b, k: native.eqm(a, b, k, options.get("n_quantiles"), options.get("extrapolation", "none"))
    if method == "dqm" and not precipitation and options.get("n_quantiles"):
        return lambda a, b, k: native.dqm(a, b, k, options["n_quantiles"], "additive", options.get("detrend", True))
    if method == "qdm" and not precipitation and options.get("n_quantiles") and not options.get("jitter"):
        return lambda a, b, k: native.qdm(a, b, k, options["n_quantiles"], "additive")
    if method == "pqm" and not precipitation and options.get("family", "normal") in ("normal", "lognormal", "exponential"):
        return lambda a, b, k: native.pqm_closed(a, b, k, options.get("family", "normal"))
    return lambda a, b, k: kernels.correct(a, b, k, method, precipitation=precipitation, threshold=thr, **options)


def _width_step(window: int | tuple[int, int]) -> tuple[int, int]:
    return (window, window) if isinstance(window, int) else window


def windowed(method: Callable, train: DataFrame, sim: DataFrame, keys: list[str], width: int, step: int) -> DataFrame:
    """Calibrate each block of ``step`` days on the ``width`` days around it; one job for all blocks."""
    blocks = sim.withColumn("window_id", grid.day_block("t", step))
    return method(grid.expand_windows(train, width, step), blocks, [*keys, "window_id"]).drop("window_id")


def cross_validate_bias(series: DataFrame, keys: list[str], method: str | Callable, folds: int | str | list[list[int]], window: int | tuple[int, int] | None = None, **options) -> DataFrame:
    """Correct every fold's years with a calibration on all other years; all folds in one job.

    ``series`` has keys, t, obs and pred. ``delta`` takes the fold's own observations as its base. With
    ``window`` each fold's blocks of days are calibrated on the other years' days around them.
    """
    year = F.year("t")
    table = grid.leave_one_out(series, year) if folds == "loo" else grid.year_folds(series, folds, year)
    rows = series.select(*keys, "t", F.col("obs").alias("o"), F.col("pred").alias("p"))
    train = grid.expand_folds(rows, table, year)
    sim = series.withColumn("year", year).join(F.broadcast(table), "year").select(*keys, "fold", "t", F.col("pred").alias("s"))
    group = [*keys, "fold"]
    if method == "isimip3":
        window = None  # it works per calendar month and takes no window
    if method == "delta":
        base = series.withColumn("year", year).join(F.broadcast(table), "year").select(*group, "t", "obs")
        if window is not None:
            width, step = _width_step(window)
            train = grid.expand_windows(train, width, step)
            sim, base = (x.withColumn("window_id", grid.day_block("t", step)) for x in (sim, base))
            group.append("window_id")
        means = train.groupBy(*group).agg(F.avg("p").alias("mp")).join(sim.groupBy(*group).agg(F.avg("s").alias("ms")), group)
        return base.join(means, group, "left").select(*keys, "t", native.finite(F.col("obs") + (F.col("ms") - F.col("mp"))).alias("corrected"))
    f = method if callable(method) else method_for(method, **options)
    if window is not None:
        return windowed(f, train, sim, group, *_width_step(window)).drop("fold")
    return f(train, sim, group).drop("fold")


def bias_correct(
    obs: DataFrame, pred: DataFrame, sim: DataFrame | None = None, *, method: str, keys: list[str] | None = None, precipitation: bool = False,
    cross_val: str = "none", folds: int | list[list[int]] = 10, window: int | tuple[int, int] | None = None, join_members: bool = False,
    return_raw: bool = False, points: DataFrame | None = None, cells: DataFrame | None = None, **options,
) -> DataFrame:
    """Correct ``sim`` (default ``pred``) with a calibration of ``pred`` against ``obs``.

    All three are long series (keys, t, value); obs has no member column, and pred and sim may carry
    ``member`` and ``runtime``, which are part of the series unless members are joined. ``points`` and
    ``cells`` interpolate the model to the observed locations (nearest). Results keep the observed
    season. Raises on unknown methods, differing members, and folds that share or lack years.
    """
    keys = keys or ["loc_id"]
    if join_members and window is not None:
        window = None  # members share one calibration, which has no window
    if points is not None and cells is not None:
        pred = grid.interpolate_to(pred, points, cells)
        sim = grid.interpolate_to(sim, points, cells) if sim is not None else None
    sim = pred if sim is None else sim
    extra = [c for c in ("runtime", "member") if c in pred.columns]
    if "member" in extra:
        grid.require_same(pred, sim, "member")
    group = keys if join_members else [*keys, *extra]
    o = obs.select(*keys, "t", F.col("value").alias("o"))
    train = pred.select(*keys, *extra, "t", F.col("value").alias("p")).join(o, [*keys, "t"])
    target = sim.select(*keys, *extra, "t", F.col("value").alias("s"))
    months = obs.select(F.month("t").alias("m")).distinct()
    target = target.withColumn("m", F.month("t")).join(F.broadcast(months), "m", "left_semi").drop("m")  # at most twelve rows
    if cross_val != "none":
        series = train.withColumnsRenamed({"o": "obs", "p": "pred"})
        out = cross_validate_bias(series, group, method, "loo" if cross_val == "loo" else folds, window, precipitation=precipitation, **options)
    else:
        f = method_for(method, precipitation, **options)
        if window is not None:
            out = windowed(f, train, target, group, *_width_step(window))
        else:
            out = f(train, target, group)
    if return_raw and "s" in out.columns:
        names = [c for c in out.columns if c not in ("s", "corrected")]
        return out.select(*names, F.lit("corrected").alias("var"), F.col("corrected").alias("value")).unionAll(out.select(*names, F.lit("raw").alias("var"), F.col("s").alias("value")))
    return out


def isimip(train: DataFrame, sim: DataFrame, keys: list[str], kind: str = "additive", threshold: float | tuple[float, float, float] = 1.0) -> DataFrame:
    """The first-generation monthly method: additive, precipitation or multiplicative.

    Extremes of temperature, wind components and snowfall follow their driver: see ratio_extreme and
    component in operators.isimip1.
    """
    if kind == "additive":
        return isimip1.additive(train, sim, keys)
    if kind not in ("precipitation", "multiplicative"):
        raise ValueError("kind is additive, precipitation or multiplicative")
    return isimip1.wet(train, sim, keys, threshold, product=kind == "multiplicative")
