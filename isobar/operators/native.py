"""Bias correction in closed form, as DataFrame plans.

Every method takes ``train`` (keys, t, o, p: observed and modelled) and ``sim`` (keys, t, s) and returns
sim's rows with ``corrected``. Statistics are one aggregation per side, joined back on the series keys.
Nulls are skipped, a series without usable training rows gives null, and so do infinite results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobar.functions.quantile import average_ties, interpolate, literal, quantiles, sorted_values


def finite(x: Column) -> Column:
    """Null instead of NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("double")).otherwise(x)


def fresh(df: DataFrame) -> DataFrame:
    """The same rows under new column ids, so two parts of one table can be cogrouped."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a, b)


def _stats(train: DataFrame, keys: list[str]) -> DataFrame:
    return train.groupBy(*keys).agg(F.avg("o").alias("mo"), F.avg("p").alias("mp"), F.stddev_samp("o").alias("so"), F.stddev_samp("p").alias("sp"))


def _apply(sim: DataFrame, stats: DataFrame, keys: list[str], value: Column) -> DataFrame:
    extra = [c for c in stats.columns if c not in keys]
    return sim.join(stats, keys, "left").withColumn("corrected", finite(value)).drop(*extra)


def delta(train: DataFrame, sim: DataFrame, keys: list[str]) -> DataFrame:
    """o + (mean s - mean p), on the observed dates."""
    means = train.groupBy(*keys).agg(F.avg("p").alias("mp"))
    changes = sim.groupBy(*keys).agg(F.avg("s").alias("ms"))
    return train.join(means, keys).join(changes, keys, "left").select(*keys, "t", finite(F.col("o") + (F.col("ms") - F.col("mp"))).alias("corrected"))


def scaling(train: DataFrame, sim: DataFrame, keys: list[str], kind: str = "additive") -> DataFrame:
    """s - mean p + mean o, or s / mean p * mean o."""
    if kind not in ("additive", "multiplicative"):
        raise ValueError("kind is additive or multiplicative")
    s, mo, mp = F.col("s"), F.col("mo"), F.col("mp")
    return _apply(sim, _stats(train, keys), keys, s - mp + mo if kind == "additive" else ratio(s, mp) * mo)


def mva(train: DataFrame, sim: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and variance adjustment: (s - mean p) * sd o / sd p + mean o."""
    return _apply(sim, _stats(train, keys), keys, (F.col("s") - F.col("mp")) * ratio(F.col("so"), F.col("sp")) + F.col("mo"))


def variance(train: DataFrame, sim: DataFrame, keys: list[str], precipitation: bool = False) -> DataFrame:
    """Variance scaling around the mean of the shifted simulation (temperature only)."""
    if precipitation:
        raise ValueError("variance scaling is for temperature")
    stats = _stats(train, keys).join(sim.groupBy(*keys).agg(F.avg("s").alias("ms")), keys, "left")
    shift = F.col("mo") - F.col("mp")
    pivot = F.col("ms") + shift
    return _apply(sim, stats, keys, (F.col("s") + shift - pivot) * ratio(F.col("so"), F.col("sp")) + pivot)


def loci(train: DataFrame, sim: DataFrame, keys: list[str], precipitation: bool = True, threshold: float = 1.0) -> DataFrame:
    """Local intensity scaling of precipitation: matched wet-day counts, then scaled intensities."""
    if not precipitation:
        raise ValueError("local intensity scaling is for precipitation")
    wet = train.groupBy(*keys).agg(F.count_if(F.col("o") > threshold).alias("l"), F.avg(F.when(F.col("o") > threshold, F.col("o"))).alias("wo"), F.sort_array(F.collect_list("p"), asc=False).alias("ps"))
    first = sim.groupBy(*keys).agg(F.sort_array(F.collect_list("s"), asc=False).alias("ss"))
    stats = wet.join(first, keys, "left").select(*keys, "wo", F.get("ps", F.col("l").cast("int")).alias("pp"), F.get("ss", F.col("l").cast("int")).alias("ps_"), F.col("ps"))
    above = F.filter("ps", lambda v: v > F.col("pp"))
    stats = stats.select(*keys, "wo", "pp", "ps_", F.try_divide(F.aggregate(above, F.lit(0.0), lambda a, b: a + b), F.size(above)).alias("wp"))
    value = ratio(F.col("wo") - threshold, F.col("wp") - F.col("pp")) * (F.col("s") - F.col("ps_")) + threshold
    return _apply(sim, stats, keys, F.when(value < threshold, 0.0).otherwise(value))


def taus(n: int) -> list[float]:
    """The n probabilities 1/n .. 1 - 1/n, evenly spaced."""
    return [1 / n + i * (1 - 2 / n) / (n - 1) for i in range(n)] if n > 1 else [0.5]


def eqm(train: DataFrame, sim: DataFrame, keys: list[str], n_quantiles: int | None = None, extrapolation: str = "none") -> DataFrame:
    """Empirical quantile mapping without a precipitation step.

    With ``n_quantiles`` the quantiles are aggregated natively; without, a series has as many as it has
    training rows. Beyond the model's quantiles: ``none`` takes the end of the observed ones,
    ``constant`` keeps the end's difference.
    """
    if extrapolation not in ("none", "constant"):
        raise ValueError("extrapolation is none or constant")
    if n_quantiles:
        at = literal(taus(n_quantiles))
        table = train.groupBy(*keys).agg(F.percentile("o", at).alias("qo"), F.percentile("p", at).alias("qp"))
    else:
        table = train.groupBy(*keys).agg(sorted_values("o").alias("vo"), sorted_values("p").alias("vp"), F.count("*").cast("int").alias("n"))
        even = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: 1 / F.col("n") + i * (1 - 2 / F.col("n")) / F.greatest(F.col("n") - 1, F.lit(1)))
        table = table.select(*keys, quantiles(F.col("vo"), even).alias("qo"), quantiles(F.col("vp"), even).alias("qp"))
    table = table.filter((F.get("qo", F.lit(0)).isNotNull()) & (F.get("qp", F.lit(0)).isNotNull())).withColumn("qo", average_ties(F.col("qp"), F.col("qo")))
    return _apply(sim, table, keys, interpolate(F.col("s"), F.col("qp"), F.col("qo"), "clamp" if extrapolation == "none" else "offset"))


def detrended_line(sim: DataFrame, keys: list[str], detrend: bool) -> DataFrame:
    """sim with ``trend``: its least-squares line over the order of its non-null values, or its mean."""
    if not detrend:
        return sim.withColumn("trend", F.avg("s").over(Window.partitionBy(*keys)))
    order = Window.partitionBy(*keys).orderBy("t")
    ranked = sim.withColumn("i", F.when(F.col("s").isNotNull(), F.count("s").over(order)))
    whole = Window.partitionBy(*keys)
    line = ranked.withColumn("b", F.regr_slope("s", "i").over(whole)).withColumn("a", F.regr_intercept("s", "i").over(whole))
    return line.withColumn("trend", F.coalesce(F.col("a") + F.col("b") * F.col("i"), F.avg("s").over(whole))).drop("i", "a", "b")


def dqm(train: DataFrame, sim: DataFrame, keys: list[str], n_quantiles: int, kind: str = "additive", detrend: bool = True) -> DataFrame:
    """Detrended quantile mapping without a precipitation step; tails keep the end's difference (or ratio)."""
    add = kind == "additive"
    stats = _stats(train, keys).select(*keys, "mo", "mp")
    at = literal([0.0, *[i / (n_quantiles + 1) for i in range(1, n_quantiles + 1)], 1.0])
    table = train.groupBy(*keys).agg(F.percentile("o", at).alias("qo"), F.percentile("p", at).alias("qp")).join(stats, keys)
    centred = (lambda q, m: F.transform(q, lambda v: v - F.col(m))) if add else (lambda q, m: F.transform(q, lambda v: ratio(v, F.col(m))))
    table = table.select(*keys, "mo", "mp", centred(F.col("qo"), "mo").alias("qo"), centred(F.col("qp"), "mp").alias("qp")).withColumn("qo", average_ties(F.col("qp"), F.col("qo")))
    level = F.col("s") - F.col("mp") + F.col("mo") if add else ratio(F.col("s"), F.col("mp")) * F.col("mo")
    moved = sim.join(table, keys, "left").withColumn("s0", F.col("s")).withColumn("s", level)
    moved = detrended_line(moved, keys, detrend)
    x = F.col("s") - F.col("trend") if add else ratio(F.col("s"), F.col("trend"))
    last = F.size("qp") - 1
    if add:
        y = interpolate(x, F.col("qp"), F.col("qo"), "offset") + F.col("trend")
    else:
        low, high = ratio(F.get("qo", F.lit(0)), F.get("qp", F.lit(0))), ratio(F.get("qo", last), F.get("qp", last))
        y = F.when(x < F.get("qp", F.lit(0)), x * low).when(x > F.get("qp", last), x * high).otherwise(interpolate(x, F.col("qp"), F.col("qo"))) * F.col("trend")
    return moved.withColumn("corrected", finite(y)).withColumn("s", F.col("s0")).drop("s0", "trend", "qo", "qp", "mo", "mp")


def qdm(train: DataFrame, sim: DataFrame, keys: list[str], n_quantiles: int, kind: str = "additive") -> DataFrame:
    """Quantile delta mapping without jitter: the simulated change at each quantile goes onto the observed one."""
    n = F.greatest(F.col("no"), F.col("np"), F.col("ns"))
    sides = train.groupBy(*keys).agg(sorted_values("o").alias("vo"), sorted_values("p").alias("vp"), F.count("*").alias("no"), F.count("*").alias("np"))
    sides = sides.join(sim.groupBy(*keys).agg(sorted_values("s").alias("vs"), F.count("*").alias("ns")), keys)
    lo = 1 / (n + 1)
    even = F.transform(F.sequence(F.lit(0), F.lit(n_quantiles - 1)), lambda i: lo + i * (1 - 2 * lo) / max(1, n_quantiles - 1))
    table = sides.withColumn("tau", even)
    table = table.select(*keys, "tau", *[quantiles(F.col(v), F.col("tau"), 6).alias(q) for v, q in (("vo", "qo"), ("vp", "qp"), ("vs", "qs"))])
    table = table.withColumn("ts", average_ties(F.col("qs"), F.col("tau")))
    joined = sim.join(table, keys, "left").withColumn("at", interpolate(F.col("s"), F.col("qs"), F.col("ts")))
    qp, qo = interpolate(F.col("at"), F.col("tau"), F.col("qp")), interpolate(F.col("at"), F.col("tau"), F.col("qo"))
    y = qo + (F.col("s") - qp) if kind == "additive" else qo * ratio(F.col("s"), qp)
    return joined.withColumn("corrected", finite(y)).drop("tau", "qo", "qp", "qs", "ts", "at")


def pqm_closed(train: DataFrame, sim: DataFrame, keys: list[str], family: str) -> DataFrame:
    """Parametric quantile mapping where the map has a closed form: normal, lognormal, exponential.

    Normal uses maximum likelihood (population) deviations; lognormal is normal in logarithms.
    """
    if family == "exponential":
        return _apply(sim, _stats(train, keys), keys, ratio(F.col("s"), F.col("mp")) * F.col("mo"))
    f = (lambda c: c) if family == "normal" else F.ln
    if family not in ("normal", "lognormal"):
        raise ValueError("closed forms: normal, lognormal, exponential")
    stats = train.groupBy(*keys).agg(*[g(f(F.col(c))).alias(f"{n}{c}") for c in ("o", "p") for n, g in (("m", F.avg), ("s", F.stddev_pop))])
    z = ratio(f(F.col("s")) - F.col("mp"), F.col("sp")) * F.col("so") + F.col("mo")
    return _apply(sim, stats, keys, z if family == "normal" else F.exp(z))


def precipitation_frequency(train: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Per series: dry days observed, the model's matching number, and the model's wet threshold."""
    s = train.groupBy(*keys).agg(F.count_if(F.col("o") < threshold).alias("n_dry_o"), F.count("o").alias("n_o"), F.count("p").alias("n_p"), sorted_values("p").alias("vp"))
    dry = F.ceil(F.col("n_p") * F.col("n_dry_o") / F.col("n_o")).cast("int")
    s = s.withColumn("n_dry_p", F.when(F.col("n_o") > 0, dry))
    return s.select(*keys, "n_dry_o", F.col("n_dry_p").cast("long").alias("n_dry_p"), F.greatest(F.get("vp", F.col("n_dry_p") - 1), F.get("vp", F.col("n_dry_p"))).alias("wet_from_p"))
