"""Trend-preserving monthly correction: additive, ratio, component and precipitation forms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isobar.operators.native import fresh


def _month(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Add the calendar month and the mean of the value's year-month."""
    w = Window.partitionBy(*keys, F.trunc("t", "MM"))
    return df.withColumn("mon", F.month("t")).withColumn("mm", F.avg(value).over(w))


def additive(train: DataFrame, sim: DataFrame, keys: list[str], direction: str = "model_on_obs") -> DataFrame:
    """Monthly mean correction, with daily anomalies scaled by a slope per calendar month.

    The slope is that of sorted modelled on sorted observed anomalies through the origin (the method's
    own direction), or of observed on modelled with ``direction='obs_on_model'``. Ranks pair within a
    calendar month, each side over its own non-null values.
    """
    k = [*keys, "mon"]
    o = _month(train.select(*keys, "t", "o"), "o", keys)
    p = _month(train.select(*keys, "t", "p"), "p", keys)
    shift_o = o.groupBy(*keys, "mon", F.trunc("t", "MM").alias("ym")).agg(F.first("mm").alias("mm")).groupBy(*k).agg(F.avg("mm").alias("co"))
    shift_p = p.groupBy(*keys, "mon", F.trunc("t", "MM").alias("ym")).agg(F.first("mm").alias("mm")).groupBy(*k).agg(F.avg("mm").alias("cp"))
    ro = o.filter("o is not null").select(*k, (F.col("o") - F.col("mm")).alias("ao"))
    rp = p.filter("p is not null").select(*k, (F.col("p") - F.col("mm")).alias("ap"))
    ro = ro.withColumn("r", F.row_number().over(Window.partitionBy(*k).orderBy("ao")))
    rp = rp.withColumn("r", F.row_number().over(Window.partitionBy(*k).orderBy("ap")))
    below = "ao" if direction == "model_on_obs" else "ap"
    slope = ro.join(rp, [*k, "r"]).groupBy(*k).agg(F.try_divide(F.sum(F.col("ao") * F.col("ap")), F.sum(F.col(below) ** 2)).alias("b"))
    s = _month(sim, "s", keys)
    out = s.join(slope, k, "left").join(shift_o, k, "left").join(shift_p, k, "left")
    value = F.coalesce("b", F.lit(1.0)) * (F.col("s") - F.col("mm")) + F.col("mm") + F.col("co") - F.col("cp")
    return out.withColumn("corrected", value).select(*sim.columns, "corrected")


def ratio_extreme(train: DataFrame, sim: DataFrame, keys: list[str]) -> DataFrame:
    """Daily extremes around a corrected mean: k (x - m) + corrected m, k per calendar month.

    train has o_x, o_m, p_x, p_m (extreme and mean); sim has s_x, s_m and the corrected mean s_c.
    """
    k = train.withColumn("mon", F.month("t")).groupBy(*keys, "mon").agg(F.try_divide(F.sum(F.col("o_x") - F.col("o_m")), F.sum(F.col("p_x") - F.col("p_m"))).alias("k"))
    out = sim.withColumn("mon", F.month("t")).join(k, [*keys, "mon"], "left")
    return out.withColumn("corrected", F.col("k") * (F.col("s_x") - F.col("s_m")) + F.col("s_c")).select(*sim.columns, "corrected")


def component(sim: DataFrame) -> DataFrame:
    """A wind component, or snowfall, scaled as its driver was: x * corrected / driver; kept where the driver is 0.

    sim has x, driver and corrected_driver.
    """
    return sim.withColumn("corrected", F.when(F.col("driver") == 0, F.col("x")).otherwise(F.col("x") * F.try_divide(F.col("corrected_driver"), F.col("driver"))))


def _wet_kernel(o, p, s, ym_o, ym_p, ym_s, mon_o, mon_p, mon_s, thr, product):
    """The staged wet-month, wet-day and intensity correction of one series."""
    t1, t2, t3 = thr

    def by_month(x, ym):
        u, inv = np.unique(ym, return_inverse=True)
        return np.bincount(inv, x) / np.bincount(inv), inv

    mo, io = by_month(o, ym_o)
    mp, ip = by_month(p, ym_p)
    ms, is_ = by_month(s, ym_s)
    out = s.copy()
    for m in range(1, 13):
        a, b, c = mon_o == m, mon_p == m, mon_s == m
        if not (a.any() and b.any() and c.any()):
            continue
        months_o, months_p = np.unique(io[a]), np.unique(ip[b])
        vo, vp = mo[months_o], mp[months_p]
        factor = vo.sum() / vp.sum() if vp.sum() else np.nan
        n = int(((vo <= t1) & (vp[: len(vo)] <= 0)).sum()) if product and len(vo) == len(vp) else int((vo <= t1).sum() + (vp <= 0).sum())
        eps_m = np.sort(vp)[min(n, len(vp) - 1)]
        wet_o = a & (mo[io] > t1)
        wet_p, wet_s = b & (mp[ip] > eps_m), c & (ms[is_] > eps_m)
        dry_days = int((o[wet_o] < t3).sum())
        eps_d = 0.0
        sp = np.sort(p[wet_p])
        if not product and len(sp) and dry_days:
            eps_d = sp[-1] if dry_days >= len(sp) else (sp[dry_days - 1] + sp[dry_days]) / 2

        def spread(x, inv, days):
            """Rain of dry days goes equally to the month's other days."""
            x = x.copy()
            for g in np.unique(inv[days]):
                d = days & (inv == g)
                dry = d & (x <= eps_d)
                if (d & ~dry).any():
                    x[d & ~dry] += x[dry].sum() / (d & ~dry).sum()
                    x[dry] = 0.0
            return x

        p2, s2 = spread(p, ip, wet_p), spread(s, is_, wet_s)
        day_o, day_p, day_s = wet_o & (o > t2), wet_p & (p2 > eps_d), wet_s & (s2 > eps_d)
        zo, zp, zs = np.sort(o[day_o] / mo[io[day_o]]), np.sort(p2[day_p] / mp[ip[day_p]]), s2[day_s] / ms[is_[day_s]]
        k = min(len(zo), len(zp))
        if k > 80 and o[day_o].mean() > 0.01 and p2[day_p].mean() > 0.01:
            slope, intercept = np.polyfit(zo[np.linspace(0, len(zo) - 1, k).astype(int)], zp[np.linspace(0, len(zp) - 1, k).astype(int)], 1)
            zs = np.abs(intercept + slope * zs)
        out[c] = s2[c]
        out[day_s] = zs * ms[is_[day_s]]
        out[c] *= factor
    return out


def wet(train: DataFrame, sim: DataFrame, keys: list[str], threshold: float | tuple[float, float, float] = 1.0, product: bool = False) -> DataFrame:
    """Precipitation form (``product`` gives the multiplicative form of radiation, pressure, wind...).

    Missing values are left out of the calibration and stay missing.
    """
    thr = (threshold,) * 3 if isinstance(threshold, (int, float)) else tuple(threshold)

    def group(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("t", kind="stable").reset_index(drop=True)
        ta, tb = pd.to_datetime(a["t"]), pd.to_datetime(b["t"])
        s = b["s"].to_numpy(dtype=float)
        good = (a["o"].notna() & a["p"].notna()).to_numpy()
        live = ~np.isnan(s)
        out = np.full(len(s), np.nan)
        if good.any() and live.any():
            ym_a, ym_b = (ta.dt.year * 12 + ta.dt.month).to_numpy(), (tb.dt.year * 12 + tb.dt.month).to_numpy()
            with np.errstate(all="ignore"):
                o, p = a["o"].to_numpy(dtype=float)[good], a["p"].to_numpy(dtype=float)[good]
                out[live] = _wet_kernel(o, p, s[live], ym_a[good], ym_a[good], ym_b[live], ta.dt.month.to_numpy()[good], ta.dt.month.to_numpy()[good], tb.dt.month.to_numpy()[live], thr, product)
        b["corrected"] = pd.Series(out).where(np.isfinite(out), None).astype(object)
        return b

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sim.schema) + ", corrected double"
    return fresh(train).groupBy(*keys).cogroup(fresh(sim).groupBy(*keys)).applyInPandas(group, schema)
