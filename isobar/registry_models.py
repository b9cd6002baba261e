"""More queries: monthly methods, quantile-map parts, analogs, models, and fitted kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from isobar.operators import analogs, glm, grid, isimip1, isimip3, kernels, native, predictors
from isobar.plans import downscale, fixtures
from isobar.plans.fixtures import KEYS
from isobar.registry import _T20, _interp, _list, _out, _query, _ties, rounded

_MONTH = """, eo AS (SELECT loc_id, t, month(t) AS mon, o, avg(o) OVER (PARTITION BY loc_id, year(t), month(t)) AS mm FROM tr),
ep AS (SELECT loc_id, t, month(t) AS mon, p, avg(p) OVER (PARTITION BY loc_id, year(t), month(t)) AS mm FROM tr),
co AS (SELECT loc_id, mon, avg(mm) AS co FROM (SELECT DISTINCT loc_id, mon, year(t) AS y, mm FROM eo) GROUP BY 1, 2),
cp AS (SELECT loc_id, mon, avg(mm) AS cp FROM (SELECT DISTINCT loc_id, mon, year(t) AS y, mm FROM ep) GROUP BY 1, 2),
ro AS (SELECT loc_id, mon, o - mm AS ao, row_number() OVER (PARTITION BY loc_id, mon ORDER BY o - mm) AS r FROM eo),
rp AS (SELECT loc_id, mon, p - mm AS ap, row_number() OVER (PARTITION BY loc_id, mon ORDER BY p - mm) AS r FROM ep),
sl AS (SELECT loc_id, mon, sum(ao * ap) / nullif(sum(ao * ao), 0) AS b FROM ro JOIN rp USING (loc_id, mon, r) GROUP BY 1, 2),
es AS (SELECT loc_id, t, month(t) AS mon, s, avg(s) OVER (PARTITION BY loc_id, year(t), month(t)) AS mm FROM si)
SELECT loc_id, t, round(coalesce(b, 1.0) * (s - mm) + mm + co - cp, 4) + 0.0 AS corrected FROM es LEFT JOIN sl USING (loc_id, mon) LEFT JOIN co USING (loc_id, mon) LEFT JOIN cp USING (loc_id, mon)"""


@_query("isimip_additive", _MONTH)
def _additive(spark, sf_dir):
    train, sim = fixtures.split(fixtures.temperature(spark, sf_dir))
    return _out(isimip1.additive(train, sim, KEYS), "loc_id", "t")


@_query("isimip_ratio_wind", """, m AS (SELECT loc_id, avg(o) AS mo, avg(p) AS mp FROM tr GROUP BY 1)
SELECT loc_id, t, round(CASE WHEN s = 0 THEN s / 3 ELSE s / 3 * ((s - mp + mo) / s) END, 4) + 0.0 AS corrected FROM si LEFT JOIN m USING (loc_id)""")
def _wind(spark, sf_dir):
    train, sim = fixtures.split(fixtures.temperature(spark, sf_dir))
    done = native.scaling(train, sim, KEYS).select("loc_id", "t", (F.col("s") / 3).alias("x"), F.col("s").alias("driver"), F.col("corrected").alias("corrected_driver"))
    return _out(isimip1.component(done), "loc_id", "t")


@_query("isimip_tasmax", """, k AS (SELECT loc_id, month(t) AS mon, sum(o * 1.2::DOUBLE + 5 - o) / nullif(sum(p * 1.1::DOUBLE + 3 - p), 0) AS k FROM tr GROUP BY 1, 2),
m AS (SELECT loc_id, avg(o) AS mo, avg(p) AS mp FROM tr GROUP BY 1)
SELECT si.loc_id, t, round(k * (s * 1.1::DOUBLE + 3 - s) + (s - mp + mo), 4) + 0.0 AS corrected FROM si LEFT JOIN k ON si.loc_id = k.loc_id AND month(t) = mon LEFT JOIN m ON m.loc_id = si.loc_id""")
def _extreme(spark, sf_dir):
    train, sim = fixtures.split(fixtures.temperature(spark, sf_dir))
    done = native.scaling(train, sim, KEYS)
    tr = train.select("loc_id", "t", (F.col("o") * 1.2 + 5).alias("o_x"), F.col("o").alias("o_m"), (F.col("p") * 1.1 + 3).alias("p_x"), F.col("p").alias("p_m"))
    si = done.select("loc_id", "t", (F.col("s") * 1.1 + 3).alias("s_x"), F.col("s").alias("s_m"), F.col("corrected").alias("s_c"))
    return _out(isimip1.ratio_extreme(tr, si, KEYS), "loc_id", "t")


_P20 = [i / 20 for i in range(21)]
_MULT = "vo * greatest(0.01::DOUBLE, least(100.0::DOUBLE, CASE WHEN vh = 0 THEN 1 ELSE vf / vh END))"
_WEIGHT = "CASE WHEN vh >= vo THEN 1.0::DOUBLE WHEN vo < 9 * vh THEN 0.5::DOUBLE * (1 + cos((vo / vh - 1) * pi() / 8)) ELSE 0.0::DOUBLE END"
for _name, _target in (("additive", "vo + vf - vh"), ("multiplicative", _MULT), ("mixed", f"{_WEIGHT} * ({_MULT}) + (1 - {_WEIGHT}) * (vo + vf - vh)")):

    def _trend_map(spark, sf_dir, kind=_name):
        """Quantile map that keeps the simulated change, over 21 quantiles; mixed on rain, where both kinds occur."""
        train, sim = fixtures.split(fixtures.precipitation(spark, sf_dir) if kind == "mixed" else fixtures.temperature(spark, sf_dir))
        return _out(isimip3.trend_map(train, sim, KEYS, kind, 20), "loc_id", "t")

    _rain = "p" if _name == "mixed" else ""
    _query(f"qm_nonparam_{_name}", f""", q AS (SELECT loc_id, quantile_cont(o::DOUBLE, {_list(_P20)}) AS qo, quantile_cont(p::DOUBLE, {_list(_P20)}) AS qh FROM tr{_rain} GROUP BY 1),
z AS (SELECT loc_id, quantile_cont(s::DOUBLE, {_list(_P20)}) AS qf FROM si{_rain} GROUP BY 1), y AS (SELECT loc_id, qo, qh, qf, {_list(_P20)} AS p0 FROM q JOIN z USING (loc_id)),
a AS (SELECT loc_id, qo, qh, qf, p0, {_ties('qf', 'p0')} AS p1 FROM y), b AS (SELECT loc_id, t, qo, qh, qf, p0, {_interp('s', 'qf', 'p1')} AS k FROM si{_rain} JOIN a USING (loc_id)),
v AS (SELECT loc_id, t, {_interp('k', 'p0', 'qo')} AS vo, {_interp('k', 'p0', 'qh')} AS vh, {_interp('k', 'p0', 'qf')} AS vf FROM b)
SELECT loc_id, t, round({_target}, 4) + 0.0 AS corrected FROM v""")(_trend_map)


@_query("qm_brute_force", """, n AS (SELECT loc_id, count(*) AS n FROM si GROUP BY 1), v AS (SELECT loc_id, list_sort(list(o)) AS y, count(*) AS m FROM tr GROUP BY 1),
r AS (SELECT loc_id, t, (rank() OVER (PARTITION BY loc_id ORDER BY s) + count(*) OVER (PARTITION BY loc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND CURRENT ROW) / 2.0::DOUBLE - 0.5::DOUBLE - 1) AS k FROM si),
h AS (SELECT loc_id, t, y, k / n * (m - 1) AS h FROM r JOIN n USING (loc_id) JOIN v USING (loc_id))
SELECT loc_id, t, round(y[1 + CAST(floor(h) AS BIGINT)] + (h - floor(h)) * (y[1 + CAST(ceil(h) AS BIGINT)] - y[1 + CAST(floor(h) AS BIGINT)]), 4) + 0.0 AS corrected FROM h""")
def _brute(spark, sf_dir):
    from pyspark.sql import Window

    from isobar.functions.quantile import sorted_values

    train, sim = fixtures.split(fixtures.temperature(spark, sf_dir))
    w = Window.partitionBy(*KEYS)
    tied = F.count("*").over(w.orderBy("s").rangeBetween(Window.currentRow, Window.currentRow))
    k = F.rank().over(w.orderBy("s")) + tied / 2.0 - 0.5 - 1
    r = sim.withColumn("k", k).withColumn("n", F.count("*").over(w)).join(train.groupBy(*KEYS).agg(sorted_values("o").alias("y")), KEYS)
    h = F.col("k") / F.col("n") * (F.size("y") - 1)
    lo, hi = F.get("y", F.floor(h).cast("int")), F.get("y", F.ceil(h).cast("int"))
    return _out(r.withColumn("corrected", lo + (h - F.floor(h)) * (hi - lo)), "loc_id", "t")


_CCS = "CASE WHEN o < h AND f < h THEN CASE WHEN h <= 0 THEN 0 ELSE o * f / h END WHEN o > h AND f > h THEN CASE WHEN h >= 1 THEN 1 ELSE 1 - (1 - o) * (1 - f) / (1 - h) END ELSE o + f - h END"


@_query("ccs_transfer", f""", d AS (SELECT loc_id, avg(CASE WHEN o < 1 THEN 1.0::DOUBLE ELSE 0 END) AS o, avg(CASE WHEN p < 1 THEN 1.0::DOUBLE ELSE 0 END) AS h FROM trp GROUP BY 1),
e AS (SELECT loc_id, avg(CASE WHEN s < 1 THEN 1.0::DOUBLE ELSE 0 END) AS f FROM sip GROUP BY 1)
SELECT loc_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, {_CCS})), 4) + 0.0 AS p FROM d JOIN e USING (loc_id)""")
def _ccs(spark, sf_dir):
    train, sim = fixtures.split(fixtures.precipitation(spark, sf_dir))
    dry = lambda c: F.avg(F.when(F.col(c) < 1, 1.0).otherwise(0.0))
    d = train.groupBy(*KEYS).agg(dry("o").alias("o"), dry("p").alias("h")).join(sim.groupBy(*KEYS).agg(dry("s").alias("f")), KEYS)
    return d.select("loc_id", rounded(isimip3.transfer_change_column(F.col("o"), F.col("h"), F.col("f"))).alias("p"))


_VECTORS = """SELECT * FROM (WITH d AS (SELECT q.vec_id AS target, c.vec_id AS day, c.label AS value, sqrt(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS dist
FROM embeddings q, embeddings c WHERE q.vec_id % 2 = 1 AND c.vec_id % 2 = 0),
b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY target ORDER BY dist, day) <= 4) SELECT target, round({f}, 4) + 0.0 AS value FROM b GROUP BY 1)"""
for _name, _f in (("mean", "avg(value::DOUBLE)"), ("wmean", "sum(value / greatest(dist, 1e-12::DOUBLE)) / sum(1 / greatest(dist, 1e-12::DOUBLE))"), ("max", "max(value::DOUBLE)"), ("min", "min(value::DOUBLE)"), ("prc90", "quantile_cont(value::DOUBLE, 0.9::DOUBLE)")):

    def _analogs(spark, sf_dir, fun=_name):
        v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        train = v.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("day"), F.col("embedding").alias("x"))
        target = v.filter("vec_id % 2 = 1").select(F.col("vec_id").alias("target"), F.col("embedding").alias("x"))
        values = v.select(F.col("vec_id").alias("day"), F.lit(0).alias("site"), F.col("label").cast("double").alias("value"))
        return _out(analogs.predict(train, target, values, 4, fun, None), "target", value="value")

    _query(f"analogs_{_name}", _VECTORS.format(f=_f))(_analogs)


@_query("analogs_window", """, d AS (SELECT q.t AS target, c.t AS day, c.y AS value, sqrt((q.x1 - c.x1) ** 2 + (q.x2 - c.x2) ** 2 + (q.x3 - c.x3) ** 2) AS dist FROM g q, g c WHERE abs(date_diff('day', q.t, c.t)) > 7),
b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY target ORDER BY dist, day) <= 4) SELECT target, round(avg(value), 4) + 0.0 AS value FROM b GROUP BY 1""")
def _window(spark, sf_dir):
    """Every day against every day."""
    g = fixtures.predictors(spark, sf_dir).withColumn("x", F.array("x1", "x2", "x3"))
    values = g.select(F.col("t").alias("day"), F.lit(0).alias("site"), F.col("y").alias("value"))
    return _out(analogs.predict(g.select(F.col("t").alias("day"), "x"), g.select(F.col("t").alias("target"), "x"), values, 4, "mean", 7), "target", value="value")


@_query("glm_gaussian", """, l AS (SELECT regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a FROM g WHERE year(t) < 1999) SELECT t, round(a + b * x1, 4) + 0.0 AS prediction FROM g, l WHERE year(t) >= 1999""")
def _gaussian(spark, sf_dir):
    g = fixtures.predictors(spark, sf_dir).withColumn("site", F.lit(0)).withColumn("x", F.array("x1"))
    models = glm.fit_spread(g.filter("year(t) < 1999"), ["site"])
    return _out(glm.predict(g.filter("year(t) >= 1999").select("site", "t", "x"), models, ["site"]), "t", value="prediction")


@_query("cv_glm_gaussian", """, y AS (SELECT DISTINCT year(t) AS year FROM g), fo AS (SELECT year, ntile(4) OVER (ORDER BY year) AS fold FROM y),
l AS (SELECT k.fold, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a FROM g JOIN fo ON year(t) = fo.year JOIN (SELECT DISTINCT fold FROM fo) k ON k.fold <> fo.fold GROUP BY 1)
SELECT t, round(a + b * x1, 4) + 0.0 AS prediction FROM g JOIN fo ON year(t) = fo.year JOIN l USING (fold)""")
def _cv(spark, sf_dir):
    g = fixtures.predictors(spark, sf_dir)
    year = F.year("t")
    folds = grid.year_folds(g, 4, year)
    lines = glm.simple_line(grid.expand_folds(g, folds, year), ["fold"])
    out = g.withColumn("year", year).join(F.broadcast(folds), "year").join(lines, "fold")
    return _out(out.withColumn("prediction", F.col("intercept") + F.col("slope") * F.col("x1")), "t", value="prediction")


def _kernel(name, method, rain, drier=False, sql=None, **options):
    @_query(name, sql)
    def run(spark, sf_dir):
        series = fixtures.precipitation(spark, sf_dir) if rain else fixtures.temperature(spark, sf_dir)
        if drier:  # the model has more dry days than were observed, so small rain is drawn
            series = series.select(*KEYS, "t", F.col("pred").alias("obs"), F.col("obs").alias("pred"))
        train, sim = fixtures.split(series)
        return _out(kernels.correct(train, sim, KEYS, method, precipitation=rain, **options), "loc_id", "t")


#: Where the model is the wetter side no small rain is drawn, so the map is one of order statistics.
_EQM_RAIN = f""", n AS (SELECT loc_id, count(*) FILTER (o < 1) AS dry_o, count(o) AS n_o, count(p) AS n_p, list_sort(list(p)) AS vp FROM trp GROUP BY 1),
d AS (SELECT loc_id, vp, CAST(ceil(n_p * dry_o / n_o) AS BIGINT) AS k FROM n), w AS (SELECT loc_id, greatest(CASE WHEN k > 0 THEN vp[k] END, vp[k + 1]) AS wet FROM d),
q AS (SELECT loc_id, any_value(wet) AS wet, quantile_cont(o::DOUBLE, {_list(_T20)}) FILTER (o > 1) AS qo, quantile_cont(p::DOUBLE, {_list(_T20)}) FILTER (p > wet) AS qp, min(p) FILTER (p > wet) AS least_wet FROM trp JOIN w USING (loc_id) GROUP BY 1),
a AS (SELECT loc_id, wet, least_wet, qp, {_ties('qp', 'qo')} AS qo FROM q),
b AS (SELECT loc_id, t, s, wet, least_wet, qp IS NULL OR qo IS NULL AS bare, {_interp('s', 'qp', 'qo')} AS y,
  count(*) FILTER (s > wet) OVER (PARTITION BY loc_id ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / count(*) FILTER (s > wet) OVER (PARTITION BY loc_id) AS share FROM sip JOIN a USING (loc_id)),
v AS (SELECT loc_id, list_sort(list(y) FILTER (s > least_wet)) AS ys FROM b GROUP BY 1),
h AS (SELECT b.*, ys, greatest(0.0::DOUBLE, least(len(ys) * share - 1, len(ys) - 1)) AS h FROM b JOIN v USING (loc_id))
SELECT loc_id, t, round(CASE WHEN bare THEN s WHEN s > least_wet THEN y WHEN s > wet THEN coalesce(ys[1 + CAST(floor(h) AS BIGINT)] + (h - floor(h)) * (ys[1 + CAST(ceil(h) AS BIGINT)] - ys[1 + CAST(floor(h) AS BIGINT)]), 0) ELSE 0 END, 4) + 0.0 AS corrected FROM h"""
#: The variation of p ** b grows with b, so the exponent is unique; halving finds it below 16.
_PTR = """, v AS (SELECT loc_id, list(p::DOUBLE) AS ps, avg(o) AS mo, stddev_samp(o) / avg(o) AS goal FROM trp GROUP BY 1),
e AS (WITH RECURSIVE b AS (SELECT loc_id, 0 AS k, 0.0::DOUBLE AS lo, 16.0::DOUBLE AS hi FROM v
  UNION ALL SELECT loc_id, k + 1, CASE WHEN up THEN lo ELSE mid END, CASE WHEN up THEN mid ELSE hi END
  FROM (SELECT loc_id, k, lo, hi, mid, list_stddev_samp(z) / list_avg(z) >= goal AS up FROM (SELECT b.loc_id, k, lo, hi, goal, (lo + hi) / 2 AS mid, list_transform(ps, lambda x: pow(x, (lo + hi) / 2)) AS z FROM b JOIN v USING (loc_id) WHERE k < 70)))
  SELECT loc_id, CASE WHEN hi < 16 THEN (lo + hi) / 2 END AS b FROM b WHERE k = 70),
x AS (SELECT loc_id, b, mo / list_avg(list_transform(ps, lambda x: pow(x, b))) AS c FROM e JOIN v USING (loc_id))
SELECT loc_id, t, round(pow(s, b) * c, 4) + 0.0 AS corrected FROM sip JOIN x USING (loc_id)"""
_kernel("bc_eqm_precip", "eqm", True, sql=_EQM_RAIN, n_quantiles=20)
_kernel("bc_eqm_precip_drizzle", "eqm", True, True, n_quantiles=20)
_kernel("bc_pqm_gamma_precip", "pqm", True, family="gamma")
_kernel("bc_pqm_gamma", "pqm", False, family="gamma")
_kernel("bc_pqm_weibull", "pqm", False, family="weibull")
_kernel("bc_gpqm", "gpqm", False)
_kernel("bc_gpqm_precip", "gpqm", True)
_kernel("bc_ptr", "ptr", True, sql=_PTR)
_kernel("bc_dqm_precip", "dqm", True, n_quantiles=20)
_kernel("bc_qdm_precip", "qdm", True, n_quantiles=20)


@_query("isimip_precip", """, eo AS (SELECT loc_id, year(t) AS y, month(t) AS mon, o, p, avg(o) OVER (PARTITION BY loc_id, year(t), month(t)) AS mo, avg(p) OVER (PARTITION BY loc_id, year(t), month(t)) AS mp FROM trp),
mm AS (SELECT loc_id, mon, y, max(mo) AS vo, max(mp) AS vp FROM eo GROUP BY 1, 2, 3),
mf AS (SELECT loc_id, mon, sum(vo) / nullif(sum(vp), 0) AS factor, list_sort(list(vp)) AS vs, count(*) FILTER (vo <= 1) + count(*) FILTER (vp <= 0) AS n FROM mm GROUP BY 1, 2),
me AS (SELECT loc_id, mon, factor, vs[least(n, len(vs) - 1) + 1] AS eps FROM mf),
dd AS (SELECT loc_id, mon, factor, eps, count(*) FILTER (mo > 1 AND o < 1) AS dry, list_sort(list(p) FILTER (mp > eps)) AS sp FROM eo JOIN me USING (loc_id, mon) GROUP BY ALL),
de AS (SELECT loc_id, mon, factor, eps, CASE WHEN sp IS NULL OR dry = 0 THEN 0 WHEN dry >= len(sp) THEN sp[len(sp)] ELSE (sp[dry] + sp[dry + 1]) / 2 END AS thr FROM dd),
wp AS (SELECT eo.*, eps, thr, sum(CASE WHEN p <= thr THEN p ELSE 0 END) OVER k AS lost, count(*) FILTER (p > thr) OVER k AS days FROM eo JOIN de USING (loc_id, mon) WINDOW k AS (PARTITION BY loc_id, y, mon)),
p2 AS (SELECT *, CASE WHEN mp > eps AND days > 0 THEN CASE WHEN p <= thr THEN 0 ELSE p + lost / days END ELSE p END AS q FROM wp),
z AS (SELECT loc_id, mon, list_sort(list(o / mo) FILTER (mo > 1 AND o > 1)) AS zo, list_sort(list(q / mp) FILTER (mp > eps AND q > thr)) AS zp, avg(o) FILTER (mo > 1 AND o > 1) AS ao, avg(q) FILTER (mp > eps AND q > thr) AS ap FROM p2 GROUP BY 1, 2),
k AS (SELECT loc_id, mon, zo, zp, len(zo) AS n_o, len(zp) AS n_p, least(len(zo), len(zp)) AS k FROM z WHERE least(len(zo), len(zp)) > 80 AND ao > 0.01 AND ap > 0.01),
i AS (SELECT *, unnest(range(k)) AS i FROM k),
pr AS (SELECT loc_id, mon, zo[1 + CASE WHEN i = k - 1 THEN n_o - 1 ELSE CAST(floor(i * ((n_o - 1)::DOUBLE / (k - 1))) AS BIGINT) END] AS a, zp[1 + CASE WHEN i = k - 1 THEN n_p - 1 ELSE CAST(floor(i * ((n_p - 1)::DOUBLE / (k - 1))) AS BIGINT) END] AS b FROM i),
c AS (SELECT loc_id, mon, regr_slope(b, a) AS slope, regr_intercept(b, a) AS base FROM pr GROUP BY 1, 2),
es AS (SELECT loc_id, t, year(t) AS y, month(t) AS mon, s, avg(s) OVER (PARTITION BY loc_id, year(t), month(t)) AS ms FROM sip),
ws AS (SELECT es.*, factor, eps, thr, sum(CASE WHEN s <= thr THEN s ELSE 0 END) OVER k AS lost, count(*) FILTER (s > thr) OVER k AS days FROM es LEFT JOIN de USING (loc_id, mon) WINDOW k AS (PARTITION BY loc_id, y, mon)),
s2 AS (SELECT *, CASE WHEN ms > eps AND days > 0 THEN CASE WHEN s <= thr THEN 0 ELSE s + lost / days END ELSE s END AS q FROM ws)
SELECT loc_id, t, round(CASE WHEN eps IS NULL THEN s WHEN ms > eps AND q > thr AND slope IS NOT NULL THEN abs(base + slope * (q / ms)) * ms * factor ELSE q * factor END, 4) + 0.0 AS corrected FROM s2 LEFT JOIN c USING (loc_id, mon)""")
def _isimip_precip(spark, sf_dir):
    train, sim = fixtures.split(fixtures.precipitation(spark, sf_dir))
    return _out(isimip1.wet(train, sim, KEYS), "loc_id", "t")


@_query("isimip_multiplicative", """, eo AS (SELECT loc_id, year(t) AS y, month(t) AS mon, o, p, avg(o) OVER (PARTITION BY loc_id, year(t), month(t)) AS mo, avg(p) OVER (PARTITION BY loc_id, year(t), month(t)) AS mp FROM tr),
mm AS (SELECT loc_id, mon, y, max(mo) AS vo, max(mp) AS vp FROM eo GROUP BY 1, 2, 3),
mf AS (SELECT loc_id, mon, sum(vo) / nullif(sum(vp), 0) AS factor, list_sort(list(vp)) AS vs, count(*) FILTER (vo <= 1 AND vp <= 0) AS n FROM mm GROUP BY 1, 2),
me AS (SELECT loc_id, mon, factor, vs[least(n, len(vs) - 1) + 1] AS eps FROM mf),
z AS (SELECT loc_id, mon, list_sort(list(o / mo) FILTER (mo > 1 AND o > 1)) AS zo, list_sort(list(p / mp) FILTER (mp > eps AND p > 0)) AS zp, avg(o) FILTER (mo > 1 AND o > 1) AS ao, avg(p) FILTER (mp > eps AND p > 0) AS ap FROM eo JOIN me USING (loc_id, mon) GROUP BY 1, 2),
k AS (SELECT loc_id, mon, zo, zp, len(zo) AS n_o, len(zp) AS n_p, least(len(zo), len(zp)) AS k FROM z WHERE least(len(zo), len(zp)) > 80 AND ao > 0.01 AND ap > 0.01),
i AS (SELECT *, unnest(range(k)) AS i FROM k),
pr AS (SELECT loc_id, mon, zo[1 + CASE WHEN i = k - 1 THEN n_o - 1 ELSE CAST(floor(i * ((n_o - 1)::DOUBLE / (k - 1))) AS BIGINT) END] AS a, zp[1 + CASE WHEN i = k - 1 THEN n_p - 1 ELSE CAST(floor(i * ((n_p - 1)::DOUBLE / (k - 1))) AS BIGINT) END] AS b FROM i),
c AS (SELECT loc_id, mon, regr_slope(b, a) AS slope, regr_intercept(b, a) AS base FROM pr GROUP BY 1, 2),
es AS (SELECT loc_id, t, month(t) AS mon, s, avg(s) OVER (PARTITION BY loc_id, year(t), month(t)) AS ms FROM si)
SELECT loc_id, t, round(CASE WHEN eps IS NULL THEN s WHEN ms > eps AND s > 0 AND slope IS NOT NULL THEN abs(base + slope * (s / ms)) * ms * factor ELSE s * factor END, 4) + 0.0 AS corrected FROM es LEFT JOIN me USING (loc_id, mon) LEFT JOIN c USING (loc_id, mon)""")
def _isimip_mult(spark, sf_dir):
    train, sim = fixtures.split(fixtures.temperature(spark, sf_dir))
    return _out(isimip1.wet(train, sim, KEYS, product=True), "loc_id", "t")


@_query("isimip3_tas")
def _isimip3_tas(spark, sf_dir):
    train, sim = fixtures.split(fixtures.temperature(spark, sf_dir))
    return _out(isimip3.correct(train, sim, KEYS, "tas"), "loc_id", "t")


@_query("isimip3_pr")
def _isimip3_pr(spark, sf_dir):
    train, sim = fixtures.split(fixtures.precipitation(spark, sf_dir))
    return _out(isimip3.correct(train, sim, KEYS, "pr"), "loc_id", "t")


def _model(name, **options):
    @_query(name)
    def run(spark, sf_dir):
        g = fixtures.predictors(spark, sf_dir).withColumn("site", F.lit(0)).withColumn("x", F.array("x1", "x2", "x3"))
        if options.get("family") == "binomial":
            g = g.withColumn("y", (F.col("y") > 38000).cast("double"))
        fit = glm.fit if "fitting" in options else glm.fit_spread  # choices among models need one place; the rest are sums
        return _out(glm.predict(g.select("site", "t", "x"), fit(g, ["site"], **options), ["site"]), "t", value="prediction")


_model("glm_binomial", family="binomial")
_model("glm_gamma", family="gamma", link="log")
_model("glm_stepwise", fitting="stepwise")
_model("glm_lasso", fitting="L1")
_model("glm_elastic_net", fitting="L1L2")


@_query("glm_group_lasso")
def _group_lasso(spark, sf_dir):
    g = fixtures.predictors(spark, sf_dir).withColumn("g", F.lit(0)).withColumn("x", F.array(F.col("x1") / 50, "x2", "x3"))
    rows = g.select("g", "x", F.array(F.col("y") / 1e4, F.col("x1") + F.col("x2") * 3).alias("y"))
    return glm.fit_group_lasso(rows, ["g"], folds=4, grid=8).select("site", F.transform("coef", lambda c: F.round(c, 4) + 0.0).alias("coef"))


@_query("nn")
def _nn(spark, sf_dir):
    g = fixtures.predictors(spark, sf_dir).withColumn("site", F.lit(0))
    rows = g.select("site", "t", F.array(F.col("x1") / 50, F.col("x2") * 10, F.col("x3") * 10).alias("x"), (F.col("y") / 1e5).alias("y"))
    out = glm.neural_predict(rows.select("site", "t", "x"), glm.neural(rows, ["site"], epochs=50, rate=0.01), ["site"])
    return _out(out.withColumn("prediction", F.col("prediction")[0]), "t", value="prediction")


@_query("pca_predictors")
def _pca(spark, sf_dir):
    g = fixtures.predictors(spark, sf_dir).select("t", F.array("x1", "x2", "x3").alias("x"))
    out = predictors.Components.fit(g, explained=0.9).transform(g)
    return out.select("t", F.transform("x", lambda v: F.round(v, 4) + 0.0).alias("pcs"))


@_query("downscale_glm")
def _downscale(spark, sf_dir):
    g = fixtures.predictors(spark, sf_dir).select("t", F.array("x1", "x2", "x3").alias("x"))
    y = fixtures.precipitation(spark, sf_dir).select(F.col("loc_id"), "t", F.col("obs").alias("y"))
    return _out(downscale.two_stage(y, g, g), "loc_id", "t", value="prediction")


@_query("cv_random_folds", """, d AS (SELECT DISTINCT t FROM g), fo AS (SELECT t, ntile(4) OVER (ORDER BY md5('1|' || CAST(t AS VARCHAR)), t) AS fold FROM d),
l AS (SELECT k.fold, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a FROM g JOIN fo USING (t) JOIN (SELECT DISTINCT fold FROM fo) k ON k.fold <> fo.fold GROUP BY 1)
SELECT t, round(a + b * x1, 4) + 0.0 AS prediction FROM g JOIN fo USING (t) JOIN l USING (fold)""")
def _cv_random(spark, sf_dir):
    g = fixtures.predictors(spark, sf_dir)
    out = downscale.downscale(g.select(F.lit(0).alias("loc_id"), "t", "y"), g.select("t", F.array("x1").alias("x")), cross_val="random", folds=4)
    return _out(out, "t", value="prediction")


def _pair(a: str, b: str) -> str:
    return f"(({a} - avg({a}) OVER ()) / stddev_samp({a}) OVER () + ({b} - avg({b}) OVER ()) / stddev_samp({b}) OVER ()) / sqrt(2.0::DOUBLE)"


@_query("components_by_variable", f""", h AS (SELECT CAST(l_shipdate AS DATE) AS t, avg(l_quantity) AS a1, avg(l_quantity * (1 - l_tax)) AS a2, avg(l_extendedprice) AS b1, avg(l_extendedprice * (1 - l_discount)) AS b2 FROM lineitem GROUP BY 1)
SELECT t, round({_pair("b1", "b2")}, 4) + 0.0 AS price, round({_pair("a1", "a2")}, 4) + 0.0 AS quantity FROM h""")
def _by_variable(spark, sf_dir):
    """The first component of each of two variables, at two places that vary together."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    days = li.groupBy(F.to_date("l_shipdate").alias("t")).agg(F.avg(q).alias("a1"), F.avg(q * (1 - F.col("l_tax"))).alias("a2"), F.avg(p).alias("b1"), F.avg(p * (1 - F.col("l_discount"))).alias("b2"))
    cells = [F.struct(F.lit(v).alias("var"), F.lit(k).alias("loc_id"), F.col(c).alias("value")) for v, k, c in (("quantity", 1, "a1"), ("quantity", 2, "a2"), ("price", 1, "b1"), ("price", 2, "b2"))]
    rows = days.select("t", F.inline(F.array(*cells)))
    out = predictors.PredictorSet.fit(rows, n=1).transform(rows)
    return out.select("t", rounded(F.col("x")[0]).alias("price"), rounded(F.col("x")[1]).alias("quantity"))


@_query("cv_occurrence")
def _occurrence(spark, sf_dir):
    g = fixtures.predictors(spark, sf_dir)
    y = g.select(F.lit(0).alias("loc_id"), "t", (F.col("y") > 38000).cast("double").alias("y"))
    out = downscale.downscale(y, g.select("t", F.array("x1", "x2", "x3").alias("x")), method="glm", cross_val="kfold", folds=4)
    return out.select("loc_id", "t", rounded("prob").alias("prob"), "bin")


@_query("downscale_mixed", """, g2 AS (SELECT t, x1 FROM g), own AS (SELECT loc_id, t, o / 1000 AS y, p / 1000 AS v FROM tr), k AS (SELECT loc_id, t, y, v, x1 FROM own JOIN g2 USING (t)),
m AS (SELECT loc_id, avg(y) AS my, avg(v) AS mv, avg(x1) AS mx, covar_pop(y, v) AS cyv, covar_pop(y, x1) AS cyx, covar_pop(v, x1) AS cvx, var_pop(v) AS vv, var_pop(x1) AS vx FROM k GROUP BY 1),
c AS (SELECT loc_id, my, mv, mx, (cyv * vx - cyx * cvx) / (vv * vx - cvx * cvx) AS b, (cyx * vv - cyv * cvx) / (vv * vx - cvx * cvx) AS a FROM m)
SELECT loc_id, t, round(my + a * (x1 - mx) + b * (s / 1000 - mv), 4) + 0.0 AS prediction FROM si JOIN g2 USING (t) JOIN c USING (loc_id)""")
def _mixed(spark, sf_dir):
    """A day's global predictor with the site's own; prices in thousands, so predictors are of like size."""
    series = fixtures.temperature(spark, sf_dir).select("loc_id", "t", (F.col("obs") / 1000).alias("obs"), (F.col("pred") / 1000).alias("pred"))
    train, sim = fixtures.split(series)
    x = fixtures.predictors(spark, sf_dir).select("t", F.array("x1").alias("x"))
    own = lambda d, c: predictors.mixed(x, d.select("loc_id", "t", F.array(c).alias("x")))
    out = downscale.train_predict(train.select("loc_id", "t", F.col("o").alias("y")), own(train, "p"), own(sim, "s"), "lm")
    return _out(out, "loc_id", "t", value="prediction")


@_query("isimip3_copula")
def _copula(spark, sf_dir):
    """Prices and quantities: margins by scaling, their dependence by rotations."""
    warm, wet = (fixtures.split(f(spark, sf_dir)) for f in (fixtures.temperature, fixtures.precipitation))
    train, sim = (a.withColumn("var", F.lit("tas")).unionByName(b.withColumn("var", F.lit("pr"))) for a, b in zip(warm, wet, strict=True))
    done = native.scaling(train, sim, ["loc_id", "var"]).select("loc_id", "t", "var", "s", "corrected")
    return _out(isimip3.correct_copula(train, done, ["loc_id"]), "loc_id", "t", "var")


@_query("mean_bounded", """SELECT loc_id, round(avg(CASE WHEN p <= 1 THEN 0 WHEN p >= 90 THEN 100 ELSE p END::DOUBLE), 4) + 0.0 AS m FROM trp GROUP BY 1""")
def _bounded(spark, sf_dir):
    train, _ = fixtures.split(fixtures.precipitation(spark, sf_dir))
    rows = train.select("loc_id", F.col("p").alias("value"))
    out = grid.bounded_mean(rows, ["loc_id"], lower=(0.0, 1.0), upper=(100.0, 90.0))
    return out.select("loc_id", rounded(out.columns[-1]).alias("m"))
