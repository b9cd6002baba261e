"""Queries of the engine's own operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar.operators import grid, native
from isobar.plans import api, fixtures
from isobar.plans.fixtures import KEYS, SQL

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
#: Decimal places of results, so both engines agree on sums taken in another order.
PLACES = 4
#: Moves values that lie exactly half-way off the edge, the same way on both sides.
NUDGE = 1.000000000001


def _query(name: str, sql: str | None = None):
    """Register a query; ``sql`` goes after the common tables, unless it names its own."""

    def register(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            whole = sql if "FROM embeddings" in sql else SQL + sql
            _SQL[name] = whole.replace("round(", f"round({NUDGE!r}::DOUBLE * (").replace(f", {PLACES})", f"), {PLACES})")
        return f

    return register


def rounded(value: str | Column) -> Column:
    """To PLACES, without a negative zero."""
    return F.round((F.col(value) if isinstance(value, str) else value) * NUDGE, PLACES) + 0.0


def _out(df: DataFrame, *columns: str, value: str = "corrected") -> DataFrame:
    return df.select(*columns, rounded(value).alias(value))


def _series(method: Callable, keys: list[str] | None = None, rain: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        series = fixtures.precipitation(spark, sf_dir) if rain else fixtures.temperature(spark, sf_dir, keys)
        train, sim = fixtures.split(series)
        return _out(method(train, sim, keys or KEYS), *(keys or KEYS), "t")

    return run


def _moments(value: str, train: str = "tr", sim: str = "si", keys: str = "loc_id") -> str:
    return f""", m AS (SELECT {keys}, avg(o) AS mo, avg(p) AS mp, stddev_samp(o) AS so, stddev_samp(p) AS sp FROM {train} GROUP BY ALL),
ms AS (SELECT {keys}, avg(s) AS ms FROM {sim} GROUP BY ALL)
SELECT {keys}, t, round({value}, {PLACES}) + 0.0 AS corrected FROM {sim} LEFT JOIN m USING ({keys}) LEFT JOIN ms USING ({keys})"""


_query("bc_scaling_add", _moments("s - mp + mo"))(_series(native.scaling))
_query("bc_scaling_mult", _moments("s / nullif(mp, 0) * mo"))(_series(lambda a, b, k: native.scaling(a, b, k, "multiplicative")))
_query("bc_mva", _moments("(s - mp) * (so / nullif(sp, 0)) + mo"))(_series(native.mva))
_query("bc_variance", _moments("(s + (mo - mp) - (ms + (mo - mp))) * (so / nullif(sp, 0)) + (ms + (mo - mp))"))(_series(native.variance))
_query("bc_delta", f""", mp AS (SELECT loc_id, avg(p) AS mp FROM tr GROUP BY 1), ms AS (SELECT loc_id, avg(s) AS ms FROM si GROUP BY 1)
SELECT loc_id, t, round(o + (ms - mp), {PLACES}) + 0.0 AS corrected FROM tr JOIN mp USING (loc_id) LEFT JOIN ms USING (loc_id)""")(_series(native.delta))
_query("bc_loci", f""", w AS (SELECT loc_id, count(*) FILTER (o > 1) AS l, avg(o) FILTER (o > 1) AS wo, list_reverse_sort(list(p)) AS ps FROM trp GROUP BY 1),
v AS (SELECT loc_id, list_reverse_sort(list(s)) AS ss FROM sip GROUP BY 1),
k AS (SELECT loc_id, wo, ps[l + 1] AS pp, ss[l + 1] AS s1, list_avg(list_filter(ps, lambda x: x > ps[l + 1])) AS wp FROM w LEFT JOIN v USING (loc_id)),
r AS (SELECT loc_id, t, (wo - 1) / nullif(wp - pp, 0) * (s - s1) + 1 AS c FROM sip LEFT JOIN k USING (loc_id))
SELECT loc_id, t, round(CASE WHEN c < 1 THEN 0 ELSE c END, {PLACES}) + 0.0 AS corrected FROM r""")(_series(native.loci, rain=True))
_query("bc_pqm_normal", f""", m AS (SELECT loc_id, avg(o) AS mo, avg(p) AS mp, stddev_pop(o) AS so, stddev_pop(p) AS sp FROM tr GROUP BY 1)
SELECT loc_id, t, round((s - mp) / nullif(sp, 0) * so + mo, {PLACES}) + 0.0 AS corrected FROM si LEFT JOIN m USING (loc_id)""")(_series(lambda a, b, k: native.pqm_closed(a, b, k, "normal")))
_query("bc_pqm_lognormal", f""", m AS (SELECT loc_id, avg(ln(o)) AS mo, avg(ln(p)) AS mp, stddev_pop(ln(o)) AS so, stddev_pop(ln(p)) AS sp FROM tr GROUP BY 1)
SELECT loc_id, t, round(exp((ln(s) - mp) / nullif(sp, 0) * so + mo), {PLACES}) + 0.0 AS corrected FROM si LEFT JOIN m USING (loc_id)""")(_series(lambda a, b, k: native.pqm_closed(a, b, k, "lognormal")))
_query("bc_pqm_exponential", _moments("s / nullif(mp, 0) * mo"))(_series(lambda a, b, k: native.pqm_closed(a, b, k, "exponential")))


def _interp(x: str, xs: str, ys: str, outside: str = "clamp") -> str:
    """SQL of linear interpolation over lists whose ties are already averaged."""
    k = f"len(list_filter({xs}, lambda v: v <= {x}))"
    low, high = (f"{ys}[1]", f"{ys}[len({ys})]") if outside == "clamp" else (f"{x} + ({ys}[1] - {xs}[1])", f"{x} + ({ys}[len({ys})] - {xs}[len({xs})])")
    return f"""CASE WHEN {x} IS NULL OR len({xs}) = 0 THEN NULL WHEN {k} = 0 THEN {low} WHEN {x} > {xs}[len({xs})] THEN {high} WHEN {k} = len({xs}) THEN {ys}[len({ys})]
ELSE {ys}[{k}] + ({ys}[{k} + 1] - {ys}[{k}]) * ({x} - {xs}[{k}]) / ({xs}[{k} + 1] - {xs}[{k}]) END"""


def _ties(xs: str, ys: str) -> str:
    return f"list_transform({xs}, lambda x: list_avg(list_filter(list_transform(list_zip({xs}, {ys}), lambda q: CASE WHEN q[1] = x THEN q[2] END), lambda z: z IS NOT NULL)))"


def _list(xs: list[float]) -> str:
    return "[" + ", ".join(repr(float(x)) for x in xs) + "]::DOUBLE[]"


_T20 = native.taus(20)
for _name, _how in (("none", "clamp"), ("constant", "offset")):
    _query(f"bc_eqm_{_name}", f""", q AS (SELECT loc_id, quantile_cont(o, {_list(_T20)}) AS qo, quantile_cont(p, {_list(_T20)}) AS qp FROM tr GROUP BY 1),
a AS (SELECT loc_id, qp, {_ties('qp', 'qo')} AS qo FROM q)
SELECT loc_id, t, round({_interp('s', 'qp', 'qo', _how)}, {PLACES}) + 0.0 AS corrected FROM si LEFT JOIN a USING (loc_id)""")(_series(lambda a, b, k, e=_name: native.eqm(a, b, k, 20, e)))

_DT = [0.0, *[i / 21 for i in range(1, 21)], 1.0]
_query("bc_dqm_add", f""", q AS (SELECT loc_id, avg(o) AS mo, avg(p) AS mp, quantile_cont(o, {_list(_DT)}) AS qo0, quantile_cont(p, {_list(_DT)}) AS qp0 FROM tr GROUP BY 1),
c AS (SELECT loc_id, mo, mp, list_transform(qo0, lambda v: v - mo) AS qo1, list_transform(qp0, lambda v: v - mp) AS qp FROM q),
a AS (SELECT loc_id, mo, mp, qp, {_ties('qp', 'qo1')} AS qo FROM c),
v AS (SELECT loc_id, t, s - mp + mo AS s1, row_number() OVER (PARTITION BY loc_id ORDER BY t) AS i FROM si JOIN a USING (loc_id)),
l AS (SELECT loc_id, regr_slope(s1, i) AS b, regr_intercept(s1, i) AS a FROM v GROUP BY 1),
d AS (SELECT loc_id, t, l.a + l.b * i AS trend, s1 - (l.a + l.b * i) AS x FROM v JOIN l USING (loc_id))
SELECT loc_id, t, round({_interp('x', 'qp', 'qo', 'offset')} + trend, {PLACES}) + 0.0 AS corrected FROM d JOIN a USING (loc_id)""")(_series(lambda a, b, k: native.dqm(a, b, k, 20)))


def _type6(values: str, tau: str) -> str:
    h = f"greatest(0.0::DOUBLE, least((len({values}) + 1) * p - 1, (len({values}) - 1)::DOUBLE))"
    return f"list_transform({tau}, lambda p: {values}[1 + CAST(floor({h}) AS BIGINT)] + ({h} - floor({h})) * ({values}[1 + CAST(ceil({h}) AS BIGINT)] - {values}[1 + CAST(floor({h}) AS BIGINT)]))"


for _name, _value in (("add", "{o} + (s - {p})"), ("mult", "{o} * (s / nullif({p}, 0))")):
    _map = _value.format(o=_interp("a_", "tau", "qo"), p=_interp("a_", "tau", "qp"))
    _query(f"bc_qdm_{_name}", f""", w AS (SELECT loc_id, list_sort(list(o)) AS vo, list_sort(list(p)) AS vp, count(*) AS n1 FROM tr GROUP BY 1),
z AS (SELECT loc_id, list_sort(list(s)) AS vs, count(*) AS n2 FROM si GROUP BY 1),
n AS (SELECT loc_id, vo, vp, vs, list_transform(range(20), lambda i: 1.0::DOUBLE / (greatest(n1, n2) + 1) + i * (1 - 2 * (1.0::DOUBLE / (greatest(n1, n2) + 1))) / 19) AS tau FROM w JOIN z USING (loc_id)),
q AS (SELECT loc_id, tau, {_type6('vo', 'tau')} AS qo, {_type6('vp', 'tau')} AS qp, {_type6('vs', 'tau')} AS qs FROM n),
u AS (SELECT loc_id, tau, qo, qp, qs, {_ties('qs', 'tau')} AS ts FROM q),
b AS (SELECT loc_id, t, s, tau, qo, qp, {_interp('s', 'qs', 'ts')} AS a_ FROM si LEFT JOIN u USING (loc_id))
SELECT loc_id, t, round({_map}, {PLACES}) + 0.0 AS corrected FROM b""")(_series(lambda a, b, k, e={"add": "additive", "mult": "multiplicative"}[_name]: native.qdm(a, b, k, 20, e)))


@_query("precip_freq", """, w AS (SELECT loc_id, count(*) FILTER (o < 1) AS n_dry_o, count(o) AS n_o, count(p) AS n_p, list_sort(list(p)) AS vp FROM trp GROUP BY 1),
d AS (SELECT *, CAST(ceil(n_p * n_dry_o / n_o) AS BIGINT) AS n_dry_p FROM w)
SELECT loc_id, n_dry_o, n_dry_p, greatest(CASE WHEN n_dry_p > 0 THEN vp[n_dry_p] END, vp[n_dry_p + 1]) + 0.0 AS wet_from_p FROM d""")
def _precip_freq(spark, sf_dir):
    train, _ = fixtures.split(fixtures.precipitation(spark, sf_dir))
    out = native.precipitation_frequency(train, KEYS, 1.0)
    return out.withColumn("wet_from_p", F.col("wet_from_p") + 0.0)


_FOLDS = ", y AS (SELECT DISTINCT year(t) AS year FROM f), fo AS (SELECT year, {fold} AS fold FROM y)"


def _cross(method: str, folds: int | str) -> Query:
    def run(spark, sf_dir):
        series = fixtures.temperature(spark, sf_dir)
        return _out(api.cross_validate_bias(series, KEYS, method, folds), "loc_id", "t")

    return run


_CV = """, m AS (SELECT loc_id, a.fold, avg(obs) AS mo, avg(pred) AS mp, stddev_samp(obs) AS so, stddev_samp(pred) AS sp FROM f JOIN fo AS b ON year(t) = b.year JOIN (SELECT DISTINCT fold FROM fo) AS a ON a.fold <> b.fold GROUP BY 1, 2)
SELECT f.loc_id, f.t, round({value}, 4) + 0.0 AS corrected FROM f JOIN fo ON year(t) = fo.year LEFT JOIN m ON m.loc_id = f.loc_id AND m.fold = fo.fold"""
_query("bc_kfold_scaling", _FOLDS.format(fold="ntile(4) OVER (ORDER BY year)") + _CV.format(value="pred - mp + mo"))(_cross("scaling", 4))
_query("bc_loo_mva", _FOLDS.format(fold="dense_rank() OVER (ORDER BY year)") + _CV.format(value="(pred - mp) * (so / nullif(sp, 0)) + mo"))(_cross("mva", "loo"))

_DOY = "(dayofyear({t}) - CASE WHEN dayofyear(make_date(year({t}), 12, 31)) = 366 AND dayofyear({t}) >= 60 THEN 1 ELSE 0 END)"


@_query("bc_window_scaling", f""", e AS (SELECT loc_id, o, p, w AS window_id, abs({_DOY.format(t='t')} - (w * 30 + (least(30, 365 - w * 30) + 1) / 2.0::DOUBLE)) AS gap FROM tr, range(13) AS r(w)),
m AS (SELECT loc_id, window_id, avg(o) AS mo, avg(p) AS mp FROM e WHERE least(gap, 365 - gap) <= 45 GROUP BY 1, 2)
SELECT si.loc_id, t, round(s - mp + mo, {PLACES}) + 0.0 AS corrected FROM si LEFT JOIN m ON m.loc_id = si.loc_id AND m.window_id = CAST(floor(({_DOY.format(t='t')} - 1) / 30) AS BIGINT)""")
def _window(spark, sf_dir):
    train, sim = fixtures.split(fixtures.temperature(spark, sf_dir))
    return _out(api.windowed(native.scaling, train, sim, KEYS, 90, 30), "loc_id", "t")


@_query("bc_join_members", f""", m AS (SELECT loc_id, avg(o) AS mo, avg(p) AS mp FROM trm GROUP BY 1)
SELECT loc_id, member, t, round(s - mp + mo, {PLACES}) + 0.0 AS corrected FROM sim LEFT JOIN m USING (loc_id)""")
def _joined(spark, sf_dir):
    train, sim = fixtures.split(fixtures.temperature(spark, sf_dir, ["loc_id", "member"]))
    return _out(native.scaling(train, sim, KEYS), "loc_id", "member", "t")


_query("bc_members", _moments("s - mp + mo", "trm", "sim", "loc_id, member"))(_series(native.scaling, ["loc_id", "member"]))


@_query("fill_dates", """, r AS (SELECT loc_id, min(t) AS a, max(t) AS b FROM f GROUP BY 1), d AS (SELECT loc_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS t FROM r)
SELECT loc_id, t, round(obs, 4) + 0.0 AS obs FROM d LEFT JOIN f USING (loc_id, t)""")
def _fill(spark, sf_dir):
    series = fixtures.temperature(spark, sf_dir).select("loc_id", "t", "obs")
    return _out(grid.fill_dates(series, KEYS), "loc_id", "t", value="obs")


@_query("temporal_intersection", """SELECT t, count(*) AS n FROM f WHERE loc_id % 2 = 0 AND t IN (SELECT t FROM f WHERE loc_id % 2 = 1) GROUP BY 1""")
def _intersect(spark, sf_dir):
    series = fixtures.temperature(spark, sf_dir)
    a, _ = grid.temporal_intersection(series.filter("loc_id % 2 = 0"), series.filter("loc_id % 2 = 1"))
    return a.groupBy("t").agg(F.count("*").alias("n"))


@_query("season_filter", """SELECT year(t) + CASE WHEN month(t) = 12 THEN 1 ELSE 0 END AS season_year, count(*) AS n, round(avg(obs), 4) AS mean FROM f WHERE month(t) IN (12, 1, 2) GROUP BY 1""")
def _season(spark, sf_dir):
    rows = grid.season(fixtures.temperature(spark, sf_dir), [12, 1, 2])
    return rows.groupBy(grid.season_year([12, 1, 2]).cast("long").alias("season_year")).agg(F.count("*").alias("n"), rounded(F.avg("obs")).alias("mean"))


_POINTS = """, pt AS (SELECT n_nationkey AS loc_id, -10.0::DOUBLE + 2 * (n_nationkey % 5) AS lon, 35.0::DOUBLE + 2 * (n_nationkey // 5) AS lat FROM nation),
ce AS (SELECT r_regionkey AS cell_id, -9.0::DOUBLE + 4 * (r_regionkey % 3) AS clon, 36.0::DOUBLE + 4 * (r_regionkey // 3) AS clat FROM region),
dd AS (SELECT loc_id, cell_id, (lat - clat) ** 2 + (lon - clon) ** 2 AS d FROM pt, ce)"""


@_query("nearest_interp", _POINTS + """ SELECT loc_id, cell_id FROM dd QUALIFY row_number() OVER (PARTITION BY loc_id ORDER BY d, cell_id) = 1""")
def _nearest(spark, sf_dir):
    return grid.nearest(fixtures.fine_points(spark, sf_dir), fixtures.coarse_cells(spark, sf_dir))


@_query("knn_local_predictors", _POINTS + """, b AS (SELECT loc_id, cell_id FROM dd QUALIFY row_number() OVER (PARTITION BY loc_id ORDER BY sqrt(d), cell_id) <= 3)
SELECT loc_id, row_number() OVER (PARTITION BY loc_id ORDER BY cell_id) AS k, cell_id FROM b""")
def _knn(spark, sf_dir):
    out = grid.neighbours(fixtures.fine_points(spark, sf_dir), fixtures.coarse_cells(spark, sf_dir), 3)
    return out.withColumn("k", F.col("k").cast("long"))


@_query("scale_grid", f""", m AS (SELECT loc_id, avg(p) AS m, stddev_samp(p) AS sd FROM tr GROUP BY 1) SELECT loc_id, t, round((s - m) / nullif(sd, 0), {PLACES}) + 0.0 AS scaled FROM si LEFT JOIN m USING (loc_id)""")
def _scale(spark, sf_dir):
    train, sim = fixtures.split(fixtures.temperature(spark, sf_dir))
    return _out(grid.scale(sim.withColumnRenamed("s", "value"), train.withColumnRenamed("p", "value"), KEYS), "loc_id", "t", value="scaled")


@_query("binary_grid_calibrated", """, w AS (SELECT loc_id, avg(CASE WHEN o >= 1 THEN 1.0::DOUBLE ELSE 0 END) AS f, list_sort(list(p)) AS v FROM trp GROUP BY 1),
h AS (SELECT loc_id, v, (len(v) - 1) * (1 - f) AS h FROM w), c AS (SELECT loc_id, v[1 + CAST(floor(h) AS BIGINT)] + (h - floor(h)) * (v[1 + CAST(ceil(h) AS BIGINT)] - v[1 + CAST(floor(h) AS BIGINT)]) AS thr FROM h)
SELECT loc_id, t, CASE WHEN s >= thr THEN 1 ELSE 0 END AS "binary" FROM sip LEFT JOIN c USING (loc_id)""")
def _calibrated(spark, sf_dir):
    train, sim = fixtures.split(fixtures.precipitation(spark, sf_dir))
    obs = grid.binary(train.withColumnRenamed("o", "value"), 1.0).select("loc_id", F.col("binary").alias("value"))
    out = grid.binary_calibrated(sim.withColumnRenamed("s", "value"), obs, train.withColumnRenamed("p", "value"), KEYS)
    return out.select("loc_id", "t", "binary")


@_query("trend_annual", """, y AS (SELECT loc_id, year(t) AS year, avg(obs) AS m FROM f GROUP BY 1, 2)
SELECT loc_id, round(regr_slope(m, year), 4) + 0.0 AS slope, round(regr_r2(m, year), 4) + 0.0 AS r2, count(m) AS n FROM y GROUP BY 1""")
def _trend(spark, sf_dir):
    out = grid.annual_trend(fixtures.temperature(spark, sf_dir).withColumnRenamed("obs", "value"), KEYS)
    return out.select("loc_id", rounded("slope").alias("slope"), rounded("r2").alias("r2"), "n")


@_query("ub_climatology", """, d AS (SELECT loc_id, dayofyear(t) AS doy, max(obs) AS v FROM f GROUP BY 1, 2),
a AS (SELECT loc_id, (((doy - 1 + o) % 366) + 366) % 366 + 1 AS doy, max(v) AS v FROM d, range(-5, 6) AS r(o) GROUP BY 1, 2),
b AS (SELECT loc_id, (((doy - 1 + o) % 366) + 366) % 366 + 1 AS doy, avg(v) AS v FROM a, range(-5, 6) AS r(o) GROUP BY 1, 2)
SELECT loc_id, doy, round(b.v, 4) + 0.0 AS climatology FROM b SEMI JOIN d USING (loc_id, doy)""")
def _climatology(spark, sf_dir):
    rows = fixtures.temperature(spark, sf_dir).select("loc_id", F.dayofyear("t").cast("long").alias("doy"), F.col("obs").alias("value"))
    return _out(grid.circular_mean_max(rows, KEYS, 5), "loc_id", "doy", value="climatology")


def queries() -> dict[str, Query]:
    """All engine queries."""
    from isobar import registry_models  # noqa: F401  (registers more)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL for those that SQL can express."""
    queries()
    return dict(_SQL)
