"""Alignment of long-format grids: calendars, seasons, folds, windows, and locations.

A grid is one row per cell: var, runtime, member, loc_id, lat, lon, time_start, time_end, value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_dates(rows: DataFrame, keys: list[str], time: str = "t") -> DataFrame:
    """A row for every day between each key's first and last; values of new rows are null."""
    span = rows.groupBy(*keys).agg(F.min(time).alias("a"), F.max(time).alias("b")).filter("a is not null")
    days = span.select(*keys, F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(time))
    return days.join(rows, [*keys, time], "left").select(*rows.columns)


def temporal_intersection(a: DataFrame, b: DataFrame, on: Sequence[str] = ("t",)) -> tuple[DataFrame, DataFrame]:
    """Both sides restricted to their common dates."""
    return a.join(b.select(*on).distinct(), list(on), "left_semi"), b.join(a.select(*on).distinct(), list(on), "left_semi")


def require_same_dates(a: DataFrame, b: DataFrame, time: str = "t") -> None:
    """Raise unless both sides have the same set of dates."""
    x, y = a.select(time).distinct(), b.select(time).distinct()
    if not x.exceptAll(y).isEmpty() or not y.exceptAll(x).isEmpty():
        raise ValueError("the dates of both grids differ")


def require_same(a: DataFrame, b: DataFrame, column: str) -> None:
    """Raise unless a column has the same distinct values on both sides (variables, members)."""
    x, y = a.select(column).distinct(), b.select(column).distinct()
    if not x.exceptAll(y).isEmpty() or not y.exceptAll(x).isEmpty():
        raise ValueError(f"{column} differs between the grids")


def require_same_coordinates(a: DataFrame, b: DataFrame, tolerance: float = 1e-3) -> None:
    """Raise unless both grids have the same locations, at coordinates that differ by less than the tolerance.

    Without lat and lon on both sides only the locations are compared.
    """
    require_same(a, b, "loc_id")
    if not all(c in x.columns for x in (a, b) for c in ("lat", "lon")):
        return
    places = b.select("loc_id", F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b")).distinct()
    off = (F.abs(F.col("lat") - F.col("lat_b")) >= tolerance) | (F.abs(F.col("lon") - F.col("lon_b")) >= tolerance)
    if not a.select("loc_id", "lat", "lon").distinct().join(places, "loc_id").filter(off).isEmpty():
        raise ValueError("the coordinates of both grids differ")


def season(rows: DataFrame, months: Sequence[int], time: str = "t") -> DataFrame:
    """Rows of these calendar months."""
    if not set(months) <= set(range(1, 13)):
        raise ValueError("months are 1..12")
    return rows.filter(F.month(time).isin(*months))


def season_year(months: Sequence[int], time: str = "t") -> Column:
    """The year a date's season belongs to: December counts to the next year if the season crosses it."""
    crosses = 12 in months and 1 in months
    return F.year(time) + F.when((F.month(time) == 12) & F.lit(crosses), 1).otherwise(0)


def year_folds(rows: DataFrame, folds: int | list[list[int]], year: Column) -> DataFrame:
    """(year, fold): consecutive groups of equal size, or the years as listed."""
    years = rows.select(year.alias("year")).distinct()
    if isinstance(folds, int):
        return years.withColumn("fold", F.ntile(folds).over(Window.orderBy("year")))
    flat = [y for f in folds for y in f]
    if len(flat) != len(set(flat)):
        raise ValueError("a year is in two folds")
    known = {r["year"] for r in years.collect()}  # one row per year
    if not set(flat) <= known:
        raise ValueError(f"years not in the data: {sorted(set(flat) - known)}")
    spark = rows.sparkSession
    return spark.createDataFrame([(y, i + 1) for i, f in enumerate(folds) for y in f], "year int, fold int")


def leave_one_out(rows: DataFrame, year: Column) -> DataFrame:
    """(year, fold): every year is its own fold."""
    return rows.select(year.alias("year")).distinct().withColumn("fold", F.dense_rank().over(Window.orderBy("year")))


def shuffled(rows: DataFrame, seed: int, time: str = "t") -> DataFrame:
    """(t, key): the distinct dates with a keyed hash that orders them at random, the same way everywhere."""
    return rows.select(time).distinct().withColumn("key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(time).cast("string"))))


def random_folds(rows: DataFrame, folds: int, seed: int = 1, time: str = "t") -> DataFrame:
    """(t, fold): dates dealt at random into folds whose sizes differ by one at most."""
    return shuffled(rows, seed, time).select(time, F.ntile(folds).over(Window.orderBy("key", time)).alias("fold"))  # a row per date


def fraction_split(rows: DataFrame, share: float, chronological: bool = True, seed: int = 1, time: str = "t") -> DataFrame:
    """(t, train): the first share of the dates (or a random one) trains, the rest tests."""
    if not 0 < share < 1:
        raise ValueError("the share lies between 0 and 1")
    w = Window.orderBy(time) if chronological else Window.orderBy("key", time)
    dates = shuffled(rows, seed, time)
    n = dates.agg(F.count("*").alias("n"))  # one row
    return dates.withColumn("r", F.row_number().over(w)).crossJoin(F.broadcast(n)).select(time, (F.col("r") <= F.round(F.col("n") * share)).alias("train"))


def expand_folds(train: DataFrame, folds: DataFrame, year: Column) -> DataFrame:
    """Training rows once for every fold that does not hold their year; all folds run in one job."""
    ids = folds.select("fold").distinct()
    own = folds.withColumnRenamed("fold", "own_fold")
    rows = train.withColumn("year", year).join(F.broadcast(own), "year")  # a row per year
    return rows.crossJoin(F.broadcast(ids)).filter("fold <> own_fold").drop("own_fold", "year")


def day_block(time: str, step: int) -> Column:
    """Block of the day of year (29 February joins 28 February)."""
    return F.floor((no_leap_day(time) - 1) / step).cast("int")


def no_leap_day(time: str) -> Column:
    """Day of year 1..365, the same calendar day every year."""
    leap = F.dayofyear(F.last_day(F.make_date(F.year(time), F.lit(12), F.lit(1)))) == 366
    return F.dayofyear(time) - F.when(leap & (F.dayofyear(time) >= 60), 1).otherwise(0)


def expand_windows(train: DataFrame, width: int, step: int, time: str = "t") -> DataFrame:
    """Training rows once for every block whose centre is within width / 2 days round the year."""
    if width < step:
        raise ValueError("the window is at least as wide as its step")
    n = -(-365 // step)
    centre = F.col("window_id") * step + (F.least(F.lit(step), 365 - F.col("window_id") * step) + 1) / 2.0
    gap = F.abs(no_leap_day(time) - centre)
    return train.withColumn("window_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).filter(F.least(gap, 365 - gap) <= width / 2)


def _closest(points: DataFrame, cells: DataFrame, n: int) -> DataFrame:
    """(loc_id, cell_id, d): each point's n nearest cells in degrees, d squared; ties go to the lower cell.

    Cells are dealt to square bins. A point looks into the nine bins around its own and is settled if its
    n-th cell is nearer than a bin is wide; the others look again in bins four times as wide, at last in
    bins as wide as the whole field. Neither table is broadcast, and no point meets all cells unless the
    cells are few or lie far away. Points and cells without coordinates take no part.
    """
    p = points.select("loc_id", "lat", "lon").filter("lat IS NOT NULL AND lon IS NOT NULL").distinct()
    c = cells.select(F.col("loc_id").alias("cell_id"), F.col("lat").alias("clat"), F.col("lon").alias("clon")).filter("clat IS NOT NULL AND clon IS NOT NULL")
    ends = lambda a, b: [f(x) for x in (a, b) for f in (F.min, F.max)]
    count, *own = c.agg(F.count("*"), *ends("clat", "clon")).first()
    other = p.agg(*ends("lat", "lon")).first()
    if not count or other[0] is None:
        return p.crossJoin(c.limit(0)).select("loc_id", "cell_id", F.lit(0.0).alias("d"))
    low, left = min(own[0], other[0]), min(own[2], other[2])
    span = max(own[1], other[1]) - low, max(own[3], other[3]) - left
    sides = own[1] - own[0], own[3] - own[2]
    share = n / count
    width = max(2 * max((sides[0] * sides[1] * share) ** 0.5, max(sides) * share), max(span) / 4**10) or 1.0
    done = None
    while True:
        last = width >= max(span)
        at = lambda lat, lon, w=width: [F.floor((F.col(x) - o) / w).cast("long") for x, o in ((lat, low), (lon, left))]
        i, j = at("lat", "lon")
        step = F.array(*[F.lit(k) for k in (-1, 0, 1)])
        looks = p.select("loc_id", "lat", "lon", F.explode(F.transform(step, lambda k: i + k)).alias("i"), j.alias("j0"))  # noqa: B023
        looks = looks.select("loc_id", "lat", "lon", "i", F.explode(F.transform(step, lambda k: F.col("j0") + k)).alias("j"))
        ci, cj = at("clat", "clon")
        pairs = looks.join(c.select("cell_id", "clat", "clon", ci.alias("i"), cj.alias("j")), ["i", "j"], "left")
        d = (F.col("lat") - F.col("clat")) ** 2 + (F.col("lon") - F.col("clon")) ** 2
        w = Window.partitionBy("loc_id", "lat", "lon")
        best = pairs.withColumn("d", d).withColumn("r", F.row_number().over(w.orderBy(F.col("d").asc_nulls_last(), "cell_id"))).filter(F.col("r") <= n)
        if not last:
            best = best.withColumn("settled", F.max("r").over(w) + F.sum(F.when(F.col("d") < width * width * (1 - 1e-9), 1).otherwise(0)).over(w) == 2 * n)
        found = (best if last else best.filter("settled")).filter("cell_id IS NOT NULL").select("loc_id", "cell_id", "d")
        done = found if done is None else done.unionAll(found)
        if last:
            return done
        p = best.filter("NOT settled AND r = 1").select("loc_id", "lat", "lon")
        if p.isEmpty():
            return done
        width *= 4


def nearest(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Each point's nearest cell in degrees (loc_id, cell_id); ties go to the lower cell."""
    return _closest(points, cells, 1).groupBy("loc_id").agg(F.min(F.struct("d", "cell_id")).alias("m")).select("loc_id", F.col("m.cell_id").alias("cell_id"))


def interpolate_to(grid: DataFrame, points: DataFrame, cells: DataFrame) -> DataFrame:
    """The grid's values at the points by nearest cell; grid rows carry loc_id of cells."""
    near = nearest(points, cells)
    return grid.withColumnRenamed("loc_id", "cell_id").join(near, "cell_id").drop("cell_id")


def bilinear(grid: DataFrame, points: DataFrame, cells: DataFrame, keys: Sequence[str] = ("t",)) -> DataFrame:
    """Values at points from the four cells around; where one is missing, the nearest cell's value."""
    lats, lons = cells.select("lat").distinct(), cells.select("lon").distinct()

    def around(p: DataFrame, axis: DataFrame, name: str) -> DataFrame:
        a = axis.withColumnRenamed(name, "c")
        return p.crossJoin(F.broadcast(a)).groupBy("loc_id", "lat", "lon").agg(F.max(F.when(F.col("c") <= F.col(name), F.col("c"))).alias(f"{name}0"), F.min(F.when(F.col("c") >= F.col(name), F.col("c"))).alias(f"{name}1"))

    box = around(points.select("loc_id", "lat", "lon"), lats, "lat").join(around(points.select("loc_id", "lat", "lon"), lons, "lon"), ["loc_id", "lat", "lon"])
    fy, fx = (F.coalesce(F.try_divide(F.col(n) - F.col(f"{n}0"), F.col(f"{n}1") - F.col(f"{n}0")), F.lit(0.0)) for n in ("lat", "lon"))
    corners = F.array(*[F.struct(F.col(f"lat{i}").alias("clat"), F.col(f"lon{j}").alias("clon"), ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("w")) for i in (0, 1) for j in (0, 1)])
    weights = box.select("loc_id", F.explode(corners).alias("k")).select("loc_id", "k.*").filter("w > 0")
    named = weights.join(cells.select(F.col("loc_id").alias("cell_id"), F.col("lat").alias("clat"), F.col("lon").alias("clon")), ["clat", "clon"], "left")
    total = grid.withColumnRenamed("loc_id", "cell_id").join(named, "cell_id").groupBy("loc_id", *keys).agg(F.sum(F.col("w") * F.col("value")).alias("v"), F.sum(F.when(F.col("value").isNotNull(), F.col("w"))).alias("w"))
    close = interpolate_to(grid, points.select("loc_id", "lat", "lon"), cells).select("loc_id", *keys, "value")
    return close.join(total, ["loc_id", *keys], "left").select("loc_id", *keys, F.when(F.col("w") > 1 - 1e-9, F.col("v")).otherwise(F.col("value")).alias("value"))


def neighbours(points: DataFrame, cells: DataFrame, n: int) -> DataFrame:
    """Each point's n nearest cells, numbered in cell order (loc_id, k, cell_id)."""
    best = _closest(points, cells, n)
    return best.withColumn("k", F.row_number().over(Window.partitionBy("loc_id").orderBy("cell_id"))).select("loc_id", "k", "cell_id")


def local_predictors(grid: DataFrame, near: DataFrame, fun: str | None = None) -> DataFrame:
    """Values of the neighbouring cells per date: one row per neighbour, or aggregated by ``fun``."""
    rows = grid.withColumnRenamed("loc_id", "cell_id").join(near, "cell_id")
    if fun is None:
        return rows.select("loc_id", "t", "var", "k", "value")
    return rows.groupBy("loc_id", "t", "var").agg(getattr(F, fun)("value").alias("value"))


def scale(rows: DataFrame, base: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Standardise by the base's mean and sample deviation per key."""
    stats = base.groupBy(*keys).agg(F.avg(value).alias("m_"), F.stddev_samp(value).alias("s_"))
    return rows.join(stats, keys, "left").withColumn("scaled", F.try_divide(F.col(value) - F.col("m_"), F.col("s_"))).drop("m_", "s_")


def binary(rows: DataFrame, threshold: float, partial: bool = False, value: str = "value") -> DataFrame:
    """1 from the threshold on, else 0; ``partial`` keeps the amounts from the threshold on."""
    v = F.col(value)
    return rows.withColumn("binary", F.when(v.isNull(), F.lit(None).cast("double")).when(v >= threshold, v if partial else F.lit(1.0)).otherwise(0.0))


def binary_calibrated(pred: DataFrame, ref_obs: DataFrame, ref_pred: DataFrame, keys: list[str]) -> DataFrame:
    """1 where the prediction reaches the reference prediction's quantile at the observed dry share.

    ref_obs has 0/1 in ``value``; the quantile (type 7) is taken per key.
    """
    from isobar.functions.quantile import quantiles, sorted_values

    wet = ref_obs.groupBy(*keys).agg(F.avg("value").alias("f"))
    table = ref_pred.groupBy(*keys).agg(sorted_values("value").alias("v")).join(wet, keys).select(*keys, quantiles(F.col("v"), F.array(1 - F.col("f")))[0].alias("thr"))
    return pred.join(table, keys, "left").withColumn("binary", F.when(F.col("value").isNull() | F.col("thr").isNull(), F.lit(None).cast("int")).when(F.col("value") >= F.col("thr"), 1).otherwise(0)).drop("thr")


def combine(a: DataFrame, b: DataFrame, keys: list[str], op: str) -> DataFrame:
    """Cell-wise arithmetic of two grids (+ - * /); division by 0 gives null."""
    x, y = F.col("value"), F.col("value_b")
    value = {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[op]
    return a.join(b.select(*keys, F.col("value").alias("value_b")), keys).withColumn("value", value).drop("value_b")


def missing_series(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Keys whose series has no finite value."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(F.count(F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)).alias("n")).filter("n = 0").select(*keys)


def bounded_mean(rows: DataFrame, keys: list[str], value: str = "value", lower: tuple[float, float] | None = None, upper: tuple[float, float] | None = None) -> DataFrame:
    """Mean of finite values; values at or beyond a (bound, threshold) count as the bound."""
    for pair, good in ((lower, lambda b, t: b < t), (upper, lambda b, t: t < b)):
        if pair and not good(*pair):
            raise ValueError("a threshold lies inside its bound")
    v = F.col(value)
    x = v
    if lower:
        x = F.when(v <= lower[1], lower[0]).otherwise(x)
    if upper:
        x = F.when(v >= upper[1], upper[0]).otherwise(x)
    ok = ~F.isnan(v) & (F.abs(v) != float("inf"))
    return rows.groupBy(*keys).agg(F.avg(F.when(ok, x)).alias("mean"))


def circular_mean_max(rows: DataFrame, keys: list[str], half: int, length: int = 366) -> DataFrame:
    """Upper-bound climatology: daily maxima over years, circular running maximum, then running mean.

    Day of year comes in ``doy``. Days wrap around ``length``; each day is copied to the days it serves,
    so no window spans a series.
    """
    day = rows.groupBy(*keys, "doy").agg(F.max("value").alias("v"))

    def around(df: DataFrame, agg) -> DataFrame:
        near = F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("o")
        return df.select(*keys, "doy", "v", near).select(*keys, (F.pmod(F.col("doy") - 1 + F.col("o"), F.lit(length)) + 1).alias("doy"), "v").groupBy(*keys, "doy").agg(agg("v").alias("v"))

    ran = around(around(day, F.max), F.avg)
    return ran.join(day.select(*keys, "doy"), [*keys, "doy"], "left_semi").withColumnRenamed("v", "climatology")


def annual_trend(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: slope of the annual means, its r squared, the years, and the two-sided t statistic."""
    yearly = rows.groupBy(*keys, F.year("t").alias("year")).agg(F.avg("value").alias("m"))
    fit = yearly.groupBy(*keys).agg(F.regr_slope("m", "year").alias("slope"), F.regr_intercept("m", "year").alias("intercept"), F.regr_r2("m", "year").alias("r2"), F.count("m").alias("n"), F.avg("year").alias("mean_year"))
    t = F.sqrt(F.try_divide(F.col("r2") * (F.col("n") - 2), 1 - F.col("r2")))
    return fit.withColumn("t_stat", t)
