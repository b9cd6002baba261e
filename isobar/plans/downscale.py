"""Perfect-prognosis downscaling: train on observed predictors, predict for new ones, cross-validate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.operators import analogs, glm, grid

METHODS = ("analogs", "glm", "lm", "nn")


def _with_sites(x: DataFrame, y: DataFrame) -> DataFrame:
    """Predictor days for every site (a row per site is broadcast), unless they are the sites' own."""
    if "loc_id" in x.columns:
        return x
    return x.crossJoin(F.broadcast(y.select("loc_id").distinct()))


def _joined(y: DataFrame, x: DataFrame) -> DataFrame:
    """Training rows: y with the day's predictors, or with the site's own ones of the day."""
    return y.join(x, ["loc_id", "t"] if "loc_id" in x.columns else "t")


def complete_days(y: DataFrame) -> DataFrame:
    """The rows of the days on which every site has a value (models of all sites at once train on these)."""
    has = F.col("y").isNotNull() & ~F.isnan("y")
    sites = y.select("loc_id").distinct().agg(F.count("*").alias("sites"))  # one row
    full = y.groupBy("t").agg(F.count_distinct(F.when(has, F.col("loc_id"))).alias("n")).crossJoin(F.broadcast(sites)).filter("n = sites")
    return y.join(full.select("t"), "t", "left_semi")


def two_stage(y: DataFrame, x: DataFrame, newdata: DataFrame, wet_threshold: float = 0.1, simulate: bool = False, seed: int = 1) -> DataFrame:
    """Precipitation: a logistic model of occurrence times a log-gamma model of wet amounts.

    y has loc_id, t, y; x and newdata have t and x, and loc_id where predictors are a site's own. Occurrence is cut at the quantile of the training
    probabilities that gives the observed wet share, unless simulated.
    """
    rows = _joined(y, x)
    occurrence = rows.withColumn("y", F.when(F.col("y").isNotNull(), (F.col("y") >= wet_threshold).cast("double")))
    wet = glm.fit(occurrence, ["loc_id"], "binomial")
    amount = glm.fit(rows, ["loc_id"], "gamma", "log", op="GE", threshold=wet_threshold)
    new = _with_sites(newdata, y)
    p = glm.predict(new, wet, ["loc_id"], simulate, seed)
    a = glm.predict(new, amount, ["loc_id"], simulate, seed + 1).select("loc_id", "t", F.col("prediction").alias("amount"))
    if simulate:
        occurs = p.select("loc_id", "t", F.col("prediction").alias("binary"))
    else:
        trained = glm.predict(occurrence.select("loc_id", "t", "x"), wet, ["loc_id"]).select("loc_id", F.col("prediction").alias("value"))
        obs = occurrence.select("loc_id", F.col("y").alias("value"))
        occurs = grid.binary_calibrated(p.withColumnRenamed("prediction", "value"), obs, trained, ["loc_id"]).select("loc_id", "t", "binary")
    return occurs.join(a, ["loc_id", "t"]).select("loc_id", "t", (F.col("binary") * F.col("amount")).alias("prediction"))


def train_predict(y: DataFrame, x: DataFrame, newdata: DataFrame, method: str, **options) -> DataFrame:
    """(loc_id, t, prediction) for newdata by a method trained on (y, x).

    x and newdata have a row per day, or per site and day (local or mixed predictors). ``site="multi"``
    trains on the days on which no site lacks a value.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}")
    if options.pop("site", "single") == "multi" and method != "analogs":
        y = complete_days(y)
    if method == "analogs" and "loc_id" in x.columns:
        raise ValueError("analogs are found by predictors of the whole field")
    if method == "analogs":
        train = x.select(F.col("t").alias("day"), "x")
        values = y.select(F.col("t").alias("day"), F.col("loc_id").alias("site"), F.col("y").alias("value"))
        out = analogs.predict(train, newdata.select(F.col("t").alias("target"), "x"), values, options.get("n_analogs", 1), options.get("sel_fun", "mean"), options.get("window"))
        return out.select(F.col("site").alias("loc_id"), F.col("target").alias("t"), F.col("value").alias("prediction"))
    if method == "glm":
        return two_stage(y, x, newdata, options.get("wet_threshold", 0.1), options.get("simulate", False))
    rows, new = _joined(y, x), _with_sites(newdata, y)
    if method == "nn":
        out = glm.neural_predict(new, glm.neural(rows, ["loc_id"], **options), ["loc_id"])
        return out.select("loc_id", "t", F.col("prediction")[0].alias("prediction"))
    simulate = options.pop("simulate", False)
    return glm.predict(new, glm.fit(rows, ["loc_id"], **options), ["loc_id"], simulate).select("loc_id", "t", "prediction")


def _is_binary(y: DataFrame) -> bool:
    """Whether all values are 0, 1 or missing, and not all are missing."""
    v = F.col("y")
    r = y.filter(v.isNotNull() & ~F.isnan("y")).agg(F.bool_and(v.isin(0.0, 1.0)).alias("b")).first()
    return bool(r["b"])


def occurrence(y: DataFrame, x: DataFrame, newdata: DataFrame, method: str, **options) -> DataFrame:
    """(loc_id, t, prob, bin) of a 0/1 predictand: the prediction, and 1 where it is among the highest.

    The cut is the quantile of the training days' predictions at the observed share of 0, per site; a
    simulated ``lm`` is drawn as 0 or 1 and needs none. ``glm`` is the logistic model.
    """
    if method == "glm":
        method, options = "lm", {"family": "binomial"} | options
    new = train_predict(y, x, newdata, method, **options)
    if method == "lm" and options.get("simulate"):
        return new.select("loc_id", "t", F.col("prediction").alias("prob"), F.col("prediction").cast("int").alias("bin"))
    trained = train_predict(y, x, x, method, **options).select("loc_id", F.col("prediction").alias("value"))
    out = grid.binary_calibrated(new.withColumnRenamed("prediction", "value"), y.select("loc_id", F.col("y").alias("value")), trained, ["loc_id"])
    return out.select("loc_id", "t", F.col("value").alias("prob"), F.col("binary").alias("bin"))


def downscale(y: DataFrame, x: DataFrame, newdata: DataFrame | None = None, method: str = "lm", n_pcs: int | None = None, cross_val: str = "none", folds: int | list[list[int]] = 4, **options) -> DataFrame:
    """Standardise by the training predictors, reduce to components if asked, train, predict.

    Raises if y and x have different dates. With ``cross_val`` 'kfold', 'loocv' or 'random' (dates dealt to
    ``folds`` folds) every fold is predicted from the others (a job per fold; folds are few); a predictand of
    0 and 1 then gives prob and bin instead of prediction.
    """
    grid.require_same_dates(y, x)
    if cross_val == "none":
        new = newdata if newdata is not None else x
        prepared = _components(x, n_pcs)
        return train_predict(y, prepared.transform(x), prepared.transform(new), method, **options)
    year = F.year("t")
    if cross_val == "random":
        if not isinstance(folds, int):
            raise ValueError("random folds are given as a number")
        table = grid.random_folds(x, folds)
    else:
        years = grid.leave_one_out(x, year) if cross_val == "loocv" else grid.year_folds(x, folds, year)
        table = x.select("t").distinct().withColumn("year", year).join(F.broadcast(years), "year").select("t", "fold")
    run = occurrence if _is_binary(y) else train_predict
    result = None
    for f in sorted(r["fold"] for r in table.select("fold").distinct().collect()):
        held = F.broadcast(table.filter(F.col("fold") == f).select("t"))  # a row per date
        rest = x.join(held, "t", "left_anti")
        prepared = _components(rest, n_pcs)
        part = run(y.join(held, "t", "left_anti"), prepared.transform(rest), prepared.transform(x.join(held, "t", "left_semi")), method, **options)
        result = part if result is None else result.unionByName(part)
    return result


def _components(x: DataFrame, n_pcs: int | None):
    from isobar.operators.predictors import Components

    return Components.fit(x, n=n_pcs or len(x.first()["x"]))


def downscale_chunks(y: DataFrame, x: DataFrame, newdata: dict[str, DataFrame], path: str, method: str, **options) -> DataFrame:
    """Downscale one latitude after the other into ``path``; a call after a failure goes on where it stopped.

    y has lat beside loc_id, t, y; results have dataset (a key of ``newdata``), lat, loc_id, t, prediction.
    A latitude counts as done once its folder holds the committer's mark. The folder belongs to one call's
    arguments: give another for other data. Rows without lat raise. Latitudes are few and run one by one,
    each on the whole cluster; use ``downscale`` where a restart from the beginning is cheap.
    """
    if not newdata:
        raise ValueError("no new data are given")
    spark = y.sparkSession
    lats = [r["lat"] for r in y.select("lat").distinct().orderBy("lat").collect()]  # a row per latitude
    if None in lats:
        raise ValueError("a site has no latitude")
    grid.require_same_dates(y, x)
    prepared = _components(x, options.pop("n_pcs", None))
    train = prepared.transform(x)
    targets = {name: prepared.transform(d) for name, d in newdata.items()}
    for lat in lats:
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/lat={lat}/_SUCCESS")
        if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            continue
        here = y.filter(F.col("lat") == lat).drop("lat")
        out = None
        for name, new in targets.items():
            part = train_predict(here, train, new, method, **options).select(F.lit(name).alias("dataset"), "loc_id", "t", "prediction")
            out = part if out is None else out.unionByName(part)
        out.write.mode("overwrite").parquet(f"{path}/lat={lat}")
    return spark.read.parquet(path)
