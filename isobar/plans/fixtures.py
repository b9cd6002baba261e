"""Climate-like series derived from the driver's business tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Years before this one train; the rest is the target.
SPLIT = 1999
KEYS = ["loc_id"]

SQL = f"""
WITH j AS (
  SELECT s_nationkey AS loc_id, CAST(l_shipdate AS DATE) AS t, l_linenumber % 3 AS member, l_extendedprice AS x,
    l_extendedprice * (1 - l_discount) AS y, CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END AS wo, CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END AS wp
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
), f AS (SELECT loc_id, t, avg(x) AS obs, avg(y) AS pred FROM j GROUP BY 1, 2),
fm AS (SELECT loc_id, member, t, avg(x) AS obs, avg(y) AS pred FROM j GROUP BY 1, 2, 3),
fp AS (SELECT loc_id, t, sum(wp) AS obs, sum(wo) AS pred FROM j GROUP BY 1, 2),
tr AS (SELECT loc_id, t, obs AS o, pred AS p FROM f WHERE year(t) < {SPLIT}),
si AS (SELECT loc_id, t, pred AS s FROM f WHERE year(t) >= {SPLIT}),
trm AS (SELECT loc_id, member, t, obs AS o, pred AS p FROM fm WHERE year(t) < {SPLIT}),
sim AS (SELECT loc_id, member, t, pred AS s FROM fm WHERE year(t) >= {SPLIT}),
trp AS (SELECT loc_id, t, obs AS o, pred AS p FROM fp WHERE year(t) < {SPLIT}),
sip AS (SELECT loc_id, t, pred AS s FROM fp WHERE year(t) >= {SPLIT}),
g AS (SELECT CAST(l_shipdate AS DATE) AS t, avg(l_quantity) AS x1, avg(l_discount) AS x2, avg(l_tax) AS x3, avg(l_extendedprice) AS y FROM lineitem GROUP BY 1)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the supplier's nation as location."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    su = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    return li.join(su, li.l_suppkey == su.s_suppkey).select(
        F.col("s_nationkey").alias("loc_id"), F.to_date("l_shipdate").alias("t"), (F.col("l_linenumber") % 3).alias("member"), F.col("l_extendedprice").alias("x"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y"), F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0).alias("wo"),
        F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0).alias("wp"),
    )


def temperature(spark: SparkSession, sf_dir: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, t, obs, pred): daily means, all positive, with gaps."""
    return lines(spark, sf_dir).groupBy(*(keys or KEYS), "t").agg(F.avg("x").alias("obs"), F.avg("y").alias("pred"))


def precipitation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(loc_id, t, obs, pred): daily sums with many zeros; the model is the wetter side."""
    return lines(spark, sf_dir).groupBy(*KEYS, "t").agg(F.sum("wp").alias("obs"), F.sum("wo").alias("pred"))


def split(series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, sim) at SPLIT."""
    keys = [c for c in series.columns if c not in ("t", "obs", "pred")]
    train = series.filter(F.year("t") < SPLIT).select(*keys, "t", F.col("obs").alias("o"), F.col("pred").alias("p"))
    return train, series.filter(F.year("t") >= SPLIT).select(*keys, "t", F.col("pred").alias("s"))


def predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, x1, x2, x3, y): one row per day."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.groupBy(F.to_date("l_shipdate").alias("t")).agg(F.avg("l_quantity").alias("x1"), F.avg("l_discount").alias("x2"), F.avg("l_tax").alias("x3"), F.avg("l_extendedprice").alias("y"))


def fine_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as stations on a grid of two degrees."""
    k = F.col("n_nationkey")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(k.alias("loc_id"), (F.lit(-10.0) + 2 * (k % 5)).alias("lon"), (F.lit(35.0) + 2 * F.floor(k / 5)).alias("lat"))


def coarse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as cells of four degrees."""
    k = F.col("r_regionkey")
    return spark.read.parquet(f"{sf_dir}/region.parquet").select(k.alias("loc_id"), (F.lit(-9.0) + 4 * (k % 3)).alias("lon"), (F.lit(36.0) + 4 * F.floor(k / 3)).alias("lat"))
