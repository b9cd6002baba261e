"""Reading and writing long-format grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of a grid and their types.
SCHEMA = (
    ("var", "string"), ("runtime", "string"), ("member", "int"), ("loc_id", "bigint"), ("lat", "double"), ("lon", "double"),
    ("time_start", "timestamp_ntz"), ("time_end", "timestamp_ntz"), ("value", "double"),
)


def as_grid(df: DataFrame, mapping: dict[str, str] | None = None, kind: str = "regular") -> DataFrame:
    """Rename and cast to the grid schema; absent columns are null, NaN and infinities become null.

    ``kind`` is regular or station; rotated grids are refused.
    """
    if kind not in ("regular", "station"):
        raise ValueError("rotated grids are not supported")
    back = mapping or {}
    cols = []
    for name, dtype in SCHEMA:
        source = back.get(name, name)
        cols.append((F.col(source) if source in df.columns else F.lit(None)).cast(dtype).alias(name))
    out = df.select(*cols)
    v = F.col("value")
    return out.withColumn("value", F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v))


def read_grid(
    spark: SparkSession, path: str, variables: Sequence[str] | None = None, years: Sequence[int] | None = None, months: Sequence[int] | None = None,
    lat: tuple[float, float] | None = None, lon: tuple[float, float] | None = None, times: tuple[str, str] | None = None,
) -> DataFrame:
    """Scan a Parquet grid with the usual restrictions; ranges on columns are pushed to the scan.

    Years become a range of time_start as well, so row groups outside it are skipped.
    """
    df = spark.read.parquet(path)
    if variables:
        df = df.filter(F.col("var").isin(*variables))
    if lat:
        df = df.filter(F.col("lat").between(*lat))
    if lon:
        df = df.filter(F.col("lon").between(*lon))
    if years:
        df = df.filter((F.col("time_start") >= F.lit(f"{min(years)}-01-01").cast("timestamp_ntz")) & (F.col("time_start") < F.lit(f"{max(years) + 1}-01-01").cast("timestamp_ntz")))
        df = df.filter(F.year("time_start").isin(*years))
    if months:
        df = df.filter(F.month("time_start").isin(*months))
    if times:
        df = df.filter((F.col("time_start") >= F.lit(times[0]).cast("timestamp_ntz")) & (F.col("time_start") <= F.lit(times[1]).cast("timestamp_ntz")))
    return df


def write_grid(df: DataFrame, path: str, by: Sequence[str] = ("lat",), mode: str = "overwrite") -> None:
    """Write Parquet partitioned for pruned reads (the equivalent of chunked files)."""
    df.repartition(*by).write.mode(mode).partitionBy(*by).parquet(path)


def bind(*grids: DataFrame) -> DataFrame:
    """Stack grids along time, member, variable or location."""
    out = grids[0]
    for g in grids[1:]:
        out = out.unionByName(g)
    return out


def multigrid(parts: dict[str, DataFrame]) -> DataFrame:
    """Stack variables; each part gets its name as ``var``."""
    return bind(*[df.withColumn("var", F.lit(name)) for name, df in parts.items()])
