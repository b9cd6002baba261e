"""Apply fitted correction tables to a stream (an extension: a stateless stream-static join)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.functions.quantile import average_ties, interpolate, literal
from isobar.operators.native import taus


def quantile_table(train: DataFrame, keys: list[str], n_quantiles: int = 50) -> DataFrame:
    """(keys, qo, qp): the quantile pairs of each series, ties averaged."""
    at = literal(taus(n_quantiles))
    q = train.groupBy(*keys).agg(F.percentile("o", at).alias("qo"), F.percentile("p", at).alias("qp"))
    return q.withColumn("qo", average_ties(F.col("qp"), F.col("qo")))


def correct_stream(stream: DataFrame, table: DataFrame, keys: list[str], value: str = "s") -> DataFrame:
    """The stream with ``corrected``; series without a table give null. No state, so no watermark."""
    out = stream.join(table, keys, "left")
    return out.withColumn("corrected", interpolate(F.col(value), F.col("qp"), F.col("qo"), "offset")).drop("qo", "qp")
