"""Frames that plots are drawn from; drawing itself is left to the caller."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.predict import Surface
from .workflow import LagModel


def histogram(df: DataFrame, column: str, bins: int = 60) -> DataFrame:
    """low, high, n of equal-width bins over the column's range; empty bins have no row."""
    r = df.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    width = (r["b"] - r["a"]) / bins or 1.0
    at = F.least(F.floor((F.col(column) - F.lit(float(r["a"]))) / F.lit(float(width))), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(at.alias("i")).agg(F.count("*").alias("n")).select((F.col("i") * float(width) + float(r["a"])).alias("low"), ((F.col("i") + 1) * float(width) + float(r["a"])).alias("high"), "n")


def slices(spark, s: Surface, values=(), lags=(), exp: bool | None = None, cumulative: bool = False) -> DataFrame:
    """kind, at, var, lag, fit, low, high of several slices; cumulative ones go by whole lags."""
    parts = [s.slice_var(spark, v, exp, cumulative).select(F.lit("var").alias("kind"), F.lit(float(v)).alias("at"), "var", "lag", "fit", "low", "high") for v in values]
    parts += [s.slice_lag(spark, k, exp).select(F.lit("lag").alias("kind"), F.lit(float(k)).alias("at"), "var", "lag", "fit", "low", "high") for k in lags]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary_frames(m: LagModel, cen=None) -> dict[str, DataFrame]:
    """The surface, the overall curve, and lag slices at the grid values nearest to the 1st and 99th percentiles."""
    spark, s = m.rows.sparkSession, m.predict(cen)
    ends = [float(s.var[np.abs(s.var - q).argmin()]) for q in m.quantile((1, 99))]
    return {"surface": s.frame(spark), "overall": s.overall(spark), "slices": slices(spark, s, ends)}


def overall_risk(m: LagModel, bins: int = 60, percentiles=(1, 10, 50, 90, 99)) -> dict[str, DataFrame]:
    """The overall curve against the minimum-risk exposure, percentile ticks, and the histogram of exposures."""
    spark, low = m.rows.sparkSession, m.minimum_risk()
    marks = spark.createDataFrame([(float(p), float(v)) for p, v in zip(percentiles, m.quantile(percentiles), strict=True)], "percentile double, value double")
    return {"overall": m.predict(low.value).overall(spark), "lowest": low.frame(spark), "ticks": marks, "histogram": histogram(m.rows, m.exposure, bins)}
