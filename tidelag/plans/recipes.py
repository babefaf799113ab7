"""Preparations that analyses of lagged responses need around the models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def risk_sets(follow: DataFrame, enter: str, leave: str, events: DataFrame, time: str, controls: int | None = None, seed: int = 1) -> DataFrame:
    """Everyone under observation at each event time (enter < time <= leave), with case for those who leave then.

    events has distinct times. Follow-up is cut into strips of time, so the range join is an equi-join on strips.
    With controls, that many of each set's others are drawn by a hash, besides its cases.
    """
    width = 64.0
    strip = lambda c: F.floor(F.col(c) / width)
    people = follow.withColumn("__strip", F.explode(F.sequence(strip(enter), strip(leave))))
    sets = people.join(events.withColumn("__strip", strip(time)), "__strip").where((F.col(enter) < F.col(time)) & (F.col(time) <= F.col(leave))).drop("__strip")
    sets = sets.withColumn("case", (F.col(leave) == F.col(time)).cast("int"))
    if controls is None:
        return sets
    order = Window.partitionBy(time, "case").orderBy(F.xxhash64(F.lit(seed), *[F.col(c) for c in follow.columns]))
    return sets.withColumn("__n", F.row_number().over(order)).where((F.col("case") == 1) | (F.col("__n") <= controls)).drop("__n")


def climatology(df: DataFrame, day: str, value: str) -> DataFrame:
    """doy and mean of the value on that day of the year."""
    return df.groupBy(F.dayofyear(day).alias("doy")).agg(F.avg(value).alias("mean"))


def weighted_means(df: DataFrame, zone: str, value: str, weight: str) -> DataFrame:
    """zone and mean of the value by weight."""
    return df.groupBy(zone).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))


def bias_corrected(df: DataFrame, day: str, observed: str, modelled: str) -> DataFrame:
    """df with corrected: modelled values moved to the observed monthly means and scaled by the slope of sorted residuals."""
    rows = df.withColumn("__m", F.month(day))
    means = rows.groupBy("__m").agg(F.avg(observed).alias("__mo"), F.avg(modelled).alias("__mm"))
    rows = rows.join(means, "__m")
    rank = lambda e: F.row_number().over(Window.partitionBy("__m").orderBy(e, day))
    a = rows.select("__m", (F.col(observed) - F.col("__mo")).alias("__o"), rank(F.col(observed) - F.col("__mo")).alias("__i"))
    b = rows.select("__m", (F.col(modelled) - F.col("__mm")).alias("__s"), rank(F.col(modelled) - F.col("__mm")).alias("__i"))
    slopes = a.join(b, ["__m", "__i"]).groupBy("__m").agg((F.sum(F.col("__o") * F.col("__s")) / F.sum(F.col("__s") * F.col("__s"))).alias("__k"))
    out = rows.join(slopes, "__m").withColumn("corrected", F.col("__mo") + F.col("__k") * (F.col(modelled) - F.col("__mm")))
    return out.select(*df.columns, "corrected")


def month_corrections(df: DataFrame, day: str, observed: str, modelled: str) -> tuple[list[float], list[float]]:
    """For each month the difference of the means, and the slope of sorted observed on sorted modelled residuals from
    the means of each month of each year, over days with both. Two times twelve numbers go to the driver."""
    both = df.where(F.col(observed).isNotNull() & F.col(modelled).isNotNull())
    both = both.select(F.month(day).alias("m"), F.year(day).alias("y"), F.col(day).alias("d"), F.col(observed).cast("double").alias("o"), F.col(modelled).cast("double").alias("s"))
    own = Window.partitionBy("y", "m")
    rows = both.select("m", "d", "o", "s", (F.col("o") - F.avg("o").over(own)).alias("ro"), (F.col("s") - F.avg("s").over(own)).alias("rs"))
    place = lambda c: F.row_number().over(Window.partitionBy("m").orderBy(c, "d"))
    pairs = rows.select("m", "ro", place("ro").alias("i")).join(rows.select("m", "rs", place("rs").alias("i")), ["m", "i"])
    slopes = pairs.groupBy("m").agg((F.sum(F.col("ro") * F.col("rs")) / F.sum(F.col("rs") * F.col("rs"))).alias("slope"))
    got = {r["m"]: r for r in rows.groupBy("m").agg((F.avg("o") - F.avg("s")).alias("shift")).join(slopes, "m").collect()}
    if len(got) < 12:
        raise ValueError("some months have no day with both values")
    return [got[m]["shift"] for m in range(1, 13)], [got[m]["slope"] for m in range(1, 13)]


def trend_preserving(df: DataFrame, day: str, modelled: str, shift: list[float], slope: list[float]) -> DataFrame:
    """df with corrected: a day's month mean plus the shift, and its residual times the slope.

    Both go over to those of the next (or last) month by the day's place in its month, from -1/2 to 1/2: a place p has
    weight |p| on the month that it is nearer to and 1 - |p| on its own.
    """
    own = Window.partitionBy(F.year(day), F.month(day))
    n = F.count("*").over(own)
    p = F.when(n > 1, (F.dayofmonth(day) - 1) / (n - 1) - 0.5).otherwise(F.lit(0.0))
    at = F.month(day) - 1

    def blended(values: list[float]):
        row = F.array(*[F.lit(float(v)) for v in values])
        near = F.when(p < 0, row[(at + 11) % 12]).otherwise(row[(at + 1) % 12])
        return (1 - F.abs(p)) * row[at] + F.abs(p) * near

    mean = F.avg(modelled).over(own)
    return df.withColumn("corrected", mean + blended(shift) + (F.col(modelled) - mean) * blended(slope))


def period_sums(df: DataFrame, day: str, values: list[str], years: int = 10, when=None) -> DataFrame:
    """period (its first year) and the sums of values over the days of each period for which `when` holds; periods without such days have 0."""
    period = (F.floor(F.year(day) / years) * years).cast("int").alias("period")
    kept = lambda v: F.col(v) if when is None else F.when(when, F.col(v)).otherwise(F.lit(0.0))
    return df.groupBy(period).agg(*[F.sum(kept(v)).alias(v) for v in values])
