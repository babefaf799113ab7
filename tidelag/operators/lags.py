"""Lagged values and exposure histories. Lags count rows of a group in the order of `order_by`, not days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import lag_range


def over(order_by: str, group: str | None, blocked: bool = False) -> str:
    """The window of all lag expressions: one exchange and one sort serve every lag."""
    keys = ([f"`{group}`"] if group else []) + (["__block"] if blocked else [])
    return f"OVER ({f'PARTITION BY {", ".join(keys)} ' if keys else ''}ORDER BY `{order_by}`)"


def in_blocks(df: DataFrame, order_by: str, group: str | None, lags: tuple[int, int], rows: int, ranges: int = 256) -> DataFrame:
    """df with __block and __own: each group's rows in order, cut into blocks of `rows`, with the rows next to a block
    that its lags reach repeated in it (__own false). So a group of any size, or an ungrouped table, is many tasks.

    Rows are numbered by approximate quantiles of the order column first (at most `ranges` values go to the
    driver), then within each range; the ranges' counts give the offsets.
    """
    low, high = lags
    past, future = max(high, 0), max(-low, 0)
    if rows < max(past, future):
        raise ValueError("a block must be longer than the lags")
    probs = [i / ranges for i in range(1, ranges)]
    cuts = df.agg(F.percentile_approx(order_by, F.array(*map(F.lit, probs)), 10_000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    part = F.size(F.filter(F.array(*[F.lit(c).cast(df.schema[order_by].dataType) for c in cuts]), lambda c: c <= F.col(order_by))) if cuts else F.lit(0)
    key = [group] if group else []
    own = df.withColumn("__range", part).withColumn("__nth", F.row_number().over(Window.partitionBy(*key, "__range").orderBy(order_by)))
    sizes = own.groupBy(*key, "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*key, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    joined = own.join(sizes, [*key, "__range"]).withColumn("__at", F.col("__from") + F.col("__nth") - 1)
    home, place = F.floor(F.col("__at") / rows).cast("long"), F.col("__at") % rows
    reach = F.array(F.struct(home.alias("b"), F.lit(True).alias("o")), F.when(place >= rows - past, F.struct((home + 1).alias("b"), F.lit(False).alias("o"))), F.when(place < future, F.struct((home - 1).alias("b"), F.lit(False).alias("o"))))
    out = joined.withColumn("__to", F.explode(F.filter(reach, lambda r: r.isNotNull())))
    return out.select(*df.columns, F.col("__to.b").alias("__block"), F.col("__to.o").alias("__own"))


def lag_sql(x: str, k: int, window: str) -> str:
    """x at k rows before (after, if k is negative)."""
    return f"lag({x}, {k}) {window}" if k > 0 else f"lead({x}, {-k}) {window}" if k < 0 else x


def check_groups(df: DataFrame, order_by: str, group: str | None, lags: tuple[int, int]) -> None:
    """Raises if a group label is missing, an order value repeats in a group, or a group is not longer than the lags."""
    key = [group] if group else []
    n = df.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct(order_by).alias("d"))
    reach = max(abs(v) for v in lags)
    bad = n.filter((F.col("d") < F.col("n")) | (F.col("n") <= reach) | (F.col(group).isNull() if group else F.lit(False))).limit(1).collect()
    if bad:
        r = bad[0]
        raise ValueError(f"group {r[group] if group else '(all)'}: it has no label, is not longer than the lags, or repeats a value of {order_by}")


def with_lags(df: DataFrame, column: str, order_by: str, lag, group: str | None = None, name: str | None = None, packed: bool = False, block_rows: int | None = None) -> DataFrame:
    """df with {name}_lag{k} for every lag of the range (lead for negative ones), or with packed one array column {name}_lags.

    With block_rows, groups are cut into blocks of so many rows, for groups too large for one task.
    """
    low, high = lag_range(lag)
    if block_rows:
        rows = _with_lags(in_blocks(df, order_by, group, (low, high), block_rows), column, low, high, name or column, over(order_by, group, True), packed)
        return rows.where("__own").drop("__block", "__own")
    return _with_lags(df, column, low, high, name or column, over(order_by, group), packed)


def _with_lags(df: DataFrame, column: str, low: int, high: int, name: str, w: str, packed: bool) -> DataFrame:
    each = [lag_sql(f"`{column}`", k, w) for k in range(low, high + 1)]
    if packed:
        return df.select("*", F.expr(f"array({', '.join(each)})").alias(f"{name}_lags"))
    return df.select("*", *[F.expr(e).alias(f"{name}_lag{k}" if k >= 0 else f"{name}_lead{-k}") for k, e in zip(range(low, high + 1), each, strict=True)])


def exposure_histories(profiles: DataFrame, subject: str, time: str, value: str, at: DataFrame, lag, fill: float = 0.0) -> DataFrame:
    """Each row of `at` (subject, time) with history, the array of the subject's values from the first lag to the last before time.

    profiles has one row for each subject and time; times without a row have the fill value. The lags of
    each different (subject, time) are exploded, joined and gathered again, so a long profile is never in one row.
    Rows of `at` meet their history by these values: numbers given to rows may differ each time `at` is computed.
    """
    low, high = lag_range(lag)
    asked = at.select(F.col(subject).alias("__s"), F.col(time).alias("__t")).distinct()
    far = asked.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("__k"))
    known = profiles.select(F.col(subject).alias("__ps"), F.col(time).alias("__pt"), F.col(value).cast("double").alias("__v"))
    far = far.join(known, (F.col("__s") == F.col("__ps")) & (F.col("__t") - F.col("__k") == F.col("__pt")), "left")
    packed = far.groupBy("__s", "__t").agg(F.array_sort(F.collect_list(F.struct("__k", F.coalesce("__v", F.lit(float(fill))).alias("v")))).alias("__h"))
    rows = at.join(packed, F.col(subject).eqNullSafe(F.col("__s")) & F.col(time).eqNullSafe(F.col("__t")))
    return rows.select(*at.columns, F.expr("transform(__h, p -> p.v)").alias("history"))


def filled_calendar(df: DataFrame, day: str, group: str | None = None) -> DataFrame:
    """df with a row for every day between the first and the last (of each group), other columns null where there was none."""
    key = [group] if group else []
    ends = df.groupBy(*key).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    days = ends.select(*key, F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(day)).withColumn(day, F.col(day).cast(df.schema[day].dataType))
    return days.join(df, [*key, day], "left").select(*df.columns)
