"""Quantiles, round-number grids and knot placement: the numbers that specs are made of."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quantile(x, probs) -> np.ndarray:
    """Linear-interpolation quantiles (type 7) of the values that aren't missing; NaN if there are none."""
    x = np.sort(np.asarray(x, float)[~np.isnan(np.asarray(x, float))])
    probs = np.atleast_1d(np.asarray(probs, float))
    if not len(x):
        return np.full(len(probs), np.nan)
    at = probs * (len(x) - 1)
    low = np.floor(at + 4 * np.finfo(float).eps).astype(int)
    part = at - low
    part[np.abs(part) < 4 * np.finfo(float).eps * np.maximum(at, 1)] = 0
    high = np.minimum(low + 1, len(x) - 1)
    return x[low] + np.where(part > 0, part * (x[high] - x[low]), 0.0)


def median(x) -> float:
    """Mean of the middle two values."""
    return float(quantile(x, 0.5)[0])


def value_range(x) -> tuple[float, float]:
    """Smallest and largest value that isn't missing."""
    return float(np.nanmin(x)), float(np.nanmax(x))


def seq(start: float, stop: float, by: float) -> np.ndarray:
    """start, start + by, ... up to stop; the last may be clipped to it."""
    if by == 0 or (stop - start) / by < 0:
        raise ValueError("'by' has the wrong sign or is 0")
    out = start + by * np.arange(math.floor((stop - start) / by + 1e-10) + 1)
    return np.minimum(out, stop) if by > 0 else np.maximum(out, stop)


#: Bias towards larger units, and for 5 rather than 2; shrinkage for a range of one value.
BIAS, BIAS5, SHRINK = 1.5, 0.5 + 1.5 * 1.5, 0.75


def pretty(x, n: float = 5, min_n: float | None = None) -> np.ndarray:
    """About n round-number breaks that cover the range of x: steps of 1, 2, 5 or 10 times a power of ten."""
    low, high = value_range(x)
    n = int(n)
    least = n // 3 if min_n is None else int(min_n)
    span = high - low
    size = max(abs(low), abs(high))
    if span == 0 and high == 0:
        cell, narrow = 1.0, True
    else:
        slack = (1 / (1 + BIAS) if BIAS5 >= 1.5 * BIAS + 0.5 else 1.5 / (1 + BIAS5)) + 1
        cell, narrow = size, span < size * slack * max(1, n) * np.finfo(float).eps * 3
    if narrow:
        cell = (9 + cell / 10 if cell > 10 else cell) * SHRINK / (least if least > 1 else 1)
    else:
        cell = span / n if n > 1 else span
    unit = base = 10.0 ** math.floor(math.log10(max(cell, 1e-300)))
    for step, bias in ((2, BIAS), (5, BIAS5), (10, BIAS)):
        if step * base - cell >= bias * (cell - unit):
            break
        unit = step * base
    eps = 1e-10
    first, last = math.floor(low / unit + eps), math.ceil(high / unit - eps)
    while first * unit > low + eps * unit:
        first -= 1
    while last * unit < high - eps * unit:
        last += 1
    short = least - (last - first)
    if short > 0:
        if low == 0 and first == 0 and high != 0:
            last += short
        elif high == 0 and last == 0 and low != 0:
            first -= short
        elif first >= 0:
            last += short // 2
            first -= short // 2 + short % 2
        else:
            first -= short // 2
            last += short // 2 + short % 2
    return np.array([k * unit for k in range(first, last + 1)]) + 0.0


def lag_range(lag) -> tuple[int, int]:
    """A number L is 0..L (L..0 if negative), a pair is kept; rounded."""
    values = np.atleast_1d(np.asarray(lag, float)).ravel()
    if len(values) not in (1, 2):
        raise ValueError("'lag' is one or two numbers")
    low, high = (min(values[0], 0), max(values[0], 0)) if len(values) == 1 else values
    low, high = int(np.rint(low)), int(np.rint(high))
    if low > high:
        raise ValueError("the first lag must not be above the last")
    return low, high


def lag_seq(lag, by: float = 1) -> np.ndarray:
    """The grid of lags."""
    low, high = lag_range(lag)
    return seq(float(low), float(high), float(by))


def knots_from_df(fun: str, df: int, degree: int = 3, intercept: bool = False) -> int:
    """Interior knots of a basis with df columns."""
    return {"ns": df - 1 - intercept, "bs": df - degree - intercept, "strata": df - intercept}[fun]


def _count(nk, fun, df, degree, intercept) -> int:
    n = nk if nk is not None else knots_from_df(fun, df, degree, intercept)
    if n < 1:
        raise ValueError("choose at least one knot")
    return int(n)


def log_knots(x, nk: int | None = None, fun: str = "ns", df: int = 1, degree: int = 3, intercept: bool = True) -> np.ndarray:
    """Knots equally spaced on the log scale of lags; x is a lag, a lag range (under three values) or data."""
    low, high = map(float, lag_range(x)) if np.size(x) < 3 else value_range(x)
    if high <= low:
        raise ValueError("the range must not be empty")
    n = _count(nk, fun, df, degree, intercept)
    return low + np.exp((1 + math.log(high - low)) / (n + 1) * np.arange(1, n + 1) - 1)


def equal_knots(x, nk: int | None = None, fun: str = "ns", df: int = 1, degree: int = 3, intercept: bool = False) -> np.ndarray:
    """Knots equally spaced within the range of x."""
    low, high = value_range(x)
    n = _count(nk, fun, df, degree, intercept)
    return low + (high - low) / (n + 1) * np.arange(1, n + 1)


def percentile_knots(df: DataFrame, column: str, percentiles) -> np.ndarray:
    """Exact percentiles of a column; one row goes to the driver."""
    probs = [float(p) / 100 for p in percentiles]
    x = F.nanvl(F.col(column).cast("double"), F.lit(None))
    return np.array(df.agg(F.percentile(x, F.array(*map(F.lit, probs))).alias("q")).first().q or [np.nan] * len(probs), float)


def percentile_of(df: DataFrame, column: str, values) -> np.ndarray:
    """Per cent of a column's values at or below each of values."""
    x = F.nanvl(F.col(column).cast("double"), F.lit(None))
    row = df.agg(*[(100 * F.avg((x <= float(v)).cast("double"))).alias(f"p{i}") for i, v in enumerate(np.atleast_1d(values))]).first()
    return np.array([np.nan if v is None else v for v in row], float)
