"""Intervals from draws, quasi-Akaike criteria and model grids."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import quantile
from .attribution import draws_of
from .crossbasis import CrossBasis
from .glm import Fit
from .linalg import reduced
from .predict import Surface, predict, rowwise_kron


def bootstrap(fn: Callable[[np.ndarray], np.ndarray], coef, vcov, nsim: int = 1000, seed: int | None = None, draws: np.ndarray | None = None) -> np.ndarray:
    """fn of every coefficient draw, stacked."""
    b = draws_of(coef, vcov, nsim, seed) if draws is None else np.asarray(draws, float)
    return np.stack([np.asarray(fn(col)) for col in b.T])


def empirical_interval(samples, level: float = 0.95, axis: int = 0) -> np.ndarray:
    """Low and high quantile along an axis."""
    probs = [(1 - level) / 2, 1 - (1 - level) / 2]
    return np.apply_along_axis(lambda v: quantile(v, probs), axis, np.asarray(samples, float))


def simulated(basis: CrossBasis, coef, vcov, nsim: int = 1000, seed: int | None = None, draws: np.ndarray | None = None, **grid) -> tuple[np.ndarray, np.ndarray, Surface]:
    """Draws of the overall curve (nsim, var) and of the surface (nsim, var, lag): two products, no loop over draws."""
    s = predict(basis, coef=coef, vcov=vcov, **grid)
    b = draws_of(coef, vcov, nsim, seed) if draws is None else np.asarray(draws, float)
    r = basis.var(s.var) - (basis.var(np.array([s.cen])) if s.cen is not None else 0)
    each = np.stack([rowwise_kron(r, np.repeat(basis.lag_basis(np.array([k])), len(r), 0)) for k in s.lags], 1)
    whole = rowwise_kron(r, np.repeat(basis.lag_basis(s.cum_lags).sum(0)[None, :], len(r), 0))
    return (whole @ b).T, np.einsum("vlp,ps->svl", each, b), s


def interval_frame(spark, basis: CrossBasis, coef, vcov, level: float = 0.95, nsim: int = 1000, seed: int | None = None, draws: np.ndarray | None = None, **grid) -> DataFrame:
    """var, fit, low, high of the overall curve on the ratio scale, with intervals from draws."""
    grid["cen"] = False if grid.get("cen") is None else grid["cen"]
    overall, _, s = simulated(basis, coef, vcov, nsim, seed, draws, **grid)
    low, high = empirical_interval(overall, level)
    return spark.createDataFrame([tuple(map(float, r)) for r in zip(s.var, np.exp(s.all_fit), np.exp(low), np.exp(high), strict=True)], "var double, fit double, low double, high double")


def poisson_loglik(df: DataFrame, y: str, mu: str) -> float:
    """Sum of y log(mu) - mu - log(y!)."""
    def one(m: np.ndarray) -> np.ndarray:
        return np.array([[float(sum((a * math.log(b) if a > 0 else 0.0) - b - math.lgamma(a + 1) for a, b in m))]])

    rows = df.select(F.col(y).cast("double").alias("y"), F.col(mu).cast("double").alias("mu")).dropna()
    out = reduced(rows, ["y", "mu"], one, lambda a, b: a + b)
    return 0.0 if out is None else float(out[0, 0])


def qaic(fit: Fit, df: DataFrame, y: str, mu: str) -> float:
    """Quasi-Akaike criterion: -2 log-likelihood of a Poisson at the fitted means, plus 2 * scale * parameters (or effective ones)."""
    if fit.family not in ("poisson", "quasipoisson"):
        raise ValueError("the criterion is for Poisson models")
    k = float(fit.extra["edf"].sum()) if "edf" in fit.extra else len(fit.coef)
    return -2 * poisson_loglik(df, y, mu) + 2 * fit.scale * k


def model_grid(spark, specs: dict[str, dict], fit_one: Callable[..., Fit], criterion: Callable[[Fit], float]) -> DataFrame:
    """model, criterion and delta from the best, best first."""
    got = {k: float(criterion(fit_one(**v))) for k, v in specs.items()}
    best = min(got.values())
    return spark.createDataFrame([(k, v, v - best) for k, v in sorted(got.items(), key=lambda p: (p[1], p[0]))], "model string, criterion double, delta double")
