"""Many locations: one fit for each group on the executors, and pooled coefficients."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .crossbasis import CrossBasis
from .glm import Family
from .predict import reduction


def small_glm(x: np.ndarray, y: np.ndarray, family: Family, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, covariance and dispersion of one group's model, in numpy."""
    beta, before = None, np.inf
    for _ in range(100):
        eta = family.eta(family.start(y)) if beta is None else x @ beta
        mu = family.mean(eta)
        slope = family.slope(mu)
        dev = family.deviance(y, mu, 1.0)
        q, r = np.linalg.qr(np.sqrt(slope)[:, None] * x)
        if beta is not None and abs(dev - before) < tol * (abs(dev) + 0.1):
            break
        before = dev if beta is not None else np.inf
        beta = np.linalg.solve(r, q.T @ (np.sqrt(slope) * (eta + (y - mu) / slope)))
    scale = 1.0 if family.known else float(((y - mu) ** 2 / slope).sum()) / (len(y) - x.shape[1])
    inv = np.linalg.inv(r)
    return beta, inv @ inv.T * scale, scale


def fit_groups(df: DataFrame, group: str, y: str, cb: CrossBasis, columns: list[str], controls: list[str] = (), family: str = "quasipoisson", type: str = "overall", value: float | None = None, cen: float | None = None) -> DataFrame:
    """group, coef, vcov (by rows), scale and n: each group's reduced coefficients.

    columns are the cross-basis columns of df, made with one spec, so that coefficients compare across
    groups. A group's rows meet in one task: series, not raw events.
    """
    kind, m = Family(family), reduction(cb, type, value, None, cen)
    names, k = [*columns, *controls], len(columns)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        label = part[group].iloc[0]
        part = part.dropna(subset=[y, *names])
        x = np.column_stack([part[names].to_numpy(float), np.ones(len(part))])
        if len(part) <= x.shape[1]:
            return pd.DataFrame({group: [label], "coef": [None], "vcov": [None], "scale": [np.nan], "n": [len(part)]})
        b, v, scale = small_glm(x, part[y].to_numpy(float), kind)
        return pd.DataFrame({group: [label], "coef": [m @ b[:k]], "vcov": [(m @ v[:k, :k] @ m.T).ravel()], "scale": [scale], "n": [len(part)]})

    schema = f"`{group}` {df.schema[group].dataType.simpleString()}, coef array<double>, vcov array<double>, scale double, n long"
    return df.select(group, y, *[f"`{c}`" for c in names]).groupBy(group).applyInPandas(one, schema)


def stacked(rows: DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """Coefficients (a row for each group) and covariances of fit_groups' result."""
    got = [r for r in rows.select("coef", "vcov").collect() if r.coef is not None]
    c = np.array([r.coef for r in got], float)
    return c, [np.array(r.vcov, float).reshape(c.shape[1], -1) for r in got]


def pooled(coef: np.ndarray, vcov: list[np.ndarray], rounds: int = 200, moderators: np.ndarray | None = None, method: str = "reml") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random-effects mean, its covariance, and the covariance between groups, by EM on the restricted ("reml") or plain ("ml") likelihood.

    With moderators (a row for each group; an intercept is a column of ones) the mean of a group is linear in
    them: the result holds, moderator by moderator, k coefficients each.
    """
    if method not in ("reml", "ml"):
        raise ValueError("'method' is reml or ml")
    m, k = coef.shape
    z = np.ones((m, 1)) if moderators is None else np.asarray(moderators, float).reshape(m, -1)
    design = [np.kron(row[None, :], np.eye(k)) for row in z]
    psi = np.cov(coef.T).reshape(k, k) if m > 1 else np.zeros((k, k))
    for _ in range(rounds):
        w = [np.linalg.inv(s + psi) for s in vcov]
        v = np.linalg.inv(sum(x.T @ a @ x for a, x in zip(w, design, strict=True)))
        mean = v @ sum(x.T @ a @ c for a, x, c in zip(w, design, coef, strict=True))
        new = np.zeros((k, k))
        for a, x, c in zip(w, design, coef, strict=True):
            e = psi @ a @ (c - x @ mean)
            new += np.outer(e, e) + psi - psi @ a @ psi
            if method == "reml":
                new += psi @ a @ x @ v @ x.T @ a @ psi
        new /= m
        done = np.abs(new - psi).max() < 1e-10 * (np.abs(psi).max() + 1e-10)
        psi = new
        if done:
            break
    return mean, v, psi
