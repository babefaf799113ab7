"""Conditional (stratified) logistic regression: Newton steps on per-stratum scores and information."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .glm import Fit


def stratum_terms(case: np.ndarray, x: np.ndarray, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, score and information of one stratum with m cases, exact for ties.

    The normaliser is the elementary symmetric function of degree m of exp(x beta); it and its first two
    derivatives are carried along by adding one row at a time.
    """
    m, p = int(case.sum()), x.shape[1]
    eta = x @ beta
    top = eta.max()
    u = np.exp(eta - top)
    if m == 1:
        q = u / u.sum()
        mean = q @ x
        return float(eta[case == 1][0] - top - np.log(u.sum())), x[case == 1][0] - mean, (x * q[:, None]).T @ x - np.outer(mean, mean)
    f, g, h = np.zeros(m + 1), np.zeros((m + 1, p)), np.zeros((m + 1, p, p))
    f[0] = 1
    for ui, xi in zip(u, x, strict=True):
        cross = np.einsum("kp,q->kpq", g[:-1], xi)
        h[1:] += ui * (h[:-1] + cross + cross.transpose(0, 2, 1) + f[:-1, None, None] * np.outer(xi, xi))
        g[1:] += ui * (g[:-1] + f[:-1, None] * xi)
        f[1:] += ui * f[:-1]
    mean = g[m] / f[m]
    return float(eta[case == 1].sum() - m * top - np.log(f[m])), x[case == 1].sum(0) - mean, h[m] / f[m] - np.outer(mean, mean)


def batch_terms(flat: np.ndarray, size: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Rows, log-likelihood, score and information summed over strata (rows of case, x one after another; size of each).

    Strata with one case are summed at once; those with more go one by one.
    """
    p, start = flat.shape[1] - 1, np.cumsum(size) - size
    y, x = flat[:, 0], flat[:, 1:]
    cases = np.add.reduceat(y, start)
    one = cases == 1
    rows = np.repeat(one, size)
    out = np.zeros(2 + p + p * p)
    out[0] = len(flat)
    if one.any():
        xs, ys, n = x[rows], y[rows], size[one]
        first = np.cumsum(n) - n
        eta = xs @ beta
        top = np.maximum.reduceat(eta, first)
        u = np.exp(eta - np.repeat(top, n))
        total = np.add.reduceat(u, first)
        q = u / np.repeat(total, n)
        mean = np.add.reduceat(xs * q[:, None], first, axis=0)
        out[1] += (eta * ys).sum() - (top + np.log(total)).sum()
        out[2 : 2 + p] += (xs * ys[:, None]).sum(0) - mean.sum(0)
        out[2 + p :] += ((xs * q[:, None]).T @ xs - mean.T @ mean).ravel()
    for i in np.flatnonzero(~one).tolist():
        a = slice(start[i], start[i] + size[i])
        ll, score, info = stratum_terms(y[a], x[a], beta)
        out[1:] += np.concatenate([[ll], score, info.ravel()])
    return out


def fit_clogit(df: DataFrame, case: str, terms: list[str], stratum: str, tol: float = 1e-9, rounds: int = 50) -> Fit:
    """Rows with a missing value are dropped, then strata without a case or without a control.

    A stratum's rows meet in one array, so strata must be of risk-set size.
    """
    p = len(terms)
    rows = df.select(F.col(stratum).alias("s"), F.col(case).cast("double").alias("y"), *[F.nanvl(F.col(f"`{t}`").cast("double"), F.lit(None)).alias(f"x{i}") for i, t in enumerate(terms)])
    total = rows.count()
    rows = rows.dropna()
    sets = rows.groupBy("s").agg(F.collect_list(F.array("y", *[f"x{i}" for i in range(p)])).alias("m"), F.sum("y").alias("cases"), F.count("*").alias("n"))
    sets = sets.filter("cases > 0 AND cases < n").select("m").cache()

    def totals(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int]:
        def run(batches):
            out = np.zeros(2 + p + p * p)
            for batch in batches:
                if batch.num_rows:
                    lists = batch.column("m")
                    flat = np.asarray(lists.flatten().flatten(), float).reshape(-1, p + 1)
                    out += batch_terms(flat, np.asarray(lists.value_lengths()).astype(np.int64), beta)
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["v"])

        v = np.sum([r.v for r in sets.mapInArrow(run, "v array<double>").collect()], axis=0)
        return v[1], v[2 : 2 + p], v[2 + p :].reshape(p, p), int(v[0])

    try:
        beta = np.zeros(p)
        ll, score, info, n = totals(beta)
        for _ in range(rounds):
            step, part = np.linalg.solve(info, score), 1.0
            while True:
                new = totals(beta + part * step)
                if np.isfinite(new[0]) and new[0] >= ll - 1e-12 * abs(ll) or part < 1e-8:
                    break
                part /= 2
            beta = beta + part * step
            done = abs(new[0] - ll) < tol * (abs(new[0]) + 0.1) and np.abs(part * step).max() < 1e-6 * (np.abs(beta).max() + 1)
            ll, score, info, n = new
            if done:
                break
        return Fit(list(terms), beta, np.linalg.inv(info), "logit", "clogit", 1.0, n, -2 * ll, [], {"loglik": ll}, total - n)
    finally:
        sets.unpersist()
