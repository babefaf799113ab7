"""Generalised linear models by distributed least squares: each iteration is one pass that returns a triangular block."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linalg import aliased, reduced, triangular

#: Names of families, their link and whether their scale is known.
FAMILIES = {"gaussian": ("identity", False), "poisson": ("log", True), "quasipoisson": ("log", False), "binomial": ("logit", True), "quasibinomial": ("logit", False)}
SYNONYMS = {"normal": "gaussian", "logistic": "binomial"}


class Family:
    """Mean, variance and deviance of a family with its canonical link."""

    def __init__(self, name: str) -> None:
        name = SYNONYMS.get(name.lower(), name.lower())
        if name not in FAMILIES:
            raise ValueError(f"no family {name!r}; there are {', '.join(FAMILIES)}")
        self.name, (self.link, self.known) = name, FAMILIES[name]

    def mean(self, eta):
        eta = np.clip(eta, -700, 700) if self.link == "log" else eta
        return eta if self.link == "identity" else np.exp(eta) if self.link == "log" else 1 / (1 + np.exp(-np.clip(eta, -36, 36)))

    def slope(self, mu):
        """d mean / d eta, which is the variance of a canonical family too."""
        return np.ones_like(mu) if self.link == "identity" else mu if self.link == "log" else np.maximum(mu * (1 - mu), 1e-16)

    def start(self, y):
        return y if self.link == "identity" else y + 0.1 if self.link == "log" else (y + 0.5) / 2

    def eta(self, mu):
        return mu if self.link == "identity" else np.log(mu) if self.link == "log" else np.log(mu / (1 - mu))

    def deviance(self, y, mu, w):
        if self.link == "identity":
            return float((w * (y - mu) ** 2).sum())
        if self.link == "log":
            part = np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0.0)
            return float(2 * (w * (part - (y - mu))).sum())
        a = np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0.0)
        b = np.where(y < 1, (1 - y) * np.log(np.where(y < 1, 1 - y, 1) / (1 - mu)), 0.0)
        return float(2 * (w * (a + b)).sum())


@dataclass
class Fit:
    """A fitted model: names, coef, vcov, and what the operators need to know of it."""

    names: list[str]
    coef: np.ndarray
    vcov: np.ndarray
    link: str = "log"
    family: str = ""
    scale: float = 1.0
    nobs: int = 0
    deviance: float = float("nan")
    aliased: list[str] = field(default_factory=list)
    extra: dict[str, Any] = field(default_factory=dict)
    n_dropped: int = 0

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.vcov), 0))

    @property
    def edf_total(self) -> float:
        """Effective degrees of freedom; of a fit without penalties the number of coefficients."""
        return float(np.sum(self.extra["edf"])) if "edf" in self.extra else float(len(self.coef))

    def summary(self) -> str:
        """A few lines of text."""
        rows = "\n".join(f"{n:<24} {c: .6g} ({s:.3g})" for n, c, s in zip(self.names, self.coef, self.se, strict=True))
        return f"{self.family}, {self.link} link, {self.nobs} rows, scale {self.scale:.4g}, deviance {self.deviance:.6g}\n{rows}"

    def frame(self, spark) -> DataFrame:
        """term, estimate, se."""
        return spark.createDataFrame([(n, float(c), float(s)) for n, c, s in zip(self.names, self.coef, self.se, strict=True)], "term string, estimate double, se double")

    def select(self, name: str, kind: str = "cb", columns: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients and covariance of a (cross-)basis by its column names; `cb` never matches `cb2`."""
        pattern = rf"^{re.escape(name)}[._]?" + (r"v(\d+)[._]l(\d+)$" if kind == "cb" else r"b(\d+)$")
        found = sorted((tuple(map(int, m.groups())), i) for i, n in enumerate(self.names) if (m := re.match(pattern, n)))
        at = [i for _, i in found]
        if not at and columns == 1 and name in self.names:
            at = [self.names.index(name)]
        if not at or (columns is not None and len(at) != columns):
            raise ValueError(f"{len(at)} coefficients match {name!r}, the basis has {columns}")
        return self.coef[at], self.vcov[np.ix_(at, at)]


#: Names of links, those that hold another first; and links of kinds of models without a family.
LINKS = ("cloglog", "loglog", "logit", "probit", "log", "identity", "inverse")
KINDS = {"logit": "logit", "conditionallogit": "logit", "conditionalmnlogit": "logit", "poisson": "log", "negativebinomial": "log", "phreg": "log", "conditionalpoisson": "log", "ols": "identity", "wls": "identity", "gls": "identity", "mixedlm": "identity"}


def link_of(model) -> str | None:
    """Link of a fit, or of a model of one's own: its `link` text, its family's link, or what its kind implies."""
    if model is None:
        return None
    if isinstance(getattr(model, "link", None), str):
        text = model.link.lower()
        return next((k for k in LINKS if k in text), None)
    inner = getattr(model, "model", model)
    link = getattr(getattr(inner, "family", None), "link", None)
    if link is not None:
        text = (link if isinstance(link, str) else type(link).__name__).lower()
        return next((k for k in LINKS if k in text), text)
    return KINDS.get(type(inner).__name__.lower())


def fit_of(model) -> Fit:
    """A model of one's own as a Fit: named `params` (a Series or a dict) and `cov_params()` or `vcov`."""
    if isinstance(model, Fit):
        return model
    params = getattr(model, "params", None)
    if params is None:
        raise TypeError("a model must have params, or coef and vcov are given instead")
    index = params if isinstance(params, dict) else getattr(params, "index", ())
    names = [] if callable(index) else list(index)
    if not names:
        raise ValueError("a model's params must have names")
    values = np.array(list(params.values()) if isinstance(params, dict) else params, float)
    if callable(getattr(model, "cov_params", None)):
        vcov = model.cov_params()
    elif hasattr(model, "vcov"):
        vcov = model.vcov
    else:
        raise TypeError("a model must have cov_params() or vcov")
    return Fit([str(n) for n in names], values, np.asarray(vcov, float), link_of(model))


def with_terms(df: DataFrame, terms: list[str], intercept: bool = True) -> tuple[DataFrame, list[str]]:
    """df with double columns for the terms: names of numeric columns, or C(name) for dummies without the first level.

    The levels of a categorical column go to the driver, as their dummies become columns.
    """
    exprs, names = [], []
    if intercept:
        exprs.append(F.lit(1.0).alias("Intercept"))
        names.append("Intercept")
    for term in terms:
        m = re.fullmatch(r"C\((.+)\)", term)
        if not m:
            names.append(term)
            continue
        column = m.group(1)
        levels = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()]
        for level in levels[1:]:
            name = f"C({column})[T.{level}]"
            exprs.append(F.when(F.col(column).isNotNull(), (F.col(column) == level).cast("double")).alias(name))
            names.append(name)
    return df.select("*", *exprs), names


def quoted(names: list[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def design(df: DataFrame, y: str, names: list[str], offset: str | None, weights: list[str]) -> DataFrame:
    """x0, x1, ..., y, off, w and rows whole in all of them, ready for the passes."""
    w = F.lit(1.0)
    for c in weights:
        w = w * F.col(c).cast("double")
    cols = [F.nanvl(F.col(f"`{n}`").cast("double"), F.lit(None)).alias(f"x{i}") for i, n in enumerate(names)]
    out = df.select(*cols, F.nanvl(F.col(y).cast("double"), F.lit(None)).alias("y"), (F.col(offset).cast("double") if offset else F.lit(0.0)).alias("off"), w.alias("w"))
    return out.dropna()


def pass_over(rows: DataFrame, p: int, family: Family, beta: np.ndarray | None, sums: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """R of [sqrt(W) X | sqrt(W) z] at beta (None: the start), and sums: n, deviance, Pearson, sum of w, log-likelihood pieces."""
    columns = [f"x{i}" for i in range(p)] + ["y", "off", "w"]

    def one(m: np.ndarray) -> np.ndarray:
        x, y, off, w = m[:, :p], m[:, p], m[:, p + 1], m[:, p + 2]
        eta = family.eta(family.start(y)) if beta is None else x @ beta + off
        mu = family.mean(eta)
        slope = family.slope(mu)
        z = eta - off + (y - mu) / slope
        root = np.sqrt(w * slope)[:, None]
        r = np.linalg.qr(np.column_stack([x, z]) * root, mode="r")
        skew = np.ones_like(mu) if family.link == "log" else np.zeros_like(mu) if family.link == "identity" else 1 - 2 * mu
        tail = np.zeros((1, p + 1))
        extra = [len(y), family.deviance(y, mu, w), (w * (y - mu) ** 2 / slope).sum(), w.sum(), (skew * (y - mu) / slope).sum()]
        return np.vstack([np.pad(r, ((0, p + 1 - len(r)), (0, 0))), tail, np.pad(np.array(extra)[:, None], ((0, 0), (0, p)))])

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = np.linalg.qr(np.vstack([a[: p + 1], b[: p + 1]]), mode="r")
        return np.vstack([np.pad(r, ((0, p + 1 - len(r)), (0, 0))), a[p + 1 :] + b[p + 1 :]])

    out = reduced(rows, columns, one, merge)
    if out is None:
        raise ValueError("no row is whole")
    return out[: p + 1], out[p + 2 :, 0]


def fit_glm(df: DataFrame, y: str, terms: list[str], family: str = "quasipoisson", intercept: bool = True, drop_aliased: bool = True, offset: str | None = None, exposure: str | None = None, freq_weights: str | None = None, var_weights: str | None = None, tol: float = 1e-10, rounds: int = 100) -> Fit:
    """Iterated least squares; rows with a missing value and aliased columns are dropped.

    The dispersion of quasi families and gaussian is Pearson's statistic over rows minus columns kept.
    """
    kind = Family(family)
    if exposure:
        df = df.withColumn("__off", F.log(F.col(exposure)) + (F.col(offset) if offset else F.lit(0.0)))
        offset = "__off"
    wide, names = with_terms(df, terms, intercept)
    rows = design(wide, y, names, offset, [c for c in (freq_weights, var_weights) if c]).cache()
    try:
        dropped: list[str] = []
        gone = aliased(triangular(rows, [f"x{i}" for i in range(len(names))])) if drop_aliased else []
        keep = [i for i in range(len(names)) if i not in gone]
        dropped = [names[i] for i in gone]
        p = len(keep)
        slim = rows.select(*[F.col(f"x{i}").alias(f"x{k}") for k, i in enumerate(keep)], "y", "off", "w")
        beta, before = None, np.inf
        for _ in range(rounds):
            r, extra = pass_over(slim, p, kind, beta)
            if beta is not None and abs(extra[1] - before) < tol * (abs(extra[1]) + 0.1):
                break
            before = extra[1] if beta is not None else np.inf
            beta = np.linalg.solve(r[:p, :p], r[:p, p])
        n, dev, pearson = int(extra[0]), float(extra[1]), float(extra[2])
        inv = np.linalg.inv(r[:p, :p])
        scale = 1.0 if kind.known else pearson / (n - p)
        return Fit([names[i] for i in keep], beta, inv @ inv.T * scale, kind.link, kind.name, scale, n, dev, dropped)
    finally:
        rows.unpersist()


def fitted(df: DataFrame, fit: Fit, name: str = "mu", offset: str | None = None) -> DataFrame:
    """df with the fitted mean; dummies are rebuilt from their names."""
    eta = F.col(offset).cast("double") if offset else F.lit(0.0)
    for n, b in zip(fit.names, fit.coef, strict=True):
        m = re.fullmatch(r"C\((.+)\)\[T\.(.+)\]", n)
        x = F.lit(1.0) if n == "Intercept" else (F.col(m.group(1)).cast("string") == m.group(2)).cast("double") if m else F.col(f"`{n}`").cast("double")
        eta = eta + float(b) * x
    mu = eta if fit.link == "identity" else F.exp(eta) if fit.link == "log" else 1 / (1 + F.exp(-eta))
    return df.withColumn(name, mu)
