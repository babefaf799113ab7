"""Bases: lin, poly, strata, thr, integer, ns, bs, ps, cr and functions of one's own.

A basis is fitted once, which settles its knots or levels, and is then a spec that gives the
same columns as numpy values and as SQL expressions.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numeric import quantile
from .pieces import Pieces, b_splines, derivative_at, extended, literal, polynomials, steps


class Data:
    """What a fit asks of its data; this one holds an array."""

    def __init__(self, x) -> None:
        self.x = np.asarray(x, float).ravel()
        self.ok = self.x[~np.isnan(self.x)]

    def range(self) -> tuple[float, float]:
        return (float(self.ok.min()), float(self.ok.max())) if len(self.ok) else (np.nan, np.nan)

    def quantiles(self, probs, within: tuple[float, float] | None = None, unique: bool = False) -> np.ndarray:
        x = self.ok if within is None else self.ok[(self.ok >= within[0]) & (self.ok <= within[1])]
        return quantile(np.unique(x) if unique else x, probs)

    def levels(self) -> np.ndarray:
        return np.unique(self.ok)

    def any_missing(self) -> bool:
        return len(self.ok) < len(self.x)


class Column(Data):
    """The same of a DataFrame's column (or an array column's elements), each answer one aggregate."""

    def __init__(self, df: DataFrame, column: str) -> None:
        kind = df.schema[column].dataType.simpleString()
        x = F.explode(F.col(column)) if kind.startswith("array") else F.col(column)
        self.rows = df.select(x.cast("double").alias("x")).select(F.nanvl("x", F.lit(None)).alias("x"))
        self.ends: tuple[float, float] | None = None

    def range(self) -> tuple[float, float]:
        if self.ends is None:
            r = self.rows.agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
            self.ends = (np.nan, np.nan) if r.a is None else (r.a, r.b)
        return self.ends

    def quantiles(self, probs, within=None, unique=False) -> np.ndarray:
        rows = self.rows if within is None else self.rows.filter((F.col("x") >= within[0]) & (F.col("x") <= within[1]))
        rows = rows.distinct() if unique else rows
        probs = [float(p) for p in np.atleast_1d(probs)]
        q = rows.agg(F.percentile("x", F.array(*map(F.lit, probs))).alias("q")).first().q
        return np.array(q if q is not None else [np.nan] * len(probs), float)

    def levels(self) -> np.ndarray:
        return np.array(sorted(r.x for r in self.rows.filter("x IS NOT NULL").distinct().collect()), float)

    def any_missing(self) -> bool:
        return self.rows.filter("x IS NULL").limit(1).count() > 0


@dataclass(frozen=True)
class Basis:
    """A fitted basis."""

    fun: str
    pieces: Pieces | None = None
    attrs: dict[str, Any] = field(default_factory=dict)
    range: tuple[float, float] = (np.nan, np.nan)
    cen: Any = None
    call: Callable | None = None

    @property
    def intercept(self) -> bool:
        return bool(self.attrs.get("intercept", False))

    @property
    def columns(self) -> int:
        if self.fun == "integer":
            return len(self.attrs["values"]) - (not self.intercept)
        return self.pieces.columns if self.pieces is not None else len(np.atleast_2d(self(np.array([np.nanmean(self.range)])))[0])

    def names(self, name: str = "b") -> list[str]:
        return [f"{name}_b{i + 1}" for i in range(self.columns)]

    def __call__(self, x) -> np.ndarray:
        """Columns at x as a matrix; missing and (for integer) unknown values give rows of NaN."""
        x = np.asarray(x, float).ravel()
        if self.call is not None:
            return np.asarray(self.call(x, **self.attrs)[0], float).reshape(len(x), -1)
        if self.fun == "integer":
            values = self.attrs["values"]
            out = (x[:, None] == values[None, :]).astype(float)
            out[~np.isin(x, values)] = np.nan
            return out[:, (0 if self.intercept else 1) :]
        return self.pieces(x)

    def sql(self, x: str) -> list[str]:
        """An expression for each column."""
        if self.call is not None:
            raise ValueError("a function of one's own has no SQL: use with_basis")
        if self.fun == "integer":
            values = self.attrs["values"]
            known = ", ".join(map(literal, values))
            return [f"CASE WHEN {x} IN ({known}) THEN CASE WHEN {x} = {literal(v)} THEN {literal(1)} ELSE {literal(0)} END END" for v in values[(0 if self.intercept else 1) :]]
        return self.pieces.sql(x)


def _outer(t: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(t[0], order), np.repeat(t[-1], order)


def _interior(data: Data, knots, df, given: int, limits, strict: bool) -> np.ndarray:
    """Interior knots as given, or at equal quantiles of the data within the boundary.

    Quantiles on a boundary move inwards by an eighth of the way to the next knot. If all are on one, a strict
    basis refuses and another keeps them there; both warn.
    """
    if knots is None:
        n = 0 if df is None else int(df) - given
        if n < 0:
            n = 0
            warnings.warn(f"'df' was too small; have used {given}", stacklevel=4)
        knots = data.quantiles(np.arange(1, n + 1) / (n + 1), limits) if n else np.zeros(0)
        inner = np.array(knots, float)
        for bound in limits:
            there = inner == bound
            if not there.any():
                continue
            if there.all():
                if strict:
                    raise ValueError(f"all interior knots lie on the boundary {bound:g}")
                warnings.warn(f"all interior knots lie on the boundary {bound:g}", stacklevel=4)
                continue
            gaps = inner[~there] - bound
            inner[there] = bound + gaps[np.abs(gaps).argmin()] / 8
            warnings.warn(f"interior knots on the boundary {bound:g} were moved inwards", stacklevel=4)
        return np.sort(inner)
    return np.sort(np.atleast_1d(np.asarray(knots, float)))


def _limits(data: Data, boundary) -> tuple[float, float]:
    low, high = sorted(map(float, boundary)) if boundary is not None else data.range()
    return (low * 7 / 8, high * 9 / 8) if low == high else (low, high)


def _lin(data: Data, intercept=False):
    return polynomials([0, 1] if intercept else [1]), {"intercept": bool(intercept)}


def _poly(data: Data, degree=1, scale=None, intercept=False):
    if degree < 1:
        raise ValueError("'degree' must be at least 1")
    scale = float(scale) if scale is not None else max(abs(v) for v in data.range())
    return polynomials(list(range(0 if intercept else 1, int(degree) + 1)), scale), {"degree": int(degree), "scale": scale, "intercept": bool(intercept)}


def _strata(data: Data, df=1, breaks=None, ref=1, intercept=False):
    if breaks is None:
        n = int(df) - bool(intercept)
        breaks = data.quantiles(np.arange(1, n + 1) / (n + 1)) if n > 0 else np.zeros(0)
    breaks = np.sort(np.atleast_1d(np.asarray(breaks, float)))
    low, high = data.range()
    edges = np.sort(np.concatenate([[low - 1e-4], breaks, [high + 1e-4]])) if np.isfinite(low) else breaks
    if len(np.unique(edges)) < len(edges):
        raise ValueError("breaks must differ, also from the ends of the data")
    k = len(breaks) + 1
    if not 0 <= ref <= k or (ref == 0 and not intercept):
        raise ValueError("'ref' must be a stratum, or 0 with an intercept")
    values = np.eye(k)
    if ref:
        values = np.delete(values, ref - 1, 1)
        if intercept:
            values = np.column_stack([np.ones(k), values])
    if values.shape[1] == 0:
        values = np.ones((k, 1))
    if np.isfinite(low):  # no stratum beyond the outer edges
        none = np.full((1, values.shape[1]), np.nan)
        return steps(edges, np.vstack([none, values, none])), {"breaks": breaks, "ref": ref, "intercept": bool(intercept)}
    return steps(breaks, values), {"breaks": breaks, "ref": ref, "intercept": bool(intercept)}


def _thr(data: Data, thr_value=None, side=None, intercept=False):
    if thr_value is None:
        thr_value = np.nan if data.any_missing() else data.quantiles(0.5)
    t = np.sort(np.atleast_1d(np.asarray(thr_value, float)))
    side = side or ("d" if len(t) > 1 else "h")
    if side not in ("h", "l", "d"):
        raise ValueError("'side' must be h, l or d")
    ends = [t[0], t[-1]] if side == "d" else [t[0]]
    breaks = np.unique(ends)
    origin = np.concatenate([[breaks[0]], breaks])
    n = (2 if side == "d" else 1) + bool(intercept)
    coef = np.zeros((len(breaks) + 1, 2, n))
    if intercept:
        coef[:, 0, 0] = 1
    at = int(bool(intercept))
    if side in ("l", "d"):
        coef[0, 1, at] = -1
    if side in ("h", "d"):
        coef[-1, 1, n - 1] = 1
    if np.isnan(t).any():
        coef[:] = np.nan
    return Pieces(breaks, origin, coef), {"thr_value": t, "side": side, "intercept": bool(intercept)}


def _integer(data: Data, values=None, intercept=False):
    values = np.unique(np.asarray(values, float)) if values is not None else data.levels()
    return None, {"values": values, "intercept": bool(intercept) or len(values) == 1}


def _ns(data: Data, df=None, knots=None, intercept=False, boundary=None):
    limits = _limits(data, boundary)
    inner = _interior(data, knots, df, 1 + bool(intercept), limits, True)
    t = np.sort(np.concatenate([np.repeat(limits, 4), inner]))
    p = b_splines(t, 4)
    last = len(p.breaks) - 1
    curved = np.stack([derivative_at(p, 1, p.breaks[0], 2), derivative_at(p, last, p.breaks[-1], 2)])
    first = 0 if intercept else 1
    q = np.linalg.qr(curved[:, first:].T, mode="complete")[0]
    out = extended(p, 1, last, 1)
    out = Pieces(out.breaks, out.origin, out.coef[:, :, first:]).combined(q[:, 2:])
    return out, {"knots": inner, "boundary": limits, "intercept": bool(intercept), "df": out.columns}


def _bs(data: Data, df=None, knots=None, degree=3, intercept=False, boundary=None):
    if degree < 1:
        raise ValueError("'degree' must be at least 1")
    limits = _limits(data, boundary)
    inner = _interior(data, knots, df, degree + bool(intercept), limits, False)
    p = b_splines(np.sort(np.concatenate([np.repeat(limits, degree + 1), inner])), degree + 1)
    out = extended(p, 1, len(p.breaks) - 1, degree)
    out = Pieces(out.breaks, out.origin, out.coef[:, :, (0 if intercept else 1) :])
    return out, {"knots": inner, "degree": int(degree), "boundary": limits, "intercept": bool(intercept), "df": out.columns}


def _penalty(S, full: np.ndarray, intercept: bool, fx: bool):
    if fx:
        return None
    own = full if intercept else full[1:, 1:]
    if S is not None and np.shape(S) != own.shape:
        raise ValueError("the penalty's shape doesn't match")
    return (own + own.T) / 2 if S is None else np.asarray(S, float)


def _ps(data: Data, df=10, knots=None, degree=3, intercept=False, fx=False, S=None, diff=2):
    if degree < 1 or diff < 1:
        raise ValueError("'degree' and 'diff' must be at least 1")
    given = np.asarray(knots, float).ravel() if knots is not None else None
    if given is None or len(given) == 2:
        if int(df) - degree <= 1:
            raise ValueError("'df' is too small for the degree")
        low, high = data.range()
        pad = 0.001 * (high - low)
        if given is not None:
            low, high = sorted(given)
        n = int(df) - degree + 2 - bool(intercept)
        step = (high - low + 2 * pad) / (n - 1)
        t = np.linspace(low - pad - step * degree, high + pad + step * degree, n + 2 * degree)
    else:
        t = given
        if len(t) - 2 * degree - 2 + bool(intercept) <= 1:
            raise ValueError("too few knots for the degree")
    p = b_splines(t, degree + 1)
    own = Pieces(p.breaks, p.origin, p.coef[:, :, (0 if intercept else 1) :])
    d = np.diff(np.eye(p.columns), diff, axis=0)
    return own, {"knots": t, "degree": int(degree), "diff": int(diff), "intercept": bool(intercept), "fx": bool(fx), "S": _penalty(S, d.T @ d, intercept, fx), "df": own.columns}


def _cr(data: Data, df=10, knots=None, intercept=False, fx=False, S=None):
    if knots is None:
        if df < 3:
            raise ValueError("'df' must be at least 3")
        knots = data.quantiles(np.linspace(0, 1, int(df) + (not intercept)), unique=True)
    t = np.sort(np.asarray(knots, float).ravel())
    if len(t) < 3:
        raise ValueError("a cr basis needs at least 3 knots")
    n, h = len(t), np.diff(t)
    # second derivatives at the knots as linear functions of the values there: natural ends, B m = D y
    D, B = np.zeros((n - 2, n)), np.diag((h[:-1] + h[1:]) / 3) + np.diag(h[1:-1] / 6, 1) + np.diag(h[1:-1] / 6, -1)
    rows = np.arange(n - 2)
    D[rows, rows], D[rows, rows + 2] = 1 / h[:-1], 1 / h[1:]
    D[rows, rows + 1] = -1 / h[:-1] - 1 / h[1:]
    inner = np.linalg.solve(B, D)
    m = np.vstack([np.zeros(n), inner, np.zeros(n)])
    y = np.eye(n)
    coef = np.zeros((n + 1, 4, n))
    for i in range(n - 1):
        coef[i + 1, 0] = y[i]
        coef[i + 1, 1] = (y[i + 1] - y[i]) / h[i] - h[i] * (2 * m[i] + m[i + 1]) / 6
        coef[i + 1, 2] = m[i] / 2
        coef[i + 1, 3] = (m[i + 1] - m[i]) / (6 * h[i])
    p = extended(Pieces(t, np.concatenate([[t[0]], t]), coef), 1, n - 1, 1)
    own = Pieces(p.breaks, p.origin, p.coef[:, :, (0 if intercept else 1) :])
    return own, {"knots": t, "intercept": bool(intercept), "fx": bool(fx), "S": _penalty(S, D.T @ inner, intercept, fx), "df": own.columns}


def dumps(basis: Basis) -> str:
    """A fitted basis as JSON; not for functions of one's own."""
    if basis.call is not None:
        raise ValueError("a function of one's own can't be written")
    plain = lambda v: v.tolist() if isinstance(v, np.ndarray) else list(v) if isinstance(v, tuple) else v
    p = basis.pieces
    spec = {"fun": basis.fun, "range": list(basis.range), "cen": basis.cen, "attrs": {k: plain(v) for k, v in basis.attrs.items()}}
    return json.dumps(spec | ({"breaks": p.breaks.tolist(), "origin": p.origin.tolist(), "coef": p.coef.tolist()} if p is not None else {}))


def loads(text: str) -> Basis:
    """The basis that dumps wrote."""
    s = json.loads(text)
    array = lambda v: np.array(v, float) if isinstance(v, list) else v
    p = Pieces(np.array(s["breaks"], float), np.array(s["origin"], float), np.array(s["coef"], float)) if "coef" in s else None
    return Basis(s["fun"], p, {k: array(v) for k, v in s["attrs"].items()}, tuple(s["range"]), s["cen"])


FITS: dict[str, Callable] = {"lin": _lin, "poly": _poly, "strata": _strata, "thr": _thr, "integer": _integer, "ns": _ns, "bs": _bs, "ps": _ps, "cr": _cr}
#: Other spellings of arguments.
ALIASES = {"type": "fun", "boundary_knots": "boundary", "boundary.knots": "boundary", "thr.value": "thr_value", "thr": "thr_value", "int": "intercept"}


def normalised(args: dict[str, Any]) -> dict[str, Any]:
    """Arguments under their own names; one that is given twice is an error."""
    out: dict[str, Any] = {}
    for key, value in args.items():
        name = key.lower()
        name = ALIASES.get(name, name)
        if len(name) > 3 and "boundary_knots".startswith(name.replace(".", "_")):
            name = "boundary"
        if len(name) > 3 and "intercept".startswith(name):
            name = "intercept"
        if name in out:
            raise TypeError(f"{name} is given twice")
        out[name] = value
    return out


def fit_basis(data: Data, fun: str | Callable = "ns", cen: Any = None, **args: Any) -> Basis:
    """A basis whose knots, levels and scale come from the data unless they are given."""
    args = normalised(args)
    if callable(fun):
        x = getattr(data, "x", None)
        low, high = data.range()
        attrs = dict(fun(x if x is not None else np.linspace(low, high, 101), **args)[1])
        return Basis("custom", None, args | attrs, (low, high), cen, fun)
    if fun not in FITS:
        raise ValueError(f"no basis {fun!r}; there are {', '.join(FITS)}")
    pieces, attrs = FITS[fun](data, **args)
    return Basis(fun, pieces, attrs, data.range(), cen)


def one_basis(rows: DataFrame, column: str, fun: str | Callable = "ns", cen: Any = None, **args: Any) -> Basis:
    """A basis fitted to a DataFrame's column."""
    return fit_basis(Column(rows, column), fun, cen, **args)


#: Formulas (columns times pieces) above which a basis is evaluated in Arrow batches: their code would be too large to compile.
WIDE = 60


def with_basis(df: DataFrame, column: str, basis: Basis, name: str = "b") -> DataFrame:
    """df with the basis columns {name}_b1, {name}_b2, ...; wide bases and functions of one's own run in Arrow batches."""
    names = basis.names(name)
    clean = f"nanvl(CAST(`{column}` AS DOUBLE), CAST(NULL AS DOUBLE))"
    if basis.call is None and (basis.pieces is None or basis.pieces.columns * len(basis.pieces.origin) <= WIDE):
        return df.withColumn("__x", F.expr(clean)).select("*", *[F.expr(e).alias(n) for e, n in zip(basis.sql("__x"), names, strict=True)]).drop("__x")
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<double>")
    def values(x):
        import pandas as pd

        out = basis(x.to_numpy(float))
        return pd.Series([None if np.isnan(r).any() else r for r in out])

    wide = df.withColumn("__b", values(F.expr(clean)))
    return wide.select("*", *[F.col("__b")[i].alias(n) for i, n in enumerate(names)]).drop("__b")
