"""Cross-bases: W[t, v, l] = sum over lags k of R(x at t - k)[v] * C[k, l], as window and arithmetic expressions."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basis import Basis, Column, Data, FITS, fit_basis, normalised, with_basis
from ..functions.numeric import lag_range, lag_seq
from ..functions.pieces import literal
from .lags import check_groups, in_blocks, lag_sql, over


@dataclass(frozen=True)
class CrossBasis:
    """Both bases, fitted, and the lags they span."""

    var: Basis
    lag_basis: Basis
    lag: tuple[int, int]

    @property
    def df(self) -> tuple[int, int]:
        return self.var.columns, self.lag_basis.columns

    @property
    def columns(self) -> int:
        return self.df[0] * self.df[1]

    @property
    def range(self) -> tuple[float, float]:
        return self.var.range

    @property
    def weights(self) -> np.ndarray:
        """The lag basis at each lag of the range."""
        return self.lag_basis(lag_seq(self.lag))

    def names(self, name: str = "cb") -> list[str]:
        """Column names, the lag index fastest."""
        return [f"{name}_v{i + 1}_l{j + 1}" for i in range(self.df[0]) for j in range(self.df[1])]

    def matrix(self, histories: np.ndarray) -> np.ndarray:
        """The columns for rows of histories (a column for each lag)."""
        q = np.asarray(histories, float)
        r = self.var(q.ravel()).reshape(*q.shape, -1)
        return np.einsum("nkv,kl->nvl", r, self.weights).reshape(len(q), -1)


def lag_basis(lag, arglag: dict[str, Any] | None = None) -> Basis:
    """The basis over lags, with an intercept unless said otherwise; without arguments one stratum (a moving sum)."""
    grid = lag_seq(lag)
    args = normalised(arglag or {})
    if not args or len(grid) == 1:
        return fit_basis(Data(grid), "strata", df=1, intercept=True)
    fun = args.pop("fun", "ns")
    if isinstance(fun, str) and fun in FITS:
        args.setdefault("intercept", True)
    args.pop("cen", None)
    return fit_basis(Data(grid), fun, **args)


def cross_basis(df: DataFrame, column: str, lag, argvar: dict[str, Any] | None = None, arglag: dict[str, Any] | None = None) -> CrossBasis:
    """Fits both bases; column holds numbers, or arrays with a value for each lag."""
    return _of(Column(df, column), lag, argvar, arglag)


def cross_basis_of(x, lag, argvar: dict[str, Any] | None = None, arglag: dict[str, Any] | None = None) -> CrossBasis:
    """The same for an array (of values, or of histories)."""
    return _of(Data(x), lag, argvar, arglag)


def _of(data: Data, lag, argvar, arglag) -> CrossBasis:
    return CrossBasis(fit_basis(data, **({"fun": "ns"} | normalised(argvar or {}))), lag_basis(lag, arglag), lag_range(lag))


def contraction(packed: str, weights: np.ndarray) -> str:
    """Sum of an array's elements times weights; null if any element is null, whatever its weight."""
    return " + ".join(f"{packed}[{k}] * {literal(w)}" for k, w in enumerate(weights))


def with_cross_basis(df: DataFrame, column: str, cb: CrossBasis, order_by: str, group: str | None = None, name: str = "cb", check: bool = True, block_rows: int | None = None) -> DataFrame:
    """df with the cross-basis columns; lags never cross groups. One window serves all columns.

    Without a group the window has a single partition: meant for one aggregated series. With block_rows,
    series are cut into blocks of so many rows, each with the rows before it that its lags reach.
    """
    if check:
        check_groups(df, order_by, group, cb.lag)
    low, high = cb.lag
    w, own = over(order_by, group, bool(block_rows)), cb.var.names("__r")
    source = in_blocks(df, order_by, group, cb.lag, block_rows) if block_rows else df
    rows = with_basis(source, column, cb.var, "__r")
    packed = [F.expr(f"array({', '.join(lag_sql(r, k, w) for k in range(low, high + 1))})").alias(f"__q{i}") for i, r in enumerate(own)]
    rows = rows.select(*df.columns, *packed, *(["__own"] if block_rows else []))
    rows = rows.where("__own") if block_rows else rows
    return _contracted(rows, df.columns, cb, name)


def with_history_basis(df: DataFrame, column: str, cb: CrossBasis, name: str = "cb") -> DataFrame:
    """The same of an array column that holds each row's history, first lag first."""
    clean = F.transform(F.col(column), lambda v: F.nanvl(v.cast("double"), F.lit(None)))
    rows = df.withColumn("__h", clean)
    rows = rows.select(*df.columns, *[F.expr(f"transform(__h, h -> {e})").alias(f"__q{i}") for i, e in enumerate(cb.var.sql("h"))])
    return _contracted(rows, df.columns, cb, name)


#: Products above which sums over lags are taken in Arrow batches: their code would be too large to compile.
WIDE = 250


def _contracted(rows: DataFrame, keep: list[str], cb: CrossBasis, name: str) -> DataFrame:
    c = cb.weights
    if cb.columns * len(c) > WIDE:
        from pyspark.sql.functions import pandas_udf

        parts = cb.df[0]

        @pandas_udf("array<double>")
        def sums(flat):
            import numpy as np
            import pandas as pd

            none = np.full(parts * len(c), np.nan)
            held = np.array([none if v is None else v for v in flat], float).reshape(-1, parts, len(c))
            out = np.einsum("nvk,kl->nvl", held, c).reshape(len(held), -1)
            return pd.Series(list(out))

        known = F.transform(F.flatten(F.array(*[f"__q{i}" for i in range(parts)])), lambda v: F.coalesce(v, F.lit(float("nan"))))
        wide = rows.withColumn("__w", sums(known))
        value = lambda i: F.nanvl(F.col("__w")[i], F.lit(None).cast("double"))
        return wide.select(*keep, *[value(i).alias(n) for i, n in enumerate(cb.names(name))])
    cells = [F.expr(contraction(f"__q{i}", c[:, j])) for i in range(cb.df[0]) for j in range(cb.df[1])]
    return rows.select(*keep, *[e.alias(n) for e, n in zip(cells, cb.names(name), strict=True)])


def described(attrs: dict[str, Any]) -> str:
    """The arguments of a basis in a line: numbers short, matrices by their size, those without a value left out."""
    parts = []
    for key, value in attrs.items():
        if value is None:
            continue
        v = np.asarray(value) if isinstance(value, (np.ndarray, list, tuple)) else None
        shown = str(value) if v is None else f"matrix of {' by '.join(map(str, v.shape))}" if v.ndim > 1 else " ".join(f"{x:g}" for x in v)
        parts.append(f"{key}: {shown}")
    return "; ".join(parts)


def summary(cb: CrossBasis) -> str:
    """A few lines of text."""
    return f"cross-basis of {cb.columns} columns\nvar: {cb.var.fun}, {cb.df[0]} columns, range {cb.range[0]:g} to {cb.range[1]:g}\n  {described(cb.var.attrs)}\nlag: {cb.lag_basis.fun}, {cb.df[1]} columns, {cb.lag[0]} to {cb.lag[1]}\n  {described(cb.lag_basis.attrs)}"
