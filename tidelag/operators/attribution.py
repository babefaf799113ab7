"""Attributable numbers and fractions, minimum-risk exposures, and draws of coefficients."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.basis import with_basis
from ..functions.numeric import percentile_knots, percentile_of, quantile
from ..functions.pieces import literal
from .crossbasis import CrossBasis, with_cross_basis, with_history_basis
from .glm import Fit
from .lags import in_blocks, lag_sql, over
from .linalg import reduced
from .predict import coefficients, grid, predict


def draws_of(coef, vcov, nsim: int = 5000, seed: int | None = None, normals=None, eigvecs=None) -> np.ndarray:
    """Coefficient draws, one in each column: coef + U sqrt(L) Z'; eigenvectors have their largest entry positive.

    With eigvecs, U is as given and L has the variance along each of its columns, in their order.
    """
    c, v = np.asarray(coef, float).ravel(), np.atleast_2d(np.asarray(vcov, float))
    v = (v + v.T) / 2
    if eigvecs is None:
        u = np.linalg.eigh(v)[1][:, ::-1]
        u = u * np.sign(u[np.abs(u).argmax(0), np.arange(len(c))])
    else:
        u = np.asarray(eigvecs, float)
        if u.shape != v.shape:
            raise ValueError("as many eigenvectors as coefficients")
    along = np.maximum(((v @ u) * u).sum(0), 0)
    z = np.asarray(normals, float) if normals is not None else np.random.default_rng(seed).standard_normal((nsim, len(c)))
    if z.ndim != 2 or z.shape[1] != len(c):
        raise ValueError("a column of normals for each coefficient")
    return c[:, None] + (u * np.sqrt(along)) @ z.T


@dataclass
class Attribution:
    """Totals, or with tot=False the DataFrame rows with af and an."""

    af: float | None
    an: float | None
    rows: DataFrame | None = None
    afsim: np.ndarray | None = None
    ansim: np.ndarray | None = None


def attribute(df: DataFrame, x: str, cases: str | list[str], basis: CrossBasis, order_by: str, cen: float | None = None, model: Fit | None = None, coef=None, vcov=None, link: str | None = None, direction: str = "back", tot: bool = True, limits: tuple[float, float] | None = None, group: str | None = None, draws: np.ndarray | None = None, name: str = "cb", block_rows: int | None = None) -> Attribution:
    """Numbers and fractions attributable to exposures other than cen, from past exposures (back) or to future cases (forw).

    The fraction is over rows with whole lag histories; the number is the fraction of all cases. Exposures
    outside limits count as cen. For forw, cases may be a list of columns, one for each lag. Reduced
    coefficients are for forw only. The sum over lags is taken in the cross-basis, never as a row for each lag.
    For back, x may hold arrays, each row's history with its first lag first. With block_rows, lags are taken in
    blocks of so many rows.
    """
    histories = isinstance(df.schema[x].dataType, ArrayType)
    if histories and direction == "forw":
        raise ValueError("histories are for direction back")
    if direction not in ("back", "forw"):
        raise ValueError("'direction' is back or forw")
    ref = basis.var.cen if cen is None else cen
    if ref is None or isinstance(ref, (bool, np.bool_)):
        raise ValueError("'cen' must be given")
    short = model is None and coef is not None and np.size(coef) != basis.columns
    if short:
        if direction == "back":
            raise ValueError("reduced coefficients are for direction forw")
        c, v = np.asarray(coef, float).ravel(), np.atleast_2d(np.asarray(vcov, float))
        if len(c) != basis.df[0]:
            raise ValueError("the coefficients don't match the basis")
    else:
        c, v, link = coefficients(model, coef, vcov, name, "cb", basis.columns, link)
    if link is not None and link not in ("log", "logit"):
        raise ValueError("attribution needs a log or logit link")
    low, high = basis.lag
    weights = basis.weights.sum(0)
    at_ref = basis.var(np.array([float(ref)]))[0]

    def masked(value):
        clean = F.nanvl(value.cast("double"), F.lit(None))
        return clean if limits is None else F.when((clean < float(limits[0])) | (clean > float(limits[1])), F.lit(float(ref))).otherwise(clean)

    rows = df.withColumn("__e", F.transform(F.col(x), masked) if histories else masked(F.col(x)))
    many = isinstance(cases, (list, tuple))
    if many and (direction == "back" or len(cases) != high - low + 1):
        raise ValueError("a column of cases for each lag is for direction forw")
    if many:
        own = [F.nanvl(F.col(k).cast("double"), F.lit(None)) for k in cases]
        present = sum(o.isNotNull().cast("double") for o in own)
        rows = rows.withColumn("__c", sum(own) / len(own)).withColumn("__all", F.when(present > 0, sum(F.coalesce(o, F.lit(0.0)) for o in own) / present))
    else:
        rows = rows.withColumn("__all", F.nanvl(F.col(cases).cast("double"), F.lit(None)))
        if direction == "forw":
            w = over(order_by, group)
            total = " + ".join(lag_sql("__all", -k, w) for k in range(low, high + 1))
            rows = rows.withColumn("__c", F.expr(f"({total}) / {high - low + 1}"))
        else:
            rows = rows.withColumn("__c", F.col("__all"))
    if direction == "back":
        rows = with_history_basis(rows, "__e", basis, "__w") if histories else with_cross_basis(rows, "__e", basis, order_by, group, "__w", check=False, block_rows=block_rows)
        names, shift = basis.names("__w"), np.outer(at_ref, weights).ravel()
    else:
        rows = with_basis(rows, "__e", basis.var, "__w")
        names, shift = basis.var.names("__w"), at_ref
    if direction == "forw" and not short:  # the sum over lags needs only the exposure side of the coefficients
        m = np.kron(np.eye(basis.df[0]), weights[None, :])
        c = m @ c
        draws = m @ draws if draws is not None else None
    eta = " + ".join(f"(`{n}` - {literal(s)}) * {literal(b)}" for n, s, b in zip(names, shift, c, strict=True))
    rows = rows.withColumn("__af", F.expr(f"1 - exp(-({eta}))"))
    if not tot:
        if draws is not None:
            raise ValueError("draws are of totals")
        return Attribution(None, None, rows.select(*df.columns, F.col("__af").alias("af"), (F.col("__af") * F.col("__c")).alias("an")))
    got = rows.agg(F.sum(F.col("__af") * F.col("__c")).alias("an"), F.sum(F.when((F.col("__af") * F.col("__c")).isNotNull(), F.col("__c"))).alias("n"), F.sum("__all").alias("all")).first()
    af = got["an"] / got["n"] if got["n"] else float("nan")
    out = Attribution(af, af * (got["all"] or 0.0))
    if draws is not None:
        b = np.asarray(draws, float)

        def one(m: np.ndarray) -> np.ndarray:
            return ((1 - np.exp(-((m[:, :-1] - shift) @ b))).T @ m[:, -1])[None, :]

        whole = rows.select(*[F.col(f"`{n}`") for n in names], "__c").dropna()
        total = reduced(whole, [*names, "__c"], one, lambda p, q: p + q)
        out.afsim = total[0] / got["n"] if total is not None else np.full(b.shape[1], np.nan)
        out.ansim = out.afsim * (got["all"] or 0.0)
    return out


def lowest(basis: CrossBasis, model: Fit | None = None, coef=None, vcov=None, at=None, start=None, stop=None, by: float = 0.1, draws: np.ndarray | None = None, name: str = "cb"):
    """The exposure of the grid with the lowest overall (uncentred) association, or one for each draw; the first of equals."""
    c, _, _ = coefficients(model, coef, vcov, name, "cb", basis.columns, None)
    x = grid(basis.range, at, start, stop, by)
    rows = np.kron(basis.var(x), basis.weights.sum(0)[None, :])
    if draws is None:
        return float(x[np.argmin(rows @ c)])
    return x[np.argmin(rows @ np.asarray(draws, float), axis=0)]


@dataclass
class MinimumRisk:
    """Minimum-risk exposure with an interval and its percentile."""

    value: float
    low: float
    high: float
    percentile: float
    level: float
    sims: np.ndarray

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(self.value, self.low, self.high, self.percentile)], "mmt double, low double, high double, percentile double")


def minimum_risk(df: DataFrame, x: str, basis: CrossBasis, model: Fit | None = None, coef=None, vcov=None, percentiles=(1, 99), by: float = 0.1, level: float = 0.95, nsim: int = 1000, seed: int | None = None, name: str = "cb") -> MinimumRisk:
    """Searches between two percentiles of the exposure."""
    c, v, _ = coefficients(model, coef, vcov, name, "cb", basis.columns, None)
    low, high = percentile_knots(df, x, percentiles)
    value = lowest(basis, coef=c, vcov=v, start=low, stop=high, by=by)
    sims = lowest(basis, coef=c, vcov=v, start=low, stop=high, by=by, draws=draws_of(c, v, nsim, seed))
    a, b = quantile(sims, [(1 - level) / 2, 1 - (1 - level) / 2])
    return MinimumRisk(value, float(a), float(b), float(percentile_of(df, x, value)[0]), level, sims)


#: The components, in order.
COMPONENTS = ("total", "cold", "heat", "extreme cold", "moderate cold", "moderate heat", "extreme heat")


def attribution_table(df: DataFrame, x: str, cases: str, basis: CrossBasis, order_by: str, cen: float, model: Fit | None = None, coef=None, vcov=None, link: str | None = None, direction: str = "back", extreme=(2.5, 97.5), nsim: int = 0, seed: int | None = None, level: float = 0.95, group: str | None = None, draws: np.ndarray | None = None, name: str = "cb", block_rows: int | None = None) -> DataFrame:
    """component, low_x, high_x, an, af and, with draws, an_low, an_high, af_low, af_high; all components share the draws.

    All components and draws are one pass over one window.
    """
    c, v, link = coefficients(model, coef, vcov, name, "cb", basis.columns, link)
    if link is not None and link not in ("log", "logit"):
        raise ValueError("attribution needs a log or logit link")
    clean = F.nanvl(F.col(x).cast("double"), F.lit(None))
    r = df.agg(F.min(clean).alias("a"), F.max(clean).alias("b")).first()
    cold, heat = percentile_knots(df, x, extreme)
    cold, heat = min(cold, cen), max(heat, cen)
    spans = [(r.a, r.b), (r.a, cen), (cen, r.b), (r.a, cold), (cold, cen), (cen, heat), (heat, r.b)]
    if draws is None and nsim:
        draws = draws_of(c, v, nsim, seed)
    many = c[:, None] if draws is None else np.column_stack([c, np.asarray(draws, float)])
    af, an = _components(df, x, cases, basis, order_by, float(cen), many, direction, spans, group, block_rows)
    ends = [(1 - level) / 2, 1 - (1 - level) / 2]
    out = []
    for k, (part, (a, b)) in enumerate(zip(COMPONENTS, spans, strict=True)):
        row = [part, float(a), float(b), float(an[k, 0]), float(af[k, 0])]
        if draws is not None:
            row += [*map(float, quantile(an[k, 1:], ends)), *map(float, quantile(af[k, 1:], ends))]
        out.append(tuple(row))
    schema = "component string, low_x double, high_x double, an double, af double" + (", an_low double, an_high double, af_low double, af_high double" if draws is not None else "")
    return df.sparkSession.createDataFrame(out, schema)


#: Products of rows and coefficient vectors that are held at once.
CELLS = 1 << 20


def _components(df: DataFrame, x: str, cases: str, basis: CrossBasis, order_by: str, cen: float, coefs: np.ndarray, direction: str, spans, group: str | None, block_rows: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """af and an (a row for each span, a column for each coefficient vector), in one pass over one window.

    A row carries its exposures at all lags. An exposure outside a span counts as cen, so its centred basis is 0
    there: each lag's part is kept or set to 0 before it is contracted with the lag weights.
    """
    if direction not in ("back", "forw"):
        raise ValueError("'direction' is back or forw")
    low, high = basis.lag
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    reach = basis.lag if direction == "back" else (-high, -low)
    source = in_blocks(df, order_by, group, reach, block_rows) if block_rows else df
    w = over(order_by, group, bool(block_rows))
    keys = [f"`{order_by}`", *([f"`{group}`"] if group else []), *(["__block", "__own"] if block_rows else [])]
    rows = source.select(*keys, number(x).alias("__x"), number(cases).alias("__n"))
    if direction == "back":
        lagged, count, weights = [lag_sql("__x", k, w) for k in range(low, high + 1)], "__n", basis.weights
    else:
        lagged, weights = ["__x"], basis.weights.sum(0)[None, :]
        count = f"({' + '.join(lag_sql('__n', -k, w) for k in range(low, high + 1))}) / {high - low + 1}"
    own = [f"__x{k}" for k in range(len(lagged))]
    rows = rows.select(*(["__own"] if block_rows else []), *[F.expr(e).alias(n) for e, n in zip(lagged, own, strict=True)], F.expr(count).alias("__c"), "__n")
    rows = rows.where("__own") if block_rows else rows
    at_ref, width, nv = basis.var(np.array([cen]))[0], len(own), basis.df[0]

    def one(m: np.ndarray) -> np.ndarray:
        """For each span its number and, in the last column, its cases; a last row has all cases."""
        total = np.zeros((len(spans) + 1, coefs.shape[1] + 1))
        total[-1, -1] = np.nansum(m[:, -1])
        m = m[np.isfinite(m[:, : width + 1]).all(1)]
        step = max(1, CELLS // coefs.shape[1])
        for k in range(0, len(m), step):
            past, c = m[k : k + step, :width], m[k : k + step, width]
            centred = (basis.var(past.ravel()) - at_ref).reshape(len(past), width, nv)
            whole = np.isfinite(centred).all((1, 2))
            for i, (a, b) in enumerate(spans):
                inside = ((past >= a) & (past <= b))[:, :, None]
                cross = np.einsum("nkv,kl->nvl", np.where(inside, centred, 0.0), weights).reshape(len(past), -1)
                total[i, :-1] += c[whole] @ -np.expm1(-(cross[whole] @ coefs))
                total[i, -1] += c[whole].sum()
        return total

    got = reduced(rows, [*own, "__c", "__n"], one, lambda p, q: p + q)
    if got is None:
        got = np.zeros((len(spans) + 1, coefs.shape[1] + 1))
    with np.errstate(invalid="ignore", divide="ignore"):
        af = got[:-1, :-1] / got[:-1, -1:]
    return af, af * got[-1, -1]


def overall_at(basis: CrossBasis, coef, vcov, values, cen: float, link: str = "log", level: float = 0.95):
    """The overall association at some values."""
    return predict(basis, coef=coef, vcov=vcov, link=link, at=values, cen=cen, level=level)
