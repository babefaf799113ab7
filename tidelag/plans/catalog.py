"""Named queries of the lag engine and their DuckDB SQL.

Floating results are rounded on both sides, as the order of sums differs. The SQL is written from the
definitions (windows, the B-spline recursion, sums over lags), not from the engine's expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.basis import Basis, Data, fit_basis, one_basis, with_basis
from ..operators import attribution as attr
from ..operators import predict as pred
from ..operators.clogit import fit_clogit
from ..operators.crossbasis import CrossBasis, cross_basis_of, with_cross_basis, with_history_basis
from ..operators.glm import fit_glm, fitted
from ..operators.lags import exposure_histories, filled_calendar, with_lags
from ..operators.linalg import aliased, gram, triangular
from ..operators.penalized import cross_penalty, fit_penalized
from ..operators.twostage import fit_groups, pooled, stacked
from ..operators.uncertainty import interval_frame, model_grid, poisson_loglik, qaic
from ..sources import series
from ..sources.datasets import simulate_cities
from . import recipes
from .fit_sql import irls, matched
from .plots import histogram
from .workflow import fit_lag_model

#: A daily series in SQL: what sources.series.daily gives.
DAILY = "daily AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS y, 100 * avg(l_discount) AS x, avg(l_quantity) AS q FROM lineitem GROUP BY 1)"
GROUPED = "daily AS (SELECT l_returnflag AS g, CAST(l_shipdate AS DATE) AS day, count(*) AS y, 100 * avg(l_discount) AS x, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2)"
#: The exposure's range that fixed specs are made for, and literal coefficients.
LOW, HIGH = 2.0, 8.0
GRID = np.linspace(LOW, HIGH, 121)


def r(e: str, name: str, digits: int = 6) -> str:
    """A rounded column; adding 0 turns -0 into 0."""
    return f"round({e}, {digits}) + 0.0 AS {name}"


def rounded(df: DataFrame, keep: list[str], values: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keep, *[(F.round(F.col(f"`{v}`"), digits) + F.lit(0.0)).alias(v) for v in values])


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        Q[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


# lags and histories -------------------------------------------------------------------------------

@query("lag_columns", f"WITH {DAILY} SELECT day, {r('x', 'x_lag0')}, {', '.join(r(f'lag(x, {k}) OVER (ORDER BY day)', f'x_lag{k}') for k in (1, 2, 3))} FROM daily")
def _lag_columns(spark, d):
    return rounded(with_lags(series.daily(spark, d), "x", "day", 3), ["day"], [f"x_lag{k}" for k in range(4)])


@query("lead_columns", f"WITH {DAILY} SELECT day, {r('lead(x, 2) OVER (ORDER BY day)', 'x_lead2')}, {r('lead(x, 1) OVER (ORDER BY day)', 'x_lead1')}, {r('x', 'x_lag0')}, {r('lag(x, 1) OVER (ORDER BY day)', 'x_lag1')} FROM daily")
def _lead_columns(spark, d):
    return rounded(with_lags(series.daily(spark, d), "x", "day", (-2, 1)), ["day"], ["x_lead2", "x_lead1", "x_lag0", "x_lag1"])


@query("lag_grouped", f"WITH {GROUPED} SELECT g, day, {r('lag(x, 1) OVER (PARTITION BY g ORDER BY day)', 'x_lag1')}, {r('lag(x, 5) OVER (PARTITION BY g ORDER BY day)', 'x_lag5')} FROM daily")
def _lag_grouped(spark, d):
    return rounded(with_lags(series.daily_grouped(spark, d), "x", "day", 5, "g"), ["g", "day"], ["x_lag1", "x_lag5"])


@query("lag_positional_gaps", "WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) / 1000 AS x FROM orders GROUP BY 1) " + f"SELECT day, {r('lag(x, 1) OVER (ORDER BY day)', 'x_lag1', 9)} FROM o")
def _lag_gaps(spark, d):
    return rounded(with_lags(series.orders_daily(spark, d), "x", "day", 1), ["day"], ["x_lag1"], 9)


@query("lag_missing_values", f"WITH {DAILY}, m AS (SELECT day, CASE WHEN date_diff('day', DATE '1992-01-01', day) % 50 = 0 THEN NULL ELSE x END AS x FROM daily) SELECT day, {r(' + '.join(['x'] + [f'lag(x, {k}) OVER (ORDER BY day)' for k in range(1, 6)]), 'cb_v1_l1')} FROM m")
def _lag_missing(spark, d):
    rows = series.daily(spark, d).withColumn("x", F.when(F.datediff("day", F.lit("1992-01-01")) % 50 != 0, F.col("x")))
    cb = cross_basis_of(GRID, 5, {"fun": "lin"})
    return rounded(with_cross_basis(rows, "x", cb, "day"), ["day"], cb.names())


@query("calendar_fill", "WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS y FROM orders GROUP BY 1), c AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM o) SELECT c.day, y FROM c LEFT JOIN o ON c.day = o.day")
def _calendar(spark, d):
    return filled_calendar(series.orders_daily(spark, d).select("day", "y"), "day")


@query("hourly_lags", f"WITH h AS (SELECT event_type AS g, date_trunc('hour', ts) AS h, count(*) AS y, avg(value) AS x FROM events GROUP BY 1, 2) SELECT g, CAST(h AS TIMESTAMP) AS h, {r('lag(x, 2) OVER (PARTITION BY g ORDER BY h)', 'x_lag2')} FROM h")
def _hourly(spark, d):
    rows = with_lags(series.hourly(spark, d, True), "x", "h", 2, "g").withColumn("h", F.col("h").cast("timestamp_ntz"))
    return rounded(rows, ["g", "h"], ["x_lag2"])


@query("exposure_histories", "WITH p AS (SELECT o_custkey AS subject, year(o_orderdate) - 1991 AS t, sum(o_totalprice) / 1000 AS x FROM orders GROUP BY 1, 2), a AS (SELECT DISTINCT subject, 7 AS t FROM p), k AS (SELECT unnest(generate_series(1, 4)) AS k) SELECT a.subject, CAST(a.t AS INTEGER) AS t, " + ", ".join(r(f"coalesce(sum(CASE WHEN k = {i} THEN p.x END), 0)", f"h{i}") for i in range(1, 5)) + " FROM a CROSS JOIN k LEFT JOIN p ON p.subject = a.subject AND p.t = a.t - k GROUP BY 1, 2")
def _histories(spark, d):
    p = series.profiles(spark, d)
    at = p.select("subject").distinct().withColumn("t", F.lit(7))
    rows = exposure_histories(p, "subject", "t", "x", at, (1, 4))
    return rounded(rows.select("subject", "t", *[F.col("history")[i].alias(f"h{i + 1}") for i in range(4)]), ["subject", "t"], [f"h{i}" for i in range(1, 5)])


# bases --------------------------------------------------------------------------------------------

def de_boor(x: str, t: np.ndarray, i: int, k: int) -> str:
    """The B-spline recursion as SQL; the last interval is closed."""
    if k == 1:
        if t[i] >= t[i + 1]:
            return "0.0e0"
        last = t[i + 1] == t[-1]
        return f"(CASE WHEN {x} >= {t[i]!r}e0 AND {x} {'<=' if last else '<'} {t[i + 1]!r}e0 THEN 1.0e0 ELSE 0.0e0 END)"
    parts = []
    if t[i + k - 1] > t[i]:
        parts.append(f"({x} - ({t[i]!r}e0)) / {t[i + k - 1] - t[i]!r}e0 * {de_boor(x, t, i, k - 1)}")
    if t[i + k] > t[i + 1]:
        parts.append(f"({t[i + k]!r}e0 - {x}) / {t[i + k] - t[i + 1]!r}e0 * {de_boor(x, t, i + 1, k - 1)}")
    return f"({' + '.join(parts)})" if parts else "0.0e0"


def floats(t) -> np.ndarray:
    """Plain Python floats, whose repr is a number."""
    return np.array([float(v) for v in t], dtype=object)


def on_daily(columns: list[str], where: str = "") -> str:
    return f"WITH {DAILY} SELECT day, {', '.join(columns)} FROM daily{where}"


def basis_query(name: str, basis: Basis, sql: list[str] | None, where: str = "") -> None:
    cols = basis.names()

    def fn(spark, d):
        rows = series.daily(spark, d)
        rows = rows.where(where.removeprefix(" WHERE ")) if where else rows
        return rounded(with_basis(rows, "x", basis), ["day"], cols, 9)

    query(name, on_daily([r(e, c, 9) for e, c in zip(sql, cols, strict=True)], where) if sql else None)(fn)


_data = Data(GRID)
basis_query("basis_lin", fit_basis(_data, "lin", intercept=True), ["1.0e0 + 0 * x", "x"])
basis_query("basis_poly", fit_basis(_data, "poly", degree=3), [f"power(x / 8.0e0, {k})" for k in (1, 2, 3)])
basis_query("basis_strata", fit_basis(_data, "strata", breaks=[4.513, 5.017, 5.511]), ["CASE WHEN x >= 4.513e0 AND x < 5.017e0 THEN 1.0e0 ELSE 0.0e0 END", "CASE WHEN x >= 5.017e0 AND x < 5.511e0 THEN 1.0e0 ELSE 0.0e0 END", "CASE WHEN x >= 5.511e0 THEN 1.0e0 ELSE 0.0e0 END"])
basis_query("basis_strata_full", fit_basis(_data, "strata", breaks=[5.017], ref=0, intercept=True), ["CASE WHEN x < 5.017e0 THEN 1.0e0 ELSE 0.0e0 END", "CASE WHEN x >= 5.017e0 THEN 1.0e0 ELSE 0.0e0 END"])
basis_query("basis_thr_high", fit_basis(_data, "thr", thr_value=5.1), ["greatest(x - 5.1e0, 0.0e0)"])
basis_query("basis_thr_low", fit_basis(_data, "thr", thr_value=4.9, side="l"), ["-least(x - 4.9e0, 0.0e0)"])
basis_query("basis_thr_double", fit_basis(_data, "thr", thr_value=[4.7, 5.3]), ["-least(x - 4.7e0, 0.0e0)", "greatest(x - 5.3e0, 0.0e0)"])

_bs = fit_basis(_data, "bs", knots=[4.5, 5.0, 5.6], boundary=(LOW, HIGH))
_t = floats(np.sort(np.r_[[LOW] * 4, [HIGH] * 4, [4.5, 5.0, 5.6]]))
_inside = f" WHERE x >= {LOW} AND x <= {HIGH}"
basis_query("basis_bs", _bs, [de_boor("x", _t, i, 4) for i in range(1, 7)], _inside)
_bs2 = fit_basis(_data, "bs", knots=[5.03], degree=2, intercept=True, boundary=(LOW, HIGH))
_t2 = floats(np.sort(np.r_[[LOW] * 3, [HIGH] * 3, [5.03]]))
basis_query("basis_bs_quadratic", _bs2, [de_boor("x", _t2, i, 3) for i in range(4)], _inside)
_ps = fit_basis(_data, "ps", df=6)
_tp = floats(_ps.attrs["knots"])
basis_query("basis_ps", _ps, [de_boor("x", _tp, i, 4) for i in range(1, 7)], _inside)


def ns_sql(x: str, inner: list[float], low: float, high: float) -> list[str]:
    """Natural splines by the recursion, projected onto functions without curvature at the boundary."""
    t = np.sort(np.r_[[low] * 4, [high] * 4, inner])
    n = len(t) - 4

    def curve(at: float) -> np.ndarray:
        """Second derivatives of the cubic B-splines at a boundary."""
        def b(v, i, k):
            if k == 1:
                return float(t[i] <= v < t[i + 1] or (v == t[-1] and t[i] < v == t[i + 1]))
            a = (v - t[i]) / (t[i + k - 1] - t[i]) * b(v, i, k - 1) if t[i + k - 1] > t[i] else 0
            return a + ((t[i + k] - v) / (t[i + k] - t[i + 1]) * b(v, i + 1, k - 1) if t[i + k] > t[i + 1] else 0)

        def slope(i, k, left):
            if left == 0:
                return b(at, i, k)
            a = slope(i, k - 1, left - 1) / (t[i + k - 1] - t[i]) if t[i + k - 1] > t[i] else 0
            return (k - 1) * (a - (slope(i + 1, k - 1, left - 1) / (t[i + k] - t[i + 1]) if t[i + k] > t[i + 1] else 0))

        return np.array([slope(i, 4, 2) for i in range(n)])

    q = np.linalg.qr(np.stack([curve(low), curve(high)])[:, 1:].T, mode="complete")[0][:, 2:]
    ft = floats(t)
    raw = [de_boor(x, ft, i, 4) for i in range(1, n)]
    return [" + ".join(f"{float(q[i, j])!r} * {e}" for i, e in enumerate(raw)) for j in range(q.shape[1])]


_ns = fit_basis(_data, "ns", knots=[4.5, 5.5], boundary=(LOW, HIGH))
basis_query("basis_ns", _ns, ns_sql("x", [4.5, 5.5], LOW, HIGH), _inside)


def cr_sql(x: str, t: list[float]) -> list[str]:
    """Cubic regression splines by values and second derivatives at the knots."""
    n, h = len(t), np.diff(t)
    d = np.zeros((n - 2, n))
    b = np.zeros((n - 2, n - 2))
    for i in range(n - 2):
        d[i, i : i + 3] = 1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]
        b[i, i] = (h[i] + h[i + 1]) / 3
        if i:
            b[i, i - 1] = b[i - 1, i] = h[i] / 6
    m = np.vstack([np.zeros(n), np.linalg.solve(b, d), np.zeros(n)])
    out = []
    for j in range(1, n):
        whens = ""
        for i in range(n - 1):
            a, c, w = f"({t[i + 1]!r} - {x})", f"({x} - {t[i]!r})", float(h[i])
            value = f"(({a} * {a} * {a} / {w!r} - {w!r} * {a}) / 6 * ({float(m[i, j])!r}) + ({c} * {c} * {c} / {w!r} - {w!r} * {c}) / 6 * ({float(m[i + 1, j])!r})"
            value += f" + {a} / {w!r} * {float(i == j)!r} + {c} / {w!r} * {float(i + 1 == j)!r})"
            whens += f" WHEN {x} <= {t[i + 1]!r} THEN {value}"
        out.append(f"CASE{whens} END")
    return out


basis_query("basis_cr", fit_basis(_data, "cr", knots=[LOW, 4.53, 5.47, HIGH]), cr_sql("x", [LOW, 4.53, 5.47, HIGH]), _inside)


@query("basis_integer", f"WITH {DAILY}, m AS (SELECT day, CAST(month(day) % 4 AS DOUBLE) AS z FROM daily) SELECT day, " + ", ".join(r(f"CASE WHEN z = {k} THEN 1.0e0 ELSE 0.0e0 END", f"b_b{k}") for k in (1, 2, 3)) + " FROM m")
def _integer(spark, d):
    rows = series.daily(spark, d).withColumn("z", (F.month("day") % 4).cast("double"))
    b = one_basis(rows, "z", "integer")
    return rounded(with_basis(rows, "z", b), ["day"], b.names())


@query("basis_custom", on_daily([r("ln(x + 1)", "b_b1"), r("x * ln(x + 1)", "b_b2")]))
def _custom(spark, d):
    rows = series.daily(spark, d)
    b = one_basis(rows, "x", lambda x, **kw: (np.column_stack([np.log(x + 1), x * np.log(x + 1)]), kw))
    return rounded(with_basis(rows, "x", b), ["day"], b.names())


# knots and quantiles ------------------------------------------------------------------------------

@query("percentile_knots", f"WITH {DAILY} SELECT p, {r('quantile_cont(x, p)', 'value')} FROM daily CROSS JOIN (SELECT unnest([0.1e0, 0.75e0, 0.9e0]) AS p) GROUP BY p".replace("quantile_cont(x, p)", "CASE p WHEN 0.1e0 THEN quantile_cont(x, 0.1) WHEN 0.75e0 THEN quantile_cont(x, 0.75) ELSE quantile_cont(x, 0.9) END"))
def _percentiles(spark, d):
    v = numeric.percentile_knots(series.daily(spark, d), "x", (10, 75, 90))
    return rounded(spark.createDataFrame([(p, float(k)) for p, k in zip((0.1, 0.75, 0.9), v, strict=True)], "p double, value double"), ["p"], ["value"])


@query("percentile_of", f"WITH {DAILY} SELECT v, {r('100 * avg(CASE WHEN x <= v THEN 1.0e0 ELSE 0.0e0 END)', 'percent')} FROM daily CROSS JOIN (SELECT unnest([4.513e0, 5.017e0, 6.1e0]) AS v) GROUP BY v")
def _percent(spark, d):
    values = [4.513, 5.017, 6.1]
    p = numeric.percentile_of(series.daily(spark, d), "x", values)
    return rounded(spark.createDataFrame([(v, float(q)) for v, q in zip(values, p, strict=True)], "v double, percent double"), ["v"], ["percent"])


@query("equal_knots", f"WITH {DAILY} SELECT CAST(k AS INTEGER) AS i, {r('min(x) + (max(x) - min(x)) / 4 * k', 'knot')} FROM daily CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) GROUP BY k")
def _equal(spark, d):
    row = series.daily(spark, d).agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
    return rounded(spark.createDataFrame([(i + 1, float(k)) for i, k in enumerate(numeric.equal_knots([row.a, row.b], 3))], "i int, knot double"), ["i"], ["knot"])


@query("log_knots", "SELECT CAST(k AS INTEGER) AS i, " + r("exp((1 + ln(21.0e0)) / 4 * k - 1)", "knot") + " FROM (SELECT unnest([1, 2, 3]) AS k)")
def _logk(spark, d):
    return rounded(spark.createDataFrame([(i + 1, float(k)) for i, k in enumerate(numeric.log_knots(21, 3))], "i int, knot double"), ["i"], ["knot"])


@query("exposure_histogram", f"WITH {DAILY}, e AS (SELECT min(x) AS a, (max(x) - min(x)) / 20 AS w FROM daily) SELECT CAST(i AS INTEGER) AS i, n FROM (SELECT least(floor((x - a) / w), 19) AS i, count(*) AS n FROM daily CROSS JOIN e GROUP BY 1)")
def _histogram(spark, d):
    rows = series.daily(spark, d)
    e = rows.agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
    h = histogram(rows, "x", 20)
    return h.select(F.round((F.col("low") - e.a) / ((e.b - e.a) / 20)).cast("int").alias("i"), "n")


# cross-bases --------------------------------------------------------------------------------------

def cross_sql(var: list[str], weights: np.ndarray, low: int, name: str = "cb", source: str = DAILY, keys: str = "day", part: str = "") -> str:
    """Cross-basis columns from expressions of x and a matrix of lag weights."""
    over = f"OVER ({part}ORDER BY day)"
    out = []
    for i in range(len(var)):
        for j in range(weights.shape[1]):
            terms = []
            for k, w in enumerate(weights[:, j]):
                lag = low + k
                terms.append(f"({float(w)!r}) * " + (f"r{i}" if lag == 0 else f"lag(r{i}, {lag}) {over}" if lag > 0 else f"lead(r{i}, {-lag}) {over}"))
            out.append(r(" + ".join(terms), f"{name}_v{i + 1}_l{j + 1}"))
    return f"WITH {source}, b AS (SELECT {keys}, {', '.join(f'{e} AS r{i}' for i, e in enumerate(var))} FROM daily) SELECT {keys}, {', '.join(out)} FROM b"


def cross_query(name: str, cb: CrossBasis, var: list[str], weights: np.ndarray, group: bool = False) -> None:
    def fn(spark, d):
        rows = series.daily_grouped(spark, d) if group else series.daily(spark, d)
        keys = ["g", "day"] if group else ["day"]
        return rounded(with_cross_basis(rows, "x", cb, "day", "g" if group else None), keys, cb.names())

    source, keys, part = (GROUPED, "g, day", "PARTITION BY g ") if group else (DAILY, "day", "")
    query(name, cross_sql(var, weights, cb.lag[0], source=source, keys=keys, part=part))(fn)


_k7, _k5 = np.arange(8.0), np.arange(6.0)
cross_query("crossbasis_moving_sum", cross_basis_of(GRID, 7, {"fun": "lin"}), ["x"], np.ones((8, 1)))
cross_query("crossbasis_poly_strata", cross_basis_of(GRID, 7, {"fun": "poly", "degree": 2}, {"fun": "strata", "breaks": [2, 5]}), ["x / 8", "power(x / 8, 2)"], np.column_stack([np.ones(8), (_k7 >= 2) & (_k7 < 5), _k7 >= 5]).astype(float))
cross_query("crossbasis_thr_poly", cross_basis_of(GRID, 5, {"fun": "thr", "thr_value": 5.1}, {"fun": "poly", "degree": 2}), ["greatest(x - 5.1e0, 0.0e0)"], np.column_stack([np.ones(6), _k5 / 5, (_k5 / 5) ** 2]))
cross_query("crossbasis_strata_integer", cross_basis_of(GRID, (0, 3), {"fun": "strata", "breaks": [5.017]}, {"fun": "integer"}), ["CASE WHEN x >= 5.017e0 THEN 1.0e0 ELSE 0.0e0 END"], np.eye(4))
cross_query("crossbasis_lags_from_two", cross_basis_of(GRID, (2, 6), {"fun": "lin"}, {"fun": "lin"}), ["x"], np.column_stack([np.ones(5), np.arange(2.0, 7.0)]))
cross_query("crossbasis_grouped", cross_basis_of(GRID, 5, {"fun": "poly", "degree": 2}, {"fun": "lin"}), ["x / 8", "power(x / 8, 2)"], np.column_stack([np.ones(6), _k5]), True)


@query("crossbasis_blocked", SQL["crossbasis_grouped"])
def _blocked(spark, d):
    cb = cross_basis_of(GRID, 5, {"fun": "poly", "degree": 2}, {"fun": "lin"})
    rows = with_cross_basis(series.daily_grouped(spark, d), "x", cb, "day", "g", block_rows=500)
    return rounded(rows, ["g", "day"], cb.names())


_clamped = f"least(greatest(x, {LOW}e0), {HIGH}e0)"
_cbn = cross_basis_of(GRID, 7, {"fun": "ns", "knots": [4.5, 5.5], "boundary": (LOW, HIGH)}, {"fun": "poly", "degree": 1})


@query("crossbasis_ns_poly", cross_sql(ns_sql(_clamped, [4.5, 5.5], LOW, HIGH), np.column_stack([np.ones(8), _k7 / 7]), 0))
def _cross_ns(spark, d):
    rows = series.daily(spark, d).withColumn("x", F.least(F.greatest("x", F.lit(LOW)), F.lit(HIGH)))
    return rounded(with_cross_basis(rows, "x", _cbn, "day"), ["day"], _cbn.names())


@query("crossbasis_histories", "WITH p AS (SELECT o_custkey AS subject, year(o_orderdate) - 1991 AS t, sum(o_totalprice) / 1000 AS x FROM orders GROUP BY 1, 2), a AS (SELECT DISTINCT subject FROM p), k AS (SELECT unnest(generate_series(1, 4)) AS k), e AS (SELECT a.subject, k, coalesce(p.x, 0) AS x FROM a CROSS JOIN k LEFT JOIN p ON p.subject = a.subject AND p.t = 7 - k) SELECT subject, " + f"{r('sum(x)', 'cb_v1_l1')}, {r('sum(x * k)', 'cb_v1_l2')} FROM e GROUP BY 1")
def _cross_histories(spark, d):
    p = series.profiles(spark, d)
    at = p.select("subject").distinct().withColumn("t", F.lit(7))
    cb = cross_basis_of(GRID, (1, 4), {"fun": "lin"}, {"fun": "lin"})
    rows = with_history_basis(exposure_histories(p, "subject", "t", "x", at, (1, 4)), "history", cb)
    return rounded(rows, ["subject"], cb.names())


# prediction with literal coefficients -------------------------------------------------------------

_CB = cross_basis_of(GRID, 3, {"fun": "poly", "degree": 2, "scale": 10}, {"fun": "lin"})
ETA = np.array([0.30, -0.05, -0.40, 0.08])
VAR = np.array([0.04, 0.01, 0.09, 0.02])
CEN = 5.0
_grid_sql = "g AS (SELECT x AS var, k AS lag, x / 10 - 0.5 AS a, x * x / 100 - 0.25 AS b FROM (SELECT unnest([2.0e0, 3.0e0, 4.0e0, 5.0e0, 6.0e0, 7.0e0, 8.0e0]) AS x) CROSS JOIN (SELECT unnest([0.0e0, 1.0e0, 2.0e0, 3.0e0]) AS k))"
_AT = np.arange(2.0, 9.0)


def _surface(**args) -> pred.Surface:
    return pred.predict(_CB, coef=ETA, vcov=VAR, link="log", cen=CEN, at=_AT, **args)


_fit = "(0.30 * a - 0.05 * a * lag - 0.40 * b + 0.08 * b * lag)"
_se = "sqrt(0.04 * a * a + 0.01 * a * a * lag * lag + 0.09 * b * b + 0.02 * b * b * lag * lag)"
_z = repr(_surface().z)


def _tail(e: str, s: str) -> str:
    return f"{r(f'exp({e})', 'fit')}, {r(f'exp({e} - {_z} * {s})', 'low')}, {r(f'exp({e} + {_z} * {s})', 'high')}"


@query("predict_surface", f"WITH {_grid_sql} SELECT var, lag, {r(_se, 'se')}, {_tail(_fit, _se)} FROM g")
def _predict_surface(spark, d):
    return rounded(_surface().frame(spark), ["var", "lag"], ["se", "fit", "low", "high"])


_all, _alls = "(1.2 * a - 0.3 * a - 1.6 * b + 0.48 * b)", "sqrt(16 * 0.04 * a * a + 36 * 0.01 * a * a + 16 * 0.09 * b * b + 36 * 0.02 * b * b)"


@query("predict_overall", f"WITH {_grid_sql} SELECT var, {_tail(_all, _alls)} FROM g WHERE lag = 0")
def _predict_overall(spark, d):
    return rounded(_surface().overall(spark), ["var"], ["fit", "low", "high"])


@query("predict_cumulative", f"WITH {_grid_sql}, s AS (SELECT var, lag, {_fit} AS f FROM g) SELECT var, lag, {r('exp(sum(f) OVER (PARTITION BY var ORDER BY lag ROWS UNBOUNDED PRECEDING))', 'fit')} FROM s")
def _predict_cumulative(spark, d):
    return rounded(_surface(cumulative=True).frame(spark, cumulative=True), ["var", "lag"], ["fit"])


@query("predict_slice_var", f"WITH {_grid_sql} SELECT lag, {_tail(_fit, _se)} FROM g WHERE var = 7")
def _slice_var(spark, d):
    return rounded(_surface().slice_var(spark, 7.0), ["lag"], ["fit", "low", "high"])


@query("predict_slice_lag", f"WITH {_grid_sql} SELECT var, {_tail(_fit, _se)} FROM g WHERE lag = 2")
def _slice_lag(spark, d):
    return rounded(_surface().slice_lag(spark, 2.0), ["var"], ["fit", "low", "high"])


@query("reduce_overall", f"WITH {_grid_sql} SELECT var, {_tail(_all, _alls)} FROM g WHERE lag = 0")
def _reduce_overall(spark, d):
    return rounded(pred.reduce(_CB, coef=ETA, vcov=VAR, link="log", cen=CEN, at=_AT).frame(spark), ["var"], ["fit", "low", "high"])


@query("reduce_lag", f"WITH {_grid_sql} SELECT var, {_tail(_fit, _se)} FROM g WHERE lag = 1")
def _reduce_lag(spark, d):
    return rounded(pred.reduce(_CB, coef=ETA, vcov=VAR, link="log", type="lag", value=1, cen=CEN, at=_AT).frame(spark), ["var"], ["fit", "low", "high"])


@query("reduce_var", f"WITH {_grid_sql} SELECT lag, {_tail(_fit, _se)} FROM g WHERE var = 3")
def _reduce_var(spark, d):
    return rounded(pred.reduce(_CB, coef=ETA, vcov=VAR, link="log", type="var", value=3.0, cen=CEN).frame(spark), ["lag"], ["fit", "low", "high"])


@query("predict_reduced", f"WITH {_grid_sql} SELECT var, {_tail('(0.9 * a - 1.1 * b)', 'sqrt(0.5 * a * a + 0.7 * b * b)')} FROM g WHERE lag = 0")
def _predict_reduced(spark, d):
    return rounded(pred.predict_reduced(_CB, [0.9, -1.1], np.diag([0.5, 0.7]), at=_AT, cen=CEN).overall(spark), ["var"], ["fit", "low", "high"])


@query("lowest_risk", f"WITH v AS (SELECT unnest(generate_series(20, 80)) / 10.0e0 AS x) SELECT round(arg_min(x, 0.9 * x / 10 - 1.12 * x * x / 100), 6) + 0.0 AS mmt FROM v")
def _lowest(spark, d):
    return rounded(spark.createDataFrame([(attr.lowest(_CB, coef=ETA, vcov=VAR, start=2.0, stop=8.0),)], "mmt double"), [], ["mmt"])


# attribution with literal coefficients ------------------------------------------------------------

def attribution_sql(direction: str, low: float | None = None, high: float | None = None, group: bool = False, daily: bool = False) -> str:
    """af and an from the definition: a sum over lags of the centred surface."""
    source, keys = (GROUPED, "g, day") if group else (DAILY, "day")
    over = f"OVER ({'PARTITION BY g ' if group else ''}ORDER BY day)"
    x = "x" if low is None else f"CASE WHEN x < {low!r} OR x > {high!r} THEN 5.0e0 ELSE x END"
    inner = f"e AS (SELECT {keys}, y, {x} AS e FROM daily), c AS (SELECT {keys}, y, e / 10 - 0.5 AS a, e * e / 100 - 0.25 AS b FROM e)"
    if direction == "back":
        terms = []
        for k in range(4):
            a, b = ("a", "b") if k == 0 else (f"lag(a, {k}) {over}", f"lag(b, {k}) {over}")
            terms.append(f"({0.30 - 0.05 * k!r}) * {a} + ({-0.40 + 0.08 * k!r}) * {b}")
        eta, cases = " + ".join(terms), "y"
    else:
        eta, cases = "0.9 * a - 1.12 * b", "(y + " + " + ".join(f"lead(y, {k}) {over}" for k in range(1, 4)) + ") / 4.0e0"
    rows = f"w AS (SELECT {keys}, y, 1 - exp(-({eta})) AS af, {cases} AS cases FROM c)"
    if daily:
        return f"WITH {source}, {inner}, {rows} SELECT {keys}, {r('af', 'af')}, {r('af * cases', 'an')} FROM w"
    return f"WITH {source}, {inner}, {rows} SELECT {r('sum(af * cases) / sum(CASE WHEN af * cases IS NOT NULL THEN cases END)', 'af')}, {r('sum(af * cases) / sum(CASE WHEN af * cases IS NOT NULL THEN cases END) * (SELECT sum(y) FROM daily)', 'an', 4)} FROM w"


def attribution_query(name: str, direction: str, limits=None, group: bool = False, daily: bool = False, short: bool = False) -> None:
    def fn(spark, d):
        rows = series.daily_grouped(spark, d) if group else series.daily(spark, d)
        c, v = ([0.9, -1.12], np.eye(2)) if short else (ETA, VAR)
        a = attr.attribute(rows, "x", "y", _CB, "day", CEN, coef=c, vcov=v, link="log", direction=direction, tot=not daily, limits=limits, group="g" if group else None)
        if daily:
            return rounded(a.rows, ["g", "day"] if group else ["day"], ["af", "an"])
        return spark.createDataFrame([(a.af, a.an)], "af double, an double").select((F.round("af", 6) + 0.0).alias("af"), (F.round("an", 4) + 0.0).alias("an"))

    query(name, attribution_sql(direction, *(limits or (None, None)), group, daily))(fn)


attribution_query("attribution_back", "back")
attribution_query("attribution_forward", "forw")
attribution_query("attribution_range", "back", (5.017, 7.5))
attribution_query("attribution_grouped", "back", group=True)
attribution_query("attribution_daily", "back", daily=True)
attribution_query("attribution_forward_daily", "forw", group=True, daily=True)
attribution_query("attribution_reduced", "forw", short=True)


#: Draws of coefficients that SQL can have too: the literal ones times each of these.
FACTORS = (0.5, 0.8, 1.0, 1.1, 1.6)
_F = f"(SELECT unnest([{', '.join(f'{f:e}' for f in FACTORS)}]) AS f)"


def table_sql(draws: bool = False) -> str:
    """The seven components, each from its definition; with draws, intervals over FACTORS."""
    spans = {"total": "(a, b)", "cold": "(a, 5.0)", "heat": "(5.0, b)", "extreme cold": "(a, lo)", "moderate cold": "(lo, 5.0)", "moderate heat": "(5.0, hi)", "extreme heat": "(hi, b)"}
    edges = "e AS (SELECT min(x) AS a, max(x) AS b, least(quantile_cont(x, 0.025), 5.0e0) AS lo, greatest(quantile_cont(x, 0.975), 5.0e0) AS hi FROM daily)"
    out = []
    for name, span in spans.items():
        low, high = span[1:-1].split(", ")
        terms = []
        for k in range(4):
            a, b = ("a", "b") if k == 0 else (f"lag(a, {k}) OVER (ORDER BY day)", f"lag(b, {k}) OVER (ORDER BY day)")
            terms.append(f"({0.30 - 0.05 * k!r}) * {a} + ({-0.40 + 0.08 * k!r}) * {b}")
        eta = f"(SELECT y, {' + '.join(terms)} AS eta FROM (SELECT day, y, m / 10 - 0.5 AS a, m * m / 100 - 0.25 AS b FROM (SELECT day, y, CASE WHEN x < {low} OR x > {high} THEN 5.0e0 ELSE x END AS m FROM daily CROSS JOIN e)))"
        if draws:
            each = f"SELECT f, sum((1 - exp(-f * eta)) * y) / sum(CASE WHEN eta IS NOT NULL THEN y END) AS af, sum(y) AS n FROM {eta}, {_F} GROUP BY f"
            ends = ", ".join(r(f"quantile_cont({v}, {q})", f"{c}_{s}", 3) for c, v in (("an", "af * n"), ("af", "af")) for s, q in (("low", 0.025), ("high", 0.975)))
            out.append(f"SELECT '{name}' AS component, {r(f'(SELECT {low} FROM e)', 'low_x', 3)}, {r(f'(SELECT {high} FROM e)', 'high_x', 3)}, {r('max(CASE WHEN f = 1 THEN af * n END)', 'an', 3)}, {r('max(CASE WHEN f = 1 THEN af END)', 'af', 3)}, {ends} FROM ({each})")
        else:
            out.append(f"SELECT '{name}' AS component, {r('sum((1 - exp(-eta)) * y) / sum(CASE WHEN eta IS NOT NULL THEN y END)', 'af')} FROM {eta}")
    return f"WITH {DAILY}, {edges} " + " UNION ALL ".join(out)


@query("attribution_table", table_sql(draws=True))
def _table(spark, d):
    out = attr.attribution_table(series.daily(spark, d), "x", "y", _CB, "day", CEN, coef=ETA, vcov=VAR, link="log", draws=np.outer(ETA, FACTORS))
    return rounded(out, ["component"], [c for c in out.columns if c != "component"], 3)


@query("attribution_components", table_sql())
def _components(spark, d):
    out = attr.attribution_table(series.daily(spark, d), "x", "y", _CB, "day", CEN, coef=ETA, vcov=VAR, link="log")
    return rounded(out, ["component"], ["af"])


@query("attribution_case_matrix", f"WITH {DAILY}, c AS (SELECT x / 10 - 0.5 AS a, x * x / 100 - 0.25 AS b, (y + q + 2 * y + 1) / 4 AS cases FROM daily) SELECT {r('sum((1 - exp(-(0.9 * a - 1.12 * b))) * cases) / sum(cases)', 'af')} FROM c")
def _matrix(spark, d):
    rows = series.daily(spark, d).withColumn("y2", 2 * F.col("y")).withColumn("one", F.lit(1.0))
    a = attr.attribute(rows, "x", ["y", "q", "y2", "one"], _CB, "day", CEN, coef=ETA, vcov=VAR, link="log", direction="forw")
    return rounded(spark.createDataFrame([(a.af,)], "af double"), [], ["af"])


# fits ---------------------------------------------------------------------------------------------

@query("fit_ols", f"WITH {DAILY} SELECT {r('regr_intercept(y, x)', 'intercept')}, {r('regr_slope(y, x)', 'slope')} FROM daily")
def _ols(spark, d):
    f = fit_glm(series.daily(spark, d), "y", ["x"], "gaussian")
    return rounded(spark.createDataFrame([tuple(map(float, f.coef))], "intercept double, slope double"), [], ["intercept", "slope"])


@query("fit_ols_weighted", f"WITH {DAILY}, s AS (SELECT sum(q) AS w, sum(q * x) AS wx, sum(q * y) AS wy, sum(q * x * x) AS wxx, sum(q * x * y) AS wxy FROM daily) SELECT {r('(w * wxy - wx * wy) / (w * wxx - wx * wx)', 'slope')} FROM s")
def _ols_weighted(spark, d):
    f = fit_glm(series.daily(spark, d), "y", ["x"], "gaussian", var_weights="q")
    return rounded(spark.createDataFrame([(float(f.coef[1]),)], "slope double"), [], ["slope"])


@query("fit_poisson_levels", f"WITH {DAILY}, m AS (SELECT dayofweek(day) AS w, y FROM daily), a AS (SELECT w, ln(avg(y)) AS e FROM m GROUP BY w) SELECT CAST(w AS INTEGER) AS level, {r('e - (SELECT e FROM a WHERE w = 0)', 'estimate')} FROM a WHERE w > 0")
def _levels(spark, d):
    rows = series.daily(spark, d).withColumn("w", (F.dayofweek("day") - 1).cast("int"))
    f = fit_glm(rows, "y", ["C(w)"], "poisson")
    out = [(int(n.split("T.")[1][:-1]), float(c)) for n, c in zip(f.names, f.coef, strict=True) if n != "Intercept"]
    return rounded(spark.createDataFrame(out, "level int, estimate double"), ["level"], ["estimate"])


@query("fit_poisson_exposure", f"WITH {DAILY} SELECT {r('ln(sum(y) / sum(q))', 'rate')} FROM daily")
def _exposure(spark, d):
    f = fit_glm(series.daily(spark, d), "y", [], "poisson", exposure="q")
    return rounded(spark.createDataFrame([(float(f.coef[0]),)], "rate double"), [], ["rate"])


@query("fit_binomial_levels", f"WITH m AS (SELECT l_linestatus AS s, CASE WHEN l_returnflag = 'R' THEN 1.0e0 ELSE 0.0e0 END AS c, CASE WHEN l_discount > 0.051 THEN 1.0e0 ELSE 0.0e0 END AS z FROM lineitem), p AS (SELECT z, avg(c) AS p FROM m GROUP BY z) SELECT {r('(SELECT ln(p / (1 - p)) FROM p WHERE z = 1) - (SELECT ln(p / (1 - p)) FROM p WHERE z = 0)', 'logodds')}")
def _binomial(spark, d):
    rows = series.table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("c"), (F.col("l_discount") > 0.051).cast("double").alias("z"))
    f = fit_glm(rows, "c", ["z"], "binomial")
    return rounded(spark.createDataFrame([(float(f.coef[1]),)], "logodds double"), [], ["logodds"])


@query("aliased_columns", "SELECT 'x2' AS dropped UNION ALL SELECT 'total' AS dropped")
def _aliased(spark, d):
    rows = series.daily(spark, d).select("x", (2 * F.col("x")).alias("x2"), "q", (F.col("x") + F.col("q")).alias("total"))
    gone = aliased(triangular(rows, rows.columns))
    return spark.createDataFrame([(rows.columns[i],) for i in gone], "dropped string")


@query("gram_matrix", f"WITH {DAILY} SELECT {r('sum(x * x)', 'xx', 4)}, {r('sum(x * q)', 'xq', 4)}, {r('sum(q * q)', 'qq', 4)} FROM daily")
def _gram(spark, d):
    g = gram(series.daily(spark, d), ["x", "q"])
    return rounded(spark.createDataFrame([(float(g[0, 0]), float(g[0, 1]), float(g[1, 1]))], "xx double, xq double, qq double"), [], ["xx", "xq", "qq"], 4)


def _model(spark, d):
    return fit_lag_model(series.daily(spark, d), "y", "x", "day", 10, df_per_year=4)


@query("workflow_predict")
def _workflow(spark, d):
    return rounded(_model(spark, d).predict(cen=5.0).overall(spark), ["var"], ["fit", "low", "high"], 5)


@query("workflow_attributable")
def _workflow_attributable(spark, d):
    out = _model(spark, d).attributable(cen=5.0)
    return rounded(out, ["component"], ["af"], 5)


@query("workflow_minimum_risk")
def _workflow_lowest(spark, d):
    return _model(spark, d).minimum_risk(nsim=200).frame(spark)


@query("fit_penalized")
def _penalized(spark, d):
    rows = series.daily(spark, d)
    cb = cross_basis_of(GRID, 3, {"fun": "ps", "df": 6}, {"fun": "lin"})
    f = fit_penalized(with_cross_basis(rows, "x", cb, "day"), "y", cb.names(), {"cb": cross_penalty(cb)}, sp=[10.0])
    return rounded(f.frame(spark), ["term"], ["estimate", "se"], 5)


@query("fit_conditional_logistic")
def _clogit(spark, d):
    f = fit_clogit(series.risk_sets(spark, d), "case", ["x", "q"], "stratum")
    return rounded(f.frame(spark), ["term"], ["estimate", "se"], 6)


@query("two_stage_slopes", f"WITH {GROUPED} SELECT g, {r('regr_slope(y, x)', 'slope')} FROM daily GROUP BY g")
def _slopes(spark, d):
    cb = cross_basis_of(GRID, 0, {"fun": "lin"})
    rows = with_cross_basis(series.daily_grouped(spark, d), "x", cb, "day", "g")
    return rounded(fit_groups(rows, "g", "y", cb, cb.names(), family="gaussian").select("g", F.col("coef")[0].alias("slope")), ["g"], ["slope"])


@query("two_stage_pooled")
def _pooled(spark, d):
    cb = cross_basis_of(GRID, 5, {"fun": "poly", "degree": 2}, {"fun": "lin"})
    rows = with_cross_basis(series.daily_grouped(spark, d), "x", cb, "day", "g")
    mean, v, _ = pooled(*stacked(fit_groups(rows, "g", "y", cb, cb.names(), cen=CEN)))
    return rounded(pred.predict_reduced(cb, mean, v, at=_AT, cen=CEN).overall(spark), ["var"], ["fit", "low", "high"], 4)


@query("qaic_loglik", f"WITH {DAILY} SELECT {r('sum(y * ln(20 + x) - (20 + x) - lgamma(y + 1))', 'loglik', 4)} FROM daily")
def _loglik(spark, d):
    rows = series.daily(spark, d).withColumn("mu", 20 + F.col("x"))
    return rounded(spark.createDataFrame([(poisson_loglik(rows, "y", "mu"),)], "loglik double"), [], ["loglik"], 4)


@query("model_grid")
def _grid(spark, d):
    rows = series.daily(spark, d).cache()
    specs = {"x": {"terms": ["x"]}, "q": {"terms": ["q"]}, "both": {"terms": ["x", "q"]}}
    return rounded(model_grid(spark, specs, lambda terms: fit_glm(rows, "y", terms), lambda f: qaic(f, fitted(rows, f), "y", "mu")), ["model"], ["criterion", "delta"], 3)


@query("simulated_intervals", f"WITH {_grid_sql} SELECT var, {r('exp(0.9 * a - 1.12 * b)', 'fit', 5)}, {r('exp(quantile_cont(f * (0.9 * a - 1.12 * b), 0.025))', 'low', 5)}, {r('exp(quantile_cont(f * (0.9 * a - 1.12 * b), 0.975))', 'high', 5)} FROM g, {_F} WHERE lag = 0 GROUP BY var, a, b")
def _intervals(spark, d):
    return rounded(interval_frame(spark, _CB, ETA, VAR, draws=np.outer(ETA, FACTORS), cen=CEN, at=_AT), ["var"], ["fit", "low", "high"], 5)


@query("simulated_cities")
def _cities(spark, d):
    return simulate_cities(spark, 3, 200)


# recipes around the models ------------------------------------------------------------------------

@query("risk_set_split", """WITH f AS (SELECT o_custkey AS cust, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS t FROM orders),
s AS (SELECT cust, min(t) AS enter, max(t) AS leave FROM f GROUP BY 1 HAVING min(t) < max(t)),
e AS (SELECT enter AS t, count(*) AS n FROM s GROUP BY 1), l AS (SELECT leave AS t, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT d.t, coalesce(e.n, 0) AS e, coalesce(l.n, 0) AS l FROM (SELECT DISTINCT t FROM f) d LEFT JOIN e ON e.t = d.t LEFT JOIN l ON l.t = d.t),
w AS (SELECT t, sum(e) OVER (ORDER BY t) - e - sum(l) OVER (ORDER BY t) + l AS at_risk, l FROM c)
SELECT t AS riskset, CAST(at_risk AS BIGINT) AS at_risk, CAST(l AS BIGINT) AS cases FROM w WHERE at_risk > 0""")
def _risk_sets(spark, d):
    """At each distinct event day."""
    f = series.table(spark, d, "orders").select(F.col("o_custkey").alias("cust"), F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).alias("t"))
    follow = f.groupBy("cust").agg(F.min("t").alias("enter"), F.max("t").alias("leave")).filter("enter < leave")
    sets = recipes.risk_sets(follow, "enter", "leave", f.select("t").distinct(), "t")
    return sets.groupBy(F.col("t").cast("long").alias("riskset")).agg(F.count("*").alias("at_risk"), F.sum(F.col("case").cast("long")).alias("cases"))


@query("climatology", f"WITH {DAILY} SELECT CAST(dayofyear(day) AS INTEGER) AS doy, {r('avg(x)', 'mean', 8)} FROM daily GROUP BY 1")
def _climatology(spark, d):
    return rounded(recipes.climatology(series.daily(spark, d), "day", "x"), ["doy"], ["mean"], 8)


@query("weighted_zone_means", f"SELECT l_returnflag AS zone, {r('sum(l_discount * l_quantity) / sum(l_quantity)', 'mean', 8)} FROM lineitem GROUP BY 1")
def _zones(spark, d):
    return rounded(recipes.weighted_means(series.table(spark, d, "lineitem"), "l_returnflag", "l_discount", "l_quantity").withColumnRenamed("l_returnflag", "zone"), ["zone"], ["mean"], 8)


@query("bias_correction", f"WITH {DAILY}, m AS (SELECT month(day) AS month, day, x, q FROM daily), c AS (SELECT month, avg(x) AS mo, avg(q) AS mm FROM m GROUP BY 1), a AS (SELECT m.month, x - mo AS o, row_number() OVER (PARTITION BY m.month ORDER BY x - mo, day) AS i FROM m JOIN c ON m.month = c.month), b AS (SELECT m.month, q - mm AS s, row_number() OVER (PARTITION BY m.month ORDER BY q - mm, day) AS i FROM m JOIN c ON m.month = c.month), k AS (SELECT a.month, sum(o * s) / sum(s * s) AS slope FROM a JOIN b ON a.month = b.month AND a.i = b.i GROUP BY 1) SELECT day, {r('mo + slope * (q - mm)', 'corrected')} FROM m JOIN c ON m.month = c.month JOIN k ON m.month = k.month")
def _bias(spark, d):
    return rounded(recipes.bias_corrected(series.daily(spark, d), "day", "x", "q"), ["day"], ["corrected"])


def flagship_sql() -> str:
    """The curve exp(8 b (var - CEN)) with its 95% band, b from an iteration over the moving sums."""
    sums = " + ".join(["x"] + [f"lag(x, {k}) OVER (ORDER BY day)" for k in range(1, 8)])
    at = f"SELECT unnest(generate_series(0, {round(2 * (HIGH - LOW))})) * 0.5 + {LOW} AS var"
    half = f"1.959963984540054 * sqrt(scale * v) * 8 * abs(var - {CEN})"
    return f"WITH {DAILY}, m AS (SELECT y, {sums} AS x FROM daily), r AS (SELECT CAST(y AS DOUBLE) AS y, x FROM m WHERE x IS NOT NULL),\n{irls('r', 'poisson')},\ng AS ({at}) SELECT CAST(var AS DOUBLE) AS var, {r(f'exp(b * 8 * (var - {CEN}))', 'fit', 5)}, {r(f'exp(b * 8 * (var - {CEN}) - {half})', 'low', 5)}, {r(f'exp(b * 8 * (var - {CEN}) + {half})', 'high', 5)} FROM g, b11, v"


@query("flagship", flagship_sql())
def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Quasi-Poisson fit of the daily counts on the moving sum of the exposure over lags 0 to 7; its overall curve."""
    cb = cross_basis_of(GRID, 7, {"fun": "lin"})
    rows = with_cross_basis(series.daily(spark, folder), "x", cb, "day")
    f = fit_glm(rows, "y", cb.names(), "quasipoisson")
    return rounded(pred.predict(cb, f, cen=CEN, at=np.arange(LOW, HIGH + 0.5, 0.5)).overall(spark), ["var"], ["fit", "low", "high"], 5)


@query("fit_binomial_slope", f"WITH r AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0e0 ELSE 0.0e0 END AS y, CAST(l_quantity AS DOUBLE) / 50 AS x FROM lineitem),\n{irls('r', 'binomial')}\nSELECT {r('a', 'intercept')}, {r('b', 'slope')}, {r('sqrt(v)', 'se')} FROM b11, v")
def _binomial_slope(spark, d):
    rows = series.table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("y"), (F.col("l_quantity").cast("double") / 50).alias("x"))
    f = fit_glm(rows, "y", ["x"], "binomial")
    return rounded(spark.createDataFrame([(*map(float, f.coef), float(f.se[1]))], "intercept double, slope double, se double"), [], ["intercept", "slope", "se"])


_SETS = "WITH l AS (SELECT l_orderkey AS s, CASE WHEN l_returnflag = 'R' THEN 1.0e0 ELSE 0.0e0 END AS y, 100 * CAST(l_discount AS DOUBLE) AS x, CAST(l_quantity AS DOUBLE) / 10 AS q FROM lineitem), k AS (SELECT s FROM l GROUP BY s HAVING sum(y) = 1 AND count(*) > 1), r AS (SELECT l.* FROM l JOIN k ON l.s = k.s)"


@query("fit_conditional_logistic_matched", f"{_SETS},\n{matched('r')}\nSELECT 'x' AS term, {r('a', 'estimate')}, {r('sqrt(ib / (ia * ib - ic * ic))', 'se')} FROM b10, i UNION ALL SELECT 'q' AS term, {r('b', 'estimate')}, {r('sqrt(ia / (ia * ib - ic * ic))', 'se')} FROM b10, i")
def _matched_sets(spark, d):
    """Strata with one case each."""
    rows = series.risk_sets(spark, d)
    one = rows.groupBy("stratum").agg(F.sum("case").alias("cases")).filter("cases = 1").select("stratum")
    f = fit_clogit(rows.join(one, "stratum").withColumn("q", F.col("q").cast("double") / 10), "case", ["x", "q"], "stratum")
    return rounded(f.frame(spark), ["term"], ["estimate", "se"])


@query("fit_penalized_ridge", f"""WITH {DAILY}, r AS (SELECT CAST(y AS DOUBLE) AS y, x - 5 AS u, (x - 5) * (x - 5) AS w FROM daily),
s AS (SELECT count(*) AS n, sum(u) AS u, sum(w) AS w, sum(u * u) + 25 AS uu, sum(u * w) AS uw, sum(w * w) + 25 AS ww, sum(y) AS y, sum(u * y) AS uy, sum(w * y) AS wy FROM r),
d AS (SELECT *, n * (uu * ww - uw * uw) - u * (u * ww - uw * w) + w * (u * uw - uu * w) AS det FROM s)
SELECT 'Intercept' AS term, {r('(y * (uu * ww - uw * uw) - u * (uy * ww - uw * wy) + w * (uy * uw - uu * wy)) / det', 'estimate')} FROM d
UNION ALL SELECT 'z_b1', {r('(n * (uy * ww - uw * wy) - y * (u * ww - uw * w) + w * (u * wy - uy * w)) / det', 'estimate')} FROM d
UNION ALL SELECT 'z_b2', {r('(n * (uu * wy - uy * uw) - u * (u * wy - uy * w) + y * (u * uw - uu * w)) / det', 'estimate')} FROM d""")
def _ridge(spark, d):
    """A gaussian fit whose two slopes have one penalty, the identity, with parameter 25."""
    rows = series.daily(spark, d).withColumns({"z_b1": F.col("x") - 5, "z_b2": (F.col("x") - 5) * (F.col("x") - 5)})
    f = fit_penalized(rows, "y", ["z_b1", "z_b2"], {"z": {"parts": {"S": np.eye(2)}, "rank": {"S": 2}, "sp": {"S": 25.0}}}, "gaussian")
    return rounded(f.frame(spark).select("term", "estimate"), ["term"], ["estimate"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

