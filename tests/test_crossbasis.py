import os

import duckdb
import numpy as np
import pytest

from tidelag.operators.crossbasis import cross_basis, cross_basis_of, lag_basis, with_cross_basis, with_history_basis
from tidelag.operators.lags import check_groups, exposure_histories, filled_calendar, with_lags
from tidelag.plans import catalog

X = np.random.default_rng(4).uniform(0, 30, 120)


def frame(spark, x=X, groups=None):
    g = groups if groups is not None else ["a"] * len(x)
    return spark.createDataFrame([(k, i, None if v is None else float(v)) for i, (k, v) in enumerate(zip(g, x, strict=True))], "g string, t int, x double")


def brute(x, cb):
    low, high = cb.lag
    c, out = cb.weights, np.full((len(x), cb.columns), np.nan)
    r = cb.var(x)
    for t in range(len(x)):
        at = [t - k for k in range(low, high + 1)]
        if min(at) >= 0 and max(at) < len(x):
            out[t] = np.einsum("kv,kl->vl", r[at], c).ravel()
    return out


@pytest.mark.parametrize(("lag", "var", "arglag"), [(6, {"fun": "ns", "df": 3}, {"fun": "ns", "knots": [1, 3]}), ((2, 8), {"fun": "ns", "df": 3}, {"fun": "poly", "degree": 2}), (4, {"fun": "bs", "df": 4}, {}), ((-2, 1), {"fun": "lin"}, {"fun": "integer"}), (0, {"fun": "thr", "thr_value": 12}, None)])
def test_window_form_is_the_definition(spark, lag, var, arglag):
    df = frame(spark)
    cb = cross_basis(df, "x", lag, var, arglag)
    got = np.array([[np.nan if v is None else v for v in r[3:]] for r in with_cross_basis(df, "x", cb, "t").orderBy("t").collect()], float)
    np.testing.assert_allclose(got, brute(X, cb), atol=1e-8)


def test_groups_are_apart_and_missing_values_spread(spark):
    x = list(X[:40])
    x[10] = None
    groups = ["a", "b"] * 20
    cb = cross_basis_of(X, 3, {"fun": "lin"})
    rows = with_cross_basis(frame(spark, x, groups), "x", cb, "t", "g").orderBy("t").collect()
    for g in "ab":
        own = np.array([np.nan if v is None else v for v, k in zip(x, groups, strict=True) if k == g], float)
        got = np.array([np.nan if r.cb_v1_l1 is None else r.cb_v1_l1 for r in rows if r.g == g], float)
        np.testing.assert_allclose(got, brute(own, cb)[:, 0], atol=1e-9)


def test_histories(spark):
    p = spark.createDataFrame([(1, 1, 5.0), (1, 2, 7.0), (1, 4, 1.0), (2, 3, 2.0)], "s int, t int, v double")
    at = spark.createDataFrame([(1, 4), (1, 9), (2, 3), (3, 1)], "s int, t int")
    got = {(r.s, r.t): r.history for r in exposure_histories(p, "s", "t", "v", at, (0, 3)).collect()}
    assert got == {(1, 4): [1, 0, 7, 5], (1, 9): [0, 0, 0, 0], (2, 3): [2, 0, 0, 0], (3, 1): [0, 0, 0, 0]}
    q = np.random.default_rng(5).uniform(0, 30, (20, 7))
    cb = cross_basis_of(q, (2, 8), {"fun": "ns", "df": 3}, {"fun": "poly", "degree": 2})
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(q)], "i int, q array<double>")
    rows = with_history_basis(df, "q", cb).orderBy("i").collect()
    np.testing.assert_allclose(np.array([r[2:] for r in rows], float), cb.matrix(q), atol=1e-8)


def unstable(df):
    """df, its rows in another order each time it is computed, as those of a shuffle between several executors."""

    def run(frames):
        for f in frames:
            yield f.sample(frac=1, random_state=int.from_bytes(os.urandom(4), "little"))

    return df.mapInPandas(run, df.schema)


def test_histories_of_rows_in_no_fixed_order(spark):
    p = spark.createDataFrame([(s, t, float(10 * s + t)) for s in range(200) for t in (1, 2)], "s int, t int, v double")
    at = spark.range(200).selectExpr("cast(id as int) s", "3 t", "id n")
    odd = spark.createDataFrame([(7, 3, 200), (7, None, 201), (None, 3, 202)], "s int, t int, n long")
    rows = exposure_histories(p, "s", "t", "v", unstable(at.union(odd).coalesce(1)), (1, 3)).collect()
    want = {n: (n, 3, [10 * n + 2, 10 * n + 1, 0]) for n in range(200)}
    want |= {200: (7, 3, [72, 71, 0]), 201: (7, None, [0, 0, 0]), 202: (None, 3, [0, 0, 0])}
    assert len(rows) == len(want)
    assert {r.n: (r.s, r.t, r.history) for r in rows} == want


def test_basis_of_histories_at_rows_in_no_fixed_order(spark):
    p = spark.createDataFrame([(s, t, float(10 * s + t)) for s in range(200) for t in (1, 2)], "s int, t int, v double")
    at = unstable(spark.range(200).selectExpr("cast(id as int) s", "3 t").coalesce(1))
    cb = cross_basis_of(X, (1, 2), {"fun": "lin"}, {"fun": "lin"})
    rows = with_history_basis(exposure_histories(p, "s", "t", "v", at, (1, 2)), "history", cb).collect()
    # sums of the values, and of each times its lag
    assert {r.s: (r.cb_v1_l1, r.cb_v1_l2) for r in rows} == {s: (20 * s + 3, 30 * s + 4) for s in range(200)}


def test_history_query_is_its_sql_on_rows_in_no_fixed_order(spark, tmp_path, monkeypatch):
    con = duckdb.connect()
    (tmp_path / "orders.parquet").mkdir()
    for i in range(3):  # files of copies with shifted keys that meet in customer 1499 k; missing customers, days and prices
        odd = ", ".join(f"CASE WHEN (o_orderkey + {i}) % {m} = 0 THEN NULL ELSE {c} END AS {c}" for c, m in (("o_orderdate", 40), ("o_totalprice", 50)))
        con.execute(f"COPY (SELECT o_orderkey + {15_000 * i} AS o_orderkey, nullif(o_custkey + {1_499 * i}, 77) AS o_custkey, {odd} FROM '/root/testdata/sf0.01/orders.parquet') TO '{tmp_path}/orders.parquet/{i}.parquet'")
    profiles = catalog.series.profiles
    monkeypatch.setattr(catalog.series, "profiles", lambda *a: unstable(profiles(*a)))
    spark.conf.set("spark.sql.exchange.reuse", "false")  # executors read a reused shuffle in another order too, threads of one process don't
    try:
        got = catalog.queries()["exposure_histories"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()["exposure_histories"]).fetchall()
    assert None in {r.subject for r in got}
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_a_constant_history_is_a_vector_prediction():
    cb = cross_basis_of(X, 5, {"fun": "ns", "df": 4}, {"fun": "lin"})
    v = np.array([3.0, 12.0, 25.0])
    want = (cb.var(v)[:, :, None] * cb.weights.sum(0)[None, None, :]).reshape(3, -1)
    np.testing.assert_allclose(cb.matrix(np.repeat(v[:, None], 6, 1)), want, atol=1e-9)


def test_default_lag_basis_is_a_moving_sum_and_others_have_an_intercept():
    np.testing.assert_allclose(lag_basis(4)([0.0, 2, 4]), 1)
    assert lag_basis(4, {"fun": "poly", "degree": 2}).intercept
    assert cross_basis_of(X, 3, {"fun": "lin"}).names("cb") == ["cb_v1_l1"]


def test_bad_groups_raise(spark):
    for rows in ([("a", 1), ("a", 1), ("a", 2)], [("a", 1), (None, 2)], [("a", 1), ("b", 1)]):
        df = spark.createDataFrame(rows, "g string, t int")
        with pytest.raises(ValueError, match="group"):
            check_groups(df, "t", "g", (0, 1))


def test_lags_by_position_and_calendar(spark):
    df = frame(spark, [1.0, 2.0, 3.0])
    assert [(r.x_lead1, r.x_lag0, r.x_lag1) for r in with_lags(df, "x", "t", (-1, 1)).orderBy("t").collect()] == [(2, 1, None), (3, 2, 1), (None, 3, 2)]
    assert [r.x_lags for r in with_lags(df, "x", "t", 1, packed=True).orderBy("t").collect()] == [[1, None], [2, 1], [3, 2]]
    days = spark.sql("SELECT DATE '2020-01-01' AS d, 1 AS v UNION ALL SELECT DATE '2020-01-04', 2")
    assert [r.v for r in filled_calendar(days, "d").orderBy("d").collect()] == [1, None, None, 2]


@pytest.mark.parametrize("lag", [(0, 4), (-2, 3), (2, 5)])
@pytest.mark.parametrize("groups", [None, "g"])
def test_blocks_give_the_same(spark, lag, groups):
    labels = ["a" if i % 3 else "b" for i in range(len(X))] if groups else None
    df = frame(spark, X, labels).repartition(4)
    cb = cross_basis_of(X, lag, {"fun": "poly", "degree": 2}, {"fun": "lin"})
    one = with_cross_basis(df, "x", cb, "t", groups).orderBy("t").collect()
    two = with_cross_basis(df, "x", cb, "t", groups, block_rows=7).orderBy("t").collect()
    assert len(one) == len(two)
    for a, b in zip(one, two, strict=True):
        assert a[:3] == b[:3]
        assert (a[3] is None) == (b[3] is None)
        if a[3] is not None:
            np.testing.assert_allclose(a[3:], b[3:], rtol=1e-12)
    assert with_lags(df, "x", "t", lag, groups, block_rows=9).orderBy("t").collect() == with_lags(df, "x", "t", lag, groups).orderBy("t").collect()
