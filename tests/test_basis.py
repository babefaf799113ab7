import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelag.functions.basis import Data, fit_basis, one_basis, with_basis
from tidelag.functions.pieces import b_splines

X = np.random.default_rng(3).uniform(-3, 9, 400)
SPECS = [
    ("lin", {}), ("lin", {"intercept": True}), ("poly", {"degree": 3}), ("poly", {"degree": 2, "scale": 4, "intercept": True}), ("strata", {"df": 3}), ("strata", {"breaks": [0, 2], "ref": 2}), ("strata", {"breaks": [0, 2], "ref": 0, "intercept": True}),
    ("thr", {"thr_value": 2}), ("thr", {"thr_value": 2, "side": "l", "intercept": True}), ("thr", {"thr_value": [1, 4]}), ("ns", {"df": 4}), ("ns", {"knots": [1, 4], "intercept": True}), ("ns", {}), ("bs", {"df": 6}), ("bs", {"df": 5, "degree": 2, "intercept": True}),
    ("ps", {"df": 8}), ("ps", {"df": 8, "intercept": True, "diff": 1}), ("cr", {"df": 6}), ("cr", {"knots": [-2, 1, 5, 8], "intercept": True}),
]


@pytest.mark.parametrize(("fun", "args"), SPECS)
def test_sql_agrees_with_numpy_everywhere(spark, fun, args):
    b = fit_basis(Data(X), fun, **args)
    knots = b.attrs.get("knots", [])
    at = np.unique(np.r_[-30, -3.5, X[:40], np.asarray(knots, float).ravel(), X.min(), X.max(), 9.5, 40])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(at)] + [(len(at), None), (len(at) + 1, float("nan"))], "i int, x double").coalesce(1)
    got = [r[2:] for r in with_basis(df, "x", b).orderBy("i").collect()]
    np.testing.assert_allclose(np.array(got[:-2], float), b(at), atol=1e-9, rtol=1e-9)
    assert all(v is None for r in got[-2:] for v in r)
    assert np.isnan(b(np.array([np.nan]))).all()


def recursion(t, i, k, x):
    if k == 1:
        return np.where((x >= t[i]) & ((x < t[i + 1]) | ((x == t[-1]) & (t[i] < t[i + 1]) & (t[i + 1] == t[-1]))), 1.0, 0.0)
    a = (x - t[i]) / (t[i + k - 1] - t[i]) * recursion(t, i, k - 1, x) if t[i + k - 1] > t[i] else 0
    return a + ((t[i + k] - x) / (t[i + k] - t[i + 1]) * recursion(t, i + 1, k - 1, x) if t[i + k] > t[i + 1] else 0)


@pytest.mark.parametrize("order", [2, 3, 4, 5])
def test_b_splines_follow_the_recursion(order):
    t = np.r_[[0] * order, 1, 2, 2, 5, [7] * order].astype(float)
    x = np.linspace(0, 6.999, 57)
    want = np.column_stack([recursion(t, i, order, x) for i in range(len(t) - order)])
    np.testing.assert_allclose(b_splines(t, order)(x), want, atol=1e-12)


def test_ns_is_linear_outside_and_smooth_at_the_boundary():
    b = fit_basis(Data(X), "ns", df=5)
    low, high = b.attrs["boundary"]
    for edge, step in ((low, -1), (high, 1)):
        p = b(edge + step * np.array([0.0, 1.0, 2.0, 3.0]))
        np.testing.assert_allclose(np.diff(p, 2, axis=0), 0, atol=1e-9)
        e = 1e-5
        np.testing.assert_allclose((b([edge + e]) - b([edge])), (b([edge]) - b([edge - e])), atol=1e-9)


def test_bs_sums_to_one_and_goes_on_as_polynomial():
    b = fit_basis(Data(X), "bs", df=7, intercept=True)
    np.testing.assert_allclose(b(np.linspace(-10, 20, 50)).sum(1), 1, atol=1e-8)
    np.testing.assert_allclose(np.diff(b(np.linspace(9, 20, 9)), 4, axis=0), 0, atol=1e-6)


def test_ps_is_zero_outside_and_penalises_curvature_only():
    b = fit_basis(Data(X), "ps", df=9, intercept=True)
    assert (b([b.attrs["knots"][0] - 1, b.attrs["knots"][-1] + 1]) == 0).all()
    s = b.attrs["S"]
    np.testing.assert_allclose(s @ np.column_stack([np.ones(9 + 0), np.arange(9)]), 0, atol=1e-12)


def test_cr_interpolates_and_is_linear_outside():
    t = np.array([-2.0, 1, 5, 8])
    b = fit_basis(Data(X), "cr", knots=t, intercept=True)
    np.testing.assert_allclose(b(t), np.eye(4), atol=1e-12)
    np.testing.assert_allclose(np.diff(b([8.0, 9, 10, 11]), 2, axis=0), 0, atol=1e-10)
    np.testing.assert_allclose(b.attrs["S"] @ np.column_stack([np.ones(4), t]), 0, atol=1e-10)


def test_integer_levels(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "x double")
    b = one_basis(df, "x", "integer")
    assert b.columns == 2
    assert np.isnan(b([3.0])).all()
    got = {r.x: (r.b_b1, r.b_b2) for r in with_basis(df, "x", b).collect()}
    assert got == {1.0: (0, 0), 2.0: (1, 0), 4.0: (0, 1), None: (None, None)}


def test_column_fit_equals_array_fit(spark):
    df = spark.createDataFrame([(float(v),) for v in X], "x double")
    for fun, args in SPECS:
        np.testing.assert_allclose(one_basis(df, "x", fun, **args)(X[:50]), fit_basis(Data(X), fun, **args)(X[:50]), atol=1e-9)


def test_errors_and_spellings():
    d = Data(X)
    for fun, args in (("strata", {"breaks": [1, 1]}), ("poly", {"degree": 0}), ("ps", {"df": 4}), ("cr", {"knots": [1, 2]}), ("thr", {"thr_value": 1, "side": "x"}), ("nothing", {})):
        with pytest.raises(ValueError):
            fit_basis(d, fun, **args)
    with pytest.raises(TypeError):
        fit_basis(d, "ns", **{"knots": [1], "Boundary.knots": (0, 1), "boundary": (0, 1)})
    assert fit_basis(d, "ns", **{"knots": [1], "Boundary.knots": (-3, 9)}).attrs["boundary"] == (-3, 9)
    assert np.isnan(fit_basis(Data(np.r_[X, np.nan]), "thr")([1.0])).all()


def test_own_function_runs_in_batches(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (None,)], "x double")
    b = one_basis(df, "x", lambda x, **kw: (np.column_stack([x, np.log(x + 1)]), kw))
    rows = with_basis(df, "x", b).orderBy(F.col("x").asc_nulls_last()).collect()
    np.testing.assert_allclose([rows[1].b_b1, rows[1].b_b2], [1, np.log(2)])
    assert rows[2].b_b1 is None


def test_wide_bases_take_the_batch_path(spark):
    b = fit_basis(Data(X), "ns", df=30)
    df = spark.createDataFrame([(float(v),) for v in X[:30]] + [(None,)], "x double").coalesce(1)
    rows = with_basis(df, "x", b).collect()
    np.testing.assert_allclose(np.array([r[1:] for r in rows[:-1]], float), b(X[:30]), atol=1e-9)
    assert rows[-1].b_b1 is None


@pytest.mark.parametrize(("fun", "args"), SPECS)
def test_specs_survive_json(fun, args):
    from tidelag.functions.basis import dumps, loads

    b = fit_basis(Data(X), fun, cen=2.0, **args)
    again = loads(dumps(b))
    at = np.r_[X[:20], -50, 50]
    np.testing.assert_array_equal(again(at), b(at))
    assert again.cen == 2.0
    assert again.intercept == b.intercept


def test_strata_are_missing_beyond_the_outer_edges():
    b = fit_basis(Data(np.arange(1.0, 7)), "strata", breaks=[2.5, 4.5])
    np.testing.assert_array_equal(b(np.array([1, 3, 5, 6])), [[0, 0], [1, 0], [0, 1], [0, 1]])
    assert np.isnan(b(np.array([100.0, -3, 6.2]))).all()
    with pytest.raises(ValueError, match="differ"):
        fit_basis(Data(np.concatenate([np.zeros(60), np.linspace(1, 50, 40)])), "strata", df=4)
    with pytest.raises(ValueError, match="differ"):
        fit_basis(Data(np.full(50, 3.0)), "strata", df=3)


def test_strata_in_a_frame_are_null_beyond_the_edges(spark):
    b = fit_basis(Data(np.arange(1.0, 7)), "strata", breaks=[2.5, 4.5])
    rows = with_basis(spark.createDataFrame([(2.0,), (5.0,), (100.0,)], "x double"), "x", b).collect()
    assert [tuple(r)[1:] for r in rows[:2]] == [(0.0, 0.0), (0.0, 1.0)]
    assert all(v is None or np.isnan(v) for v in tuple(rows[2])[1:])


def test_knots_that_tie_with_a_boundary():
    with pytest.warns(UserWarning, match="boundary"):
        b = fit_basis(Data(np.concatenate([np.zeros(60), np.linspace(0.5, 50, 20)])), "bs", df=5)
    assert b.columns == 5
    many = Data(np.concatenate([np.zeros(90), np.linspace(0.5, 50, 10)]))
    with pytest.raises(ValueError, match="interior knots"):
        fit_basis(many, "ns", df=5)
    with pytest.warns(UserWarning, match="boundary"):
        assert fit_basis(many, "bs", df=5).columns == 5
