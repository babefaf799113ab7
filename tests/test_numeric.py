import numpy as np
import pytest

from tidelag.functions import numeric as n


@pytest.mark.parametrize(("args", "want"), [
    (([-26.6, 33.3],), np.arange(-30, 50, 10)), (([0, 1],), np.arange(0, 1.1, 0.2)), (([0, 356.2],), np.arange(0, 500, 100)), (([1.3, 1.7],), [1.3, 1.4, 1.5, 1.6, 1.7]),
    (([-3, 3],), np.arange(-3, 4)), (([0, 0],), [-1, 0]), (([5, 5],), [0, 5]), (([100, 1000000],), np.arange(0, 1200000, 200000)), (([-26.6, 33.3], 50), np.arange(-27, 35)), (([0, 20], 9), np.arange(0, 22, 2)),
])
def test_pretty(args, want):
    np.testing.assert_allclose(n.pretty(*args), want, atol=1e-12)


def test_knots():
    np.testing.assert_allclose(n.log_knots(30, 3), [1.1055017954442, 3.32210524143099, 9.98314365532871])
    np.testing.assert_allclose(n.log_knots(30, df=4), [1.59530636137125, 6.91803374096553])
    np.testing.assert_allclose(n.equal_knots([-20, 30], fun="ns", df=4), [-7.5, 5, 17.5])
    np.testing.assert_allclose(n.equal_knots([-26.6, 33.4], 3), [-11.6, 3.4, 18.4])


def test_quantile_ignores_missing_and_is_linear():
    x = [3, np.nan, 1, 2, 10]
    np.testing.assert_allclose(n.quantile(x, [0, 0.25, 0.5, 1]), [1, 1.75, 2.5, 10])
    assert np.isnan(n.quantile([], 0.5)[0])
    assert n.median([1, 2, 3, 4]) == 2.5


def test_lag_range():
    assert n.lag_range(5) == (0, 5)
    assert n.lag_range(-2) == (-2, 0)
    assert n.lag_range((2.2, 7)) == (2, 7)
    for bad in ((3, 1), (1, 2, 3)):
        with pytest.raises(ValueError, match="lag"):
            n.lag_range(bad)
    np.testing.assert_allclose(n.lag_seq(2, 0.5), [0, 0.5, 1, 1.5, 2])


def test_columns_agree_with_arrays(spark):
    x = np.random.default_rng(1).normal(size=301)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    np.testing.assert_allclose(n.percentile_knots(df, "x", (10, 75)), n.quantile(x, [0.1, 0.75]))
    np.testing.assert_allclose(n.percentile_of(df, "x", [0.0]), [100 * (x <= 0).mean()])
