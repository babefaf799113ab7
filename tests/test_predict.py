import numpy as np
import pytest

from tidelag.operators import attribution as attr
from tidelag.operators import predict as pred
from tidelag.operators.crossbasis import cross_basis_of
from tidelag.operators.uncertainty import bootstrap, interval_frame, simulated
from tidelag.plans.workflow import fit_lag_model

rng = np.random.default_rng(9)
X = rng.uniform(0, 30, 90)
CASES = rng.poisson(20, 90).astype(float)
CB = cross_basis_of(X, 4, {"fun": "ns", "df": 3}, {"fun": "poly", "degree": 2})
ETA = rng.normal(scale=0.05, size=CB.columns)
_R = rng.normal(size=(CB.columns, CB.columns))
V = _R @ _R.T * 1e-4


def surface(**args):
    return pred.predict(CB, coef=ETA, vcov=V, link="log", cen=12.0, **args)


def test_surface_is_the_tensor_product():
    s = surface(at=[5, 12, 20], cumulative=True)
    r = CB.var(s.var) - CB.var([12.0])
    c = CB.lag_basis(np.arange(5.0))
    want = np.einsum("iv,kl,vl->ik", r, c, ETA.reshape(CB.df))
    np.testing.assert_allclose(s.fit, want, atol=1e-12)
    np.testing.assert_allclose(s.all_fit, want.sum(1), atol=1e-12)
    np.testing.assert_allclose(s.cum_fit, np.cumsum(want, 1), atol=1e-12)
    np.testing.assert_allclose(s.fit[1], 0, atol=1e-12)
    assert surface(at=[5], bylag=0.5).fit.shape == (1, 9)


def test_reduced_equals_full():
    s = surface(at=[3, 9, 27])
    o = pred.reduce(CB, coef=ETA, vcov=V, link="log", cen=12.0, at=[3, 9, 27])
    np.testing.assert_allclose(o.fit, s.all_fit, atol=1e-12)
    np.testing.assert_allclose(o.se, s.all_se, atol=1e-12)
    k = pred.reduce(CB, coef=ETA, vcov=V, type="lag", value=2, cen=12.0, at=[3, 9, 27])
    np.testing.assert_allclose(k.fit, s.fit[:, 2], atol=1e-12)
    v = pred.reduce(CB, coef=ETA, vcov=V, type="var", value=9.0, cen=12.0)
    np.testing.assert_allclose(v.fit, s.fit[1], atol=1e-12)
    again = pred.predict_reduced(CB, o.coef, o.vcov, at=[3, 9, 27], cen=12.0)
    np.testing.assert_allclose(again.all_se, s.all_se, atol=1e-12)


def test_grids_centres_and_errors():
    np.testing.assert_allclose(pred.grid((-26.6, 33.3)), np.arange(-26, 34))
    np.testing.assert_allclose(pred.grid((-26.6, 33.3), by=2.5)[:3], [-26, -23.5, -21])
    assert pred.grid((-26.6, 33.3), start=-10, stop=30).tolist() == list(range(-10, 31))
    assert pred.grid((-26.6, 33.3), start=-10, stop=30, by=3).tolist() == list(range(-10, 30, 3))
    assert pred.grid((0, 1), at=[3, 1, 3]).tolist() == [1, 3]
    with pytest.warns(pred.CenteringWarning):
        assert pred.centre(None, CB, (-26.6, 33.3)) == 5
    assert pred.centre(False, CB, (0, 1)) is None
    assert pred.centre(None, cross_basis_of(X, 2, {"fun": "lin"}), (0, 30)) is None
    for bad in ({"type": "lag", "value": 9}, {"type": "var", "value": [1, 2]}, {"type": "var"}):
        with pytest.raises(ValueError):
            pred.reduce(CB, coef=ETA, vcov=V, cen=12.0, **bad)
    with pytest.raises(ValueError, match="match"):
        pred.predict(CB, coef=ETA[:3], vcov=np.eye(3), cen=1.0)


def test_frames(spark):
    s = surface(at=[5, 20])
    assert s.frame(spark).count() == 10
    row = s.slice_var(spark, 20).where("lag = 3").first()
    assert row.fit == pytest.approx(np.exp(s.fit[1, 3]))
    assert row.se == pytest.approx(s.se[1, 3])
    with pytest.raises(ValueError, match="grid"):
        s.slice_lag(spark, 1.5)
    histories = surface(at=np.tile([[20.0]], (1, 5)))
    assert histories.all_fit[0] == pytest.approx(s.all_fit[1])


def data(spark):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(X, CASES, strict=True))], "t int, x double, y double")


def brute(direction, limits=None):
    x = X.copy() if limits is None else np.where((X < limits[0]) | (X > limits[1]), 12.0, X)
    r = CB.var(x) - CB.var([12.0])
    c, eta = CB.weights, ETA.reshape(CB.df)
    an = num = 0.0
    for t in range(len(x)):
        if direction == "back" and t >= 4:
            e, n = sum(r[t - k] @ eta @ c[k] for k in range(5)), CASES[t]
        elif direction == "forw" and t + 4 < len(x):
            e, n = sum(r[t] @ eta @ c[k] for k in range(5)), CASES[t : t + 5].mean()
        else:
            continue
        an, num = an + (1 - np.exp(-e)) * n, num + n
    return an / num, an / num * CASES.sum()


@pytest.mark.parametrize("direction", ["back", "forw"])
@pytest.mark.parametrize("limits", [None, (12.0, 25.0)])
def test_attribution_against_the_definition(spark, direction, limits):
    a = attr.attribute(data(spark), "x", "y", CB, "t", 12.0, coef=ETA, vcov=V, link="log", direction=direction, limits=limits)
    np.testing.assert_allclose([a.af, a.an], brute(direction, limits), rtol=1e-9)


def test_draws(spark):
    b = attr.draws_of(ETA, V, 4000, 1)
    np.testing.assert_allclose(b.mean(1), ETA, atol=4e-3)
    z = rng.standard_normal((5, len(ETA)))
    np.testing.assert_allclose(attr.draws_of(ETA, V, normals=z), attr.draws_of(ETA, V, normals=z))
    same = np.repeat(ETA[:, None], 3, 1)
    for direction in ("back", "forw"):
        a = attr.attribute(data(spark), "x", "y", CB, "t", 12.0, coef=ETA, vcov=V, direction=direction, draws=same)
        np.testing.assert_allclose(a.ansim, a.an, rtol=1e-9)
    overall, each, s = simulated(CB, ETA, V, draws=same, cen=12.0, at=[3, 20])
    np.testing.assert_allclose(overall[0], s.all_fit, atol=1e-12)
    np.testing.assert_allclose(each[0], s.fit, atol=1e-12)
    assert bootstrap(lambda c: c.sum(), ETA, V, draws=same).tolist() == pytest.approx([ETA.sum()] * 3)
    assert interval_frame(spark, CB, ETA, V, nsim=50, seed=1, cen=12.0, at=[3, 20]).count() == 2
    t = attr.attribution_table(data(spark), "x", "y", CB, "t", 12.0, coef=ETA, vcov=V, draws=b[:, :50])
    assert [r.component for r in t.collect()] == list(attr.COMPONENTS)


def test_lowest():
    x = pred.grid(CB.range, start=0, stop=30, by=0.1)
    curve = np.kron(CB.var(x), CB.weights.sum(0)[None, :]) @ ETA
    assert attr.lowest(CB, coef=ETA, vcov=V, start=0, stop=30) == pytest.approx(x[curve.argmin()])


def test_workflow_is_the_explicit_path(spark):
    n = 500
    t = np.arange(n)
    x = 15 + 8 * np.sin(2 * np.pi * t / 365.25) + rng.normal(size=n)
    y = rng.poisson(np.exp(3 + 0.002 * (x - 15) ** 2))
    df = spark.createDataFrame([(int(a), float(b), int(c), int(a % 7)) for a, b, c in zip(t, x, y, strict=True)], "t int, x double, y int, dow int")
    m = fit_lag_model(df, "y", "x", "t", 7, df_per_year=3, dow="dow")
    direct = pred.predict(m.basis, m.fit, cen=15.0, at=[5, 25])
    np.testing.assert_allclose(m.predict(cen=15.0, at=[5, 25]).all_fit, direct.all_fit)
    assert {"value", "rr", "low", "high"} == set(m.rr_at([25.0], 15.0).columns)
    assert np.isfinite(m.qaic())
    assert "lowest risk" in m.summary()
    assert m.attributable(15.0).count() == 7


@pytest.mark.parametrize("direction", ["back", "forw"])
def test_components_in_one_pass_equal_separate_ones(spark, direction):
    rows = attr.attribution_table(data(spark), "x", "y", CB, "t", 12.0, coef=ETA, vcov=V, link="log", direction=direction).collect()
    for r in rows:
        a = attr.attribute(data(spark), "x", "y", CB, "t", 12.0, coef=ETA, vcov=V, link="log", direction=direction, limits=(r.low_x, r.high_x))
        np.testing.assert_allclose([r.af, r.an], [a.af, a.an], rtol=1e-9, atol=1e-12)


def test_draws_along_given_eigenvectors():
    from tidelag.operators.attribution import draws_of

    v = np.array([[2, 0.3], [0.3, 1]])
    normals = np.random.default_rng(3).standard_normal((200_000, 2))
    vectors = np.linalg.eigh(v)[1]  # rising eigenvalues
    for u in (vectors, vectors[:, ::-1], -vectors):
        np.testing.assert_allclose(np.cov(draws_of([0, 0], v, normals=normals, eigvecs=u)), v, atol=0.02)
    np.testing.assert_allclose(np.cov(draws_of([0, 0], v, normals=normals)), v, atol=0.02)
    with pytest.raises(ValueError, match="eigenvectors"):
        draws_of([0, 0], v, normals=normals, eigvecs=np.eye(3))
    with pytest.raises(ValueError, match="normals"):
        draws_of([0, 0], v, normals=normals[:, :1])


@pytest.mark.parametrize("direction", ["back", "forw"])
def test_table_with_draws_equals_separate_components(spark, direction):
    b = attr.draws_of(ETA, V, nsim=40, seed=5)
    rows = attr.attribution_table(data(spark), "x", "y", CB, "t", 12.0, coef=ETA, vcov=V, direction=direction, draws=b).collect()
    blocks = attr.attribution_table(data(spark), "x", "y", CB, "t", 12.0, coef=ETA, vcov=V, direction=direction, draws=b, block_rows=40).collect()
    for r, other in zip(rows, blocks, strict=True):
        np.testing.assert_allclose([r.an, r.af, r.an_low, r.af_high], [other.an, other.af, other.an_low, other.af_high], rtol=1e-9, atol=1e-12)
        a = attr.attribute(data(spark), "x", "y", CB, "t", 12.0, coef=ETA, vcov=V, direction=direction, limits=(r.low_x, r.high_x), draws=b)
        np.testing.assert_allclose([r.af, r.an], [a.af, a.an], rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose([r.an_low, r.an_high], np.quantile(a.ansim, [0.025, 0.975]), rtol=1e-9, atol=1e-12)


def test_attribution_of_histories_equals_that_of_the_series(spark):
    from tidelag.operators.lags import with_lags

    df = with_lags(data(spark), "x", "t", CB.lag, name="h", packed=True)
    one = attr.attribute(data(spark), "x", "y", CB, "t", 12.0, coef=ETA, vcov=V, limits=(5, 20))
    two = attr.attribute(df, "h_lags", "y", CB, "t", 12.0, coef=ETA, vcov=V, limits=(5, 20))
    three = attr.attribute(data(spark), "x", "y", CB, "t", 12.0, coef=ETA, vcov=V, limits=(5, 20), block_rows=30)
    np.testing.assert_allclose([two.af, two.an], [one.af, one.an], rtol=1e-12)
    np.testing.assert_allclose([three.af, three.an], [one.af, one.an], rtol=1e-12)
    with pytest.raises(ValueError, match="histories"):
        attr.attribute(df, "h_lags", "y", CB, "t", 12.0, coef=ETA, vcov=V, direction="forw")


def test_each_group_has_a_season_of_its_own_days(spark):
    from tidelag.plans.workflow import season, with_clock

    rows = [("a", float(t), 0.0) for t in range(400)] + [("b", float(t), 0.0) for t in range(200, 1500)]
    df = spark.createDataFrame(rows, "g string, t double, y double")
    out, names, bases = season(with_clock(df, "t"), "__clock", 4, "g")
    assert [b.columns for b in bases] == [round(4 * 400 / 365.25), round(4 * 1300 / 365.25)]
    assert bases[0].attrs["boundary"] == (0, 399) and bases[1].attrs["boundary"] == (200, 1499)
    got = out.where("t = 300").orderBy("g").collect()
    for r, b, other in ((got[0], bases[0], "season_g2"), (got[1], bases[1], "season_g1")):
        own = [r[n] for n in names if not n.startswith(other)]
        np.testing.assert_allclose(own, b(np.array([300.0]))[0], atol=1e-10)
        assert all(r[n] == 0 for n in names if n.startswith(other))


def test_wide_cross_bases_in_batches(spark, monkeypatch):
    from tidelag.operators import crossbasis

    one = crossbasis.with_cross_basis(data(spark), "x", CB, "t").orderBy("t").collect()
    monkeypatch.setattr(crossbasis, "WIDE", 0)
    two = crossbasis.with_cross_basis(data(spark), "x", CB, "t").orderBy("t").collect()
    cells = lambda rows: np.array([[r[n] for n in CB.names("cb")] for r in rows], float)
    np.testing.assert_allclose(cells(one), cells(two), rtol=1e-9, atol=1e-12)
    assert [[r[n] is None for n in CB.names("cb")] for r in one] == [[r[n] is None for n in CB.names("cb")] for r in two]
