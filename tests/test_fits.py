import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelag.operators.clogit import fit_clogit, stratum_terms
from tidelag.operators.crossbasis import cross_basis_of, with_cross_basis
from tidelag.operators.glm import Fit, Family, fit_glm, fitted
from tidelag.operators.linalg import aliased, gram, triangular
from tidelag.operators.predict import predict
from tidelag.operators.penalized import cross_penalty, edf_by, fit_penalized
from tidelag.operators.twostage import fit_groups, pooled, stacked
from tidelag.operators.uncertainty import model_grid, poisson_loglik, qaic

rng = np.random.default_rng(8)
N = 400
A = rng.normal(size=(N, 2))
CAT = rng.integers(0, 3, N)
Y = rng.poisson(np.exp(0.5 + 0.3 * A[:, 0] - 0.2 * A[:, 1] + 0.1 * CAT))


@pytest.fixture(scope="module")
def df(spark):
    rows = [(int(y), float(a), float(b), f"c{c}", float(a), int(y > 1)) for y, (a, b), c in zip(Y, A, CAT, strict=True)]
    return spark.createDataFrame([*rows, (None, 0.0, 0.0, "c0", 0.0, 0), (1, float("nan"), 0.0, "c0", 0.0, 0)], "y int, a double, b double, c string, twin double, z int").repartition(5).cache()


def newton(x, y, family):
    f, b = Family(family), np.zeros(x.shape[1])
    if f.link == "log":
        b[0] = np.log(y.mean())
    for _ in range(60):
        mu = f.mean(x @ b)
        w = f.slope(mu)
        b = b + np.linalg.solve((x * w[:, None]).T @ x, x.T @ (y - mu))
    mu = f.mean(x @ b)
    w = f.slope(mu)
    return b, np.linalg.inv((x * w[:, None]).T @ x), ((y - mu) ** 2 / w).sum() / (len(y) - len(b))


DESIGN = np.column_stack([np.ones(N), A, CAT == 1, CAT == 2]).astype(float)


@pytest.mark.parametrize("family", ["gaussian", "normal", "poisson", "quasipoisson"])
def test_glm_against_newton(df, family):
    fit = fit_glm(df, "y", ["a", "b", "C(c)", "twin"], family)
    b, v, scale = newton(DESIGN, Y.astype(float), family)
    assert fit.aliased == ["twin"]
    assert fit.nobs == N
    np.testing.assert_allclose(fit.coef, b[[0, 1, 2, 3, 4]], atol=1e-8)
    known = family == "poisson"
    np.testing.assert_allclose(fit.vcov, v * (1 if known else scale), atol=1e-8)
    assert fit.scale == pytest.approx(1 if known else scale)


def test_binomial_offset_weights(df):
    b, v, _ = newton(DESIGN, (Y > 1).astype(float), "binomial")
    fit = fit_glm(df.where("y IS NOT NULL"), "z", ["a", "b", "C(c)"], "logistic")
    np.testing.assert_allclose(fit.coef, b, atol=1e-7)
    np.testing.assert_allclose(fit.vcov, v, atol=1e-7)
    one = fit_glm(df.withColumn("e", F.exp("a")), "y", [], "poisson", exposure="e")
    assert one.coef[0] == pytest.approx(np.log(Y.sum() / np.exp(A[:, 0]).sum()))
    twice = fit_glm(df.withColumn("w", F.lit(2.0)), "y", ["a"], "quasipoisson", freq_weights="w")
    once = fit_glm(df, "y", ["a"], "quasipoisson")
    np.testing.assert_allclose(twice.coef, once.coef, atol=1e-9)


def test_names_are_anchored():
    f = Fit(["cb2_v1_l1", "cb_v1_l2", "cb_v1_l1", "x"], np.arange(4.0), np.eye(4))
    assert f.select("cb", "cb", 2)[0].tolist() == [2, 1]
    assert f.select("x", "one", 1)[0].tolist() == [3]
    with pytest.raises(ValueError, match="match"):
        f.select("cb", "cb", 3)


def test_tsqr_keeps_the_alias_test(df, spark):
    x = np.column_stack([A, A[:, 0] + A[:, 1], A[:, 0] + 1e-3 * rng.normal(size=N)])
    rows = spark.createDataFrame([tuple(map(float, v)) for v in x], "p double, q double, r double, s double").repartition(7)
    assert aliased(triangular(rows, list("pqrs"))) == aliased(x) == [2]
    np.testing.assert_allclose(gram(rows, list("pqrs")), x.T @ x, rtol=1e-10)


def brute_stratum(case, x, beta):
    m = int(case.sum())
    sets = [sum(x[i] for i in s) for s in itertools.combinations(range(len(x)), m)]
    w = np.exp([s @ beta for s in sets])
    p = w / w.sum()
    mean = sum(a * s for a, s in zip(p, sets, strict=True))
    var = sum(a * np.outer(s, s) for a, s in zip(p, sets, strict=True)) - np.outer(mean, mean)
    own = x[case == 1].sum(0)
    return own @ beta - np.log(w.sum()), own - mean, var


@pytest.mark.parametrize("m", [1, 2, 3])
def test_stratum_against_enumeration(m):
    x, beta = rng.normal(size=(7, 2)), np.array([0.4, -0.7])
    case = np.r_[np.ones(m), np.zeros(7 - m)]
    for a, b in zip(stratum_terms(case, x, beta), brute_stratum(case, x, beta), strict=True):
        np.testing.assert_allclose(a, b, atol=1e-10)


def test_clogit_recovers_and_drops(spark):
    rows = []
    for s in range(150):
        x = rng.normal(size=(4, 2))
        p = np.exp(x @ [0.8, -0.5])
        c = rng.choice(4, p=p / p.sum())
        rows += [(s, int(i == c), float(a), float(b)) for i, (a, b) in enumerate(x)]
    rows += [(999, 0, 1.0, 1.0), (0, 0, None, 1.0)]
    fit = fit_clogit(spark.createDataFrame(rows, "s int, case int, a double, b double"), "case", ["a", "b"], "s")
    assert np.abs(fit.coef - [0.8, -0.5]).max() < 0.4
    assert fit.n_dropped == 2
    data = np.array([r for r in rows[:-2]], float)
    score = sum(brute_stratum(d[:, 1], d[:, 2:], fit.coef)[1] for d in np.split(data, 150))
    np.testing.assert_allclose(score, 0, atol=1e-5)


def test_penalised_fit_at_fixed_parameters(spark):
    x = rng.uniform(0, 10, 300)
    y = rng.poisson(np.exp(1 + np.sin(x)))
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "t int, x double, y int")
    cb = cross_basis_of(x, 0, {"fun": "ps", "df": 9})
    rows = with_cross_basis(df, "x", cb, "t")
    pen = cross_penalty(cb)
    fit = fit_penalized(rows, "y", cb.names(), {"cb": pen}, "poisson", sp=[5.0])
    m = np.column_stack([np.ones(300), cb.var(x)])
    s = np.zeros((10, 10))
    s[1:, 1:] = 5 * pen["parts"]["Svar"]
    b = np.r_[np.log(y.mean()), np.zeros(9)]
    for _ in range(60):
        mu = np.exp(m @ b)
        b = b + np.linalg.solve((m * mu[:, None]).T @ m + s, m.T @ (y - mu) - s @ b)
    np.testing.assert_allclose(fit.coef, b, atol=1e-6)
    inv = np.linalg.inv((m * mu[:, None]).T @ m + s)
    np.testing.assert_allclose(fit.vcov, inv, atol=1e-6)
    assert edf_by(fit, "cb") == pytest.approx(np.trace(inv @ (m * mu[:, None]).T @ m) - np.diag(inv @ (m * mu[:, None]).T @ m)[0], abs=1e-5)
    free = fit_penalized(rows, "y", cb.names(), {"cb": pen}, "poisson")
    assert free.extra["converged"]
    for sp in (0.01, 1e4):
        assert free.extra["reml"] <= fit_penalized(rows, "y", cb.names(), {"cb": pen}, "poisson", sp=[sp]).extra["reml"] + 1e-6


def test_two_stage(spark):
    from tidelag.sources.datasets import simulate_cities

    cities = simulate_cities(spark, 4, 400)
    cb = cross_basis_of(np.linspace(-5, 35, 100), 5, {"fun": "poly", "degree": 2}, {"fun": "lin"})
    rows = with_cross_basis(cities, "tmean", cb, "time", "city")
    got = fit_groups(rows, "city", "y", cb, cb.names())
    c, v = stacked(got)
    assert c.shape == (4, 2)
    one = fit_glm(rows.where("city = 2"), "y", cb.names())
    m = np.kron(np.eye(2), cb.weights.sum(0)[None, :])
    own = got.where("city = 2").first()
    np.testing.assert_allclose(own.coef, m @ one.select("cb", "cb", 4)[0], atol=1e-8)
    mean, cov, psi = pooled(c, v)
    assert np.isfinite(mean).all()
    assert (np.linalg.eigvalsh(cov) > 0).all()
    assert (np.linalg.eigvalsh(psi) > -1e-8).all()


def test_criteria(df, spark):
    fit = fit_glm(df, "y", ["a"])
    rows = fitted(df, fit)
    ll = poisson_loglik(rows, "y", "mu")
    import math

    mu = np.exp(fit.coef[0] + fit.coef[1] * A[:, 0])
    assert ll == pytest.approx(sum(y * math.log(m) - m - math.lgamma(y + 1) for y, m in zip(Y, mu, strict=True)) + (math.log(math.exp(fit.coef[0])) * 0))
    assert qaic(fit, rows, "y", "mu") == pytest.approx(-2 * ll + 2 * fit.scale * 2)
    out = model_grid(spark, {"p": {"terms": ["a"]}, "q": {"terms": ["b"]}}, lambda terms: fit_glm(df, "y", terms), lambda f: f.deviance).collect()
    assert out[0].delta == 0
    assert out[1].delta > 0


def test_strata_at_once_equal_strata_one_by_one():
    from tidelag.operators.clogit import batch_terms

    size, rows = np.array([3, 5, 4, 2, 6]), []
    for n, m in zip(size, (1, 2, 1, 1, 3), strict=True):
        rows.append(np.column_stack([np.r_[np.ones(m), np.zeros(n - m)], rng.normal(size=(n, 2))]))
    beta = np.array([0.3, -0.2])
    want = sum(np.concatenate([[ll], s, i.ravel()]) for ll, s, i in (stratum_terms(r[:, 0], r[:, 1:], beta) for r in rows))
    got = batch_terms(np.vstack(rows), size, beta)
    assert got[0] == 20
    np.testing.assert_allclose(got[1:], want, atol=1e-10)


def test_link_names():
    from tidelag.operators.glm import link_of

    assert link_of(Fit([], np.zeros(0), np.zeros((0, 0)), "logit")) == "logit"
    assert link_of(type("M", (), {"link": "CLogLog"})()) == "cloglog"
    assert link_of(object()) is None


def penalised_problem(spark, family, n=250):
    r = np.random.default_rng(12)
    x = r.uniform(0, 10, n)
    y = r.poisson(np.exp(1 + np.sin(x))).astype(float) if family != "gaussian" else np.sin(x) + r.normal(size=n) * 0.4
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "t int, x double, y double")
    cb = cross_basis_of(x, 0, {"fun": "ps", "df": 9})
    return x, y, with_cross_basis(df, "x", cb, "t"), cb, cross_penalty(cb)


def test_reml_of_a_gaussian_model_is_its_marginal_likelihood(spark):
    """With a normal prior on penalised coefficients and a flat one on the others, integrated out exactly."""
    x, y, rows, cb, pen = penalised_problem(spark, "gaussian")
    m = np.column_stack([np.ones(len(x)), cb.var(x)])
    s = np.zeros((m.shape[1],) * 2)
    s[1:, 1:] = pen["parts"]["Svar"]
    ev, u = np.linalg.eigh(s)
    bent = ev > 1e-9
    z, f = m @ u[:, bent] / np.sqrt(ev[bent]), m @ u[:, ~bent]
    for method in ("reml", "ml"):
        got = {sp: fit_penalized(rows, "y", cb.names(), {"cb": pen}, "gaussian", method, sp=[sp]) for sp in (0.1, 3.0)}
        want = {}
        for sp, fit in got.items():
            phi = fit.extra["reml_scale"]
            v = phi * (np.eye(len(y)) + z @ z.T / sp)
            iv = np.linalg.inv(v)
            b = np.linalg.solve(f.T @ iv @ f, f.T @ iv @ y)
            e = y - f @ b
            want[sp] = (e @ iv @ e + np.linalg.slogdet(v)[1]) / 2 + (np.linalg.slogdet(f.T @ iv @ f)[1] / 2 if method == "reml" else 0)
        assert got[3.0].extra["reml"] - got[0.1].extra["reml"] == pytest.approx(want[3.0] - want[0.1], abs=1e-6)


@pytest.mark.parametrize("family", ["poisson", "quasipoisson", "gaussian"])
def test_chosen_smoothing_is_a_minimum(spark, family):
    _, _, rows, cb, pen = penalised_problem(spark, family)
    fit = fit_penalized(rows, "y", cb.names(), {"cb": pen}, family)
    (best,) = fit.extra["sp"].values()
    assert fit.extra["converged"] and fit.extra["edf_total"] == pytest.approx(fit.extra["edf"].sum())
    for factor in (0.8, 1.25):
        other = fit_penalized(rows, "y", cb.names(), {"cb": pen}, family, sp=[best * factor])
        assert other.extra["reml"] >= fit.extra["reml"] - 1e-7


def test_penalised_start_where_an_unpenalised_fit_diverges(spark):
    r = np.random.default_rng(4)
    x = r.gamma(2, 3, 300)
    y = r.poisson(0.01, 300)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "t int, x double, y int")
    cb = cross_basis_of(x, 2, {"fun": "ps", "df": 6}, {"fun": "ps", "df": 5})
    fit = fit_penalized(with_cross_basis(df, "x", cb, "t"), "y", cb.names(), {"cb": cross_penalty(cb)}, "poisson", sp=[1.0, 1.0])
    assert np.isfinite(fit.coef).all() and np.isfinite(fit.extra["reml"])


def test_models_of_ones_own():
    from types import SimpleNamespace

    from tidelag.operators.glm import fit_of, link_of

    class Log:
        pass

    cb = cross_basis_of(np.linspace(0, 10, 60), (0, 3), {"fun": "poly", "degree": 2}, {"fun": "lin"})
    c = np.random.default_rng(1).normal(size=cb.columns)
    v = np.diag(np.abs(c) + 0.1)
    names = ["Intercept", *cb.names("cb"), *cb.names("cb2")]
    whole = np.concatenate([[9], c, c + 5])
    cov = np.zeros((len(names), len(names)))
    cov[1 : 1 + len(c), 1 : 1 + len(c)] = v
    own = SimpleNamespace(params=pd.Series(whole, index=names), cov_params=lambda: cov, model=SimpleNamespace(family=SimpleNamespace(link=Log())))
    a = predict(cb, own, cen=5.0, at=[2, 8])
    b = predict(cb, coef=c, vcov=v, link="log", cen=5.0, at=[2, 8])
    np.testing.assert_allclose(a.all_fit, b.all_fit)
    np.testing.assert_allclose(a.all_se, b.all_se)
    assert a.is_exp
    assert fit_of(SimpleNamespace(params={"x": 1.0}, vcov=[[2.0]], link="cloglog")).link == "cloglog"
    assert link_of(type("Poisson", (), {})()) == "log" and link_of(type("OLS", (), {})()) == "identity" and link_of(object()) is None
    for bad, error in ((SimpleNamespace(), TypeError), (SimpleNamespace(params=[1.0], vcov=[[1.0]]), ValueError), (SimpleNamespace(params={"x": 1.0}), TypeError)):
        with pytest.raises(error):
            fit_of(bad)


def test_pooling_with_moderators():
    r = np.random.default_rng(3)
    z = np.column_stack([np.ones(60), r.normal(size=60)])
    truth = np.array([[1.0, -2.0], [0.5, 0.0]])  # of each moderator
    vcov = [np.eye(2) * 0.01 for _ in range(60)]
    coef = z @ truth + r.normal(size=(60, 2)) * np.sqrt(0.01 + 0.04)
    for method in ("reml", "ml"):
        mean, v, psi = pooled(coef, vcov, 2000, z, method)
        np.testing.assert_allclose(mean.reshape(2, 2), truth, atol=0.12)
        np.testing.assert_allclose(np.diag(psi), 0.04, rtol=0.6)
        assert v.shape == (4, 4)
    assert np.trace(pooled(coef, vcov, 2000, z, "ml")[2]) < np.trace(pooled(coef, vcov, 2000, z)[2])
    one = pooled(coef, vcov)
    np.testing.assert_allclose(one[0], pooled(coef, vcov, moderators=np.ones(60))[0])
    with pytest.raises(ValueError, match="method"):
        pooled(coef, vcov, method="x")
