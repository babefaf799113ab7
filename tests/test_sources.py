import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelag.functions.basis import Data, fit_basis
from tidelag.operators.crossbasis import cross_basis_of
from tidelag.plans import plots, recipes
from tidelag.plans.workflow import fit_lag_model
from tidelag.sources import datasets, series
from tidelag.streaming.scoring import score_lags, score_stream

FOLDER = "/root/testdata/sf0.001"


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("day,x,w1,w2\n2020-01-02,1.5,3,4\n2020-01-03,NA,5,6\n")
    df = datasets.read_csv(spark, f"{tmp_path}/a.csv", ("day",))
    rows = df.orderBy("day").collect()
    assert rows[0].day == datetime.date(2020, 1, 2)
    assert rows[1].x is None
    got = datasets.trial_histories(df, "day", ["w1", "w2"], 2).orderBy("day").collect()
    assert got[0].history == [4, 4, 3, 3]


def test_series(spark):
    d = series.daily(spark, FOLDER)
    assert d.select(F.min("t")).first()[0] == 0
    assert d.agg(F.sum("y")).first()[0] == series.table(spark, FOLDER, "lineitem").count()
    assert set(series.daily_grouped(spark, FOLDER).columns) == {"g", "day", "y", "x", "q"}
    assert series.hourly(spark, FOLDER, True).select("g").distinct().count() == 5
    r = series.risk_sets(spark, FOLDER).groupBy("stratum").agg(F.sum("case").alias("c"), F.count("*").alias("n")).where("c = 0 OR c = n")
    assert r.count() == 0


def test_simulated_cities(spark):
    df = datasets.simulate_cities(spark, 2, 60)
    assert df.where("y IS NULL").count() == 20
    assert df.count() == 120


def test_risk_sets_with_controls(spark):
    follow = spark.createDataFrame([(i, i % 10, 100 + i) for i in range(100)], "id int, enter int, leave int")
    events = spark.createDataFrame([(t,) for t in (105, 150)], "t int")
    every = recipes.risk_sets(follow, "enter", "leave", events, "t")
    assert every.where("t = 150").count() == 50
    some = recipes.risk_sets(follow, "enter", "leave", events, "t", controls=10)
    got = {(r.t, r.case): r.n for r in some.groupBy("t", "case").agg(F.count("*").alias("n")).collect()}
    assert got == {(105, 1): 1, (105, 0): 10, (150, 1): 1, (150, 0): 10}


def test_plot_frames(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 20, 300)
    y = rng.poisson(np.exp(2 + 0.003 * (x - 10) ** 2))
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "t int, x double, y int")
    m = fit_lag_model(df, "y", "x", "t", 2, {"fun": "ns", "df": 3}, {"fun": "lin"}, df_per_year=None)
    s = plots.summary_frames(m, 10.0)
    assert s["slices"].select("at").distinct().count() == 2
    risk = plots.overall_risk(m, 10)
    assert risk["histogram"].agg(F.sum("n")).first()[0] == 300
    assert risk["ticks"].count() == 5
    assert [r.percentile for r in plots.overall_risk(m, 10, (5, 95))["ticks"].orderBy("percentile").collect()] == [5, 95]
    both = plots.slices(spark, m.predict(10.0, at=[5, 15]), [5], [1])
    assert {r.kind for r in both.collect()} == {"var", "lag"}


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1.0, [1.0, 2.0]), (None, None), (7.0, [3.0, 4.0])], "x double, h array<double>").write.parquet(f"{tmp_path}/in")
    b = fit_basis(Data(np.linspace(0, 10, 50)), "ns", df=3)
    cb = cross_basis_of(np.linspace(0, 10, 50), (0, 1), {"fun": "lin"})
    stream = spark.readStream.schema("x double, h array<double>").parquet(f"{tmp_path}/in")
    out = score_stream(stream, "x", b, cb, "h")
    q = out.writeStream.format("memory").queryName("scored").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(60)
    got = {r.x: r for r in spark.table("scored").collect()}
    np.testing.assert_allclose([got[7.0].b_b1, got[7.0].b_b2, got[7.0].b_b3], b([7.0])[0])
    assert got[1.0].cb_v1_l1 == 3
    assert got[None].cb_v1_l1 is None


def test_lags_on_a_stream(spark, tmp_path):
    r = np.random.default_rng(6)
    cb = cross_basis_of(np.linspace(0, 10, 50), (1, 3), {"fun": "ns", "df": 2}, {"fun": "lin"})
    coef = r.normal(size=cb.columns)
    series_of = {g: r.uniform(0, 10, 9) for g in "ab"}
    schema = "g string, t long, x double"
    for k, part in enumerate((range(0, 4), range(4, 9))):
        rows = [(g, t, float(series_of[g][t])) for g in "ab" for t in part]
        rows += [("a", 2, 5.0)] if k else []  # late
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = score_lags(stream, "g", "t", "x", cb, coef, 4.0).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(90)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sum(x.late for x in got) == 1
    ref = cb.matrix(np.full((1, 3), 4.0))[0]
    for row in got:
        if row.late or row.t < 3:
            assert row.eta is None
        else:
            past = series_of[row.g][row.t - 3 : row.t][::-1]
            np.testing.assert_allclose(row.eta, (cb.matrix(past[None, :])[0] - ref) @ coef, atol=1e-9)


def test_trend_preserving_correction(spark):
    days = pd.date_range("2001-01-01", "2003-12-31")
    r = np.random.default_rng(2)
    s = 10 + 8 * np.sin(np.arange(len(days)) / 58) + r.normal(size=len(days))
    o = 1.3 * s + 2 + r.normal(size=len(days))
    df = spark.createDataFrame([(d.date(), float(a), float(b)) for d, a, b in zip(days, o, s, strict=True)], "day date, o double, s double").repartition(3)
    shift, slope = recipes.month_corrections(df, "day", "o", "s")
    f = pd.DataFrame({"o": o, "s": s, "m": days.month, "k": days.year * 100 + days.month, "d": days.day})
    res = f[["o", "s"]] - f.groupby("k")[["o", "s"]].transform("mean")
    for m in range(1, 13):
        at = (f.m == m).to_numpy()
        a, b = np.sort(res.s[at]), np.sort(res.o[at])
        np.testing.assert_allclose([shift[m - 1], slope[m - 1]], [f.o[at].mean() - f.s[at].mean(), (a * b).sum() / (a * a).sum()], rtol=1e-9)
    got = [x.corrected for x in recipes.trend_preserving(df, "day", "s", shift, slope).orderBy("day").collect()]
    n, mean = f.groupby("k").s.transform("size"), f.groupby("k").s.transform("mean")
    p = ((f.d - 1) / (n - 1) - 0.5).to_numpy()
    c, b, i = np.array(shift), np.array(slope), f.m.to_numpy() - 1
    to = np.where(p < 0, (i + 11) % 12, (i + 1) % 12)
    blend = lambda v: (1 - np.abs(p)) * v[i] + np.abs(p) * v[to]
    np.testing.assert_allclose(got, mean + blend(c) + (f.s - mean) * blend(b), rtol=1e-9)
    with pytest.raises(ValueError, match="months"):
        recipes.month_corrections(df.where("month(day) < 12"), "day", "o", "s")


def test_period_sums(spark):
    df = spark.createDataFrame([(datetime.date(1999, 5, 1), 1.0, 5.0), (datetime.date(2001, 5, 1), 2.0, 30.0), (datetime.date(2009, 5, 1), 4.0, 5.0)], "day date, an double, x double")
    every = recipes.period_sums(df, "day", ["an"]).orderBy("period").collect()
    assert [tuple(r) for r in every] == [(1990, 1.0), (2000, 6.0)]
    heat = recipes.period_sums(df, "day", ["an"], when=F.col("x") > 20).orderBy("period").collect()
    assert [tuple(r) for r in heat] == [(1990, 0.0), (2000, 2.0)]
