import duckdb
import pytest

from tidelag.plans import catalog

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(str(tuple(r[c] for c in columns)) for r in df.collect())
    assert rows
    if name in catalog.oracle_sql():
        got = con.execute(catalog.oracle_sql()[name])
        names = [c[0] for c in got.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert rows == sorted(str(tuple(r[i] for i in at)) for r in got.fetchall())


def test_one_window_serves_all_lags(spark):
    plan = catalog.queries()["crossbasis_poly_strata"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1


def test_risk_sets_at_all_event_days(spark, con):
    days: dict = {}
    for cust, t in con.execute("SELECT o_custkey, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) FROM orders").fetchall():
        days.setdefault(cust, set()).add(t)
    spans = [(min(x), max(x)) for x in days.values() if len(x) > 1]
    want = {}
    for t in set().union(*days.values()):
        inside = [b for a, b in spans if a < t <= b]
        if inside:
            want[t] = (len(inside), inside.count(t))
    got = {r.riskset: (r.at_risk, r.cases) for r in catalog.queries()["risk_set_split"](spark, FOLDER).collect()}
    assert got == want
