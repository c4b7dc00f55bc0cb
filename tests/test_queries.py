"""Every query of the core against its SQL on the smallest tables, and the driver's entry points."""



import duckdb
import pandas as pd
import pytest

import __spark_entry__
from terrane import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(None if pd.isna(v) else v for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_sql_agrees(spark, duck, name):
    got, want = rows(core.QUERIES[name](spark, SF).toPandas()), rows(duck.sql(core.ORACLE_SQL[name]).df())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=2e-6)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE_SQL)))
def test_query_runs(spark, name):
    df = core.QUERIES[name](spark, SF)
    assert df.count() > 0


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """The smallest tables with two events of value 0."""
    folder = tmp_path_factory.mktemp("odd")
    c = duckdb.connect()
    c.sql(f"CREATE TABLE events AS SELECT * FROM '{SF}/events.parquet' WHERE event_id < 60")
    c.sql("UPDATE events SET value = 0 WHERE event_id IN (7, 31)")
    c.sql(f"COPY events TO '{folder}/events.parquet'")
    return str(folder), c


@pytest.mark.parametrize("name", ["family_gauss", "loglik_m1_z", "loglik_m2_z", "loglik_sgv_1d", "loglik_y_1d", "table_loglik", "vl_loglik_gauss", "vl_loglik_own_plan"])
def test_sql_agrees_on_zeros(spark, odd, name):
    folder, c = odd
    df, want = core.QUERIES[name](spark, folder), c.sql(core.ORACLE_SQL[name])
    # As text, in which NaN, infinity and null are three things.
    exact = lambda columns, found: sorted([str(dict(zip(columns, r, strict=True))[k]) for k in sorted(columns)] for r in found)
    got = exact(df.columns, df.collect())
    assert got == exact(want.columns, want.fetchall()) and len(got) in (1, 60)


@pytest.mark.parametrize("name", ["w_matrix", "selected_inverse"])
def test_sql_agrees_on_events_at_one_time(spark, tmp_path, name):
    c = duckdb.connect()
    c.sql(f"CREATE TABLE events AS SELECT * FROM '{SF}/events.parquet' WHERE event_id < 60")
    c.sql("UPDATE events SET ts = (SELECT ts FROM events WHERE event_id = 5) WHERE event_id IN (9, 20)")
    c.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    got, want = rows(core.QUERIES[name](spark, str(tmp_path)).toPandas()), rows(c.sql(core.ORACLE_SQL[name]).df())
    assert got == want and len(got) == 119


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())



@pytest.mark.parametrize("name", ["estimate", "predict_fitted"])
def test_searches_end_by_convergence(spark, name):
    got = core.QUERIES[name](spark, SF).select("evaluations", "converged").distinct().collect()
    assert [r.converged for r in got] == [True] and got[0].evaluations > 101
