"""Every query with SQL gives what DuckDB gives on the smallest tables; the others give rows."""

import decimal
import os

import duckdb
import pytest

from embertide.plans import w1_groups, w2_sampling, w3_state, w4_log, w5_batches, w6_experiments, w7_transitions, w8_verify, w9_attested

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PLANS = (w1_groups, w2_sampling, w3_state, w4_log, w5_batches, w6_experiments, w7_transitions, w8_verify, w9_attested)
QUERIES = {n: (f, p.ORACLE.get(n)) for p in PLANS for n, f in p.QUERIES.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    return str(v)


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted("|".join(plain(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    run, sql = QUERIES[name]
    df = run(spark, SF)
    got = df.collect()
    if sql is None:
        assert got
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(got, df.columns) == rows_of(want.fetchall(), want.columns)
