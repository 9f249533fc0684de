"""Scans of more than one block: plans stay small, results stay those of SQL."""

import os
import random

import pytest
from pyspark.sql import functions as F

from embertide.operators import replay, scan
from embertide.sources.logs import LOG_SCHEMA
from tests.test_plans import QUERIES, SF, duck, rows_of  # noqa: F401

TABLES = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


def leaves(df):
    """Scans in the plan of df."""
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


@pytest.fixture
def small_blocks(monkeypatch):
    blocked = scan.blocked
    monkeypatch.setattr(scan, "blocked", lambda df, order, name, rows=0, span=None: blocked(df, order, name, 100, span))


def test_running_values_of_a_log_share_a_scan(spark, small_blocks):
    """One after another, five scans in blocks would hold the log 32 times."""
    log = spark.range(1, 1001).withColumnRenamed("id", "ord").select("ord", *(F.lit(None).cast(f.dataType).alias(f.name) for f in LOG_SCHEMA))
    assert leaves(replay.clock(log)) == 2


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_sums_that_share_a_scan(spark, keys):
    r = random.Random(3)
    rows = [(o, r.randrange(3), r.choice([None, r.randrange(-(10**30), 10**30)]), r.randrange(9)) for o in sorted(r.sample(range(5000), 700))]
    df = spark.createDataFrame([(o, k, None if a is None else str(a), b) for o, k, a, b in rows], "o long, k int, a string, b int").withColumn("a", F.col("a").cast("decimal(38,0)"))
    got = scan.running_sums(df, "o", {"x": (F.coalesce("a", F.lit(0).cast("decimal(38,0)")), "decimal(38,0)"), "y": (F.col("b"), "bigint")}, 50, keys)
    assert set(got.columns) == {"o", "k", "a", "b", "x", "y"} and dict(got.dtypes)["y"] == "bigint"
    upto = lambda at, o, k: sum(row[at] or 0 for row in rows if row[0] <= o and (not keys or row[1] == k))
    assert sorted((x.o, int(x.x), x.y) for x in got.collect()) == [(o, upto(2, o, k), upto(3, o, k)) for o, k, _, _ in rows]


def in_blocks(spark, duck, name, most):  # noqa: F811
    run, sql = QUERIES[name]
    df = run(spark, SF)
    assert leaves(df) <= most
    want = duck.sql(sql)
    assert rows_of(df.collect(), df.columns) == rows_of(want.fetchall(), want.columns)


@TABLES
def test_explain_row_in_blocks(spark, duck, small_blocks):  # noqa: F811
    in_blocks(spark, duck, "explain_row", 16)


@TABLES
def test_verify_samples_in_blocks(spark, duck, small_blocks):  # noqa: F811
    in_blocks(spark, duck, "verify_samples", 40)
