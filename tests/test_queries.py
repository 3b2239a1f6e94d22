"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from veldspar.plans.stage_queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = con.execute(SQL[name])
    at = {d[0]: k for k, d in enumerate(want.description)}
    assert sorted(at) == cols
    assert got == sorted((tuple(plain(r[at[c]]) for c in cols) for r in want.fetchall()), key=repr)


def test_isotonic_steps_are_the_least_squares_fit(spark):
    import random

    from pyspark.sql import functions as F

    from veldspar.operators.evaluation import isotonic

    r = random.Random(1)
    rows = [("k", float(r.randrange(30)), float(r.random() < 0.02 * x)) for x in range(40)]
    steps = sorted((s.x_start, s.p) for s in isotonic(spark.createDataFrame(rows, "k string, x double, y double"), F.col("x"), F.col("y"), ["k"]).collect())
    assert all(a[1] < b[1] for a, b in zip(steps, steps[1:]))
    # min-max formula of the isotonic fit at each x
    xs = sorted({x for _, x, _ in rows})
    mean = lambda lo, hi: (lambda v: sum(v) / len(v))([y for _, x, y in rows if lo <= x <= hi])
    for x in xs:
        want = max(min(mean(a, b) for b in xs if b >= x) for a in xs if a <= x)
        assert abs([p for s, p in steps if s <= x][-1] - want) < 1e-9


def test_bootstrap_is_steady_and_covers(spark):
    from pyspark.sql import functions as F

    from veldspar.operators.evaluation import bootstrap

    df = spark.range(300).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 10 == 1, -1).otherwise(0).alias("d"))
    a, b = bootstrap(df, F.col("d")).collect()[0], bootstrap(df, F.col("d")).collect()[0]
    assert a == b and a.lo < a["diff"] < a.hi and 0.05 < a.hi - a.lo < 0.25
    assert bootstrap(df.limit(0), F.col("d")).count() == 0
