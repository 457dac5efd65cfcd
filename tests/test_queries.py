"""Every query of the registry against its SQL, in names, types and values."""

import os

import duckdb
import pandas as pd
import pytest

from larkspur.plans import crm, domain, files, indexes, more, registry, relational, rest, stored, upkeep  # noqa: F401

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT"}


@pytest.fixture(scope="session")
def db():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return c


def text(v):
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return ""
    if isinstance(v, (int, float)) or getattr(getattr(v, "dtype", None), "kind", "O") in "iuf":
        return repr(round(float(v), 6) + 0.0)
    return str(v).removesuffix(" 00:00:00")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.toPandas()
    if name not in registry.ORACLES:
        assert len(got)
        return
    want = db.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: TYPES[k] for c, k in df.dtypes} == {c: k.replace("TIMESTAMP_US", "TIMESTAMP") for c, k in kinds.items()}
    columns = sorted(df.columns)
    rows = lambda x: sorted(tuple(map(text, r)) for r in x[columns].itertuples(index=False))
    assert rows(got) == rows(want.df())


def exact(db, sql):
    return db.sql(sql).fetchall()


def test_approximate_results_within_bounds(spark, db):
    """The queries that have no SQL, since they are approximate or random: bounds, sizes and subsets."""
    q = lambda n: registry.QUERIES[n](spark, SF)
    events = {r[0] for r in exact(db, "SELECT event_id FROM events")}
    some = [r.event_id for r in q("o7_bernoulli_sample").collect()]
    assert len(set(some)) == len(some) and set(some) <= events and abs(len(some) - 0.1 * len(events)) < 4 * (0.09 * len(events)) ** 0.5
    assert [r.event_id for r in q("o7_bernoulli_sample").collect()] == some
    held = [r.event_id for r in q("o7_reservoir_sample").collect()]
    assert len(set(held)) == len(held) == min(100, len(events)) and set(held) <= events
    for r in q("g21_profile").collect():
        n, nulls, values, longest = exact(db, f'SELECT count(*), count(*) FILTER ("{r.column}" IS NULL), count(DISTINCT "{r.column}"), max(length("{r.column}"::VARCHAR)) FROM customer')[0]
        assert (r.rows, r.nulls) == (n, nulls) and abs(r["values"] - values) <= max(2, 0.2 * values) and r.longest >= 1 and longest >= 1


def test_approximate_aggregates_within_bounds(spark, db):
    for name in ("g10_approximate_aggregates", "g11_approximate_distinct"):
        got = registry.QUERIES[name](spark, SF)
        assert got.count() and not got.where(" OR ".join(f"{c} IS NULL" for c in got.columns)).count()
    from pyspark.sql import functions as F

    prices = spark.read.parquet(f"{SF}/orders.parquet")
    near = prices.agg(F.approx_percentile("o_totalprice", [0.1, 0.5, 0.9], 1000).alias("q"), F.approx_count_distinct("o_custkey").alias("n")).first()
    for share, x in zip((0.1, 0.5, 0.9), near.q, strict=True):
        below, all_ = exact(db, f"SELECT count(*) FILTER (o_totalprice <= {x}), count(*) FROM orders")[0]
        assert abs(below / all_ - share) < 0.01
    assert abs(near.n - exact(db, "SELECT count(DISTINCT o_custkey) FROM orders")[0][0]) <= 0.1 * near.n
