"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from readloom.plans import registry_more  # noqa: F401
from readloom.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def rows(df):
    columns = sorted(df.columns)
    x = df[columns].astype(object).where(df[columns].notna(), None).map(str)
    return columns, sorted(map(tuple, x.to_numpy()))


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees(spark, duck, name):
    got, expected = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert rows(got) == rows(expected)
    assert len(got)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count()


def test_mixture_is_a_minimum(spark):
    got = QUERIES["mixture_solve"](spark, SF).toPandas()
    assert abs(got["pred"].sum() - 1) < 1e-3
    from readloom.operators import labels
    from readloom.plans import likelihood, registry

    m = labels.margins(registry.v_reads(spark, SF))
    best = got["nll"].sum()
    for shift in ((0.05, -0.05, 0), (-0.05, 0, 0.05), (0, 0.05, -0.05)):
        t = {k: p + d for k, p, d in zip(got["cell_type"], got["pred"], shift)}
        assert likelihood.class_likelihood(registry.scored(spark, SF), m, t).toPandas()["nll"].sum() > best
