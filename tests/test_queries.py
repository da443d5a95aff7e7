"""Every query with an SQL formulation, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from speechlytics.plans.oracle import ORACLE
from speechlytics.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def test_all_have_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    found = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    result = db.execute(ORACLE[name])
    heads = [c[0] for c in result.description]
    assert sorted(heads) == names
    assert found == sorted((tuple(r[heads.index(c)] for c in names) for r in result.fetchall()), key=repr)
