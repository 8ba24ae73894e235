"""Each registered query of the engine against its DuckDB statement, and their shape."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from quire.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(df):
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "∅"
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    df = df[sorted(df.columns)]
    return sorted(map(tuple, df.map(cell).to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, db, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), db.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "chunk_id" in df.columns


def test_every_query_is_known(spark):
    assert set(ORACLES) <= set(QUERIES) <= set(__spark_entry__.queries())
    assert set(QUERIES) - set(ORACLES) == {"chunk_markdown"}
