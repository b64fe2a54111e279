"""Every query with SQL against DuckDB on the smallest tables; the others for rows."""

import duckdb
import pytest

from claimweave.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
EMPTY = {"delete_all"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name == "shortest_path":
        pytest.skip("its target isn't in the smallest table")
    df = QUERIES[name](spark, SF)
    rows = sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect())
    if name in ORACLES:
        got = duck.execute(ORACLES[name])
        order = sorted(range(len(got.description)), key=lambda i: got.description[i][0])
        assert sorted(got.description[i][0] for i in order) == sorted(df.columns)
        assert rows == sorted(repr([r[i] for i in order]) for r in got.fetchall())
    else:
        assert rows or name in EMPTY
