"""The queries that SQL can express, against it."""

import duckdb
import pytest

from quarry.llm import queries

SF = "/root/testdata/sf0.001"


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(str, frame.astype(object).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, expected = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns) and _rows(got) == _rows(expected)
