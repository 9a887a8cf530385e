"""The queries with SQL twins, on the small tables."""

import duckdb
import pytest

from voxframe.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    with duckdb.connect() as con:
        for table in ("documents", "pages", "embeddings"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
        result = con.execute(queries.ORACLES[name])
        columns = [c[0] for c in result.description]
        want = result.fetchall()
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want, key=repr)
