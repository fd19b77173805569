import duckdb
import pytest

from cartulary.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, small, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{small.dir}/documents.parquet')")
    result = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    want = sorted(result.fetchall(), key=repr)
    df = queries.QUERIES[name](spark, small.dir)
    assert sorted(columns) == sorted(df.columns) and want
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want
