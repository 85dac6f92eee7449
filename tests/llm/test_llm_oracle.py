"""The queries of operators that SQL can express give the rows that DuckDB gives."""

import duckdb
import pytest

from parlance.llm import registry

TABLES = ("documents", "pages", "labels", "benchmark", "embeddings", "conversations")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, sf_dir, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = c.execute(registry.ORACLE_SQL[name])
    columns = sorted(d[0] for d in got.description)
    place = [[d[0] for d in got.description].index(x) for x in columns]
    df = registry.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == columns
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted((tuple(plain(r[i]) for i in place) for r in got.fetchall()), key=repr)
    assert sorted((tuple(plain(r[x]) for x in columns) for r in df.collect()), key=repr) == want
