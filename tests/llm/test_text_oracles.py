"""Queries with SQL against DuckDB."""

import duckdb
import pytest

from parallaxis.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    norm = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(norm(r[i]) for i in order) for r in want.fetchall()), key=repr)


def test_warc_query(spark):
    import base64
    import hashlib

    rows = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    top = {}
    for i, x in rows:
        top[x] = max(top.get(x, i), i)
    want = sorted((i, len(x), base64.b32encode(hashlib.sha1(x).digest()).decode(), "response" if top[x] == i else "revisit", None if top[x] == i else top[x]) for i, x in rows)
    assert sorted(map(tuple, queries.op5_warc_index(spark, SF).collect())) == want
