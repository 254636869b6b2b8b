"""Names of splits with more than 100 000 rows."""

import duckdb

from parallaxis.plans import measures


def test_numbers_of_six_digits_stay_whole(spark, tmp_path):
    duckdb.sql("SELECT i::BIGINT AS o_orderkey FROM range(1, 100101) r(i)").write_parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    want = con.sql(measures.ORACLE["split_names"]).fetchall()
    got = [tuple(r) for r in measures.split_names(spark, str(tmp_path)).select("id", "split", "name").collect()]
    assert sorted(got) == sorted(want)
    assert max(len(n) for _, _, n in want) == len("train_100000")
