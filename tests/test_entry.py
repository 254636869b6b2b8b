import __spark_entry__


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_counts_points(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(r.points >= 0 for r in rows)
