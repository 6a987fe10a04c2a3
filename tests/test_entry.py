import __spark_entry__ as E


def test_names_and_sql_agree():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100


def test_flagship(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"node_id", "tier", "hops"}
