import __spark_entry__ as E
from feedlake.plans.catalog import registry


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["section", "key", "n", "value", "text", "rank"]


def test_every_query_has_oracle_or_reason():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 40
    # every job on the reference's own operators is SQL-expressible
    assert set(registry()) <= set(o)
