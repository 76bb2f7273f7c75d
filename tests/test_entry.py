import os

import __spark_entry__ as entry
from orderly.plans import catalog


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() == 5
