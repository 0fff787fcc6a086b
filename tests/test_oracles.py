"""Every registered query of the library against its SQL, at the smallest scale."""

import pytest

from lodestone import plans
from test_brute_force import COVERED
from tools.compare import compared

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    said = compared(spark, name, DIR)
    assert ": ok," in said or (name in COVERED and "no SQL" in said), said


def test_every_query_is_checked():
    """A query has SQL, or a brute-force test."""
    assert set(plans.QUERIES) - set(plans.ORACLE_SQL) <= COVERED


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["query_id", "doc_id", "score", "rank"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
