"""Every registered query of the document operators against its SQL, or at least run, on the smallest tables."""

import pytest

from corpusloom.plans import catalogue
from tests.conftest import SF, same_rows


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    df = catalogue.queries()[name](spark, SF)
    if name in catalogue.oracle_sql():
        same_rows(df, catalogue.oracle_sql()[name])
    else:
        assert df.collect() is not None and df.columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
