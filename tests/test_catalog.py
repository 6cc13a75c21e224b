"""Every query of the library proper against its SQL, or for its shape."""

import pytest

from laurel import catalog

from .compare import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    got = spark_rows(catalog.QUERIES[name](spark, sf))
    if name in catalog.ORACLE_SQL:
        assert got == duck_rows(duck, catalog.ORACLE_SQL[name])
    else:
        assert got[0] and got[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
