"""Every query of the library against its SQL."""

import pytest

from helixframe import queries as library
from tests.oracle import assert_same

library.load_all()
FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(library.SQL))
def test_query(spark, name):
    assert_same(spark, FOLDER, library.QUERIES[name], library.SQL[name])


def test_entry_and_names(spark):
    import __spark_entry__ as e

    known, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(known) and e.entry(spark).count() > 0
