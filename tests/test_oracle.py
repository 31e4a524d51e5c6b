"""Every registered query against its SQL at the smallest scale."""

import pytest

from tests.conftest import TINY
from verification.check import compare
from verification.oracle import ORACLE
from verification.queries import QUERIES


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    assert compare(spark, db, TINY, name) is None
